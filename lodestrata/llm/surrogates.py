"""PII surrogates: keyed, type-consistent replacements, distinct and coreferent.

Everything is Spark SQL expressions on each row: matches are found by one
pattern, and each is replaced by a function of a secret key and the entity's
canonical form, so the same entity gets the same surrogate in every document
without a join.

Numbers (addresses, cards, phone and social security numbers) have little room,
so their surrogates are a keyed permutation of each class of numbers that look
alike: distinct by construction, however many there are, and never the number
itself.  E-mail addresses and names are drawn from an endless space; a second
pass over the distinct ones checks that no two of a type share a surrogate and
that no surrogate is itself an entity of the corpus.  The few that clash draw
again, longer in the end, and only documents with those entities are joined
with the table of draws.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import let, release, store, unveiled, veiled

# Titles and given names by gender.
TITLES = {"m": "Mr Mister Sir Herr Monsieur Señor Sr Господин".split(), "f": "Mrs Ms Miss Madam Lady Frau Madame Mme Señora Sra Госпожа".split(), "": "Dr Prof Professor Judge Captain".split()}
GIVEN = {
    ("m", "latin"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew George Kenneth Edward Brian Kevin Timothy Peter Hans Karl Jürgen Wolfgang Pierre Jean Luc José Juan Carlos Luis Miguel".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Betty Sandra Ashley Emily Donna Michelle Laura Helen Anna Ruth Sharon Ursula Ingrid Monika Claire Sophie Camille Marie María Carmen Lucía Isabel Elena".split(),
    ("m", "cyrillic"): "Александр Дмитрий Сергей Андрей Алексей Иван Михаил Николай Павел Юрий Борис Виктор".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Людмила Вера".split(),
}
TITLES = {g: [*own, *map(str.upper, own)] for g, own in TITLES.items()}
SYLLABLES = {"latin": [c + v for c in "bdfgklmnprstvw" for v in "aeiou"][:64], "cyrillic": [c + v for c in "бвгдклмнпрстхш" for v in "аеиоу"][:64]}

_name = r"\p{Lu}[\p{L}'’-]+"
_octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_title = "(?:" + "|".join(t for own in TITLES.values() for t in own) + r")\b\.?"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*(?<=\.[A-Za-z]{2,24})",
    "ip": rf"(?<![0-9.])(?:{_octet}\.){{3}}{_octet}(?!\.?[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4})(?![0-9])",
    "name": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_title} {_name}(?: {_name}){{0,2}}|(?:" + "|".join(n for own in GIVEN.values() for n in own) + rf") {_name})",
}
ALL = "|".join(PATTERNS.values())
#: A cheap first look: texts without any of these hold no entity.
HINT = r"[0-9@]|(?=\p{Lu})(?<!\p{L})(?:" + "|".join(sorted({t for own in [*TITLES.values(), *GIVEN.values()] for t in own})) + ")"

ENTITY = "array<struct<type:string,canon:string>>"


def type_of(hit: Column) -> Column:
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    first = F.substring(hit, 1, 1)
    return (
        F.when(F.contains(hit, F.lit("@")), "email")
        .when(hit.rlike(r"\A[0-9]+(?:\.[0-9]+){3}\z"), "ip")
        .when(hit.rlike(r"\A[0-9]{3}-[0-9]{2}-[0-9]{4}\z"), "ssn")
        .when((digits >= 13) & first.rlike("[0-9]"), "card")
        .when(first.rlike(r"[0-9+(]"), "phone")
        .otherwise("name")
    )


def listed(words) -> Column:
    """An array of words, as one literal."""
    return F.split(F.lit(" ".join(words)), " ")


class Names:
    """How the parts of a name are read, for one key."""

    def __init__(self, key: str):
        self.next = {}
        for (gender, script), names in GIVEN.items():
            ring = sorted(names, key=lambda n: hmac.new(key.encode(), n.encode(), hashlib.sha256).digest())
            self.next |= {n: (ring[(k + 1) % len(ring)], gender, script) for k, n in enumerate(ring)}
        self.gender = {t: g for g, own in TITLES.items() for t in own}

    def lookup(self, word: Column, table: dict[str, str]) -> Column:
        """table[word], null if absent: the tables are fixed and small."""
        at = F.array_position(listed(table), word)
        return F.when(at > 0, F.get(listed(table.values()), (at - 1).cast("int")))

    def parts(self, hit: Column) -> Column:
        """Of each word of a name: type (keep, known, given:m, given:f, given: or family) and canonical form."""
        words = F.split(hit, " ")

        def read(words: Column) -> Column:
            title = self.lookup(F.rtrim(F.get(words, F.lit(0)), F.lit(".")), {t: f"given:{g}" for t, g in self.gender.items()})
            return F.transform(
                words,
                lambda w, i: F.struct(
                    F.when((i == 0) & title.isNotNull(), "keep")
                    .when(self.lookup(w, dict.fromkeys(self.next, "known")).isNotNull(), "known")
                    .when((i == 1) & title.isNotNull() & (F.size(words) > 2), title)
                    .otherwise("family")
                    .alias("type"),
                    F.lower(w).alias("canon"),
                    w.alias("word"),
                ),
            )

        return let(words, read)


def entities(hit: Column, names: Names) -> Column:
    """The (type, canonical form) pairs a match stands for; words of known names need no check, they are permuted."""
    kind = type_of(hit)
    own = F.transform(F.filter(names.parts(hit), lambda p: ~p["type"].isin("keep", "known")), lambda p: F.struct(p["type"].alias("type"), p["canon"].alias("canon")))
    return F.when(kind == "name", own.cast(ENTITY)).otherwise(F.array(F.struct(kind.alias("type"), canonical(kind, hit).alias("canon"))).cast(ENTITY))


def canonical(kind: Column, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9+]", "")
    return F.when(kind == "email", F.regexp_replace(F.lower(hit), r"\A[._+-]+", "")).when(kind == "ip", hit).otherwise(digits)


def noise(key: str, kind: Column, canon: Column, draw: Column) -> Column:
    """64 hex digits for an entity's draw."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, draw.cast("string")), 256)


def byte(h: Column, i: Column) -> Column:
    return F.conv(F.substring(h, (i % 30 * 2 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def recast(text: Column, h: Column) -> Column:
    """text with each letter and digit replaced by one of its kind."""

    def swap(c: Column, i: Column) -> Column:
        draw = byte(h, i)
        pick = lambda own: F.substring(F.lit(own), (draw % len(own) + 1).cast("int"), F.lit(1))
        return F.when(c.rlike("[0-9]"), pick("0123456789")).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), swap), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    each = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(F.transform(F.transform(F.reverse(F.split(digits, "")), lambda c: c.cast("int")), each), F.lit(0), lambda a, x: a + x) % 10


# First octets all of whose addresses are public.
PUBLIC = [k for k in range(1, 224) if k not in (10, 100, 127, 169, 172, 192, 198, 203)]
ROUNDS = 4


def permuted(key: str, tweak: Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """Struct (l, r): the image of (left, right) under a permutation of all pairs below (a, b) without fixed points.

    Four rounds of an alternating Feistel network, in which one half is moved
    by a keyed number that depends on the other, then one step on, then the
    rounds backwards.  Where a and b are 1 there is but one pair.
    """

    def moved(r: Column, x: Column) -> Column:
        h = F.sha2(F.concat_ws("\x1f", F.lit(key), tweak, r.cast("string"), x.cast("string")), 256)
        return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")

    def turn(p: Column) -> Column:
        def step(x: Column, i: Column) -> Column:
            back = i > ROUNDS
            r = F.when(back, 2 * ROUNDS - i).otherwise(i)
            by = lambda half, n: F.when(back, n - half % n).otherwise(half % n)
            on_left = F.struct(((x["l"] + by(moved(r, x["r"]), p["a"])) % p["a"]).alias("l"), x["r"].alias("r"))
            on_right = F.struct(x["l"].alias("l"), ((x["r"] + by(moved(r, x["l"]), p["b"])) % p["b"]).alias("r"))
            one_on = F.struct(F.when(p["b"] == 1, (x["l"] + 1) % p["a"]).otherwise(x["l"]).alias("l"), ((x["r"] + 1) % p["b"]).alias("r"))
            return F.when(i == ROUNDS, one_on).when(r % 2 == 0, on_left).otherwise(on_right)

        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS)), F.struct(p["l"].alias("l"), p["r"].alias("r")), step)

    return let(F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def _number(digits: Column) -> Column:
    return F.when(digits == "", F.lit(0).cast("long")).otherwise(digits.cast("long"))


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def _digits(key: str, tweak: Column, digits: Column) -> Column:
    """Another string of as many digits, below 10^36."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    head, tail = F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, rest)
    return let(permuted(key, tweak, _number(head), _number(tail), _power(half), _power(rest)), lambda x: F.concat(F.lpad(x["l"].cast("string"), half, F.lit("0")), F.lpad(x["r"].cast("string"), rest, F.lit("0"))))


def new_ip(key: str, canon: Column) -> Column:
    """Private addresses stay in their range; public ones stay public; others keep their first two numbers."""

    def make(o: Column) -> Column:
        one, two, low = (F.get(o, 0), F.get(o, 1), F.get(o, 2) * 256 + F.get(o, 3))
        place = F.array_position(listed(map(str, PUBLIC)), one.cast("string")) - 1
        kind = F.when(one == 10, 10).when((one == 172) & two.between(16, 31), 172).when(place >= 0, 1).otherwise(0)
        left = F.when(kind == 10, two).when(kind == 172, two - 16).when(kind == 1, place).otherwise(F.get(o, 2))
        right = F.when(kind.isin(10, 172), low).when(kind == 1, two * 65536 + low).otherwise(F.get(o, 3))
        a = F.when(kind == 172, 16).when(kind == 1, len(PUBLIC)).otherwise(256)
        b = F.when(kind.isin(10, 172), 1 << 16).when(kind == 1, 1 << 24).otherwise(256)
        tweak = F.concat_ws(".", F.lit("ip"), kind.cast("string"), F.when(kind == 0, F.concat_ws(".", one, two)))

        def spell(x: Column) -> Column:
            first = F.when(kind == 1, F.get(listed(map(str, PUBLIC)), x["l"].cast("int")).cast("long")).otherwise(one)
            second = F.when(kind == 10, x["l"]).when(kind == 172, x["l"] + 16).when(kind == 1, F.floor(x["r"] / 65536)).otherwise(two)
            third = F.when(kind == 0, x["l"]).otherwise(F.floor(x["r"] / 256) % 256)
            return F.concat_ws(".", *[y.cast("string") for y in (first, second, third, x["r"] % 256)])

        return let(permuted(key, tweak, left, right, a, b), spell)

    return let(F.transform(F.split(canon, r"\."), lambda x: x.cast("long")), make)


def new_ssn(key: str, canon: Column) -> Column:
    """Parts that are never issued (area 000, 666 and from 900, group 00, serial 0000) stay; the others are permuted."""
    area, group, serial = (F.substring(canon, x, n) for x, n in ((1, 3), (4, 2), (6, 4)))
    n = area.cast("int")
    fine = (~n.isin(0, 666) & (n < 900), group != "00", serial != "0000")
    left = F.when(fine[0], n - 1 - (n > 666).cast("int")).otherwise(0)
    right = F.when(fine[1], group.cast("long") - 1).otherwise(0) * F.when(fine[2], 9999).otherwise(1) + F.when(fine[2], serial.cast("long") - 1).otherwise(0)
    a = F.when(fine[0], 898).otherwise(1)
    b = F.when(fine[1], 99).otherwise(1) * F.when(fine[2], 9999).otherwise(1)
    tweak = F.concat_ws("-", F.lit("ssn"), *[F.when(~ok, part).otherwise("") for ok, part in zip(fine, (area, group, serial), strict=True)])

    def spell(x: Column) -> Column:
        new_area = x["l"] + 1 + (x["l"] >= 665).cast("int")
        new_group = F.floor(x["r"] / F.when(fine[2], 9999).otherwise(1)) + 1
        new_serial = x["r"] % 9999 + 1
        one = lambda ok, new, n, old: F.when(ok, F.lpad(new.cast("string"), n, "0")).otherwise(old)
        return F.concat(one(fine[0], new_area, 3, area), one(fine[1], new_group, 2, group), one(fine[2], new_serial, 4, serial))

    return let(permuted(key, tweak, left, right, a, b), spell)


def new_card(key: str, canon: Column) -> Column:
    """The first digit stays, and so does the difference of the last one from the right check digit."""
    n = F.length(canon)
    first, middle, last = F.substring(canon, 1, 1), F.substring(canon, F.lit(2), n - 2), F.substring(canon, n, F.lit(1)).cast("int")
    check = lambda body: (10 - luhn(F.concat(body, F.lit("0")))) % 10
    off = (last - check(F.concat(first, middle)) + 10) % 10
    tweak = F.concat_ws("-", F.lit("card"), first, off.cast("string"))
    return let(F.concat(first, _digits(key, tweak, middle)), lambda body: F.concat(body, ((check(body) + off) % 10).cast("string")))


def new_phone(key: str, canon: Column) -> Column:
    """+ and the country's code stay, and a next digit from 2 to 9 stays in that range, so the form stays a number one can dial."""
    code = F.when(F.startswith(canon, F.lit("+")), F.greatest(F.lit(2), F.length(canon) - 10)).otherwise(0).cast("int")
    head, first, rest = F.substring(canon, F.lit(1), code), F.substring(canon, code + 1, F.lit(1)), F.substring(canon, code + 2, F.length(canon))
    dialled = first >= "2"
    n = F.length(rest)
    tweak = F.concat_ws("-", F.lit("phone"), head, F.when(~dialled, first))
    image = permuted(key, tweak, F.when(dialled, first.cast("int") - 2).otherwise(0), _number(rest), F.when(dialled, 8).otherwise(1), _power(n))
    return let(image, lambda x: F.concat(head, F.when(dialled, (x["l"] + 2).cast("string")).otherwise(first), F.when(n > 0, F.lpad(x["r"].cast("string"), n, F.lit("0"))).otherwise("")))


#: Types whose surrogates are permutations.
PERMUTED = ("ip", "card", "ssn", "phone")


def surrogate(key: str, kind: Column, canon: Column, draw: Column, names: Names) -> Column:
    """The canonical form of an entity's surrogate."""
    # Where a short form's space runs out, later draws grow longer.
    longer = F.when(draw >= 8, F.concat(F.lit("x"), draw.cast("string"))).otherwise("")

    def make(h: Column) -> Column:
        local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
        site, top = F.regexp_replace(domain, r"\.[a-z]+\z", ""), F.concat(F.lit("."), F.substring_index(domain, ".", -1))
        email = F.concat(recast(local, h), longer, F.lit("@"), recast(site, noise(key, F.lit("domain"), domain, F.lit(0))), top)
        script = F.when(canon.rlike("[а-яё]"), "cyrillic").otherwise("latin")
        syllable = lambda own, k: F.get(listed(own), byte(h, F.lit(k)) % len(own))
        built = lambda own: F.concat(*[syllable(own, 2 * k) for k in range(4)], F.when(draw >= 8, F.concat(*[syllable(own, 8 + 2 * k) for k in range(4)])).otherwise(""))
        word = F.when(script == "cyrillic", F.concat(built(SYLLABLES["cyrillic"]), F.when(kind == "given:f", "на").when(kind == "given:m", "слав").otherwise("ев")))
        word = word.otherwise(F.concat(built(SYLLABLES["latin"]), F.when(kind == "given:f", "na").when(kind == "given:m", "rd").otherwise("son")))
        return F.when(kind == "email", email).otherwise(word)

    drawn = let(noise(key, kind, canon, draw), make)
    return F.when(kind == "ip", new_ip(key, canon)).when(kind == "card", new_card(key, canon)).when(kind == "ssn", new_ssn(key, canon)).when(kind == "phone", new_phone(key, canon)).otherwise(drawn)


def dress(hit: Column, plain: Column) -> Column:
    """A surrogate's digits in the punctuation of the match."""
    signs = F.filter(F.split(plain, ""), lambda c: c.rlike("[0-9+]"))

    def fill(signs: Column) -> Column:
        step = lambda acc, c: F.when(c.rlike("[0-9+]"), F.struct(F.concat(acc["out"], F.get(signs, acc["n"])).alias("out"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["n"].alias("n")))
        return F.aggregate(F.split(hit, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step)["out"]

    return let(signs, fill)


ROLES = "array<struct<type:string,canon:string,word:string>>"


def roles_of(hits: Column, names: Names) -> Column:
    """The words of all names among the matches, each once, as in Names.parts: the longest first."""
    words = F.flatten(F.transform(F.filter(hits, lambda h: type_of(h) == "name"), names.parts))
    kept = F.filter(words, lambda p: (p["type"] != "keep") & (F.length(p["word"]) > 1)).cast(ROLES)
    return F.array_sort(F.array_distinct(kept), lambda x, y: F.when(F.length(x["word"]) != F.length(y["word"]), F.length(y["word"]) - F.length(x["word"])).when(x["word"] < y["word"], -1).when(x["word"] > y["word"], 1).when(x["type"] < y["type"], -1).otherwise(1))


def pattern_of(roles: Column) -> Column:
    """ALL, and the words of a document's names wherever they stand alone."""
    return F.when(F.size(roles) > 0, F.concat(F.lit(ALL + r"|(?<!\p{L})(?:"), F.array_join(F.transform(roles, lambda p: p["word"]), "|"), F.lit(r")(?!\p{L})"))).otherwise(ALL)


def replacement(key: str, hit: Column, draws: Column, names: Names, roles: Column) -> Column:
    """What a match is replaced by; roles tell how a word that stands alone is read."""
    draw = lambda kind, canon: F.coalesce(F.try_element_at(draws, F.concat_ws("\x1f", kind, canon)), F.lit(0))
    shaped = lambda word, new: let(new, lambda x: F.when(word == F.upper(word), F.upper(x)).otherwise(F.initcap(x)))
    known = {n: to for n, (to, _, _) in names.next.items()}

    def make(kind: Column) -> Column:
        def one(p: Column) -> Column:
            """A word of a name, or any other match as a whole."""
            plain = surrogate(key, p["type"], p["canon"], draw(p["type"], p["canon"]), names)
            drawn = lambda x: F.when(p["type"] == "email", F.concat(F.regexp_extract(hit, r"\A[._+-]*", 0), x)).when(p["type"] == "ip", x).when(p["type"].isin("card", "phone", "ssn"), dress(hit, x)).otherwise(shaped(p["word"], x))
            return F.when(p["type"] == "keep", p["word"]).when(p["type"] == "known", names.lookup(p["word"], known)).otherwise(let(plain, drawn))

        alone = F.filter(roles, lambda p: p["word"] == hit)
        whole = F.array(F.struct(kind.alias("type"), canonical(kind, hit).alias("canon"), hit.alias("word")))
        parts = F.when(kind != "name", whole.cast(ROLES)).when(F.size(alone) > 0, F.slice(alone, 1, 1)).otherwise(names.parts(hit).cast(ROLES))
        return F.array_join(F.transform(parts, one), " ")

    return let(type_of(hit), make)


def found(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ALL), F.lit(0))).otherwise(F.array().cast("array<string>"))


def check_draws(own: DataFrame, key: str, names: Names) -> DataFrame:
    """type, canon and draw of the entities that can't take their first draw.

    own: distinct (type, canon).  Of entities that share a surrogate the one
    that settled before, or else the smallest, keeps it; a surrogate that is
    an entity of its type is never taken.  One shuffle of the distinct
    entities a round, and normally one round; it ends, as from the ninth draw
    on surrogates are longer and new room comes with each.  Permuted types
    need no draws.
    """
    own = own.where(~F.col("type").isin(*PERMUTED))
    now = store(own.select("type", "canon", F.lit(0).alias("draw")), "draws")
    while True:
        made = now.withColumn("made", surrogate(key, F.col("type"), F.col("canon"), F.col("draw"), names))
        holder = made.groupBy("type", "made").agg(F.min(F.struct("draw", "canon")).alias("first"), F.count(F.lit(1)).alias("n"))
        taken = own.select("type", F.col("canon").alias("made"))
        clash = holder.where("n > 1").select("type", "made", F.col("first.canon").alias("keeps")).union(holder.join(taken, ["type", "made"], "left_semi").select("type", "made", F.lit(None).cast("string")))
        bad = made.join(clash.groupBy("type", "made").agg(F.min("keeps").alias("keeps"), F.count_if(F.col("keeps").isNull()).alias("never")), ["type", "made"]).where("never > 0 or canon <> keeps").select("type", "canon")
        bad = store(bad.distinct(), "clashes")
        if bad.isEmpty():
            release(bad)
            return now.where("draw > 0")
        after = store(now.join(bad.withColumn("again", F.lit(1)), ["type", "canon"], "left").select("type", "canon", (F.col("draw") + F.coalesce("again", F.lit(0))).alias("draw")), "draws")
        release(now)
        release(bad)
        now = after


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", first_draw_only: bool = False) -> DataFrame:
    """docs with surrogates in place of e-mail and IP addresses, card, phone and social security numbers and names.

    Case, punctuation, length of numbers, country codes, top-level domains,
    Luhn validity, private address ranges, script and gender of names stay.
    An entity gets the same surrogate wherever and however it is written;
    different entities of a type get different ones.  A name is found after a
    title or as a listed given name and a family name; then its words are
    replaced everywhere in the document.  Adds n_entities and n_<type>, later
    mentions included; columns named so are replaced, all others are kept.
    Null texts stay null and have none; texts are read whole; repeated rows
    stay, and fare alike.
    """
    names = Names(key)
    added = ["n_entities", *[f"n_{k}" for k in PATTERNS]]
    out, own_names = veiled(docs.drop(*added))
    own_text = own_names[text_col]
    text = F.col(own_text).cast("string")
    every = lambda: F.explode(F.array_distinct(F.flatten(F.transform(found(text), lambda h: entities(h, names))))).alias("e")
    own = out.select(every()).select("e.type", "e.canon").where(~F.col("type").isin(*PERMUTED)).distinct()
    draws = None if first_draw_only else check_draws(store(own, "entities"), key, names)
    if draws is None or draws.isEmpty():
        rows = out.withColumn("draws", F.lit(None).cast("map<string,int>"))
    else:
        with_key = out.withColumn("text_key", F.sha2(text, 256))
        held = with_key.select("text_key", every()).distinct()
        table = held.join(draws, (F.col("e.type") == draws.type) & (F.col("e.canon") == draws.canon)).groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "type", "canon"), "draw"))).alias("draws"))
        rows = with_key.join(table, "text_key", "left").drop("text_key")

    def rewrite(roles: Column, hits: Column, pattern: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        new = F.transform(hits, lambda h: replacement(key, h, F.col("draws"), names, roles))
        joined = F.array_join(F.zip_with(gaps, F.array_append(new, F.lit("")), lambda g, r: F.concat(g, r)), "")
        return F.struct(joined.alias("text"), F.transform(hits, type_of).alias("kinds"))

    def read(first: Column, roles: Column) -> Column:
        """Once more, where there are names, with their words."""
        again = lambda p: F.when(F.size(roles) == 0, first).otherwise(F.regexp_extract_all(text, p, F.lit(0)))
        return let(pattern_of(roles), lambda p: let(again(p), lambda hits: rewrite(roles, hits, p)))

    none = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    spelt = let(found(text), lambda hits: F.when(F.size(hits) == 0, none).otherwise(let(roles_of(hits, names), lambda roles: read(hits, roles))))
    rows = rows.withColumn("new", F.when(text.isNotNull(), spelt))
    n = lambda k: F.coalesce(F.size(F.filter("new.kinds", lambda x: x == k)), F.lit(0)).cast("long")
    rewritten = rows.select(
        *[F.col("new.text").alias(c) if c == own_text else F.col(c) for c in out.columns],
        F.coalesce(F.size("new.kinds"), F.lit(0)).cast("long").alias("n_entities"),
        *[n(k).alias(f"n_{k}") for k in PATTERNS],
    )
    return unveiled(rewritten, own_names | {c: c for c in added})
