"""Secret scans: fixed patterns, and two character Markov models by log-likelihood ratio.

Everything here is Spark SQL expressions; the models reach them as a literal
array of 69 x 69 weights.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import let, unveiled, veiled

# The kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# A greedy run of 12 or more after AKIA, or of 32 or more digits, is just the run that passes the least length.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8

#: Strings the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CLASSES = len(ALPHABET) + 2  # 0: any other character; the last: the start of a string

WORDS = (
    "get set load save read write open close file path name user table index value count size list map key type data node edge graph "
    "text line word page link host port time date start stop begin end first last next previous parent child tree leaf root view model "
    "controller service client server request response handler manager factory builder parser printer test case suite report result "
    "error message buffer stream block chunk array string number integer double boolean object class method function module package "
    "version release update delete insert select filter group order merge split join sort search find replace format convert encode "
    "decode image color width height left right top bottom center margin window button label title header footer content description"
).split()


def samples(n: int = 400) -> list[tuple[str, int]]:
    """Labelled strings made by rule: 1 for random strings, 0 for ordinary identifiers."""
    digits = {"hex": "0123456789abcdef", "upper": ALPHABET[:26] + ALPHABET[52:62], "word": ALPHABET[:62], "url": ALPHABET[:62] + "_-", "base64": ALPHABET[:62] + "+/"}
    out = []
    for i in range(n):
        seed = hashlib.sha512(f"random {i}".encode()).digest() + hashlib.sha512(f"more {i}".encode()).digest()
        kind = list(digits)[i % len(digits)]
        out.append(("".join(digits[kind][b % len(digits[kind])] for b in seed[: 24 + i % 40]), 1))
    for i in range(n):
        pick = hashlib.sha256(f"words {i}".encode()).digest()
        words = [WORDS[(256 * pick[2 * k] + pick[2 * k + 1]) % len(WORDS)] for k in range(3 + i % 4)]
        camel = words[0] + "".join(w.title() for w in words[1:])
        joined = (camel, camel[0].upper() + camel[1:], "_".join(words), "-".join(words), "".join(words), "_".join(words).upper(), "/".join(words))[i % 7]
        out.append((joined + (str(pick[20] * 8) if i % 5 == 0 else ""), 0))
    out += [(x * 12, 0) for x in "-=_/+"] + [(str(3**k), 0) for k in range(40, 60)]
    return out


def class_of(c: Column) -> Column:
    """The class of a one-character string."""
    table = ["0"] * 128
    for k, x in enumerate(ALPHABET):
        table[ord(x)] = str(k + 1)
    return F.coalesce(F.get(F.split(F.lit(",".join(table)), ",").cast("array<int>"), F.ascii(c)), F.lit(0))


def steps_of(token: Column) -> Column:
    """The numbered transitions of a string, the first from the start."""
    before = lambda chars, i: F.when(i == 0, F.lit(CLASSES - 1)).otherwise(class_of(F.get(chars, i - 1)))
    return let(F.split(token, ""), lambda chars: F.transform(chars, lambda c, i: before(chars, i) * CLASSES + class_of(c)))


class Model:
    """Weights (log-likelihood ratios) of transitions, and the least mean of a random string."""

    def __init__(self, weights: list[float], least: float):
        self.weights, self.least = weights, least

    def ratio(self, token: Column) -> Column:
        """Mean log-likelihood ratio of a string's transitions: above zero speaks for a random one."""
        table = F.split(F.lit(",".join(f"{w:.6f}" for w in self.weights)), ",").cast("array<double>")
        total = F.aggregate(steps_of(token), F.lit(0.0), lambda acc, s: acc + F.coalesce(F.get(table, s), F.lit(0.0)))
        return total / F.greatest(F.length(token), F.lit(1))


def labelled(spark: SparkSession) -> DataFrame:
    """samples() as rows (token, label)."""
    text = " ".join(f"{label}{token}" for token, label in samples())
    return spark.range(1).select(F.explode(F.split(F.lit(text), " ")).alias("x")).selectExpr("substr(x, 2) as token", "cast(substr(x, 1, 1) as int) as label")


def train(sample: DataFrame, smoothing: float = 0.3) -> Model:
    """Fit both models on rows (token, label); what is collected is 2 x 69 x 69 counts at most.

    The threshold lies midway between the mean ratios of both labels, and not
    below zero.  Null tokens or labels are left out; without rows of either
    label all weights are zero and nothing is found.
    """
    rows = sample.select(F.col("token").cast("string").alias("token"), F.col("label").cast("int").alias("label")).where("token is not null and label in (0, 1) and token <> ''")
    counts = [[smoothing] * (CLASSES * CLASSES) for _ in range(2)]
    n = [0, 0]
    for r in rows.select("label", F.explode(steps_of(F.col("token"))).alias("step")).groupBy("label", "step").count().collect():
        counts[r["label"]][r["step"]] += r["count"]
        n[r["label"]] += r["count"]
    if not all(n):
        return Model([0.0] * CLASSES * CLASSES, math.inf)
    logs = []
    for own in counts:
        sums = [sum(own[a * CLASSES : (a + 1) * CLASSES]) for a in range(CLASSES)]
        logs.append([math.log(x / sums[k // CLASSES]) for k, x in enumerate(own)])
    weights = [r - o for o, r in zip(*logs, strict=True)]
    model = Model(weights, 0.0)
    mean = {r["label"]: r["m"] for r in rows.groupBy("label").agg(F.avg(model.ratio(F.col("token"))).alias("m")).collect()}
    model.least = max(0.0, (mean[0] + mean[1]) / 2)
    return model


SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
#: Elements in a block of running().
BLOCK = 256


def running(n: Column, begin: Column, none: Column, step) -> Column:
    """A flat array of what step(state, i) lists for i from 0 to n - 1, passing a state on.

    ``step`` gives a struct (state, out), out an array like ``none``.  An array
    that grows by one element is copied each time; so the numbers go in blocks
    of 256, whose short arrays are joined in the end, and the work stays in
    proportion to n.
    """
    nothing = F.array(none)

    def block(acc: Column, k: Column) -> Column:
        def one(inner: Column, i: Column) -> Column:
            return let(step(inner["state"], i), lambda s: F.struct(s["state"].alias("state"), F.concat(inner["out"], s["out"]).alias("out")))

        ids = F.sequence(k * BLOCK, F.least((k + 1) * BLOCK, n) - 1)
        inner = F.aggregate(ids, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return let(inner, lambda x: F.struct(x["state"].alias("state"), F.array_append(acc["out"], x["out"]).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
    folded = F.aggregate(blocks, F.struct(begin.alias("state"), F.slice(nothing, 1, 0).alias("out")), block)
    return F.when(n > 0, F.flatten(folded["out"])).otherwise(none)


def places(text: Column, pattern: str, kind: int, good=None, group: int = 0) -> Column:
    """Spans of all leftmost, non-overlapping matches: array of (start, kind, end), in code points.

    The gaps between matches and the matches themselves give the positions.
    ``good`` maps the text of the given group to whether the span is kept.
    """
    none = F.array().cast(SPANS)

    def spans(parts: Column) -> Column:
        gaps, hits, values = parts["gaps"], parts["hits"], parts["values"]

        def step(at: Column, i: Column) -> Column:
            start = at + F.length(F.get(gaps, i))
            one = lambda s: F.array(s).cast(SPANS) if good is None else F.when(good(F.get(values, i)), F.array(s).cast(SPANS)).otherwise(none)
            span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(F.get(hits, i))).alias("end"))
            return let(span, lambda s: F.struct(s["end"].alias("state"), one(s).alias("out")))

        return running(F.size(hits), F.lit(0).cast("long"), none, step)

    every = lambda k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), every(0).alias("hits"), every(group).alias("values"))
    return F.when(text.rlike(pattern), let(parts, spans)).otherwise(none)


MARKOV = KINDS.index("markov")


def apart(base: Column, extra: Column) -> Column:
    """The spans of extra that overlap none of base.

    Both are merged by start.  Spans of extra don't overlap one another, so a
    span of base that begins inside one comes right after it; those that begin
    before it are known by the furthest end so far.
    """
    none = F.array().cast(SPANS)

    def walk(every: Column) -> Column:
        def step(furthest: Column, i: Column) -> Column:
            mine, after = F.get(every, i), F.get(every, i + 1)
            own = mine["kind"] == MARKOV
            free = own & (furthest <= mine["start"]) & F.coalesce((after["kind"] == MARKOV) | (after["start"] >= mine["end"]), F.lit(True))
            return F.struct(F.when(own, furthest).otherwise(F.greatest(furthest, mine["end"])).alias("state"), F.when(free, F.array(mine)).otherwise(none).alias("out"))

        return running(F.size(every), F.lit(0).cast("long"), none, step)

    return F.when((F.size(base) == 0) | (F.size(extra) == 0), extra).otherwise(let(F.array_sort(F.concat(base, extra)), walk))


def scan(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with base and extra: arrays of spans (start, kind, end), sorted, in code points.

    base holds the fixed patterns; extra the strings that the models call
    random and that overlap no base span.  A null text counts as empty.  Long
    texts are scanned whole, in time proportional to their matches.  Repeated
    rows stay, each with its own spans; columns named base or extra are
    replaced, all others are kept.
    """
    out, own = veiled(docs.drop("base", "extra"))
    text = F.coalesce(F.col(own[text_col]).cast("string"), F.lit(""))
    base = F.array_sort(
        F.concat(
            places(text, ASSIGN, 0, lambda value: F.length(value) >= LEAST_VALUE, group=2),
            places(text, ACCESS, 1),
            places(text, HEX, 2),
        )
    )
    more = places(text, CANDIDATE, MARKOV, lambda token: model.ratio(token) > model.least) if model.least < math.inf else F.array().cast(SPANS)
    found = out.withColumn("base", base).withColumn("more", more).withColumn("extra", apart(F.col("base"), F.col("more")))
    return unveiled(found, own | {"base": "base", "extra": "extra"})


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def summary(found: DataFrame) -> DataFrame:
    """scan() with counts and digests in place of the spans; columns of their names are replaced."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    added = {
        "n_assign": n(0),
        "n_access": n(1),
        "n_hex": n(2),
        "base_sha256": F.sha2(listed(F.col("base")), 256),
        "spans": listed(F.array_sort(F.concat("base", "extra"))),
    }
    return found.select(*[F.col(f"`{c}`") for c in found.columns if c not in ("base", "extra", *added)], *[c.alias(name) for name, c in added.items()])
