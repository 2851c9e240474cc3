import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import surrogates as sg
from lodestrata.llm.queries import op2_surrogates

TEXTS = {
    1: "Write to jane.doe-7@Mail.Example.com, or jane.doe-7@mail.example.com! Not bob@x.",
    2: "Call +1 (286) 555-5136 or +1 286 555 5136, (212) 555-0100; 212-555-0100.",
    3: "Hosts 188.54.39.104, 10.1.2.3 and 192.168.0.7. Version 1.2.3.4.5 and 999.1.1.1 stay.",
    4: "Card 4111111111111111 is 4111 1111 1111 1111; 4785380592391139!! fails. ID 123-45-6789.",
    5: "Mr. John Smith met Mrs Smith and Dr. Ada Lovelace; MS. SMITH left. Mary Poppins sang. Господин Иван Петров и Госпожа Петрова.",
    6: None,
    7: "",
    8: "No entity here, not even é𝄞.",
    9: "é𝄞 jane.doe-7@mail.example.com###%%%bob.1@mail.example.com$$$ +4930123456",
}


@pytest.fixture(scope="module")
def out(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").selectExpr("*", "5 as n_entities", "1 as _x", "2 as _new", "3 as _draws", "4 as new", "5 as draws")
    return {r.doc_id: r for r in sg.pseudonymise(df, "key").collect()}


def shape(s):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))


def luhn(s):
    d = [int(c) for c in reversed(re.sub(r"\D", "", s))]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10


def test_counts(out):
    n = {k: [out[k][f"n_{t}"] for t in sg.PATTERNS] for k in TEXTS}
    assert n[1] == [2, 0, 0, 0, 0, 0] and n[2] == [0, 0, 0, 0, 4, 0] and n[3] == [0, 3, 0, 0, 0, 0]
    assert n[4] == [0, 0, 3, 1, 0, 0] and n[5][5] == 7 and n[9] == [2, 0, 0, 0, 1, 0]
    assert [out[k].n_entities for k in (6, 7, 8)] == [0, 0, 0]
    assert [out[k].text for k in (6, 7, 8)] == [TEXTS[k] for k in (6, 7, 8)]


def test_format_and_coreference(out):
    mails = re.findall(r"\S+@[\w.]+\w", out[1].text)
    assert mails[0] == mails[1] and mails[0].endswith(".com") and shape(mails[1]) == "aaaa.aaa-0@aaaa.aaaaaaa.aaa"
    assert mails[1] in out[9].text and "doe" not in out[9].text and out[9].text.startswith("é𝄞 ")
    assert shape(out[2].text) == shape(TEXTS[2]) and shape(out[4].text) == shape(TEXTS[4])
    p = re.findall(r"[+(0-9][-0-9() ]+[0-9]", out[2].text)
    digits = [re.sub(r"\D", "", x) for x in p]
    assert digits[0] == digits[1] and digits[2] == digits[3] and digits[0].startswith("1") and p[0].startswith("+1 (")
    assert not set(digits) & {"12865555136", "2125550100"}
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", out[3].text)
    assert len(set(ips)) == 5 and ips[1].startswith("10.") and ips[2].startswith("192.168.") and "1.2.3.4.5" in out[3].text and "999.1.1.1" in out[3].text
    cards = re.findall(r"\d{4} ?\d{4} ?\d{4} ?\d{4}", out[4].text)
    assert cards[0] == cards[1].replace(" ", "") != "4111111111111111" and luhn(cards[0]) == 0 and all(c[0] == "4" for c in cards)
    assert not re.search("123-45-6789", out[4].text)


def test_names(out):
    t = out[5].text
    m = re.match(r"Mr\. (\w+) (\w+) met Mrs (\w+) and Dr\. (\w+) (\w+); MS\. (\w+) left\. (\w+) (\w+) sang\. Господин (\w+) (\w+) и Госпожа (\w+)\.$", t)
    assert m, t
    assert m[2] == m[3] != "Smith"
    assert m[1] in sg.GIVEN["m", "latin"] and m[1] != "John" and m[7] in sg.GIVEN["f", "latin"] and m[7] != "Mary"
    assert m[9] in sg.GIVEN["m", "cyrillic"] and re.fullmatch("[А-Я][а-я]+", m[10]) and m[10] != m[11]
    assert "Lovelace" not in t and "Ada" not in t


def test_later_mentions(spark):
    text = "Dr. Ada Lovelace wrote. Lovelace died. John Smith came; Smith and JOHN, Johnson and Adam left. Ada stayed."
    df = spark.createDataFrame([(1, text), (1, text), (2, "Smith and Lovelace stay where no name is found.")], "doc_id long, text string")
    got = sg.pseudonymise(df, "key").collect()
    m = re.fullmatch(r"Dr\. (\w+) (\w+) wrote\. (\w+) died\. (\w+) (\w+) came; (\w+) and JOHN, Johnson and Adam left\. (\w+) stayed\.", got[0].text)
    assert m, got[0].text
    assert m[2] == m[3] != "Lovelace" and m[5] == m[6] != "Smith" and m[1] == m[7] != "Ada" and m[4] != "John"
    assert got[0].text == got[1].text and got[0].n_name == 5
    assert got[2].text == "Smith and Lovelace stay where no name is found."


@pytest.mark.parametrize("kind", ["private", "phone", "ssn", "card", "public"])
def test_permutations(spark, kind):
    """Whole ranges: every number gets another one, of its own class, and no two get the same."""
    rnd = random.Random(5)
    made = {
        "private": lambda: [f"192.168.{x}.{y}" for x in range(256) for y in range(256)],
        "phone": lambda: [f"+49{x:05d}" for x in range(20_000, 60_000)] + [f"{k}12345678" for k in range(10)] + ["+491234567890123", "+4912"],
        "ssn": lambda: [f"{a:03d}{g:02d}{s:04d}" for a in (0, 1, 5, 665, 666, 667, 899, 900) for g in (0, 1, 50, 99) for s in (0, 1, 9999)],
        "card": lambda: sorted({f"4{rnd.randrange(10**11):011d}{x}" for _ in range(3000) for x in range(10)}),
        "public": lambda: [f"{a}.{b}.{c}.9" for a in (1, 8, 10, 100, 127, 172, 192, 203, 223, 224, 255, 0) for b in (0, 15, 16, 31, 32, 168, 255) for c in range(0, 256, 5)],
    }[kind]()
    kinds = {"private": "ip", "public": "ip"}.get(kind, kind)
    df = spark.createDataFrame([(x,) for x in made], "canon string").withColumn("new", sg.surrogate("key", F.lit(kinds), F.col("canon"), F.lit(0), sg.Names("key")))
    got = {r.canon: r.new for r in df.collect()}
    assert len(got) == len(set(got.values())) == len(made)
    assert all(len(a) == len(b) for a, b in got.items()) or kinds == "ip"
    if kinds == "ip":
        import ipaddress

        assert all(ipaddress.ip_address(a).is_private == ipaddress.ip_address(b).is_private for a, b in got.items() if not a.startswith(("0.", "198.", "203.", "192.0.")))
    if kind == "private":
        assert set(got.values()) == set(made)
    if kind == "card":
        assert all((luhn(a) == 0) == (luhn(b) == 0) for a, b in got.items())
    never = {"0000"} if kind == "ssn" else set()
    assert [a for a, b in got.items() if a == b and not (kind == "ssn" and a[:3] in ("000", "666", "900") and a[3:5] == "00" and a[5:] in never)] == []


def test_many_addresses(spark):
    texts = [(x, " ".join(f"192.168.{x}.{y}" for y in range(256))) for x in range(256)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {h for r in sg.pseudonymise(df, "k").collect() for h in r.text.split()}
    assert len(got) == 65536 and all(h.startswith("192.168.") for h in got)


def test_keys_differ(spark, out):
    df = spark.createDataFrame([(1, TEXTS[1])], "doc_id long, text string")
    assert sg.pseudonymise(df, "other").first().text != out[1].text
    assert sg.pseudonymise(df, "key").first().text == out[1].text


def test_clashes_are_resolved(spark, monkeypatch):
    """Short forms leave little room: 36 of 100 two-digit local parts at one domain clash, or hit one another."""
    texts = [(k, f"mail {k:02d}@ab.com and {k:02d}@ab.com") for k in range(0, 100, 2)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    first = [r.text.split()[1] for r in sg.pseudonymise(df, "k", first_draw_only=True).collect()]
    assert len(set(first)) < len(first)
    got = [r.text.split() for r in sg.pseudonymise(df, "k").collect()]
    assert all(a[1] == a[3] for a in got)
    made = {a[1] for a in got}
    assert len(made) == len(texts) and not made & {t.split()[1] for _, t in texts}


def test_empty_and_long(spark):
    df = spark.createDataFrame([(1, "x" * 300_000 + "@" + " 1.2.3.4" * 3000)], "doc_id long, text string")
    assert sg.pseudonymise(df, "k").first().n_ip == 3000
    assert sg.pseudonymise(df.where("false"), "k").collect() == []


def test_query(spark, tiny):
    df = op2_surrogates(spark, tiny)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    before = spark.read.parquet(f"{tiny}/documents.parquet")
    both = before.alias("a").join(df.alias("b"), "doc_id").select("doc_id", F.col("a.text").alias("old"), F.col("b.text").alias("new"), "n_entities").collect()
    assert len(both) == before.count()
    plain = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\+\d+ \(\d+\) [\d-]+|\d{16}|\d+\.\d+\.\d+\.\d+")
    seen = {}
    for r in both:
        old, new = plain.findall(r.old), plain.findall(r.new)
        assert len(old) == len(new) == r.n_entities or not old
        assert not set(old) & set(new)
        for a, b in zip(old, new, strict=True):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen) > 10
