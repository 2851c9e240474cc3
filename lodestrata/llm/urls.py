"""URL filters: host and path rules, and logistic regression on hashed character n-grams.

Scoring is Spark SQL expressions; the weights reach them as a literal array.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import let

BUCKETS = 4096
HOST_GRAM, PATH_GRAM = 4, 3

# Fixed values: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

BAD = "spam farm cheap pills casino viagra loan payday replica lottery jackpot xxx porn adult sexy poker slots bonus discount deals click traffic seo escort dating torrent warez crack keygen miracle diet free win bet betting prize ads banner popup".split()
GOOD = "news library museum garden science history school city music travel kitchen weather forest river journal art church sport market radio village theatre nature research health book teacher street water bridge".split()
SYLLABLES = "th er in an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()


def samples(n: int = 400) -> list[tuple[str, int]]:
    """A small labelled URL table made by rule: 1 for urls to block.  Schemes, ends and most paths are alike for both labels."""
    out = []
    for i in range(2 * n):
        pick = hashlib.sha256(f"url {i}".encode()).digest()
        bad = i % 2
        take = lambda words, k: words[pick[k] % len(words)]  # noqa: E731, B023
        if bad:
            name = f"{take(BAD, 0)}-{take(BAD, 1)}" if pick[2] % 3 else take(BAD, 0) + take(BAD, 1)
        elif i % 4 == 0:
            name = "".join(SYLLABLES[b % len(SYLLABLES)] for b in pick[10 : 13 + pick[9] % 4])
        else:
            name = f"{take(GOOD, 0)}-{take(GOOD, 1)}" if pick[2] % 3 else take(GOOD, 0) + take(GOOD, 1)
        host = ("", "www.", "blog.", "m.")[pick[3] % 4] + name + (".example", "")[pick[4] % 2] + (".com", ".net", ".org")[pick[5] % 3]
        path = f"/{('en', 'de', 'fr', 'es')[pick[6] % 4]}/{pick[7] * 7}" + ("", "/", ".html", "/index.html")[pick[8] % 4]
        if i % 10 >= 8:
            path = f"/{take(BAD if bad else GOOD, 14)}/{take(BAD if bad else GOOD, 15)}.html"
        out.append((("http://", "https://")[pick[16] % 2] + host + path, bad))
    return out


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def grams_of(host: Column, path: Column) -> Column:
    """Buckets of the n-grams of the host (with its ends marked) and of the path (all digits alike)."""

    def own(text: Column, n: int, part: str) -> Column:
        gram = lambda chars, i: F.concat(F.lit(part), *[F.get(chars, i + k) for k in range(n)])
        heads = lambda chars: F.slice(chars, F.lit(1), F.greatest(F.size(chars) - (n - 1), F.lit(0)))
        return let(F.split(text, ""), lambda chars: F.transform(heads(chars), lambda _, i: F.pmod(F.xxhash64(gram(chars, i)), F.lit(BUCKETS)).cast("int")))

    return F.concat(own(F.concat(F.lit("^"), host, F.lit("$")), HOST_GRAM, "h"), own(F.translate(path, "123456789", "000000000"), PATH_GRAM, "p"))


class Model:
    def __init__(self, weights: Sequence[float], bias: float):
        self.weights, self.bias = weights, bias

    def probability(self, host: Column, path: Column) -> Column:
        """How likely the url is one to block."""
        table = F.split(F.lit(",".join(f"{w:.6f}" for w in self.weights)), ",").cast("array<double>")
        total = F.aggregate(grams_of(host, path), F.lit(float(self.bias)), lambda acc, b: acc + F.get(table, b))
        return 1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(500.0)), F.lit(-500.0))))


def labelled(spark: SparkSession) -> DataFrame:
    """samples() as rows (url, label)."""
    text = " ".join(f"{label}{url}" for url, label in samples())
    return spark.range(1).select(F.explode(F.split(F.lit(text), " ")).alias("x")).selectExpr("substr(x, 2) as url", "cast(substr(x, 1, 1) as int) as label")


def train(table: DataFrame, rounds: int = 60, rate: float = 0.15, shrink: float = 1e-4, most: int = 10_000) -> Model:
    """Fit on a small table (url, label) by gradient steps row after row, in the order of the urls.

    ``most`` is the documented bound: of a larger table the rows with the
    smallest hashes are taken.  Null urls or labels are left out.
    """
    rows = (
        table.select(F.col("url").cast("string").alias("url"), F.col("label").cast("int").alias("label"))
        .where("url is not null and label in (0, 1)")
        .orderBy(F.xxhash64("url"), "url", "label")
        .limit(most)
        .select("label", grams_of(host_of(F.col("url")), path_of(F.col("url"))).alias("grams"))
        .collect()
    )
    weights, bias = [0.0] * BUCKETS, 0.0
    for k in range(rounds):
        step = rate / (1 + 0.05 * k)
        for r in rows:
            z = bias + sum(weights[g] for g in r["grams"])
            off = step * (r["label"] - 1 / (1 + math.exp(-max(-60.0, min(60.0, z)))))
            bias += 0.1 * off
            for g in r["grams"]:
                weights[g] += off - step * shrink * weights[g]
    return Model(weights, bias)


def judge(pages: DataFrame, model: Model, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url", least: float = 0.5) -> DataFrame:
    """pages with host, path, rule, verdict and score.

    A rule fits its host and all subdomains if the path starts with the
    rule's; the longest fitting rule decides (of equal length the one listed
    first), else the model does: block from ``least`` upwards.  Null urls and
    urls without :// have empty host and path and are judged by the model
    alone, which has only its bias for them.
    """
    out = pages.drop("host", "path", "rule", "verdict", "score").withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    chain = None
    decide = None
    for verdict, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        chain = F.when(fits, host + path) if chain is None else chain.when(fits, host + path)
        decide = F.when(fits, verdict) if decide is None else decide.when(fits, verdict)
    rule = chain if chain is not None else F.lit(None).cast("string")
    own = F.when(F.col("score") >= least, "block").otherwise("allow")
    return out.withColumn("score", model.probability(F.col("host"), F.col("path"))).withColumns({"rule": rule, "verdict": decide.otherwise(own) if decide is not None else own})
