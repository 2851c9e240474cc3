"""Line deduplication by a suffix array over line numbers.

All lines of the corpus, in order of document and position, form one sequence.
Prefix doubling sorts its suffixes: level 0 by their first line, level k+1 by
the pair of level-k ranks at their start and 2^k lines further on.  A rank is a
place in that sorted order (of distinct beginnings), so ranks order the
suffixes, and suffixes of equal rank are an interval of the suffix array whose
longest common prefix is 2^k lines at least.  A suffix that is alone in its
interval leaves: only runs that repeat go on, and every level is smaller than
the one before.

The interval with a common prefix of l lines, for any l with 2^k <= l <
2^(k+1), is the set of suffixes that agree in two ranks of level k: at the
start, and 2^k lines before the end of the prefix.  Its member that stands
first in the corpus stays and the later ones are deleted.  The intervals asked
for are those of the shortest runs with enough words, from each line forwards
and backwards; together they cover just the lines that lie in some repeated
maximal run with enough words, since every line of such a run lies in one of
its own shortest runs.

Everything is DataFrame operations; no group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import beside, let, release, store, unveiled, veiled

#: A word, as it is counted here.
WORD = r"[^\x20\x09-\x0D]+"


def _line_table(texts: DataFrame) -> DataFrame:
    """pid, start, at, line, words: non-blank lines numbered in corpus order, those of a text one after another; h with the first."""
    ordered = texts.repartitionByRange(F.asc_nulls_last("first_id"), "h").sortWithinPartitions(F.asc_nulls_last("first_id"), "h")
    each = ordered.select("h", F.posexplode("lines").alias("pos", "x")).withColumn("pid", F.monotonically_increasing_id())
    return each.select(F.when(F.col("pos") == 0, F.col("h")).alias("h"), "pid", (F.col("pid") - F.col("pos")).alias("start"), F.col("x.at").alias("at"), F.col("x.id").alias("line"), F.col("x.n").alias("words"))


def _rank(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur at least twice, with rank: the place of their keys in sorted order.

    rows must be stored, as they are read more than once.  Keys are counted by
    partial aggregates, and sorted once each.  Those with over a thousandth of
    the rows, fewer than a thousand, meet their rows by broadcast, so that a
    very common line doesn't gather in one task; the others by a join with one
    row for a key.
    """
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = store(counted.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), "line-keys")
    total = ranked.agg(F.sum("n")).first()[0] or 0
    common = ranked.where(F.col("n") * 1000 > total).drop("n")
    rest = ranked.where(F.col("n") * 1000 <= total).drop("n")
    if common.isEmpty():
        return rows.join(rest, keys).drop(*keys)
    return rows.join(F.broadcast(common), keys).drop(*keys).unionByName(rows.join(F.broadcast(common), keys, "left_anti").join(rest, keys).drop(*keys))


def find_copies(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """h (a text's SHA-256), first_id, all_words, dead: what to delete from each text that holds later copies.

    dead: the places of the lines to delete from the first document with the
    text.  Every other document with it is a later copy as a whole.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    line = lambda x, i: F.struct(F.unhex(F.substring(F.sha2(x, 256), 1, 32)).alias("id"), F.regexp_count(x, F.lit(WORD)).alias("n"), i.alias("at"))
    rows = store(
        docs.select(
            F.col(id_col).alias("id"),
            F.unhex(F.sha2(text, 256)).alias("h"),
            F.filter(F.transform(F.split(text, "\n"), line), lambda x: x["n"] > 0).alias("lines"),
        ).withColumn("all_words", F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["n"])),
        "line-rows",
    )
    firsts = rows.groupBy("h").agg(F.min("id").alias("first_id"), F.min(F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("lo"), F.max(F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("hi"))
    held = rows.join(firsts.withColumnRenamed("h", "h2"), (F.col("h") == F.col("h2")) & F.col("id").eqNullSafe(F.col("first_id")))
    texts = held.select("h", "first_id", "lines", "all_words", (F.col("lo") != F.col("hi")).alias("copied")).dropDuplicates(["h"])
    texts = store(texts, "line-texts")
    lines = store(_line_table(texts.select("first_id", "h", "lines")), "lines")
    levels = [store(_rank(lines.select("pid", "start", "at", "words", "line"), ["line"]), "line-ranks")]

    # Stretches of repeated lines, and in them the shortest runs with enough words.
    base = levels[0].withColumn("stretch", F.col("pid") - F.row_number().over(Window.partitionBy("start").orderBy("pid")))
    own = Window.partitionBy("start", "stretch").orderBy("pid")
    base = base.withColumn("upto", F.sum("words").over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("upto") - F.col("words"))
    by = lambda c: Window.partitionBy("start", "stretch").orderBy(c)
    ahead = by("before").rangeBetween(0, min_words - 1)
    behind = by("upto").rangeBetween(-(min_words - 1), 0)
    seen = base.select(
        F.col("pid"),
        F.max("pid").over(ahead).alias("to"),
        (F.max("upto").over(ahead) - F.col("before")).alias("ahead"),
        F.min("pid").over(behind).alias("since"),
        (F.col("upto") - F.min("before").over(behind)).alias("behind"),
    )
    runs = seen.where(f"ahead >= {min_words}").selectExpr("pid", "to - pid + 1 as len").union(seen.where(f"behind >= {min_words}").selectExpr("since", "pid - since + 1")).distinct()
    runs = store(runs, "line-runs")
    longest = runs.agg(F.max("len")).first()[0] or 0

    while (2 << (len(levels) - 1)) <= longest:
        half = 1 << (len(levels) - 1)
        now = levels[-1].select("pid", "start", "rank")
        later = now.select((F.col("pid") - half).alias("pid"), F.col("start").alias("start2"), F.col("rank").alias("rank2"))
        pairs = now.join(later, "pid").where("start = start2").select("pid", "start", F.col("rank").alias("r1"), F.col("rank2").alias("r2"))
        pairs = store(pairs, "line-pairs")
        levels.append(store(_rank(pairs, ["r1", "r2"]), "line-ranks"))
        release(pairs)

    named = None
    for k, level in enumerate(levels):
        rank = level.select("pid", "rank")
        part = runs.where(f"len >= {1 << k} and len < {2 << k}")
        part = part.join(rank.withColumnRenamed("rank", "r1"), "pid").withColumn("tail", F.col("pid") + F.col("len") - (1 << k))
        part = part.join(rank.select(F.col("pid").alias("tail"), F.col("rank").alias("r2")), "tail").select("pid", "len", "r1", "r2")
        named = part if named is None else named.union(part)
    keys = ["len", "r1", "r2"]
    copies = named.join(named.groupBy(*keys).agg(F.min("pid").alias("first")), keys).where("pid > first")
    dead = copies.select(F.explode(F.sequence(F.col("pid"), F.col("pid") + F.col("len") - 1)).alias("pid")).distinct()
    place = levels[0].select("pid", "start", "at").join(dead, "pid").groupBy("start").agg(F.collect_list("at").alias("dead"))
    place = place.join(lines.where("h is not null").select("start", "h"), "start").drop("start")
    out = store(
        texts.select("h", "first_id", "all_words", "copied").join(place, "h", "left").where(f"dead is not null or copied and all_words >= {min_words}").drop("copied"),
        "line-dead",
    )
    for df in (rows, texts, lines, runs, *levels):
        release(df)
    return out


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without later copies of repeated runs of lines, with n_lines and n_deleted.

    A run is some consecutive non-blank lines of one document with at least
    ``min_words`` words in all.  Where the same run occurs before (in order of
    id, then text, then position, also in the same document) its lines are
    deleted; blank lines count for nothing and stay, unless nothing else does:
    then the text is empty.  Only equal lines match.  Rows with equal id and
    text are one document and fare alike; null ids come last; a null text has no
    lines and stays null.  n_lines and n_deleted count non-blank lines; columns
    named so are replaced, and all others are kept, whatever their names.
    """
    out, own = veiled(docs.drop("n_lines", "n_deleted"))
    doc_id, text_col = own[id_col], own[text_col]
    dead = beside(find_copies(out, min_words, doc_id, text_col))
    text = F.col(text_col).cast("string")
    joined = out.withColumn("own_h", F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))).join(dead, F.col("own_h") == F.col("h"), "left")
    first = F.col(doc_id).eqNullSafe(F.col("first_id"))
    whole = F.col("h").isNotNull() & ~first & (F.col("all_words") >= min_words)
    some = F.col("h").isNotNull() & first & F.col("dead").isNotNull()

    def cut(lines: Column) -> Column:
        kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dead")), lambda i: F.get(lines, i))
        return let(kept, lambda kept: F.when(F.exists(kept, lambda x: x.rlike(WORD)), F.array_join(kept, "\n")).otherwise(""))

    count = F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))), F.lit(0)).cast("long")
    n_lines = F.when(text.isNull(), F.lit(0).cast("long")).otherwise(count)
    result = joined.select(
        *[F.when(whole & text.isNotNull(), F.lit("")).when(some, let(F.split(text, "\n"), cut)).otherwise(text).alias(c) if c == text_col else F.col(c) for c in out.columns],
        n_lines.alias("n_lines"),
        F.when(whole, n_lines).when(some, F.size("dead").cast("long")).otherwise(F.lit(0).cast("long")).alias("n_deleted"),
    )
    return unveiled(result, own | {"n_lines": "n_lines", "n_deleted": "n_deleted"})
