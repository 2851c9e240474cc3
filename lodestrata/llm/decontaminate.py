"""Benchmark decontamination by a broadcast hash set of word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from .base import beside, slices, store, tune, unveiled, veiled

#: Words of a window; an item with fewer words is one window.
WINDOW = 8
#: Benchmark text in one broadcast set; a larger benchmark is dealt over several sets, one job each.
SET_BYTES = 32 << 20
PIECE = 1 << 20
RUNS = ArrayType(StructType().add("a", "long").add("b", "long"))

_R, _Q, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_word = np.zeros(256, bool)
_word[0x30:0x3A] = _word[0x61:0x7B] = _word[0x80:] = True
_gap = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, r, np.uint64)))) for r in (_R, _R_INVERSE)]
    return _powers[0], _powers[1]


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word in lower-cased UTF-8 bytes.

    A word's hash is a polynomial in its bytes modulo 2^64, taken from running
    sums, so it does not depend on where the word stands.
    """
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and _word[raw[end]]:
            end += 1
        b = np.frombuffer(raw, np.uint8, end - at, at)
        inside = _word[b]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        s, e = edge[::2], edge[1::2]
        up, down = powers(len(b) + 1)
        run = np.concatenate(([np.uint64(0)], np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])))
        h = (run[e] - run[s]) * down[s]
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
        parts.append((s + at, e + at, h))
        at = end
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of n words."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    g = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        g *= _Q
        g += h[k : len(h) - n + 1 + k]
    return g


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


class Windows:
    """The windows of some items: by length, sorted by hash, with the words they stand for."""

    FILTER = 22

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window, self.ids = window, sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        raws, offset, starts, ends = [], 0, [], []
        by: dict[int, list] = {}
        first = 0
        for item, text in items:
            raw = lowered(text)
            s, e, h = words(raw)
            if len(h):
                n = min(window, len(h))
                g = windows(h, n)
                by.setdefault(n, []).append((g, first + np.arange(len(g)), np.full(len(g), number[item])))
                starts.append(s + offset)
                ends.append(e + offset)
                raws.append(raw)
                first, offset = first + len(h), offset + len(raw)
        self.raw = b"".join(raws)
        self.starts, self.ends = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends))
        self.by = {}
        for n, parts in by.items():
            g, at, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(g, kind="stable")
            seen = np.zeros(1 << self.FILTER, bool)
            seen[g >> np.uint64(64 - self.FILTER)] = True
            self.by[n] = (g[order], at[order], item[order], seen)

    def spell(self, at: int, n: int) -> bytes:
        return b" ".join(self.raw[s:e] for s, e in zip(self.starts[at : at + n].tolist(), self.ends[at : at + n].tolist(), strict=True))

    def find(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[int]]]:
        """For each text: number of words, hit runs of words (end exclusive) and items."""
        out: list = [None] * len(texts)
        group, size = [], 0
        for k, text in enumerate(texts):
            raw = lowered(text)
            group.append((k, raw))
            size += len(raw)
            if size >= PIECE:
                self._group(group, out)
                group, size = [], 0
        self._group(group, out)
        return out

    def _group(self, group: list[tuple[int, bytes]], out: list) -> None:
        if not group:
            return
        whole = b"\0".join(raw for _, raw in group)
        s, e, h = words(whole)
        edges = np.cumsum([0, *(len(raw) + 1 for _, raw in group)])
        bounds = np.searchsorted(s, edges)
        hits: dict[int, tuple[list, set]] = {}
        for n, (table, at, item, seen) in self.by.items():
            g = windows(h, n)
            near = np.flatnonzero(seen[g >> np.uint64(64 - self.FILTER)])
            if not len(near):
                continue
            lo, hi = np.searchsorted(table, g[near]), np.searchsorted(table, g[near], "right")
            doc = np.searchsorted(bounds, near, "right") - 1
            real = (lo < hi) & (near + n <= bounds[doc + 1])
            spelt: dict[int, bytes] = {}
            for i, a, b, d in zip(near[real].tolist(), lo[real].tolist(), hi[real].tolist(), doc[real].tolist(), strict=True):
                own = b" ".join(whole[x:y] for x, y in zip(s[i : i + n].tolist(), e[i : i + n].tolist(), strict=True))
                for k in range(a, b):
                    if k not in spelt:
                        spelt[k] = self.spell(int(at[k]), n)
                    if spelt[k] == own:
                        runs, items = hits.setdefault(d, ([], set()))
                        if not runs or runs[-1] != (i - int(bounds[d]), i - int(bounds[d]) + n):
                            runs.append((i - int(bounds[d]), i - int(bounds[d]) + n))
                        items.add(int(item[k]))
        for d, (k, _) in enumerate(group):
            runs, items = hits.get(d, ([], set()))
            out[k] = (int(bounds[d + 1] - bounds[d]), merged(runs), items)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, set_bytes: int = SET_BYTES) -> DataFrame:
    """docs with n_words, hit_runs (hit words, end exclusive) and hit_items (sorted as strings).

    Null texts have no words.  Items without id, text or words count for
    nothing; rows of one item_id with several texts are one item.  Texts are
    scanned whole; repeated rows stay; columns named like the three are
    replaced, all others are kept.

    The size of the benchmark is checked.  Beyond ``set_bytes`` its items are
    dealt over several broadcast sets, one job each: a job writes what it
    found, by the text's digest and for texts with hits alone, and lets its
    set go before the next is made.  So neither driver nor executors hold more
    than one set, which has as many bytes of text and some more items at most.
    """
    tune(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col if text_col in benchmark.columns else "text").cast("string").alias("text")).where("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    sets = max(1, -(-total // set_bytes))
    out, own = veiled(docs.drop("n_words", "hit_runs", "hit_items"))
    text = own[text_col]
    names = own | {c: c for c in ("n_words", "hit_runs", "hit_items")}
    if sets == 1:
        return unveiled(_scan(out, text, _shared(items, window)), names)
    digest = lambda: F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)).alias("digest")
    parts = None
    for part in range(sets):
        shared = _shared(items.where(F.pmod(F.xxhash64("item"), F.lit(sets)) == part), window)
        found = _scan(out.select(text), text, shared).where(F.size("hit_items") > 0)
        found = store(found.select(digest(), F.lit(part).alias("part"), "hit_runs", "hit_items").dropDuplicates(["digest", "part"]), "hit-parts")
        shared.unpersist(blocking=True)
        parts = found if parts is None else parts.union(found)
    # A row for each set at most meets for a text.
    merged_parts = parts.groupBy("digest").agg(F.array_sort(F.flatten(F.collect_list("hit_runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_items")))).alias("hit_items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [[{"a": a, "b": b} for a, b in merged([(r["a"], r["b"]) for r in own])] for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, PAIR), batch.column(2)], ["digest", "hit_runs", "hit_items"])

    hits = store(merged_parts.mapInArrow(merge, StructType().add("digest", "binary").add("hit_runs", RUNS).add("hit_items", ArrayType(StringType()))), "hits")
    counted = _scan(out, text, None).drop("hit_runs", "hit_items").withColumn("own_digest", digest())
    joined = counted.join(beside(hits), F.col("own_digest") == F.col("digest"), "left")
    joined = joined.withColumn("hit_runs", F.coalesce("hit_runs", F.array().cast(RUNS))).withColumn("hit_items", F.coalesce("hit_items", F.array().cast("array<string>")))
    return unveiled(joined, names)


PAIR = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _shared(items: DataFrame, window: int):
    return items.sparkSession.sparkContext.broadcast(Windows([(r.item, r.text) for r in items.collect()], window))


def _scan(docs: DataFrame, text_col: str, shared) -> DataFrame:
    """docs with n_words, and the hit_runs and hit_items of one set (None: an empty one)."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value if shared is not None else Windows([])
        for batch in slices(batches):
            found = table.find(batch.column(at).to_pylist())
            ids = [sorted(table.ids[i] for i in x[2]) for x in found]
            cols = [pa.array([x[0] for x in found], pa.int64()), pa.array([[{"a": a, "b": b} for a, b in x[1]] for x in found], PAIR), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "n_words", "hit_runs", "hit_items"])

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add("n_words", "long").add("hit_runs", RUNS).add("hit_items", ArrayType(StringType())))


def summary(hits: DataFrame, least_items: int = 2) -> DataFrame:
    """find_hits() with n_hit, n_items, items_sha256 and contaminated in place of runs and items; columns of their names are replaced."""
    added = {
        "n_hit": F.aggregate("hit_runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"]),
        "n_items": F.size("hit_items").cast("long"),
        "items_sha256": F.sha2(F.array_join("hit_items", ","), 256),
        "contaminated": F.size("hit_items") >= least_items,
    }
    return hits.select(*[F.col(f"`{c}`") for c in hits.columns if c not in ("hit_runs", "hit_items", *added)], *[c.alias(name) for name, c in added.items()])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", least_items: int = 1, spans: bool = False) -> DataFrame:
    """docs without the documents that hold windows of at least ``least_items`` items.

    With ``spans`` all documents stay and their hit words are cut out, from the
    start of the first to the end of the last word of each run.
    """
    plain, own = veiled(docs)
    items = benchmark.withColumnRenamed("text", own[text_col])
    found = find_hits(plain, items, own[text_col])
    if not spans:
        return unveiled(found.where(F.size("hit_items") < least_items), own)
    names = plain.columns
    at = names.index(own[text_col])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without(t, [(r["a"], r["b"]) for r in runs]) for t, runs in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else batch.column(k) for k in range(len(names))], names)

    return unveiled(found.select(*names, "n_words", "hit_runs", "hit_items").mapInArrow(cut, plain.schema), own)


def without(text: str | None, runs: list[tuple[int, int]]) -> str | None:
    if not runs:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    s, e, _ = words(raw.lower())
    keep, at = [], 0
    for a, b in runs:
        keep.append(raw[at : s[a]])
        at = int(e[b - 1])
    return b"".join([*keep, raw[at:]]).decode("utf-8", "surrogatepass")


def sha(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
