"""Near copies by SimHash with a check on the word shingles.

The tiled comparison of fingerprints finds candidates, for a radius as wide as
the similarity asks for; the Jaccard similarity of the shingle sets decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .base import batches_of, beside, release, slices, store, tune
from .components import connected_components
from .simhash import SEED, Bits, forest, hashed, link_sized, sketch

#: Shingles in a tile, about (8 bytes each), the most sets in it, and pairs of tiles and of sets in one Arrow batch.
TILE, SETS, PAIRS, TWOS = 1 << 18, 2048, 2, 100
#: Columns of a table of shingles that are worked on at once.
BLOCK = 4096


def grams(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; none if it has no words."""
    parts = [np.unique(np.array(h, np.uint64)) for h in hashed(text, words)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def name_of(own: np.ndarray) -> int:
    """A 64-bit name of a set of shingles."""
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """The number of shingles that each of one has in common with each of two."""
    both = np.intersect1d(np.concatenate(one), np.concatenate(two))
    found = np.zeros((len(one), len(two)), np.float32)
    for at in range(0, len(both), BLOCK):
        some = both[at : at + BLOCK]
        a, b = (np.stack([np.isin(some, x, assume_unique=True) for x in side]).astype(np.float32) for side in (one, two))
        found += a @ b.T
    return found


def alike(common: np.ndarray, n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of n and m shingles with so many in common have the least Jaccard similarity."""
    return common >= least * (n + m - common) - 1e-9


def _lists(col: pa.Array) -> list[np.ndarray]:
    values, at = col.values.to_numpy(), col.offsets.to_numpy()
    return [values[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def _signed(docs: DataFrame, words: int, least: float) -> DataFrame:
    """id, key (a hash of the text), node (the name of the shingle set), fp, n (its size) and its sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            node, fp, n = (np.zeros(batch.num_rows, np.uint64) for _ in range(3))
            sketches = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                bits, parts = Bits(), []
                for hashes in hashed(text, words):
                    own = np.array(hashes, np.uint64)
                    bits.add(own)
                    parts.append(np.unique(own))
                grams = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
                node[k], fp[k], n[k] = name_of(grams), bits.fingerprint(), len(grams)
                sketches.append(sketch(grams, least).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x.view(np.int64)) for x in (node, fp, n)), pa.array(sketches, pa.list_(pa.int64()))], ["id", "key", "node", "fp", "n", "sketch"])

    return docs.mapInArrow(run, docs.select("id", "key").schema.add("node", "long").add("fp", "long").add("n", "long").add("sketch", ArrayType(LongType())))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TWOS):
            sets = [grams(t, words) for t in batch.column(0).to_pylist()]
            names = pa.array(np.array([name_of(s) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([names, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "grams"])

    return docs.select("text").mapInArrow(run, "node long, grams array<bigint>")


def link(docs: DataFrame, own: DataFrame, words: int, radius: int, least: float) -> DataFrame:
    """Edges u, v that connect all sets that link; only such sets have an edge.

    Sets link if their fingerprints differ in at most ``radius`` bits and
    their similarity is at least ``least``.  Candidates, whose sketches allow
    that similarity, form clusters.  First
    each member meets the smallest of its cluster, which settles most of a
    group of copies in as many rows as it has members.  Then, in clusters that
    still hold several components, members of different components are
    compared tile by tile, and each pair of tiles returns a spanning forest.
    """
    spark = docs.sparkSession
    nodes = store(own.dropDuplicates(["node"]).select("node", "fp", "n", "sketch"), "similar-nodes")
    cluster = store(connected_components(link_sized(nodes, radius, least)), "similar-clusters").withColumnRenamed("node", "_node")
    crowd = cluster.join(nodes, F.col("node") == F.col("_node")).select("node", "fp", F.col("root").alias("lead"))
    crowd = store(crowd, "similar-crowd")
    # Only texts of the crowd are read again, one of those with the same shingles.
    wanted = crowd.select("node").distinct()
    first = own.join(beside(wanted), "node", "left_semi").groupBy("node").agg(F.min(F.struct("key", "id")).alias("first"))
    keys = store(first.select(F.col("first.key").alias("key1"), F.col("first.id").alias("id1")), "similar-keys")
    again = _sets(docs.join(beside(keys), (F.col("key") == F.col("key1")) & F.col("id").eqNullSafe(F.col("id1")), "left_semi"), words)
    sets = store(again.join(beside(wanted), "node", "left_semi").dropDuplicates(["node"]).join(crowd, "node").select("node", "fp", "lead", "grams"), "similar-sets")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, other = (batch.column(k).to_numpy().view(np.uint64) for k in (2, 3))
            mine, theirs = _lists(batch.column(4)), _lists(batch.column(5))
            common = np.array([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(mine, theirs, strict=True)], float)
            keep = alike(common, np.array([len(a) for a in mine], float), np.array([len(b) for b in theirs], float), least)
            keep = pa.array(keep & (np.bitwise_count(fp ^ other) <= radius), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["u", "v"])

    heads = sets.where("node = lead").select("lead", F.col("fp").alias("other"), F.col("grams").alias("theirs"))
    pairs = sets.where("node <> lead").join(heads, "lead").select("node", "lead", "fp", "other", "grams", "theirs")
    with batches_of(spark, TWOS):
        near = store(pairs.mapInArrow(meet, "u long, v long"), "similar-stars")

    roots = connected_components(near).withColumnRenamed("node", "_node")
    placed = store(crowd.join(roots, F.col("node") == F.col("_node"), "left").select("lead", "node", F.coalesce("root", "node").alias("root")), "similar-placed")
    sized = placed.join(nodes.select(F.col("node").alias("_node"), "n"), F.col("node") == F.col("_node"))
    chunks = F.greatest(F.ceil(F.sum("n") / TILE), F.ceil(F.count(F.lit(1)) / SETS))
    mixed = sized.groupBy("lead").agg(F.min("root").alias("low"), F.max("root").alias("high"), chunks.alias("chunks")).where("low <> high").select("lead", "chunks")
    mixed = store(mixed, "similar-mixed")
    # The chunks of a cluster meet pair by pair: each is copied once for every other chunk it meets.
    chunked = placed.join(beside(mixed), "lead").select(F.col("node").alias("_node"), "root", "chunks", F.pmod(F.xxhash64("node"), "chunks").alias("chunk"))
    chunked = store(chunked, "similar-chunked")
    tiles = sets.join(beside(chunked), F.col("node") == F.col("_node")).groupBy("lead", "chunks", "chunk").agg(F.collect_list(F.struct("node", "root", "fp", "grams")).alias("own"))
    tiles = store(tiles, "similar-tiles")
    several = tiles.where("chunks > 1")
    left = several.select("lead", F.col("chunk").alias("a"), F.explode(F.sequence("chunk", F.col("chunks") - 1)).alias("b"), F.col("own").alias("one")).where("a <> b")
    pairs = left.join(several.select("lead", F.col("chunk").alias("b"), F.col("own").alias("two")), ["lead", "b"]).select("one", "two")
    # A tile meets itself where it lies.
    pairs = pairs.union(tiles.select(F.col("own").alias("one"), F.col("own").alias("two")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(col: pa.Array):
            flat = col.flatten()
            return flat.field("node").to_numpy(), flat.field("root").to_numpy(), flat.field("fp").to_numpy().view(np.uint64), _lists(flat.field("grams"))

        for batch in batches:
            for k in range(batch.num_rows):
                nodes, root, fp, mine = read(batch.column(0).slice(k, 1))
                nodes2, root2, fp2, theirs = read(batch.column(1).slice(k, 1))
                n, m = np.array([len(x) for x in mine], float), np.array([len(x) for x in theirs], float)
                maybe = (root[:, None] != root2[None, :]) & (np.bitwise_count(fp[:, None] ^ fp2[None, :]) <= radius) & (np.minimum(n[:, None], m) >= least * np.maximum(n[:, None], m) - 1e-9)
                r, c = np.flatnonzero(maybe.any(axis=1)), np.flatnonzero(maybe.any(axis=0))
                if not len(r):
                    continue
                close = maybe[np.ix_(r, c)] & alike(overlaps([mine[i] for i in r], [theirs[j] for j in c]), n[r][:, None], m[c][None, :], least)
                if close.any():
                    ids, label = np.concatenate((nodes[r], nodes2[c])), np.concatenate(forest(close))
                    moved = label != np.arange(len(ids))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], ["u", "v"])

    with batches_of(spark, PAIRS):
        more = store(pairs.mapInArrow(compare, "u long, v long"), "shingle-links")
    for df in (nodes, keys, crowd, sets, tiles, mixed, chunked, placed):
        release(df)
    return near.union(more)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 14, least: float = 0.8) -> DataFrame:
    """id and component_id of every row.

    Texts are linked if their fingerprints (SimHash of the runs of so many
    words, in lower case; a shorter text is one) differ in at most ``radius``
    bits and the Jaccard similarity of their sets of shingles is at least
    ``least``.  component_id is the smallest id reachable, itself included.
    Texts without words link with one another; texts of any length are read
    whole.  Repeated rows are all returned.  Ids may be null: then they name
    no component unless they are all there is.  Extra columns are not read.
    """
    tune(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    own = store(_signed(docs, words, least), "similar-own")
    roots = store(connected_components(link(docs, own, words, radius, least)), "similar-roots").withColumnRenamed("node", "_node")
    nodes = own.groupBy("node").agg(F.min("id").alias("first"))
    labelled = nodes.join(roots, F.col("node") == F.col("_node"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named = labelled.join(labelled.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "component_id")
    return own.select("id", "node").join(named, "node").select(F.col("id").alias(id_col), "component_id")
