"""Embedding near-duplicates by a pivot-permutation index.

Every vector is described by the order of its nearest reference points: the
``prefix`` nearest of the pivots, nearest first.  The inverted list of a pivot
holds the vectors that have it in first place, so each vector once; a vector
looks up the lists of the first ``probes`` pivots in its order.  Of what it
finds there, those that share enough pivots with it, or one to which both are
close, are candidates, and are verified by their cosine in double precision.
A pair that meets in two lists counts in the one of the smaller pivot.

Pivots lie apart: no two are as near as a link.  A dense group, however large
its share of the table, so has few pivots, and the order of the others tells
its members' places as it does for any vector.  The number of pivots grows
with the square root of the number of vectors, and so do the lists: all pairs
of a lookup are some N^1.5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .base import batches_of, release, store
from .components import connected_components
from .simhash import forest

#: Vectors of an inverted list in one tile, about.
TILE = 1024
#: Pairs of tiles in one Arrow batch.
PAIRS = 2
#: The number of pivots: the square root of the number of vectors, within these bounds.
FEWEST, MOST = 256, 4096
#: Vectors among which each pivot is chosen.
DRAWN = 16
#: Cosines that pivots stay below, tried in this order while there are too few; the link's own is the last.
APART = (0.4, 0.5, 0.6, 0.7, 0.8)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows or vanishes."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def spread(drawn: np.ndarray, pivots: int, threshold: float) -> np.ndarray:
    """Up to so many of the drawn unit vectors, in their order, no two with a cosine of the threshold or more.

    Wide distances come first: nearer ones are taken only while there are too few.
    """
    taken = np.zeros(len(drawn), bool)
    nearest = np.full(len(drawn), -np.inf)
    for least in [x for x in APART if x < threshold] + [threshold]:
        for k in range(len(drawn)):
            if taken.sum() == pivots:
                break
            if not taken[k] and nearest[k] < least:
                taken[k] = True
                nearest = np.maximum(nearest, drawn @ drawn[k])
    return drawn[taken]


def prefixes(x: np.ndarray, pivots: np.ndarray, prefix: int, close: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivots of each row, nearest first (of equals the smaller number), and how many of them have a cosine of ``close``."""
    cosine = x @ pivots.T
    near = np.argsort(-cosine, axis=1, kind="stable")[:, :prefix]
    return near.astype(np.int32), (np.take_along_axis(cosine, near, axis=1) >= close).sum(axis=1).astype(np.int32)


def bits_of(near: np.ndarray, count: np.ndarray | None, known: np.ndarray) -> np.ndarray:
    """A bit for each of the known pivots (sorted) in the first ``count`` places of each row."""
    at = np.minimum(np.searchsorted(known, near), len(known) - 1)
    held = known[at] == near
    if count is not None:
        held &= np.arange(near.shape[1]) < count[:, None]
    out = np.zeros((len(near), -(-len(known) // 64) * 64), np.uint8)
    r, c = np.nonzero(held)
    out[r, at[r, c]] = 1
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def candidates(near: np.ndarray, close: np.ndarray, near2: np.ndarray, close2: np.ndarray, shared: int) -> np.ndarray:
    """Which pairs share enough pivots, or one close to both."""
    known = np.unique(near2)
    count = np.zeros((len(near), len(near2)), np.uint16)
    for a, b in zip(bits_of(near, None, known).T, bits_of(near2, None, known).T, strict=True):
        count += np.bitwise_count(a[:, None] & b[None, :])
    enough = count >= shared
    if close.any() and close2.any():
        for a, b in zip(bits_of(near, close, known).T, bits_of(near2, close2, known).T, strict=True):
            enough |= (a[:, None] & b[None, :]) != 0
    return enough


def _links(nodes: DataFrame, width: int, threshold: float, pivots: int | None, prefix: int, probes: int, shared: int) -> DataFrame:
    """nid, root, n: for each pair of tiles, what its members are linked with there, and with how many vectors."""
    spark = nodes.sparkSession
    pivots = pivots or min(MOST, max(FEWEST, math.isqrt(nodes.count())))
    # A bounded sample of reference points, from the vectors with the smallest hashes.
    drawn = np.array([r.vec for r in nodes.orderBy(F.xxhash64("vec"), "nid").limit(DRAWN * pivots).collect()])
    chosen = spread(unit(drawn), pivots, threshold)
    shared, probes = min(shared, len(chosen)), min(probes, len(chosen))
    # A vector linked with one within the threshold of a pivot has at least this cosine to the pivot.
    close = 2 * threshold * threshold - 1 if threshold > 0 else -1.0
    points = spark.sparkContext.broadcast(chosen)
    vec = nodes.schema["vec"].dataType

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, n_close = prefixes(unit(rows_of(batch.column(1), width)), points.value, prefix, close)
                wrapped = pa.FixedSizeListArray.from_arrays(pa.array(near.reshape(-1)), near.shape[1]).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), wrapped, pa.array(n_close)], ["nid", "vec", "copies", "near", "close"])

    schema = StructType().add("nid", "long").add("vec", vec).add("copies", "long").add("near", ArrayType(IntegerType())).add("close", IntegerType())
    index = store(nodes.select("nid", "vec", "copies").mapInArrow(describe, schema), "pivot-index")
    # Lookups in the own list, and in those of the next pivots of the order; of these a vector is no member.
    lookups = index.select("*", F.posexplode(F.slice("near", 1, probes)).alias("place", "pivot")).withColumn("member", F.col("place") == 0)
    # Two rows for each pivot: a fixed bound for the broadcasts.
    counts = lookups.groupBy("pivot").agg(F.ceil(F.count_if("member") / TILE).cast("int").alias("members"), F.ceil(F.count_if(~F.col("member")) / TILE).cast("int").alias("others")).where("members > 0")
    counts = store(counts, "pivot-counts")
    chunk = F.pmod(F.xxhash64("nid"), F.when(F.col("member"), F.col("members")).otherwise(F.col("others"))).cast("int")
    dealt = lookups.join(F.broadcast(counts), "pivot").withColumn("chunk", chunk)
    own = F.collect_list(F.struct("nid", "copies", "near", "close", "vec"))
    # A tile of lookups is copied once for each tile of members it meets: no pair of tiles waits for another.
    left = dealt.groupBy("pivot", "member", "chunk", "members").agg(own.alias("one"))
    left = left.withColumn("met", F.explode(F.sequence(F.when(F.col("member"), F.col("chunk")).otherwise(0), F.col("members") - 1)))
    right = dealt.where("member").groupBy("pivot", F.col("chunk").alias("met")).agg(own.alias("two"))
    pairs = left.join(right, ["pivot", "met"]).select("pivot", "member", (F.col("member") & (F.col("chunk") == F.col("met"))).alias("same"), "one", "two")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(col: pa.Array):
            flat = col.flatten()
            nid, copies, close = (flat.field(k).to_numpy() for k in ("nid", "copies", "close"))
            near = flat.field("near").flatten().to_numpy().reshape(len(nid), -1)
            return nid, copies, near, close, unit(rows_of(flat.field("vec"), width))

        for batch in batches:
            for k in range(batch.num_rows):
                pivot, member, same = (batch.column(c)[k].as_py() for c in range(3))
                nid, copies, order, n_close, x = one = read(batch.column(3).slice(k, 1))
                nid2, copies2, order2, n_close2, x2 = one if same else read(batch.column(4).slice(k, 1))
                near = candidates(order, n_close, order2, n_close2, shared)
                if same:
                    np.fill_diagonal(near, False)
                if not member:
                    # Looked up the other way round, the pair meets in the list of the smaller pivot instead.
                    for first in np.unique(order[:, 0]):
                        if first < pivot:
                            near[np.ix_(order[:, 0] == first, (order2[:, :probes] == first).any(axis=1))] = False
                r, c = near.any(axis=1), near.any(axis=0)
                near = near[np.ix_(r, c)] & (x[r] @ x2[c].T >= threshold)
                if not near.any():
                    continue
                ids, label = np.concatenate((nid[r], nid2[c])), np.concatenate(forest(near))
                # In a tile with itself each pair stands twice in the table, once in each half.
                n = np.concatenate((near @ copies2[c], np.zeros(c.sum(), np.int64) if same else near.T @ copies[r]))
                hit = (n > 0) | (label != np.arange(len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(ids[label[hit]]), pa.array(n[hit].astype(np.int64))], ["nid", "root", "n"])

    with batches_of(spark, PAIRS):
        found = store(pairs.mapInArrow(verify, "nid long, root long, n long"), "pivot-links")
    release(index)
    release(counts)
    return found


def near_duplicates(rows: DataFrame, threshold: float = 0.9, pivots: int | None = None, prefix: int = 10, probes: int = 6, shared: int = 2, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id and kept of every vector.

    All pairs that the index retrieves are verified: only cosines of at least
    ``threshold`` link.  Vectors that are null, zero, empty or hold null or
    non-finite components link with nothing; vectors of different length never
    link.  Equal vectors are one node of the index, so groups of copies cost
    nothing: n_links counts the copies.  Rows with one id count each.
    component_id is the smallest id reachable, the own one included.  Extra
    columns are not read; an empty table gives no rows.

    Links are gathered for each member of a pair of tiles (a count and one
    edge of a spanning forest), never for each pair.
    """
    v = F.col(vec_col)
    numeric = rows.schema[vec_col].dataType.elementType.typeName() == "float"
    vec = v if numeric else v.cast("array<double>")
    biggest = F.array_max(F.transform(vec, F.abs))
    good = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (biggest > 0), F.lit(False))
    # 128 bits stand for a vector in joins.
    keyed = [F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(1), "vec").alias("k2")]
    own = rows.select(F.col(id_col).alias("id"), F.when(good, vec).alias("vec"))
    nodes = own.where("vec is not null").groupBy("vec").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).withColumn("nid", F.monotonically_increasing_id())
    nodes = store(nodes, "pivot-nodes")
    # Vectors of one length at a time; a table normally has one length.
    widths = [r[0] for r in nodes.select(F.size("vec")).distinct().collect()]
    links = None
    for width in sorted(widths):
        part = _links(nodes.where(F.size("vec") == width), width, threshold, pivots, prefix, probes, shared)
        links = part if links is None else links.union(part)
    if links is None:
        return own.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    counts = links.groupBy("nid").agg(F.sum("n").alias("n"))
    roots = connected_components(links.select(F.col("nid").alias("u"), F.col("root").alias("v")))
    named = nodes.select("nid", "first", "copies", *keyed).join(roots, F.col("nid") == F.col("node"), "left").join(counts, "nid", "left")
    named = store(named.select("k1", "k2", "first", F.coalesce("root", "nid").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "pivot-named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("k1", "k2", "n_links", "component_id")
    release(nodes)
    component = F.coalesce("component_id", "id")
    keys = own.select("id", *[F.when(F.col("vec").isNotNull(), k).alias(name) for k, name in zip(keyed, ("k1", "k2"), strict=True)])
    return keys.join(named, ["k1", "k2"], "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
