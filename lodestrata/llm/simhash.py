"""SimHash near-duplicates: fingerprints and their tiled exact comparison."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import batches_of, release, slices, store, tune
from .components import connected_components

SEED = 42
LANES, LANE_BITS = 4, 16
#: Fingerprints in a tile, about; and where the radius is wide, where a tile is compared in blocks.
TILE, WIDE, BLOCK = 256, 65_536, 1024
#: Bytes of a wide tile, about, and words of sketches that are compared at once.
ROOM, WORDS = 8 << 20, 1 << 17
#: Bytes of a text that are split into words at once.
PIECE = 1 << 22
_space = re.compile(rb"[\x20\x09-\x0D]")


def hashed(text: str | None, words: int) -> Iterator[list[int]]:
    """The shingle hashes of a text, piece by piece: runs of so many words, repeats
    included; a text with fewer words is one shingle."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    at, carry, some = 0, [], False
    digest = xxhash.xxh64_intdigest
    while True:
        end = len(raw)
        if end - at > PIECE and (m := _space.search(raw, at + PIECE)):
            end = m.start()
        own = carry + raw[at:end].split()
        joined = b" ".join(own)
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        if len(own) >= words:
            some = True
            yield [digest(joined[s:e], SEED) for s, e in zip(starts[: len(own) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
        elif end == len(raw) and not some and own:
            yield [digest(joined, SEED)]
        if end == len(raw):
            break
        carry, at = own[-(words - 1) :] if words > 1 else [], end


class Bits:
    """How often each bit is set in some hashes."""

    def __init__(self):
        self.ones, self.n = np.zeros(64, np.int64), 0

    def add(self, hashes: np.ndarray) -> None:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.ones += bits.sum(axis=0, dtype=np.int64)
        self.n += len(hashes)

    def fingerprint(self) -> int:
        """The bits set in over half the hashes; zero if there are none."""
        return int(np.packbits(2 * self.ones > self.n, bitorder="little").view(np.uint64)[0]) if self.n else 0


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text: a bit is 1 if set in over half the shingle hashes.

    Shingles are runs of so many words, repeats included; a text with fewer
    words is one shingle, and a text without words has fingerprint zero.
    """
    bits = Bits()
    for hashes in hashed(text, words):
        bits.add(np.array(hashes, np.uint64))
    return bits.fingerprint()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """id and fp (the fingerprint as a signed long) of every row."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, rows.select("id").schema.add("fp", "long"))


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a table of links between two lists, a label of each member: equal where links connect."""
    rows, cols = near.shape
    a, b, none = np.arange(rows), np.arange(rows, rows + cols), rows + cols
    while True:
        b2 = np.minimum(b, np.where(near, a[:, None], none).min(axis=0))
        a2 = np.minimum(a, np.where(near, b2[None, :], none).min(axis=1))
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def spanning(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest number each of 0 to n - 1 reaches by the edges u, v."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
    return label


def steps(radius: int, lanes: int = LANES) -> list[tuple[int, ...]]:
    """Differences of lane counts that two fingerprints within the radius can have, one of each sign."""
    found = [d for d in itertools.product(range(-radius, radius + 1), repeat=lanes) if sum(map(abs, d)) <= radius]
    return [d for d in found if d >= (0,) * lanes]


def link(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Edges u, v that connect all distinct fingerprints (column fp) within the radius.

    Tiles hold fingerprints with equal population counts in each 16-bit lane.
    The counts of two fingerprints that differ in at most ``radius`` bits
    differ by no more than that in total, so only such pairs of tiles meet;
    the others are skipped.  Within a pair of tiles all members are compared
    by exclusive-or and bit count.  A pair of tiles returns a spanning forest
    of the links found, at most one edge for each member, never all pairs of a
    group of copies.
    """
    lane = lambda k: F.bit_count(F.shiftrightunsigned("fp", LANE_BITS * k).bitwiseAND((1 << LANE_BITS) - 1))
    base = LANE_BITS + 1
    signed = fps.select("fp").distinct().select("fp", *[lane(k).alias(f"c{k}") for k in range(LANES)])
    counts = [f"c{k}" for k in range(LANES)]
    nodes = store(signed, "simhash-nodes")
    # At most 17^4 = 83,521 rows, whatever the input: a proven bound for the broadcast.
    chunks = nodes.groupBy(*counts).agg(F.ceil(F.count(F.lit(1)) / TILE).alias("chunks"))
    tiles = store(
        nodes.join(F.broadcast(chunks), counts)
        .groupBy(*counts, F.pmod(F.xxhash64("fp"), "chunks").cast("int").alias("chunk"))
        .agg(F.collect_list("fp").alias("fps"))
        .withColumn("sig", sum(F.col(f"c{k}") * base**k for k in range(LANES))),
        "simhash-tiles",
    )
    moves = F.array(*[F.struct(*[F.lit(x).alias(f"d{k}") for k, x in enumerate(d)]) for d in steps(radius)])
    left = tiles.select("*", F.explode(moves).alias("d"))
    inside = [F.col(f"c{k}") + F.col(f"d.d{k}") for k in range(LANES)]
    left = left.where(" and ".join(f"c{k} + d.d{k} between 0 and {LANE_BITS}" for k in range(LANES))).select(
        sum(x * base**k for k, x in enumerate(inside)).alias("sig"),
        (F.col("sig") == sum(x * base**k for k, x in enumerate(inside))).alias("same"),
        F.col("chunk").alias("left_chunk"),
        F.col("fps").alias("left_fps"),
    )
    pairs = left.join(tiles.select("sig", "chunk", "fps"), "sig").where("not same or left_chunk <= chunk").select("left_fps", "fps", (F.col("same") & (F.col("left_chunk") == F.col("chunk"))).alias("self"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            one, two = batch.column(0), batch.column(1)
            mine, theirs = one.values.to_numpy().view(np.uint64), two.values.to_numpy().view(np.uint64)
            i, j = one.offsets.to_numpy(), two.offsets.to_numpy()
            for k, own in enumerate(batch.column(2).to_pylist()):
                a, b = mine[i[k] : i[k + 1]], theirs[j[k] : j[k + 1]]
                near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
                if own:
                    np.fill_diagonal(near, False)
                if near.any():
                    la, lb = forest(near)
                    both = np.concatenate((a, b))
                    label = np.concatenate((la, lb))
                    moved = label != np.arange(len(both))
                    us.append(both[moved])
                    vs.append(both[label[moved]])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], ["u", "v"])

    return pairs.mapInArrow(compare, "u long, v long")


def sketch(own: np.ndarray, least: float) -> np.ndarray:
    """The parities of how many members of a set of hashes fall on each of 2^k places, a bit a place.

    Sketches of two sets differ in no more bits than the sets in members,
    whatever the number of places, and sets of n and m members with a Jaccard
    similarity of ``least`` differ in no more than apart(least) (n + m)
    members.  With as many places as here, sets that have nothing in common
    differ in more bits than that, but for small ones.
    """
    places = 1 << min(17, max(6, int(np.ceil(np.log2(8 * apart(least) * len(own) + 1)))))
    odd = np.bincount((own & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def apart(least: float) -> float:
    """The share of n + m in which sets of n and m members of that similarity differ at most."""
    return (1 - least) / (1 + least)


def folded(values: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """Sketches, which lie one after another from the given places, as rows of so many words."""
    out, length = np.zeros((len(at) - 1, words), np.uint64), np.diff(at)
    for w in np.unique(length):
        rows = np.flatnonzero(length == w)
        out[rows] = np.bitwise_xor.reduce(values[at[rows][:, None] + np.arange(w)].reshape(len(rows), w // words, words), axis=1)
    return out


def link_sized(nodes: DataFrame, radius: int, ratio: float) -> DataFrame:
    """Edges u, v that connect all nodes whose fingerprints lie within a wide
    radius and whose sketches and sizes allow a similarity of ratio.

    nodes: node (long, distinct), fp, n (a size) and sketch.  Tiles hold
    fingerprints of one class of sizes, a factor of 1 / ratio wide, and of one
    range of population counts, wider than the radius.  Only tiles of the same
    or the next class of sizes, and of the same or the next range, meet.  A
    task sorts the members of two tiles by population count and compares them
    in blocks; blocks whose counts differ by more than the radius are skipped.
    Every member of a pair of blocks is compared by exclusive-or and bit count.
    Pairs within the radius, of which chance makes more with every text, are
    then compared by their sketches, unless they are connected already: no
    pair of the similarity is lost, and next to none is left that lies far
    below.  The pair of tiles returns a spanning forest.  A tile is copied once
    for each tile it meets, so tiles are large.
    """
    group = max(16, radius + 1)
    size = F.when(F.col("n") > 0, F.floor(F.log("n") / F.log(F.lit(1 / ratio)) + 1e-9)).otherwise(-9).cast("int")
    # The middle range is centred at 32, the commonest count.
    ones = F.floor((F.bit_count("fp") - 32 + group / 2) / group).cast("int")
    cells = nodes.select("node", "fp", F.col("n").cast("int").alias("n"), "sketch", size.alias("size"), ones.alias("ones"))
    # At most 5 ranges for each class of sizes, of which there are 196 at most for a ratio of 0.8.
    room = F.sum(F.lit(64) + 8 * F.size("sketch")) / ROOM
    counted = cells.groupBy("size", "ones").agg(F.ceil(F.greatest(F.count(F.lit(1)) / WIDE, room)).cast("int").alias("chunks"))
    tiles = store(
        cells.join(F.broadcast(counted), ["size", "ones"]).groupBy("size", "ones", F.pmod(F.xxhash64("node"), "chunks").cast("int").alias("chunk")).agg(F.collect_list(F.struct("node", "fp", "n", "sketch")).alias("own")),
        "simhash-tiles",
    )
    moves = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(o).alias("o")) for s, o in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    meets = counted.select("size", "ones", F.explode(moves).alias("d"), F.col("chunks").alias("n1")).selectExpr("size", "ones", "size + d.s as size2", "ones + d.o as ones2", "n1")
    meets = meets.join(F.broadcast(counted.selectExpr("size as size2", "ones as ones2", "chunks as n2")), ["size2", "ones2"])
    meets = meets.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n1") - 1))).withColumn("chunk2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)))
    meets = meets.where("size <> size2 or ones <> ones2 or chunk <= chunk2").select("size", "ones", "chunk", "size2", "ones2", "chunk2")
    right = tiles.selectExpr("size as size2", "ones as ones2", "chunk as chunk2", "own as theirs")
    pairs = meets.join(tiles, ["size", "ones", "chunk"]).join(right, ["size2", "ones2", "chunk2"])
    pairs = pairs.select(F.expr("size = size2 and ones = ones2 and chunk = chunk2").alias("same"), "own", "theirs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(col: pa.Array):
            flat = col.flatten()
            fp, lists = flat.field("fp").to_numpy().view(np.uint64), flat.field("sketch")
            ones = np.bitwise_count(fp).astype(int)
            order = np.argsort(ones, kind="stable")
            return *(y[order] for y in (flat.field("node").to_numpy(), fp, flat.field("n").to_numpy().astype(float), ones)), order, lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy().astype(np.int64)

        for batch in batches:
            for k, same in enumerate(batch.column(0).to_pylist()):
                node, fp, n, ones, order, values, at = read(batch.column(1).slice(k, 1))
                node2, fp2, n2, ones2, order2, values2, at2 = read(batch.column(2).slice(k, 1))
                words = min(np.diff(at).min(), np.diff(at2).min())
                sketched, sketched2 = folded(values, at, words)[order], folded(values2, at2, words)[order2]
                us, vs = [], []
                for i in range(0, len(fp), BLOCK):
                    a = slice(i, i + BLOCK)
                    for j in range(i if same else 0, len(fp2), BLOCK):
                        b = slice(j, j + BLOCK)
                        if ones2[b][0] - ones[a][-1] > radius:
                            break
                        if ones[a][0] - ones2[b][-1] > radius:
                            continue
                        rows, cols = len(fp[a]), len(fp2[b])
                        near = np.bitwise_count(fp[a, None] ^ fp2[None, b]) <= radius
                        if same and i == j:
                            np.fill_diagonal(near, False)
                        r, c = np.nonzero(near)
                        fit = np.minimum(n[a][r], n2[b][c]) >= ratio * np.maximum(n[a][r], n2[b][c]) - 1e-9
                        r, c = r[fit], c[fit]
                        # In a block the members of the second tile are numbered after those of the first.
                        label, step = np.arange(rows + cols), max(1, WORDS // words)
                        for first in range(0, len(r), step):
                            p, q = r[first : first + step], c[first : first + step]
                            new = label[p] != label[rows + q]
                            p, q = p[new], q[new]
                            most = apart(ratio) * (n[a][p] + n2[b][q]) + 1e-6
                            may = np.bitwise_count(sketched[i + p] ^ sketched2[j + q]).sum(axis=1, dtype=np.int64) <= most
                            label = spanning(label[p[may]], label[rows + q[may]], rows + cols)[label]
                        moved = np.flatnonzero(label != np.arange(rows + cols))
                        if len(moved):
                            place = np.concatenate((i + np.arange(rows), len(fp) + j + np.arange(cols)))
                            us.append(place[moved])
                            vs.append(place[label[moved]])
                if us:
                    ids, u, v = np.concatenate((node, node2)), np.concatenate(us), np.concatenate(vs)
                    label = spanning(u, v, len(ids))
                    moved = label != np.arange(len(ids))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], ["u", "v"])

    with batches_of(nodes.sparkSession, 2):
        found = store(pairs.mapInArrow(compare, "u long, v long"), "simhash-links")
    release(tiles)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id of every row.

    Rows whose fingerprints differ in at most ``radius`` bits are linked;
    component_id is the smallest id reachable, itself included.  Null and
    empty texts have fingerprint zero and link like any other.  Repeated rows
    are all returned.  Ids may be null: then they name no component unless
    they are all there is.
    """
    own = store(fingerprints(docs, id_col, text_col, words), "simhash-fp")
    nodes = own.groupBy("fp").agg(F.min("id").alias("first"))
    roots = store(connected_components(link(own, radius)), "simhash-roots")
    labelled = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = labelled.join(least, "root").select("fp", "component_id")
    return own.join(named, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
