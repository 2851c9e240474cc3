"""Sharding by minimax contiguous partition.

Rows with equal texts form an atomic group.  Groups are ordered by the SHA-256
of their text, which mixes sources across shards and needs no sort by content.
The shard capacity is the smallest for which a greedy pass over the ordered
group sizes needs no more than the wanted number of shards; it is found by
binary search and the sequence is cut there.

The driver never holds the groups: it holds the sizes of 65,536 blocks (the
first two bytes of the digest), and the groups of only those blocks in which a
cut can fall, about one block for each cut.

A group larger than the mean load of the shards left would leave the others
empty, since it alone sets the capacity; such a group (there are fewer than
shards) gets a shard of its own and the rest is partitioned among the others.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable
from itertools import accumulate, pairwise

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import release, store

BLOCKS = 1 << 16
LAST = bytes([255] * 32)


class OrderedSizes:
    """Prefix sums over ordered groups, known by block and loaded where needed.

    ``load`` maps a list of block ranges (first, last) to {block: [(digest,
    size), ...]}.  With a block its ``reach`` nearest on either side are loaded.
    """

    def __init__(self, sums: dict[int, int], load: Callable[[list[tuple[int, int]]], dict[int, list[tuple[bytes, int]]]], reach: int = 0):
        self.reach = reach
        self.blocks = sorted(b for b, s in sums.items() if s > 0)
        self.ends = list(accumulate(sums[b] for b in self.blocks))
        self.total = self.ends[-1] if self.ends else 0
        self.load, self.inner = load, {}

    def fetch(self, places: list[int]) -> None:
        wanted = {p for p in places if 0 <= p < len(self.blocks)} - self.inner.keys()
        new = sorted({q for p in wanted for q in range(max(0, p - self.reach), min(len(self.blocks), p + self.reach + 1))} - self.inner.keys())
        if new:
            runs = [[self.blocks[new[0]]] * 2]
            for before, p in pairwise(new):
                if p == before + 1:
                    runs[-1][1] = self.blocks[p]
                else:
                    runs.append([self.blocks[p]] * 2)
            got = self.load([(a, b) for a, b in runs])
            for p in new:
                rows = sorted(got.get(self.blocks[p], []))
                start = self.ends[p - 1] if p else 0
                self.inner[p] = ([start + x for x in accumulate(n for _, n in rows)], [h for h, _ in rows])

    def place(self, x: int) -> int:
        """The block in which the running sum passes x."""
        return bisect.bisect_right(self.ends, x)

    def floor(self, x: int) -> int:
        """The largest group end that is at most x."""
        p = self.place(x)
        if p == len(self.blocks):
            return self.total
        self.fetch([p])
        ends = self.inner[p][0]
        k = bisect.bisect_right(ends, x)
        return ends[k - 1] if k else (self.ends[p - 1] if p else 0)

    def ceil(self, x: int) -> int:
        """The smallest group end that is at least x."""
        if x >= self.total:
            return self.total
        p = bisect.bisect_left(self.ends, x)
        self.fetch([p])
        ends = self.inner[p][0]
        return ends[bisect.bisect_left(ends, x)]

    def key(self, end: int) -> bytes:
        """A digest not below those of the groups up to this end, and below the rest."""
        if end <= 0:
            return b""
        p = bisect.bisect_left(self.ends, end)
        if self.ends[p] == end:
            return self.blocks[p].to_bytes(2, "big") + LAST[2:]
        self.fetch([p])
        ends, digests = self.inner[p]
        return digests[bisect.bisect_left(ends, end)]

    def rough(self, capacity: int, shards: int, optimist: bool) -> tuple[bool, list[int]]:
        """Greedy cuts by blocks alone: a block counts as divisible, or not at all."""
        at, cuts = 0, []
        for _ in range(shards):
            x = at + capacity
            p = self.place(x)
            at = self.total if p == len(self.blocks) else x if optimist else max(at, self.ends[p - 1] if p else 0)
            cuts.append(at)
        return at >= self.total, cuts

    def ahead(self, capacity: int, shards: int, at: int) -> None:
        """Load the blocks in which greedy cuts will fall, all at once: cuts are guessed where a block isn't known, a few times."""
        for _ in range(3):
            x, new = at, []
            for _ in range(shards):
                x += capacity
                p = self.place(x)
                if p == len(self.blocks):
                    break
                if p in self.inner:
                    x = self.floor(x)
                else:
                    new.append(p)
            if not new:
                return
            self.fetch(new)

    def fits(self, capacity: int, shards: int, at: int = 0) -> bool:
        self.ahead(capacity, shards, at)
        for _ in range(shards):
            if at >= self.total:
                return True
            at = self.floor(at + capacity)
        return at >= self.total

    def capacity(self, shards: int) -> int:
        """The smallest capacity with which the groups fit into so many shards."""

        def least(lo: int, hi: int, good: Callable[[int], bool]) -> int:
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if good(mid) else (mid + 1, hi)
            return lo

        lo = -(-self.total // shards)
        hi = least(lo, self.total, lambda c: self.rough(c, shards, False)[0])
        return least(lo, hi, lambda c: self.fits(c, shards))

    def cuts(self, shards: int) -> list[int]:
        """Group ends that close each shard but the last: none exceeds the
        smallest capacity, and each is as near to an equal share as that allows."""
        if not self.total:
            return [0] * (shards - 1)
        capacity, at, found = self.capacity(shards), 0, []
        self.fetch([self.place(self.total * k // shards) for k in range(1, shards)])
        for left in range(shards, 1, -1):
            share = at + -(-(self.total - at) // left)
            for end in (self.ceil(share), self.floor(share), self.floor(at + capacity)):
                if end - at <= capacity and self.fits(capacity, left - 1, end):
                    break
            found.append(at := end)
        return found


def alone(sizes: list[int], total: int, shards: int) -> int:
    """How many of the largest sizes (in falling order) get a shard of their own."""
    n = 0
    while n < min(len(sizes), shards - 1) and sizes[n] * (shards - n) > total:
        total -= sizes[n]
        n += 1
    return n


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of the shards, sizes near equal, equal texts together.

    Size: UTF-8 bytes of the text plus 8; a null text has none, and all null
    texts form one group.  Returns id, size, text_crc32 (null for a null text),
    law ('bytes'), shard, slot (gapless from 0 in each shard, in order of digest
    and id) and grown_shard (null: this law gives no promise for one more
    shard).  Repeated rows are all kept.  An empty table gives no rows; with
    fewer groups than shards some shards are empty.
    """
    digest = F.sha2(F.col("text"), 256)
    rows = store(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).select(
            "id",
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
            F.crc32("text").alias("crc"),
            F.coalesce(F.unhex(digest), F.lit(b"")).alias("h"),
            F.coalesce(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"), F.lit(0)).alias("block"),
        ),
        "shard-rows",
    )
    # One narrow shuffle: a hot group spreads over partitions, as the id is part of the key.
    ranked = store(
        rows.repartitionByRange("h", "id").sortWithinPartitions("h", "id").withColumn("seq", F.monotonically_increasing_id()).withColumn("pid", F.shiftright("seq", 33)),
        "shard-ranked",
    )
    groups = ranked.groupBy("block", "h").agg(F.sum("size").alias("size"))
    per_block = ranked.groupBy("block").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    sums = {r["block"]: r["size"] for r in per_block}
    largest = [(r["size"], bytes(r["h"]), r["block"]) for r in groups.orderBy(F.desc("size"), "h").limit(shards).collect()]
    own = largest[: alone([x[0] for x in largest], sum(sums.values()), shards)]
    for size, _, block in own:
        sums[block] -= size
    giants = {h for _, h, _ in own}

    def load(ranges: list[tuple[int, int]]) -> dict[int, list[tuple[bytes, int]]]:
        found: dict[int, list[tuple[bytes, int]]] = {}
        near = F.lit(False)
        for first, last in ranges:
            near = near | F.col("block").between(first, last)
        for r in ranked.where(near).groupBy("block", "h").agg(F.sum("size").alias("size")).collect():
            if bytes(r["h"]) not in giants:
                found.setdefault(r["block"], []).append((bytes(r["h"]), r["size"]))
        return found

    # Where blocks hold few rows, some of their neighbours come along: a few hundred rows for each cut.
    sizes = OrderedSizes(sums, load, reach=256 * len(per_block) // max(1, sum(r["n"] for r in per_block)))
    keys = [sizes.key(end) for end in sizes.cuts(shards - len(own))]

    # Segments: runs of the order that lie in one shard.  A lifted group is a segment inside another shard's range.
    marks = sorted([(k, 1, None) for k in keys] + [(h, after, h) for h in giants for after in (0, 1)], key=lambda m: m[:2])
    segment = F.lit(0)
    for key, after, _ in marks:
        segment = segment + (F.col("h") > F.lit(key) if after else F.col("h") >= F.lit(key)).cast("int")
    lifted = {h: n for n, (_, h, _) in enumerate(own)}
    at = len(own)
    shard_of = [at]
    for _, after, giant in marks:
        at += giant is None
        shard_of.append(lifted[giant] if giant is not None and not after else at)
    laid = ranked.withColumn("segment", segment)
    parts = sorted((r["segment"], r["pid"], r["first"], r["n"]) for r in laid.groupBy("segment", "pid").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n")).collect())
    filled, base = [0] * shards, []
    for seg, pid, first, n in parts:
        base.append((seg, pid, shard_of[seg], filled[shard_of[seg]] - first))
        filled[shard_of[seg]] += n
    # At most a row for each partition and segment: a bound set by the layout, not by the documents.
    spark = docs.sparkSession
    starts = spark.createDataFrame(base, "segment int, pid long, shard int, shift long")
    release(rows)
    return laid.join(F.broadcast(starts), ["segment", "pid"]).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("seq") + F.col("shift")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
