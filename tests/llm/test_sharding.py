import random
import zlib
from collections import defaultdict
from itertools import accumulate

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm.sharding import OrderedSizes, alone, shard


def brute(sizes, shards):
    ends = [0, *accumulate(sizes)]
    lo = max([0, *sizes])
    while True:
        at, used = 0, 0
        while at < len(sizes):
            nxt = max(i for i in range(at, len(ends)) if ends[i] - ends[at] <= lo)
            at, used = nxt, used + 1
        if used <= shards:
            return lo
        lo += 1


def sizes_of(groups, reach=0):
    by = defaultdict(list)
    for h, n in groups:
        by[int.from_bytes(h[:2], "big")].append((h, n))
    return OrderedSizes({b: sum(n for _, n in x) for b, x in by.items()}, lambda ranges: {b: by[b] for b in by if any(x <= b <= y for x, y in ranges)}, reach)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40), st.integers(1, 8), st.integers(1, 4000))
def test_capacity_is_the_smallest(sizes, shards, step):
    got = sizes_of([((i * step % 65536).to_bytes(2, "big") + i.to_bytes(30, "big"), n) for i, n in enumerate(sizes)], step % 4)
    order = [n for _, n in sorted(((i * step % 65536, i), n) for i, n in enumerate(sizes))]
    assert got.capacity(shards) == brute(order, shards)
    ends = [0, *got.cuts(shards), got.total]
    assert all(0 <= b - a <= got.capacity(shards) for a, b in zip(ends, ends[1:], strict=False))
    assert len(ends) == shards + 1


def test_alone():
    assert alone([90, 2, 2, 2, 2, 2], 100, 4) == 1
    assert alone([10, 10, 10], 30, 3) == 0
    assert alone([5], 5, 1) == 0


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    out = [(i, "x" * rnd.randrange(200) + str(i)) for i in range(300)]
    out += [(1000 + i, "the same text again " * 9) for i in range(150)]
    return out + [(5000, None), (5001, None), (5002, ""), (5003, "é" * 70000), (7, out[7][1]), (None, "no id")]


def test_shard(spark, rows):
    got = shard(spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, shard int, slot string"), 8).collect()
    assert len(got) == len(rows)
    text = defaultdict(set)
    for i, t in rows:
        text[i].add(t)
    load, slots, where = defaultdict(int), defaultdict(list), defaultdict(set)
    for r in got:
        t = next(iter(text[r.doc_id]))
        raw = (t or "").encode()
        assert r.size == len(raw) + 8 and r.law == "bytes" and r.grown_shard is None
        assert r.text_crc32 == (None if t is None else zlib.crc32(raw))
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[t].add(r.shard)
    assert all(len(x) == 1 for x in where.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert set(load) == set(range(8))
    assert sorted(load.values())[-1] == 140008  # the largest text alone
    rest = sorted(load.values())[:-2]
    assert rest[-1] <= rest[0] * 1.25


def test_shard_empty(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = shard(spark.createDataFrame([(3, "a")], "doc_id long, text string")).collect()
    assert [(r.shard, r.slot) for r in one] == [(0, 0)]
