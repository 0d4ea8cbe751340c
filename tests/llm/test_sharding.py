"""Balanced label propagation: the law, the quotas, and cut links against the best possible."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest

from beamspark.llm import sharding


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as n", "3 as digest", "4 as size", "5 as part")


def checked(spark, docs, shards=sharding.SHARDS):
    """Rows by shard after checking the law, slots and columns; links cut."""
    rows = sharding.sharded(frame(spark, docs), shards).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert sum(sizes) == len(docs) and max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)
    where = defaultdict(Counter)
    for r in rows:
        where[r["size"], r.text_crc32][r.shard] += 1
    return where, sum(a * b for c in where.values() for a, b in itertools.combinations(c.values(), 2))


def test_groups_stay_together(spark):
    rng = random.Random(1)
    docs = [(i, f"text {rng.randrange(60)}") for i in range(200)] + [(1000 + i, f"alone {i}") for i in range(150)]
    _, cut = checked(spark, docs)
    assert cut == 0


def test_hot_text_fills_whole_shards(spark):
    """A text with half of all rows, another one repeated whole, nulls and empty texts."""
    docs = [(i, "hot") for i in range(320)] + [(9, "again")] * 40 + [(None, None)] * 30 + [(None, "")] * 30 + [(2000 + i, f"alone {i}") for i in range(220)]
    where, _ = checked(spark, docs)
    hot = where[4, zlib.crc32(b"hot")]
    # Three shards whole; the rest meets where linked texts leave room, in two shards at most.
    assert sorted(hot.values())[-3:] == [80, 80, 80] and len(hot) <= 5
    assert len(where[6, zlib.crc32(b"again")]) == 1 and len(where[1, 0]) == 1


def test_nothing_but_one_text(spark):
    where, _ = checked(spark, [(1, "one")] * 83)
    assert sorted(where[4, zlib.crc32(b"one")].values()) == [10] * 5 + [11] * 3


def test_no_room_at_all(spark):
    """Every document is linked, so that shards can only exchange."""
    docs = [(i, f"pair {i // 2}") for i in range(160)]
    _, cut = checked(spark, docs, 4)
    assert cut <= 8  # of 80 links, all of which are cut by the deal; exchanges of two or three shards alone are left


def test_small_and_empty(spark):
    checked(spark, [(1, "a"), (1, "a"), (2, None)])
    assert sharding.sharded(frame(spark, [(1, "a")]).limit(0)).count() == 0
    checked(spark, [(1, "x" * 500_000), (2, "x" * 500_000), (3, "y")], 2)


def test_few_sizes_against_all_placements(spark):
    """Groups of 3, 3, 2 and two single documents over two shards of five: no link need be cut."""
    docs = [(i, "aaa"[:3]) for i in range(3)] + [(i, "bb") for i in range(3)] + [(i, "c") for i in range(2)] + [(1, "d"), (2, "e")]
    _, cut = checked(spark, docs, 2)
    assert cut == 0


@pytest.mark.parametrize("seed", range(20))
def test_quotas(seed):
    rng = random.Random(seed)
    k = 5
    wanted = {(s, t): rng.randrange(20) for s in range(k) for t in range(k) if s != t and rng.random() < 0.7}
    room = [rng.choice([0, 0, 3, 10]) for _ in range(k)]
    moved = sharding.quotas(wanted, room)
    gain = [sum(n for (_, t), n in moved.items() if t == i) - sum(n for (s, _), n in moved.items() if s == i) for i in range(k)]
    assert all(0 < n <= wanted[m] for m, n in moved.items()) and all(g <= r for g, r in zip(gain, room, strict=True))
    # Nothing is left that a pair or free room could still serve.
    rest = {m: n - moved.get(m, 0) for m, n in wanted.items()}
    assert not any(n and rest.get((t, s), 0) for (s, t), n in rest.items())
    assert not any(n and room[t] - gain[t] for (s, t), n in rest.items())
