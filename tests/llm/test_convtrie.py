"""Conversation trie: the radix tree by itself, and whole tables against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from beamspark.llm import convtrie
from beamspark.llm.radix import Tree

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows, taken=lambda c: 0, source=lambda c: c):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    paths = {c: own.get(source(c), [])[:taken(c)] + v[taken(c):] for c, v in own.items()}
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[tuple(paths[c][:d])].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        kids[p[:-1]] += bool(p)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = set()
    for p, m in members.items():
        ids = ",".join(str(c) for c in m if len(paths[c]) == len(p))
        out.add((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ids.encode()).hexdigest()))
    return out


def found(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "1 as hi", "2 as slice", "'x' as digest", "3 as block", "4 as at")


def contract(c):
    return zlib.crc32(str(c).encode()) % 6


def base(c):
    return c - (abs(c) % 100) * (1 if c >= 0 else -1)


@pytest.mark.parametrize("seed", range(8))
def test_radix_tree(seed):
    rng = random.Random(seed)
    width = rng.choice([2, 16, 256])
    keys = [bytes(rng.randrange(width) for _ in range(rng.choice([0, 1, 2, 3, 7]))) for _ in range(600)]
    tree = Tree(lambda a, b: a + b)
    for k in keys:
        tree.put(k, 1)
    # Every node's subtree: keys that begin with the bytes down to it.
    seen = sorted((finish, value) for _, finish, value in tree.edges())
    want = []
    distinct = set(keys)
    for p in {k[:i] for k in keys for i in range(len(k) + 1)} | {b""}:
        forks = {k[len(p)] for k in distinct if k.startswith(p) and len(k) > len(p)}
        if p in distinct or len(forks) > 1:
            want.append((len(p), sum(k.startswith(p) for k in keys)))
    if all(k[:1] == keys[0][:1] for k in keys) or b"" in distinct or len({k[:1] for k in distinct}) > 1:
        assert seen == sorted(want)


def test_layouts_grow_and_hold():
    tree = Tree(lambda a, b: a + b)
    sizes = []
    for b in range(256):
        tree.put(bytes([b]), 1)
        sizes.append(tree.root.size)
    assert [sizes[i] for i in (3, 4, 15, 16, 47, 48, 255)] == [4, 16, 16, 48, 48, 256, 256]
    assert sorted(b for b in range(256) if tree.root.child(b) is not None) == list(range(256))


def test_odd_tables(spark):
    rows = [(0, 0, "u", "a"), (0, 1, "a", "b"), (0, 2, "u", None), (0, 3, None, "c"), (7, None, "u", "first"), (7, 0, "u", "x"), (7, 0, "u", "x"), (7, 0, "a", "w"),
            (107, 1, "u", "x" * 5000), (-205, 0, "u", "a"), (-200, 0, "u", "é"), (-200, 1, "", ""), (None, 0, "u", "lost"), (None, None, None, None), (1, 0, "u", "a"),
            (8, 0, "u", "a"), (8, 1, "a", "b"), (65536, 4, None, None), (65600, 5, "", "")]
    df = frame(spark, rows)
    assert found(convtrie.trie(df)) == brute(rows)
    assert found(convtrie.trie(df, convtrie.contract_taken(), convtrie.contract_source())) == brute(rows, contract, base)
    assert convtrie.trie(df.limit(0)).count() == 0


def test_many_alike(spark):
    """Copies, growing snapshots of one dialogue, shared beginnings, and one conversation with a third of all rows."""
    rng = random.Random(3)
    rows = [(c, t, "u", f"same {t}") for c in range(300, 380) for t in range(3)]
    rows += [(c, t, "a", f"grows {t}") for c in range(400, 440) for t in range(c - 399)]
    rows += [(5, t, "u", rng.choice("pq")) for t in range(700)] + [(6, t, "u", "p" if t < 200 else "q") for t in range(300)]
    for c in range(600, 700):
        rows += [(c, t, "u", rng.choice("xyz")) for t in range(rng.randrange(1, 9))]
    rng.shuffle(rows)
    assert found(convtrie.trie(frame(spark, rows))) == brute(rows)


def test_small_slices_and_trees(spark, monkeypatch):
    """The same result when every block, slice and tree is tiny."""
    for name, value in (("BLOCK", 3), ("SLICE", 6), ("HELD", 5), ("WIDE", 3)):
        monkeypatch.setattr(convtrie, name, value)
    rng = random.Random(4)
    rows = [(c, t, "u", rng.choice("xy") if t < 12 else "x") for c in range(40) for t in range(rng.randrange(0, 30))]
    rows += [(c, t, "u", "x") for c in (50, 51, 52) for t in range(25)]
    assert found(convtrie.trie(frame(spark, rows), convtrie.contract_taken(), convtrie.contract_source())) == brute(rows, contract, base)
