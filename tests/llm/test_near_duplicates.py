"""The pipeline's near-duplicate stage, and the join at its five words and 80 percent, against all pairs."""

import itertools
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from beamspark.llm import setjoin

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(t):
    w = re.findall("[^\\x20\\x09-\\x0D]+", (t or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute(docs):
    sets = {d: shingles(t) for d, t in docs}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        inter = len(x & y)
        if inter and 100 * inter >= 80 * (len(x) + len(y) - inter):
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    return sorted((d, len(sets[d]), root(d)) for d in sets)


def made(seed):
    """Texts with 0 to 30 % of words added or a few changed, on either side of the limit; 0.8 itself is met often."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(10 ** 6)}"
    docs = ["", None, "one", "One", "a b c d", "a b c d e", "a b c d e f"]
    for size in (5, 6, 8, 9, 12, 14, 16, 20, 24, 29, 44, 84, 204, 404):
        base = [word() for _ in range(size)]
        docs.append(" ".join(base))
        for share in (0.0, 0.08, 0.12, 0.2, 0.25, 0.26, 0.3):
            docs.append(" ".join(base + [word() for _ in range(round((size - 4) * share))]))
        for changes in {1, 2, max(1, round(size * 0.02)), max(1, round(size * 0.025))}:
            t = list(base)
            for k in rnd.sample(range(size), changes):
                t[k] = word()
            docs.append(" ".join(t))
    rnd.shuffle(docs)
    return list(enumerate(docs))


def test_stage_keeps_one_of_each_group(spark):
    docs = made(1)
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, df.repartition(4), "")
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [d for d, _, c in brute(docs) if d == c]


def test_added_text_is_a_copy(spark):
    base = [f"w{i}" for i in range(404)]  # 400 runs of five words
    docs = [(0, base), (1, base + [f"x{i}" for i in range(100)]), (2, [f"y{i}" for i in range(101)] + base)]  # 400/500, 400/501 of the first
    df = spark.createDataFrame([(d, " ".join(t), "en", "s", 0) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [0, 2]


@pytest.mark.parametrize("largest", [None, 0, 7, setjoin.SMALL // 2])
def test_boundary_does_not_change_links(spark, monkeypatch, largest):
    if largest is not None:
        monkeypatch.setattr(setjoin, "boundary", lambda c, p: largest)
    monkeypatch.setattr(setjoin, "BLOCK", 3)
    docs = made(2)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = setjoin.jaccard_components(df, gram=5, percent=80)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(docs)


def test_parts_and_subset_sizes_at_80():
    for n in range(1, 400):
        for m in range(-(-80 * n // 100), n + 1):
            shared = int(setjoin.need(np.int64(n), np.int64(m), 80))
            if shared > m:
                continue
            assert 100 * shared >= 80 * (n + m - shared) and 100 * (shared - 1) < 80 * (n + m - shared + 1)
            level, lower = setjoin.levels(np.array([n, m]), 80)
            assert 0 <= level - lower <= 1
            parts, spare = (int(x[0]) for x in setjoin.parts_of(np.array([level]), 80))
            # Each element that one set lacks spoils one part at most: a part beyond the spare ones is the same in both.
            assert parts - spare > n + m - 2 * shared
            if n <= setjoin.SMALL and not n == m == shared:
                assert shared in setjoin.subset_sizes(n, 80) and shared in setjoin.subset_sizes(m, 80)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_list_a_part_in_common(percent):
    """Sets at the limit, either way round: one listed part is the same, though the emptiest parts are left out."""
    rnd = np.random.default_rng(percent)
    for m in (3, 5, 9, 10, 20, 33, 64, 150, 400):
        for n in {m, m - 1, max(1, -(-percent * m // 100))}:
            for _ in range(20):
                shared = int(setjoin.need(np.int64(n), np.int64(m), percent))
                if shared > min(n, m):
                    continue
                e = rnd.integers(0, 2 ** 64, n + m - shared, dtype=np.uint64)
                sets = [np.sort(e[:n]), np.sort(np.concatenate([e[:shared], e[n:]]))]
                keys, owners = setjoin.part_keys(np.concatenate(sets), np.array([0, n, n + m]), np.array([0, 1]), percent)
                assert set(keys[owners == 0]) & set(keys[owners == 1]), (n, m)


def test_unlike_sets_with_empty_parts_share_no_list():
    """A part that is empty in very many sets isn't listed by those that have enough others."""
    rnd = np.random.default_rng(5)
    n = 200
    sets = np.sort(rnd.integers(0, 2 ** 64, (300, n), dtype=np.uint64), axis=1)
    keys, owners = setjoin.part_keys(sets.ravel(), np.arange(301) * n, np.arange(300), 80)
    assert len(set(keys.tolist())) == len(keys)


def test_rows_that_repeat_a_class_come_once(spark):
    """3 000 rows of one null id and text bring one row a task to the comparison, and keep their links."""
    near = [f"w{i}" for i in range(100)]
    rows = [(None, " ".join(near))] * 3000 + [(1, " ".join(near + ["x"])), (2, " ".join(near + ["y"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = setjoin.signatures(df, 5).groupBy("f1", "f2", "n").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "rep")
    read = setjoin.elements_of(df.repartition(4), wanted, 5).collect()
    assert 3 <= len(read) <= 6
    got = setjoin.jaccard_components(df, gram=5, percent=80).groupBy("component_id").count().collect()
    assert [(r["component_id"], r["count"]) for r in got] == [(1, 3002)]


def test_only_likely_sets_are_read_again(spark, monkeypatch):
    """Texts that share a passage are one group of possible links; signatures part them before sets are shuffled."""
    docs = []
    for size in (400, 3000):  # signatures of the least width, and wider ones
        passage = [f"p{size}_{i}" for i in range(size * 6 // 10)]
        docs += [" ".join(passage + [f"w{size}_{k}_{i}" for i in range(size * 4 // 10)]) for k in range(25)]
        docs += [docs[-1] + " one more", docs[-3] + " and two more"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    read, elements_of = [], setjoin.elements_of

    def counted(rows, wanted, gram):
        read.extend(r.rep for r in wanted.collect())
        return elements_of(rows, wanted, gram)

    monkeypatch.setattr(setjoin, "elements_of", counted)
    monkeypatch.setattr(setjoin, "BLOCK", 2)
    got = setjoin.jaccard_components(df, gram=5, percent=80)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(list(enumerate(docs)))
    assert sorted(read) == [22, 24, 25, 26, 49, 51, 52, 53]
