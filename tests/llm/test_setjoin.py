"""The Jaccard join against all pairs."""

import random
import re

from beamspark.llm import setjoin
from beamspark.llm.graph import components
from beamspark.llm.op_queries import op10_jaccard_join

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(t):
    w = re.findall("[^\\x20\\x09-\\x0D]+", (t or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def brute(docs):
    sets = {d: shingles(t) for d, t in docs}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= 90 * max(len(x), len(y)):
                inter = len(x & y)
                if 100 * inter >= 90 * (len(x) + len(y) - inter):
                    ra, rb = root(a), root(b)
                    up[max(ra, rb)] = min(ra, rb)
    return sorted((d, len(sets[d]), root(d)) for d in ids)


def rows(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def made(seed):
    """Short and long texts with few edits, so that many pairs lie close to the limit on either side."""
    rnd = random.Random(seed)
    word = lambda: f"W{rnd.randrange(400)}"
    docs = []
    for size in [1, 2, 3, 8, 11, 12, 14, 20, 21, 22, 25, 30, 60, 130]:
        for _ in range(2):
            base = [word() for _ in range(size)]
            for _ in range(8):
                t = list(base)
                for _ in range(rnd.randrange(0, 1 + max(1, size // 18))):
                    k = rnd.randrange(len(t))
                    t[k:k + 1] = rnd.choice([[word()], [], [word(), t[k]]]) if rnd.random() < 0.6 or k < size - 2 else [word()]
                t += [word()] * rnd.choice([0, 0, 1])
                docs.append(" ".join(t))
    docs += ["", None, " \n", "a b", "A  b", "c", "a a a a a a", "a a a a"]
    rnd.shuffle(docs)
    return list(enumerate(docs))


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 3)  # blocks of few members, so that there are many of them
    docs = made(1)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "0 as n", "1 as key", "2 as cid").repartition(5)
    assert rows(setjoin.jaccard_components(df)) == brute(docs)


def test_boundary_does_not_change_links(spark, monkeypatch):
    docs = made(2)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for largest in (0, 13, setjoin.SMALL):
        monkeypatch.setattr(setjoin, "boundary", lambda c, p, x=largest: x)
        assert rows(setjoin.jaccard_components(df)) == brute(docs)


def test_odd_rows(spark):
    docs = [(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (7, None), (7, None), (9, "x " * 30000), (4, "x x x x")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in setjoin.jaccard_components(df).collect()), key=str)
    assert got == sorted([(None, 2, 5), (None, 2, 5), (5, 2, 5), (7, 0, 7), (7, 0, 7), (9, 1, 4), (4, 1, 4)], key=str)
    assert setjoin.jaccard_components(df.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in setjoin.one_of_each(df).collect()) == ["4", "5", "7", "7", "None", "None"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(op10_jaccard_join(spark, sf_dir)) == brute(docs)
