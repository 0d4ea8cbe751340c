"""Scores against an automaton of dictionaries that is walked token by token."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from beamspark.llm import backoff
from beamspark.llm.op_queries import op8_backoff_scores

LOWER = {i: i + 32 for i in range(65, 91)}
END = object()


def tokens(t):
    return [*re.findall("[^\\x20\\x09-\\x0D]+", (t or "").translate(LOWER)), END]


class Automaton:
    def __init__(self, texts, order, weight=backoff.WEIGHT, add=backoff.ADD):
        self.c = Counter()
        self.order, self.m = order, weight
        for t in map(tokens, texts):
            for k in range(1, order + 1):
                for i in range(len(t) - k + 1):
                    self.c[tuple(t[i:i + k])] += 1
        words = [n for g, n in self.c.items() if len(g) == 1]
        self.n, self.v, once = sum(words), len(words), sum(x == 1 for x in words)
        plain = add / (self.n + add * (self.v + 1)) if self.n else 1.0
        self.unseen = max(plain, once / (self.n + 1) if once < self.n else plain) if self.n else 1.0
        self.low = lambda c: (c + add) * (1 - self.unseen) / (self.n + add * self.v)

    def arc(self, state, w):
        """Weight of the arc, or None, and the failure arc's weight."""
        if not state:
            return (self.low(self.c[(w,)]) if self.c[(w,)] else self.unseen), None
        fail = self.m / (self.c[state] + self.m)
        if not self.c[(*state, w)]:
            return None, fail
        return (self.c[(*state, w)] / (self.c[state] + self.m)) + fail * self.p(state[1:], w), fail

    def p(self, state, w):
        factor = 1.0
        while True:
            p, fail = self.arc(state, w)
            if p is not None:
                return factor * p
            factor, state = factor * fail, state[1:]

    def step(self, state, w):
        to = (*state, w)[-(self.order - 1):] if self.order > 1 else ()
        while to and not self.c[to]:
            to = to[1:]
        return to

    def score(self, t):
        state, total = (), 0.0
        for w in tokens(t):
            total += math.log10(self.p(state, w))
            state = self.step(state, w)
        return total

    def base(self, t):
        return sum(math.log10((self.c[(w,)] + 1) / (self.n + self.v + 1)) for w in tokens(t))


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def compare(got, docs, order):
    a = Automaton([t for d, t in docs if not held(d)], order)
    want = sorted(((d, held(d), len(tokens(t)), sum(a.c[(w,)] > 0 for w in tokens(t)), a.n, a.base(t), a.score(t)) for d, t in docs), key=lambda r: str(r[:4]))
    rows = sorted(map(tuple, got.collect()), key=lambda r: str(r[:4]))
    assert [r[:5] for r in rows] == [r[:5] for r in want]
    assert sorted(x for r in rows for x in r[5:]) == pytest.approx(sorted(x for r in want for x in r[5:]), rel=1e-9)
    return a


@pytest.mark.parametrize("order", [1, 2, 3])
def test_small_tables(spark, order):
    rnd = random.Random(order)
    docs = [(i, " ".join(rnd.choice("a b c d E f G hh é".split()) for _ in range(rnd.randrange(0, 30)))) for i in range(60)]
    docs += [(100, None), (101, ""), (None, "a b zz"), (102, "q " * 400), (102, "q " * 400), (103, "x" * 70000 + " a"), (9, "only here")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as chunk", "2 as shard").repartition(4)
    flag = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    a = compare(backoff.automaton_scores(df, flag, order=order, chunk_tokens=100, shard_entries=40), docs, order)
    words = {g[0] for g in a.c if len(g) == 1}
    for state in [g for g in a.c if len(g) < order and END not in g][:40]:
        assert sum(a.p(state, w) for w in words) + a.p(state, "never seen") == pytest.approx(1)


def test_no_training(spark):
    held_id = next(i for i in range(100) if held(i))
    df = spark.createDataFrame([(held_id, "a b")], "doc_id long, text string")
    got = backoff.automaton_scores(df, F.lit(True)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)]
    assert backoff.automaton_scores(df.limit(0), F.lit(True)).count() == 0


def test_whole_table(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    compare(op8_backoff_scores(spark, sf_dir), docs, backoff.ORDER)
