"""Decontamination against a brute-force scan of every window."""

import hashlib
import re

import pytest

from beamspark.llm import contamination
from beamspark.llm.op_queries import op5_decontamination

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, window=13):
    wins = {}
    for i, t in items:
        w = words(t)
        m = min(window, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            wins.setdefault(tuple(w[s:s + m]), set()).add(str(i))
    sizes = {len(k) for k in wins}
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for m in sizes:
            for s in range(len(w) - m + 1):
                got = wins.get(tuple(w[s:s + m]))
                if got:
                    hit |= set(range(s, s + m))
                    found |= got
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), ids, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_small_tables(spark):
    base = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(base[:20])), (2, "Alpha beta"), (3, None), (4, ""), (5, " ".join(base[10:30])), (2, "Alpha beta"),
             (6, "solo"), (7, "x " * 13)]
    docs = [(1, "a " + " ".join(base[:13]) + " b"), (2, "ALPHA-beta alpha gamma"), (3, None), (4, ""), (5, " ".join(base[:12])),
            (6, " ".join(base)), (6, " ".join(base)), (None, "solo " + "y " * 30), (8, "x " * 50), (9, "é" * 70000 + " alpha beta"), (10, "?!")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as key", "'k' as hash")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as words")
    for bits in (4, 24):
        got = contamination.contaminated_spans(d.repartition(3), i, bits=bits)
        rows = [(r.doc_id, r.n_words, r.n_hit, len(r.item_ids), hashlib.sha256(",".join(r.item_ids).encode()).hexdigest(),
                 bool(r.n_hit and 20 * r.n_hit >= r.n_words)) for r in got.collect()]
        assert sorted(rows, key=str) == brute(docs, items)
    kept = contamination.decontaminate(d, i)
    assert kept.columns == d.columns
    good = [x[0] for x in brute(docs, items) if not x[5]]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(good, key=str)


@pytest.mark.parametrize("empty", ["docs", "items"])
def test_empty_tables(spark, empty):
    d = spark.createDataFrame([] if empty == "docs" else [(1, "a b")], "doc_id long, text string")
    i = spark.createDataFrame([] if empty == "items" else [(1, "a b")], "item_id long, text string")
    got = contamination.contaminated_spans(d, i).collect()
    assert [(r.doc_id, r.n_words, r.n_hit) for r in got] == ([] if empty == "docs" else [(1, 2, 0)])


def test_whole_table(spark, sf_dir):
    got = [tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
           for r in op5_decontamination(spark, sf_dir).collect()]
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(got, key=str) == brute(docs, items)
    assert any(r[5] for r in got)
