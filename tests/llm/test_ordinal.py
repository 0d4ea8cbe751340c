"""Ordinal classifier: held-out accuracy, monotone tails, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamspark.llm import ordinal


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    test = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    model = ordinal.trained(docs, labels.where(~test), ordinal.quality_and_toxicity(), 2)
    assert model.thresholds[0] <= model.thresholds[1]
    rows = ordinal.graded(docs.join(labels.where(test), "doc_id"), model).select("tail_probability", "expected_grade", ordinal.quality_and_toxicity().alias("grade")).collect()
    kept = {g: np.mean([r.tail_probability >= ordinal.KEEP for r in rows if r.grade == g]) for g in (0, 1, 2)}
    assert kept[0] < 0.03 and kept[1] < 0.25 and kept[2] > 0.98
    mean = [np.mean([r.expected_grade for r in rows if r.grade == g]) for g in (0, 1, 2)]
    assert mean[0] < mean[1] < mean[2]


def test_likelihood_gradient():
    rng = np.random.default_rng(0)
    slots = rng.integers(0, 30, 3000)
    offsets = np.arange(0, 3001, 10)
    grades = np.minimum(2, (slots.reshape(300, 10) < 12).sum(1) // 3)
    m = ordinal.fit(slots, offsets, grades, 2, bits=5, l1=1e-4, steps=(400, 400))
    above = m.above(m.score(slots, offsets))
    assert (above[:, 0] >= above[:, 1]).all()
    guess = (above > 0.5).sum(1)
    assert np.mean(guess == grades) > 0.8
    flat = ordinal.fit(slots, offsets, np.zeros(300, int), 2, bits=5)
    assert not flat.weights.any()


@pytest.fixture
def tiny(spark):
    good = ["The quiet river ran past the old mill and the meadow."] * 30
    bad = ["BUY!! NOW!! CHEAP!! ### $$$ WIN!!"] * 30
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(100, None), (101, ""), (None, "The quiet river ran."), (102, "BUY!! " * 40000), (102, "BUY!! " * 40000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as expected_grade", "2 as grade", "3 as slots")
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(60)] + [(7, None, None), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_selection(tiny):
    docs, labels = tiny
    kept = ordinal.selected(docs, labels, keep=0.5)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(range(30)) <= set(ids) and not set(range(30, 60)) & set(ids) and 102 not in ids
    again = [r.doc_id for r in ordinal.selected(docs.repartition(5), labels, keep=0.5).collect()]
    assert sorted(map(str, again)) == sorted(map(str, ids))


def test_empty(tiny):
    docs, labels = tiny
    assert ordinal.selected(docs.limit(0), labels).count() == 0
    model = ordinal.trained(docs, labels.limit(0), ordinal.quality_and_toxicity(), 2)
    assert not model.weights.any()
