"""Licence classifier: held notices, planted paragraphs, and scores recomputed from the model's weights."""

import math
import re

import pytest

from beamspark.llm import licences
from beamspark.llm.op_queries import op3_licences


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    return licences.trained(docs)


def grams(line):
    w = [x for x in (re.sub("^[.+-]+|[.+-]+$", "", x) for x in re.split(r"[^\w.+-]+|_", line.lower())) if x]
    return list(dict.fromkeys(" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)))


def brute(line, model):
    known = [model.weights[g] for g in grams(line) if g in model.weights]
    if not known:
        return None
    z = [math.exp(b + sum(w[i] for w in known)) for i, b in enumerate(model.bias)]
    p = [x / sum(z) for x in z]
    best = max(range(1, len(p)), key=lambda i: p[i])
    return model.families[best] if p[best] >= model.cut else licences.UNKNOWN, p[best]


PLANTED = [
    ("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL"), ("Licensed under CC BY 4.0.", "CC-BY"),
    ("Released under the BSD 3-Clause License", "BSD"), ("  licensed under the APACHE license version 2.0", "Apache-2.0")]


def test_planted_paragraphs(spark, model):
    rows = [(i, f"Some line.\n{line}\nAnother.") for i, (line, _) in enumerate(PLANTED)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as family", "1 as line", "2 as p")
    got = {r.doc_id: r for r in licences.scanned(df, model).collect()}
    assert {i: (r.paragraph, r.family, r.confirmed) for i, r in got.items()} == {i: (1, f, True) for i, (_, f) in enumerate(PLANTED)}
    for i, (line, _) in enumerate(PLANTED):
        family, p = brute(line, model)
        assert got[i].family == family and got[i].probability == pytest.approx(p, rel=1e-6)


def test_unknown_stays_unknown(spark, model):
    lines = ["Her driving licence expired in March.", "The weather was fine.", "They walked under the bridge.", "Her licensed dog ran."]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    assert not [r for r in licences.scanned(df, model).collect() if r.confirmed]


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (None, "Released under the MIT License."), (3, "x " * 40000 + "\nLicensed under CC BY-NC 4.0."), (3, "x " * 40000 + "\nLicensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.paragraph, r.family) for r in licences.scanned(df, model).collect()), key=str)
    assert got == [(3, 1, "CC-BY-NC"), (3, 1, "CC-BY-NC"), (None, 0, "MIT")]
    assert licences.scanned(df.limit(0), model).count() == 0
    assert licences.trained(df.limit(0)).cut >= 0.5


def test_whole_table(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {(d.doc_id, i): brute(line, model) for d in docs for i, line in enumerate(d.text.split("\n")) if brute(line, model)}
    query = op3_licences(spark, sf_dir)
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    got = {(r.doc_id, r.paragraph): r for r in query.collect()}
    assert {k: r.family for k, r in got.items()} == {k: f for k, (f, _) in want.items()}
    notices = [k for k, (f, p) in want.items() if p > 0.9]
    assert notices and all(got[k].confirmed for k in notices)
