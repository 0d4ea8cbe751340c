"""Validation report: merged fragments, the strict gate, and writes that a failing row stops."""

import os

import pytest
from pyspark.sql import functions as F

from beamspark.operators import report


def test_fragments_merge_and_missing_checks_fail(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None), (4, True)], "id int, ok boolean")
    good = report.fragment(rows.where("ok"), "model", F.col("ok"), F.col("id"))
    bad = report.fragment(rows, "alignment", F.col("ok"), F.col("id"))
    more = report.fragment(rows.where("id = 4"), "alignment", F.col("ok"), F.col("id"))
    none = report.fragment(rows.limit(0), "deglitch", F.col("ok"), F.col("id"))
    r = report.merged([good, bad, more, none], required=("model", "alignment", "deglitch", "branch_registry", "benchmark"))
    got = {x["check"]: (x["items"], x.failures, x.first_failing, x.status) for x in r.collect()}
    assert got == {"model": (2, 0, None, "passed"), "alignment": (5, 2, "2", "failed"), "deglitch": (0, 0, None, "missing"),
                   "branch_registry": (0, 0, None, "not_requested"), "benchmark": (0, 0, None, "missing")}
    v = report.verdict(r).first()
    assert (v.checks, v.failed, v.paper_ready) == (5, 3, False)
    assert v.failures == "alignment: 2/5 failed, first 2; benchmark: missing check; deglitch: missing check"
    assert not report.gate(r, strict=False)
    with pytest.raises(report.BatchFailed, match="alignment"):
        report.gate(r)
    assert report.gate(report.merged([good], required=("model",)))
    with pytest.raises(ValueError):
        report.merged([])


def test_a_failing_row_stops_the_commit(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.when(F.col("id") != 57, F.col("id"))).repartition(4)
    checks = {"known": F.col("v").isNotNull(), "small": F.col("v") < 98}
    with pytest.raises(report.BatchFailed) as e:
        report.checked_write(df, f"{tmp_path}/out", checks)
    assert e.value.failures == {"known": 1, "small": 3} and os.listdir(tmp_path) == []
    assert report.checked_write(df, f"{tmp_path}/out", checks, strict=False) == {"known": 1, "small": 3, "rows": 100}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 100 and os.listdir(tmp_path) == ["out"]
    with pytest.raises(FileExistsError):
        report.checked_write(df, f"{tmp_path}/out", checks)
    assert report.checked_write(df.where("v < 9"), f"{tmp_path}/good", checks) == {"known": 0, "small": 0, "rows": 9}


def test_checks_are_counted_in_the_pass_that_writes(spark, tmp_path):
    """Nine checks, one job over the rows: each row is computed once."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(v):
        seen.add(1)
        return v

    df = spark.range(50).withColumn("v", counted.asNondeterministic()("id"))
    counts = report.checked_write(df, f"{tmp_path}/nine", {f"c{k}": F.col("v") >= 0 for k in range(9)})
    assert seen.value == 50 and counts == {f"c{k}": 0 for k in range(9)} | {"rows": 50}
