"""Validation report: check rows from many fragments, one merged verdict, and writes that a failing check stops.

A fragment is a table of items with a verdict each. Fragments fold to one row per check before they meet, so that a report
costs one aggregation a table, whatever the number of items. A required check that no fragment gives is a failure of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# The checks of a run, in the order of its report.
RUN_CHECKS = ("inventory", "benchmark", "bootstrap_fidelity", "type2_distance_stratified", "type3_alignment_jitter", "deglitch",
              "branch_registry", "model", "preprocessing", "alignment")
OPTIONAL_CHECKS = ("branch_registry",)


class BatchFailed(RuntimeError):
    """A strict gate: the checks named did not pass, and nothing was committed."""

    def __init__(self, failures: dict[str, int]):
        super().__init__("validation failed: " + ", ".join(f"{k} ({n})" for k, n in failures.items()))
        self.failures = failures


def fragment(rows: DataFrame, check: str, ok: Column, item: Column) -> DataFrame:
    """One row (check, items, failures, first_failing): an unknown verdict is a failure, the least failing item is named."""
    bad = ~F.coalesce(ok, F.lit(False))
    return rows.agg(F.lit(check).alias("check"), F.count("*").alias("items"), F.count_if(bad).alias("failures"),
                    F.min(F.when(bad, item.cast("string"))).alias("first_failing"))


def merged(fragments: Iterable[DataFrame], required: Sequence[str] = RUN_CHECKS, optional: Sequence[str] = OPTIONAL_CHECKS) -> DataFrame:
    """(check, items, failures, first_failing, status): fragments of one check are added up, required ones without a fragment are missing.

    A check without items, like one without a fragment, is missing and not passed; an optional one is then not requested.
    """
    every = None
    for f in fragments:
        every = f if every is None else every.unionByName(f)
    if every is None:
        raise ValueError("a report needs at least one fragment")
    names = every.sparkSession.createDataFrame([(c,) for c in required], "check string")
    rows = every.unionByName(names.select("check", F.lit(0).cast("long").alias("items"), F.lit(0).cast("long").alias("failures"),
                                          F.lit(None).cast("string").alias("first_failing")))
    out = rows.groupBy("check").agg(F.sum("items").alias("items"), F.sum("failures").alias("failures"), F.min("first_failing").alias("first_failing"))
    status = (F.when(F.col("failures") > 0, "failed").when(F.col("items") > 0, "passed")
              .when(F.col("check").isin(*optional), "not_requested").otherwise("missing"))
    return out.withColumn("status", status)


def verdict(report: DataFrame) -> DataFrame:
    """One row (checks, failed, failures, paper_ready); ``failures`` names what did not pass, in order."""
    bad = F.col("status").isin("failed", "missing")
    named = F.concat("check", F.lit(": "), F.when(F.col("status") == "missing", "missing check").otherwise(
        F.concat(F.col("failures").cast("string"), F.lit("/"), F.col("items").cast("string"), F.lit(" failed, first "), F.coalesce("first_failing", F.lit("unknown")))))
    return report.agg(F.count("*").alias("checks"), F.count_if(bad).alias("failed"),
                      F.array_join(F.array_sort(F.collect_list(F.when(bad, named))), "; ").alias("failures"), (F.count_if(bad) == 0).alias("paper_ready"))


def gate(report: DataFrame, strict: bool = True) -> bool:
    """Whether every check passed; with ``strict`` anything else raises ``BatchFailed``. A report has a row per check."""
    bad = {r["check"]: r["failures"] for r in report.where(F.col("status").isin("failed", "missing")).orderBy("check").collect()}
    if bad and strict:
        raise BatchFailed(bad)
    return not bad


def checked_write(df: DataFrame, path: str, checks: dict[str, Column], *, strict: bool = True) -> dict[str, int]:
    """Write Parquet and count what fails each check in the same pass; failing rows stop the commit.

    The rows go to a folder beside ``path`` and take its name only after the counts are known. With ``strict`` a
    failing check removes that folder and raises ``BatchFailed``; otherwise the counts are returned with the data in place. An
    existing ``path`` is refused, so that nothing is lost.
    """
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    pending = f"{path.rstrip('/')}.pending-{uuid.uuid4().hex}"
    here, there = jvm.org.apache.hadoop.fs.Path(pending), jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(conf)
    if files.exists(there):
        raise FileExistsError(path)
    seen = Observation()
    observed = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"check_{k}") for k, ok in checks.items()])
    try:
        observed.write.parquet(pending)
        counts = {k: seen.get[f"check_{k}"] for k in checks}
        bad = {k: n for k, n in counts.items() if n}
        if bad and strict:
            raise BatchFailed(bad)
        if not files.rename(here, there):
            raise OSError(f"{pending} could not take the name {path}")
    finally:
        files.delete(here, True)
    return counts | {"rows": seen.get["rows"]}
