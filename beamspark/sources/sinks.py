"""Sinks. Spark's commit protocol makes each write appear whole or not at all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamspark import dims

# Column order of the peak table.
PEAK_COLUMNS = (
    "mode", "input_type", "norm_variant", "polarization_operator", "stack_method", "power_window_s", "phase",
    "peak_label", "time_s", "slowness_sdeg", "power", "support_count", "minimum_support", "status",
    "excluded_reason", "paper_time_s", "paper_slowness_sdeg", "dt_vs_paper_s", "ds_vs_paper_sdeg",
    "within_published_tolerance", "grid_coordinate_miss_norm", "median_distance_error_deg",
    "max_distance_error_deg", "distance_uncertainty_moveout_s", "uncertainty_folded_time_tolerance_s",
    "within_uncertainty_folded_tolerance", "local_max_neighbor_check", "box_peak_background_quantile",
    "target_box_rank", "published_target_box", "box_occupancy_in_band", "box_supported_cell_fraction",
    "box_valid_cell_count", "box_total_cell_count", "normalization_lane", "current_provenance_status",
)


def write_lanes(grid: DataFrame, path: str, lanes: Sequence[str], mode: str = "overwrite") -> None:
    """Grid by lane folder, ordered by slowness inside each file so that statistics prune.

    Rows spread over (lane, slowness), so one large lane is still written by many tasks.
    """
    grid.repartition(*lanes, "si").sortWithinPartitions(*lanes, "si").write.mode(mode).partitionBy(*lanes).parquet(path)


def write_bootstrap(path: str, *, occupancy: DataFrame, peaks: DataFrame, design: DataFrame, meta: DataFrame) -> None:
    for name, df in {"occupancy": occupancy, "boot_peaks": peaks, "design": design, "run_meta": meta}.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_leave_one_out(path: str, *, grids: DataFrame, members: DataFrame, influence: DataFrame, lanes: Sequence[str], held: str) -> None:
    """Influence products: grids by lane and held-out event (Parquet), members likewise, and a JSON line per product.

    A held-out event that is null is the full set; it is filed under ``full_set``, others under ``hold_out_<id>``.
    """
    def filed(df: DataFrame) -> DataFrame:
        return df.withColumn("product", F.coalesce(F.concat(F.lit("hold_out_"), F.col(held).cast("string")), F.lit("full_set")))

    for name, df in {"grids": grids, "members": members}.items():
        filed(df).repartition(*lanes, "product").write.mode("overwrite").partitionBy(*lanes, "product").parquet(f"{path}/{name}")
    write_json(filed(influence), f"{path}/summary")


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV with a fixed header; columns the table lacks are written empty. Files stay as Spark split them."""
    df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.mode(
        "overwrite").csv(path, header=True)


def sorted_json(df: DataFrame) -> Column:
    """Row as JSON with its fields in name order."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))


def write_json(df: DataFrame, path: str) -> None:
    df.select(sorted_json(df).alias("value")).write.mode("overwrite").text(path)


def append_manifest(entries: DataFrame, path: str) -> None:
    """Append-only manifest; readers take the last entry of a path that carries a digest."""
    entries.write.mode("append").json(path)


def write_model_text(layers: DataFrame, path: str, order: str = "ord") -> None:
    """One text folder per model: section marks and four-decimal rows in order."""
    from beamspark.operators.model import format_rows

    rows = layers.withColumn("value", F.coalesce("mark", format_rows(*[F.col(c) for c in ("depth", "vp", "vs", "rho")])))
    rows.repartition("model").sortWithinPartitions("model", order).select("model", "value").write.mode(
        "overwrite").partitionBy("model").text(path)


def markdown_rows(df: DataFrame) -> DataFrame:
    """Markdown table lines: the header and rule at 0 and 1, then one line per row."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    head = df.sparkSession.createDataFrame(
        [(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + " --- |" * len(df.columns))], "place int, line string")
    return head.unionByName(df.select(F.lit(2).alias("place"), line.alias("line")))


LARGE_DIGEST = 100_000  # rows of a key that are digested by many tasks
LARGE_DIGEST_KEYS = 10_000


def locked_digest(rows: DataFrame, key: str, content: Column) -> DataFrame:
    """Digest per key of its row digests in order, whatever order the rows come in.

    It is a tree of digests of this library's own, not the digest of the sorted manifest as one text, which only one
    task could compute: compare it with digests made by this function, not with recorded digests of manifests.

    Repeats fold into a count, then digests merge by their leading characters in two steps. Keys are counted by a job of
    their own: those of more than ``LARGE_DIGEST`` rows and over one in ``LARGE_DIGEST_KEYS`` of all go by broadcast and are
    shuffled at each step, so that even a key with most of the rows is never gathered whole. Rows of all others are
    shuffled once, by their key.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > LARGE_DIGEST)
    every = rows.count() if not counts.isEmpty() else 0
    large = counts.where(F.col("n") * LARGE_DIGEST_KEYS > every).select(key).collect() if every else []
    hashed = rows.select(key, F.unhex(F.sha2(content, 256)).alias("at"))
    if not large:
        return _digest_tree(hashed.repartition(key), key)
    large = F.broadcast(rows.sparkSession.createDataFrame(large, rows.select(key).schema)).alias("l")
    same = F.col(f"r.{key}").eqNullSafe(F.col(f"l.{key}"))
    hashed = hashed.alias("r")
    return _digest_tree(hashed.join(large, same, "left_anti").repartition(key), key).unionByName(
        _digest_tree(hashed.join(large, same, "left_semi"), key))


def _digest_tree(hashed: DataFrame, key: str) -> DataFrame:
    """Counted rows merged by six characters, by three and by none; digests travel as bytes and are hashed as hex text."""
    text = lambda c: F.lower(F.hex(c))
    d = hashed.groupBy(key, "at").agg(F.count("*").alias("n"))
    d = d.select(key, text("at").alias("at"), F.unhex(F.sha2(F.concat_ws(":", text("at"), "n"), 256)).alias("h"))
    for width in (6, 3, 0):
        to = F.substring("at", 1, width) if width else F.lit("")
        at = F.unhex("at") if width == 6 else F.col("at")
        parts = F.array_sort(F.collect_list(F.struct(at.alias("at"), "h")))
        d = d.groupBy(key, to.alias("to")).agg(parts.alias("p")).select(
            key, F.col("to").alias("at"), F.unhex(F.sha2(F.array_join(F.transform("p", lambda s: text(s["h"])), ""), 256)).alias("h"))
    return d.select(key, text("h").alias("digest"))


def refuse_reserved_status(status: Column) -> Column:
    """A sidecar may not claim the strict status; doing so fails the job."""
    strict = dims.DEGLITCH_STATUSES[2]
    return F.when(status == strict, F.raise_error(F.lit("reserved status"))).otherwise(status)
