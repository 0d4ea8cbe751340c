"""The five registered peaks of a grid and the fact table made of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamspark import dims
from beamspark.dims import Box
from beamspark.operators import peaks
from beamspark.sources.sinks import PEAK_COLUMNS

# Tolerance in seconds and s/deg per phase and label.
TOLERANCES = {
    "PKiKP/global": (2.0, 0.6), "PKiKP/published_target": (2.0, 0.6), "PKKP/peak_1": (30.0, 1.5),
    "PKKP/peak_2": (30.0, 1.5), "PKKP/paper_target": (5.0, 0.4),
}
TARGETS = {
    "PKiKP/global": "PKiKP", "PKiKP/published_target": "PKiKP", "PKKP/peak_1": "PKKP_1", "PKKP/peak_2": "PKKP_2",
    "PKKP/paper_target": "PKKP_2",
}
BOX_NAMES = {"published_target": "PKIKP_PUBLISHED", "paper_target": "PKKP_PUBLISHED"}


def five_peaks(
    cells: DataFrame, keys: Sequence[str], *, windows: dict[str, tuple[float, float]] = dims.PHASE_WINDOWS,
    boxes: Sequence[Box] = (dims.PKIKP_PUBLISHED, dims.PKKP_PUBLISHED), dt: float = dims.EXCLUSION_TIME_S,
    ds: float = dims.EXCLUSION_SLOWNESS, min_support: int = dims.MIN_STACK_SUPPORT,
) -> DataFrame:
    """Global peak per phase, second peak outside the first's surroundings, and the peak of each target box,
    with box statistics, background quantile, rank and local-maximum flag."""
    keys = list(keys)
    none = F.lit(0).cast("bigint")

    def label(df: DataFrame, phase: str, name: str) -> DataFrame:
        return df.withColumns({"phase": F.lit(phase), "peak_label": F.lit(name),
                               "box_total_cell_count": none, "box_valid_cell_count": none})

    parts = [
        label(peaks.global_peak(cells, keys, *windows["PKiKP"], min_support), "PKiKP", "global"),
        label(peaks.global_peak(cells, keys, *windows["PKKP"], min_support), "PKKP", "peak_1"),
        label(peaks.second_peak(cells, keys, *windows["PKKP"], dt=dt, ds=ds, min_support=min_support), "PKKP", "peak_2"),
        peaks.box_peaks(cells, keys, boxes, min_support),
    ]
    p = reduce(DataFrame.unionByName, parts)
    p = peaks.box_occupancy(cells, p, keys, boxes, min_support)
    boxed = F.col("peak_label").isin(*[b.label for b in boxes])
    p = p.withColumns({c: F.when(boxed, F.col(c)) for c in ("box_supported_cell_fraction", "box_occupancy_in_band")})
    p = peaks.rank_and_quantile(cells, p, keys, windows, min_support)
    flags = peaks.local_maxima(cells, keys).where("is_local_max").select(
        *keys, F.col("si").alias("slow_idx"), F.col("ti").alias("time_idx"), F.lit(True).alias("local_max_neighbor_check"))
    return p.join(flags, [*keys, "slow_idx", "time_idx"], "left").fillna({"local_max_neighbor_check": False})


def peak_table(
    cells: DataFrame, lanes: Sequence[str], errors: DataFrame, *, provenance: str = "not_required", **options
) -> DataFrame:
    """The 36-column peak table. ``lanes`` hold mode, input_type, norm_variant, polarization_operator,
    stack_method and power_window_s; ``errors`` has median and max distance error per lane."""
    p = five_peaks(cells, lanes, **options).join(errors, list(lanes), "left")
    published = {k: dims.PUBLISHED_PEAKS[v] for k, v in TARGETS.items()}
    f = peaks.peak_facts(p, published, tolerances=TOLERANCES, median_error=F.col("median_distance_error_deg"),
                         max_error=F.col("max_distance_error_deg"))
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in BOX_NAMES.items() for x in kv])[F.col("peak_label")], F.lit(""))
    return f.withColumns({
        "minimum_support": F.lit(options.get("min_support", dims.MIN_STACK_SUPPORT)), "published_target_box": name,
        "box_peak_background_quantile": F.col("background_quantile"),
        "normalization_lane": peaks.normalization_lane(F.col("mode"), F.col("norm_variant")),
        "current_provenance_status": F.lit(provenance)}).select(*PEAK_COLUMNS)
