"""Column builders for identifiers, paths, hashes and loosely typed fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from beamspark import dims


def event_tokens(text: Column) -> Column:
    """All stand-alone event identifiers; one inside a longer word does not count."""
    return F.regexp_extract_all(text, F.lit("(" + dims.EVENT_TOKEN + ")"), F.lit(1))


def is_empty(c: Column) -> Column:
    """Null, blank or the text of a missing number."""
    s = F.trim(c.cast("string"))
    return s.isNull() | (s == "") | (F.lower(s) == "nan")


def finite(c: Column) -> Column:
    """Number or null; text that is no number, NaN and infinities become null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def lane_value(c: Column) -> Column:
    """Comparable form of a lane field: numbers by value, other text trimmed."""
    return F.coalesce(finite(c).cast("string"), F.trim(c.cast("string")))


def lane_path(path: Column) -> dict[str, Column]:
    """mode/input/variant/method_winNN.ext to lane fields; shorter paths give what they hold."""
    parts = F.split(path, "/")
    full = F.size(parts) >= 4
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    method = F.regexp_extract(stem, r"^(.+?)_win(\d+)", 1)
    window = F.regexp_extract(stem, r"^(.+?)_win(\d+)", 2)
    tail = F.regexp_extract(stem, r"^(.*)_([^_]+)$", 2).try_cast("double")
    head = F.regexp_extract(stem, r"^(.*)_([^_]+)$", 1)
    matched = window != ""
    number = F.when(matched, window.try_cast("double")).otherwise(tail)
    parent = F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2)))
    return {
        "mode": F.when(full, F.get(parts, F.lit(0))).otherwise(F.coalesce(parent, F.lit("unknown"))),
        "input_type": F.when(full, F.get(parts, F.lit(1))).otherwise(F.lit("")),
        "norm_variant": F.when(full, F.get(parts, F.lit(2))).otherwise(F.lit("")),
        "stack_method": F.when(matched, method).when(tail.isNotNull(), head).otherwise(stem),
        "power_window_s": number,
    }


def expand_spec(spec: Column) -> Column:
    """``identity,2-4,9`` to realisation numbers 0, 2, 3, 4, 9, in order and without repeats."""
    piece = lambda p: F.when(p == "identity", F.array(F.lit(0))).when(
        p.contains("-"), F.sequence(F.split_part(p, F.lit("-"), F.lit(1)).cast("int"),
                                    F.split_part(p, F.lit("-"), F.lit(2)).cast("int"))
    ).otherwise(F.array(p.cast("int")))
    parts = F.transform(F.split(spec, ","), lambda p: F.trim(p))
    return F.array_distinct(F.flatten(F.transform(parts, piece)))


def is_safe_relative(path: Column) -> Column:
    return (F.length(F.trim(path)) > 0) & ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)")


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def is_sha256(c: Column) -> Column:
    return c.rlike(r"^(sha256:)?[0-9a-f]{64}$")


def composite_hash(*labelled: tuple[str, Column]) -> Column:
    """One digest of labelled digests: each label, a zero byte, its digest and a newline."""
    parts = [F.concat(F.lit(label), F.lit("\0"), digest, F.lit("\n")) for label, digest in labelled]
    return F.sha2(F.concat(*parts), 256)


def is_data_row(line: Column) -> Column:
    """Neither blank nor one of the header and comment prefixes."""
    s = F.ltrim(line)
    return (s != "") & ~s.startswith("#") & ~s.startswith("-") & ~s.startswith("NUM")


def weakest(status: Column, ranks: dict[str, int]) -> Column:
    """Aggregate: the status of lowest rank, unknown ones lowest of all."""
    rank = F.coalesce(F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))])[status], F.lit(-1))
    return F.min(F.struct(rank.alias("r"), status.alias("s")))["s"]


def table_cells(line: Column) -> Column:
    """Cells of one pipe-table line, back-ticks and padding removed."""
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(inner, r"\|"), lambda c: F.regexp_replace(F.trim(c), "^`|`$", ""))
