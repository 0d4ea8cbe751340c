"""Connected components of an edge table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beamspark.llm.shared import written

ROUNDS = 60


def _hooked(pairs: DataFrame, small: bool) -> DataFrame:
    """Each vertex v and its neighbours u: link to the least of them all the larger (or, small, all the smaller) ones."""
    if small:
        near = pairs.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    else:
        near = pairs.select(F.col("a").alias("v"), F.col("b").alias("u")).union(pairs.select(F.col("b").alias("v"), F.col("a").alias("u")))
    least = near.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
    # The join may split a vertex with very many neighbours; nothing is gathered per vertex.
    hooked = near.join(least, "v")
    if small:
        out = hooked.select("u", "m").union(least.select(F.col("v").alias("u"), "m"))
    else:
        out = hooked.where("u > v").select("u", "m")
    return out.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) for every vertex with an edge to another one; the component is its least vertex.

    A round keeps every vertex linked to its component and needs narrow shuffles only; rounds grow with the logarithm
    of the size. Each one is written to the shared folder. Null ends and loops are ignored.
    """
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(now, "edges")
    mark = None
    for _ in range(ROUNDS):
        now = written(_hooked(_hooked(now, small=False), small=True), "edges")
        # The star forest no longer changes once edges and their checksum stay the same.
        row = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if row == mark:
            return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).union(
                now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
        mark = row
    raise RuntimeError("the components did not settle")
