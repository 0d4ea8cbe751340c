"""Shards of even size that keep linked documents together, by balanced label propagation.

Documents are linked when their texts are equal. Every linked document starts with a label dealt like cards, so that the
shards are even from the first; then, round by round, documents move to the shard that most of their neighbours are in,
as many as quotas allow: pairs and triples of shards exchange equal numbers, and a shard with room takes some more. Which
ones move is decided by how much is gained, then by hash. Where the shard that most are in is full, they meet in
another. Documents of one text and one label are alike, so that they are one row with a count, whatever their number; a
row may move in part. Documents without neighbours cut nothing wherever they are: they fill the shards up at the end.

The law is ``rows``: counts of shards differ by one at most. It holds before, between and after the rounds, as no shard
ever takes more than its share. All moves of one text in one round go to one shard, and either that shard has at least as
many of them or they go whole; so every move cuts fewer links (pairs of equal texts in different shards), and the rounds
end by themselves (``ROUNDS`` is a guard: stopping early costs links, never evenness). A text with more documents than a
shard may hold fills shards one by one. What no exchange of two or three shards and no room can mend stays cut: a local
optimum.

Everything is DataFrame functions; 8 x 8 counts a round reach the driver. Exact ranks and running sums are taken in two
levels: sums of slices by hash, then inside each slice. The texts of over a thousandth of all documents, a thousand
at most, are known by broadcast, and their documents meet the labels over ``SALTS`` salted keys.

Defined cases: a null text is empty, so that null and empty texts are linked; a null doc_id is kept as any other; rows
that repeat are documents of their own. An empty table gives no rows. Fewer documents than shards leave shards empty. Long
texts are one digest. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamspark.llm.shared import written

SHARDS = 8
ROUNDS = 40
SALTS = 256
HEAVY = 1_000
SLICE_BITS = 12
SINGLES = b"\0"  # digest of no text: those have 16 bytes


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, digest, chance): what a document weighs and is linked by; written."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("digest"), F.monotonically_increasing_id().alias("uid"))
    return written(rows.withColumn("chance", F.xxhash64("doc_id", "digest", "uid")), "shard-rows")


def before(rows: DataFrame, keys: list[str], parts: list[str], order: list, amount: Column) -> DataFrame:
    """Rows with ``before``: the amounts of all rows of a key that come first, by ``parts`` (slices, in order) and inside a slice by ``order``."""
    rows = rows.withColumn("amount", amount.cast("long"))
    slices = rows.groupBy(*keys, *parts).agg(F.sum("amount").alias("whole"))
    earlier = Window.partitionBy(*keys).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*keys, *parts, F.coalesce(F.sum("whole").over(earlier), F.lit(0)).alias("slices_before"))
    within = Window.partitionBy(*keys, *parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("amount").over(within), F.lit(0))
    return rows.withColumn("inside", inside).join(slices, [*keys, *parts]).withColumn("before", F.col("slices_before") + F.col("inside")).drop(
        "amount", "inside", "slices_before")


def dealt(groups: DataFrame, shards: int) -> DataFrame:
    """(digest, shard, n): documents of each text dealt to the shards in turn, one text after the other."""
    rows = groups.withColumns({"one": F.lit(0), "part": F.pmod(F.xxhash64("digest"), F.lit(1 << SLICE_BITS))})
    rows = before(rows, ["one"], ["part"], ["digest"], F.col("n"))
    rows = rows.withColumn("shard", F.explode(F.array(*[F.lit(s) for s in range(shards)])))
    first, last = F.col("before") - 1 - F.col("shard"), F.col("before") + F.col("n") - 1 - F.col("shard")
    return rows.select("digest", "shard", (F.floor(last / shards) - F.floor(first / shards)).alias("n")).where("n > 0")


def wishes(labels: DataFrame, open_to: Sequence[bool], back: bool = False) -> DataFrame:
    """(digest, shard, n, target, gain): counts that want to join the most of their neighbours among the shards that are open.

    With ``back`` also larger counts join smaller ones, which cuts fewer links if they go whole.
    """
    mine = F.struct(F.col("n"), F.xxhash64("digest", "shard").alias("tie"), F.col("shard"))
    may = F.col("shard").isin([s for s, free in enumerate(open_to) if free])
    rows = labels.withColumns({"mine": mine, "best": F.max(F.when(may, mine)).over(Window.partitionBy("digest"))})
    return rows.where("best <> mine" if back else "best > mine").select("digest", "shard", "n", F.col("best.shard").alias("target"), F.col("best.n").alias("gain"))


def quotas(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many of those who want to go from one shard to another may go, so that none gains more than its room."""
    left, room, moved = dict(wanted), list(room), dict.fromkeys(wanted, 0)

    def go(*steps: tuple[int, int], most: int | None = None) -> int:
        n = min([left.get(s, 0) for s in steps] + ([] if most is None else [most]))
        for s in steps if n > 0 else ():
            left[s] -= n
            moved[s] += n
        return max(n, 0)

    for s, t in sorted(wanted):
        go((s, t), (t, s))
    for s, t in sorted(wanted):
        for u in range(len(room)):
            go((s, t), (t, u), (u, s))
    while True:
        some = 0
        for s, t in sorted(wanted, key=lambda k: (-left[k], k)):
            n = go((s, t), most=room[t])
            room[t] -= n
            room[s] += n
            some += n
        if not some:
            return {k: n for k, n in moved.items() if n}


def shares_of_room(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Upper limits within the room that each shard has, the largest wish first."""
    left, given = list(room), {}
    for s, t in sorted(wanted, key=lambda k: (-wanted[k], k)):
        n = min(wanted[s, t], left[t])
        left[t] -= n
        if n > 0:
            given[s, t] = n
    return given


def moved(labels: DataFrame, wanting: DataFrame, quota: dict[tuple[int, int], int], whole: bool = False) -> DataFrame:
    """Labels after the moves: the largest gains first, then by hash, exactly as many as the quotas say.

    With ``whole`` counts go whole or not at all, the smallest first, and quotas are upper limits.
    """
    allowed = F.create_map(*[F.lit(v) for (s, t), n in quota.items() for v in (s * 1000 + t, n)])
    rows = wanting.withColumns({
        "quota": F.coalesce(allowed[F.col("shard") * 1000 + F.col("target")], F.lit(0)).cast("long"),
        "level": F.floor(F.log2("n")) if whole else -F.floor(F.log2("gain")), "chance": F.xxhash64("shard", "digest")}).where("n <= quota" if whole else "quota > 0")
    rows = rows.withColumn("part", F.shiftright("chance", 56))
    rows = before(rows, ["shard", "target"], ["level", "part"], ["chance", "digest"], F.col("n"))
    left = F.col("quota") - F.col("before")
    rows = rows.withColumn("go", F.when(F.lit(not whole) | (F.col("n") <= left), F.least(F.col("n"), left))).where("go > 0")
    gone = rows.select("digest", "shard", (-F.col("go")).alias("n"))
    come = rows.select("digest", F.col("target").alias("shard"), F.col("go").alias("n"))
    return labels.union(gone).union(come).groupBy("digest", "shard").agg(F.sum("n").alias("n")).where("n > 0")


def propagated(labels: DataFrame, caps: Sequence[int], rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """Labels that no quota lets move any further, and the counts of their shards.

    A round lets documents join most of their neighbours; once none may, those whose first choice is full join the most
    among shards with room; once none may, whole counts do so against the stream. Any move starts from the first kind again.
    """

    def counted(labels: DataFrame) -> list[int]:
        found = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        return [found.get(s, 0) for s in range(len(caps))]

    labels = written(labels, "shard-labels")
    loads, kind = counted(labels), 0
    for _ in range(rounds):
        room = [c - n for c, n in zip(caps, loads, strict=True)]
        wanting = wishes(labels, [kind == 0 or r > 0 for r in room], back=kind == 2)
        wanted = {(r["shard"], r["target"]): r["n"] for r in wanting.groupBy("shard", "target").agg(F.sum("n").alias("n")).collect()}
        # Whole counts may stay behind, so that nothing may be set off against them: room alone counts.
        quota = shares_of_room(wanted, room) if kind == 2 else quotas(wanted, room)
        last = loads
        if quota:
            labels = written(moved(labels, wanting, quota, whole=kind == 2), "shard-labels")
            loads = counted(labels)
        if quota and loads != last or quota and kind < 2:
            kind = 0
        elif kind == 2:
            break
        else:
            kind += 1
    return labels, loads


def placed(rows: DataFrame, labels: DataFrame, groups: DataFrame, total: int, room: Sequence[int]) -> DataFrame:
    """Rows with their shard: every text's documents by its labels, those without neighbours where there is room."""
    share = F.array_sort(F.collect_list(F.struct("shard", "n")))
    shares = labels.groupBy("digest").agg(share.alias("shares"))
    heavy = F.broadcast(groups.where(F.col("n") > total // HEAVY).select("digest", F.lit(True).alias("heavy")))
    salts = F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    shares = shares.join(heavy, "digest", "left").select("digest", "shares", F.explode(salts).alias("salt"))
    salt = F.when(F.col("heavy"), F.pmod("chance", F.lit(SALTS))).otherwise(0).cast("int")
    rows = rows.join(heavy, "digest", "left").withColumn("salt", salt).join(shares, ["digest", "salt"], "left").drop("salt", "heavy")
    rows = written(rows, "shard-shares")
    whole = rows.where(F.size("shares") == 1).withColumn("shard", F.col("shares")[0]["shard"])
    # A text in several shards, or no neighbours (one crowd, however large): places in order of hash, cut into the shares.
    alone = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(n).cast("long").alias("n")) for s, n in enumerate(room)])
    cut = rows.where("shares is null or size(shares) > 1").withColumns({
        "crowd": F.when(F.col("shares").isNull(), F.lit(SINGLES)).otherwise(F.col("digest")), "shares": F.coalesce("shares", alone),
        "part": F.shiftright("chance", 64 - SLICE_BITS)})
    cut = before(cut, ["crowd"], ["part"], ["chance", "uid"], F.lit(1))
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(-1).alias("shard"))

    def step(acc: Column, s: Column) -> Column:
        found = acc["shard"] >= 0
        upto = acc["upto"] + s["n"]
        return F.struct(upto.alias("upto"), F.when(found, acc["shard"]).when(F.col("before") < upto, s["shard"]).otherwise(-1).alias("shard"))

    cut = cut.withColumn("shard", F.aggregate("shares", start, step, lambda acc: acc["shard"]))
    keep = ["doc_id", "size", "text_crc32", "chance", "uid", "shard"]
    return whole.select(*keep).union(cut.select(*keep))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row; slots count from 0 in each shard."""
    rows = described(docs)
    groups = written(rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "shard-texts")
    total = rows.count()
    caps = [total // shards + (s < total % shards) for s in range(shards)]
    labels, loads = propagated(dealt(groups, shards), caps)
    found = placed(rows, labels, groups, total, [c - n for c, n in zip(caps, loads, strict=True)])
    found = found.withColumn("part", F.shiftright("chance", 64 - SLICE_BITS))
    found = before(written(found, "shard-places"), ["shard"], ["part"], ["chance", "uid"], F.lit(1))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                        F.col("before").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
