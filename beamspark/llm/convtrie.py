"""Prefix trie of conversations: which ones begin alike, how far, and what sharing their beginnings saves.

Turns become 16-byte big-endian ids (a digest of position, role and text), a conversation the string of its ids, and
adaptive radix trees (``radix.py``) over these strings find the shared beginnings: of the depths that a path of a tree
runs through, only those on whole turns become nodes.

How it is spread. A conversation is cut into blocks of ``BLOCK`` turns, so that no row grows with a conversation. A
prefix is named by the exclusive or of its turns' ids, so that the name of a block's entry is a running value, scanned in
slices. Equal blocks behind equal entries are added up first, then each task puts the blocks it holds into trees, one per
entry, and gives what it saw of every node; partial nodes are added up by name. A tree is emptied after ``HELD`` keys.

Sums over subtrees need no walk from node to node: each node is given to the member conversation with the least hash
(its *keeper*), which cuts the trie into chains, one per keeper. Sums run along a chain as suffix sums, in slices, and
a chain's total goes to the node it hangs on. Along any path the keeper changes about ln(members) times, as hashes are
random, so that chains nest so deep and no deeper, however long conversations are; each level is one small round.

Hot keys: turns are ranked over range slices of (conversation, turn), so that one conversation may hold any share of the
rows. Nodes with more than a thousandth of all nodes as children (a thousand at most) meet their children by broadcast,
the others by shuffle. Ends of equal conversations are joined in pieces of 65 536 numbers, and one task hashes a node's
pieces as a stream, since a digest has to be taken in order.

Defined cases: null role or text is empty; null turns come first; equal turn numbers follow each other by digest, and
rows repeated whole all stay. Rows without conv_id belong to no conversation. An empty table has no conversation, hence
no root. Extra columns are ignored. A text of any length is one digest and its length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beamspark.llm.radix import Tree
from beamspark.llm.shared import written

BLOCK = 64
SLICE = 1024 * BLOCK  # turns, or nodes of a chain, that one task scans in order
HELD = 20_000
WIDE = 1_000
MOST = 6  # first turns taken from another conversation are fewer than this
NODE = ("hi long, lo long, up_hi long, up_lo long, depth long, n_convs long, conv_id long, chance long, keeper long, n_chars long")
ID = ["hi", "lo"]


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, n_chars): a turn's role and text as 16 bytes."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return turns.where("conv_id is not null").select(
        "conv_id", "turn", F.substring(F.unhex(F.sha2(said, 256)), 1, 16).alias("digest"), F.length(text).cast("long").alias("n_chars"))


def ranked(rows: DataFrame) -> DataFrame:
    """Rows with ``slice``: contiguous in (conv_id, turn, digest), bounded whatever one conversation holds; written."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("same")]
    cut = rows.withColumn("same", F.monotonically_increasing_id()).repartitionByRange(*order)
    return written(cut.withColumn("slice", F.spark_partition_id()), "trie-turns")


def lengths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, slice, before) and (conv_id, total): rows of a conversation in the slices before, and in all."""
    held = turns.groupBy("conv_id", "slice").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("conv_id")
    held = held.select("conv_id", "slice", (F.sum("n").over(whole.orderBy("slice")) - F.col("n")).alias("before"))
    return held, turns.groupBy("conv_id").agg(F.count("*").alias("total"))


def rebuilt(turns: DataFrame, taken: Column, source: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first ``taken`` turns are those of conversation ``source``: (conv_id, at, digest, n_chars, length), and (conv_id, length).

    ``taken`` and ``source`` are functions of conv_id; a source is its own source. One with fewer turns gives all it has,
    one that is absent nothing.
    """
    held, total = lengths(turns)
    convs = total.select("conv_id", "total", taken.cast("long").alias("taken"), source.alias("source"))
    convs = convs.join(total.select(F.col("conv_id").alias("source"), F.col("total").alias("there")), "source", "left")
    convs = convs.withColumn("given", F.least("taken", F.coalesce("there", F.lit(0))))
    convs = convs.withColumn("length", F.col("given") + F.greatest(F.col("total") - F.col("taken"), F.lit(0)))
    within = Window.partitionBy("conv_id", "slice").orderBy(F.col("turn").asc_nulls_first(), "digest", "same")
    places = held.join(convs.select("conv_id", "taken", "given", "length"), "conv_id")
    own = turns.withColumn("rank", F.row_number().over(within)).join(places, ["conv_id", "slice"])
    own = own.withColumn("rank", F.col("rank") + F.col("before"))
    kept = own.where("rank > taken").select(
        "conv_id", (F.col("rank") - F.col("taken") + F.col("given")).alias("at"), "digest", "n_chars", "length")
    first = own.where((F.col("rank") < MOST) & (F.col("conv_id") == source)).select(F.col("conv_id").alias("source"), "rank", "digest", "n_chars")
    lent = convs.where("given > 0").join(first, "source").where("rank <= given").select(
        "conv_id", F.col("rank").alias("at"), "digest", "n_chars", "length")
    return written(kept.union(lent), "trie-places"), convs.select("conv_id", "length")


def named(places: DataFrame) -> DataFrame:
    """Turns with the two halves of their 16-byte ids: digests of position, role and text."""
    return places.withColumns({"hi": F.xxhash64("at", "digest"), "lo": F.xxhash64("digest", "at")})


def blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, block, turns, entry_hi, entry_lo, exit_hi, exit_lo): the prefixes before and after each block."""
    rows = turns.withColumns({"part": F.floor((F.col("at") - 1) / SLICE), "block": F.floor((F.col("at") - 1) / BLOCK)})
    xor = [F.bit_xor(c).alias(f"x_{c}") for c in ID]
    # Dealt by (conversation, slice): gathering blocks and scanning them needs no further exchange.
    held = rows.repartition("conv_id", "part").groupBy("conv_id", "part", "block").agg(
        F.array_sort(F.collect_list(F.struct("at", "hi", "lo", "n_chars"))).alias("turns"), *xor)
    before = Window.partitionBy("conv_id", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Only conversations of several slices have anything before a slice.
    long = rows.where(F.col("length") > SLICE).groupBy("conv_id", "part").agg(*xor)
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    long = long.select("conv_id", "part", *[F.bit_xor(f"x_{c}").over(earlier).alias(f"s_{c}") for c in ID])
    held = held.withColumns({f"b_{c}": F.bit_xor(f"x_{c}").over(before) for c in ID}).join(long, ["conv_id", "part"], "left")
    none = F.lit(0).cast("long")
    held = held.withColumns({f"entry_{c}": F.coalesce(f"b_{c}", none).bitwiseXOR(F.coalesce(f"s_{c}", none)) for c in ID})
    return held.select("conv_id", "block", "turns", "entry_hi", "entry_lo",
                       *[F.col(f"entry_{c}").bitwiseXOR(F.col(f"x_{c}")).alias(f"exit_{c}") for c in ID])


def _either(a: tuple, b: tuple) -> tuple:
    """Value of both: conversations, least conversation, keeper, and one key's prefixes and lengths of texts."""
    return a[0] + b[0], min(a[1], b[1]), min(a[2], b[2]), a[3]


def _grown(batches: Iterator[pa.RecordBatch], block_turns: int, most: int) -> Iterator[pa.RecordBatch]:
    """Partial nodes of the blocks of one task."""
    types = {"bigint": pa.int64(), "long": pa.int64()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in NODE.split(", ")])
    trees: dict[tuple, Tree] = {}
    held = 0

    def emptied() -> Iterator[pa.RecordBatch]:
        found: list[list] = [[] for _ in schema]
        for (block, *entry), tree in trees.items():
            for begin, finish, (n, conv, (chance, keeper), (hi, lo, chars)) in tree.edges():
                if begin < 0 and not block:
                    for to, v in zip(found, (0, 0, None, None, 0, n, conv, chance, keeper, 0), strict=True):
                        to.append(v)
                # Only depths on whole turns are nodes; a compressed path may run through several.
                for d in range(max(begin, 0) // 16 + 1, finish // 16 + 1):
                    up = (hi[d - 2], lo[d - 2]) if d > 1 else entry
                    for to, v in zip(found, (hi[d - 1], lo[d - 1], *up, block * block_turns + d, n, conv, chance, keeper, chars[d - 1]), strict=True):
                        to.append(v)
                    if len(found[0]) >= 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found], schema=schema)
                        found = [[] for _ in schema]
        trees.clear()
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found], schema=schema)

    for batch in batches:
        turns = batch.column("turns")
        ends = turns.offsets.to_numpy()
        hi, lo, chars = (turns.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("hi", "lo", "n_chars"))
        keys = np.stack([hi, lo], axis=1).astype(">i8").tobytes()
        rows = [batch.column(c).to_pylist() for c in ("block", "entry_hi", "entry_lo", "n_convs", "conv_id", "chance", "keeper")]
        for i, (block, entry_hi, entry_lo, n, conv, chance, keeper) in enumerate(zip(*rows, strict=True)):
            a, b = ends[i], ends[i + 1]
            prefix = [(np.bitwise_xor.accumulate(v[a:b]) ^ e).tolist() for v, e in ((hi, entry_hi), (lo, entry_lo))]
            tree = trees.setdefault((block, entry_hi, entry_lo), Tree(_either))
            tree.put(keys[16 * a:16 * b], (n, conv, (chance, keeper), (*prefix, chars[a:b].tolist())))
            held += 1
            if held >= most:
                held = 0
                yield from emptied()
    yield from emptied()


def nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie, without what its subtree adds up to; written."""
    empty = convs.where("length = 0").selectExpr(
        "conv_id", "0L as block", "cast(array() as array<struct<at:bigint,hi:bigint,lo:bigint,n_chars:bigint>>) as turns",
        "0L as entry_hi", "0L as entry_lo", "0L as exit_hi", "0L as exit_lo")
    held = blocks(turns).union(empty).groupBy("exit_hi", "exit_lo").agg(
        *[F.first(c).alias(c) for c in ("block", "turns", "entry_hi", "entry_lo")], F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.min(F.struct(F.xxhash64("conv_id").alias("chance"), F.col("conv_id").alias("keeper"))).alias("kept"))
    held = held.select("block", "turns", "entry_hi", "entry_lo", "n_convs", "conv_id", "kept.chance", "kept.keeper")
    sizes = {"block_turns": BLOCK, "most": HELD}
    seen = held.mapInArrow(partial(_grown, **sizes), NODE).groupBy(*ID).agg(
        *[F.first(c).alias(c) for c in ("up_hi", "up_lo", "depth", "n_chars")], F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
        F.min(F.struct("chance", "keeper")).alias("kept"))
    seen = written(seen.select(*ID, "up_hi", "up_lo", "depth", "n_convs", "conv_id", "kept.keeper", ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved")), "trie-nodes")
    below = seen.where("up_hi is not null").groupBy("up_hi", "up_lo").agg(F.count("*").alias("n_children"))
    both = seen.join(below.select(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo"), "n_children"), ID, "left")
    both = both.withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return written(both.withColumn("leaf", (F.col("n_children") == 0).cast("long")), "trie-counted")


SUMS = ("leaf", "saved")


def hung(found: DataFrame) -> DataFrame:
    """(hi, lo, leaf, saved): what the chains that hang on a node add up to, with all that hangs on them."""
    chains = written(found.groupBy("keeper").agg(
        F.min_by(F.struct("up_hi", "up_lo"), "depth").alias("up"), *[F.sum(c).alias(c) for c in SUMS]).select("keeper", "up.*", *SUMS), "trie-chains")
    chains = chains.where("up_hi is not null")
    sums = [F.sum(c).alias(c) for c in SUMS]
    points = chains.groupBy("up_hi", "up_lo").agg(*sums)
    points = written(points.join(found.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), "keeper"), ["up_hi", "up_lo"]), "trie-points")
    level, levels = points, [points]
    while True:
        # Sums of a chain move to the node it hangs on: one row per chain, then one per node.
        moved = level.groupBy("keeper").agg(*sums).join(chains.select("keeper", "up_hi", "up_lo"), "keeper").groupBy("up_hi", "up_lo").agg(*sums)
        level = written(moved.join(points.select("up_hi", "up_lo", "keeper"), ["up_hi", "up_lo"]), "trie-points")
        if level.isEmpty():
            break
        levels.append(level)
    whole = levels[0]
    for more in levels[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(*sums)


def summed(found: DataFrame) -> DataFrame:
    """Nodes with n_leaves and saved_tokens of their subtrees: suffix sums along each chain, in slices of depths."""
    rows = found.join(hung(found).select(*ID, *[F.col(c).alias(f"h_{c}") for c in SUMS]), ID, "left")
    rows = rows.withColumns({c: F.col(c) + F.coalesce(f"h_{c}", F.lit(0)) for c in SUMS}).drop("h_leaf", "h_saved")
    rows = written(rows.withColumn("part", F.floor(F.col("depth") / SLICE)), "trie-sums")
    deeper = Window.partitionBy("keeper").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("keeper", "part").agg(*[F.sum(c).alias(c) for c in SUMS])
    parts = parts.select("keeper", "part", *[F.coalesce(F.sum(c).over(deeper), F.lit(0)).alias(f"p_{c}") for c in SUMS])
    within = Window.partitionBy("keeper", "part").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(parts, ["keeper", "part"])
    return rows.withColumns({name: F.sum(c).over(within) + F.col(f"p_{c}") for name, c in (("n_leaves", "leaf"), ("saved_tokens", "saved"))})


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each name, which follow each other in order."""
    now, state = None, None
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        cols = zip(*done, strict=True) if done else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["hi", "lo", "ends_sha256"])

    for batch in batches:
        for hi, lo, ids in zip(*(batch.column(c).to_pylist() for c in ("hi", "lo", "ids")), strict=True):
            if (hi, lo) != now:
                if state:
                    done.append((*now, state.hexdigest()))
                now, state = (hi, lo), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if done:
            yield out()
            done = []
    if state:
        done.append((*now, state.hexdigest()))
        yield out()


def ends(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256): the conversations that end at a node, in numerical order."""
    last = turns.groupBy("conv_id").agg(*[F.bit_xor(c).alias(c) for c in ID]).union(convs.where("length = 0").selectExpr("conv_id", "0L as hi", "0L as lo"))
    pieces = last.groupBy(*ID, F.shiftright("conv_id", 16).alias("piece")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select(*ID, "piece", F.array_join(F.transform("ids", lambda c: c.cast("string")), ",").alias("ids"))
    return pieces.repartition(*ID).sortWithinPartitions(*ID, "piece").mapInArrow(_digested, "hi long, lo long, ends_sha256 string")


def with_parents(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with parent_conv_id. Nodes with more than a thousandth of all nodes as children are a thousand at most and go by broadcast."""
    parents = found.select(F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    many = found.count() // WIDE + 1
    wide = F.broadcast(parents.where(F.col("n_children") >= many).drop("n_children"))
    narrow = parents.where((F.col("n_children") > 0) & (F.col("n_children") < many)).drop("n_children")
    key = ["up_hi", "up_lo"]
    root = rows.where("up_hi is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    below = rows.where("up_hi is not null")
    return below.join(wide, key).unionByName(below.join(narrow, key)).unionByName(root)


def trie(turns: DataFrame, taken: Column | None = None, source: Column | None = None) -> DataFrame:
    """Every node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``taken`` (fewer than ``MOST``) and ``source`` say which first turns come from which conversation; none by default.
    """
    taken = F.lit(0) if taken is None else taken
    source = F.col("conv_id") if source is None else source
    places, convs = rebuilt(ranked(digests(turns)), taken, source)
    turns = named(places)
    found = nodes(turns, convs)
    rows = written(summed(found).select(*ID, "up_hi", "up_lo", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"), "trie-summed")
    rows = with_parents(rows, found).join(ends(turns, convs), ID, "left")
    none = hashlib.sha256().hexdigest()
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                       F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def contract_taken() -> Column:
    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST


def contract_source() -> Column:
    return F.col("conv_id") - F.col("conv_id") % 100


SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS rank FROM said),
-- CRC-32 of the decimal number: each byte is mixed in (a number from 0) and shifted eight times (-1)
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS source, list_reduce(
    [4294967295] || flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
      lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS crc
  FROM (SELECT DISTINCT conv_id FROM said)),
taken AS (SELECT conv_id, source, xor(crc, 4294967295) % 6 AS h FROM convs),
mixed AS (
  SELECT taken.conv_id, rank, {'r': role, 't': text} AS said FROM taken JOIN placed ON placed.conv_id = source WHERE rank <= h
  UNION ALL
  SELECT taken.conv_id, rank, {'r': role, 't': text} FROM taken JOIN placed USING (conv_id) WHERE rank > h),
paths AS (
  SELECT conv_id, coalesce(list(said ORDER BY rank) FILTER (WHERE said IS NOT NULL), []) AS path
  FROM taken LEFT JOIN mixed USING (conv_id) GROUP BY conv_id),
members AS (SELECT conv_id AS member, unnest(range(0, len(path) + 1)) AS depth, path FROM paths),
owned AS (
  SELECT member, depth, len(path) = depth AS ends, CASE WHEN depth > 0 THEN length(path[depth].t) ELSE 0 END AS chars,
         min(member) OVER (PARTITION BY depth, path[1:depth]) AS conv_id FROM members),
nodes AS (
  SELECT conv_id, depth, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS saved,
         sha256(coalesce(string_agg(CAST(member AS VARCHAR), ',' ORDER BY member) FILTER (WHERE ends), '')) AS ends_sha256
  FROM owned GROUP BY conv_id, depth),
linked AS (
  SELECT nodes.*, owned.conv_id AS parent_conv_id
  FROM nodes LEFT JOIN owned ON owned.member = nodes.conv_id AND owned.depth = nodes.depth - 1),
grown AS (
  SELECT linked.*, (SELECT count(*) FROM linked k WHERE k.parent_conv_id = linked.conv_id AND k.depth = linked.depth + 1) AS n_children FROM linked),
above AS (
  SELECT owned.conv_id, owned.depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM grown JOIN owned ON owned.member = grown.conv_id AND owned.depth <= grown.depth GROUP BY owned.conv_id, owned.depth)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM grown JOIN above USING (conv_id, depth)
"""
