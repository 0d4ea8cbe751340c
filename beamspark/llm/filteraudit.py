"""Filter interaction audit: what each filter removes in every order, from one contingency tensor per part.

A document either passes or fails each of the filters, so a part of the corpus is a tensor of counts with one axis of
length two per filter (2x2x2x2x2 for five). Every number of the audit is a contraction of that tensor: along each axis
``einsum`` takes the vector that selects pass, fail or all. Documents are read once, whatever the number of orders.

The five filters are stated in ``failures``. The first four depend on the text alone; the last fails where the text is
identical to that of a smaller doc_id of the whole table. Work at scale: texts never move, only digests and flags.
Repeated rows are added up before every shuffle. The smallest doc_id of a text is a pre-aggregated minimum and comes
back by (digest, doc_id), so that a text with a third of all rows is not one key; labels come by (doc_id, salt), so that
one doc_id with many texts is not one either. What reaches the contraction is at most 32 rows a part.

Defined cases: null texts are empty; an empty text fails A alone (and E where it is repeated). A null lang is the part ""
together with empty ones. A null doc_id is not smaller than any other and has no smaller one, and has no labels. Rows
that repeat one doc_id and text do not fail E because of each other. Several label rows of one doc_id count as one that
holds each mark any of them holds. Null labels are no marks. An empty table gives no rows. Texts are used whole; extra
columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SALTS = 16  # a doc_id's rows meet its label in so many tasks
PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
MARKS = ("n", "good", "toxic")
RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def text_failures(text: Column) -> Column:
    """Bits 1, 2, 4 and 8 for the filters A to D that a text fails: one pass over its words."""
    words = F.filter(F.split(text, "[ \\x09-\\x0D]+"), lambda w: w != "")

    def bits(w: Column) -> Column:
        n = F.size(w)
        few = F.when(n < 100, 1).otherwise(0)
        repeated = F.when(100 * F.size(F.array_distinct(w)) < 80 * n, 2).otherwise(0)
        return few + repeated

    n_chars, capitals = F.length(text), F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    shouted = F.when(100 * capitals.cast("long") > 10 * n_chars.cast("long"), 4).otherwise(0)
    # A one-element array binds the words once: they are used three times.
    return F.transform(F.array(words), bits)[0] + shouted + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters they fail, bit i for filter i."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), text_failures(F.col("text")).alias("mask"))
    rows = rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    rows = rows.join(first, ["digest", "doc_id"], "left")
    again = F.col("doc_id").isNotNull() & F.col("first").isNull()
    rows = rows.select("doc_id", "part", "n", (F.col("mask") + F.when(again, 16).otherwise(0)).alias("mask"),
                       F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int").alias("salt"))
    marks = labels.where("quality = 1 or toxic = 1").groupBy("doc_id").agg(
        F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("long")).alias("good"),
        F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("long")).alias("toxic"))
    marks = marks.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    marked = rows.join(marks, ["doc_id", "salt"], "left")
    return marked.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(F.col(m), F.lit(0))).alias(m) for m in MARKS[1:]])


def contracted(tensor: np.ndarray, axes: list[np.ndarray]) -> np.ndarray:
    """The tensor of counts (mark, filter, filter, ...) with each filter's axis contracted by its selector."""
    letters = "abcdefghijklmnopqrstuvwxy"[:len(axes)]
    return np.einsum(f"z{letters},{','.join(letters)}->z", tensor, *axes)


def audit_of(part: str, tensor: np.ndarray, filters: str = FILTERS) -> pd.DataFrame:
    """Every step of every order of the filters over one part's tensor."""
    k, found, seen = len(filters), [], {}
    whole = [ALL] * k

    def select(passed: frozenset, fails: int | None = None, rest: np.ndarray = ALL) -> np.ndarray:
        key = (passed, fails, rest is PASS)
        if key not in seen:
            axes = [FAIL if i == fails else PASS if i in passed else rest for i in range(k)]
            seen[key] = contracted(tensor, axes)
        return seen[key]

    failing = [contracted(tensor, whole[:i] + [FAIL] + whole[i + 1:])[0] for i in range(k)]
    alone = [select(frozenset(), i, PASS)[0] for i in range(k)]
    shapley = [0] * k
    for order in permutations(range(k)):
        for step, i in enumerate(order):
            before = frozenset(order[:step])
            removed = select(before, i)
            shapley[i] += int(removed[0])
            found.append(("".join(filters[j] for j in order), step + 1, i, int(select(before | {i})[0]), int(removed[0]),
                          int(failing[i] - removed[0]), int(alone[i]), int(removed[1]), int(removed[2])))
    out = pd.DataFrame(found, columns=["filter_order", "step", "i", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"])
    out["shapley"] = out.pop("i").map(lambda i: shapley[i])
    out.insert(0, "part", part)
    return out


def audited(counts: DataFrame) -> DataFrame:
    """The audit of every part from (part, mask, n, good, toxic): at most 32 rows a part are gathered."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        flat = np.zeros((len(MARKS), 1 << len(FILTERS)), dtype=np.int64)
        for j, mark in enumerate(MARKS):
            np.add.at(flat[j], rows["mask"].to_numpy(), rows[mark].to_numpy())
        # Bit i of the mask is axis i: the last axis of a C-ordered reshape is the lowest bit, so axes are turned round.
        tensor = flat.reshape(len(MARKS), *[2] * len(FILTERS)).transpose(0, *range(len(FILTERS), 0, -1))
        return audit_of(rows["part"].iloc[0], tensor)

    return counts.groupBy("part").applyInPandas(one, RESULT)


SQL = """
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
said AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM docs),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flagged AS (
  SELECT part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
                100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
                regexp_matches(text, '[#$%&*|]'), coalesce(said.doc_id > first, false)] AS fails,
         coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM said LEFT JOIN marks ON said.doc_id = marks.doc_id),
counts AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM flagged GROUP BY part, fails),
one AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM one a, one b, one c, one d, one e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT o, s.i AS step, o[s.i] AS f, list_transform(o, lambda x: 'ABCDE'[x]) AS names FROM orders, one s),
seen AS (
  SELECT part, array_to_string(names, '') AS filter_order, step, f, n, good, toxic, fails[f] AS fail,
         len(list_filter(o[:step - 1], lambda x: fails[x])) > 0 AS gone, len(list_filter(fails, lambda x: x)) = 1 AS alone
  FROM counts, steps),
audit AS (
  SELECT part, filter_order, step, f,
         CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fail), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND fail), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (WHERE gone AND fail), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (WHERE fail AND alone), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (WHERE NOT gone AND fail), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (WHERE NOT gone AND fail), 0) AS BIGINT) AS toxic_lost
  FROM seen GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM audit
"""
