"""Document fingerprints by a randomised edit embedding.

All texts take the same random walk: at step j the character under the pointer is written down, and a coin that depends
on j and the character alone decides whether the pointer moves on. Two texts with few edits between them write nearly
the same string, for after an edit the pointers meet again: edit distance becomes Hamming distance. The walk ends when
the pointer has passed the whole text.

A fingerprint samples ``SAMPLES`` steps of that string. Sample i takes the step with the smallest i-th priority among
all steps of the walk, so that texts of any length have fingerprints of one size, and of two walks the longer one
samples the same step wherever that step lies in the shorter one. A sample is eight bits of the step and character
there. The likeness of two fingerprints is the share of equal samples.

Banding takes bits of some samples as a key; rows that share a key are compared with the least one of the key, and those
whose likeness is high enough are linked (``near_links``).

Work is row by row. Texts are walked together, as array steps, while many are under way; the last and longest ones
are walked on by themselves. Nulls and empty texts have no step and the fingerprint of all zeros. Equal texts have
equal fingerprints. Repeated rows stay, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beamspark.llm.bytewords import mix
from beamspark.llm.shared import written

SAMPLES = 128
COINS = 1 << 12  # steps after which the coins repeat
CLASSES = 256  # classes of characters
TOGETHER = 48  # texts under way below which each goes on by itself
SLICE_CHARS = 1 << 23
PART_CHARS = 1 << 24  # texts whose neighbours are found in one go
BANDS, BAND_SAMPLES = 24, 5


@lru_cache(maxsize=1)
def coins() -> np.ndarray:
    """0 or 1 for each step (modulo COINS) and class of character, end to end."""
    return (mix(np.arange(COINS * CLASSES, dtype=np.uint64) + np.uint64(1 << 33)) >> np.uint64(63)).astype(np.uint8)


def sampled_steps(length: np.ndarray, samples: int) -> np.ndarray:
    """Step of each sample for walks of the given lengths: walks by samples."""
    longest = int(length.max(initial=1))
    out = np.zeros((len(length), samples), np.int64)
    for i in range(samples):
        steps = records(i, max(1, longest))
        out[:, i] = steps[np.maximum(np.searchsorted(steps, length, "left") - 1, 0)]
    return out


_RECORDS: dict[int, tuple[int, np.ndarray]] = {}


def records(sample: int, upto: int) -> np.ndarray:
    """Steps below ``upto`` whose priority for the sample is lower than that of every step before."""
    done, steps = _RECORDS.get(sample, (0, np.zeros(0, np.int64)))
    while done < upto:
        new = np.arange(done, max(2 * done, 1 << 12), dtype=np.int64)
        before = mix(steps[-1:].astype(np.uint64) ^ np.uint64((sample + 1) << 40)) if len(steps) else np.full(1, np.iinfo(np.uint64).max)
        low = np.minimum.accumulate(np.concatenate([before, mix(new.astype(np.uint64) ^ np.uint64((sample + 1) << 40))]))
        steps = np.concatenate([steps, new[np.flatnonzero(low[1:] < low[:-1])]])
        done = int(new[-1]) + 1
        _RECORDS[sample] = (done, steps)
    return steps


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of each code point."""
    return (mix(np.arange(0x110000, dtype=np.uint64) + np.uint64(7)) >> np.uint64(56)).astype(np.uint8)


def walks(chars: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Per text the classes written down, one for each step of its walk."""
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    flat = coins().reshape(COINS, CLASSES)
    n = int(np.count_nonzero(size))
    live = order[:n]
    at = offsets[live].astype(np.int64)
    end = offsets[live + 1].astype(np.int64)
    written: list[list[np.ndarray]] = [[] for _ in range(len(size))]
    step = 0
    block = 512
    while n > TOGETHER:
        kept = np.empty((block, n), np.uint8)
        moved = np.zeros(n, np.int64)
        for j in range(block):
            c = chars[at]
            kept[j] = c
            at += flat[(step + j) % COINS][c]
            over = at >= end
            if over.any():
                moved[(moved == 0) & over] = j + 1
                np.minimum(at, end - 1, out=at)
        step += block
        for i in range(n):
            written[live[i]].append(kept[:moved[i] or block, i])
        going = moved == 0
        live, at, end = live[going], at[going], end[going]
        n = len(live)
    table = flat.tolist() if n else []
    for i in range(n):
        text = chars[at[i]:end[i]].tolist()
        out, p, j, size_i = bytearray(), 0, step % COINS, len(text)
        while p < size_i:
            c = text[p]
            out.append(c)
            p += table[j][c]
            j = j + 1 if j + 1 < COINS else 0
        written[live[i]].append(np.frombuffer(bytes(out), np.uint8))
    return [np.concatenate(w) if w else np.zeros(0, np.uint8) for w in written]


def fingerprints(texts: list[str], samples: int = SAMPLES) -> np.ndarray:
    """Fingerprints of whole texts: texts by samples, a byte each."""
    out = np.zeros((len(texts), samples), np.uint8)
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) <= SLICE_CHARS):
            total += len(texts[j])
            j += 1
        part = texts[i:j]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64)
        raw = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        written = walks(class_table()[raw], offsets)
        length = np.array([len(w) for w in written], np.int64)
        some = np.flatnonzero(length)
        if len(some):
            steps = sampled_steps(length[some], samples)
            start = np.concatenate([[0], np.cumsum(length)[:-1]])[some]
            seen = np.concatenate(written)[start[:, None] + steps].astype(np.uint64)
            out[i + some] = (mix((steps.astype(np.uint64) << np.uint64(8)) | seen) >> np.uint64(56)).astype(np.uint8)
        i = j
    return out


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprint columns (lowercase hex)."""
    equal = [F.substring(a, 1 + 2 * i, 2) == F.substring(b, 1 + 2 * i, 2) for i in range(samples)]
    total = equal[0].cast("int")
    for e in equal[1:]:
        total = total + e.cast("int")
    return total / F.lit(float(samples))


def fingerprinted(docs: DataFrame, text: str = "text", out: str = "fingerprint", samples: int = SAMPLES) -> DataFrame:
    """``docs`` with the fingerprint of every whole text, as lowercase hex."""
    schema = T.StructType([f for f in docs.schema if f.name != out] + [T.StructField(out, T.StringType())])
    names = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = fingerprints([x or "" for x in b.column(text).to_pylist()], samples)
            hexed = pa.array([row.tobytes().hex() for row in found], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), hexed], names=schema.names)

    return docs.mapInArrow(run, schema)


def near_links(prints: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", fingerprint: str = "fingerprint") -> DataFrame:
    """Pairs (doc_id, other_id, likeness) of different fingerprints that share a band: each with the least of the band.

    After an edit the pointers of two walks meet again within a time that has no finite mean, so one edit may cost much of
    the likeness: take it as evidence for, not as a bound on, the number of edits. Rows with one fingerprint count as one, under their least id; nothing is gathered per band.
    """
    rows = prints.groupBy(F.col(fingerprint).alias("fingerprint")).agg(F.min(doc_id).alias("doc_id"))
    width = 2 * BAND_SAMPLES
    bands = F.array(*(F.concat(F.lit(f"{i}:"), F.substring("fingerprint", 1 + i * width, width)) for i in range(BANDS)))
    banded = rows.select("doc_id", "fingerprint", F.explode(bands).alias("band"))
    least = banded.groupBy("band").agg(F.min("doc_id").alias("other_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = banded.join(least, "band").where("doc_id <> other_id").select("doc_id", "fingerprint", "other_id").distinct()
    others = rows.select(F.col("doc_id").alias("other_id"), F.col("fingerprint").alias("other_print"))
    alike = likeness("fingerprint", "other_print").alias("likeness")
    return pairs.join(others, "other_id").select("doc_id", "other_id", alike).where(F.col("likeness") >= threshold)


def descending_parts(rows: DataFrame, part_chars: int) -> DataFrame:
    """``rows`` (doc_id, text) with a part number: ranges of descending doc_id with about ``part_chars`` characters."""
    size = rows.agg(F.count("*"), F.sum(F.length("text"))).first()
    parts = max(1, -(-int(size[1] or 0) // part_chars))
    shares = [i / parts for i in range(1, parts)]
    bounds = np.array((rows.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] if shares else None) or [], np.int64)

    @F.arrow_udf("int")
    def part(ids: pa.Array) -> pa.Array:
        found = parts - 1 - np.searchsorted(bounds, ids.fill_null(0).to_numpy(), "left")
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), parts, found).astype(np.int32))

    return rows.withColumn("part", part("doc_id"))


def with_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """Rows for ``neighbours``: every document, by part and descending doc_id, and after each part the one that follows it.

    The whole texts are shuffled once. After the last document comes the first; rows with equal ids are ordered by their
    text; null ids come last.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = descending_parts(rows, part_chars).withColumn("place", F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down")))
    heads = written(rows.groupBy("part").agg(F.min("place").alias("place")), "heads")  # a row per part, no texts
    at = Window.orderBy("part")
    before = heads.select("place", F.coalesce(F.lag("part").over(at), F.max("part").over(Window.partitionBy())).alias("part"))
    first = rows.drop("part").join(before, rows["place"] == before["place"]).groupBy("part").agg(
        F.first("doc_id").alias("doc_id"), F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first(rows["place"]).alias("place"))
    both = rows.withColumn("head", F.lit(0)).unionByName(first.withColumn("head", F.lit(1)))
    return both.repartition("part").sortWithinPartitions("part", "head", "place", F.coalesce("text", F.lit("")))


def edited(text: str, following: str) -> str:
    """The last half of the text (rounded down) replaced by the first as many characters of the next one, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def neighbours(docs: DataFrame, samples: int = SAMPLES, **options) -> DataFrame:
    """Per document row: its size, the edited text's digest, and fingerprints of itself, the edited and the next text."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        ids, texts, following = (list(x) for x in zip(*rows, strict=True))
        changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
        own, other = fingerprints(texts, samples), fingerprints(changed, samples)
        # The next text is the following row's own text but for a part's last row.
        after = np.concatenate([own[1:], own[:1]])
        odd = [i for i in range(len(texts)) if following[i] is not texts[(i + 1) % len(texts)]]
        if odd:
            after[odd] = fingerprints([following[i] for i in odd], samples)
        digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
        columns = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(digests)]
        columns += [pa.array([r.tobytes().hex() for r in x], pa.string()) for x in (own, other, after)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for b in batches:
            ready, size = [], 0
            for part, head, i, t in zip(*(b.column(c).to_pylist() for c in ("part", "head", "doc_id", "text")), strict=True):
                t = t or ""
                if held is not None and held[0] == part:
                    ready.append((held[1], held[2], t))
                    size += len(t)
                held = None if head else (part, i, t)
                if size > 4 * SLICE_CHARS:
                    yield out(ready)
                    ready, size = [], 0
            if ready:
                yield out(ready)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
    return with_next(docs, **options).select("part", "head", "doc_id", "text").mapInArrow(run, schema)
