"""Ordinal quality classifier: cumulative-link regression on hashed text.

A document's features are the slots of its distinct words, of their beginnings and of its style marks (shares of capitals, symbols, digits,
repeated words and so on, in steps), hashed into 2**BITS slots. One weight per slot is shared by all grades; ordered
thresholds cut the score: P(grade > k) = sigmoid(score - threshold[k]). Expected grade and the tail probability of the
best grades follow, and selection takes the tail.

Fitting takes a bounded sample of labelled documents (``SAMPLE``, those with the smallest hash of their id), by
proximal gradient steps with an L1 penalty, so that words which say nothing weigh exactly nothing. Scoring goes over
every whole text, row by row without a shuffle; the model (2**BITS weights) is all that is broadcast.

Nulls and texts without words have only style features and get a score like any other. Labels with a null grade or
without a document are not used; a sample in which all grades are equal gives flat thresholds and no weights. Repeated
rows are scored each; extra columns stay; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beamspark.llm.bytewords import SPACED, Words, mix, word_slices

BITS = 18
SAMPLE = 12_000
HEADS = (4, 5)  # bytes of a word's beginning that are a feature of their own; at most 7
MIN_DOCS = 4  # a slot that fewer sampled documents have keeps weight zero
L1 = 8e-4
STEPS = (160, 300)  # of the selection and of the refit
RUN = 1 << 19  # slots of texts that a step of the fit handles at once
KEEP = 0.8  # least tail probability that selection asks for

_CLASS = np.zeros(256, np.uint8)  # 1 capital, 2 digit, 3 symbol
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[list(b"!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~")] = 3
_MARKS = 9


def _step(share: np.ndarray) -> np.ndarray:
    """Share between 0 and 1 in steps that are finer near 0."""
    return np.searchsorted([0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9], share)


def style(w: Words, h: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """Slots, before the fold, of each text's style marks: rows by marks."""
    n, size = np.maximum(1, np.diff(w.offsets)), np.maximum(1, np.diff(w.bytes_at))
    kind = _CLASS[w.data]
    per = [np.diff(np.concatenate([[0], np.cumsum(kind == k)])[w.bytes_at]) / size for k in (1, 2, 3)]
    lines = np.diff(np.concatenate([[0], np.cumsum(w.data == 10)])[w.bytes_at])
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    again = np.diff(np.concatenate([[0], np.cumsum(same)])[w.offsets]) / n
    symbol_end = np.zeros(len(h), bool)
    if len(h):
        symbol_end = _CLASS[w.data[w.ends - 1]] == 3
    ends = np.diff(np.concatenate([[0], np.cumsum(symbol_end)])[w.offsets]) / n
    bare = np.diff(np.concatenate([[0], np.cumsum((w.ends - w.starts == 1) & symbol_end)])[w.offsets]) / n
    steps = [_step(x) for x in (*per, again, ends, bare, 1 - distinct / n)]
    steps += [np.log2(1 + n).astype(int), np.minimum(12, np.log2(1 + n / (1 + lines)).astype(int))]
    return np.stack([np.int64(64) * i + s for i, s in enumerate(steps)], 1)


def features(w: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct slots of each text, in text order, and the offsets between texts."""
    h = _stems(w)
    row = w.row << bits
    words = np.unique(row | (h >> np.uint64(64 - bits)).astype(np.int64))
    distinct = np.bincount(words >> bits, minlength=w.rows)
    heads = [row[long] | slot for long, slot in (_heads(w, k, bits) for k in HEADS)]
    marks = style(w, h, distinct)
    folded = (mix(marks.astype(np.uint64) + np.uint64(1 << 40)) >> np.uint64(64 - bits)).astype(np.int64)
    rows = np.repeat(np.arange(w.rows), marks.shape[1])
    both = np.unique(np.concatenate([words, *heads, (rows << bits) | folded.ravel()]))
    return both & ((1 << bits) - 1), np.concatenate([[0], np.cumsum(np.bincount(both >> bits, minlength=w.rows))])


def _heads(w: Words, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words have over k bytes, and the slots of their first k bytes."""
    long = np.flatnonzero(w.ends - w.starts > k)
    value = np.full(len(long), k, np.uint64)
    for i in range(k):
        byte = w.data[w.starts[long] + i]
        value = (value << np.uint64(8)) | (byte + 32 * (_CLASS[byte] == 1)).astype(np.uint64)
    return long, (mix(value) >> np.uint64(64 - bits)).astype(np.int64)


def _stems(w: Words) -> np.ndarray:
    """Hashes of the words without symbols and full stops at their ends."""
    cut = Words(w.first, w.data, w.starts, w.ends.copy(), w.offsets, w.bytes_at)
    for _ in range(3):
        last = w.data[np.maximum(cut.ends - 1, 0)] if len(cut.ends) else np.zeros(0, np.uint8)
        trim = ((_CLASS[last] == 3) | (last == 44) | (last == 46)) & (cut.ends - cut.starts > 1)
        cut.ends -= trim
    return cut.hashes()


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, slots: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[slots])])
        return total[offsets[1:]] - total[offsets[:-1]]

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k: texts by thresholds."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def fit(slots: np.ndarray, offsets: np.ndarray, grades: np.ndarray, top: int, *, bits: int = BITS, l1: float = L1,
        steps: tuple[int, int] = STEPS, min_docs: int = MIN_DOCS) -> OrdinalModel:
    """Weights and thresholds for grades 0..top, by accelerated proximal gradient with a diagonal step size."""
    docs = np.bincount(slots, minlength=1 << bits)
    weights = np.zeros(1 << bits)
    n = len(grades)
    share = np.array([(np.sum(grades > k) + 0.5) / (n + 1) for k in range(top)])
    theta = -np.log(share / (1 - share))
    if not n or len(np.unique(grades)) < 2:
        return OrdinalModel(weights, theta)
    # The penalty picks the slots that say something; a second round fits those with a twentieth of it.
    used = np.flatnonzero(docs >= min_docs)
    for penalty, rounds in zip((l1, l1 / 20), steps, strict=True):
        spot = np.full(1 << bits, -1, np.int32)
        spot[used] = np.arange(len(used), dtype=np.int32)
        col = spot[slots]
        kept = np.concatenate([[0], np.cumsum(col >= 0)])[offsets]
        values, theta = _descend(col[col >= 0], kept, grades, docs[used] / n, theta, penalty, rounds)
        weights[:] = 0
        weights[used] = values
        used = used[values != 0]
    return OrdinalModel(weights, theta)


def _descend(col: np.ndarray, offsets: np.ndarray, grades: np.ndarray, share: np.ndarray, theta: np.ndarray, l1: float,
             steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights of slots, which ``share`` of the documents have, and thresholds after ``steps`` steps.

    ``col`` holds each text's slots end to end. Texts are taken in runs of bounded size, to bound the memory of a step.
    """
    n, top = len(grades), len(theta)
    if not len(share):
        return np.zeros(0), theta
    cuts = np.unique(np.append(np.searchsorted(offsets, np.arange(0, offsets[-1], RUN)), n))
    runs = [(lo, hi, col[offsets[lo]:offsets[hi]], np.diff(offsets[lo:hi + 1])) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]

    def text_sums(of_slot: np.ndarray) -> np.ndarray:
        out = np.empty(n)
        for lo, hi, c, _ in runs:
            total = np.concatenate([[0.0], np.cumsum(of_slot[c])])
            out[lo:hi] = np.diff(total[offsets[lo:hi + 1] - offsets[lo]])
        return out

    # Rare slots get larger steps; the rate follows the curvature bound of the text with the most to add.
    scale = 1 / np.sqrt(share + 1e-3)
    rate = 4.0 / (text_sums(scale**2 * share).max() / 2 + 1)
    v = np.zeros(len(share))
    look, t, at = v, 1.0, np.arange(n)
    for _ in range(steps):
        score = text_sums(scale * look)
        p = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -40, 40)))
        # P(grade = k) is the difference of neighbouring tails.
        tails = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], 1)
        slope = tails * (1 - tails)
        prob = np.maximum(tails[at, grades] - tails[at, grades + 1], 1e-9)
        pull = (slope[at, grades] - slope[at, grades + 1]) / prob
        gradient = np.zeros(len(share))
        for lo, hi, c, size in runs:
            gradient -= np.bincount(c, weights=np.repeat(pull[lo:hi], size), minlength=len(share))
        gradient *= scale / n
        bend = [np.sum(slope[:, k + 1] / prob * ((grades == k + 1) * 1.0 - (grades == k))) / n for k in range(top)]
        theta = np.maximum.accumulate(theta - 0.5 * np.array(bend))
        moved = look - rate * gradient
        last, v = v, np.sign(moved) * np.maximum(np.abs(moved) - rate * l1 * scale, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        look = v + (before - 1) / t * (v - last)
    return scale * v, theta


def sampled(docs: DataFrame, labels: DataFrame, grade: Column, *, doc_id: str, text: str, sample: int, bits: int) -> DataFrame:
    """Grades and features of at most ``sample`` labelled documents, those with the smallest hash of their id."""
    graded = labels.select(F.col(doc_id).alias("doc_id"), grade.cast("int").alias("grade")).where("grade is not null and doc_id is not null")
    chosen = graded.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").select("grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for w in word_slices(b.column("text"), SPACED):
                slots, offsets = features(w, bits)
                got.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(slots.astype(np.int32))))
            if got:
                yield pa.RecordBatch.from_arrays([b.column("grade"), pa.concat_arrays(got)], names=["grade", "slots"])

    return rows.mapInArrow(run, "grade int, slots array<int>")


def trained(docs: DataFrame, labels: DataFrame, grade: Column, top: int, *, doc_id: str = "doc_id", text: str = "text",
            sample: int = SAMPLE, bits: int = BITS, **options) -> OrdinalModel:
    """Model of ``grade`` (a column of ``labels``, 0 to ``top``) fitted on the bounded sample."""
    got = sampled(docs, labels, grade, doc_id=doc_id, text=text, sample=sample, bits=bits).toArrow()
    grades = got.column("grade").to_numpy().astype(np.int64)
    lists = []
    for chunk in got.column("slots").chunks if len(grades) else []:
        at = chunk.offsets.to_numpy()
        lists += np.split(chunk.values.to_numpy()[at[0]:at[-1]], at[1:-1] - at[0])
    # The order of rows differs from run to run, and sums must not.
    order = sorted(range(len(lists)), key=lambda i: (grades[i], len(lists[i]), hashlib.blake2b(lists[i].tobytes(), digest_size=16).digest()))
    flat = np.concatenate([lists[i] for i in order]) if len(grades) else np.zeros(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum([len(lists[i]) for i in order])]).astype(np.int64)
    del got, lists
    return fit(flat, offsets, grades[order] if len(grades) else grades, top, bits=bits, **options)


def graded(docs: DataFrame, model: OrdinalModel, *, text: str = "text", bits: int = BITS) -> DataFrame:
    """``docs`` with expected_grade and tail_probability (of the best grade) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([f for f in docs.schema if f.name not in ("expected_grade", "tail_probability")]
                          + [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType())])
    names = schema.names[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            above = [m.above(m.score(*features(w, bits))) for w in word_slices(b.column(text), SPACED)]
            p = np.concatenate(above) if above else np.zeros((0, len(m.thresholds)))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(p.sum(1)), pa.array(p[:, -1])], names=schema.names)

    return docs.mapInArrow(run, schema)


def quality_and_toxicity() -> Column:
    """Grade of a labelled document: 0 poor, 1 good but toxic, 2 good; null where a label is missing."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)


def selected(docs: DataFrame, labels: DataFrame, keep: float = KEEP, **options) -> DataFrame:
    """The documents whose best grade is likely enough, columns as they are; the model is fitted on ``labels``."""
    model = trained(docs, labels, quality_and_toxicity(), 2, **options)
    text = {"text": options["text"]} if "text" in options else {}
    bits = {"bits": options["bits"]} if "bits" in options else {}
    return graded(docs, model, **text, **bits).where(F.col("tail_probability") >= keep).select(*docs.columns)
