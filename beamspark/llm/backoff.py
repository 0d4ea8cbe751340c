"""Language-model scores from a weighted backoff automaton.

The n-grams (up to ``order``) of the training documents are the states of an automaton: from state h, word w leads along
its arc with weight log10 P(w|h) if h w was seen, else along the failure arc, with weight log10(m / (c(h) + m)), to the
state of h without its first word. Smoothing is hierarchical: P(w|h) = (c(h w) + m P(w|h')) / (c(h) + m), so an arc's
weight holds all lower orders and a failure arc what is left to them; for every state the probabilities sum to 1. At the
bottom P(w) = (c(w) + d) / (N + d (V + 1)) for the V seen words, where the rest, one class of unseen words, gets the
share that words seen once have (Good and Turing), if that is more. Scoring is one traversal from left to right that
carries the state and adds weights; it runs as array steps over all tokens of a block of texts.

The model is never in one place. Documents go into chunks of about ``CHUNK_TOKENS`` tokens. Each chunk sends every
distinct n-gram it holds, with its own training count, to a shard chosen by the n-gram's hash. A shard adds up, and
answers each chunk with what is missing from its own counts. So each chunk ends up with exactly the arcs its texts can take,
and scores its texts with them. A frequent word costs one entry per chunk; chunks and shards have bounded size, and
their number follows the input. What goes over the network is packed: sorted hashes as differences, bytes by place.

Nulls and empty texts have the end token only. A null doc_id's check sum is null: it is trained on and not held out.
Repeated rows count each time. Without training tokens (empty table) every token is unseen: its share is 1. Extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beamspark.llm.bytewords import SPACED, Words, mix, word_slices

ORDER = 2
WEIGHT = 4.0  # m: how many counts the lower order is worth
ADD = 0.5  # d
CHUNK_TOKENS = 1 << 20
SHARD_ENTRIES = 1 << 20
END = np.uint64(0x2545F4914F6CDD1D)

_U = np.uint64


def _mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(context * _U(0x9FB21C651E98DF25) + word)


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts of a slice with an end after each, and the offsets between texts."""
    offsets = w.offsets + np.arange(len(w.offsets))
    out = np.empty(offsets[-1], _U)
    ends = offsets[1:] - 1
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[ends] = END
    out[inside] = w.hashes()
    return out, offsets


def ngrams(t: np.ndarray, offsets: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per length k the hash of the k tokens that end at each token, and whether they lie in one text."""
    back = np.arange(len(t)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = [(t, np.ones(len(t), bool))]
    for k in range(2, order + 1):
        g = np.zeros(len(t), _U)
        g[k - 1:] = _mixed(out[-1][0][k - 2:-1], t[k - 1:])
        out.append((g, back >= k - 1))
    return out


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys and their counts: differences, first bytes first, so that they compress."""
    d = np.diff(keys, prepend=_U(0))
    return (np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes()
            + np.ascontiguousarray(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(raw, np.uint8).reshape(2, 8, -1)
    d, c = (np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in a)
    with np.errstate(over="ignore"):
        return np.cumsum(d, dtype=_U), c.astype(np.int64)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def counted(texts: Iterator[pa.RecordBatch], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per length the distinct n-grams of all texts with their counts in training texts."""
    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order)]
    for b in texts:
        training = ~b.column("held_out").to_numpy(zero_copy_only=False)
        for w in word_slices(b.column("text"), SPACED):
            t, offsets = tokens(w)
            train = np.repeat(training[w.first:w.first + w.rows], np.diff(offsets)).astype(np.int64)
            for k, (g, whole) in enumerate(ngrams(t, offsets, order)):
                held[k].append(added(g[whole], train[whole]))
    return [added(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else (np.zeros(0, _U), np.zeros(0, np.int64))
            for parts in held]


def cut_at(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where sorted keys are cut into shards, which are equal ranges of the keys' upper 32 bits."""
    return np.searchsorted(keys >> _U(32), (np.arange(shards + 1, dtype=_U) << _U(32)) // _U(shards))


def sent(per_length: list[tuple[np.ndarray, np.ndarray]], shards: list[int], chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, chunk, packed): what a chunk sends; the shards of all lengths are numbered through."""
    base = 0
    for (keys, counts), n in zip(per_length, shards, strict=True):
        cut = cut_at(keys, n)
        rows = [(base + s, chunk, pack(keys[cut[s]:cut[s + 1]], counts[cut[s]:cut[s + 1]])) for s in np.flatnonzero(np.diff(cut))]
        if rows:
            s, c, p = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(c, pa.int32()), pa.array(p, pa.binary())], names=["shard", "chunk", "packed"])
        base += n


def answers(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the totals of a shard add to each chunk's own counts, in the order of the keys that the chunk sent."""
    chunks, keys, counts = [], [], []
    for b in batches:
        chunks += b.column("chunk").to_pylist()
        for p in b.column("packed").to_pylist():
            k, n = unpack(p)
            keys.append(k)
            counts.append(n)
    flat, own = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(flat)
    first = np.ones(len(flat), bool)
    first[1:] = flat[order[1:]] != flat[order[:-1]]
    total = np.empty(len(flat), np.int64)
    total[order] = np.add.reduceat(own[order], np.flatnonzero(first))[np.cumsum(first) - 1]
    more = np.split(total - own, np.cumsum([len(k) for k in keys])[:-1])
    rows = [(key[0].as_py(), c, m.view(np.uint8).reshape(-1, 8).T.tobytes()) for c, m in zip(chunks, more, strict=True) if m.any()]
    if rows:
        s, c, p = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(c, pa.int32()), pa.array(p, pa.binary())], names=["shard", "chunk", "packed"])


def bottom(totals: tuple[int, int, int], add: float) -> tuple[float, float]:
    """Constants (scale, unseen) with P(w) = (c + add) * scale for seen words and ``unseen`` for the class of the others."""
    n, v, once = totals
    if not n:
        return 0.0, 1.0
    plain = add / (n + add * (v + 1))
    unseen = max(plain, once / (n + 1.0) if once < n else plain)
    return (1 - unseen) / (n + add * v), unseen


def traverse(t: np.ndarray, offsets: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]], totals: tuple[int, int, int], *, weight: float,
             add: float) -> tuple[np.ndarray, np.ndarray]:
    """log10 P of each token in its state, and each token's training count.

    A token's longest context that was seen is the state it is read in; arcs that lead on from shorter contexts are
    already part of the longer arc's weight, failure arcs are the factor m / (c(h) + m).
    """
    order = len(tables)
    counts = []
    for (g, whole), (keys, n) in zip(ngrams(t, offsets, order), tables, strict=True):
        at = np.minimum(np.searchsorted(keys, g), max(0, len(keys) - 1))
        found = whole & (keys[at] == g) if len(keys) else np.zeros(len(g), bool)
        counts.append(np.where(found, n[at] if len(keys) else 0, 0))
    scale, unseen = bottom(totals, add)
    p = np.where(counts[0] > 0, (counts[0] + add) * scale, unseen)
    for k in range(1, order):
        context = np.zeros(len(t), np.int64)  # how often the k tokens before this one were seen
        context[1:] = counts[k - 1][:-1]
        context[offsets[:-1]] = 0  # what stands before a text's first token is another text
        p = np.where(context > 0, (counts[k] + weight * p) / (context + weight), p)
    return np.log10(p), counts[0]


def training_totals(rows: DataFrame, shards: int) -> tuple[int, int, int]:
    """Training tokens, distinct ones, and those seen once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        pending = 0
        for b in batches:
            held.append(counted(iter([b]), 1)[0])
            pending += len(held[-1][0])
            if pending > 4 * SHARD_ENTRIES:  # several rows per shard and task are as good as one
                yield from sent([added(*(np.concatenate(x) for x in zip(*held, strict=True)))], [shards], 0)
                held, pending = [], 0
        if held:
            yield from sent([added(*(np.concatenate(x) for x in zip(*held, strict=True)))], [shards], 0)

    def sums(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, _U), np.zeros(0, np.int64)
        for b in batches:
            parts = [unpack(p) for p in b.column("packed").to_pylist()]
            keys, n = added(np.concatenate([keys, *(p[0] for p in parts)]), np.concatenate([n, *(p[1] for p in parts)]))
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in (n.sum(), (n > 0).sum(), (n == 1).sum())], names=["n", "v", "once"])

    packed = rows.select("held_out", "text").mapInArrow(count, "shard int, chunk int, packed binary")
    row = packed.groupBy("shard").applyInArrow(sums, "n long, v long, once long").agg(F.sum("n"), F.sum("v"), F.sum("once")).first()
    return tuple(int(x or 0) for x in row)


def automaton_scores(docs: DataFrame, held_out: Column, *, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, weight: float = WEIGHT,
                     add: float = ADD, chunk_tokens: int = CHUNK_TOKENS, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    ``held_out`` is a boolean column of ``docs``; the rest trains the model. base_score is the add-one unigram score.
    """
    if order < 1:
        raise ValueError("order must be 1 or more")
    flag = F.coalesce(held_out, F.lit(False)).alias("held_out")
    rows = docs.select(F.col(doc_id).alias("doc_id"), flag, F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.length("text")), F.count("*")).first()
    tokens_about = int((size[0] or 0) / 5 + size[1])
    chunks = max(1, math.ceil(tokens_about / chunk_tokens))
    shards = [max(1, math.ceil(tokens_about / shard_entries))] * order
    totals = training_totals(rows, shards[0])
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(chunks)).cast("int"))

    def send(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sent(counted(batches, order), shards, key[0].as_py())

    def score(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        batches = texts.to_batches()
        tables = counted(iter(batches), order)
        cuts = [cut_at(keys, n) for (keys, _), n in zip(tables, shards, strict=True)]
        for s, p in zip(told.column("shard").to_pylist(), told.column("packed").to_pylist(), strict=True):
            k = next(i for i in range(order) if s < sum(shards[:i + 1]))
            keys, n = tables[k]
            lo, hi = cuts[k][s - sum(shards[:k])], cuts[k][s - sum(shards[:k]) + 1]
            n[lo:hi] += np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(8, -1).T).view(np.int64).ravel()
        n_all, v, _ = totals
        out = [[], [], [], []]
        for b in batches:
            for w in word_slices(b.column("text"), SPACED):
                t, offsets = tokens(w)
                log_p, known = traverse(t, offsets, tables, totals, weight=weight, add=add)
                base = np.log10((known + 1) / (n_all + 1 * (v + 1)))
                out[0].append(np.diff(offsets))
                out[1].append(np.add.reduceat((known > 0).astype(np.int64), offsets[:-1]))
                out[2].append(np.add.reduceat(base, offsets[:-1]))
                out[3].append(np.add.reduceat(log_p, offsets[:-1]))
        n, known, base, log_p = map(np.concatenate, out)
        return pa.Table.from_arrays([texts.column("doc_id"), texts.column("held_out"), pa.array(n.astype(np.int64)), pa.array(known),
                                     pa.array(np.full(len(n), n_all)), pa.array(base), pa.array(log_p)], names=result.names)

    result = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string(
        "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    packed = "shard int, chunk int, packed binary"
    told = rows.groupBy("chunk").applyInArrow(send, packed).groupBy("shard").applyInArrow(answers, packed)
    return rows.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, result)
