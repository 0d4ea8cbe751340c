"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` consecutive words (an item of fewer words is one window). A
window occurs in a document where all its words do, in order. As sets of word shingles: all shingles of the window must
be there, so one of them is prefix enough. Shingles are ordered by rarity over all documents, and the rarest of each
window is its prefix.

1. Count, over all documents, the shingles that benchmark windows hold (pre-aggregated in each task).
2. Per window keep the rarest shingle and its offset in the window.
3. Join the documents' shingles with these prefixes. Offset and lengths give where the window would begin; it must
   lie within the document. The words there are compared with the window's words one by one.
4. Per document, the union of the found spans.

Documents are read twice and never shuffled; only places whose shingle passes a bit table of fixed size
(``TABLE_BITS``) go into the join. A fuller table lets more places through and never loses one. Bounds: the table, the
counts and prefixes (as many as benchmark words), and a context of under three windows for each place.

Nulls and texts without words have no words and no hits; items without words have no window. Rows that repeat are kept
apart by a row key; a null doc_id stays null. Extra columns are ignored. Empty tables give no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beamspark.llm.bytewords import ALNUM, Words, signed, word_slices
from beamspark.llm.shared import written

WINDOW = 13
SHINGLE = 5
TABLE_BITS = 24  # a bit table of 2 MB

_WINDOWS = "item_id string, words array<string>, shingle long, size int, at int"
_COUNTS = "shingle long, n long"
_PLACES = "hash long, at int, first int, context array<string>"


def item_windows(items: DataFrame, item_id: str, text: str, window: int, shingle: int) -> DataFrame:
    """One row per window and shingle of it: the words, the shingle's hash, its words and its offset."""
    rows = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("item_id").to_pylist()
            for w in word_slices(b.column("text"), ALNUM):
                h = w.hashes()
                grams = {}
                for r in range(w.rows):
                    out = []
                    lo, hi = int(w.offsets[r]), int(w.offsets[r + 1])
                    size = min(window, hi - lo)
                    k = min(shingle, size)
                    if not size:
                        continue
                    if k not in grams:
                        grams[k] = signed(w.grams(h, k)[0])
                    for s in range(lo, hi - size + 1):
                        words = [w.word(i) for i in range(s, s + size)]
                        out += [(ids[w.first + r], words, int(grams[k][s + o]), k, o) for o in range(size - k + 1)]
                    cols = list(zip(*out, strict=True))
                    kinds = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                                     names=["item_id", "words", "shingle", "size", "at"])

    return rows.mapInArrow(run, _WINDOWS)


def bit_table(shingles: DataFrame, bits: int) -> np.ndarray:
    """Bit table of hashes, by their upper bits. The driver gets at most the 2**bits slots that are set."""
    slots = shingles.select(F.shiftrightunsigned("shingle", 64 - bits).cast("int").alias("slot")).distinct().toArrow()
    on = np.zeros(1 << bits, bool)
    on[slots.column("slot").to_numpy()] = True
    return np.packbits(on)


def _passing(g: np.ndarray, whole: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    slot = (g >> np.uint64(64 - bits)).astype(np.int64)
    return np.flatnonzero(whole & ((table[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).astype(bool))


def shingle_counts(docs: DataFrame, table: np.ndarray, sizes: list[int], bits: int) -> DataFrame:
    """Occurrences, over all documents, of the shingles whose slot is set."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for w in word_slices(b.column("text"), ALNUM):
                h = w.hashes()
                for k in sizes:
                    g, whole = w.grams(h, k)
                    got.append(g[_passing(g, whole, sent.value, bits)])
            keys, n = np.unique(np.concatenate(got) if got else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(n.astype(np.int64))], names=["shingle", "n"])

    return docs.select("text").mapInArrow(run, _COUNTS).groupBy("shingle").agg(F.sum("n").alias("n"))


def _places(w: Words, h: np.ndarray, table: np.ndarray, sizes: list[int], bits: int, window: int) -> list[list[dict]]:
    """Per text the places of passing shingles, each with the words around it."""
    out: list[list[dict]] = [[] for _ in range(w.rows)]
    row = w.row
    for k in sizes:
        g, whole = w.grams(h, k)
        hashes = signed(g)
        for p in _passing(g, whole, table, bits):
            r = int(row[p])
            lo = max(int(w.offsets[r]), int(p) - window + k)
            hi = min(int(w.offsets[r + 1]), int(p) + window)
            out[r].append({"hash": int(hashes[p]), "at": int(p - w.offsets[r]), "first": int(lo - w.offsets[r]),
                           "context": [w.word(i) for i in range(lo, hi)]})
    return out


def document_places(docs: DataFrame, table: np.ndarray, sizes: list[int], bits: int, window: int) -> DataFrame:
    """Per document row: a key of its own, its number of words and its places."""
    sent = docs.sparkSession.sparkContext.broadcast(table)
    places = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("context", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for b in batches:
            n, found = [], []
            for w in word_slices(b.column("text"), ALNUM):
                n.append(np.diff(w.offsets))
                found += _places(w, w.hashes(), sent.value, sizes, bits, window)
            counts = np.concatenate(n) if n else np.zeros(0, np.int64)
            keys = np.arange(key, key + len(counts), dtype=np.int64)
            key += len(counts)
            yield pa.RecordBatch.from_arrays([pa.array(keys), b.column("doc_id"), b.column("text_hash"), pa.array(counts.astype(np.int64)), pa.array(found, places)],
                                             names=["key", "doc_id", "text_hash", "n_words", "places"])

    schema = T.StructType([T.StructField("key", T.LongType()), docs.schema["doc_id"], docs.schema["text_hash"], T.StructField("n_words", T.LongType()),
                           T.StructField("places", T.ArrayType(T._parse_datatype_string(_PLACES)))])
    return docs.mapInArrow(run, schema)


def covered(spans: str) -> F.Column:
    """Number of positions in the union of sorted spans (start, end)."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("upto"))

    def step(acc: F.Column, s: F.Column) -> F.Column:
        fresh = F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], acc["upto"]))
        return F.struct((acc["n"] + fresh).alias("n"), F.greatest(acc["upto"], s["end"]).alias("upto"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def contaminated_spans(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, bits: int = TABLE_BITS) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, the sorted spans of words that benchmark windows cover, and item_ids."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    windows = item_windows(items, item_id, item_text, window, shingle)
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most ``shingle`` values
    counts = shingle_counts(rows, bit_table(windows, bits), sizes, bits)
    ranked = windows.join(counts, "shingle", "left").withColumn("order", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("shingle")))
    prefix = ranked.groupBy("item_id", "words").agg(
        F.min_by(F.struct("shingle", "size"), "order").alias("rarest"), F.min_by("at", F.struct("order", "at")).alias("offset"))
    # Written once: the bit table and the join would each count the corpus anew.
    prefix = written(prefix.select("item_id", "words", F.col("rarest.shingle").alias("hash"), "offset"), "prefixes")
    found = document_places(rows, bit_table(prefix.select(F.col("hash").alias("shingle")), bits), sizes, bits, window)
    places = found.select("key", "doc_id", "text_hash", "n_words", F.explode_outer("places").alias("place"))
    # Rows without a place carry a key of their own instead of one null that all would meet at.
    places = places.select("key", "doc_id", "text_hash", "n_words", "place.at", "place.first", "place.context",
                           F.coalesce("place.hash", F.xxhash64("key")).alias("hash"))
    start = F.col("at") - F.col("offset")
    size = F.size("words")
    fits = (start >= F.col("first")) & (start + size <= F.col("first") + F.size("context"))
    same = F.slice("context", F.when(fits, start - F.col("first") + 1).otherwise(1), size) == F.col("words")
    joined = places.join(prefix, "hash", "left").withColumn("hit", F.when(fits & same, F.struct(start.alias("start"), (start + size).alias("end"))))
    per_doc = joined.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.first("n_words").alias("n_words"), F.array_sort(F.collect_set("hit")).alias("spans"),
        F.array_sort(F.collect_set(F.when(F.col("hit").isNotNull(), F.col("item_id")))).alias("item_ids"))
    return per_doc.select("doc_id", "n_words", covered("spans").alias("n_hit"), "spans", "item_ids", "text_hash")


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> F.Column:
    """A twentieth of a document's words, and at least one, lie in benchmark windows."""
    return (F.col(n_hit) > 0) & (F.lit(20) * F.col(n_hit) >= F.col(n_words))


def items_digest(items: str = "item_ids") -> F.Column:
    return F.sha2(F.array_join(items, ","), 256)


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated ones, columns as they are. Rows are told apart by id and text, null ids too."""
    bad = contaminated_spans(docs, items, **options).where(contaminated())
    bad = bad.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    doc_id, text = docs[options.get("doc_id", "doc_id")], docs[options.get("text", "text")]
    return docs.join(bad, doc_id.eqNullSafe(bad["bad_id"]) & (F.xxhash64(text.cast("string")) == bad["bad_hash"]), "left_anti")
