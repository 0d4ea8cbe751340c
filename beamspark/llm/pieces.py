"""SentencePiece encoding and decoding of merge-type models with a prefix table.

A merge-type encoding of a prefix ends in one piece that only the prefix decides. The table stores that piece for each
prefix: among the pieces that end there (automaton matches) it is the one whose neighbour to the left, the last piece
of the prefix before it, stays beside it when the two are encoded together (pair compatibility). Walking the table
from the end gives the ids backwards. This takes time linear in the text, whatever its length.

No piece of these models has a space mark after another character, so the marks cut a text into chunks that no merge
crosses. Each worker keeps the encodings of chunks seen before, in a store of bounded size: two generations, the older of which
goes when the newer is full; what is asked for again moves to the newer one.

Nulls and empty texts have no pieces, only the end id; they decode to the empty text. Repeated rows stay, extra columns
are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as model_pb2

MARK = "▁"  # fixed value: stands for a space in the model
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types
STORED_CHUNKS = 3 << 17  # in each of two generations
ROWS = 512  # texts taken out of a batch at once
STORED_CHARS = 64  # longer chunks are encoded anew each time


class PieceModel:
    """Prefix-table encoder of one merge-type model with byte fallback and the identity normaliser."""

    def __init__(self, serialized: bytes):
        m = model_pb2.ModelProto()
        m.ParseFromString(serialized)
        kinds = {p.type for p in m.pieces}
        if m.trainer_spec.model_type != model_pb2.TrainerSpec.BPE or not m.trainer_spec.byte_fallback or kinds & {USER, UNUSED}:
            raise ValueError("only merge-type models with byte fallback and without user-defined pieces")
        if m.normalizer_spec.name != "identity" or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only the identity normaliser that keeps white space")
        self.prefix = MARK if m.normalizer_spec.add_dummy_prefix else ""
        self.score = {p.piece: p.score for p in m.pieces if p.type == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece has a space mark after another character")
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = []
        for i, p in enumerate(m.pieces):
            if p.type == BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_ids[value] = i
                self.surface.append(bytes([value]))
            else:
                self.surface.append(b"" if p.type == CONTROL else p.piece.replace(MARK, " ").encode())
        self.eos = next(i for i, p in enumerate(m.pieces) if p.piece == m.trainer_spec.eos_piece)
        self.automaton = ahocorasick.Automaton()
        for p in self.score:
            if self.merged(p) == [p]:  # a piece that its own text doesn't give is never used
                self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()
        self.beside: dict[str, dict[str, bool]] = {}  # by left piece, then right piece
        self.pairs = 0
        self.chunks: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by its merges, best score first and leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two pieces stay as they are when encoded together."""
        if self.pairs >= STORED_CHUNKS:
            self.beside, self.pairs = {}, 0
        self.pairs += 1
        known = self.beside.setdefault(left, {})[right] = self.merged(left + right) == [left, right]
        return known

    def pieces(self, text: str) -> list[str]:
        """Pieces of a chunk: fill the prefix table from the left, then walk it from the end."""
        if text in self.ids and self.automaton.exists(text):
            return [text]
        last: list[str | None] = [None] * (len(text) + 1)
        rows = self.beside.get
        for at, (piece, size) in self.automaton.iter(text):
            end = at + 1
            if last[end] is not None:
                continue
            start = end - size
            if start:
                left = last[start] or text[start - 1]
                row = rows(left)
                fits = row.get(piece) if row is not None else None
                if fits is None:
                    fits = self.compatible(left, piece)
                    rows = self.beside.get
                if not fits:
                    continue
            last[end] = piece
        out, i = [], len(text)
        while i:
            piece = last[i] or text[i - 1]  # no piece: a character outside the model, encoded as bytes
            out.append(piece)
            i -= len(piece)
        return out[::-1]

    def chunk_ids(self, text: str) -> list[int]:
        out = []
        for p in self.pieces(text):
            i = self.ids.get(p)
            if i is None:
                out.extend(self.byte_ids[b] for b in p.encode())
            else:
                out.append(i)
        return out

    def chunk(self, text: str) -> tuple[str, bytes]:
        """Ids of a chunk in decimal, joined by spaces, and the bytes that these ids decode to."""
        done = self.older.get(text)
        if done is None:
            ids = self.chunk_ids(text)
            done = " ".join(map(str, ids)), self.decode_bytes(ids)
        if len(text) <= STORED_CHARS:
            if len(self.chunks) >= STORED_CHUNKS:
                self.chunks, self.older = {}, self.chunks
            self.chunks[text] = done
        return done

    def split(self, text: str) -> list[str]:
        """Chunks of a whole text: marks, then what follows up to the next mark."""
        if not text:
            return []
        if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " " and self.prefix:
            return (MARK + text.replace(" ", f" {MARK}")).split(" ")
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", self.prefix + text.replace(" ", MARK))

    def encode(self, text: str) -> list[int]:
        return [i for c in self.split(text) for i in self.chunk_ids(c)]

    def decode_bytes(self, ids: list[int]) -> bytes:
        surface = self.surface
        return b"".join([surface[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; the space that the dummy prefix put in front goes."""
        raw = self.decode_bytes(ids)
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of ids with the end id, and digests of the ids and of the decoded text."""
        chunks, get = self.split(text), self.chunks.get
        done = [get(c) or self.chunk(c) for c in chunks]  # a full store is replaced, not changed: get may miss, never err
        ids = " ".join([d[0] for d in done])
        ids = f"{ids} {self.eos}" if ids else str(self.eos)
        raw = b"".join([d[1] for d in done])
        raw = raw[1:] if self.prefix and raw[:1] == b" " else raw
        return ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()


@lru_cache(maxsize=4)
def load(path: str) -> PieceModel:
    return PieceModel(SentencePieceProcessor(model_file=path).serialized_model_proto())


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[str]:
    column = batch.column(name)
    return (x or "" for at in range(0, len(column), ROWS) for x in column.slice(at, ROWS).to_pylist())


def encoded(docs: DataFrame, model: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text, end id last, in column ``out``."""
    schema = T.StructType([f for f in docs.schema if f.name != out] + [T.StructField(out, T.ArrayType(T.IntegerType()))])
    names = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for b in batches:
            ids = pa.array([[*m.encode(t), m.eos] for t in _texts(b, text)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), ids], names=[*names, out])

    return docs.mapInArrow(run, schema)


def decoded(rows: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of every list of ids; null ids give null."""
    schema = T.StructType([f for f in rows.schema if f.name != out] + [T.StructField(out, T.StringType())])
    names = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for b in batches:
            texts = pa.array([None if x is None else m.decode(x) for x in b.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), texts], names=[*names, out])

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: number of ids, digest of the ids and digest of what they decode to. Row by row, no shuffle."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for b in batches:
            found = [m.digests(t) for t in _texts(b, "text")]
            cols = zip(*found, strict=True) if found else ([], [], [])
            n, i, d = map(list, cols)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return rows.mapInArrow(run, schema)
