"""Prefix-table encoding against the library, id for id."""

import hashlib
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from beamspark.llm import pieces
from beamspark.llm.op_queries import op7_sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def want(library, text):
    ids = library.encode(text or "", add_eos=True)
    return len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))


def texts():
    rnd = random.Random(4)
    made = ["".join(rnd.choice("ab theéñ ▁\n\t012  .,!#中😀\x00Ш  ") for _ in range(rnd.randrange(40))) for _ in range(3000)]
    return [*made, "", " ", "    ", "▁", "▁▁ x", " lead", "trail ", "a" * 5000, "é" * 3000, " " * 4000, "▁ ▁", "</s><s><unk>", "x " * 20000]


def test_encode_and_decode(library):
    m = pieces.load(PATH)
    for t in texts():
        ids = library.encode(t)
        assert m.encode(t) == ids
        assert m.decode([*ids, m.eos]) == library.decode([*ids, m.eos])
        assert m.digests(t) == want(library, t)


def test_stored_chunks_are_bounded(library, monkeypatch):
    monkeypatch.setattr(pieces, "STORED_CHUNKS", 5)
    m = pieces.PieceModel(library.serialized_model_proto())
    for t in texts()[:300]:
        assert m.digests(t) == want(library, t)
        assert len(m.chunks) <= 5 and len(m.older) <= 5 and m.pairs <= 5


def test_tables(spark, library):
    rows = [(1, "Hello  world"), (1, "Hello  world"), (None, None), (2, ""), (3, "long word " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 as n_tokens", "6 as ids")
    got = sorted(map(tuple, pieces.digests(df, PATH).collect()), key=str)
    assert got == sorted([(d, *want(library, t)) for d, t in rows], key=str)
    back = pieces.decoded(pieces.encoded(df, PATH), PATH)
    assert [c for c in back.columns if c not in df.columns] == ["decoded"]
    assert sorted((r.decoded, tuple(r.ids)) for r in back.collect()) == sorted((t or "", tuple(library.encode(t or "", add_eos=True))) for _, t in rows)
    assert pieces.digests(df.limit(0), PATH).count() == 0


def test_whole_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, op7_sentencepiece(spark, sf_dir).collect())) == sorted((d.doc_id, *want(library, d.text)) for d in docs)
