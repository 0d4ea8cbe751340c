"""The pipeline, stage by stage, against brute force on the rows that each stage was given."""

import hashlib

import public_tokenizers
from sentencepiece import SentencePieceProcessor
from test_contamination import brute as contaminated
from test_near_duplicates import brute as components

import corpus_pipeline
from beamspark.llm import ordinal


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, given = docs.columns, docs
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, given, sf_dir).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before = {r.doc_id: r.text for r in given.collect()}
        after = {r.doc_id: r for r in out.collect()}
        assert out.count() == len(after) and set(after) <= set(before)
        if name == "quality":
            model = ordinal.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ordinal.quality_and_toxicity(), 2)
            want = {r.doc_id for r in ordinal.graded(docs, model).where(f"tail_probability >= {ordinal.KEEP}").collect()}
        elif name == "near_duplicates":
            want = {d for d, _, c in components(list(before.items())) if c == d}
        elif name == "decontamination":
            want = {r[0] for r in contaminated(list(before.items()), items) if not r[5]}
        else:
            library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            want = set(before)
            for d, r in after.items():
                ids = library.encode(before[d], add_eos=True)
                assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert set(after) == want
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and all(after[d].text == before[d] for d in after)
            assert len(after) < len(before)
        given = out
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, given.collect()))


def test_odd_documents(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "Some words here.", "en", None, 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf_dir)
            assert out.count() <= frame.count()
