"""Registered queries: the contract's columns from each operator's own results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamspark.llm import (
    backoff, contamination, convtrie, derivatives, editwalk, filteraudit, licences, ordinal, perspectives, pieces, setjoin, sharding, tagpaths,
)
from beamspark.llm.shared import query
from beamspark.plans.registry import table


def piece_model() -> str:
    """Path of the public 32k merge-type model, the same on every node."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op7_sentencepiece")
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), piece_model())


@query("op5_decontamination")
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        contamination.items_digest().alias("items_sha256"), contamination.contaminated().alias("contaminated"))


@query("op9_ordinal_quality")
def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.trained(docs, table(spark, sf_dir, "labels"), ordinal.quality_and_toxicity(), 2)
    found = ordinal.graded(docs, model)
    return found.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= ordinal.KEEP).alias("keep"))


@query("op10_jaccard_join")
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_components(table(spark, sf_dir, "documents"))


@query("op8_backoff_scores")
def op8_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return backoff.automaton_scores(table(spark, sf_dir, "documents"), held_out)


@query("op6_edit_fingerprints")
def op6_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = editwalk.neighbours(table(spark, sf_dir, "documents"))
    near = [editwalk.likeness("fingerprint", other).alias(name) for other, name in (("edited_fingerprint", "near_edited"), ("next_fingerprint", "near_next"))]
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near)


@query("op2_tag_paths")
def op2_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagpaths.sized(tagpaths.extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


@query("op1_perspectives", perspectives.SQL)
def op1_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = perspectives.rotated(table(spark, sf_dir, "conversations"))
    return found.withColumn("mask", perspectives.mask_text())


@query("op4_warc_derivatives", derivatives.SQL)
def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives.derived(derivatives.responses(table(spark, sf_dir, "pages")), keep=("page_id",))


@query("op3_licences")
def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scanned(docs, licences.trained(docs))


@query("op11_conversation_trie", convtrie.SQL)
def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.trie(table(spark, sf_dir, "conversations"), convtrie.contract_taken(), convtrie.contract_source())


@query("op12_filter_audit", filteraudit.SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = filteraudit.failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filteraudit.audited(counts)


@query("op13_label_shards")
def op13_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))
