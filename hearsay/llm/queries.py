"""Registered queries of the corpus operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.llm import (
    conversation_trie,
    decontamination,
    jaccard_join,
    language_id,
    licenses,
    line_dedup,
    mixing,
    pii,
    quality_mil,
    repetition,
    substring_dedup,
    token_alignment,
    url_graph,
)
from hearsay.llm.shipping import ship
from hearsay.llm.tables import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    digest = F.sha2("base_spans", 256).alias("base_sha256")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", digest, "spans", "n_spans")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.learn(docs.where(~F.coalesce(held_out(), F.lit(False))))
    out = F.coalesce(held_out(), F.lit(False)).alias("held_out")
    return language_id.predict(docs, profiles).select("doc_id", out, "lang_pred", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op4_url_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.judge(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines before and after, and a digest of what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    before = docs.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long"))
    after = line_dedup.drop_boilerplate(before)
    left = F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0).cast("long")
    return after.select(
        "doc_id", "source", "n_lines", left.alias("n_left"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    )


def op6_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out())
    scored = quality_mil.score(docs, quality_mil.learn(docs, labels))
    out = F.coalesce(held_out(), F.lit(False)).alias("held_out")
    return scored.select("doc_id", out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.measure(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    as_text = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *as_text, "score")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_alignment.align(table(spark, sf_dir, "documents"), token_alignment.Tokenizers.read())
    counts = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, "groups_sha256", "n_group_links")


def with_shared_heads(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) that begin like the conversation of their hundred: its first crc32(id) % 6 turns, then the own ones."""
    own = conversations.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int"))
    own = own.withColumn("hundred", F.col("conv_id") - F.col("conv_id") % 100)
    heads = conversations.where("conv_id % 100 = 0").select(F.col("conv_id").alias("hundred"), F.slice("turns", 1, 5).alias("head"))
    rest = F.expr("filter(turns, (t, i) -> i >= h)")
    return own.join(heads, "hundred", "left").select(
        "conv_id", F.concat(F.coalesce(F.expr("slice(head, 1, h)"), F.expr("filter(turns, t -> false)")), rest).alias("turns")
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversation_trie.sequences(table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(with_shared_heads(written(found, "conversations")))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_language_id": op2_language_id,
    "op3_decontamination": op3_decontamination,
    "op4_url_graph": op4_url_graph,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_mil": op6_quality_mil,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_repetition": op8_repetition,
    "op9_mixing": op9_mixing,
    "op10_licenses": op10_licenses,
    "op11_token_alignment": op11_token_alignment,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_substring_dedup": op13_substring_dedup,
}
