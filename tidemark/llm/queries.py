"""The queries opN_<name> of this subpackage and the SQL that some can be checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, embedding_dedup, fill_in_middle, line_dedup, mixing, ngram_lm, packing, quality_rules, simhash, substring_dedup, toxicity, url_filter, whitening
from tidemark.llm.text import table

URL_RULES = (
    url_filter.rule("block", "net/"),
    url_filter.rule("allow", "example.net/en/"),
    url_filter.rule("block", "example.com/de/"),
    url_filter.rule("allow", "org/fr/"),
)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, rules=URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _remainder(doc_id: Column, by: int) -> Column:
    """crc32 of doc_id as text, mod by; a null doc_id has 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % by, F.lit(0))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).filter(_remainder(F.col("doc_id"), 3) != 1)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", (_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", "evidence")


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ngram_lm.train(docs.filter(_remainder(F.col("doc_id"), 5) != 1))
    scored = ngram_lm.score(docs, model)
    return scored.select("doc_id", (_remainder(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return chat.digests(chat.format_windows(rows.unionByName(extra)))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mixing.rates(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rated.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), n=4, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("embedding")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id", F.col("n_units").alias("n"), "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored).alias("restored_sha256"),
    )


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), least=35)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_quality_rules, op3_toxicity, op4_ngram_lm, op5_chat_format,
        op6_line_dedup, op7_mixing, op8_embedding_dedup, op9_simhash, op10_packing,
        op11_whitening, op12_fill_in_middle, op13_substring_dedup,
    )
}
