"""The corpus queries: thin functions of (spark, sf_dir) over the operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenio.llm import sql
from provenio.llm.archives import pages_through_archives
from provenio.llm.bpe_counts import token_counts
from provenio.llm.common import scratch_path
from provenio.llm.exact_dedup import exact_dedup
from provenio.llm.filter_audit import filter_audit
from provenio.llm.jaccard_join import similarity_groups
from provenio.llm.language_id import detect_language
from provenio.llm.mixing import mix_sources
from provenio.llm.periodic_runs import periodic_runs
from provenio.llm.piece_lattice import encode
from provenio.llm.quality_rules import quality_rules
from provenio.llm.sharding import shard_by_key
from provenio.llm.suffix_dedup import suffix_dedup
from provenio.llm.toxicity import score_toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file is, on the driver as on the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_groups(_documents(spark, sf_dir), width=4, percent=85)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(_documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = pages_through_archives(pages, scratch_path(spark, "archives"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_documents(spark, sf_dir))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(_documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "n_pieces", "round_trip", "piece_ids")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_key(_documents(spark, sf_dir).select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(_documents(spark, sf_dir), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = detect_language(_documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return judged.select("doc_id", "held_out", "lang_pred", "score")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return score_toxicity(_documents(spark, sf_dir).select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_documents(spark, sf_dir).select("doc_id", "text"), plant=True)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("back"), (-r["period"]).alias("short"), r["start"], r["period"])))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "source")
    audited = filter_audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return audited.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_token_counts": op2_token_counts,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_warc": op4_warc,
        "op5_mix_sources": op5_mix_sources,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_sharding": op7_sharding,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_quality_rules": op9_quality_rules,
        "op10_language_id": op10_language_id,
        "op11_toxicity": op11_toxicity,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
