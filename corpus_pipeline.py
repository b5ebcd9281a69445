"""A corpus through five stages: language ID, exact dedup, near dedup, mixing, and SentencePiece encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenio.llm.common import SMALL_BATCHES, written
from provenio.llm.exact_dedup import exact_dedup
from provenio.llm.jaccard_join import one_of_each_group
from provenio.llm.language_id import UNDETERMINED, detect_language
from provenio.llm.mixing import mixed_rows
from provenio.llm.piece_lattice import encode
from provenio.llm.registry import tokenizer_path

#: A document goes if no language has this probability on average over its bytes.
LEAST_SCORE = 0.3


def small_batches(spark: SparkSession) -> None:
    """Python stages get small Arrow batches for as long as the session lives: executors keep what large ones once took."""
    for name, value in SMALL_BATCHES.items():
        spark.conf.set(name, value)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined: those without a letter, or without a likely language, go."""
    small_batches(spark)
    judged = detect_language(docs)
    return judged.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def keep_one_of_equals(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts the one with the largest id."""
    return exact_dedup(docs).filter("kept").select(docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 on five-word shingles the one with the smallest id."""
    return one_of_each_group(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target shares: a document is there as often as the mix takes it."""
    return mixed_rows(docs).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its piece ids; the text, which they give back, stays behind."""
    small_batches(spark)
    # as the last stage it runs beside what four others have left in the executors: a smaller dictionary, a little slower
    encoded = encode(docs, tokenizer_path("piece_bpe_32k.model"), dictionary_words=50_000, remembered=40_000)
    return encoded.select("doc_id", "lang", "source", "n_pieces", "round_trip", "piece_ids")


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", keep_one_of_equals),
    ("near_dedup", keep_one_of_similar),
    ("mix_sources", mix),
    ("sentencepiece", encode_pieces),
]

#: A trained network and a tokenizer are not SQL: tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
