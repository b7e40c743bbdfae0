"""From raw documents to packed sequences.

Language ID, near-duplicate removal, benchmark decontamination, secret redaction, packing. Each stage takes
(spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder and reads it again.
Documents that are clean pass every filtering stage; all their columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm import decontaminate, language_id, minhash_dedup, packing, secret_scan
from pricelens.llm.common import table, written
from pricelens.llm.tokens import tokenizer_path

#: Languages that the first stage keeps; None: all that the labelled rows teach.
WANTED: frozenset[str] | None = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str, wanted: frozenset[str] | None = WANTED) -> DataFrame:
    """Drops documents that are no text of a known language: those without letters, and those whose grams no learned
    language makes likely (other languages, strings of letters); with `wanted`, also those predicted to be of a language
    that isn't in it. Texts in several languages are kept. Learns, floor included, from all of the stage's own labelled
    rows that aren't held out; if there are none, every document with letters stays."""
    known = docs.filter(~language_id.held_out(F.col("doc_id"))).select("text", "lang")
    model = language_id.calibrated(known, language_id.train(known))
    return language_id.select_languages(spark, docs, model, wanted=wanted if model.languages else None)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each group of near copies (five-word shingles, similarity 0.8). Rows that repeat a
    kept id stay, as do those without an id."""
    groups = minhash_dedup.groups(spark, docs.select("doc_id", "text"))
    kept = groups.filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*docs.columns)


def benchmark_overlaps(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    return decontaminate.clean(spark, docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the text; n_chars follows."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack(spark, docs.select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", languages),
    ("near_duplicates", near_duplicates),
    ("benchmark_overlaps", benchmark_overlaps),
    ("secrets", secrets),
    ("packed", packed),
]

#: Minima, learned weights and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return docs
