"""Decoding of chain logs, and templates, prefixes and flags of questions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tape import read

FIELDS_V1 = ("maker_asset_id", "taker_asset_id", "maker_amount_filled", "taker_amount_filled", "fee")


def decode_logs(df: DataFrame, key: str = "id", data: str = "data") -> DataFrame:
    """key and five unsigned 256-bit numbers as decimal strings, from hex data with or without 0x. Data that is null,
    short or no hex gives nulls. Numbers beyond 38 digits have no Spark type, so batches are decoded in Python."""
    schema = f"{key} long, " + ", ".join(f"{f} string" for f in FIELDS_V1)

    def number(raw: str, k: int) -> str | None:
        try:
            return str(int(raw[64 * k : 64 * (k + 1)], 16)) if len(raw) >= 64 * (k + 1) else None
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(x or "").removeprefix("0x") for x in b.column(1).to_pylist()]
            columns = [pa.array([number(x, k) for x in raw], pa.string()) for k in range(len(FIELDS_V1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[key, *FIELDS_V1])

    return df.select(F.col(key).cast("long"), F.col(data).cast("string")).mapInArrow(run, schema)


def sided(df: DataFrame) -> DataFrame:
    """Logs of the second kind (side, token, amounts): side 0 sells cash for the token, so its maker asset is '0'."""
    buys = F.col("side") == 0
    return df.withColumns({"maker_asset_id": F.when(buys, "0").otherwise(F.col("token")), "taker_asset_id": F.when(buys, F.col("token")).otherwise("0")})


def log_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items written as hex logs and decoded again."""
    line = read(spark, sf_dir, "lineitem")
    word = lambda c: F.lpad(F.lower(F.hex(c.cast("long"))), 64, "0")
    data = F.concat(F.lit("0x"), word(F.col("l_partkey") * 2), word(F.lit(0)), word(F.rint(F.col("l_extendedprice") * 100)), word(F.col("l_suppkey") * 1_000_003), word(F.col("l_linenumber")))
    logs = line.select(F.col("l_orderkey").alias("id"), data.alias("data"))
    d = decode_logs(logs)
    return d.groupBy("fee").agg(F.count("*").alias("n"), F.sum(F.col("maker_asset_id").cast("long")).alias("assets"), F.sum(F.col("maker_amount_filled").cast("long")).alias("makers"), F.sum(F.col("taker_amount_filled").cast("long")).alias("takers"))


# What dates, times and numbers look like in questions.
_MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
QUESTION_RULES: tuple[tuple[str, str], ...] = (
    (rf"\b{_MONTH}\.? \d{{1,2}}(?:st|nd|rd|th)?(?:, ?20\d\d)?\b", "<DATE>"),
    (r"\b20\d\d-\d{2}-\d{2}\b", "<DATE>"),
    (rf"\b{_MONTH} 20\d\d\b", "<DATE>"),
    (r"\b\d{1,2}(?::\d{2})? ?(?i:am|pm)(?: E[SD]?T)?\b", "<TIME>"),
    (r"\b20[0-3]\d\b", "<DATE>"),
    (r"[$€£]?\b\d[\d,]*(?:\.\d+)?(?: ?(?:%|bps|[kKmMbB]\b|million|billion))?", "<NUM>"),
    (r"<NUM>(?: ?(?:-|to) ?<NUM>)+", "<NUM>"),
    (r"\s+", " "),
)


def question_template(question: Column) -> Column:
    """Dates, times and numbers of a question as placeholders; null gives ''."""
    return F.trim(reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), QUESTION_RULES, F.coalesce(question, F.lit(""))))


def ticker_prefix(ticker: Column) -> Column:
    return F.regexp_extract(ticker, r"^([A-Z0-9]+?)(?:-|$)", 1)


def question_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made from parts: templates with how many questions they stand for, and leftover digits."""
    p = read(spark, sf_dir, "part")
    q = F.concat(F.lit("Will "), F.col("p_type"), F.lit(" close above $"), F.format_number("p_retailprice", 2), F.lit(" on March "), (F.col("p_size") % 28 + 1).cast("string"), F.lit(", 2025 at "), (F.col("p_size") % 12 + 1).cast("string"), F.lit("pm ET?"))
    t = p.select(question_template(q).alias("template"))
    return t.groupBy("template").agg(F.count("*").alias("n"), F.max(F.col("template").rlike("[0-9]").cast("int")).alias("raw_digits"), F.max(F.size(F.split("template", "<")) - 1).alias("placeholders"))


def ticker_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Representative of each ticker prefix: the question most often seen, then the first."""
    p = read(spark, sf_dir, "part").select(F.concat(F.lit("KX"), F.upper(F.regexp_extract("p_type", r"^(\w+)", 1)), F.lit("-25MAR"), F.col("p_size").cast("string")).alias("ticker"), F.col("p_type").alias("question"))
    per = p.groupBy(ticker_prefix(F.col("ticker")).alias("prefix"), "question").agg(F.count("*").alias("n"), F.countDistinct("ticker").alias("tickers"))
    return per.groupBy("prefix").agg(F.min_by("question", F.struct(-F.col("n"), F.col("question"))).alias("question"), F.sum("n").alias("n"), F.count("*").alias("questions"))


QUERIES = {
    "log_decode": (
        log_decode,
        "SELECT CAST(l_linenumber AS VARCHAR) AS fee, count(*) AS n, CAST(sum(l_partkey * 2) AS BIGINT) AS assets, CAST(sum(CAST(round_even(l_extendedprice * 100, 0) AS BIGINT)) AS BIGINT) AS makers, CAST(sum(l_suppkey * 1000003) AS BIGINT) AS takers FROM lineitem GROUP BY l_linenumber",
    ),
    "question_templates": (
        question_templates,
        "SELECT 'Will ' || p_type || ' close above <NUM> on <DATE> at <TIME>?' AS template, count(*) AS n, 0 AS raw_digits, 3 AS placeholders FROM part GROUP BY p_type",
    ),
    "ticker_prefixes": (
        ticker_prefixes,
        """WITH p AS (SELECT 'KX' || upper(regexp_extract(p_type, '^(\\w+)', 1)) AS prefix, p_type AS question, count(*) AS n FROM part GROUP BY ALL)
SELECT prefix, arg_min(question, struct_pack(a := -n, b := question)) AS question, CAST(sum(n) AS BIGINT) AS n, count(*) AS questions FROM p GROUP BY prefix""",
    ),
}
