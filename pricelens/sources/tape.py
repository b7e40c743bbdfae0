"""The trade tape, adapted from the star-schema tables, as DataFrames and as DuckDB SQL.

wallet = customer of the order, market = part, token = market and side of the outcome, price = quantity / 51, dollars =
extended price, event = brand, category = part type, won = the traded outcome is the part's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Trades before this second are no part of the tape.
LAUNCH = 0
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def seconds(ts: str):
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades without resolution: lineitem with the wallet of its order."""
    line = read(spark, sf_dir, "lineitem")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return line.join(orders, line.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").cast("string").alias("wallet"),
        seconds("l_shipdate").alias("ts"),
        F.col("l_partkey").alias("market_id"),
        (F.col("l_partkey") * 2 + F.col("l_linenumber") % 2).cast("long").alias("token_id"),
        F.col("l_extendedprice").alias("usdc"),
        (F.col("l_quantity") / 51.0).alias("price"),
        F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"),
        F.when(F.col("l_linenumber") % 2 == 0, "Yes").otherwise("No").alias("outcome"),
        (F.col("l_returnflag") == "A").alias("is_maker"),
        F.col("l_suppkey").cast("string").alias("counterparty"),
        F.col("o_orderpriority").alias("priority"),
    )


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("market_id"),
        F.when(F.col("p_size") % 2 == 0, "Yes").otherwise("No").alias("winning_outcome"),
        F.col("p_brand").alias("event"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("question"),
    )


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved trades with won and ret."""
    won = (F.col("outcome") == F.col("winning_outcome")).cast("int")
    return fills(spark, sf_dir).join(markets(spark, sf_dir), "market_id").withColumn("won", won).withColumn("ret", F.col("won") - F.col("price"))


def buys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BUY trades, priced between 0 and 1."""
    return tape(spark, sf_dir).filter("side = 'BUY' AND price >= 0 AND price <= 1")


FILLS_SQL = """fills AS (
  SELECT CAST(o.o_custkey AS VARCHAR) AS wallet, CAST(epoch(l.l_shipdate) AS BIGINT) AS ts, l.l_partkey AS market_id,
    CAST(l.l_partkey * 2 + l.l_linenumber % 2 AS BIGINT) AS token_id, l.l_extendedprice AS usdc, l.l_quantity / 51.0 AS price,
    CASE WHEN l.l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN l.l_linenumber % 2 = 0 THEN 'Yes' ELSE 'No' END AS outcome,
    l.l_returnflag = 'A' AS is_maker, CAST(l.l_suppkey AS VARCHAR) AS counterparty, o.o_orderpriority AS priority
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""
MARKETS_SQL = """markets AS (
  SELECT p_partkey AS market_id, CASE WHEN p_size % 2 = 0 THEN 'Yes' ELSE 'No' END AS winning_outcome, p_brand AS event,
    p_type AS category, p_name AS question FROM part)"""
TAPE_SQL = f"""{FILLS_SQL}, {MARKETS_SQL}, tape AS (
  SELECT f.*, m.winning_outcome, m.event, m.category, m.question, CAST(outcome = winning_outcome AS INT) AS won,
    CAST(outcome = winning_outcome AS INT) - price AS ret FROM fills f JOIN markets m USING (market_id)),
buys AS (SELECT * FROM tape WHERE side = 'BUY' AND price >= 0 AND price <= 1)"""
