"""The decile table of a stream of trades: watermarked windows, and repeats of an id dropped within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import decile

SCHEMA = "trade_id long, ts timestamp, price double, won int, usdc double"


def windowed_deciles(trades: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """n, sums of price, won and dollars by window and decile; trades later than `late` are left out, repeats count once."""
    own = trades.withWatermark("ts", late).dropDuplicatesWithinWatermark(["trade_id"])
    by = own.groupBy(F.window("ts", window).alias("w"), decile(F.col("price")).alias("decile"))
    sums = by.agg(F.count("*").alias("n"), F.sum("price").alias("price"), F.sum("won").alias("won"), F.sum("usdc").alias("usdc"))
    return sums.select(F.col("w.start").alias("start"), "decile", "n", "price", "won", "usdc")


def run_available(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    """Takes the files of the folder that are new since the last run, and appends closed windows to a table; the
    checkpoint folder holds what has been read (the high-water mark)."""
    trades = spark.readStream.schema(SCHEMA).parquet(folder)
    q = windowed_deciles(trades).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
