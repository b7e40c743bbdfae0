"""Readers and writers of the formats the tape comes in and goes out to, through Spark's own sources."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RAW_EVENTS = (
    "order_hash string, maker string, taker string, maker_asset_id string, taker_asset_id string, maker_amount_filled long, taker_amount_filled long, fee long, "
    "block_number int, transaction_hash string, log_index int, exchange_address string"
)


def parquet_union(spark: SparkSession, *paths: str) -> DataFrame:
    """Files of several generations as one table, columns by name; missing ones are null."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def since(df: DataFrame, column: str, least: int) -> DataFrame:
    return df.filter(F.col(column) >= least)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents that are arrays of records, plain or compressed."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_tape(df: DataFrame, path: str, sort: tuple[str, ...] = ("token_id", "ts")) -> None:
    """The tape by month, each month's files sorted; only months that df holds are replaced. Months are dealt by month
    and token, so that a large month is written by many tasks."""
    dealt = df.repartition("year_month", sort[0]).sortWithinPartitions("year_month", *sort)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year_month").parquet(path)


def checked_count(spark: SparkSession, path: str, expected: int) -> int:
    """Rows of a written table; fails if they aren't as many as expected."""
    n = spark.read.parquet(path).count()
    if n != expected:
        raise ValueError(f"{path}: {n} rows, expected {expected}")
    return n


def describe(df: DataFrame) -> DataFrame:
    """Name, type, non-null and distinct counts (approximate) of each column, in one pass."""
    out = df.agg(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.count(F.col(n)).alias("filled"), F.approx_count_distinct(F.col(n)).alias("values")).alias(f"c{k}") for k, (n, t) in enumerate(df.dtypes)])
    return out.select(F.explode(F.array(*out.columns)).alias("c")).select("c.*")


def reliable(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df as a checkpoint in the folder that the cluster names in spark.checkpoint.dir; in local runs without one, in a
    folder of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pricelens-"))
    return df.checkpoint()


class BlockRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class BlockReader(DataSourceReader):
    """Reads ranges of blocks with a fetch function; a range that is refused as too large is halved."""

    def __init__(self, fetch: Callable[[int, int], list[tuple]], first: int, last: int, step: int):
        self.fetch, self.first, self.last, self.step = fetch, first, last, step

    def partitions(self) -> list[InputPartition]:
        return [BlockRange(a, min(a + self.step - 1, self.last)) for a in range(self.first, self.last + 1, self.step)]

    def read(self, partition: BlockRange) -> Iterator[tuple]:
        todo = [(partition.first, partition.last)]
        while todo:
            a, b = todo.pop()
            try:
                yield from self.fetch(a, b)
            except OverflowError:
                if a == b:
                    raise
                middle = (a + b) // 2
                todo += [(middle + 1, b), (a, middle)]


def block_source(name: str, schema_: str, fetch: Callable[[int, int], list[tuple]]) -> type[DataSource]:
    """A data source class over blocks, for spark.dataSource.register; options first, last and step. fetch(a, b) returns
    the rows of blocks a to b and raises OverflowError where that is too much for one call."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema_

        def reader(self, schema) -> DataSourceReader:
            o = self.options
            return BlockReader(fetch, int(o["first"]), int(o["last"]), int(o.get("step", 1000)))

    return Source
