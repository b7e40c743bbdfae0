"""Dimension operators on odd rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pricelens.operators import dimensions as d
from pricelens.operators import stats


def test_average_ranks_like_pandas(spark):
    rng = np.random.default_rng(5)
    for values in (rng.integers(0, 40, 500), np.full(50, 7), np.arange(300)[::-1], np.array([3])):
        want = pd.Series(values).rank(method="average")
        got = {r["v"]: (r["rank"], r["total"]) for r in d.average_ranks(spark.createDataFrame([(int(v),) for v in values], "v long"), "v", 8).collect()}
        assert got == {int(v): (r, len(values)) for v, r in zip(values, want, strict=True)}


def test_average_ranks_of_nothing(spark):
    assert d.average_ranks(spark.createDataFrame([(None,)], "v long"), "v").count() == 0


def test_verified(spark):
    rows = [
        (1, '["1", "0"]', '["A", "B"]', True),
        (2, '["0.01", "0.99"]', '["A", "B"]', True),
        (3, '["1", "0"]', '["A", "B"]', False),
        (4, "", '["A", "B"]', True),
        (5, '["1"]', '["A"]', True),
        (6, "not json", None, True),
        (7, None, None, True),
        (8, '["0.98", "0.02"]', '["A", "B"]', True),
        (9, '["1", "0"]', '["A", "B"]', None),
    ]
    df = spark.createDataFrame(rows, "market_id long, prices string, outcomes string, closed boolean")
    assert {(r["market_id"], r["winning_outcome"]) for r in d.verified(df).collect()} == {(1, "A"), (2, "B")}


def test_eligible(spark):
    rows = [(1, "YES", 5, 100.0, 1, 2), (2, "MKT", 9, 900.0, 1, 2), (3, "NO", None, 900.0, 1, 2), (4, "NO", 9, 99.0, 1, 2), (5, "NO", 9, 900.0, 0, 2), (6, "NO", 9, 900.0, 2, 2), (7, None, 9, 900.0, 1, 2), (8, "NO", 9, 900.0, None, 2)]
    df = spark.createDataFrame(rows, "id long, resolution string, bettors int, volume double, created long, closed long")
    assert [r["id"] for r in d.eligible(df).collect()] == [1]


def test_labels(spark):
    df = spark.createDataFrame([(0.5, 1, 0.0), (1.0, 100, 60.0), (7.5, 10, 30.0), (None, 9, 90.0)], "days double, size long, span double")
    got = df.select(d.feedback_lag(F.col("days")), d.family_label(F.col("size"), F.col("span")), d.settled_before(F.col("size"))).collect()
    assert [tuple(r) for r in got] == [("<1d", "One-off", "1-10"), ("<1d", "Daily", "11-100"), ("1-4wk", "Recurring", "1-10"), (None, "Episodic", "1-10")]


def test_sliced_slopes_like_clustered_slope(spark):
    """Also where clusters are null, a slice's price doesn't vary, its returns lie on a line, or it has one row."""
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(3000):
        x, key = float(rng.integers(1, 50)) / 51, [int(rng.integers(k)) for k in (40, 30, 90)]
        kind = str(rng.choice(["a", "b", "line", "flat"]))
        rows.append((*[None if rng.random() < 0.05 else k for k in key], 0.3 if kind == "flat" else x, -2 * x + 1 if kind == "line" else float(rng.random() < x) - x, [kind, "all"]))
    rows.append((1, 1, 1, 0.5, 0.5, ["one", "all"]))
    df = spark.createDataFrame(rows, "market_id long, day int, wallet int, x double, y double, slices array<string>")
    wide = df.withColumn("slice", F.explode("slices"))
    want = stats.clustered_slope(stats.cells(wide, ["slice"], F.lit(1), F.col("x"), F.col("y")), ["slice"]).select("slice", "n", "b", "se").collect()
    got = {r["slice"]: r for r in stats.sliced_slopes(df, F.col("slices"), F.col("x") - 0.5, F.col("y")).collect()}
    assert set(got) == {r["slice"] for r in want} == {"a", "b", "line", "all"}
    for r in want:
        assert got[r["slice"]]["n"] == r["n"] and abs(got[r["slice"]]["b"] - r["b"]) < 1e-11 and abs(got[r["slice"]]["se"] - r["se"]) < 2e-7


def test_pooled_horizons_reads_the_tape_once(spark, sf):
    df = d.pooled_horizons(spark, sf)
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("FileScan" in line and "l_orderkey" in line for line in plan.splitlines()) == 1
