"""Clustered statistics as aggregation plans.

Three-way clustered variances follow Cameron, Gelbach and Miller: sums of squared score sums over every subset of the
cluster keys, with alternating signs. Rows are first reduced to the finest cells (group and all cluster keys) with the
algebraic sums that any score needs, so each further pass reads cells, not rows; the subsets are one expand over cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import r6, safe_div

CLUSTERS = ("day", "wallet", "market_id")


def cells(df: DataFrame, by: list[str], weight: Column, x: Column, y: Column, clusters: tuple[str, ...] = CLUSTERS) -> DataFrame:
    """Sums of 1, w, wx, wy, wxx, wxy for each group and combination of clusters."""
    w = weight.cast("double")
    sums = {"n": F.count(F.lit(1)), "sw": F.sum(w), "swx": F.sum(w * x), "swy": F.sum(w * y), "swxx": F.sum(w * x * x), "swxy": F.sum(w * x * y)}
    return df.groupBy(*by, *clusters).agg(*[v.alias(k) for k, v in sums.items()])


def plain_and_weighted(df: DataFrame, by: list[str], weight: Column, x: Column, y: Column, clusters: tuple[str, ...] = CLUSTERS) -> tuple[DataFrame, DataFrame]:
    """Cells with weight 1 and with the given weight, from one aggregation: both read the same shuffled sums."""
    w = weight.cast("double")
    both = df.groupBy(*by, *clusters).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("x1"), F.sum(y).alias("y1"), F.sum(w).alias("w2"), F.sum(w * x).alias("x2"), F.sum(w * y).alias("y2"))
    one = both.select(*by, *clusters, "n", F.col("n").cast("double").alias("sw"), F.col("x1").alias("swx"), F.col("y1").alias("swy"))
    return one, both.select(*by, *clusters, "n", F.col("w2").alias("sw"), F.col("x2").alias("swx"), F.col("y2").alias("swy"))


def clustered_mean(cell: DataFrame, by: list[str], clusters: tuple[str, ...] = CLUSTERS) -> DataFrame:
    """Weighted mean of y and its clustered error, by group."""
    total = cell.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("sw").alias("W"), F.sum("swx").alias("X"), F.sum("swy").alias("Y"))
    mean = total.withColumn("theta", safe_div(F.col("Y"), F.col("W")))
    scored = cell.join(mean.select(*by, "theta"), by).withColumn("score", F.col("swy") - F.col("theta") * F.col("sw"))
    v = grouped_cube(scored, by, "score", clusters)
    return mean.join(v, by).withColumn("se", F.sqrt(F.greatest(F.col("v"), F.lit(0.0))) / F.col("W"))


def grouped_cube(scored: DataFrame, by: list[str], score: str, clusters: tuple[str, ...] = CLUSTERS) -> DataFrame:
    """Signed sums of squares by group. One row of a cell becomes a row for each subset of the clusters (an expand over
    cells); keys left out are replaced by null together with the subset's number, so nulls in keys stay apart."""
    n = len(clusters)
    subsets = [m for m in range(1, 1 << n)]
    options = [
        F.struct(F.lit(m).alias("m"), *[(F.col(c) if m >> k & 1 else F.lit(None)).cast("string").alias(f"k{k}") for k, c in enumerate(clusters)])
        for m in subsets
    ]
    wide = scored.select(*by, score, F.explode(F.array(*options)).alias("o"))
    sums = wide.groupBy(*by, "o").agg(F.sum(score).alias("s"))
    odd = F.bit_count(F.col("o.m")) % 2 == 1
    return sums.groupBy(*by).agg(F.sum(F.when(odd, F.col("s") * F.col("s")).otherwise(-F.col("s") * F.col("s"))).alias("v"))


def clustered_slope(cell: DataFrame, by: list[str], clusters: tuple[str, ...] = CLUSTERS) -> DataFrame:
    """Weighted least-squares slope of y on x with clustered error, by group; null where x doesn't vary."""
    t = cell.groupBy(*by).agg(*[F.sum(c).alias(c.upper()) for c in ("n", "sw", "swx", "swy", "swxx", "swxy")])
    xb, yb = F.col("SWX") / F.col("SW"), F.col("SWY") / F.col("SW")
    sxx = F.col("SWXX") - F.col("SW") * xb * xb
    t = t.select(*by, F.col("N").alias("n"), xb.alias("xb"), yb.alias("yb"), sxx.alias("sxx"), (F.col("SWXY") - F.col("SW") * xb * yb).alias("sxy"))
    t = t.filter("n >= 2 AND sxx > 1e-12").withColumn("b", F.col("sxy") / F.col("sxx")).withColumn("a", F.col("yb") - F.col("b") * F.col("xb"))
    u = F.col("swxy") - F.col("a") * F.col("swx") - F.col("b") * F.col("swxx") - F.col("xb") * (F.col("swy") - F.col("a") * F.col("sw") - F.col("b") * F.col("swx"))
    scored = cell.drop("n").join(t.select(*by, "a", "b", "xb"), by).withColumn("score", u)
    v = grouped_cube(scored, by, "score", clusters)
    return t.join(v, by).withColumn("se", F.sqrt(F.greatest(F.col("v"), F.lit(0.0))) / F.col("sxx"))


def sliced_slopes(df: DataFrame, slices: Column, x: Column, y: Column, clusters: tuple[str, ...] = ("market_id", "wallet", "day")) -> DataFrame:
    """Slope of y on x with clustered error in each of the slices (an array) that a row is in, in one pass over df: clustered_slope
    with weight 1. A score is a product of a group's sums and of numbers known last, so the signed products of the sums are
    what is added up. Subsets with the first cluster need no exchange where df is dealt out by it; cells are dealt out once
    more, by the second, for those with that, and the last alone is summed before its exchange."""
    z = ["n", "x", "y", "xx", "xy"]
    cell = df.groupBy(*clusters, slices.alias("slices")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"))
    pairs = [(i, j) for i in range(5) for j in range(i, 5)]
    parts = []
    for k, key in enumerate(clusters):
        others = clusters[k + 1 :]
        if k == 1:
            cell = cell.repartition(key)
        options = [F.struct(F.lit(m).alias("m"), *[(F.col(c) if m >> i & 1 else F.lit(None)).cast("string").alias(c) for i, c in enumerate(others)]) for m in range(1 << len(others))]
        wide = cell.select(*clusters[k:], *z, F.explode("slices").alias("slice")).select(key, "slice", *z, F.explode(F.array(*options)).alias("o"))
        sums = wide.groupBy(key, "slice", "o").agg(*[F.sum(c).alias(c) for c in z])
        sign = F.when(F.bit_count(F.col("o.m")) % 2 == 0, 1.0).otherwise(-1.0)
        total = [F.sum(F.when(F.col("o.m") == 0, F.col(c))) if k == 0 else F.lit(0.0) for c in z]
        parts.append(sums.groupBy("slice").agg(*[v.alias(c) for c, v in zip(z, total, strict=True)], *[F.sum(sign * F.col(z[i]) * F.col(z[j])).alias(f"p{i}{j}") for i, j in pairs]))
    t = reduce(DataFrame.union, parts)
    t = t.groupBy("slice").agg(*[F.sum(c).alias(c) for c in t.columns[1:]])
    t = t.withColumns({"xb": F.col("x") / F.col("n"), "yb": F.col("y") / F.col("n")})
    t = t.withColumns({"sxx": F.col("xx") - F.col("n") * F.col("xb") * F.col("xb"), "sxy": F.col("xy") - F.col("n") * F.col("xb") * F.col("yb")})
    t = t.filter("n >= 2 AND sxx > 1e-12").withColumn("b", F.col("sxy") / F.col("sxx")).withColumn("a", F.col("yb") - F.col("b") * F.col("xb"))
    by = [F.col("xb") * F.col("a"), F.col("xb") * F.col("b") - F.col("a"), -F.col("xb"), -F.col("b"), F.lit(1.0)]  # a score's factors of z
    v = reduce(lambda s, p: s + p, [by[i] * by[j] * F.col(f"p{i}{j}") * (1.0 if i == j else 2.0) for i, j in pairs])
    return t.select("slice", F.col("n").cast("long").alias("n"), "b", (F.sqrt(F.greatest(v, F.lit(0.0))) / F.col("sxx")).alias("se"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in names})
