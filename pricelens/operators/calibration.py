"""Binned price calibration: trade level, contract level, tiers, snap prices and sliced deciles with clustered errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import decile, ladder, lifecycle, price_bin, r6, safe_div, stars
from ..sources.tape import TAPE_SQL, buys, tape
from . import stats

DAY = 86400
#: Share of a token's life that counts as mature, and fewest trades of a slice.
MATURE, SLICE_FLOOR, DECILE_FLOOR = (0.25, 0.80), 200, 50
VOLUME_CUTS = ((200_000.0, "low"), (700_000.0, "mid"))
WALLET_CUTS = ((500_000.0, "small"), (1_500_000.0, "medium"))
CATEGORIES = (("metal", ("brass", "copper", "nickel", "steel", "tin")), ("coated", ("anodized", "plated", "polished", "burnished", "brushed")))


def bin_stats(df: DataFrame, *by: str, n: int = 20) -> DataFrame:
    """count, mean_implied_prob, empirical_win_rate and mean_return of each price bin."""
    return (
        df.withColumn("bin_idx", price_bin(F.col("price"), n))
        .groupBy(*by, "bin_idx")
        .agg(F.count("*").alias("n"), r6(F.avg("price")).alias("mean_implied_prob"), r6(F.avg("won")).alias("empirical_win_rate"), r6(F.avg("ret")).alias("mean_return"))
    )


_STATS = "count(*) AS n, round(avg(price), 6) AS mean_implied_prob, round(avg(won), 6) AS empirical_win_rate, round(avg(ret), 6) AS mean_return"
_BIN = "CAST(floor(price * 20) AS INT)"


def _bin_sql(source: str, *by: str) -> str:
    keys = "".join(f"{b}, " for b in by)
    return f"SELECT {keys}{_BIN} AS bin_idx, {_STATS} FROM {source} GROUP BY ALL"


def flb_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_stats(buys(spark, sf_dir))


def _tail(df: DataFrame, edge: float, per: int) -> DataFrame:
    side = F.when(F.col("price") < edge, "low").when(F.col("price") > 1 - edge, "high")
    fine = F.floor(F.col("price") * per).cast("int")
    return (
        df.withColumn("tail", side)
        .filter("tail IS NOT NULL")
        .withColumn("bin_idx", fine)
        .groupBy("tail", "bin_idx")
        .agg(F.count("*").alias("n"), r6(F.avg("price")).alias("mean_implied_prob"), r6(F.avg("won")).alias("empirical_win_rate"), r6(F.avg("ret")).alias("mean_return"))
        .withColumn("centre", r6((F.col("bin_idx") + 0.5) / per))
    )


def _tail_sql(source: str, edge: float, per: int) -> str:
    return f"""SELECT *, round((bin_idx + 0.5) / {per}, 6) AS centre FROM (
  SELECT CASE WHEN price < {edge} THEN 'low' ELSE 'high' END AS tail, CAST(floor(price * {per}) AS INT) AS bin_idx, {_STATS}
  FROM {source} WHERE price < {edge} OR price > 1 - {edge}::DOUBLE GROUP BY ALL)"""


def flb_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tail(buys(spark, sf_dir), 0.10, 100)


def flb_basic_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall and by-category bins from one scan, as grouping sets."""
    df = buys(spark, sf_dir).withColumn("bin_idx", price_bin(F.col("price")))
    own = df.groupingSets([["bin_idx"], ["category", "bin_idx"]], "category", "bin_idx")
    return own.agg(
        F.grouping("category").cast("int").alias("overall"), F.count("*").alias("n"), r6(F.avg("price")).alias("mean_implied_prob"), r6(F.avg("won")).alias("empirical_win_rate"), r6(F.avg("ret")).alias("mean_return")
    )


def contracts(df: DataFrame) -> DataFrame:
    """A row for each token: volume-weighted price, volume, trades, won, ret."""
    per = df.groupBy("token_id", "market_id", "event", "category").agg(
        safe_div(F.sum(F.col("price") * F.col("usdc")), F.sum("usdc")).alias("price"), F.sum("usdc").alias("volume"), F.count("*").alias("trades"), F.max("won").alias("won")
    )
    return per.withColumn("ret", F.col("won") - F.col("price"))


CONTRACTS_SQL = """contracts AS (
  SELECT *, won - price AS ret FROM (
    SELECT token_id, market_id, event, category, sum(price * usdc) / nullif(sum(usdc), 0) AS price, sum(usdc) AS volume, count(*) AS trades, max(won) AS won
    FROM buys GROUP BY ALL))"""


def _tier(value: Column, cuts: tuple[tuple[float, str], ...] = VOLUME_CUTS, last: str = "high") -> Column:
    return ladder(value, list(cuts), last)


def _tier_sql(value: str, cuts: tuple[tuple[float, str], ...] = VOLUME_CUTS, last: str = "high") -> str:
    return "CASE " + " ".join(f"WHEN {value} < {c} THEN '{label}'" for c, label in cuts) + f" ELSE '{last}' END"


def flb_volume_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades by their contract's volume; the volume is a window over the token, as the tape is dealt by it anyway."""
    df = buys(spark, sf_dir).withColumn("volume", F.sum("usdc").over(Window.partitionBy("token_id")))
    return bin_stats(df.withColumn("tier", _tier(F.col("volume"))), "tier")


OUTCOME_CUTS = ((81.0, "few"), (161.0, "some"))


def _with_outcomes(df: DataFrame) -> DataFrame:
    per = df.groupBy("event").agg(F.countDistinct("token_id").alias("outcomes"))
    return df.join(per, "event").withColumn("tier", _tier(F.col("outcomes"), OUTCOME_CUTS, "many"))


def flb_outcome_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_stats(_with_outcomes(buys(spark, sf_dir)), "tier")


def flb_contract_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_stats(contracts(buys(spark, sf_dir)))


def flb_contract_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tail(contracts(buys(spark, sf_dir)), 0.45, 50)


def flb_contract_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_stats(contracts(buys(spark, sf_dir)), "category", n=10)


def flb_contract_volume_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = contracts(buys(spark, sf_dir)).withColumn("tier", _tier(F.col("volume")))
    size = df.groupBy("tier").agg(r6(F.avg("volume")).alias("tier_mean"), r6(F.percentile("volume", F.lit(0.5))).alias("tier_median"))
    return bin_stats(df, "tier").join(size, "tier")


def flb_contract_outcome_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_stats(_with_outcomes(contracts(buys(spark, sf_dir))), "tier")


SNAPS = (0.5, 0.7, 0.8, 0.9)
SNAP_WINDOW, SNAP_TRADES = 90 * DAY, 10


def snap_trades(df: DataFrame) -> DataFrame:
    """Trades in (snap - window, snap] of their token, for each share of its life; one pass, no join: a trade is
    repeated for the snaps it belongs to."""
    w = Window.partitionBy("token_id")
    df = df.withColumns({"t0": F.min("ts").over(w), "t1": F.max("ts").over(w), "k": F.count("*").over(w)}).filter((F.col("t1") - F.col("t0") >= DAY) & (F.col("k") >= SNAP_TRADES))
    df = df.withColumn("snap", F.explode(F.array(*[F.lit(s) for s in SNAPS])))
    at = F.col("t0") + F.rint(F.col("snap") * (F.col("t1") - F.col("t0"))).cast("long")
    return df.filter((F.col("ts") > at - SNAP_WINDOW) & (F.col("ts") <= at))


def flb_snap_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = snap_trades(buys(spark, sf_dir)).groupBy("snap", "token_id").agg(safe_div(F.sum(F.col("price") * F.col("usdc")), F.sum("usdc")).alias("price"), F.max("won").alias("won"))
    kept = per.filter("price >= 0.05 AND price <= 0.95").withColumn("ret", F.col("won") - F.col("price"))
    return bin_stats(kept, "snap", n=10)


def snap_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token, life, trades and the second of each snap."""
    per = tape(spark, sf_dir).groupBy("token_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("n_trades"), r6(F.sum("usdc")).alias("total_volume"))
    per = per.filter("n_trades >= 10 AND end_ts - first_ts >= 86400")
    wide = per.withColumn("snap", F.explode(F.array(*[F.lit(s) for s in SNAPS])))
    return wide.withColumn("snap_ts", F.col("first_ts") + F.rint(F.col("snap") * (F.col("end_ts") - F.col("first_ts"))).cast("long"))


def keyword_category(text: Column) -> Column:
    """The first category one of whose words is in the text, else other."""
    out = F.lit("other")
    for name, words in reversed(CATEGORIES):
        out = F.when(F.lower(text).rlike("|".join(words)), name).otherwise(out)
    return out


_KEYWORD_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(category), '{'|'.join(words)}') THEN '{name}'" for name, words in CATEGORIES) + " ELSE 'other' END"


def flb_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_stats(buys(spark, sf_dir).withColumn("topic", keyword_category(F.col("category"))), "topic")


def _with_wallet_tier(df: DataFrame, all_trades: DataFrame) -> DataFrame:
    per = all_trades.groupBy("wallet").agg(F.sum("usdc").alias("lifetime"))
    return df.join(per, "wallet").withColumn("tier", _tier(F.col("lifetime"), WALLET_CUTS, "large"))


_WALLET_TIER_SQL = f"wt AS (SELECT wallet, {_tier_sql('sum(usdc)', WALLET_CUTS, 'large')} AS tier FROM tape GROUP BY wallet)"


def flb_trader_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tape(spark, sf_dir)
    return bin_stats(_with_wallet_tier(t.filter("side = 'BUY' AND price >= 0 AND price <= 1"), t), "tier")


def flb_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of each wallet tier in the trades and dollars of a bin, prices from .05 to .95."""
    t = tape(spark, sf_dir)
    df = _with_wallet_tier(t.filter("side = 'BUY' AND price >= 0.05 AND price <= 0.95"), t).withColumn("bin_idx", price_bin(F.col("price")))
    per = df.groupBy("bin_idx", "tier").agg(F.count("*").alias("n"), F.sum("usdc").alias("volume"))
    w = Window.partitionBy("bin_idx")
    return per.select("bin_idx", "tier", "n", r6(F.col("n") / F.sum("n").over(w)).alias("pct_trades"), r6(F.col("volume") / F.sum("volume").over(w)).alias("pct_volume"))


# ---- sliced deciles ----


def filtered(spark: SparkSession, sf_dir: str, window: tuple[float, float] = MATURE, token: tuple[str, ...] = ("token_id",)) -> DataFrame:
    """Standard filters: BUY, life before the price filter, 0.01 < price < 0.99, place in the window. token: columns that name
    a token; with its market first, rows that are dealt out by market stay where they are."""
    df = tape(spark, sf_dir).filter("side = 'BUY'").withColumn("pos", lifecycle(*token))
    df = df.filter((F.col("price") > 0.01) & (F.col("price") < 0.99) & F.col("pos").between(*window))
    return df.withColumns({"decile": decile(F.col("price")), "day": F.floor(F.col("ts") / DAY).cast("int")})


FILTERED_SQL = f"""{TAPE_SQL}, lived AS (
  SELECT *, (ts - min(ts) OVER t) / greatest(max(ts) OVER t - min(ts) OVER t, 1) AS pos FROM tape WHERE side = 'BUY' WINDOW t AS (PARTITION BY token_id)),
filtered AS (SELECT *, CAST(least(floor(price * 10), 9) + 1 AS INT) AS decile, CAST(floor(ts / 86400.0) AS INT) AS day FROM lived
  WHERE price > 0.01 AND price < 0.99 AND pos BETWEEN {MATURE[0]} AND {MATURE[1]})"""


def big_slices(df: DataFrame, by: str, floor: int) -> DataFrame:
    return df.join(df.groupBy(by).agg(F.count("*").alias("slice_n")).filter(F.col("slice_n") >= floor).drop("slice_n"), by, "left_semi")


def flb_per_slice(spark: SparkSession, sf_dir: str, slice_floor: int = SLICE_FLOOR, decile_floor: int = DECILE_FLOOR) -> DataFrame:
    """Deciles by event: counts, means, count- and dollar-weighted returns with three-way clustered errors."""
    df = big_slices(filtered(spark, sf_dir), "event", slice_floor)
    by = ["event", "decile"]
    cell, dollar = stats.plain_and_weighted(df, by, F.col("usdc"), F.col("price"), F.col("ret"))
    a = stats.clustered_mean(cell, by).select(*by, "n", (F.col("X") / F.col("W")).alias("mean_price"), F.col("theta").alias("mean_ret"), F.col("se").alias("se_ret"))
    b = stats.clustered_mean(dollar, by).select(*by, F.col("W").alias("usd"), F.col("theta").alias("mean_ret_usd"), F.col("se").alias("se_ret_usd"))
    return _floored(a.join(b, by), decile_floor, "mean_price", "mean_ret", "se_ret", "mean_ret_usd", "se_ret_usd").withColumn("usd", F.round("usd", 2))


def _floored(df: DataFrame, floor: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.when(F.col("n") >= floor, r6(F.col(c))) for c in names})


def _cube_sql(name: str, cells: str, by: str, score: str) -> str:
    """Signed sums of squares over every subset of day, wallet and market."""
    keys = ["day", "wallet", "market_id"]
    parts = []
    for m in range(1, 8):
        own = [k for j, k in enumerate(keys) if m >> j & 1]
        sign = "" if len(own) % 2 else "-"
        parts.append(f"SELECT {by}, {sign}s * s AS q FROM (SELECT {by}, {', '.join(own)}, sum({score}) AS s FROM {cells} GROUP BY ALL)")
    return f"{name} AS (SELECT {by}, sum(q) AS v FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL)"


def _mean_sql(prefix: str, by: str, weight: str, source: str) -> str:
    on = ", ".join(x.strip() for x in by.split(","))
    return f"""{prefix}c AS (SELECT {by}, day, wallet, market_id, count(*) AS n, sum({weight}) AS sw, sum({weight} * price) AS swx, sum({weight} * ret) AS swy FROM {source} GROUP BY ALL),
{prefix}m AS (SELECT {by}, sum(n) AS n, sum(sw) AS W, sum(swx) AS X, sum(swy) / nullif(sum(sw), 0) AS theta FROM {prefix}c GROUP BY ALL),
{prefix}s AS (SELECT c.*, c.swy - m.theta * c.sw AS score FROM {prefix}c c JOIN {prefix}m m USING ({on})),
{_cube_sql(prefix + "v", prefix + "s", by, "score")},
{prefix}r AS (SELECT {by}, n, W, X / W AS mean_price, theta, sqrt(greatest(v, 0)) / W AS se FROM {prefix}m JOIN {prefix}v USING ({on}))"""


_BIG = f"big AS (SELECT f.* FROM filtered f WHERE event IN (SELECT event FROM filtered GROUP BY event HAVING count(*) >= {SLICE_FLOOR}))"
FLB_PER_SLICE_SQL = f"""WITH {FILTERED_SQL}, {_BIG},
{_mean_sql("x", "event, decile", "1.0::DOUBLE", "big")},
{_mean_sql("y", "event, decile", "usdc", "big")}
SELECT event, decile, CAST(xr.n AS BIGINT) AS n, round(yr.W, 2) AS usd,
  CASE WHEN xr.n >= {DECILE_FLOOR} THEN round(xr.mean_price, 6) END AS mean_price, CASE WHEN xr.n >= {DECILE_FLOOR} THEN round(xr.theta, 6) END AS mean_ret,
  CASE WHEN xr.n >= {DECILE_FLOOR} THEN round(xr.se, 6) END AS se_ret, CASE WHEN xr.n >= {DECILE_FLOOR} THEN round(yr.theta, 6) END AS mean_ret_usd,
  CASE WHEN xr.n >= {DECILE_FLOOR} THEN round(yr.se, 6) END AS se_ret_usd
FROM xr JOIN yr USING (event, decile)"""


def flb_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deciles of all trades: mean return, clustered error, t, interval and marks."""
    cell = stats.cells(filtered(spark, sf_dir, (0.0, 1.0)), ["decile"], F.lit(1), F.col("price"), F.col("ret"))
    m = stats.clustered_mean(cell, ["decile"])
    t = safe_div(F.col("theta"), F.col("se"))
    return m.select(
        "decile", "n", r6(F.col("X") / F.col("W")).alias("mean_price"), r6(F.col("theta")).alias("mean_ret"), r6(F.col("se")).alias("se"), F.round(t, 4).alias("t"),
        r6(F.col("theta") - 1.96 * F.col("se")).alias("lo"), r6(F.col("theta") + 1.96 * F.col("se")).alias("hi"), stars(t).alias("marks"),
    )


FLB_CANONICAL_SQL = f"""WITH {FILTERED_SQL.replace(f"BETWEEN {MATURE[0]} AND {MATURE[1]}", "BETWEEN 0.0 AND 1.0")}, {_mean_sql("x", "decile", "1.0::DOUBLE", "filtered")}
SELECT decile, CAST(n AS BIGINT) AS n, round(mean_price, 6) AS mean_price, round(theta, 6) AS mean_ret, round(se, 6) AS se, round(theta / nullif(se, 0), 4) AS t,
  round(theta - 1.96::DOUBLE * se, 6) AS lo, round(theta + 1.96::DOUBLE * se, 6) AS hi,
  CASE WHEN abs(theta / nullif(se, 0)) >= 3.29 THEN '***' WHEN abs(theta / nullif(se, 0)) >= 2.58 THEN '**' WHEN abs(theta / nullif(se, 0)) >= 1.96 THEN '*' ELSE '' END AS marks FROM xr"""


def flb_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top minus bottom decile by event, and the error of the difference."""
    df = big_slices(filtered(spark, sf_dir), "event", SLICE_FLOOR)
    m = stats.clustered_mean(stats.cells(df, ["event", "decile"], F.lit(1), F.col("price"), F.col("ret")), ["event", "decile"])
    pick = lambda c, d: F.max(F.when(F.col("decile") == d, F.col(c)))
    out = m.groupBy("event").agg(pick("theta", 1).alias("r1"), pick("theta", 10).alias("r10"), pick("se", 1).alias("s1"), pick("se", 10).alias("s10"))
    return out.select("event", r6(F.col("r10") - F.col("r1")).alias("spread"), r6(F.sqrt(F.col("s1") * F.col("s1") + F.col("s10") * F.col("s10"))).alias("se"))


FLB_SPREAD_SQL = f"""WITH {FILTERED_SQL}, {_BIG}, {_mean_sql("x", "event, decile", "1.0::DOUBLE", "big")}
SELECT event, round(max(theta) FILTER (decile = 10) - max(theta) FILTER (decile = 1), 6) AS spread,
  round(sqrt(pow(max(se) FILTER (decile = 1), 2) + pow(max(se) FILTER (decile = 10), 2)), 6) AS se FROM xr GROUP BY event"""


def flb_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of return on price by category, with clustered error; b_won = slope + 1."""
    df = filtered(spark, sf_dir)
    s = stats.clustered_slope(stats.cells(df, ["event"], F.lit(1), F.col("price"), F.col("ret")), ["event"])
    return s.select("event", "n", r6(F.col("b")).alias("b_ret"), r6(F.col("b") + 1).alias("b_won"), r6(F.col("se")).alias("se"))


FLB_SLOPE_SQL = f"""WITH {FILTERED_SQL},
c AS (SELECT event, day, wallet, market_id, count(*) AS n, sum(1.0::DOUBLE) AS sw, sum(price) AS swx, sum(ret) AS swy, sum(price * price) AS swxx, sum(price * ret) AS swxy FROM filtered GROUP BY ALL),
t AS (SELECT event, sum(n) AS n, sum(swx) / sum(sw) AS xb, sum(swy) / sum(sw) AS yb, sum(swxx) - sum(sw) * pow(sum(swx) / sum(sw), 2) AS sxx,
  sum(swxy) - sum(swx) * sum(swy) / sum(sw) AS sxy FROM c GROUP BY event),
u AS (SELECT *, sxy / sxx AS b, yb - sxy / sxx * xb AS a FROM t WHERE n >= 2 AND sxx > 1e-12),
s AS (SELECT c.*, c.swxy - a * c.swx - b * c.swxx - xb * (c.swy - a * c.sw - b * c.swx) AS score FROM c JOIN u USING (event)),
{_cube_sql("v", "s", "event", "score")}
SELECT event, CAST(n AS BIGINT) AS n, round(b, 6) AS b_ret, round(b + 1, 6) AS b_won, round(sqrt(greatest(v, 0)) / sxx, 6) AS se FROM u JOIN v USING (event)"""


def dropped_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices under the floor, with their size."""
    return filtered(spark, sf_dir).groupBy("market_id").agg(F.count("*").alias("n")).filter(F.col("n") < SLICE_FLOOR)


def cluster_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By decile: plain error, clustered by market, design effect, effective size, within-cluster correlation."""
    df = filtered(spark, sf_dir)
    base = df.groupBy("decile").agg(F.count("*").alias("n"), F.avg("ret").alias("mu"), F.var_pop("ret").alias("var"))
    per = df.groupBy("decile", "market_id").agg(F.sum("ret").alias("s"), F.count("*").alias("m"))
    v = per.join(base, "decile").groupBy("decile").agg(F.sum(F.pow(F.col("s") - F.col("mu") * F.col("m"), 2)).alias("vc"), (F.sum(F.col("m") * F.col("m")) / F.sum("m")).alias("mbar"), F.count("*").alias("clusters"))
    j = base.join(v, "decile")
    deff = F.col("vc") / (F.col("n") * F.col("var"))
    icc = F.greatest(F.lit(0.0), safe_div(deff - 1, F.col("mbar") - 1))
    return j.select(
        "decile", "n", "clusters", r6(F.sqrt(F.col("var") / F.col("n"))).alias("se_iid"), r6(F.sqrt("vc") / F.col("n")).alias("se_market"), r6(deff).alias("deff"), F.round(F.col("n") / deff, 3).alias("n_eff"), r6(icc).alias("icc"),
    )


CLUSTER_DIAGNOSTICS_SQL = f"""WITH {FILTERED_SQL},
b AS (SELECT decile, count(*) AS n, avg(ret) AS mu, var_pop(ret) AS var FROM filtered GROUP BY decile),
p AS (SELECT decile, market_id, sum(ret) AS s, count(*) AS m FROM filtered GROUP BY ALL),
v AS (SELECT decile, sum(pow(s - mu * m, 2)) AS vc, sum(m * m) / sum(m) AS mbar, count(*) AS clusters FROM p JOIN b USING (decile) GROUP BY decile),
j AS (SELECT *, vc / (n * var) AS deff FROM b JOIN v USING (decile))
SELECT decile, n, clusters, round(sqrt(var / n), 6) AS se_iid, round(sqrt(vc) / n, 6) AS se_market, round(deff, 6) AS deff, round(n / deff, 3) AS n_eff,
  round(greatest(0.0::DOUBLE, (deff - 1) / nullif(mbar - 1, 0)), 6) AS icc FROM j"""


def lifecycle_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean return by fifth of life and decile, pivoted."""
    df = filtered(spark, sf_dir, (0.0, 1.0)).withColumn("fifth", F.least(F.floor(F.col("pos") * 5), F.lit(4)).cast("int"))
    return df.groupBy("decile").pivot("fifth", [0, 1, 2, 3, 4]).agg(r6(F.avg("ret"))).withColumnsRenamed({str(k): f"life{k}" for k in range(5)})


def lifecycle_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What filters of extreme prices late in life keep, for six thresholds in one scan."""
    df = filtered(spark, sf_dir, (0.0, 1.0))
    wide = df.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.90, 0.93, 0.95, 0.97, 0.98, 0.99)])))
    late = ((F.col("price") >= 0.9) | (F.col("price") <= 0.1)) & (F.col("pos") >= F.col("threshold"))
    return wide.filter(~late).groupBy("threshold", "decile").agg(F.count("*").alias("n"), F.countDistinct("token_id").alias("tokens"), r6(F.avg("ret")).alias("mean_ret"), r6(safe_div(F.sum(F.col("usdc") * F.col("ret")), F.sum("usdc"))).alias("mean_ret_usd"))


_FULL_SQL = FILTERED_SQL.replace(f"BETWEEN {MATURE[0]} AND {MATURE[1]}", "BETWEEN 0.0 AND 1.0")

QUERIES = {
    "flb_per_slice": (flb_per_slice, FLB_PER_SLICE_SQL),
    "flb_canonical": (flb_canonical, FLB_CANONICAL_SQL),
    "flb_spread": (flb_spread, FLB_SPREAD_SQL),
    "flb_slope": (flb_slope, FLB_SLOPE_SQL),
    "dropped_slices": (dropped_slices, f"WITH {FILTERED_SQL} SELECT market_id, count(*) AS n FROM filtered GROUP BY market_id HAVING count(*) < {SLICE_FLOOR}"),
    "cluster_diagnostics": (cluster_diagnostics, CLUSTER_DIAGNOSTICS_SQL),
    "flb_bins": (flb_bins, f"WITH {TAPE_SQL} {_bin_sql('buys')}"),
    "flb_tails": (flb_tails, f"WITH {TAPE_SQL} {_tail_sql('buys', 0.10, 100)}"),
    "flb_basic_batch": (
        flb_basic_batch,
        f"WITH {TAPE_SQL}, b AS (SELECT *, {_BIN} AS bin_idx FROM buys) SELECT category, bin_idx, CAST(grouping(category) AS INT) AS overall, {_STATS} FROM b GROUP BY GROUPING SETS ((bin_idx), (category, bin_idx))",
    ),
    "flb_volume_tier": (flb_volume_tier, f"WITH {TAPE_SQL}, v AS (SELECT token_id, {_tier_sql('sum(usdc)')} AS tier FROM buys GROUP BY token_id) {_bin_sql('buys JOIN v USING (token_id)', 'tier')}"),
    "flb_outcome_count": (flb_outcome_count, f"WITH {TAPE_SQL}, o AS (SELECT event, {_tier_sql('count(DISTINCT token_id)', OUTCOME_CUTS, 'many')} AS tier FROM buys GROUP BY event) {_bin_sql('buys JOIN o USING (event)', 'tier')}"),
    "flb_contract_bins": (flb_contract_bins, f"WITH {TAPE_SQL}, {CONTRACTS_SQL} {_bin_sql('contracts')}"),
    "flb_contract_tails": (flb_contract_tails, f"WITH {TAPE_SQL}, {CONTRACTS_SQL} {_tail_sql('contracts', 0.45, 50)}"),
    "flb_contract_category": (flb_contract_category, f"WITH {TAPE_SQL}, {CONTRACTS_SQL} {_bin_sql('contracts', 'category').replace('* 20', '* 10')}"),
    "flb_contract_volume_tier": (
        flb_contract_volume_tier,
        f"WITH {TAPE_SQL}, {CONTRACTS_SQL}, c AS (SELECT *, {_tier_sql('volume')} AS tier FROM contracts), m AS (SELECT tier, round(avg(volume), 6) AS tier_mean, round(quantile_cont(volume, 0.5), 6) AS tier_median FROM c GROUP BY tier), b AS ({_bin_sql('c', 'tier')}) SELECT * FROM b JOIN m USING (tier)",
    ),
    "flb_contract_outcome_count": (
        flb_contract_outcome_count,
        f"WITH {TAPE_SQL}, {CONTRACTS_SQL}, o AS (SELECT event, {_tier_sql('count(DISTINCT token_id)', OUTCOME_CUTS, 'many')} AS tier FROM contracts GROUP BY event) {_bin_sql('contracts JOIN o USING (event)', 'tier')}",
    ),
    "flb_snap_price": (
        flb_snap_price,
        f"""WITH {TAPE_SQL}, w AS (SELECT token_id, min(ts) AS t0, max(ts) AS t1 FROM buys GROUP BY token_id HAVING count(*) >= {SNAP_TRADES} AND max(ts) - min(ts) >= {DAY}),
s AS (SELECT token_id, snap, t0 + CAST(snap * (t1 - t0) AS BIGINT) AS at FROM w CROSS JOIN (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) v(snap)),
p AS (SELECT snap, b.token_id, sum(price * usdc) / nullif(sum(usdc), 0) AS price, max(won) AS won FROM buys b JOIN s ON b.token_id = s.token_id AND b.ts > s.at - {SNAP_WINDOW} AND b.ts <= s.at GROUP BY ALL),
k AS (SELECT *, won - price AS ret FROM p WHERE price >= 0.05 AND price <= 0.95) {_bin_sql("k", "snap").replace("* 20", "* 10")}""",
    ),
    "snap_table": (
        snap_table,
        f"""WITH {TAPE_SQL}, w AS (SELECT token_id, min(ts) AS first_ts, max(ts) AS end_ts, count(*) AS n_trades, round(sum(usdc), 6) AS total_volume FROM tape GROUP BY token_id HAVING count(*) >= 10 AND max(ts) - min(ts) >= 86400)
SELECT w.*, snap, first_ts + CAST(snap * (end_ts - first_ts) AS BIGINT) AS snap_ts FROM w CROSS JOIN (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) v(snap)""",
    ),
    "flb_category": (flb_category, f"WITH {TAPE_SQL}, b AS (SELECT *, {_KEYWORD_SQL} AS topic FROM buys) {_bin_sql('b', 'topic')}"),
    "flb_trader_tier": (flb_trader_tier, f"WITH {TAPE_SQL}, {_WALLET_TIER_SQL} {_bin_sql('buys JOIN wt USING (wallet)', 'tier')}"),
    "flb_attribution": (
        flb_attribution,
        f"""WITH {TAPE_SQL}, {_WALLET_TIER_SQL}, g AS (SELECT {_BIN} AS bin_idx, tier, count(*) AS n, sum(usdc) AS volume FROM buys JOIN wt USING (wallet) WHERE price >= 0.05 AND price <= 0.95 GROUP BY ALL)
SELECT bin_idx, tier, n, round(n / sum(n) OVER w, 6) AS pct_trades, round(volume / sum(volume) OVER w, 6) AS pct_volume FROM g WINDOW w AS (PARTITION BY bin_idx)""",
    ),
    "lifecycle_grid": (
        lifecycle_grid,
        f"WITH {_FULL_SQL}, g AS (SELECT *, CAST(least(floor(pos * 5), 4) AS INT) AS fifth FROM filtered) SELECT decile, " + ", ".join(f"round(avg(ret) FILTER (fifth = {k}), 6) AS life{k}" for k in range(5)) + " FROM g GROUP BY decile",
    ),
    "lifecycle_sweep": (
        lifecycle_sweep,
        f"""WITH {_FULL_SQL}, x AS (SELECT * FROM filtered CROSS JOIN (VALUES (0.90::DOUBLE), (0.93::DOUBLE), (0.95::DOUBLE), (0.97::DOUBLE), (0.98::DOUBLE), (0.99::DOUBLE)) v(threshold))
SELECT threshold, decile, count(*) AS n, count(DISTINCT token_id) AS tokens, round(avg(ret), 6) AS mean_ret, round(sum(usdc * ret) / nullif(sum(usdc), 0), 6) AS mean_ret_usd
FROM x WHERE NOT ((price >= 0.9 OR price <= 0.1) AND pos >= threshold) GROUP BY ALL""",
    ),
}
