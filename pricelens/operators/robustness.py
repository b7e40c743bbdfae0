"""Robustness of the calibration: humans and flagged wallets, weighted slopes and spreads, other clusterings, dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import decile, r6, safe_div
from ..sources.tape import TAPE_SQL, buys, tape
from . import stats
from .calibration import _BIG, FILTERED_SQL, SLICE_FLOOR, _cube_sql, _mean_sql, big_slices, filtered
from .traders import LIMITS, STREAM_SQL, _flags_sql, flags, stream
from .vectors import _SIMS_SQL, hubness

DECILE_SQL = "CAST(least(floor(price * 10), 9) + 1 AS INT)"


def unique(df: DataFrame, *keys: str) -> DataFrame:
    """df; its evaluation fails if two rows share the keys, as a one-to-one merge must."""
    error = F.raise_error(F.lit("repeated key in " + ", ".join(keys))).cast("boolean")
    counted = df.withColumn("rows of key", F.count("*").over(Window.partitionBy(*keys)))
    return counted.filter(F.when(F.col("rows of key") == 1, F.lit(True)).otherwise(error)).drop("rows of key")


def flb_bots_humans(spark: SparkSession, sf_dir: str, limits: dict | None = None) -> DataFrame:
    """Deciles of all buys and of those by wallets that aren't flagged (also wallets without a stream): mean return, return
    per dollar."""
    flagged = unique(flags(stream(spark, sf_dir), limits or LIMITS).select("wallet", "is_nonhuman"), "wallet")
    t = buys(spark, sf_dir).join(flagged, "wallet", "left").withColumn("decile", decile(F.col("price")))
    own = F.when(F.coalesce("is_nonhuman", F.lit(False)), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("human")))
    return (
        t.withColumn("sample", F.explode(own))
        .groupBy("sample", "decile")
        .agg(F.count("*").alias("n"), r6(F.avg("ret")).alias("mean_ret"), r6(safe_div(F.sum(F.col("usdc") * F.col("ret")), F.sum("usdc"))).alias("ret_per_dollar"))
    )


def flb_spread_usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top minus bottom decile by event, weighted by dollars, and the error of the difference."""
    df = big_slices(filtered(spark, sf_dir), "event", SLICE_FLOOR)
    m = stats.clustered_mean(stats.cells(df, ["event", "decile"], F.col("usdc"), F.col("price"), F.col("ret")), ["event", "decile"])
    pick = lambda c, d: F.max(F.when(F.col("decile") == d, F.col(c)))
    out = m.groupBy("event").agg(pick("theta", 1).alias("r1"), pick("theta", 10).alias("r10"), pick("se", 1).alias("s1"), pick("se", 10).alias("s10"))
    return out.select("event", r6(F.col("r10") - F.col("r1")).alias("spread"), r6(F.sqrt(F.col("s1") * F.col("s1") + F.col("s10") * F.col("s10"))).alias("se"))


def flb_slope_usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of return on price by event, weighted by dollars, with clustered error."""
    s = stats.clustered_slope(stats.cells(filtered(spark, sf_dir), ["event"], F.col("usdc"), F.col("price"), F.col("ret")), ["event"])
    return s.select("event", "n", r6(F.col("b")).alias("b_ret"), r6(F.col("b") + 1).alias("b_won"), r6(F.col("se")).alias("se"))


def slope_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope of return on price by outcome, its error clustered one way, by event; no small-sample factor."""
    s = stats.clustered_slope(stats.cells(filtered(spark, sf_dir), ["outcome"], F.lit(1), F.col("price"), F.col("ret"), ("event",)), ["outcome"], ("event",))
    return s.select("outcome", "n", r6(F.col("b")).alias("b"), r6(F.col("se")).alias("se"))


def cluster_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By decile and clustering (day, wallet, market): design effect, effective size, within-cluster correlation. Rows are
    summed by decile and all three keys first, so the three clusterings expand sums, not rows."""
    df = filtered(spark, sf_dir)
    cell = df.groupBy("decile", *stats.CLUSTERS).agg(F.sum("ret").alias("s"), F.count("*").alias("m"))
    base = df.groupBy("decile").agg(F.count("*").alias("n"), F.avg("ret").alias("mu"), F.var_pop("ret").alias("var"))
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("clustering"), F.col(c).cast("string").alias("key")) for c in stats.CLUSTERS]))
    per = cell.select("decile", "s", "m", kinds.alias("k")).groupBy("decile", "k.clustering", "k.key").agg(F.sum("s").alias("s"), F.sum("m").alias("m"))
    v = per.join(F.broadcast(base.select("decile", "mu")), "decile").groupBy("decile", "clustering")  # ten rows
    v = v.agg(F.sum(F.pow(F.col("s") - F.col("mu") * F.col("m"), 2)).alias("vc"), (F.sum(F.col("m") * F.col("m")) / F.sum("m")).alias("mbar"), F.count("*").alias("clusters"))
    deff = F.col("vc") / (F.col("n") * F.col("var"))
    icc = F.greatest(F.lit(0.0), safe_div(deff - 1, F.col("mbar") - 1))
    return v.join(F.broadcast(base), "decile").select("decile", "clustering", "n", "clusters", r6(F.sqrt("vc") / F.col("n")).alias("se"), r6(deff).alias("deff"), F.round(F.col("n") / deff, 3).alias("n_eff"), r6(icc).alias("icc"))


def hubness_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of rows among the neighbours of queries: mean, bias-corrected skewness, 99.9 % quantile, largest."""
    h = hubness(spark, sf_dir).select(F.col("occurrences").cast("double").alias("x"))
    n = F.col("rows")
    s = h.agg(F.count("*").alias("rows"), F.avg("x").alias("mean"), F.skewness("x").alias("g"), F.percentile("x", F.lit(0.999)).alias("p999"), F.max("x").alias("most"))
    return s.select("rows", r6(F.col("mean")).alias("mean"), r6(F.sqrt(n * (n - 1)) / (n - 2) * F.col("g")).alias("skewness"), r6(F.col("p999")).alias("p999"), "most")


def market_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each market: log dollars, log trades, mean price, and its event."""
    per = tape(spark, sf_dir).groupBy("market_id", "event", "category").agg(F.sum("usdc").alias("usdc"), F.count("*").alias("trades"), F.avg("price").alias("x3"))
    return per.select("market_id", "event", "category", F.log("usdc").alias("x1"), F.log(F.col("trades").cast("double")).alias("x2"), "x3")


def dimension_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson correlations of the market dimensions, and their variance inflation factors (the inverse's diagonal)."""
    r = market_dimensions(spark, sf_dir).agg(F.corr("x1", "x2").alias("r12"), F.corr("x1", "x3").alias("r13"), F.corr("x2", "x3").alias("r23"))
    a, b, c = F.col("r12"), F.col("r13"), F.col("r23")
    det = 1 + 2 * a * b * c - a * a - b * b - c * c
    return r.select(*(r6(x).alias(n) for x, n in ((a, "r12"), (b, "r13"), (c, "r23"))), *(r6((1 - x * x) / det).alias(n) for x, n in ((c, "vif1"), (b, "vif2"), (a, "vif3"))))


def within_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each market dimension's variance that is left within events; each market counts once."""
    d = market_dimensions(spark, sf_dir)
    wide = d.select("event", F.explode(F.array(*[F.struct(F.lit(k).alias("dim"), F.col(k).alias("x")) for k in ("x1", "x2", "x3")])).alias("d")).select("event", "d.*")
    per = wide.groupBy("dim", "event").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    # Within plus between is the whole, so events' sums are enough.
    total = per.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("ss"))
    between = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    return total.select("dim", F.col("n").alias("markets"), r6(F.col("within") / (F.col("within") + between)).alias("within_share"))


def standardised_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of mean price on log dollars and log trades, all standardised, and the fit, from correlations."""
    r = market_dimensions(spark, sf_dir).agg(F.corr("x1", "x2").alias("r12"), F.corr("x1", "x3").alias("r1"), F.corr("x2", "x3").alias("r2"), F.count("*").alias("markets"))
    det = 1 - F.col("r12") * F.col("r12")
    b1, b2 = (F.col("r1") - F.col("r12") * F.col("r2")) / det, (F.col("r2") - F.col("r12") * F.col("r1")) / det
    return r.select("markets", r6(b1).alias("b1"), r6(b2).alias("b2"), r6(b1 * F.col("r1") + b2 * F.col("r2")).alias("r2"))


def skill_crossing(spark: SparkSession, sf_dir: str, least: float = 2.0) -> DataFrame:
    """Wallets by doublings of their buys: mean return and t of a wallet's mean; the lowest group from which on every t is
    `least` or more (null: none). The window runs over the groups."""
    per = buys(spark, sf_dir).groupBy("wallet").agg(F.count("*").alias("k"), F.avg("ret").alias("r"))
    b = per.withColumn("grp", F.floor(F.log2(F.col("k").cast("double"))).cast("int")).groupBy("grp")
    b = b.agg(F.count("*").alias("wallets"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"))
    t = F.coalesce(safe_div(F.col("m"), F.col("sd") / F.sqrt(F.col("wallets"))), F.lit(0.0))
    # Groups are fewer than 64, as they are doublings.
    worst = F.min("t").over(Window.orderBy(F.desc("grp")).rowsBetween(Window.unboundedPreceding, 0))
    b = b.withColumn("t", t).withColumn("holds", worst >= least)
    first = F.min(F.when(F.col("holds"), F.col("grp"))).over(Window.partitionBy())
    return b.select("grp", "wallets", r6(F.col("m")).alias("mean_ret"), F.round("t", 4).alias("t"), "holds", first.alias("crossing"))


def spread_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions ranked by how far their slices' mean returns lie apart: variance, range, lowest and highest slice."""
    dims = ("event", "category", "priority", "outcome")
    one = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("slice")) for d in dims]))
    per = buys(spark, sf_dir).select("ret", one.alias("d")).groupBy("d.dim", "d.slice").agg(F.count("*").alias("n"), r6(F.avg("ret")).alias("m"))
    out = per.groupBy("dim").agg(
        F.count("*").alias("slices"), r6(F.var_pop("m")).alias("variance"), r6(F.max("m") - F.min("m")).alias("spread"),
        F.min_by("slice", F.struct("m", "slice")).alias("lowest"), F.max_by("slice", F.struct("m", "slice")).alias("highest"),
    )
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("spread"), "dim")))  # a row for each dimension


def tail_stats(spark: SparkSession, sf_dir: str, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """By wallet and contract: dollars and dollar-weighted price of buys and sells in the low and the high tail."""
    t = tape(spark, sf_dir).filter((F.col("price") <= low) | (F.col("price") >= high))
    out = []
    for side in ("BUY", "SELL"):
        for name, tail in (("low", F.col("price") <= low), ("high", F.col("price") >= high)):
            hit = (F.col("side") == side) & tail
            usd = F.sum(F.when(hit, F.col("usdc")))
            out += [F.round(usd, 2).alias(f"{side.lower()}_{name}_usd"), r6(F.sum(F.when(hit, F.col("usdc") * F.col("price"))) / usd).alias(f"{side.lower()}_{name}_vwap")]
    return t.groupBy("wallet", "token_id").agg(F.count("*").alias("n"), *out)


def econ_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return per dollar of longshots (price 0.30 or less) and favourites (0.70 or more) by fifth of market volume, fifths
    cut over the markets."""
    d = market_dimensions(spark, sf_dir).withColumn("fifth", F.ntile(5).over(Window.orderBy("x1", "market_id")))  # over markets, not trades
    band = F.when(F.col("price") <= 0.30, "longshot").when(F.col("price") >= 0.70, "favourite")
    t = buys(spark, sf_dir).withColumn("band", band).filter("band IS NOT NULL").join(unique(d.select("market_id", "fifth"), "market_id"), "market_id")
    return t.groupBy("band", "fifth").agg(F.count("*").alias("n"), r6(safe_div(F.sum(F.col("usdc") * F.col("ret")), F.sum("usdc"))).alias("ret_per_dollar"))


def event_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By event: the most frequent outcome bought (the smaller of equals), one priority (the smallest), and markets whose
    bought outcome and resolution disagree more often than not."""
    t = buys(spark, sf_dir)
    per = t.groupBy("event", "market_id").agg(F.avg(((F.col("outcome") == "Yes") != (F.col("winning_outcome") == "Yes")).cast("int")).alias("apart"))
    off = per.groupBy("event").agg(F.sum((F.col("apart") > 0.5).cast("long")).alias("markets_apart"))
    votes = t.groupBy("event", "outcome").agg(F.count("*").alias("k"), F.min("priority").alias("p"))
    most = votes.groupBy("event").agg(F.min_by("outcome", F.struct(-F.col("k"), F.col("outcome"))).alias("mode_outcome"), F.min("p").alias("any_priority"))
    return unique(most, "event").join(unique(off, "event"), "event")


def event_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean return in the first, middle and last third of each event's markets, by their first trade."""
    t = buys(spark, sf_dir)
    first = t.groupBy("event", "market_id").agg(F.min("ts").alias("t0"), F.sum("ret").alias("s"), F.count("*").alias("k"))
    w = Window.partitionBy("event")
    place = (F.row_number().over(w.orderBy("t0", "market_id")) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))
    third = F.when(place < 1 / 3, "first").when(place < 2 / 3, "middle").otherwise("last")
    return first.withColumn("third", third).groupBy("third").agg(F.count("*").alias("markets"), F.sum("k").alias("n"), r6(F.sum("s") / F.sum("k")).alias("mean_ret"))


_DIMS_SQL = """dims AS (SELECT market_id, event, category, ln(sum(usdc)) AS x1, ln(CAST(count(*) AS DOUBLE)) AS x2, avg(price) AS x3 FROM tape GROUP BY ALL)"""


def _tails_sql(low: float, high: float) -> str:
    parts = []
    for side in ("BUY", "SELL"):
        for name, tail in (("low", f"price <= {low}"), ("high", f"price >= {high}")):
            hit = f"FILTER (side = '{side}' AND {tail})"
            parts.append(f"round(sum(usdc) {hit}, 2) AS {side.lower()}_{name}_usd, round(sum(usdc * price) {hit} / sum(usdc) {hit}, 6) AS {side.lower()}_{name}_vwap")
    return ", ".join(parts)


QUERIES = {
    "flb_bots_humans": (
        flb_bots_humans,
        f"""WITH {TAPE_SQL}, {STREAM_SQL}, {_flags_sql(LIMITS)},
x AS (SELECT buys.*, {DECILE_SQL} AS decile, coalesce(is_nonhuman, false) AS bot FROM buys LEFT JOIN flagged USING (wallet)),
y AS (SELECT 'all' AS sample, decile, ret, usdc FROM x UNION ALL SELECT 'human', decile, ret, usdc FROM x WHERE NOT bot)
SELECT sample, decile, count(*) AS n, round(avg(ret), 6) AS mean_ret, round(sum(usdc * ret) / nullif(sum(usdc), 0), 6) AS ret_per_dollar FROM y GROUP BY ALL""",
    ),
    "flb_spread_usd": (
        flb_spread_usd,
        f"""WITH {FILTERED_SQL}, {_BIG}, {_mean_sql("x", "event, decile", "usdc", "big")}
SELECT event, round(max(theta) FILTER (decile = 10) - max(theta) FILTER (decile = 1), 6) AS spread,
  round(sqrt(pow(max(se) FILTER (decile = 1), 2) + pow(max(se) FILTER (decile = 10), 2)), 6) AS se FROM xr GROUP BY event""",
    ),
    "flb_slope_usd": (
        flb_slope_usd,
        f"""WITH {FILTERED_SQL},
c AS (SELECT event, day, wallet, market_id, count(*) AS n, sum(usdc) AS sw, sum(usdc * price) AS swx, sum(usdc * ret) AS swy, sum(usdc * price * price) AS swxx, sum(usdc * price * ret) AS swxy FROM filtered GROUP BY ALL),
t AS (SELECT event, sum(n) AS n, sum(swx) / sum(sw) AS xb, sum(swy) / sum(sw) AS yb, sum(swxx) - sum(sw) * pow(sum(swx) / sum(sw), 2) AS sxx,
  sum(swxy) - sum(swx) * sum(swy) / sum(sw) AS sxy FROM c GROUP BY event),
u AS (SELECT *, sxy / sxx AS b, yb - sxy / sxx * xb AS a FROM t WHERE n >= 2 AND sxx > 1e-12),
s AS (SELECT c.*, c.swxy - a * c.swx - b * c.swxx - xb * (c.swy - a * c.sw - b * c.swx) AS score FROM c JOIN u USING (event)),
{_cube_sql("v", "s", "event", "score")}
SELECT event, CAST(n AS BIGINT) AS n, round(b, 6) AS b_ret, round(b + 1, 6) AS b_won, round(sqrt(greatest(v, 0)) / sxx, 6) AS se FROM u JOIN v USING (event)""",
    ),
    "slope_by_cluster": (
        slope_by_cluster,
        f"""WITH {FILTERED_SQL}, t AS (SELECT outcome, count(*) AS n, avg(price) AS xb, regr_slope(ret, price) AS b, regr_intercept(ret, price) AS a, regr_sxx(ret, price) AS sxx FROM filtered GROUP BY outcome),
s AS (SELECT outcome, event, sum((price - xb) * (ret - a - b * price)) AS score FROM filtered JOIN t USING (outcome) GROUP BY ALL),
v AS (SELECT outcome, sum(score * score) AS v FROM s GROUP BY outcome)
SELECT outcome, n, round(b, 6) AS b, round(sqrt(v) / sxx, 6) AS se FROM t JOIN v USING (outcome)""",
    ),
    "cluster_designs": (
        cluster_designs,
        f"""WITH {FILTERED_SQL}, b AS (SELECT decile, count(*) AS n, avg(ret) AS mu, var_pop(ret) AS var FROM filtered GROUP BY decile),
k AS (SELECT decile, 'day' AS clustering, CAST(day AS VARCHAR) AS key, ret FROM filtered UNION ALL SELECT decile, 'wallet', wallet, ret FROM filtered UNION ALL SELECT decile, 'market_id', CAST(market_id AS VARCHAR), ret FROM filtered),
p AS (SELECT decile, clustering, key, sum(ret) AS s, count(*) AS m FROM k GROUP BY ALL),
v AS (SELECT decile, clustering, sum(pow(s - mu * m, 2)) AS vc, sum(m * m) / sum(m) AS mbar, count(*) AS clusters FROM p JOIN b USING (decile) GROUP BY ALL),
j AS (SELECT *, vc / (n * var) AS deff FROM v JOIN b USING (decile))
SELECT decile, clustering, n, clusters, round(sqrt(vc) / n, 6) AS se, round(deff, 6) AS deff, round(n / deff, 3) AS n_eff, round(greatest(0.0::DOUBLE, (deff - 1) / nullif(mbar - 1, 0)), 6) AS icc FROM j""",
    ),
    "hubness_summary": (
        hubness_summary,
        f"""WITH {_SIMS_SQL}, h AS (SELECT id, CAST(count(*) AS DOUBLE) AS x FROM k GROUP BY id)
SELECT count(*) AS rows, round(avg(x), 6) AS mean, round(skewness(x), 6) AS skewness, round(quantile_cont(x, 0.999), 6) AS p999, max(x) AS most FROM h""",
    ),
    "dimension_correlations": (
        dimension_correlations,
        f"""WITH {TAPE_SQL}, {_DIMS_SQL}, r AS (SELECT corr(x1, x2) AS a, corr(x1, x3) AS b, corr(x2, x3) AS c FROM dims), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r)
SELECT round(a, 6) AS r12, round(b, 6) AS r13, round(c, 6) AS r23, round((1 - c * c) / det, 6) AS vif1, round((1 - b * b) / det, 6) AS vif2, round((1 - a * a) / det, 6) AS vif3 FROM d""",
    ),
    "within_shares": (
        within_shares,
        f"""WITH {TAPE_SQL}, {_DIMS_SQL}, w AS (SELECT event, 'x1' AS dim, x1 AS x FROM dims UNION ALL SELECT event, 'x2', x2 FROM dims UNION ALL SELECT event, 'x3', x3 FROM dims),
m AS (SELECT *, x - avg(x) OVER (PARTITION BY dim, event) AS e FROM w)
SELECT dim, count(*) AS markets, round(var_pop(e) / var_pop(x), 6) AS within_share FROM m GROUP BY dim""",
    ),
    "standardised_ols": (
        standardised_ols,
        f"""WITH {TAPE_SQL}, {_DIMS_SQL}, z AS (SELECT (x1 - avg(x1) OVER ()) / stddev_pop(x1) OVER () AS a, (x2 - avg(x2) OVER ()) / stddev_pop(x2) OVER () AS b, (x3 - avg(x3) OVER ()) / stddev_pop(x3) OVER () AS y FROM dims),
g AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS by_, sum(y * y) AS yy, count(*) AS n FROM z),
s AS (SELECT *, (ay * bb - ab * by_) / (aa * bb - ab * ab) AS b1, (by_ * aa - ab * ay) / (aa * bb - ab * ab) AS b2 FROM g)
SELECT n AS markets, round(b1, 6) AS b1, round(b2, 6) AS b2, round(1 - (yy - 2 * b1 * ay - 2 * b2 * by_ + b1 * b1 * aa + 2 * b1 * b2 * ab + b2 * b2 * bb) / yy, 6) AS r2 FROM s""",
    ),
    "skill_crossing": (
        skill_crossing,
        f"""WITH {TAPE_SQL}, p AS (SELECT wallet, count(*) AS k, avg(ret) AS r FROM buys GROUP BY wallet),
b AS (SELECT CAST(floor(log2(CAST(k AS DOUBLE))) AS INT) AS grp, count(*) AS wallets, avg(r) AS m, coalesce(avg(r) / nullif(stddev_samp(r) / sqrt(count(*)), 0), 0.0::DOUBLE) AS t FROM p GROUP BY grp),
h AS (SELECT *, NOT EXISTS (SELECT 1 FROM b c WHERE c.grp >= b.grp AND c.t < 2) AS holds FROM b)
SELECT grp, wallets, round(m, 6) AS mean_ret, round(t, 4) AS t, holds, (SELECT min(grp) FROM h WHERE holds) AS crossing FROM h""",
    ),
    "spread_ranking": (
        spread_ranking,
        f"""WITH {TAPE_SQL}, p AS (SELECT 'event' AS dim, event AS slice, round(avg(ret), 6) AS m FROM buys GROUP BY event UNION ALL SELECT 'category', category, round(avg(ret), 6) FROM buys GROUP BY category
UNION ALL SELECT 'priority', priority, round(avg(ret), 6) FROM buys GROUP BY priority UNION ALL SELECT 'outcome', outcome, round(avg(ret), 6) FROM buys GROUP BY outcome),
g AS (SELECT dim, count(*) AS slices, round(var_pop(m), 6) AS variance, round(max(m) - min(m), 6) AS spread, first(slice ORDER BY m, slice) AS lowest, first(slice ORDER BY m DESC, slice DESC) AS highest FROM p GROUP BY dim)
SELECT *, CAST(row_number() OVER (ORDER BY spread DESC, dim) AS INT) AS rank FROM g""",
    ),
    "tail_stats": (tail_stats, f"WITH {TAPE_SQL} SELECT wallet, token_id, count(*) AS n, {_tails_sql(0.15, 0.85)} FROM tape WHERE price <= 0.15 OR price >= 0.85 GROUP BY ALL"),
    "econ_by_band": (
        econ_by_band,
        f"""WITH {TAPE_SQL}, {_DIMS_SQL}, f AS (SELECT market_id, CAST(ntile(5) OVER (ORDER BY x1, market_id) AS INT) AS fifth FROM dims),
t AS (SELECT *, CASE WHEN price <= 0.30 THEN 'longshot' WHEN price >= 0.70 THEN 'favourite' END AS band FROM buys JOIN f USING (market_id))
SELECT band, fifth, count(*) AS n, round(sum(usdc * ret) / nullif(sum(usdc), 0), 6) AS ret_per_dollar FROM t WHERE band IS NOT NULL GROUP BY ALL""",
    ),
    "event_modes": (
        event_modes,
        f"""WITH {TAPE_SQL}, v AS (SELECT event, outcome, count(*) AS k FROM buys GROUP BY ALL), m AS (SELECT event, first(outcome ORDER BY k DESC, outcome) AS mode_outcome FROM v GROUP BY event),
a AS (SELECT event, market_id, avg(CAST(outcome <> winning_outcome AS INT)) AS apart, min(priority) AS p FROM buys GROUP BY ALL)
SELECT event, any_value(mode_outcome) AS mode_outcome, min(p) AS any_priority, CAST(count(*) FILTER (apart > 0.5) AS BIGINT) AS markets_apart FROM a JOIN m USING (event) GROUP BY event""",
    ),
    "event_thirds": (
        event_thirds,
        f"""WITH {TAPE_SQL}, f AS (SELECT event, market_id, min(ts) AS t0, sum(ret) AS s, count(*) AS k FROM buys GROUP BY ALL),
p AS (SELECT *, (row_number() OVER (PARTITION BY event ORDER BY t0, market_id) - 1)::DOUBLE / greatest(count(*) OVER (PARTITION BY event) - 1, 1) AS place FROM f)
SELECT CASE WHEN place < 1::DOUBLE / 3 THEN 'first' WHEN place < 2::DOUBLE / 3 THEN 'middle' ELSE 'last' END AS third, count(*) AS markets, CAST(sum(k) AS BIGINT) AS n, round(sum(s) / sum(k), 6) AS mean_ret FROM p GROUP BY ALL""",
    ),
}
