"""Market dimensions, as-of counts, rolling windows, quantile bins, variance ratios and convergence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import equal_frequency, r6, safe_div
from ..sources.tape import TAPE_SQL, read, seconds, tape

DAY = 86400


def lives_of(t: DataFrame) -> DataFrame:
    """A row for each market: first and last day of trading, trades, dollars, outcome."""
    return t.groupBy("market_id", "event", "category").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count("*").alias("n"), F.sum("usdc").alias("usd"), F.max(F.when(F.col("outcome") == "Yes", F.col("won"))).alias("won"))


def market_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lives_of(tape(spark, sf_dir))


def spells(t: DataFrame, days: int = 90, blocks: int = 1000) -> DataFrame:
    """The tape with each market's trades of a block of days as a market of its own, so that some settle before others start."""
    return t.withColumn("market_id", F.col("market_id") * blocks + F.floor(F.col("ts") / (days * DAY)))


LIVES_SQL = "lives AS (SELECT market_id, event, category, min(ts) AS t0, max(ts) AS t1, count(*) AS n, sum(usdc) AS usd, max(won) FILTER (outcome = 'Yes') AS won FROM tape GROUP BY ALL)"
SPELLS_SQL = f"""spelled AS (SELECT * REPLACE (market_id * 1000 + ts // {90 * DAY} AS market_id) FROM tape),
spell_lives AS (SELECT market_id, event, min(ts) AS t0, max(ts) AS t1, max(won) FILTER (outcome = 'Yes') AS won FROM spelled GROUP BY market_id, event)"""


def as_of(lives: DataFrame, group: str, ties: bool) -> DataFrame:
    """For each market: markets of its group that settled before it began, and how many of them were won. Starts and
    settlements are one stream of events per group with running sums, so no market is paired with another. ties: a
    settlement at the very second of the start counts."""
    start = lives.select(group, F.col("t0").alias("t"), F.lit(0).alias("ord"), F.lit(0).alias("k"), F.lit(0).alias("w"), "market_id")
    end = lives.select(group, F.col("t1").alias("t"), F.lit(-1 if ties else 1).alias("ord"), F.lit(1).alias("k"), F.coalesce("won", F.lit(0)).alias("w"), F.lit(None).cast("long").alias("market_id"))
    w = Window.partitionBy(group).orderBy("t", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = start.unionByName(end).withColumns({"before": F.sum("k").over(w), "won_before": F.sum("w").over(w)})
    return run.filter("market_id IS NOT NULL").select("market_id", "before", "won_before")


def prior_settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lives = market_lives(spark, sf_dir)
    strict, loose = as_of(lives, "event", False), as_of(lives, "event", True).select("market_id", F.col("before").alias("with_ties"))
    label = F.when(F.col("before") == 0, "0").when(F.col("before") <= 5, "1-5").when(F.col("before") <= 50, "6-50").otherwise("50+")
    return strict.join(loose, "market_id").select("market_id", "before", "with_ties", "won_before", label.alias("label"))


def _as_of_sql(op: str) -> str:
    return f"(SELECT count(*) FROM lives b WHERE b.event = a.event AND b.t1 {op} a.t0)"


def brier_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score of prices against the base rate of the event's earlier markets (ten at least, settled strictly before).
    Spells of 90 days stand for markets, as whole lives overlap."""
    t = spells(tape(spark, sf_dir))
    base = as_of(lives_of(t), "event", False).filter("before >= 10").select("market_id", (F.col("won_before") / F.col("before")).alias("rate"))
    t = t.filter("outcome = 'Yes' AND side = 'BUY'").join(base, "market_id")
    own, ref = F.pow(F.col("price") - F.col("won"), 2), F.pow(F.col("rate") - F.col("won"), 2)
    return t.groupBy("category").agg(F.count("*").alias("n"), r6(F.avg(own)).alias("brier"), r6(F.avg(ref)).alias("brier_base"), r6(F.avg(ref - own)).alias("skill"))


def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within a category: quantile cuts of first ranks, average-rank fifths, tenths by ntile, percent rank and earlier
    counts, of the markets' dollars."""
    m = market_lives(spark, sf_dir).withColumn("size", F.round(F.col("usd") / 1e5).cast("int"))
    by = Window.partitionBy("category")
    order, ties = by.orderBy("size", "market_id"), Window.partitionBy("category", "size")
    m = m.withColumns({"rn": F.row_number().over(order), "rk": F.rank().over(by.orderBy("size")), "same": F.count("*").over(ties), "m": F.count("*").over(by), "tenth": F.ntile(10).over(order), "pct": F.percent_rank().over(by.orderBy("size"))})
    fifth = F.least(F.greatest(F.ceil((F.col("rk") + (F.col("same") - 1) / 2) / F.col("m") * 5), F.lit(1)), F.lit(5)).cast("int")
    return m.select("market_id", equal_frequency(F.col("rn"), F.col("m"), 4).alias("quarter"), fifth.alias("fifth"), "tenth", r6(F.col("pct")).alias("pct"), (F.col("rk") - 1).alias("earlier"), F.ceil(F.col("rn") / F.col("m") * 10).cast("int").alias("first_tenth"))


def rolling_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market dollars against the median of markets born in the 90 days before, of the last 30 where those are fewer."""
    m = market_lives(spark, sf_dir).withColumn("day", F.floor(F.col("t0") / DAY).cast("long"))
    w = Window.partitionBy("category").orderBy("day")
    back, last = w.rangeBetween(-90, -1), Window.partitionBy("category").orderBy("day", "market_id").rowsBetween(-30, -1)
    usd = F.round(F.col("usd"), 2)
    m = m.withColumns({"k": F.count("usd").over(back), "m90": F.percentile(usd, F.lit(0.5)).over(back), "m30": F.percentile(usd, F.lit(0.5)).over(last)})
    ref = F.coalesce(F.when(F.col("k") >= 30, F.col("m90")).otherwise(F.col("m30")), usd)
    return m.select("market_id", "k", F.round(ref, 3).alias("reference"), r6(safe_div(usd, ref)).alias("relative"))


def variance_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-step variance ratio of daily last values by token of the stream."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("token"), seconds("ts").alias("sec"), "event_id", F.col("value").alias("p"))
    daily = e.withColumn("day", F.floor(F.col("sec") / DAY).cast("long")).groupBy("token", "day").agg(F.max_by("p", F.struct("sec", "event_id")).alias("p"))
    w = Window.partitionBy("token").orderBy("day")
    r = daily.withColumns({"r": F.col("p") - F.lag("p").over(w), "gap": F.col("day") - F.lag("day").over(w)}).filter("gap <= 3")
    r = r.withColumns({"c": F.sum("r").over(w.rowsBetween(Window.unboundedPreceding, 0)), "i": F.row_number().over(w)})
    r = r.withColumn("five", F.when(F.col("i") >= 5, F.col("c") - F.coalesce(F.lag("c", 5).over(w), F.lit(0.0))))
    out = r.groupBy("token").agg(F.count("*").alias("n"), F.var_pop("r").alias("v1"), F.var_pop("five").alias("v5")).filter("n >= 20 AND v1 > 0")
    return out.select("token", "n", r6(F.col("v5") / (5 * F.col("v1"))).alias("vr"))


def convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute error early and late in a market's life, and surprises at the end."""
    t = tape(spark, sf_dir)
    w = Window.partitionBy("token_id")
    pos = (F.col("ts") - F.min("ts").over(w)) / F.greatest(F.max("ts").over(w) - F.min("ts").over(w), F.lit(1))
    err = F.abs(F.col("won") - F.col("price"))
    t = t.withColumns({"pos": pos, "err": err})
    per = t.groupBy("market_id", "event").agg(F.avg(F.when(F.col("pos").between(0.05, 0.35), F.col("err"))).alias("early"), F.avg(F.when(F.col("pos").between(0.65, 0.95), F.col("err"))).alias("late"), F.max(F.when(F.col("pos") >= 0.9, F.col("err"))).alias("surprise"))
    return per.groupBy("event").agg(F.count("*").alias("markets"), r6(F.avg("early")).alias("early"), r6(F.avg("late")).alias("late"), r6(F.avg(F.col("early") - F.col("late"))).alias("gain"), r6(F.avg("surprise")).alias("surprise"))


def market_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Life, recurrence, instances before, vintage and size class of each market."""
    m = market_lives(spark, sf_dir)
    life = (F.col("t1") - F.col("t0")) / DAY
    w = Window.partitionBy("event").orderBy("t0", "market_id")
    m = m.withColumns({"life_d": life, "prior_instances": F.count("*").over(w.rowsBetween(Window.unboundedPreceding, -1)), "vintage": F.year(F.timestamp_seconds("t0"))})
    klass = F.when(F.col("life_d") <= 700, "short").when(F.col("life_d") <= 1500, "medium").otherwise("long")
    return m.select("market_id", r6(F.col("life_d")).alias("life_d"), "prior_instances", "vintage", klass.alias("class"), F.size(F.split("category", " ")).alias("words"))


def horizon_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration by life class, half of the calendar and topic; three sets of keys in one pass."""
    t = tape(spark, sf_dir).filter("side = 'BUY'")
    w = Window.partitionBy("market_id")
    life = (F.max("ts").over(w) - F.min("ts").over(w)) / DAY
    t = t.withColumns({"hclass": F.when(life <= 1500, "short").when(life <= 2200, "middle").otherwise("long"), "period": F.when(F.col("ts") < 820454400, "early").otherwise("late")})
    return t.groupingSets([["hclass", "period"], ["category", "period"], ["hclass"]], "hclass", "period", "category").agg(F.count("*").alias("n"), r6(F.avg("ret")).alias("mean_ret"), r6(F.regr_slope("won", "price")).alias("slope"))


def experience_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns by how many trades a wallet made before, in doubling buckets, and first encounters with a market."""
    t = tape(spark, sf_dir).filter("side = 'BUY'")
    w = Window.partitionBy("wallet").orderBy("ts", "token_id", "usdc", "price")
    m = Window.partitionBy("wallet", "market_id").orderBy("ts", "token_id", "usdc", "price")
    t = t.withColumns({"k": F.row_number().over(w), "first": F.row_number().over(m) == 1})
    bucket = F.floor(F.log2(F.col("k"))).cast("int")
    return t.groupBy(bucket.alias("bucket"), "first").agg(F.count("*").alias("n"), r6(F.avg("ret")).alias("mean_ret"), F.round(F.avg("usdc"), 2).alias("mean_usd"))


def residual_tercile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log dollars a trade, what log size leaves of it, and its third within the category."""
    m = market_lives(spark, sf_dir).withColumns({"y": F.log1p(F.col("usd") / F.col("n")), "x": F.log1p("n")})
    fit = m.groupBy("category").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    m = m.join(fit, "category").withColumn("res", r6(F.col("y") - F.col("a") - F.col("b") * F.col("x")))
    by = Window.partitionBy("category")
    m = m.withColumns({"rn": F.row_number().over(by.orderBy("res", "market_id")), "m": F.count("*").over(by)})
    return m.select("market_id", equal_frequency(F.col("rn"), F.col("m"), 3).alias("third"))


def threshold_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-regime regression of return on price split at each of 40 dollar cuts: sums of squares from the regimes'
    moments. Rows are reduced to moments by cut once; running sums over 41 rows give both regimes of every cut."""
    t = tape(spark, sf_dir).filter("side = 'BUY'")
    t = t.withColumn("cut", F.least(F.floor(F.col("usdc") / 2000), F.lit(40)).cast("int"))
    x, y = F.col("price"), F.col("won").cast("double")
    m = t.groupBy("cut").agg(F.count("*").cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"))
    names = ["n", "sx", "sy", "sxx", "sxy", "syy"]
    grid = spark.range(1, 41).select(F.col("id").cast("int").alias("at"))
    j = F.broadcast(m).join(F.broadcast(grid), F.lit(True)).groupBy("at")
    sums = j.agg(*[F.sum(F.when(F.col("cut") < F.col("at"), F.col(c)).otherwise(0.0)).alias("l" + c) for c in names], *[F.sum(F.when(F.col("cut") >= F.col("at"), F.col(c)).otherwise(0.0)).alias("h" + c) for c in names])

    def ssr(p: str):
        n, sx, sy, sxx, sxy, syy = (F.col(p + c) for c in names)
        vx, cov, vy = sxx - sx * sx / n, sxy - sx * sy / n, syy - sy * sy / n
        return vy - cov * cov / F.nullif(vx, F.lit(0.0))

    ok = sums.filter("ln >= 500 AND hn >= 500")
    return ok.select(F.col("at").alias("cutoff"), F.col("ln").cast("long").alias("n_low"), F.col("hn").cast("long").alias("n_high"), F.round(ssr("l") + ssr("h"), 4).alias("ssr"))


def label_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted vote of words for a category: each word of a part's name counts by its rarity for the part's metal;
    winner, margin over the second, abstention."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("market_id"), F.explode(F.array_distinct(F.split(F.lower("p_name"), " "))).alias("tag"))
    n = part.select("market_id").distinct().agg(F.count("*").alias("total"))
    df = part.groupBy("tag").agg(F.countDistinct("market_id").alias("df"))
    topic = F.element_at(F.array(F.lit("warm"), F.lit("cold"), F.lit("plain")), (F.pmod(F.length("tag"), F.lit(3)) + 1).cast("int"))
    votes = part.join(df, "tag").crossJoin(F.broadcast(n)).withColumn("topic", topic).groupBy("market_id", "topic").agg(F.sum(F.log(F.col("total") / F.greatest(F.col("df"), F.lit(1)))).alias("score"))
    ranked = votes.withColumn("score", r6(F.col("score"))).withColumn("rn", F.row_number().over(Window.partitionBy("market_id").orderBy(F.desc("score"), "topic")))
    best = ranked.filter("rn <= 2").groupBy("market_id").agg(F.max(F.when(F.col("rn") == 1, F.col("topic"))).alias("topic"), F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rn") == 2, F.col("score"))).alias("s2"))
    margin = F.when(F.col("s2") > 0, r6(F.col("s1") / F.col("s2")))
    return best.select("market_id", "topic", "s1", margin.alias("margin"), (F.col("s1") / F.greatest(F.coalesce("s2", F.lit(0.0)), F.lit(1e-4)) < 1.25).alias("abstain"))


def flag_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets only in one, only in the other, or in both of two flags, and their Jaccard similarity."""
    m = market_lives(spark, sf_dir)
    a, b = F.col("usd") > 500_000, F.col("n") > 15
    one = m.agg(F.sum((a & ~b).cast("long")).alias("only_a"), F.sum((~a & b).cast("long")).alias("only_b"), F.sum((a & b).cast("long")).alias("both"))
    return one.withColumn("jaccard", r6(F.col("both") / F.nullif(F.col("only_a") + F.col("only_b") + F.col("both"), F.lit(0))))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five markets of each size class by a fixed pseudo-random order of their ids (a sampling operator)."""
    m = market_lives(spark, sf_dir).withColumn("size", F.when(F.col("n") < 12, "s").when(F.col("n") < 18, "m").otherwise("l"))
    key = F.col("market_id") * 2654435761 % 4294967296
    return m.withColumn("key", key).withColumn("rn", F.row_number().over(Window.partitionBy("size").orderBy("key", "market_id"))).filter("rn <= 5").select("size", "market_id", "rn")


QUERIES = {
    "prior_settlements": (
        prior_settlements,
        f"""WITH {TAPE_SQL}, {LIVES_SQL}, c AS (SELECT market_id, {_as_of_sql("<")} AS before, {_as_of_sql("<=")} AS with_ties, coalesce((SELECT sum(won) FROM lives b WHERE b.event = a.event AND b.t1 < a.t0), 0) AS won_before FROM lives a)
SELECT market_id, before, with_ties, CAST(won_before AS BIGINT) AS won_before, CASE WHEN before = 0 THEN '0' WHEN before <= 5 THEN '1-5' WHEN before <= 50 THEN '6-50' ELSE '50+' END AS label FROM c""",
    ),
    "brier_skill": (
        brier_skill,
        f"""WITH {TAPE_SQL}, {SPELLS_SQL}, c AS (SELECT a.market_id, count(*) AS k, sum(coalesce(b.won, 0)) AS w FROM spell_lives a JOIN spell_lives b ON b.event = a.event AND b.t1 < a.t0 GROUP BY a.market_id HAVING count(*) >= 10)
SELECT category, count(*) AS n, round(avg(pow(price - won, 2)), 6) AS brier, round(avg(pow(w / k - won, 2)), 6) AS brier_base, round(avg(pow(w / k - won, 2) - pow(price - won, 2)), 6) AS skill FROM spelled JOIN c USING (market_id) WHERE outcome = 'Yes' AND side = 'BUY' GROUP BY category""",
    ),
    "quantile_bins": (
        quantile_bins,
        f"""WITH {TAPE_SQL}, {LIVES_SQL}, s AS (SELECT *, CAST(round(usd / 1e5) AS INT) AS size FROM lives),
m AS (SELECT *, row_number() OVER o AS rn, rank() OVER (PARTITION BY category ORDER BY size) AS rk, count(*) OVER (PARTITION BY category, size) AS same, count(*) OVER (PARTITION BY category) AS m, ntile(10) OVER o AS tenth, percent_rank() OVER (PARTITION BY category ORDER BY size) AS pct FROM s WINDOW o AS (PARTITION BY category ORDER BY size, market_id))
SELECT market_id, CAST(CASE WHEN m = 1 THEN 1 ELSE greatest(1, ceil((rn - 1) * 4 / (m - 1))) END AS INT) AS quarter, CAST(least(greatest(ceil((rk + (same - 1) / 2) / m * 5), 1), 5) AS INT) AS fifth, CAST(tenth AS INT) AS tenth, round(pct, 6) AS pct, rk - 1 AS earlier, CAST(ceil(rn / m * 10) AS INT) AS first_tenth FROM m""",
    ),
    "rolling_volume": (
        rolling_volume,
        f"""WITH {TAPE_SQL}, {LIVES_SQL}, m AS (SELECT *, CAST(floor(t0 / 86400.0) AS BIGINT) AS day, round(usd, 2) AS u FROM lives),
w AS (SELECT market_id, u, count(u) OVER b AS k, quantile_cont(u, 0.5) OVER b AS m90, quantile_cont(u, 0.5) OVER l AS m30 FROM m
  WINDOW b AS (PARTITION BY category ORDER BY day RANGE BETWEEN 90 PRECEDING AND 1 PRECEDING), l AS (PARTITION BY category ORDER BY day, market_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
SELECT market_id, k, round(coalesce(CASE WHEN k >= 30 THEN m90 ELSE m30 END, u), 3) AS reference, round(u / nullif(coalesce(CASE WHEN k >= 30 THEN m90 ELSE m30 END, u), 0), 6) AS relative FROM w""",
    ),
    "variance_ratio": (
        variance_ratio,
        """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS token, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_id, value AS p FROM events), d AS (SELECT token, CAST(floor(sec / 86400.0) AS BIGINT) AS day, arg_max(p, struct_pack(a := sec, b := event_id)) AS p FROM e GROUP BY ALL),
r AS (SELECT * FROM (SELECT token, day, p - lag(p) OVER w AS r, day - lag(day) OVER w AS gap FROM d WINDOW w AS (PARTITION BY token ORDER BY day)) WHERE gap <= 3), c AS (SELECT *, sum(r) OVER (PARTITION BY token ORDER BY day ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER (PARTITION BY token ORDER BY day) AS i FROM r),
f AS (SELECT *, CASE WHEN i >= 5 THEN c - coalesce(lag(c, 5) OVER (PARTITION BY token ORDER BY day), 0) END AS five FROM c)
SELECT token, count(*) AS n, round(var_pop(five) / (5 * var_pop(r)), 6) AS vr FROM f GROUP BY token HAVING count(*) >= 20 AND var_pop(r) > 0""",
    ),
    "convergence": (
        convergence,
        f"""WITH {TAPE_SQL}, w AS (SELECT *, (ts - min(ts) OVER t) / greatest(max(ts) OVER t - min(ts) OVER t, 1) AS pos, abs(won - price) AS err FROM tape WINDOW t AS (PARTITION BY token_id)),
p AS (SELECT market_id, event, avg(err) FILTER (pos BETWEEN 0.05 AND 0.35) AS early, avg(err) FILTER (pos BETWEEN 0.65 AND 0.95) AS late, max(err) FILTER (pos >= 0.9) AS surprise FROM w GROUP BY ALL)
SELECT event, count(*) AS markets, round(avg(early), 6) AS early, round(avg(late), 6) AS late, round(avg(early - late), 6) AS gain, round(avg(surprise), 6) AS surprise FROM p GROUP BY event""",
    ),
    "market_dimensions": (
        market_dimensions,
        f"""WITH {TAPE_SQL}, {LIVES_SQL}, d AS (SELECT *, (t1 - t0) / 86400.0 AS life FROM lives)
SELECT market_id, round(life, 6) AS life_d, count(*) OVER (PARTITION BY event ORDER BY t0, market_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_instances, CAST(year(make_timestamp(t0 * 1000000)) AS INT) AS vintage,
  CASE WHEN life <= 700 THEN 'short' WHEN life <= 1500 THEN 'medium' ELSE 'long' END AS class, CAST(len(string_split(category, ' ')) AS INT) AS words FROM d""",
    ),
    "horizon_cells": (
        horizon_cells,
        f"""WITH {TAPE_SQL}, w AS (SELECT *, (max(ts) OVER m - min(ts) OVER m) / 86400.0 AS life FROM tape WHERE side = 'BUY' WINDOW m AS (PARTITION BY market_id)),
h AS (SELECT *, CASE WHEN life <= 1500 THEN 'short' WHEN life <= 2200 THEN 'middle' ELSE 'long' END AS hclass, CASE WHEN ts < 820454400 THEN 'early' ELSE 'late' END AS period FROM w)
SELECT hclass, period, category, count(*) AS n, round(avg(ret), 6) AS mean_ret, round(regr_slope(won, price), 6) AS slope FROM h GROUP BY GROUPING SETS ((hclass, period), (category, period), (hclass))""",
    ),
    "experience_curves": (
        experience_curves,
        f"""WITH {TAPE_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY ts, token_id, usdc, price) AS k, row_number() OVER (PARTITION BY wallet, market_id ORDER BY ts, token_id, usdc, price) = 1 AS first FROM tape WHERE side = 'BUY')
SELECT CAST(floor(log2(k)) AS INT) AS bucket, first, count(*) AS n, round(avg(ret), 6) AS mean_ret, round(avg(usdc), 2) AS mean_usd FROM w GROUP BY ALL""",
    ),
    "residual_tercile": (
        residual_tercile,
        f"""WITH {TAPE_SQL}, {LIVES_SQL}, m AS (SELECT *, ln(1 + usd / n) AS y, ln(1 + n) AS x FROM lives), f AS (SELECT category, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM m GROUP BY category),
r AS (SELECT market_id, category, round(y - a - b * x, 6) AS res FROM m JOIN f USING (category)), q AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY res, market_id) AS rn, count(*) OVER (PARTITION BY category) AS m FROM r)
SELECT market_id, CAST(CASE WHEN m = 1 THEN 1 ELSE greatest(1, ceil((rn - 1) * 3 / (m - 1))) END AS INT) AS third FROM q""",
    ),
    "threshold_regression": (
        threshold_regression,
        f"""WITH {TAPE_SQL}, b AS (SELECT CAST(least(floor(usdc / 2000), 40) AS INT) AS cut, price AS x, CAST(won AS DOUBLE) AS y FROM tape WHERE side = 'BUY'), g AS (SELECT CAST(unnest(range(1, 41)) AS INT) AS pos),
s AS (SELECT pos, cut >= pos AS high, count(*) AS n, regr_syy(y, x) - pow(regr_sxy(y, x), 2) / nullif(regr_sxx(y, x), 0) AS ssr FROM b, g GROUP BY ALL)
SELECT pos AS cutoff, max(n) FILTER (NOT high) AS n_low, max(n) FILTER (high) AS n_high, round(sum(ssr), 4) AS ssr FROM s GROUP BY pos HAVING max(n) FILTER (NOT high) >= 500 AND max(n) FILTER (high) >= 500""",
    ),
    "label_vote": (
        label_vote,
        """WITH t AS (SELECT DISTINCT p_partkey AS market_id, unnest(string_split(lower(p_name), ' ')) AS tag FROM part), n AS (SELECT count(DISTINCT market_id) AS total FROM t), d AS (SELECT tag, count(DISTINCT market_id) AS df FROM t GROUP BY tag),
v AS (SELECT market_id, CASE length(tag) % 3 WHEN 0 THEN 'warm' WHEN 1 THEN 'cold' ELSE 'plain' END AS topic, round(sum(ln(total / greatest(df, 1))), 6) AS score FROM t JOIN d USING (tag), n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY score DESC, topic) AS rn FROM v), b AS (SELECT market_id, max(topic) FILTER (rn = 1) AS topic, max(score) FILTER (rn = 1) AS s1, max(score) FILTER (rn = 2) AS s2 FROM r WHERE rn <= 2 GROUP BY market_id)
SELECT market_id, topic, s1, CASE WHEN s2 > 0 THEN round(s1 / s2, 6) END AS margin, s1 / greatest(coalesce(s2, 0), 1e-4) < 1.25 AS abstain FROM b""",
    ),
    "flag_overlap": (
        flag_overlap,
        f"""WITH {TAPE_SQL}, {LIVES_SQL}, o AS (SELECT count(*) FILTER (usd > 500000 AND n <= 15) AS only_a, count(*) FILTER (usd <= 500000 AND n > 15) AS only_b, count(*) FILTER (usd > 500000 AND n > 15) AS "both" FROM lives)
SELECT *, round("both" / nullif(only_a + only_b + "both", 0), 6) AS jaccard FROM o""",
    ),
    "stratified_sample": (
        stratified_sample,
        f"""WITH {TAPE_SQL}, {LIVES_SQL}, s AS (SELECT market_id, CASE WHEN n < 12 THEN 's' WHEN n < 18 THEN 'm' ELSE 'l' END AS size, market_id * 2654435761 % 4294967296 AS key FROM lives)
SELECT size, market_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY size ORDER BY key, market_id) AS rn FROM s) WHERE rn <= 5""",
    ),
}
