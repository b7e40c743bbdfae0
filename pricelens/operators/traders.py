"""Wallets: behaviour flags, profiles, experience, segments, profit and loss, timelines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import equal_frequency, mirrored, price_bin, r6, safe_div
from ..sources.tape import TAPE_SQL, read, tape

DAY = 86400


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intraday stream: wallet, second, size, token."""
    e = read(spark, sf_dir, "events")
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(F.col("user_id").cast("string").alias("wallet"), sec.alias("sec"), F.col("value").alias("size"), F.col("event_type").alias("token"), "event_id")


STREAM_SQL = "stream AS (SELECT CAST(user_id AS VARCHAR) AS wallet, epoch_us(ts) / 1e6 AS sec, value AS size, event_type AS token, event_id FROM events)"


def wallet_metrics(s: DataFrame, near: float) -> DataFrame:
    """Per wallet: trades, active days, trades a day, median gap (only where the mean gap is under `near` seconds),
    concentration over hours, relative spread of sizes. Gaps need the wallet's rows in order; all else is summed."""
    w = Window.partitionBy("wallet").orderBy("sec", "event_id")
    base = s.groupBy("wallet").agg(
        F.count("*").alias("n_trades"), F.countDistinct(F.floor(F.col("sec") / DAY)).alias("active_days"), F.min("sec").alias("t0"), F.max("sec").alias("t1"), (F.stddev_pop("size") / F.nullif(F.avg("size"), F.lit(0.0))).alias("size_cv"),
    )
    close = base.filter((F.col("n_trades") > 1) & ((F.col("t1") - F.col("t0")) / (F.col("n_trades") - 1) < near)).select("wallet")
    gaps = s.join(close, "wallet", "left_semi").withColumn("gap", F.col("sec") - F.lag("sec").over(w)).groupBy("wallet").agg(F.median("gap").alias("median_iti"))
    hours = s.groupBy("wallet", F.pmod(F.floor(F.col("sec") / 3600), F.lit(24)).alias("hour")).agg(F.count("*").alias("k"))
    hhi = hours.groupBy("wallet").agg((F.sum(F.col("k") * F.col("k")) / F.pow(F.sum("k"), 2)).alias("hour_hhi"))
    return base.join(gaps, "wallet", "left").join(hhi, "wallet").withColumn("per_day", F.col("n_trades") / F.greatest(F.col("active_days"), F.lit(1)))


#: Definite and likely limits of the criteria: median gap, trades a day, hour concentration, size spread.
LIMITS = {"near": 100_000.0, "a_def": 3_000.0, "a_lik": 12_000.0, "b_def": 24.0, "b_lik": 22.5, "c": 0.0445, "c_n": 500, "e": 0.99, "e_n": 50}


def flags(s: DataFrame, lim: dict | None = None) -> DataFrame:
    x = LIMITS if lim is None else lim
    no = F.lit(False)
    m = wallet_metrics(s, x["near"])
    c = lambda v: F.coalesce(v, no)
    m = m.withColumns(
        {
            "flag_a_definite": c(F.col("median_iti") < x["a_def"]),
            "flag_a_likely": c((F.col("median_iti") >= x["a_def"]) & (F.col("median_iti") < x["a_lik"])),
            "flag_b_definite": c(F.col("per_day") > x["b_def"]),
            "flag_b_likely": c((F.col("per_day") > x["b_lik"]) & (F.col("per_day") <= x["b_def"])),
            "flag_c": c((F.col("hour_hhi") < x["c"]) & (F.col("n_trades") > x["c_n"])),
            "flag_e": c((F.col("size_cv") < x["e"]) & (F.col("n_trades") > x["e_n"])),
        }
    )
    ad, al, bd, bl, fc, fe = (F.col(k) for k in ("flag_a_definite", "flag_a_likely", "flag_b_definite", "flag_b_likely", "flag_c", "flag_e"))
    two = bl.cast("int") + fc.cast("int") + fe.cast("int") >= 2
    return m.withColumn("is_nonhuman", ad | (al & (bd | bl | fc | fe)) | (bd & fc) | two)


def bot_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flags(stream(spark, sf_dir))
    return f.select("wallet", "n_trades", "active_days", r6(F.col("per_day")).alias("per_day"), F.round("median_iti", 3).alias("median_iti"), r6(F.col("hour_hhi")).alias("hour_hhi"), r6(F.col("size_cv")).alias("size_cv"), "flag_a_definite", "flag_a_likely", "flag_b_definite", "flag_b_likely", "flag_c", "flag_e", "is_nonhuman")


def _flags_sql(x: dict) -> str:
    return f"""b AS (SELECT wallet, count(*) AS n_trades, count(DISTINCT floor(sec / {DAY})) AS active_days, min(sec) AS t0, max(sec) AS t1, stddev_pop(size) / nullif(avg(size), 0) AS size_cv FROM stream GROUP BY wallet),
g AS (SELECT wallet, median(gap) AS median_iti FROM (SELECT wallet, sec - lag(sec) OVER (PARTITION BY wallet ORDER BY sec, event_id) AS gap FROM stream) JOIN b USING (wallet) WHERE n_trades > 1 AND (t1 - t0) / (n_trades - 1) < {x["near"]} GROUP BY wallet),
h AS (SELECT wallet, sum(k * k) / pow(sum(k), 2) AS hour_hhi FROM (SELECT wallet, floor(sec / 3600) % 24 AS hour, count(*) AS k FROM stream GROUP BY ALL) GROUP BY wallet),
m AS (SELECT b.*, median_iti, hour_hhi, n_trades / greatest(active_days, 1) AS per_day FROM b LEFT JOIN g USING (wallet) JOIN h USING (wallet)),
f AS (SELECT *, coalesce(median_iti < {x["a_def"]}, false) AS flag_a_definite, coalesce(median_iti >= {x["a_def"]} AND median_iti < {x["a_lik"]}, false) AS flag_a_likely,
  coalesce(per_day > {x["b_def"]}, false) AS flag_b_definite, coalesce(per_day > {x["b_lik"]} AND per_day <= {x["b_def"]}, false) AS flag_b_likely,
  coalesce(hour_hhi < {x["c"]} AND n_trades > {x["c_n"]}, false) AS flag_c, coalesce(size_cv < {x["e"]} AND n_trades > {x["e_n"]}, false) AS flag_e FROM m),
flagged AS (SELECT *, flag_a_definite OR (flag_a_likely AND (flag_b_definite OR flag_b_likely OR flag_c OR flag_e)) OR (flag_b_definite AND flag_c)
  OR CAST(flag_b_likely AS INT) + CAST(flag_c AS INT) + CAST(flag_e AS INT) >= 2 AS is_nonhuman FROM f)"""


def bot_attrition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many wallets and trades each criterion takes: one aggregate, unpivoted."""
    f = flags(stream(spark, sf_dir))
    names = ["flag_a_definite", "flag_a_likely", "flag_b_definite", "flag_b_likely", "flag_c", "flag_e", "is_nonhuman"]
    own = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("hit")) for c in names]))
    return f.select("n_trades", own.alias("o")).groupBy("o.criterion").agg(F.sum(F.col("o.hit").cast("long")).alias("wallets"), F.sum(F.when(F.col("o.hit"), F.col("n_trades")).otherwise(0)).alias("trades"))


def bot_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged wallets under looser, base and tighter limits."""
    s = stream(spark, sf_dir)
    out = None
    for name, k in (("tighter", 0.9), ("base", 1.0), ("looser", 1.1)):
        lim = {**LIMITS, "a_def": LIMITS["a_def"] * k, "a_lik": LIMITS["a_lik"] * k, "c": LIMITS["c"] * k}
        one = flags(s, lim).agg(F.lit(name).alias("variant"), F.sum(F.col("is_nonhuman").cast("long")).alias("wallets"), F.sum(F.when(F.col("is_nonhuman"), F.col("n_trades")).otherwise(0)).alias("trades"))
        out = one if out is None else out.unionByName(one)
    return out


def trader_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buyer type and frequency tier; tiers cut at the 50th, 90th and 99th percentile of log trades (one row of cuts)."""
    t = tape(spark, sf_dir)
    per = t.groupBy("wallet").agg(F.count("*").alias("n"), F.avg((F.col("side") == "BUY").cast("int")).alias("buy_share"), F.min_by("outcome", F.struct("ts", "token_id", "usdc", "price")).alias("first_outcome"))
    cuts = per.agg(*[F.percentile(F.log10("n"), F.lit(q)).alias(k) for k, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))])
    j = per.crossJoin(F.broadcast(cuts))
    lg = F.log10("n")
    tier = F.when(lg <= F.col("p50"), "low").when(lg <= F.col("p90"), "medium").when(lg <= F.col("p99"), "high").otherwise("extreme")
    kind = F.when(F.col("buy_share") >= 0.95, "buyer").when(F.col("buy_share") <= 0.05, "seller").otherwise("mixed")
    return j.withColumns({"tier": tier, "kind": kind}).groupBy("tier", "kind").agg(F.count("*").alias("wallets"), F.sum("n").alias("trades"), F.sum((F.col("first_outcome") == "Yes").cast("long")).alias("first_yes"))


def category_specialization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each wallet's main category and the concentration of its trades over categories."""
    per = tape(spark, sf_dir).groupBy("wallet", "category").agg(F.count("*").alias("k"))
    out = per.groupBy("wallet").agg(F.max_by("category", F.struct(F.col("k"), F.col("category"))).alias("main"), F.sum("k").alias("n"), (F.sum(F.col("k") * F.col("k")) / F.pow(F.sum("k"), 2)).alias("hhi"))
    return out.select("wallet", "main", "n", r6(F.col("hhi")).alias("hhi"), (F.col("hhi") > 0.49).alias("specialist"))


def flb_segments_two_sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins by several segments at once, sells mirrored to buys of the complement; one scan, rows repeated by segment."""
    t = tape(spark, sf_dir)
    p = mirrored(F.col("side"), F.col("price"))
    w = F.when(F.col("side") == "BUY", F.col("won")).otherwise(1 - F.col("won"))
    t = t.select(price_bin(p, 10).alias("bin_idx"), w.alias("won"), (w - p).alias("ret"), "usdc", "is_maker", "priority", "side")
    seg = F.explode(F.array(F.struct(F.lit("maker").alias("dim"), F.col("is_maker").cast("string").alias("value")), F.struct(F.lit("priority").alias("dim"), F.col("priority").alias("value")), F.struct(F.lit("side").alias("dim"), F.col("side").alias("value"))))
    return t.withColumn("s", seg).groupBy("s.dim", "s.value", "bin_idx").agg(F.count("*").alias("n"), r6(F.avg("won")).alias("win_rate"), r6(F.avg("ret")).alias("mean_ret"), F.round(F.sum("usdc"), 2).alias("usdc"))


def flb_contract_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By trades of a wallet in a contract: one, then cuts at percentiles of the repeat counts."""
    t = tape(spark, sf_dir).filter("side = 'BUY'")
    per = t.groupBy("wallet", "market_id").agg(F.count("*").alias("k"), F.sum("won").alias("w"), F.sum("ret").alias("r"), F.sum("price").alias("p"))
    cuts = per.filter("k > 1").agg(F.percentile("k", F.lit(0.5)).alias("p50"), F.percentile("k", F.lit(0.9)).alias("p90"))
    j = per.crossJoin(F.broadcast(cuts)).withColumn("tier", F.when(F.col("k") == 1, "one").when(F.col("k") <= F.col("p50"), "p50").when(F.col("k") <= F.col("p90"), "p90").otherwise("top"))
    return j.groupBy("tier").agg(F.sum("k").alias("n"), r6(F.sum("w") / F.sum("k")).alias("win_rate"), r6(F.sum("r") / F.sum("k")).alias("mean_ret"), r6(F.sum("p") / F.sum("k")).alias("mean_price"))


def flb_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the number of contracts a wallet entered before, overall and within the category."""
    first = tape(spark, sf_dir).filter("side = 'BUY'").groupBy("wallet", "token_id", "category").agg(F.min("ts").alias("t"), F.avg("price").alias("price"), F.max("won").alias("won"))
    w, c = Window.partitionBy("wallet").orderBy("t", "token_id"), Window.partitionBy("wallet", "category").orderBy("t", "token_id")
    x = first.withColumns({"prior": F.row_number().over(w) - 1, "prior_cat": F.row_number().over(c) - 1})
    bucket = lambda k: F.when(k == 0, "0").when(k <= 2, "1-2").when(k <= 5, "3-5").otherwise("6+")
    return x.groupBy(bucket(F.col("prior")).alias("experience"), bucket(F.col("prior_cat")).alias("in_category")).agg(F.count("*").alias("n"), r6(F.avg("price")).alias("mean_price"), r6(F.avg("won")).alias("win_rate"))


def cross_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a category's longshot wallets that also buy longshots in another. Each wallet's categories (few) are
    gathered and paired, so the wallet table isn't joined with itself."""
    t = tape(spark, sf_dir).filter("side = 'BUY' AND price < 0.2").groupBy("wallet").agg(F.collect_set("category").alias("cats"))
    pairs = t.withColumn("a", F.explode("cats")).withColumn("b", F.explode("cats")).groupBy("a", "b").agg(F.count("*").alias("both"))
    own = pairs.filter("a = b").select("a", F.col("both").alias("n_a"))
    return pairs.join(own, "a").select("a", "b", "both", r6(F.col("both") / F.col("n_a")).alias("overlap"))


def trader_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net position, cash flow and total profit by wallet and event."""
    t = tape(spark, sf_dir)
    sign = F.when(F.col("side") == "BUY", 1).otherwise(-1)
    size = F.col("usdc") / F.nullif(F.col("price"), F.lit(0.0))
    pos = t.groupBy("wallet", "event", "token_id").agg(F.sum(sign * size).alias("pos"), F.sum(-sign * F.col("usdc")).alias("cash"), F.max("won").alias("won"))
    per = pos.groupBy("wallet", "event").agg(F.sum("cash").alias("cash"), F.sum(F.col("pos") * F.col("won")).alias("value"), F.sum((F.abs("pos") > 1e-9).cast("long")).alias("open_tokens"))
    return per.select("wallet", "event", F.round("cash", 2).alias("cash"), F.round(F.col("cash") + F.col("value"), 7).alias("total"), "open_tokens")


def market_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome by the last price of a token, ties to the latest larger trade."""
    last = tape(spark, sf_dir).groupBy("token_id").agg(F.max_by("price", F.struct("ts", "usdc", "price")).alias("last"))
    state = F.when(F.col("last") >= 0.95, "yes").when(F.col("last") <= 0.05, "no").otherwise("open")
    return last.select("token_id", r6(F.col("last")).alias("last"), state.alias("state"))


def trader_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wallets cut at the 50th, 90th and 99th percentile of volume, with the spread of their prices."""
    per = tape(spark, sf_dir).groupBy("wallet").agg(F.sum("usdc").alias("volume"), F.avg("price").alias("m"), F.avg(F.col("price") * F.col("price")).alias("mm"))
    cuts = per.agg(*[F.percentile("volume", F.lit(q)).alias(k) for k, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))])
    v = F.col("volume")
    j = per.crossJoin(F.broadcast(cuts)).withColumn("segment", F.when(v <= F.col("p50"), "bottom").when(v <= F.col("p90"), "middle").when(v <= F.col("p99"), "top").otherwise("whale"))
    return j.groupBy("segment").agg(F.count("*").alias("wallets"), F.round(F.avg("volume"), 2).alias("mean_volume"), r6(F.avg(F.sqrt(F.greatest(F.col("mm") - F.col("m") * F.col("m"), F.lit(0.0))))).alias("price_sd"))


def market_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume-weighted size and counts of each token in windows of an hour."""
    s = stream(spark, sf_dir).withColumn("bucket", (F.floor(F.col("sec") / 3600) * 3600).cast("long"))
    return s.groupBy("token", "bucket").agg(F.count("*").alias("n"), F.round(F.sum("size"), 4).alias("volume"), F.round(safe_div(F.sum(F.col("size") * F.col("size")), F.sum("size")), 4).alias("weighted"))


def monthly_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tape(spark, sf_dir)
    return t.groupBy(F.date_format(F.timestamp_seconds("ts"), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("usdc"), 2).alias("usdc"), F.countDistinct("wallet").alias("wallets"), F.countDistinct("market_id").alias("markets"))


def closed_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markets whose last ten trades average near 0 or 1. Prices are added from the latest on, each in its place: an average
    of exactly 0.6 or 0.4 rounds to either side of the limit by the order of the sum, and a hash aggregate that spills
    would add parts of it."""
    w = Window.partitionBy("token_id").orderBy(F.desc("ts"), F.desc("usdc"), F.desc("price"))
    last = tape(spark, sf_dir).withColumn("rn", F.row_number().over(w)).filter("rn <= 10")
    places = [F.max(F.when(F.col("rn") == k, F.col("price"))).alias(f"p{k}") for k in range(1, 11)]
    per = last.groupBy("token_id").agg(F.count("*").alias("n"), F.count("price").alias("priced"), *places)
    total = reduce(lambda a, k: a + F.coalesce(f"p{k}", F.lit(0.0)), range(1, 11), F.lit(0.0))
    per = per.select("token_id", "n", safe_div(total, F.col("priced")).alias("p"))
    return per.select("token_id", "n", r6(F.col("p")).alias("p"), F.when(F.col("p") >= 0.6, "up").when(F.col("p") <= 0.4, "down").otherwise("open").alias("state"))


def market_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By tenth of a token's life: mean of the last ten prices in it, in 10 quantile bins, against the outcome."""
    t = tape(spark, sf_dir)
    w = Window.partitionBy("token_id")
    t = t.withColumns({"t0": F.min("ts").over(w), "t1": F.max("ts").over(w), "k": F.count("*").over(w)}).filter("k >= 15 AND t1 > t0")
    t = t.withColumn("tenth", F.least(F.floor((F.col("ts") - F.col("t0")) * 10 / (F.col("t1") - F.col("t0"))), F.lit(9)).cast("int"))
    order = Window.partitionBy("token_id", "tenth").orderBy(F.desc("ts"), F.desc("usdc"), F.desc("price"))
    per = t.withColumn("rn", F.row_number().over(order)).filter("rn <= 10").groupBy("token_id", "tenth").agg(F.avg("price").alias("p"), F.max("won").alias("won"))
    by = Window.partitionBy("tenth")
    per = per.withColumns({"number": F.row_number().over(by.orderBy("p", "token_id")), "n": F.count("*").over(by)}).withColumn("bin", equal_frequency(F.col("number"), F.col("n"), 10))
    return per.groupBy("tenth", "bin").agg(F.count("*").alias("n"), r6(F.avg("p")).alias("mean_price"), r6(F.avg("won")).alias("win_rate"))


def quick_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape(spark, sf_dir).agg(F.count("*").alias("n"), F.countDistinct("wallet").alias("wallets"), F.countDistinct("token_id").alias("tokens"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.round(F.sum("usdc"), 2).alias("usdc"), r6(F.median("price")).alias("median_price"))


def side_symmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided tape by side, maker and tail."""
    t = tape(spark, sf_dir)
    p = mirrored(F.col("side"), F.col("price"))
    w = F.when(F.col("side") == "BUY", F.col("won")).otherwise(1 - F.col("won"))
    t = t.select("side", "is_maker", p.alias("p"), (w - p).alias("r"), "usdc").withColumn("tail", F.when(F.col("p") <= 0.3, "low").when(F.col("p") >= 0.7, "high").otherwise("middle"))
    return t.groupBy("side", "is_maker", "tail").agg(F.count("*").alias("n"), r6(F.avg("r")).alias("mean_ret"), r6(safe_div(F.sum(F.col("r") * F.col("usdc")), F.sum("usdc"))).alias("mean_ret_usd"))


_MIRROR = "CASE WHEN side = 'BUY' THEN price ELSE 1 - price END AS p, CASE WHEN side = 'BUY' THEN won ELSE 1 - won END AS w"

QUERIES = {
    "bot_flags": (bot_flags, f"WITH {STREAM_SQL}, {_flags_sql(LIMITS)} SELECT wallet, n_trades, active_days, round(per_day, 6) AS per_day, round(median_iti, 3) AS median_iti, round(hour_hhi, 6) AS hour_hhi, round(size_cv, 6) AS size_cv, flag_a_definite, flag_a_likely, flag_b_definite, flag_b_likely, flag_c, flag_e, is_nonhuman FROM flagged"),
    "bot_attrition": (
        bot_attrition,
        f"WITH {STREAM_SQL}, {_flags_sql(LIMITS)} " + " UNION ALL ".join(f"SELECT '{c}' AS criterion, CAST(sum(CAST({c} AS INT)) AS BIGINT) AS wallets, CAST(sum(CASE WHEN {c} THEN n_trades ELSE 0 END) AS BIGINT) AS trades FROM flagged" for c in ("flag_a_definite", "flag_a_likely", "flag_b_definite", "flag_b_likely", "flag_c", "flag_e", "is_nonhuman")),
    ),
    "bot_sensitivity": (
        bot_sensitivity,
        " UNION ALL ".join(
            f"SELECT '{name}' AS variant, CAST(sum(CAST(is_nonhuman AS INT)) AS BIGINT) AS wallets, CAST(sum(CASE WHEN is_nonhuman THEN n_trades ELSE 0 END) AS BIGINT) AS trades FROM (WITH {STREAM_SQL}, {_flags_sql({**LIMITS, 'a_def': LIMITS['a_def'] * k, 'a_lik': LIMITS['a_lik'] * k, 'c': LIMITS['c'] * k})} SELECT * FROM flagged)"
            for name, k in (("tighter", 0.9), ("base", 1.0), ("looser", 1.1))
        ),
    ),
    "trader_profiles": (
        trader_profiles,
        f"""WITH {TAPE_SQL}, p AS (SELECT wallet, count(*) AS n, avg(CAST(side = 'BUY' AS INT)) AS b, arg_min(outcome, struct_pack(a := ts, b := token_id, c := usdc, d := price)) AS first_outcome FROM tape GROUP BY wallet),
c AS (SELECT quantile_cont(log10(n), 0.5) AS p50, quantile_cont(log10(n), 0.9) AS p90, quantile_cont(log10(n), 0.99) AS p99 FROM p),
j AS (SELECT *, CASE WHEN log10(n) <= p50 THEN 'low' WHEN log10(n) <= p90 THEN 'medium' WHEN log10(n) <= p99 THEN 'high' ELSE 'extreme' END AS tier, CASE WHEN b >= 0.95 THEN 'buyer' WHEN b <= 0.05 THEN 'seller' ELSE 'mixed' END AS kind FROM p, c)
SELECT tier, kind, count(*) AS wallets, CAST(sum(n) AS BIGINT) AS trades, CAST(sum(CAST(first_outcome = 'Yes' AS INT)) AS BIGINT) AS first_yes FROM j GROUP BY ALL""",
    ),
    "category_specialization": (
        category_specialization,
        f"""WITH {TAPE_SQL}, p AS (SELECT wallet, category, count(*) AS k FROM tape GROUP BY ALL)
SELECT wallet, arg_max(category, struct_pack(a := k, b := category)) AS main, CAST(sum(k) AS BIGINT) AS n, round(sum(k * k) / pow(sum(k), 2), 6) AS hhi, sum(k * k) / pow(sum(k), 2) > 0.49 AS specialist FROM p GROUP BY wallet""",
    ),
    "flb_segments_two_sided": (
        flb_segments_two_sided,
        f"""WITH {TAPE_SQL}, m AS (SELECT *, {_MIRROR} FROM tape), s AS (SELECT 'maker' AS dim, CAST(is_maker AS VARCHAR) AS value, p, w, usdc FROM m UNION ALL SELECT 'priority', priority, p, w, usdc FROM m UNION ALL SELECT 'side', side, p, w, usdc FROM m)
SELECT dim, value, CAST(floor(p * 10) AS INT) AS bin_idx, count(*) AS n, round(avg(w), 6) AS win_rate, round(avg(w - p), 6) AS mean_ret, round(sum(usdc), 2) AS usdc FROM s GROUP BY ALL""",
    ),
    "flb_contract_intensity": (
        flb_contract_intensity,
        f"""WITH {TAPE_SQL}, p AS (SELECT wallet, market_id, count(*) AS k, sum(won) AS w, sum(ret) AS r, sum(price) AS p FROM tape WHERE side = 'BUY' GROUP BY ALL), c AS (SELECT quantile_cont(k, 0.5) AS p50, quantile_cont(k, 0.9) AS p90 FROM p WHERE k > 1)
SELECT CASE WHEN k = 1 THEN 'one' WHEN k <= p50 THEN 'p50' WHEN k <= p90 THEN 'p90' ELSE 'top' END AS tier, CAST(sum(k) AS BIGINT) AS n, round(sum(w) / sum(k), 6) AS win_rate, round(sum(r) / sum(k), 6) AS mean_ret, round(sum(p) / sum(k), 6) AS mean_price FROM p, c GROUP BY tier""",
    ),
    "flb_experience": (
        flb_experience,
        f"""WITH {TAPE_SQL}, f AS (SELECT wallet, token_id, category, min(ts) AS t, avg(price) AS price, max(won) AS won FROM tape WHERE side = 'BUY' GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY t, token_id) - 1 AS a, row_number() OVER (PARTITION BY wallet, category ORDER BY t, token_id) - 1 AS b FROM f)
SELECT CASE WHEN a = 0 THEN '0' WHEN a <= 2 THEN '1-2' WHEN a <= 5 THEN '3-5' ELSE '6+' END AS experience, CASE WHEN b = 0 THEN '0' WHEN b <= 2 THEN '1-2' WHEN b <= 5 THEN '3-5' ELSE '6+' END AS in_category, count(*) AS n, round(avg(price), 6) AS mean_price, round(avg(won), 6) AS win_rate FROM x GROUP BY ALL""",
    ),
    "cross_substitution": (
        cross_substitution,
        f"""WITH {TAPE_SQL}, d AS (SELECT DISTINCT wallet, category FROM tape WHERE side = 'BUY' AND price < 0.2), p AS (SELECT x.category AS a, y.category AS b, count(*) AS n FROM d x JOIN d y USING (wallet) GROUP BY ALL)
SELECT p.a, p.b, p.n AS "both", round(p.n / o.n, 6) AS overlap FROM p JOIN p o ON o.a = p.a AND o.b = p.a""",
    ),
    "trader_pnl": (
        trader_pnl,
        f"""WITH {TAPE_SQL}, p AS (SELECT wallet, event, token_id, sum(CASE WHEN side = 'BUY' THEN usdc / price ELSE -usdc / price END) AS pos, sum(CASE WHEN side = 'BUY' THEN -usdc ELSE usdc END) AS cash, max(won) AS won FROM tape GROUP BY ALL)
SELECT wallet, event, round(sum(cash), 2) AS cash, round(sum(cash) + sum(pos * won), 7) AS total, CAST(sum(CAST(abs(pos) > 1e-9 AS INT)) AS BIGINT) AS open_tokens FROM p GROUP BY ALL""",
    ),
    "market_outcomes": (
        market_outcomes,
        f"""WITH {TAPE_SQL}, l AS (SELECT token_id, arg_max(price, struct_pack(a := ts, b := usdc, c := price)) AS last FROM tape GROUP BY token_id) SELECT token_id, round(last, 6) AS last, CASE WHEN last >= 0.95 THEN 'yes' WHEN last <= 0.05 THEN 'no' ELSE 'open' END AS state FROM l""",
    ),
    "trader_segments": (
        trader_segments,
        f"""WITH {TAPE_SQL}, p AS (SELECT wallet, sum(usdc) AS volume, avg(price) AS m, avg(price * price) AS mm FROM tape GROUP BY wallet), c AS (SELECT quantile_cont(volume, 0.5) AS p50, quantile_cont(volume, 0.9) AS p90, quantile_cont(volume, 0.99) AS p99 FROM p)
SELECT CASE WHEN volume <= p50 THEN 'bottom' WHEN volume <= p90 THEN 'middle' WHEN volume <= p99 THEN 'top' ELSE 'whale' END AS segment, count(*) AS wallets, round(avg(volume), 2) AS mean_volume, round(avg(sqrt(greatest(mm - m * m, 0))), 6) AS price_sd FROM p, c GROUP BY segment""",
    ),
    "market_timelines": (
        market_timelines,
        f"WITH {STREAM_SQL} SELECT token, CAST(floor(sec / 3600) * 3600 AS BIGINT) AS bucket, count(*) AS n, round(sum(size), 4) AS volume, round(sum(size * size) / nullif(sum(size), 0), 4) AS weighted FROM stream GROUP BY ALL",
    ),
    "monthly_volume": (monthly_volume, f"WITH {TAPE_SQL} SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m') AS month, count(*) AS n, round(sum(usdc), 2) AS usdc, count(DISTINCT wallet) AS wallets, count(DISTINCT market_id) AS markets FROM tape GROUP BY ALL"),
    "closed_markets": (
        closed_markets,
        f"""WITH {TAPE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY token_id ORDER BY ts DESC, usdc DESC, price DESC) AS rn FROM tape), p AS (SELECT token_id, avg(price) AS p, count(*) AS n FROM r WHERE rn <= 10 GROUP BY token_id)
SELECT token_id, n, round(p, 6) AS p, CASE WHEN p >= 0.6 THEN 'up' WHEN p <= 0.4 THEN 'down' ELSE 'open' END AS state FROM p""",
    ),
    "market_accuracy": (
        market_accuracy,
        f"""WITH {TAPE_SQL}, w AS (SELECT *, min(ts) OVER t AS t0, max(ts) OVER t AS t1, count(*) OVER t AS k FROM tape WINDOW t AS (PARTITION BY token_id)),
d AS (SELECT *, CAST(least(floor((ts - t0) * 10 / (t1 - t0)), 9) AS INT) AS tenth FROM w WHERE k >= 15 AND t1 > t0), r AS (SELECT *, row_number() OVER (PARTITION BY token_id, tenth ORDER BY ts DESC, usdc DESC, price DESC) AS rn FROM d),
p AS (SELECT token_id, tenth, avg(price) AS p, max(won) AS won FROM r WHERE rn <= 10 GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY tenth ORDER BY p, token_id) AS number, count(*) OVER (PARTITION BY tenth) AS n FROM p)
SELECT tenth, CAST(CASE WHEN n = 1 THEN 1 ELSE greatest(1, ceil((number - 1) * 10 / (n - 1))) END AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_price, round(avg(won), 6) AS win_rate FROM q GROUP BY ALL""",
    ),
    "quick_stats": (quick_stats, f"WITH {TAPE_SQL} SELECT count(*) AS n, count(DISTINCT wallet) AS wallets, count(DISTINCT token_id) AS tokens, min(ts) AS first, max(ts) AS last, round(sum(usdc), 2) AS usdc, round(median(price), 6) AS median_price FROM tape"),
    "side_symmetry": (
        side_symmetry,
        f"""WITH {TAPE_SQL}, m AS (SELECT *, {_MIRROR} FROM tape) SELECT side, is_maker, CASE WHEN p <= 0.3 THEN 'low' WHEN p >= 0.7 THEN 'high' ELSE 'middle' END AS tail, count(*) AS n, round(avg(w - p), 6) AS mean_ret, round(sum((w - p) * usdc) / nullif(sum(usdc), 0), 6) AS mean_ret_usd FROM m GROUP BY ALL""",
    ),
}
