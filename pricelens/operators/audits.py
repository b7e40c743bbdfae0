"""Appendix tables, audits and contract dimensions over the tape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import ladder, lifecycle, r6, safe_div
from ..sources.tape import TAPE_SQL, read, tape

DAY = 86400
#: Edges of the price classes, and their names.
PRICE_CLASSES = ((0.05, "certain_no"), (0.25, "unlikely"), (0.45, "leaning_no"), (0.55, "toss_up"), (0.75, "leaning_yes"), (0.95, "likely"))
_CLASS_SQL = "CASE " + " ".join(f"WHEN price < {c} THEN '{n}'" for c, n in PRICE_CLASSES) + " ELSE 'certain_yes' END"
_POS_SQL = f"""{TAPE_SQL}, placed AS (SELECT *, (ts - min(ts) OVER t) / greatest(max(ts) OVER t - min(ts) OVER t, 1) AS pos FROM tape WINDOW t AS (PARTITION BY token_id))"""


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape(spark, sf_dir).withColumn("pos", lifecycle())


def postevent_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades by price class and quarter of life, as shares of the class."""
    quarter = F.least(F.floor(F.col("pos") * 4), F.lit(3)).cast("int")
    t = placed(spark, sf_dir).withColumns({"class": ladder(F.col("price"), list(PRICE_CLASSES), "certain_yes"), "quarter": quarter})
    wide = t.groupBy("class").pivot("quarter", [0, 1, 2, 3]).agg(F.count(F.lit(1))).na.fill(0)
    n = sum((F.col(str(k)) for k in range(4)), F.lit(0))
    return wide.select("class", n.cast("long").alias("n"), *[r6(F.col(str(k)) / n).alias(f"q{k + 1}") for k in range(4)])


def postevent_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What six filters of late extreme prices leave: trades, dollars, markets. One scan, filters as columns."""
    t = placed(spark, sf_dir)
    names = [(p, q) for p in (0.05, 0.10, 0.25) for q in (0.9, 0.99)]
    cut = F.explode(F.array(*[F.struct(F.lit(p).alias("edge"), F.lit(q).alias("late")) for p, q in names]))
    t = t.withColumn("f", cut).filter(~(((F.col("price") <= F.col("f.edge")) | (F.col("price") >= 1 - F.col("f.edge"))) & (F.col("pos") >= F.col("f.late"))))
    return t.groupBy("f.edge", "f.late").agg(F.count("*").alias("n"), F.round(F.sum("usdc"), 2).alias("usdc"), F.countDistinct("market_id").alias("markets"))


def lifecycle_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades and dollars in each of 50 stretches of life, with running shares."""
    t = placed(spark, sf_dir).withColumn("bin", F.least(F.floor(F.col("pos") * 50), F.lit(49)).cast("int"))
    per = t.groupBy("bin").agg(F.count("*").alias("n"), F.sum("usdc").alias("usdc"))  # 50 rows
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    return per.select("bin", "n", r6(F.sum("n").over(w) / F.sum("n").over(whole)).alias("running"), r6(F.col("usdc") / F.sum("usdc").over(whole)).alias("usd_share"))


def dropped_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mid-life price class of contracts by whether a late extreme trade was dropped from them."""
    t = placed(spark, sf_dir)
    late = ((F.col("price") >= 0.9) | (F.col("price") <= 0.1)) & (F.col("pos") >= 0.9)
    mid = F.when(F.col("pos").between(0.5, 0.8), F.col("usdc"))
    per = t.groupBy("token_id").agg(F.max(late.cast("int")).alias("dropped"), safe_div(F.sum(F.col("price") * mid), F.sum(mid)).alias("price"), F.max("won").alias("won"))
    c = F.when(F.col("price").isNull(), "none").otherwise(ladder(F.col("price"), list(PRICE_CLASSES), "certain_yes"))
    return per.groupBy("dropped", c.alias("class")).agg(F.count("*").alias("contracts"), r6(F.avg("won")).alias("win_rate"))


def filter_appendix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By category: median price and dollars of winners and losers."""
    t = tape(spark, sf_dir)
    return t.groupBy("category", "won").agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("side") == "BUY", F.col("token_id"))).alias("bought_tokens"), r6(F.median("price")).alias("median_price"), F.round(F.median("usdc"), 3).alias("median_usd"), r6(F.percentile("price", F.lit(0.9))).alias("p90_price"))


def quality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve checks of the tape, one pass, a row each: name and number of offending rows."""
    t = tape(spark, sf_dir)
    c = F.col
    tests = {
        "null_wallet": c("wallet").isNull(), "null_price": c("price").isNull(), "price_low": c("price") <= 0.01, "price_high": c("price") >= 0.99, "price_outside": (c("price") < 0) | (c("price") > 1),
        "no_dollars": c("usdc") <= 0, "self_trade": c("wallet") == c("counterparty"), "bad_side": ~c("side").isin("BUY", "SELL"), "bad_outcome": ~c("outcome").isin("Yes", "No"), "before_launch": c("ts") < 0,
        "large": c("usdc") > 90000, "no_event": F.coalesce(c("event"), F.lit("")) == "",
    }
    one = t.agg(*[F.sum(F.coalesce(v.cast("long"), F.lit(0))).alias(k) for k, v in tests.items()], F.count("*").alias("total"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.col(k).alias("rows"), r6(F.col(k) / F.col("total")).alias("share")) for k in tests])).alias("r")).select("r.*")


def buy_sell_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decile win rates of buys beside sells."""
    t = tape(spark, sf_dir).withColumn("decile", (F.least(F.floor(F.col("price") * 10), F.lit(9)) + 1).cast("int"))
    own = lambda side, c: r6(F.avg(F.when(F.col("side") == side, F.col(c))))
    return t.groupBy("decile").agg(own("BUY", "won").alias("buy_win"), own("SELL", "won").alias("sell_win"), F.sum((F.col("side") == "BUY").cast("long")).alias("buys"), F.sum((F.col("side") == "SELL").cast("long")).alias("sells"))


def window_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts only in the mature window, only in the closing one, or in both."""
    per = placed(spark, sf_dir).filter("side = 'BUY'").groupBy("token_id").agg(F.max(F.col("pos").between(0.25, 0.8).cast("int")).alias("a"), F.max(F.col("pos").between(0.8, 1.0).cast("int")).alias("b"))
    return per.groupBy("a", "b").agg(F.count("*").alias("contracts"))


def contract_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per market: size of its event's family, outcomes, specificity of the question, recurrence."""
    p = read(spark, sf_dir, "part")
    traded = tape(spark, sf_dir).groupBy("market_id").agg(F.countDistinct("token_id").alias("outcomes"))
    w = Window.partitionBy("p_brand")
    p = p.withColumns({"family": F.count("*").over(w), "same_type": F.count("*").over(Window.partitionBy("p_brand", "p_type"))})
    recur = F.when(F.col("same_type") == 1, "single").when(F.col("same_type") <= 10, "some").otherwise("many")
    return p.join(traded, p.p_partkey == traded.market_id).select("market_id", "family", "same_type", recur.alias("recurrence"), "outcomes", F.size(F.split("p_name", " ")).alias("question_words"))


def family_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume tier of markets within and across families: a three-by-three table."""
    per = tape(spark, sf_dir).groupBy("market_id", "event").agg(F.sum("usdc").alias("usd"))
    fam = per.groupBy("event").agg(F.sum("usd").alias("family_usd"))
    own = F.when(F.col("usd") < 400_000, "s").when(F.col("usd") < 550_000, "m").otherwise("l")
    total = F.when(F.col("family_usd") < 36_000_000, "s").when(F.col("family_usd") < 42_000_000, "m").otherwise("l")
    return per.join(fam, "event").groupBy(total.alias("family"), own.alias("market")).agg(F.count("*").alias("markets"), F.round(F.sum("usd"), 1).alias("usd"))


def participant_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns by whether a wallet traded the event before, once or five times at least, against first comers."""
    t = tape(spark, sf_dir).filter("side = 'BUY'")
    w = Window.partitionBy("wallet", "event").orderBy("ts", "token_id", "usdc", "price")
    t = t.withColumn("prior", F.row_number().over(w) - 1)
    group = F.when(F.col("prior") == 0, "first").when(F.col("prior") < 5, "returning").otherwise("regular")
    m = Window.partitionBy("wallet")
    t = t.withColumn("own", F.col("ret") - F.avg("ret").over(m))
    return t.groupBy(group.alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("wallet").alias("wallets"), r6(F.avg("ret")).alias("mean_ret"), r6(F.avg("own")).alias("within_wallet"))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sums rolled up to markets, with the first text that isn't blank."""
    t = tape(spark, sf_dir)
    tok = t.groupBy("market_id", "token_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("side") == "BUY", F.col("usdc")).otherwise(0.0)).alias("usd_buy"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.max("is_maker").alias("any_maker"))
    m = tok.groupBy("market_id").agg(F.count("*").alias("n_tokens"), F.sum("n").alias("n_trades"), F.round(F.sum("usd_buy"), 2).alias("usd_buy"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.bool_or("any_maker").alias("any_maker"))
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("market_id"), F.coalesce(F.nullif(F.trim("p_name"), F.lit("")), F.col("p_type")).alias("text"))
    return m.join(part, "market_id", "left")


QUERIES = {
    "postevent_prices": (
        postevent_prices,
        f"""WITH {_POS_SQL}, g AS (SELECT {_CLASS_SQL} AS class, CAST(least(floor(pos * 4), 3) AS INT) AS quarter FROM placed)
SELECT class, count(*) AS n, """ + ", ".join(f"round(count(*) FILTER (quarter = {k}) / count(*), 6) AS q{k + 1}" for k in range(4)) + " FROM g GROUP BY class",
    ),
    "postevent_filters": (
        postevent_filters,
        f"""WITH {_POS_SQL}, f AS (SELECT * FROM (VALUES (0.05::DOUBLE), (0.10::DOUBLE), (0.25::DOUBLE)) a(edge) CROSS JOIN (VALUES (0.9::DOUBLE), (0.99::DOUBLE)) b(late))
SELECT edge, late, count(*) AS n, round(sum(usdc), 2) AS usdc, count(DISTINCT market_id) AS markets FROM placed, f WHERE NOT ((price <= edge OR price >= 1 - edge) AND pos >= late) GROUP BY ALL""",
    ),
    "lifecycle_shares": (
        lifecycle_shares,
        f"""WITH {_POS_SQL}, g AS (SELECT CAST(least(floor(pos * 50), 49) AS INT) AS bin, count(*) AS n, sum(usdc) AS usdc FROM placed GROUP BY ALL)
SELECT bin, n, round(sum(n) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS running, round(usdc / sum(usdc) OVER (), 6) AS usd_share FROM g""",
    ),
    "dropped_state": (
        dropped_state,
        f"""WITH {_POS_SQL}, p AS (SELECT token_id, max(CAST((price >= 0.9 OR price <= 0.1) AND pos >= 0.9 AS INT)) AS dropped, sum(price * usdc) FILTER (pos BETWEEN 0.5 AND 0.8) / nullif(sum(usdc) FILTER (pos BETWEEN 0.5 AND 0.8), 0) AS price, max(won) AS won FROM placed GROUP BY token_id)
SELECT dropped, CASE WHEN price IS NULL THEN 'none' ELSE {_CLASS_SQL} END AS class, count(*) AS contracts, round(avg(won), 6) AS win_rate FROM p GROUP BY ALL""",
    ),
    "filter_appendix": (
        filter_appendix,
        f"WITH {TAPE_SQL} SELECT category, won, count(*) AS n, count(DISTINCT token_id) FILTER (side = 'BUY') AS bought_tokens, round(median(price), 6) AS median_price, round(median(usdc), 3) AS median_usd, round(quantile_cont(price, 0.9), 6) AS p90_price FROM tape GROUP BY ALL",
    ),
    "quality_audit": (
        quality_audit,
        f"WITH {TAPE_SQL}, n AS (SELECT count(*) AS total FROM tape) "
        + " UNION ALL ".join(
            f"SELECT '{k}' AS \"check\", count(*) AS rows, round(count(*) / max(total), 6) AS share FROM n LEFT JOIN (SELECT 1 AS hit FROM tape WHERE {v}) x ON true WHERE hit = 1"
            for k, v in {
                "null_wallet": "wallet IS NULL", "null_price": "price IS NULL", "price_low": "price <= 0.01", "price_high": "price >= 0.99", "price_outside": "price < 0 OR price > 1", "no_dollars": "usdc <= 0", "self_trade": "wallet = counterparty",
                "bad_side": "side NOT IN ('BUY', 'SELL')", "bad_outcome": "outcome NOT IN ('Yes', 'No')", "before_launch": "ts < 0", "large": "usdc > 90000", "no_event": "coalesce(event, '') = ''",
            }.items()
        ).replace("round(count(*) / max(total), 6)", "coalesce(round(count(*) / max(total), 6), 0)"),
    ),
    "buy_sell_calibration": (
        buy_sell_calibration,
        f"""WITH {TAPE_SQL} SELECT CAST(least(floor(price * 10), 9) + 1 AS INT) AS decile, round(avg(won) FILTER (side = 'BUY'), 6) AS buy_win, round(avg(won) FILTER (side = 'SELL'), 6) AS sell_win, count(*) FILTER (side = 'BUY') AS buys, count(*) FILTER (side = 'SELL') AS sells FROM tape GROUP BY ALL""",
    ),
    "window_overlap": (
        window_overlap,
        f"""WITH {TAPE_SQL}, placed AS (SELECT *, (ts - min(ts) OVER t) / greatest(max(ts) OVER t - min(ts) OVER t, 1) AS pos FROM tape WINDOW t AS (PARTITION BY token_id)), p AS (SELECT token_id, max(CAST(pos BETWEEN 0.25 AND 0.8 AS INT)) AS a, max(CAST(pos BETWEEN 0.8 AND 1.0 AS INT)) AS b FROM placed WHERE side = 'BUY' GROUP BY token_id)
SELECT a, b, count(*) AS contracts FROM p GROUP BY ALL""",
    ),
    "contract_dimensions": (
        contract_dimensions,
        f"""WITH {TAPE_SQL}, t AS (SELECT market_id, count(DISTINCT token_id) AS outcomes FROM tape GROUP BY market_id), p AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS family, count(*) OVER (PARTITION BY p_brand, p_type) AS same_type FROM part)
SELECT market_id, family, same_type, CASE WHEN same_type = 1 THEN 'single' WHEN same_type <= 10 THEN 'some' ELSE 'many' END AS recurrence, outcomes, CAST(len(string_split(p_name, ' ')) AS INT) AS question_words FROM p JOIN t ON p_partkey = market_id""",
    ),
    "family_tiers": (
        family_tiers,
        f"""WITH {TAPE_SQL}, p AS (SELECT market_id, event, sum(usdc) AS usd FROM tape GROUP BY ALL), f AS (SELECT event, sum(usd) AS family_usd FROM p GROUP BY event)
SELECT CASE WHEN family_usd < 36000000 THEN 's' WHEN family_usd < 42000000 THEN 'm' ELSE 'l' END AS family, CASE WHEN usd < 400000 THEN 's' WHEN usd < 550000 THEN 'm' ELSE 'l' END AS market, count(*) AS markets, round(sum(usd), 1) AS usd FROM p JOIN f USING (event) GROUP BY ALL""",
    ),
    "participant_splits": (
        participant_splits,
        f"""WITH {TAPE_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY wallet, event ORDER BY ts, token_id, usdc, price) - 1 AS prior, ret - avg(ret) OVER (PARTITION BY wallet) AS own FROM tape WHERE side = 'BUY')
SELECT CASE WHEN prior = 0 THEN 'first' WHEN prior < 5 THEN 'returning' ELSE 'regular' END AS kind, count(*) AS n, count(DISTINCT wallet) AS wallets, round(avg(ret), 6) AS mean_ret, round(avg(own), 6) AS within_wallet FROM w GROUP BY kind""",
    ),
    "universe_markets": (
        universe,
        f"""WITH {TAPE_SQL}, m AS (SELECT market_id, count(DISTINCT token_id) AS n_tokens, count(*) AS n_trades, round(sum(CASE WHEN side = 'BUY' THEN usdc ELSE 0 END), 2) AS usd_buy, min(ts) AS t0, max(ts) AS t1, bool_or(is_maker) AS any_maker FROM tape GROUP BY market_id)
SELECT m.*, coalesce(nullif(trim(p_name), ''), p_type) AS text FROM m LEFT JOIN part ON p_partkey = market_id""",
    ),
}
