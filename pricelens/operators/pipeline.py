"""From raw fills to the trade tape: dedup, token mapping, resolution, maker/taker expansion, flags and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import r6, safe_div
from ..sources.tape import MARKETS_SQL, TAPE_SQL, markets, read, seconds, tape

EXCHANGES = ("1", "2", "3")


def raw_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as chain events: the supplier makes, the customer takes; amounts have six decimals."""
    line, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    price = F.col("l_quantity") / 51.0
    usd = F.rint(F.col("l_extendedprice") * 1_000_000).cast("long")
    tokens = F.rint(F.col("l_extendedprice") * 1_000_000 / price).cast("long")
    token = (F.col("l_partkey") * 2 + F.col("l_linenumber") % 2).cast("string")
    sells = F.col("l_linestatus") == "O"  # the maker holds the token
    return line.join(orders, line.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").alias("transaction_hash"),
        F.col("l_partkey").alias("order_hash"),
        F.col("l_linenumber").alias("log_index"),
        F.col("l_suppkey").cast("string").alias("maker"),
        F.col("o_custkey").cast("string").alias("taker"),
        F.when(sells, token).otherwise("0").alias("maker_asset_id"),
        F.when(sells, F.lit("0")).otherwise(token).alias("taker_asset_id"),
        F.when(sells, tokens).otherwise(usd).alias("maker_amount_filled"),
        F.when(sells, usd).otherwise(tokens).alias("taker_amount_filled"),
        seconds("l_shipdate").alias("ts"),
    )


RAW_SQL = """raw AS (
  SELECT l_orderkey AS transaction_hash, l_partkey AS order_hash, l_linenumber AS log_index, CAST(l_suppkey AS VARCHAR) AS maker, CAST(o_custkey AS VARCHAR) AS taker,
    CASE WHEN l_linestatus = 'O' THEN CAST(l_partkey * 2 + l_linenumber % 2 AS VARCHAR) ELSE '0' END AS maker_asset_id,
    CASE WHEN l_linestatus = 'O' THEN '0' ELSE CAST(l_partkey * 2 + l_linenumber % 2 AS VARCHAR) END AS taker_asset_id,
    CASE WHEN l_linestatus = 'O' THEN CAST(round_even(l_extendedprice * 1000000 / (l_quantity / 51.0), 0) AS BIGINT) ELSE CAST(round_even(l_extendedprice * 1000000, 0) AS BIGINT) END AS maker_amount_filled,
    CASE WHEN l_linestatus = 'O' THEN CAST(round_even(l_extendedprice * 1000000, 0) AS BIGINT) ELSE CAST(round_even(l_extendedprice * 1000000 / (l_quantity / 51.0), 0) AS BIGINT) END AS taker_amount_filled,
    CAST(epoch(l_shipdate) AS BIGINT) AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def dedup(df: DataFrame) -> DataFrame:
    """Without mirror events (the taker is an exchange); of equal (transaction, order) the lowest log index. A minimum
    over a struct is summed per task before the shuffle, so a key with many repeats costs little."""
    rest = [c for c in df.columns if c not in ("transaction_hash", "order_hash")]
    own = df.filter(~F.lower("taker").isin(*EXCHANGES))
    least = own.groupBy("transaction_hash", "order_hash").agg(F.min(F.struct("log_index", *[c for c in rest if c != "log_index"])).alias("r"))
    return least.select("transaction_hash", "order_hash", "r.*")


def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(raw_fills(spark, sf_dir))


_DEDUP_SQL = f"""deduped AS (SELECT * EXCLUDE (k) FROM (
  SELECT *, row_number() OVER (PARTITION BY transaction_hash, order_hash ORDER BY log_index, maker, taker, maker_asset_id, taker_asset_id, maker_amount_filled, taker_amount_filled, ts) AS k
  FROM raw WHERE lower(taker) NOT IN ({", ".join(f"'{x}'" for x in EXCHANGES)})) WHERE k = 1)"""


def token_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each outcome token of a market."""
    m = markets(spark, sf_dir)
    both = F.array(F.struct(F.lit("Yes").alias("outcome"), F.lit(0).alias("k")), F.struct(F.lit("No").alias("outcome"), F.lit(1).alias("k")))
    wide = m.withColumn("o", F.explode(both))
    return wide.select((F.col("market_id") * 2 + F.col("o.k")).cast("string").alias("token_id"), F.col("market_id").alias("condition_id"), F.col("o.outcome").alias("outcome"), F.col("event").alias("event_slug"), "question", "winning_outcome")


_TOKENS_ONLY_SQL = """tokens AS (
  SELECT CAST(market_id * 2 + k AS VARCHAR) AS token_id, market_id AS condition_id, outcome, event AS event_slug, question, winning_outcome
  FROM markets CROSS JOIN (VALUES ('Yes', 0), ('No', 1)) v(outcome, k))"""
_TOKENS_SQL = f"{MARKETS_SQL}, {_TOKENS_ONLY_SQL}"


def mapped(fills: DataFrame, tokens: DataFrame) -> DataFrame:
    """Fills with their token's market and the side that holds it. One join on the token either side names: exactly one
    side is cash."""
    key = F.when(F.col("maker_asset_id") != "0", F.col("maker_asset_id")).otherwise(F.col("taker_asset_id"))
    side = F.when(F.col("maker_asset_id") != "0", "maker").when(F.col("taker_asset_id") != "0", "taker")
    return fills.withColumns({"token_id": key, "token_side": side}).join(tokens, "token_id", "left").withColumn("token_side", F.when(F.col("condition_id").isNotNull(), F.col("token_side")))


def token_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the mapping by side and event."""
    m = mapped(raw_fills(spark, sf_dir), token_map(spark, sf_dir))
    return m.groupBy("token_side", "event_slug").agg(F.count("*").alias("n"), F.countDistinct("token_id").alias("tokens"), F.sum("maker_amount_filled").alias("maker_sum"))


def expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tape rows for each fill, from one scan: the holder of the token sells it, the other buys."""
    m = mapped(dedup(raw_fills(spark, sf_dir)), token_map(spark, sf_dir)).filter("condition_id IS NOT NULL")
    holds = F.col("token_side") == "maker"
    usd = F.when(holds, F.col("taker_amount_filled")).otherwise(F.col("maker_amount_filled")) / 1e6
    size = F.when(holds, F.col("maker_amount_filled")).otherwise(F.col("taker_amount_filled")) / 1e6
    m = m.withColumns({"usdc": usd, "price": safe_div(usd, size)}).filter("price > 0 AND price <= 1")
    maker = F.struct(F.col("maker").alias("wallet"), F.when(holds, "SELL").otherwise("BUY").alias("side"), F.lit(True).alias("is_maker"), F.col("taker").alias("counterparty"))
    taker = F.struct(F.col("taker").alias("wallet"), F.when(holds, "BUY").otherwise("SELL").alias("side"), F.lit(False).alias("is_maker"), F.col("maker").alias("counterparty"))
    wide = m.withColumn("o", F.explode(F.array(maker, taker)))
    return wide.select("o.wallet", "ts", "token_id", "condition_id", r6(F.col("usdc")).alias("usdc"), r6(F.col("price")).alias("price"), "o.side", "outcome", "winning_outcome", "event_slug", "o.is_maker", "o.counterparty", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM").alias("year_month"))


_EXPAND_SQL = f"""{RAW_SQL}, {_DEDUP_SQL}, {_TOKENS_SQL},
m AS (SELECT d.*, t.*, CASE WHEN maker_asset_id <> '0' THEN 'maker' ELSE 'taker' END AS token_side FROM deduped d JOIN tokens t ON t.token_id = CASE WHEN maker_asset_id <> '0' THEN maker_asset_id ELSE taker_asset_id END),
p AS (SELECT *, CASE WHEN token_side = 'maker' THEN taker_amount_filled ELSE maker_amount_filled END / 1e6 AS usdc, CASE WHEN token_side = 'maker' THEN maker_amount_filled ELSE taker_amount_filled END / 1e6 AS size FROM m),
q AS (SELECT *, usdc / nullif(size, 0) AS price FROM p),
expanded AS (
  SELECT maker AS wallet, ts, token_id, condition_id, round(usdc, 6) AS usdc, round(price, 6) AS price, CASE WHEN token_side = 'maker' THEN 'SELL' ELSE 'BUY' END AS side, outcome, winning_outcome, event_slug, true AS is_maker, taker AS counterparty, strftime(make_timestamp(ts * 1000000), '%Y-%m') AS year_month FROM q WHERE price > 0 AND price <= 1
  UNION ALL
  SELECT taker, ts, token_id, condition_id, round(usdc, 6), round(price, 6), CASE WHEN token_side = 'maker' THEN 'BUY' ELSE 'SELL' END, outcome, winning_outcome, event_slug, false, maker, strftime(make_timestamp(ts * 1000000), '%Y-%m') FROM q WHERE price > 0 AND price <= 1)"""


def tape_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = expand(spark, sf_dir)
    return e.groupBy("year_month", "side", "is_maker").agg(F.count("*").alias("n"), F.round(F.sum("usdc"), 2).alias("usdc"), F.countDistinct("wallet").alias("wallets"), F.round(F.avg("price"), 4).alias("price"))


def resolutions_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_map(spark, sf_dir).select("token_id", "winning_outcome").distinct()


def clean_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct rows and removed rows of each month."""
    t = tape(spark, sf_dir).withColumn("year_month", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM"))
    keys = ["wallet", "ts", "token_id", "usdc", "price", "side", "outcome", "is_maker", "counterparty"]
    per = t.groupBy("year_month", *keys).agg(F.count("*").alias("k"))
    return per.groupBy("year_month").agg(F.sum("k").alias("n_raw"), F.count("*").alias("n_clean"), F.sum(F.col("k") - 1).alias("n_removed"))


def raw_clean_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per category: trades before and after the extreme-price filter, full outer."""
    t = tape(spark, sf_dir)
    a = t.groupBy("category").agg(F.count("*").alias("n_raw"), F.round(F.sum("usdc"), 2).alias("usd_raw"))
    b = t.filter("price > 0.1 AND price < 0.9").groupBy("category").agg(F.count("*").alias("n_clean"), F.round(F.sum("usdc"), 2).alias("usd_clean"))
    j = a.join(b, "category", "full")
    return j.withColumn("drop_share", r6(1 - F.coalesce(F.col("n_clean"), F.lit(0)) / F.nullif(F.col("n_raw"), F.lit(0))))


def market_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with their market's flag, from the question or the category; traded tokens without a flag are counted."""
    flagged = F.lower(F.coalesce("question", F.lit(""))).rlike("green|blue") | F.coalesce("event_slug", F.lit("")).endswith("5")
    tokens = token_map(spark, sf_dir).withColumn("is_updown", flagged)
    traded = tape(spark, sf_dir).select(F.col("token_id").cast("string").alias("token_id")).distinct()
    return traded.join(tokens, "token_id", "left").groupBy("is_updown", "winning_outcome").agg(F.count("*").alias("tokens"), F.sum(F.col("condition_id").isNull().cast("int")).alias("unmatched"))


def parsed_resolution(closed: Column, prices: Column, outcomes: Column, least: float = 0.99) -> Column:
    """The outcome of a closed market: the one whose price is `least` or more, if it is the only one."""
    wins = F.filter(F.arrays_zip(outcomes.alias("o"), prices.alias("p")), lambda x: x["p"] >= least)
    return F.when(closed & (F.size(wins) == 1) & (F.size(prices) == F.size(outcomes)), wins[0]["o"])


def resolution_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners of parts read as markets whose outcomes and prices are JSON strings."""
    part = read(spark, sf_dir, "part")
    raw = part.select(
        F.col("p_partkey").alias("condition_id"),
        (F.col("p_size") % 5 != 0).alias("closed"),
        F.when(F.col("p_size") % 7 == 0, '["Yes"]').otherwise('["Yes", "No"]').alias("outcomes"),
        F.when(F.col("p_size") % 3 == 0, '["0.995", "0.005"]').when(F.col("p_size") % 3 == 1, '["0.0", "1.0"]').otherwise('["0.5", "0.5"]').alias("prices"),
    )
    names, prices = F.from_json("outcomes", "array<string>"), F.transform(F.from_json("prices", "array<string>"), lambda x: x.try_cast("double"))
    return raw.select("condition_id", parsed_resolution(F.col("closed"), prices, names).alias("winning_outcome")).filter("winning_outcome IS NOT NULL")


def wallet_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expanded trades with realised profit."""
    size = F.col("usdc") / F.col("price")
    won = F.col("outcome") == F.col("winning_outcome")
    pnl = F.when(F.col("side") == "BUY", F.when(won, size - F.col("usdc")).otherwise(-F.col("usdc"))).otherwise(F.when(won, F.col("usdc") - size).otherwise(F.col("usdc")))
    return tape(spark, sf_dir).withColumn("pnl", pnl)


_PNL_SQL = f"""{TAPE_SQL}, wallet_trades AS (SELECT *, CASE WHEN side = 'BUY' THEN CASE WHEN won = 1 THEN usdc / price - usdc ELSE -usdc END ELSE CASE WHEN won = 1 THEN usdc - usdc / price ELSE usdc END END AS pnl FROM tape)"""


def wallet_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wallet_trades(spark, sf_dir).groupBy("wallet", "side").agg(F.count("*").alias("n"), F.round(F.sum("pnl"), 2).alias("pnl"))


def wallet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    correct = F.when((F.col("side") == "BUY") == (F.col("won") == 1), 1).otherwise(0)
    per = wallet_trades(spark, sf_dir).groupBy("wallet").agg(
        F.count("*").alias("trades"), F.sum("usdc").alias("volume"), F.countDistinct("market_id").alias("n_markets"), F.sum("pnl").alias("pnl"),
        F.avg(F.col("is_maker").cast("int")).alias("maker_share"), F.avg(correct).alias("accuracy"), F.countDistinct(F.floor(F.col("ts") / 86400)).alias("active_days"),
    )
    return per.select("wallet", "trades", F.round("volume", 2).alias("volume"), "n_markets", F.round("pnl", 2).alias("pnl"), r6(F.col("maker_share")).alias("maker_share"), r6(F.col("accuracy")).alias("accuracy"), r6(safe_div(F.col("pnl"), F.col("volume"))).alias("roi"), "active_days")


_SUMMARY_SQL = f"""{_PNL_SQL}, ws AS (
  SELECT wallet, count(*) AS trades, round(sum(usdc), 2) AS volume, count(DISTINCT market_id) AS n_markets, round(sum(pnl), 2) AS pnl, round(avg(CAST(is_maker AS INT)), 6) AS maker_share,
    round(avg(CASE WHEN (side = 'BUY') = (won = 1) THEN 1 ELSE 0 END), 6) AS accuracy, round(sum(pnl) / nullif(sum(usdc), 0), 6) AS roi, count(DISTINCT floor(ts / 86400.0)) AS active_days
  FROM wallet_trades GROUP BY wallet)"""


def wallet_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wallets by the first class that fits."""
    s = wallet_summary(spark, sf_dir)
    tpd = F.col("trades") / F.greatest(F.col("active_days"), F.lit(1))
    kind = (
        F.when((tpd > 50) | (F.col("trades") > 1000), "Bot")
        .when((F.col("volume") > 2_000_000) & (F.col("n_markets") >= 5) & (F.col("active_days") > 30), "Sophisticated")
        .when(F.col("trades") >= 10, "Active Retail")
        .when(F.col("trades") >= 2, "Casual")
        .otherwise("One-Shot")
    )
    return s.withColumn("wallet_type", kind).groupBy("wallet_type").agg(F.count("*").alias("wallets"), F.sum("trades").alias("trades"), F.round(F.sum("pnl"), 1).alias("pnl"))


def return_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total = (outcome - fair) + (fair - entry), fair the token's volume-weighted price; means by event."""
    t = tape(spark, sf_dir).filter("side = 'BUY'")
    fair = t.groupBy("token_id").agg(safe_div(F.sum(F.col("price") * F.col("usdc")), F.sum("usdc")).alias("fair"))
    j = t.join(fair, "token_id")
    return j.groupBy("event").agg(r6(F.avg("ret")).alias("total"), r6(F.avg(F.col("won") - F.col("fair"))).alias("selection"), r6(F.avg(F.col("fair") - F.col("price"))).alias("timing"), F.count("*").alias("n"))


def zero_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profit of makers and takers of the expanded tape; together they cancel."""
    e = expand(spark, sf_dir)
    size, won = F.col("usdc") / F.col("price"), F.col("outcome") == F.col("winning_outcome")
    pnl = F.when(F.col("side") == "BUY", F.when(won, size - F.col("usdc")).otherwise(-F.col("usdc"))).otherwise(F.when(won, F.col("usdc") - size).otherwise(F.col("usdc")))
    return e.withColumn("pnl", pnl).groupBy("event_slug").agg(F.abs(F.round(F.sum("pnl"), 2)).alias("net"), F.count("*").alias("n"))


def approx_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real times where known, else the linear estimate from the block number (here: the order key)."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("block"), seconds("o_orderdate").alias("known"))
    guess = F.rint(1667260800 + (F.col("block") - 21_000_000) * 1.676312).cast("long")
    part = o.filter(F.col("block") % 3 != 0).withColumnRenamed("known", "real")
    return o.select("block").join(part, "block", "left").select("block", F.coalesce("real", guess).alias("ts"), F.col("real").isNull().alias("approximate"))


def tape_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of checks over the tape, in one pass."""
    return tape(spark, sf_dir).agg(
        F.count("*").alias("n"), F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"), r6(F.min("price")).alias("price_min"), r6(F.max("price")).alias("price_max"), r6(F.avg("price")).alias("price_mean"),
        F.sum((F.col("side") == "BUY").cast("long")).alias("buys"), F.sum((~F.col("side").isin("BUY", "SELL")).cast("long")).alias("bad_sides"), F.countDistinct("token_id").alias("tokens"),
        F.sum((F.col("price") > 1).cast("long")).alias("bad_prices"),
    )


def top_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten events with the most trades."""
    return tape(spark, sf_dir).groupBy("event").agg(F.count("*").alias("n"), F.round(F.sum("usdc"), 2).alias("usdc")).orderBy(F.desc("n"), "event").limit(10)


def missing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without any line item of flag R: needed minus had."""
    o, line = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    return o.select("o_orderkey").join(line.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


def overlapping_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two shards of the events that overlap in time, joined without repeats: the second is cut at the first's end."""
    e = read(spark, sf_dir, "events").select("event_id", seconds("ts").alias("sec"), "event_type")
    a = e.filter("sec <= 1705363200")
    b = e.filter("sec >= 1705276800")
    both = a.unionByName(b.filter("sec > 1705363200"))
    return both.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"), F.max("sec").alias("last"))


def event_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first question of each event, and its token count: a slug map with backfill coverage."""
    t = token_map(spark, sf_dir)
    first = t.groupBy("event_slug").agg(F.min(F.struct("condition_id", "question")).alias("f"), F.count("*").alias("tokens"))
    return first.select("event_slug", F.col("f.condition_id").alias("condition_id"), F.col("f.question").alias("question"), "tokens")


QUERIES = {
    "dedup_events": (dedup_events, f"WITH {RAW_SQL}, {_DEDUP_SQL} SELECT * FROM deduped"),
    "token_mapping": (
        token_mapping,
        f"""WITH {RAW_SQL}, {_TOKENS_SQL}, j AS (SELECT r.*, t.event_slug, t.condition_id, CASE WHEN maker_asset_id <> '0' THEN maker_asset_id ELSE taker_asset_id END AS tok, CASE WHEN t.condition_id IS NULL THEN NULL WHEN maker_asset_id <> '0' THEN 'maker' WHEN taker_asset_id <> '0' THEN 'taker' END AS token_side
  FROM raw r LEFT JOIN tokens t ON t.token_id = CASE WHEN maker_asset_id <> '0' THEN maker_asset_id ELSE taker_asset_id END)
SELECT token_side, event_slug, count(*) AS n, count(DISTINCT tok) AS tokens, CAST(sum(maker_amount_filled) AS BIGINT) AS maker_sum FROM j GROUP BY ALL""",
    ),
    "tape_expand": (tape_expand, f"WITH {_EXPAND_SQL} SELECT year_month, side, is_maker, count(*) AS n, round(sum(usdc), 2) AS usdc, count(DISTINCT wallet) AS wallets, round(avg(price), 4) AS price FROM expanded GROUP BY ALL"),
    "resolutions_distinct": (resolutions_distinct, f"WITH {_TOKENS_SQL} SELECT DISTINCT token_id, winning_outcome FROM tokens"),
    "clean_distinct": (
        clean_distinct,
        f"""WITH {TAPE_SQL}, t AS (SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m') AS year_month, wallet, ts, token_id, usdc, price, side, outcome, is_maker, counterparty FROM tape),
d AS (SELECT year_month, count(*) AS n_clean FROM (SELECT DISTINCT * FROM t) GROUP BY year_month), r AS (SELECT year_month, count(*) AS n_raw FROM t GROUP BY year_month)
SELECT year_month, n_raw, n_clean, n_raw - n_clean AS n_removed FROM r JOIN d USING (year_month)""",
    ),
    "raw_clean_diff": (
        raw_clean_diff,
        f"""WITH {TAPE_SQL}, a AS (SELECT category, count(*) AS n_raw, round(sum(usdc), 2) AS usd_raw FROM tape GROUP BY category), b AS (SELECT category, count(*) AS n_clean, round(sum(usdc), 2) AS usd_clean FROM tape WHERE price > 0.1 AND price < 0.9 GROUP BY category)
SELECT category, n_raw, usd_raw, n_clean, usd_clean, round(1 - coalesce(n_clean, 0) / nullif(n_raw, 0), 6) AS drop_share FROM a FULL JOIN b USING (category)""",
    ),
    "market_flags": (
        market_flags,
        f"""WITH {TAPE_SQL}, {_TOKENS_ONLY_SQL}, f AS (SELECT *, regexp_matches(lower(coalesce(question, '')), 'green|blue') OR coalesce(event_slug, '') LIKE '%5' AS is_updown FROM tokens)
SELECT is_updown, winning_outcome, count(*) AS tokens, CAST(sum(CAST(condition_id IS NULL AS INT)) AS BIGINT) AS unmatched FROM (SELECT DISTINCT CAST(token_id AS VARCHAR) AS token_id FROM tape) t LEFT JOIN f USING (token_id) GROUP BY ALL""",
    ),
    "resolution_parse": (
        resolution_parse,
        """SELECT p_partkey AS condition_id, CASE WHEN p_size % 3 = 0 THEN 'Yes' ELSE 'No' END AS winning_outcome FROM part WHERE p_size % 5 <> 0 AND p_size % 7 <> 0 AND p_size % 3 <> 2""",
    ),
    "wallet_pnl": (wallet_pnl, f"WITH {_PNL_SQL} SELECT wallet, side, count(*) AS n, round(sum(pnl), 2) AS pnl FROM wallet_trades GROUP BY ALL"),
    "wallet_stats": (wallet_summary, f"WITH {_SUMMARY_SQL} SELECT * FROM ws"),
    "wallet_types": (
        wallet_types,
        f"""WITH {_SUMMARY_SQL}, k AS (SELECT *, CASE WHEN trades / greatest(active_days, 1) > 50 OR trades > 1000 THEN 'Bot' WHEN volume > 2000000 AND n_markets >= 5 AND active_days > 30 THEN 'Sophisticated' WHEN trades >= 10 THEN 'Active Retail' WHEN trades >= 2 THEN 'Casual' ELSE 'One-Shot' END AS wallet_type FROM ws)
SELECT wallet_type, count(*) AS wallets, CAST(sum(trades) AS BIGINT) AS trades, round(sum(pnl), 1) AS pnl FROM k GROUP BY wallet_type""",
    ),
    "return_decomposition": (
        return_decomposition,
        f"""WITH {TAPE_SQL}, t AS (SELECT * FROM tape WHERE side = 'BUY'), f AS (SELECT token_id, sum(price * usdc) / nullif(sum(usdc), 0) AS fair FROM t GROUP BY token_id)
SELECT event, round(avg(ret), 6) AS total, round(avg(won - fair), 6) AS selection, round(avg(fair - price), 6) AS timing, count(*) AS n FROM t JOIN f USING (token_id) GROUP BY event""",
    ),
    "zero_sum": (
        zero_sum,
        f"""WITH {_EXPAND_SQL} SELECT event_slug, abs(round(sum(CASE WHEN side = 'BUY' THEN CASE WHEN outcome = winning_outcome THEN usdc / price - usdc ELSE -usdc END ELSE CASE WHEN outcome = winning_outcome THEN usdc - usdc / price ELSE usdc END END), 2)) AS net, count(*) AS n FROM expanded GROUP BY event_slug""",
    ),
    "approx_time": (
        approx_time,
        """SELECT o_orderkey AS block, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(epoch(o_orderdate) AS BIGINT) ELSE CAST(round_even(1667260800 + (o_orderkey - 21000000) * 1.676312::DOUBLE, 0) AS BIGINT) END AS ts, o_orderkey % 3 = 0 AS approximate FROM orders""",
    ),
    "tape_validation": (
        tape_validation,
        f"""WITH {TAPE_SQL} SELECT count(*) AS n, min(ts) AS ts_min, max(ts) AS ts_max, round(min(price), 6) AS price_min, round(max(price), 6) AS price_max, round(avg(price), 6) AS price_mean, CAST(sum(CAST(side = 'BUY' AS INT)) AS BIGINT) AS buys, CAST(sum(CAST(side NOT IN ('BUY', 'SELL') AS INT)) AS BIGINT) AS bad_sides, count(DISTINCT token_id) AS tokens, CAST(sum(CAST(price > 1 AS INT)) AS BIGINT) AS bad_prices FROM tape""",
    ),
    "top_events": (top_events, f"WITH {TAPE_SQL} SELECT event, count(*) AS n, round(sum(usdc), 2) AS usdc FROM tape GROUP BY event ORDER BY n DESC, event LIMIT 10"),
    "missing_blocks": (missing_blocks, "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"),
    "overlapping_shards": (overlapping_shards, "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, max(CAST(floor(epoch(ts)) AS BIGINT)) AS last FROM events GROUP BY event_type"),
    "event_slugs": (event_slugs, f"WITH {_TOKENS_SQL} SELECT event_slug, min(condition_id) AS condition_id, arg_min(question, condition_id) AS question, count(*) AS tokens FROM tokens GROUP BY event_slug"),
}
