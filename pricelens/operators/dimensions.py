"""Market dimensions from metadata, verified resolutions, closing prices, liquidity and horizon slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import ladder, price_bin, r6, safe_div
from ..sources.tape import TAPE_SQL, read, tape
from . import stats
from .calibration import FILTERED_SQL, SNAPS, _cube_sql, filtered, snap_table
from .learning import DAY, LIVES_SQL, SPELLS_SQL, as_of, lives_of, market_lives, spells

# Patterns of information types, in order; the first that matches names the group.
INFO_PATTERNS = (
    ("market_data", r"(crypto|stock|equity|forex|fx|commodity|treasury|yield|interest_rate|bond).*?(price|return|level|yield|rate|data)"),
    ("sports_data", r"sports?|game|team|player|league|tournament|match"),
    ("weather_data", r"weather|temperature|rainfall|snow|hurricane|storm"),
    ("awards", r"award|oscar|emmy|grammy|nobel|hall_of_fame|mvp|cup|championship"),
    ("politics_governance", r"election|vote|poll|policy|legislation|congress|senate|president|gov|resignation|appointment"),
    ("culture_media", r"film|movie|music|tv|show|book|art|celebrity|media|streaming"),
)
# Sources that publish prices.
FEEDS = r"chain\.link|binance|pyth|coingecko|coinmarketcap"


def average_ranks(df: DataFrame, value: str, parts: int = 32) -> DataFrame:
    """For each distinct non-null value: its average rank among df's rows (1 up), and their number. Rows are counted by value
    first; values are cut into about `parts` ranges at approximate quantiles, ranked within a range, and ranges start where the
    counts of earlier ones end, so no task holds all values. A value must be exact (no sum of doubles)."""
    per = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("same"))
    cuts = per.agg(F.percentile_approx(value, [k / parts for k in range(1, parts)])).first()[0] or []  # parts - 1 values
    range_of = reduce(lambda a, c: a + (F.col(value) > F.lit(c)).cast("int"), sorted(set(cuts)), F.lit(0))
    per = per.withColumn("range", range_of)
    ends = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = per.groupBy("range").agg(F.sum("same").alias("size"))  # a row for each range
    bases = bases.select("range", F.coalesce(F.sum("size").over(ends), F.lit(0)).alias("base"), F.sum("size").over(Window.partitionBy()).alias("total"))
    before = F.sum("same").over(Window.partitionBy("range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    return per.join(F.broadcast(bases), "range").select(value, (F.col("base") + F.coalesce(before, F.lit(0)) + (F.col("same") + 1) / 2).alias("rank"), "total")


def verified(df: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Closed markets whose two final prices are clean, one at most low and the other at least high. prices and outcomes are
    JSON arrays of two strings; null, blank or malformed ones are no market's proof and go."""
    pair = lambda c: F.from_json(F.when(F.length(F.trim(c)) > 0, F.col(c)), "array<string>")
    at = lambda c, k: F.try_element_at(F.col(c), F.lit(k))
    d = df.filter("closed").withColumns({"p": pair("prices"), "o": pair("outcomes")})
    d = d.select("market_id", *[at("p", k).try_cast("double").alias(f"price{k}") for k in (1, 2)], *[at("o", k).alias(f"outcome{k}") for k in (1, 2)])
    first, second = (F.col("price1") >= high) & (F.col("price2") <= low), (F.col("price1") <= low) & (F.col("price2") >= high)
    return d.filter(first | second).withColumn("winning_outcome", F.when(F.col("price1") >= high, F.col("outcome1")).otherwise(F.col("outcome2")))


def raw_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of markets, from parts: some without prices, undecided, or open."""
    size = F.col("p_size") % 7
    prices = F.when(size == 0, F.lit(None)).when(size == 1, " ").when(size == 2, '["0.5", "0.5"]').when(size == 3, '["x", "1"]').when(size == 4, '["1", "0"]').otherwise('["0.005", "0.995"]')
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("market_id"), prices.alias("prices"), F.lit('["Yes", "No"]').alias("outcomes"), (F.col("p_partkey") % 5 != 0).alias("closed"))


def verified_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(raw_resolutions(spark, sf_dir))


def info_group(text: Column) -> Column:
    """The group of an information type; null, empty and unmatched text is other."""
    out = F.lit("other")
    for name, pattern in reversed(INFO_PATTERNS):
        out = F.when(text.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


WORDS = ("Crypto_spot_price", "stock", "Team", "RAINFALL", "oscar", "poll", "Movie", "steel", "bond_auction_yield", "policy_rate", "mvp_show", "")


def info_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("p_partkey") % len(WORDS) + 1).cast("int"))
    t = read(spark, sf_dir, "part").withColumn("info_type", F.when(F.col("p_size") == 50, F.lit(None)).otherwise(word))
    return t.groupBy(info_group(F.col("info_type")).alias("info_group"), "info_type").agg(F.count("*").alias("n"))


def anchor(source: Column) -> Column:
    """How a market is resolved: by a price feed, by a named source, by none."""
    blank = source.isNull() | (F.trim(source) == "")
    return F.when(blank, "3_unsourced").when(source.rlike(f"(?i){FEEDS}"), "1_priced_feed").otherwise("2_sourced")


def recurrence(step: Column) -> Column:
    intraday, multiday = step.isin("5m", "hourly"), step.isin("weekly", "monthly", "annual")
    return F.when(intraday, "intraday").when(step == "daily", "daily").when(multiday, "multiday").otherwise("one_off")


def feedback_lag(days: Column) -> Column:
    """Right-closed cuts at 1, 7 and 30 days; null stays null."""
    return F.when(days <= 1, "<1d").when(days <= 7, "1-7d").when(days <= 30, "1-4wk").when(days.isNotNull(), ">1mo")


def settled_before(n: Column) -> Column:
    return F.when(n == 0, "0").when(n <= 10, "1-10").when(n <= 100, "11-100").otherwise("100+")


STEPS = ("5m", "hourly", "daily", "weekly", "monthly", "annual", "once")


def native_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchor, recurrence, feedback lag and prior settlements (ties count) of each market's spells of 90 days, each a market of
    its own, as whole lives overlap."""
    step = F.element_at(F.array(*map(F.lit, STEPS)), (F.col("p_size") % len(STEPS) + 1).cast("int"))
    k = F.col("p_size") % 5
    source = F.when(k == 0, F.lit(None)).when(k == 1, " ").when(k == 2, "https://data.Chain.Link/x").when(k == 3, "Binance").otherwise("the league's site")
    meta = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), anchor(source).alias("anchor"), recurrence(step).alias("recurrence"))
    lives = lives_of(spells(tape(spark, sf_dir)))
    prior = as_of(lives, "event", True).select("market_id", settled_before(F.col("before")).alias("prior"))
    lag = feedback_lag((F.col("t1") - F.col("t0")) / DAY)
    return lives.select("market_id", F.floor(F.col("market_id") / 1000).alias("part"), lag.alias("lag")).join(meta, "part").join(prior, "market_id").drop("part")


def family_label(size: Column, span: Column, daily: tuple = (100, 60, 0.5), recurring: tuple = (10, 30)) -> Column:
    """Recurrence of a family of markets from its size and span in days."""
    often = (size >= daily[0]) & (span >= daily[1]) & (size / F.greatest(span, F.lit(1.0)) >= daily[2])
    return F.when(size <= 1, "One-off").when(often, "Daily").when((size >= recurring[0]) & (span >= recurring[1]), "Recurring").otherwise("Episodic")


def family_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families at three widths: type, brand, and both; the tape's lives are long, so the limits differ from the defaults."""
    wide = market_lives(spark, sf_dir).withColumn("family", F.explode(F.array("category", "event", F.concat_ws("|", "category", "event"))))
    per = wide.groupBy("family").agg(F.count("*").alias("size"), ((F.max("t1") - F.min("t0")) / DAY).alias("span"))
    return per.select("family", "size", r6(F.col("span")).alias("span_days"), family_label(F.col("size"), F.col("span"), (80, 60, 0.033), (14, 30)).alias("label"))


def eligible(df: DataFrame, bettors: int = 5, volume: float = 100.0) -> DataFrame:
    """Resolved markets with enough bettors and volume, and a life; 0 and null times are missing."""
    life = (F.col("created") != 0) & (F.col("closed") > F.col("created"))
    return df.filter(F.col("resolution").isin("YES", "NO") & (F.coalesce("bettors", F.lit(0)) >= bettors) & (F.coalesce("volume", F.lit(0.0)) >= volume) & life)


def eligible_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = tape(spark, sf_dir).groupBy("market_id", "wallet").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.sum("usdc").alias("usd"))
    per = per.groupBy("market_id").agg(F.min("t0").alias("created"), F.max("t1").alias("closed"), F.count("*").alias("bettors"), F.round(F.sum("usd"), 2).alias("volume"))
    k = F.col("market_id") % 4
    return eligible(per.withColumn("resolution", F.when(k == 0, "YES").when(k == 1, "NO").when(k == 2, "MKT")), bettors=20)


def cash_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills with cash ('0') on exactly one side, by who pays; asset ids that are null or the text 'nan' are no ids."""
    line = read(spark, sf_dir, "lineitem")
    asset = lambda k: F.when(F.col("l_suppkey") % k == 0, "0").when(F.col("l_suppkey") % 5 == 0, "nan").otherwise(F.concat(F.lit("t"), F.col("l_partkey").cast("string")))
    t = line.select(asset(3).alias("maker_asset"), asset(2).alias("taker_asset"), "l_extendedprice")
    named = F.col("maker_asset").isNotNull() & F.col("taker_asset").isNotNull() & (F.col("maker_asset") != "nan") & (F.col("taker_asset") != "nan")
    t = t.filter(named & ((F.col("maker_asset") == "0") != (F.col("taker_asset") == "0")))
    return t.groupBy(F.when(F.col("maker_asset") == "0", "maker").otherwise("taker").alias("payer")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("usdc"))


def closing_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each token and snap: the price of the last trade at or before the snap (of equal seconds the larger dollars,
    then price). One aggregation by token gives all snaps."""
    snaps = snap_table(spark, sf_dir).groupBy("token_id").agg(*[F.max(F.when(F.col("snap") == s, F.col("snap_ts"))).alias(f"at{k}") for k, s in enumerate(SNAPS)])
    t = tape(spark, sf_dir).select("token_id", "ts", "usdc", "price", "won").join(snaps, "token_id")
    last = [F.max(F.when(F.col("ts") <= F.col(f"at{k}"), F.struct("ts", "usdc", "price")))["price"].alias(f"p{k}") for k in range(len(SNAPS))]
    per = t.groupBy("token_id").agg(F.max("won").alias("won"), *last)
    return per.select("token_id", "won", F.explode(F.array(*[F.struct(F.lit(s).alias("snap"), F.col(f"p{k}").alias("price")) for k, s in enumerate(SNAPS)])).alias("x")).select("token_id", "won", "x.*")


def closing_calibration(spark: SparkSession, sf_dir: str, n_bins: int = 20, near: float = 0.05) -> DataFrame:
    """Bins of closing prices against outcomes by what remains of the life, without nearly resolved ones."""
    c = closing_prices(spark, sf_dir).filter((F.col("price") >= near) & (F.col("price") <= 1 - near))
    label = F.concat(F.round((1 - F.col("snap")) * 100).cast("int").cast("string"), F.lit("% remaining"))
    per = c.groupBy(label.alias("category"), price_bin(F.col("price"), n_bins).alias("bin_idx"))
    ret = F.when(F.col("won") == 1, 1 - F.col("price")).otherwise(-F.col("price"))
    return per.agg(F.count("*").alias("count"), r6(F.avg("price")).alias("mean_implied_prob"), r6(F.avg("won")).alias("empirical_win_rate"), r6(F.avg(ret)).alias("mean_return"))


def liquidity_fifths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifth of each market's dollars (whole cents) by average rank among all markets."""
    m = tape(spark, sf_dir).groupBy("market_id").agg(F.sum(F.round(F.col("usdc") * 100).cast("long")).alias("cents"))
    fifth = F.least(F.greatest(F.ceil(F.col("rank") / F.col("total") * 5), F.lit(1)), F.lit(5)).cast("int")
    return m.join(average_ranks(m, "cents").withColumn("fifth", fifth), "cents").select("market_id", "cents", "fifth")


def liquidity_top_band(spark: SparkSession, sf_dir: str, floor: float = 0.9) -> DataFrame:
    """By fifth of liquidity: what trades at floor or more are and return."""
    t = filtered(spark, sf_dir).join(liquidity_fifths(spark, sf_dir).select("market_id", "fifth"), "market_id")
    top = F.col("price") >= floor
    own = lambda c: F.when(top, c)
    return t.groupBy("fifth").agg(
        F.count(own(F.lit(1))).alias("n"),
        r6(F.count(own(F.lit(1))) / F.count("*")).alias("share_n"),
        r6(F.sum(F.when(top, F.col("usdc")).otherwise(0.0)) / F.sum("usdc")).alias("share_usd"),
        r6(F.avg(own(F.col("price")))).alias("mean_price"),
        r6(F.avg(own(F.col("won")))).alias("win_rate"),
        r6(F.avg(own(F.col("ret")))).alias("cal_err"),
        r6(safe_div(F.sum(own(F.col("usdc") * F.col("won"))), F.sum(own(F.col("usdc"))))).alias("win_rate_dol"),
    )


def slopes(df: DataFrame, label: Column, least: int) -> DataFrame:
    """Slope of return on price in each slice that label (an array) puts a row in, of at least `least` rows."""
    wide = df.withColumn("slice", F.explode(F.array_compact(label)))
    s = stats.clustered_slope(stats.cells(wide, ["slice"], F.lit(1), F.col("price"), F.col("ret")), ["slice"])
    return s.filter(F.col("n") >= least).select("slice", "n", r6(F.col("b")).alias("b"), r6(F.col("se")).alias("se"))


def liquidity_slopes(spark: SparkSession, sf_dir: str, least: int = 50) -> DataFrame:
    """By fifth of liquidity: slopes in three bands of the life, over prices from 0.10 to 0.90, and of all."""
    t = filtered(spark, sf_dir).join(liquidity_fifths(spark, sf_dir).select("market_id", "fifth"), "market_id")
    pos, price = F.col("pos"), F.col("price")
    band = F.when((pos >= 0.25) & (pos < 0.4), "pos25-40").when((pos >= 0.4) & (pos < 0.6), "pos40-60").when((pos >= 0.6) & (pos < 0.8), "pos60-80")
    cuts = F.array(F.lit("all"), F.when((price >= 0.1) & (price <= 0.9), "interior"), band)
    return slopes(t, F.transform(cuts, lambda c: F.concat(F.lit("q"), F.col("fifth").cast("string"), F.lit("|"), c)), least)


def _horizon(t: DataFrame) -> DataFrame:
    days = (F.max("ts").over(Window.partitionBy("market_id")) - F.col("ts")) / DAY
    return t.withColumn("days", days).withColumn("hclass", F.when(F.col("days") <= 1, "a").when(F.col("days") <= 7, "b").when(F.col("days") <= 30, "c").when(F.col("days") <= 120, "d").otherwise("e"))


def pooled_horizons(spark: SparkSession, sf_dir: str, least: int = 50) -> DataFrame:
    """Slopes by time left (to the market's last trade of the mature sample): up to 1, 7, 30, 120 days, more, and pooled. The
    tape is dealt out by market once, for tokens' lives, markets' ends and the cells. Prices are taken from 0.5, so that sums
    of products are small; slopes are the same."""
    t = _horizon(filtered(spark, sf_dir, token=("market_id", "token_id")))
    s = stats.sliced_slopes(t, F.array("hclass", F.lit("pooled")), F.col("price") - 0.5, F.col("ret"))
    return s.filter(F.col("n") >= least).select("slice", "n", r6(F.col("b")).alias("b"), r6(F.col("se")).alias("se"))


def short_composition(spark: SparkSession, sf_dir: str, horizon: str = "a", top: int = 15) -> DataFrame:
    """The report's `top` topics by trades of a horizon, with markets and dollars."""
    t = _horizon(filtered(spark, sf_dir)).filter(F.col("hclass") == horizon)
    per = t.groupBy("event", "outcome", "market_id").agg(F.count("*").alias("k"), F.sum("usdc").alias("usd"))
    per = per.groupBy("event", "outcome").agg(F.sum("k").alias("n"), F.count("*").alias("n_markets"), F.round(F.sum("usd"), 2).alias("usd"))
    return per.orderBy(F.desc("n"), "event", "outcome").limit(top)


def wallet_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary codes of wallets without a window over all of them: codes from 1 in order of the wallet's number."""
    w = tape(spark, sf_dir).select(F.col("wallet").cast("long").alias("number")).distinct()
    return average_ranks(w, "number").select(F.col("number").cast("string").alias("wallet"), F.col("rank").cast("long").alias("code"), ladder(F.col("rank") / F.col("total"), [(0.33, "low"), (0.67, "mid")], "high").alias("band"))


def _info_sql() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(info_type, '{p}', 'i') THEN '{n}'" for n, p in INFO_PATTERNS) + " ELSE 'other' END"


def _list_sql(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_FIFTH_SQL = """m AS (SELECT market_id, CAST(sum(CAST(round(usdc * 100) AS BIGINT)) AS BIGINT) AS cents FROM tape GROUP BY market_id),
fifths AS (SELECT market_id, cents, CAST(least(greatest(ceil((rank() OVER (ORDER BY cents) + (count(*) OVER (PARTITION BY cents) - 1) / 2) / count(*) OVER () * 5), 1), 5) AS INT) AS fifth FROM m)"""
_HORIZON_SQL = f"""h0 AS (SELECT f.*, (e.t_end - f.ts) / {DAY} AS days FROM filtered f JOIN (SELECT market_id, max(ts) AS t_end FROM filtered GROUP BY market_id) e USING (market_id)),
hz AS (SELECT *, CASE WHEN days <= 1 THEN 'a' WHEN days <= 7 THEN 'b' WHEN days <= 30 THEN 'c' WHEN days <= 120 THEN 'd' ELSE 'e' END AS hclass FROM h0)"""


def _slopes_sql(table: str, least: int) -> str:
    return f"""c AS (SELECT slice, day, wallet, market_id, count(*) AS n, sum(price) AS swx, sum(ret) AS swy, sum(price * price) AS swxx, sum(price * ret) AS swxy FROM {table} GROUP BY ALL),
t AS (SELECT slice, sum(n) AS n, sum(swx) / sum(n) AS xb, sum(swy) / sum(n) AS yb, sum(swxx) - pow(sum(swx), 2) / sum(n) AS sxx, sum(swxy) - sum(swx) * sum(swy) / sum(n) AS sxy FROM c GROUP BY slice),
u AS (SELECT *, sxy / sxx AS b, yb - sxy / sxx * xb AS a FROM t WHERE n >= 2 AND sxx > 1e-12),
s AS (SELECT c.*, c.swxy - a * c.swx - b * c.swxx - xb * (c.swy - a * c.n - b * c.swx) AS score FROM c JOIN u USING (slice)),
{_cube_sql("v", "s", "slice", "score")}
SELECT slice, CAST(n AS BIGINT) AS n, round(b, 6) AS b, round(sqrt(greatest(v, 0)) / sxx, 6) AS se FROM u JOIN v USING (slice) WHERE n >= {least}"""


_SNAP_SQL = ", ".join(f"({s}::DOUBLE)" for s in SNAPS)

QUERIES = {
    "verified_markets": (
        verified_markets,
        """SELECT p_partkey AS market_id, CASE WHEN p_size % 7 = 4 THEN 1.0::DOUBLE ELSE 0.005 END AS price1, CASE WHEN p_size % 7 = 4 THEN 0.0::DOUBLE ELSE 0.995 END AS price2,
  'Yes' AS outcome1, 'No' AS outcome2, CASE WHEN p_size % 7 = 4 THEN 'Yes' ELSE 'No' END AS winning_outcome FROM part WHERE p_partkey % 5 <> 0 AND p_size % 7 >= 4""",
    ),
    "info_groups": (
        info_groups,
        f"""WITH t AS (SELECT CASE WHEN p_size = 50 THEN NULL ELSE ({_list_sql(WORDS)})[p_partkey % {len(WORDS)} + 1] END AS info_type FROM part)
SELECT {_info_sql()} AS info_group, info_type, count(*) AS n FROM t GROUP BY ALL""",
    ),
    "native_dimensions": (
        native_dimensions,
        f"""WITH {TAPE_SQL}, {SPELLS_SQL},
p AS (SELECT a.market_id, any_value(a.t1 - a.t0) / {DAY} AS days, count(b.market_id) AS k FROM spell_lives a LEFT JOIN spell_lives b ON a.event = b.event AND b.t1 <= a.t0 GROUP BY a.market_id)
SELECT market_id, CASE WHEN days <= 1 THEN '<1d' WHEN days <= 7 THEN '1-7d' WHEN days <= 30 THEN '1-4wk' ELSE '>1mo' END AS lag,
  CASE p_size % 5 WHEN 2 THEN '1_priced_feed' WHEN 3 THEN '1_priced_feed' WHEN 4 THEN '2_sourced' ELSE '3_unsourced' END AS anchor,
  ['intraday', 'intraday', 'daily', 'multiday', 'multiday', 'multiday', 'one_off'][p_size % 7 + 1] AS recurrence,
  CASE WHEN k = 0 THEN '0' WHEN k <= 10 THEN '1-10' WHEN k <= 100 THEN '11-100' ELSE '100+' END AS prior FROM p JOIN part ON p_partkey = market_id // 1000""",
    ),
    "family_recurrence": (
        family_recurrence,
        f"""WITH {TAPE_SQL}, {LIVES_SQL}, f AS (SELECT unnest([category, event, category || '|' || event]) AS family, t0, t1 FROM lives),
g AS (SELECT family, count(*) AS size, (max(t1) - min(t0)) / {DAY} AS span FROM f GROUP BY family)
SELECT family, size, round(span, 6) AS span_days, CASE WHEN size <= 1 THEN 'One-off' WHEN size >= 80 AND span >= 60 AND size / greatest(span, 1) >= 0.033 THEN 'Daily'
  WHEN size >= 14 AND span >= 30 THEN 'Recurring' ELSE 'Episodic' END AS label FROM g""",
    ),
    "eligible_markets": (
        eligible_markets,
        f"""WITH {TAPE_SQL} SELECT market_id, min(ts) AS created, max(ts) AS closed, count(DISTINCT wallet) AS bettors, round(sum(usdc), 2) AS volume, CASE market_id % 4 WHEN 0 THEN 'YES' ELSE 'NO' END AS resolution
FROM tape WHERE market_id % 4 IN (0, 1) GROUP BY market_id HAVING count(DISTINCT wallet) >= 20 AND sum(usdc) >= 100 AND max(ts) > min(ts)""",
    ),
    "cash_sides": (
        cash_sides,
        """SELECT CASE WHEN l_suppkey % 3 = 0 THEN 'maker' ELSE 'taker' END AS payer, count(*) AS n, round(sum(l_extendedprice), 2) AS usdc FROM lineitem
WHERE (l_suppkey % 3 = 0) <> (l_suppkey % 2 = 0) AND l_suppkey % 5 <> 0 GROUP BY 1""",
    ),
    "closing_calibration": (
        closing_calibration,
        f"""WITH {TAPE_SQL}, w AS (SELECT token_id, min(ts) AS a, max(ts) AS b FROM tape GROUP BY token_id HAVING count(*) >= 10 AND max(ts) - min(ts) >= 86400),
x AS (SELECT token_id, snap, a + CAST(snap * (b - a) AS BIGINT) AS until FROM w CROSS JOIN (VALUES {_SNAP_SQL}) v(snap)),
c AS (SELECT snap, price, won FROM x JOIN tape USING (token_id) WHERE ts <= until QUALIFY row_number() OVER (PARTITION BY token_id, snap ORDER BY ts DESC, usdc DESC, price DESC) = 1)
SELECT CAST(CAST(round((1 - snap) * 100) AS INT) AS VARCHAR) || '% remaining' AS category, CAST(floor(price * 20) AS INT) AS bin_idx, count(*) AS count, round(avg(price), 6) AS mean_implied_prob,
  round(avg(won), 6) AS empirical_win_rate, round(avg(won - price), 6) AS mean_return FROM c WHERE price >= 0.05 AND price <= 0.95 GROUP BY ALL""",
    ),
    "liquidity_fifths": (liquidity_fifths, f"WITH {TAPE_SQL}, {_FIFTH_SQL} SELECT * FROM fifths"),
    "liquidity_top_band": (
        liquidity_top_band,
        f"""WITH {FILTERED_SQL}, {_FIFTH_SQL}, j AS (SELECT *, price >= 0.9 AS top FROM filtered JOIN fifths USING (market_id))
SELECT fifth, count(*) FILTER (top) AS n, round(count(*) FILTER (top) / count(*), 6) AS share_n, round(sum(CASE WHEN top THEN usdc ELSE 0 END) / sum(usdc), 6) AS share_usd, round(avg(price) FILTER (top), 6) AS mean_price,
  round(avg(won) FILTER (top), 6) AS win_rate, round(avg(ret) FILTER (top), 6) AS cal_err, round(sum(usdc * won) FILTER (top) / sum(usdc) FILTER (top), 6) AS win_rate_dol FROM j GROUP BY fifth""",
    ),
    "liquidity_slopes": (
        liquidity_slopes,
        f"""WITH {FILTERED_SQL}, {_FIFTH_SQL}, j AS (SELECT * FROM filtered JOIN fifths USING (market_id)),
k AS (SELECT *, 'q' || fifth || '|all' AS slice FROM j UNION ALL SELECT *, 'q' || fifth || '|interior' FROM j WHERE price BETWEEN 0.1 AND 0.9
  UNION ALL SELECT *, 'q' || fifth || CASE WHEN pos < 0.4 THEN '|pos25-40' WHEN pos < 0.6 THEN '|pos40-60' ELSE '|pos60-80' END FROM j WHERE pos >= 0.25 AND pos < 0.8),
{_slopes_sql("k", 50)}""",
    ),
    "pooled_horizons": (
        pooled_horizons,
        f"WITH {FILTERED_SQL}, {_HORIZON_SQL}, k AS (SELECT *, hclass AS slice FROM hz UNION ALL SELECT *, 'pooled' FROM hz), {_slopes_sql('k', 50)}",
    ),
    "short_composition": (
        short_composition,
        f"""WITH {FILTERED_SQL}, {_HORIZON_SQL} SELECT event, outcome, count(*) AS n, count(DISTINCT market_id) AS n_markets, round(sum(usdc), 2) AS usd FROM hz WHERE hclass = 'a'
GROUP BY ALL ORDER BY n DESC, event, outcome LIMIT 15""",
    ),
    "wallet_codes": (
        wallet_codes,
        f"""WITH {TAPE_SQL}, d AS (SELECT DISTINCT wallet FROM tape), r AS (SELECT wallet, row_number() OVER (ORDER BY CAST(wallet AS BIGINT)) AS code, count(*) OVER () AS total FROM d)
SELECT wallet, code, CASE WHEN code / total < 0.33 THEN 'low' WHEN code / total < 0.67 THEN 'mid' ELSE 'high' END AS band FROM r""",
    ),
}
