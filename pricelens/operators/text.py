"""Rule-based templating of slugs and questions, address domains, template audits and term weights, all in built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import r6
from ..sources.tape import read

# League codes, months and patterns that slugs follow.
LEAGUES = (
    "atp nba wta ufc mls nfl lol ucl cs2 crint epl uel fl1 dota2 bun lib valorant j2100 val nhl arg cricipl cfb cricpsl elc bra el1 enl el2 rueuchamp per1 wnba mar1 "
    "crictbcl mlb cruae nwsl crwt20wcgq cbb r6siege rl cricthunderbolt ncaab cru19wc khl dehl bkligend cwbb wttwom bkjpn wttmen snhl cehl bkseriea bkarg bkbbl "
    "lal sea mex tur por j1100 den chi1 kor col bol1 dfb efl aus"
).split()
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
SHORT_MONTHS = "jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec"
YEAR = r"(?:20[0-3]\d)"
TEAM = r"(?=[a-z0-9]*[a-z])[a-z0-9]+"

#: (pattern, replacement), applied in order to the lower-case slug.
SLUG_RULES: tuple[tuple[str, str], ...] = (
    (r"^duplicate-", ""),
    (r"\bwinter-olympics-winter-olympics-", "winter-olympics-"),
    (r"-\d{4}-\d{1,2}-\d{1,2}$", "-<DATE>"),
    (r"(?:-\d{2,}){3,}$", ""),
    (r"(?:-\d+){2,}$", ""),
    (rf"((?:{MONTHS})-\d{{1,2}})-\d{{1,4}}$", "$1"),
    (rf"^({'|'.join(LEAGUES)})-(?:{TEAM}-vs-{TEAM}|{TEAM}-{TEAM})\b", "$1-<TEAM>-<TEAM>"),
    (r"\b\d{1,2}(?:pm|am)(?:-et)?\b", "<TIME>"),
    (rf"\b(?:{MONTHS})-\d{{1,2}}\b(?:-{YEAR})?", "<DATE>"),
    (rf"\b(?:{SHORT_MONTHS})(?=-)", "<DATE>"),
    (rf"\b(?:{YEAR}|{MONTHS}|q[1-4])\b", "<DATE>"),
    (r"\b(?:\d+pt\d+[a-z]?|\d+(?:k|m|b|h|bps|st|nd|rd|th))\b", "<NUM>"),
    (r"\bgame\d+\b", "game-<NUM>"),
    (r"\btop\d+\b", "top<NUM>"),
    (r"\b\d+\b", "<NUM>"),
    (r"(?:<DATE>-)+<DATE>", "<DATE>"),
    (r"(?:<NUM>-)+<NUM>", "<NUM>"),
)


def slug_template(slug: Column) -> Column:
    """The slug's template: dates, times, numbers and teams become placeholders. Null and empty slugs give ''."""
    start = F.lower(F.trim(F.coalesce(slug, F.lit(""))))
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), SLUG_RULES, start)


def strip_placeholders(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)<(DATE|TIME|NUM|TEAM)>", ""), r"\s+", " "))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs with dates and numbers, made from parts and orders."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("-", F.translate("p_name", " ", "-"), F.lit("above"), F.col("p_size").cast("string"), F.lit("on"), F.lit("march"), (F.col("p_size") % 28 + 1).cast("string")).alias("slug"))
    games = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat_ws("-", F.element_at(F.array(F.lit("nba"), F.lit("lal"), F.lit("zzz")), (F.col("s_suppkey") % 3 + 1).cast("int")), F.lit("ab"), F.concat(F.lit("c"), F.col("s_nationkey").cast("string")), F.lit("2025"), F.lpad((F.col("s_suppkey") % 12 + 1).cast("string"), 2, "0"), F.lit("07")).alias("slug"))
    return part.unionByName(games)


SLUGS_SQL = """slugs AS (SELECT p_partkey AS id, concat_ws('-', replace(p_name, ' ', '-'), 'above', CAST(p_size AS VARCHAR), 'on', 'march', CAST(p_size % 28 + 1 AS VARCHAR)) AS slug FROM part
  UNION ALL SELECT s_suppkey, concat_ws('-', CASE s_suppkey % 3 WHEN 0 THEN 'nba' WHEN 1 THEN 'lal' ELSE 'zzz' END, 'ab', 'c' || CAST(s_nationkey AS VARCHAR), '2025', lpad(CAST(s_suppkey % 12 + 1 AS VARCHAR), 2, '0'), '07') FROM supplier)"""


def slug_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = slugs(spark, sf_dir).withColumn("template", slug_template(F.col("slug")))
    return t.groupBy("template").agg(F.count("*").alias("n"), F.countDistinct("slug").alias("slugs"), F.min("slug").alias("example"))


_TEMPLATE_SQL = """regexp_replace(regexp_replace(CASE WHEN regexp_matches(slug, '^(nba|lal)-') THEN regexp_extract(slug, '^[a-z]+') || '-<TEAM>-<TEAM>-<DATE>'
  WHEN regexp_matches(slug, '^zzz-') THEN 'zzz-ab-' || string_split(slug, '-')[3] || '-<DATE>' ELSE regexp_replace(regexp_replace(slug, 'march-[0-9]+$', '<DATE>'), '-above-[0-9]+-', '-above-<NUM>-') END, '(<DATE>-)+<DATE>', '<DATE>'), 'x^', '')"""


def template_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old templates (digits only) against new ones: pairs that are unchanged, merged, split or renamed."""
    t = slugs(spark, sf_dir).withColumns({"new": slug_template(F.col("slug")), "old": F.regexp_replace("slug", r"\d+", "<NUM>")})
    pairs = t.groupBy("old", "new").agg(F.count("*").alias("n"))
    a = pairs.groupBy("old").agg(F.count("*").alias("news"))
    b = pairs.groupBy("new").agg(F.count("*").alias("olds"))
    kind = F.when(F.col("old") == F.col("new"), "UNCHANGED").when(F.col("olds") > 1, "MERGE").when(F.col("news") > 1, "SPLIT").otherwise("RENAME")
    return pairs.join(a, "old").join(b, "new").groupBy(kind.alias("kind")).agg(F.count("*").alias("pairs"), F.sum("n").alias("slugs"))


def domain(url: Column) -> Column:
    """The address's host without www., lower-case."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^www\.", "")


def domain_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the class of their host, first match."""
    h = domain(F.col("url"))
    kind = F.when(h.rlike("casino|bet"), "gaming").when(h.rlike(r"^(m|blog)\."), "sub").when(h.endswith(".org"), "org").when(h.endswith(".net"), "net").otherwise("other")
    return read(spark, sf_dir, "pages").select(kind.alias("kind"), h.alias("host"), "page_id").groupBy("kind").agg(F.count("*").alias("pages"), F.countDistinct("host").alias("hosts"))


def text_quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many conversation turns show each flaw, in one pass."""
    t = F.coalesce(F.col("text"), F.lit(""))
    tests = {"double_space": t.contains("  "), "long": F.length(t) > 200, "raw_number": t.rlike("[0-9]{3,}"), "iso_date": t.rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}"), "empty": F.trim(t) == "", "question": t.endswith("?")}
    return read(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"), *[F.sum(v.cast("long")).alias(k) for k, v in tests.items()])


def class_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve heaviest terms of each class (language): term share times log rarity over classes; a top-k report."""
    words = read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("lang", F.explode(F.split(F.col("text"), "[ \n]+")).alias("term")).filter("term <> ''")
    tf = words.groupBy("lang", "term").agg(F.count("*").alias("n"))
    total = tf.groupBy("lang").agg(F.sum("n").alias("total"))
    df = tf.groupBy("term").agg(F.count("*").alias("classes"), F.sum("n").alias("everywhere"))
    mean = total.agg(F.avg("total").alias("mean"))
    w = r6(F.col("n") / F.col("total") * F.log(1 + F.col("mean") / F.col("everywhere")) * 1000)
    j = tf.join(F.broadcast(total), "lang").join(df, "term").crossJoin(F.broadcast(mean)).withColumn("weight", w)
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("weight"), "term"))).filter("rank <= 12").select("lang", "rank", "term", "weight")


def slug_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct questions of each event in order, as one text; a set per event of bounded vocabulary."""
    p = read(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), " || ").alias("text"), F.countDistinct("p_type").alias("questions"))
    return p.withColumnRenamed("p_brand", "event")


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the events' JSON properties, with how often each is there."""
    e = read(spark, sf_dir, "events").select(F.explode(F.json_object_keys("props")).alias("key"))
    return e.groupBy("key").agg(F.count("*").alias("n"))


QUERIES = {
    "slug_templates": (slug_templates, f"WITH {SLUGS_SQL}, t AS (SELECT slug, {_TEMPLATE_SQL} AS template FROM slugs) SELECT template, count(*) AS n, count(DISTINCT slug) AS slugs, min(slug) AS example FROM t GROUP BY template"),
    "template_pairs": (
        template_pairs,
        f"""WITH {SLUGS_SQL}, t AS (SELECT {_TEMPLATE_SQL} AS new, regexp_replace(slug, '[0-9]+', '<NUM>', 'g') AS old FROM slugs), p AS (SELECT old, new, count(*) AS n FROM t GROUP BY ALL), a AS (SELECT old, count(*) AS news FROM p GROUP BY old), b AS (SELECT new, count(*) AS olds FROM p GROUP BY new)
SELECT CASE WHEN old = new THEN 'UNCHANGED' WHEN olds > 1 THEN 'MERGE' WHEN news > 1 THEN 'SPLIT' ELSE 'RENAME' END AS kind, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS slugs FROM p JOIN a USING (old) JOIN b USING (new) GROUP BY kind""",
    ),
    "domain_ladder": (
        domain_ladder,
        r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages)
SELECT CASE WHEN regexp_matches(host, 'casino|bet') THEN 'gaming' WHEN regexp_matches(host, '^(m|blog)\.') THEN 'sub' WHEN host LIKE '%.org' THEN 'org' WHEN host LIKE '%.net' THEN 'net' ELSE 'other' END AS kind, count(*) AS pages, count(DISTINCT host) AS hosts FROM h GROUP BY kind""",
    ),
    "text_quality_flags": (
        text_quality_flags,
        """WITH c AS (SELECT role, coalesce(text, '') AS t FROM conversations) SELECT role, count(*) AS n, count(*) FILTER (contains(t, '  ')) AS double_space, count(*) FILTER (length(t) > 200) AS long, count(*) FILTER (regexp_matches(t, '[0-9]{3,}')) AS raw_number,
  count(*) FILTER (regexp_matches(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) AS iso_date, count(*) FILTER (trim(t) = '') AS empty, count(*) FILTER (t LIKE '%?') AS question FROM c GROUP BY role""",
    ),
    "class_terms": (
        class_terms,
        r"""WITH w AS (SELECT lang, unnest(string_split_regex(text, '[ \n]+')) AS term FROM documents WHERE text IS NOT NULL), t AS (SELECT lang, term, count(*) AS n FROM w WHERE term <> '' GROUP BY ALL), s AS (SELECT lang, sum(n) AS total FROM t GROUP BY lang),
d AS (SELECT term, sum(n) AS everywhere FROM t GROUP BY term), m AS (SELECT avg(total) AS mean FROM s), j AS (SELECT t.lang, t.term, round(n / total * ln(1 + mean / everywhere) * 1000, 6) AS weight FROM t JOIN s USING (lang) JOIN d USING (term), m)
SELECT lang, rank, term, weight FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS INT) AS rank FROM j) WHERE rank <= 12""",
    ),
    "slug_documents": (slug_documents, "SELECT p_brand AS event, array_to_string(list_sort(list(DISTINCT p_type)), ' || ') AS text, count(DISTINCT p_type) AS questions FROM part GROUP BY p_brand"),
    "json_props": (json_props, "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(CAST(props AS JSON))) AS key FROM events) GROUP BY key"),
}
