"""Secret scans in DataFrame functions only: fixed patterns and sliding-window Shannon entropy.

Base kinds (assign, access, hex) are leftmost non-overlapping matches of fixed patterns. The method's own kind, entropy,
takes runs of key characters as candidates, slides a window of `window` characters over each, keeps the counts of the
window's characters up to date by one in and one out, and reports the candidate if some window's entropy reaches the
limit of its character class (hex digits; mixed key characters). Candidates that the allow-list knows are suppressed.
Each row costs in proportion to its text, however long a candidate is and however many secrets there are.

Rows are handled on their own: no shuffle. Spans are code points, end exclusive.

Defined results: null or empty text has no spans (empty strings, the digest of the empty string); repeated rows and null
ids give one row each; other columns pass by, and one named like the output is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: The base kinds in their order, pattern, group that is measured, least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs of 24 and more; a shorter run would match and be dropped, and holds no other match.
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
HEX_BITS, MIXED_BITS = 3.0, 3.7
#: Placeholders and counting strings; a candidate that holds one is no secret.
ALLOW = r"(?i)example|placeholder|changeme|your_|dummy|0123456789|abcdefghij|(.)\1{7}"

_SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Bits of a packed count, counts in a long, and the fixed point of the sums of n*log2(n).
_FIELD, _FIELDS, _SCALE = 5, 12, 1 << 40
_KEY_CHARACTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_BLOCK = 128
_CHUNK = 4096


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once, as the variable of a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, join, zero: int) -> Column:
    """Running sums (or maxima) of an array of ints, by blocks, so that no long array is copied for each element."""
    state = F.struct(F.lit(zero).alias("v"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        v = join(acc["v"], x)
        return F.struct(v.alias("v"), F.array_append(acc["out"], v).alias("out"))

    def parts(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _BLOCK).cast("int")), lambda b: F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK)))
        inner = F.transform(blocks, lambda block: F.aggregate(block, state, step, lambda acc: acc["out"]))
        return _bound(inner, whole)

    def whole(inner: Column) -> Column:
        before = lambda acc, block: F.struct(join(acc["v"], F.element_at(block, -1)).alias("v"), F.array_append(acc["out"], acc["v"]).alias("out"))
        bases = F.aggregate(inner, state, before, lambda acc: acc["out"])
        return F.flatten(F.zip_with(inner, bases, lambda block, base: F.transform(block, lambda x: join(base, x))))

    return _bound(values, lambda a: F.when(F.size(a) > 0, parts(a)).otherwise(F.array().cast("array<int>")))


def _spans(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Spans, with what they match, of the matches whose group has `least` characters or more. Between the matches stand
    split()'s pieces, so the running sum of both lengths gives each match's end."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    both = F.zip_with(F.split(text, pattern, -1), matches, lambda gap, m: F.length(gap) + F.coalesce(F.length(m), F.lit(0)))
    rows = F.arrays_zip(matches.alias("match"), measured.alias("part"), _running(both, lambda a, b: a + b, 0).alias("end"))
    found = F.filter(rows, lambda x: F.coalesce(F.length(x["part"]) >= least, F.lit(False)))
    return F.transform(found, lambda x: F.struct((x["end"] - F.length(x["match"])).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["match"].alias("match")))


def _least_sum(candidate: Column, window: int) -> Column:
    """The least sum of n*log2(n), in 1/_SCALE, over the counts n of a window's characters: the window of that sum has
    the candidate's largest entropy, log2(window) - sum / window.

    The characters' counts in the window are fields of longs. A step adds one field and takes one away, and the sum
    follows by differences, so each character costs the same wherever it stands; whole numbers keep the sum exact."""
    xlogx = [round(n * math.log2(n) * _SCALE) if n else 0 for n in range(window + 2)]
    #: What the sum gains when a count n grows, and what it loses when a count n shrinks.
    grows = F.array(*[F.lit(xlogx[n + 1] - xlogx[n]).cast("long") for n in range(window + 1)])
    shrinks = F.array(*[F.lit(xlogx[n] - xlogx[n - 1] if n else 0).cast("long") for n in range(window + 1)])
    words = -(-len(_KEY_CHARACTERS) // _FIELDS)
    place = [0] * 128
    for k, c in enumerate(_KEY_CHARACTERS):
        place[ord(c)] = k
    places = F.array(*[F.lit(k) for k in place])
    none = F.lit(-1)

    def steps(codes: Column) -> Column:
        def one(new: Column, i: Column) -> Column:
            old = F.when(i >= window, F.element_at(codes, i - window + 1)).otherwise(none)
            word = lambda c: F.when(c < 0, F.lit(0)).otherwise(F.floor(c / _FIELDS).cast("int"))
            # Without a character that goes, the field beyond the last, which stays empty.
            shift = lambda c: F.when(c < 0, F.lit(_FIELDS * _FIELD)).otherwise(F.pmod(c, F.lit(_FIELDS)) * _FIELD).cast("int")
            return _bound(old, lambda o: F.struct((new == o).alias("same"), (i + 1 >= window).alias("whole"), word(new).alias("nw"), shift(new).alias("ns"), word(o).alias("ow"), shift(o).alias("os"), (o >= 0).alias("goes")))

        return F.transform(codes, one)

    def bit(shift: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), shift)

    def count(counts: Column, word: Column, shift: Column) -> Column:
        field = F.call_function("shiftrightunsigned", F.element_at(counts, word + 1), shift)
        return field.bitwiseAND(F.lit((1 << _FIELD) - 1).cast("long")).cast("int")

    def step(acc: Column, x: Column) -> Column:
        gain = F.element_at(grows, count(acc["counts"], x["nw"], x["ns"]) + 1)
        loss = F.element_at(shrinks, count(acc["counts"], x["ow"], x["os"]) + 1)
        moved = F.transform(acc["counts"], lambda c, k: c + F.when(k == x["nw"], bit(x["ns"])).otherwise(F.lit(0).cast("long")) - F.when((k == x["ow"]) & x["goes"], bit(x["os"])).otherwise(F.lit(0).cast("long")))
        total = F.when(x["same"], acc["total"]).otherwise(acc["total"] + gain - loss)
        return F.struct(F.when(x["same"], acc["counts"]).otherwise(moved).alias("counts"), total.alias("total"), F.when(x["whole"], F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))

    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), F.lit(0).cast("long").alias("total"), F.lit((1 << 63) - 1).cast("long").alias("least"))
    codes = F.transform(F.split(candidate, ""), lambda c: F.element_at(places, F.ascii(c) + 1))
    return F.aggregate(_bound(codes, steps), zero, step, lambda acc: acc["least"])


def _entropy_spans(text: Column, window: int, hex_bits: float, mixed_bits: float) -> Column:
    if not 1 < window < 1 << _FIELD:
        raise ValueError(f"window must be from 2 to {(1 << _FIELD) - 1}")
    most = lambda bits: F.lit(math.floor((math.log2(window) - bits) * window * _SCALE)).cast("long")

    def keep(s: Column) -> Column:
        c = s["match"]
        mixed = c.rlike("[0-9]") & c.rlike("[A-Za-z]") & ~c.rlike(ALLOW)
        limit = F.when(c.rlike("^[0-9A-Fa-f]+$"), most(hex_bits)).otherwise(most(mixed_bits))
        return F.when(mixed, _least_sum(c, window) <= limit).otherwise(F.lit(False))

    return F.filter(_spans(text, CANDIDATE.replace("20", str(window)), KINDS.index("entropy"), 0, window), keep)


def spans(text: Column, window: int = WINDOW, hex_bits: float = HEX_BITS, mixed_bits: float = MIXED_BITS) -> Column:
    """The text's secrets: structs (start, kind, end) ordered by start and kind; kind is the place in KINDS.

    Cheap substring tests come first, so that only rows that can hold a kind pay for its pattern."""
    t, none = F.coalesce(text.cast("string"), F.lit("")), F.array().cast(_SPANS)
    low = F.lower(t)
    assign = F.lit(False)
    for key in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        assign = assign | low.contains(key)
    bare = lambda found: F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    parts = [
        F.when(assign, bare(_spans(t, ASSIGN, 0, 2, 6))).otherwise(none),
        F.when(t.contains("AKIA"), bare(_spans(t, ACCESS, 1, 0, 20))).otherwise(none),
        F.when(t.rlike("[0-9a-f]{24}"), bare(_spans(t, HEX, 2, 0, 24))).otherwise(none),
        F.when(t.rlike(CANDIDATE.replace("20,", str(window))), bare(_entropy_spans(t, window, hex_bits, mixed_bits))).otherwise(none),
    ]
    return F.array_sort(F.concat(*parts))


def find(df: DataFrame, text: str = "text", out: str = "secrets", **limits: float) -> DataFrame:
    """df with the column `out` of its spans, in place of a column of that name."""
    return df.withColumn(out, spans(F.col(f"`{text}`"), **limits))


def spans_string(found: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """The text with each stretch that spans (ordered by start) cover replaced by the mask; overlapping and adjacent
    spans count once. The text is cut into chunks first, so what stands between spans is taken from chunks nearby."""
    chunks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _CHUNK), F.lit(0))

    def stretch(cut: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / _CHUNK).cast("int")
        last = F.floor((b - 1) / _CHUNK).cast("int")
        pieces = F.transform(F.slice(cut, first + 1, F.greatest(last - first + 1, F.lit(0))), lambda c, k: _part(c, a - (first + k) * _CHUNK, b - (first + k) * _CHUNK))
        return F.when(a < b, F.array_join(pieces, "")).otherwise(F.lit(""))

    def _part(c: Column, a: Column, b: Column) -> Column:
        lo = F.greatest(a, F.lit(0))
        return F.substr(c, lo + 1, F.least(b, F.lit(_CHUNK)) - lo)

    def pieces(ends: Column, cut: Column) -> Column:
        def one(s: Column, k: Column) -> Column:
            before = F.when(k > 0, F.element_at(ends, F.greatest(k, F.lit(1)))).otherwise(F.lit(0))
            return _bound(before, lambda at: F.when((k == 0) | (s["start"] > at), F.concat(stretch(cut, at, s["start"]), F.lit(mask))).otherwise(F.lit("")))

        return F.concat(F.array_join(F.transform(found, one), ""), stretch(cut, F.element_at(ends, -1), F.length(text)))

    ends = _running(F.transform(found, lambda s: s["end"]), lambda a, b: F.greatest(a, b), 0)
    return F.when(F.size(found) > 0, _bound(ends, lambda e: _bound(chunks, lambda cut: pieces(e, cut)))).otherwise(text)


def redact(df: DataFrame, text: str = "text", mask: str = "[SECRET]", **limits: float) -> DataFrame:
    """df with the secrets in its text masked; all other columns pass by, whatever their names."""
    name = "secrets"
    while name in df.columns:
        name += "_"
    t = F.col(f"`{text}`")
    return find(df, text, name, **limits).withColumn(text, masked(t, F.col(f"`{name}`"), mask)).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = find(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    base = spans_string(F.filter("secrets", lambda s: s["kind"] < 3))
    return df.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), spans_string(F.col("secrets")).alias("spans"))


def sql() -> str:
    """The same rows in DuckDB: places by the lengths of what lies between matches, entropies by whole recounts."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    # RE2 has no back references; runs of one character are listed.
    keys = "abcdefghijklmnopqrstuvwxyz0123456789"
    allow = ALLOW.replace(r"(.)\1{7}", "|".join([f"{c}{{8}}" for c in keys] + [r"\+{8}", "/{8}", "_{8}", "={8}", "-{8}"]))

    def spans(kind: int, pattern: str, group: int, least: int) -> str:
        p = quoted(pattern)
        m, g, s = f"regexp_extract_all(t, {p}, 0)", f"regexp_extract_all(t, {p}, {group})", f"string_split_regex(t, {p})"
        return f"""s{kind} AS (SELECT doc_id, list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
  'start': list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'kind': {kind}, 'size': length(g[i]), 'match': m[i]}}), lambda x: x.size >= {least}) AS f{kind}
  FROM (SELECT doc_id, {m} AS m, {g} AS g, {s} AS s FROM t))"""

    bits = f"list_max(list_transform(range(1, length(x.match) - {WINDOW - 2}), lambda i: list_aggregate(string_split(substr(x.match, i, {WINDOW}), ''), 'entropy')))"
    entropy = f"""list_filter(f3, lambda x: CASE WHEN regexp_matches(x.match, '[0-9]') AND regexp_matches(x.match, '[A-Za-z]') AND NOT regexp_matches(x.match, {quoted(allow)})
  THEN {bits} >= CASE WHEN regexp_full_match(x.match, '[0-9A-Fa-f]+') THEN {HEX_BITS} ELSE {MIXED_BITS} END ELSE false END)"""
    name = "[" + ", ".join(quoted(k) for k in KINDS) + "]"
    text = lambda xs: f"coalesce(array_to_string(list_transform({xs}, lambda x: {name}[x.kind + 1] || ':' || CAST(x.start AS VARCHAR) || ':' || CAST(x.start + length(x.match) AS VARCHAR)), ','), '')"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{spans(0, ASSIGN, 2, 6)}, {spans(1, ACCESS, 0, 20)}, {spans(2, HEX, 0, 24)}, {spans(3, CANDIDATE, 0, WINDOW)},
f AS (SELECT doc_id, f0, f1, f2, {entropy} AS f3 FROM s0 JOIN s1 USING (doc_id) JOIN s2 USING (doc_id) JOIN s3 USING (doc_id)),
o AS (SELECT *, list_sort(f0 || f1 || f2) AS base, list_sort(f0 || f1 || f2 || f3) AS found FROM f)
SELECT doc_id, CAST(len(f0) AS BIGINT) AS n_assign, CAST(len(f1) AS BIGINT) AS n_access, CAST(len(f2) AS BIGINT) AS n_hex, sha256({text("base")}) AS base_sha256, {text("found")} AS spans FROM o"""
