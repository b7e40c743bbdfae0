"""Benchmark decontamination by spaced seeds.

Words are runs of ASCII letters and digits and of characters beyond ASCII; A-Z are lower-cased. Fixed masks over SPAN
words select some places and ignore the others, so a window matches another that differs at ignored places. The masked
windows of the benchmark items are hashed into a table; every masked window of every document is looked up in it (an
equi-join inside the scan, so documents are never shuffled). Each hit fixes an alignment of item and document, which is
verified on the words around it: some stretch of LEAST words, or the whole item if it is shorter, must agree in at least
SHARE of its places.

Every set of three places of SPAN is ignored by some mask, items shorter than SPAN get masks of their own length that
ignore every set of places that may differ, and documents are looked up EDGE places beyond both ends, so each alignment
that the verification accepts is hit.

Benchmark items go to the executors in blocks of at most BLOCK words; a larger benchmark takes a pass for each block.

Defined results: null and empty texts match nothing; items of under SHORT words match nothing and are listed by
unsearched(); repeated rows and items give repeated pairs once for each (document row, item id); columns beside id and
text pass by.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table
from .textkernel import ALNUM, chunks, mix, odd

SPAN = 12
#: Fixed masks: 1 marks a place that must agree. Any three places are ignored by at least one.
MASKS = (
    "000011001111", "001001110011", "001010111100", "010001111100", "010100101011",
    "010111100100", "011010010101", "011101011000", "100101010110", "100110011001",
    "101010101010", "101100100101", "110010110010", "111000001110", "111011000001",
)
LEAST, SHARE, SHORT = 12, 0.75, 5
#: Places of a stretch that may lie beyond a document's ends.
EDGE = LEAST - math.ceil(SHARE * LEAST)
BLOCK = 500_000
#: Places of a chunk whose windows are hashed at once.
PART = 1 << 14
PAIRS = 1 << 20

U64 = np.uint64


def _offsets(mask: str) -> list[int]:
    return [k for k, x in enumerate(mask) if x == "1"]


@cache
def masks(size: int) -> tuple[str, ...]:
    """Masks for a span of size words, SPAN at most: any places that may differ by SHARE are ignored by at least one. Of
    the masks that ignore half of the places, the one that serves most sets of places yet unserved comes next."""
    if size == SPAN:
        return MASKS
    left = {frozenset(x) for x in combinations(range(size), size - math.ceil(SHARE * size))}
    out = []
    while left:
        best = max(combinations(range(size), size // 2), key=lambda gone: sum(x.issubset(gone) for x in left))
        left = {x for x in left if not x.issubset(best)}
        out.append("".join("0" if k in best else "1" for k in range(size)))
    return tuple(out)


def _by_place(wh: np.ndarray) -> list[np.ndarray]:
    """What each word adds to a window's hash at each place."""
    return [wh * U64(odd(64 + k)) for k in range(SPAN)]


def _hash(by_place: list[np.ndarray], places: list[int], span: int) -> np.ndarray:
    """Hash of the selected words of every window of span words."""
    n = max(0, len(by_place[0]) - span + 1)
    out = np.zeros(n, dtype=U64)
    for k in places:
        out += by_place[k][k : k + n]
    return mix(out)


def _padded(words: np.ndarray, bounds: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """words with EDGE places that agree with nothing before and after each row, and the rows' bounds in them."""
    wide = bounds + 2 * EDGE * np.arange(len(bounds))
    out = np.full(wide[-1], U64(odd(0)))
    out[np.arange(len(words)) + EDGE * (2 * row + 1)] = words
    return out, wide


@dataclass(frozen=True)
class Block:
    """Items with their words' hashes, and by (span, places) the sorted hashes of their masked windows, with the item
    and the place in it, and a map of the hashes' first 20 bits."""

    ids: list[int]
    words: np.ndarray
    bounds: np.ndarray
    seeds: list[tuple[int, list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def block(ids: list[int], texts: list[str | None]) -> Block:
    parts = list(chunks(pa.array(texts, pa.string()), size=1 << 62, word=ALNUM))
    words = parts[0].hashes(lower=True) if parts else np.zeros(0, U64)
    bounds = parts[0].bounds if parts else np.zeros(1, np.int64)
    sizes = np.diff(bounds)
    seeds = []
    kinds = [(SPAN, _offsets(m), sizes >= SPAN) for m in MASKS]
    kinds += [(int(n), _offsets(m), sizes == n) for n in np.unique(sizes) if SHORT <= n < SPAN for m in masks(int(n))]
    row = np.repeat(np.arange(len(sizes)), sizes)
    by_place = _by_place(words)
    for span, places, use in kinds:
        h = _hash(by_place, places, span)
        at = np.arange(len(h))
        ok = use[row[: len(h)]] & (at + span <= bounds[1:][row[: len(h)]]) if len(h) else np.zeros(0, bool)
        h, at = h[ok], at[ok]
        order = np.argsort(h, kind="stable")
        there = np.zeros(1 << 20, dtype=bool)
        there[h >> U64(44)] = True
        items = row[at[order]]
        seeds.append((span, places, h[order], items.astype(np.int32), (at[order] - bounds[items]).astype(np.int32), there))
    return Block(ids, words, bounds, seeds)


def _verified(b: Block, words: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, diag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For alignments of items with words[lo:hi] at diag: places that agree, and whether some stretch is alike enough."""
    n = np.diff(b.bounds)[item]
    ends = np.concatenate([[0], np.cumsum(n)])
    k = np.arange(ends[-1]) - np.repeat(ends[:-1], n)
    at = k + np.repeat(diag, n)
    inside = (at >= np.repeat(lo, n)) & (at < np.repeat(hi, n))
    same = inside & (words[np.clip(at, 0, len(words) - 1)] == b.words[k + np.repeat(b.bounds[item], n)])
    sums = np.concatenate([[0], np.cumsum(same)])
    matched = sums[ends[1:]] - sums[ends[:-1]]
    length = np.minimum(n, LEAST)
    window = np.repeat(length, n)
    whole = k + window <= np.repeat(n, n)
    stop = np.minimum(np.arange(len(k)) + window, len(k))
    good = whole & (sums[stop] - sums[np.arange(len(k))] >= np.ceil(SHARE * window))
    return matched, np.add.reduceat(good, ends[:-1]) > 0 if len(n) else np.zeros(0, bool)


def pairs(column: pa.Array, b: Block) -> Iterator[tuple[int, int, int, int]]:
    """(row of the column, place of the item in the block, places that agree, first word of the alignment)."""
    for c in chunks(column, word=ALNUM):
        words = c.hashes(lower=True)
        ends = c.bounds[1:]
        wide, wide_bounds = _padded(words, c.bounds, c.row)
        found = []
        for start in range(0, len(wide), PART):
            by_place = _by_place(wide[start : start + PART + SPAN - 1])
            for span, places, table_, items, offsets, there in b.seeds:
                h = _hash(by_place, places, span)[:PART]
                at = np.flatnonzero(there[h >> U64(44)])
                h, at = h[at], at + start
                inside = at + span <= wide_bounds[np.searchsorted(wide_bounds, at, side="right")]
                h, at = h[inside], at[inside]
                first = np.searchsorted(table_, h, side="left")
                count = np.searchsorted(table_, h, side="right") - first
                at, first, count = at[count > 0], first[count > 0], count[count > 0]
                for x in range(0, len(at), 4096):
                    m = count[x : x + 4096]
                    cut = np.concatenate([[0], np.cumsum(m)])
                    pick = np.arange(cut[-1]) - np.repeat(cut[:-1] - first[x : x + 4096], m)
                    place = np.repeat(at[x : x + 4096], m)
                    row = np.searchsorted(wide_bounds, place, side="right") - 1
                    found.append(np.unique(np.stack([row, items[pick], place - EDGE * (2 * row + 1) - offsets[pick]]), axis=1))
        if not found:
            continue
        row, item, diag = np.unique(np.concatenate(found, axis=1), axis=1)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for x in range(0, len(row), 4096):
            r, i, d = row[x : x + 4096], item[x : x + 4096], diag[x : x + 4096]
            matched, good = _verified(b, words, c.bounds[r], ends[r], i, d)
            for j in np.flatnonzero(good).tolist():
                key, value = (c.first + int(r[j]), int(i[j])), (int(matched[j]), -int(d[j] - c.bounds[r[j]]))
                best[key] = max(best.get(key, value), value)
        for (r, i), (m, d) in best.items():
            yield r, i, m, -d


def blocks(benchmark: DataFrame, most: int = BLOCK) -> Iterator[Block]:
    """The benchmark (item_id, text) in blocks of about `most` words, read one partition at a time."""
    ids: list[int] = []
    texts: list[str | None] = []
    n = 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        size = len((r["text"] or "").split())
        if ids and n + size > most:
            yield block(ids, texts)
            ids, texts, n = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        n += size
    if ids:
        yield block(ids, texts)


def unsearched(benchmark: DataFrame) -> DataFrame:
    """The items too short to be searched, which match nothing: item_id, item_words."""
    schema = "item_id long, item_words long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.diff(c.bounds) for c in chunks(batch.column(1), word=ALNUM)]
            n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["item_id", "item_words"])

    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema).filter(F.col("item_words") < SHORT)


def find(spark: SparkSession, df: DataFrame, benchmark: DataFrame, most: int = BLOCK) -> DataFrame:
    """A row for each document of (doc_id, text) and item whose overlap is verified: doc_id, item_id, matched (places
    that agree on the best alignment), item_words, overlap (their share), first_word (of the alignment in the document;
    may lie before its start)."""
    schema = "doc_id long, item_id long, matched long, item_words long, overlap double, first_word long"
    out = spark.createDataFrame([], schema)
    for own in blocks(benchmark, most):
        shared = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            b = shared.value
            sizes = np.diff(b.bounds)
            for batch in batches:
                docs = batch.column(0)
                rows = [(docs[r].as_py(), b.ids[i], m, int(sizes[i]), m / int(sizes[i]), d) for r, i, m, d in pairs(batch.column(1), b)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                types = (pa.int64(),) * 4 + (pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "matched", "item_words", "overlap", "first_word"])

        out = out.union(df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema))
    return out


def clean(spark: SparkSession, df: DataFrame, benchmark: DataFrame, text: str = "text", most: int = BLOCK) -> DataFrame:
    """df without the rows whose text overlaps with some item."""
    place = df.columns.index(text)
    for own in blocks(benchmark, most):
        shared = spark.sparkContext.broadcast(own)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), dtype=bool)
                keep[[r for r, *_ in pairs(batch.column(place), shared.value)]] = False
                yield batch.filter(pa.array(keep))

        df = df.mapInArrow(run, df.schema)
    return df


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark, documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
