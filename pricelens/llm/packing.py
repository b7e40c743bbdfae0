"""Best-fit packing of documents into sequences, by patterns and non-negative least squares.

1. Every document is tokenized once and cut into pieces; per (task, length) counts are kept, so that each piece has a
   rank among all pieces of its length without any sort of them (counts of earlier tasks by prefix sums, plus the rank
   within the task).
2. The histogram of lengths (at most `size` counts, whatever the corpus) is packed on the driver: patterns of two to MOST
   lengths that fill a sequence or nearly do are enumerated, their repeat counts fitted to the histogram by non-negative
   least squares and rounded down, and what is left is packed best-fit, longest first, many equal pieces at a time.
3. Each piece looks its rank up in the plan and gets its sequence and place.

Defined results: null text counts as empty and holds only the end id; repeated rows are packed each; ids may be null or
repeat; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, release, written
from .textkernel import flat
from .tokens import encoder, tokenizer_path

SIZE, END = 1024, 2
#: Step of the lengths from which patterns of three are enumerated, and documents of a pattern.
STEP, MOST = 16, 6
#: Shares of the fitted repeat counts that are tried.
SHARES = (1.0, 0.75, 0.5, 0.25, 0.0)
#: Text of a slice. A worker holds about 30 times as much while it encodes one, beside other stages' workers.
BYTES = 4 << 20
#: Bytes of words and ids that a worker keeps from slice to slice and task to task, as most words come again.
KEEP = 24 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def slices(column: pa.Array, size: int = BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes of text, one row at least."""
    n, lo = len(column), 0
    _, offsets = flat(column)
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1))
        yield lo, hi
        lo = hi


def pieces(df: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """A row for each piece of each document. Pieces of a longer document have `size` ids, but for the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        e, part, seen = encoder(path, KEEP), TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)

        def cut(b: pa.RecordBatch) -> pa.RecordBatch:
            ids, bounds = e.encode(b.column(1))
            tail = np.array([end], dtype="<u4")
            out: list[list] = [[] for _ in range(7)]
            for k, doc in enumerate(b.column(0).to_pylist()):
                own = np.concatenate([ids[bounds[k] : bounds[k + 1]], tail]).astype("<u4", copy=False)
                n, at = len(own), 0
                first = (n - 1) % size + 1
                for j in range((n - first) // size + 1):
                    stop = first + j * size
                    m = stop - at
                    for column, v in zip(out, (doc, j, at, m, zlib.crc32(own[at:stop]), part, int(seen[m])), strict=True):
                        column.append(v)
                    seen[m] += 1
                    at = stop
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

        for b in batches:
            for lo, hi in slices(b.column(1)):
                made = cut(b.slice(lo, hi - lo))
                release()
                yield made

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def patterns(lengths: list[int], size: int, step: int = STEP, most: int = MOST) -> list[tuple[int, ...]]:
    """Patterns of two to `most` lengths that are there, tightest first: pairs that fill a sequence, triples that do, two of
    them near multiples of step, and for each length and number of documents the one whose others share the rest evenly,
    each as long as fits, so that some room may be left."""
    there, ordered = set(lengths), np.array(sorted(lengths))
    out = {(a, size - a) for a in lengths if size - a <= a and size - a in there}
    coarse = [x for x in lengths if x % step == 0 or len(lengths) <= size // step]
    for i, a in enumerate(coarse):
        for b in coarse[: i + 1]:
            c = size - a - b
            if 0 < c <= b and c in there:
                out.add((a, b, c))
    for a in lengths:
        for m in range(2, most + 1):
            own, left = [a], size - a
            for k in range(m - 1, 0, -1):
                at = int(np.searchsorted(ordered, left if k == 1 else left // k, side="right")) - 1
                if at < 0:
                    break
                own.append(int(ordered[at]))
                left -= own[-1]
            if len(own) == m:
                out.add(tuple(sorted(own, reverse=True)))
    return sorted(out, key=lambda p: (size - sum(p), p))


def fit(histogram: np.ndarray, found: list[tuple[int, ...]], rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that make the patterns' lengths add up to the histogram in least squares, by accelerated
    projected gradient steps."""
    sizes = np.array([len(p) for p in found])
    row, column = np.repeat(np.arange(len(found)), sizes), np.concatenate([np.array(p) for p in found])
    made = lambda x: np.bincount(column, x[row], len(histogram))
    back = lambda r: np.bincount(row, r[column], len(found))
    v = np.ones(len(found))
    for _ in range(30):
        v = back(made(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * float(v @ back(made(v))))
    x = y = np.zeros(len(found))
    t, target = 1.0, histogram.astype(float)
    for _ in range(rounds):
        new = np.maximum(0.0, y + step * back(target - made(y)))
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (before - 1) / t * (new - x)
        x = new
    return x


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, on counts: equal pieces go into the fullest kind of sequence that takes them."""
    gaps: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    gaps[size][()] = int(left.sum())

    def put(kind: tuple[int, ...], n: int, length: int, times: int) -> None:
        if n:
            new = kind + (length,) * times
            room = gaps[size - sum(new)]
            room[new] = room.get(new, 0) + n

    for length in range(size, 0, -1):
        need = int(left[length])
        while need:
            gap = min(g for g, kinds in gaps.items() if g >= length and kinds)
            kind, n = next(iter(gaps[gap].items()))
            q = gap // length
            full = min(n, need // q)
            part = need - full * q if full < n and need - full * q < q else 0
            put(kind, full, length, q)
            put(kind, 1 if part else 0, length, part)
            used = full + (1 if part else 0)
            if used == n:
                del gaps[gap][kind]
            else:
                gaps[gap][kind] = n - used
            need -= full * q + part
    return [(kind, n) for kinds in gaps.values() for kind, n in kinds.items() if kind]


def fitted(left: np.ndarray, found: list[tuple[int, ...]], x: np.ndarray, size: int) -> dict[tuple[int, ...], int]:
    """The patterns, x times each (rounded down, and as far as the histogram goes), and what they leave packed best-fit."""
    left, out = left.copy(), defaultdict(int)
    for k in np.lexsort((np.arange(len(x)), -x)):
        if x[k] < 1:
            break
        at, c = np.unique(found[k], return_counts=True)
        n = min(int(x[k]), int((left[at] // c).min()))
        if n > 0:
            out[found[k]] += n
            left[at] -= c * n
    for kind, n in best_fit(left, size):
        out[kind] += n
    return out


def plan(histogram: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of sequences, each a tuple of lengths, and how many there are; together they use the histogram up. Of the fitted
    counts a share is taken (SHARES, the first of equally good ones); none would be best fit alone, so it is never worse."""
    left = histogram.astype(np.int64).copy()
    full = int(left[size])
    left[size] = 0
    found = patterns([int(x) for x in np.flatnonzero(left)], size)
    x = fit(left, found) if found else np.zeros(0)
    out = min((fitted(left, found, share * x, size) for share in SHARES), key=lambda kinds: sum(kinds.values()))
    if full:
        out[(size,)] += full
    return sorted(out.items())


def _places(kinds: list[tuple[tuple[int, ...], int]], size: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: ends of rank ranges, the first sequence of each range, the place in it."""
    by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    base = 0
    for kind, n in kinds:
        at = 0
        for length in kind:
            by[length].append((n, base, at))
            at += length
        base += n
    return {k: (np.cumsum([n for n, _, _ in v]), np.array([b for _, b, _ in v]), np.array([a for _, _, a in v])) for k, v in by.items()}


def pack(spark: SparkSession, df: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for each piece of (doc_id, text)."""
    cut = written(spark, pieces(df, path, size, end), "pieces")
    counts = written(spark, cut.groupBy("length", "part").count(), "counts")
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    histogram = np.zeros(size + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most `size` rows
        histogram[r["length"]] = r["n"]
    places = spark.sparkContext.broadcast(_places(plan(histogram, size), size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            for x in np.unique(length):
                ends, base, at = places.value[int(x)]
                own = np.flatnonzero(length == x)
                k = np.searchsorted(ends, rank[own], side="right")
                sequence[own] = base[k] + rank[own] - np.where(k > 0, ends[k - 1], 0)
                offset[own] = at[k]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    ranked = cut.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("rank")).drop("base", "part")
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
