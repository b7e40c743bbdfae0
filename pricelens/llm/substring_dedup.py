"""Removal of repeated word windows, with a count-min prefilter.

A window is `size` consecutive words of one document; a word goes if some window over it also starts earlier (in a
smaller document, or earlier in the same one), judged on the input. Everything is exact but for equal 128-bit hashes of
different windows.

First pass: which windows are estimated repeated. A window is counted by its minimizer, the least hash of its runs of
`gram` words, so neighbouring windows share a count: a run of windows with one minimizer is counted once. Two places of a
window have minimizers at two places, so a count is never below the count of any of its windows. Each task sums its runs
into partial count-min sketches, one for each hash range (two rows of saturated counts, only the touched cells), which
are sent to the range's task and merged there, with the runs whose cells they are. A run whose cells are repeated in the partial sketch already is known to
be repeated; all other runs are looked up in the merged sketch by the task that holds it. So a very frequent passage
sends a cell from each task, not a row for each place, no sketch is broadcast, and a sketch's size doesn't grow: the
number of ranges does, with the bytes of text (`fill` and `density`).

Second pass: the runs estimated repeated are joined to their documents, and their windows are grouped exactly, in the
same ranges. Each task first settles what it can alone: of equal windows in its buffer all but the first are known to be
later, and only the first is sent on. What isn't the first of its kind goes back to its document as bit masks.

Defined results: null, empty and short texts lose nothing. Rows with one doc_id count as one document: a place of it is
not earlier than the same place in its other rows, so repeated rows come out alike; should their texts differ, a place
found to be a later one in either is taken out of both. A row without an id has no place in the order of documents: it
loses nothing, and nothing is later than it. Columns beside id and text aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .textkernel import CHUNK, Chunk, chunks, mix, odd, powers

U64 = np.uint64
#: Bits of a run that hold its number of windows, and those that hold its first word and that number.
_LENGTH, _PLACE = 4, 32
#: Rows of an output batch.
_BATCH = 1 << 18


@dataclass(frozen=True)
class Settings:
    """size: words of a window; gram: words of a minimizer's runs; cells: of each row of a range's sketch, a power of two;
    fill: runs that are to share a cell on average; density: runs in a byte of text (0.025 in prose); ranges: a power of
    two (0: by the bytes of text, and no fewer than shuffle partitions); chunk: bytes of text handled at once; runs,
    windows: held by a task before it sends; settle: windows of a range that are sorted at once."""

    size: int = 20
    gram: int = 8
    cells: int = 1 << 20
    fill: float = 0.125
    density: float = 0.03
    ranges: int = 0
    chunk: int = CHUNK
    runs: int = 1 << 18
    windows: int = 1 << 18
    settle: int = 1 << 20


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of equal neighbours."""
    if not len(values):
        return []
    at = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip([0, *at.tolist()], [*at.tolist(), len(values)], strict=True))


def _windows(wh: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of every n consecutive words."""
    up, down = powers(seed)
    total = np.zeros(len(wh) + 1, dtype=U64)
    np.cumsum(mix(wh + U64(odd(seed))) * up.upto(len(wh)), out=total[1:])
    m = max(0, len(wh) - n + 1)
    return mix((total[n : n + m] - total[:m]) * down.upto(len(wh) + 1)[:m])


def _minimizers(wh: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of size words: the least hash of its grams and its place; the first of equals."""
    g = _windows(wh, gram, 21)
    m = max(0, len(wh) - size + 1)
    if not m:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    least, place = g[:m].copy(), np.arange(m)
    for k in range(1, size - gram + 1):
        other = g[k : k + m]
        less = other < least
        least[less] = other[less]
        place[less] = np.flatnonzero(less) + k
    return least, place


def _inside(c: Chunk, size: int) -> np.ndarray:
    """Windows (by first word) that lie in one document."""
    m = max(0, len(c.row) - size + 1)
    return np.arange(m) + size <= c.bounds[1:][c.row[:m]]


def _cells(least: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's cell in both rows."""
    bits = U64(64 - (cells - 1).bit_length())
    return mix(least ^ U64(odd(31))) >> bits, mix(least ^ U64(odd(32))) >> bits


def _part(h: np.ndarray, ranges: int) -> np.ndarray:
    return (h >> U64(64 - (ranges - 1).bit_length())).astype(np.int64) if ranges > 1 else np.zeros(len(h), np.int64)


def _spread(doc: np.ndarray, ranges: int) -> np.ndarray:
    """A range for rows that only pass through, so that they are dealt evenly."""
    return _part(mix(doc.view(U64)), ranges)


def _rows(df: DataFrame) -> DataFrame:
    """doc_id and text. Both are expressions, not plain columns: the optimizer would drop the renaming of plain ones in some of
    the places that read these rows and not in others, and their exchange could not be shared."""
    doc_id = F.col("doc_id").cast("long").bitwiseOR(F.lit(0).cast("long"))
    return df.select(doc_id.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _minimizer_runs(c: Chunk, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimizer: first window, number of windows, the minimizer's hash."""
    least, place = _minimizers(c.hashes(), s.size, s.gram)
    at = np.flatnonzero(_inside(c, s.size))
    if not len(at):
        return at, at, np.zeros(0, U64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = place[at[1:]] != place[at[:-1]]
    first = np.flatnonzero(new)
    return at[first], np.diff(first, append=len(at)), least[at[first]]


PACKED = "part int, kind int, w binary, x binary, y binary, z binary"
_NAMES = ["part", "kind", "w", "x", "y", "z"]


class _Sender:
    """Rows of PACKED: columns of values, each packed by range. Rows must come sorted by range."""

    def __init__(self) -> None:
        self.rows: list[list] = [[] for _ in _NAMES]

    def add(self, kind: int, part: np.ndarray, *columns: np.ndarray) -> None:
        cuts = _runs(part)
        self.rows[0] += [int(part[a]) for a, _ in cuts]
        self.rows[1] += [kind] * len(cuts)
        for k in range(4):
            if k < len(columns):
                raw, width = columns[k].tobytes(), columns[k].dtype.itemsize
                self.rows[2 + k] += [raw[a * width : b * width] for a, b in cuts]
            else:
                self.rows[2 + k] += [None] * len(cuts)

    def batch(self) -> pa.RecordBatch:
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(self.rows, types, strict=True)], names=_NAMES)
        self.__init__()
        return out


class _Held:
    """Columns of arrays, put together when they are taken."""

    def __init__(self, *types: str):
        self.types = types
        self.clear()

    def clear(self) -> None:
        self.n, self.parts = 0, [[np.zeros(0, t)] for t in self.types]

    def add(self, *columns: np.ndarray) -> None:
        self.n += len(columns[0])
        for own, column, t in zip(self.parts, columns, self.types, strict=True):
            own.append(column.astype(t, copy=False))

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate(p) for p in self.parts]
        self.clear()
        return out


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how often each occurs, and each key's place among them."""
    each, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    return each, n, at


def _sketched(df: DataFrame, s: Settings) -> DataFrame:
    """PACKED rows of each task's buffers, a partial sketch for each range. Kinds 0 and 1: cells of the sketch's first and second
    row touched more than once; kind 2: runs to look up (doc, run), with their cells of both rows, touched once or listed
    in kinds 0 and 1; kind 3: runs known to be repeated (doc, run with its range), dealt evenly."""

    def flushed(held: _Held, out: _Sender) -> pa.RecordBatch:
        doc, run, h = held.take()
        part = _part(h, s.ranges)
        order = np.argsort(part, kind="stable")
        doc, run, part = doc[order], run[order], part[order]
        known = np.ones(len(doc), dtype=bool)
        cells, keys = [], []
        for cell in _cells(h[order], s.cells):
            each, n, at = _counted(part * s.cells + cell.astype(np.int64))
            known &= (n > 1)[at]
            cells.append(cell.astype("<u4"))
            keys.append(each[n > 1])
            out.add(len(keys) - 1, keys[-1] // s.cells, (keys[-1] % s.cells).astype("<u4"))
        ask = ~known
        out.add(2, part[ask], doc[ask].astype("<i8"), run[ask].astype("<u4"), cells[0][ask], cells[1][ask])
        doc, run = doc[known], run[known].astype(np.int64) | part[known] << _PLACE
        to = _spread(doc, s.ranges)
        order = np.argsort(to, kind="stable")
        out.add(3, to[order], doc[order].astype("<i8"), run[order].astype("<i8"))
        return out.batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = _Held("i8", "i8", "u8"), _Sender()
        for b in batches:
            ids = b.column(0).to_numpy()
            for c in chunks(b.column(1), s.chunk):
                at, n, h = _minimizer_runs(c, s)
                row = c.row[at]
                word = at - c.bounds[row]
                if len(word) and word.max() >> (_PLACE - _LENGTH):
                    raise ValueError("a text has too many words")
                held.add(ids[c.first + row], word << _LENGTH | n, h)
                if held.n >= s.runs:
                    yield flushed(held, out)
        if held.n:
            yield flushed(held, out)

    return df.mapInArrow(run, PACKED)


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    yield from zip(*(batch.column(k).to_pylist() for k in range(len(_NAMES))), strict=True)


def _dealt(packed: DataFrame, n: int) -> DataFrame:
    return packed.repartition(n, "part").sortWithinPartitions("part", "kind")


def _repeated(sketched: DataFrame, s: Settings, n: int) -> DataFrame:
    """(doc_id, runs): the runs of windows that the merged sketches estimate repeated. A range's partial sketches are summed,
    then its runs are looked up, and its counts are forgotten."""

    def out(held: _Held) -> pa.RecordBatch:
        doc, run = held.take()
        order = np.lexsort((run, doc))
        doc, run = doc[order], run[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (run[1:] != run[:-1])
        return pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(run[new])], names=["doc_id", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sketch, held = None, np.zeros((2, s.cells), dtype=np.uint8), _Held("i8", "i8")
        asked: list[tuple[bytes, ...]] = []

        def touch(row: int, cells: np.ndarray, n: int) -> None:
            # Cells that stand in one list twice are in another list as touched twice.
            sketch[row, cells] = np.minimum(sketch[row, cells] + n, 2)

        def answer() -> None:
            for doc, run, a, b in asked:
                hit = (sketch[0, np.frombuffer(a, dtype="<u4")] > 1) & (sketch[1, np.frombuffer(b, dtype="<u4")] > 1)
                held.add(np.frombuffer(doc, dtype="<i8")[hit], np.frombuffer(run, dtype="<u4")[hit].astype(np.int64) | key << _PLACE)
            asked.clear()
            sketch[:] = 0

        for b in batches:
            for part, kind, w, x, y, z in _rows_of(b):
                if part != key:
                    answer()
                    key = part
                if kind < 2:
                    touch(kind, np.frombuffer(w, dtype="<u4"), 2)
                elif kind == 2:
                    for row, cells in enumerate((y, z)):
                        touch(row, np.frombuffer(cells, dtype="<u4"), 1)
                    asked.append((w, x, y, z))
                else:
                    held.add(np.frombuffer(w, dtype="<i8"), np.frombuffer(x, dtype="<i8"))
                if held.n >= _BATCH:
                    yield out(held)
        answer()
        if held.n:
            yield out(held)

    return _dealt(sketched, n).mapInArrow(run, "doc_id long, run long").groupBy("doc_id").agg(F.collect_list("run").alias("runs"))


def _strictly_later(doc: np.ndarray, word: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places sorted by hashes, document and word: those that are the first of their window, and those after that
    place."""
    new = np.ones(len(h1), dtype=bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(h1) else np.zeros(0, np.int64)
    return new, (doc != doc[first]) | (word != word[first])


def _leads(open_: DataFrame, s: Settings) -> DataFrame:
    """PACKED rows of (doc_id, text, runs). Kind 0: for each buffer and range, the distinct windows with the first place of
    each (doc, word, both hashes), in the order of places; kind 1: places known to be later ones (doc, word), dealt
    evenly."""

    def flushed(held: _Held, out: _Sender) -> pa.RecordBatch:
        part, doc, word, h1, h2 = held.take()
        order = np.lexsort((word, doc, h2, h1))
        part, doc, word, h1, h2 = part[order], doc[order], word[order], h1[order], h2[order]
        first, late = _strictly_later(doc, word, h1, h2)
        lead = np.flatnonzero(first)
        lead = lead[np.lexsort((word[lead], doc[lead], part[lead]))]
        out.add(0, part[lead], doc[lead].astype("<i8"), word[lead].astype("<u4"), h1[lead].astype("<u8"), h2[lead].astype("<u8"))
        doc, word = doc[late], word[late]
        to = _spread(doc, s.ranges)
        order = np.argsort(to, kind="stable")
        out.add(1, to[order], doc[order].astype("<i8"), word[order].astype("<u4"))
        return out.batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = _Held("i8", "i8", "i8", "u8", "u8"), _Sender()
        for b in batches:
            ids, lists = b.column(0).to_numpy(), b.column(2)
            bounds, values = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            for c in chunks(b.column(1), s.chunk):
                lo, hi = bounds[c.first], bounds[c.last]
                own = values[lo:hi]
                n = own & ((1 << _LENGTH) - 1)
                row = np.repeat(np.arange(c.last - c.first), np.diff(bounds[c.first : c.last + 1]))
                at = c.bounds[row] + (own >> _LENGTH & ((1 << (_PLACE - _LENGTH)) - 1))
                ends = np.cumsum(n)
                at = np.repeat(at - (ends - n), n) + np.arange(int(n.sum()))
                row, part = np.repeat(row, n), np.repeat(own >> _PLACE, n)
                there = at + s.size <= c.bounds[1:][row]  # not so only where rows of one id differ
                at, pick = np.unique(at[there], return_index=True)
                if not len(at):
                    continue
                row, part = row[there][pick], part[there][pick]
                h1, h2 = _windows(c.hashes(), s.size, 41)[at], _windows(c.hashes(seed=2), s.size, 42)[at]
                held.add(part, ids[c.first + row], at - c.bounds[row], h1, h2)
                if held.n >= s.windows:
                    yield flushed(held, out)
        if held.n:
            yield flushed(held, out)

    return open_.select("doc_id", "text", "runs").mapInArrow(run, PACKED)


def _later(leads: DataFrame, s: Settings, n: int) -> DataFrame:
    """(doc_id, later): windows that aren't the first of their kind, as longs: a mask of eight words below, the first of them
    by 8 above. A range is sorted in slices of its hashes, about s.settle windows at once."""

    def settled(rows: list[tuple[bytes, ...]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        packs = [[np.frombuffer(x, dtype=t) for x, t in zip(r, ("<i8", "<u4", "<u8", "<u8"), strict=True)] for r in rows]
        bits = max(0, (sum(len(p[0]) for p in packs) - 1) // s.settle).bit_length()
        for k in range(1 << bits):
            own = [p[2] >> U64(64 - bits) == U64(k) if bits else slice(None) for p in packs]
            doc, word, h1, h2 = (np.concatenate([p[j][x] for p, x in zip(packs, own, strict=True)]) for j in range(4))
            order = np.lexsort((word, doc, h2, h1))
            doc, word = doc[order], word[order].astype(np.int64)
            _, late = _strictly_later(doc, word, h1[order], h2[order])
            yield doc[late], word[late]

    def out(held: _Held) -> pa.RecordBatch:
        doc, word = held.take()
        order = np.lexsort((word, doc))
        doc, word = doc[order], word[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (word[1:] >> 3 != word[:-1] >> 3)
        first = np.flatnonzero(new)
        masks = np.bitwise_or.reduceat(1 << (word & 7), first)
        return pa.RecordBatch.from_arrays([pa.array(doc[first]), pa.array(word[first] >> 3 << 8 | masks)], names=["doc_id", "later"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, held = None, [], _Held("i8", "i8")
        for b in batches:
            for part, kind, *columns in _rows_of(b):
                if part != key:
                    for found in settled(rows) if rows else ():
                        held.add(*found)
                    key, rows = part, []
                if kind == 0:
                    rows.append(columns)
                else:
                    held.add(np.frombuffer(columns[0], dtype="<i8"), np.frombuffer(columns[1], dtype="<u4"))
                if held.n >= _BATCH:
                    yield out(held)
        for found in settled(rows) if rows else ():
            held.add(*found)
        if held.n:
            yield out(held)

    return _dealt(leads, n).mapInArrow(run, "doc_id long, later long").groupBy("doc_id").agg(F.collect_list("later").alias("later"))


def _kept(text: str | None, later: np.ndarray, size: int) -> tuple[int, int, bytes]:
    """Words, words taken out, and what is left, for windows that start at `later` (all inside the text)."""
    words = (text or "").encode().split()
    later = later[later + size <= len(words)]
    if not len(later):
        return len(words), 0, b" ".join(words)
    gone = np.zeros(len(words) + 1, dtype=np.int32)
    np.add.at(gone, later, 1)
    np.add.at(gone, later + size, -1)
    keep = np.cumsum(gone[:-1]) == 0
    return len(words), int(len(words) - keep.sum()), b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])


def _finished(rows: DataFrame, size: int) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of (doc_id, text, later)."""
    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            lists = b.column(2)
            for k, text in enumerate(b.column(1).to_pylist()):
                later = none
                if lists[k].is_valid:
                    packed = lists[k].values.to_numpy()
                    row, bit = np.nonzero(packed[:, None] >> np.arange(8) & 1)
                    later = np.unique((packed[row] >> 8 << 3) + bit)
                for column, v in zip(out, _kept(text, later, size), strict=True):
                    column.append(v)
            n, gone, kept = out
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.select("doc_id", "text", "later").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def settings(df: DataFrame, s: Settings) -> tuple[Settings, int]:
    """s with its ranges, and the number of partitions that they are dealt to, by the bytes of text."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(n, int(size * s.density / (s.fill * s.cells)) + 1)
    return replace(s, ranges=s.ranges or 1 << (wanted - 1).bit_length()), max(n, size // (128 << 20) + 1)


def dedup(spark: SparkSession, df: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for each row of (doc_id, text)."""
    if not s.gram <= s.size < s.gram + (1 << _LENGTH) - 1:
        raise ValueError("a window must hold a minimizer's run, and few of them")
    rows = _rows(df)
    s, n = settings(rows, s)
    # Both joins read one exchange of the documents.
    known = rows.filter("doc_id IS NOT NULL")
    repeated = _repeated(_sketched(known, s), s, n)
    later = _later(_leads(known.join(repeated, "doc_id"), s), s, n)
    rest = rows.filter("doc_id IS NULL").withColumn("later", F.lit(None).cast("array<long>"))
    return _finished(known.join(later, "doc_id", "left").unionByName(rest), s.size)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, documents(spark, sf_dir))


def sql() -> str:
    """The same rows in DuckDB, by grouping every window's words."""
    return r"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM t),
f AS (SELECT doc_id, i, string_agg(word, ' ') OVER f AS s, count(*) OVER f AS n FROM x WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM f WHERE n = 20),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM k WHERE k > 1),
y AS (SELECT x.doc_id, x.i, x.word, g.i IS NOT NULL AS gone FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i),
z AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM y GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN z USING (doc_id)"""
