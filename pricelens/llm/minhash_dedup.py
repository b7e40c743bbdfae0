"""Near-duplicate groups by b-bit MinHash.

1. Each text becomes the set of its distinct word shingles (64-bit hashes), and the set K minima. Bands of R minima make
   bucket keys; of each minimum the low B bits are kept, packed into longs. Texts with equal sets (128-bit digest) form
   one class; only one row of it goes on, so copies are never paired.
2. In every bucket all members are held against the bucket's first class. Pairs whose collision-corrected estimate
   (equal B-bit fields, by xor and bit counts) is too low go; the rest are confirmed on full sets. The links found give
   components. Nodes are classes, not ids, so an id that stands beside several texts joins what each of them is like.
3. In buckets that still hold several components all pairs from different components are estimated in blocks; a spanning
   forest of those that are likely, at most a row for each member, gives clusters. In clusters of several components all
   full sets are intersected, in blocks, and a spanning forest of the links comes out. So pairs are compared where that
   is needed, but not emitted, and a large bucket or cluster is dealt to many tasks. No link between different texts is
   lost by step 2, as a pair within one component can't change the components.

With R = 5, K = 160 a pair at similarity 0.8 shares no bucket with probability (1 - 0.8^5)^32 = 3e-6; the estimate lies
more than 5.5 standard deviations below 0.8 where it is refused.

Defined results: a text without words (null, empty, white space) has an empty set and is linked with nothing; a text
with fewer words than a shingle has its whole sequence as its only shingle; repeated rows give equal rows; rows of one id
with different texts are one document that is linked with all that either is like; rows with a null id keep a null
component; columns beside id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, release, written
from .components import components
from .textkernel import Chunk, chunks, mix, odd

K, R, B = 160, 5, 4
PERCENT = 80
#: Lowest estimate that is still confirmed on full sets.
LEAST_ESTIMATE = 0.62
#: Rows of a block of a bucket (signatures) and of a cluster (texts); a task holds two blocks at a time.
BUCKET_ROWS, CLUSTER_ROWS = 1024, 256
#: Parts in which the rows of one bucket or cluster meet its size.
SALTS = 16

_A = np.array([odd(1000 + k) & 0xFFFFFFFF for k in range(K)], dtype=np.uint32)
_X = np.array([odd(5000 + k) >> 32 for k in range(K)], dtype=np.uint32)
_BAND = np.array([odd(9000 + k) for k in range(R)], dtype=np.uint64)
U64 = np.uint64


def shingle_sets(c: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's sorted distinct shingles of n words, one after the other, and the rows' bounds."""
    wh = c.hashes(lower=True)
    counts = np.diff(c.bounds)
    value = np.zeros(len(wh), dtype=U64)
    for k in range(n):  # beyond a row's end nothing is added, so a short row's first place holds its whole sequence
        at = np.arange(len(wh)) + k
        ok = at < c.bounds[1:][c.row]
        value[ok] += mix(wh[at[ok]] + U64(odd(77 + k)))
    place = np.arange(len(wh)) - c.bounds[:-1][c.row]
    use = (place <= counts[c.row] - n) | (place == 0)
    value, row = mix(value[use]), c.row[use]
    ends = np.searchsorted(row, np.arange(len(counts) + 1))
    parts = [np.unique(value[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return np.concatenate(parts) if parts else value, np.concatenate([[0], np.cumsum(sizes)])


def minima(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """K minima (uint32) of each non-empty set."""
    x = (values >> U64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, K), dtype=np.uint32)
    for k in range(K):
        out[:, k] = np.minimum.reduceat((x * _A[k]) ^ _X[k], bounds[:-1])
    return out


def _packed(m: np.ndarray) -> np.ndarray:
    """Low B bits of the minima in int64 words, 64 / B fields each."""
    per = 64 // B
    low = (m & np.uint32((1 << B) - 1)).astype(U64).reshape(len(m), K // per, per)
    return np.bitwise_or.reduce(low << (np.arange(per, dtype=U64) * U64(B)), axis=2).view(np.int64)


def _bands(m: np.ndarray) -> np.ndarray:
    rows = m.astype(U64).reshape(len(m), K // R, R)
    key = (mix(rows + U64(1)) * _BAND).sum(axis=2, dtype=U64)
    return mix(key + np.arange(1, K // R + 1, dtype=U64) * U64(odd(3))).view(np.int64)


SIGNATURES = "doc_id long, text_hash long, n_shingles long, c1 long, c2 long, sig array<long>, bands array<long>"


def _lists(a: np.ndarray, valid: np.ndarray) -> pa.Array:
    """A list column; rows that aren't valid get an empty list."""
    sizes = np.where(valid, a.shape[1] if a.ndim == 2 else 0, 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(a.reshape(-1)))


def signatures(df: DataFrame, shingle: int) -> DataFrame:
    """One row per row of (doc_id, text); c1 and c2 are the set's digest, null for an empty set; text_hash tells rows of one
    id apart."""

    def made(b: pa.RecordBatch, c: Chunk) -> pa.RecordBatch:
        values, bounds = shingle_sets(c, shingle)
        sizes = np.diff(bounds)
        full = sizes > 0
        starts = np.append(bounds[:-1][full], bounds[-1])
        m = minima(values, starts) if full.any() else np.empty((0, K), np.uint32)
        digest = []
        for salt in (11, 12):
            v = np.zeros(len(sizes), dtype=U64)
            if full.any():
                v[full] = np.add.reduceat(mix(values + U64(odd(salt))), starts[:-1])
            digest.append(pa.array(mix(v + sizes.astype(U64)).view(np.int64), mask=~full))
        return pa.RecordBatch.from_arrays(
            [*(b.column(k).slice(c.first, c.last - c.first) for k in (0, 1)), pa.array(sizes), *digest, _lists(_packed(m), full), _lists(_bands(m), full)],
            names=["doc_id", "text_hash", "n_shingles", "c1", "c2", "sig", "bands"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            yield from (made(b, c) for c in chunks(b.column(2)))
            release()

    return _rows(df).mapInArrow(run, SIGNATURES)


def _rows(df: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return df.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: share of equal fields, corrected for fields that agree by chance."""
    ones = sum(1 << (B * k) for k in range(64 // B))
    ones -= 1 << 64 if ones >= 1 << 63 else 0

    def differing(x: Column) -> Column:
        any_bit = x
        for k in range(1, B):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(any_bit.bitwiseAND(F.lit(ones)))

    apart = sum((differing(a[k].bitwiseXOR(b[k])) for k in range(K * B // 64)), F.lit(0))
    chance = 2.0**-B
    return (1 - apart / K - chance) / (1 - chance)


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes of (node, text) whose full shingle sets have 100 * intersection >= percent * union."""
    left = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "ta"}), "a")
    both = left.join(texts.withColumnsRenamed({"node": "b", "text": "tb"}), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            ta, tb = batch.column(2), batch.column(3)
            n = len(batch)
            if not n:
                continue
            for lo in range(0, n, 256):
                hi = min(n, lo + 256)
                sets = []
                for column in (ta, tb):
                    own = []
                    for c in chunks(column.slice(lo, hi - lo)):
                        v, bounds = shingle_sets(c, shingle)
                        own += [v[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                    sets.append(own)
                for x, y in zip(*sets, strict=True):
                    same = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(bool(len(x)) and 100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def _split(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The rows (node, component) of keys that hold several components, with i and j: pairs of blocks of a key's rows, so
    that any two rows of a key meet in some (key, i, j). A key of up to `most` rows is one block; others are dealt by a
    hash into blocks of about so many. Sizes are summed before they are shuffled, and a large key's rows meet its size in
    SALTS parts."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    salted = sizes.filter("lo < hi").select(key, "n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    own = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit(1), "node"), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"]).drop("salt")
    own = own.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    pair = own.withColumn("other", other)
    return pair.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("other", "n", "mine")


class _Forest:
    """Union-find over the rows of a block; rows of one component count as joined."""

    def __init__(self, component: np.ndarray):
        _, self.root = np.unique(component, return_inverse=True)
        self.parent = list(range(int(self.root.max()) + 1))

    def find(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def spanning(self, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        """Those of the pairs of rows that join something, at most as many as there are components."""
        out = []
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            p, q = self.find(int(self.root[a])), self.find(int(self.root[b]))
            if p != q:
                self.parent[p] = q
                out.append((a, b))
        return out


def _likely(sig: np.ndarray, component: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Spanning pairs of rows whose packed signatures (uint64) estimate `least` or more."""
    ones = U64(sum(1 << (B * k) for k in range(64 // B)))
    chance = 2.0**-B
    apart = int(K * (1 - least * (1 - chance) - chance))
    forest, out = _Forest(component), []
    step = max(1, (1 << 21) // max(1, len(sig)))
    for lo in range(0, len(sig), step):
        differing = np.zeros((len(sig[lo : lo + step]), len(sig)), dtype=np.int64)
        for k in range(sig.shape[1]):
            d = sig[lo : lo + step, None, k] ^ sig[None, :, k]
            any_bit = d
            for shift in range(1, B):
                any_bit = any_bit | (d >> U64(shift))
            differing += np.bitwise_count(any_bit & ones)
        x, y = np.nonzero(differing <= apart)
        new = (x + lo < y) & (component[x + lo] != component[y])
        out += forest.spanning(x[new] + lo, y[new])
    return out


def _linked(sets: list[np.ndarray], component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Spanning pairs of rows whose sets have 100 * intersection >= percent * union, exactly. Intersections add up over
    shingles: of many rows by a matrix product, of few rows pair by pair."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.zeros((len(sets), len(sets)), dtype=np.float32)
    many = np.flatnonzero(df >= 16)
    place = np.full(len(df), -1)
    place[many] = np.arange(len(many))
    for lo in range(0, len(many), 4096):
        own = (place[column] >= lo) & (place[column] < lo + 4096)
        dense = np.zeros((len(sets), min(4096, len(many) - lo)), dtype=np.float32)
        dense[row[own], place[column[own]] - lo] = 1
        shared += dense @ dense.T
    few = (df[column] > 1) & (df[column] < 16)
    order = np.argsort(column[few], kind="stable")
    r, c = row[few][order], column[few][order]
    for gap in range(1, 15):
        same = c[gap:] == c[:-gap]
        if not same.any():
            break
        np.add.at(shared, (r[:-gap][same], r[gap:][same]), 1)
        np.add.at(shared, (r[gap:][same], r[:-gap][same]), 1)
    union = sizes[:, None] + sizes[None, :] - shared.astype(np.int64)
    x, y = np.nonzero(100 * shared.astype(np.int64) >= percent * union)
    new = (x < y) & (component[x] != component[y])
    return _Forest(component).spanning(x[new], y[new])


def _by_block(rows: DataFrame, key: str, columns: list[str], settle) -> DataFrame:
    """(a, b) that settle(list of columns) finds among the rows of each (key, i, j)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t.column("node").to_numpy()
            found = settle(t) if len(t) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([min(ids[x], ids[y]) for x, y in found], pa.int64()), pa.array([max(ids[x], ids[y]) for x, y in found], pa.int64())], names=["a", "b"])

        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in (key, "i", "j")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if y == x:
                    continue
                this = tuple(keys[:, x].tolist())
                if this != last and held:
                    yield done()
                    held = []
                last = this
                held.append(b.slice(x, y - x))
        if held:
            yield done()

    dealt = rows.select(key, "i", "j", "node", "component", *columns).repartition(n, key, "i", "j").sortWithinPartitions(key, "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def groups(spark: SparkSession, df: DataFrame, shingle: int = 5, percent: int = PERCENT, least: float = LEAST_ESTIMATE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) for each row of (doc_id, text)."""
    sets = written(spark, signatures(df, shingle), "sets")
    full = sets.filter("c1 IS NOT NULL AND doc_id IS NOT NULL")
    # A node is a class of equal sets, which have equal signatures; first is the row that stands for it.
    own = full.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = written(spark, own.select("c1", "c2", "first.*", "sig", "bands", F.monotonically_increasing_id().alias("node")), "classes")

    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = written(spark, buckets.join(heads, "bucket"), "buckets")
    sigs = classes.select("node", "sig")
    # Only classes that share a bucket are compared by text.
    reps = classes.select("node", "doc_id", "text_hash").join(shared.select("node").distinct(), "node", "left_semi")
    texts = written(spark, _rows(df).join(reps, ["doc_id", "text_hash"]).dropDuplicates(["node"]).select("node", "text"), "texts")

    star = shared.filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    both = star.join(sigs.withColumnsRenamed({"node": "a", "sig": "sa"}), "a").join(sigs.withColumnsRenamed({"node": "b", "sig": "sb"}), "b")
    likely = written(spark, both.filter(estimate(F.col("sa"), F.col("sb")) >= least).select("a", "b"), "pairs")
    links = written(spark, confirmed(likely, texts, shingle, percent), "links")
    found = components(spark, links)

    open_ = shared.select("bucket", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    part = written(spark, _split(open_, "bucket", BUCKET_ROWS), "open").join(sigs, "node")
    width = K * B // 64
    alike = written(spark, _by_block(part, "bucket", ["sig"], lambda t: _likely(_matrix(t.column("sig"), width), t.column("component").to_numpy(), least)), "alike")

    near = components(spark, alike.union(links)).withColumnRenamed("component", "cluster")
    near = near.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    dealt = written(spark, _split(near, "cluster", CLUSTER_ROWS), "clusters").join(texts, "node")

    def settle(t: pa.Table) -> list[tuple[int, int]]:
        own: list[np.ndarray] = []
        for c in chunks(t.column("text").combine_chunks()):
            v, bounds = shingle_sets(c, shingle)
            own += [v[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        return _linked(own, t.column("component").to_numpy(), percent)

    links2 = written(spark, _by_block(dealt, "cluster", ["text"], settle).union(links), "links")
    return _by_id(spark, sets, classes, components(spark, links2))


def _by_id(spark: SparkSession, sets: DataFrame, classes: DataFrame, linked: DataFrame) -> DataFrame:
    """The rows of sets with the smallest id of their component. Components of classes become components of ids, which
    differ from them only where an id has rows in several classes."""
    component = F.coalesce("component", "node")
    nodes = classes.select("c1", "c2", "node", "doc_id").join(linked, "node", "left").select("c1", "c2", component.alias("component"), "doc_id")
    smallest = nodes.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    # The smallest ids of the components that one id has rows in are links of their own.
    own = sets.filter("doc_id IS NOT NULL AND c1 IS NOT NULL").select("doc_id", "c1", "c2")
    several = own.groupBy("doc_id").agg(F.min(F.struct("c1", "c2")).alias("lo"), F.max(F.struct("c1", "c2")).alias("hi")).filter("lo <> hi").select("doc_id")
    labels = written(spark, nodes.join(smallest, "component").select("c1", "c2", F.col("smallest").alias("label")), "labels")
    held = own.join(several, "doc_id", "left_semi").distinct().join(labels, ["c1", "c2"]).select("doc_id", "label").distinct()
    bridges = written(spark, held.groupBy("doc_id").agg(F.min("label").alias("a")).join(held, "doc_id").filter("a <> label").select("a", F.col("label").alias("b")), "bridges")
    if bridges.limit(1).count():
        roots = components(spark, bridges).withColumnsRenamed({"node": "label", "component": "root"})
        labels = written(spark, labels.join(roots, "label", "left").select("c1", "c2", F.coalesce("root", "label").alias("label")), "labels")
    out = sets.select("doc_id", "n_shingles", "c1", "c2").join(labels, ["c1", "c2"], "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().view(U64).reshape(-1, width)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(spark, documents(spark, sf_dir), shingle=2)


def sql() -> str:
    """The query's rows in DuckDB, by intersecting the sets of all pairs that share a shingle."""
    return r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM t),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * i >= 80 * (na + nb - i)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS node, b AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other), c AS (SELECT node, least(node, min(other)) AS component FROM r GROUP BY node)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept FROM s LEFT JOIN c ON node = doc_id"""
