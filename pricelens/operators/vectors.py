"""Vectors: strictly backward neighbours, novelty, hubness, combined fields, clusters, components and joint models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import r6
from ..sources.tape import read, tape

#: Queries in a broadcast block, neighbours kept, similarity that counts as near.
BLOCK, K, TAU = 2048, 25, 0.25
#: Reference rows of the mutual proximity, and rows that it scores at once.
REFERENCE, PART = 2048, 512
#: Rows that linked_groups holds all rows against first, and numbers in a part of the rest.
SEEDS, PART_NUMBERS = 2048, 1 << 21


def backward_neighbours(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """(q, id, sim): for each query row the k most similar rows born before it (smaller id; equal births don't count).
    Queries go out in blocks of fixed size; each task keeps its own best k of a block, and Spark merges them. Ties go to
    the smaller id. rows and queries: (id, vector)."""
    schema = "q long, id long, sim double"
    out = spark.createDataFrame([], schema)
    held: list = []

    def against(rows: list) -> DataFrame:
        q = np.array([r[0] for r in rows], dtype=np.int64)
        m = np.array([r[1] for r in rows], dtype=np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        shared = spark.sparkContext.broadcast((q, m))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, m = shared.value
            for b in batches:
                if not len(b):
                    continue
                ids = b.column(0).to_numpy()
                v = b.column(1).flatten().to_numpy().astype(np.float64).reshape(len(b), -1)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                sim = np.round(m @ v.T, 9)
                sim[ids[None, :] >= q[:, None]] = -np.inf
                top = np.lexsort((np.broadcast_to(ids, sim.shape), -sim), axis=1)[:, :k]
                best = np.take_along_axis(sim, top, axis=1)
                ok = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(q[:, None], top.shape)[ok]), pa.array(ids[top][ok]), pa.array(best[ok])], names=["q", "id", "sim"])

        return vectors.mapInArrow(run, schema)

    for r in queries.toLocalIterator():
        held.append(r)
        if len(held) == block:
            out, held = out.union(against(held)), []
    if held:
        out = out.union(against(held))
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return v, v.filter("id % 100 = 0")


def near_links(spark: SparkSession, vectors: DataFrame, queries: DataFrame, least: float = TAU, block: int = BLOCK) -> DataFrame:
    """(q, id): every earlier row whose similarity to a query row is `least` or more, without a limit on their number."""
    schema = "q long, id long"
    out = spark.createDataFrame([], schema)
    held: list = []

    def against(rows: list) -> DataFrame:
        q = np.array([r[0] for r in rows], dtype=np.int64)
        shared = spark.sparkContext.broadcast((q, _unit(np.array([r[1] for r in rows], dtype=np.float64))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, m = shared.value
            for b in batches:
                for lo in range(0, len(b), PART):
                    part = b.slice(lo, PART)
                    ids = part.column(0).to_numpy()
                    v = _unit(part.column(1).flatten().to_numpy().astype(np.float64).reshape(len(part), -1))
                    x, y = np.nonzero((np.round(m @ v.T, 9) >= least) & (ids[None, :] < q[:, None]))
                    yield pa.RecordBatch.from_arrays([pa.array(q[x]), pa.array(ids[y])], names=["q", "id"])

        return vectors.mapInArrow(run, schema)

    for r in queries.toLocalIterator():
        held.append(r)
        if len(held) == block:
            out, held = out.union(against(held)), []
    return out.union(against(held)) if held else out


def knn_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity of the 1, 5 and 25 nearest earlier rows, and how many of all earlier rows are near, for query rows."""
    v, q = _vectors(spark, sf_dir)
    n = backward_neighbours(spark, v, q)
    near = near_links(spark, v, q).groupBy("q").agg(F.count("*").alias("near"))
    mean = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, F.col("sim"))), 5)
    out = n.groupBy("q").agg(F.count("*").alias("neighbours"), mean(1).alias("sim_k1"), mean(5).alias("sim_k5"), mean(25).alias("sim_k25"), F.min_by("id", "rank").alias("top_id"))
    return out.join(near, "q", "left").withColumn("near", F.coalesce("near", F.lit(0).cast("long")))


def hubness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each row is among the neighbours of queries."""
    v, q = _vectors(spark, sf_dir)
    return backward_neighbours(spark, v, q).groupBy("id").agg(F.count("*").alias("occurrences"), F.min("rank").alias("best_rank"))


_SIMS_SQL = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS len FROM v),
s AS (SELECT a.id AS q, b.id, round(list_dot_product(a.e, b.e) / (a.len * b.len), 9) AS sim FROM n a JOIN n b ON b.id < a.id WHERE a.id % 100 = 0),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS rank FROM s) WHERE rank <= 25)"""


def combined_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean of two halves of the vectors, weights renormalised where the second is missing, at unit length."""
    v, _ = _vectors(spark, sf_dir)
    a, b = F.slice("vector", 1, 32), F.slice("vector", 33, 32)
    both = F.zip_with(a, b, lambda x, y: F.when(F.col("id") % 7 == 0, x.cast("double")).otherwise(0.6 * x + 0.4 * y))
    v = v.select("id", both.alias("u"))
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x))
    return v.select("id", F.round(F.element_at("u", 1) / norm, 5).alias("first"), F.round(norm, 5).alias("norm"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means of the vectors (12 clusters, fixed seed): size and mean distance to the centre. Rows only."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v, _ = _vectors(spark, sf_dir)
    model = KMeans(k=12, seed=5, maxIter=20).fit(v.select("id", array_to_vector("vector").alias("features")))
    centres = spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())], "prediction int, centre array<double>")
    own = model.transform(v.select("id", array_to_vector("vector").alias("features"))).withColumn("x", vector_to_array("features")).join(F.broadcast(centres), "prediction")
    d = F.sqrt(F.aggregate(F.zip_with("x", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    return own.groupBy("prediction").agg(F.count("*").alias("n"), r6(F.avg(d)).alias("mean_distance"))


def principal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First two principal scores, signs fixed by the largest loading. Rows only."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v, _ = _vectors(spark, sf_dir)
    f = v.select("id", array_to_vector("vector").alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(f)
    signs = [float(np.sign(c[np.argmax(np.abs(c))])) for c in model.pc.toArray().T]
    pc = vector_to_array("pc")
    return model.transform(f).select("id", *[r6(pc[k] * s).alias(f"pc{k + 1}") for k, s in enumerate(signs)])


def joint_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns on two market dimensions and their products with price, after each event's own intercept and price slope
    are taken out of every column; errors clustered by market. Group moments and the cross products are aggregates; only
    the four-by-four system is solved on the driver. Rows only."""
    t = tape(spark, sf_dir).filter("side = 'BUY'")
    w = Window.partitionBy("market_id")
    t = t.withColumns({"d1": F.log1p(F.sum("usdc").over(w)), "d2": F.log1p(F.count("*").over(w).cast("double"))})
    t = t.withColumns({"d3": F.col("d1") * F.col("price"), "d4": F.col("d2") * F.col("price")})
    names = ["d1", "d2", "d3", "d4", "ret"]
    m = t.groupBy("event").agg(F.count("*").alias("n"), F.avg("price").alias("pm"), F.var_pop("price").alias("pv"), *[F.avg(c).alias("m_" + c) for c in names], *[F.covar_pop("price", c).alias("c_" + c) for c in names])
    j = t.join(m, "event")
    slope = lambda c: F.when(F.col("pv") > 1e-12, F.col("c_" + c) / F.col("pv")).otherwise(0.0)
    j = j.select("market_id", *[(F.col(c) - F.col("m_" + c) - slope(c) * (F.col("price") - F.col("pm"))).alias(c) for c in names])
    gram = j.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in names[:4] for b in names]).first()
    A = np.array([[gram[f"{a}_{b}"] for b in names[:4]] for a in names[:4]])
    beta = np.linalg.lstsq(A, np.array([gram[f"{a}_ret"] for a in names[:4]]), rcond=None)[0]
    e = F.col("ret") - sum((F.col(c) * float(b) for c, b in zip(names[:4], beta, strict=True)), F.lit(0.0))
    scores = j.withColumn("e", e).groupBy("market_id").agg(*[F.sum(F.col(c) * F.col("e")).alias(c) for c in names[:4]])
    meat = scores.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in names[:4] for b in names[:4]]).first()
    inv = np.linalg.pinv(A)
    V = inv @ np.array([[meat[f"{a}_{b}"] for b in names[:4]] for a in names[:4]]) @ inv
    rows = [(c, float(b), float(np.sqrt(max(V[k, k], 0)))) for k, (c, b) in enumerate(zip(names[:4], beta, strict=True))]
    return spark.createDataFrame(rows, "term string, beta double, se double")


def _phi(z: np.ndarray) -> np.ndarray:
    """Normal probability by a rational approximation (error under 1e-7)."""
    t = 1 / (1 + 0.2316419 * np.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = np.exp(-z * z / 2) / np.sqrt(2 * np.pi) * poly
    return np.where(z >= 0, 1 - tail, tail)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _spread(x: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation (at least 1e-3) of each row's similarity to the reference rows."""
    s = x @ ref.T
    return s.mean(axis=1), np.maximum(s.std(axis=1, ddof=1), 1e-3)


def rescaled_neighbours(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """(q, id, mp, rank): for each query row the k rows born before it whose mutual proximity is highest: the product of
    two normal probabilities of the similarity, standardised by either end's similarity to REFERENCE fixed rows. All
    earlier rows are rescaled; each task keeps its own best k of a block, and Spark merges them. Ties go to the smaller
    id."""
    schema = "q long, id long, mp double"
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(REFERENCE).collect()
    out = spark.createDataFrame([], schema)
    if not sample:
        return out.withColumn("rank", F.lit(0))
    ref = spark.sparkContext.broadcast(_unit(np.array([r["vector"] for r in sample], dtype=np.float64)))
    held: list = []

    def against(rows: list) -> DataFrame:
        q = np.array([r[0] for r in rows], dtype=np.int64)
        m = _unit(np.array([r[1] for r in rows], dtype=np.float64))
        shared = spark.sparkContext.broadcast((q, m, *_spread(m, ref.value)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, m, mq, sq = shared.value
            best, names = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), dtype=np.int64)
            for b in batches:
                for x in range(0, len(b), PART):
                    part = b.slice(x, PART)
                    ids = part.column(0).to_numpy()
                    v = _unit(part.column(1).flatten().to_numpy().astype(np.float64).reshape(len(part), -1))
                    mu, sd = _spread(v, ref.value)
                    sim = m @ v.T
                    mp = np.round(_phi((sim - mq[:, None]) / sq[:, None]) * _phi((sim - mu) / sd), 9)
                    mp[ids[None, :] >= q[:, None]] = -np.inf
                    mp, to = np.hstack([best, mp]), np.hstack([names, np.broadcast_to(ids, mp.shape)])
                    top = np.lexsort((to, -mp), axis=1)[:, :k]
                    best, names = np.take_along_axis(mp, top, axis=1), np.take_along_axis(to, top, axis=1)
            ok = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(q[:, None], best.shape)[ok]), pa.array(names[ok]), pa.array(best[ok])], names=["q", "id", "mp"])

        return vectors.mapInArrow(run, schema)

    for r in queries.toLocalIterator():
        held.append(r)
        if len(held) == block:
            out, held = out.union(against(held)), []
    if held:
        out = out.union(against(held))
    w = Window.partitionBy("q").orderBy(F.desc("mp"), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mutual_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and highest mutual proximity of query rows to the 25 earlier rows that are nearest by it. Rows only."""
    v, q = _vectors(spark, sf_dir)
    return rescaled_neighbours(spark, v, q).groupBy("q").agg(F.count("*").alias("neighbours"), r6(F.avg("mp")).alias("mean_mp"), r6(F.max("mp")).alias("max_mp"))


def _near(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in x and y, of rows of length 1, whose rounded similarity is `least` or more."""
    sim = x @ y.T
    i, j = np.nonzero(sim >= least - 1e-8)
    ok = np.round(sim[i, j], 9) >= least
    return i[ok], j[ok]


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of each a and b; parent holds every place's root, its class's smallest place."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def _by_seed(vectors: DataFrame, seeds: np.ndarray, least: float) -> DataFrame:
    """(id, seed, null): each row and the first seed that it is near, if any. (null, seed, root): seeds that a task's rows join."""
    shared = vectors.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, names = shared.value, ["id", "seed", "root"]
        parent = np.arange(len(m))
        for b in batches:
            for lo in range(0, len(b), PART):
                part = b.slice(lo, PART)
                x, y = _near(_unit(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1)), m, least)
                first = np.full(len(part), -1)
                first[x[::-1]] = y[::-1]
                _merge(parent, y, first[x])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(first, pa.int32(), mask=first < 0), pa.nulls(len(part), pa.int32())], names=names)
        joined = np.flatnonzero(parent != np.arange(len(m)))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(joined), pa.int64()), pa.array(joined, pa.int32()), pa.array(parent[joined], pa.int32())], names=names)

    return vectors.mapInArrow(run, "id long, seed int, root int")


def _cell_links(table: pa.Table, least: float) -> pa.Table:
    """(a, b): a forest of the classes that links between the two sides of a cell join. Rows of one class aren't compared."""
    second = table["second"].to_numpy().astype(bool)
    v = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
    names, of = np.unique(table["klass"].to_numpy(), return_inverse=True)
    left, right, parent = np.flatnonzero(~second), np.flatnonzero(second), np.arange(len(names))
    for i in range(0, len(left), PART):
        for j in range(0, len(right), 4 * PART):
            x, y = left[i : i + PART], right[j : j + 4 * PART]
            p, q = parent[of[x]], parent[of[y]]
            if (p == p[0]).all():
                y = y[q != p[0]]
            elif (q == q[0]).all():
                x = x[p != q[0]]
            if len(x) and len(y):
                a, b = _near(_unit(v[x].astype(np.float64)), _unit(v[y].astype(np.float64)), least)
                _merge(parent, of[x[a]], of[y[b]])
    joined = np.flatnonzero(parent != np.arange(len(names)))
    return pa.table({"a": names[joined], "b": names[parent[joined]]})


def _rest_links(vectors: DataFrame, classes: DataFrame, main: int, dim: int, rest: int, others: int, least: float) -> DataFrame:
    """(a, b): classes joined by links that have an end outside the class `main`. The `rest` rows outside it and the `others` in
    it are dealt into parts of a fixed size; each pair of parts with one outside is a cell, which one task holds at a time."""
    size = max(1, PART_NUMBERS // max(dim, 1))
    mine, all_parts = -(-rest // size), -(-rest // size) - (-others // size)
    known = vectors.join(classes, "id").select("vector", "klass", F.xxhash64("id").alias("hash"))
    out = known.filter(F.col("klass") != main).withColumn("part", F.pmod("hash", F.lit(mine)))
    within = known.filter(F.col("klass") == main).withColumn("part", mine + F.pmod("hash", F.lit(all_parts - mine)))
    at = lambda i, j: (F.lit(i) if isinstance(i, int) else i) * all_parts + j
    side = lambda df, cells, second: df.select("vector", "klass", F.lit(second).alias("second"), F.explode(cells).alias("cell"))
    span = lambda a, b: F.sequence(F.lit(a).cast("long") if isinstance(a, int) else a, F.lit(b).cast("long") if isinstance(b, int) else b)
    firsts = F.transform(F.concat(span(0, F.col("part")), span(mine, all_parts - 1)), lambda j: at(F.col("part"), j))
    cells = side(out, firsts, False).union(side(out, F.transform(span(F.col("part"), mine - 1), lambda i: at(i, F.col("part"))), True))
    cells = cells.union(side(within, F.transform(span(0, mine - 1), lambda i: at(i, F.col("part"))), True))
    n = min(mine * (mine + 1) // 2 + mine * (all_parts - mine), 4096)
    return cells.repartition(n, "cell").groupBy("cell").applyInArrow(lambda t: _cell_links(t, least), "a long, b long")


def linked_groups(spark: SparkSession, sf_dir: str, least: float = TAU) -> DataFrame:
    """Connected components of all links of near rows: each row's smallest row reached, and the component's size. All rows are
    held against SEEDS rows first, which gives classes; then every row outside the largest class against all rows of other
    classes, so no link that could join two classes is left out. Classes take the smallest label among themselves and their
    neighbours', then the label of that label, until they stand still; each round is a reliable checkpoint. The driver holds
    the seeds and pairs of them."""
    from ..sources.io import reliable

    v, _ = _vectors(spark, sf_dir)
    full = v.filter("id IS NOT NULL AND vector IS NOT NULL")
    seeds = full.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, full.count() // SEEDS))) == 0).limit(SEEDS).collect()
    seeds = seeds or full.limit(SEEDS).collect()
    rows = v.select("id", F.col("id").alias("klass"))
    if seeds:
        held = reliable(spark, _by_seed(full, _unit(np.array([r["vector"] for r in seeds], dtype=np.float64)), least))
        pairs = np.array([tuple(r) for r in held.filter("root IS NOT NULL").select("seed", "root").distinct().collect()], dtype=np.int64).reshape(-1, 2)
        root = np.arange(len(seeds))
        _merge(root, pairs[:, 0], pairs[:, 1])
        of = spark.createDataFrame([(k, seeds[r]["id"]) for k, r in enumerate(root.tolist())], "seed int, klass long")
        rows = held.filter("root IS NULL").join(F.broadcast(of), "seed", "left").select("id", F.coalesce("klass", "id").alias("klass"))
        main, others = rows.groupBy("klass").count().orderBy(F.desc("count"), "klass").first()
        rest = rows.count() - others
        links = rows.groupBy("id").agg(F.collect_set("klass").alias("k")).filter("size(k) > 1").select(F.col("k")[0].alias("a"), F.explode("k").alias("b"))
        if rest:
            links = links.union(_rest_links(full, rows.distinct(), main, len(seeds[0]["vector"]), rest, others, least))
        both = reliable(spark, links.union(links.select("b", "a")).distinct())
        labels = reliable(spark, both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
        while True:
            heard = both.join(labels, both["b"] == labels["node"]).groupBy(both["a"].alias("node")).agg(F.min("label").alias("heard"))
            near = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("near"))
            after = near.join(labels.select(F.col("node").alias("near"), F.col("label").alias("far")), "near")
            after = reliable(spark, after.select("node", "old", F.least("near", "far").alias("label")))
            labels = after.select("node", "label")
            if not after.filter("old <> label").limit(1).count():
                break
        rows = rows.join(labels.withColumnRenamed("node", "klass"), "klass", "left").select("id", F.coalesce("label", "klass").alias("klass"))
        rows = rows.union(v.filter("id IS NULL OR vector IS NULL").select("id", F.col("id").alias("klass")))
    per = rows.groupBy(F.col("klass").alias("k")).agg(F.min("id").alias("component"), F.count("*").alias("size"))
    return rows.join(per, F.col("klass").eqNullSafe(F.col("k"))).select("id", "component", "size")


QUERIES = {
    "knn_novelty": (
        knn_novelty,
        f"WITH {_SIMS_SQL} SELECT q, count(*) AS neighbours, round(avg(sim) FILTER (rank <= 1), 5) AS sim_k1, round(avg(sim) FILTER (rank <= 5), 5) AS sim_k5, round(avg(sim), 5) AS sim_k25, any_value(near) AS near, arg_min(id, rank) AS top_id FROM k JOIN (SELECT q, count(*) FILTER (sim >= {TAU}) AS near FROM s GROUP BY q) USING (q) GROUP BY q",
    ),
    "hubness": (hubness, f"WITH {_SIMS_SQL} SELECT id, count(*) AS occurrences, CAST(min(rank) AS INT) AS best_rank FROM k GROUP BY id"),
    "combined_fields": (
        combined_fields,
        """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT id, list_transform(range(1, 33), lambda i: CASE WHEN id % 7 = 0 THEN e[i] ELSE 0.6::DOUBLE * e[i] + 0.4::DOUBLE * e[i + 32] END) AS u FROM v)
SELECT id, round(u[1] / sqrt(list_dot_product(u, u)), 5) AS first, round(sqrt(list_dot_product(u, u)), 5) AS norm FROM u""",
    ),
    "linked_groups": (
        linked_groups,
        f"""WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT id, e, sqrt(list_dot_product(e, e)) AS len FROM v),
l AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON b.id < a.id WHERE round(list_dot_product(a.e, b.e) / (a.len * b.len), 9) >= {TAU}), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, b AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other), c AS (SELECT node, least(node, min(other)) AS label FROM r GROUP BY node),
o AS (SELECT id, coalesce(label, id) AS component FROM v LEFT JOIN c ON node = id)
SELECT id, component, count(*) OVER (PARTITION BY component) AS size FROM o""",
    ),
    "mutual_proximity": (mutual_proximity, None),
    "kmeans_clusters": (clusters, None),
    "pca_scores": (principal_scores, None),
    "joint_model": (joint_model, None),
}
