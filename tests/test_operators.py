import datetime as dt
import itertools
import json
import math

import numpy as np
from pyspark.sql import functions as F

from pricelens.functions import exprs
from pricelens.operators import learning, stats, text, vectors
from pricelens.sources import io
from pricelens.streaming import calibration as streaming


def test_clustered_errors_like_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(6)), int(rng.integers(5)), int(rng.integers(7)), float(rng.random()), float(rng.random()), float(rng.integers(1, 9))) for _ in range(400)]
    df = spark.createDataFrame(rows, "day int, wallet int, market_id int, x double, y double, w double").withColumn("g", F.lit("a"))
    cell = stats.cells(df, ["g"], F.col("w"), F.col("x"), F.col("y"))
    d = np.array(rows)
    w, x, y = d[:, 5], d[:, 3], d[:, 4]

    def variance(score):
        v = 0.0
        for n in (1, 2, 3):
            for keys in itertools.combinations(range(3), n):
                sums: dict = {}
                for row, s in zip(d, score, strict=True):
                    k = tuple(row[list(keys)])
                    sums[k] = sums.get(k, 0) + s
                v += (-1) ** (n + 1) * sum(s * s for s in sums.values())
        return max(v, 0)

    theta = (w * y).sum() / w.sum()
    r = stats.clustered_mean(cell, ["g"]).first()
    assert abs(r["theta"] - theta) < 1e-12 and abs(r["se"] - np.sqrt(variance(w * (y - theta))) / w.sum()) < 1e-12
    xb, yb = (w * x).sum() / w.sum(), theta
    sxx = (w * (x - xb) ** 2).sum()
    b = (w * (x - xb) * (y - yb)).sum() / sxx
    s = stats.clustered_slope(cell, ["g"]).first()
    assert abs(s["b"] - b) < 1e-9 and abs(s["se"] - np.sqrt(variance(w * (x - xb) * (y - yb - b * (x - xb)))) / sxx) < 1e-9


def test_constant_price_has_no_slope(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.5, 1.0)] * 3, "day int, wallet int, market_id int, x double, y double").withColumn("g", F.lit(1))
    assert stats.clustered_slope(stats.cells(df, ["g"], F.lit(1), F.col("x"), F.col("y")), ["g"]).count() == 0


def test_as_of_ties(spark):
    rows = [(1, "e", 0, 10, 1), (2, "e", 10, 20, 0), (3, "e", 11, 30, 1), (4, "f", 50, 60, 1)]
    lives = spark.createDataFrame(rows, "market_id long, event string, t0 long, t1 long, won int")
    strict = {r["market_id"]: (r["before"], r["won_before"]) for r in learning.as_of(lives, "event", False).collect()}
    loose = {r["market_id"]: r["before"] for r in learning.as_of(lives, "event", True).collect()}
    assert strict == {1: (0, 0), 2: (0, 0), 3: (1, 1), 4: (0, 0)} and loose == {1: 0, 2: 1, 3: 1, 4: 0}


def test_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.35,), (0.99,), (1.0,)], "p double")
    got = [tuple(r) for r in df.select(exprs.decile(F.col("p")), exprs.price_bin(F.col("p")), exprs.ladder(F.col("p"), [(0.2, "a"), (0.5, "b")], "c")).collect()]
    assert got == [(1, 0, "a"), (2, 2, "a"), (4, 7, "b"), (10, 19, "c"), (10, 20, "c")]
    n = 11
    q = spark.range(1, n + 1).select(exprs.equal_frequency(F.col("id"), F.lit(n), 4).alias("b"))
    assert [r["b"] for r in q.collect()] == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4, 4]


def test_slug_templates(spark):
    cases = {
        "ethereum-above-2040-on-march-31": "ethereum-above-<NUM>-on-<DATE>",
        "nba-min-okc-2025-02-24": "nba-<TEAM>-<TEAM>-<DATE>",
        "lal-mad-vs-bar-moneyline": "lal-<TEAM>-<TEAM>-moneyline",
        "duplicate-btc-up-4pm-et": "btc-up-<TIME>",
        "top10-by-q3": "top<NUM>-by-<DATE>",
        "series-game2-1pt5-50k": "series-game-<NUM>",
        "": "",
        None: "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "slug string")
    assert {r[0]: r[1] for r in df.select("slug", text.slug_template(F.col("slug"))).collect()} == cases


def test_backward_neighbours_like_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(m)], "id long, vector array<float>")
    got = {(r["q"], r["rank"]): r["id"] for r in vectors.backward_neighbours(spark, df, df, k=3, block=7).collect()}
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q in range(60):
        order = sorted(range(q), key=lambda k: (-round(float(u[q] @ u[k]), 9), k))[:3]
        assert [got.get((q, r + 1)) for r in range(len(order))] == order
    assert (0, 1) not in got


def test_mutual_proximity_like_numpy(spark, tmp_path):
    rng = np.random.default_rng(3)
    m = (rng.normal(size=(700, 8)) + rng.normal(size=(700, 1)) * rng.normal(size=8)).astype(np.float32)
    rows = [(k, [float(x) for x in v], 0) for k, v in enumerate(m)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    u = m.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    z = (s - s.mean(axis=1)[:, None]) / s.std(axis=1, ddof=1)[:, None]
    phi = np.vectorize(lambda x: (1 + math.erf(x / math.sqrt(2))) / 2)(z)
    mp = phi * phi.T
    got = {r["q"]: (r["neighbours"], r["mean_mp"], r["max_mp"]) for r in vectors.mutual_proximity(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(100, 700, 100))
    for q, (n, mean, most) in got.items():
        top = np.sort(mp[q, :q])[::-1][:25]
        assert n == 25 and abs(mean - top.mean()) < 2e-6 and abs(most - top[0]) < 2e-6


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "x", "n": 1}, {"id": "y", "n": None}]))
    assert io.json_array(spark, str(tmp_path / "a.json"), "id string, n long").count() == 2
    (tmp_path / "b.jsonl").write_text('{"id": "x"}\n{"id": "z", "n": 3}\n')
    lines = io.json_lines(spark, str(tmp_path / "b.jsonl"), "id string, n long")
    assert lines.filter("n = 3").count() == 1
    io.write_csv(lines, str(tmp_path / "c"))
    assert sorted(r["id"] for r in io.csv(spark, str(tmp_path / "c"), "id string, n long").collect()) == ["x", "z"]
    tape = spark.createDataFrame([(k % 3, k, f"2024-0{1 + k % 2}") for k in range(20)], "token_id long, ts long, year_month string")
    io.write_tape(tape, str(tmp_path / "t"))
    io.write_tape(tape.filter("year_month = '2024-01'").limit(3), str(tmp_path / "t"))
    assert io.checked_count(spark, str(tmp_path / "t"), 13) == 13
    both = io.parquet_union(spark, str(tmp_path / "t"))
    assert io.since(both, "ts", 10).count() > 0 and io.describe(both).count() == 3


def test_block_source(spark):
    def fetch(a, b):
        if b - a > 3:
            raise OverflowError
        return [(k, f"h{k}") for k in range(a, b + 1)]

    spark.dataSource.register(io.block_source("fake_blocks", "block long, hash string", fetch))
    df = spark.read.format("fake_blocks").option("first", 5).option("last", 42).option("step", 16).load()
    assert sorted(r["block"] for r in df.collect()) == list(range(5, 43))


def test_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    trade = lambda k, hours, p: (k, t0 + dt.timedelta(hours=hours), p, k % 2, 10.0)
    first = [trade(1, 1, 0.15), trade(2, 2, 0.15), trade(2, 2, 0.15), trade(3, 3, 0.95)]
    spark.createDataFrame(first, streaming.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    args = (str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    streaming.run_available(spark, *args)
    spark.createDataFrame([trade(4, 60, 0.5)], streaming.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streaming.run_available(spark, *args)
    rows = {(r["decile"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {(2, 2), (10, 1)}


def test_unique_refuses_repeated_keys(spark):
    import pytest

    from pricelens.operators.robustness import unique

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert unique(rows.filter("v <> 'c'"), "k").count() == 2
    with pytest.raises(Exception, match="repeated key in k"):
        unique(rows, "k").collect()


def test_near_links_like_brute_force(spark):
    import numpy as np

    from pricelens.operators import vectors

    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 6))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>").repartition(4)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(a, b) for a in range(90) for b in range(a) if round(float(u[a] @ u[b]), 9) >= 0.5}
    assert {(r["q"], r["id"]) for r in vectors.near_links(spark, df, df, 0.5, block=17).collect()} == want


def test_linked_groups_like_brute_force(spark, tmp_path, monkeypatch):
    """Groups, chains and rows alone, in many cells; no row is fetched by the driver but the seeds."""
    from pyspark.sql.classic.dataframe import DataFrame

    rng = np.random.default_rng(8)
    base = np.vstack([np.eye(24)[k] + 0.02 * rng.normal(size=(9, 24)) for k in range(10)] + [np.eye(24)[10 + k // 3] + np.eye(24)[(10 + (k + 2) // 3)] for k in range(25)] + [np.eye(24)[21:23]])
    x = base[rng.permutation(len(base))].astype(np.float32)
    rows = [(3 * k, [float(c) for c in v], 0) for k, v in enumerate(x)] + [(1000, None, 0)]
    rows.append((0, [0.0] * 23 + [1.0], 0))  # a second row of id 0, and what is near that
    rows.append((1001, [0.0] * 23 + [2.0], 0))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    label = {r[0]: r[0] for r in rows}
    u = [(r[0], np.array(r[1], dtype=float) / np.linalg.norm(r[1])) for r in rows if r[1]]
    links = [(a, b) for a, p in u for b, q in u if b < a and round(float(p @ q), 9) >= vectors.TAU]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    size = {k: sum(label[r[0]] == k for r in rows) for k in set(label.values())}
    assert len(size) > 10
    want = sorted((r[0], label[r[0]], size[label[r[0]]]) for r in rows)
    fetched = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda self, *a, **b: fetched.append(len(rows)) or iter(collect(self)))
    monkeypatch.setattr(DataFrame, "collect", lambda self: fetched.append(len(out := collect(self))) or out)
    for seeds, numbers in ((3, 24 * 7), (200, 1 << 21), (1, 24 * 50)):
        monkeypatch.setattr(vectors, "SEEDS", seeds, raising=False)
        monkeypatch.setattr(vectors, "PART_NUMBERS", numbers, raising=False)
        out = vectors.linked_groups(spark, str(tmp_path))
        assert seeds == 200 or max(fetched) <= 3
        assert sorted(map(tuple, collect(out))) == want
        fetched.clear()
