import datetime as dt
import random

import duckdb

from pricelens.operators import traders


def test_closed_markets_adds_in_order(spark, tmp_path):
    """Averages of exactly 0.6 or 0.4 fall on the side that adding from the latest trade on gives, as the SQL's do on one
    thread, also if the aggregate spills every third row."""
    rng = random.Random(3)
    lines, want = [], {}
    for part, low in enumerate([False, True] * 40):
        q = [16, 44, 38, 32, 26, 39, 31, 30, 13, 37]
        rng.shuffle(q)
        q = [51 - x for x in q] if low else q
        total = 0.0
        for k, x in enumerate(q):
            total += x / 51.0
            lines.append((part, part, 1, 1, float(x), 10.0, "A", "O", dt.datetime(2001, 1, 20 - k)))
        p = total / 10
        want[part * 2 + 1] = "up" if p >= 0.6 else "down" if p <= 0.4 else "open"
    lines.append((80, 80, 1, 1, None, 10.0, "A", "O", dt.datetime(2001, 1, 1)))
    want[161] = "open"
    assert set(want.values()) == {"up", "down", "open"}
    tables = {
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "orders": spark.range(81).selectExpr("id o_orderkey", "1L o_custkey", "'1-URGENT' o_orderpriority"),
        "part": spark.range(81).selectExpr("id p_partkey", "'x' p_name", "'b' p_brand", "'t' p_type", "2 p_size"),
    }
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'; SET threads = 1")
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    sql = sorted(con.execute(f"SELECT token_id, n, p, state FROM ({traders.QUERIES['closed_markets'][1]})").fetchall())
    assert {r[0]: r[3] for r in sql} == want
    forced = "spark.sql.TungstenAggregate.testFallbackStartsAt"
    for spill in (None, "0, 3"):
        if spill:
            spark.conf.set(forced, spill)
        try:
            got = traders.closed_markets(spark, str(tmp_path)).select("token_id", "n", "p", "state").collect()
        finally:
            spark.conf.unset(forced)
        assert sorted(map(tuple, got)) == sql, spill
