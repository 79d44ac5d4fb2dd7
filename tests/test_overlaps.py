"""Regions and the points they hold: what is shuffled, how both are joined, and regions of all lengths."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from signalbrook.operators import inventory as I
from signalbrook.plans import queries as Q


def shuffled(spark, run):
    """What run gives, and how many rows were shuffled for it."""
    store = spark._jsparkSession.sparkContext().statusStore()

    def stages():
        seq = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteRecords() for s in map(seq.apply, range(seq.size()))}

    before = stages()
    out = run()
    return out, sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize("name,kind", [("annotation_overlap", "error"), ("annotation_overlap_signups", "signup")])
def test_a_point_is_shuffled_once(spark, tmp_path, name, kind):
    rng = random.Random(4)
    rows = [(i, datetime(2024, 1, 1) + timedelta(milliseconds=rng.randrange(5 * 86_400_000)), 0, rng.choice(["error", "signup", "click", "view", "purchase"])) for i in range(3000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    df = Q.QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got, n = shuffled(spark, lambda: sorted(tuple(r) for r in Q.QUERIES[name](spark, str(tmp_path)).select("event_id", "id").collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT *, 0.0 AS value FROM '{tmp_path}/events.parquet/*.parquet'")
    con.execute("CREATE TABLE orders (o_orderkey INT, o_custkey INT, o_orderstatus VARCHAR, o_orderpriority VARCHAR)")
    assert got == sorted(con.sql(Q.SQL[name]).fetchall()) and len(got) > len(rows)
    assert n <= len(rows) + 9 * sum(r[3] == kind for r in rows)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan  # files say little of how much a table unpacks to


def test_regions_of_all_lengths(spark):
    rng = random.Random(8)
    regions = [(i, a := rng.choice([-1, 1]) * rng.randrange(1 << rng.randrange(1, 42)), rng.choice([None, a - 5, a, *[a + rng.randrange(1 << rng.randrange(1, 40))] * 9])) for i in range(400)]
    regions += [(400 + i, a, a + n * 65_536 + d) for i, (a, n, d) in enumerate((a, n, d) for a in (0, -65_536, 65_535) for n in (1, 15, 16, 17, 255, 256, 272, 4096) for d in (-1, 0, 1))]
    regions += [(900, None, 5), (901, None, None)]
    ends = [x for _, a, b in regions for x in (a, b) if x is not None]
    points = [(i, t) for i, t in enumerate(sorted({x + d for x in rng.sample(ends, 300) for d in (-1, 0, 1)} | {rng.randrange(-(1 << 41), 1 << 41) for _ in range(100)}))] + [(-1, None)]
    df = spark.createDataFrame(regions, "id int, a long, b long")
    got = [tuple(r) for r in I.overlapping(spark.createDataFrame(points, "p int, t long"), df, "t", "a", "b").select("p", "id").collect()]
    want = {(p, i) for p, t in points for i, a, b in regions if t is not None and a is not None and a <= t <= max(a if b is None else b, a)}
    assert len(got) == len(set(got)) and set(got) == want


def test_levels_asked_for():
    assert I._levels({0: 10, 4: 100}) == [4]
    assert I._levels({0: 5, 4: 60, 8: 1000}) == [8]
    assert I._levels({0: 5, 4: 60, 8: 500}) == [4, 8]  # with what came from below, too many for the next
    assert I._levels({0: 10, 4: 70, 8: 1000}) == [0, 8]
    assert I._levels({0: 10, 8: 1000}) == [0, 8]  # not over two levels at once
    assert I._levels({}) == []
