"""Registered queries over their whole tables, against brute force on rows made for it."""

from datetime import datetime, timedelta

import duckdb
import pytest

from signalbrook.plans import queries as Q

START = datetime(2024, 1, 5)


def events(spark, path, rows):
    """rows(event_id, minutes after START, user_id, event_type) as the table of events."""
    made = [(i, START + timedelta(minutes=m), u, kind) for i, m, u, kind in rows]
    spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{path}/events.parquet")
    return made


def test_every_signup_is_a_region(spark, tmp_path):
    rows = events(spark, tmp_path, [(i, i * 37 % 600, i % 5, ("signup", "click", "error")[i % 7 % 3]) for i in range(1, 120)])
    want = {(p[0], r[0]) for r in rows if r[3] == "signup" for p in rows if r[1] <= p[1] <= r[1] + timedelta(hours=2 if r[0] % 3 else 0)}
    got = [tuple(r) for r in Q.QUERIES["annotation_overlap_signups"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r for _, r in want} == {r[0] for r in rows if r[3] == "signup"}


@pytest.mark.parametrize("name,kind", [("annotation_overlap", "error"), ("annotation_overlap_signups", "signup")])
def test_regions_and_points_are_rounded_to_milliseconds_as_in_sql(spark, tmp_path, name, kind):
    at = [datetime(2024, 1, 24, 1, 5, 38) + timedelta(microseconds=us) for us in (791396, 791536, 791500, 791499, 792499, 792500)]
    at += [datetime(1969, 12, 31, 23, 59, 59) + timedelta(microseconds=us) for us in (999500, 999499, 999501, 998500, 998501)]
    rows = [(i * len(at) + j, t, 0, (kind, "click")[i % 2]) for i in range(6) for j, t in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT *, 0.0 AS value FROM '{tmp_path}/events.parquet/*.parquet'")
    con.execute("CREATE TABLE orders (o_orderkey INT, o_custkey INT, o_orderstatus VARCHAR, o_orderpriority VARCHAR)")
    want = con.sql(Q.SQL[name]).fetchall()
    assert sorted(tuple(r) for r in Q.QUERIES[name](spark, str(tmp_path)).select("event_id", "id").collect()) == sorted(want) and want
