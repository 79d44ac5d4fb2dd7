"""Streams give what batches give; sources and sinks read and write what they say."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalbrook.operators.relabel import Rule
from signalbrook.sources import readers, sinks
from signalbrook.streaming import alerts as SA

T0 = datetime(2024, 1, 1)


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_windowed_counts_late_rows(spark, tmp_path):
    rows = [(T0 + timedelta(minutes=m), "a" if m % 2 else "b", 1.0) for m in (0, 1, 2, 61, 62, 5, 1000)]
    df = spark.createDataFrame(rows, "ts timestamp, k string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run(SA.windowed(stream, "1 hour", ["k"]), "w1")
    batch = df.groupBy(F.window("ts", "1 hour").alias("w"), "k").agg(F.count("*").alias("n")).select("w.start", "k", "n")
    got = {(r.window_start, r.k, r.n) for r in spark.table("w1").collect()}
    want = {tuple(r) for r in batch.collect()}
    assert got <= want and {x for x in want if x[0] < T0 + timedelta(hours=2)} <= got


def test_state_changes_match_batches(spark, tmp_path):
    conds = [1, 1, 1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 1, 0]
    for i in range(0, len(conds), 5):
        part = [("k", T0 + timedelta(minutes=j), bool(c)) for j, c in enumerate(conds) if i <= j < i + 5]
        spark.createDataFrame(part, "k string, ts timestamp, cond boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, cond boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(SA.state_changes(stream, "k", "5m"), "s1", "append")
    got = [(int((r.ts - T0).total_seconds() // 60), r.state, r.version) for r in spark.table("s1").orderBy("ts").collect()]
    assert got == [(0, "pending", 0), (5, "firing", 1), (6, "resolved", 1), (7, "pending", 1), (12, "firing", 2), (13, "resolved", 2)]


def steps(spark, path, batches, schema):
    """A stream that gets one batch after another."""
    for n, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/b{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def minutes(t):
    return (t - T0).total_seconds() / 60


def test_a_key_that_stops_reporting_ends(spark, tmp_path):
    at = lambda k, m, c: (k, T0 + timedelta(minutes=m), c)
    batches = [[at("a", m, True) for m in range(7)] + [at("b", 6, True)], [at("c", 100, False)], [at("c", 101, False)]]
    run(SA.state_changes(steps(spark, str(tmp_path / "in"), batches, "k string, ts timestamp, cond boolean"), "k", "5m", stale="30m"), "s2")
    got = sorted((r.k, minutes(r.ts), r.state, r.version) for r in spark.table("s2").collect())
    assert got == [("a", 0, "pending", 0), ("a", 5, "firing", 1), ("a", 36, "resolved", 1), ("b", 6, "pending", 0), ("b", 36, "inactive", 0)]


def test_notifications_as_in_batches(spark, tmp_path):
    from signalbrook.operators import alerts as A

    times = {"g": [0, 0.2, 1, 3, 4, 9, 40, 300], "h": [2, 2.1]}
    rows = sorted((T0 + timedelta(minutes=m), k) for k, ms in times.items() for m in ms)
    batches = [[(k, t) for t, k in rows[i : i + 3]] for i in range(0, len(rows), 3)] + [[("z", T0 + timedelta(minutes=700))], [("z", T0 + timedelta(minutes=701))]]
    stream = steps(spark, str(tmp_path / "in"), batches, "k string, ts timestamp")
    run(SA.notifications(stream, ["k"]), "n1")
    got = sorted((r.k, minutes(r.sent_at), r.n_changes) for r in spark.table("n1").collect() if r.k != "z")
    batch = spark.createDataFrame([(k, t.replace(), T0 + timedelta(minutes=700)) for t, k in rows], "k string, ts timestamp_ntz, until timestamp_ntz")
    want = sorted((r.k, minutes(r.sent_at), r.n_changes) for r in A.notification_times(batch, ["k"]).collect())
    assert got == want and len({k for k, *_ in got}) == 2


def test_debounced_and_silent(spark, tmp_path):
    at = lambda k, m, sev, on: (k, T0 + timedelta(minutes=m), sev, on)
    batches = [[at("c", 0, "critical", True), at("w", 0, "warning", True), at("short", 0, "warning", True)], [at("short", 3, "warning", False)], [at("x", 20, "warning", True)], [at("y", 21, "warning", False)]]
    run(SA.debounced(steps(spark, str(tmp_path / "a"), batches, "k string, ts timestamp, severity string, firing boolean"), "k"), "d1")
    assert sorted((r.k, minutes(r.fired_at), minutes(r.act_at)) for r in spark.table("d1").collect()) == [("c", 0, 0), ("w", 0, 5)]
    beats = [[("a", T0), ("b", T0)], [("a", T0 + timedelta(minutes=4))], [("a", T0 + timedelta(minutes=8))], [("a", T0 + timedelta(minutes=30))], [("a", T0 + timedelta(minutes=31))]]
    run(SA.gone_silent(steps(spark, str(tmp_path / "b"), beats, "k string, ts timestamp"), "k", "10m"), "g1")
    assert sorted((r.k, minutes(r.last_seen), minutes(r.silent_at)) for r in spark.table("g1").collect()) == [("a", 8, 18), ("b", 0, 10)]


def test_pipeline_stream(spark, tmp_path):
    df = spark.createDataFrame([({"name": "/x"},), ({"name": "y"},)], "labels map<string,string>")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run(SA.pipeline(stream, [Rule(("name",), regex="/.*", action="keep"), Rule(("name",), target="container", regex="/(.*)")], {"host": "h"}), "p1")
    assert [dict(r.labels) for r in spark.table("p1").collect()] == [{"name": "/x", "container": "x", "host": "h"}]


def test_text_and_json_sources(spark, tmp_path):
    (tmp_path / "access.log").write_text("one\ntwo\n")
    got = readers.log_files(spark, str(tmp_path / "*.log"), {"type": "caddy"}, with_file=True).collect()
    assert {(r.line, r.type, r.file) for r in got} == {("one", "caddy", "access.log"), ("two", "caddy", "access.log")}
    (tmp_path / "d.json").write_text(json.dumps({"panels": [{"title": "a", "type": "stat", "targets": [{"expr": "max(up)"}]}]}, indent=1))
    assert [tuple(r) for r in readers.panels(readers.json_document(spark, str(tmp_path / "d.json"))).collect()] == [("a", "stat", "max(up)")]
    assert readers.files_with(spark, str(tmp_path), "panels", "*.json").count() == 1
    row = spark.range(1).select(readers.output_lines(F.lit("a\n\nb\n")).alias("x"), readers.json_rows(F.lit('[{"vmid":1,"status":"running"}]'), "array<struct<vmid:long,status:string>>").alias("y")).first()
    assert row.x == ["a", "b"] and row.y[0].vmid == 1


def test_yaml_sources(spark):
    text = "all:\n  children:\n    docker:\n      hosts:\n        apps: {}\n        infra: {}\n"
    assert {tuple(r) for r in readers.inventory(spark, text).collect()} == {("all", "docker", False), ("docker", "apps", True), ("docker", "infra", True)}
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("cores", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType()))])
    got = readers.yaml_rows(spark, "guests:\n  a: {cores: 2, tags: [x]}\n  b: {}\n", ["guests"], "name", schema)
    assert [tuple(r) for r in got.orderBy("name").collect()] == [("a", 2, ["x"]), ("b", None, None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(T0, 1), (T0 + timedelta(days=20), 2)], "ts timestamp_ntz, v int")
    sinks.append_history(df, str(tmp_path / "h"), max_rows=1)
    sinks.append_history(df, str(tmp_path / "h"))
    kept = sinks.within_retention(spark.read.parquet(str(tmp_path / "h")), "2024-01-25")
    assert [r.v for r in kept.collect()] == [2, 2]
    opened = spark.createDataFrame([(1, 10, None), (2, 20, None)], "id long, t0_ms long, t1_ms long")
    closed = spark.createDataFrame([(1, 15), (3, 9)], "id long, t1_ms long")
    assert {tuple(r) for r in sinks.close_regions(opened, closed).collect()} == {(1, 10, 15), (2, 20, None)}
    assert spark.range(1).select(sinks.rendered("# made\n", F.array(F.lit("a"), F.lit("b")), "\n").alias("x")).first().x == "# made\na\nb\n"


def test_notify_reaches_all_targets(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    seen = []
    q = sinks.notify(stream, str(tmp_path / "c"), lambda b, n: seen.append(("a", b.count())), lambda b, n: seen.append(("b", b.count())), trigger="1 second")
    q.processAllAvailable()
    q.stop()
    assert seen == [("a", 3), ("b", 3)]


def test_request_source(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"ts":"2024-01-01T00:00:00","method":"GET","path":"/a","status":200,"more":1}\nno json\n')
    got = readers.requests(spark, str(tmp_path / "r.json")).orderBy("path").collect()
    assert [(r.method, r.path, r.status) for r in got] == [(None, None, None), ("GET", "/a", 200)]
    run(readers.requests(spark, str(tmp_path), streaming=True).where("path IS NOT NULL"), "req1")
    assert spark.table("req1").count() == 1


def test_silent_at_more_ticks_than_a_row_has_bits(spark):
    rng = random.Random(3)
    ticks = [T0 + timedelta(minutes=17 * i) for i in range(-40, 100)] + [T0 + timedelta(days=40)]
    beats = [(k, T0 + timedelta(minutes=rng.choice([rng.randint(-700, 1800), 17 * rng.randint(-40, 99)]))) for k in ("a", "b", None) for _ in range(60)] + [("a", None), ("odd", T0)]
    expected = [(k,) for k in ("a", "b", "never", None, "a")]
    df, want = spark.createDataFrame(beats, "k string, ts timestamp_ntz"), []
    for k in ("a", "b", "never", None):
        own = [t for x, t in beats if k is not None and x == k and t is not None]
        want += [(str(k), t) for t in ticks if not any(t - timedelta(minutes=30) < x <= t for x in own)]
    got = SA.silent(df, spark.createDataFrame(expected, "k string"), "k", ticks, "30m")
    assert sorted((str(r.k), r.tick) for r in got.collect()) == sorted(want) and len(want) > 200
    assert SA.silent(df, df, "k", [], "30m").count() == 0
    # keys meet their bits, and only what is left of the ticks is unfolded
    assert not [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x and "LeftAnti" in x]
