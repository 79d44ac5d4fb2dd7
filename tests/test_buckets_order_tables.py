"""Leaky buckets, threads, keyed tables, rotation, YAML files, reference layers and rule states."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalbrook.model import SAMPLES
from signalbrook.operators import buckets as B
from signalbrook.operators import inventory as I
from signalbrook.operators import pieces as P
from signalbrook.operators import probes as PR
from signalbrook.plans import rules
from signalbrook.sources import readers, sinks
from signalbrook.streaming import alerts as SA

from .test_streams_and_sources import minutes, run, steps

T0 = datetime(2024, 1, 1)


def sec(s):
    return T0 + timedelta(seconds=s)


def poured(times, drip, full):
    """Level after each, and whether it runs over, in order of time."""
    level, last, out = 0, 0, []
    for t in sorted(times):
        had, level, last = level, max(level - (t - last), 0) + drip, t
        out.append((t, level, had <= full < level))
    return out


BURST, DRIP = [0, 1, 2, 3, 4, 5, 40, 41, 42, 43, 200], [0, 30, 61, 90, 125, 150, 180, 215]


@pytest.mark.parametrize("span", ["1d", "20s"])
def test_levels(spark, span):
    rng = random.Random(6)
    times = {"burst": BURST, "drip": DRIP, None: [5, 5, 5, 5, 5], "many": [rng.randint(0, 2000) for _ in range(200)]}
    df = spark.createDataFrame([(k, sec(s), i) for k, ts in times.items() for i, s in enumerate(ts)] + [("burst", None, 99)], "k string, ts timestamp_ntz, i int").repartition(3)
    got = B.levels(df, ["k"], "10s", 3, ties=["i"], span=span)
    found = sorted((str(r.k), int((r.ts - T0).total_seconds() * 1000), r.level_ms, r.overflow) for r in got.collect())
    want = sorted((str(k), *x) for k, ts in times.items() for x in poured([1000 * t for t in ts], 10_000, 30_000))
    assert found == want
    over = {str(k): sum(x[2] for x in poured([1000 * t for t in ts], 10_000, 30_000)) for k, ts in times.items()}
    assert over["burst"] == 2 and over["drip"] == 0 and over["None"] == 1 and over["many"] > 3


def test_streamed_buckets_agree_with_batches(spark, tmp_path):
    rng = random.Random(7)
    rows = [("burst", s) for s in BURST] + [("drip", s) for s in DRIP] + [("many", rng.randint(0, 900)) for _ in range(80)]
    rows.sort(key=lambda r: r[1])
    late = [r for i, r in enumerate(rows) if i % 9 == 4]  # each comes a batch later
    batches, held = [], []
    for i in range(0, len(rows), 12):
        part = [r for r in rows[i : i + 12] if r not in late]
        batches.append([(k, sec(s)) for k, s in part + held])
        held = [r for r in rows[i : i + 12] if r in late]
    batches.append([(k, sec(s)) for k, s in held] + [("end", sec(5000))])
    batches += [[("end", sec(9000))], [("end", sec(9500))]]
    stream = steps(spark, str(tmp_path / "in"), batches, "k string, ts timestamp")
    run(SA.leaking(stream, ["k"], "10s", 3, late="10 minutes"), "lb1")
    got = sorted((r.k, int((r.ts - T0).total_seconds()), r.level_ms) for r in spark.table("lb1").collect() if r.k != "end")
    df = spark.createDataFrame([(k, sec(s)) for k, s in rows], "k string, ts timestamp_ntz")
    want = sorted((r.k, int((r.ts - T0).total_seconds()), r.level_ms) for r in B.levels(df, ["k"], "10s", 3).where("overflow").collect())
    assert got == want and {"burst", "many"} == {k for k, *_ in got}


def test_status_events_meet_their_thread(spark, tmp_path):
    event = lambda g, m, kind: (g, T0 + timedelta(minutes=m), kind, None)
    opening = lambda g, m, channel: (g, T0 + timedelta(minutes=m), None, channel)
    batches = [
        [event("early", 0, "ack"), event("early", 1, "resolve"), event("never", 2, "ack"), opening("usual", 0, "c1")],
        [opening("early", 3, "c2"), event("usual", 5, "resolve")],
        [event("early", 6, "reopen"), opening("usual", 7, "c3"), event("usual", 8, "ack")],
        [event("z", 200, "tick")], [event("z", 400, "tick")], [event("usual", 20_000, "after a week"), event("z", 20_001, "tick")], [event("z", 20_200, "tick")], [event("z", 20_201, "tick")],
    ]
    both = steps(spark, str(tmp_path / "in"), batches, "group_id string, ts timestamp, kind string, channel_id string")
    again = spark.readStream.schema(both.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run(SA.with_threads(both.where("kind IS NOT NULL").drop("channel_id"), again.where("kind IS NULL").drop("kind")), "th1")
    rows = [(r.group_id, minutes(r.ts), r.kind, r.channel_id) for r in spark.table("th1").collect()]
    assert sorted(r for r in rows if r[0] != "z") == sorted([
        ("early", 0, "ack", "c2"), ("early", 1, "resolve", "c2"), ("early", 6, "reopen", "c2"), ("never", 2, "ack", None), ("usual", 5, "resolve", "c1"), ("usual", 8, "ack", "c3"),
        ("usual", 20_000, "after a week", None),
    ])
    assert [r[1] for r in rows if r[0] == "early"] == [0, 1, 6]


def table_of(t):
    return sorted((r.k, r.n, r.v) for r in t.rows().collect())


def test_keyed_table(spark, tmp_path, monkeypatch):
    schema = "k long, n long, v string"
    df = lambda rows: spark.createDataFrame(rows, schema)
    t = sinks.KeyedTable(spark, str(tmp_path / "t"), "k", "n", schema, buckets=8)
    assert table_of(t) == []
    assert t.upsert(df([(i, 1, "a") for i in range(40)] + [(3, 2, "b"), (None, 1, "x")]), 0)
    first = {i: (i, 1, "a") for i in range(40)} | {3: (3, 2, "b")}
    assert table_of(t) == sorted(first.values())
    assert not t.upsert(df([(1, 9, "again")]), 0) and table_of(t) == sorted(first.values())

    # stopped between the write and the swap: the table is whole, and the batch may be sent again
    def stopped(manifest):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(t, "_swap", stopped)
        t.upsert(df([(1, 5, "c")]), 1)
    assert table_of(t) == sorted(first.values())
    # only the bucket of a changed key is read and written
    before = t._manifest()["folders"]
    own = str(df([(1, 5, "c")]).select(F.pmod(F.xxhash64("k"), F.lit(8))).first()[0])
    import glob
    import os

    moved = [f for b, folder in before.items() if b != own for f in glob.glob(f"{tmp_path}/t/{folder}/*.parquet")]
    for f in moved:
        os.rename(f, f + ".away")
    assert t.upsert(df([(1, 5, "c"), (1, 4, "older")]), 1)
    for f in moved:
        os.rename(f + ".away", f)
    after = t._manifest()["folders"]
    assert {b for b in after if after[b] != before[b]} == {own}
    assert table_of(t) == sorted((first | {1: (1, 5, "c")}).values())
    # other writers have ledgers of their own; a version that is there already is not overwritten
    assert t.upsert(df([(50, 1, "w")]), 0, "other") and t.upsert(df([]), 1, "other")
    stale = t._manifest() | {"version": t._manifest()["version"]}
    with pytest.raises(RuntimeError, match="another writer"):
        t._swap(stale)
    assert t.vacuum() >= 1 and len(table_of(sinks.KeyedTable(spark, str(tmp_path / "t"), "k", "n"))) == 41
    with pytest.raises(ValueError):
        sinks.KeyedTable(spark, str(tmp_path / "none"), "k", "n")


def greedy(sizes, limit):
    file, used, out = 0, 0, []
    for i, s in enumerate(sizes):
        if i and used + s > limit:
            file, used = file + 1, 0
        used += s
        out.append(file)
    return out


@pytest.mark.parametrize("span", [65536, 5])
def test_rotation_by_exact_size(spark, tmp_path, span):
    rng, rows = random.Random(9), []
    for k, n in (("a", 120), ("b", 7)):
        rows += [(k, i, rng.choice(["x" * rng.randint(0, 30), "é" * 5, "y" * 90]) if i % 11 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, line string").withColumn("file", F.lit("mine")).repartition(3)
    got = sorted((r.k, r.i, r.file) for r in sinks.rotated(df, ["k"], "i", 80, span=span).collect())
    want = [(k, i, f) for k in "ab" for i, f in enumerate(greedy([len((x or "").encode()) + 1 for a, _, x in rows if a == k], 80))]
    assert got == want and max(f for _, _, f in want) > 20
    if span > 5:
        sinks.write_rotated(df, str(tmp_path / "logs"), ["k"], "i", 80, keep=3)
        back = spark.read.text(str(tmp_path / "logs")).groupBy("k", "file").agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.count("*").alias("n")).collect()
        last = {k: max(f for x, _, f in want if x == k) for k in "ab"}
        assert {(r.k, r.file) for r in back} == {(k, f) for k in "ab" for f in range(max(0, last[k] - 2), last[k] + 1)}
        assert {(r.k, r.file): r.n for r in back} == {(k, f): sum((a, b) == (k, f) for a, _, b in want) for k, f in {(r.k, r.file) for r in back}}


def test_yaml_files_are_parsed_in_tasks(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"sub{i % 3}").mkdir(exist_ok=True)
        (tmp_path / f"sub{i % 3}" / f"f{i}.yaml").write_text(f"guests:\n  g{i}: {{cores: {i}, tags: [a, !Find [x, y]]}}\n  bare{i}:\n---\nsecond: !Ref 'é{i}'\n")
    (tmp_path / "torn.yaml").write_text("a: [1, 2\n")
    (tmp_path / "empty.yaml").write_text("")
    docs = readers.yaml_documents(spark, str(tmp_path)).cache()
    assert docs.count() == 81 and [r.path.split("/")[-1] for r in docs.where("error IS NOT NULL").collect()] == ["torn.yaml"]
    assert {json.loads(r.body)["second"] for r in docs.where("nth = 1").collect()} == {f"é{i}" for i in range(40)}
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("cores", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType()))])
    got = {r.name: (r.cores, r.tags) for r in readers.yaml_entries(docs, ["guests"], "name", schema).collect()}
    assert got["g7"] == (7, ["a", '["x","y"]']) and got["bare3"] == (None, None) and len(got) == 80
    assert "MapInArrow" in readers.yaml_documents(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    stream = readers.yaml_documents(spark, str(tmp_path), stream=True)
    run(stream, "yaml1")
    assert spark.table("yaml1").count() == 81


def test_yaml_inventories(spark, tmp_path):
    (tmp_path / "i.yaml").write_text("fleet:\n  hosts:\n    kite:\n  children:\n    wheeled:\n      hosts: {van: {n: 1}, lorry: {}}\n      children: {small: {hosts: {trike: }}}\n    boats:\n")
    got = {tuple(r) for r in readers.yaml_edges(readers.yaml_documents(spark, str(tmp_path))).collect()}
    assert got == {("fleet", "kite", True), ("fleet", "wheeled", False), ("fleet", "boats", False), ("wheeled", "van", True), ("wheeled", "lorry", True), ("wheeled", "small", False), ("small", "trike", True)}


def test_layers_of_many_objects_and_circles(spark):
    rng = random.Random(10)
    n = 10_000
    links = [(f"o{i}", f"o{rng.randrange(i // 2, i) if i % 3 else i // 5}") for i in range(1, n)] + [(f"o{i}", f"o{rng.randrange(i // 4)}") for i in range(400, n, 7)]
    links = [x for x in links if rng.random() > 0.5] + [("o1", "unknown"), ("o3", None)]
    circle = [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("waits", "c1"), ("waits more", "waits"), ("self", "self"), ("c1", "o5")]
    names = [f"o{i}" for i in range(n)] + ["c1", "c2", "c3", "waits", "waits more", "self", None]
    df = spark.createDataFrame([(x, "mine") for x in names], "k string, layer string").repartition(4)
    got = {r.k: (r.layer, r.in_cycle) for r in I.layers(df, spark.createDataFrame(links + circle + circle, "child string, parent string"), "k").collect()}
    parents, want = {}, {}
    for c, p in links:
        if p and p != "unknown":
            parents.setdefault(c, set()).add(p)
    for i in range(n):
        want[f"o{i}"] = 1 + max((want[p] for p in parents.get(f"o{i}", ())), default=-1)
    assert {k: v for k, v in got.items() if k and k[0] == "o"} == {k: (v, None) for k, v in want.items()} and max(want.values()) > 5
    assert {k: v for k, v in got.items() if k is None or k[0] != "o"} == {**dict.fromkeys(["c1", "c2", "c3", "self"], (None, True)), "waits": (None, False), "waits more": (None, False), None: (None, None)}


def test_a_region_of_ten_years_takes_few_rows(spark):
    rng = random.Random(12)
    year = 365 * 86_400_000
    regions = [("decade", 0, 10 * year), ("point", 5, None), ("back", 50, 10), ("before", -3 * year, -1)] + [(f"r{i}", a := rng.randint(-year, year), a + rng.randint(0, year)) for i in range(40)]
    points = [(i, rng.choice([rng.randint(-2 * year, 11 * year), rng.randint(-year, year), rng.choice(regions)[1]])) for i in range(300)]
    df = spark.createDataFrame(regions, "id string, a long, b long")
    cover = df.select("id", F.size(I.dyadic_cover(F.floor(F.col("a") / 65536), F.floor(F.greatest(F.coalesce("b", "a"), "a") / 65536), 48)).alias("n")).collect()
    assert 0 < max(r.n for r in cover) < 50
    got = {(r.p, r.id) for r in I.overlapping(spark.createDataFrame(points, "p long, t long"), df, "t", "a", "b").collect()}
    assert got == {(p, i) for p, t in points for i, a, b in regions if a <= t <= max(a if b is None else b, a)}
    assert I.overlapping(spark.createDataFrame(points, "p long, t long"), df.limit(0), "t", "a", "b").count() == 0


def test_each_rule_has_a_state(spark):
    df = spark.createDataFrame([("g", {"a": "x"}, T0, 5.0)], SAMPLES)
    step = {"kind": "series", "metric": "g"}
    docs = [
        {"alert": "good", "expr": step}, {"alert": "empty", "expr": {"kind": "compare", "op": ">", "number": 9, "of": step}}, {"alert": "no kind", "expr": {"kind": "nothing"}},
        {"alert": "at run time", "expr": {**step, "where": [["a", "=~", "(x"]]}}, {"alert": "no expression"},
    ]
    got = {r.alert: (r.state, r.n, r.message is None) for r in rules.state_of_each(df, docs, "2024-01-01 00:01:00").collect()}
    assert got == {"good": ("alerting", 1, True), "empty": ("ok", 0, True), "no kind": ("error", None, False), "at run time": ("error", None, False), "no expression": ("error", None, False)}
    assert {r.alert: r.state for r in rules.state_of_each(df, docs[:2], "2024-01-01 00:01:00", no_data="nodata").collect()} == {"good": "alerting", "empty": "nodata"}
    assert rules.state_of_each(df, [], "2024-01-01 00:01:00").count() == 0


def test_conditions_are_read_once(spark):
    rows = [("[STATUS] == 200", 200, True), ("[STATUS] != 200", 200, False), ("[STATUS] <= 200", 200, True), ("[STATUS] < 200", 199, True), ("[STATUS] >= 200", None, False), ("[STATUS] > x", 200, False), ("STATUS == 200", 200, False), ("[BODY] == ok go", None, True), ("[BODY] != ok go", None, False), (None, 200, False)]
    df = spark.createDataFrame([([c], s, "ok go", None, None, want) for c, s, want in rows] + [([], 1, "", None, None, True), (None, 1, "", None, None, False)], "conditions array<string>, status int, body string, dns_rcode string, cert_expiry_s long, want boolean")
    found = PR.eval_conditions(df)
    assert [r.success for r in found.collect()] == [r.want for r in df.collect()]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count("RLIKE") + plan.count("rlike") <= 2


def test_places_of_a_whole_table(spark):
    df = spark.range(0, 500, 1, 5).select((F.col("id") * 37 % 500).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("o"))
    got = [(r.o, r.k) for r in P.placed(df, [F.coalesce("o", F.lit(1)), F.col("k")], "starts").orderBy("starts").collect()]
    assert got == sorted(got, key=lambda r: (1 if r[0] is None else r[0], r[1])) and len(got) == 500
    plan = P.placed(df, [F.col("k")], "starts")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 1  # the counts of the ranges


def test_rounds_of_layers_write_only_what_they_find(spark, monkeypatch):
    real, written = I.settled, []

    def counted(df):
        out = real(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(I, "settled", counted)
    n = 300
    links = [(i, i - 1) for i in range(1, 6)] + [(i, 5) for i in range(6, n)]  # a chain, and all others wait for its end
    got = {r.k: r.layer for r in I.layers(spark.range(n).withColumnRenamed("id", "k"), spark.createDataFrame(links, "child long, parent long"), "k").collect()}
    assert got == {i: min(i, 6) for i in range(n)}
    assert sum(written) < 5 * n
