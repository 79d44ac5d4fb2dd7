"""Rules and ranges over a grid of times, and long series in pieces, against what one time or one pass over a series gives."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from signalbrook.model import SAMPLES
from signalbrook.operators import alerts as A
from signalbrook.operators import grid as G
from signalbrook.operators import pieces as P
from signalbrook.operators import ranges as R
from signalbrook.operators import selectors as S
from signalbrook.plans import rules

T0 = datetime(2024, 1, 1, 10)


def made(spark, n=300, seed=2, series=("a", "b", "c"), span_s=3600):
    """Counters with falls, gaps and repeated times; series c is silent in the middle."""
    rng, rows = random.Random(seed), []
    for k in series:
        value = 0
        for _ in range(n):
            s = rng.randint(-900, span_s) if rng.random() < 0.8 else rng.randrange(0, span_s, 60)
            if k == "c" and 600 < s < 2400:
                continue
            rows.append((k, s))
    rows.sort(key=lambda r: r[1])
    out, value = [], dict.fromkeys(series, 0)
    for k, s in rows:
        value[k] = 1 if rng.random() < 0.05 else value[k] + rng.randint(0, 5)
        out.append(("m", {"k": k}, T0 + timedelta(seconds=s), float(value[k])))
    out += [("other", {"k": "a"}, T0, 5.0), ("m", {"k": "lone"}, T0 + timedelta(seconds=61), 7.0)]
    return spark.createDataFrame(out, SAMPLES).repartition(3).cache()


@pytest.fixture(scope="module")
def samples(spark):
    return made(spark)


@pytest.fixture(params=[16, 1])
def wide(request, monkeypatch):
    """Spans that hold the whole grid, and spans of one window."""
    monkeypatch.setattr(G, "WIDE", request.param)
    return request.param


def rows(df, digits=9):
    return sorted((r.series_key, r.eval_ts, round(r.value, digits)) for r in df.collect())


def ticks(grid):
    start, end = datetime.fromisoformat(grid.start), datetime.fromisoformat(grid.end)
    step = timedelta(seconds=R.seconds(grid.step))
    return [start + i * step for i in range(int((end - start) / step) + 1)]


def test_instant_is_the_lookup_at_each_time(samples, wide):
    grid = G.Grid("2024-01-01 10:00:00", "2024-01-01 11:05:00", "10m")
    want = sorted((r.series_key, t, r.value) for t in ticks(grid) for r in S.select_series(samples, "m", [], t, "3m").collect())
    assert rows(G.instant(samples, "m", [], grid, "3m")) == want and want


@pytest.mark.parametrize(("width", "step"), [("5m", "1m"), ("1m", "7m"), ("90s", "60s")])
def test_overlapping_ranges_are_those_of_samples_copied(spark, samples, wide, width, step):
    grid = G.Grid("2024-01-01 10:00:00", "2024-01-01 11:00:00", step)
    us = grid.micros()
    keyed = samples.where("metric = 'm'").withColumn("series_key", S.series_key("labels"))
    w = int(R.seconds(width)) * 1_000_000
    at = F.explode(F.filter(F.sequence(F.lit(us[0]), F.lit(us[1]), F.lit(us[2])), lambda t: (t - w < P.micros("ts")) & (t >= P.micros("ts"))))
    copied = keyed.withColumn("t", at).withColumn("eval_ts", P.at_micros(F.col("t"))).drop("t")
    copied = copied.cache()
    assert rows(G.increase(samples, "m", [], grid, width)) == rows(R.increase(copied, ["eval_ts"])) != []
    assert rows(G.rate(samples, "m", [("k", "=", "a")], grid, width)) == rows(R.rate(copied.where("labels['k'] = 'a'"), width, ["eval_ts"]))
    for fn in ("avg", "sum", "min", "max", "count", "last"):
        assert rows(G.over_time(samples, "m", [], grid, width, fn)) == rows(R.over_time(copied, fn, ["eval_ts"])), fn


def test_sliding_agrees(samples):
    keyed = samples.where("metric = 'm'").withColumn("series_key", S.series_key("labels"))
    grid = G.Grid("2024-01-01 09:40:00", "2024-01-01 11:10:00", "1m")
    assert rows(G.increase(samples, "m", [], grid, "5m")) == rows(R.increase(R.sliding(keyed, "5m", "1m"), ["eval_ts"]))


def test_absence_at_each_time(spark, samples, wide):
    grid = G.Grid("2024-01-01 09:30:00", "2024-01-01 12:00:00", "5m")
    for matchers in ([("k", "=", "c"), ("k", "=~", ".*")], [("k", "=", "none")], []):
        got = [(r.eval_ts, dict(r.labels), r.value) for r in G.absent(samples, "m", matchers, grid, "4m").orderBy("eval_ts").collect()]
        want = [(t, dict(r.labels), 1.0) for t in ticks(grid) for r in R.absent_over_time(S.range_series(samples, "m", matchers, t, "4m"), matchers).collect()]
        assert got == want


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_one_shuffle_by_series_whatever_the_overlap(spark, samples):
    grid = G.Grid("2024-01-01 10:00:00", "2024-01-01 11:00:00", "1m")
    assert exchanges(G.instant(samples, "m", [], grid, "5m")) == 1
    assert exchanges(G.increase(samples, "m", [], grid, "5m")) == 1
    for width in ("5m", "60m"):  # rows that are shuffled: the samples, and at most one in WIDE of them again
        reach = int(R.seconds(width)) * 1_000_000
        base = G._rows(samples, "m", [], grid, reach)
        assert G._spread(base, grid, reach)[0].count() <= base.count() * (1 + 2 / G.WIDE)


def test_rules_at_each_time(spark, samples):
    docs = [
        {"alert": "Fast", "hold": "4m", "labels": {"severity": "warning"}, "annotations": {"text": '{{ $labels.k }}: {{ printf "%.2f" $value }}'},
         "expr": {"kind": "compare", "op": ">", "number": 0.2, "of": {"kind": "rate", "metric": "m", "width": "3m"}}},
        {"alert": "Sum", "expr": {"kind": "compare", "op": ">", "number": 300, "of": {"kind": "aggregate", "fn": "sum", "by": [], "of": {"kind": "series", "metric": "m", "lookback": "2m"}}}},
        {"alert": "Share", "expr": {"kind": "arithmetic", "op": "/", "left": {"kind": "increase", "metric": "m", "width": "5m"}, "right": {"kind": "over_time", "fn": "max", "metric": "m", "width": "5m"}}},
        {"alert": "Two", "expr": {"kind": "top", "k": 2, "of": {"kind": "over_time", "metric": "m", "width": "5m"}}},
        {"alert": "Any", "expr": {"kind": "any", "parts": [{"kind": "absent", "metric": "m", "width": "2m", "where": [("k", "=", "c")]}, {"kind": "series", "metric": "m", "where": [("k", "=", "b")]}]}},
        {"alert": "All", "expr": {"kind": "all", "parts": [{"kind": "series", "metric": "m"}, {"kind": "compare", "op": ">", "number": 5, "of": {"kind": "increase", "metric": "m", "width": "5m"}}]}},
    ]
    grid = G.Grid("2024-01-01 10:10:00", "2024-01-01 10:50:00", "4m")
    for rule, expr in rules.from_documents(docs):
        each = rules.evaluate_range(samples, rule, expr, grid).cache()
        want = {}
        for t in ticks(grid):
            for r in rules.evaluate_at(samples, rule, expr, str(t)).collect():
                want[r.series_key, t] = (round(r.value, 9), dict(r.labels), dict(r.annotations))
        got = {(r.series_key, r.eval_ts): (round(r.value, 9), dict(r.labels), dict(r.annotations)) for r in each.where("cond").collect()}
        assert got == want and got, rule.alert
        off = {(r.series_key, r.eval_ts) for r in each.where("NOT cond").collect()}
        step = timedelta(minutes=4)
        assert off == {(k, t + step) for k, t in want if (k, t + step) not in want and t + step <= ticks(grid)[-1]}
        state, since = {}, {}
        for k, t in sorted(want, key=lambda x: x[1]):
            since[k, t] = since.get((k, t - step), t)
            state[k, t] = "firing" if (t - since[k, t]).total_seconds() >= R.seconds(rule.hold) else "pending"
        found = {(r.series_key, r.eval_ts): (r.state, r.active_at) for r in rules.states(samples, rule, expr, grid).where("cond").collect()}
        assert found == {x: (state[x], since[x]) for x in state}
    assert {"firing", "pending"} == {r.state for r in rules.states(samples, *rules.from_documents(docs)[0], grid).where("cond").collect()}


# Series in pieces


def conditions(spark, seed=4):
    rng, out = random.Random(seed), []
    for k, n in (("hot", 400), ("b", 30), (None, 25), ("one", 1)):
        chance = 0.9 if k == "hot" else 0.6
        times = sorted(rng.sample(range(4 * n), n))
        out += [(k, T0 + timedelta(minutes=m), None if rng.random() < 0.03 else rng.random() < chance) for m in times]
    return out, spark.createDataFrame(out, "k string, ts timestamp_ntz, cond boolean").repartition(3)


@pytest.mark.parametrize("span", ["1d", "1h", "7m"])
def test_runs_in_pieces(spark, span):
    made, df = conditions(spark)
    got = {(r.k, r.ts): (r.run_start, r.run_length, r.run_ended) for r in P.runs(df, ["k"], F.col("cond"), "ts", span).collect()}
    want, last = {}, {}
    for k, t, on in sorted(made, key=lambda r: r[1]):
        start, n = last.get(k, (None, 0))
        ended = None if on else start
        start, n = (start or t, n + 1) if on else (None, 0)
        last[k] = start, n
        want[k, t] = (start, n, ended)
    assert got == want
    held = A.hold_for(df, ["k"], "cond", "10m", span=span)
    fired = {}
    for (k, t), (start, _, ended) in sorted(want.items(), key=lambda x: x[0][1]):
        if start and t - start >= timedelta(minutes=10):
            fired.setdefault((k, start), [t, None])
        if ended and (k, ended) in fired:
            fired[k, ended][1] = t
    assert {(r.k, r.active_at): [r.fired_at, r.resolved_at] for r in A.firings(held, ["k"]).collect()} == fired and fired


def test_a_hot_series_is_many_tasks_work(spark):
    df = spark.range(0, 40_000, 1, 4).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"), F.timestamp_add("SECOND", F.col("id"), F.lit(str(T0)).cast("timestamp_ntz")).alias("ts"), (F.col("id") % 97 != 0).alias("cond"))
    pieces = df.withColumn("p", P.piece_of(df, "ts", "10m")).groupBy("k", "p").count()
    assert pieces.agg(F.max("count")).first()[0] <= 600 < 13_334 == pieces.where("k = 'hot'").agg(F.sum("count")).first()[0]
    plan = P.runs(df, ["k"], F.col("cond"), "ts", "10m")._jdf.queryExecution().executedPlan().toString()
    by_row = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "piece_" in line]
    assert by_row and all("series_" in line for line in by_row)


@pytest.mark.parametrize("span", [1000.0, 5.0])
def test_places_and_lookups_in_pieces(spark, span):
    rng = random.Random(3)
    points = [(k, rng.randint(0, 200)) for k in ("a", "b", None) for _ in range(40)]
    df = spark.createDataFrame(points, "k string, at long").repartition(3)
    got = sorted((str(r.k), r.place, r["at"]) for r in P.numbered(df, ["k"], "at", span=span).collect())
    want = [(str(k), i, t) for k in ("a", "b", None) for i, t in enumerate(sorted(t for x, t in points if x == k))]
    assert got == sorted(want)
    asks = spark.createDataFrame([(k, t, f"{k}{t}") for k in ("a", "b", None, "none") for t in range(-3, 210)], "k string, at long, note string")
    for r in P.next_of(df, asks, ["k"], "at", "at", span).collect():
        assert r.next_at == min((t for k, t in points if k == r.k and t >= r["at"]), default=None) and r.note == f"{r.k}{r['at']}"


def folded(readings, limit, cooldown):
    """The watcher's own way: one reading after another."""
    out, state = {}, {}
    for k, t, missed in sorted(readings, key=lambda r: (r[1], bool(r[2]))):
        n, last = state.get(k, (0, None))
        n = n + 1 if missed else 0
        act = n >= limit and (last is None or t - last >= cooldown)
        out.setdefault((k, t), []).append((min(n, limit), act))
        state[k] = (0, t) if act else (n, last)
    return out


@pytest.mark.parametrize(("limit", "cooldown", "span"), [(2, 300, 65536), (1, 0, 4), (3, 60, 7), (2, 1000, 3), (5, 10, 16)])
def test_cooldown_is_the_fold(spark, limit, cooldown, span):
    rng, readings = random.Random(limit * 7 + cooldown), []
    for k, n in (("hot", 300), ("b", 40), (None, 20), ("calm", 10)):
        t = 1000
        for _ in range(n):
            t += rng.choice([10, 30, 60, 60, 400])
            readings.append((k, t, None if rng.random() < 0.02 else rng.random() < (0.1 if k == "calm" else 0.75)))
    df = spark.createDataFrame(readings, "k string, t long, miss boolean").withColumns({"misses": F.lit("mine"), "x": F.lit(1)}).repartition(3)
    found = A.act_with_cooldown(df, ["k"], "miss", limit, cooldown, span=span)
    assert found.columns == ["k", "t", "miss", "x", "misses", "acted"]
    got = {}
    for r in found.collect():
        got.setdefault((r.k, r.t), []).append((r.misses, r.acted))
    assert got == folded(readings, limit, cooldown)
    assert "Python" not in found._jdf.queryExecution().toString() and sum(x[1] for v in got.values() for x in v) > 3


def test_chains_end_and_circles_are_named(spark):
    links = spark.createDataFrame([("k", i, i + 3) for i in range(0, 300)] + [("z", 1, 2), ("z", 2, 1)], "k string, a long, b long")
    got = sorted(r.a for r in P.chained(links.where("k = 'k'"), spark.createDataFrame([("k", 5)], "k string, a long"), ["k"]).collect())
    assert got == list(range(5, 303, 3))
    with pytest.raises(RuntimeError, match="circle"):
        P.chained(links, spark.createDataFrame([("z", 1)], "k string, a long"), ["k"], most_rounds=4)


@pytest.mark.parametrize("span", [4, 1000])
def test_the_largest_before_may_stand_in_any_earlier_piece(spark, span):
    values = {"falls": [9, 3, 7, 1, 2, 8, 0, 4, 5, 6, 1, 1], "nulls": [None, 5, None, None, None, None, 3, None, None, 1], "alone": [2]}
    df = spark.createDataFrame([(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)], "k string, i long, v long").repartition(3)
    got = {(r.k, r.i): r.most for r in P.last_before(df, ["k"], F.col("v"), "i", span, "most").collect()}
    assert got == {(k, i): max((v for v in vs[:i] if v is not None), default=None) for k, vs in values.items() for i in range(len(vs))}
