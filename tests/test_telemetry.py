"""Hand-worked cases for ranges, vectors, logs, relabelling, probes, alerts and inventory."""

import re
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from signalbrook.functions import durations, text
from signalbrook.model import LOGS, SAMPLES, key_text, label, merge_labels, series_key
from signalbrook.operators import alerts as A
from signalbrook.operators import inventory as I
from signalbrook.operators import logs as L
from signalbrook.operators import probes as P
from signalbrook.operators import ranges as R
from signalbrook.operators import relabel as RL
from signalbrook.operators import selectors as S
from signalbrook.operators import vectors as V
from signalbrook.plans import rules


def at(minute, hour=10):
    return datetime(2024, 1, 1, hour, minute)


def samples(spark, rows):
    return spark.createDataFrame([(m, lb, t, float(v)) for m, lb, t, v in rows], SAMPLES)


def test_increase_and_rate(spark):
    points = [(50, 9, 7), (52, 9, 9), (55, 9, 12), (58, 9, 2), (0, 10, 5)]
    df = samples(spark, [("c", {"a": "x"}, at(m, h), v) for m, h, v in points] + [("c", {"a": "lone"}, at(0), 3)])
    rv = S.range_series(df, "c", [], "2024-01-01 10:00:00", "10m")
    assert [(r.series_key, r.value) for r in R.increase(rv).collect()] == [("a=x", 8.0)]
    assert R.rate(rv, "10m").first().value == pytest.approx(8 / 600)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=2, max_size=12))
def test_increase_is_never_negative(spark, values):
    df = samples(spark, [("c", {"a": "x"}, at(i), v) for i, v in enumerate(values)])
    got = R.increase(S.range_series(df, "c", [], "2024-01-01 10:30:00", "1h")).first().value
    assert got == sum(b - a if b >= a else b for a, b in zip(values, values[1:])) >= 0


ROOMS = [("room", "!=", "")]
DOCUMENTS = [
    {
        "alert": "TankLow", "hold": "10m", "labels": {"severity": "warning"},
        "annotations": {"text": '{{ $labels.tank }} ({{ $labels.room }}): {{ printf "%.1f" $value }} of 100'},
        "expr": {"kind": "all", "parts": [
            {"kind": "compare", "op": "<", "number": 20, "of": {
                "kind": "arithmetic", "op": "*", "right": 100,
                "left": {"kind": "arithmetic", "op": "/", "left": {"kind": "series", "metric": "tank_litres", "where": ROOMS}, "right": {"kind": "series", "metric": "tank_capacity", "where": ROOMS}},
            }},
            {"kind": "compare", "op": "==", "number": 0, "of": {"kind": "series", "metric": "tank_sealed"}},
            {"kind": "compare", "op": ">", "number": 500, "of": {"kind": "series", "metric": "tank_capacity"}},
        ]},
    },
    {"alert": "PumpGone", "expr": {"kind": "any", "parts": [{"kind": "absent", "metric": "pump_turns", "width": "5m", "where": [("room", "=", r), ("pump", "=~", ".+")]} for r in ("east", "west")]}},
    {"alert": "PumpErrors", "expr": {"kind": "compare", "op": ">", "number": 0, "of": {"kind": "increase", "metric": "pump_errors", "width": "10m"}}},
    {"alert": "PumpErrorRate", "expr": {"kind": "compare", "op": ">", "number": 0.01, "of": {"kind": "rate", "metric": "pump_errors", "width": "10m"}}},
    {"alert": "FlowWeak", "expr": {"kind": "compare", "op": "<", "number": 0.5, "of": {"kind": "aggregate", "fn": "avg", "by": ["room"], "of": {"kind": "over_time", "fn": "avg", "metric": "flow", "width": "6m"}}}},
    {"alert": "Fullest", "expr": {"kind": "top", "k": 1, "of": {"kind": "series", "metric": "tank_litres"}}},
]


def test_rules_from_documents(spark):
    rows = []
    for tank, litres, capacity, sealed in (("a", 100, 1000, 0), ("b", 100, 400, 0), ("c", 100, 1000, 1), ("d", 200, 1000, 0), ("e", 100, None, 0)):
        lb = {"room": "east", "tank": tank}
        rows += [("tank_litres", lb, at(0), litres), ("tank_sealed", lb, at(0), sealed)] + ([("tank_capacity", lb, at(0), capacity)] if capacity else [])
    rows += [("pump_turns", {"room": "east", "pump": "p"}, at(0), 1), ("flow", {"room": "east", "n": "1"}, at(0), 0.4), ("flow", {"room": "east", "n": "2"}, at(0), 0.5)]
    rows += [("pump_errors", {"pump": "p"}, at(m), v) for m, v in ((52, 1), (55, 3))]
    rows[-2:] = [(a, b, datetime(2024, 1, 1, 9, m), v) for (a, b, _, v), m in zip(rows[-2:], (52, 55))]
    df, made = samples(spark, rows), rules.from_documents(DOCUMENTS)
    got = {rule.alert: rules.evaluate_at(df, rule, expr, "2024-01-01 10:00:30").collect() for rule, expr in made}
    assert [(r.labels["tank"], r.value, r.labels["severity"], r.annotations["text"]) for r in got["TankLow"]] == [("a", 10.0, "warning", "a (east): 10.0 of 100")]
    assert [(dict(r.labels), r.value) for r in got["PumpGone"]] == [({"room": "west", "alertname": "PumpGone"}, 1.0)]
    assert [r.value for r in got["PumpErrors"]] == [2.0] and not got["PumpErrorRate"]
    assert [(r.labels["room"], r.value) for r in got["FlowWeak"]] == [("east", 0.45)]
    assert [r.labels["tank"] for r in got["Fullest"]] == ["d"]
    with pytest.raises(ValueError):
        rules.expression({"kind": "query"})


def test_absence_without_labels(spark):
    df = samples(spark, [("up", {"host": "a"}, at(0), 1)])
    none = rules.expression({"kind": "absent", "metric": "gone", "width": "10m"})(df, "2024-01-01 10:01:00").collect()
    assert [(dict(r.labels), r.value) for r in none] == [({}, 1.0)]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.dictionaries(st.text("ab,=\\", min_size=1, max_size=3), st.text("ab,=\\", min_size=1, max_size=3), max_size=3), min_size=2, max_size=6))
def test_series_keys_tell_labels_apart(spark, maps):
    got = spark.createDataFrame([(m,) for m in maps], "labels map<string,string>").select("labels", series_key("labels").alias("k")).collect()
    for r in got:
        assert r.k == key_text(dict(r.labels))
    assert len({r.k for r in got}) == len({tuple(sorted(m.items())) for m in maps})


def test_matchers_take_the_whole_value(spark):
    df = spark.createDataFrame([({"a": v},) for v in ("abc", "abc\n", "xabc")], "labels map<string,string>")
    assert [r.labels["a"] for r in S.where_labels(df, [("a", "=~", "abc")]).collect()] == ["abc"]
    assert [r.labels["a"] for r in S.where_labels(df, [("a", "!~", "abc")]).collect()] == ["abc\n", "xabc"]


def test_sets_and_topk(spark):
    vec = lambda rows: spark.createDataFrame([(f"a={k}", {"a": k}, float(v)) for k, v in rows], "series_key string, labels map<string,string>, value double")
    a, b = vec([("x", 1), ("y", 5)]), vec([("y", 7), ("z", 5)])
    assert {(r.series_key, r.value) for r in V.v_or(a, b).collect()} == {("a=x", 1.0), ("a=y", 5.0), ("a=z", 5.0)}
    assert [r.series_key for r in V.v_and(a, b).collect()] == ["a=y"]
    assert [r.series_key for r in V.topk(V.v_or(a, b), 2).collect()] == ["a=y", "a=z"]
    assert V.binop(a, "/", vec([("x", 0)])).first().value is None
    assert V.or_zero(V.compare(a, ">", 100)).first().value == 0.0


LINES = [
    (r'level=info msg="(one/two) some/probe by ip 203.0.113.9 (US/64500) : 4h ban on Ip 203.0.113.9"', "some/probe, 203.0.113.9 of US: 4h ban"),
    (r'level=info msg="(one/two) alert : other/env by ip 198.51.100.7 (DE/64501)"', "other/env, 198.51.100.7 of DE: seen"),
    (r'level=info msg="(m) alert : scn by range 198.51.100.0/24"', "scn, 198.51.100.0/24: seen"),
    ("level=info msg=nothing", None),
]


def test_ban_lines(spark):
    df = spark.createDataFrame([(at(i), "h", "proxy", "waf", "c", line) for i, (line, _) in enumerate(LINES)], LOGS)
    got = [r.line for r in rules.message_lines(df, rules.BAN, ".+ by .+", "{{.scenario}}, {{.source_ip}}{{if .country}} of {{.country}}{{end}}{{if .action}}: {{.duration}} {{.action}}{{else}}: seen{{end}}", stack="proxy", service="waf").collect()]
    assert got == [want for _, want in reversed(LINES) if want]


def test_logfmt_unquotes(spark):
    lines = [r'level=info msg="(m) a \"q\" by ip 198.51.100.4" level=warn', "no pairs", 'a="" b= c=x=y d="open e="', None]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = [r.m and dict(r.m) for r in df.select(text.logfmt(text.logfmt_pairs("line")).alias("m")).collect()]
    assert got == [{"level": "warn", "msg": '(m) a "q" by ip 198.51.100.4'}, {}, {"a": "", "b": "", "c": "x=y", "d": "open e="}, None]


def test_named_groups_are_read_once(spark):
    pattern = r"(?P<a>\w+)=(?P<b>\d+)?(?:;(?P<c>x))?"
    lines = ["k=1;x", "  k=2 and l=3", "none", "k=", "", None, "k=\x01 4", "\x02k=5;x", "k=6\n"]
    groups, names = text.split_groups(text.laid_groups("line", pattern), "line", pattern)
    got = [tuple(r.g) for r in spark.createDataFrame([(x,) for x in lines], "line string").select(groups.alias("g")).collect()]
    found = [re.search(pattern, x or "") for x in lines]
    assert names == ["a", "b", "c"] and got == [tuple(x or "" for x in m.groups()) if m else ("", "", "") for m in found]
    plan = L.parse_regexp(L.parse_logfmt(L.stream(spark.createDataFrame([], LOGS))), pattern).where(label("a") == "k").select(label("a"), label("b"), label("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("regexp_replace(line") == 1


def test_json_labels_and_tail(spark):
    df = spark.createDataFrame([(at(i), "h", "s", "v", "c", line) for i, line in enumerate(['{"level":"error","m":1}', "no json", '{"level":"info"}'])], LOGS)
    parsed = L.parse_json(L.stream(df), {"level": "$.level"})
    assert [r.line for r in L.label_filter(parsed, "level", "=~", "error|fatal").collect()] == ['{"level":"error","m":1}']
    assert [r.line for r in L.tail(df, 1).collect()] == ['{"level":"info"}']


#: Parcels with a label that can be read, on one of two belts.
PARCELS = [
    RL.Rule(("__code",), regex="[A-Z]+-.+", action="keep"), RL.Rule(("__belt_name", "__size"), regex="slow;large", action="drop"),
    RL.Rule(("__belt_ip", "__code"), target="at", separator=" "), RL.Rule(("__code",), target="town", regex="([A-Z]+)-(.*)", replacement="$2 in $1"), RL.Rule(("none",), target="__size"),
]


def test_relabel_targets(spark):
    rows = [("DE-Ulm", "large", [("slow", "b1"), ("fast", "b2")]), ("torn", "small", [("fast", "b2")]), ("FR-Metz", "small", [("slow", "b1")])]
    df = spark.createDataFrame([({"__code": c, "__size": z}, belts) for c, z, belts in rows], "labels map<string,string>, networks array<struct<name:string,ip:string>>")
    got = sorted((r.labels["at"], r.labels["town"], "__size" in r.labels) for r in RL.relabel(RL.per_network(df, prefix="__belt_"), PARCELS).collect())
    assert got == [("b1 FR-Metz", "Metz in FR", False), ("b2 DE-Ulm", "Ulm in DE", False)]


def test_rules_are_worked_out_once_each(spark):
    rows = [(1, {"a": "x", "b": "", "c": None}), (2, {"a": "y"}), (3, None), (4, {}), (5, {"a": "xgone"})]
    df = spark.createDataFrame(rows, "id int, labels map<string,string>")
    chain = [RL.Rule(("a",), target="a", regex=f"(.*)({i}?)", replacement=f"$1{i}") for i in range(5)]
    made = RL.relabel(df, [*chain, RL.Rule(("a",), regex="xgone.*", action="drop"), RL.Rule(("absent",), target="b"), RL.Rule(("a", "c"), target="d", separator="/")])
    got = {r.id: r.labels for r in made.where(F.coalesce(F.col("labels")["a"], F.lit("")) != "no").collect()}
    assert got == {1: {"a": "x01234", "c": None, "d": "x01234/"}, 2: {"a": "y01234", "d": "y01234/"}, 3: None, 4: {"a": "01234", "d": "01234/"}}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan.count(rf"(.*)({i}?)") <= 2 for i in range(5))


def test_probe_conditions(spark):
    web, dns = ["[STATUS] == 200", "[CERTIFICATE_EXPIRATION] > 48h"], ["[DNS_RCODE] == NOERROR", "[BODY] == 192.0.2.1"]
    rows = [(web, 200, 172801, None, None, True), (web, 200, 172800, None, None, False), (["[STATUS] == 302", web[1]], 200, 999999, None, None, False), (dns, None, None, "NOERROR", "192.0.2.1", True), (web, None, None, None, None, False)]
    df = spark.createDataFrame(rows, "conditions array<string>, status int, cert_expiry_s bigint, dns_rcode string, body string, want boolean")
    assert all(r.success == r.want for r in P.eval_conditions(df).collect())
    assert [r.s for r in df.limit(2).select(P.all_of(*web).alias("s")).collect()] == [True, False]


def test_hold(spark):
    df = spark.createDataFrame([("k", at(i), bool(c)) for i, c in enumerate([1, 1, 1, 1, 1, 1, 0, 1, 1, 1])], "k string, ts timestamp_ntz, cond boolean")
    held = A.hold_for(df, ["k"], "cond", "5m")
    states = [r.state for r in held.orderBy("ts").collect()]
    assert states == ["pending"] * 5 + ["firing", "inactive"] + ["pending"] * 3
    assert [(r.active_at, r.fired_at, r.resolved_at) for r in A.firings(held, ["k"]).collect()] == [(at(0), at(5), at(6))]


def test_cooldown(spark):
    readings = [0, 0, 0, 0, 5, 0, 0]
    df = spark.createDataFrame([("k", 1000 + 60 * i, v == 0) for i, v in enumerate(readings)], "k string, t long, miss boolean")
    got = A.act_with_cooldown(df, ["k"], "miss", 2, 300).orderBy("t").collect()
    assert [r.t for r in got if r.acted] == [1060, 1360]
    assert [r.misses for r in got] == [1, 2, 1, 2, 0, 1, 2]


def test_routing_and_payloads(spark):
    df = spark.createDataFrame([("critical",), ("warning",), ("odd",), (None,)], "severity string")
    assert [(r.contact, r.priority) for r in A.route(df).collect()] == [("critical", 5)] + [("warning", 3)] * 3
    groups = spark.createDataFrame([("t" * 120, "", "why", "g1", "https://example.org/g1")], "title string, summary string, description string, group_id string, link string")
    import json

    got = json.loads(A.thread_open(groups).first().payload)
    assert got == {"thread_name": "t" * 100, "content": "why\n-- group g1, see https://example.org/g1", "allowed_mentions": {"parse": []}}


def test_notification_times(spark):
    df = spark.createDataFrame([("a", at(0), at(30)), ("a", at(1), at(30)), ("a", at(20), at(30))], "g string, ts timestamp_ntz, until timestamp_ntz")
    got = [(r.sent_at, r.n_changes) for r in A.notification_times(df, ["g"]).orderBy("sent_at").collect()]
    assert got == [(datetime(2024, 1, 1, 10, 0, 30), 1), (datetime(2024, 1, 1, 10, 5, 30), 1), (at(20), 1)]


EDGES = [
    ("fleet", "wheeled", 0), ("fleet", "boats", 0), ("wheeled", "lorry", 1), ("wheeled", "van", 1), ("boats", "ferry", 1), ("boats", "barge", 1), ("electric", "van", 1),
    ("electric", "ferry", 1), ("fleet", "electric", 0), ("fleet", "hired", 0), ("hired", "crane", 1), ("fleet", "kite", 1),
]


@pytest.mark.parametrize(("pattern", "want"), [("wheeled:&electric", "van"), ("fleet:!boats", "crane kite lorry van"), ("boats:hired", "barge crane ferry"), ("boats[0]", "barge"), ("electric:!electric[0]", "van"), ("fleet:&electric:!wheeled", "ferry")])
def test_host_patterns(spark, pattern, want):
    df = spark.createDataFrame([(a, b, bool(c)) for a, b, c in EDGES], "parent string, child string, is_host boolean")
    assert sorted(r.host for r in I.hosts_of(df, pattern).collect()) == want.split()


def test_lookup_is_strict(spark):
    rows, targets = spark.createDataFrame([("a", "x"), ("b", "gone")], "host string, target string"), spark.createDataFrame([("x", "192.0.2.1")], "name string, address string")
    assert I.lookup(rows, targets, {"target": "name"}, ["address"], strict=False).count() == 2
    with pytest.raises(Exception, match="no entry for gone"):
        I.lookup(rows, targets, {"target": "name"}, ["address"]).collect()


def test_overlap_across_bins(spark):
    points = spark.createDataFrame([(1, 0), (2, 3_600_000), (3, 7_200_001)], "p long, t long")
    regions = spark.createDataFrame([("r", 0, 7_200_000), ("s", 3_600_000, None)], "id string, a long, b long")
    got = {(r.p, r.id) for r in I.overlapping(points, regions, "t", "a", "b").collect()}
    assert got == {(1, "r"), (2, "r"), (2, "s")}


def test_text(spark):
    df = spark.createDataFrame([("vmlinuz-6.8.9", "1.5K", "5m"), ("vmlinuz-6.8.12", "x", "2x")], "v string, n string, d string")
    got = df.select(text.human_bytes("n").alias("b"), durations.seconds_of("d").alias("s")).collect()
    assert [(r.b, r.s) for r in got] == [(1536.0, 300), (None, None)]
    assert df.agg(F.max_by("v", text.version_key("v", "vmlinuz-")).alias("m")).first().m == "vmlinuz-6.8.12"
    assert durations.seconds("1h30m") == 5400
    with pytest.raises(ValueError):
        durations.seconds("5 minutes")


def test_label_maps(spark):
    df = spark.createDataFrame([({"b": "2", "a": "1", "c": ""},)], "labels map<string,string>")
    got = df.select(series_key("labels").alias("k"), label("z").alias("z"), merge_labels(F.col("labels"), F.create_map(F.lit("a"), F.lit("9"))).alias("m")).first()
    assert (got.k, got.z, dict(got.m)) == ("a=1,b=2", "", {"a": "9", "b": "2", "c": ""})
