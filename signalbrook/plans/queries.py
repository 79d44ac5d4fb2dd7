"""The registered telemetry and inventory queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import durations, text
from ..model import label, merge_labels, series_key
from ..operators import alerts as A
from ..operators import buckets as B
from ..operators import grid as G
from ..operators import inventory as I
from ..operators import logs as L
from ..operators import probes as P
from ..operators import ranges as R
from ..operators import records as RC
from ..operators import relabel as RL
from ..operators import selectors as S
from ..operators import updates as U
from ..operators import vectors as V
from ..operators.grid import Grid
from ..operators.pieces import micros
from . import rules
from . import testviews as TV

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AT = "2024-01-15 12:00:00"

#: The same views as testviews makes, for the SQL side.
VIEWS = """
g AS (SELECT 'g' AS metric, event_type AS job, CAST(user_id % 10 AS VARCHAR) AS instance, ts, value, event_id FROM events),
c AS (SELECT 'c_total' AS metric, job, instance, ts, CAST((rn - 1) % 50 + 1 AS DOUBLE) AS value, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY job, instance ORDER BY ts, event_id) AS rn FROM g)),
up AS (SELECT 'up' AS metric, CAST(user_id % 10 AS VARCHAR) AS instance, ts, CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS value, event_id FROM events),
logs AS (SELECT ts, 'h' || CAST(user_id % 2 AS VARCHAR) AS host, 'proxy' AS stack, event_type AS service, event_id,
  'level=info msg="(m) alert : ' || event_type || ' by ip 198.51.100.' || CAST(user_id % 10 AS VARCHAR) || ' (US/64500)'
  || CASE WHEN user_id % 3 = 0 THEN ' : 4h ban on Ip 198.51.100.' || CAST(user_id % 10 AS VARCHAR) ELSE '' END || '"' AS line FROM events),
msgs AS (SELECT *, regexp_extract(line, 'msg="([^"]*)"', 1) AS msg FROM logs),
parsed AS (SELECT *, regexp_extract(msg, '{ban}', 2) AS scenario, regexp_extract(msg, '{ban}', 3) AS source_ip, regexp_extract(msg, '{ban}', 4) AS country,
  regexp_extract(msg, '{ban}', 5) AS asn, regexp_extract(msg, '{ban}', 6) AS duration, regexp_extract(msg, '{ban}', 7) AS action FROM msgs),
rose AS (SELECT job, instance, sum(CASE WHEN value >= prev THEN value - prev WHEN prev IS NOT NULL THEN value END) AS value, count(*) AS n FROM (
  SELECT *, lag(value) OVER (PARTITION BY job, instance ORDER BY ts, value) AS prev FROM c WHERE ts > TIMESTAMP '{at}' - INTERVAL 24 HOURS AND ts <= TIMESTAMP '{at}') GROUP BY 1, 2 HAVING count(*) >= 2),
latest AS (SELECT job, instance, value FROM (SELECT *, row_number() OVER (PARTITION BY job, instance ORDER BY ts DESC, value DESC) AS r FROM g
  WHERE ts > TIMESTAMP '{at}' - INTERVAL 24 HOURS AND ts <= TIMESTAMP '{at}') WHERE r = 1),
latest_c AS (SELECT job, instance, value FROM (SELECT *, row_number() OVER (PARTITION BY job, instance ORDER BY ts DESC, value DESC) AS r FROM c
  WHERE ts > TIMESTAMP '{at}' - INTERVAL 24 HOURS AND ts <= TIMESTAMP '{at}') WHERE r = 1),
hourly AS (SELECT CAST(user_id % 10 AS VARCHAR) AS instance, date_trunc('hour', ts) AS hour, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) = 1 AS cond FROM events GROUP BY 1, 2),
marked AS (SELECT *, sum(CASE WHEN cond THEN 0 ELSE 1 END) OVER (PARTITION BY instance ORDER BY hour ROWS UNBOUNDED PRECEDING) AS island FROM hourly),
held AS (SELECT *, CASE WHEN NOT cond THEN 'inactive' WHEN hour >= since + INTERVAL 2 HOURS THEN 'firing' ELSE 'pending' END AS state FROM (
  SELECT *, min(CASE WHEN cond THEN hour END) OVER (PARTITION BY instance, island) AS since FROM marked)),
probes AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS web, CASE WHEN o_orderstatus = 'F' THEN 200 ELSE 302 END AS status, o_custkey * 1000 AS cert, o_orderstatus <> 'F' AS resolves, o_orderpriority AS body FROM orders)
""".replace("{at}", AT).replace("{ban}", rules.BAN.replace("'", "''"))


def register(name: str, sql: str | None = None):
    """Register a query under a name, with SQL over VIEWS if there is any."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH RECURSIVE {VIEWS} {sql}"
        return f

    return add


#: Messages that name an address, and how a list shows one: who was seen first, then what was done.
BANS = r"\(\w+\) .+ by ip [0-9.]+.*"
BAN_LINE = "{{.source_ip}} ({{.country}}) seen by {{.machine}} for {{.scenario}}{{if .action}}, {{.action}} of {{.duration}}{{end}}"


def _bans(logs: DataFrame, **stream: str) -> DataFrame:
    return rules.messages(logs, rules.BAN, BANS, **stream)


def _labels(vec: DataFrame, *names: str) -> DataFrame:
    return vec.select(*[label(n).alias(n) for n in names], "value")


# Selectors and filters


@register("label_eq", "SELECT event_id, value FROM g WHERE job = 'click'")
def label_eq(spark, d):
    return S.where_labels(TV.gauge(spark, d), [("job", "=", "click")]).select("event_id", "value")


@register("label_neq_present", "SELECT event_id, value FROM g WHERE job <> 'error' AND instance <> ''")
def label_neq_present(spark, d):
    return S.where_labels(TV.gauge(spark, d), [("job", "!=", "error"), ("instance", "!=", ""), ("absent", "=", "")]).select("event_id", "value")


@register("label_regex", "SELECT event_id, value FROM g WHERE regexp_full_match(job, 'click|view')")
def label_regex(spark, d):
    return S.where_labels(TV.gauge(spark, d), [("job", "=~", "click|view")]).select("event_id", "value")


@register("label_not_regex", "SELECT event_id, value FROM g WHERE NOT regexp_full_match(job, 'cl.*|vie')")
def label_not_regex(spark, d):
    return S.where_labels(TV.gauge(spark, d), [("job", "!~", "cl.*|vie")]).select("event_id", "value")


@register("value_filter", "SELECT event_id, value FROM g WHERE value > 50")
def value_filter(spark, d):
    return V.compare(TV.gauge(spark, d), ">", 50).select("event_id", "value")


@register("keep_metrics", "SELECT metric, count(*) AS n FROM (SELECT metric FROM g UNION ALL SELECT metric FROM c UNION ALL SELECT metric FROM up) WHERE regexp_full_match(metric, 'g|u.') GROUP BY 1")
def keep_metrics(spark, d):
    cols = ["metric", "labels", "ts", "value"]
    every = TV.gauge(spark, d).select(*cols).unionByName(TV.counter(spark, d).select(*cols)).unionByName(TV.up(spark, d).select(*cols))
    return S.keep_metrics(every, "g|u.").groupBy("metric").agg(F.count("*").alias("n"))


@register("instant_lookup", "SELECT * FROM latest")
def instant_lookup(spark, d):
    return _labels(S.select_series(TV.gauge(spark, d), "g", [], AT, "24h"), "job", "instance")


# Ranges and aggregation


def _rose(spark, d):
    return R.increase(S.range_series(TV.counter(spark, d), "c_total", [], AT, "24h"))


def _counters(spark, d):
    return S.select_series(TV.counter(spark, d), "c_total", [], AT, "24h")


@register("sum_global", "SELECT sum(value) AS value FROM latest_c HAVING count(*) > 0")
def sum_global(spark, d):
    return V.agg(_counters(spark, d), "sum").select("value")


@register("sum_by", "SELECT job, sum(value) AS value FROM latest_c GROUP BY 1")
def sum_by(spark, d):
    return _labels(V.agg(_counters(spark, d), "sum", ["job"]), "job")


@register("sum_by3", "SELECT host, service, source_ip, CAST(count(*) AS DOUBLE) AS value FROM parsed GROUP BY 1, 2, 3")
def sum_by3(spark, d):
    return _labels(L.count_over_time(_bans(TV.logs(spark, d)), ["host", "service", "source_ip"]), "host", "service", "source_ip")


@register("max_all", f"SELECT max(value) AS value FROM up WHERE ts > TIMESTAMP '{AT}' - INTERVAL 24 HOURS AND ts <= TIMESTAMP '{AT}'")
def max_all(spark, d):
    return V.agg(R.over_time(S.range_series(TV.up(spark, d), "up", [], AT, "24h"), "max"), "max").select("value")


@register(
    "avg_by_avg_over_time",
    f"SELECT job, round(avg(v), 6) AS value FROM (SELECT job, instance, avg(value) AS v FROM g WHERE ts > TIMESTAMP '{AT}' - INTERVAL 24 HOURS AND ts <= TIMESTAMP '{AT}' GROUP BY 1, 2) GROUP BY 1",
)
def avg_by_avg_over_time(spark, d):
    rv = S.range_series(TV.gauge(spark, d), "g", [], AT, "24h")
    return _labels(V.agg(R.avg_over_time(rv), "avg", ["job"]), "job").withColumn("value", F.round("value", 6))


@register("count_over_time", f"SELECT host, CAST(count(*) AS DOUBLE) AS value FROM logs WHERE contains(line, 'ban on') AND ts > TIMESTAMP '{AT}' - INTERVAL 24 HOURS AND ts <= TIMESTAMP '{AT}' GROUP BY 1")
def count_over_time(spark, d):
    rows = L.line_contains(L.in_window(TV.logs(spark, d), AT, "24h"), "ban on")
    return _labels(L.count_over_time(rows, ["host"]), "host")


@register("increase_range", "SELECT job, instance, value FROM rose")
def increase_range(spark, d):
    return _labels(_rose(spark, d), "job", "instance")


@register("rate_range", "SELECT job, instance, round(value / 86400, 9) AS value FROM rose")
def rate_range(spark, d):
    rv = S.range_series(TV.counter(spark, d), "c_total", [], AT, "24h")
    return _labels(R.rate(rv, "24h"), "job", "instance").withColumn("value", F.round("value", 9))


@register(
    "increase_step",
    """, s AS (SELECT job, instance, time_bucket(INTERVAL '6 hours', ts) AS window_start, ts, value FROM c),
    d AS (SELECT *, lag(value) OVER (PARTITION BY job, instance, window_start ORDER BY ts, value) AS prev FROM s),
    i AS (SELECT job, instance, window_start, sum(CASE WHEN value >= prev THEN value - prev WHEN prev IS NOT NULL THEN value END) AS v FROM d GROUP BY 1, 2, 3 HAVING count(*) >= 2)
    SELECT job, window_start, sum(v) AS value FROM i GROUP BY 1, 2""",
)
def increase_step(spark, d):
    rows = TV.counter(spark, d).withColumn("series_key", series_key("labels"))
    rose = R.increase(R.tumbling(rows, "6 hours"), ["window_start"])
    return V.agg(rose, "sum", ["job"], ["window_start"]).select(label("job").alias("job"), "window_start", "value")


@register(
    "sliding_count",
    """, e AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01 00:00:00', TIMESTAMP '2024-01-31 12:00:00', INTERVAL 3 HOURS)) AS eval_ts)
    SELECT job, eval_ts, CAST(count(*) AS DOUBLE) AS value FROM e JOIN g ON g.ts > eval_ts - INTERVAL 12 HOURS AND g.ts <= eval_ts GROUP BY 1, 2""",
)
def sliding_count(spark, d):
    rows = R.sliding(TV.gauge(spark, d).withColumn("series_key", series_key("labels")), "12h", "3h")
    return V.agg(R.over_time(rows, "count", ["eval_ts"]), "sum", ["job"], ["eval_ts"]).select(label("job").alias("job"), "eval_ts", "value")


GRID = Grid("2024-01-02 00:00:00", "2024-01-29 00:00:00", "1h")
TICKS = "t AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02 00:00:00', TIMESTAMP '2024-01-29 00:00:00', INTERVAL 1 HOURS)) AS eval_ts)"


@register(
    "increase_overlapping",
    f""", {TICKS}, w AS (SELECT job, instance, eval_ts, value, lag(value) OVER (PARTITION BY job, instance, eval_ts ORDER BY ts, value) AS prev
      FROM t JOIN c ON c.ts > eval_ts - INTERVAL 12 HOURS AND c.ts <= eval_ts)
    SELECT job, instance, eval_ts, sum(CASE WHEN value >= prev THEN value - prev WHEN prev IS NOT NULL THEN value END) AS value FROM w GROUP BY 1, 2, 3 HAVING count(*) >= 2""",
)
def increase_overlapping(spark, d):
    """The rise over twelve hours, each hour."""
    return G.increase(TV.counter(spark, d), "c_total", [], GRID, "12h").select(label("job").alias("job"), label("instance").alias("instance"), "eval_ts", "value")


@register("sum_overlapping", f", {TICKS} SELECT job, eval_ts, round(sum(value), 2) AS value FROM t JOIN g ON g.ts > eval_ts - INTERVAL 6 HOURS AND g.ts <= eval_ts GROUP BY 1, 2")
def sum_overlapping(spark, d):
    """The sum over six hours, each hour, by job."""
    each = G.over_time(TV.gauge(spark, d), "g", [], GRID, "6h", "sum")
    return V.agg(each, "sum", ["job"], ["eval_ts"]).select(label("job").alias("job"), "eval_ts", F.round("value", 2).alias("value"))


#: Where a series was over 30 and its last rise below 40: hourly, held for three hours.
HIGH = {
    "alert": "High", "hold": "3h", "labels": {"severity": "warning"},
    "expr": {"kind": "all", "parts": [
        {"kind": "compare", "op": ">", "number": 30, "of": {"kind": "series", "metric": "g", "lookback": "8h"}},
        {"kind": "compare", "op": "<", "number": 40, "of": {"kind": "increase", "metric": "c_total", "width": "12h"}},
    ]},
}


@register(
    "rule_over_time",
    f""", {TICKS}, last AS (SELECT job, instance, eval_ts, arg_max(value, (ts, value)) AS value FROM t JOIN g ON g.ts > eval_ts - INTERVAL 8 HOURS AND g.ts <= eval_ts GROUP BY 1, 2, 3),
    w AS (SELECT job, instance, eval_ts, value, lag(value) OVER (PARTITION BY job, instance, eval_ts ORDER BY ts, value) AS prev FROM t JOIN c ON c.ts > eval_ts - INTERVAL 12 HOURS AND c.ts <= eval_ts),
    up12 AS (SELECT job, instance, eval_ts, sum(CASE WHEN value >= prev THEN value - prev WHEN prev IS NOT NULL THEN value END) AS v FROM w GROUP BY 1, 2, 3 HAVING count(*) >= 2),
    met AS (SELECT job, instance, eval_ts, last.value FROM last JOIN up12 USING (job, instance, eval_ts) WHERE last.value > 30 AND v < 40),
    isl AS (SELECT *, eval_ts - INTERVAL 1 HOURS * row_number() OVER (PARTITION BY job, instance ORDER BY eval_ts) AS island FROM met)
    SELECT job, instance, eval_ts, value, CASE WHEN eval_ts >= since + INTERVAL 3 HOURS THEN 'firing' ELSE 'pending' END AS state, since AS active_at
    FROM (SELECT *, min(eval_ts) OVER (PARTITION BY job, instance, island) AS since FROM isl)""",
)
def rule_over_time(spark, d):
    """A rule document at every hour, with its states."""
    cols = ["metric", "labels", "ts", "value"]
    both = TV.gauge(spark, d).select(*cols).unionByName(TV.counter(spark, d).select(*cols))
    (rule, expr), = rules.from_documents([HIGH])
    found = rules.states(both, rule, expr, GRID).where("cond")
    return found.select(label("job").alias("job"), label("instance").alias("instance"), "eval_ts", "value", "state", "active_at")


@register("last_not_null", "SELECT job, value FROM (SELECT job, value, row_number() OVER (PARTITION BY job ORDER BY ts DESC, value DESC) AS r FROM g) WHERE r = 1")
def last_not_null(spark, d):
    return R.last_not_null(TV.gauge(spark, d).withColumn("job", label("job")), ["job"])


@register("empty_as_zero", "SELECT coalesce(max(value), 0.0::DOUBLE) AS value FROM g WHERE job = 'none'")
def empty_as_zero(spark, d):
    return V.or_zero(S.where_labels(TV.gauge(spark, d), [("job", "=", "none")]))


@register("absent_present", "SELECT 'click' AS job, 1.0::DOUBLE AS value WHERE NOT EXISTS (SELECT 1 FROM g WHERE job = 'click')")
def absent_present(spark, d):
    m = [("job", "=", "click")]
    return _labels(R.absent_over_time(S.range_series(TV.gauge(spark, d), "g", m, AT, "24h"), m), "job")


@register("absent_missing", "SELECT 'none' AS job, 1.0::DOUBLE AS value")
def absent_missing(spark, d):
    m = [("job", "=", "none"), ("instance", "=~", ".*")]
    return _labels(R.absent_over_time(S.range_series(TV.gauge(spark, d), "g", m, AT, "24h"), m), "job")


# Vector operations


@register("ratio_join", "SELECT a.job, a.instance, round(a.value / b.value * 100, 6) AS value FROM rose a JOIN latest_c b USING (job, instance)")
def ratio_join(spark, d):
    ratio = V.binop(V.binop(_rose(spark, d), "/", _counters(spark, d)), "*", 100)
    return _labels(ratio, "job", "instance").withColumn("value", F.round("value", 6))


@register("and_semi", "SELECT job, instance, value FROM rose WHERE EXISTS (SELECT 1 FROM latest l WHERE l.job = rose.job AND l.instance = rose.instance AND l.value > 20)")
def and_semi(spark, d):
    return _labels(V.v_and(_rose(spark, d), V.compare(S.select_series(TV.gauge(spark, d), "g", [], AT, "24h"), ">", 20)), "job", "instance")


@register("or_union", "SELECT job, instance, value FROM latest WHERE job = 'click' UNION ALL SELECT job, instance, value FROM rose WHERE instance = '3' AND NOT EXISTS (SELECT 1 FROM latest l WHERE l.job = 'click' AND l.job = rose.job AND l.instance = rose.instance)")
def or_union(spark, d):
    a = S.select_series(TV.gauge(spark, d), "g", [("job", "=", "click")], AT, "24h")
    b = R.increase(S.range_series(TV.counter(spark, d), "c_total", [("instance", "=", "3")], AT, "24h"))
    return _labels(V.v_or(a, b), "job", "instance")


@register("topk_sum", "SELECT instance, sum(value) AS value FROM rose GROUP BY 1 ORDER BY 2 DESC, 'instance=' || instance LIMIT 5")
def topk_sum(spark, d):
    return _labels(V.topk(V.agg(_rose(spark, d), "sum", ["instance"]), 5), "instance")


@register("topk_having", "SELECT job, instance, value FROM rose WHERE value > 3 ORDER BY 3 DESC, 'instance=' || instance || ',job=' || job LIMIT 15")
def topk_having(spark, d):
    return _labels(V.topk(V.compare(_rose(spark, d), ">", 3), 15), "job", "instance")


@register("threshold_node", "SELECT host, CAST(count(*) AS DOUBLE) AS value, count(*) > 100 AS met FROM logs WHERE contains(line, 'purchase') GROUP BY 1")
def threshold_node(spark, d):
    counted = V.threshold(L.count_over_time(L.line_contains(TV.logs(spark, d), "purchase"), ["host"]), "gt", 100)
    return counted.select(label("host").alias("host"), "value", "met")


@register("threshold_map", "SELECT event_id, CASE WHEN value >= 1 THEN 'green' ELSE 'red' END AS color FROM up")
def threshold_map(spark, d):
    return TV.up(spark, d).select("event_id", V.color("value", [(None, "red"), (1, "green")]).alias("color"))


@register("table_panel", 'SELECT job AS "Job", value AS "Total" FROM (SELECT job, sum(value) AS value FROM latest_c GROUP BY 1)')
def table_panel(spark, d):
    return V.labels_to_columns(V.agg(_counters(spark, d), "sum", ["job"]), ["job", "instance"], {"job": "Job", "value": "Total"}, ("instance",))


# Logs


@register("log_contains", "SELECT event_id, line FROM logs WHERE contains(line, '198.51.100.7')")
def log_contains(spark, d):
    return L.line_contains(TV.logs(spark, d), "198.51.100.7").select("event_id", "line")


@register("logfmt_parse", "SELECT event_id, 'info' AS level, msg FROM msgs")
def logfmt_parse(spark, d):
    return L.parse_logfmt(L.stream(TV.logs(spark, d), stack="proxy")).select("event_id", label("level").alias("level"), label("msg").alias("msg"))


@register("log_regexp_groups", "SELECT event_id, scenario, source_ip, country, asn, duration, action FROM parsed")
def log_regexp_groups(spark, d):
    return _bans(TV.logs(spark, d), stack="proxy").select("event_id", *[label(n).alias(n) for n in ("scenario", "source_ip", "country", "asn", "duration", "action")])


@register("log_topk", f"SELECT source_ip, country, asn, CAST(count(*) AS DOUBLE) AS value FROM parsed WHERE ts > TIMESTAMP '{AT}' - INTERVAL 14 DAYS AND ts <= TIMESTAMP '{AT}' GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1 LIMIT 15")
def log_topk(spark, d):
    return _labels(rules.top_messages(TV.logs(spark, d), AT, "14d", ["source_ip", "country", "asn"], rules.BAN, BANS), "source_ip", "country", "asn")


@register("log_topk_scenario", f"SELECT scenario, CAST(count(*) AS DOUBLE) AS value FROM parsed WHERE ts > TIMESTAMP '{AT}' - INTERVAL 14 DAYS AND ts <= TIMESTAMP '{AT}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def log_topk_scenario(spark, d):
    return _labels(rules.top_messages(TV.logs(spark, d), AT, "14d", ["scenario"], rules.BAN, BANS), "scenario")


@register("line_format_if", "SELECT event_id, source_ip || ' (' || country || ') seen by m for ' || scenario || CASE WHEN action <> '' THEN ', ' || action || ' of ' || duration ELSE '' END AS line FROM parsed")
def line_format_if(spark, d):
    return rules.message_lines(TV.logs(spark, d), rules.BAN, BANS, BAN_LINE).select("event_id", "line")


@register("log_tail", "SELECT event_id, line FROM logs WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' ORDER BY ts DESC, event_id LIMIT 200")
def log_tail(spark, d):
    return L.tail(TV.logs(spark, d), 200, since="2024-01-20 00:00:00", tie=("event_id",)).select("event_id", "line")


@register("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 90")
def json_props(spark, d):
    rows = TV.table(spark, d, "events").withColumn("p", F.from_json("props", "k bigint"))
    return rows.where(F.col("p.k") > 90).select("event_id", F.col("p.k").alias("k"))


@register("log_alert", f"SELECT host, CAST(count(*) AS DOUBLE) AS value, count(*) > 0 AS met FROM logs WHERE contains(line, 'error') AND ts > TIMESTAMP '{AT}' - INTERVAL 6 HOURS AND ts <= TIMESTAMP '{AT}' GROUP BY 1")
def log_alert(spark, d):
    return rules.log_alert(TV.logs(spark, d), "error", AT, "6h").select(label("host").alias("host"), "value", "met")


@register("contains_documents", "SELECT doc_id FROM documents WHERE contains(text, 'the and')")
def contains_documents(spark, d):
    return TV.table(spark, d, "documents").where(F.col("text").contains("the and")).select("doc_id")


# Relabelling and probes


def _meters(spark, d):
    """Customers as meters that a discovery has found, each on two lines."""
    # a small file is read by a task or two, and a row is much work
    c = TV.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey").repartition("c_custkey")
    labels = F.create_map(
        F.lit("__maker"), F.concat(F.lit("Maker of "), F.col("c_name")), F.lit("__branch"), F.lower("c_mktsegment"),
        F.lit("__zone"), (F.col("c_nationkey") % 3).cast("string"), F.lit("__serial"), F.concat(F.lit("SN-"), F.col("c_custkey").cast("string"), F.lit("-"), (F.col("c_nationkey") % 5).cast("string")),
        F.lit("note"), F.lit("unread"),
    )
    line = lambda name, rest: F.struct(F.lit(name).alias("name"), F.concat(F.lit("m"), F.col("c_custkey").cast("string"), F.lit(rest)).alias("ip"))
    return c.select("c_custkey", labels.alias("labels"), F.array(line("bus", ".bus.example"), line("radio", ".radio.example")).alias("networks"))


#: One rule or more for each thing that a rule can do, on meters: whole branches left out, one line kept, several sources joined, groups moved
#: about, a part of a value replaced, a label without a value taken away.
METER_RULES = [
    RL.Rule(("__branch", "__zone"), regex="(machinery;0|household;.)", action="drop"),
    RL.Rule(("__line_name", "__branch"), regex="radio;.*|bus;(furniture|building)", action="keep"),
    RL.Rule(("__zone", "__line_name", "__branch"), target="place", separator="/"),
    RL.Rule(("__serial",), target="batch", regex=r"SN-(\d+)-(\d)", replacement="$2:$1"),
    RL.Rule(("__branch",), target="branch", regex="(b.*)"),
    RL.Rule(("__line_ip",), target="__address__", regex=r"m(\d+)\..*", replacement="$1"),
    RL.Rule(("absent",), target="note"),
]


@register(
    "relabel_targets",
    """SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS address, CAST(c_nationkey % 3 AS VARCHAR) || '/' || l || '/' || lower(c_mktsegment) AS place,
      CAST(c_nationkey % 5 AS VARCHAR) || ':' || CAST(c_custkey AS VARCHAR) AS batch, CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' ELSE '' END AS branch, '' AS note
    FROM customer CROSS JOIN (VALUES ('bus'), ('radio')) x(l)
    WHERE c_mktsegment <> 'HOUSEHOLD' AND NOT (c_mktsegment = 'MACHINERY' AND c_nationkey % 3 = 0) AND (l = 'radio' OR c_mktsegment IN ('FURNITURE', 'BUILDING'))""",
)
def relabel_targets(spark, d):
    made = RL.relabel(RL.per_network(_meters(spark, d), prefix="__line_"), METER_RULES)
    return made.select("c_custkey", label("__address__").alias("address"), *[label(n).alias(n) for n in ("place", "batch", "branch", "note")])


@register("relabel_constant", "SELECT c_custkey, 'plant' AS site, lower(c_mktsegment) AS branch FROM customer")
def relabel_constant(spark, d):
    rows = RL.relabel(_meters(spark, d), [RL.Rule(("__branch",), target="branch")])
    return RL.constant_label(rows, "site", "plant").select("c_custkey", label("site").alias("site"), label("branch").alias("branch"))


@register("probe_conditions", "SELECT o_orderkey, CASE WHEN web THEN status = 200 AND cert > 172800 ELSE resolves AND body = '1-URGENT' END AS success FROM probes")
def probe_conditions(spark, d):
    return P.eval_conditions(TV.probes(spark, d)).select("o_orderkey", "success")


@register("transport_constraints", "SELECT o_orderkey, o_orderstatus <> 'P' AND o_custkey % 2 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS success FROM orders")
def transport_constraints(spark, d):
    key = F.col("o_orderkey")
    rows = TV.table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", 200).when(F.col("o_orderstatus") == "O", 204).alias("status"), (F.col("o_custkey") % 2 == 0).alias("tls"),
        F.when(key % 3 == 0, 6).otherwise(4).alias("ip_version"), F.when(key % 5 == 0, "POST").otherwise("get").alias("method"),
    )
    return rows.select("o_orderkey", P.reachable([200, 204], ip_version=4, methods=("GET", "HEAD")).alias("success"))


@register("probe_fixed_conditions", "SELECT o_orderkey, web AND status = 200 AND cert > 172800 AS success FROM probes")
def probe_fixed_conditions(spark, d):
    return TV.probes(spark, d).select("o_orderkey", P.all_of("[STATUS] == 200", "[CERTIFICATE_EXPIRATION] > 48h").alias("success"))


# Alerts


@register("alert_for_hold", "SELECT instance, hour, state FROM held")
def alert_for_hold(spark, d):
    return A.hold_for(TV.hourly(spark, d), ["instance"], "cond", "2h", "hour").select("instance", "hour", "state")


@register(
    "alert_firings",
    """, off AS (SELECT *, min(CASE WHEN state <> 'firing' THEN hour END) OVER (PARTITION BY instance ORDER BY hour ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_off FROM held)
    SELECT instance, since AS active_at, min(hour) AS fired_at, max(next_off) AS resolved_at FROM off WHERE state = 'firing' GROUP BY 1, 2""",
)
def alert_firings(spark, d):
    return A.firings(A.hold_for(TV.hourly(spark, d), ["instance"], "cond", "2h", "hour"), ["instance"], "hour")


@register("consecutive_miss", "SELECT instance, hour, CAST(sum(CASE WHEN cond THEN 1 ELSE 0 END) OVER (PARTITION BY instance, island ORDER BY hour ROWS UNBOUNDED PRECEDING) AS BIGINT) AS misses FROM marked")
def consecutive_miss(spark, d):
    return A.consecutive(TV.hourly(spark, d), ["instance"], F.col("cond"), "hour").select("instance", "hour", "misses")


@register("health_state", "SELECT instance, hour, sum(CASE WHEN cond THEN 1 ELSE 0 END) OVER (PARTITION BY instance, island ORDER BY hour ROWS UNBOUNDED PRECEDING) < 3 AS healthy FROM marked")
def health_state(spark, d):
    return A.health(TV.hourly(spark, d).withColumn("ok", ~F.col("cond")), ["instance"], "ok", 3, ts="hour").select("instance", "hour", "healthy")


@register(
    "cooldown_actions",
    """, h AS (SELECT instance, CAST(epoch(hour) - epoch(TIMESTAMP '2024-01-01 00:00:00') AS BIGINT) AS t, cond, row_number() OVER (PARTITION BY instance ORDER BY hour) AS rn FROM hourly),
    fold AS (
      SELECT DISTINCT instance, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS last, CAST(0 AS BIGINT) AS misses, false AS acted FROM h
      UNION ALL
      SELECT instance, rn, t, CASE WHEN act THEN 0 ELSE c END, CASE WHEN act THEN t ELSE last END, least(c, 2), act FROM (
        SELECT *, c >= 2 AND (last IS NULL OR t - last >= 18000) AS act FROM (
          SELECT h.instance, h.rn, h.t, f.last, CASE WHEN h.cond THEN f.n + 1 ELSE 0 END AS c FROM fold f JOIN h ON h.instance = f.instance AND h.rn = f.rn + 1)))
    SELECT instance, t, misses, acted FROM fold WHERE rn > 0""",
)
def cooldown_actions(spark, d):
    rows = TV.hourly(spark, d).withColumn("t", (F.timestamp_diff("HOUR", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("hour")) * 3600).cast("long"))
    return A.act_with_cooldown(rows.select("instance", "t", "cond"), ["instance"], "cond", 2, 18000).select("instance", "t", "misses", "acted")


def _order_alerts(spark, d):
    severity = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "critical").when(F.col("o_orderpriority") == "3-MEDIUM", "warning").otherwise("info")
    return TV.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", severity.alias("severity"), F.col("o_orderpriority").alias("alertname"))


@register("alert_route", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'critical' ELSE 'warning' END AS contact, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 5 ELSE 3 END AS priority, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'rotating_light' ELSE 'warning' END AS tags FROM orders")
def alert_route(spark, d):
    return A.route(_order_alerts(spark, d)).select("o_orderkey", "contact", "priority", "tags")


@register("alert_group", "SELECT o_orderpriority AS alertname, o_custkey, count(*) AS n_alerts, string_agg('order ' || CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY o_orderkey) AS message FROM orders GROUP BY 1, 2")
def alert_group(spark, d):
    rows = _order_alerts(spark, d).withColumn("description", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
    return A.group_alerts(rows, ["alertname", "o_custkey"], "description", ["o_orderkey"])


@register(
    "alert_pages",
    """SELECT alertname, page, count(*) AS n_alerts, string_agg('order ' || CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY o_orderkey) AS message FROM (
      SELECT o_orderkey, o_orderpriority AS alertname, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 50 AS BIGINT) AS page FROM orders) GROUP BY 1, 2""",
)
def alert_pages(spark, d):
    rows = _order_alerts(spark, d).withColumn("description", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
    return A.group_pages(rows, ["alertname"], "description", "o_orderkey", 50, 8192)


@register("alert_debounce", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderdate ELSE o_orderdate + INTERVAL 5 MINUTES END AS act_at FROM orders")
def alert_debounce(spark, d):
    return A.debounce(_order_alerts(spark, d), ts="o_orderdate").select("o_orderkey", "act_at")


@register("push_title", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '[done] ' ELSE '[open] ' END || o_orderpriority AS title FROM orders")
def push_title(spark, d):
    o = TV.table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("firing"))
    return o.select("o_orderkey", A.push_title("status", "o_orderpriority").alias("title"))


@register("status_payload", """SELECT o_orderkey, '{"content":"' || CASE o_orderstatus WHEN 'F' THEN '✅ Resolved' WHEN 'O' THEN 'Unacknowledged' ELSE o_orderstatus END || '","allowed_mentions":{"parse":[]}}' AS payload FROM orders""")
def status_payload(spark, d):
    o = TV.table(spark, d, "orders").withColumn("event_type", F.when(F.col("o_orderstatus") == "F", "resolve").when(F.col("o_orderstatus") == "O", "unacknowledge").otherwise(F.col("o_orderstatus")))
    return A.status_change(o).select("o_orderkey", "payload")


@register("thread_payload", """SELECT o_orderkey, '{"thread_name":"' || o_orderpriority || '","content":"order of ' || CAST(o_custkey AS VARCHAR) || '\\n-- group ' || CAST(o_orderkey AS VARCHAR) || ', see https://example.org/' || CAST(o_orderkey AS VARCHAR) || '","allowed_mentions":{"parse":[]}}' AS payload FROM orders""")
def thread_payload(spark, d):
    key = F.col("o_orderkey").cast("string")
    o = TV.table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("title"), F.lit("").alias("summary"), F.concat(F.lit("order of "), F.col("o_custkey").cast("string")).alias("description"), key.alias("group_id"), F.concat(F.lit("https://example.org/"), key).alias("link"))
    return A.thread_open(o).select("o_orderkey", "payload")


@register("thread_join", "SELECT o.o_orderkey, o.o_orderstatus, c.c_name AS channel_id FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey")
def thread_join(spark, d):
    events = TV.table(spark, d, "orders").withColumn("group_id", F.col("o_custkey"))
    opened = TV.table(spark, d, "customer").select(F.col("c_custkey").alias("group_id"), F.col("c_name").alias("channel_id"))
    return A.with_thread(events, opened).select("o_orderkey", "o_orderstatus", "channel_id")


@register("notification_times")
def notification_times(spark, d):
    e = TV.table(spark, d, "events").where("event_type = 'error'").select(F.lit("error").alias("alertname"), F.concat(F.lit("h"), (F.col("user_id") % 10).cast("string")).alias("host"), "ts", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz").alias("until"))
    return A.notification_times(e, ["alertname", "host"])


@register(
    "bucket_overflows",
    """, e AS (SELECT event_id, user_id, ts, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) - 1 AS nth, user_id % 40 AS k FROM events),
    p AS (SELECT *, nth * 7200000 - ms AS poured FROM e),
    l AS (SELECT *, CAST(poured - min(poured) OVER (PARTITION BY k ORDER BY nth) + 7200000 AS BIGINT) AS level_ms FROM p)
    SELECT event_id, k, level_ms, level_ms > 3 * 7200000 AND coalesce(lag(level_ms) OVER (PARTITION BY k ORDER BY nth), 0) <= 3 * 7200000 AS overflow FROM l""",
)
def bucket_overflows(spark, d):
    """Every event poured into one of 40 buckets of three drops, of which one leaks in two hours."""
    e = TV.table(spark, d, "events").withColumn("k", F.col("user_id") % 40)
    return B.levels(e, ["k"], "2h", 3, ties=["event_id"]).select("event_id", "k", "level_ms", "overflow")


STATES = [
    {"alert": "Any", "expr": {"kind": "compare", "op": ">", "number": 20, "of": {"kind": "series", "metric": "g", "lookback": "24h"}}},
    {"alert": "None", "expr": {"kind": "compare", "op": ">", "number": 1e9, "of": {"kind": "series", "metric": "g", "lookback": "24h"}}},
    {"alert": "Broken", "expr": {"kind": "aggregate", "fn": "mode", "of": {"kind": "series", "metric": "g", "lookback": "24h"}}},
]


@register("rule_states", "SELECT 'Any' AS alert, CASE WHEN count(*) > 0 THEN 'alerting' ELSE 'ok' END AS state, count(*) AS n FROM latest WHERE value > 20 UNION ALL SELECT 'None', CASE WHEN count(*) > 0 THEN 'alerting' ELSE 'ok' END, count(*) FROM latest WHERE value > 1e9 UNION ALL SELECT 'Broken', 'error', NULL")
def rule_states(spark, d):
    """A rule that alerts, one that does not, and one that fails."""
    return rules.state_of_each(TV.gauge(spark, d), STATES, AT).select("alert", "state", "n")


@register(
    "reference_layers",
    """, e AS (SELECT o_orderkey AS k FROM orders), r AS (SELECT k AS c, k // 3 AS p FROM e UNION SELECT k, k - 7 FROM e WHERE k % 5 = 0),
    l AS (SELECT c, p FROM r WHERE p IN (SELECT k FROM e) AND c <> p),
    walk(k, layer) AS (SELECT k, 0 FROM e UNION SELECT l.c, w.layer + 1 FROM walk w JOIN l ON l.p = w.k)
    SELECT k AS o_orderkey, max(layer) AS layer FROM walk GROUP BY 1""",
)
def reference_layers(spark, d):
    """Orders that refer to one of a third of their number, and some to one seven before: in which round each can be made."""
    o = TV.table(spark, d, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    third = o.select(k.alias("child"), F.expr("o_orderkey div 3").alias("parent"))
    seven = o.where(k % 5 == 0).select(k.alias("child"), (k - 7).alias("parent"))
    return I.layers(o, third.unionByName(seven).where("child <> parent"), "o_orderkey").select("o_orderkey", "layer")


@register("query_state", "SELECT CASE WHEN count(*) > 0 THEN 'alerting' ELSE 'ok' END AS state, count(*) AS n FROM latest WHERE value > 1000000")
def query_state(spark, d):
    return A.query_state(V.compare(S.select_series(TV.gauge(spark, d), "g", [], AT, "24h"), ">", 1e6))


@register(
    "silent_senders",
    """, t AS (SELECT unnest(generate_series((SELECT date_trunc('hour', min(ts)) FROM events), (SELECT date_trunc('hour', max(ts)) FROM events) + INTERVAL 12 HOURS, INTERVAL 12 HOURS)) AS tick), u AS (SELECT DISTINCT user_id FROM events)
    SELECT user_id, tick FROM u CROSS JOIN t WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.ts > t.tick - INTERVAL 12 HOURS AND e.ts <= t.tick)""",
)
def silent_senders(spark, d):
    """Ticks from the first hour of all events to the last, a window apart, so that no time is left out."""
    from ..streaming.alerts import silent, ticks_of

    e = TV.table(spark, d, "events")
    return silent(e, e, "user_id", ticks_of(e, "ts", "12h"), "12h")


# Inventory and configuration


@register("lookup_join", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def lookup_join(spark, d):
    return I.lookup(TV.table(spark, d, "nation"), TV.table(spark, d, "region"), {"n_regionkey": "r_regionkey"}, ["r_name"]).select("n_name", "r_name")


@register("theta_self_join", "SELECT a.n_name, b.n_name AS other_n_name, a.n_regionkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name")
def theta_self_join(spark, d):
    return I.others(TV.table(spark, d, "nation"), "n_name", "n_regionkey").select("n_name", "other_n_name", "n_regionkey")


@register("missing_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def missing_anti(spark, d):
    return I.missing(TV.table(spark, d, "customer").select("c_custkey"), TV.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@register("version_differs", "SELECT a.p_partkey AS k, a.p_brand AS version, b.p_brand AS installed_version FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE coalesce(b.p_brand, '') <> a.p_brand")
def version_differs(spark, d):
    p = TV.table(spark, d, "part")
    want, have = p.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("version")), p.select((F.col("p_partkey") - 1).alias("k"), F.col("p_brand").alias("version"))
    return I.differing(want, have, "k", "version")


@register("dup_key", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def dup_key(spark, d):
    return I.duplicates(TV.table(spark, d, "part"), ["p_name"])


@register("all_back", "SELECT count(*) AS n_before, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS n_after, count(*) = count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS all_back FROM customer")
def all_back(spark, d):
    return I.all_back(TV.table(spark, d, "customer").select("c_custkey"), TV.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@register("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return I.union(TV.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), TV.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@register("set_bag_union", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def set_bag_union(spark, d):
    both = TV.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionAll(TV.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))
    return both.groupBy("k").agg(F.count("*").alias("n"))


@register("set_intersect", "SELECT n_name AS host FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND n_nationkey % 2 = 0")
def set_intersect(spark, d):
    return I.hosts_of(TV.edges(spark, d), "ASIA:&vm")


@register("set_except", "SELECT n_name AS host FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def set_except(spark, d):
    return I.hosts_of(TV.edges(spark, d), "all:!ASIA")


@register("set_first", "SELECT min(n_name) AS host FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
def set_first(spark, d):
    return I.hosts_of(TV.edges(spark, d), "EUROPE[0]")


@register("recursive_groups", "SELECT DISTINCT n_name AS host FROM nation JOIN region ON n_regionkey = r_regionkey")
def recursive_groups(spark, d):
    return I.members(TV.edges(spark, d), "all")


@register(
    "desired_diff",
    """, d AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer), a AS (SELECT o_custkey + 2 AS k, CAST(max(o_orderkey % 25) AS INTEGER) AS v FROM orders GROUP BY 1)
    SELECT coalesce(d.k, a.k) AS k, d.v AS want_v, a.v AS have_v, CASE WHEN a.k IS NULL THEN 'create' WHEN d.k IS NULL THEN 'delete' WHEN d.v = a.v THEN 'keep' ELSE 'update' END AS action FROM d FULL JOIN a ON d.k = a.k""",
)
def desired_diff(spark, d):
    """All customers against all that orders say of them, two keys on."""
    want = TV.table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    have = TV.table(spark, d, "orders").groupBy((F.col("o_custkey") + 2).alias("k")).agg(F.max(F.col("o_orderkey") % 25).cast("int").alias("v"))
    return I.desired_diff(want, have, "k", ["v"])


@register("upsert_latest", "SELECT k, v, n FROM (SELECT o_custkey AS k, o_orderkey AS n, o_orderstatus AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def upsert_latest(spark, d):
    from ..sources.sinks import upsert

    o = TV.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("n"), F.col("o_orderstatus").alias("v"))
    return upsert(o.where("n % 2 = 0"), o.where("n % 2 = 1"), "k", "n")


def _overlaps(spark, d, kind: str) -> DataFrame:
    # to the nearest millisecond, halves away from 1970, as epoch_ms rounds; in whole numbers
    us = micros(F.col("ts").cast("timestamp_ntz"))
    ms = F.call_function("div", us + F.when(us < 0, -500).otherwise(500), F.lit(1000))
    e = TV.table(spark, d, "events")
    r = e.where(F.col("event_type") == kind).select(F.col("event_id").alias("id"), ms.alias("t0"), F.when(F.col("event_id") % 3 != 0, ms + 7200000).alias("t1"))
    return I.overlapping(e.select("event_id", ms.alias("t")), r, "t", "t0", "t1").select("event_id", "id")


OVERLAPS = """, r AS (SELECT event_id AS id, epoch_ms(ts) AS t0, CASE WHEN event_id % 3 = 0 THEN NULL ELSE epoch_ms(ts) + 7200000 END AS t1 FROM events WHERE event_type = '{kind}'),
    p AS (SELECT event_id, epoch_ms(ts) AS t FROM events)
    SELECT p.event_id, r.id FROM p JOIN r ON p.t >= r.t0 AND p.t <= coalesce(r.t1, r.t0)"""


@register("annotation_overlap", OVERLAPS.replace("{kind}", "error"))
def annotation_overlap(spark, d):
    """Every error as a region, every event as a point."""
    return _overlaps(spark, d, "error")


@register("annotation_overlap_signups", OVERLAPS.replace("{kind}", "signup"))
def annotation_overlap_signups(spark, d):
    """Every signup as a region, every event as a point."""
    return _overlaps(spark, d, "signup")


@register("consistent_keys", "SELECT k, in_c, in_s FROM (SELECT coalesce(c.k, s.k) AS k, c.k IS NOT NULL AS in_c, s.k IS NOT NULL AS in_s FROM (SELECT DISTINCT c_custkey AS k FROM customer) c FULL JOIN (SELECT DISTINCT s_suppkey AS k FROM supplier) s ON c.k = s.k) WHERE NOT (in_c AND in_s)")
def consistent_keys(spark, d):
    return I.consistent({"c": TV.table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "s": TV.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))}, "k")


@register("output_map", "SELECT string_agg(r_name || '=' || CAST(r_regionkey AS VARCHAR), ',' ORDER BY r_name) AS output FROM region")
def output_map(spark, d):
    out = I.as_map(TV.table(spark, d, "region"), "r_name", "r_regionkey")
    return out.select(F.array_join(F.transform(F.map_entries("output"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("output"))


@register("optional_defaults", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size ELSE 2 END AS cores FROM part")
def optional_defaults(spark, d):
    p = TV.table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_size")).alias("cores"))
    return I.with_defaults(p, {"cores": 2})


@register("score_product", "SELECT r_name, f, p FROM region CROSS JOIN (VALUES ('a'), ('b')) x(f) CROSS JOIN (VALUES ('hd'), ('uhd')) y(p)")
def score_product(spark, d):
    r = TV.table(spark, d, "region").select("r_name", F.array(F.lit("a"), F.lit("b")).alias("f"), F.array(F.lit("hd"), F.lit("uhd")).alias("p"))
    return I.product(r, "f", "p").select("r_name", "f", "p")


@register("reference_resolve", "SELECT p_partkey, s_suppkey AS owner FROM part LEFT JOIN supplier ON s_suppkey = p_size AND s_nationkey = p_partkey % 25")
def reference_resolve(spark, d):
    p = TV.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("a"), (F.col("p_partkey") % 25).cast("int").alias("b"))
    return I.resolve(p, TV.table(spark, d, "supplier"), {"a": "s_suppkey", "b": "s_nationkey"}, "s_suppkey", "owner").select("p_partkey", "owner")


@register("route_allowlist", "SELECT o_orderkey, (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') OR (o_orderstatus = 'O' AND starts_with(o_orderpriority, '2')) AS ok FROM orders")
def route_allowlist(spark, d):
    return TV.table(spark, d, "orders").select("o_orderkey", I.allowed("o_orderstatus", "o_orderpriority", [("F", "1-URGENT"), ("O", "2*")]).alias("ok"))


# Text and scalars


@register("version_latest", "SELECT 'vmlinuz-6.8.' || CAST(max(p_size) AS VARCHAR) AS newest FROM part")
def version_latest(spark, d):
    p = TV.table(spark, d, "part").select(F.concat(F.lit("vmlinuz-6.8."), F.col("p_size").cast("string")).alias("f"))
    return p.agg(F.max_by("f", text.version_key("f", "vmlinuz-")).alias("newest"))


@register("version_below", "SELECT p_partkey, p_size < 15 AS below FROM part")
def version_below(spark, d):
    return TV.table(spark, d, "part").select("p_partkey", text.version_below(F.concat(F.lit("v3."), F.col("p_size").cast("string"), F.lit("-rc1")), 3, 15).alias("below"))


UPDATE_RULES = [
    U.UpdateRule({"merge": "hand"}),
    U.UpdateRule({"merge": "auto", "batch": "small"}, kinds=("minor", "patch")),
    U.UpdateRule({"batch": "first"}, patterns=("Brand#1.*",), names=("Brand#55",)),
    U.UpdateRule({"merge": "never"}, names=("Brand#22", "Brand#23"), below=(3, 20)),
]


@register(
    "update_rules",
    """SELECT p_partkey, kind, CASE WHEN p_brand IN ('Brand#22', 'Brand#23') AND below THEN 'never' WHEN kind IN ('minor', 'patch') THEN 'auto' ELSE 'hand' END AS merge,
      CASE WHEN p_brand LIKE 'Brand#1%' OR p_brand = 'Brand#55' THEN 'first' WHEN kind IN ('minor', 'patch') THEN 'small' END AS batch FROM (
      SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'major' WHEN 1 THEN 'minor' WHEN 2 THEN 'patch' WHEN 3 THEN 'prerelease' END AS kind,
        CASE p_partkey % 5 WHEN 0 THEN false WHEN 1 THEN p_size + 1 < 20 WHEN 4 THEN true ELSE p_size < 20 END AS below FROM part)""",
)
def update_rules(spark, d):
    step, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    new = F.when(step == 0, "v4.0").when(step == 1, F.concat(F.lit("3."), (F.col("p_size") + 1).cast("string"))).when(step == 2, F.concat(F.lit("3."), size, F.lit(".1")))
    new = new.when(step == 3, F.concat(F.lit("v3."), size)).otherwise("2.9.9")
    current = F.concat(F.lit("v3."), size, F.when(step == 3, "-rc2").otherwise(""))
    rows = TV.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("package"), current.alias("current"), new.alias("new"))
    return U.settle(rows, UPDATE_RULES).select("p_partkey", "kind", "merge", "batch")


PIN = r"# renovate: datasource=(?P<datasource>\S+) depName=(?P<depName>\S+)\n\S+=(?P<currentValue>\S+)"


@register("pin_extract", "SELECT p_partkey, 'docker' AS datasource, replace(p_name, ' ', '/') AS depname, CAST(p_size AS VARCHAR) AS currentvalue FROM part UNION ALL SELECT p_partkey, 'github', p_brand, 'v' || CAST(p_size AS VARCHAR) FROM part")
def pin_extract(spark, d):
    size = F.col("p_size").cast("string")
    content = F.concat(F.lit("# renovate: datasource=docker depName="), F.replace("p_name", F.lit(" "), F.lit("/")), F.lit("\na="), size, F.lit("\nx=1\n# renovate: datasource=github depName="), F.col("p_brand"), F.lit("\nb=v"), size, F.lit("\n"))
    rows = TV.table(spark, d, "part").select("p_partkey", F.explode(text.extract_all_named(content, PIN)).alias("m"))
    return rows.select("p_partkey", F.col("m.datasource").alias("datasource"), F.col("m.depName").alias("depname"), F.col("m.currentValue").alias("currentvalue"))


@register("duration_parse", "SELECT p_partkey, CAST(p_size * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 ELSE 86400 END AS BIGINT) AS s, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) || ' s' WHEN 1 THEN CAST(p_size AS VARCHAR) || ' min' WHEN 2 THEN CAST(p_size AS VARCHAR) || ' h' ELSE CAST(p_size * 24 AS VARCHAR) || ' h' END AS since FROM part")
def duration_parse(spark, d):
    unit = F.element_at(F.array(*[F.lit(u) for u in "smhd"]), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = TV.table(spark, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("t"))
    return p.select("p_partkey", durations.seconds_of("t").alias("s"), durations.since_argument("t").alias("since"))


@register("largest_sizes", "SELECT p_partkey, CAST(p_size AS DOUBLE) * CASE WHEN p_partkey % 2 = 0 THEN 1024 ELSE 1048576 END AS bytes FROM part ORDER BY 2 DESC, 1 LIMIT 20")
def largest_sizes(spark, d):
    p = TV.table(spark, d, "part").select("p_partkey", text.human_bytes(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "K").otherwise("M"))).alias("bytes"))
    return p.orderBy(F.col("bytes").desc(), "p_partkey").limit(20)


@register("render_template", "SELECT p_partkey, p_name || ' still has ' || printf('%.1f', p_partkey / 2) || '% free' || CASE WHEN p_type = 'PROMO' THEN '!' ELSE '' END AS message FROM part")
def render_template(spark, d):
    message = text.template('{{ $labels.p_name }} still has {{ printf "%.1f" v }}% free{{ if eq p_type "PROMO" }}!{{ end }}', F.col)
    return TV.table(spark, d, "part").withColumn("v", F.col("p_partkey") / 2).select("p_partkey", message.alias("message"))


@register("paths_and_encodings", "SELECT page_id, regexp_extract(url, '[^/]*$') AS base, CAST(length(url) AS INTEGER) AS n FROM pages")
def paths_and_encodings(spark, d):
    decoded = F.unbase64(F.base64(F.col("url").cast("binary"))).cast("string")
    return TV.table(spark, d, "pages").select("page_id", text.basename(decoded).alias("base"), F.length(decoded).alias("n"))


@register("first_non_empty", "SELECT p_partkey, coalesce(nullif(CASE WHEN p_type = 'PROMO' THEN p_name ELSE '' END, ''), p_brand) AS v FROM part")
def first_non_empty(spark, d):
    return TV.table(spark, d, "part").select("p_partkey", text.non_empty(F.when(F.col("p_type") == "PROMO", F.col("p_name")).otherwise(F.lit("")), F.col("p_brand")).alias("v"))


@register("latest_per_tick", "SELECT hour, instance, value FROM (SELECT date_trunc('hour', ts) AS hour, instance, value, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY value DESC, instance, event_id) AS r FROM g) WHERE r <= 3")
def latest_per_tick(spark, d):
    rows = TV.gauge(spark, d).select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), label("instance").alias("instance"), "value", "event_id")
    return V.ranked(rows, ["hour"], ["instance", "event_id"], 3).select("hour", "instance", "value")


# Records: arrays of structs, text predicates, nested fields, frames


def _lines_of_order(spark, d):
    """Orders with their lines as an array of structs, in order of the line's number."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"), F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("tax"))))
    return TV.table(spark, d, "lineitem").groupBy("l_orderkey").agg(entries.alias("items"))


@register("select_attr_eq", "SELECT l_orderkey, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) FILTER (WHERE l_returnflag = 'R'), '') AS numbers FROM lineitem GROUP BY 1")
def select_attr_eq(spark, d):
    numbers = RC.attribute(RC.select_by("items", "flag", "eq", "R"), "n")
    return _lines_of_order(spark, d).select("l_orderkey", F.array_join(F.transform(numbers, lambda n: n.cast("string")), ",").alias("numbers"))


@register("select_attr_in", "SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag IN ('A', 'N')) AS n FROM lineitem GROUP BY 1")
def select_attr_in(spark, d):
    return _lines_of_order(spark, d).select("l_orderkey", F.size(RC.select_by("items", "flag", "in", ["A", "N"])).cast("long").alias("n"))


@register("reject_attr_defined", "SELECT l_orderkey, count(*) FILTER (WHERE NOT l_tax > 0.04) AS n FROM lineitem GROUP BY 1")
def reject_attr_defined(spark, d):
    return _lines_of_order(spark, d).select("l_orderkey", F.size(RC.reject_by("items", "tax", "defined")).cast("long").alias("n"))


@register("select_match", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^(The|Der|El) '))) AS n FROM documents")
def select_match(spark, d):
    lines = F.split("text", "\n", -1)
    return TV.table(spark, d, "documents").select("doc_id", F.size(RC.select_by(lines, None, "match", "(The|Der|El) ")).cast("long").alias("n"))


@register("search_not_search", "SELECT page_id FROM pages WHERE regexp_matches(url, '/[0-9]+$') AND NOT regexp_matches(url, 'blog')")
def search_not_search(spark, d):
    return TV.table(spark, d, "pages").where(RC.searches("url", "/[0-9]+$") & ~RC.searches("url", "blog")).select("page_id")


@register("given_and_among", "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND length(text) > 0 AND source IS NOT NULL")
def given_and_among(spark, d):
    return TV.table(spark, d, "documents").where(RC.among("lang", ["en", "de"]) & RC.given("text") & RC.given("source", "any")).select("doc_id")


@register("exclude_values", "SELECT p_partkey FROM part WHERE p_brand IS NULL OR p_brand NOT IN ('Brand#11', 'Brand#22')")
def exclude_values(spark, d):
    return RC.excluding(TV.table(spark, d, "part"), "p_brand", ["Brand#11", "Brand#22"]).select("p_partkey")


@register("glob_then_member", "SELECT c_custkey FROM customer WHERE NOT (c_name GLOB '*[13579]' OR c_name GLOB 'Customer#00000000?') AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def glob_then_member(spark, d):
    return RC.picked(TV.table(spark, d, "customer"), "c_name", ["*[13579]", "Customer#00000000?"], "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey")


@register(
    "call_allowlist",
    """SELECT o_orderkey, (o_orderstatus = 'F' AND regexp_full_match(CAST(o_custkey AS VARCHAR), '[0-9]{1,2}')) OR (o_orderstatus = 'O' AND o_orderkey % 3 <> 0) AS ok FROM orders""",
)
def call_allowlist(spark, d):
    o = TV.table(spark, d, "orders")
    words = F.when(F.col("o_orderkey") % 3 == 0, F.array("o_orderstatus", F.col("o_custkey").cast("string"))).otherwise(F.array("o_orderstatus", F.col("o_custkey").cast("string"), F.lit("x")))
    words = F.when(F.col("o_orderstatus") == "F", F.array("o_orderstatus", F.col("o_custkey").cast("string"))).otherwise(words)
    return o.select("o_orderkey", RC.call_allowed(words, {"F": ["[0-9]{1,2}"], "O": ["[0-9]+", "x"]}).alias("ok"))


@register("json_number_probe", "SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS DOUBLE) >= 50, false) AS ok FROM events")
def json_number_probe(spark, d):
    return TV.table(spark, d, "events").select("event_id", RC.json_number("props", "$.k", 50).alias("ok"))


@register("drop_nested_field", "SELECT c_custkey, '{\"name\":\"' || c_name || '\",\"config\":{\"segment\":\"' || c_mktsegment || '\"}}' AS text FROM customer")
def drop_nested_field(spark, d):
    config = F.struct(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("env"))
    c = TV.table(spark, d, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), config.alias("config")).alias("r"))
    return c.select("c_custkey", F.to_json(RC.without_fields("r", "config.env")).alias("text"))


@register("nested_defaults", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size ELSE 2 END AS cores, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'none' END AS tag FROM part")
def nested_defaults(spark, d):
    own = F.struct(F.when(F.col("p_size") > 25, F.col("p_size")).alias("cores"), F.when(F.col("p_size") % 2 == 0, F.struct(F.col("p_brand").alias("tag"))).alias("meta"))
    base = F.struct(F.lit(2).alias("cores"), F.struct(F.lit("none").alias("tag")).alias("meta"))
    p = TV.table(spark, d, "part").select("p_partkey", RC.merged(base, own, {"cores": None, "meta": {"tag": None}}).alias("m"))
    return p.select("p_partkey", "m.cores", "m.meta.tag")


@register(
    "merge_frames",
    "SELECT coalesce(a.k, b.k) AS k, a.n_customers, b.n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier GROUP BY 1) b ON a.k = b.k",
)
def merge_frames(spark, d):
    c = TV.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_customers"))
    s = TV.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers"))
    return RC.merge_frames([c, s], ["k"])


@register("start_order", "SELECT n_name, CAST(row_number() OVER (ORDER BY CASE WHEN n_regionkey > 0 THEN n_regionkey ELSE 2 END, n_name) AS INTEGER) AS starts FROM nation")
def start_order(spark, d):
    n = TV.table(spark, d, "nation").withColumn("o", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")))
    return RC.start_order(n, "n_name", "o", 2).select("n_name", "starts")


@register(
    "bound_targets",
    """SELECT event_id, value, CAST(c_nationkey % 3 AS VARCHAR) || '/radio/' || lower(c_mktsegment) AS place, event_type AS job FROM events JOIN customer ON c_custkey = user_id
    WHERE c_mktsegment <> 'HOUSEHOLD' AND NOT (c_mktsegment = 'MACHINERY' AND c_nationkey % 3 = 0)""",
)
def bound_targets(spark, d):
    """Readings under the labels of the meter that they came from, by its radio line."""
    meters = RL.relabel(RL.per_network(_meters(spark, d), prefix="__line_"), [RL.Rule(("__line_name",), regex="radio", action="keep"), *METER_RULES])
    at = lambda e: F.col("user_id").cast("string").alias("at")
    return RC.bound_to(TV.gauge(spark, d, at), meters, "at").select("event_id", "value", label("place").alias("place"), label("job").alias("job"))


@register("query_string", "SELECT p_partkey, 'title=' || replace(replace(p_name, '%', '%25'), ' ', '%20') || '&priority=' || CAST(p_size AS VARCHAR) AS q FROM part")
def query_string(spark, d):
    return TV.table(spark, d, "part").select("p_partkey", RC.query_string(title="p_name", priority="p_size", none=F.lit(None)).alias("q"))


@register("metrics_page", "SELECT 'up{instance=\"' || instance || '\",job=\"up\"} ' || CASE WHEN value = 0 THEN '0.0' ELSE '1.0' END AS value FROM up")
def metrics_page(spark, d):
    return RC.exposition(TV.up(spark, d))


@register("older_than", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 168 HOURS")
def older_than(spark, d):
    return RC.older_than(TV.table(spark, d, "events"), "ts", AT, "168h").select("event_id")


@register("label_key_escape", ", k AS (SELECT event_type || ',b=' || CAST(user_id % 3 AS VARCHAR) AS a, CASE WHEN user_id % 2 = 0 THEN 'x=' ELSE '' END AS b, value FROM events) SELECT a, b, sum(value) AS value, count(*) AS n FROM k GROUP BY 1, 2")
def label_key_escape(spark, d):
    e = TV.table(spark, d, "events")
    a = F.concat("event_type", F.lit(",b="), (F.col("user_id") % 3).cast("string"))
    labels = F.create_map(F.lit("a"), a, F.lit("b"), F.when(F.col("user_id") % 2 == 0, "x=").otherwise(""))
    rows = e.select(labels.alias("labels"), "value").withColumn("series_key", series_key("labels"))
    sums = rows.groupBy("series_key").agg(F.any_value("labels").alias("labels"), F.sum("value").alias("value"), F.count("*").alias("n"))
    return sums.select(label("a").alias("a"), label("b").alias("b"), "value", "n")


@register("output_object", """SELECT CASE WHEN k = min(k) OVER () THEN '{' ELSE ',' END || '"' || k || '":"' || p_name || '"' || CASE WHEN k = max(k) OVER () THEN '}' ELSE '' END AS line
  FROM (SELECT 'part ' || CAST(p_partkey AS VARCHAR) AS k, p_name FROM part)""")
def output_object(spark, d):
    return I.object_lines(TV.table(spark, d, "part").withColumn("k", F.concat(F.lit("part "), F.col("p_partkey").cast("string"))), "k", "p_name")


@register("label_allowlist", "SELECT 'g' AS metric, 'job=' || job AS series, count(*) AS n FROM g GROUP BY 1, 2 UNION ALL SELECT 'c_total', 'instance=' || instance || ',job=' || job, count(*) FROM c GROUP BY 1, 2")
def label_allowlist(spark, d):
    every = [f(spark, d).select("metric", "labels", "ts", "value") for f in (TV.gauge, TV.counter, TV.up)]
    rows = S.keep_labels(S.drop_families(every[0].unionByName(every[1]).unionByName(every[2]), "up"), ["job"], "g.*")
    return rows.groupBy("metric", series_key("labels").alias("series")).agg(F.count("*").alias("n"))


@register("series_legend", "SELECT DISTINCT job || ' on ' || instance AS legend FROM g")
def series_legend(spark, d):
    return TV.gauge(spark, d).select(text.template("{{job}} on {{instance}}", label).alias("legend")).distinct()


@register("strip_and_split", "SELECT p_partkey, regexp_replace('v' || CAST(p_size AS VARCHAR) || '.git', '^v|[.]git$', '', 'g') AS bare, upper(string_split(trim('  ' || p_type || '  '), ' ')[1]) AS first_word, TRY_CAST(p_name AS BIGINT) IS NULL AS no_number FROM part")
def strip_and_split(spark, d):
    size = F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit(".git"))
    return TV.table(spark, d, "part").select(
        "p_partkey", text.stripped(size, "v", ".git").alias("bare"), F.upper(F.get(F.split(F.trim(F.concat(F.lit("  "), "p_type", F.lit("  "))), " "), F.lit(0))).alias("first_word"), F.col("p_name").try_cast("bigint").isNull().alias("no_number"),
    )


@register("age_ms", "SELECT event_id, CAST(epoch_ms(TIMESTAMP '2024-02-15 12:00:00') - floor(epoch_us(ts) / 1000) AS BIGINT) AS age_ms FROM events")
def age_ms(spark, d):
    return TV.table(spark, d, "events").select("event_id", durations.age_ms("ts", "2024-02-15 12:00:00").alias("age_ms"))


@register(
    "probes_agree",
    f"""SELECT job, instance, count(*) AS n_probes, count(*) FILTER (WHERE v < 0.5) AS n_failing, avg(v) AS value FROM (
      SELECT 'up' AS job, CAST(user_id % 10 AS VARCHAR) AS instance, user_id % 3 AS probe, avg(CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS v FROM events
      WHERE ts > TIMESTAMP '{AT}' - INTERVAL 24 HOURS AND ts <= TIMESTAMP '{AT}' GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def probes_agree(spark, d):
    e = TV.table(spark, d, "events").select("event_id", (F.col("user_id") % 3).cast("string").alias("p"))
    up = TV.up(spark, d).join(e, "event_id").withColumn("labels", merge_labels(F.col("labels"), F.create_map(F.lit("probe"), F.col("p"))))
    return P.by_probe(up, "up", AT, "24h")
