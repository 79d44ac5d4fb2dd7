"""Alert evaluation: holding, miss counting, routing, grouping, notification payloads and schedules."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durations import seconds
from ..functions.text import lookup, non_empty, template
from ..model import label, merge_labels
from ..sources.shared import settled
from .pieces import SPAN, chained, last_before, next_of, numbered, runs


@dataclass(frozen=True)
class Rule:
    """An alert rule: its expression is a function from samples and a time to a vector."""

    alert: str
    hold: str = "0s"
    labels: dict[str, str] = field(default_factory=dict)
    annotations: dict[str, str] = field(default_factory=dict)


def hold_for(evals: DataFrame, keys: list[str], cond: str, hold: str | float, ts: str = "ts", span: str | float = SPAN) -> DataFrame:
    """evals: a row for each key and evaluation time, with a boolean. Adds state (inactive, pending or firing), active_at and ended_at: a key fires once its
    condition has been true at every evaluation for at least hold; a row that ends an alert has the time that it had been active from. A null
    condition is false. A key's evaluations are worked on in pieces of span."""
    held = F.col(ts) >= F.col("run_start") + F.make_dt_interval(secs=F.lit(float(seconds(hold))))
    state = F.when(F.col("run_start").isNull(), "inactive").when(held, "firing").otherwise("pending")
    return runs(evals, keys, F.col(cond), ts, span).withColumn("state", state).withColumnsRenamed({"run_start": "active_at", "run_ended": "ended_at"}).drop("run_length")


def firings(held: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """The alerts in a table of states: keys, active_at, fired_at, resolved_at (null while firing)."""
    fired = F.min(F.when(F.col("state") == "firing", F.col(ts)))
    each = held.where("state = 'firing' OR ended_at IS NOT NULL").groupBy(*keys, F.coalesce("active_at", "ended_at").alias("active_at"))
    return each.agg(fired.alias("fired_at"), F.min(F.when(F.col("ended_at").isNotNull(), F.col(ts))).alias("resolved_at")).where("fired_at IS NOT NULL")


def consecutive(df: DataFrame, keys: list[str], miss: Column, ts: str = "ts", span: str | float = SPAN) -> DataFrame:
    """Adds misses: how many rows up to this one have missed in a row. A key's rows are worked on in pieces of span."""
    return runs(df, keys, miss, ts, span).withColumnRenamed("run_length", "misses").drop("run_start", "run_ended")


def health(checks: DataFrame, keys: list[str], ok: str, retries: int, started: str | None = None, start_period: str | float = 0, ts: str = "ts") -> DataFrame:
    """Adds healthy: false once retries checks in a row have failed; failures within start_period of started don't count."""
    failed = ~F.coalesce(F.col(ok), F.lit(False))
    if started:
        failed = failed & (F.col(ts) >= F.col(started) + F.make_dt_interval(secs=F.lit(float(seconds(start_period)))))
    return consecutive(checks, keys, failed, ts).withColumn("healthy", F.col("misses") < retries)


def act_with_cooldown(readings: DataFrame, keys: list[str], miss: str, limit: int, cooldown_s: int, t: str = "t", span: float = 65536) -> DataFrame:
    """Adds misses (as the watcher counts) and acted: a key's readings in order of t; after limit misses in a row it acts, if cooldown_s seconds have passed
    since it last did, and starts counting anew; a reading that is no miss (or null) resets. Of readings of one time, misses come last.

    After an action the next one is the first reading that ends limit misses in a row, is limit readings on, and cooldown_s on. Each reading that could
    be an action points to that one, and the actions are the places on the chain of these pointers from the first. No step takes a key's readings
    as a whole: they are numbered, counted and looked up in pieces of span readings (and as many cooldowns), and chains are followed by doubling."""
    known = [c for c in readings.columns if c not in ("misses", "acted")]
    rows = runs(numbered(readings.select(*known), keys, t, [miss], span * max(cooldown_s, 1), "place_"), keys, F.col(miss), "place_", span)
    rows = settled(rows.drop("run_ended"))
    could = rows.where(F.col("run_length") >= limit).select(*keys, F.col("place_").alias("a"), F.col(t).alias("t_"))
    on = next_of(could.select(*keys, F.col("a").alias("at")), could.select(*keys, "a", (F.col("a") + limit).alias("at")), keys, "at", "at", span)
    due = next_of(could.select(*keys, F.col("t_").alias("at"), F.col("a").alias("to")), could.select(*keys, "a", (F.col("t_") + cooldown_s).alias("at")), keys, "at", "to", span * max(cooldown_s, 1))
    on, due = on.select(*[F.col(k).alias(f"k_{i}") for i, k in enumerate(keys)], F.col("a").alias("a_"), "next_at"), due.drop("at")
    links = due.join(on, [F.col(k).eqNullSafe(F.col(f"k_{i}")) for i, k in enumerate(keys)] + [F.col("a") == F.col("a_")])
    links = links.select(*keys, "a", F.when(F.col("next_at").isNotNull() & F.col("next_to").isNotNull(), F.greatest("next_at", "next_to")).alias("b"))
    acts = chained(links, could.groupBy(*keys).agg(F.min("a").alias("a")), keys).withColumn("acted", F.lit(True))
    acts = acts.withColumnsRenamed({k: f"k_{i}" for i, k in enumerate(keys)})
    met = rows.join(acts, [F.col(k).eqNullSafe(F.col(f"k_{i}")) for i, k in enumerate(keys)] + [F.col("place_") == F.col("a")], "left")
    met = met.select(*rows.columns, F.coalesce("acted", F.lit(False)).alias("acted"))
    told = last_before(met, keys, F.when(F.col("acted"), F.col("place_")), "place_", span, "reset_")
    since = F.greatest(F.coalesce("reset_", F.lit(-1)), F.col("run_start") - 1)
    misses = F.when(F.col("run_length") > 0, F.least(F.lit(limit), F.col("place_") - since)).otherwise(0)
    return told.select(*known, misses.cast("long").alias("misses"), "acted")


#: What each severity's receiver is called, its priority and its tag. Anything unknown goes to warning.
RECEIVERS = {"critical": (5, "rotating_light"), "warning": (3, "warning")}


def route(alerts: DataFrame, severity: str = "severity", receivers: dict[str, tuple[int, str]] | None = None, default: str = "warning") -> DataFrame:
    """Adds contact, priority and tags: the receiver of the first matching severity, else the default's."""
    receivers = receivers or RECEIVERS
    out = {"contact": F.lit(default), "priority": F.lit(receivers[default][0]), "tags": F.lit(receivers[default][1])}
    for name, (priority, tag) in receivers.items():
        hit = F.col(severity) == name
        for k, v in (("contact", name), ("priority", priority), ("tags", tag)):
            out[k] = F.when(hit, F.lit(v)).otherwise(out[k])
    return alerts.withColumns(out)


def annotate(vec: DataFrame, rule: Rule) -> DataFrame:
    """A vector as alerts: its labels under the rule's, alertname, and the rule's annotations rendered with the labels and value."""
    own = {"alertname": rule.alert, **rule.labels}
    labels = merge_labels(F.col("labels"), F.create_map(*[F.lit(x) for kv in own.items() for x in kv]))
    value = lambda name: F.col("value") if name == "$value" else label(name)
    notes = [x for k, v in rule.annotations.items() for x in (F.lit(k), template(v, value))]
    made = F.create_map(*notes) if notes else F.create_map().cast("map<string,string>")
    return vec.withColumn("labels", labels).withColumn("annotations", made)


def group_alerts(alerts: DataFrame, by: list[str], description: str, order: list[str]) -> DataFrame:
    """Alerts by their group: how many, and their descriptions one to a line in the order given."""
    entries = F.array_sort(F.collect_list(F.struct(*order, F.col(description).alias("text_"))))
    return alerts.groupBy(*by).agg(F.count("*").alias("n_alerts"), entries.alias("e_")).select(
        *by, "n_alerts", F.array_join(F.transform("e_", lambda e: F.coalesce(e["text_"], F.lit(""))), "\n").alias("message")
    )


def group_pages(alerts: DataFrame, by: list[str], description: str, order: str, size: int = 100, span: str | float = SPAN, ties: list[str] | None = None) -> DataFrame:
    """Groups as pages of at most size alerts, so that a group of any size is spread over tasks: by, page (from 0), n_alerts, and message, the page's
    descriptions (null: empty) one to a line. Alerts stand in the order of a time or number, then of ties, then of their descriptions; span says how much of order a
    piece holds while places are counted."""
    rows = alerts.select(*by, F.col(order).alias("order_"), *[F.col(t).alias(f"tie_{i}_") for i, t in enumerate(ties or [])], F.coalesce(F.col(description), F.lit("")).alias("text_"))
    then = [c for c in rows.columns if c.startswith("tie_")] + ["text_"]
    placed = numbered(rows, by, "order_", then, span, "place_").withColumn("page", F.floor(F.col("place_") / size).cast("long"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place_", "text_"))), lambda e: e["text_"])
    return placed.groupBy(*by, "page").agg(F.count("*").alias("n_alerts"), F.array_join(lines, "\n").alias("message"))


def push_title(status: str = "status", alertname: str = "alertname", marks: dict[str, str] | None = None, default: str = "[open] ") -> Column:
    """The title of a push message: what marks its status (marks, else default), and the alert's name."""
    return F.concat(lookup(marks or {"resolved": "[done] "}, F.col(status), F.lit(default)), F.col(alertname))


#: What a group's change of status is called in its thread.
STATUS_TEXT = {
    "resolve": "✅ Resolved", "acknowledge": "\U0001f440 Acknowledged", "unacknowledge": "Unacknowledged",
    "unresolve": "\U0001f525 Firing again", "silence": "\U0001f515 Silenced", "unsilence": "\U0001f514 Unsilenced",
}


def thread_open(groups: DataFrame, footer: str = "\n-- group {{group_id}}, see {{link}}", name_length: int = 100, text_length: int = 1500) -> DataFrame:
    """Adds payload, the JSON that opens a thread for a group (title, summary, description, group_id, link): the name and the text cut to
    their lengths, and a footer, a template over the group's columns, that names the group."""
    body = F.concat(F.substring(F.coalesce(non_empty("summary", "description"), F.lit("")), 1, text_length), template(footer, F.col))
    quiet = F.struct(F.array().cast("array<string>").alias("parse"))
    return groups.withColumn("payload", F.to_json(F.struct(F.substring("title", 1, name_length).alias("thread_name"), body.alias("content"), quiet.alias("allowed_mentions"))))


def status_change(events: DataFrame, kind: str = "event_type") -> DataFrame:
    """Adds payload, the JSON that posts a change of status to a group's thread."""
    quiet = F.struct(F.array().cast("array<string>").alias("parse"))
    return events.withColumn("payload", F.to_json(F.struct(lookup(STATUS_TEXT, kind).alias("content"), quiet.alias("allowed_mentions"))))


def with_thread(events: DataFrame, opened: DataFrame) -> DataFrame:
    """Status changes with the channel that their group's opening got."""
    return events.join(opened.select("group_id", "channel_id"), "group_id")


def notification_times(changes: DataFrame, keys: list[str], wait: str = "30s", interval: str = "5m", repeat: str = "4h", until: str = "until") -> DataFrame:
    """When a group's notifications go out. changes: keys, ts, and until (the end of what is known): a group first waits for wait,
    then sends changes at most every interval, and repeats after repeat without one. Gives keys, sent_at, n_changes.

    The next time depends on the last, so a group's changes are folded in order, one group to a task at a time; changes of one time are
    counted before they are brought together, so that a group is as large as the times at which it changed."""
    w, i, r = (timedelta(seconds=seconds(x)) for x in (wait, interval, repeat))
    schema = ", ".join(f"`{k}` {dict(changes.dtypes)[k]}" for k in keys) + ", sent_at timestamp_ntz, n_changes long"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        times, counts, end = list(pdf.ts), pdf.n_.tolist(), pdf.until_.max()
        out, at, due = [], 0, times[0] + w
        while due <= end:
            n = 0
            while at < len(times) and times[at] <= due:
                n, at = n + counts[at], at + 1
            out.append((due, n))
            fresh = max(due + i, times[at]) if at < len(times) else None
            due = min(due + r, fresh) if fresh is not None else due + r
        made = pd.DataFrame(out, columns=["sent_at", "n_changes"])
        for k in keys:
            made[k] = pdf[k].iloc[0]
        return made[[*keys, "sent_at", "n_changes"]]

    counted = changes.groupBy(*keys, "ts").agg(F.count("*").alias("n_"), F.max(until).alias("until_"))
    return counted.groupBy(*keys).applyInPandas(fold, schema)


def debounce(alerts: DataFrame, severity: str = "severity", waits: dict[str, str] | None = None, ts: str = "fired_at") -> DataFrame:
    """Adds act_at: criticals at once, others after their wait."""
    waits = waits or {"critical": "0s", "warning": "5m"}
    wait = F.lit(float(seconds(waits["warning"])))
    for k, v in waits.items():
        wait = F.when(F.col(severity) == k, F.lit(float(seconds(v)))).otherwise(wait)
    return alerts.withColumn("act_at", F.col(ts) + F.make_dt_interval(secs=wait))


def query_state(vec: DataFrame) -> DataFrame:
    """A rule's state from its vector: no rows means ok, rows mean alerting."""
    return vec.agg(F.count("*").alias("n")).select(F.when(F.col("n") > 0, "alerting").otherwise("ok").alias("state"), "n")
