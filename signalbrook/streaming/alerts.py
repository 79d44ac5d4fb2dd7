"""Continuous queries: relabelled pipelines, windowed counts with late data, and the alert state machine."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.durations import seconds
from ..model import epoch_seconds
from ..operators.relabel import Rule, relabel


def pipeline(stream: DataFrame, rules: list[Rule], external: dict[str, str] | None = None) -> DataFrame:
    """A stream of rows with labels through relabel rules and the labels that all rows get."""
    rules = [*rules, *[Rule((), target=k, replacement=v) for k, v in (external or {}).items()]]
    return relabel(stream, rules)


def windowed(stream: DataFrame, width: str, keys: list[str], step: str | None = None, late: str = "6 hours") -> DataFrame:
    """Counts and sums by window and keys. Rows up to late behind the newest are still counted, as after an outage whose data is
    sent again; a window comes out once no such row can follow."""
    window = F.window("ts", width, step) if step else F.window("ts", width)
    sums = stream.withWatermark("ts", late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return sums.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def overflows(stream: DataFrame, keys: list[str], width: str, limit: int, late: str = "6 hours") -> DataFrame:
    """Keys with more than limit rows in a window."""
    return windowed(stream, width, keys, late=late).where(F.col("n") > limit)


def distinct_rows(stream: DataFrame, keys: list[str], late: str = "6 hours") -> DataFrame:
    """A stream without the rows that were sent twice."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def _by_key(stream: DataFrame, keys: list[str], columns: list[str], late: str, fold: Callable, out: str, state: str) -> DataFrame:
    """Rows by key through fold(rows, state, now), which yields tuples of out. rows: lists of the columns and the time in ms, in order of time,
    empty when the key's timer has run out; now: the watermark in ms, before which nothing more comes. A fold keeps its state in one
    small row and sets the next timer, so that keys which stop reporting come to an end."""
    kinds = dict(stream.dtypes)
    made = stream.withWatermark("ts", late).withColumn("ms_", F.unix_millis("ts"))
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + out
    names = [*keys, *[x.split()[0] for x in out.split(", ")]]

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.getCurrentWatermarkMs()
        rows = [] if held.hasTimedOut else sorted((int(m), *r) for pdf in batches for m, *r in zip(pdf.ms_, *(pdf[c] for c in columns), strict=True))
        found = list(fold(rows, held, now))
        yield pd.DataFrame([(*key, *r) for r in found], columns=names)

    return made.groupBy(*keys).applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.EventTimeTimeout)


def _timer(held: GroupState, at: int, now: int) -> None:
    held.setTimeoutTimestamp(max(at, now + 1))


def _ms(text: str) -> int:
    return int(seconds(text) * 1000)


def state_changes(evals: DataFrame, key: str, hold: str, stale: str = "1h", late: str = "0 seconds") -> DataFrame:
    """evals: a stream of key, ts (timestamp) and cond. Gives a row for each change: key, ts, state (pending, firing, resolved or
    inactive) and version, which counts a key's firings, so that one after a resolve is told from the one before.

    Rows of a key must come in order of time from batch to batch; within a batch they are sorted. A key that has not reported for stale ends:
    what it had pending or firing goes out as inactive or resolved, and its state is dropped, the version with it."""
    wait, rest = _ms(hold), _ms(stale)

    def fold(rows: list, held: GroupState, now: int):
        active, fired, version, last = held.get if held.exists else (None, None, 0, None)
        for t, cond in rows:
            if last is not None and t <= last:
                continue  # seen, or too late to change what was said
            last = t
            if bool(cond):
                if active is None:
                    active = t
                    if wait:
                        yield t, "pending", version
                if fired is None and t - active >= wait:
                    fired, version = t, version + 1
                    yield t, "firing", version
            elif active is not None:
                yield t, "inactive" if fired is None else "resolved", version
                active = fired = None
        if not rows and last is not None:
            if active is not None:
                yield last + rest, "inactive" if fired is None else "resolved", version
            held.remove()
        elif last is not None:
            held.update((active, fired, version, last))
            _timer(held, last + rest, now)

    made = evals.withColumn("cond", F.coalesce("cond", F.lit(False)))
    found = _by_key(made, [key], ["cond"], late, fold, "ms long, state string, version long", "active long, fired long, version long, last long")
    return found.select(key, F.timestamp_millis("ms").alias("ts"), "state", "version")


def notifications(changes: DataFrame, keys: list[str], wait: str = "30s", interval: str = "5m", repeat: str = "4h", forget: str = "1d", late: str = "0 seconds") -> DataFrame:
    """changes: a stream of keys and ts. When a group's notifications go out (keys, sent_at, n_changes), by timers, as
    operators.alerts.notification_times has it for tables: first after wait, then changes at most every interval, and again after repeat without
    one. A group without a change for forget ends. A change that comes later than its notification counts for the next."""
    w, i, r, end = map(_ms, (wait, interval, repeat, forget))

    def fold(rows: list, held: GroupState, now: int):
        due, waiting, last = held.get if held.exists else (None, [], None)
        waiting = sorted([*(waiting or []), *(t for t, in rows)])
        last = max([x for x in (last, *waiting) if x is not None], default=None)
        if due is None:
            due = waiting[0] + w
        while due <= now and due <= last + end:
            n = sum(t <= due for t in waiting)
            yield due, n
            waiting = waiting[n:]
            due = min(due + r, max(due + i, waiting[0])) if waiting else due + r
        if due > last + end and not waiting:
            held.remove()
        else:
            held.update((due, waiting, last))
            _timer(held, due, now)

    found = _by_key(changes, keys, [], late, fold, "ms long, n_changes long", "due long, waiting array<long>, last long")
    return found.select(*keys, F.timestamp_millis("ms").alias("sent_at"), "n_changes")


def debounced(alerts: DataFrame, key: str, waits: dict[str, str] | None = None, default: str = "warning", late: str = "0 seconds") -> DataFrame:
    """alerts: a stream of key, ts, severity and firing. Gives key, severity, fired_at and act_at of the alerts that are still firing when their
    severity's wait is over; those resolved before are never heard of. A key has one alert at a time."""
    spans = {k: _ms(v) for k, v in (waits or {"critical": "0s", "warning": "5m"}).items()}

    def fold(rows: list, held: GroupState, now: int):
        severity, fired, due, done = held.get if held.exists else (None, None, None, False)
        for t, kind, firing in rows:
            if fired is not None and not done and due <= t and (due < t or firing):
                yield severity, fired, due
                done = True
            if not bool(firing):
                severity = fired = due = None
                done = False
            elif fired is None:
                severity, fired = kind, t
                due = t + spans.get(kind, spans[default])
        if fired is not None and not done and due <= now:
            yield severity, fired, due
            done = True
        if fired is None:
            if held.exists:
                held.remove()
        else:
            held.update((severity, fired, due, done))
            if not done:
                _timer(held, due, now)

    found = _by_key(alerts, [key], ["severity", "firing"], late, fold, "severity string, fired long, due long", "severity string, fired long, due long, done boolean")
    return found.select(key, "severity", F.timestamp_millis("fired").alias("fired_at"), F.timestamp_millis("due").alias("act_at"))


def gone_silent(heartbeats: DataFrame, key: str, width: str, late: str = "0 seconds") -> DataFrame:
    """heartbeats: a stream of key and ts. Gives key, last_seen and silent_at once a key has had none for width; its state then ends, and begins
    anew with its next heartbeat."""
    span = _ms(width)

    def fold(rows: list, held: GroupState, now: int):
        last = held.get[0] if held.exists else None
        for (t,) in rows:
            if last is not None and t - last > span:
                yield last, last + span
            last = t if last is None else max(last, t)
        if last is not None and last + span <= now:
            yield last, last + span
            if held.exists:
                held.remove()
        elif last is not None:
            held.update((last,))
            _timer(held, last + span, now)

    found = _by_key(heartbeats, [key], [], late, fold, "last long, at long", "last long")
    return found.select(key, F.timestamp_millis("last").alias("last_seen"), F.timestamp_millis("at").alias("silent_at"))


def leaking(events: DataFrame, keys: list[str], leak: str, capacity: int, late: str = "0 seconds") -> DataFrame:
    """events: a stream of keys and ts. Gives keys, ts and level_ms of the events at which a key's bucket runs over: operators.buckets.levels for streams.

    Events wait until the watermark has passed them, and are poured in order of time, so that one which comes up to late behind the newest counts as it
    does in a table; what comes later still is dropped. A key's state is its level, the times of events that wait, and a timer for the next of
    them, or for when the bucket will have run empty, when it ends."""
    drip = int(seconds(leak) * 1000)
    full = capacity * drip

    def fold(rows: list, held: GroupState, now: int):
        level, last, waiting = held.get if held.exists else (0, 0, [])
        waiting = sorted([*(waiting or []), *(t for (t,) in rows)])
        for t in [t for t in waiting if t <= now]:
            had, level, last = level, max(level - (t - last), 0) + drip, t
            if had <= full < level:
                yield t, level
        waiting = [t for t in waiting if t > now]
        if not waiting and last + level <= now:
            if held.exists:
                held.remove()
        else:
            held.update((level, last, waiting))
            _timer(held, waiting[0] if waiting else last + level, now)

    found = _by_key(events, keys, [], late, fold, "ms long, level_ms long", "level long, last long, waiting array<long>")
    return found.select(*keys, F.timestamp_millis("ms").alias("ts"), "level_ms")


def with_threads(events: DataFrame, opened: DataFrame, key: str = "group_id", channel: str = "channel_id", wait: str = "1h", forget: str = "7d", late: str = "0 seconds") -> DataFrame:
    """Two streams, joined: events (key, ts, and more) with the channel that their group's opening (key, ts, channel) got. An event that comes before
    its group's opening is held back until that comes; after wait it goes out without a channel. A group's channel is forgotten when nothing has
    been heard of it for so long, and events of a group that is opened anew get the newer channel. Events go out in order of time within a batch."""
    span, rest = _ms(wait), _ms(forget)
    body = F.to_json(F.struct(*[c for c in events.columns if c != key]))
    told = events.select(key, "ts", body.alias("body_"), F.lit(None).cast("string").alias("channel_"))
    both = told.unionByName(opened.select(key, "ts", F.lit(None).cast("string").alias("body_"), F.col(channel).cast("string").alias("channel_")))

    def fold(rows: list, held: GroupState, now: int):
        known, times, bodies, last = held.get if held.exists else (None, [], [], 0)
        waiting = list(zip(times or [], bodies or []))
        for t, event, place in rows:
            if t > last + rest:
                known = None
            last = max(last, t)
            if place is not None:
                known = place
            else:
                waiting.append((t, event))
        if known is not None:
            yield from ((event, known) for _, event in sorted(waiting))
            waiting = []
        yield from ((event, None) for t, event in sorted(waiting) if t + span <= now)
        waiting = sorted((t, event) for t, event in waiting if t + span > now)
        end = waiting[0][0] + span if waiting else last + rest
        if not waiting and (known is None or end <= now):
            if held.exists:
                held.remove()
        else:
            held.update((known, [t for t, _ in waiting], [x for _, x in waiting], last))
            _timer(held, end, now)

    found = _by_key(both, [key], ["body_", "channel_"], late, fold, "body string, channel string", "known string, times array<long>, bodies array<string>, last long")
    kinds = ", ".join(f"`{c}` {t}" for c, t in events.dtypes if c != key)
    return found.select(key, F.from_json("body", kinds).alias("e"), F.col("channel").alias(channel)).select(key, "e.*", channel)


def ticks_of(rows: DataFrame, ts: str, step: str) -> list[datetime]:
    """The times at which a table is looked at: from the hour of its first row on, a step apart, until all is covered. They are known on the
    driver: as many as the steps between two times, whatever the rows."""
    first, last = rows.agg(F.date_trunc("hour", F.min(ts)).cast("timestamp_ntz"), F.date_trunc("hour", F.max(ts)).cast("timestamp_ntz")).first()
    width, out = timedelta(seconds=seconds(step)), []
    while first is not None and first + len(out) * width <= last + width:
        out.append(first + len(out) * width)
    return out


def silent(heartbeats: DataFrame, expected: DataFrame, key: str, ticks: list[datetime], width: str) -> DataFrame:
    """Expected keys with no heartbeat in (tick - width, tick], for each tick: a dead sender leaves no row to see. A key has a bit for each tick, 64 to a row,
    set by the heartbeats near it; only the ticks whose bit is not set are unfolded, after keys and bits have met."""
    bin_s = int(seconds(width))
    array_of = lambda part: F.array(*[F.lit(str(t)).cast("timestamp_ntz") for t in part])
    if not ticks:
        return expected.select(key, F.lit(None).cast("timestamp_ntz").alias("tick")).limit(0)
    words = [array_of(ticks[i : i + 64]) for i in range(0, len(ticks), 64)]
    w = F.make_dt_interval(secs=F.lit(float(bin_s)))
    bin_of = lambda c: F.floor(epoch_seconds(c) / bin_s)
    near = heartbeats.sparkSession.range(1).select(F.posexplode(array_of(ticks)).alias("n_", "tick_"))
    near = near.select(
        "tick_", F.floor(F.col("n_") / 64).cast("int").alias("word_"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n_") % 64).alias("bit_"),
        F.explode(F.array(*[bin_of("tick_") + i for i in (-1, 0)])).alias("bin_"),
    )
    beat = heartbeats.select(F.col(key), F.col("ts").alias("beat_"), bin_of("ts").alias("bin_"))
    inside = (F.col("beat_") <= F.col("tick_")) & (F.col("beat_") > F.col("tick_") - w)
    seen = beat.join(F.broadcast(near), "bin_").where(inside).groupBy(key, "word_").agg(F.bit_or("bit_").alias("bits_"))
    grid = expected.select(key).distinct().withColumn("word_", F.explode(F.array(*[F.lit(i) for i in range(len(words))])))
    bits = F.coalesce("bits_", F.lit(0).cast("long"))
    unseen = F.filter(F.get(F.array(*words), F.col("word_")), lambda _, i: F.call_function("getbit", bits, i) == 0)
    return grid.join(seen, [key, "word_"], "left").select(key, F.explode(unseen).alias("tick"))
