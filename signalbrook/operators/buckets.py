"""Leaky buckets: how full a bucket is after each event, and when it runs over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durations import seconds
from .pieces import SPAN, last_before, micros, numbered


def drip_ms(leak: str | float) -> int:
    """How long one event takes to leak out, in whole milliseconds: levels are times, so that they are exact."""
    return int(seconds(leak) * 1000)


def levels(events: DataFrame, keys: list[str], leak: str | float, capacity: int, ts: str = "ts", ties: list[str] | None = None, span: str | float = SPAN) -> DataFrame:
    """Each event pours one drop into its key's bucket, and one leaks out every `leak`. Adds level_ms (how long the bucket would take to run empty after
    the event) and overflow (the event raises it over capacity drops; it does so once until the level is down again).

    The level is max(level - time passed, 0) + a drop; unrolled over all events of a key it is what the n-th event has poured less the time, above the
    least that this was before: a running minimum, which is taken in pieces of span. Events without a time are left out; events of one
    time pour one after another, in the order of ties."""
    drip = drip_ms(leak)
    rows = numbered(events.where(F.col(ts).isNotNull()), keys, ts, ties, span, "nth_")
    ms = F.floor(micros(F.col(ts).cast("timestamp_ntz")) / 1000)
    rows = rows.withColumn("poured_", (F.col("nth_") * drip - ms).cast("long"))
    # the least so far, as the largest of what is left below zero
    told = last_before(rows, keys, -F.col("poured_"), "nth_", 65536, "deepest_")
    low = F.least(F.col("poured_"), F.coalesce(-F.col("deepest_"), F.col("poured_")))
    told = told.withColumn("level_ms", F.col("poured_") - low + drip)
    former = last_before(told, keys, F.struct("nth_", "level_ms"), "nth_", 65536, "former_")
    full = capacity * drip
    return former.select(*events.columns, "level_ms", ((F.col("level_ms") > full) & (F.coalesce(F.col("former_.level_ms"), F.lit(0)) <= full)).alias("overflow"))
