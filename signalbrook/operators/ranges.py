"""Functions of ranges: increase and rate of counters, averages, counts, absence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durations import seconds
from ..model import key_text
from .selectors import Matcher

ORDER = ("ts", "value")


def steps(keys: list[str]) -> Column:
    """By how much a counter rose since the sample before with the same keys; a fall is a reset, after which the whole value
    counts. Null for the first."""
    last = F.lag("value").over(Window.partitionBy(*keys).orderBy(*ORDER))
    return F.when(F.col("value") >= last, F.col("value") - last).when(last.isNotNull(), F.col("value"))


def increase(rv: DataFrame, by: list[str] | None = None) -> DataFrame:
    """How much each series of a range rose, resets allowed for; series with one sample give no row. by: further columns
    that tell ranges apart (a window, an evaluation time)."""
    keys = ["series_key", *(by or [])]
    rose = rv.withColumn("step_", steps(keys))
    total = rose.groupBy(*keys).agg(F.any_value("labels").alias("labels"), F.sum("step_").alias("value"), F.count("*").alias("n_"))
    return total.where("n_ >= 2").drop("n_")


def rate(rv: DataFrame, width: str | float, by: list[str] | None = None) -> DataFrame:
    """increase per second of the range's width."""
    return increase(rv, by).withColumn("value", F.col("value") / float(seconds(width)))


def over_time(rv: DataFrame, fn: str, by: list[str] | None = None) -> DataFrame:
    """avg, sum, min, max, count or last of each series' samples in a range."""
    value = {
        "avg": F.avg("value"), "sum": F.sum("value"), "min": F.min("value"), "max": F.max("value"),
        "count": F.count("value").cast("double"), "last": F.max(F.struct("ts", "value"))["value"],
    }[fn]
    return rv.groupBy("series_key", *(by or [])).agg(F.any_value("labels").alias("labels"), value.alias("value"))


def avg_over_time(rv: DataFrame, by: list[str] | None = None) -> DataFrame:
    return over_time(rv, "avg", by)


def last_not_null(rv: DataFrame, keys: list[str]) -> DataFrame:
    """The latest value that is not null for each of the keys."""
    latest = rv.where(F.col("value").isNotNull()).groupBy(*keys).agg(F.max(F.struct("ts", "value")).alias("s"))
    return latest.select(*keys, F.col("s.value").alias("value"))


def absent_over_time(rv: DataFrame, matchers: list[Matcher] | None = None) -> DataFrame:
    """One row of value 1 with the selector's equality matchers as its labels if the range has no sample at all, else none."""
    equal = [(k, v) for k, op, v in (matchers or []) if op == "=" and v != ""]
    labels = F.create_map(*[F.lit(x) for kv in equal for x in kv]) if equal else F.create_map().cast("map<string,string>")
    key = key_text(dict(equal))
    found = rv.limit(1).agg(F.count("*").alias("n_"))
    return found.where("n_ = 0").select(F.lit(key).alias("series_key"), labels.alias("labels"), F.lit(1.0).alias("value"))


def tumbling(samples: DataFrame, step: str) -> DataFrame:
    """Samples with the start of their aligned step, as window_start."""
    return samples.withColumn("window_start", F.window("ts", step)["start"].cast("timestamp_ntz"))


def sliding(samples: DataFrame, width: str, step: str) -> DataFrame:
    """Samples once for each evaluation time (a multiple of step) whose window (eval - width, eval] holds them, as eval_ts."""
    w, s = int(seconds(width)) * 1_000_000, int(seconds(step)) * 1_000_000
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    first = F.ceil(us / s) * s
    n = F.floor((us + w - 1 - first) / s)
    at = F.explode(F.when(n >= 0, F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: first + i * s)))
    return samples.withColumn("eval_us", at).withColumn("eval_ts", F.expr("timestampadd(MICROSECOND, eval_us, timestamp_ntz'1970-01-01 00:00:00')")).drop("eval_us")
