"""Series selectors: label matchers, the latest sample at a time, the samples of a window."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durations import seconds
from ..model import label, series_key

Matcher = tuple[str, str, str]
#: How far back an instant selector looks for a series' latest sample.
LOOKBACK = 300


def at_time(t: datetime | str) -> Column:
    return F.lit(str(t)).cast("timestamp_ntz")


def before(t: datetime | str | Column, width: str | float) -> Column:
    t = t if isinstance(t, Column) else at_time(t)
    return t - F.make_dt_interval(secs=F.lit(float(seconds(width))))


def matches(value: Column, op: str, want: str) -> Column:
    """One matcher: = and != compare, =~ and !~ match the whole value."""
    if op == "=":
        return value == want
    if op == "!=":
        return value != want
    whole = value.rlike(rf"\A(?:{want})\z")
    return whole if op == "=~" else ~whole


def where_labels(df: DataFrame, matchers: list[Matcher], columns: bool = False) -> DataFrame:
    """Rows whose labels satisfy all matchers (label, op, value). With columns, labels that are columns of df are read from
    there, so that the comparison reaches the scan."""
    for name, op, want in matchers:
        value = F.coalesce(F.col(name), F.lit("")) if columns and name in df.columns else label(name)
        df = df.where(matches(value, op, want))
    return df


def keep_metrics(df: DataFrame, regex: str) -> DataFrame:
    """Samples whose metric name matches the whole regex."""
    return df.where(matches(F.col("metric"), "=~", regex))


def drop_families(df: DataFrame, *prefixes: str) -> DataFrame:
    """Samples of no family of metrics that is turned off: a family is a prefix of names up to an underscore or the end. A null name stays."""
    off = F.lit(False)
    for p in prefixes:
        off = off | (F.col("metric") == p) | F.col("metric").startswith(p.rstrip("_") + "_")
    return df.where(~F.coalesce(off, F.lit(False)))


def keep_labels(df: DataFrame, names: list[str], metrics: str = ".*") -> DataFrame:
    """Samples whose metric name matches the whole regex keep only the labels named; the others keep theirs. Series that differ in dropped labels
    alone are one afterwards, with the samples of all of them."""
    kept = F.map_filter("labels", lambda k, _: k.isin(*names) if names else F.lit(False))
    return df.withColumn("labels", F.when(matches(F.col("metric"), "=~", metrics), kept).otherwise(F.col("labels")))


def range_series(samples: DataFrame, metric: str, matchers: list[Matcher], at: datetime | str, width: str | float) -> DataFrame:
    """The samples of a metric in (at - width, at]: series_key, labels, ts, value."""
    rows = where_labels(samples.where(F.col("metric") == metric), matchers)
    rows = rows.where((F.col("ts") > before(at, width)) & (F.col("ts") <= at_time(at)))
    return rows.select(series_key("labels").alias("series_key"), "labels", "ts", "value")


def select_series(samples: DataFrame, metric: str, matchers: list[Matcher], at: datetime | str, lookback: str | float = LOOKBACK) -> DataFrame:
    """Each series' latest sample in (at - lookback, at] (of equal times the larger value): series_key, labels, value."""
    rows = range_series(samples, metric, matchers, at, lookback)
    latest = rows.groupBy("series_key").agg(F.max(F.struct("ts", "value")).alias("s"), F.any_value("labels").alias("labels"))
    return latest.select("series_key", "labels", F.col("s.value").alias("value"))
