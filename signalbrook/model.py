"""The data model: samples, logs, and the helpers that read labels.

A sample has a metric name, labels (a map of strings), a time and a value; a *vector* is a DataFrame with labels,
series_key and value, and a *range* one that has ts as well. Label maps cannot be join keys, so series_key, a
canonical text of the map, stands for them. A label that is missing counts as the empty text.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = T.MapType(T.StringType(), T.StringType())

SAMPLES = T.StructType([
    T.StructField("metric", T.StringType()), T.StructField("labels", LABELS),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("value", T.DoubleType()),
])

LOGS = T.StructType([
    T.StructField("ts", T.TimestampNTZType()), *[T.StructField(c, T.StringType()) for c in ("host", "stack", "service", "container", "line")],
])

PROBES = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("grp", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("status", T.IntegerType()), T.StructField("body", T.StringType()), T.StructField("dns_rcode", T.StringType()),
    T.StructField("cert_expiry_s", T.LongType()), T.StructField("conditions", T.ArrayType(T.StringType())),
])


def label(name: str, labels: str | Column = "labels") -> Column:
    """A label's value, empty where it is missing."""
    return F.coalesce((F.col(labels) if isinstance(labels, str) else labels)[name], F.lit(""))


def series_key(labels: str | Column = "labels") -> Column:
    """The canonical text of a label map: its k=v pairs in order of the keys, without empty values. A backslash stands before
    each comma, equals sign and backslash of a key or value, so that different labels have different texts."""
    pairs = F.array_sort(F.map_entries(F.map_filter(labels, lambda _, v: F.coalesce(v, F.lit("")) != "")))
    return F.array_join(F.transform(pairs, lambda e: F.concat(_escaped(e["key"]), F.lit("="), _escaped(e["value"]))), ",")


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\,=])", r"\\$1")


def key_text(labels: dict[str, str]) -> str:
    """series_key of labels known beforehand."""
    escaped = lambda x: re.sub(r"([\\,=])", r"\\\1", x)
    return ",".join(f"{escaped(k)}={escaped(v)}" for k, v in sorted(labels.items()) if v)


def epoch_seconds(ts: str | Column) -> Column:
    """Whole seconds from 1970 to a time without zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def merge_labels(*maps: Column) -> Column:
    """Maps laid over one another: later ones win. (map_concat alone raises on a repeated key.)"""

    def over(low: Column, high: Column) -> Column:
        return F.map_concat(F.map_filter(low, lambda k, _: ~F.coalesce(F.map_contains_key(high, k), F.lit(False))), high)

    return reduce(over, maps)


def with_series_key(df: DataFrame) -> DataFrame:
    return df.withColumn("series_key", series_key("labels"))
