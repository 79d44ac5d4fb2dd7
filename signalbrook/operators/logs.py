"""Log pipelines: line filters, parsers, label filters and formatters over logs(ts, host, stack, service, container, line)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import laid_groups, logfmt, logfmt_pairs, split_groups, template
from ..model import label, merge_labels, series_key
from .selectors import at_time, before, matches

STREAM = ("host", "stack", "service", "container")


def stream(logs: DataFrame, **equal: str) -> DataFrame:
    """The lines of a stream selector, their labels as a map beside the stream's own columns."""
    for k, v in equal.items():
        logs = logs.where(F.col(k) == v)
    return logs.withColumn("labels", F.create_map().cast("map<string,string>"))


def line_contains(logs: DataFrame, text: str) -> DataFrame:
    return logs.where(F.col("line").contains(text))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once for a row, however often they are read: the optimizer does not copy what
    stands behind a generator into those who read it."""
    for name, c in columns.items():
        rest = [x for x in df.columns if x != name]
        df = df.select(*rest, F.explode(F.array(c)).alias(name))
    return df


def parse_logfmt(logs: DataFrame) -> DataFrame:
    """Adds a line's key=value pairs to its labels."""
    made = once(logs, pairs_=logfmt_pairs("line"))
    found = F.coalesce(logfmt("pairs_"), F.create_map().cast("map<string,string>"))
    return once(made, labels=merge_labels(F.col("labels"), found)).select(*logs.columns)


def parse_json(logs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Adds fields of a JSON line to its labels: name to path. Lines that are no JSON get none."""
    pairs = [x for n, p in fields.items() for x in (F.lit(n), F.coalesce(F.get_json_object("line", p), F.lit("")))]
    return logs.withColumn("labels", merge_labels(F.col("labels"), F.create_map(*pairs)))


def _value(name: str) -> Column:
    return F.col(name) if name in STREAM else label(name)


def label_filter(logs: DataFrame, name: str, op: str, value: str) -> DataFrame:
    return logs.where(matches(_value(name), op, value))


def line_format(logs: DataFrame, text: str) -> DataFrame:
    """Replaces the line by a template over its labels."""
    return logs.withColumn("line", template(text, _value))


def parse_regexp(logs: DataFrame, pattern: str) -> DataFrame:
    """Adds the named groups of a pattern to the labels; empty where it does not match. The line stays."""
    made = once(logs, laid_=laid_groups("line", pattern))
    groups, names = split_groups("laid_", "line", pattern)
    made = once(made, groups_=groups)
    found = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.col("groups_"))
    return once(made, labels=merge_labels(F.col("labels"), found)).select(*logs.columns)


def in_window(logs: DataFrame, at: datetime | str, width: str | float) -> DataFrame:
    return logs.where((F.col("ts") > before(at, width)) & (F.col("ts") <= at_time(at)))


def count_over_time(logs: DataFrame, by: list[str], extra: list[str] | None = None) -> DataFrame:
    """Lines counted by some labels, as a vector. Cut the window first with in_window."""
    cols = {f"by_{i}_": _value(b) for i, b in enumerate(by)}
    counted = logs.withColumns(cols).groupBy(*cols, *(extra or [])).agg(F.count("*").cast("double").alias("value"))
    pairs = [x for b, c in zip(by, cols, strict=True) for x in (F.lit(b), F.col(c))]
    labels = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return counted.withColumn("labels", labels).withColumn("series_key", series_key("labels")).select("series_key", "labels", *(extra or []), "value")


def tail(logs: DataFrame, n: int, cap: int = 2000, since: datetime | str | None = None, tie: tuple[str, ...] = ("line",)) -> DataFrame:
    """The last n lines (never over cap), newest first, from a time on if one is given."""
    if since is not None:
        logs = logs.where(F.col("ts") >= at_time(since))
    return logs.orderBy(F.col("ts").desc(), *tie).limit(min(n, cap))
