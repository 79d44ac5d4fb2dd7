"""Selectors and ranges at every time of a grid: start, start + step, and so on to end.

A sample reaches the times at which it is the latest, or in the window; neither samples nor windows are joined with the times. Rows are shuffled by
series and by a span of time much longer than a window, so that a long series is many tasks' work; a sample stands in the next span too if
a window there reaches back to it."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durations import seconds
from ..model import key_text, series_key
from .pieces import at_micros, micros
from .selectors import LOOKBACK, Matcher, where_labels

#: A span is at least so many times as long as what a window reaches back, so that at most one sample in so many stands twice.
WIDE = 16
SECOND = 1_000_000


@dataclass(frozen=True)
class Grid:
    """Evaluation times, the end included where the steps meet it."""

    start: str
    end: str
    step: str | float

    def micros(self) -> tuple[int, int, int]:
        start, end = ((datetime.fromisoformat(str(t)) - datetime(1970, 1, 1)) // timedelta(microseconds=1) for t in (self.start, self.end))
        return start, end, round(seconds(self.step) * SECOND)

    def times(self, spark) -> DataFrame:
        """The times as rows of eval_ts."""
        start, end, step = self.micros()
        return spark.range(start, end + 1, step).select(at_micros(F.col("id")).alias("eval_ts"))


def _rows(samples: DataFrame, metric: str, matchers: list[Matcher], grid: Grid, reach: int) -> DataFrame:
    """Samples of (start - reach, end]: series_key, labels, us (microseconds after the grid's start), value."""
    start, end, _ = grid.micros()
    rows = where_labels(samples.where(F.col("metric") == metric), matchers)
    rows = rows.where((F.col("ts") > at_micros(F.lit(start - reach))) & (F.col("ts") <= at_micros(F.lit(end))))
    return rows.select(series_key("labels").alias("series_key"), "labels", (micros("ts") - start).alias("us"), "value")


def _spread(rows: DataFrame, grid: Grid, reach: int) -> tuple[DataFrame, int]:
    """Rows with the span whose times they can reach, twice where a window of the next span reaches back to them; and the span's length."""
    step = grid.micros()[2]
    span = step * -(-WIDE * max(reach, step) // step)
    own = F.floor(F.col("us") / span)
    pieces = F.when(F.col("us") > (own + 1) * span - reach, F.array(own, own + 1)).otherwise(F.array(own))
    return rows.withColumn("piece", F.explode(pieces)).where("piece >= 0"), span


def _ticks(first: Column, past: Column, grid: Grid, span: int) -> Column:
    """The numbers of the times from first to before past (microseconds) that are a row's span's and the grid's; null if none."""
    start, end, step = grid.micros()
    low = F.ceil(F.greatest(first, F.col("piece") * span) / step)
    high = F.ceil(F.least(past, (F.col("piece") + 1) * span, F.lit(end - start + 1)) / step) - 1
    return F.when(high >= low, F.sequence(low, high))


def _dated(df: DataFrame, grid: Grid) -> DataFrame:
    start, _, step = grid.micros()
    return df.select("series_key", "labels", at_micros(F.col("tick") * step + start).alias("eval_ts"), "value")


def instant(samples: DataFrame, metric: str, matchers: list[Matcher], grid: Grid, lookback: str | float = LOOKBACK) -> DataFrame:
    """Each series' latest sample in (t - lookback, t] at each time t (of equal times the larger value): series_key, labels, eval_ts, value. A sample is
    the latest from its own time until the next one's, or until lookback has passed."""
    reach = round(seconds(lookback) * SECOND)
    rows, span = _spread(_rows(samples, metric, matchers, grid, reach), grid, reach)
    following = F.lead("us").over(Window.partitionBy("series_key", "piece").orderBy("us", "value"))
    until = F.least(F.col("us") + reach, F.coalesce(following, F.col("us") + reach))
    return _dated(rows.withColumn("until", until).withColumn("tick", F.explode(_ticks(F.col("us"), F.col("until"), grid, span))), grid)


def increase(samples: DataFrame, metric: str, matchers: list[Matcher], grid: Grid, width: str | float) -> DataFrame:
    """How much each series rose in (t - width, t] at each time t, resets allowed for; windows with one sample give no row.

    Each sample gets the total of all rises up to it in its span, after each fall counted anew. A window's rise is the total at its last sample
    less that at its first: a sample is a window's last from its own time until the next one's, and its first from when the one before drops out
    until it does itself."""
    reach = round(seconds(width) * SECOND)
    rows, span = _spread(_rows(samples, metric, matchers, grid, reach), grid, reach)
    order = Window.partitionBy("series_key", "piece").orderBy("us", "value")
    last = F.lag("value").over(order)
    rise = F.when(F.col("value") >= last, F.col("value") - last).when(last.isNotNull(), F.col("value"))
    rows = rows.withColumns({"rise": rise, "n": F.row_number().over(order), "prev": F.lag("us").over(order), "next": F.lead("us").over(order)})
    rows = rows.withColumn("total", F.coalesce(F.sum("rise").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    out_of = F.col("us") + reach
    as_last = _ticks(F.col("us"), F.least(out_of, F.coalesce("next", out_of)), grid, span)
    as_first = _ticks(F.greatest(F.col("us"), F.coalesce(F.col("prev") + reach, F.col("us"))), out_of, grid, span)
    none = F.array().cast("array<bigint>")
    mark = lambda ticks, ends: F.transform(F.coalesce(ticks, none), lambda i: F.struct(i.alias("tick"), F.lit(ends).alias("ends")))
    marked = F.concat(mark(as_last, True), mark(as_first, False))
    marks = rows.select("series_key", "piece", "labels", "n", "total", F.explode(marked).alias("m"))
    at = lambda c, ends: F.max(F.when(F.col("m.ends") == ends, F.col(c)))
    met = marks.groupBy("series_key", "piece", F.col("m.tick").alias("tick")).agg(
        F.any_value("labels").alias("labels"), (at("total", True) - at("total", False)).alias("value"), (at("n", True) > at("n", False)).alias("several")
    )
    return _dated(met.where("several"), grid)


def rate(samples: DataFrame, metric: str, matchers: list[Matcher], grid: Grid, width: str | float) -> DataFrame:
    """increase per second of the width."""
    return increase(samples, metric, matchers, grid, width).withColumn("value", F.col("value") / float(seconds(width)))


def over_time(samples: DataFrame, metric: str, matchers: list[Matcher], grid: Grid, width: str | float, fn: str = "avg") -> DataFrame:
    """avg, sum, min, max, count or last of each series' samples in (t - width, t] at each time t.

    Samples are first summed up by panes, the longest stretches of which both width and step are multiples; a series then has as many rows as it has
    panes, and a window is the panes of a frame. A pane without samples has no row; a time without a pane of its own is put between."""
    start, end, step = grid.micros()
    reach = round(seconds(width) * SECOND)
    pane = gcd(reach, step)
    wide, apart, times = reach // pane, step // pane, (end - start) // step
    # a pane is (k * pane, (k + 1) * pane]; its place is its end's
    place = F.ceil(F.col("us") / pane)
    panes = _rows(samples, metric, matchers, grid, reach).groupBy("series_key", place.alias("place")).agg(
        F.any_value("labels").alias("labels"), F.sum("value").alias("sum"), F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.max(F.struct("us", "value")).alias("last"),
    )
    order = Window.partitionBy("series_key").orderBy("place")
    first = F.greatest(F.ceil(F.col("place") / apart), F.lit(0))
    until = F.least(F.floor((F.col("place") + wide - 1) / apart), F.lit(times))
    following = F.lead(first).over(order)
    until = F.least(until, F.coalesce(following - 1, until))
    own = F.struct(F.col("place"), F.lit(False).alias("is_time"), "sum", "n", "min", "max", "last")
    empty = F.struct(*[F.lit(None).cast(panes.schema[c].dataType).alias(c) for c in ("sum", "n", "min", "max", "last")])
    ticks = F.transform(F.when(until >= first, F.sequence(first, until)), lambda i: F.struct((i * apart).alias("place"), F.lit(True).alias("is_time"), *[empty[c].alias(c) for c in ("sum", "n", "min", "max", "last")]))
    each = panes.withColumn("e", F.concat(F.array(own), F.coalesce(ticks, F.array().cast(f"array<{panes.select(own.alias('x')).schema['x'].dataType.simpleString()}>"))))
    rows = each.select("series_key", "labels", F.explode("e").alias("e")).select("series_key", "labels", "e.*")
    frame = Window.partitionBy("series_key").orderBy("place").rangeBetween(-(wide - 1), 0)
    value = {
        "avg": lambda: F.sum("sum").over(frame) / F.sum("n").over(frame), "sum": lambda: F.sum("sum").over(frame), "min": lambda: F.min("min").over(frame),
        "max": lambda: F.max("max").over(frame), "count": lambda: F.sum("n").over(frame).cast("double"), "last": lambda: F.max("last").over(frame)["value"],
    }[fn]()
    found = rows.withColumn("value", value).where("is_time").withColumn("tick", F.floor(F.col("place") / apart))
    return _dated(found, grid)


def absent(samples: DataFrame, metric: str, matchers: list[Matcher], grid: Grid, width: str | float) -> DataFrame:
    """A row of value 1 at each time t without a sample in (t - width, t], labelled with the selector's equality matchers. Only the steps in which any
    sample falls are told apart, as many as the grid has and width / step more."""
    start, end, step = grid.micros()
    reach = round(seconds(width) * SECOND)
    pane = gcd(reach, step)
    full = _rows(samples, metric, matchers, grid, reach).select(F.ceil(F.col("us") / pane).alias("place")).distinct()
    first, until = F.greatest(F.ceil(F.col("place") * pane / step), F.lit(0)), F.least(F.floor(((F.col("place") - 1) * pane + reach) / step), F.lit((end - start) // step))
    seen = full.select(F.explode(F.when(until >= first, F.sequence(first, until))).alias("tick")).distinct()
    equal = [(k, v) for k, op, v in matchers if op == "=" and v != ""]
    labels = F.create_map(*[F.lit(x) for kv in equal for x in kv]) if equal else F.create_map().cast("map<string,string>")
    every = samples.sparkSession.range(0, (end - start) // step + 1).select(F.col("id").alias("tick"))
    gone = every.join(seen, "tick", "left_anti").select(F.lit(key_text(dict(equal))).alias("series_key"), labels.alias("labels"), "tick", F.lit(1.0).alias("value"))
    return _dated(gone, grid)
