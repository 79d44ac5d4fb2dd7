"""Arithmetic, comparison, set operations and aggregation of vectors (series_key, labels, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import label, series_key

AGGREGATES = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "count": lambda c: F.count(c).cast("double")}
COMPARISONS = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
}


def _apply(a: Column, op: str, b: Column) -> Column:
    return {"/": lambda: F.try_divide(a, b), "*": lambda: a * b, "-": lambda: a - b, "+": lambda: a + b}[op]()


def binop(a: DataFrame, op: str, b: DataFrame | float, extra: list[str] | None = None) -> DataFrame:
    """a op b: with a number, or one to one with a vector on the full label set. Division by zero gives null."""
    if not isinstance(b, DataFrame):
        return a.withColumn("value", _apply(F.col("value"), op, F.lit(float(b))))
    keys = ["series_key", *(extra or [])]
    other = b.select(*keys, F.col("value").alias("other_"))
    return a.join(other, keys).withColumn("value", _apply(F.col("value"), op, F.col("other_"))).drop("other_")


def compare(vec: DataFrame, op: str, number: float) -> DataFrame:
    """The rows whose value compares true with a number, their values as they were."""
    return vec.where(COMPARISONS[op](F.col("value"), F.lit(float(number))))


def v_and(a: DataFrame, b: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Rows of a whose labels b has too."""
    keys = ["series_key", *(extra or [])]
    return a.join(b.select(*keys), keys, "left_semi")


def v_or(a: DataFrame, b: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """All rows of a, and those of b whose labels a does not have."""
    keys = ["series_key", *(extra or [])]
    return a.unionByName(b.join(a.select(*keys), keys, "left_anti").select(*a.columns))


def agg(vec: DataFrame, fn: str, by: list[str] | None = None, extra: list[str] | None = None) -> DataFrame:
    """sum, avg, max, min or count over a vector, by some labels; extra: columns kept apart (an evaluation time)."""
    by, extra = by or [], extra or []
    keyed = vec.withColumns({f"by_{i}_": label(b) for i, b in enumerate(by)})
    cols = [f"by_{i}_" for i in range(len(by))]
    out = keyed.groupBy(*cols, *extra).agg(AGGREGATES[fn]("value").alias("value"))
    if not by and not extra:
        out = out.where(F.col("value").isNotNull())
    pairs = [x for b, c in zip(by, cols, strict=True) for x in (F.lit(b), F.col(c))]
    labels = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return out.withColumn("labels", labels).withColumn("series_key", series_key("labels")).select("series_key", "labels", *extra, "value")


def topk(vec: DataFrame, k: int) -> DataFrame:
    """The k rows of the largest values; ties go by the labels' text."""
    return vec.orderBy(F.col("value").desc(), "series_key").limit(k)


def ranked(rows: DataFrame, within: list[str], ties: list[str], k: int | None = None) -> DataFrame:
    """Adds rank: a row's place by value, largest first, among those alike in within; only the first k, if k is given."""
    order = Window.partitionBy(*within).orderBy(F.col("value").desc(), *ties)
    out = rows.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


def or_zero(vec: DataFrame) -> DataFrame:
    """A vector of one number, 0 if it is empty."""
    return vec.agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("value"))


def threshold(vec: DataFrame, op: str, *params: float) -> DataFrame:
    """Adds met: whether the value is gt or lt a number, or within_range or outside_range of two."""
    v = F.col("value")
    met = {
        "gt": lambda: v > params[0], "lt": lambda: v < params[0],
        "within_range": lambda: (v > params[0]) & (v < params[1]), "outside_range": lambda: (v < params[0]) | (v > params[1]),
    }[op]()
    return vec.withColumn("met", met)


def color(value: str | Column, steps: list[tuple[float | None, str]]) -> Column:
    """The colour of the last step that a value reaches; a step of None is the base."""
    value = F.col(value) if isinstance(value, str) else value
    out = F.lit(None).cast("string")
    for start, name in steps:
        out = F.lit(name) if start is None else F.when(value >= start, F.lit(name)).otherwise(out)
    return out


def labels_to_columns(vec: DataFrame, names: list[str], rename: dict[str, str] | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Labels as columns beside value, some dropped and some renamed, as a table panel shows them."""
    rename = rename or {}
    out = vec.select(*[label(n).alias(rename.get(n, n)) for n in names if n not in drop], F.col("value").alias(rename.get("value", "value")))
    return out
