"""Predicates and projections of records: arrays of structs, texts, nested fields, frames."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import placed


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def starts_match(text: str | Column, regex: str) -> Column:
    """Whether a regex matches from the first character on (it need not reach the end). Null is no match."""
    return F.coalesce(_col(text).rlike(rf"\A(?:{regex})"), F.lit(False))


def searches(text: str | Column, regex: str) -> Column:
    """Whether a regex matches anywhere. Null is no match."""
    return F.coalesce(_col(text).rlike(regex), F.lit(False))


def given(value: str | Column, kind: str = "string") -> Column:
    """Whether a value is there and not empty: a text with characters, an array or map with entries, or (kind any) not null."""
    c = _col(value)
    size = {"string": F.length, "array": F.size, "map": F.size}.get(kind)
    return c.isNotNull() & (F.coalesce(size(c), F.lit(0)) > 0) if size else c.isNotNull()


def among(value: str | Column, values: list | Column) -> Column:
    """Whether a value is one of a list, or of an array column. Null is not."""
    found = F.array_contains(values, _col(value)) if isinstance(values, Column) else _col(value).isin(values)
    return F.coalesce(found, F.lit(False))


def excluding(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column is none of the values; a null stays."""
    return df.where(~among(column, values))


TESTS = {
    "eq": lambda c, v: F.coalesce(c == v, F.lit(False)), "ne": lambda c, v: ~F.coalesce(c == v, F.lit(False)), "in": among,
    "defined": lambda c, _: c.isNotNull(), "match": starts_match, "search": searches,
}


def select_by(items: str | Column, field: str | None, test: str, value=None) -> Column:
    """The elements of an array of which a field (or the element itself) passes a test: eq, ne, in, defined, match or search."""
    return F.filter(_col(items), lambda x: TESTS[test](x[field] if field else x, value))


def reject_by(items: str | Column, field: str | None, test: str, value=None) -> Column:
    """The elements that select_by leaves out."""
    return F.filter(_col(items), lambda x: ~TESTS[test](x[field] if field else x, value))


def attribute(items: str | Column, field: str) -> Column:
    """One field of each element."""
    return F.transform(_col(items), lambda x: x[field])


def glob_regex(pattern: str) -> str:
    """A shell pattern (*, ?, [..], [!..]) as a regex for whole values."""
    out, i = "", 0
    while i < len(pattern):
        c, close = pattern[i], pattern.find("]", i + 2)
        if c == "[" and close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out += "[^" + body[1:] + "]" if body[0] == "!" else f"[{body}]"
            i = close
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.sub(r"(\W)", r"\\\1", c)
        i += 1
    return rf"(?s)\A{out}\z"


def picked(df: DataFrame, name: str, without: list[str], column: str, values: list) -> DataFrame:
    """Rows whose name fits none of some shell patterns and whose column is one of the values."""
    fits = reduce(lambda a, b: a | b, [searches(name, glob_regex(p)) for p in without], F.lit(False))
    return df.where(~fits & among(column, values))


def call_allowed(words: str | Column, allowed: dict[str, list[str]], optional: int = 0) -> Column:
    """Whether an array of a command and its arguments is allowed: a known command, as many arguments as it has patterns (the last optional
    ones may lack), and each argument matching its pattern as a whole."""
    words = _col(words)
    out = F.lit(False)
    for name, patterns in allowed.items():
        n = F.size(words) - 1
        ok = (F.get(words, F.lit(0)) == name) & (n <= len(patterns)) & (n >= len(patterns) - optional)
        for i, p in enumerate(patterns, 1):
            ok = ok & F.coalesce(F.get(words, F.lit(i)).rlike(rf"\A(?:{p})\z"), n < i)
        out = out | F.coalesce(ok, F.lit(False))
    return out


def json_number(text: str | Column, path: str, least: float) -> Column:
    """Whether a JSON text has a number of at least so much at a path; a text that is no JSON, or has none there, fails."""
    return F.coalesce(F.get_json_object(_col(text), path).try_cast("double") >= least, F.lit(False))


def without_fields(value: str | Column, *paths: str) -> Column:
    """A struct without some of its (nested) fields."""
    return _col(value).dropFields(*paths)


def merged(defaults: Column, own: Column, fields: dict[str, dict | None]) -> Column:
    """A struct over a struct of defaults: a field that is null takes the default's; fields: their names, each with its own fields where it is
    a struct that is merged in turn."""

    def one(name: str, inner: dict | None) -> Column:
        low, high = defaults[name], own[name]
        return (merged(low, high, inner) if inner else F.coalesce(high, low)).alias(name)

    return F.struct(*[one(n, inner) for n, inner in fields.items()])


def merge_frames(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """Frames laid side by side on the columns they share; each row of one stands once, with nulls where another has none."""
    return reduce(lambda a, b: a.join(b, on, "full_outer"), frames)


def start_order(rows: DataFrame, key: str, order: str, default: int = 0) -> DataFrame:
    """Adds starts: a row's place when all start by an integer, ties by key; one without an integer counts as default. See pieces.placed."""
    return placed(rows, [F.coalesce(order, F.lit(default)), F.col(key)], "starts")


def bound_to(samples: DataFrame, targets: DataFrame, on: str, address: str = "__address__") -> DataFrame:
    """Samples of discovered targets under the targets' labels: joined on the address they were read from; a sample of no known target is
    left out, and labels of the sample stay unless the target sets them."""
    from ..model import label, merge_labels

    side = targets.select(label(address).alias("address_"), F.map_filter("labels", lambda k, _: ~k.startswith("__")).alias("target_labels_"))
    joined = samples.join(side, F.col(on) == F.col("address_"))
    return joined.withColumn("labels", merge_labels(F.col("labels"), F.col("target_labels_"))).select(*samples.columns)


def query_string(**fields: str | Column) -> Column:
    """Fields as a URL's query, percent-encoded, in the order given; null ones are left out."""
    parts = [F.concat(F.lit(k + "="), F.replace(F.url_encode(_col(c).cast("string")), F.lit("+"), F.lit("%20"))) for k, c in fields.items()]
    return F.concat_ws("&", *parts)


def exposition(samples: DataFrame) -> DataFrame:
    """Samples as the lines of a metrics page, one column named value: name{label="text",...} number, labels in order."""
    quoted = lambda v: F.regexp_replace(F.regexp_replace(v, r"([\\\"])", r"\\$1"), "\n", r"\\n")
    pairs = F.array_sort(F.map_entries(F.map_filter("labels", lambda _, v: F.coalesce(v, F.lit("")) != "")))
    text = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit('="'), quoted(e["value"]), F.lit('"'))), ",")
    return samples.select(F.concat(F.col("metric"), F.when(text != "", F.concat(F.lit("{"), text, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("value"))


def older_than(df: DataFrame, ts: str, now: str, age: str) -> DataFrame:
    """Rows of before now - age; now is a parameter, so that reruns agree."""
    from .selectors import before

    return df.where(F.col(ts) < before(now, age))
