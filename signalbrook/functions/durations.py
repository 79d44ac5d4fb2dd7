"""Duration texts such as 90s, 5m, 48h, 14d, as seconds."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The seconds in each unit.
UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def seconds(text: str | int | float) -> float:
    """The seconds that a duration stands for; numbers are seconds already. Several parts add up (1h30m)."""
    if isinstance(text, (int, float)):
        return text
    parts = re.findall(r"(\d+)(ms|[smhdw])", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    return sum(int(a) * UNITS[b] for a, b in parts)


def seconds_of(col: str | Column) -> Column:
    """The same for a column of single-unit durations; null where the text is none."""
    col = F.col(col) if isinstance(col, str) else col
    number, unit = F.regexp_extract(col, r"^(\d+)(s|m|h|d|w)$", 1), F.regexp_extract(col, r"^(\d+)(s|m|h|d|w)$", 2)
    factor = F.lit(None).cast("long")
    for u in ("s", "m", "h", "d", "w"):
        factor = F.when(unit == u, F.lit(int(UNITS[u]))).otherwise(factor)
    return F.try_multiply(F.expr("1L") * number.try_cast("long"), factor)


def since_argument(col: str | Column) -> Column:
    """A duration in the spelling that a journal reader takes: days as hours, minutes as min."""
    col = F.col(col) if isinstance(col, str) else col
    number, unit = F.regexp_extract(col, r"^(\d+)([smhd])$", 1), F.regexp_extract(col, r"^(\d+)([smhd])$", 2)
    return (
        F.when(unit == "d", F.concat((number.try_cast("long") * 24).cast("string"), F.lit(" h")))
        .when(unit == "m", F.concat(number, F.lit(" min")))
        .when(unit != "", F.concat(number, F.lit(" "), unit))
    )


def age_ms(ts: str | Column, now: str) -> Column:
    """Milliseconds from a time without zone to now, which is a parameter, so that reruns agree."""
    since = lambda t: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t)
    at = F.col(ts) if isinstance(ts, str) else ts
    return (F.floor(since(F.lit(now).cast("timestamp_ntz")) / 1000) - F.floor(since(at) / 1000)).cast("long")
