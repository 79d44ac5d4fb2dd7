"""Probe conditions such as [STATUS] == 200 or [CERTIFICATE_EXPIRATION] > 48h."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.durations import seconds, seconds_of
from .logs import once
from .vectors import COMPARISONS

#: The placeholders and the columns that hold them.
FIELDS = {"STATUS": "status", "BODY": "body", "DNS_RCODE": "dns_rcode", "CERTIFICATE_EXPIRATION": "cert_expiry_s"}
_CONDITION = r"^\[([A-Z_]+)\] (==|!=|<=|>=|<|>) (.+)$"


def condition(text: str) -> Column:
    """One fixed condition as a column; a null field fails it."""
    m = re.fullmatch(_CONDITION, text)
    if not m or m[1] not in FIELDS:
        raise ValueError(f"not a condition: {text!r}")
    value = F.col(FIELDS[m[1]])
    want = F.lit(int(seconds(m[3]))) if m[1] == "CERTIFICATE_EXPIRATION" else F.lit(int(m[3])) if m[1] == "STATUS" else F.lit(m[3])
    return F.coalesce(COMPARISONS[m[2]](value, want), F.lit(False))


def all_of(*texts: str) -> Column:
    out = F.lit(True)
    for t in texts:
        out = out & condition(t)
    return out


def read_conditions(conditions: Column) -> Column:
    """An array of condition texts as structs of field, op, want (a text) and number (what a status or a duration is compared with); nulls where one cannot be
    read. Each text is searched once: its parts are joined by a character that no condition has, and split."""
    laid = F.transform(conditions, lambda c: F.when(c.rlike(_CONDITION), F.split(F.regexp_replace(c, _CONDITION, "$1\u0001$2\u0001$3"), "\u0001", 3)))

    def parts(x: Column) -> Column:
        field, op, want = (F.get(x, F.lit(i)) for i in range(3))
        number = F.when(field == "STATUS", want.try_cast("long")).when(field == "CERTIFICATE_EXPIRATION", seconds_of(want))
        return F.struct(field.alias("field"), op.alias("op"), want.alias("want"), number.alias("number"))

    return F.transform(laid, parts)


def eval_conditions(probes: DataFrame, column: str = "conditions") -> DataFrame:
    """Adds success: whether every condition of a row's own list holds. A condition that cannot be read fails. Conditions are read once, into
    structs; after that only the structs' fields are compared."""
    read = once(probes, read_=read_conditions(F.col(column)))

    def one(c: Column) -> Column:
        number = F.when(c["field"] == "STATUS", F.col("status").cast("long")).when(c["field"] == "CERTIFICATE_EXPIRATION", F.col("cert_expiry_s"))
        text = F.when(c["field"] == "BODY", F.col("body")).when(c["field"] == "DNS_RCODE", F.col("dns_rcode"))
        # -1, 0 or 1; null where either side is missing
        sign = lambda a, b: F.when(a < b, -1).when(a > b, 1).when(a == b, 0)
        order, out = F.coalesce(sign(number, c["number"]), sign(text, c["want"])), F.lit(False)
        for op, f in COMPARISONS.items():
            out = F.when(c["op"] == op, f(order, F.lit(0))).otherwise(out)
        return F.coalesce(out, F.lit(False))

    return read.withColumn("success", F.coalesce(F.forall("read_", one), F.lit(False))).drop("read_")


def reachable(statuses: list[int], tls: bool = True, ip_version: int | None = None, methods: tuple[str, ...] = ()) -> Column:
    """A web check's success: a status of the list and, where asked for, TLS, a version of IP (column ip_version) and one of some methods (column
    method, in any case). What is null fails."""
    asked = [F.col("status").isin(statuses)]
    if tls:
        asked.append(F.col("tls"))
    if ip_version is not None:
        asked.append(F.col("ip_version") == ip_version)
    if methods:
        asked.append(F.upper("method").isin(*[m.upper() for m in methods]))
    return F.coalesce(reduce(Column.__and__, asked), F.lit(False))


def by_probe(samples: DataFrame, metric: str, at: str, width: str, probe: str = "probe", by: tuple[str, ...] = ("job", "instance")) -> DataFrame:
    """A check that several probes make: for each of by how many probes reported in (at - width, at], how many of them mostly failed, and the mean
    of their means, so that a probe which reports more often has no more say."""
    from ..model import label
    from .ranges import avg_over_time
    from .selectors import range_series

    each = avg_over_time(range_series(samples, metric, [(probe, "!=", "")], at, width))
    cols = {b: label(b) for b in by}
    return each.withColumns({**cols, "probe_": label(probe)}).groupBy(*by).agg(
        F.count_distinct("probe_").alias("n_probes"), F.count_if(F.col("value") < 0.5).alias("n_failing"), F.avg("value").alias("value")
    )
