"""Target discovery and relabelling."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import label, merge_labels


@dataclass(frozen=True)
class Rule:
    """action replace: where the joined source labels match the whole regex, target gets the replacement ($1 is a group).
    action keep or drop: rows whose joined source labels match stay, or go."""

    source: tuple[str, ...]
    target: str = ""
    regex: str = "(.*)"
    replacement: str = "$1"
    separator: str = ";"
    action: str = "replace"


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f refers to it."""
    return F.transform(F.array(value), f)[0]


def relabel(df: DataFrame, rules: list[Rule], column: str = "labels") -> DataFrame:
    """Apply rules in order to a column of labels; a replacement that comes out empty removes the label. Null labels stay null, and all of them count as empty.

    The labels that rules name are taken out of the map once; each rule makes the next state from the one before, which it refers to once, so that
    the expression grows by as much with each rule; and the map is put together at the end. Rows leave where the result is unfolded, which no filter can be
    moved before: nothing is worked out twice."""
    if not rules:
        return df
    names = list(dict.fromkeys(n for r in rules for n in (*r.source, *([r.target] if r.action == "replace" else []))))
    place = {n: f"v{i}" for i, n in enumerate(names)}

    def then(rule: Rule) -> Callable[[Column], Column]:
        def step(s: Column) -> Column:
            """The state after a rule, from the joined source labels j and the state s before it."""
            joined = F.concat_ws(rule.separator, *[s[place[n]] for n in rule.source])
            return _bound(F.struct(joined.alias("j"), s.alias("s")), made)

        def made(x: Column) -> Column:
            j, s, whole = x["j"], x["s"], rf"\A(?:{rule.regex})\z"
            fits = j.rlike(whole)
            own = {c: s[c] for c in ("kept", "some", *place.values())}
            if rule.action in ("keep", "drop"):
                own["kept"] = s["kept"] & (fits if rule.action == "keep" else ~fits)
            else:
                at = place[rule.target]
                own[at] = F.when(s["some"] & fits, F.regexp_replace(j, whole, rule.replacement)).otherwise(s[at])
            return F.struct(*[v.alias(c) for c, v in own.items()])

        return step

    labels = F.col(column)
    state = F.struct(F.lit(True).alias("kept"), labels.isNotNull().alias("some"), *[label(n, labels).alias(c) for n, c in place.items()])
    for rule in rules:
        state = _bound(state, then(rule))
    # a label stands where the last rule that sets it puts it
    targets = list(dict.fromkeys(r.target for r in reversed(rules) if r.action == "replace"))[::-1]

    def ended(s: Column) -> Column:
        out = labels
        if targets:
            new = F.map_filter(F.create_map(*[x for t in targets for x in (F.lit(t), s[place[t]])]), lambda _, v: v != "")
            out = F.map_concat(F.map_filter(labels, lambda k, _: ~k.isin(targets)), new)
        return F.when(s["kept"], F.array(out))

    return df.select(*[F.explode(_bound(state, ended)).alias(c) if c == column else F.col(c) for c in df.columns])


def constant_label(df: DataFrame, name: str, value: str, column: str = "labels") -> DataFrame:
    return df.withColumn(column, merge_labels(F.col(column), F.create_map(F.lit(name), F.lit(value))))


def per_network(targets: DataFrame, networks: str = "networks", column: str = "labels", prefix: str = "__meta_network_") -> DataFrame:
    """A target once for each of its networks (an array of structs of name and ip), their fields as meta labels."""
    each = targets.withColumn("net_", F.explode(networks))
    made = F.create_map(F.lit(prefix + "name"), F.col("net_.name"), F.lit(prefix + "ip"), F.col("net_.ip"))
    return each.withColumn(column, merge_labels(F.col(column), made)).drop("net_", networks)
