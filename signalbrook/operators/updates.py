"""Updates of packages: what kind of step a new version is, and rules that settle what is done about it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import VERSION, version_below, version_parts
from .selectors import matches

KINDS = ("major", "minor", "patch", "prerelease")


def update_kind(current: str | Column, new: str | Column) -> Column:
    """The first part of a version that a new one raises: major, minor, patch or prerelease (of equal numbers: a later prerelease, or the release
    after its prereleases); null where either is no version, or the new one the same or older."""
    current, new = (F.col(c) if isinstance(c, str) else c for c in (current, new))
    a, b = version_parts(current), version_parts(new)
    out = F.when(b["prerelease"] == a["prerelease"], None).when((b["prerelease"] == "") | ((a["prerelease"] != "") & (b["prerelease"] > a["prerelease"])), "prerelease")
    for part in reversed(KINDS[:3]):
        out = F.when(b[part] > a[part], part).when(b[part] == a[part], out)
    return F.when(current.rlike(VERSION) & new.rlike(VERSION), out)


@dataclass(frozen=True)
class UpdateRule:
    """settings for the updates that all given predicates hold for: package among names or matching one of patterns (whole), kind among kinds, and the
    new version below a limit such as (3, 15). A rule without predicates holds for all."""

    settings: Mapping[str, str]
    names: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    below: tuple[int, ...] = field(default=())

    def holds(self, package: Column, kind: Column, new: Column) -> Column:
        parts = []
        if self.names or self.patterns:
            named = [package.isin(*self.names)] if self.names else []
            parts.append(reduce(Column.__or__, [*named, *[matches(package, "=~", p) for p in self.patterns]]))
        if unknown := set(self.kinds) - set(KINDS):
            raise ValueError(f"no kind of update: {sorted(unknown)}")
        if self.kinds:
            parts.append(kind.isin(*self.kinds))
        if self.below:
            parts.append(new.rlike(VERSION) & version_below(new, *self.below))
        return F.coalesce(reduce(Column.__and__, parts, F.lit(True)), F.lit(False))


def settle(updates: DataFrame, rules: list[UpdateRule], package: str = "package", current: str = "current", new: str = "new") -> DataFrame:
    """Adds kind, and a column for each setting that a rule has: the value of the last rule that holds, null where none does. Columns of
    these names are replaced; a null package or version only meets rules that don't ask for it."""
    names = list(dict.fromkeys(k for r in rules for k in r.settings))
    kinds = updates.withColumn("kind", update_kind(F.col(current), F.col(new)))
    out = {}
    for name in names:
        held = [(r.holds(F.col(package), F.col("kind"), F.col(new)), r.settings[name]) for r in rules if name in r.settings]
        out[name] = F.coalesce(*[F.when(on, F.lit(value)) for on, value in reversed(held)])
    return kinds.withColumns(out) if out else kinds
