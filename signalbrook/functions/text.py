"""Text to columns: named regex groups, logfmt, pinned versions, versions, paths, sizes, templates."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LOGFMT_PAIR = r'([^\s=]+)=("(?:[^"\\]|\\.)*"|\S*)'


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def named_groups(pattern: str) -> tuple[str, list[str]]:
    """A pattern with its named groups made plain ones (Spark's names take no underscore), and the names in order.
    Every group that captures must have a name."""
    names = re.findall(r"\(\?P?<(\w+)>", pattern)
    return re.sub(r"\(\?P?<\w+>", "(", pattern), names


def laid_groups(c: str | Column, pattern: str) -> Column:
    """A text's named groups laid out by one run of the pattern, between control characters that split_groups takes apart; a text that does not
    match, or holds these characters itself, stays."""
    c, (spelled, names) = _col(c), named_groups(pattern)
    whole = rf"(?s)\A.*?(?-s:{spelled})(?s:.*)\z"
    laid = F.regexp_replace(c, whole, "\x02" + "\x01".join(f"${i}" for i in range(1, len(names) + 1)))
    return F.when(c.contains("\x01") | c.contains("\x02"), c).otherwise(laid)


def split_groups(laid: str | Column, c: str | Column, pattern: str) -> tuple[Column, list[str]]:
    """The named groups of a pattern as an array of texts, and their names; empty texts where the pattern or an optional group does not match.
    laid is laid_groups of the text c; a text that holds the control characters itself is read group by group."""
    laid, c, (spelled, names) = _col(laid), _col(c), named_groups(pattern)
    none = F.array(*[F.lit("")] * len(names))
    each = F.array(*[F.coalesce(F.regexp_extract(c, spelled, i), F.lit("")) for i in range(1, len(names) + 1)])
    once = F.when(laid.startswith("\x02"), F.split(F.substring(laid, 2, 2**31 - 1), "\x01", -1)).otherwise(none)
    return F.when(c.isNull(), none).when(c.contains("\x01") | c.contains("\x02"), each).otherwise(once), names


def extract_all_named(c: str | Column, pattern: str) -> Column:
    """All matches of a pattern with named groups, as an array of structs of strings."""
    spelled, names = named_groups(pattern)
    groups = [F.regexp_extract_all(_col(c), F.lit(spelled), F.lit(i)).alias(n) for i, n in enumerate(names, 1)]
    return F.arrays_zip(*groups)


def logfmt_pairs(c: str | Column) -> Column:
    """The key=value pairs of a line, as an array of texts."""
    return F.regexp_extract_all(_col(c), F.lit(LOGFMT_PAIR), F.lit(0))


def logfmt(pairs: str | Column) -> Column:
    """Pairs (logfmt_pairs) as a map; quoted values lose their quotes and escapes. Of repeated keys the last wins; only lines that
    repeat one pay for that."""

    def bare(v: Column) -> Column:
        inner = F.when(v.endswith('"') & (F.length(v) > 1), v.substr(F.lit(2), F.length(v) - 2)).otherwise(v.substr(F.lit(2), F.length(v)))
        return F.when(~v.startswith('"'), v).when(inner.contains("\\"), F.regexp_replace(inner, r"\\(.)", "$1")).otherwise(inner)

    pairs = _col(pairs)
    keys = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), bare(p.substr(F.locate("=", p) + 1, F.length(p))).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), e["k"]))
    return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), entries).otherwise(last))


def version_key(c: str | Column, prefix: str = "") -> Column:
    """The numbers of a version as an array, which sorts versions as versions do (6.8.9 before 6.8.12)."""
    text = F.regexp_replace(_col(c), "^" + re.escape(prefix), "")
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))


#: A version: up to three numbers, with or without a leading v, and a prerelease.
VERSION = r"^v?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:[-+]?([A-Za-z].*))?$"


def version_parts(c: str | Column) -> Column:
    """major, minor, patch and prerelease of a version, with or without a leading v."""
    number = lambda i: F.coalesce(F.regexp_extract(_col(c), VERSION, i).try_cast("int"), F.lit(0))
    return F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), F.regexp_extract(_col(c), VERSION, 4).alias("prerelease"))


def version_below(c: str | Column, *limit: int) -> Column:
    """Whether a version is below a limit such as 3, 15."""
    parts = version_parts(c)
    names = ["major", "minor", "patch"][: len(limit)]
    return F.struct(*[parts[n].alias(n) for n in names]) < F.struct(*[F.lit(x).alias(n) for n, x in zip(names, limit, strict=True)])


def stripped(c: str | Column, prefix: str = "", suffix: str = "") -> Column:
    """A text without a literal prefix and suffix, where it has them."""
    quoted = lambda t: re.sub(r"(\W)", r"\\\1", t)
    return F.regexp_replace(_col(c), rf"\A{quoted(prefix)}|{quoted(suffix)}\z", "")


def basename(c: str | Column) -> Column:
    return F.substring_index(_col(c), "/", -1)


def dirname(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), r"/?[^/]*$", "")


def human_bytes(c: str | Column) -> Column:
    """Bytes of a size such as 512K, 1.5G or 20 (powers of 1024); null where the text is none."""
    pattern = r"^([0-9.]+)([KMGT]?)B?$"
    number, unit = F.regexp_extract(_col(c), pattern, 1).try_cast("double"), F.regexp_extract(_col(c), pattern, 2)
    factor = F.lit(1.0)
    for power, u in enumerate("KMGT", 1):
        factor = F.when(unit == u, F.lit(float(1024**power))).otherwise(factor)
    return number * factor


def non_empty(*cols: str | Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cols])


def lookup(mapping: dict[str, str], c: str | Column, default: Column | None = None) -> Column:
    """A fixed map's value for a key, or a default, by default the key itself."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(table, _col(c)), _col(c) if default is None else default)


_MARK = re.compile(r"\{\{\s*(.*?)\s*\}\}")


def template(text: str, field: Callable[[str], Column]) -> Column:
    """A template as one column expression. {{ .a }}, {{ $labels.a }} and {{ a }} stand for field("a"); {{ $value }} for field("$value");
    {{ printf "%.1f" x }} formats; {{ if x }}..{{ else }}..{{ end }} takes the first branch where x is not empty, and
    {{ if eq x "text" }} where they are equal. Nothing else is understood."""
    tokens: list[tuple[str, str]] = []
    at = 0
    for m in _MARK.finditer(text):
        tokens += [("text", text[at : m.start()]), ("mark", m[1])]
        at = m.end()
    tokens.append(("text", text[at:]))
    pos = 0

    def value(name: str) -> Column:
        if name.startswith('"'):
            return F.lit(name[1:-1])
        return field(re.sub(r"^(\$labels\.|\.)", "", name))

    def block(stop: tuple[str, ...]) -> tuple[Column, str]:
        nonlocal pos
        parts = []
        while pos < len(tokens):
            kind, body = tokens[pos]
            pos += 1
            if kind == "text":
                if body:
                    parts.append(F.lit(body))
            elif body in stop:
                return F.concat(*parts) if parts else F.lit(""), body
            elif m := re.fullmatch(r'if eq (\S+) ("[^"]*"|\S+)|if (\S+)', body):
                test = value(m[1]) == value(m[2]) if m[1] else F.coalesce(value(m[3]).cast("string"), F.lit("")) != ""
                yes, end = block(("else", "end"))
                no = block(("end",))[0] if end == "else" else F.lit("")
                parts.append(F.when(test, yes).otherwise(no))
            elif m := re.fullmatch(r'printf "([^"]*)" (\S+)', body):
                parts.append(F.format_string(m[1], value(m[2])))
            else:
                parts.append(F.coalesce(value(body).cast("string"), F.lit("")))
        return F.concat(*parts) if parts else F.lit(""), ""

    return block(())[0]
