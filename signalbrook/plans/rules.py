"""Alert rules read from documents, and the dashboard panels, as functions over samples and logs.

A rule document has what a line of a rule table has (namespace, grp, alert, hold, labels, annotations) and an
expression as a tree of steps: {"kind": ..., and the step's own fields}. KINDS lists them. No query text is parsed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import series_key
from ..operators import grid as G
from ..operators import logs as L
from ..operators import ranges as R
from ..operators import selectors as S
from ..operators import vectors as V
from ..operators.alerts import Rule, annotate, hold_for
from ..operators.grid import Grid
from ..operators.pieces import at_micros

#: Takes samples and a time, gives the vector that alerts; or takes a grid of times, and gives a vector for each, told apart by eval_ts.
Expression = Callable[[DataFrame, "str | Grid"], DataFrame]


def _matchers(step: dict) -> list[S.Matcher]:
    return [tuple(m) for m in step.get("where", [])]


def _apart(at: str | Grid) -> list[str]:
    return ["eval_ts"] if isinstance(at, Grid) else []


def _series(step: dict) -> Expression:
    lookback = step.get("lookback", S.LOOKBACK)
    return lambda samples, at: (G.instant if isinstance(at, Grid) else S.select_series)(samples, step["metric"], _matchers(step), at, lookback)


def _range(step: dict) -> Callable[[DataFrame, str], DataFrame]:
    return lambda samples, at: S.range_series(samples, step["metric"], _matchers(step), at, step["width"])


def _ranged(on_grid: Callable, at_once: Callable, *more: str) -> Callable[[dict], Expression]:
    """A function of a range, with the named fields of a step after the width (on a grid) or the range."""

    def build(step: dict) -> Expression:
        own = [step.get(k, "avg") for k in more]

        def run(samples: DataFrame, at: str | Grid) -> DataFrame:
            if isinstance(at, Grid):
                return on_grid(samples, step["metric"], _matchers(step), at, step["width"], *own)
            return at_once(step, _range(step)(samples, at), *own)

        return run

    return build


def _aggregate(step: dict) -> Expression:
    inner = expression(step["of"])
    return lambda samples, at: V.agg(inner(samples, at), step["fn"], step.get("by"), _apart(at))


def _arithmetic(step: dict) -> Expression:
    left, right = expression(step["left"]), step["right"]
    other = expression(right) if isinstance(right, dict) else lambda samples, at: float(right)
    return lambda samples, at: V.binop(left(samples, at), step["op"], other(samples, at), _apart(at))


def _compare(step: dict) -> Expression:
    inner = expression(step["of"])
    return lambda samples, at: V.compare(inner(samples, at), step["op"], step["number"])


def _joined(step: dict) -> Expression:
    parts, join = [expression(x) for x in step["parts"]], V.v_and if step["kind"] == "all" else V.v_or
    return lambda samples, at: reduce(lambda a, b: join(a, b, _apart(at)), [x(samples, at) for x in parts])


def _top(step: dict) -> Expression:
    inner = expression(step["of"])

    def run(samples: DataFrame, at: str | Grid) -> DataFrame:
        vec = inner(samples, at)
        return V.ranked(vec, ["eval_ts"], ["series_key"], step["k"]).drop("rank") if isinstance(at, Grid) else V.topk(vec, step["k"])

    return run


KINDS: dict[str, Callable[[dict], Expression]] = {
    "series": _series, "aggregate": _aggregate, "arithmetic": _arithmetic,
    "over_time": _ranged(G.over_time, lambda step, rv, fn: R.over_time(rv, fn), "fn"), "increase": _ranged(G.increase, lambda step, rv: R.increase(rv)),
    "rate": _ranged(G.rate, lambda step, rv: R.rate(rv, step["width"])), "absent": _ranged(G.absent, lambda step, rv: R.absent_over_time(rv, _matchers(step))),
    "compare": _compare, "all": _joined, "any": _joined, "top": _top,
}


def expression(step: dict) -> Expression:
    """A step as a function of samples and a time, or a grid of times; an unknown kind is an error at once."""
    if step.get("kind") not in KINDS:
        raise ValueError(f"not an expression: {step!r}")
    return KINDS[step["kind"]](step)


def from_documents(documents: Iterable[dict]) -> list[tuple[Rule, Expression]]:
    """Rule documents (dicts, as JSON or YAML gives them) as rules with their expressions."""
    return [(Rule(d["alert"], d.get("hold", "0s"), dict(d.get("labels") or {}), dict(d.get("annotations") or {})), expression(d["expr"])) for d in documents]


def evaluate_at(samples: DataFrame, rule: Rule, expr: Expression, at: str) -> DataFrame:
    """A rule's alerts at one time, labelled and annotated, before holding."""
    return annotate(expr(samples, at), rule)


def evaluate_range(samples: DataFrame, rule: Rule, expr: Expression, grid: Grid) -> DataFrame:
    """A rule at every time of a grid, for hold_for: series_key, labels, annotations, eval_ts, value, cond. A series has a row (cond true) at each time at
    which the rule holds, and one (cond false, without value and annotations) at the first time after that at which it does not."""
    start, end, step = grid.micros()
    vec = expr(samples, grid).select("series_key", "labels", "eval_ts", "value")
    following = F.lead("eval_ts").over(Window.partitionBy("series_key").orderBy("eval_ts"))
    then = F.timestamp_add("MICROSECOND", F.lit(step), F.col("eval_ts"))
    ends = (following.isNull() | (following > then)) & (then <= at_micros(F.lit(end)))
    each = annotate(vec, rule).withColumn("ends_", ends).withColumn("cond", F.explode(F.when(F.col("ends_"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    on = F.col("cond")
    return each.select("series_key", "labels", F.when(on, F.col("annotations")).alias("annotations"), F.when(on, F.col("eval_ts")).otherwise(then).alias("eval_ts"), F.when(on, F.col("value")).alias("value"), "cond")


def states(samples: DataFrame, rule: Rule, expr: Expression, grid: Grid) -> DataFrame:
    """evaluate_range with each row's state (pending, firing, or inactive where an alert ends), active_at and ended_at, by the rule's hold."""
    return hold_for(evaluate_range(samples, rule, expr, grid), ["series_key"], "cond", rule.hold, "eval_ts")


def state_of_each(samples: DataFrame, documents: Iterable[dict], at: str, no_data: str = "ok") -> DataFrame:
    """What each rule says at one time: alert, state, n (how many series alert), message. A rule is evaluated on its own, so that one which fails says so in a row
    of state error, with the error's first line, and the others are told all the same; a rule without rows has the state no_data (ok, alerting or
    nodata). A rule's rows are counted where they are; one row a rule comes back."""
    told = []
    for i, d in enumerate(documents):
        name = str(d.get("alert"))
        try:
            (rule, expr), = from_documents([d])
            n = evaluate_at(samples, rule, expr, at).agg(F.count("*").alias("n")).first().n
            told.append((i, name, "alerting" if n else no_data, n, None))
        except Exception as e:  # whatever a rule's fault is, it is the rule's
            told.append((i, name, "error", None, f"{type(e).__name__}: {e}".split("\n")[0]))
    return samples.sparkSession.createDataFrame(told, "nth int, alert string, state string, n long, message string")


#: Fixed value: the pattern that reads a ban or an alert out of a message.
BAN = r"^\((?P<machine>[^)]*)\) (?:alert : )?(?P<scenario>\S+)(?: for \d+/\d+ decisions)? by (?:ip|range) (?P<source_ip>\S+)(?: \((?P<country>[^/)]*)/?(?P<asn>[^)]*)\))?(?: : (?P<duration>\S+) (?P<action>\S+) on .*)?$"


def messages(logs: DataFrame, pattern: str, fits: str, field: str = "msg", **stream: str) -> DataFrame:
    """The messages of a log stream (a field of its logfmt lines) that match fits as a whole, the named groups of pattern as labels."""
    lines = L.label_filter(L.parse_logfmt(L.stream(logs, **stream)), field, "=~", fits)
    return L.parse_regexp(L.line_format(lines, "{{." + field + "}}"), pattern)


def top_messages(logs: DataFrame, at: str, width: str, by: list[str], pattern: str, fits: str, k: int = 15, **stream: str) -> DataFrame:
    """The most frequent messages of a window by some of their groups. The window is cut before anything is parsed."""
    found = messages(L.in_window(logs, at, width), pattern, fits, **stream)
    return V.topk(L.count_over_time(found, by), k)


def message_lines(logs: DataFrame, pattern: str, fits: str, text: str, **stream: str) -> DataFrame:
    """Messages rendered by a template, newest first."""
    return L.line_format(messages(logs, pattern, fits, **stream), text).orderBy(F.col("ts").desc())


def top_rises(samples: DataFrame, metric: str, by: list[str], at: str, width: str, k: int = 15) -> DataFrame:
    """The counters that rose most over a window, by some labels; those that did not rise are left out."""
    rose = R.increase(S.range_series(samples, metric, [], at, width))
    return V.topk(V.compare(V.agg(rose, "sum", by), ">", 0), k)


def rises_by_step(samples: DataFrame, metric: str, by: list[str], step: str = "5 minutes") -> DataFrame:
    """By how much a counter rose in each step, by some labels."""
    rows = samples.where(F.col("metric") == metric).withColumn("series_key", series_key("labels"))
    return V.agg(R.increase(R.tumbling(rows, step), ["window_start"]), "sum", by, ["window_start"])


def log_alert(logs: DataFrame, text: str, at: str, width: str = "15m", by: tuple[str, ...] = ("host",)) -> DataFrame:
    """Lines with a text counted over a window, and whether the count is over 0."""
    return V.threshold(L.count_over_time(L.line_contains(L.in_window(logs, at, width), text), list(by)), "gt", 0)
