"""Configuration as relations: lookups, differences, groups of hosts, desired against actual state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled


def lookup(rows: DataFrame, table: DataFrame, on: dict[str, str], take: list[str], strict: bool = True) -> DataFrame:
    """rows with columns of a table found by key (rows' column to table's). Strict: a key that the table lacks is an error when
    the result is computed; else its columns are null. The join's strategy is left to the optimizer."""
    side = table.select(*[F.col(k).alias(f"key_{i}_") for i, k in enumerate(on.values())], *[F.col(c).alias(f"take_{c}") for c in take], F.lit(True).alias("hit_"))
    cond = [F.col(a) == F.col(f"key_{i}_") for i, a in enumerate(on)]
    joined = rows.join(side, cond, "left")
    if strict:
        shown = F.concat_ws(",", *[F.col(c).cast("string") for c in on])
        joined = joined.withColumn("hit_", F.when(F.col("hit_").isNull(), F.raise_error(F.concat(F.lit("no entry for "), shown)).cast("boolean")).otherwise(True)).where("hit_")
    return joined.select(*rows.columns, *[F.col(f"take_{c}").alias(c) for c in take])


def others(hosts: DataFrame, key: str, group: str | None = None) -> DataFrame:
    """Each host with every other one (of its group, if one is given): key and other_key."""
    a, b = hosts.select(*([group] if group else []), key), hosts.select(*([F.col(group).alias("group_")] if group else []), F.col(key).alias(f"other_{key}"))
    differ = F.col(key) != F.col(f"other_{key}")
    on = differ & (F.col(group) == F.col("group_")) if group else differ
    return a.join(b, on).drop("group_")


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.join(present.select(key), key, "left_anti")


def differing(wanted: DataFrame, installed: DataFrame, key: str, version: str) -> DataFrame:
    """What is wanted in a version other than the installed one, or not installed."""
    have = installed.select(key, F.col(version).alias("have_"))
    joined = wanted.join(have, key, "left").where(F.coalesce("have_", F.lit("")) != F.col(version))
    return joined.withColumnRenamed("have_", f"installed_{version}")


def duplicates(rows: DataFrame, keys: list[str], where: str | None = None) -> DataFrame:
    """Keys that more than one row (or more than one distinct value of a column) has, and how many."""
    n = F.count_distinct(where) if where else F.count("*")
    return rows.groupBy(*keys).agg(n.alias("n")).where("n > 1")


def all_back(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One row: how many ran before, how many of them run now, and whether that is all."""
    back = before.join(after.select(key), key, "left_semi").agg(F.count("*").alias("n_after"))
    return before.agg(F.count("*").alias("n_before")).join(back).withColumn("all_back", F.col("n_before") == F.col("n_after"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def members(edges: DataFrame, root: str) -> DataFrame:
    """The hosts below a group: edges(parent, child, is_host) followed down through its groups."""
    return edges.sparkSession.sql(
        """WITH RECURSIVE below(child, is_host) AS (
             SELECT child, is_host FROM {edges} WHERE parent = :root
             UNION ALL
             SELECT e.child, e.is_host FROM below b JOIN {edges} e ON e.parent = b.child WHERE NOT b.is_host)
           SELECT DISTINCT child AS host FROM below WHERE is_host""",
        args={"root": root}, edges=edges,
    )


def hosts_of(edges: DataFrame, pattern: str) -> DataFrame:
    """The hosts of a pattern: groups joined by : add, :& intersects, :! takes away; in that order. group[0] is the first of its hosts."""
    plus, meet, less = [], [], []
    for part in pattern.split(":"):
        (less if part[0] == "!" else meet if part[0] == "&" else plus).append(part.lstrip("!&"))

    def one(name: str) -> DataFrame:
        if name.endswith("]"):
            base, i = name[:-1].split("[")
            return members(edges, base).orderBy("host").offset(int(i)).limit(1)
        direct = edges.where((F.col("child") == name) & F.col("is_host")).select(F.col("child").alias("host"))
        return members(edges, name).unionByName(direct).distinct()

    out = one(plus[0])
    for p in plus[1:]:
        out = out.unionByName(one(p)).distinct()
    for p in meet:
        out = out.intersect(one(p))
    for p in less:
        out = out.join(one(p), "host", "left_anti")
    return out


def desired_diff(desired: DataFrame, actual: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """What to do about each key: create, update, delete or keep."""
    d = desired.select(F.col(key), *[F.col(f).alias(f"want_{f}") for f in fields], F.lit(True).alias("in_desired"))
    a = actual.select(F.col(key), *[F.col(f).alias(f"have_{f}") for f in fields], F.lit(True).alias("in_actual"))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"want_{f}").eqNullSafe(F.col(f"have_{f}"))
    action = F.when(F.col("in_actual").isNull(), "create").when(F.col("in_desired").isNull(), "delete").when(same, "keep").otherwise("update")
    return d.join(a, key, "full_outer").withColumn("action", action).drop("in_desired", "in_actual")


def as_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    """All rows as one map, in order of the keys: an output block."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))))
    return rows.agg(F.map_from_entries(entries).alias("output"))


def object_lines(rows: DataFrame, key: str, value: str) -> DataFrame:
    """All rows as the lines of one JSON object, in the order of their keys: line. Lines are sorted by ranges of keys, so no task holds the
    object. Of repeated keys the largest value stands (values must have an order); a null key is an error, a null value null; without rows the object is empty."""
    text = F.coalesce(F.col(key).cast("string"), F.raise_error(F.lit("a null key of an object")).cast("string"))
    json = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    kept = rows.select(text.alias("k"), F.col(value).alias("v")).groupBy("k").agg(F.max("v").alias("v"))
    ends = rows.agg(F.min(F.col(key).cast("string")).alias("low"), F.max(F.col(key).cast("string")).alias("high"))  # one row
    opened = F.when(F.col("k") == F.col("low"), "{").otherwise(",")
    closed = F.when(F.col("k") == F.col("high"), "}").otherwise("")
    lines = kept.crossJoin(F.broadcast(ends)).select("k", F.concat(opened, json(F.col("k")), F.lit(":"), json(F.col("v")), closed).alias("line"))
    none = ends.where("low IS NULL").select(F.lit("").alias("k"), F.lit("{}").alias("line"))
    return lines.unionAll(none).orderBy("k").select("line")


def with_defaults(rows: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Optional fields filled with what they default to."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def product(rows: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each pair of an element of one array column with one of another."""
    return rows.withColumn("a_", F.explode(a)).withColumn("b_", F.explode(b)).drop(a, b).withColumnsRenamed({"a_": a, "b_": b})


def resolve(rows: DataFrame, objects: DataFrame, refs: dict[str, str], take: str, name: str) -> DataFrame:
    """References by several attributes (rows' column to the object's) as the object's id, under a new name; null if there is none."""
    side = objects.select(*[F.col(v).alias(f"ref_{i}_") for i, v in enumerate(refs.values())], F.col(take).alias(name))
    on = [F.col(k) == F.col(f"ref_{i}_") for i, k in enumerate(refs)]
    return rows.join(side, on, "left").drop(*[f"ref_{i}_" for i in range(len(refs))])


#: Regions are cut into stretches of 2^0, 2^4, 2^8 ... bins, and one takes so many of them at most.
LEVEL_STEP, MOST_STRETCHES = 4, 17


def dyadic_cover(low: Column, high: Column, levels: int | list[int]) -> Column:
    """Stretches of a power of two bins, each at a multiple of its length, that together hold the bins low to high (both included): an array of structs of
    level and node. All are of one level, the lowest at which they are MOST_STRETCHES at most (else the highest). Levels are those to choose from, or the highest of them."""
    choice = list(range(0, levels + 1, LEVEL_STEP)) if isinstance(levels, int) else sorted(levels)
    level = F.lit(choice[-1])
    for k in reversed(choice[:-1]):
        level = F.when(_node(high, F.lit(k)) < _node(low, F.lit(k)) + MOST_STRETCHES, F.lit(k)).otherwise(level)
    nodes = F.sequence(_node(low, level), _node(high, level))
    return F.transform(nodes, lambda n: F.struct(level.alias("level"), n.alias("node")))


def _node(bin_: Column, level: Column) -> Column:
    return F.call_function("shiftright", bin_, level)


def _levels(rows: dict[int, int]) -> list[int]:
    """The levels worth asking for, of those that regions would take and how many rows each would have. A level goes into the next one, where its regions take two
    rows at most, if that adds at most a quarter to the rows there: each point is then shuffled once less, for few pairs more that the exact ends rule out."""
    kept = dict(rows)
    for k in sorted(rows):
        if 8 * kept[k] <= kept.get(k + LEVEL_STEP, 0):
            kept[k + LEVEL_STEP] += 2 * kept.pop(k)
    return sorted(kept)


def overlapping(points: DataFrame, regions: DataFrame, ts: str, start: str, end: str, bin_ms: int = 65_536) -> DataFrame:
    """Points (epoch milliseconds) with the regions that hold them, both ends included; a region without an end is a point.

    A region stands in the dyadic stretches of bins that hold it, of a length that goes by its own, so that one of ten years takes a few rows; a point asks for
    the one stretch that holds it of each length that regions have (as a rule one or two). Both meet in an equi-join, where the exact ends decide. It is a merge
    join whatever the sizes: what a task holds can spill, and a table that unpacks to many times its file's size is not broadcast."""
    last = F.greatest(F.coalesce(F.col(end), F.col(start)), F.col(start))
    bin_of = lambda c: F.floor(c / bin_ms)
    held = regions.withColumn("last_", last)

    def spread(levels: int | list[int]) -> DataFrame:
        cover = dyadic_cover(bin_of(F.col(start)), bin_of(F.col("last_")), levels)
        return held.withColumn("cover_", F.explode(cover)).select(*regions.columns, "last_", F.col("cover_.level").alias("level_"), F.col("cover_.node").alias("node_"))

    used = _levels(dict(spread(48).groupBy("level_").count().collect())) or [0]  # 13 rows at most
    ask = F.explode(F.array(*map(F.lit, used))) if len(used) > 1 else F.lit(used[0])
    at = points.withColumn("ask_", ask)
    met = (F.col("ask_") == F.col("level_")) & (_node(bin_of(F.col(ts)), F.col("ask_")) == F.col("node_"))
    inside = (F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col("last_"))
    return at.join(spread(used).hint("merge"), met & inside).drop("ask_", "last_", "level_", "node_")


def layers(objects: DataFrame, references: DataFrame, key: str, child: str = "child", parent: str = "parent", most_rounds: int = 1000) -> DataFrame:
    """In which order objects can be made that refer to one another: adds layer, 0 for those that refer to none, else one more than the highest layer
    that they refer to; null for those that no order reaches, with in_cycle true for those on a circle of references (or on the way from one to another)
    and false for those that only wait for one.

    A round takes the objects whose references have all been made, which it looks for among those that refer to the round before: what it shuffles goes by
    them, and objects and references stay where they lie. What is left when a round finds none is cut back from its other end, to those that something left
    refers to, in the same way. As many rounds as there are layers; what each finds is settled in the shared folder. References to unknown objects and repeated ones don't count; of repeated keys each row gets the layer."""
    names = objects.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct()
    links = references.select(F.col(child).alias("c"), F.col(parent).alias("p")).where("c IS NOT NULL AND p IS NOT NULL").distinct()
    known = names.select(F.col("k").alias("p"))
    links = links.join(known, "p", "left_semi").join(known.select(F.col("p").alias("c")), "c", "left_semi")

    def peeled(left: DataFrame, links: DataFrame, end: str, other: str) -> tuple[list[DataFrame], DataFrame, DataFrame]:
        """Objects that stand at no link's end, round by round, and what is left of objects and links."""
        taken = []
        free = settled(left.join(links.select(F.col(end).alias("k")), "k", "left_anti"))
        for _ in range(most_rounds):
            if not free.head(1):
                if not taken:
                    return taken, left, links
                done = reduce(DataFrame.unionAll, taken)
                return taken, settled(left.join(done, "k", "left_anti")), settled(links.join(done.select(F.col("k").alias(other)), other, "left_anti"))
            taken.append(free)
            done = reduce(DataFrame.unionAll, taken)
            # only what a link joins to the last round's can be free in the next; it is, unless it has a link to something not yet taken
            near = settled(links.join(free.select(F.col("k").alias(other)), other, "left_semi").select(F.col(end).alias("k")).distinct())
            held = links.join(near.select(F.col("k").alias(end)), end, "left_semi").join(done.select(F.col("k").alias(other)), other, "left_anti")
            free = settled(near.join(held.select(F.col(end).alias("k")), "k", "left_anti"))
        raise RuntimeError(f"more than {most_rounds} layers")

    made, left, links = peeled(settled(names), settled(links), "c", "p")
    _, core, _ = peeled(left, links, "p", "c")
    none = names.sparkSession.createDataFrame([], names.schema).select("k", F.lit(None).cast("int").alias("layer"), F.lit(None).cast("boolean").alias("in_cycle"))
    told = reduce(DataFrame.unionAll, [x.select("k", F.lit(i).alias("layer"), F.lit(None).cast("boolean").alias("in_cycle")) for i, x in enumerate(made)], none)
    round_ = core.select("k", F.lit(None).cast("int").alias("layer"), F.lit(True).alias("in_cycle"))
    waits = left.join(core, "k", "left_anti").select("k", F.lit(None).cast("int").alias("layer"), F.lit(False).alias("in_cycle"))
    told = told.unionAll(round_).unionAll(waits).withColumnRenamed("k", "k_")
    return objects.drop("layer", "in_cycle").join(told, F.col(key) == F.col("k_"), "left").drop("k_")


def latest_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's latest row: an upsert of changes."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("r_"))
    return best.select(key, *[F.col(f"r_.{c}").alias(c) for c in rest])


def consistent(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that not every source has: a column for each source says whether it does."""
    out = None
    for name, df in sources.items():
        side = df.select(key).distinct().withColumn(f"in_{name}", F.lit(True))
        out = side if out is None else out.join(side, key, "full_outer")
    flags = [F.coalesce(F.col(f"in_{n}"), F.lit(False)).alias(f"in_{n}") for n in sources]
    every = F.lit(True)
    for n in sources:
        every = every & F.col(f"in_{n}")
    return out.select(key, *flags).where(~every)


def allowed(method: str | Column, path: str | Column, routes: list[tuple[str, str]]) -> Column:
    """Whether a request is one of the routes; a path that ends with * is a prefix."""
    m, p = (F.col(c) if isinstance(c, str) else c for c in (method, path))
    out = F.lit(False)
    for want, route in routes:
        out = out | ((m == want) & (p.startswith(route[:-1]) if route.endswith("*") else p == route))
    return out
