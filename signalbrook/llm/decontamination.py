"""Benchmark decontamination: windows of benchmark items found in documents by a prefix-filtered join [native]."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

#: Words of a window, and of a shingle (all of a window's, if it has fewer).
WINDOW, SHINGLE = 10, 5
#: Shingles of the benchmark that one pass over the documents looks for: what a pass broadcasts is 8 bytes for each of them.
BLOCK = 1 << 20

_ASCII = [chr(c) for c in range(128) if not (chr(c).isdigit() or chr(c).islower())]
_FROM, _TO = "".join(_ASCII), "".join(c.lower() if c.isalpha() else " " for c in _ASCII)


def words(text: Column) -> Column:
    """The words of a text, A-Z lowered: runs of digits, letters a to z and characters beyond ASCII. Null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _FROM, _TO), " "), "")


def _shingles(w: Column, size: int) -> Column:
    """Every run of size words of w: its place and its hash."""
    run = lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(size), *[F.get(w, i + j) for j in range(size)]).alias("h"))
    return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), run)).otherwise(F.array().cast("array<struct<pos:int,h:bigint>>"))


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """The distinct windows of all items: window (its words, space-joined), length, items (the ids of those that have it, without nulls)."""
    w = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    run = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - width, F.lit(0)) + 1), lambda i: F.array_join(F.slice("w", i, width), " "))
    each = w.select("item", F.explode(run).alias("window")).distinct()
    return each.groupBy("window").agg(F.collect_set("item").alias("items")).withColumn("length", F.size(F.split("window", " ")))


def _looked_for(wins: DataFrame, size: int) -> DataFrame:
    """The shingles of each window: window, pos (the shingle's place in it), h."""
    w = wins.select("window", F.split("window", " ").alias("w"))
    own = [w.where((F.size("w") == k) if k < size else (F.size("w") >= size)).select("window", F.inline(_shingles(F.col("w"), k))) for k in range(1, size + 1)]
    return reduce(DataFrame.unionAll, own)


def _hits(docs: DataFrame, keys: DataFrame, sizes: list[int], width: int, marks: bool) -> DataFrame:
    """Where documents (row, doc, w) have shingles of keys (h), with the words around them; and, with marks, a row of place -1 for each document.

    The exploded shingles meet a broadcast table within the same pass, so that only those found carry words along."""
    mark = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).cast("long").alias("h")))
    found = F.concat(*([mark] if marks else []), *[_shingles(F.col("w"), k) for k in sizes]) if sizes else mark
    each = docs.select("row", "doc", "w", F.explode(found).alias("e"))
    table = keys.select(F.col("h").alias("key"), F.lit(False).alias("mark"))
    if marks:
        table = table.unionAll(docs.sparkSession.sql("SELECT CAST(0 AS BIGINT) AS key, true AS mark"))
    first = F.greatest(F.col("e.pos") - (width - 1), F.lit(0))
    return each.join(F.broadcast(table), F.col("e.h") == F.col("key")).where((F.col("e.pos") < 0) == F.col("mark")).select(
        "row", F.when(F.col("mark"), F.col("doc")).alias("doc"), F.size("w").alias("n_words"), F.col("e.pos").alias("pos"), "key",
        F.when(~F.col("mark"), first).alias("first"), F.when(~F.col("mark"), F.slice("w", first + 1, F.col("e.pos") - first + width)).alias("around"),
    )


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", columns: list[str] | None = None, item: str = "item_id", item_text: str = "text", width: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Which words of each document lie in a window of a benchmark item: width consecutive words of it, or all of an item of fewer.

    Returns for each document columns (by default all but text), n_words, n_hit (words inside an occurrence), items (ids, as sorted texts) and
    spans (begin and past the end of each stretch of hit words, counted in words from 0). Columns of these names are replaced.

    A window is contained only if each of its shingles is, so one of them suffices to find it: the one that documents have least often, ties by hash. All
    shingles of the benchmark are looked up while the documents are read once; those found are written with the words around them, counted, and the
    rarest of each window joined with the window. A candidate must leave room for the window before and after (positional and length bounds), and
    then is compared word by word. Windows with a shingle that no document has drop out. Texts are not shuffled.

    Null and wordless texts have no words and no hits; null and wordless items have no windows; an item without an id makes hits but is not among items;
    rows that repeat each come back; an empty benchmark hits nothing; empty documents give an empty result. A benchmark of more than BLOCK shingles is
    looked up in blocks, a pass each."""
    made = ["n_words", "n_hit", "items", "spans"]
    columns = [c for c in (columns or df.columns) if c != text and c not in made] if columns is None else columns
    docs = df.select(F.monotonically_increasing_id().alias("row"), F.struct(*columns).alias("doc") if columns else F.struct(F.lit(0)).alias("doc"), words(F.col(text)).alias("w"))
    wins = cut(windows(benchmark, item, item_text, width))
    shingle = min(shingle, width)
    parts = cut(_looked_for(wins, shingle))
    sizes = sorted(r[0] for r in wins.select(F.least("length", F.lit(shingle)).alias("k")).distinct().collect())  # at most `shingle` values
    keys = parts.select("h").distinct()
    n_blocks = -(-keys.count() // BLOCK)
    if n_blocks <= 1:
        hits = cut(_hits(docs, keys, sizes, width, True))
    else:
        docs, keys = cut(docs), cut(keys)
        block = lambda b: keys.where(F.pmod("h", F.lit(n_blocks)) == b)
        hits = reduce(DataFrame.unionAll, [cut(_hits(docs, block(b), sizes, width, b == 0)) for b in range(n_blocks)])
    # the rarest shingle of each window
    counts = hits.where("pos >= 0").groupBy("key").agg(F.count("*").alias("n"))
    ranked = parts.join(counts, parts["h"] == counts["key"], "left").select("window", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", F.col("pos").alias("offset")).alias("r"))
    prefix = ranked.groupBy("window").agg(F.min("r").alias("r")).where("r.n > 0").select("window", F.col("r.h").alias("h"), F.col("r.offset").alias("offset"))
    prefix = small(prefix.join(wins, "window"))
    begin = F.col("pos") - F.col("offset")
    met = hits.where("pos >= 0").join(prefix, F.col("key") == F.col("h"))
    met = met.where((begin >= 0) & (begin + F.col("length") <= F.col("n_words")))
    met = met.where(F.array_join(F.slice("around", begin - F.col("first") + 1, F.col("length")), " ") == F.col("window"))
    met = cut(met.select("row", begin.alias("begin"), (begin + F.col("length")).alias("end"), "items"))
    # stretches of words that overlapping and adjoining windows cover
    order = Window.partitionBy("row").orderBy("begin", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = met.select("row", "begin", "end", F.when(F.col("begin") <= reach, 0).otherwise(1).alias("new"))
    stretch = opened.withColumn("k", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("row", "k").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    spans = stretch.groupBy("row").agg(F.sum(F.col("end") - F.col("begin")).cast("long").alias("n_hit"), F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    named = met.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = hits.where("pos < 0").select("row", "doc", F.col("n_words").cast("long").alias("n_words")).join(spans, "row", "left").join(named, "row", "left")
    return out.select(
        *[F.col("doc").getField(c).alias(c) for c in columns], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int>>")).alias("spans"),
    )
