"""Mix sources to target weights: Sainte-Lague quotas of equal-word blocks, then seeded block selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut
from .sharding import assign_shards

SPACE_CLASS = r"[\x20\x09-\x0D]"


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """sources(no_source, source, source_size) with weight and target.

    Sources by code point, null last, take the weights in turn and share the total in proportion; a target
    stops at cap times its source's size and the excess is shared again by weight until none is above. Only the
    sums of each round reach the driver."""
    placed = assign_shards(sources.withColumn("one", F.lit(1)), "one", ["no_source", "source"], 1, partitions=8)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("slot") % len(weights)).cast("int") + 1)
    placed = cut(placed.select("no_source", "source", "source_size", w.alias("weight")))
    most = F.col("source_size") * F.lit(float(cap))
    wanted = share * float(placed.agg(F.sum("source_size")).first()[0] or 0)
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) > most
        open_w, held, still = placed.agg(F.sum(F.when(~full, F.col("weight"))), F.sum(F.when(full, most)), F.count(F.when(~full, 1))).first()
        now = (wanted - (held or 0.0)) / open_w if still else level
        if now == level or now is None or (level is not None and now < level):
            break
        level = now
    level = level or 0.0
    return placed.withColumn("target", F.least(F.col("weight") * F.lit(level), most))


def quotas(parties: DataFrame, keys: list[str], seats: int) -> DataFrame:
    """parties(keys, votes, most): adds quota, the Sainte-Lague seats of each party, most at most: the seats
    with the highest quotients votes / (2j - 1), ties by the keys.

    The divisor is closed in on with a grid of multipliers a pass, all summed in one aggregate; then only the seats
    between the two nearest multipliers are ranked."""
    n = parties.count()
    won = lambda m: F.least(F.col("most"), F.floor(F.col("votes") * F.lit(m) + 0.5))
    if not n or seats <= 0:
        return parties.withColumn("quota", F.lit(0).cast("long"))
    low, high, at_low, at_high = 0.0, None, 0, 0
    width = min(1.0, (n + 1) / seats)
    for _ in range(60):
        if high is None:
            grid = [1 - width, 1.0, 1 + width, 1 + 4 * width, 1 + 16 * width]
            width *= 16
        else:
            grid = [low + (high - low) * i / 33 for i in range(1, 33)]
        sums = parties.agg(*[F.sum(won(m)) for m in grid]).first()
        for m, got in zip(grid, sums, strict=True):
            if got <= seats and m > low:
                low, at_low = m, got
            if got >= seats and (high is None or m < high):
                high, at_high = m, got
        if high is not None and (at_high - at_low <= 4096 or high - low < 1e-13 * high):
            break
        if high is None and width > 1e9:  # the caps leave fewer seats than asked for
            high, at_high = grid[-1], sums[-1]
            break
    between = parties.select(*keys, "votes", F.explode(F.sequence(won(low) + 1, won(high))).alias("seat"), (won(high) > won(low)).alias("any")).where("any")
    quotient = F.col("votes") / (2 * F.col("seat") - 1)
    more = between.orderBy(quotient.desc(), *keys, "seat").limit(max(0, seats - at_low)).groupBy(*keys).agg(F.count("*").alias("more"))
    return parties.withColumn("base", won(low)).join(more, keys, "left").select(*parties.columns, (F.col("base") + F.coalesce("more", F.lit(0))).cast("long").alias("quota"))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = 32, shard_words: int = 1 << 16, seed: int = 20240229, columns: list[str] | None = None) -> DataFrame:
    """df (or some of its columns) with size (words), source_size, target, taken and the spans taken.

    The words of a source are dealt into shards of about shard_words by a seeded hash of the id (a source that holds a third
    of all rows is many shards), laid end to end in a seeded order and cut into blocks of block words. Sainte-Lague
    apportions all blocks of the mix to the shards, with the targets as votes and cap times their blocks as the most. A shard's
    quota is whole passes over it plus a cyclic run of blocks from a seeded start, so documents stay whole but at
    the run's ends. Adds passes (whole passes), and from_word_1, to_word_1, from_word_2, to_word_2 (the spans of
    the run in the document, empty where from = to); taken counts repeats.

    Null texts have no words, a null source is a source of its own, and a null id is dealt like any value. Reruns agree: all is decided by
    ids, sizes and the seed (rows alike in id and size may swap places). Columns of these names are replaced; an empty table gives an empty result."""
    made = ["size", "source_size", "target", "taken", "passes", "from_word_1", "to_word_1", "from_word_2", "to_word_2"]
    # the caller's columns travel as one struct, so that no name of theirs meets one of ours
    carried = [c for c in columns or df.columns if c not in made]
    rows = cut(df.select(F.struct(*carried).alias("row"), F.col(doc_id).alias("id"), F.col(source).isNull().alias("no_source"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), word_count(text).alias("size")))
    from_source = ["no_source", "source"]
    per = rows.groupBy(*from_source).agg(F.sum("size").alias("source_size"))
    aimed = cut(targets(per, weights, share, cap).select(*from_source, "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).alias("n_shards")))
    dealt = rows.join(aimed, from_source).withColumn("shard", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("n_shards")))
    at = [*from_source, "shard"]
    shards = dealt.groupBy(*at).agg(F.sum("size").alias("words"), F.first("target").alias("t"), F.first("source_size").alias("s"))
    blocks = F.ceil(F.col("words") / block)
    parties = cut(shards.select(*at, "words", blocks.alias("blocks"), F.coalesce(F.try_divide(F.col("t") * F.col("words"), F.col("s") * block), F.lit(0.0)).alias("votes"), F.floor(blocks * cap).alias("most")))
    wanted = aimed.agg(F.sum("target")).first()[0] or 0.0
    some = F.greatest("blocks", F.lit(1))
    passes = F.floor(F.col("quota") / some)
    left = F.col("quota") - passes * F.col("blocks")
    start = F.pmod(F.xxhash64(*at, F.lit(seed)), some)
    run = quotas(parties, at, round(wanted / block)).select(
        *at, passes.alias("passes"), (start * block).alias("lo"), F.least((start + left) * block, "words").alias("hi"), (F.greatest(F.lit(0), start + left - F.col("blocks")) * block).alias("wrap")
    )
    order = Window.partitionBy(*at).orderBy(F.xxhash64("id", F.lit(seed + 1)), "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = dealt.withColumn("end", F.sum("size").over(order)).withColumn("begin", F.col("end") - F.col("size"))
    inside = lambda c: F.least(F.greatest(F.col(c) - F.col("begin"), F.lit(0)), F.col("size")).cast("long")
    spans = laid.join(run, at).withColumns({"from_word_1": inside("lo"), "to_word_1": inside("hi"), "from_word_2": F.lit(0).cast("long"), "to_word_2": inside("wrap")})
    length = lambda i: F.greatest(F.lit(0), F.col(f"to_word_{i}") - F.col(f"from_word_{i}"))
    return spans.withColumn("taken", (F.col("passes") * F.col("size") + length(1) + length(2)).cast("long")).select("row.*", *made)


def realise(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The mix as rows: a document's row once for each whole pass, and once more with the words of its spans,
    their separators kept, where the run takes a part of it. Adds nothing; rows that the mix does not take are gone,
    but a document without words stays as it is (it has nothing to take)."""
    names = [c for c in mixed.columns if c not in ("size", "source_size", "target", "taken", "passes", "from_word_1", "to_word_1", "from_word_2", "to_word_2")]
    whole = mixed.where(F.col("size") > 0).where(F.col("passes") > 0).withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("passes"))))
    part = mixed.where(F.col("taken") > F.col("passes") * F.col("size"))
    pieces = F.regexp_extract_all(text, F.lit(f"{SPACE_CLASS}*{WORD}"), F.lit(0))
    span = lambda i: F.slice("pieces_", F.col(f"from_word_{i}").cast("int") + 1, F.greatest(F.lit(0), F.col(f"to_word_{i}") - F.col(f"from_word_{i}")).cast("int"))
    all_of_it = F.col("taken") - F.col("passes") * F.col("size") == F.col("size")
    cut_text = F.when(all_of_it, F.col(text)).otherwise(F.array_join(F.concat(span(2), span(1)), ""))
    part = part.withColumn("pieces_", F.when(~all_of_it, pieces)).withColumn(text, cut_text)
    wordless = mixed.where(F.col("size") == 0)
    return whole.select(*names).unionByName(part.select(*names)).unionByName(wordless.select(*names))
