"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HUB, HUBS, connected_components, cut, slices, small

SEED = 42


def fingerprint(text: bytes | None, n: int = 3, chunk: int = 1 << 15) -> int:
    """The SimHash of a text's word n-grams: a bit is 1 if it is set in over half the n-grams' XXH64."""
    words = (text or b"").lower().split()  # on bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > n:
        starts, ends = starts[: len(words) - n + 1], ends[n - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), chunk):
        pairs = zip(starts[at : at + chunk].tolist(), ends[at : at + chunk].tolist(), strict=True)
        h = np.fromiter((digest(line[a:b], SEED) for a, b in pairs), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = 2 * ones > len(starts)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "simhash", n: int = 3) -> DataFrame:
    """Add out (long, the 64 bits as a signed number) for each whole text; null or wordless texts get 0.
    A column named like out is replaced."""
    df = df.drop(out)
    at = df.columns.index(text)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, at):
                raw = batch.column(at).cast(pa.binary()).to_pylist()
                made = np.fromiter((fingerprint(v, n) for v in raw), np.uint64, len(raw)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.LongType())]))


#: A segment's value that more fingerprints share than this is split by the other half's own segments.
CROWD = 2000


def _masks(radius: int, width: int) -> list[int]:
    found = {0}
    for _ in range(radius):
        found |= {m ^ (1 << i) for m in found for i in range(width)}
    return sorted(found)


def _radii(radius: int, segments: int) -> list[int]:
    """How far each segment is probed: if all but the last differed in more than radius // segments bits, the last would differ in the rest at
    most; a negative radius needs no probe."""
    ball = radius // segments
    return [ball] * (segments - 1) + [radius - (segments - 1) * (ball + 1)]


def near_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """prints(f long, distinct): all pairs a < b of fingerprints that differ in 1 to radius bits, by multi-index hashing.

    The 64 bits are cut into two halves, and each is probed within its own small ball, which misses nothing. One side enumerates the ball and
    the other stands in the table under its own value; the complete distance is verified at the match. Where a half's value is shared by more
    than CROWD fingerprints, they meet by a segment of the other half as well, probed within what is left of the radius. A ball holds at most 2,081
    values for radius 2, so that a fingerprint has at most that many partners, however large a group is."""
    half = lambda c, i: F.shiftrightunsigned(c, 32 * i).bitwiseAND(F.lit((1 << 32) - 1))
    piece = lambda c, i, j: F.shiftrightunsigned(half(c, i), 16 * j).bitwiseAND(F.lit((1 << 16) - 1))
    probes = []
    for i, r in enumerate(_radii(radius, 2)):
        probes += [F.struct(F.lit(i).alias("i"), half("f", i).bitwiseXOR(F.lit(m)).alias("v"), F.lit(radius - m.bit_count()).alias("left")) for m in (_masks(r, 32) if r >= 0 else [])]
    table = F.array(*[F.struct(F.lit(i).alias("i"), half("f", i).alias("v")) for i in (0, 1)])
    spread = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    standing = spread.select(F.col("f").alias("b"), F.explode(table).alias("k")).select("b", "k.i", "k.v")
    crowds = small(standing.groupBy("i", "v").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("i", "v", F.lit(True).alias("crowd")))
    none = F.array(F.struct(F.lit(-1).alias("j"), F.lit(0).cast("long").alias("w")))

    def by_piece(c: str, other: Column, left: int | None) -> Column:
        """The pieces of the other half, as the table has them, or probed within left."""
        radii = [0, 0] if left is None else _radii(left, 2)
        return F.array(*[F.struct(F.lit(j).alias("j"), F.when(other == 1, piece(c, 1, j)).otherwise(piece(c, 0, j)).bitwiseXOR(F.lit(m)).alias("w")) for j in (0, 1) if radii[j] >= 0 for m in _masks(radii[j], 16)])

    def pieces(rows: DataFrame, c: str, probing: bool) -> DataFrame:
        at, other = rows.join(crowds, ["i", "v"], "left"), 1 - F.col("i")
        made = by_piece(c, other, None)
        if probing:
            made = none
            for left in range(radius + 1):
                made = F.when(F.col("left") == left, by_piece(c, other, left)).otherwise(made)
        return at.select(c, "i", "v", F.explode(F.when(F.col("crowd"), made).otherwise(none)).alias("p")).select(c, "i", "v", "p.j", "p.w")

    asking = spread.select(F.col("f").alias("a"), F.explode(F.array(*probes)).alias("k")).select("a", "k.i", "k.v", "k.left")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    # the optimizer does not know how many rows a ball makes of one: neither side is to be broadcast
    met = pieces(asking, "a", True).hint("merge").join(pieces(standing, "b", False), ["i", "v", "j", "w"])
    return met.where((F.col("a") < F.col("b")) & (near <= radius)).select("a", "b").distinct()


def simhash_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, radius: int = 2, carry: list[str] | None = None) -> DataFrame:
    """One row per row of df: doc_id, simhash (long), component_id: the smallest id reachable over links between
    fingerprints at radius or fewer differing bits, part (long): a name of the component that is never null; and the columns to carry.

    Texts with the same fingerprint are one class from the start, so that a large group of copies costs one
    row; links and components are between classes only. Null and empty texts have fingerprint 0 and link like
    any other; rows that repeat an id each come back; a null id belongs to its class but cannot name it (a component of
    null ids only has a null component_id). An empty table gives an empty result."""
    carry = carry or []
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.struct(F.lit(0).alias("none_"), *carry).alias("carried_"))
    own = cut(fingerprints(rows, "text", n=n).drop("text"))
    classes = cut(own.groupBy("simhash").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    links = near_links(classes.select(F.col("simhash").alias("f")), radius)
    parts = connected_components(links)
    named = cut(classes.join(parts, F.col("simhash") == F.col("id"), "left").select("simhash", "least", "copies", F.coalesce("component", "simhash").alias("part")))
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    final = cut(named.join(least, "part").select("simhash", "component_id", "part", "copies"))
    # classes that hold a large share of the rows are broadcast, so that their rows stay where they lie
    held = F.col("copies") > max(HUB, own.count() // HUBS)
    large = F.broadcast(final.where(held).select(F.col("simhash").alias("s_"), F.col("component_id").alias("c_"), F.col("part").alias("p_")))  # HUBS rows at most
    at = own.join(large, F.col("simhash") == F.col("s_"), "left")
    out = ["doc_id", "simhash", "component_id", "part", *[f"carried_.{c}" for c in carry]]
    rest = at.where("s_ IS NULL").drop("s_", "c_", "p_").join(final.where(~held).drop("copies"), "simhash")
    return rest.select(*out).unionByName(at.where("s_ IS NOT NULL").withColumnsRenamed({"c_": "component_id", "p_": "part"}).select(*out))
