"""Near-duplicate embeddings from randomised-rotation binary codes with correction factors."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut
from .topk import _valid

#: Standard errors that an estimate may be off before a pair is ruled out unseen.
BOUND = 4.0
#: Pairs that are recomputed exactly at once.
EXACT = 1 << 14


def rotation(dim: int, i: int) -> np.ndarray:
    """The i-th random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([2024, i]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def plan(rows: int, threshold: float, recall: float, cell: int) -> tuple[int, int]:
    """Bits to a cell and number of tables: about cell rows to a cell, and a pair just at the threshold meets in one
    of the tables with probability recall. A recall of 1 is one cell for all rows."""
    if recall >= 1:
        return 0, 1
    bits = min(60, max(8, int(math.log2(max(rows, 1) / cell)) if rows > cell else 8))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def cell_keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The cell of each unit vector in each table, by the signs after random rotations."""
    n, d = x.shape
    if not bits:
        return np.zeros((n, 1), np.int64)
    signs = np.concatenate([x @ rotation(d, 1 + r) > 0 for r in range(-(-bits * tables // d))], axis=1)[:, : bits * tables]
    return signs.reshape(n, tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def codes_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The code of each unit vector after rotation: a nibble a component, of which the highest bit is the sign (two to a byte); the nibbles' step; the
    correction factor, the inner product of a vector and its signs; and the length of what the nibbles miss."""
    d = x.shape[1]
    y = x @ rotation(d, 0)
    step = np.maximum(np.abs(y).max(1), 1e-30) / 8 * (1 + 1e-9)
    q = np.clip(np.floor(y / step[:, None]), -8, 7).astype(np.int64) + 8
    missed = np.linalg.norm(y - (q - 7.5) * step[:, None], axis=1)
    if d % 2:
        q = np.concatenate([q, np.zeros((len(q), 1), np.int64)], axis=1)
    return (q[:, ::2] * 16 + q[:, 1::2]).astype(np.uint8), step, np.abs(y).sum(1) / math.sqrt(d), missed


def decoded(code: np.ndarray, step: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rotated vectors as the nibbles have them, and the unit vectors of their signs."""
    q = np.stack([code >> 4, code & 15], axis=2).reshape(len(code), -1)[:, :dim].astype(np.float32)
    return (q - 7.5) * step[:, None].astype(np.float32), np.where(q >= 8, 1, -1).astype(np.float32) / math.sqrt(dim)


def encode(ids: pa.Array, e: list[np.ndarray], dtype: str, bits: int, tables: int) -> pa.RecordBatch:
    """The exact file's rows of vectors (finite, not zero), with their codes and cells."""
    n = np.array([len(v) for v in e], np.int64)
    raw = [(v + 0.0).astype(dtype).tobytes() for v in e]
    digest = [hashlib.blake2b(v, digest_size=16).digest() for v in raw]
    code, step, factor, missed, keys = [b""] * len(e), np.zeros(len(e)), np.ones(len(e)), np.zeros(len(e)), [[]] * len(e)
    for d in np.unique(n).tolist():
        at = np.flatnonzero(n == d)
        x = unit(np.stack([e[i] for i in at]).astype("f8"))
        own, step[at], factor[at], missed[at] = codes_of(x)
        key = cell_keys(x, bits, tables)
        for j, i in enumerate(at):
            code[i], keys[i] = own[j].tobytes(), key[j]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n.astype(np.int32)), pa.array(digest, pa.binary()), pa.array(raw, pa.binary()), pa.array(code, pa.binary()), pa.array(step.astype("f4")), pa.array(factor.astype("f4")), pa.array(missed.astype("f4")), pa.array(keys, pa.list_(pa.int64()))],
        names=["vec_id", "dim", "digest", "e", "code", "step", "factor", "missed", "keys"],
    )


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def undecided(a: pd.DataFrame, b: pd.DataFrame | None, dim: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs between two sides, or within one if b is None, whose upper confidence bound reaches the threshold. The estimate of an
    inner product from one vector's signs and correction factor is unbiased; its error is bounded by BOUND standard errors, and by all that the
    other's nibbles miss."""
    other = a if b is None else b
    read = lambda x: decoded(np.frombuffer(b"".join(x.code), np.uint8).reshape(len(x), -1), x.step.to_numpy(), dim)
    (own, signs), f = read(a), a.factor.to_numpy().astype("f4")[:, None]
    turned = own if b is None else read(b)[0]
    estimate = (signs @ turned.T) / f
    error = BOUND * np.sqrt(np.maximum(0, 1 - f * f)) / f / math.sqrt(max(1, dim - 1)) + 1e-4
    i, j = np.nonzero(estimate + other.missed.to_numpy().astype("f4")[None, :] / f + error >= threshold)
    return (i[i < j], j[i < j]) if b is None else (i, j)


def blocks_of(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray | None]:
    """The rows of a block pair's two sides; the second is None where a block meets itself."""
    first = pdf.iloc[0]
    at_a = np.flatnonzero(pdf.own == first.bi)
    return at_a, None if first.bi == first.bj else np.flatnonzero(pdf.own == first.bj)


def wanted(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The rows of a block pair that have an undecided pair there: theirs are the vectors to read."""
    pdf = pdf.sort_values(["id"], kind="stable").reset_index(drop=True)
    a, b = blocks_of(pdf)
    has = np.zeros(len(pdf), bool)
    if len(a) and (b is None or len(b)):
        i, j = undecided(pdf.iloc[a], None if b is None else pdf.iloc[b], int(pdf.dim.iloc[0]), threshold)
        has[a[i]] = True
        has[(a if b is None else b)[j]] = True
    return pdf.loc[has, [*AT, "own", "id", "digest"]]


AT = ["dim", "t", "key", "bi", "bj"]
MET = "dim int, t int, key long, bi long, bj long, own long, id long, digest binary"


def compare(pdf: pd.DataFrame, dtype: str, threshold: float) -> pd.DataFrame:
    """A block pair's links, as one row for each class (by its number, id) that has any: how many vectors it links with here, and the
    smallest number of its component here. No pairs leave the block. Pairs that met in an earlier table are left to it."""
    none = pd.DataFrame({"id": [], "links": [], "root": []}).astype("int64")
    dim, table = int(pdf.dim.iloc[0]), int(pdf.t.iloc[0])
    at_a, at_b = blocks_of(pdf)
    if len(pdf) < 2 or not len(at_a) or (at_b is not None and not len(at_b)):
        return none
    x = unit(np.frombuffer(b"".join(pdf.e), dtype).reshape(-1, dim).astype("f8"))
    keys = np.stack(pdf["keys"].to_numpy())
    ids, copies = pdf.id.to_numpy(), pdf.copies.to_numpy()
    n, root = np.zeros(len(pdf), np.int64), ids.copy()
    other = at_a if at_b is None else at_b
    linked = []
    for a in range(0, len(at_a), 1024):
        rough = x[at_a[a : a + 1024]] @ x[other].T
        i, j = np.nonzero(rough >= threshold - 1e-9)
        i += a
        if at_b is None:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), EXACT):
            p, q = at_a[i[s : s + EXACT]], other[j[s : s + EXACT]]
            dot = np.einsum("nd,nd->n", x[p], x[q])
            # a pair within rounding of the threshold is decided on the vectors as they are
            close = np.flatnonzero(np.abs(dot - threshold) < 1e-9)
            for c in close.tolist():
                u, v = (np.frombuffer(pdf.e.iloc[k[c]], dtype).astype("f8") for k in (p, q))
                dot[c] = exact_cosine(u, v)
            keep = (dot >= threshold) & ~(keys[p, :table] == keys[q, :table]).any(1)
            linked.append((p[keep], q[keep]))
    i, j = (np.concatenate([x[k] for x in linked]) if linked else np.empty(0, np.int64) for k in range(2))
    np.add.at(n, i, copies[j])
    np.add.at(n, j, copies[i])
    while True:
        low = np.minimum(root[i], root[j])
        if (root[i] == low).all() and (root[j] == low).all():
            break
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
    has = n > 0
    return pd.DataFrame({"id": ids[has], "links": n[has], "root": root[has]})


def exact_cosine(u: np.ndarray, v: np.ndarray) -> float:
    """The cosine in doubles, as a dot product over two lengths; scaled by powers of two, which changes no digit."""
    u, v = (np.ldexp(w, -int(np.frexp(np.abs(w).max())[1])) for w in (u, v))
    return float(np.dot(u, v) / (math.sqrt(np.dot(u, u)) * math.sqrt(np.dot(v, v))))


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, recall: float = 0.98, cell: int = 2048, block: int = 1024) -> DataFrame:
    """One row per row of df: vec_id, n_links (other vectors at cosine >= threshold found), component_id (the smallest id
    reachable over links, itself included) and kept (vec_id = component_id).

    Equal vectors are one class with a count from the start. Classes meet in cells of hash tables keyed by
    signs after random rotations; their number follows from the recall asked for a pair just at the threshold. Only codes travel to the
    cells (half a byte a component); confidence bounds tell which rows have a pair that they cannot decide, and the vectors of those alone
    are read for exact cosines. A large cell is dealt into blocks that meet pair by pair, so a group that holds a third of all rows is spread
    over tasks; counts and each block's components leave a block, never its pairs. Every link given is exact. With recall=1 all rows
    share one cell and every pair is computed: exact, at a cost that grows with the square of the rows.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
    lengths do not link. Rows that repeat an id each count as a vector. A null id takes no part and is its own
    (null) component. An empty table gives an empty result; other columns are ignored."""
    double = dict(df.dtypes)[embedding] == "array<double>"
    dtype, kind = ("<f8", pa.float64()) if double else ("<f4", pa.float32())
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>" if double else "array<float>").alias("e"))
    fit = F.col("vec_id").isNotNull() & _valid("e") & F.exists("e", lambda x: x != 0)
    fit = F.coalesce(fit, F.lit(False))
    bits, tables = plan(rows.where(fit).count(), threshold, recall, cell)

    def pack(batches):
        for b in batches:
            e = b.column("e")
            flat, ends = np.asarray(e.flatten().cast(kind)), np.cumsum(np.asarray(pc.list_value_length(e)))
            if len(ends):
                yield encode(b.column("vec_id"), np.split(flat, ends[:-1]), dtype, bits, tables)

    packed = cut(rows.where(fit).mapInArrow(pack, "vec_id long, dim int, digest binary, e binary, code binary, step float, factor float, missed float, keys array<long>"))
    short = ["code", "step", "factor", "missed", "keys"]
    # a class of equal vectors has a number of its own, as an id may have several vectors; the smallest id comes back in at the end
    grouped = packed.groupBy("dim", "digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value(F.struct(*short)).alias("c"))
    classes = cut(grouped.select("dim", "digest", "least", "copies", F.monotonically_increasing_id().alias("id"), "c.*"))
    each = F.posexplode("keys").alias("t", "key")
    large = classes.select("dim", each).groupBy("dim", "t", "key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("dim", "t", "key", F.ceil(F.col("n") / block).alias("parts"))
    spread = classes.select("dim", "id", "digest", "code", "step", "factor", "missed", each).join(large, ["dim", "t", "key"], "left")
    parts = F.coalesce("parts", F.lit(1))
    met = (
        spread.withColumn("own", F.pmod(F.xxhash64("digest"), parts))
        .withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        .select("dim", "t", "key", F.least("own", "with").alias("bi"), F.greatest("own", "with").alias("bj"), "own", "id", "digest", "code", "step", "factor", "missed")
    )
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if bits:
        met = met.repartition(n, *AT).groupBy(*AT).applyInPandas(lambda pdf: wanted(pdf, threshold), MET)
    else:  # all pairs are computed
        met = met.select(*AT, "own", "id", "digest")
    own = classes.select("dim", "digest", F.col("least").alias("vec_id"), "id", "copies", "keys")
    exact = packed.select("dim", "digest", "vec_id", "e").join(own, ["dim", "digest", "vec_id"]).dropDuplicates(["id"])
    read = cut(met).join(exact.drop("vec_id"), ["dim", "digest", "id"]).select(*AT, "own", "id", "copies", "e", "keys")
    found = cut(read.repartition(n, *AT).groupBy(*AT).applyInPandas(lambda pdf: compare(pdf, dtype, threshold), "id long, links long, root long"))
    components = cut(connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))))
    smallest = components.join(classes.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("smallest"))
    named = components.join(smallest, "component").select("id", "smallest")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    per_class = (
        classes.join(counts, "id", "left")
        .join(named, "id", "left")
        .select("dim", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("component_id"))
    )
    linked = packed.select("vec_id", "dim", "digest").join(per_class, ["dim", "digest"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
