"""Exact top-k by inner product with vector-approximation files."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

SCALE = 1024
#: Pairs of a query and a candidate (32 bytes each) that are broadcast to the exact file; more are joined with it.
PAIRS = 400_000
#: Queries and candidates that meet in one matrix product.
TILE = (512, 4096)


def _valid(c: str):
    return F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def integers(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, ints (array<long>): floor(1024 * x) of each component, x as double; rows with a null id, or vectors that are null
    or hold null or non-finite components, take no part. A component beyond the longs (9e15 and more) is an error."""
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("e")).where(F.col("id").isNotNull() & _valid("e"))
    whole = lambda x: x.cast("double") * SCALE
    far = F.raise_error(F.lit("a component is too large for integer scores")).cast("long")
    return rows.select("id", F.transform("e", lambda x: F.when(F.abs(whole(x)) < 2.0**62, F.floor(whole(x))).otherwise(far)).alias("ints"))


def packed(vectors: DataFrame, kind: str) -> DataFrame:
    """The exact file: id, dim, digest (of the components) and v, the components as bytes of a numpy kind; rows that repeat stand once."""

    def run(batches):
        for b in batches:
            ints = b.column(1)
            n = np.asarray(pc.list_value_length(ints))
            parts = np.split(np.asarray(ints.flatten()).astype(kind), np.cumsum(n)[:-1]) if len(n) else []
            v = [p.tobytes() for p in parts]
            digest = [hashlib.blake2b(x, digest_size=16).digest() for x in v]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int32)), pa.array(digest, pa.binary()), pa.array(v, pa.binary())], names=["id", "dim", "digest", "v"])

    return vectors.select("id", "ints").mapInArrow(run, "id long, dim int, digest binary, v binary")


def approximated(exact: DataFrame, kind: str, width: int, low: int) -> DataFrame:
    """The approximation file: id, dim, digest and code, a byte a component: which of the cells of one width it lies in, from low on."""

    def run(batches):
        for b in batches:
            v = b.column(3).to_pylist()
            code = [((np.frombuffer(x, kind).astype(np.int64) - low) // width).astype(np.uint8).tobytes() for x in v]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(code, pa.binary())], names=["id", "dim", "digest", "code"])

    return exact.mapInArrow(run, "id long, dim int, digest binary, code binary")


class Block:
    """A block of queries, numbered, by length of vector: numbers, components, and what the cells' width can add to or take from a score; ids and
    digests by number. An id may have several vectors, each of which is a query."""

    def __init__(self, rows: list[tuple[int, int, bytes, bytes]], kind: str, width: int):
        self.by_dim = {}
        self.ids, self.digests = np.array([r[0] for r in rows], np.int64), [r[3] for r in rows]
        for d in {r[1] for r in rows}:
            own = [i for i, r in enumerate(rows) if r[1] == d]
            q = np.frombuffer(b"".join(rows[i][2] for i in own), kind).reshape(len(own), d).astype(np.float64)
            self.by_dim[d] = (np.array(own, np.int64), q, np.abs(q).sum(1) * (width - 1) / 2)


def centres(batch: pa.RecordBatch, block: Block, width: int, low: int):
    """For each tile: the queries' numbers, the candidates' rows in the batch, the scores at the cells' middles (-inf for a query's own row, which has its
    id and its vector), and by how much a true score can be off, rounding included."""
    ids, dims, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_pylist()
    for d, (no, q, slack) in block.by_dim.items():
        at = np.flatnonzero(dims == d)
        for a in range(0, len(at), TILE[1]):
            own = at[a : a + TILE[1]]
            mid = np.frombuffer(b"".join(codes[i] for i in own), np.uint8).reshape(len(own), d).astype(np.float64) * width + (low + (width - 1) / 2)
            size = np.abs(mid).max(initial=0)
            for z in range(0, len(no), TILE[0]):
                part = slice(z, z + TILE[0])
                centre = q[part] @ mid.T
                for i, j in zip(*np.nonzero(block.ids[no[part]][:, None] == ids[own][None, :])):
                    if block.digests[no[part][i]] == batch.column(2)[int(own[j])].as_py():
                        centre[i, j] = -np.inf
                off = slack[part] + 1e-12 * np.abs(q[part]).sum(1) * size + 1
                yield d, part, no[part], own, centre, off


def bars(codes: DataFrame, block, k: int, width: int, low: int) -> DataFrame:
    """query, bar: the k-th largest lower bound of each query (by number) of a block; a true k-th score is no lower. Tasks keep k bounds a query."""

    def run(batches):
        best: dict[int, np.ndarray] = {}
        for b in batches:
            for d, part, _, _, centre, off in centres(b, block.value, width, low):
                held = best.setdefault(d, np.full((len(block.value.by_dim[d][0]), k), -np.inf))
                both = np.concatenate([held[part], centre - off[:, None]], axis=1)
                held[part] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        for d, held in best.items():
            row, _ = np.nonzero(held > -np.inf)
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(block.value.by_dim[d][0][row]), pa.array(held[held > -np.inf])], names=["query", "bound"])

    bounds = codes.mapInArrow(run, "query long, bound double")
    order = Window.partitionBy("query").orderBy(F.col("bound").desc())
    return bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query", F.col("bound").alias("bar"))


def candidates_of(codes: DataFrame, block, bar, width: int, low: int) -> DataFrame:
    """query, id, digest, upper: the candidates whose upper bound reaches the query's bar (a broadcast dict; -inf where it has none)."""

    def run(batches):
        bar_of = bar.value
        for b in batches:
            digest = b.column(2)
            ids = b.column(0).to_numpy()
            for _, _, no, own, centre, off in centres(b, block.value, width, low):
                upper = centre + off[:, None]
                least = np.array([bar_of.get(x, -np.inf) for x in no.tolist()])
                i, j = np.nonzero((upper >= least[:, None]) & (centre > -np.inf))
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(no[i]), pa.array(ids[own[j]]), digest.take(pa.array(own[j])), pa.array(upper[i, j])], names=["query", "id", "digest", "upper"])

    return codes.mapInArrow(run, "query long, id long, digest binary, upper double")


def read_exactly(pairs: DataFrame, exact: DataFrame, block, kind: str) -> DataFrame:
    """query, query_id, vec_id, score of pairs (query, id, digest), from the exact file. The pairs are broadcast where they are few, so that the file is
    read where it lies."""

    def run(batches):
        place = {no: (d, i) for d, (numbers, _, _) in block.value.by_dim.items() for i, no in enumerate(numbers.tolist())}
        for b in batches:
            scores = []
            for no, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                d, i = place[no]
                scores.append(int(block.value.by_dim[d][1][i].astype(np.int64) @ np.frombuffer(v, kind).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(block.value.ids[b.column(0).to_numpy()]), b.column(1), pa.array(scores, pa.int64())], names=["query", "query_id", "vec_id", "score"])

    found = exact.join(small(pairs.select("query", "id", "digest"), PAIRS), ["id", "digest"]).select("query", F.col("id").alias("vec_id"), "v")
    return found.mapInArrow(run, "query long, query_id long, vec_id long, score long")


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, block: int = 16_384) -> DataFrame:
    """queries(id, ints) against all candidates(id, ints): query_id, rank (from 1), vec_id, score of the k best by
    integer inner product, ties to the smaller id; all, if fewer than k; a row is not its own candidate.

    The candidates are written once as two files: the exact vectors, and a byte for each component that says in which of 256 cells of one width
    it lies. Queries go in blocks of a bounded size. For each, the narrow file is scanned for bounds: the k-th largest lower bound rules out
    most candidates; of the others the 2k with the highest upper bounds are read exactly, and then those whose upper bound still
    reaches the k-th exact score: nothing else can be among the k best.

    Of equal vectors only the k + 1 smallest ids can appear in any result, so a large group of copies is cut to those first, exactly. Vectors of
    another length than the query's are not compared. An id may have several vectors: each is a query and a candidate of its own (a query's results then
    stand beside those of its id's other vectors), and only the row with both its id and its vector is a query's own; rows that repeat both
    count once. Scores must fit in a long:
    components for which they might not are an error. Empty inputs give an empty result."""
    spark = candidates.sparkSession
    most = lambda df: df.agg(F.max(F.greatest(F.array_max("ints"), -F.array_min("ints"))), F.max(F.size("ints"))).first()
    (size_c, dim_c), (size_q, dim_q) = most(candidates), most(queries)
    size, dim = max(size_c or 0, size_q or 0), max(dim_c or 0, dim_q or 0)
    if dim * size * size >= 2**62:
        raise ValueError(f"components up to {size} over {dim} dimensions: scores might not fit in a long")
    kind = "<i4" if size < 2**31 else "<i8"
    width, low = -(-(2 * size + 1) // 256), -size
    exact = cut(packed(candidates, kind).dropDuplicates(["id", "digest", "dim"]))
    same = Window.partitionBy("digest", "dim").orderBy("id")
    codes = approximated(exact, kind, width, low)
    codes = cut(codes.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    asked = cut(packed(queries, kind).dropDuplicates(["id", "digest", "dim"]))
    blocks = max(1, -(-asked.count() // block))
    results = None
    for i in range(blocks):
        rows = [(r.id, r.dim, bytes(r.v), bytes(r.digest)) for r in asked.where(F.pmod(F.xxhash64("id", "digest"), F.lit(blocks)) == i).select("id", "dim", "v", "digest").toLocalIterator()]
        own = spark.sparkContext.broadcast(Block(rows, kind, width))
        bar = spark.sparkContext.broadcast({r.query: r.bar for r in bars(codes, own, k, width, low).toLocalIterator()})
        upper = Window.partitionBy("query").orderBy(F.col("upper").desc(), "id", "digest")
        found = cut(candidates_of(codes, own, bar, width, low).withColumn("place", F.row_number().over(upper)))
        first = cut(read_exactly(found.where(F.col("place") <= 2 * k), exact, own, kind))
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
        certain = first.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query", F.col("score").alias("least"))
        rest = found.where(F.col("place") > 2 * k).join(certain, "query", "left").where(F.col("least").isNull() | (F.col("upper") >= F.col("least")))
        got = cut(first.unionByName(read_exactly(rest, exact, own, kind)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        results = got if results is None else results.unionByName(got)
    return results.select("query_id", "rank", "vec_id", "score")
