"""Helpers shared by the training-data operators: cut lineage, hash words, connect components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than these (space and tab to carriage return).
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = r"[^\x20\x09-\x0D]+"

_local_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the one given to SparkContext.setCheckpointDir. Only where
    driver and tasks are one process on one machine does a temporary folder take its place; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="signalbrook-"))
    return _local_dir[0]


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later stages start from files that
    outlive the executors which made them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, column: int = 0, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about limit bytes of text, at least a row each."""
    if not batch.num_rows:
        return
    text = batch.column(column)
    size = np.nan_to_num(np.asarray(pc.binary_length(text).to_numpy(zero_copy_only=False), dtype="f8"))
    block = (np.cumsum(size) // limit).astype("i8")
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_TAIL = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
#: Words longer than this are hashed one by one; shorter ones all at once, eight bytes at a time.
LONG = 64


class Words:
    """The words of a column of texts, as arrays.

    data: the bytes of all texts, a line feed between two; offsets: where each text begins, and one past the last one's end and line feed; starts, ends:
    of each word in data; row: the text that a word is in; n_rows: texts. Null texts count as empty."""

    def __init__(self, texts: pa.Array):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        self.n_rows = len(texts)
        size = np.asarray(pc.binary_length(texts), np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(size + 1)])
        whole = pa.LargeListArray.from_arrays(pa.array([0, self.n_rows]), texts)
        joined = pc.binary_join(whole, pa.scalar(b"\n", pa.large_binary())).buffers()[2] if self.n_rows else None
        n = max(int(self.offsets[-1]) - 1, 0)
        self.data = data = np.frombuffer(joined, np.uint8)[:n] if joined is not None else np.empty(0, np.uint8)
        solid = np.zeros(n + 2, bool)
        inner = solid[1:-1]
        np.not_equal(data, 0x20, out=inner)
        inner &= data - np.uint8(9) > 4
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        self.starts, self.ends = edges[::2].copy(), edges[1::2].copy()
        self.row = np.repeat(np.arange(self.n_rows), np.diff(np.searchsorted(self.starts, self.offsets)))

    def hashes(self, lower: bool = True, step: int = 1 << 16, key: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word (A-Z lowered if asked): its blocks of eight bytes, mixed in turn; XXH3 if it is long. Without a key, words with equal
        hashes can be made; a key that no text knows starts each size's words from a secret state, so that equal hashes come by chance only."""
        n = len(self.data)
        starts_at = np.arange(LONG + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) if key is None else np.random.default_rng(key).integers(0, 2**64, LONG + 2, np.uint64)
        padded = np.zeros(n + 16, np.uint8)
        padded[:n] = self.data
        if lower:
            padded += (padded - np.uint8(65) < 26) * np.uint8(32)
        eight = np.ndarray((n + 8,), "<u8", padded.data, strides=(1,))  # the eight bytes from each place on
        out = np.empty(len(self.starts), np.uint64)
        for a in range(0, len(out), step):
            start, size = self.starts[a : a + step], self.ends[a : a + step] - self.starts[a : a + step]
            h = eight[start]
            h &= np.take(_TAIL, size, mode="clip")
            h += np.take(starts_at, size, mode="clip")
            h = mix(h)
            more = np.flatnonzero((size > 8) & (size <= LONG))
            for k in range(8, LONG, 8):
                if not len(more):
                    break
                at, left = start[more] + k, size[more] - k
                h[more] = mix((h[more] + np.uint64(0x632BE59BD9B4E019)) ^ (eight[at] & np.take(_TAIL, left, mode="clip")))
                more = more[left > 8]
            for i in np.flatnonzero(size > LONG).tolist():
                h[i] = xxhash.xxh3_64_intdigest(padded[start[i] : start[i] + size[i]].tobytes(), key or 0)
            out[a : a + step] = h
        return out


def release() -> None:
    """Give back to the system what Arrow holds of memory that nothing uses any more: a driver that has collected a sample keeps it else."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """df written out, with leave to broadcast it if it has no more rows than limit."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= limit else df


#: A node is a hub beyond this many links, and beyond total / HUBS.
HUB, HUBS = 4096, 10_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a, b): links between long ids. Returns (id, component): each id that has a link, with the
    smallest id reachable from it.

    Large-star and small-star rounds as joins and grouped minima. A node with more than a HUBS-th of all links is a hub, of which
    there are 2 * HUBS at most: hubs' minima are broadcast, so that their links stay where they lie. Only the count and a
    checksum of the links reach the driver. Each round is cut to the shared folder.
    """

    def canon(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    def meet(rows: DataFrame, low: DataFrame, total: int) -> DataFrame:
        hub = F.col("n") > max(HUB, total // HUBS)
        hubs = F.broadcast(low.where(hub).select(F.col("k").alias("hub"), F.col("m").alias("hub_m")))
        at = rows.join(hubs, F.col("u") == F.col("hub"), "left")
        rest = at.where("hub IS NULL").join(low.where(~hub), F.col("u") == F.col("k")).select("u", "v", "m")
        return rest.unionByName(at.where("hub IS NOT NULL").select("u", "v", F.col("hub_m").alias("m")))

    def sign(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    links = cut(canon(edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))))
    last = sign(links)
    for _ in range(max_rounds):
        if not last[0]:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"), "n")
        large = canon(meet(both, low, 2 * last[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("k"), "m", "n")
        joined = meet(large, low, last[0])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("k").alias("u"), F.col("m").alias("v")))
        links = cut(canon(small))
        now = sign(links)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("the components did not settle")
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
