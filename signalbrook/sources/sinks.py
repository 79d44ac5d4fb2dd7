"""Writing: append history, keep the latest of each key, render files, send notifications from a stream."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import merge_labels
from ..operators.inventory import latest_by, object_lines
from ..operators.pieces import chained, next_of, numbered, summed
from .shared import settled


def with_external_labels(df: DataFrame, **labels: str) -> DataFrame:
    """The labels that every pushed row gets."""
    return df.withColumn("labels", merge_labels(F.col("labels"), F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])))


def append_history(df: DataFrame, path: str, day_of: str = "ts", max_rows: int = 0) -> None:
    """Append rows below a folder for each day, so that old days can be dropped whole; max_rows bounds a file."""
    writer = df.withColumn("day", F.to_date(day_of)).write.mode("append").partitionBy("day")
    (writer.option("maxRecordsPerFile", max_rows) if max_rows else writer).parquet(path)


def write_object(rows: DataFrame, key: str, value: str, path: str) -> None:
    """Write all rows as one JSON object: text files which, put together in the order of their names, are the object."""
    object_lines(rows, key, value).write.mode("overwrite").text(path)


def within_retention(df: DataFrame, now: str, days: int = 14) -> DataFrame:
    """The rows of the days that are still kept; a filter on the day's folder, so others are not read."""
    return df.where(F.col("day") > F.date_sub(F.lit(now).cast("date"), days))


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Current rows and changes, each key's latest."""
    return latest_by(current.unionByName(changes, allowMissingColumns=True), key, order)


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a function that makes its paths."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


class KeyedTable:
    """A table that keeps the latest row of each key, and takes batches of changes.

    Rows lie in buckets by a hash of the key, each bucket in a folder of its own. A manifest, versions of which are numbered files, names the
    folder of each bucket and the last batch of each writer. A batch reads and rewrites only the buckets that it has keys of, into new folders, and then
    puts the next version of the manifest in place by a rename that fails if it is there already: before it the table is as it was, after it the batch
    is in, and one that is sent again is known by its number and changes nothing. Two writers at once: the second fails and may try again.
    Folders that no manifest names are left; vacuum removes them."""

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, schema: str | None = None, buckets: int = 64):
        self.spark, self.path, self.key, self.order = spark, path.rstrip("/"), key, order
        self.fs, self.make = _files(spark, path)
        found = self._manifest()
        if found is None and schema is None:
            raise ValueError(f"no table at {path}; give a schema to make one")
        self.fresh = {"version": 0, "buckets": buckets, "schema": schema, "folders": {}, "batches": {}}

    def _manifest(self) -> dict | None:
        folder = self.make(f"{self.path}/manifest")
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        versions = [int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")]
        if not versions:
            return None
        return json.loads(self.spark.read.option("wholetext", True).text(f"{folder}/v{max(versions)}.json").first()[0])

    def _swap(self, manifest: dict) -> None:
        """Write the next version aside and rename it; it is there whole or not at all."""
        final, aside = self.make(f"{self.path}/manifest/v{manifest['version']}.json"), self.make(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = self.fs.create(aside)
        out.write(json.dumps(manifest).encode())
        out.close()
        if self.fs.exists(final) or not self.fs.rename(aside, final):
            self.fs.delete(aside, False)
            raise RuntimeError(f"another writer made version {manifest['version']}")

    def _read(self, manifest: dict, buckets: list[str]) -> DataFrame:
        paths = [f"{self.path}/{manifest['folders'][b]}" for b in buckets if b in manifest["folders"]]
        if not paths:
            return self.spark.createDataFrame([], manifest["schema"])
        return self.spark.read.schema(manifest["schema"]).parquet(*paths)

    def rows(self) -> DataFrame:
        manifest = self._manifest() or self.fresh
        return self._read(manifest, list(manifest["folders"]))

    def upsert(self, changes: DataFrame, batch: int, writer: str = "main") -> bool:
        """Take a batch of changes; false if this writer's batch of this number, or a later one, is in. Of a key's rows, in the table and in the batch,
        the one of the largest order stays. Null keys are left out."""
        manifest = self._manifest() or self.fresh
        if batch <= manifest["batches"].get(writer, -1):
            return False
        names = [f.name for f in self.spark.createDataFrame([], manifest["schema"]).schema]
        bucket = F.pmod(F.xxhash64(self.key), F.lit(manifest["buckets"])).cast("int")
        changes = settled(changes.select(*names).where(F.col(self.key).isNotNull()))
        touched = sorted(str(r[0]) for r in changes.select(bucket.alias("b")).distinct().collect())  # as many as there are buckets at most
        if touched:
            merged = upsert(self._read(manifest, touched), changes, self.key, self.order).select(*names, bucket.alias("bucket_"))
            folder = f"data/{uuid.uuid4().hex}"
            merged.repartition(len(touched), "bucket_").write.partitionBy("bucket_").parquet(f"{self.path}/{folder}")
            manifest = manifest | {"folders": manifest["folders"] | {b: f"{folder}/bucket_={b}" for b in touched}}
        self._swap(manifest | {"version": manifest["version"] + 1, "batches": manifest["batches"] | {writer: batch}})
        return True

    def target(self, writer: str = "stream") -> Callable[[DataFrame, int], None]:
        """For notify: each batch of a stream goes in once, whatever is repeated."""
        return lambda changes, number: self.upsert(changes, number, writer) and None

    def vacuum(self) -> int:
        """Remove the data that the current manifest does not name (nobody may be reading it); how many folders went."""
        used = {x.split("/")[1] for x in (self._manifest() or self.fresh)["folders"].values()}
        folder = self.make(f"{self.path}/data")
        gone = [f.getPath() for f in self.fs.listStatus(folder) if f.getPath().getName() not in used] if self.fs.exists(folder) else []
        for p in gone:
            self.fs.delete(p, True)
        return len(gone)


def rotated(lines: DataFrame, keys: list[str], order: str, limit: int, keep: int | None = None, line: str = "line", span: float = 65536) -> DataFrame:
    """Lines of each stream (keys) dealt to files as a log rotation would: a file takes lines in order until the next would bring it over limit bytes (a line
    and its end; a longer line is a file of its own). Adds file, from 0; with keep, only the last so many files of a stream come back.

    Bytes are summed up along a stream in pieces; each line points to the first that no longer fits in a file which it begins, and the files begin on the
    chain of these pointers from the first line. Null lines are empty. Lines of equal order stand by their text."""
    size = F.octet_length(F.coalesce(F.col(line), F.lit(""))).cast("long") + 1
    rows = settled(summed(numbered(lines, keys, order, [line], name="place_"), keys, size, "place_", span, "upto_"))
    begin = F.col("upto_") - size
    points = rows.select(*keys, F.col("upto_").alias("at"), F.col("place_").alias("to"))
    # the first line that ends beyond the limit from here on; an overlong one is followed by the next line
    asks = rows.select(*keys, F.col("place_").alias("a"), (begin + limit + 1).alias("at"))
    links = next_of(points, asks, keys, "at", "to", span * 64).select(*keys, "a", F.when(F.col("next_to").isNotNull(), F.greatest("next_to", F.col("a") + 1)).alias("b"))
    starts = chained(links, rows.groupBy(*keys).agg(F.min("place_").alias("a")), keys)
    starts = starts.select(F.struct(*keys).alias("s_"), F.col("a").alias("a_"), F.lit(1).alias("first_"))
    met = rows.join(starts, (F.struct(*keys) == F.col("s_")) & (F.col("place_") == F.col("a_")), "left")
    filed = summed(met.select(*rows.columns, F.coalesce("first_", F.lit(0)).alias("first_")), keys, F.col("first_"), "place_", span, "file_")
    filed = filed.select(*[c for c in lines.columns if c != "file"], (F.col("file_") - 1).alias("file"))
    if keep is None:
        return filed
    last = filed.groupBy(F.struct(*keys).alias("s_")).agg(F.max("file").alias("last_"))
    return filed.join(last, F.struct(*keys) == F.col("s_")).where(F.col("file") > F.col("last_") - keep).select(*filed.columns)


def write_rotated(lines: DataFrame, path: str, keys: list[str], order: str, limit: int, keep: int | None = None, line: str = "line") -> None:
    """rotated lines as text files, one to a folder stream/file, in order."""
    filed = rotated(lines, keys, order, limit, keep, line)
    text = filed.select(*keys, "file", order, F.coalesce(F.col(line), F.lit("")).alias("value"))
    dealt = text.repartition(*keys, "file").sortWithinPartitions(*keys, "file", order, "value")
    dealt.select(*keys, "file", "value").write.partitionBy(*keys, "file").text(path)


def close_regions(opened: DataFrame, closed: DataFrame, key: str = "id", start: str = "t0_ms", end: str = "t1_ms") -> DataFrame:
    """Annotation regions with the end that a later close gave them; a close without an opening is dropped."""
    ends = closed.groupBy(key).agg(F.max(end).alias("end_"))
    return opened.join(ends, key, "left").withColumn(end, F.coalesce("end_", F.col(end))).drop("end_")


def rendered(head: str, lines: str | Column, tail: str = "") -> Column:
    """A file's text: a head, an array's elements one to a line, a tail."""
    body = F.array_join(F.col(lines) if isinstance(lines, str) else lines, "\n")
    return F.concat(F.lit(head), body, F.lit(tail))


def notify(stream: DataFrame, checkpoint: str, *targets: Callable[[DataFrame, int], None], trigger: str = "30 seconds"):
    """Start a stream that hands each batch to all targets in turn (a webhook, an on-call service); a batch that a failure
    repeats has the same number, by which a target can tell."""

    def send(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for target in targets:
                target(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()
