"""Reading logs, samples, probe results and configuration."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import basename
from ..model import LOGS, SAMPLES


def log_files(spark: SparkSession, path: str, labels: dict[str, str] | None = None, with_file: bool = False, stream: bool = False) -> DataFrame:
    """The lines of text files (globs too; new files join a stream as they appear), with constant labels as columns and, if
    asked, the name of the file each line is from."""
    reader = spark.readStream if stream else spark.read
    df = reader.text(path).withColumnRenamed("value", "line")
    for k, v in (labels or {}).items():
        df = df.withColumn(k, F.lit(v))
    return df.withColumn("file", basename(F.col("_metadata.file_path"))) if with_file else df


def json_logs(spark: SparkSession, path: str, schema: T.StructType = LOGS, stream: bool = False) -> DataFrame:
    """Log records written as JSON lines, under a declared schema."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).json(path)


def samples(spark: SparkSession, path: str, job: str | None = None, stream: bool = False) -> DataFrame:
    """Samples stored as Parquet; a job's name becomes a label of all of them."""
    df = (spark.readStream if stream else spark.read).schema(SAMPLES).parquet(path)
    return df if job is None else df.withColumn("labels", F.map_concat(F.map_filter("labels", lambda k, _: k != "job"), F.create_map(F.lit("job"), F.lit(job))))


def json_document(spark: SparkSession, path: str) -> DataFrame:
    """One row for each whole JSON document."""
    return spark.read.option("multiLine", True).json(path)


def panels(document: DataFrame) -> DataFrame:
    """The queries of a dashboard document: panel title, type and each target's expression."""
    each = document.select(F.explode("panels").alias("p"))
    return each.select(F.col("p.title").alias("panel"), F.col("p.type").alias("kind"), F.explode("p.targets").alias("t")).select("panel", "kind", F.col("t.expr").alias("expr"))


def yaml_rows(spark: SparkSession, text: str, at: Iterable[str], key: str, schema: T.StructType) -> DataFrame:
    """A map of objects within a YAML text (a configuration file, read on the driver) as rows: the map's key and the fields
    of the schema; a field that is missing is null."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs the yaml module") from e
    node = yaml.safe_load(text)
    for part in at:
        node = node[part]
    fields = [f for f in schema.fieldNames() if f != key]
    rows = [(k, *[(v or {}).get(f) if isinstance(v, dict) else v for f in fields]) for k, v in node.items()]
    return spark.createDataFrame(rows, T.StructType([T.StructField(key, T.StringType()), *[schema[f] for f in fields]]))


def inventory(spark: SparkSession, text: str) -> DataFrame:
    """An inventory's groups as edges(parent, child, is_host), from a YAML text of groups with hosts and children."""
    import yaml

    edges: list[tuple[str, str, bool]] = []

    def walk(name: str, group: dict | None) -> None:
        for host in (group or {}).get("hosts") or {}:
            edges.append((name, host, True))
        for child, below in ((group or {}).get("children") or {}).items():
            edges.append((name, child, False))
            walk(child, below)

    for name, group in yaml.safe_load(text).items():
        walk(name, group)
    return spark.createDataFrame(edges, "parent string, child string, is_host boolean")


def yaml_documents(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The documents of YAML files (a folder, a glob; new files join a stream): path, nth (of the documents of a file), body (the document as JSON; null where
    the file cannot be read) and error (why not). Spark lists and reads the files, in as many tasks as it cuts them into, and each is parsed where it is read;
    the driver has only their names. Tags that YAML itself does not know count as the values that they stand before, as text where those are scalars."""
    reader = (spark.readStream if stream else spark.read).option("recursiveFileLookup", True)
    files = reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        class Loader(yaml.SafeLoader):
            """SafeLoader that takes tagged values as they are."""

        def plain(loader, suffix, node):
            made = {yaml.MappingNode: loader.construct_mapping, yaml.SequenceNode: loader.construct_sequence}.get(type(node))
            return made(node, deep=True) if made else node.value

        Loader.add_multi_constructor("", plain)
        for batch in batches:
            out = []
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    bodies = [json.dumps(x, default=str, ensure_ascii=False) for x in yaml.load_all(text, Loader)]
                    out += [(name, i, x, None) for i, x in enumerate(bodies)]
                except (yaml.YAMLError, TypeError, ValueError, RecursionError) as e:
                    out.append((name, 0, None, f"{type(e).__name__}: {e}"))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["path", "nth", "body", "error"])

    return files.mapInArrow(parse, "path string, nth int, body string, error string")


def yaml_entries(documents: DataFrame, at: Iterable[str], key: str, schema: T.StructType) -> DataFrame:
    """The entries of a map within each of yaml_documents, as rows: path, the map's key, and the fields of the schema (null where they are missing)."""
    fields = T.StructType([f for f in schema.fields if f.name != key])
    where = "$" + "".join(f"['{p}']" for p in at)
    node = F.get_json_object("body", where)
    each = documents.select("path", F.explode(F.from_json(node, T.MapType(T.StringType(), T.StringType()))).alias(key, "entry_"))
    return each.select("path", key, F.from_json("entry_", fields).alias("e_")).select("path", key, *[F.col("e_").getField(f.name).alias(f.name) for f in fields])


def yaml_edges(documents: DataFrame, levels: int = 12) -> DataFrame:
    """Inventories among yaml_documents as edges(parent, child, is_host): groups with hosts and children, up to so many levels deep."""
    group = "map<string,struct<hosts:map<string,string>,children:string>>"
    below = documents.select(F.explode(F.from_json("body", group)).alias("parent", "g"))
    out = []
    for _ in range(levels):
        out.append(below.select("parent", F.explode(F.map_keys("g.hosts")).alias("child"), F.lit(True).alias("is_host")))
        children = below.select("parent", F.explode(F.from_json("g.children", group)).alias("child", "g"))
        out.append(children.select("parent", "child", F.lit(False).alias("is_host")))
        below = children.select(F.col("child").alias("parent"), "g")
    return reduce(DataFrame.unionAll, out).distinct()


def json_rows(column: str | Column, schema: str) -> Column:
    """Rows of a command's JSON output held in a string column, as an array of structs."""
    return F.from_json(column, schema)


def output_lines(column: str | Column) -> Column:
    """The lines of a command's output that are not empty, as an array."""
    return F.filter(F.split(column, "\n"), lambda x: x != "")


def files_with(spark: SparkSession, path: str, pattern: str, glob: str = "*") -> DataFrame:
    """Paths of the files below a folder whose content has a match."""
    df = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True)
    return df.where(F.col("value").rlike(pattern)).select(F.col("_metadata.file_path").alias("path"))


def required(name: str, message: str = "") -> str:
    """A setting from the environment that must not be empty."""
    value = os.environ.get(name, "")
    if not value:
        raise ValueError(message or f"{name} is not set")
    return value


#: A request as a web firewall hands it on.
REQUESTS = "ts timestamp, method string, host string, path string, query string, ip string, user_agent string, status int"


def requests(spark: SparkSession, path: str, streaming: bool = False, schema: str = REQUESTS) -> DataFrame:
    """Requests from JSON lines, as a table or as a stream of new files; a line that does not fit gives nulls."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).json(path)
