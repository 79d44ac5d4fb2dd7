"""From raw documents to a tokenised mix, in five stages; each works on all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbrook.llm import bpe, line_dedup, mixing, quality, simhash
from signalbrook.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rates as sound and clean with the probability asked for; the others go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs.select(*COLUMNS), labels).where("kept").select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that match an earlier one; n_chars follows the text. A document that has lost
    all its lines stays, empty, for the next stage to fold with others."""
    return line_dedup.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id (null ids last), of those that share it the one whose text's digest
    comes first. A document is a row's id and text: rows that repeat both count once, an id with two texts is two documents."""
    docs = docs.select(*COLUMNS)
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), F.coalesce(F.concat(F.lit("t"), "text"), F.lit("-"))).cast("binary"), 256)
    found = simhash.simhash_components(docs.select("doc_id", "text", key.alias("key")), carry=["key"])
    first = found.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("s")).select(F.col("s.key").alias("key"))
    return _once(docs.withColumn("key", key), cut(first.join(found.groupBy("key").agg(F.count("*").alias("rows")), "key"))).select(*COLUMNS)


def _once(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of some keys (key, rows: how many there are), one of each."""
    many = rows.join(keys.where("rows > 1").select("key"), "key", "left_semi").dropDuplicates(["key"])
    return rows.join(keys.where("rows = 1").select("key"), "key", "left_semi").unionByName(many)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents of favoured sources come again, others only as far as their source's quota goes; n_chars
    follows the text."""
    mixed = mixing.realise(mixing.mix(docs.select(*COLUMNS)))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and the digest of what they decode to."""
    return bpe.round_trip_digests(docs.select("doc_id", "lang", "source", "text"), keep_ids=True).select(
        "doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("simhash near-dedup", simhash_near_dedup),
    ("source mixing", source_mixing),
    ("byte-level bpe", bpe_tokens),
]

#: The classifier, XXH64 and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written and read again: a row for each document of the mix, with its token ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
