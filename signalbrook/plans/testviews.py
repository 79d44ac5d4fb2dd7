"""The driver's tables seen as telemetry: events as samples and logs, orders as probes, nations as an inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _instance():
    return (F.col("user_id") % 10).cast("string")


def gauge(spark: SparkSession, sf_dir: str, *more: Callable[[DataFrame], Column]) -> DataFrame:
    """Metric g: an event's value, labelled with its type as job and a digit of its user as instance; and further columns of the events."""
    e = table(spark, sf_dir, "events")
    labels = F.create_map(F.lit("job"), F.col("event_type"), F.lit("instance"), _instance())
    return e.select(F.lit("g").alias("metric"), labels.alias("labels"), "ts", "value", "event_id", *[c(e) for c in more])


def counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric c_total: how many events a series has had, starting anew after every 50."""
    e = table(spark, sf_dir, "events").withColumn("instance", _instance())
    n = F.row_number().over(Window.partitionBy("event_type", "instance").orderBy("ts", "event_id"))
    labels = F.create_map(F.lit("job"), F.col("event_type"), F.lit("instance"), F.col("instance"))
    return e.select(F.lit("c_total").alias("metric"), labels.alias("labels"), "ts", ((n - 1) % 50 + 1).cast("double").alias("value"), "event_id")


def up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric up by instance: 0 for an error, else 1."""
    e = table(spark, sf_dir, "events")
    labels = F.create_map(F.lit("instance"), _instance(), F.lit("job"), F.lit("up"))
    return e.select(F.lit("up").alias("metric"), labels.alias("labels"), "ts", F.when(F.col("event_type") == "error", 0.0).otherwise(1.0).alias("value"), "event_id")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each event, of which every third user's ends in a ban."""
    e = table(spark, sf_dir, "events")
    ip = F.concat(F.lit("198.51.100."), _instance())
    ban = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit(" : 4h ban on Ip "), ip)).otherwise(F.lit(""))
    line = F.concat(F.lit('level=info msg="(m) alert : '), F.col("event_type"), F.lit(" by ip "), ip, F.lit(" (US/64500)"), ban, F.lit('"'))
    return e.select("ts", F.concat(F.lit("h"), (F.col("user_id") % 2).cast("string")).alias("host"), F.lit("proxy").alias("stack"), F.col("event_type").alias("service"), F.lit("c").alias("container"), line.alias("line"), "event_id")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a probe result; even orders are web checks, odd ones name lookups."""
    o = table(spark, sf_dir, "orders")
    web = F.col("o_orderkey") % 2 == 0
    return o.select(
        "o_orderkey", F.when(web, F.when(F.col("o_orderstatus") == "F", 200).otherwise(302)).cast("int").alias("status"),
        F.when(~web, F.col("o_orderpriority")).alias("body"), F.when(~web, F.when(F.col("o_orderstatus") == "F", "NXDOMAIN").otherwise("NOERROR")).alias("dns_rcode"),
        F.when(web, F.col("o_custkey") * 1000).alias("cert_expiry_s"),
        F.when(web, F.array(F.lit("[STATUS] == 200"), F.lit("[CERTIFICATE_EXPIRATION] > 48h"))).otherwise(F.array(F.lit("[DNS_RCODE] == NOERROR"), F.lit("[BODY] == 1-URGENT"))).alias("conditions"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation for each instance and hour that has events: whether any of them is an error."""
    e = table(spark, sf_dir, "events").withColumn("instance", _instance()).withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return e.groupBy("instance", "hour").agg(F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("bad")).withColumn("cond", F.col("bad") == 1)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and nations as an inventory: all, its regions, their nations as hosts; even nations are in group vm too."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    top = r.select(F.lit("all").alias("parent"), F.col("r_name").alias("child"), F.lit(False).alias("is_host"))
    hosts = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"), F.lit(True).alias("is_host"))
    vm = n.where(F.col("n_nationkey") % 2 == 0).select(F.lit("vm").alias("parent"), F.col("n_name").alias("child"), F.lit(True).alias("is_host"))
    return top.unionByName(hosts).unionByName(vm)
