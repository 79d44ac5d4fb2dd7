"""Kinds of updates and their rules, labels kept, constraints of a probe, groups in pages and objects in files, against plain Python."""

import json
import random
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from signalbrook.model import SAMPLES
from signalbrook.operators import alerts as A
from signalbrook.operators import inventory as I
from signalbrook.operators import probes as P
from signalbrook.operators import selectors as S
from signalbrook.operators import updates as U
from signalbrook.sources import sinks

KIND = [
    ("1.2.3", "2.0.0", "major"), ("v1.2.3", "1.3", "minor"), ("1.2.3", "v1.2.10", "patch"), ("1.2.0-rc1", "1.2.0-rc2", "prerelease"), ("1.2-rc1", "1.2", "prerelease"),
    ("1.2", "1.2-rc1", None), ("1.2.3", "1.2.3", None), ("1.10", "1.9", None), ("2.0", "1.9.9", None), ("latest", "1.0", None), ("1.0", "latest", None), (None, "1.0", None), ("1.0", None, None), ("", "", None),
]


def test_kinds_of_updates(spark):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(KIND)], "id int, current string, new string")
    assert [r.kind for r in rows.select("id", U.update_kind("current", "new").alias("kind")).orderBy("id").collect()] == [k for *_, k in KIND]


def test_the_last_rule_that_holds_settles(spark):
    rules = [
        U.UpdateRule({"a": "1", "b": "1"}), U.UpdateRule({"a": "2"}, kinds=("major",)), U.UpdateRule({"b": "3"}, names=("x",), patterns=("lib.*",)),
        U.UpdateRule({"c": "4"}, below=(2,)), U.UpdateRule({"a": "5"}, names=("x",), kinds=("major", "minor")),
    ]
    data = [("x", "1.0", "2.0"), ("y", "1.0", "2.0"), ("lib-z", "1.0", "1.0.1"), ("a-lib", "1.0", "1.1"), (None, None, None), ("x", "1.0", "odd")]
    rows = spark.createDataFrame([(*r, "clash") for r in data], "package string, current string, new string, kind string")
    got = {(r.package, r.new): (r.kind, r.a, r.b, r.c) for r in U.settle(rows, rules).collect()}
    assert got == {
        ("x", "2.0"): ("major", "5", "3", None), ("y", "2.0"): ("major", "2", "1", None), ("lib-z", "1.0.1"): ("patch", "1", "3", "4"),
        ("a-lib", "1.1"): ("minor", "1", "1", "4"), (None, None): (None, "1", "1", None), ("x", "odd"): (None, "1", "3", None),
    }
    assert U.settle(rows, []).columns == rows.columns and U.settle(rows.limit(0), rules).count() == 0
    with pytest.raises(ValueError):
        U.settle(rows, [U.UpdateRule({"a": "1"}, kinds=("huge",))])


def test_labels_kept_and_families_off(spark):
    data = [("net_in", {"a": "1", "b": "2"}), ("net", {"a": "1"}), ("network", {"b": "3"}), ("disk_x", {"a": "1", "b": "2"}), ("disk_x", {"a": "1", "b": "4"}), (None, {"b": "5"}), ("disk_y", None)]
    rows = spark.createDataFrame([(m, labels, None, 1.0) for m, labels in data], SAMPLES)
    got = sorted((str(r.metric), r.labels) for r in S.keep_labels(S.drop_families(rows, "net"), ["a"], "disk_.*").select("metric", "labels").collect() if r.labels is not None)
    assert got == [("None", {"b": "5"}), ("disk_x", {"a": "1"}), ("disk_x", {"a": "1"}), ("network", {"b": "3"})]
    assert S.drop_families(rows).count() == len(data) and {len(r.labels or {}) for r in S.keep_labels(rows, [], "disk_.*").where("metric LIKE 'disk%'").collect()} == {0}


def test_constraints_of_a_probe(spark):
    data = [(200, True, 4, "get"), (200, True, 6, "GET"), (200, False, 4, "GET"), (500, True, 4, "GET"), (200, True, 4, "POST"), (None, True, 4, "GET"), (200, None, 4, "GET"), (200, True, None, "GET"), (200, True, 4, None)]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id int, status int, tls boolean, ip_version int, method string")

    def passed(**more):
        return {r.id for r in rows.where(P.reachable([200], **more)).collect()}

    assert passed(ip_version=4, methods=("GET",)) == {0}
    assert passed() == {0, 1, 4, 7, 8} and passed(tls=False) == {0, 1, 2, 4, 6, 7, 8}


def test_pages_of_a_group(spark):
    rng = random.Random(4)
    data = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(60)]), rng.choice(["x", "y", None, ""]), i) for i in range(500)]
    rows = spark.createDataFrame(data, "g string, at int, text string, page int").repartition(3)
    got = {(r.g, r.page): (r.n_alerts, r.message) for r in A.group_pages(rows, ["g"], "text", "at", 7, 10).collect()}
    want = {}
    for g in ("hot", "b", None):
        lines = [t for _, t in sorted((-1 if at is None else at, t or "") for k, at, t, _ in data if k == g)]
        for p in range(0, len(lines), 7):
            want[(g, p // 7)] = (len(lines[p : p + 7]), "\n".join(lines[p : p + 7]))
    assert got == want and A.group_pages(rows.limit(0), ["g"], "text", "at").count() == 0


def test_an_object_in_files(spark, tmp_path):
    data = {f'k"{i}\\\n': (None if i % 5 == 0 else f'v"{i}\n') for i in range(200)}
    rows = spark.createDataFrame([*data.items(), ("k\"1\\\n", "a smaller value")], "k string, v string").repartition(5)
    path = str(tmp_path / "object")
    sinks.write_object(rows, "k", "v", path)
    text = "".join(f.read_text() for f in sorted(Path(path).glob("part-*")))
    assert json.loads(text) == data and list(json.loads(text)) == sorted(data)
    assert [r.line for r in I.object_lines(rows.limit(0), "k", "v").collect()] == ["{}"]
    assert [r.line for r in I.object_lines(rows.limit(0).unionAll(spark.createDataFrame([("one", "1")], rows.schema)), "k", "v").collect()] == ['{"one":"1"}']
    with pytest.raises(PySparkException, match="null key"):
        I.object_lines(rows.withColumn("k", F.when(F.col("v").isNotNull(), F.col("k"))), "k", "v").collect()
