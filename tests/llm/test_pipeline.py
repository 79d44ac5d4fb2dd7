"""Each stage works on its own input; the whole gives tokens that decode to the mixed texts."""

import hashlib
import os
import random
import re

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from signalbrook.llm import bpe, mixing, quality, queries

from .helpers import DOCS, components, documents, words
from .test_documents import brute_lines, brute_print

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rng = random.Random(9)
    rows = documents(80)
    twin = next(r for r in rows if r[0] == 8)
    # null ids and repeated ids, with texts that are copies of others, alone, or both
    rows += [(None, twin[1], "en", "src1", None), (None, twin[1], "en", "src1", None), (None, "nobody else says this " * 4, "en", "src0", None), (8, "the same id with another text " * 3, "en", "src0", None), (9, twin[1], "en", "src2", None), twin]
    rows += [(2000 + i, " ".join(w.upper() + "!!" for w in words(r[1])), None, "src2", None) for i, r in enumerate(rows[:40]) if r[1]]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, DOCS).repartition(2).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], 0 if r[0] >= 2000 else 1, 0) for r in rows if r[0] is not None and rng.random() < 0.8]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == corpus_pipeline.COLUMNS
        seen[name] = (before.count(), docs.count())
        assert docs.where(F.col("n_chars") != F.length("text")).count() == 0 or name == "quality classifier"
    assert seen["quality classifier"][1] < seen["quality classifier"][0] and seen["line dedup"][0] == seen["line dedup"][1]
    assert seen["simhash near-dedup"][1] < seen["simhash near-dedup"][0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count()
    assert last.join(docs.select(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("decoded_sha256")), "decoded_sha256", "left_anti").count() == 0


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()), key=repr)


def test_each_stage_against_brute_force(spark, sf):
    """All five stages, each on what the one before it kept; the classifier's model and the mix's spans are given."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = []
    for _, stage in corpus_pipeline.STAGES:
        made.append((docs, stage(spark, docs, sf).cache()))
        docs = made[-1][1]
    docs, kept = made[0]
    model = quality.train(docs, quality.graded(spark.read.parquet(f"{sf}/labels.parquet")))
    tails = lambda t: model.grades(pa.array([t], pa.string()))[1][0][1]
    assert rows_of(kept) == [r for r in rows_of(docs) if tails(r[1]) >= 0.7]

    before, after = (rows_of(x) for x in made[1])
    gone = brute_lines(before)
    want = []
    for i, t, *rest in before:
        out = gone.get((-(2**63) if i is None else i, t), [])
        text = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in out)
        want.append((i, text, *rest[:2], None if text is None else len(text)))
    assert after == sorted(want, key=repr)

    before, after = (rows_of(x) for x in made[2])
    prints = {t: brute_print(t) for t in {r[1] for r in before}}
    fs = sorted(set(prints.values()))
    part = components(fs, [(a, b) for n, a in enumerate(fs) for b in fs[n + 1 :] if (a ^ b).bit_count() <= 2])
    groups = {}
    for r in before:
        digest = hashlib.sha256(("-" if r[0] is None else str(r[0])).encode() + b"|" + (b"-" if r[1] is None else b"t" + r[1].encode())).hexdigest()
        groups.setdefault(part[prints[r[1]]], []).append((r[0] is None, r[0] or 0, digest, r[:2]))
    assert sorted((r[:2] for r in after), key=repr) == sorted((min(g)[3] for g in groups.values()), key=repr)
    assert len(after) == len(groups) < len(before)

    before, after = made[3]
    want = []
    for r in mixing.mix(before).collect():
        pieces = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", r.text or "")
        want += [r.text] * (r.passes if r.size else 1)
        if r.taken > r.passes * r.size:
            some = pieces[r.from_word_2 : r.to_word_2] + pieces[r.from_word_1 : r.to_word_1]
            want.append(r.text if r.taken - r.passes * r.size == r.size else "".join(some))
    assert sorted(map(repr, want)) == sorted(repr(r[1]) for r in rows_of(after))

    before, after = made[4]
    ranks = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert sorted(map(repr, ((r.doc_id, r.ids) for r in after.collect()))) == sorted(repr((r[0], ranks.encode_ordinary(r[1] or ""))) for r in rows_of(before))


def test_one_survivor_of_each_group(spark):
    """Null ids and repeated ids bring no copy back."""
    t, other = "one text that stands again and again in rows of all kinds", "quite another text, which no other row says in any way"
    rows = [(3, t), (5, other), (5, t), (None, t), (None, "alone, without an id, and unlike all of the other rows here"), (None, t), (5, other)]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], DOCS)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()), key=repr)
    assert got == sorted([(3, t), (5, other), rows[4]], key=repr)


def test_run_gives_the_stages_rows(spark, sf):
    got, docs = corpus_pipeline.run(spark, sf), spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, docs.collect()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_over_whole_tables(spark, name):
    df = queries.QUERIES[name](spark, SF)
    if name.startswith("op11"):  # no row a document: each source of a language meets the others
        groups = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("coalesce(lang, '') lang", "coalesce(source, '') source").distinct().groupBy("lang").count()
        assert df.where("part = 'pair'").count() == sum(r["count"] * (r["count"] - 1) for r in groups.collect())
        return
    if name.startswith("op12"):
        assert df.count() == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
        return
    source = {"op3": "pages", "op2": "embeddings", "op8": "embeddings"}.get(name.split("_")[0], "documents")
    n = spark.read.parquet(f"{SF}/{source}.parquet").count()
    assert df.count() == (n // 100 * 10 if name.startswith("op8") else n)
