"""Vector operators and the URL filter against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalbrook.llm import embedding_dedup, topk, url_filter

from .helpers import components

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n=300, dim=24, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype("f4")
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    for i in range(0, 60):
        rows.append((n + i, (x[i % 6] + rng.normal(0, rng.choice([0.02, 0.1, 0.2]), dim)).astype("f4").tolist(), None))
    rows += [(n + 100 + i, x[7].tolist(), 0) for i in range(15)]
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, 1), (901, [0.0] * dim, 1), (902, [nan] * dim, 1), (903, [inf] + [1.0] * (dim - 1), 1), (904, [None] + [1.0] * (dim - 1), 1), (905, [], 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1)]
    rows += [(3, rows[3][1], 0)]
    return rows


def usable(rows):
    return [(i, np.array(v, "f8")) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]


def brute_links(rows, threshold=0.9):
    out = []
    for a, (i, x) in enumerate(rows):
        for b, (j, y) in enumerate(rows):
            if a < b and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                out.append((a, b))
    return out


@pytest.mark.parametrize("block", [1024, 8])
def test_near_duplicates(spark, block):
    rows = vectors()
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS).withColumn("n_links", F.lit(1)), block=block).collect()
    fit = usable(rows)
    links = brute_links(fit)
    part = components(sorted({i for i, _ in fit}), [(fit[a][0], fit[b][0]) for a, b in links])
    n = [0] * len(fit)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got)
    assert found <= sum(n) and found >= 0.9 * sum(n)
    alone = {r[0] for r in rows} - {i for i, _ in fit}
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in got if r.vec_id in alone)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    same = sum(r.component_id == part[r.vec_id] for r in got if r.vec_id in part)
    assert same >= 0.95 * sum(r.vec_id in part for r in got)


def test_estimates_are_unbiased_and_bounded():
    """Over random rotations of one pair the estimate's mean is the inner product."""
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((2, 48))
    x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
    y = 0.8 * x + 0.6 * (y - (x @ y) * x) / np.linalg.norm(y - (x @ y) * x)
    seen = []
    for i in range(300):
        p = embedding_dedup.rotation(48, i)
        r = x @ p
        seen.append((np.sign(r) / np.sqrt(48)) @ (y @ p) / (np.abs(r).sum() / np.sqrt(48)))
    assert abs(np.mean(seen) - x @ y) < 0.02


@pytest.mark.parametrize("bits", [8, 16])
def test_recall_of_many_cells(spark, monkeypatch, bits):
    """Pairs planted just above the threshold, at the numbers of bits that large tables have."""
    rng = np.random.default_rng(bits)
    plan = lambda rows, threshold, recall, cell: (bits, embedding_dedup.math.ceil(embedding_dedup.math.log(0.02) / embedding_dedup.math.log(1 - (1 - embedding_dedup.math.acos(threshold) / embedding_dedup.math.pi) ** bits)))
    monkeypatch.setattr(embedding_dedup, "plan", plan)
    x = rng.standard_normal((120, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = rng.uniform(0.902, 0.915, (120, 1))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, c * x + np.sqrt(1 - c * c) * z]).astype("f4"))]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    found = sum(got[i + 120].component_id == i for i in range(120))
    assert found >= 0.94 * 120
    assert all(r.n_links <= 1 for r in got.values())


@pytest.mark.parametrize("block", [1024, 8])
@pytest.mark.parametrize("kind", ["float", "double"])
def test_all_pairs_if_asked(spark, block, kind):
    """recall=1 misses nothing; null ids, doubles, and lengths whose squares overflow."""
    rows = [*vectors(80), (None, [1.0] * 24, 0), (2000, [3e38 if kind == "float" else 1e200] * 24, 0), (2001, [1e-40 if kind == "float" else 1e-200] * 24, 0)]
    df = spark.createDataFrame(rows, VECTORS.replace("array<float>", f"array<{kind}>"))
    got = embedding_dedup.near_duplicates(df, recall=1, block=block).collect()
    fit = [(i, x / np.abs(x).max()) for i, x in usable([r for r in rows if r[0] is not None])]
    if kind == "float":
        fit = [(i, x / np.abs(x).max()) for i, x in ((i, np.array(v, "f4").astype("f8")) for i, v, _ in rows if i is not None and v and all(y is not None and np.isfinite(y) for y in v) and any(np.array(v, "f4")))]
    links = brute_links(fit)
    part = components(sorted({i for i, _ in fit}), [(fit[a][0], fit[b][0]) for a, b in links])
    n = {}
    for a, b in links:
        for k in (a, b):
            n[fit[k][0]] = n.get(fit[k][0], 0) + 1
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id in part and r.vec_id != 3:  # 3 stands twice
            assert (r.n_links, r.component_id) == (n.get(r.vec_id, 0), part[r.vec_id])
        elif r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)


def test_bounds_rule_out_no_link():
    """Codes of random pairs at the threshold: the upper bound reaches it."""
    rng = np.random.default_rng(5)
    x = embedding_dedup.unit(rng.standard_normal((3000, 33)))
    z = rng.standard_normal(x.shape)
    z = embedding_dedup.unit(z - (z * x).sum(1, keepdims=True) * x)
    y = 0.9 * x + np.sqrt(0.19) * z
    import pandas as pd

    def side(v):
        code, step, factor, missed = embedding_dedup.codes_of(v)
        return pd.DataFrame({"code": [c.tobytes() for c in code], "step": step, "factor": factor, "missed": missed})

    kept = 0
    for a in range(0, 3000, 300):
        i, j = embedding_dedup.undecided(side(x[a : a + 300]), side(y[a : a + 300]), 33, 0.9)
        kept += len(set(zip(i.tolist(), j.tolist())) & {(k, k) for k in range(300)})
        assert len(i) < 0.2 * 300 * 300
    assert kept >= 2998


def brute_top(rows, queries, k=10):
    ints = {i: np.floor(1024 * np.array(v, "f8")).astype("i8") for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in queries:
        if q in ints:
            best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 50])
def test_exact_top_k(spark, block):
    rows = vectors()
    df = topk.integers(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(df.where("id % 10 = 0"), df, 10, block).collect())
    assert got == brute_top(rows, [i for i in range(0, 1000, 10)])


def test_the_bounds_leave_few_to_read(spark):
    """Most vectors are ruled out by their cells alone, and none that belongs to the result."""
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.standard_normal((2000, 32)).astype("f4"))]
    df = topk.integers(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding")
    kind, size = "<i4", max(int(abs(np.floor(1024 * np.array(v))).max()) for _, v, _ in rows)
    width, low = -(-(2 * size + 1) // 256), -size
    exact = topk.packed(df, kind)
    codes = topk.approximated(exact, kind, width, low)
    asked = [(r.id, r.dim, bytes(r.v), bytes(r.digest)) for r in exact.where("id % 500 = 0").collect()]
    block = spark.sparkContext.broadcast(topk.Block(asked, kind, width))
    bars = {r.query: r.bar for r in topk.bars(codes, block, 10, width, low).collect()}
    left = topk.candidates_of(codes, block, spark.sparkContext.broadcast(bars), width, low).collect()
    assert {(q, i) for q, _, i, _ in brute_top(rows, [0, 500, 1000, 1500])} <= {(asked[r.query][0], r.id) for r in left}
    assert len(left) < 0.03 * 4 * len(rows)


def test_top_k_where_ids_have_several_vectors(spark):
    """Each vector of an id is a query, and a candidate of the id's others; rows that repeat both stand once."""
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.standard_normal(8).astype("f4").tolist(), 0) for i in rng.integers(0, 40, 120)]
    rows += rows[:20] + [(0, [-9.0] * 8, 0), (0, [9.0] * 8, 0)]
    ints = sorted({(i, tuple(np.floor(1024 * np.array(v, "f4").astype("f8")).astype(int).tolist())) for i, v, _ in rows})
    df = topk.integers(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(df.where("id % 10 = 0"), df, 5, 7).collect())
    want = []
    for q, x in (r for r in ints if r[0] % 10 == 0):
        best = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ints if (i, y) != (q, x))[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == sorted(want) and len({(r[0], r[3]) for r in got if r[1] == 1}) > len({r[0] for r in got})


@pytest.mark.parametrize("recall", [1, 0.999])
def test_near_duplicates_where_ids_have_several_vectors(spark, recall):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((6, 16))
    near = lambda i: (base[i] + rng.normal(0, 0.02, 16)).astype("f4").tolist()
    rows = [(5, near(0), 0), (2, near(0), 0), (5, near(1), 0), (7, near(2), 0), (3, near(2), 0), (7, near(3), 0), (1, near(3), 0), (9, near(4), 0), (9, near(4), 0), (9, near(5), 0), (8, near(5), 0)]
    rows += [(4, rows[2][1], 0), (5, rows[2][1], 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS), recall=recall).collect())
    links = brute_links(usable(rows))
    part = components(range(len(rows)), links)
    least = {c: min(rows[i][0] for i in range(len(rows)) if part[i] == c) for c in part.values()}
    want = sorted((r[0], sum(i in x for x in links), least[part[i]], r[0] == least[part[i]]) for i, r in enumerate(rows))
    assert got == want and {(5, 1, 2, False), (5, 2, 4, False)} <= set(got)


def test_top_k_of_awkward_vectors(spark):
    """Ties, copies, large components and columns named like the operator's own; and scores that no long holds."""
    rows = [(i, [float(i % 3), -1e5, 2.0**18], None) for i in range(60)] + [(100 + i, [1e5, 5.0, float(i % 2)], None) for i in range(30)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("mine") for c in ("id", "code", "digest", "score", "rank", "dim", "v", "query_id")})
    ints = topk.integers(df, "vec_id", "embedding")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(ints.where("id % 20 = 0").withColumn("upper", F.lit(1)), ints, 10).collect())
    exact = {i: [int(np.floor(1024 * x)) for x in v] for i, v, _ in rows}
    want = []
    for q in sorted(i for i in exact if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(exact[q], v)), i) for i, v in exact.items() if i != q)[:10]
        want += [(q, n, i, -x) for n, (x, i) in enumerate(best, 1)]
    assert got == sorted(want)
    large = topk.integers(spark.createDataFrame([(1, [3e12, 1.0], 0), (2, [2e12, 1.0], 0)], VECTORS), "vec_id", "embedding")
    with pytest.raises(ValueError):
        topk.exact_top_k(large, large)
    with pytest.raises(Exception, match="too large"):
        topk.integers(spark.createDataFrame([(1, [3e18], 0)], VECTORS), "vec_id", "embedding").collect()


URLS = [
    ("http://A.Example.NET/en/1?x=/de/", "a.example.net", "/en/1", "example.net/en/"), ("https://x.net/", "x.net", "/", "net/"), ("https://x.net", "x.net", "", None),
    ("http://example.com/de/1#top", "example.com", "/de/1", "example.com/de/"), ("http://badexample.com/de/1", "badexample.com", "/de/1", None), ("ftp://é.org/fr/ü", "é.org", "/fr/ü", "org/fr/"),
    ("no scheme/path", "", "", None), ("", "", "", None), (None, "", "", None), ("http://h?q://z/y", "h", "", None), ("http://h#f", "h", "", None), ("a://b://c", "b:", "//c", None), ("http://x.net/a\nb?c", "x.net", "/a\nb", "net/"), ("http://" + "h" * 3000 + ".net/" + "p" * 5000, "h" * 3000 + ".net", "/" + "p" * 5000, "net/"),
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "mine", "mine") for i, (u, *_) in enumerate(URLS)] * 2, "page_id long, url string, host string, verdict string")
    got = url_filter.judge(df).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        _, host, path, rule = URLS[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (url_filter.RULES[rule] if rule else "block" if r.block_probability >= 0.5 else "allow")
    assert url_filter.judge(df.limit(0)).count() == 0


def test_url_model_on_urls_it_has_not_seen(tmp_path):
    import pyarrow as pa

    assert url_filter.held_out_error() <= 0.15
    w, b = url_filter.train()
    rows = url_filter.read_labelled()
    assert np.mean([(p >= 0.5) == bool(y) for p, (_, y) in zip(url_filter.probabilities(pa.array([t for t, _ in rows]), w, b), rows)]) >= 0.98
    (tmp_path / "own.csv").write_text('url,block\n"http://A.example/X,y?z",1\nnone,0\n')
    assert url_filter.read_labelled(tmp_path / "own.csv") == [("a.example/X,y", 1), ("", 0)]


def test_urls_may_hold_any_characters(spark):
    """Characters that mark a text's ends elsewhere neither fail nor move the others' rows, and long urls come in parts."""
    urls = ["http://b\x02c.com/y", "http://a.example/\x02\x03\x00", "\x02://\x02", None, "http://plain.example/q", "http://" + "\x02" * 50 + "/"] + [f"http://h{i}.example/" + "p\x02" * 40_000 for i in range(60)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").coalesce(1)
    got = {r.page_id: r.block_probability for r in url_filter.judge(df).collect()}
    alone = {i: url_filter.judge(df.where(f"page_id = {i}")).first().block_probability for i in (0, 1, 3, 4, 5, 65)}
    assert len(got) == len(urls) and all(got[i] == pytest.approx(p, abs=1e-9) for i, p in alone.items())
    assert got[0] != got[4]


def test_url_column_of_any_name(spark):
    df = spark.createDataFrame([("http://A.b/c",), (None,)], "`u``r.l` string")
    assert [(r.host, r.path) for r in url_filter.judge(df, "u`r.l").collect()] == [("a.b", "/c"), ("", "")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert embedding_dedup.near_duplicates(none).count() == 0
    rows = topk.integers(none, "vec_id", "embedding")
    assert topk.exact_top_k(rows, rows).count() == 0
