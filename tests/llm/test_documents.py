"""The operators on documents against brute force, on awkward rows."""

import collections
import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from signalbrook.llm import bpe, common, line_dedup, lm, mixing, quality, sharding, simhash
from signalbrook.llm.common import Words, connected_components

from .helpers import DOCS, components, documents, low, words


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def unique(rows):
    """Rows whose ids name them."""
    seen = set()
    return [r for r in rows if r[0] is not None and not (r[0] in seen or seen.add(r[0]))]


def clashing(df):
    """df with further columns named like those that operators add or use."""
    names = ["shard", "slot", "n_lines", "removed", "size", "target", "taken", "kept", "n_tokens", "score", "part_", "doc", "line", "id_", "copies", "component_id", "simhash", "row", "id", "votes", "quota", "n_shards", "blocks", "begin", "end", "lo"]
    return df.withColumns({n: F.lit("mine") for n in names})


def test_line_dedup_of_words_made_to_collide(spark):
    """Words whose fixed hashes are equal are two words to a line: under the key of a run they differ."""
    import pyarrow as pa

    a, b = "4wsjlbcaabababab", "u9iynfapjrw*!o>m"
    h = Words(pa.array([a, b]))
    assert len(set(h.hashes().tolist())) == 1 and len(set(h.hashes(key=7).tolist())) == 2
    rows = [(1, f"{a} {b} aa bb"), (2, f"{a} {b} aa bb yy"), (3, f"{a} one two three"), (4, f"{b} one two three"), (5, f"{a} " + "w" * 100)]
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0}


def test_word_hashes_agree_with_words(rows):
    import pyarrow as pa

    w = Words(pa.array([r[1] for r in rows]))
    h = w.hashes()
    got = collections.defaultdict(set)
    at = 0
    for i, r in enumerate(rows):
        for x in words(r[1]):
            assert w.row[at] == i
            got[x].add(int(h[at]))
            at += 1
    assert at == len(h) and all(len(v) == 1 for v in got.values())
    assert len({next(iter(v)) for v in got.values()}) == len(got)


def thue_morse(n):
    """A word of n letters and its complement, which every polynomial hash modulo 2^64 with an odd base takes for one."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]


MORSE = thue_morse(2048)


def brute_lines(rows, threshold=0.8):
    order = sorted({(-(2**63) if r[0] is None else r[0], r[1]) for r in rows if r[1] is not None})
    earlier, out = [], {}
    for i, t in order:
        for n, line in enumerate(t.split("\n")):
            s = frozenset(words(line))
            if not s:
                continue
            hit = any(len(s & x) / len(s | x) >= threshold for x in earlier)
            if hit:
                out.setdefault((i, t), []).append(n)
            earlier.append(s)
    return out


def test_line_dedup(docs, rows):
    got = line_dedup.dedup_lines(docs.withColumn("copy", F.col("text"))).collect()
    want = brute_lines(rows)
    assert len(got) == len(rows)
    for r in got:
        gone = want.get((-(2**63) if r.doc_id is None else r.doc_id, r["copy"]), [])
        assert [e.line for e in r.removed] == gone and r.n_removed == len(gone)
        left = None if r["copy"] is None else "\n".join(x for n, x in enumerate(r["copy"].split("\n")) if n not in gone)
        assert r.text == left


def test_line_dedup_tells_words_apart(spark):
    """Words that are hard on hashes; equal sets in other orders, other cases and other spaces; long lines."""
    rng = random.Random(11)
    long = [f"l{i}" for i in range(1500)]
    lines = [*MORSE, "x " + MORSE[0], "x " + MORSE[1], "b a", "A  b", "a b c", "c\tB a", "one", "One", "one one", " ".join(long), " ".join(rng.sample(long, 1400)), " ".join(rng.sample(long, 1100))]
    rows = [(i, x, None, None, None) for i, x in enumerate(lines)]
    want = brute_lines(rows)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert {r.doc_id: [e.line for e in r.removed] for r in got} == {r[0]: want.get((r[0], r[1]), []) for r in rows}


def test_line_dedup_of_one_line_everywhere(spark):
    """A line that most documents hold, over many tasks, in rows that repeat; and clashing columns."""
    rng = random.Random(12)
    rows = [(i % 70 if i % 2 else i, f"the common line of all\nown {rng.random()} {i}\nThe common LINE of all", None, None, None) for i in range(200)]
    rows += rows[:20]
    want = brute_lines(rows)
    got = line_dedup.dedup_lines(clashing(spark.createDataFrame(rows, DOCS).repartition(9).withColumn("copy", F.col("text")))).collect()
    assert len(got) == len(rows) and all([e.line for e in r.removed] == want.get((r.doc_id, r["copy"]), []) for r in got)
    assert all(r.shard == "mine" and r.n_lines == 3 for r in got)


def test_line_search_asks_again_and_in_blocks(spark, monkeypatch):
    """A token that stands in many sets, and candidates that fail, lose no match."""
    rng = random.Random(5)
    known = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.sample(known, 12)) + f" rare{i % 3}", None, None, None) for i in range(300)]
    rows += [(400 + i, rows[i][1] + " extra", None, None, None) for i in range(0, 60, 7)]
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    want = brute_lines(rows)
    assert got == {r[0]: len(want.get((r[0], r[1]), [])) for r in rows}


def brute_print(text, n=3):
    w = low(text or "").encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_postings_meet_whatever_else_their_rows_hold():
    """A token's postings go to one group from rows with tokens of long lists and from rows without."""
    hot = (np.array([7], np.uint64), np.array([3]))

    def made(tokens):
        row = {"doc": np.array([1]), "version": np.array([0]), "line": np.array([0], np.int32), "size": np.array([9], np.uint16), "parity": np.array([0], np.uint64)}
        return line_dedup.postings(row | {"posts": np.array([len(tokens)]), "token": np.array(tokens, np.uint64), "place": np.arange(len(tokens)).astype(np.uint16)}, hot)["h"]

    assert made([5])[0] in made([5, 7]) and len(made([5, 7])) == 4
    assert set(made([7])) <= set(made([5, 7]))


def test_simhash(docs, rows):
    got = simhash.simhash_components(clashing(docs)).collect()
    prints = {t: brute_print(t) for t in {r[1] for r in rows}}
    fs = sorted(set(prints.values()))
    links = [(a, b) for i, a in enumerate(fs) for b in fs[i + 1 :] if (a ^ b).bit_count() <= 2]
    part = components(fs, links)
    least = {}
    for r in rows:
        if r[0] is not None:
            p = part[prints[r[1]]]
            least[p] = min(least.get(p, r[0]), r[0])
    want = collections.Counter((r[0], prints[r[1]], least.get(part[prints[r[1]]])) for r in rows)
    assert collections.Counter((r.doc_id, r.simhash % 2**64, r.component_id) for r in got) == want


def test_near_links_miss_nothing(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(20)]
    fs = {b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(12)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fs]
    for radius in (1, 2, 3):
        got = {(r.a, r.b) for r in simhash.near_links(spark.createDataFrame([(f,) for f in signed], "f long"), radius).collect()}
        assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= radius}


def test_near_links_of_a_crowd(spark, monkeypatch):
    """100,000 fingerprints share a half; what is near another among them is found, across both halves."""
    rng = random.Random(21)
    crowd = {(0x1234ABCD << 32) | rng.getrandbits(32) for _ in range(100_000)}
    planted = set()
    for f in rng.sample(sorted(crowd), 200):
        g = f ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 2)))
        planted.add((min(f, g), max(f, g)))
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    fs = crowd | {f for p in planted for f in p}
    got = {tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in simhash.near_links(spark.createDataFrame([(signed(f),) for f in fs], "f long")).collect()}
    assert planted <= got and all(0 < (a ^ b).bit_count() <= 2 for a, b in got)
    few = sorted(fs)[:300] + [f ^ (1 << i) for i, f in enumerate(sorted(fs)[:40])]
    monkeypatch.setattr(simhash, "CROWD", 3)
    got = {(r.a, r.b) for r in simhash.near_links(spark.createDataFrame([(signed(f),) for f in set(few)], "f long")).collect()}
    every = [signed(f) for f in set(few)]
    assert got == {(a, b) for a in every for b in every if a < b and ((a ^ b) % 2**64).bit_count() <= 2}


def test_components_around_a_hub(spark, monkeypatch):
    """Links of which most lead to one node, and some to nodes behind it."""
    monkeypatch.setattr(common, "HUB", 8)
    monkeypatch.setattr(common, "HUBS", 4)
    links = [(7, i) for i in range(100, 400)] + [(i, i + 1000) for i in range(150, 180)] + [(2000, 1160), (3, 2000), (5000, 5001)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()}
    assert got == components({x for e in links for x in e}, links)


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(150)] + [(400, 400 + i) for i in range(1, 50)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components({x for e in links if e[0] != e[1] for x in e}, links)
    assert got == want


@pytest.mark.parametrize("space", [" ", "\n", " \n", "\u00a0\t", "\u2003"])
def test_bpe_of_long_white_space(spark, space):
    """Cut as the pattern would: checked on runs that it can still take itself, and then on ten megabytes of them."""
    ranks = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    run = space * (12_000 // len(space))
    texts = [run, f"one{run}two", f"{run}a", f"{run}1 b", f"a{run}", f"x{run}!{run}\x1f{run}y's{run}", f"a {run}", f"{run}\n", "it's" + run + "'s"]
    assert [bpe.encode_text(ranks, t, limit) for t in texts for limit in (100, 1 << 16)] == [ranks.encode_ordinary(t) for t in texts for _ in range(2)]
    long = space * (10_000_000 // len(space))
    df = spark.createDataFrame([(0, long), (1, f"word{long}word"), (2, f"{long}a")], "doc_id long, text string")
    for r in bpe.round_trip_digests(df).collect():
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest() and r.n_tokens > 0


def test_bpe(spark, rows):
    ranks = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert isinstance(ranks, tiktoken.Encoding)
    df = spark.createDataFrame(rows, DOCS)
    for limit in (1 << 16, 40, 3):
        for r in bpe.round_trip_digests(df, limit=limit, keep_ids=True).collect():
            ids = ranks.encode_ordinary(r.text or "")
            assert r.ids == ids and r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(clashing(df), "text"))
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
    parts = spark.createDataFrame([([31753],), (None,), ([10, 11],)], "ids array<int>")
    assert [bytes(r.decoded) for r in bpe.decode(parts).collect()] == [ranks.decode_bytes(x or []) for x in ([31753], None, [10, 11])]


def test_sharding(docs, rows):
    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"))
    mine = {n: F.lit("mine") for n in ("shard", "slot", "row", "own", "part", "bytes", "first", "place", "key_0")}
    got = sharding.assign_shards(sized.withColumns(mine), "size", ["doc_id", "size"], 16).collect()
    assert len(got) == len(rows)
    total = sum(r["size"] for r in got)
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r["size"])
    run = 0
    by = collections.defaultdict(list)
    for r in sorted(got, key=key):
        assert r.shard == min(15, run * 16 // total)
        by[r.shard].append(r.slot)
        run += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, wanted = set(), share * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = (wanted - sum(cap * sizes[s] for s in full)) / sum(w[s] for s in rest) if rest else 0
        over = {s for s in rest if w[s] * level > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else w[s] * level for s in names}
        full |= over


def test_mixing(docs, rows):
    mixed = mixing.mix(clashing(docs), block=8, shard_words=256)
    got = mixed.collect()
    again = mixing.mix(docs.repartition(5), block=8, shard_words=256).collect()
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "", r.taken)
    assert [(r.doc_id, r.taken) for r in sorted(got, key=key)] == [(r.doc_id, r.taken) for r in sorted(again, key=key)]
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = brute_targets(dict(sizes))
    taken = collections.Counter()
    for r in got:
        assert r["size"] == len(words(r.text)) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 8 * 8 for s in want)
    made = mixing.realise(mixing.mix(docs, block=8, shard_words=256)).collect()
    assert sum(len(words(r.text)) for r in made) == sum(taken.values())


def test_sainte_lague(spark):
    rng = random.Random(8)
    votes = [rng.uniform(0, 50) for _ in range(30)] + [7.0, 7.0, 7.0, 0.0]
    most = [rng.randint(0, 60) for _ in votes]
    df = spark.createDataFrame([(i, v, m) for i, (v, m) in enumerate(zip(votes, most))], "k int, votes double, most long")
    for seats in (0, 1, 57, 400, 10_000):
        heap = [(-v, i) for i, v in enumerate(votes) if v > 0]
        heapq.heapify(heap)
        want = [0] * len(votes)
        while heap and sum(want) < seats:
            _, i = heapq.heappop(heap)
            if want[i] < most[i]:
                want[i] += 1
                heapq.heappush(heap, (-votes[i] / (2 * want[i] + 1), i))
        got = {r.k: r.quota for r in mixing.quotas(df, ["k"], seats).collect()}
        assert [got[i] for i in range(len(votes))] == want, seats


def test_language_model(spark, docs, rows):
    rows = [*rows, (2001, MORSE[0], None, None, None), (2005, MORSE[1], None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(rows[-2:], DOCS))
    got = lm.score_corpus(clashing(docs)).collect()
    toks = lambda t: [*words(t), None]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(x for r in rows if not out(r[0]) for x in toks(r[1]))
    n, v = sum(c.values()), len(c)
    want = collections.Counter((r[0], out(r[0]), len(toks(r[1])), sum(c[x] > 0 for x in toks(r[1])), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in toks(r[1])), 4)) for r in rows)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_quality(spark):
    rng = random.Random(6)
    from .helpers import lexicon, prose

    known = lexicon()
    rows, labels = [], []
    for i in range(900):
        text, kind = prose(rng, rng.randint(20, 80), known), i % 3
        if kind == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif kind == 1:
            parts = text.split()
            for _ in range(4):
                parts.insert(rng.randrange(len(parts)), "vile" + rng.choice(["an", "er", "on"]))
            text = " ".join(parts)
        rows.append((i, text, None, None, None))
        if i % 2:
            labels.append((i, 0 if kind == 0 else 1, 1 if kind == 1 else 0))
    labels += [(None, 1, 0), (5, None, None), (7, 1, None)]
    rows += [(2000, None, None, None, None), (2001, "", None, None, None)]
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(clashing(docs), table).collect()
    assert len(got) == len(rows)
    right = [r.kept == (r.doc_id % 3 == 2) for r in got if r.doc_id < 900 and r.doc_id % 2 == 0]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    grades = [np.mean([r.expected_grade for r in got if r.doc_id < 900 and r.doc_id % 3 == k]) for k in range(3)]
    assert grades == sorted(grades)


def brute_features(text):
    """What the quality classifier sees in a text, a word at a time: the hash of each feature, and its value."""
    import pyarrow as pa

    from signalbrook.llm.common import mix

    one = lambda x: np.array([x], np.uint64)
    found, shares, last = {}, collections.Counter(), None
    raw = [x.encode() for x in re.findall(mixing.WORD, text or "")]
    for w in raw:
        own = int(Words(pa.array([w.decode()])).hashes()[0])
        found[own] = 1.0
        head = 1 << 43
        for k in range(4):
            c = w[k] if k < len(w) else 256
            head = (head * 257 + (c + 32 if 65 <= c <= 90 else c)) % 2**64
        found[int(mix(one(head))[0])] = 1.0
        shares[w[-1] * 256 + (w[-2] if len(w) > 1 else 0) + (1 << 40)] += 1
        kinds = 0
        for c in w:
            kinds |= 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 4 if 48 <= c <= 57 else 8 if c >= 128 else 0 if c in b",." else 16
        shares[kinds + (1 << 41)] += 1
        shares[1 << 42] += own == last
        last = own
    n = max(1, len(raw))
    return found | {int(mix(one(k))[0]): 4 * v / n for k, v in shares.items() if v}


def test_quality_against_brute_force(docs, rows):
    """Features, scores and probabilities a word at a time; long texts, ties, repeated rows."""
    import pyarrow as pa

    texts = sorted({r[1] for r in rows if r[1] is not None}) + ["Same same same 12,5 Ünï!", "same"]
    row, h, value = quality.features(pa.array(texts))
    for i, t in enumerate(texts):
        assert {int(a): pytest.approx(float(b), rel=1e-5) for a, b in zip(h[row == i], value[row == i])} == brute_features(t)
    known = np.unique(h)
    rng = np.random.default_rng(4)
    m = quality.Model(known, rng.normal(0, 0.3, len(known)).astype("f4"), np.array([-0.5, 1.0]))
    weight = dict(zip(known.tolist(), m.weights.tolist()))
    got = {r.text: r for r in quality.score(docs.where("text IS NOT NULL"), m).collect()}
    for t in texts[:-2]:
        s = sum(weight.get(k, 0) * v for k, v in brute_features(t).items())
        below = [1 / (1 + math.exp(-min(40, max(-40, c - s)))) for c in m.thresholds]
        each = [below[0], below[1] - below[0], 1 - below[1]]
        assert got[t].tail_probability == pytest.approx(each[2], abs=1e-4) and got[t].expected_grade == pytest.approx(each[1] + 2 * each[2], abs=1e-4)


def test_quality_steps_follow_the_likelihood():
    """Descending without a penalty, the likelihood's own slopes vanish, the thresholds stay in order, and ties in rating keep their text's score."""
    rng = np.random.default_rng(7)
    n, f = 400, 6
    x = rng.random((n, f)) < 0.4
    s = x @ np.array([2.0, -2.0, 1.0, 0, 0, -1.0])
    grade = np.digitize(s + rng.logistic(size=n), [-1.0, 1.0])
    doc, column = np.nonzero(x)
    w, cuts = quality.descend(doc, column, np.ones(len(doc)), grade, np.zeros(f), np.array([-0.1, 0.1]), 3000, 0.3, 0.0)

    def likelihood(w, cuts):
        edge = np.concatenate([[-40.0], cuts, [40.0]])
        z = x @ w
        return np.log(quality.sigmoid(edge[grade + 1] - z) - quality.sigmoid(edge[grade] - z)).mean()

    best = likelihood(w, cuts)
    for i in range(f):
        for step in (-0.05, 0.05):
            assert likelihood(w + step * np.eye(f)[i], cuts) <= best + 1e-4
    assert cuts[0] < cuts[1] and abs(w[0] - 2) < 0.8 and abs(w[1] + 2) < 0.8


def test_quality_bounds_what_it_learns_from(spark):
    """Texts beyond the bound of bytes, and ids that stand in many rows, are passed over; a model is there all the same."""
    rows = [(i, ("good words here " if i % 2 else "BAD!! WORDS!! ") * 5, None, None, None) for i in range(200)] + [(1000, "huge " * 200_000, None, None, None)] + [(1001, "many rows", None, None, None)] * 500
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(1000, 0, 0), (1001, 0, 0)], "doc_id long, quality int, toxic int")
    m = quality.train(docs, quality.graded(labels), max_bytes=25_000)
    got = {r.doc_id: r.tail_probability for r in quality.score(docs.where("doc_id < 200"), m).collect()}
    assert min(got[i] for i in range(1, 200, 2)) > 0.5 > max(got[i] for i in range(0, 200, 2))


def test_without_labels_all_stay(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept for r in quality.classify(docs, none).collect())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    sized = docs.select("doc_id", F.lit(1).cast("long").alias("size"))
    for df in (
        line_dedup.dedup_lines(docs), simhash.simhash_components(docs), bpe.round_trip_digests(docs), mixing.mix(docs), mixing.realise(mixing.mix(docs)),
        lm.score_corpus(docs), quality.classify(docs, labels), sharding.assign_shards(sized, "size", ["doc_id"]),
    ):
        assert df.count() == 0
