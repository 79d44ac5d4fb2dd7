"""The language model against its definition: probabilities add up to one, context tells, scores are the product of the factors, and how the
texts are split changes nothing."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from signalbrook.llm import lm

from .helpers import DOCS, documents, words

TEXTS = [f"{a} {b} " + " ".join(f"often{i}" for i in range(40)) for a, b in (("left", "xan"), ("right", "yan"))] * 60 + [f"rare{i}an" for i in range(300)]


@pytest.fixture(scope="module")
def trained(spark):
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(2).cache()
    known = lm.counts(texts).cache()
    return known, lm.train(texts, known)


def test_context_chooses_the_word(spark, trained):
    known, m = trained
    asked = [f"{a} {b}" for a in ("left", "right") for b in ("xan", "yan")]
    got = {r.id: r.score for r in lm.score(spark.createDataFrame([(t, t) for t in asked], "id string, text string"), m, known).collect()}
    assert got["left xan"] > got["left yan"] + 0.5 and got["right yan"] > got["right xan"] + 0.5


def test_codes_after_a_context_add_up_to_one(trained):
    known, m = trained
    t = lm.Tokens.of(pa.array(["left", "often3 often4 often5"]))
    # put every code after the same words before: what the model gives them all
    one = np.uint64(lm.CODES - 1) << np.uint64(8)
    for at in (1, 4):
        contexts = [np.repeat(c[at : at + 1], lm.CODES) for c in t.contexts()]
        every = lm.Tokens(np.zeros(lm.CODES, np.int64), np.arange(lm.CODES, dtype=np.uint64) << np.uint64(8), 1)
        assert (every.h & ~one == 0).all()
        every.contexts = lambda contexts=contexts: contexts
        assert np.exp(m.scores(every)).sum() == pytest.approx(1, abs=1e-4)
    within = collections.Counter()
    for r in known.collect():
        within[(r.h % 2**64 >> 8) % lm.CODES] += (r.n + 1) / m.shares[(r.h % 2**64 >> 8) % lm.CODES]
    assert all(total + 1 / m.shares[c] == pytest.approx(1) for c, total in within.items())


def brute_score(m, n, text):
    """A text's log10 probability, a token and a digit at a time."""
    t, out = lm.Tokens.of(pa.array([text])), 0.0
    contexts, rows = t.contexts(), m.cells.shape[2]
    for i, h in enumerate(t.h.tolist()):
        code = h >> 8 & lm.CODES - 1
        digits = [code >> 10, code >> 5 & 31, code & 31]
        for d, y in enumerate(digits):
            before = code >> 15 - 5 * d
            z = []
            for c in range(32):
                span = 1 << 5 * (2 - d)
                first = (before * 32 + c) * span
                x = math.log(m.shares[first : first + span].sum())
                for k in range(3):
                    row = int(lm.mix(contexts[k][i : i + 1] + np.uint64(before * 0x9E3779B97F4A7C15 % 2**64))[0]) % rows
                    met = lm.COUNT[m.met[d, k, row]]
                    x += m.weights[d, k, min(int(math.log2(met + 1.2)), lm.BINS - 1)] * math.log1p(lm.COUNT[m.cells[d, k, row, c]])
                z.append(x)
            out += z[y] - math.log(sum(map(math.exp, z)))
        out += math.log((n[h] + 1) / m.shares[code])
    return out / math.log(10)


def test_scores_are_the_definition_s(spark, trained):
    known, m = trained
    n = collections.Counter({r.h % 2**64: r.n for r in known.collect()})
    asked = ["", "left xan often0", "right rare7an never seen", "often39 often38 rare1an"]
    for part in (m, lm.Model(m.n, m.v, m.head[::2], m.head_counts[::2], m.shares, m.cells, m.met, m.weights)):  # counts that tasks know, or that are joined
        got = {r.id: r.score for r in lm.score(spark.createDataFrame([(t, t) for t in asked], "id string, text string"), part, known).collect()}
        for t in asked:
            assert got[t] == pytest.approx(brute_score(m, n, t), abs=1e-3)


def test_tables_count_every_token(trained):
    _, m = trained
    tokens = sum(len(t.split()) + 1 for t in TEXTS)
    for d in range(lm.DIGITS):
        for k in range(lm.CONTEXTS):
            assert lm.COUNT[m.met[d, k]].sum() == pytest.approx(tokens, rel=0.05)
    assert np.rint(lm.COUNT[lm.quantised(np.arange(12))]).tolist() == list(range(12)) and (np.diff(lm.quantised(np.arange(100_000)).astype(int)) >= 0).all()


def test_frequent_cells_are_counted_whole(spark):
    """Cells beyond a byte and beyond two, over several partitions."""
    texts = spark.createDataFrame([("a b " * 30_000,), ("a b " * 500,), ("c",)] * 2, "text string").repartition(3)
    cells, met = lm.tables(texts, 64)
    assert lm.COUNT[met[0, 0]].max() == pytest.approx(61_000, rel=0.05) and lm.COUNT[cells[2, 0]].max() == pytest.approx(61_000, rel=0.05)


def test_the_slopes_are_those_of_the_likelihood(trained):
    """The gradient against differences of the likelihood, own counts left out on both sides."""
    _, m = trained
    t = lm.Tokens.of(pa.array(TEXTS[:40] + TEXTS[-40:]))

    def likelihood(weights):
        own = lm.Model(m.n, m.v, m.head, m.head_counts, m.shares, m.cells, m.met, weights)
        contexts, codes, out = t.contexts(), t.codes(), 0.0
        for d in range(lm.DIGITS):
            before, y = lm.prefixes(codes, d)
            z, each = own.alone(d)[before].astype(float), np.arange(len(y))
            for k in range(lm.CONTEXTS):
                row = lm.table_rows(contexts[k], before, m.cells.shape[2])
                x = lm.UNIT * m.cells[d, k, row].astype(float)
                x[each, y] = lm.LOG_REST[m.cells[d, k, row, y]]
                z += weights[d, k][lm.BIN_REST[m.met[d, k, row]]][:, None] * x
            out += (z[each, y] - np.log(np.exp(z).sum(1))).sum()
        return out

    first, _ = m.slopes(t)
    for d, k, b in ((0, 0, 3), (1, 1, 5), (2, 2, 6), (0, 2, 0)):
        w = m.weights.copy()
        w[d, k, b] += 1e-3
        up = likelihood(w)
        w[d, k, b] -= 2e-3
        assert (up - likelihood(w)) / 2e-3 == pytest.approx(first[d, k * lm.BINS + b], rel=0.02, abs=0.05)


def test_splitting_changes_nothing(spark):
    rows = documents()
    df = spark.createDataFrame(rows, DOCS)
    one, many = (sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in lm.score_corpus(df.repartition(n)).collect()) for n in (1, 7))
    assert [x[:2] for x in one] == [x[:2] for x in many] and np.allclose([x[2] for x in one], [x[2] for x in many], atol=1e-4)


def test_held_out_texts_gain_from_context(spark):
    rng, known = random.Random(3), [f"w{i}" for i in range(60)]
    follow = {w: rng.sample(known, 3) for w in known}
    rows = []
    for i in range(400):
        w = [rng.choice(known)]
        while len(w) < 40:
            w.append(rng.choice(follow[w[-1]]))
        rows.append((i, " ".join(w), None, None, None))
    held = [r for r in lm.score_corpus(spark.createDataFrame(rows, DOCS)).collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in held)
    n = sum(len(words(rows[r.doc_id][1])) + 1 for r in held)
    assert sum(r.score - r.base_score for r in held) / n > 0.7  # of log10(60 / 3) at most


def test_words_made_to_collide_are_two(spark):
    """Two words of one hash where no key is used, one of them trained on, the other held out."""
    a, b = "4wsjlbcaabababab", "u9iynfapjrw*!o>m"
    assert len(set(lm.Words(pa.array([f"{a} {b}"])).hashes().tolist())) == 1
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(i, f"{a} here", None, None, None) for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2][:20] + [(held, f"{b} here", None, None, None)]
    for key in (lm.KEY, 99):
        got = {r.doc_id: r for r in lm.score_corpus(spark.createDataFrame(rows, DOCS), key=key).collect()}
        assert got[held].n_known == 2 and got[held].n_tokens == 3 and got[0].n_known == 3
        assert got[held].base_score == pytest.approx(sum(math.log10((c + 1) / (60 + 4)) for c in (0, 20, 20)), abs=1e-9)


def test_what_a_task_passes_on_of_its_tables_takes_half_of_what_the_shuffle_makes_of_it():
    rng = np.random.default_rng(5)
    part = np.where(rng.random(1 << 18) < 0.2, np.minimum(rng.geometric(0.6, 1 << 18), 255), 0).astype(np.uint8)
    sent = lm.packed(part)
    assert (lm.unpacked(sent, len(part)) == part).all()
    assert len(sent) < 0.6 * len(pa.compress(part, codec="lz4", asbytes=True))


def test_what_tokens_share_is_worked_out_once(trained, monkeypatch):
    """Texts that stand twenty times take no more rows of the tables than once, and count twenty times; steps of any length give the same."""
    _, m = trained
    texts, asked = [*TEXTS[:3], *TEXTS[-40:], "", "left xan never seen"], []
    once, often = lm.Tokens.of(pa.array(texts)), lm.Tokens.of(pa.array(texts * 20))
    monkeypatch.setattr(lm, "table_rows", lambda c, p, n, plain=lm.table_rows: asked.append(len(c)) or plain(c, p, n))
    (first, second), scores = m.slopes(once), m.scores(once)
    few = sum(asked)
    for step in (lm.STEP, 7):
        monkeypatch.setattr(lm, "STEP", step)
        asked.clear()
        got, more = m.slopes(often), m.scores(often)
        assert sum(asked) == few
        assert np.allclose(got[0], 20 * first, rtol=1e-4, atol=1e-2) and np.allclose(got[1], 20 * second, rtol=1e-4, atol=1e-2)
        assert np.allclose(more, np.tile(scores, 20), atol=1e-5)
