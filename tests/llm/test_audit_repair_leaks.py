"""Source audit, conversation repair and benchmark decontamination against brute force, on awkward rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from signalbrook.llm import conversations, decontamination, divergence, queries
from signalbrook.llm.conversations import LONG

from .helpers import DOCS, documents, low

ODD = {"n": "mine", "term": "mine", "row": 1, "doc": "mine", "w": "mine", "h": "mine", "items": "mine", "spans": "mine", "copies": "mine", "part": "mine", "turns": "mine", "conv": "mine", "rank": "mine", "value": "mine"}


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in ODD.items() if k not in df.columns})


# Source audit


def brute_audit(rows, least=10, top=10):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(lang or "", source or "", term.findall(low(text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in mine for t in set(d[2]))
        kept = sorted((t for t in df if df[t] >= least), key=str.encode)
        whole = collections.Counter(t for d in mine for t in d[2] if df[t] >= least)
        groups = {s: collections.Counter(t for d in mine if d[1] == s for t in d[2] if df[t] >= least) for s in {d[1] for d in mine}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        q, p = share(whole), {s: share(c) for s, c in groups.items()}
        for s in groups:
            pair = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s))
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pair, 1)]
            ranked = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(ranked, 1)]
    return sorted(out)


def audit_rows():
    rng = random.Random(5)
    rows = [(t, lang, source) for _, t, lang, source, _ in documents(150)]
    rows += [("\x00\x1f", "xx", "no terms"), (None, "xx", None), ("", None, None), ("ÀÉ Àé AéB", "fr", "s"), ("one", "lone", "lone")]
    rows += [(" ".join(rng.choice(["la", "Le", "été", "x1y", "Ω"]) for _ in range(40)), "fr", f"s{i % 3}") for i in range(40)]
    return rows + [("same same", "en", "src0")] * 70


def test_audit(spark):
    rows = audit_rows()
    df = clashing(spark.createDataFrame(rows, "text string, lang string, source string").repartition(3))
    want = brute_audit(rows)
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == want
    # small blocks: the same rows from many tasks
    assert sorted(tuple(r) for r in divergence.audit(df, block=8).collect()) == want
    assert {r[2] for r in want} == {"pair", "term"} and any(r[0] == "xx" for r in want)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


@pytest.mark.parametrize("digest", [len, lambda b: 7, lambda b: b[0]])
def test_equal_hashes_are_told_apart(digest):
    texts = ["an on AN\x00on", None, "", "a-b-c ab " + "x" * 30 + " " + "x" * 29 + "y", "é è É"]
    found = divergence.Terms(pa.array(texts), digest)
    got = [(int(r), found.terms[c].decode()) for r, c in zip(found.row, found.code)]
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    assert got == [(i, t) for i, x in enumerate(texts) for t in term.findall(low(x or ""))]
    assert len(set(found.terms)) == len(found.terms)


@given(st.integers(0, 10**15), st.integers(0, 10**15), st.integers(1, 10**8))
@settings(max_examples=200, deadline=None)
def test_shares_are_exact(count, more, terms):
    total = count + more
    assert int(divergence.shares(count, total, terms)) == 1 + 10**9 * (count + 2) // (total + 2 * terms)


# Conversation repair


def brute_damage(rows):
    """(conv, turn, role, text) after damage, in order; every conversation."""
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text, role = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text, "user" if d == 4 else role
        out[conv] += [] if d == 0 else [(turn, role, text)] * (2 if d == 3 else 1)
    return out


def brute_repair(rows):
    """rows in order: (turn, role, text). All edits in turn, for what the initials so far can be followed by: nothing yet, s, u, or ua."""
    kinds, seen = [], set()
    for _, role, text in rows:
        last = text.strip(conversations.SPACE)[-1:]
        kinds.append("blank" if not last else "duplicate" if (role, text) in seen else "ok" if last in ".!?" else "truncated")
        seen.add((role, text))
    best = {"": (0, "")}

    def fits(x):
        return re.fullmatch(r"s?(ua)*u?", x)

    def grow(front):
        """Insertions."""
        todo = dict(front)
        for _ in range(3):
            for x, (cost, audit) in list(todo.items()):
                for r in "ua":
                    if fits(x + r):
                        k = key(x + r)
                        todo[k] = min(todo.get(k, (10**9, "")), (cost + 3, audit + "I"))
        return todo

    def key(x):
        return "" if not x else "s" if x == "s" else "u" if x[-1] == "u" else "ua"

    for (_, role, _), kind in zip(rows, kinds):
        front, best = grow(best), {}

        def offer(k, cost, audit):
            if k not in best or (cost, audit) < best[k]:
                best[k] = (cost, audit)

        for x, (cost, audit) in front.items():
            offer(x, cost + 4, audit + "D")
            if kind in ("blank", "duplicate"):
                continue
            more = 3 if kind == "truncated" else 0
            if fits(x + role[:1]):
                offer(key(x + role[:1]), cost + more, audit + "K")
            for r in "ua":
                if fits(x + r):
                    offer(key(x + r), cost + more + 3, audit + "R")
    cost, audit = min(v for k, v in grow(best).items() if k in ("", "ua"))
    return kinds, cost, audit


def brute_exhaustive(rows):
    """The definition itself, for a few rows: all strings of edits, all roles."""
    kinds = brute_repair(rows)[0]
    found = []
    limit = len(rows) + 4
    for audit in (x for n in range(limit + 1) for x in itertools.product("DIKR", repeat=n)):
        if sum(c != "I" for c in audit) != len(rows):
            continue
        cost, at, options = 0, 0, [""]
        for c in audit:
            if c == "I":
                cost, options = cost + 3, [x + r for x in options for r in "ua"]
                continue
            (_, role, _), kind = rows[at], kinds[at]
            at += 1
            if c == "D":
                cost += 4
                continue
            if kind in ("blank", "duplicate"):
                options = []
            cost += (3 if c == "R" else 0) + (3 if kind == "truncated" else 0)
            options = [x + r for x in options for r in ("ua" if c == "R" else [role[:1]])]
        if any(re.fullmatch(r"(s?(ua)+)?", x) for x in options):
            found.append((cost, "".join(audit)))
    return min(found)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", " "]), st.sampled_from(["a.", "b", "", "c!", "d?", "e."])), max_size=4))
@settings(max_examples=40, deadline=None)
def test_edits_against_all_strings_of_edits(turns):
    rows = [(None, r, t) for r, t in turns]
    want = brute_exhaustive(rows)
    assert brute_repair(rows)[1:] == want
    seen, made = set(), []
    for r, t in turns:
        made.append((r, t, 1, (r, t) not in seen))
        seen.add((r, t))
    assert conversations.complete(conversations.edits(made, conversations.faults(made))) == want
    # joined from pieces of any size: the same
    for cut in range(len(made) + 1):
        ends = {}
        for entry, (cost, audit) in conversations.edits(made[:cut], conversations.faults(made[:cut])).items():
            for s, (c, x) in conversations.edits(made[cut:], conversations.faults(made[cut:]), entry).items():
                ends[s] = min(ends.get(s, (10**9, "")), (cost + c, audit + x))
        assert conversations.complete(ends) == want


def conversation_rows():
    rng = random.Random(8)
    say = ["Yes.", "No!", "Why?", "well", "", " \t", "a: b.\nc", "É ok.", "end. "]
    rows = []
    for c in range(300):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None]) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, rng.choice([*say, None, f"text {c} {t}."])))
    rows += [(None, i, ("user", "assistant")[i % 2], f"orphan {i}.") for i in range(5)] + [(900, None, "user", "no turn."), (900, None, "user", "no turn."), (900, 3, "assistant", "x.")]
    rows += [(901, t, "user", "all the same.") for t in (-4, -1, 7)] + [(902, None, None, None)]
    rows += [(903, 2, "user", "long " * 3000 + ".")]
    rows += [(950, t, rng.choice(["user", "assistant"]), rng.choice(say) if t % 7 else f"turn {t}.") for t in range(400)] + [(950, 3, "user", "again.")] * 3
    return rows


def checked(got, rows, order):
    """got: the report's rows by conversation; order: rows of a conversation in the operator's order."""
    damaged = brute_damage(rows)
    assert set(got) == set(damaged)
    for conv, turns in damaged.items():
        turns = order(turns)
        kinds, cost, audit = brute_repair(turns)
        known = {t for t, _, _ in turns if t is not None}
        initials = [r[:1] for _, r, _ in turns]
        r = got[conv]
        assert (r.blank, r.duplicate, r.truncated) == tuple(kinds.count(k) for k in ("blank", "duplicate", "truncated"))
        assert r.gaps == (max(known) - min(known) + 1 - len(known) if known else 0)
        assert r.illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        assert (r.cost, r.audit) == (cost, audit)
        final, at = [], iter(turns)
        for c in audit:
            turn = next(at) if c != "I" else (None, "", "")
            if c == "D":
                continue
            now = "".join(x[0][:1] for x in final)
            role = ("assistant" if now[-1:] == "u" else "user") if c in "IR" else turn[1]
            final.append((role, turn[2]))
        assert re.fullmatch(r"(s?(ua)+)?", "".join(x[0][:1] for x in final))
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in final).encode()).hexdigest()


@pytest.fixture(scope="module")
def order(spark):
    """Rows of one turn stand in order of Spark's hash of role and text."""
    from pyspark.sql import functions as F

    pairs = {(r, t) for turns in brute_damage(conversation_rows()).values() for _, r, t in turns}
    known = {(r.role, r.text): r.h for r in spark.createDataFrame(list(pairs), "role string, text string").withColumn("h", F.xxhash64("role", "text")).collect()}
    return lambda turns: sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, known[x[1:]], x[1:]))


@pytest.mark.parametrize(("long_rows", "piece"), [(LONG, 1024), (30, 16), (0, 3)])
def test_repair(spark, order, long_rows, piece):
    rows = conversation_rows()
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    report, turns = conversations.repair(conversations.damage(df), copies="copies", long_rows=long_rows, piece=piece)
    checked({r.conv_id: r for r in report.collect()}, rows, order)
    texts = collections.defaultdict(list)
    for r in turns.orderBy("conv_id", "part", "piece", "place").collect():
        texts[r.conv_id].append(f"{r.role}:{r.text}")
    for r in report.collect():
        assert hashlib.sha256("\n".join(texts[r.conv_id]).encode()).hexdigest() == r.repaired_sha256


def test_repair_query_and_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(empty)[0].count() == 0
    key = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(key, 0, "user", "dropped.")], empty.schema).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()] == [(key, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# Benchmark decontamination


def brute_leaks(docs, items, width=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = collections.defaultdict(set)
    for item, text in items:
        w = word.findall(low(text or ""))
        for i in range(max(len(w) - width, 0) + 1 if w else 0):
            wins[tuple(w[i : i + width])].add(item)
    sizes, out = {len(w) for w in wins}, []
    for doc, text in docs:
        w, hit, named = word.findall(low(text or "")), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (run := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    named |= {str(x) for x in wins[run] if x is not None}
        stretches = [b for b in sorted(hit) if b - 1 not in hit]
        out.append((doc, len(w), len(hit), sorted(named), [(b, next(e for e in itertools.count(b) if e not in hit)) for b in stretches]))
    return sorted(out, key=repr)


def leak_rows():
    rng = random.Random(11)
    lex = ["the", "of", "and", "été", "x1", "run", "Fox", "in", "it's", "a"] + [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choice(lex) for _ in range(n))
    items = [(i, say(rng.randint(8, 40))) for i in range(30)] + [(40, "zyx"), (41, "Two words"), (42, "of and the"), (43, None), (44, " ,.;"), (None, say(15)), (46, "the " * 14)]
    items += [(47, items[0][1]), (48, items[0][1]), (0, items[0][1]), (100, say(5)), (101, say(9)), (102, say(10)), (103, say(11))]
    docs = [(1000 + i, t) for i, (_, t, *_) in enumerate(documents(20))]
    for i in range(120):
        text = say(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            part = (rng.choice(items)[1] or "").split(" ")
            a = rng.randint(0, max(len(part) - 9, 0))
            part = " ".join(part[a : a + rng.choice([5, 9, 10, 12, 40])])
            text = f"{text} {part.upper() if rng.random() < 0.2 else part},{say(rng.randint(0, 6))}"
        docs.append((i, text))
    docs += [(None, "zyx"), (7, "two WORDS"), (7, "two WORDS"), (8, None), (9, ""), (10, "the " * 5000)]
    return docs, items


@pytest.mark.parametrize("block", [decontamination.BLOCK, 40])
def test_contamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK", block)
    docs, items = leak_rows()
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    bench = clashing(spark.createDataFrame(items, "item_id long, text string"))
    found = decontamination.contamination(df, bench)
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) for r in found.collect()]
    want = brute_leaks(docs, items)
    assert sorted(got, key=repr) == want
    assert found.columns[0] == "doc_id" and "term" in found.columns and sum(w[2] > 0 for w in want) > 30 < sum(w[2] == 0 for w in want)


def test_contamination_of_nothing(spark):
    docs, items = leak_rows()
    df, none = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    got = decontamination.contamination(df, none)
    assert got.count() == len(docs) and got.where("n_hit > 0").count() == 0
    assert decontamination.contamination(df.limit(0), spark.createDataFrame(items, none.schema)).count() == 0


def test_contamination_runs_no_python(spark):
    docs, items = leak_rows()
    df, bench = spark.createDataFrame(docs, DOCS.split(", lang")[0]), spark.createDataFrame(items, "item_id long, text string")
    plan = decontamination.contamination(df, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "MapPartitions" not in plan
