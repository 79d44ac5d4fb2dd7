"""Hashed maximum-entropy language model with a class-factored softmax.

A word's code is three digits of its hash, 32 values each: its class, the class within the class, and so on. P(word | before) is the product of the
digits' probabilities, each a softmax over 32 given the digits before it, and of the word's share among the words of its code by their counts
(the unknown word has the share of one count). Each softmax is log-linear: the log of what counts alone give, and for each of three
contexts (the last word, the last two together, the one before the last alone: a skip) a weight times log(1 + how often the digit
has followed that context). Contexts are hashed to rows of a table of counts; the weights go by how often the row was met.

Training sums whole numbers and gradients over all texts: how the texts are split changes nothing but the last digits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, cut, mix, slices

#: Digits of a word's code, and values of a digit.
DIGITS, BASE = 3, 32
CODES = BASE**DIGITS
CONTEXTS = 3
#: Rows of each digit's and context's table: a row for so many bytes of text, within these bounds.
BYTES_A_ROW, FEWEST, MOST = 64, 1 << 10, 1 << 18
#: Cells of the tables that are summed at once.
CHUNK = 1 << 18
#: Weights of a context and digit: a row met 2^b - 1 times or more, up to twice that, has the b-th.
BINS = 10
PARTS = CONTEXTS * BINS
#: Words whose counts every task knows; the counts of all others are joined.
HEAD = 1 << 16
END = np.uint64(0x6A09E667F3BCC908)
#: The key of word hashes, unless another is given.
KEY = 1
BEFORE = np.uint64(0xBB67AE8584CAA73B)
SALTS = np.array([0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1], np.uint64)
#: Tokens at once.
STEP = 1 << 13
#: Where the weights start, and how firmly they are held there.
START, HELD = 0.3, 1.0


#: A byte stands for log(1 + count) in steps of this: counts to a dozen are told apart, and it ends beyond three million.
UNIT = 1 / 17


def quantised(n: np.ndarray) -> np.ndarray:
    """A count as a byte, its log in steps."""
    return np.minimum(np.rint(np.log1p(n) / UNIT), 255).astype(np.uint8)


#: The counts that the bytes stand for; the logs of one less (a token's own left out); the bins of both.
COUNT = np.expm1(np.arange(256) * UNIT)
LOG_REST = np.log1p(np.maximum(COUNT - 1, 0)).astype(np.float32)
BIN = np.clip(np.log2(COUNT + 1.2), 0, BINS - 1).astype(np.int64)
BIN_REST = np.clip(np.log2(np.maximum(COUNT - 1, 0) + 1.2), 0, BINS - 1).astype(np.int64)
#: The logs of one less in the bytes' steps; and a one for each value of a digit: a product with it sums rows, at a fifth of what sum(1) takes.
STEPS_REST = (LOG_REST / UNIT).astype(np.float32)
ONES = np.ones(BASE, np.float32)


@dataclass
class Tokens:
    """The tokens of a slice of texts, each text's end among them: row and hash."""

    row: np.ndarray
    h: np.ndarray
    n_rows: int

    @classmethod
    def of(cls, texts: pa.Array, key: int = KEY) -> Tokens:
        words = Words(texts)
        n, own = words.n_rows, len(words.starts)
        place = np.arange(own) + words.row  # each earlier text has put its end in between
        row, h = np.empty(own + n, np.int64), np.full(own + n, END)
        h[place], row[place] = words.hashes(key=key), words.row
        ends = np.cumsum(np.bincount(words.row, minlength=n)) + np.arange(n)
        row[ends] = np.arange(n)
        return cls(row, h, n)

    def contexts(self) -> list[np.ndarray]:
        """The hashes of each token's contexts."""
        one, two = np.full(len(self.h), BEFORE), np.full(len(self.h), BEFORE)
        same = self.row[1:] == self.row[:-1]
        one[1:][same] = self.h[:-1][same]
        same = self.row[2:] == self.row[:-2]
        two[2:][same] = self.h[:-2][same]
        return [mix(one ^ SALTS[0]), mix(mix(one ^ SALTS[2]) + two), mix(two ^ SALTS[1])]

    def codes(self) -> np.ndarray:
        return ((self.h >> np.uint64(8)) & np.uint64(CODES - 1)).astype(np.int64)


@dataclass
class Distinct:
    """The tokens of a slice by what the model sees of them, each once: sorted by context and code. contexts, codes: of each; times: how often
    it stands in the slice; order: the tokens' places, those of one after those of another."""

    contexts: list[np.ndarray]
    codes: np.ndarray
    times: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, t: Tokens) -> Distinct:
        contexts, codes = t.contexts(), t.codes()
        n = len(codes)
        bits = n.bit_length()
        low = np.uint64((CODES << bits) - 1)
        near = np.uint64(0xFFF << 52)  # what follows one word stands together, so that its rows are at hand
        key = contexts[0] & near
        key |= (contexts[1] & ~low) >> np.uint64(12) & ~(low | near)
        key |= codes.astype(np.uint64) << np.uint64(bits)
        key |= np.arange(n, dtype=np.uint64)
        key.sort()  # the places go along in the lowest bits
        key &= np.uint64((1 << bits) - 1)
        order = key.view(np.int64)
        first = np.flatnonzero(changes(codes[order], *(c[order] for c in contexts)))
        at = order[first]
        return cls([c[at] for c in contexts], codes[at], np.diff(np.append(first, n)), order)

    def sharing(self, digit: int) -> np.ndarray:
        """Where those begin that share their contexts and the digits before this one."""
        return np.flatnonzero(changes(prefixes(self.codes, digit)[0], *self.contexts))

    def spread(self, x: np.ndarray) -> np.ndarray:
        """A value of each for each token."""
        out = np.empty(len(self.order), x.dtype)
        out[self.order] = np.repeat(x, self.times)
        return out


def changes(*sorted_: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it."""
    out = np.zeros(len(sorted_[0]), bool)
    out[:1] = True
    for x in sorted_:
        out[1:] |= x[1:] != x[:-1]
    return out


def prefixes(codes: np.ndarray, digit: int) -> tuple[np.ndarray, np.ndarray]:
    """The digits before one, as a number, and the digit itself."""
    left = BASE ** (DIGITS - 1 - digit)
    return codes // (left * BASE), codes // left % BASE


def table_rows(context: np.ndarray, prefix: np.ndarray, rows: int) -> np.ndarray:
    """The row of a digit's table for a context and the digits before."""
    return (mix(context + prefix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(rows - 1)).astype(np.int64)


def room(n: int, *kinds: type) -> list[np.ndarray]:
    """Arrays of a digit's values for at most STEP of n tokens, to be used again in each step."""
    return [np.empty((min(n, STEP), BASE), kind) for kind in kinds]


@dataclass
class Model:
    """n, v: tokens and distinct tokens of training; head, head_counts: sorted hashes of frequent words and their counts; cells: for each digit,
    context and row, how often each value followed (quantised); met: how often the row was met; shares: of each code, its words' counts plus one,
    summed, plus one; weights: of each digit, context and bin; key: of the words' hashes."""

    n: int
    v: int
    head: np.ndarray
    head_counts: np.ndarray
    shares: np.ndarray
    cells: np.ndarray
    met: np.ndarray
    weights: np.ndarray
    key: int = KEY

    def alone(self, digit: int) -> np.ndarray:
        """The log odds of each value of a digit after the digits before it, by counts alone."""
        sums = self.shares.reshape(BASE**digit, BASE, -1).sum(2)
        return np.log(sums / sums.sum(1, keepdims=True)).astype(np.float32)

    def scores(self, t: Tokens) -> np.ndarray:
        """Natural log of each token's code. What tokens share of it is worked out once for them."""
        d = Distinct.of(t)
        out, rows = np.zeros(len(d.codes)), self.cells.shape[2]
        spare = room(len(out), np.uint8, np.float32, np.float32)
        for digit in range(DIGITS):
            alone = self.alone(digit)
            before, value = prefixes(d.codes, digit)
            weights = (UNIT * self.weights[digit])[:, BIN].astype(np.float32)  # by the byte that a row was met
            first = d.sharing(digit)
            ends = np.append(first, len(out))
            for a in range(0, len(first), STEP):
                b = first[a : a + STEP]
                at, x, z = (s[: len(b)] for s in spare)
                np.take(alone, before[b], axis=0, mode="clip", out=z)
                for k in range(CONTEXTS):
                    row = table_rows(d.contexts[k][b], before[b], rows)
                    np.take(self.cells[digit, k], row, axis=0, mode="clip", out=at)
                    x[...] = at
                    x *= weights[k].take(self.met[digit, k].take(row, mode="clip"), mode="clip")[:, None]
                    z += x
                each = slice(b[0], ends[a + len(b)])
                of = np.repeat(np.arange(len(b)), np.diff(ends[a : a + len(b) + 1]))
                out[each] += z.ravel().take(of * BASE + value[each], mode="clip")
                out[each] -= np.log(np.exp(z, out=z) @ ONES)[of]  # 15 times the weights' bound at most: no overflow
        return d.spread(out)

    def slopes(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The gradient and the curvature of the log-likelihood in the weights, for each digit. A token's own count is left out, so that what
        was seen once does not vouch for itself."""
        d, rows = Distinct.of(t), self.cells.shape[2]
        # summed by the bins of the three contexts together: what each context adds to the gradient, and each two to the curvature
        one = np.zeros((DIGITS, CONTEXTS, BINS**CONTEXTS))
        two = np.zeros((DIGITS, CONTEXTS, CONTEXTS, BINS**CONTEXTS))
        at_, x_, y_, *values = room(len(d.codes), np.uint8, *[np.float32] * (3 + CONTEXTS))
        for digit in range(DIGITS):
            alone = self.alone(digit)
            before, value = prefixes(d.codes, digit)
            weights = (UNIT * self.weights[digit])[:, BIN_REST].astype(np.float32)
            for a in range(0, len(d.codes), STEP):
                b = slice(a, a + STEP)
                own, times = np.arange(len(value[b])) * BASE + value[b], d.times[b]
                at, x, y, z, *each = (s[: len(own)] for s in (at_, x_, y_, *values))
                np.take(alone, before[b], axis=0, mode="clip", out=z)
                rest, bins = [], 0
                for k in range(CONTEXTS):
                    row = table_rows(d.contexts[k][b], before[b], rows)
                    np.take(self.cells[digit, k], row, axis=0, mode="clip", out=at)
                    each[k][...] = at
                    rest.append(STEPS_REST.take(at.ravel().take(own, mode="clip"), mode="clip"))
                    each[k].ravel()[own] = rest[k]
                    met = self.met[digit, k].take(row, mode="clip")
                    bins = bins * BINS + BIN_REST.take(met, mode="clip")
                    z += np.multiply(each[k], weights[k].take(met, mode="clip")[:, None], out=x)
                scale, mean = 1 / (np.exp(z, out=z) @ ONES), []  # z is 67.5 at most: times 255 twice, and 32 of them, is no overflow
                for k in range(CONTEXTS):
                    np.multiply(z, each[k], out=x)
                    mean.append((x @ ONES) * scale)
                    one[digit, k] += np.bincount(bins, (rest[k] - mean[k]) * times, BINS**CONTEXTS)
                    for j in range(k + 1):
                        both = (np.multiply(x, each[j], out=y) @ ONES) * scale - mean[k] * mean[j]
                        two[digit, k, j] += np.bincount(bins, both * times, BINS**CONTEXTS)
        first, second = np.zeros((DIGITS, PARTS)), np.zeros((DIGITS, PARTS, PARTS))
        of = np.indices((BINS,) * CONTEXTS).reshape(CONTEXTS, -1) + np.arange(CONTEXTS)[:, None] * BINS  # each context's part
        for digit in range(DIGITS):
            for k in range(CONTEXTS):
                np.add.at(first[digit], of[k], UNIT * one[digit, k])
                for j in range(k + 1):
                    np.add.at(second[digit], (of[k], of[j]), UNIT**2 * two[digit, k, j])
                    if j < k:
                        np.add.at(second[digit], (of[j], of[k]), UNIT**2 * two[digit, k, j])
        return first, second


def counts(texts: DataFrame, key: int = KEY) -> DataFrame:
    """texts(text) to token counts: h (hash under key), n. Tasks sum what they have seen before they pass it on; what is passed on grows with the texts."""

    def run(batches):
        held: list[tuple] = []

        def merged():
            h, n = (np.concatenate([x[i] for x in held]) for i in range(2))
            known, at = np.unique(h, return_inverse=True)
            return known, np.bincount(at, n, len(known)).astype(np.int64)

        def out(h, n):
            for a in range(0, len(h), 1 << 17):
                b = slice(a, a + (1 << 17))
                yield pa.RecordBatch.from_arrays([pa.array(h[b].view(np.int64)), pa.array(n[b])], names=["h", "n"])

        for batch in batches:
            for part in slices(batch):
                held.append(np.unique(Tokens.of(part.column(0), key).h, return_counts=True))
                if sum(len(x[0]) for x in held) > 1_500_000:
                    held[:] = [merged()]
                    if len(held[0][0]) > 1_000_000:
                        yield from out(*held.pop())
        if held:
            yield from out(*merged())

    return texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def packed(part: np.ndarray) -> bytes:
    """A chunk's bytes, mostly zeros, for the shuffle: in half the room that the shuffle's own compression leaves them."""
    return pa.compress(np.ascontiguousarray(part), codec="zstd", asbytes=True)


def unpacked(n: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(n, decompressed_size=size, codec="zstd"), np.uint8)


def grouped(texts: DataFrame) -> DataFrame:
    """texts in no more partitions than the cluster can have at work twice over: each passes on tables of a fixed size."""
    most = 2 * texts.sparkSession.sparkContext.defaultParallelism
    return texts.coalesce(most) if texts.rdd.getNumPartitions() > most else texts


def tables(texts: DataFrame, rows: int, key: int = KEY) -> tuple[np.ndarray, np.ndarray]:
    """cells and met of a model: tasks count, chunks of the tables are summed as streams, and the quantised sums reach the driver (a byte a
    cell, DIGITS * CONTEXTS * MOST * BASE cells at most)."""
    size = DIGITS * CONTEXTS * rows * BASE
    chunk = min(CHUNK, rows * BASE)

    def run(batches):
        own, over = np.zeros(size, np.uint8), []
        held, filled = np.empty(1 << 22, np.uint32), 0

        def add(at):  # what does not fit a byte is carried: a few frequent cells
            at.sort()
            first = np.flatnonzero(changes(at))
            n = np.diff(np.append(first, len(at)))
            at = at[first]
            n += own[at]
            own[at] = (n & 255).astype(np.uint8)
            more = np.flatnonzero(n > 255)
            over.append((at[more], n[more] >> 8))
            if len(over) > 64:
                over[:] = [carried()]

        def carried():
            at, n = (np.concatenate([x[i] for x in over]) for i in range(2))
            at, place = np.unique(at, return_inverse=True)
            return at, np.bincount(place, n, len(at)).astype(np.int64)

        def out():
            at, n = carried() if over else (np.empty(0, np.uint32), np.empty(0, np.int64))
            ends = np.searchsorted(at, np.arange(0, size + 1, chunk))
            for i in range(size // chunk):
                part, big = own[i * chunk : (i + 1) * chunk], slice(ends[i], ends[i + 1])
                if part.any() or ends[i] < ends[i + 1]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i], pa.int32()), pa.array([packed(part)]), pa.array([(at[big] - i * chunk).astype("<u4").tobytes()]), pa.array([n[big].astype("<u4").tobytes()])],
                        names=["chunk", "n", "at", "carry"],
                    )

        for batch in batches:
            for part in slices(batch):
                t = Tokens.of(part.column(0), key)
                contexts, codes = t.contexts(), t.codes()
                for a in range(0, len(codes), STEP):
                    b = slice(a, a + STEP)
                    if filled + DIGITS * CONTEXTS * STEP > len(held):
                        add(held[:filled])
                        filled = 0
                    for digit in range(DIGITS):
                        before, value = prefixes(codes[b], digit)
                        for k in range(CONTEXTS):
                            end = filled + len(value)
                            held[filled:end] = ((digit * CONTEXTS + k) * rows + table_rows(contexts[k][b], before, rows)) * BASE + value
                            filled = end
        if filled:
            add(held[:filled])
        yield from out()

    def total(batches):
        at, sums = -1, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([quantised(sums).tobytes()]), pa.array([quantised(sums.reshape(-1, BASE).sum(1)).tobytes()])], names=["chunk", "cells", "met"])
        for b in batches:
            for i, n, places, carry in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if i != at:
                    if sums is not None:
                        yield done()
                    at, sums = i, np.zeros(chunk, np.int64)
                sums += unpacked(n, chunk)
                sums[np.frombuffer(places, "<u4")] += np.frombuffer(carry, "<u4").astype(np.int64) << 8
        if sums is not None:
            yield done()

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = grouped(texts).mapInArrow(run, "chunk int, n binary, at binary, carry binary").repartition(n, "chunk").sortWithinPartitions("chunk")
    cells, met = np.zeros(size, np.uint8), np.zeros(size // BASE, np.uint8)
    for r in parts.mapInArrow(total, "chunk int, cells binary, met binary").toLocalIterator():
        cells[r.chunk * chunk : (r.chunk + 1) * chunk] = np.frombuffer(r.cells, np.uint8)
        met[r.chunk * chunk // BASE : (r.chunk + 1) * chunk // BASE] = np.frombuffer(r.met, np.uint8)
    return cells.reshape(DIGITS, CONTEXTS, rows, BASE), met.reshape(DIGITS, CONTEXTS, rows)


def slopes(texts: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Model.slopes summed over all texts: in tasks, then in at most 16 parts, whose sums the driver adds."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    schema = "part int, first binary, second binary"

    def row(part: int, first: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first.tobytes()]), pa.array([second.tobytes()])], names=["part", "first", "second"])

    def run(batches):
        first, second = np.zeros((DIGITS, PARTS)), np.zeros((DIGITS, PARTS, PARTS))
        for batch in batches:
            for part in slices(batch):
                one, two = shared.value.slopes(Tokens.of(part.column(0), shared.value.key))
                first += one
                second += two
        yield row(TaskContext.get().partitionId() % 16, first, second)

    def total(batches):
        first, second, part = np.zeros((DIGITS, PARTS)), np.zeros((DIGITS, PARTS, PARTS)), None
        for b in batches:
            for part, one, two in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):  # noqa: B007
                first += np.frombuffer(one).reshape(first.shape)
                second += np.frombuffer(two).reshape(second.shape)
        if part is not None:
            yield row(part, first, second)

    first, second = np.zeros((DIGITS, PARTS)), np.zeros((DIGITS, PARTS, PARTS))
    for r in texts.mapInArrow(run, schema).repartition(16, "part").mapInArrow(total, schema).toLocalIterator():
        first += np.frombuffer(r.first).reshape(first.shape)
        second += np.frombuffer(r.second).reshape(second.shape)
    shared.destroy()
    return first, second


def train(texts: DataFrame, known: DataFrame, rounds: int = 1, key: int = KEY) -> Model:
    """Fit on texts(text) with their token counts known(h, n), h under key: the tables are counted over all texts, then each round sums gradient and
    curvature over all of them and moves the weights by Newton's step (held to where they start, as if by HELD tokens of evidence).
    The driver gets the HEAD most frequent words, the sums of each code, the tables and the sums of the slopes."""
    n, v = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = known.orderBy(F.col("n").desc(), "h").limit(HEAD).select("h", "n").toArrow()
    h, c = np.asarray(top.column("h")).view(np.uint64), np.asarray(top.column("n"))
    order = np.argsort(h)
    code = F.shiftrightunsigned("h", 8).bitwiseAND(F.lit(CODES - 1)).cast("int")
    sums = known.groupBy(code.alias("code")).agg(F.sum(F.col("n") + 1).alias("n")).toArrow()  # CODES rows at most
    shares = np.ones(CODES)
    shares[np.asarray(sums.column("code"))] += np.asarray(sums.column("n"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = min(MOST, max(FEWEST, 1 << (max(1, size // BYTES_A_ROW) - 1).bit_length()))
    cells, met = tables(texts, rows, key)
    weights = np.full((DIGITS, CONTEXTS, BINS), START)
    model = Model(n, v, h[order], c[order], shares, cells, met, weights, key)
    for _ in range(rounds if n else 0):
        first, second = slopes(texts, model)
        pull = HELD * (START - model.weights).reshape(DIGITS, PARTS)
        step = [np.linalg.solve(second[d] + HELD * np.eye(PARTS), first[d] + pull[d]) for d in range(DIGITS)]
        model.weights = np.clip(model.weights + np.reshape(step, weights.shape), 0.0, 1.5)
    return model


def score(df: DataFrame, model: Model, known: DataFrame, text: str = "text") -> DataFrame:
    """Add n_tokens, n_known, base_score and score to df, for each whole text (null: empty).

    Tasks score codes and frequent words; for the others they pass on each text's distinct words, whose counts are joined by
    hash, and only sums come back to the text's row."""
    names = [c for c in df.columns if c not in ("n_tokens", "n_known", "base_score", "score")]
    df = df.select(*names)
    at = names.index(text)
    rest = [i for i in range(len(names)) if i != at]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, done, task = shared.value, 0, TaskContext.get().partitionId()
        head_logs, share_logs = np.log10(m.head_counts + 1.0), np.log10(m.shares)
        for batch in batches:
            for part in slices(batch, at):
                t = Tokens.of(part.column(at), m.key)
                n = t.n_rows
                total = np.bincount(t.row, m.scores(t) / np.log(10) - share_logs[t.codes()], n)
                if len(m.head):
                    place = np.minimum(np.searchsorted(m.head, t.h), len(m.head) - 1)
                    hit = m.head[place] == t.h
                    logs = np.where(hit, head_logs[place], 0.0)
                else:
                    hit, logs = np.zeros(len(t.h), bool), np.zeros(len(t.h))
                row, h = t.row[~hit], t.h[~hit]
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])) if len(row) else np.empty(0, np.int64)
                times, row, h = np.diff(np.append(first, len(row))), row[first], h[first]
                ends = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
                own = np.bincount(t.row, logs, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(i) for i in rest], pa.array((task << 36) + done + np.arange(n)), pa.array(np.bincount(t.row, minlength=n)),
                        pa.array(np.bincount(t.row, hit, n).astype(np.int64)), pa.array(own), pa.array(total + own),
                        pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
                    ],
                    names=[*[names[i] for i in rest], "row_", "tokens_", "known_", "logs_", "score_", "h_", "times_"],
                )
                done += n

    kept = T.StructType([df.schema.fields[i] for i in rest])
    for c, kind in (("row_", T.LongType()), ("tokens_", T.LongType()), ("known_", T.LongType()), ("logs_", T.DoubleType()), ("score_", T.DoubleType()), ("h_", T.ArrayType(T.LongType())), ("times_", T.ArrayType(T.IntegerType()))):
        kept = kept.add(c, kind)
    part = cut(df.mapInArrow(run, kept))
    words = part.select("row_", F.explode(F.arrays_zip("h_", "times_")).alias("w")).select("row_", F.col("w.h_").alias("h"), F.col("w.times_").alias("times"))
    met = words.join(known.select("h", "n"), "h").groupBy("row_").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_"), F.sum("times").alias("more_known_"))
    whole = F.log10(F.lit(float(model.n + model.v + 1)))
    more, more_known = F.coalesce("more_", F.lit(0.0)), F.coalesce("more_known_", F.lit(0))
    return part.join(met, "row_", "left").select(
        *[names[i] for i in rest],
        F.col("tokens_").alias("n_tokens"), (F.col("known_") + more_known).cast("long").alias("n_known"),
        (F.col("logs_") + more - F.col("tokens_") * whole).alias("base_score"), (F.col("score_") + more).alias("score"),
    )


def held_out(doc_id: str) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 7; a null id trains."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = 1, key: int = KEY) -> DataFrame:
    """For each row of df: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score; learnt from the rows
    that are not held out.

    Words are told apart by 64-bit hashes under key, so that two are taken for one by chance only (among 10^9 distinct words, one pair
    is met in some 37 runs); a secret key keeps out words that were made to have equal hashes.

    Null and empty texts are the end token alone; rows that repeat an id each count; without training rows the counts are
    zero and the model is even. An empty table gives an empty result; other columns are ignored."""
    rows = df.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    texts = rows.where(~F.col("held_out")).select("text")
    known = cut(counts(texts, key))
    model = train(texts, known, rounds, key)
    scored = score(rows, model, known)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
