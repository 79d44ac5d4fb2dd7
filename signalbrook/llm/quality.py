"""Ordinal cumulative-link regression on graded ratings, with shared hashed-text weights."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, mix, release, slices

#: At most so many labelled documents are read for training (the first by a seeded hash of the id).
MAX_TRAIN = 6_000
#: And of these, at most so many bytes of text: what they become on the driver is a small multiple.
MAX_BYTES = 40 << 20
#: A feature counts if it is in so many of them.
MIN_DOCS = 12


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, 64-bit hashed feature and value: each distinct word and each distinct first four bytes of one (A-Z lowered,
    present or not); and as a share of the words their last two bytes, the kinds of bytes in them and whether a
    word repeats the one before."""
    words = Words(texts)
    if not len(words.starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.float32)
    data, ends, row = words.data, words.ends, words.row
    kind = np.full(256, 16, np.uint8)  # other
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 1, 2, 4, 8
    kind[[0x2C, 0x2E]] = 0  # comma and full stop say little
    kinds = np.bitwise_or.reduceat(np.where(np.isin(data, [0x20, *range(9, 14)]), 0, kind[data]).astype(np.uint8), words.starts)
    last = data[ends - 1].astype(np.uint64)
    tail = np.where(ends - words.starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
    total = np.maximum(1, np.bincount(row, minlength=words.n_rows))
    shares = mix(np.concatenate([last * np.uint64(256) + tail + np.uint64(1 << 40), kinds.astype(np.uint64) + np.uint64(1 << 41)]))
    own = words.hashes()
    again = np.flatnonzero((own[1:] == own[:-1]) & (row[1:] == row[:-1])) + 1
    shares, rows = np.append(shares, np.full(len(again), mix(np.array([1 << 42], np.uint64)))), np.concatenate([row, row, row[again]])
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += np.uint64(32)
    head = np.full(len(row), 1 << 43, np.uint64)
    for k in range(4):
        at = words.starts + k
        head = head * np.uint64(257) + np.where(at < ends, low[data[np.minimum(at, len(data) - 1)]], np.uint64(256))

    def distinct(r: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((h, r))
        r, h = r[order], h[order]
        first = np.ones(len(r), bool)
        first[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
        at = np.flatnonzero(first)
        return r[at], h[at], np.diff(np.append(at, len(r)))

    r1, h1, _ = distinct(np.concatenate([row, row]), np.concatenate([own, mix(head)]))
    r2, h2, n2 = distinct(rows, shares)
    return np.concatenate([r1, r2]), np.concatenate([h1, h2]), np.concatenate([np.ones(len(r1)), 4 * n2 / total[r2]]).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """hashes (sorted) and weights of the features that count; thresholds between the grades, in order."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.hashes, self.weights, self.thresholds = hashes, weights, thresholds

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, h, value = features(texts)
        if not len(self.hashes):
            return np.zeros(len(texts))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[at] == h
        return np.bincount(row[hit], self.weights[at[hit]] * value[hit], len(texts))

    def grades(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and for each grade from 1 the probability that the grade is at least that."""
        tails = 1 - sigmoid(self.thresholds[None, :] - self.scores(texts)[:, None])
        return tails.sum(1), tails


def descend(doc: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, w: np.ndarray, cuts: np.ndarray, rounds: int, rate: float, lasso: float) -> tuple[np.ndarray, np.ndarray]:
    """Proximal Adagrad steps over the whole sample towards the most likely weights and thresholds."""
    n, seen_w, seen_c = len(grade), np.full(len(w), 1e-8), np.full(len(cuts), 1e-8)
    for _ in range(rounds):
        s = np.bincount(doc, w[column] * value, n)
        edge = np.concatenate([[-40.0], cuts, [40.0]])
        a, b = sigmoid(edge[grade + 1] - s), sigmoid(edge[grade] - s)
        p = np.maximum(a - b, 1e-9)
        g = np.bincount(column, ((1 - a - b) / n)[doc] * value, len(w))
        seen_w += g * g
        step = rate / np.sqrt(seen_w)
        w = w - step * g
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * lasso)
        g = np.array([((grade == j + 1) * b * (1 - b) / p).sum() - ((grade == j) * a * (1 - a) / p).sum() for j in range(len(cuts))]) / n
        seen_c += g * g
        cuts = np.maximum.accumulate(cuts - rate / np.sqrt(seen_c) * g)
    return w, cuts


def fit(doc: np.ndarray, h: np.ndarray, value: np.ndarray, grade: np.ndarray, n_grades: int, select: tuple = (200, 0.3, 1e-3), refine: tuple = (300, 0.3, 3e-5)) -> Model:
    """Maximum likelihood of P(grade <= j) = logistic(threshold_j - score): first with a penalty that keeps few
    features, then over those with hardly any. select and refine: rounds, rate and penalty."""
    order = np.argsort(h, kind="stable")
    known = h[order]
    first = np.concatenate([[True], known[1:] != known[:-1]])
    column = np.empty(len(h), np.int32)
    column[order] = np.cumsum(first, dtype=np.int32) - 1
    docs = np.diff(np.append(np.flatnonzero(first), len(h)))
    known = known[first]
    del order, first
    share = np.clip(np.cumsum(np.bincount(grade, minlength=n_grades))[:-1] / len(grade), 1e-3, 1 - 1e-3)
    keep, w, cuts = docs >= MIN_DOCS, np.zeros(len(known)), np.log(share / (1 - share))
    for rounds, rate, lasso in (select, refine):
        new, on = np.cumsum(keep) - 1, keep[column]
        doc, column, value, known = doc[on], new[column[on]], value[on], known[keep]
        w, cuts = descend(doc, column, value, grade, w[keep], cuts, rounds, rate, lasso)
        keep = w != 0
    return Model(known[keep], w[keep].astype("f4"), cuts)


def train(docs: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", text: str = "text", grade: str = "grade", n_grades: int = 3, max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on at most max_train rated documents: ratings(doc_id, grade 0 to n_grades - 1), the best grade where a document
    has several. They are taken in the order of a seeded hash of the id, and one is passed over whose rows would take all texts
    together beyond max_bytes. Rows with a null id or grade don't count. Without any rated document the model gives every
    text the same score, and its thresholds put every text in the best grade."""
    rated = (
        ratings.select(F.col(doc_id).alias("rated_id"), F.col(grade).cast("int").alias("grade_"))
        .where("rated_id IS NOT NULL AND grade_ IS NOT NULL")
        .groupBy("rated_id").agg(F.max("grade_").alias("grade_"))
        .orderBy(F.xxhash64("rated_id", F.lit(11)), "rated_id").limit(max_train)
    )
    rows = docs.select(F.col(doc_id).alias("rated_id"), F.col(text).alias("text_")).join(F.broadcast(rated), "rated_id")
    sizes = rows.groupBy("rated_id").agg(F.sum(F.coalesce(F.octet_length("text_"), F.lit(0)) + 64).alias("size")).orderBy(F.xxhash64("rated_id", F.lit(11)), "rated_id")
    chosen, left = [], max_bytes
    for r in sizes.collect():  # max_train rows at most
        if r["size"] <= left:
            left -= r["size"]
            chosen.append((r.rated_id,))
    fits = docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("rated_id", rated.schema["rated_id"].dataType)]))
    own = rows.join(F.broadcast(fits), "rated_id").select("text_", "grade_")

    def run(batches):
        for whole in batches:
            for b in slices(whole):
                row, h, value = features(b.column(0))
                ends = np.searchsorted(row, np.arange(b.num_rows + 1)) if (np.diff(row) >= 0).all() else None
                if ends is None:
                    order = np.argsort(row, kind="stable")
                    row, h, value = row[order], h[order], value[order]
                    ends = np.searchsorted(row, np.arange(b.num_rows + 1))
                cut = ends.tolist()
                yield pa.RecordBatch.from_arrays(
                    [b.column(1), pa.array([h[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()), pa.array([value[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())],
                    names=["grade", "h", "value"],
                )

    got = own.mapInArrow(run, "grade int, h binary, value binary").toArrow()
    if not got.num_rows:
        return Model(np.empty(0, np.uint64), np.empty(0, np.float32), np.full(n_grades - 1, -40.0))
    # the rows' bytes stand one behind the other in Arrow's buffers: no copies
    h_rows, value_rows = (got.column(c).combine_chunks() for c in ("h", "value"))
    whole = lambda rows, kind: np.frombuffer(rows.buffers()[2], kind)[: pc.sum(pc.binary_length(rows)).as_py() // np.dtype(kind).itemsize]
    n = np.asarray(pc.binary_length(h_rows)) // 8
    grade_of, doc = np.asarray(got.column("grade")), np.repeat(np.arange(len(n), dtype=np.int32), n)
    del got
    return fit(doc, whole(h_rows, np.uint64), whole(value_rows, np.float32), grade_of, n_grades)


def score(df: DataFrame, model: Model, text: str = "text", at_least: int = 2) -> DataFrame:
    """Add expected_grade (double) and tail_probability (that the grade is at_least or more), for each whole text.
    Null and wordless texts are judged by the thresholds alone. Columns so named are replaced; an empty table gives
    an empty result."""
    df = df.drop("expected_grade", "tail_probability")
    at = df.columns.index(text)

    def run(batches):
        for whole in batches:
            for b in slices(whole, at):
                mean, tails = model.grades(b.column(at))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mean), pa.array(np.ascontiguousarray(tails[:, at_least - 1]))], names=[*b.schema.names, "expected_grade", "tail_probability"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType())]))


def graded(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) as ratings: 0 poor, 1 sound but toxic, 2 sound and clean. A null toxic counts as
    clean, a null quality gives no rating."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality").isNotNull(), 2)
    return labels.select("doc_id", grade.alias("grade"))


def classify(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_at: float = 0.7, max_train: int = MAX_TRAIN) -> DataFrame:
    """df with expected_grade, tail_probability (of grade 2: sound and clean) and kept (tail_probability >= keep_at)."""
    model = train(df, graded(labels), doc_id, text, max_train=max_train)
    release()
    return score(df.drop("kept"), model, text).withColumn("kept", F.col("tail_probability") >= keep_at)
