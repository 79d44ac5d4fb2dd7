"""Audit of sources: how the words of each source differ from the other sources' and from the language's, in whole numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _TAIL, cut, slices, small

#: A term is a run of letters a to z (A-Z lowered) and bytes beyond ASCII.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
TERM = np.zeros(256, dtype=bool)
TERM[[*range(97, 123), *range(128, 256)]] = True

SCALE = 1000  # cubed: the unit of a share
#: Counts of (source, term) that one task works on, about; more where a language has so many sources that a block's pairs would outnumber its
#: counts, but at most MOST.
BLOCK, MOST = 1 << 15, 1 << 22
ROWS = "lang string, source string, term string, n long, docs long"


class Terms:
    """The terms of a column of texts. code: of each occurrence, in order; row: the text that it is in; terms: by code, as bytes."""

    def __init__(self, texts: pa.Array, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest):
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        size = np.asarray(pc.binary_length(texts), np.int64)
        whole = pa.LargeListArray.from_arrays(pa.array([0, len(texts)]), texts)
        joined = pc.binary_join(whole, pa.scalar(b"\n", pa.large_binary()))[0].as_py() if len(texts) else b""
        data = np.zeros(len(joined) + 16, np.uint8)
        data[: len(joined)] = LOWER[np.frombuffer(joined, np.uint8)]
        inside = np.zeros(len(joined) + 2, bool)
        inside[1:-1] = TERM[data[: len(joined)]]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edges[::2], edges[1::2]
        offsets = np.concatenate([[0], np.cumsum(size + 1)])
        self.row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, offsets)))
        raw = data.tobytes()
        each = map(raw.__getitem__, map(slice, start.tolist(), end.tolist()))
        hashes = np.fromiter(map(digest, each), np.uint64, len(start))
        _, first, self.code = np.unique(hashes, return_index=True, return_inverse=True)
        self.terms = [raw[start[i] : end[i]] for i in first.tolist()]
        self._verify(data, raw, start, end, first)

    def _verify(self, data: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> None:
        """Occurrences whose bytes are not those of the first one with their hash get codes of their own."""
        eight = np.ndarray((len(data) - 7,), "<u8", data.data, strides=(1,))  # the eight bytes from each place on
        size, twin = end - start, first[self.code]
        same = size == size[twin]
        left = np.flatnonzero(same)
        for k in range(0, int(size.max(initial=0)), 8):
            left = left[size[left] > k]
            tail = np.take(_TAIL, size[left] - k, mode="clip")
            same[left] &= (eight[start[left] + k] & tail) == (eight[start[twin[left]] + k] & tail)
        more: dict[bytes, int] = {}
        for i in np.flatnonzero(~same).tolist():
            self.code[i] = more.setdefault(raw[start[i] : end[i]], len(self.terms) + len(more))
        self.terms += more


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of text, lang, source: what each group has of each term, and in how many of its texts; a row of the empty term for each group."""
    for batch in batches:
        for part in slices(batch):
            found = Terms(part.column(0))
            names: dict[tuple[str, str], int] = {}
            group = np.array([names.setdefault(x, len(names)) for x in zip(part.column(1).to_pylist(), part.column(2).to_pylist())], np.int64)
            n = max(1, len(found.terms))
            cell, count = np.unique(group[found.row] * n + found.code, return_counts=True)
            once = np.sort(found.row * n + found.code)
            once = once[np.append(True, once[1:] != once[:-1])[: len(once)]]
            _, texts = np.unique(group[once // n] * n + once % n, return_counts=True)
            lang, source = (pa.array([k[i] for k in names]) for i in (0, 1))
            at = pa.array(np.concatenate([cell // n, np.arange(len(names))]))
            term = pa.array(found.terms, pa.binary()).take(pa.array(cell % n)).cast(pa.string()) if len(cell) else pa.array([], pa.string())
            none = np.zeros(len(names), np.int64)
            yield pa.RecordBatch.from_arrays(
                [lang.take(at), source.take(at), pa.concat_arrays([term, pa.array([""] * len(names))]), pa.array(np.concatenate([count, none])), pa.array(np.concatenate([texts, none]))],
                names=["lang", "source", "term", "n", "docs"],
            )


def shares(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)), by three long divisions by a thousand each, so that no product leaves 64 bits
    (for totals under 9 * 10^15)."""
    rest, whole = np.asarray(count, np.int64) + 2, np.asarray(total, np.int64) + 2 * terms
    out = np.zeros(np.broadcast(rest, whole).shape, np.int64)
    for _ in range(3):
        rest = rest * SCALE
        out = out * SCALE + rest // whole
        rest = rest % whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of the stretches of values between begins (one more than there are stretches); 0 for an empty one."""
    out = np.zeros(len(begins) - 1, np.int64)
    full = np.flatnonzero(np.diff(begins))
    if len(full):
        out[full] = np.add.reduceat(values, begins[full])
    return out


def compare(counts: pd.DataFrame, groups: pd.DataFrame, top: int = 10) -> pd.DataFrame:
    """One block of a language's terms. counts: source, term, n, lang_n; groups: all sources of the language with their totals (source, total, terms,
    lang_total). Gives each pair of sources' share of the divergence, smaller source first, and each source's top terms of the block.

    Counts stand as a sparse matrix by source (CSR). A term that a source lacks has the source's least share, so of two sources only the
    terms that either has are visited: where the second has one, what it adds over its least share is summed by reduceat."""
    groups = groups.sort_values("source", key=lambda s: s.str.encode("utf-8")).reset_index(drop=True)
    names, total = groups.source.tolist(), groups.total.to_numpy(np.int64)
    n_terms, lang_total = int(groups.terms[0]), int(groups.lang_total[0])
    words = sorted(set(counts.term), key=str.encode)
    place, spot = {s: i for i, s in enumerate(names)}, {t: i for i, t in enumerate(words)}
    row, col = counts.source.map(place).to_numpy(np.int64), counts.term.map(spot).to_numpy(np.int64)
    order = np.lexsort((col, row))
    row, col, n = row[order], col[order], counts.n.to_numpy(np.int64)[order]
    begins = np.searchsorted(row, np.arange(len(names) + 1))
    out = []
    if n_terms:
        least = shares(np.zeros(len(names), np.int64), total, n_terms)
        p = shares(n, total[row], n_terms)
        for a in range(len(names)):
            own = slice(begins[a], begins[a + 1])
            mine = np.full(len(words), least[a])
            mine[col[own]] = p[own]
            tail = slice(begins[a + 1], None)
            added = divergence(mine[col[tail]], p[tail]) - divergence(mine[col[tail]], least[row[tail]])
            value = _sums(added, begins[a + 1 :] - begins[a + 1])
            value += (len(words) - (begins[a + 1] - begins[a])) * divergence(least[a], least[a + 1 :])
            for b in range(a + 1, len(names), 64):
                value[b - a - 1 : b - a + 63] += divergence(p[own][:, None], least[None, b : b + 64]).sum(axis=0)
            out += [(names[a], "pair", names[b], int(v)) for b, v in zip(range(a + 1, len(names)), value.tolist())]
        lang_n = np.zeros(len(words), np.int64)
        lang_n[col] = counts.lang_n.to_numpy(np.int64)[order]
        q = shares(lang_n, lang_total, n_terms)[col]
        for a in range(len(names)):
            more = np.flatnonzero(p[begins[a] : begins[a + 1]] > q[begins[a] : begins[a + 1]]) + begins[a]
            value = divergence(p[more], q[more])
            for i in np.lexsort((col[more], -value))[:top].tolist():
                out.append((names[a], "term", words[col[more[i]]], int(value[i])))
    else:
        out = [(s, "pair", t, 0) for i, s in enumerate(names) for t in names[i + 1 :]]
    return pd.DataFrame(out, columns=["source", "part", "item", "value"])


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10, top: int = 10, block: int = BLOCK) -> DataFrame:
    """How far each source of a language is from every other (part pair) and by which terms it stands out in its language (part term): lang, source,
    part, item, value, rank. See compare for what is summed; of terms only those in at least least_docs texts of the language count, and only the first
    top ranks of terms are given.

    Texts are counted where they lie, four megabytes at a time; only sums of (lang, source, term) are shuffled. The terms of a language are dealt to
    blocks of about `block` counts (BLOCK, MOST) by their hash, so that a large language or source is worked on by many tasks; a block gets all sources' totals
    beside its counts. Its result is a row for each pair of sources, as the whole result has.

    Null texts, languages and sources count as the empty text; repeated rows count each time; a group without terms is compared all the same; a
    language of one source has no pairs; an empty table gives no rows; other columns are not looked at."""
    texts = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    counted = cut(texts.mapInArrow(_count, ROWS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = counted.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.count("*").alias("cells"))
    kept = cut(terms.where(F.col("docs") >= least_docs).drop("docs"))
    groups = counted.where("term = ''").select("lang", "source")
    whole = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"), F.sum("cells").alias("cells"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(whole, "lang", "left")
    size = F.least(F.lit(MOST), F.greatest(F.lit(block), F.col("sources") * F.col("sources")))
    # few languages would deal all counts to few tasks
    langs = small(langs.select("lang", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("terms", "lang_total")], (F.coalesce(F.col("cells"), F.lit(0)) / size + 1).cast("long").alias("blocks")))
    cells = cut(counted.where("term <> ''").select("lang", "source", "term", "n").join(kept.drop("cells"), ["lang", "term"]))
    totals = groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang")
    every = totals.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", F.coalesce("total", F.lit(0).cast("long")).alias("total"), "terms", "lang_total")
    dealt = cells.join(langs.select("lang", "blocks"), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "n", "lang_n")

    def both(key: tuple, counts: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        made = compare(counts, groups, top)
        made.insert(0, "lang", key[0])
        return made

    parts = cut(dealt.groupBy("lang", "block").cogroup(every.groupBy("lang", "block")).applyInPandas(both, "lang string, source string, part string, item string, value long"))
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda x: x.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(parts.where("part = 'term'")).where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
