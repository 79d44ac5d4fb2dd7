"""Judge URLs: rules by host and path first, then logistic regression on hashed character n-grams."""

from __future__ import annotations

import csv
import io
import re
from importlib import resources
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, slices

#: The rules that the query applies, and what they decide.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

#: The small labelled URL table: url and whether to block, invented names under .example.
LABELLED = "labelled_urls.csv"

BUCKETS = 1 << 15
SIZES = (3, 4, 5)


def split_url(url: str) -> tuple[Column, Column]:
    """Host (after the first :// up to /, ?, # or the end, A-Z lowered) and path (then up to ?, # or the end) as columns.
    Both are empty for null or where there is no ://."""
    column = F.col("`" + url.replace("`", "``") + "`")
    rest = F.when(F.instr(column, "://") > 0, F.substring(column, F.instr(column, "://") + 3, F.length(column))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    whole = F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 1)
    host = F.translate(whole, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 2)


def match_rule(host: Column, path: Column, rules: dict[str, str] | None = None) -> tuple[Column, Column]:
    """The longest rule that fits (its host or a subdomain of it, and a path that starts with the rule's) and what it
    decides; null where none fits. Rules of one length go by their text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, v in sorted((rules or RULES).items(), key=lambda x: (len(x[0]), x[0])):
        cut = r.index("/")
        fits = ((host == r[:cut]) | host.endswith("." + r[:cut])) & path.startswith(r[cut:])
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each character n-gram (as UTF-8 bytes) of the texts, the ends of a text marked by a byte before and one after it. Rows are told by
    where texts begin, so that a text may hold any characters."""
    each = [b"\x02" + (t or "").encode() + b"\x03" for t in texts.to_pylist()]
    data = np.frombuffer(b"".join(each), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(each)), [len(t) for t in each])
    rows, buckets = [], []
    for n in SIZES:
        if len(data) < n:
            continue
        h = np.zeros(len(data) - n + 1, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + data[k : k + len(h)] + np.uint64(n)
        same = row[: len(h)] == row[n - 1 :]
        rows.append(row[: len(h)][same])
        buckets.append((mix(h[same]) % np.uint64(BUCKETS)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(buckets)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def probabilities(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    row, bucket = grams(texts)
    n = np.maximum(1, np.bincount(row, minlength=len(texts)))
    z = np.bincount(row, weights[bucket], len(texts)) / np.sqrt(n) + bias
    return 1 / (1 + np.exp(-z))


def read_labelled(table: str | Path | list[tuple[str, int]] | None = None) -> list[tuple[str, int]]:
    """Host and path, as the operator reads them, of the labelled urls, and whether to block. table: rows, or a small CSV file with the columns url
    and block; the package's own if None."""
    if not isinstance(table, list):
        own = resources.files(__package__).joinpath(LABELLED)  # a zipped package has it too
        text = (Path(table) if table else own).read_text()
        table = [(r["url"], int(r["block"])) for r in csv.DictReader(io.StringIO(text))]
    out = []
    for url, block in table:
        m = re.match(r"(?s)^([^/?#]*)([^?#]*)", url.split("://", 1)[1] if "://" in url else "")
        out.append((m[1].translate({c: c + 32 for c in range(65, 91)}) + m[2], block))
    return out


def train(labelled: list[tuple[str, int]] | None = None, rounds: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression by gradient descent on the small labelled table (read_labelled; every row is used)."""
    labelled = read_labelled() if labelled is None else labelled
    y = np.array([v for _, v in labelled], float)
    row, bucket = grams(pa.array([text for text, _ in labelled]))
    value = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(y))))[row]
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        z = np.bincount(row, w[bucket] * value, len(y)) + b
        off = 1 / (1 + np.exp(-z)) - y
        w -= rate * (np.bincount(bucket, off[row] * value, BUCKETS) + ridge * w)
        b -= rate * off.mean()
    return w, b


def held_out_error(folds: int = 5, table: str | Path | list[tuple[str, int]] | None = None) -> float:
    """The share of labelled urls that a model judges wrong which has not seen them: each fold by the others'."""
    rows = read_labelled(table)
    wrong = 0
    for k in range(folds):
        w, b = train([r for i, r in enumerate(rows) if i % folds != k])
        held = [r for i, r in enumerate(rows) if i % folds == k]
        wrong += sum((p >= 0.5) != bool(y) for p, (_, y) in zip(probabilities(pa.array([t for t, _ in held]), w, b), held, strict=True))
    return wrong / len(rows)


def judge(df: DataFrame, url: str = "url", rules: dict[str, str] | None = None, labelled: str | Path | list[tuple[str, int]] | None = None) -> DataFrame:
    """Add host, path, rule, block_probability and verdict (allow or block: the rule's, else block where the probability
    is at least a half).

    Null urls and those without :// have empty host and path; the model judges the empty text for them, for which it knows no more than how often labelled urls
    are blocked (with the package's own table it blocks them, just). Columns so
    named are replaced; empty tables give an empty result; repeated rows each come back."""
    df = df.drop("host", "path", "rule", "verdict", "block_probability")
    w, b = train(read_labelled(labelled))
    w = w.astype("f4")

    @F.pandas_udf("double")
    def blocked(texts):
        import pandas as pd

        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
        found = [probabilities(part.column(0), w, b) for part in slices(batch)]
        return pd.Series(np.concatenate([np.empty(0), *found]), dtype="f8")

    host, path = split_url(url)
    named = df.withColumns({"host": host, "path": path})
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    named = named.withColumns({"rule": rule, "verdict_": verdict, "block_probability": blocked(F.concat("host", "path"))})
    by_model = F.when(F.col("block_probability") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return named.withColumn("verdict", F.coalesce("verdict_", by_model)).drop("verdict_")
