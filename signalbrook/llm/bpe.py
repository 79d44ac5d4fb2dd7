"""Byte-level BPE: encode whole texts with tiktoken and a local rank file, decode ids to raw bytes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

#: A place where no match of the pattern can run across: a space between two letters or digits starts a match,
#: and so does any change from a letter or digit to another class.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?= [\p{L}\p{N}])|(?<=\p{L})(?=[\p{N}])|(?<=\p{N})(?=\p{L})")


@lru_cache(maxsize=4)
def encoding(ranks_file: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: A run of white space from here on is not given to the pattern, whose lookahead takes a step of the stack for each of its characters.
LONG_SPACE = 10_000
_SPACES = regex.compile(r"\p{White_Space}{%d,}" % LONG_SPACE)


def stretches(text: str) -> Iterator[tuple[str, bool]]:
    """A text in stretches, and whether a stretch is one match of the pattern: of a long run of white space all but its last character is, or
    all of it at the text's end; the last one begins what follows."""
    at = 0
    for m in _SPACES.finditer(text) if len(text) >= LONG_SPACE else ():
        end = m.end() if m.end() == len(text) else m.end() - 1
        yield text[at : m.start()], False
        yield text[m.start() : end], True
        at = end
    yield text[at:], False


def pieces(text: str, limit: int) -> Iterator[str]:
    """Cut a text at safe places into pieces of limit characters, longer where no safe place comes earlier."""
    at = 0
    while len(text) - at > limit:
        m = SAFE.search(text, at + limit)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode_text(enc: tiktoken.Encoding, text: str, limit: int) -> list[int]:
    if len(text) <= min(limit, LONG_SPACE):
        return enc.encode_ordinary(text)
    out: list[int] = []
    for part, whole in stretches(text):
        if whole:
            out += enc._encode_single_piece(part)
        else:
            for piece in pieces(part, limit):
                out += enc.encode_ordinary(piece)
    return out


def _parts(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about four megabytes of texts, or of lists of ids."""
    column = batch.column(at)
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        size = np.nan_to_num(np.asarray(pc.list_value_length(column).to_numpy(zero_copy_only=False), dtype="f8"))
        edges = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // (1 << 20))) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a)
    else:
        yield from slices(batch, at)


def _mapped(df: DataFrame, column: str, fields: list[tuple[str, T.DataType]], arrow: list[pa.DataType], one) -> DataFrame:
    """df with further columns that one(value) gives for the column's values, some megabytes of them at a time."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in fields]])
    at = df.columns.index(column)

    def run(batches):
        for batch in batches:
            for part in _parts(batch, at):
                made = list(zip(*[one(v) for v in part.column(at).to_pylist()], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *[pa.array(v, t) for v, t in zip(made, arrow, strict=True)]],
                    names=[*part.schema.names, *[n for n, _ in fields]],
                )

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", ranks_file: str | None = None, pattern: str | None = None, limit: int = 1 << 16) -> DataFrame:
    """Add ids (array<int>): the tokens of each whole text, the same as tiktoken gives for the text at once.

    Texts over limit characters are cut where the pattern cannot match across and encoded piece by piece; a run
    without such a place stays whole, a long one of white space as the one match that it is. No special tokens. Null counts as empty (no ids); a column named like
    ids is replaced."""
    df, file, pat = df.drop(ids), ranks_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def one(v):
        return (encode_text(encoding(file, pat), v or "", limit),)

    return _mapped(df, text, [(ids, T.ArrayType(T.IntegerType(), False))], [pa.list_(pa.int32())], one)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", ranks_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add out (binary): the raw bytes that the ids stand for, which need not be valid UTF-8 for ids of a part
    of a text. Null ids count as none; a column named like out is replaced."""
    df, file, pat = df.drop(out), ranks_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def one(v):
        return (encoding(file, pat).decode_bytes(v or []),)

    return _mapped(df, ids, [(out, T.BinaryType())], [pa.binary()], one)


def round_trip_digests(df: DataFrame, text: str = "text", ranks_file: str | None = None, pattern: str | None = None, limit: int = 1 << 16, keep_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass: adds n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit
    integers) and decoded_sha256 (of the decoded bytes), both lowercase hex, and with keep_ids the ids themselves
    (array<int>). Columns so named are replaced; null counts as the empty text."""
    file, pat = ranks_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), ("ids", T.ArrayType(T.IntegerType(), False))]
    df = df.drop(*[n for n, _ in fields[: 4 if keep_ids else 3]])

    def one(v):
        enc = encoding(file, pat)
        ids = encode_text(enc, v or "", limit)
        digests = len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()
        return (*digests, ids) if keep_ids else digests

    n = 4 if keep_ids else 3
    return _mapped(df, text, fields[:n], [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())][:n], one)
