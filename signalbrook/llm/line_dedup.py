"""Line dedup by an exact set-similarity join with prefix, positional and length filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, cut, mix, slices

#: Slots of the tables that tasks know whole (token counts by hash; marks by hash): a fixed size, whatever the input.
SLOTS = 1 << 24
#: In how many parts a table of slots is summed.
CHUNKS = 256
WIDTH = SLOTS // CHUNKS
#: Postings of one token that one task compares at once (or its share of all of them, if that is more); longer lists are dealt into
#: blocks that meet pair by pair. At most SPLIT tokens have so many.
BLOCK, SPLIT = 8192, 1 << 20
#: Sizes up to which a line's parity has 1, 2 and 4 words of 64 bits; beyond, it has 8.
PARITY = np.array([96, 192, 384])
#: Sizes and places are passed on up to here; at it, they rule nothing out.
FULL = 65535
#: A pair is a likely match if its parities differ in this part of the bits that they may.
LIKELY = 2
#: Candidates that a line takes for each likely one that it asks for.
LEAVE = 8
#: Distinct lines that a task remembers at once.
HELD = 400_000
KEY = ["doc", "version", "line"]


def level(n: np.ndarray) -> np.ndarray:
    """A count as a byte that never falls as the count grows: exact to 16, then eight steps to a doubling."""
    big = 16 + np.floor(8 * np.log2(np.maximum(n, 16) / 16))
    return np.minimum(np.where(n <= 16, n, big), 255).astype(np.uint8)


def _runs(key: np.ndarray) -> np.ndarray:
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return np.flatnonzero(first)


def _slots(batches: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sum a task's slots; each chunk of the table goes on as the places and counts that are not zero."""
    own, held = np.zeros(SLOTS, np.uint32), []

    def add():
        slot = np.sort(np.concatenate(held))
        at = _runs(slot)
        own[slot[at]] += np.diff(np.append(at, len(slot))).astype(np.uint32)
        held.clear()

    for slot in batches:
        held.append(slot.astype(np.uint32))
        if sum(map(len, held)) > 1 << 21:
            add()
    if held:
        add()
    for i in range(CHUNKS):
        part = own[i * WIDTH : (i + 1) * WIDTH]
        at = np.flatnonzero(part)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at.astype("<u2").tobytes()]), pa.array([part[at].astype("<u4").tobytes()])], names=["chunk", "at", "n"])


def slot_table(docs: DataFrame, slots, kind: str) -> np.ndarray:
    """The table of the slots that the function slots gives for docs' batches: levels of the counts, or marks. Counts are summed in tasks, then by
    chunk as a stream; the table is what reaches the driver."""

    def run(batches):
        yield from _slots(slots(batches))

    def total(batches):
        chunk, own = -1, None

        def out():
            part = level(own) if kind == "levels" else np.packbits(own > 0)
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part.tobytes()])], names=["chunk", "part"])

        for b in batches:
            for i, at, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if i != chunk:
                    if own is not None:
                        yield out()
                    chunk, own = i, np.zeros(WIDTH, np.int64)
                own[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u4")
        if own is not None:
            yield out()

    parts = docs.mapInArrow(run, "chunk int, at binary, n binary").repartition(min(_width(docs), 16), "chunk").sortWithinPartitions("chunk")
    out = np.zeros(SLOTS, np.uint8) if kind == "levels" else np.zeros(SLOTS // 8, np.uint8)
    step = len(out) // CHUNKS
    for row in parts.mapInArrow(total, "chunk int, part binary").collect():
        out[row.chunk * step : (row.chunk + 1) * step] = np.frombuffer(row.part, np.uint8)
    return out


def _width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _marked(marks: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (marks[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64)


def _key_slot(doc: np.ndarray, version: np.ndarray, line: np.ndarray) -> np.ndarray:
    h = mix(mix(doc.astype(np.int64).view(np.uint64)) ^ version.astype(np.int64).view(np.uint64)) + line.astype(np.uint64)
    return _slot(mix(h))


def token_levels(texts: DataFrame, key: int | None = None) -> np.ndarray:
    """How often each token's slot occurs in all texts, as levels. key: of the words' hashes."""
    return slot_table(texts, lambda batches: (_slot(Words(part.column(0)).hashes(key=key)) for b in batches for part in slices(b)), "levels")


def _sorted_tokens(h: np.ndarray, line: np.ndarray, n_lines: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line, token and level, distinct, ordered by line, level and token."""
    bits_i, bits_l = max(1, (len(h) - 1).bit_length()), max(1, (n_lines - 1).bit_length())
    rest = 56 - bits_i - bits_l
    rarity = levels[_slot(h)]
    if rest >= 16:  # line, level, the token's first bits and its place fit in one word
        key = (line.astype(np.uint64) << np.uint64(64 - bits_l)) | (rarity.astype(np.uint64) << np.uint64(56 - bits_l))
        key |= (h >> np.uint64(64 - rest)) << np.uint64(bits_i)
        key |= np.arange(len(h), dtype=np.uint64)
        key.sort()
        order = (key & np.uint64((1 << bits_i) - 1)).astype(np.int64)
        key >>= np.uint64(bits_i)
        whole, h, line = h, h[order], line[order]
        torn = np.flatnonzero((key[1:] == key[:-1]) & (h[1:] != h[:-1]))
        if len(torn):  # tokens of a line that share their first bits: order these lines by the whole token
            some = np.zeros(n_lines, bool)
            some[line[torn]] = True
            at = np.flatnonzero(some[line])
            own = order[at]
            order[at] = own[np.lexsort((h[at], rarity[own], line[at]))]
            h[at] = whole[order[at]]
    else:
        order = np.lexsort((h, rarity, line))
        h, line = h[order], line[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    return line[first], h[first], rarity[order][first]


def _words_of(size: np.ndarray) -> np.ndarray:
    """Words of parity for lines of these sizes."""
    return 1 << np.searchsorted(PARITY, size)


def parities(token: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of how many tokens each bit is the slot, odd or even: the words of all lines, one line behind the other."""
    words = _words_of(size)
    at = np.cumsum(words) - words
    out = np.zeros(int(words.sum()), np.uint64)
    bit, word = np.uint64(1) << (token & np.uint64(63)), (token >> np.uint64(6)).astype(np.uint8)
    one = np.flatnonzero(words == 1)
    out[at] = np.bitwise_xor.reduceat(bit, begin) if len(begin) else 0
    if len(one) < len(words):
        big = np.repeat(words, size) > 1
        bit, word, w = bit[big], word[big], np.repeat(words, size)[big]
        rows = np.flatnonzero(words > 1)
        first = np.cumsum(size[rows]) - size[rows]
        word &= (w - 1).astype(np.uint8)
        for j in range(8):
            own = rows[words[rows] > j]
            if len(own):
                sums = np.bitwise_xor.reduceat(np.where(word == j, bit, np.uint64(0)), first)
                out[at[own] + j] = sums[words[rows] > j]
    return out


def line_sets(texts: pa.Array, levels: np.ndarray, threshold: float, key: int | None = None) -> dict[str, np.ndarray]:
    """The token set of each line that has words: row, line number, first and last byte, size, parity, and its postings: the tokens of its
    prefix, rarest first, that occur more than once anywhere, with their places."""
    words = Words(texts)
    h = words.hashes(key=key)
    breaks = np.flatnonzero(words.data == 10)
    after = np.zeros(len(h) + 1, bool)
    after[np.searchsorted(words.starts, breaks)] = True
    after[:1] = True
    at = np.flatnonzero(after[:-1])  # the first words of lines
    words_in = np.diff(np.append(at, len(h)))
    row, first = words.row[at], words.starts[at]
    before = np.searchsorted(breaks, first)  # breaks in all texts up to here
    number = before - np.searchsorted(breaks, words.offsets[:-1])[row]
    start, stop = np.append(0, breaks + 1)[before], np.append(breaks, len(words.data))[before]
    line, token, rarity = _sorted_tokens(h, np.repeat(np.arange(len(at)), words_in), len(at), levels)
    begin = _runs(line)
    size = np.diff(np.append(begin, len(line)))
    place = np.arange(len(line)) - np.repeat(begin, size)
    prefix = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
    posted = (place < np.repeat(prefix, size)) & (rarity > 1)
    often = posted & (rarity >= level(np.array([BLOCK]))[0])
    return {"often": token[often],
        "row": row, "line": number, "start": start, "stop": stop, "size": size, "parity": parities(token, begin, size) if len(begin) else np.empty(0, np.uint64),
        "token": token[posted], "place": place[posted], "posts": np.add.reduceat(posted, begin, dtype=np.int64) if len(begin) else np.empty(0, np.int64), "data": words.data,
    }


LINES = "doc binary, version binary, line binary, size binary, parity binary, posts binary, token binary, place binary, digest binary, c_doc binary, c_version binary, c_line binary, of_doc binary, of_line binary, often binary, n_posts long"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def lines_of(docs: DataFrame, levels, threshold: float, secret: int | None = None) -> DataFrame:
    """docs(doc, version, text) to rows that each hold many lines as arrays of bytes: the lines that have words, and of those that a task has
    met before, letter by letter but for the case, their earlier place."""

    def run(batches):
        own, seen = levels.value, {}
        for b in batches:
            for part in slices(b, 2):
                s = line_sets(part.column(2), own, threshold, secret)
                if not len(s["row"]):
                    continue
                doc, version = part.column(0).to_numpy()[s["row"]], part.column(1).to_numpy()[s["row"]]
                text = s["data"].tobytes().translate(_LOWER)
                digests, new, copies = [], np.ones(len(doc), bool), []
                if len(seen) > HELD:
                    seen.clear()
                keys = zip(doc.tolist(), version.tolist(), s["line"].tolist(), strict=True)
                for i, (a, z, key) in enumerate(zip(s["start"].tolist(), s["stop"].tolist(), keys, strict=True)):
                    d = hashlib.blake2b(text[a:z], digest_size=16).digest()
                    digests.append(d)
                    first = seen.setdefault(d, key)
                    if first is key:
                        continue
                    if key < first:  # this one stands earlier
                        seen[d] = key
                    else:
                        new[i] = False
                        if key != first:
                            copies.append((i, first[0], first[2]))
                at = np.flatnonzero(new)
                posted, parity = np.repeat(new, s["posts"]), np.repeat(new, _words_of(s["size"]))
                c, of_doc, of_line = (np.array([x[k] for x in copies], np.int64) for k in range(3))
                digest = np.frombuffer(b"".join(digests), "V16")[at]
                cols = [
                    doc[at].astype("<i8"), version[at].astype("<i8"), s["line"][at].astype("<i4"), np.minimum(s["size"][at], FULL).astype("<u2"), s["parity"][parity],
                    s["posts"][at].astype("<u4"), s["token"][posted], np.minimum(s["place"][posted], FULL).astype("<u2"), digest,
                    doc[c].astype("<i8"), version[c].astype("<i8"), s["line"][c].astype("<i4"), of_doc, of_line.astype("<i4"), s["often"],
                ]
                yield pa.RecordBatch.from_arrays([*[pa.array([x.tobytes()], pa.binary()) for x in cols], pa.array([int(posted.sum())])], names=[x.split()[0] for x in LINES.split(", ")])

    return docs.mapInArrow(run, LINES)


_KINDS = {"doc": "<i8", "version": "<i8", "line": "<i4", "size": "<u2", "parity": "<u8", "posts": "<u4", "token": "<u8", "place": "<u2", "digest": "V16", "c_doc": "<i8", "c_version": "<i8", "c_line": "<i4", "of_doc": "<i8", "of_line": "<i4", "often": "<u8"}


def _rows(batches, names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    for b in batches:
        for row in zip(*(b.column(n).to_pylist() for n in names), strict=True):
            yield {n: np.frombuffer(x, _KINDS[n]) for n, x in zip(names, row, strict=True)}


def _sent(held: list[dict[str, np.ndarray]], to: np.ndarray, columns: list[str], ragged: str | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of arrays, one for each part that something is sent to. ragged: a column of several values to a row, as many as rag says."""
    order = np.argsort(to.astype(np.uint16 if to.max(initial=0) < FULL else np.int64), kind="stable")
    at = _runs(to[order])
    cuts = np.append(at, len(to)).tolist()
    cols = [np.concatenate([h[c] for h in held])[order] for c in columns]
    if ragged:
        rag = np.concatenate([h["rag"] for h in held])
        cols.append(_take(np.concatenate([h[ragged] for h in held]), rag, order))
        ends = np.concatenate([[0], np.cumsum(rag[order])])
    for a, z in zip(cuts, cuts[1:]):
        blobs = [c[a:z].tobytes() for c in cols[: len(columns)]] + ([cols[-1][ends[a] : ends[z]].tobytes()] if ragged else [])
        yield pa.RecordBatch.from_arrays([pa.array([int(to[order[a]])], pa.int32()), *[pa.array([x], pa.binary()) for x in blobs]], names=["to", *columns, *([ragged] if ragged else [])])


def _take(values: np.ndarray, n: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The runs of values (n of each row) in another order of the rows."""
    first = (np.cumsum(n) - n)[order]
    m = n[order]
    return values[np.repeat(first - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]


def copies_of(lines: DataFrame) -> DataFrame:
    """Lines that stand again, letter by letter but for the case, in another task's texts: doc, version, line, and the first such line (of_doc, of_line).
    A task passes on each line once, so that a line that stands everywhere is as many rows as there are tasks."""
    columns, n = ["doc", "version", "line", "digest"], _width(lines)

    def send(batches):
        held, rows = [], 0
        for r in _rows(batches, columns):
            held.append(r)
            rows += len(r["doc"])
            if rows > 1 << 19:
                yield from _sent(held, _part(np.concatenate([h["digest"] for h in held]).view("<u8")[::2], n), columns)
                held, rows = [], 0
        if rows:
            yield from _sent(held, _part(np.concatenate([h["digest"] for h in held]).view("<u8")[::2], n), columns)

    def fold(batches):
        got = list(_rows(batches, columns))
        if not got:
            return
        doc, version, line, digest = (np.concatenate([g[c] for g in got]) for c in columns)
        d = digest.view("<u8").reshape(-1, 2)
        order = np.lexsort((line, version, doc, d[:, 1], d[:, 0]))
        d, doc, version, line = d[order], doc[order], version[order], line[order]
        first = np.ones(len(doc), bool)
        first[1:] = (d[1:] != d[:-1]).any(1)
        of = np.maximum.accumulate(np.where(first, np.arange(len(doc)), 0))
        again = np.flatnonzero((doc != doc[of]) | (version != version[of]) | (line != line[of]))
        for a in range(0, len(again), 1 << 17):
            i = again[a : a + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[i], version[i], line[i], doc[of[i]], line[of[i]])], names=[*KEY, "of_doc", "of_line"])

    sent = lines.mapInArrow(send, "to int, doc binary, version binary, line binary, digest binary")
    return sent.repartitionById(n, "to").mapInArrow(fold, "doc long, version long, line int, of_doc long, of_line int")


def _part(h: np.ndarray, n: int) -> np.ndarray:
    return ((mix(h) >> np.uint64(32)).astype(np.int64) * n) >> 32


def search(t: dict[str, np.ndarray], begin: np.ndarray, threshold: float, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings in groups (begin: the first of each posting's group), earlier lines first: for each posting that asks, the earlier ones of its
    group that no filter rules out, in order, until take of them are likely matches by their parities, or LEAVE times as
    many have been found. Returns positions (later, earlier) and whether the later one may have more."""
    own = threshold / (1 + threshold) * t["size"]
    over = t["size"] - t["place"] + 1e-6 - own  # what a posting can spare: the other's share of the overlap needed must fit in it
    full = t["size"] >= FULL
    over, own = np.where(full, np.inf, over).astype(np.float32), np.where(full, -np.inf, own).astype(np.float32)
    found, likely = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    active = np.flatnonzero(t["asks"] & (begin < np.arange(len(begin))))
    later, earlier = [], []
    k, width = 0, 64
    while len(active):
        n = np.minimum(active - begin[active] - k, width)
        ends = np.cumsum(n)
        a = 0
        while a < len(active):  # so many visits at once
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 19), side="right")))
            y, m = active[a:z], n[a:z]
            row = np.repeat(np.arange(z - a), m)
            x = np.arange(len(row)) + np.repeat(begin[y] + k - (np.cumsum(m) - m), m)
            fits = np.flatnonzero((over[x] >= np.repeat(own[y], m)) & (np.repeat(over[y], m) >= own[x]))
            x, row = x[fits], row[fits]
            ok, good = plausible(t, x, y[row], threshold)
            x, row, good = x[ok], row[ok], good[ok]
            if len(x):
                # how many the posting had found before each of these, in this run of visits and earlier
                first = _runs(row)
                place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
                sums = np.cumsum(good)
                had = sums - good - np.repeat(sums[first] - good[first], np.diff(np.append(first, len(row))))
                at = y[row]
                open_ = (likely[at] + had < take) & (found[at] + place < LEAVE * (take))
                np.add.at(found, at[open_], np.ones(int(open_.sum()), np.int64))
                np.add.at(likely, at[open_], good[open_].astype(np.int64))
                later.append(at[open_])
                earlier.append(x[open_])
            a = z
        k += width
        width *= 4
        active = active[(begin[active] + k < active) & (likely[active] < take) & (found[active] < LEAVE * (take))]
    more = (likely >= take) | (found >= LEAVE * (take))
    later, earlier = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (later, earlier))
    return later, earlier, more[later]


def plausible(t: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs' parities allow a match, and which of them make one likely. Each token that only one of the two has turns one bit."""
    size, words = t["size"], t["words"]
    sums = size[x] + size[y]
    differ = sums - 2 * np.ceil(threshold / (1 + threshold) * sums - 1e-9)
    full = np.maximum(size[x], size[y]) >= FULL
    far = np.bitwise_count(t["fold"][x] ^ t["fold"][y]).astype(np.int64)
    ok = (far <= differ) & (t["within"][y] | (t["side"][x] != t["side"][y])) & (t["id"][x] != t["id"][y])
    wide = np.flatnonzero(ok & (np.minimum(words[x], words[y]) > 1))
    if len(wide):
        far[wide] = apart(t, x[wide], y[wide])
        ok[wide] = far[wide] <= differ[wide]
    ok |= full & (t["id"][x] != t["id"][y]) & (t["within"][y] | (t["side"][x] != t["side"][y]))
    return ok, LIKELY * far <= differ


def apart(t: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits of two lines' parities differ, folded to the shorter of the two."""
    wx, wy, ax, ay, p = t["words"][x], t["words"][y], t["at"][x], t["at"][y], t["parity"]
    w, out = np.minimum(wx, wy), np.zeros(len(x), np.int64)
    for j in range(int(w.max(initial=0))):
        own = np.flatnonzero(w > j)
        sides = []
        for n, at in ((wx[own], ax[own]), (wy[own], ay[own])):
            v = p[at + j]
            for s in range(1, int((n // w[own]).max(initial=1))):
                far = np.flatnonzero(n // w[own] > s)
                v[far] ^= p[at[far] + j + s * w[own][far]]
            sides.append(v)
        out[own] += np.bitwise_count(sides[0] ^ sides[1])
    return out


POSTING = ["group", "doc", "version", "line", "size", "place", "flags"]
_POSTING = {"group": "<u4", "doc": "<i8", "version": "<i8", "line": "<i4", "size": "<u2", "place": "<u2", "flags": "u1", "parity": "<u8"}
WITHIN, SIDE, ASKS = 1, 2, 4


def postings(row: dict[str, np.ndarray], hot: tuple[np.ndarray, np.ndarray], keep=None, asks=None) -> dict[str, np.ndarray]:
    """A row of lines as postings: one for each token of a line's prefix (of those that keep says, if given), once for each pair of blocks
    where a token's list is long. asks: the marks of the lines that look for matches; all, if None."""
    line = np.repeat(np.arange(len(row["doc"])), row["posts"])
    token, place = row["token"], row["place"]
    if keep is not None:
        at = np.flatnonzero(_marked(keep, _slot(token)))
        line, token, place = line[at], token[at], place[at]
    flags = np.full(len(token), WITHIN | ASKS, np.uint8)
    if asks is not None:
        own = _marked(asks, _key_slot(row["doc"], row["version"], row["line"]))
        flags[~own[line]] = WITHIN
    group = token
    if len(hot[0]):
        i = np.minimum(np.searchsorted(hot[0], token), len(hot[0]) - 1)
        parts = np.where(hot[0][i] == token, hot[1][i], 1)
        n = np.where(parts > 1, parts, 1)
        again = np.repeat(np.arange(len(token)), n)
        other = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
        key = (mix(row["doc"].view("<u8")) + row["line"].astype("<u8"))[line]
        mine = (mix(key) % parts.astype(np.uint64)).astype(np.int64)[again]
        low, high = np.minimum(mine, other), np.maximum(mine, other)
        line, place, flags = line[again], place[again], flags[again].copy()
        flags[low != high] &= ~np.uint8(WITHIN)
        flags[mine != low] |= SIDE
        group = np.where(parts[again] > 1, mix(token[again] + ((low << 32) | high).astype(np.uint64)), token[again])  # the same in each row, whatever else it holds
    words = _words_of(row["size"])
    out = {c: row[c][line] for c in ("doc", "version", "line", "size")}
    return out | {"place": place, "flags": flags, "rag": words[line], "parity": _take(row["parity"], words, line), "h": mix(group)}


def candidates(lines: DataFrame, hot, threshold: float, take: int, n: int, keep=None, asks=None) -> DataFrame:
    """Pairs of a later line and an earlier one (x_) that share a token of their prefixes and that no filter rules out; more: whether the later may have others."""
    columns = ["doc", "version", "line", "size", "parity", "posts", "token", "place"]

    def send(batches):
        held, rows = [], 0
        value = lambda b: None if b is None else b.value

        def out():
            h = np.concatenate([x.pop("h") for x in held])
            held[0]["group"] = h.astype("<u4")
            for x in held[1:]:
                x["group"] = np.empty(0, "<u4")
            yield from _sent(held, ((h >> np.uint64(32)).astype(np.int64) * n) >> 32, POSTING, "parity")

        for r in _rows(batches, columns):
            made = postings(r, hot.value, value(keep), value(asks))
            if not len(made["h"]):
                continue
            held.append(made)
            rows += len(made["h"])
            if rows > 1 << 20:
                yield from out()
                held, rows = [], 0
        if rows:
            yield from out()

    def meet(batches):
        got = [{c: np.frombuffer(x, _POSTING[c]) for c, x in zip([*POSTING, "parity"], row, strict=True)} for b in batches for row in zip(*(b.column(c).to_pylist() for c in [*POSTING, "parity"]), strict=True)]
        if not got:
            return
        t = {c: np.concatenate([g[c] for g in got]) for c in [*POSTING, "parity"]}
        del got
        words = _words_of(t["size"])
        at = np.cumsum(words) - words
        order = np.lexsort((t["line"], t["version"], t["doc"], t["group"]))
        t |= {c: t[c][order] for c in POSTING} | {"words": words[order], "at": at[order]}
        t["size"], t["place"] = t["size"].astype(np.int64), t["place"].astype(np.int64)
        t["fold"] = np.bitwise_xor.reduceat(t["parity"], at)[order]
        change = np.ones(len(order), bool)
        change[1:] = t["group"][1:] != t["group"][:-1]
        new = change.copy()
        for c in KEY:
            new[1:] |= t[c][1:] != t[c][:-1]
        t["id"] = np.cumsum(new)  # a line stands twice in a group if two of its tokens share their bits
        t["within"], t["side"], t["asks"] = t["flags"] & WITHIN > 0, t["flags"] & SIDE, t["flags"] & ASKS > 0
        y, x, more = search(t, np.maximum.accumulate(np.where(change, np.arange(len(order)), 0)), threshold, take)
        pair = [t[c][k] for k in (x, y) for c in KEY]
        order = np.lexsort([more, *pair])  # a pair that several tokens have found goes on once
        once = np.zeros(len(order), bool)
        once[-1:] = True
        for c in pair:
            once[:-1] |= c[order][1:] != c[order][:-1]
        order = order[once]
        y, x, more = y[order], x[order], more[order]
        for a in range(0, len(y), 1 << 17):
            i, j = y[a : a + (1 << 17)], x[a : a + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(t[c][k]) for k in (i, j) for c in KEY] + [pa.array(more[a : a + (1 << 17)])], names=[*KEY, *[f"x_{c}" for c in KEY], "more"])

    kinds = ", ".join(f"{c} binary" for c in [*POSTING, "parity"])
    sent = lines.select(*columns).mapInArrow(send, f"to int, {kinds}").repartitionById(n, "to")
    return sent.mapInArrow(meet, "doc long, version long, line int, x_doc long, x_version long, x_line int, more boolean")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of the wanted lines (distinct doc, version, line), as bytes. Lines are picked where the documents lie, by a
    table of SLOTS bits that marks the wanted ones' hashes; what else it lets through falls out at the join."""

    def slots(batches):
        return (_key_slot(*[b.column(i).to_numpy() for i in range(3)]) for b in batches)

    marks = docs.sparkSession.sparkContext.broadcast(slot_table(wanted.select(*KEY), slots, "marks"))

    def pick(batches):
        own = marks.value
        for whole in batches:
            for b in slices(whole, 2):
                texts = pc.fill_null(b.column(2).cast(pa.large_binary()), b"")
                offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
                if not len(texts) or texts.buffers()[2] is None:
                    data = np.empty(0, np.uint8)
                else:
                    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
                offsets = offsets - offsets[0]
                breaks = np.flatnonzero(data == 10)
                upto = np.searchsorted(breaks, offsets)
                n = np.diff(upto) + 1
                row = np.repeat(np.arange(len(n)), n)
                line = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                doc, version = b.column(0).to_numpy()[row], b.column(1).to_numpy()[row]
                at = np.flatnonzero(_marked(own, _key_slot(doc, version, line)))
                row, line = row[at], line[at]
                k = upto[row] + line
                if len(breaks):
                    start = np.where(line > 0, breaks[np.clip(k - 1, 0, len(breaks) - 1)] + 1, offsets[row])
                    stop = np.where(line < n[row] - 1, breaks[np.minimum(k, len(breaks) - 1)], offsets[row + 1])
                else:
                    start, stop = offsets[row], offsets[row + 1]
                raw = data.tobytes()
                parts = [raw[a:z] for a, z in zip(start.tolist(), stop.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(version[at]), pa.array(line.astype(np.int32)), pa.array(parts, pa.binary())], names=[*KEY, "text"])

    return docs.mapInArrow(pick, "doc long, version long, line int, text binary").join(wanted, KEY).dropDuplicates(KEY)


def verified(found: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs found, those whose texts' sets of words have a Jaccard similarity of threshold or more."""
    x_key = [f"x_{c}" for c in KEY]
    wanted = found.select(*KEY).unionByName(found.select(*[F.col(x).alias(c) for x, c in zip(x_key, KEY, strict=True)])).distinct()
    texts = cut(texts_of(docs, wanted))
    both = found.join(texts.withColumnRenamed("text", "y_text"), KEY).join(texts.select(*[F.col(c).alias(x) for c, x in zip(KEY, x_key, strict=True)], F.col("text").alias("x_text")), x_key)

    def run(batches):
        last, x = None, frozenset()
        for b in batches:
            keep = []
            for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                y = frozenset(a.lower().split())  # on bytes: A-Z and the six ASCII spaces only
                if c != last:
                    last, x = c, frozenset(c.lower().split())
                n = len(y & x)
                keep.append(n / (len(y) + len(x) - n) >= threshold)
            yield pa.RecordBatch.from_arrays([*b.columns[2:]], names=b.schema.names[2:]).filter(pa.array(keep, pa.bool_()))

    return both.select("y_text", "x_text", *KEY, *x_key).mapInArrow(run, "doc long, version long, line int, x_doc long, x_version long, x_line int")


def near_matches(docs: DataFrame, lines: DataFrame, copies: DataFrame, threshold: float) -> DataFrame:
    """For each line that is no copy and matches an earlier one: the earliest match verified (of_doc, of_line).

    Of a group of postings a line takes its earliest candidates first; one that none of them verifies, and that has more, asks again, among its
    own tokens' postings, for eight times as many, until no line has any left: nothing is cut off."""
    sc = docs.sparkSession.sparkContext
    total = lines.agg(F.coalesce(F.sum("n_posts"), F.lit(0))).first()[0]
    limit = max(BLOCK, total // SPLIT)
    n = max(_width(lines), total // (1 << 22))

    def often(batches):  # tokens that may have long lists: those frequent anywhere, as they stand in prefixes
        for r in _rows(batches, ["often"]):
            token, times = np.unique(r["often"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view("<i8")), pa.array(times.astype("<i8"))], names=["token", "n"])

    many = lines.select("often").mapInArrow(often, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > limit).toArrow()  # SPLIT rows at most
    token, parts = np.asarray(many.column("token")).view("<u8"), -(-np.asarray(many.column("n")) // limit)
    hot = (np.sort(token), parts[np.argsort(token)])
    hot = sc.broadcast(hot)
    best, take, keep, asks = None, 2, None, None
    while True:
        pairs = candidates(lines, hot, threshold, take, n, keep, asks).groupBy(*KEY, *[f"x_{c}" for c in KEY]).agg(F.max("more").alias("more"))
        found = cut(pairs.join(copies.select(*KEY), KEY, "left_anti"))
        now = verified(found, docs, threshold).groupBy(*KEY).agg(F.min(F.struct("x_doc", "x_version", "x_line")).alias("x")).select(*KEY, F.col("x.x_doc").alias("of_doc"), F.col("x.x_line").alias("of_line"))
        best = cut(now if best is None else best.unionByName(now))
        asking = cut(found.where("more").select(*KEY).distinct().join(best, KEY, "left_anti"))
        if asking.isEmpty():
            return best
        asks = sc.broadcast(slot_table(asking, lambda batches: (_key_slot(*[b.column(i).to_numpy() for i in range(3)]) for b in batches), "marks"))

        def theirs(batches, asks=asks):
            for r in _rows(batches, ["doc", "version", "line", "posts", "token"]):
                own = _marked(asks.value, _key_slot(r["doc"], r["version"], r["line"]))
                yield _slot(r["token"][np.repeat(own, r["posts"])])

        keep = sc.broadcast(slot_table(lines.select("doc", "version", "line", "posts", "token"), theirs, "marks"))
        take *= 8


def _copies_in_tasks(lines: DataFrame) -> DataFrame:
    names = ["c_doc", "c_version", "c_line", "of_doc", "of_line"]

    def run(batches):
        for r in _rows(batches, names):
            yield pa.RecordBatch.from_arrays([pa.array(r[n]) for n in names], names=[*KEY, "of_doc", "of_line"])

    return lines.select(*names).mapInArrow(run, "doc long, version long, line int, of_doc long, of_line int")


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8, key: int = 1) -> DataFrame:
    """df with its text rid of lines that match an earlier one, and n_lines, n_removed and removed: for each line that went its
    number (from 0), and the document and number of an earlier line that it matches (of several, which one can depend on how the
    rows lie; what goes does not).

    Lines are the text's parts between line feeds; two match if the Jaccard similarity of their sets of words (A-Z
    lowered) is at least threshold. Order is by document id (nulls first), then line number; every line that
    matches an earlier one goes. Lines without words stay, and match nothing. A document whose lines all go stays as a row with what is
    left of its text, perhaps none.

    Lines alike letter by letter (A-Z lowered; compared by 128-bit BLAKE2) are one line from the start; all other pairs, those of equal
    sets among them, are verified on their words. Which lines are compared is decided by 64-bit hashes of words under key; a
    secret one keeps out words that were made to have equal hashes.

    Null texts stay null; rows that repeat both id and text are one document and stay alike; rows that repeat an id with other
    texts are told apart by a hash of the text. Ids must fit in a long; -2^63 counts as null. Extra columns stay,
    those named like the new ones are replaced; an empty table gives an empty result."""
    made = ["n_lines", "n_removed", "removed"]
    df = df.drop(*made)
    sc = df.sparkSession.sparkContext
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))
    repeated = df.select(doc.alias("doc")).groupBy("doc").count().where("count > 1")
    version = F.lit(0).cast("long") if repeated.isEmpty() else F.xxhash64(text)
    docs = df.select(doc.alias("doc"), version.alias("version"), F.col(text).alias("text"))
    lines = cut(lines_of(docs, sc.broadcast(token_levels(docs.select("text"), key)), threshold, key))
    copies = cut(copies_of(lines))
    near = near_matches(docs, lines, copies, threshold)
    gone = _copies_in_tasks(lines).unionByName(copies).unionByName(near)
    entries = F.array_sort(F.collect_list(F.struct("line", "of_doc", "of_line")))
    per_doc = gone.groupBy(F.col("doc").alias("g_doc_"), F.col("version").alias("g_version_")).agg(entries.alias("all_"))
    # a line of a document that stands in several rows can be told more than once
    removed = F.filter("all_", lambda e, i: (i == 0) | (F.get("all_", i - 1)["line"] != e["line"]))
    per_doc = per_doc.select("g_doc_", "g_version_", removed.alias("removed")).hint("shuffle_hash")
    joined = df.join(per_doc, (doc == F.col("g_doc_")) & (version == F.col("g_version_")), "left").drop("g_doc_", "g_version_")
    numbers = F.transform("removed", lambda e: e["line"])
    # the lines are a column first (n_lines, a name that is free until it gets its number): within transform the text would be split again for each line
    joined = joined.withColumn("n_lines", F.when(F.col("removed").isNotNull(), F.split(text, "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("n_lines") - 1), numbers)
    left = F.array_join(F.transform(stay, lambda i: F.get("n_lines", i)), "\n")
    none = F.array().cast("array<struct<line:int,of_doc:bigint,of_line:int>>")
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return joined.withColumns({
        "n_lines": F.coalesce(breaks + 1, F.lit(0)).cast("long"),
        "n_removed": F.coalesce(F.size("removed"), F.lit(0)).cast("long"),
        text: F.when(F.col("removed").isNull(), F.col(text)).otherwise(left),
        "removed": F.coalesce("removed", none),
    })
