"""Conversation structure repair: the cheapest edits that make turns alternate, by a DP over the turns that stay."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Prices of the edits; a truncated turn that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: What stands before the next turn: nothing yet (^), or a turn of system, user or assistant. How many turns must be put in before a turn of a
#: role can follow; system only comes first. At the end, what is needed to be complete.
NEED = {"s": {"^": 0}, "u": {"^": 0, "s": 0, "a": 0, "u": 1}, "a": {"u": 0, "^": 1, "s": 1, "a": 1}}
END = {"^": 0, "s": 2, "u": 1, "a": 0}
#: A conversation of more rows or bytes than these is worked on in pieces of so many rows by many tasks.
LONG, LONG_BYTES, PIECE = 4096, 4 << 20, 1024

#: A row of a conversation: role, text, how many times it stands there, whether its role and text are new.
Row = tuple[str, str, int, bool]


def faults(rows: list[Row]) -> list[str]:
    """b (blank), d (duplicate), t (truncated) or empty for the first copy of each row; further copies are b or d."""
    out = []
    for _, text, _, new in rows:
        seen = text.strip(SPACE)
        out.append("b" if not seen else "d" if not new else "" if seen[-1] in ".!?" else "t")
    return out


def edits(rows: list[Row], found: list[str], entry: str = "^") -> dict[str, tuple[int, str]]:
    """The cheapest edits of rows that lead from what stands before them (entry) to each role that may stand last: cost and audit, of equal costs
    the ASCII-least audit. Retained turns are chosen in order: a turn follows the best retained one before it, for which each role keeps a running
    minimum of cost less the deletions up to there, so that the gap between the two is priced by the difference of two prefix sums; the pair of
    roles says what must be inserted. In a gap deletions stand before insertions, which is ASCII-least."""
    gone = [0]  # rows before each, copies counted
    for _, _, copies, _ in rows:
        gone.append(gone[-1] + copies)
    best = {entry: (0, "", 0)}  # role: cost less deletions, audit, how many rows the audit covers
    for j, ((role, _, _, _), fault) in enumerate(zip(rows, found)):
        if fault in ("b", "d"):
            continue
        extra, made = TRUNCATED if fault == "t" else 0, {}

        def offer(to: str, price: int, inserts: int, letter: str, had: tuple[int, str, int]):
            value, audit, covered = had
            option = (value + price + extra + INSERT * inserts - DELETE, audit + "D" * (gone[j] - covered) + "I" * inserts + letter)
            if to not in made or option < made[to]:
                made[to] = option

        for state, had in best.items():
            first = role[:1]
            if not first:  # a role without a character changes nothing, and may stand before or after what is inserted
                offer(state, 0, 0, "K", had)
                for to in {"u", "a"} - {state}:
                    offer(to, 0, NEED[to][state] + 1, "K", had)
            elif first in NEED and state in NEED[first]:
                offer(first, 0, NEED[first][state], "K", had)
            for to in ("u", "a"):
                offer(to, REROLE, NEED[to][state], "R", had)
        for to, (value, audit) in made.items():
            had = best.get(to)
            if had is None or (value, audit) < (had[0], had[1] + "D" * (gone[j] + 1 - had[2])):
                best[to] = (value, audit, gone[j] + 1)
    return {s: (value + DELETE * gone[-1], audit + "D" * (gone[-1] - covered)) for s, (value, audit, covered) in best.items()}


def complete(ends: dict[str, tuple[int, str]]) -> tuple[int, str]:
    """The best of edits that lead to each last role, with what completes it."""
    return min((cost + INSERT * END[s], audit + "I" * END[s]) for s, (cost, audit) in ends.items())


def replay(rows: list[Row], audit: str, entry: str = "^") -> list[tuple[str, str]]:
    """The turns (role, text) that an audit makes of rows: a rerole or insertion has the one role that fits."""
    each, state, out = ((r, t) for r, t, copies, _ in rows for _ in range(copies)), entry, []
    for letter in audit:
        role, text = next(each) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter in "IR":
            role = ROLES["a" if state == "u" else "u"]
        state = role[:1] or state
        out.append((role, text))
    return out


def counts(rows: list[Row], found: list[str]) -> tuple[int, int, int, int]:
    """blank, duplicate, truncated; adjacent pairs of roles that are not legal, copies counted."""
    blank = sum(c for (_, _, c, _), f in zip(rows, found) if f == "b")
    duplicate = sum(c if f == "d" else c - 1 for (_, _, c, _), f in zip(rows, found) if f != "b")
    firsts = [r[:1] for r, _, _, _ in rows]
    illegal = sum(c - 1 for _, _, c, _ in rows) + sum(a + b not in LEGAL for a, b in zip(firsts, firsts[1:]))
    return blank, duplicate, sum(f == "t" for f in found), illegal


def digest(turns: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations damaged by the CRC-32 of `conv:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and question
    marks, 3 has it stand twice, 4 makes it the user's. Nulls of the key, of role and of text are one space; further columns go.

    Adds copies (0 for a dropped row, so that a conversation that lost all rows is still known)."""
    space = F.lit(" ")
    d = F.pmod(F.crc32(F.concat(F.coalesce(F.col(conv).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space)).cast("binary")), F.lit(20))
    body = F.coalesce(text, space)
    return df.select(conv, turn, F.when(d == 4, "user").otherwise(F.coalesce(role, space)).alias(role), F.when(d == 1, "").when(d == 2, F.translate(body, ".!?", "")).otherwise(body).alias(text), F.when(d == 0, 0).when(d == 3, 2).otherwise(1).alias("copies"))


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None, long_rows: int = LONG, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """The cheapest edits that give each conversation's role initials the form (s?(ua)+)?: keep a turn (K, 0), give it the role user or assistant (R, 3),
    delete it (D, 4; must be for blank ones and repetitions of role and text), insert an empty turn of user or assistant (I, 3); a turn that does not
    end in a full stop, exclamation or question mark costs 3 more unless deleted.

    Returns two frames: a report (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) with a row for each conversation, and
    the repaired turns (conv, part, piece, place, role, text; in that order). Rows stand in order of turn, nulls first; of one turn, by a hash of role
    and text, then by themselves. copies: a column that says how many times a row stands there (else once); 0 only makes its conversation known.

    A null role or text is one space; an empty role has no initial and may stand anywhere; a null conv_id is a conversation; turns that are all null
    have no gaps; a conversation without rows has zeros, an empty audit and the empty text's digest; an empty table gives no rows; other columns are
    not looked at. Conversations of up to long_rows rows are grouped, a row each. Longer ones are cut in pieces by ranges of turns: a piece
    is summed up as its best edits from each role before it to each role after it, which are joined in order, as such
    matrices may be joined in any grouping; only the joining and the digest, which goes through all the conversation's text in order, take it as a whole."""
    key, space = df.schema[conv].dataType, F.lit(" ")
    rows = df.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), space).alias("role"), F.coalesce(F.col(text).cast("string"), space).alias("text"),
        (F.col(copies).cast("long") if copies else F.lit(1).cast("long")).alias("copies"),
    )
    sizes = rows.groupBy("conv").agg(F.sum("copies").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    many = cut(sizes.where((F.col("n") > long_rows) | (F.col("bytes") > LONG_BYTES)).select(F.col("conv").alias("many")))
    if not many.head(1):
        report, turns = _grouped(rows, key)
    else:
        same = F.col("conv").eqNullSafe(F.col("many"))
        (report, turns), (more, further) = _grouped(rows.join(many, same, "left_anti"), key), _in_pieces(rows.join(many, same, "left_semi"), key, piece)
        report, turns = report.unionByName(more), turns.unionByName(further)
    return report.withColumnRenamed("conv", conv), turns.withColumnsRenamed({"conv": conv, "role": role, "text": text})


def _gaps(turns: list) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _grouped(rows: DataFrame, key) -> tuple[DataFrame, DataFrame]:
    entry = F.struct("turn", F.xxhash64("role", "text").alias("h"), "role", "text", "copies")
    whole = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.when(F.col("copies") > 0, entry))).alias("rows"))

    def run(keep: bool):
        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for entries in batch.column(1).to_pylist():
                    seen, made = set(), []
                    for e in entries:
                        made.append((e["role"], e["text"], e["copies"], (e["role"], e["text"]) not in seen))
                        seen.add((e["role"], e["text"]))
                    found = faults(made)
                    cost, audit = complete(edits(made, found))
                    turns = replay(made, audit)
                    out.append([{"role": r, "text": t} for r, t in turns] if keep else (_gaps([e["turn"] for e in entries]), *counts(made, found), cost, audit, digest(turns)))
                if keep:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))], names=["conv", "turns"])
                else:
                    cols = list(zip(*out)) or [[]] * 8
                    kinds = [pa.int64()] * 6 + [pa.string()] * 2
                    yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["conv", *[f.split()[0] for f in REPORT.split(", ")]])

        return one

    kind = key.simpleString()
    report = whole.mapInArrow(run(False), f"conv {kind}, {REPORT}")
    turns = whole.mapInArrow(run(True), f"conv {kind}, turns array<struct<role:string,text:string>>")
    zero = F.lit(0)
    return report, turns.select("conv", zero.alias("part"), zero.alias("piece"), F.posexplode("turns").alias("place", "t")).select("conv", "part", "piece", "place", "t.role", "t.text")


def _in_pieces(rows: DataFrame, key, size: int) -> tuple[DataFrame, DataFrame]:
    """_grouped for conversations that are too long for one task: equal rows are summed first, and no task takes more of a conversation than a piece."""
    kind = key.simpleString()
    known = rows.select("conv").distinct()
    once = rows.where("copies > 0").groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    new = once.groupBy("conv", "role", "text").agg(F.min(F.struct("turn"))["turn"].alias("turn"))
    a, b = once.alias("a"), new.alias("b")
    met = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("conv", "turn", "role", "text")], "left")
    marked = met.select("a.*", F.col("b.text").isNotNull().alias("new"), F.xxhash64("a.role", "a.text").alias("h"))
    order = [F.col("turn").asc_nulls_first(), F.col("h"), F.col("role"), F.col("text")]
    n = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(marked.repartitionByRange(n, F.col("conv").asc_nulls_first(), *order[:2]).withColumn("part", F.spark_partition_id()))
    at = F.row_number().over(Window.partitionBy("part", "conv").orderBy(*order))
    pieces = cut(dealt.withColumn("at", at).withColumn("piece", ((F.col("at") - 1) / size).cast("int")))
    by = ["conv", "part", "piece"]

    def rows_of(pdf: pd.DataFrame) -> list[Row]:
        pdf = pdf.sort_values("at")
        return list(zip(pdf.role, pdf.text, pdf.copies.tolist(), pdf.new.tolist()))

    def summary(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        made = rows_of(pdf)
        found = faults(made)
        paths = [{"entry": e, "last": s, "cost": c, "audit": x} for e in END for s, (c, x) in edits(made, found, e).items()]
        return pd.DataFrame([[*key, *counts(made, found), made[0][0][:1], made[-1][0][:1], paths]])

    sums = cut(pieces.groupBy(*by).applyInPandas(summary, f"conv {kind}, part int, piece int, blank long, duplicate long, truncated long, illegal long, head string, tail string, paths array<struct<entry:string,last:string,cost:bigint,audit:string>>"))

    def chosen(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The way through a conversation's pieces: role before each and its audit; the cost and the illegal pairs between pieces with the first."""
        pdf = pdf.sort_values(["part", "piece"])
        best, back = {"^": (0, "")}, []
        for paths in pdf.paths:
            made, came = {}, {}
            for p in paths:
                if p["entry"] in best:
                    cost, audit = best[p["entry"]]
                    option = (cost + p["cost"], audit + p["audit"])
                    if p["last"] not in made or option < made[p["last"]]:
                        made[p["last"]], came[p["last"]] = option, (p["entry"], p["audit"])
            best = made
            back.append(came)
        cost, audit = complete(best)
        state = next(s for s, (c, x) in best.items() if (c + INSERT * END[s], x + "I" * END[s]) == (cost, audit))
        way = []
        for i, came in enumerate(reversed(back)):
            entry, piece = came[state]
            way.append((entry, piece + "I" * (END[state] if i == 0 else 0)))
            state = entry
        between = sum(a + b not in LEGAL for a, b in zip(pdf["tail"], pdf["head"].iloc[1:]))
        out = pd.DataFrame({"conv": [key[0]] * len(pdf), "part": pdf.part.to_numpy(), "piece": pdf.piece.to_numpy(), "entry": [w[0] for w in way[::-1]], "audit": [w[1] for w in way[::-1]]})
        out["cost"], out["between"] = [cost] + [0] * (len(pdf) - 1), [between] + [0] * (len(pdf) - 1)
        return out

    ways = cut(sums.groupBy("conv").applyInPandas(chosen, f"conv {kind}, part int, piece int, entry string, audit string, cost long, between long"))
    w = ways.select(*[F.col(c).alias(f"w_{c}") for c in ways.columns])
    told = pieces.join(w, [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in by]).select(*pieces.columns, F.col("w_entry").alias("entry"), F.col("w_audit").alias("audit"))

    def repaired(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        turns = replay(rows_of(pdf), pdf.audit.iloc[0], pdf.entry.iloc[0])
        return pd.DataFrame([[*key, i, r, t] for i, (r, t) in enumerate(turns)], columns=[*by, "place", "role", "text"])

    turns = cut(told.groupBy(*by).applyInPandas(repaired, f"conv {kind}, part int, piece int, place int, role string, text string"))

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The digest of each conversation's turns, which come in order; a conversation's rows are together."""
        last, state = None, None
        for pdf in batches:
            for conv, head, body in zip(pdf.conv, pdf.role, pdf.text):
                named = (None if pd.isna(conv) else conv,)
                if named != last:
                    if last is not None:
                        yield pd.DataFrame({"conv": [last[0]], "sha": [state.hexdigest()]})
                    last, state = named, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{head}:{body}".encode())
        if last is not None:
            yield pd.DataFrame({"conv": [last[0]], "sha": [state.hexdigest()]})

    shas = turns.repartition("conv").sortWithinPartitions("conv", "part", "piece", "place").select("conv", "role", "text").mapInPandas(digests, f"conv {kind}, sha string")
    gaps = once.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    faulty = sums.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    made = ways.groupBy("conv").agg(F.sum("cost").alias("cost"), F.sum("between").alias("between"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "piece", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    out = known.select(F.col("conv").alias("conv_"))
    for side in (gaps, faulty, made, shas):
        out = out.join(side, out["conv_"].eqNullSafe(side["conv"]), "left").drop("conv")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    none = hashlib.sha256(b"").hexdigest()
    report = out.select(
        F.col("conv_").alias("conv"), zero("gaps"), zero("blank"), zero("duplicate"), zero("truncated"), F.coalesce(F.col("illegal") + F.col("between"), F.lit(0)).cast("long").alias("illegal"),
        zero("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(none)).alias("repaired_sha256"),
    )
    return report, turns
