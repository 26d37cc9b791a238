"""Conversation structure repair by Wagner-Fischer alignment with the strings of the grammar (s?(ua)+)?.

A conversation's turns are read in order of their turn number. Each turn is kept (0), gets another role (2) or is deleted (3);
a user or assistant turn without text may be inserted anywhere (2); a truncated turn that stays adds 1. Blank turns and repeats of an earlier turn must go, so they
take no part in the alignment: their place in the audit is fixed. The others are aligned from the end with the last r letters of the alternating string: one table of
suffix costs, kept for every r, is the Wagner-Fischer table of every target length at once. A first, plain repair (insert what is missing) gives the incumbent cost; a cell whose
offset from the diagonal alone costs more than the incumbent cannot lie on a cheapest path, which leaves Ukkonen's band. Each target length (with and without a kept system
turn in front) that reaches the least cost is traced back from the front, taking the least letter that stays cheapest, and the least audit of all wins.
Rows of the table are vectors; every ``KEEP``-th is kept and the ones between are made again when traced, so memory grows with
the band and not with its area. Conversations stream through a sorted partition one at a time.

Defined cases: a null role or text is one space, so a null text is blank; null turns come first, equal turns are taken by role, then
text; all rows without a conversation id are one conversation; a turn keeps only a role that begins with s, u or a; a conversation
of no turns (all rows ``absent``) has zeros, an empty audit and no repaired turns; an empty table gives an empty result; there is one
row per conversation, so columns other than the four named are not passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from fieldtrace.llm.common import SPACES, query
from fieldtrace.session import configure

RETYPE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
KEEP = 64
FAR = 1 << 30
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
LEGAL = {"su", "ua", "au"}


def incumbent(letters: str) -> int:
    """Cost of a plain repair without deletions: a missing turn is inserted, a turn of another kind gets the role that is due."""
    cost, due = 0, "u"
    for at, letter in enumerate(letters):
        if letter == "s" and at == 0:
            continue
        if letter not in "ua":
            cost, letter = cost + RETYPE, due
        elif letter != due:
            cost += INSERT
        due = "a" if letter == "u" else "u"
    lone = letters == "s"
    return cost + (INSERT if due == "a" else 0) + (2 * INSERT if lone else 0)


class Table:
    """Suffix costs: ``row(i)[b]`` aligns the turns from i on with the last r letters of ...uaua, r = turns left + b - reach."""

    def __init__(self, letters: str, cut: list[bool], excess: int):
        self.letters, self.cut, self.n = letters, cut, len(letters)
        self.reach = excess // 2 + 1
        self.offset = np.arange(-self.reach, self.reach + 1)
        self.kept: dict[int, np.ndarray] = {}
        self.block: dict[int, np.ndarray] = {}
        row = np.where(self.offset >= 0, INSERT * self.offset, FAR)  # no turns left: the letters are inserted
        for i in range(self.n, -1, -1):
            if i < self.n:
                row = self._before(i, row)
            if i % KEEP == 0 or i == self.n:
                self.kept[i] = row

    def _before(self, i: int, after: np.ndarray) -> np.ndarray:
        left = self.n - i
        r = left + self.offset
        own = TRUNCATED if self.cut[i] else 0
        # the r-th last letter is a for odd r, u for even r; taking it leaves r - 1 letters, turns left - 1: the same offset
        match = after + own + np.where(r % 2 == 1, 0 if self.letters[i] == "a" else RETYPE, 0 if self.letters[i] == "u" else RETYPE)
        match[r < 1] = FAR
        gone = np.full(len(after), FAR)
        gone[:-1] = after[1:] + DELETE  # r letters are left, one turn fewer
        row = np.minimum(match, gone)
        row[r < 0] = FAR
        # insertions: one letter fewer for the same turns
        return np.minimum(np.minimum.accumulate(row - INSERT * r) + INSERT * r, FAR)

    def row(self, i: int) -> np.ndarray:
        if i in self.kept:
            return self.kept[i]
        if i not in self.block:
            top = min(self.n, (i // KEEP + 1) * KEEP)
            row, self.block = self.kept[top], {}
            for k in range(top - 1, i // KEEP * KEEP, -1):
                row = self.block[k] = self._before(k, row)
        return self.block[i]

    def cost(self, i: int, r: int) -> int:
        at = r - (self.n - i) + self.reach
        return int(self.row(i)[at]) if 0 <= at < len(self.offset) and r >= 0 else FAR

    def trace(self, i: int, r: int) -> str:
        """The least audit of the cheapest alignments of the turns from i on with r letters."""
        out = []
        while i < self.n or r:
            now = self.cost(i, r)
            if i < self.n and self.cost(i + 1, r) + DELETE == now:
                out.append("D")
                i += 1
            elif r and self.cost(i, r - 1) + INSERT == now:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.letters[i] == ("a" if r % 2 else "u") else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def align(letters: str, cut: list[bool]) -> tuple[int, str]:
    """(cost, least audit) of the cheapest repair of turns with these role letters."""
    base = TRUNCATED * sum(cut)
    table = Table(letters, cut, max(incumbent(letters), 0))
    n = len(letters)
    reach = lambda i: range(max(0, n - i - table.reach), n - i + table.reach + 1)
    starts = [(table.cost(0, r), 0, r, "") for r in reach(0) if r % 2 == 0]
    # a system turn kept in front: all before it deleted
    for i in range(min(n, (incumbent(letters) + base) // DELETE + 1)):
        if letters[i] == "s":
            front = DELETE * i + (TRUNCATED if cut[i] else 0)
            starts += [(front + table.cost(i + 1, r), i + 1, r, "D" * i + "K") for r in reach(i + 1) if r >= 2 and r % 2 == 0]
    least = min(c for c, *_ in starts)
    return least, min(front + table.trace(i, r) for c, i, r, front in starts if c == least)


def repair_turns(turns: list[int | None], roles: list[str], texts: list[str]) -> tuple[dict[str, int], str, list[tuple[str, str]]]:
    """(counts and cost, audit, repaired turns) of a conversation in order."""
    seen, must_go, cut, found = set(), [], [], dict.fromkeys(COUNTS, 0)
    for role, text in zip(roles, texts):
        bare = text.rstrip(SPACES)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            found[fault] += 1
        must_go.append(fault in ("blank", "duplicate"))
        cut.append(fault == "truncated")
    first = [role[:1] for role in roles]
    found["illegal"] = sum(a + b not in LEGAL for a, b in zip(first, first[1:]))
    known = {t for t in turns if t is not None}
    found["gaps"] = max(known) - min(known) + 1 - len(known) if known else 0
    letters = "".join(x if x and x in "sua" else "?" for x, gone in zip(first, must_go) if not gone)
    cost, steps = align(letters, [c for c, gone in zip(cut, must_go) if not gone])
    found["cost"] = cost + DELETE * sum(must_go)
    audit, repaired, i, due = [], [], 0, "user"
    for step in [*steps, None]:
        while i < len(roles) and must_go[i]:  # D comes before any other letter
            audit.append("D")
            i += 1
        if step is None:
            break
        audit.append(step)
        if step != "D":
            repaired.append((due, "") if step == "I" else (roles[i] if step == "K" else due, texts[i]))
            if not (step == "K" and first[i] == "s"):
                due = "assistant" if due == "user" else "user"
        i += step != "I"
    return found, "".join(audit), repaired


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, rows) of each conversation of a sorted partition."""
    own, rows = None, []
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for row in zip(ids, *(batch.column(k).to_pylist() for k in range(1, 6))):
            if rows and row[0] != own:
                yield own, rows
                rows = []
            own = row[0]
            rows.append(row)
    if rows:
        yield own, rows


def _repaired(batches, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", kind), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()),
                        ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
    out, held = [], 0
    for own, rows in _conversations(batches):
        rows = [row for row in rows for _ in range(row[4]) if not row[5]]
        found, audit, repaired = repair_turns([r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows])
        out.append({"conv_id": own, **found, "audit": audit, "repaired": [{"role": a, "text": b} for a, b in repaired]})
        held += 100 + sum(len(b) for _, b in repaired)
        if held > 4_000_000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           copies: Column | None = None, absent: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired array<struct<role, text>>) per conversation.

    ``copies``: how often a row stands there (once); ``absent``: rows that only name their conversation.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    configure(conversations.sparkSession)
    space = F.lit(" ")
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
                                F.coalesce(F.col(text_col).cast("string"), space).alias("text"), (F.lit(1) if copies is None else copies).cast("int").alias("copies"),
                                (F.lit(False) if absent is None else absent).alias("absent"))
    kind = rows.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)
    schema = StructType([StructField("conv_id", kind), *[StructField(c, LongType()) for c in COUNTS], StructField("audit", StringType()),
                         StructField("repaired", ArrayType(StructType([StructField("role", StringType()), StructField("text", StringType())])))])
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return ordered.mapInArrow(lambda batches: _repaired(batches, arrow), schema)


def damage(conversations: DataFrame) -> DataFrame:
    """The conversations with the faults that crc32(conv_id:turn) names; adds ``copies`` and ``absent``."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    return (conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), fault.alias("fault"))
            .select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                    F.when(F.col("fault") == 3, 2).otherwise(1).alias("copies"), (F.col("fault") == 0).alias("absent")))


@query("op11_turn_repair")
def op11_turn_repair(spark, folder):
    damaged = damage(spark.read.parquet(f"{folder}/conversations.parquet"))
    line = lambda t: F.concat(t["role"], F.lit(":"), t["text"])
    return (repair(damaged, copies=F.col("copies"), absent=F.col("absent"))
            .select("conv_id", *COUNTS, "audit", F.sha2(F.array_join(F.transform("repaired", line), "\n"), 256).alias("repaired_sha256")))
