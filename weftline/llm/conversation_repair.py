"""Conversation structure repair: the cheapest edits that make a conversation alternate.

A conversation's turns are kept, given another role or deleted, and empty turns are
inserted, until its roles read ``(s?(ua)+)?`` by their first letters. The dynamic
program runs over the *retained* turns: what lies between two of them is deleted, which
prefix sums of the deletion costs price; the best retained turn before a gap is a running
minimum for each state (the role that was retained last); and the pair of roles on both
sides of the gap decides whether an empty turn goes in. Among equally cheap audits the
least in ASCII wins.

A conversation of any length streams through its task in turn order: kept are a few
numbers and a digest for each state, and four bytes a row to read the audit back. Texts
are never gathered. One conversation is one task, since its digest follows its order.

Bytes are taken as they are, valid UTF-8 or not. Nulls in role or text count as one space; a null conv_id is a conversation of its own;
null turns come first; turns that tie go by role, then text. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NONE, SYSTEM, USER, ASSISTANT = range(4)
INITIAL = {b"s": SYSTEM, b"u": USER, b"a": ASSISTANT}
NAMES = {USER: b"user", ASSISTANT: b"assistant"}
LEGAL = (b"su", b"ua", b"au")
RETYPE, DELETE, INSERT, FLAW = 2, 3, 2, 1
#: Edits of one row by rank in ASCII; an insertion stands directly before the row it makes room for.
EDITS = ("D", "IK", "IR", "K", "R")
#: The empty turn between two retained roles, or None where no single one helps.
BETWEEN = {
    (NONE, SYSTEM): 0, (NONE, USER): 0, (NONE, ASSISTANT): USER,
    (SYSTEM, USER): 0, (SYSTEM, ASSISTANT): USER,
    (USER, USER): ASSISTANT, (USER, ASSISTANT): 0,
    (ASSISTANT, USER): 0, (ASSISTANT, ASSISTANT): USER,
}
AFTER = {NONE: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3


class Repair:
    """The program for one conversation, fed with its turns in order."""

    def __init__(self):
        self.rows = 0  # 3 * rows is the prefix sum of deletion costs
        #: By state: cost less the prefix sum, rank among the states' audits, digest so far.
        self.best = {NONE: (0, 0, None)}
        self.back = bytearray()

    def add(self, role: bytes, text: bytes, fault: int) -> None:
        #: By state: cost less the prefix sum, (rank of origin, edit), origin, role that is written.
        ways = {state: (cost, (rank, 0), state, None) for state, (cost, rank, _) in self.best.items()}
        if fault not in (BLANK, DUPLICATE):
            flaw = FLAW if fault == TRUNCATED else 0
            own = INITIAL.get(role[:1])
            for state, name, price in ((own, role, 0), (USER, NAMES[USER], RETYPE), (ASSISTANT, NAMES[ASSISTANT], RETYPE)):
                if not state:
                    continue
                for origin, (cost, rank, _) in self.best.items():
                    gap = BETWEEN.get((origin, state))
                    if gap is None:
                        continue
                    edit = EDITS.index(("I" if gap else "") + ("R" if price else "K"))
                    way = (cost - DELETE + flaw + price + (INSERT if gap else 0), (rank, edit), origin, name)
                    if state not in ways or way[:2] < ways[state][:2]:
                        ways[state] = way
        order = {key: i for i, key in enumerate(sorted(way[1] for way in ways.values()))}
        marks = bytearray(4)
        best = {}
        for state, (cost, key, origin, name) in ways.items():
            digest = self.best[origin][2]
            if name is not None:
                gap = BETWEEN[origin, state]
                digest = _more(_more(digest, NAMES[gap], b":") if gap else digest, name, b":", text)
            best[state] = (cost, order[key], digest)
            marks[state] = origin << 4 | key[1]
        self.best, self.rows = best, self.rows + 1
        self.back += marks

    def end(self) -> tuple[int, str, str]:
        """Cost, audit, digest of the repaired turns."""
        (cost, _), state = min(((cost + DELETE * self.rows + INSERT * len(AFTER[state]), rank), state) for state, (cost, rank, _) in self.best.items())
        digest = self.best[state][2]
        for role in AFTER[state]:
            digest = _more(digest, NAMES[role], b":")
        audit, at = ["I" * len(AFTER[state])], state
        for row in range(self.rows - 1, -1, -1):
            mark = self.back[4 * row + at]
            audit.append(EDITS[mark & 15])
            at = mark >> 4
        return cost, "".join(reversed(audit)), (digest or hashlib.sha256()).hexdigest()


def _more(digest, *pieces: bytes):
    """A digest that has one more turn; the one before stays as it is."""
    if digest is None:
        digest = hashlib.sha256()
    else:
        digest = digest.copy()
        digest.update(b"\n")
    for piece in pieces:
        digest.update(piece)
    return digest


class Conversation:
    """Counts and repair of one conversation, fed in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.repair = Repair()
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def add(self, turn, role: bytes, text: bytes, fault: int) -> None:
        self.faults[fault] += 1
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL
        self.before = initial
        self.repair.add(role, text, fault)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.conv_id, gaps, *self.faults[1:], self.illegal, *self.repair.end()


COLUMNS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def repair(turns: DataFrame, dropped: str | None = None) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text): its faults, cost, audit and repaired digest.

    A row whose column ``dropped`` (if one is named) is true only says that its conversation exists. A fault
    is the row's first: blank (no character but white space), duplicate (role and text stand
    in an earlier row), truncated (the last character that isn't white space is none of
    ``.!?``). A conversation without rows has zeros, an empty audit and the digest of the
    empty string; an empty table gives no rows. A role without a first letter is never kept.
    """
    gone = F.coalesce(F.col(dropped), F.lit(False)) if dropped else F.lit(False)
    of = turns.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), gone.alias("dropped"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
    ).repartition("conv_id")
    earlier = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.asc_nulls_first("turn"))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when(F.col("seen") > 1, DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED)
        .otherwise(0)
    )
    judged = of.withColumn("seen", F.row_number().over(earlier)).withColumn("fault", fault).drop("seen")
    ordered = judged.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    raw = ordered.select("conv_id", "turn", "dropped", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "fault")
    kind = turns.schema["conv_id"].dataType.simpleString()
    return raw.mapInArrow(_stream, f"conv_id {kind}, {COLUMNS}")


def _stream(batches):
    import pyarrow as pa

    names, out, now = ["conv_id", *(c.split()[0] for c in COLUMNS.split(", "))], [], None

    def table():
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.string()) for c in columns[7:])], names=names)

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv_id, turn, dropped, role, text, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "dropped", "role", "text", "fault")), strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out.append(now.row())
                    if len(out) >= 1000:
                        yield table()
                        out.clear()
                now = Conversation(conv_id)
            if not dropped:
                now.add(turn, role, text, fault)
    if now is not None:
        out.append(now.row())
        yield table()


def damage(turns: DataFrame) -> DataFrame:
    """The stated damage, by the checksum of ``conv_id:turn`` modulo 20.

    0 drops the row (it stays as a ``dropped`` row without text, so that its conversation
    is known), 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 sets the role user.
    Nulls of any column count as one space.
    """
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    act = F.crc32(F.concat(say("conv_id"), F.lit(":"), say("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", say("role").alias("role"), say("text").alias("text"), act.alias("act"))
    text = F.when(F.col("act").isin(0, 1), "").when(F.col("act") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("act") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    damaged = rows.select("conv_id", "turn", F.when(F.col("act") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("act") == 0).alias("dropped"), F.explode(times).alias("copy"))
    return damaged.drop("copy")
