"""Conversation structure repair by a lazily determinised weighted automaton.

Edits turn a conversation's rows into one whose role initials are (s?(ua)+)?: keep a row, give it another role, delete
it, or insert a row. The states of that language (nothing yet, after s, after u, after a) and what each would still cost
make a vector; normalised by its least cost it is a state of a deterministic automaton. Few such vectors exist. Each is
made when a row first leads to it and kept in a transition table, so that a scan is one table step a row.

The scan runs from the last row to the first and gives the cost of the rest. The trace then runs back against the scan,
from the first row, along tight arcs: an arc is tight if its cost and the rest's cost make up the state's. Of several tight
arcs it takes the one of least letter, so its audit is the least of all cheapest ones.

Spark does the rest. Equal rows are counted first. The first occurrence of a text is a grouped minimum joined by unique
keys. Rows are then sorted by ranges of (conversation, turn), so a conversation of any length is spread over tasks. A
conversation inside a range is repaired in one pass. What touches a range's edge, or is long, becomes blocks of bounded
size: each sends a table (for every automaton state behind it: state before it, cost, and which state every entry leads
to), the tables of a conversation are chained, and each block is traced on its own.

Rows are taken by turn, nulls first; rows of one turn by role, then SHA-256 of the text. A null role or text is one
space; a role's initial is its first character. A null conversation id is a conversation. Rows that `copies` counts 0
times only name their conversation, which then has an empty result if it has no others. An empty table gives no rows.
Other columns are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import Staging, ship

RE_ROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
START, S, U, A = range(4)
BEHIND = {START: U, S: U, U: A, A: U}  # where an inserted or re-roled row leads
KEEPS = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
ROLES = {U: "user", A: "assistant"}
LEGAL = {"su", "ua", "au"}
#: A row's symbol: 2 * place of its initial here (3: any other), 1 more if it is cut off; GONE if it must be deleted.
INITIALS, GONE = "sua", 8
#: A longer conversation, or one of more characters, is cut into blocks.
BLOCK_ROWS, BLOCK_CHARS = 20_000, 8 << 20


class Automaton:
    """States are normalised vectors of costs, numbered as they are met; END is the state behind the last row."""

    END = 0

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = [(0, 2 * INSERT, INSERT, 0)]
        self.number = {self.vectors[0]: 0}
        self.table: dict[tuple[int, int], tuple[int, int, tuple]] = {}

    def step(self, behind: int, symbol: int) -> tuple[int, int, tuple]:
        """The state before a row, the cost that normalising took off, and for each entry state (letters, state behind the row)."""
        found = self.table.get((behind, symbol))
        return found or self._make(behind, symbol)

    def _make(self, behind: int, symbol: int) -> tuple[int, int, tuple]:
        rest = self.vectors[behind]
        arcs: list[dict[str, tuple[int, int]]] = []
        for q in range(4):
            own = {"D": (DELETE + rest[q], q)}
            if symbol != GONE:
                late = CUT_OFF * (symbol & 1)
                kept = KEEPS.get(INITIALS[symbol >> 1] if symbol >> 1 < 3 else "", {}).get(q)
                if kept is not None:
                    own["K"] = (late + rest[kept], kept)
                own["R"] = (RE_ROLE + late + rest[BEHIND[q]], BEHIND[q])
            arcs.append(own)
        cost = [min(c for c, _ in own.values()) for own in arcs]
        for _ in range(2):
            cost = [min(cost[q], INSERT + cost[BEHIND[q]]) for q in range(4)]
        moves = []
        for q in range(4):
            letters = ""
            while True:
                tight = {k: to for k, (c, to) in arcs[q].items() if c == cost[q]}
                if INSERT + cost[BEHIND[q]] == cost[q]:
                    tight["I"] = BEHIND[q]
                letter = min(tight)
                letters, q = letters + letter, tight[letter]
                if letter != "I":
                    break
            moves.append((letters, q))
        least = min(cost)
        vector = tuple(c - least for c in cost)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        made = (self.number[vector], least, tuple(moves))
        self.table[behind, symbol] = made
        return made

    @classmethod
    def complete(cls) -> Automaton:
        """One that has met every state that any rows can lead to, in one order, so that numbers agree between tasks."""
        made, at = cls(), 0
        while at < len(made.vectors):
            for symbol in range(9):
                made.step(at, symbol)
            at += 1
        return made


#: Letters from each entry state to the end behind the last row.
LAST_LETTERS = {START: "", S: "II", U: "I", A: ""}


class Block:
    """Rows of one conversation in order, each with its copies, role, text, symbol and fault (0 none, 1 blank, 2 duplicate, 3 cut off)."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, str, str, int]] = []
        self.chars = self.turns = self.illegal = 0
        self.first_turn = self.last_turn = None
        self.first_initial = self.last_initial = None
        self.faults = [0, 0, 0, 0]

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: int) -> None:
        if not copies:
            return
        initial = role[:1]
        if self.last_initial is None:
            self.first_initial = initial
        elif self.last_initial + initial not in LEGAL:
            self.illegal += 1
        self.illegal += copies - 1
        self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.faults[fault] += 1
        self.faults[1 if fault == 1 else 2] += copies - 1
        place = INITIALS.find(initial) if initial else -1
        self.rows.append((copies, role, text, GONE if fault in (1, 2) else 2 * (place if place >= 0 else 3) + (fault == 3)))
        self.chars += len(role) + len(text)


def scan(automaton: Automaton, rows: list[tuple[int, str, str, int]], behind: int = Automaton.END) -> tuple[list[tuple], int, int]:
    """From the last row to the first: each row's moves (in the rows' order), the state before them, and the cost taken off."""
    moves, state, cost = [], behind, 0
    for copies, _, _, symbol in reversed(rows):
        if copies > 1:  # further copies are duplicates or blank: deleted, and deleting changes no difference
            cost += DELETE * (copies - 1)
        state, off, move = automaton.step(state, symbol)
        cost += off
        moves.append(move)
    return moves[::-1], state, cost


def trace(rows: list[tuple[int, str, str, int]], moves: list[tuple], q: int, last: bool) -> tuple[str, list[dict], int]:
    """Against the scan along tight arcs: audit, repaired rows and the state behind them."""
    audit, out = [], []

    def insert(n: int, q: int) -> int:
        for _ in range(n):
            q = BEHIND[q]
            out.append({"role": ROLES[q], "text": ""})
        return q

    for (copies, role, text, _), move in zip(rows, moves, strict=True):
        letters, to = move[q]
        audit.append(letters)
        insert(len(letters) - 1, q)
        if letters[-1] == "K":
            out.append({"role": role, "text": text})
        elif letters[-1] == "R":
            out.append({"role": ROLES[to], "text": text})
        q = to
        if copies > 1:
            audit.append("D" * (copies - 1))
    if last:
        audit.append(LAST_LETTERS[q])
        q = insert(len(LAST_LETTERS[q]), q)
    return "".join(audit), out, q


def table_of(automaton: Automaton, rows: list[tuple[int, str, str, int]]) -> tuple[list[int], list[int], list[int]]:
    """For every state behind the rows: the state before them, the cost taken off, and the state that each entry state leads to."""
    n = len(automaton.vectors)
    before, cost, leads = list(range(n)), [0] * n, [[q for q in range(4)] for _ in range(n)]
    for copies, _, _, symbol in rows:
        more, steps = DELETE * (copies - 1), [automaton.step(s, symbol) for s in range(n)]
        leads = [[steps[s][2][leads[steps[s][0]][q]][1] for q in range(4)] for s in range(n)]
        cost = [more + steps[s][1] + cost[steps[s][0]] for s in range(n)]
        before = [before[steps[s][0]] for s in range(n)]
    return before, cost, [q for own in leads for q in own]


_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_ROW = pa.struct([("copies", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("symbol", pa.int32())])
_LONG = ("part", "sub", "blank", "duplicate", "truncated", "illegal", "cost", "turns", "first_turn", "last_turn")
_BLOCK = pa.schema([("conv_id", pa.int64()), ("whole", pa.bool_()), *((c, pa.int64()) for c in _LONG), ("first_initial", pa.string()), ("last_initial", pa.string()), ("audit", pa.string()), ("repaired", pa.list_(_TURN)),
                    ("rows", pa.list_(_ROW)), ("before", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("leads", pa.list_(pa.int32()))])
_BLOCK_DDL = f"conv_id bigint, whole boolean, {', '.join(f'{c} bigint' for c in _LONG)}, first_initial string, last_initial string, audit string, repaired array<struct<role:string,text:string>>, rows array<struct<copies:bigint,role:string,text:string,symbol:int>>, before array<int>, costs array<bigint>, leads array<int>"


def _row(automaton: Automaton, conv_id: int | None, part: int, sub: int, block: Block, whole: bool) -> dict:
    out = {"conv_id": conv_id, "whole": whole, "part": part, "sub": sub, "blank": block.faults[1], "duplicate": block.faults[2], "truncated": block.faults[3], "illegal": block.illegal, "cost": 0, "turns": block.turns,
           "first_turn": block.first_turn, "last_turn": block.last_turn, "first_initial": block.first_initial, "last_initial": block.last_initial}
    if not whole:
        before, costs, leads = table_of(automaton, block.rows)
        return out | {"rows": [dict(zip(("copies", "role", "text", "symbol"), r, strict=True)) for r in block.rows], "before": before, "costs": costs, "leads": leads}
    moves, state, cost = scan(automaton, block.rows)
    audit, repaired, _ = trace(block.rows, moves, START, True)
    return out | {"cost": cost + automaton.vectors[state][START], "audit": audit, "repaired": repaired}


def _scan_ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range to blocks; the first and the last conversation of a range may go on beside it and are never whole."""
    automaton, complete = Automaton(), Automaton.complete()
    nothing = object()
    now, block, part, sub, first, cut = nothing, Block(), 0, 0, True, False
    done: list[dict] = []
    size = 0

    def close(whole: bool) -> None:
        nonlocal block, sub, size
        size += block.chars + 100
        done.append(_row(automaton if whole else complete, now, part, sub, block, whole))
        block, sub = Block(), sub + 1

    for batch in batches:
        for conv_id, turn, role, text, copies, fault, part_of in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
            part = part_of
            if conv_id != now or now is nothing:
                if now is not nothing:
                    close(whole=not first and not cut)
                    first = False
                now, cut = conv_id, False
            elif len(block.rows) >= BLOCK_ROWS or block.chars >= BLOCK_CHARS:
                close(whole=False)
                cut = True
            block.add(turn, role, text, copies, fault)
        if size > BLOCK_CHARS:
            yield pa.RecordBatch.from_pylist(done, schema=_BLOCK)
            done, size = [], 0
    if now is not nothing:
        close(whole=False)
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=_BLOCK)


_CHAINED = pa.schema([(c, pa.int64()) for c in ("part", "sub", "behind", "entry", "piece", "pieces", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")])
_TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _gaps(first: int | None, last: int | None, turns: int) -> int:
    return 0 if first is None else last - first + 1 - turns


def _chain(group: pa.Table) -> pa.Table:
    """The blocks of one conversation, without their rows: what stands behind and before each, and the conversation's totals."""
    blocks = group.sort_by([("part", "ascending"), ("sub", "ascending")]).to_pylist()
    vectors = Automaton.complete().vectors
    behind, state, cost = [], Automaton.END, 0
    for b in reversed(blocks):
        behind.append(state)
        cost += b["costs"][state]
        state = b["before"][state]
    behind.reverse()
    entry, q = [], START
    for b, s in zip(blocks, behind, strict=True):
        entry.append(q)
        q = b["leads"][4 * s + q]
    totals = {"cost": cost + vectors[state][START]} | {c: sum(b[c] for b in blocks) for c in ("blank", "duplicate", "truncated", "illegal")}
    filled = [b for b in blocks if b["first_initial"] is not None]
    totals["illegal"] += sum(x["last_initial"] + y["first_initial"] not in LEGAL for x, y in zip(filled, filled[1:], strict=False))
    timed = [b for b in blocks if b["first_turn"] is not None]
    turns = sum(b["turns"] for b in timed) - sum(x["last_turn"] == y["first_turn"] for x, y in zip(timed, timed[1:], strict=False))
    totals["gaps"] = _gaps(timed[0]["first_turn"], timed[-1]["last_turn"], turns) if timed else 0
    return pa.Table.from_pylist([{"part": b["part"], "sub": b["sub"], "behind": s, "entry": e, "piece": i, "pieces": len(blocks)} | totals for i, (b, s, e) in enumerate(zip(blocks, behind, entry, strict=True))], schema=_CHAINED)


_PIECE = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("pieces", pa.int64()), *((c, pa.int64()) for c in _TOTALS), ("audit", pa.string()), ("repaired", pa.list_(_TURN))])
_PIECE_DDL = f"conv_id bigint, piece bigint, pieces bigint, {', '.join(f'{c} bigint' for c in _TOTALS)}, audit string, repaired array<struct<role:string,text:string>>"


def _trace_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = Automaton.complete()
    for batch in batches:
        for b in batch.to_pylist():
            rows = [(r["copies"], r["role"], r["text"], r["symbol"]) for r in b["rows"]]
            moves, _, _ = scan(automaton, rows, b["behind"])
            audit, repaired, _ = trace(rows, moves, b["entry"], b["piece"] == b["pieces"] - 1)
            yield pa.RecordBatch.from_pylist([{c: b[c] for c in ("conv_id", "piece", "pieces", *_TOTALS)} | {"audit": audit, "repaired": repaired}], schema=_PIECE)


_SPACE = "[^\\x20\\x09-\\x0D]"


def _runs(df: DataFrame, staging: Staging, copies: Column) -> DataFrame:
    """conv_id, turn, role, text, copies, fault of the first copy; one row for equal rows, in sorted ranges, with the range's number."""
    none = copies == 0
    rows = df.select("conv_id", F.when(none, None).otherwise(F.col("turn")).alias("turn"), F.when(none, "").otherwise(F.coalesce("role", F.lit(" "))).alias("role"), F.when(none, "").otherwise(F.coalesce("text", F.lit(" "))).alias("text"), copies.alias("copies"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("digest", F.sha2("text", 256))
    rows = staging.put(rows, "turns")
    order = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    first = rows.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(order).alias("o"))
    first = first.select(F.col("conv_id").alias("c"), F.col("o.turn").alias("t"), F.col("role").alias("r"), F.col("digest").alias("d"), F.lit(True).alias("new"))
    met = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    fault = F.when(~F.col("text").rlike(_SPACE), 1).when(F.col("new").isNull(), 2).when(~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z"), 3).otherwise(0)
    keys = ["conv_id", "turn", "role", "digest"]
    return met.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"), "digest").repartitionByRange(*keys).sortWithinPartitions(*keys)


def repair(df: DataFrame, copies: Column | None = None) -> DataFrame:
    """Pieces of repaired conversations: conv_id, piece, pieces, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    df: conv_id, turn, role, text; copies: how often a row counts, once if not given. A conversation is one piece but for
    long ones and those at the edge of a range. Counts and cost are the whole conversation's; audits and repaired rows
    follow each other by piece.
    """
    staging = Staging()
    ship(df.sparkSession)
    rows = _runs(df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("copies")), staging, F.col("copies"))
    blocks = rows.withColumn("part", F.spark_partition_id()).select("conv_id", "turn", "role", "text", "copies", "fault", "part").mapInArrow(_scan_ranges, _BLOCK_DDL)
    blocks = staging.put(blocks, "blocks")
    edges = blocks.where("not whole")
    light = edges.select("conv_id", "part", "sub", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first_initial", "last_initial", "before", "costs", "leads")
    chained = light.groupBy("conv_id").applyInArrow(_chain, ", ".join(f"{c} bigint" for c in _CHAINED.names))
    traced = edges.select("conv_id", "part", "sub", "rows").join(chained, ["part", "sub"]).mapInArrow(_trace_blocks, _PIECE_DDL)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    whole = blocks.where("whole").select("conv_id", F.lit(0).cast("long").alias("piece"), F.lit(1).cast("long").alias("pieces"), gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")
    staging.drop(blocks)
    return whole.unionByName(traced)


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one row a conversation; texts pass by one at a time."""
    now, told, audit, digest, some = None, None, [], None, False
    names = ["conv_id", *_TOTALS, "audit", "repaired_sha256"]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([told[c]], pa.int64()) for c in names[:-2]), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=names)

    for batch in batches:
        for b in batch.to_pylist():
            if b["piece"] == 0:
                if told:
                    yield row()
                told, audit, digest, some = b, [], hashlib.sha256(), False
            audit.append(b["audit"])
            for turn in b["repaired"]:
                digest.update(f"{chr(10) if some else ''}{turn['role']}:{turn['text']}".encode())
                some = True
    if told:
        yield row()


def report(pieces: DataFrame) -> DataFrame:
    """One row a conversation: its counts, cost, audit, and the SHA-256 of its repaired `role:text`, joined by line feeds.

    A hash of one long string is made in one task, row by row; only conversations of several pieces need it.
    """
    text = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    single = pieces.where("pieces = 1").select("conv_id", *_TOTALS, "audit", F.sha2(text, 256).alias("repaired_sha256"))
    several = pieces.where("pieces > 1").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return single.unionByName(several.mapInArrow(_joined, f"conv_id bigint, {', '.join(f'{c} bigint' for c in _TOTALS)}, audit string, repaired_sha256 string"))


def damage(df: DataFrame) -> DataFrame:
    """Rows harmed by a hash of their place: conv_id, turn, role, text, copies (0: dropped, 2: repeated)."""
    space = F.lit(" ")
    code = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    text = F.coalesce(F.col("text"), space)
    return df.select("conv_id", "turn", F.when(code == 4, "user").otherwise(F.coalesce("role", space)).alias("role"), F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("copies"))
