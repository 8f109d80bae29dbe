"""Cheapest repair of a conversation's turn structure, by a rank-compressed dynamic program.

Rows are kept, rerolled, deleted, and turns inserted, so that the roles read system (at most one, first), then pairs of
user and assistant. Rows are the layers of a dynamic program over what came last (nothing, system, user, assistant).
The edits from one row to the next are a macro: a run of inserts and the row's own edit. As text (IIK, ID, R) macros are
prefix-free, so comparing two audits of as many rows is comparing their macros one by one. A state therefore keeps no
audit, only its cost, its audit's rank among the layer's states, and a pointer to the state and macro before; the
audit is read back at the end.

The same holds for blocks of rows: for each state before and after, a block has a cost and a rank, and blocks are the
layers of the next program. A conversation of any length is split into blocks at most of ``BLOCK_ROWS`` rows, that
Spark deals out by ranges of (conversation, turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracewright.llm.common import join_totals, sliced, written

#: States by what came last; what an insert or a reroll adds next, and the state it leads to.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ADDS = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Role initials that may be kept after a state.
KEEPS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LEGAL = ("su", "ua", "au")
#: Inserts that end a conversation well, by the state after its last row.
CLOSING = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Two inserts lead from any state to one that keeps what ASSISTANT keeps; a third leads where one led.
MACROS = sorted("I" * n + edit for n in range(3) for edit in "DKR")
FINE, CUT, DUPLICATE, BLANK = range(4)
NEVER = 1 << 62
SPACES = "\t\n\x0b\x0c\r "
BLOCK_ROWS, BLOCK_BYTES = 1000, 1 << 20


@lru_cache(4096)
def moves(initial: str, fault: int) -> tuple[tuple[int, int, int, int], ...]:
    """(state before, state after, cost, macro) of a row; of two ways between the same states the better one."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for before in ADDS:
        for code, macro in enumerate(MACROS):
            state, cost = before, INSERT * (len(macro) - 1)
            for _ in macro[:-1]:
                state = ADDS[state]
            if macro[-1] == "D":
                cost += DELETE
            elif fault in (DUPLICATE, BLANK):
                continue
            else:
                cost += (fault == CUT) * TRUNCATED + (macro[-1] == "R") * REROLE
                state = ADDS[state] if macro[-1] == "R" else KEEPS.get((state, initial))
                if state is None:
                    continue
            best[before, state] = min(best.get((before, state), (NEVER, 0)), (cost, code))
    return tuple((a, b, *v) for (a, b), v in best.items())


def layer(cost: list[int], rank: list[int], steps) -> tuple[list[int], list[int], list[tuple[int, int] | None]]:
    """Costs, ranks and pointers after one layer; a step is (state before, after, cost, order among a state's steps)."""
    best: list[tuple | None] = [None] * 4
    for a, b, c, code in steps:
        if cost[a] < NEVER:
            key = (cost[a] + c, rank[a], code, a)
            if best[b] is None or key < best[b]:
                best[b] = key
    reached = sorted((s for s in ADDS if best[s]), key=lambda s: best[s][1:3])
    ranks = [0] * 4
    for k, s in enumerate(reached):
        ranks[s] = k
    return [b[0] if b else NEVER for b in best], ranks, [(b[3], b[2]) if b else None for b in best]


def forward(rows: list[tuple[str, int]], entry: int):
    """After all rows (role initial, fault), begun in state ``entry``: costs, ranks, and the pointers of each layer."""
    cost, rank, back = [NEVER] * 4, [0] * 4, []
    cost[entry] = 0
    for initial, fault in rows:
        cost, rank, pointers = layer(cost, rank, moves(initial, fault))
        back.append(pointers)
    return cost, rank, back


def closing(cost: list[int], rank: list[int]) -> int:
    """The best last state."""
    return min((s for s in ADDS if cost[s] < NEVER), key=lambda s: (cost[s] + INSERT * CLOSING[s], rank[s]))


def edits(turns: list[tuple[str, str]], back: list, entry: int, state: int, last: bool) -> tuple[str, list[tuple[str, str]]]:
    """The audit and the repaired turns of rows (role, text) that end in ``state``; at the end of all, with its inserts."""
    codes = []
    for pointers in reversed(back):
        state, code = pointers[state]
        codes.append(MACROS[code])
    codes.reverse()
    out = []
    for (role, text), macro in zip([*turns, ("", "")] if last else turns, codes + [None] * last):
        for edit in "I" * CLOSING[entry] if macro is None else macro:
            if edit in "IR":
                entry = ADDS[entry]
                out.append((ROLE[entry], text if edit == "R" else ""))
            elif edit == "K":
                entry = KEEPS[entry, role[:1]]
                out.append((role, text))
        if macro is None:
            codes.append("I" * (len(out) - sum(len(c) - ("D" in c) for c in codes)))
    return "".join(codes), out


PIECE = "conv_id {}, part int, k int, turns array<struct<role:string,text:string,fault:int>>, costs array<long>, ranks array<int>, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, n_turns long, cost long, audit string, repaired array<struct<role:string,text:string>>, repaired_sha256 string"


def _lines(repaired: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in repaired).encode("utf-8", "surrogatepass")


class _Block:
    """Rows of a conversation, in order."""

    def __init__(self) -> None:
        self.rows: list[tuple[int | None, str, str, int]] = []
        self.size = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.rows.append((turn, role, text, fault))
        self.size += len(role) + len(text)

    def full(self) -> bool:
        return len(self.rows) >= BLOCK_ROWS or self.size >= BLOCK_BYTES

    def facts(self) -> dict:
        initials = [role[:1] for _, role, _, _ in self.rows]
        turns = [t for t, *_ in self.rows if t is not None]
        faults = [f for *_, f in self.rows]
        return {
            "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(CUT), "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "first": initials[0], "last": initials[-1], "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "n_turns": len(set(turns)),
        }

    def classes(self) -> list[tuple[str, int]]:
        return [(role[:1], fault) for _, role, _, fault in self.rows]

    def open(self) -> dict:
        """What the block costs between any two states."""
        ways = [forward(self.classes(), entry)[:2] for entry in ADDS]
        turns = [{"role": role, "text": text, "fault": fault} for _, role, text, fault in self.rows]
        return self.facts() | {"turns": turns, "costs": [c for cost, _ in ways for c in cost], "ranks": [r for _, rank in ways for r in rank]}

    def solved(self) -> dict:
        cost, rank, back = forward(self.classes(), NOTHING)
        end = closing(cost, rank)
        audit, out = edits([(role, text) for _, role, text, _ in self.rows], back, NOTHING, end, True)
        return self.facts() | {"cost": cost[end] + INSERT * CLOSING[end], "audit": audit, "repaired": [{"role": r, "text": t} for r, t in out], "repaired_sha256": hashlib.sha256(_lines(out)).hexdigest()}


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 2000, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(t["text"]) for t in (row.get("turns") or row.get("repaired") or ()))
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for whole in batches:
        for batch in sliced(whole):
            yield from zip(*(c.to_pylist() for c in batch.columns))


def _mapped(df: DataFrame, function, schema: str) -> DataFrame:
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: _batches(function(_rows(batches)), kinds), schema)


def _pieces(rows: Iterator[tuple]) -> Iterator[dict]:
    """Conversations that lie within the task and one block are solved; others, and the task's first and last, are blocks."""
    part, k, first, ident, block, opened = TaskContext.get().partitionId(), 0, True, None, None, False
    for conv, *row in rows:
        if block is None or conv != ident:
            if block is not None:
                if first or opened:
                    yield {"conv_id": ident, "part": part, "k": k} | block.open()
                else:
                    yield {"conv_id": ident} | block.solved()
                first, k = False, k + 1
            ident, block, opened = conv, _Block(), False
        elif block.full():
            yield {"conv_id": ident, "part": part, "k": k} | block.open()
            block, opened, k = _Block(), True, k + 1
        block.add(*row)
    if block is not None:
        yield {"conv_id": ident, "part": part, "k": k} | block.open()


CHAINED = "conv_id {}, part int, k int, entry int, exit int, closes boolean, cost long, illegal long, same_turn long"


def _chained(rows: Iterator[tuple]) -> Iterator[dict]:
    """Blocks of conversations in order, as layers; the states between them on the best way."""

    def solved(ident, blocks: list[tuple], pointers: list, cost: list[int], rank: list[int]) -> list[dict]:
        state = end = closing(cost, rank)
        out = []
        for (part, k, illegal, same), back in zip(reversed(blocks), reversed(pointers)):
            closes, after = not out, state
            state = back[state][0]
            out.append({"conv_id": ident, "part": part, "k": k, "entry": state, "exit": after, "closes": closes, "cost": cost[end] + INSERT * CLOSING[end] if closes else 0, "illegal": illegal, "same_turn": same})
        return out[::-1]

    blocks: list[tuple] = []
    for ident, part, k, costs, ranks, first, last, low, high in rows:
        if blocks and ident != now:
            yield from solved(now, blocks, pointers, cost, rank)
            blocks = []
        if not blocks:
            now, pointers, cost, rank, before = ident, [], [0, NEVER, NEVER, NEVER], [0] * 4, None
        # What lies between two blocks: a pair of roles, a turn that both hold.
        illegal = before is not None and before[0] + first not in LEGAL
        same = before is not None and low is not None and before[1] == low
        cost, rank, back = layer(cost, rank, [(a, b, costs[4 * a + b], ranks[4 * a + b]) for a in ADDS for b in ADDS if costs[4 * a + b] < NEVER])
        pointers.append(back)
        blocks.append((part, k, int(illegal), int(same)))
        before = (last, high)
    if blocks:
        yield from solved(now, blocks, pointers, cost, rank)


def _applied(rows: Iterator[tuple]) -> Iterator[dict]:
    for ident, part, k, turns, entry, exit_, closes in rows:
        back = forward([(t["role"][:1], t["fault"]) for t in turns], entry)[2]
        audit, out = edits([(t["role"], t["text"]) for t in turns], back, entry, exit_, closes)
        yield {"conv_id": ident, "part": part, "k": k, "audit": audit, "repaired": [{"role": r, "text": t} for r, t in out]}


def _digests(rows: Iterator[tuple]) -> Iterator[dict]:
    """Audits and digests of conversations whose pieces come in order; a piece is held at a time."""
    digest = None
    for ident, audit, out in rows:
        if digest is not None and ident != now:
            yield {"conv_id": now, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}
            digest = None
        if digest is None:
            now, audits, digest, begun = ident, [], hashlib.sha256(), False
        audits.append(audit)
        if out:
            digest.update(b"\n" * begun + _lines([(t["role"], t["text"]) for t in out]))
            begun = True
    if digest is not None:
        yield {"conv_id": now, "audit": "".join(audits), "repaired_sha256": digest.hexdigest()}


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of ``rows``, damaged by the CRC of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes ``[.!?]`` out of it, 3 repeats it, 4 makes its role user. A null role
    or text is one space, and so is a null id or turn in the CRC's text; ids and turns themselves stay null.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"))
    out = out.withColumn("way", F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20).where("way != 0")
    out = out.withColumn("text", F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("way") == 4, "user").otherwise(F.col("role")))
    out = out.withColumn("copy", F.explode(F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return out.select("conv_id", "turn", "role", "text")


def marked(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with ``fault`` and what orders them; equal rows meet as counts before they are told apart.

    A row's first fault: blank, duplicate (role and text earlier in the conversation), truncated.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    slim = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"))
    unique = slim.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    unique = written(unique.withColumn("key", F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.length("role").cast("string"), F.col("role"), F.col("text")).cast("binary"))))
    # Null turns come first.
    turn = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    totals = unique.groupBy("key").agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("n"))
    met = join_totals(unique, totals, "key", unique.count())
    later = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    met = met.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    end = F.trim(F.col("text"), F.lit(SPACES))
    fault = F.when(end == "", BLANK).when(later | (F.col("copy") > 0), DUPLICATE).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(FINE)
    return met.select("conv_id", "turn", "role", "text", fault.cast("int").alias("fault"), F.left("text", F.lit(64)).alias("head"), "key", "copy")


def repair_pieces(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of conversations, and their repaired turns in pieces (conv_id, part, k, repaired), by part and k.

    See ``repaired``.
    """
    ident = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "role", "head", "key", "copy"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = marked(rows).repartitionByRange(n, *order).sortWithinPartitions(*order)
    pieces = written(_mapped(dealt.select("conv_id", "turn", "role", "text", "fault"), _pieces, PIECE.format(ident)))
    blocks, done = pieces.where("part is not null"), pieces.where("part is null")
    ends = blocks.select("conv_id", "part", "k", "costs", "ranks", "first", "last", "low", "high")
    ways = written(_mapped(ends.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "k"), _chained, CHAINED.format(ident)))
    way = ways.select("part", "k", "entry", "exit", "closes")
    applied = blocks.select("conv_id", "part", "k", "turns").join(way, ["part", "k"]).select("conv_id", "part", "k", "turns", "entry", "exit", "closes")
    applied = written(_mapped(applied, _applied, f"conv_id {ident}, part int, k int, audit string, repaired array<struct<role:string,text:string>>"))
    ordered = applied.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "k").select("conv_id", "audit", "repaired")
    digests = _mapped(ordered, _digests, f"conv_id {ident}, audit string, repaired_sha256 string")
    between = ways.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal_between"), F.sum("same_turn").alias("same"))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "n_turns")]
    summed = blocks.groupBy("conv_id").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"))
    names = {"conv_id": "mine"}
    joined = summed.join(between.withColumnsRenamed(names), F.col("conv_id").eqNullSafe(F.col("mine"))).drop("mine")
    joined = joined.join(digests.withColumnsRenamed(names), F.col("conv_id").eqNullSafe(F.col("mine"))).drop("mine")
    joined = joined.withColumn("illegal", F.col("illegal") + F.col("illegal_between")).withColumn("n_turns", F.col("n_turns") - F.col("same"))
    facts = ["conv_id", "blank", "duplicate", "truncated", "illegal", "low", "high", "n_turns", "cost", "audit", "repaired_sha256"]
    both = done.select(facts).unionByName(joined.select(facts))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("n_turns"), F.lit(0))
    both = both.select("conv_id", gaps.alias("gaps"), *[c for c in facts[1:] if c not in ("low", "high", "n_turns")])
    zero = F.lit(0).cast("int")
    turns = done.select("conv_id", zero.alias("part"), zero.alias("k"), "repaired").unionByName(applied.select("conv_id", "part", "k", "repaired"))
    return both, turns


def repaired(rows: DataFrame, idents: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    ``rows`` holds conv_id, turn, role and text; a conversation is its rows by turn (null first), then role, the first
    64 characters of the text, and a hash of all. Each row's first fault counts: blank (no word), duplicate (role and
    text earlier), truncated (does not end in ``[.!?]``). ``gaps`` are turns that miss between the least and the
    greatest; ``illegal`` adjacent roles whose initials aren't su, ua or au. Keeping a row costs 0, a new role 2,
    deleting 3 (blank and duplicate rows must go), inserting an empty turn 2, and a truncated row that stays 1 more.
    ``audit`` is the cheapest edits' initials, in order, of those the least as ASCII, and ``repaired_sha256`` hashes the
    ``role:text`` of what they give, by lines.

    A null role or text is one space. Null ids are one conversation. ``idents`` may name conversations without rows:
    they have zeros, an empty audit and the hash of an empty text. Repeated rows are duplicates; other columns are
    ignored; an empty table stays empty. An audit is one value, so a conversation has at most 2^31 edits; its digest is
    one sum, so one task reads its repaired turns in order, a block at a time.
    """
    out = repair_pieces(rows)[0]
    if idents is None:
        return out
    listed = idents.select(F.col("conv_id").alias("original")).distinct()
    out = listed.join(out, F.col("original").eqNullSafe(F.col("conv_id")), "left").drop("conv_id").withColumnRenamed("original", "conv_id")
    zeros = {c: 0 for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.fillna(zeros | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}).select("conv_id", *zeros, "audit", "repaired_sha256")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the repaired conversations, turns numbered from 0; see ``repaired``."""
    from pyspark.sql import Window

    turns = repair_pieces(rows)[1]
    # A window holds a conversation's pieces, of up to BLOCK_ROWS turns each, as numbers only.
    sizes = turns.select("conv_id", "part", "k", F.size("repaired").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("conv_id").alias("mine"), F.col("part").alias("p"), F.col("k").alias("q"), F.coalesce(before, F.lit(0)).alias("start"))
    met = turns.join(starts, F.col("conv_id").eqNullSafe(F.col("mine")) & (F.col("part") == F.col("p")) & (F.col("k") == F.col("q")))
    return met.select("conv_id", "start", F.posexplode("repaired").alias("at", "t")).select("conv_id", (F.col("start") + F.col("at")).alias("turn"), "t.role", "t.text")
