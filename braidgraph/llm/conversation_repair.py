"""Repair of conversations to the grammar of turns, at least cost.

A conversation's turns are kept, reroled, deleted, or have empty turns inserted between
them, so that the initials of their roles read ``(s?(ua)+)?``. Blank and repeated turns
must go; a truncated one may stay at a price. Of the cheapest edits those whose initials
(D, I, K, R) come first in ASCII order are taken.

A backward dynamic program holds, before each turn and for each of the grammar's four
states, the cost to go. A forward walk then takes, among the edits that are tight with
it, the one with the least initial; as no two edits of one initial lead apart, the walk
is greedy and needs no search.

Turns are range-partitioned by conversation and place and sorted, so a conversation with
a large share of all turns lies in many partitions. What a partition holds of such a one
is a segment, described by a 4 x 4 matrix: the least cost from each state before it to
each state after it. Segments, two for each partition at most, are chained on the
driver: costs to go from the last to the first, then, by the state in which each
segment's walk ends for every state in which it may begin, states from the first to the
last. Each segment is then walked where it lies. Only a digest of a whole conversation
is sequential; pieces of those that span partitions are streamed for it in order,
through one task that holds one piece.

Defined edge cases: a null role or text is one space; a null conv_id is a conversation
of its own; turns go by number, nulls first, then by role and the text's SHA-256;
repeated rows are repeated turns; a role with another initial must be reroled or
deleted; a conversation without turns is valid; an empty table gives no rows; other
columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidgraph.llm.common import checkpointed, dealt_join, small_batches

FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
RETOLD, DELETED, INSERTED, CUT = 1, 2, 5, 5
#: The grammar's states: at the start, after a system, a user, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that the next user or assistant turn leads to, and the cost to end.
NEXT, END = (USER, USER, ASSISTANT, USER), (0, 10, 5, 0)
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
FAR = 1 << 40
#: Characters of a piece that is streamed to the digest.
PIECE = 1 << 20
_BLANKS = " \t\n\x0b\x0c\r"


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone of ``turns``, damaged by a checksum of ``conv_id:turn``: one
    kind of twenty drops a row (it stays, marked as gone), empties its text, removes its stops,
    repeats it, or makes it the user's."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(kind < 2, "").when(kind == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    role = F.when(kind == 4, "user").otherwise(spaced("role"))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), copies).drop("copy")


def ordered(turns: DataFrame, gone: Column | None = None) -> DataFrame:
    """The turns in sorted ranges, with the part they lie in and their first fault, and before each
    repeated one a row that says so. Rows where ``gone`` holds only name their conversation."""
    gone = F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").isNotNull().alias("named"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), gone.alias("gone"))
    body = F.rtrim("text", F.lit(_BLANKS))
    fault = F.when(body == "", BLANK).when(~F.right(body, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    numbered = F.col("turn").isNotNull().alias("numbered"), F.coalesce("turn", F.lit(0)).alias("at")
    # written once, so that both of its uses see the same row numbers
    rows = checkpointed(rows.select("named", "conv", *numbered, "role", "text", "gone", fault.alias("fault"), F.unhex(F.sha2("text", 256)).alias("mark"), F.monotonically_increasing_id().alias("row_no")))
    place = F.struct("numbered", "at", "row_no")
    keys = ["named", "conv", "role", "mark"]
    said = rows.where(~F.col("gone") & (F.col("fault") != BLANK)).select(*keys, "numbered", "at", "row_no")
    first = said.groupBy(*keys).agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    again = dealt_join(said, first, keys).where(place != F.col("first")).drop("first")
    none = F.lit(None).cast("string")
    again = again.select("named", "conv", "numbered", "at", "role", none.alias("text"), F.lit(False).alias("gone"), F.lit(DUPLICATE).alias("fault"), "mark", "row_no")
    both = rows.withColumn("later", F.lit(1)).unionByName(again.withColumn("later", F.lit(0)))
    order = ["named", "conv", "numbered", "at", "role", "mark", "row_no"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartitionByRange(n, *order).sortWithinPartitions(*order, "later")
    turn = F.when(F.col("numbered"), F.col("at")).alias("turn")
    return checkpointed(dealt.select(F.spark_partition_id().cast("long").alias("part"), "named", "conv", turn, "role", "text", "gone", "fault", "later"))


class Run:
    """The turns of one conversation in one part."""

    def __init__(self, part: int, conv: int | None):
        self.part, self.conv = part, conv
        self.initials: list[int | None] = []
        self.faults: list[int] = []
        self.turns: list[int | None] = []
        self.said: list[tuple[str, str]] = []

    def back(self, end: tuple[int, ...]) -> list[tuple[int, ...]]:
        """Costs to go before each turn and at the end, where they are ``end``."""
        out = [end]
        for initial, fault in zip(reversed(self.initials), reversed(self.faults), strict=True):
            after, base = out[-1], []
            cut = CUT if fault == TRUNCATED else 0
            stays = fault not in (BLANK, DUPLICATE)
            for state in range(4):
                cost = DELETED + after[state]
                if stays:
                    cost = min(cost, RETOLD + cut + after[NEXT[state]])
                    if (to := kept(state, initial)) is not None:
                        cost = min(cost, cut + after[to])
                base.append(cost)
            out.append(tuple(min(base[s], INSERTED + base[NEXT[s]], 2 * INSERTED + base[NEXT[NEXT[s]]]) for s in range(4)))
        return out[::-1]

    def matrix(self) -> list[int]:
        """Least costs from each state before the turns to each state after them, row by row."""
        columns = [self.back(tuple(0 if s == t else FAR for s in range(4)))[0] for t in range(4)]
        return [min(FAR, columns[t][s]) for s in range(4) for t in range(4)]

    def walk(self, state: int, end: tuple[int, ...], last: bool) -> Iterator[tuple[str, int, int, int]]:
        """(edit, turn or -1, state afterwards, cost); ``last`` if the conversation ends here."""
        go = self.back(end)
        i, n = 0, len(self.faults)
        while i < n or last and END[state]:
            if i == n:
                state = NEXT[state]
                yield "I", -1, state, INSERTED
                continue
            now, after, initial, fault = go[i], go[i + 1], self.initials[i], self.faults[i]
            cut = CUT if fault == TRUNCATED else 0
            to = kept(state, initial) if fault not in (BLANK, DUPLICATE) else None
            if now[state] == DELETED + after[state]:
                yield "D", i, state, DELETED
            elif now[state] == INSERTED + now[NEXT[state]]:
                state = NEXT[state]
                yield "I", -1, state, INSERTED
                continue
            elif to is not None and now[state] == cut + after[to]:
                state = to
                yield "K", i, state, cut
            else:
                state = NEXT[state]
                yield "R", i, state, RETOLD + cut
            i += 1

    def edits(self, state: int, end: tuple[int, ...], last: bool) -> Iterator[tuple[str, str | None, str | None, int]]:
        """(edit, role, text, cost) along the walk; without role and text where a turn goes."""
        for edit, i, to, cost in self.walk(state, end, last):
            role, text = self.said[i] if i >= 0 else (None, "")
            if edit == "D":
                yield edit, None, None, cost
            else:
                yield edit, role if edit == "K" else ROLE[to], text, cost

    def counts(self) -> list:
        """blank, duplicate, truncated, illegal, different turns, first and last turn, first and last initial (-1: another), turns."""
        numbers = [t for t in self.turns if t is not None]
        known = [-1 if x is None else x for x in self.initials]
        illegal = sum((a, b) not in LEGAL for a, b in zip(known, known[1:], strict=False))
        ends = [numbers[0], numbers[-1]] if numbers else [None, None]
        edges = [known[0], known[-1]] if known else [None, None]
        return [*(self.faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), illegal, len(set(numbers)), *ends, *edges, len(known)]


def kept(state: int, initial: int | None) -> int | None:
    """The state after a turn with this initial, if it may follow."""
    if initial == SYSTEM:
        return SYSTEM if state == START else None
    return initial if initial == NEXT[state] else None


def merged(a: list, b: list) -> list:
    """Counts of two runs, one after the other."""
    if not b[9] or not a[9]:
        return b if not a[9] else a
    out = [x + y for x, y in zip(a[:5], b[:5], strict=True)]
    out[3] += (a[8], b[7]) not in LEGAL
    out[4] -= a[6] is not None and a[6] == b[5]
    return [*out, b[5] if a[5] is None else a[5], a[6] if b[6] is None else b[6], a[7], b[8], a[9] + b[9]]


_NARROW = ["part", "named", "conv", "turn", "role", "gone", "fault", "later"]


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    """The runs of a part, in order; with what was said if the batches have it."""
    run, again = None, False
    for b in batches:
        cols = [b.column(c).to_pylist() for c in _NARROW]
        texts = b.column("text") if "text" in b.schema.names else None
        for i, (part, named, conv, turn, role, gone, fault, later) in enumerate(zip(*cols, strict=True)):
            conv = conv if named else None
            if run is None or run.conv != conv:
                if run is not None:
                    yield run
                run = Run(part, conv)
            if gone:
                continue
            if not later:
                again = True
                continue
            run.initials.append(INITIAL.get(role[:1]))
            run.faults.append(DUPLICATE if again else fault)
            run.turns.append(turn)
            again = False
            if texts is not None:
                run.said.append((role, texts[i].as_py()))
    if run is not None:
        yield run


Key = tuple  # (part, conv_id)


def chained(rows: DataFrame) -> dict[Key, tuple[tuple[int, ...], int, bool]]:
    """For each segment of a conversation that spans parts: costs to go at its end, the state before it, and whether it is the last."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for run in runs(batches):
            first, last = first or run, run
        ends = [] if first is None else [first] if first is last else [first, last]
        yield pa.RecordBatch.from_arrays([pa.array([x.part for x in ends], pa.int64()), pa.array([x.conv for x in ends], pa.int64()), pa.array([x.matrix() for x in ends], pa.list_(pa.int64()))], names=["part", "conv", "costs"])

    narrow = small_batches(rows).select(*_NARROW)
    met = [(r.part, r.conv, r.costs) for r in narrow.mapInArrow(outer, "part long, conv long, costs array<long>").collect()]
    # inside a part the order of the two is that of their conversations
    met.sort(key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    chains: list[list] = []
    for r in met:
        if chains and chains[-1][-1][1] == r[1] and chains[-1][-1][0] != r[0]:
            chains[-1].append(r)
        else:
            chains.append([r])
    chains = [c for c in chains if len(c) > 1]
    if not chains:
        return {}
    ends: dict[Key, tuple[int, ...]] = {}
    for chain in chains:
        end: tuple[int, ...] = END
        for part, conv, m in reversed(chain):
            ends[part, conv] = end
            end = tuple(min(m[4 * s + t] + end[t] for t in range(4)) for s in range(4))
    finals = {(c[-1][0], c[-1][1]) for c in chains}
    sent = rows.sparkSession.sparkContext.broadcast(ends)  # two for each part at most

    def arrive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            if (end := sent.value.get((run.part, run.conv))) is not None:
                to = []
                for state in range(4):
                    for *_, state, _ in run.walk(state, end, False):  # noqa: B020
                        pass
                    to.append(state)
                yield pa.RecordBatch.from_arrays([pa.array([run.part], pa.int64()), pa.array([run.conv], pa.int64()), pa.array([to], pa.list_(pa.int32()))], names=["part", "conv", "to"])

    convs = sorted({c for _, c in ends if c is not None})
    wanted = F.col("conv").isin(convs) if convs else F.lit(False)
    spans = narrow.where(~F.col("named") | wanted)
    arrivals = {(r.part, r.conv): r.to for r in spans.mapInArrow(arrive, "part long, conv long, to array<int>").collect()}
    out: dict[Key, tuple] = {}
    for chain in chains:
        state = START
        for part, conv, _ in chain:
            out[part, conv] = (ends[part, conv], state, (part, conv) in finals)
            state = arrivals[part, conv][state]
    return out


def repaired_turns(turns: DataFrame, gone: Column | None = None) -> DataFrame:
    """conv_id, part and nth (both give the order), edit, role and text of every edit; role and text are null where a turn was deleted."""
    rows = ordered(turns, gone)
    plan = rows.sparkSession.sparkContext.broadcast(chained(rows))
    names, kinds = ["conv_id", "part", "nth", "edit", "role", "text"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for run in runs(batches):
            end, state, last = plan.value.get((run.part, run.conv), (END, START, True))
            for nth, (edit, role, text, _) in enumerate(run.edits(state, end, last)):
                held.append((run.conv, run.part, nth, edit, role, text))
                size += len(text or "") + 64
                if size > PIECE:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return small_batches(rows).select(*_NARROW, "text").mapInArrow(run_all, "conv_id long, part long, nth long, edit string, role string, text string")


_PIECES = {"conv": pa.int64(), "part": pa.int64(), "nth": pa.int64(), "counts": pa.list_(pa.int64()), "cost": pa.int64(), "audit": pa.string(), "lines": pa.int64(), "said": pa.string(), "whole": pa.bool_(), "digest": pa.string()}
_REPORT = {"conv_id": pa.int64(), "gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(), "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()}


def batch_of(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values(), strict=True)], names=list(kinds))


def pieces(run: Run, state: int, end: tuple[int, ...], last: bool, whole: bool) -> Iterator[tuple]:
    """What a run adds to its conversation's report. Of a whole conversation it is one row with
    the digest; else rows of some ``PIECE`` characters, of which the first has the counts."""
    audit, said, size, cost, nth, lines = [], [], 0, 0, 0, 0
    digest, counts = sha256(), run.counts()
    for edit, role, text, price in run.edits(state, end, last):
        audit.append(edit)
        cost += price
        size += 1
        if role is not None:
            line = f"{role}:{text}"
            if whole:
                digest.update((f"\n{line}" if lines else line).encode())
            else:
                said.append(line)
                size += len(line)
            lines += 1
        if not whole and size > PIECE:
            yield run.conv, run.part, nth, counts, cost, "".join(audit), lines, "\n".join(said), False, None
            audit, said, size, cost, nth, counts, lines = [], [], 0, 0, nth + 1, None, 0
    yield run.conv, run.part, nth, counts, cost, "".join(audit), lines, "\n".join(said), whole, digest.hexdigest() if whole else None


def reported(conv: int | None, counts: list | None, cost: int, audit: str, digest: str) -> tuple:
    blank, duplicate, truncated, illegal, different, first, last, *_ = counts or [0] * 5 + [None] * 4 + [0]
    gaps = last - first + 1 - different if first is not None else 0
    return conv, gaps, blank, duplicate, truncated, illegal, cost, audit, digest


def repair_report(turns: DataFrame, gone: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation."""
    rows = ordered(turns, gone)
    spans = chained(rows)
    plan = rows.sparkSession.sparkContext.broadcast(spans)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for run in runs(batches):
            end, state, last = plan.value.get((run.part, run.conv), (END, START, True))
            for piece in pieces(run, state, end, last, (run.part, run.conv) not in plan.value):
                held.append(piece)
                size += len(piece[5]) + len(piece[7]) + 64
                if size > PIECE:
                    yield batch_of(held, _PIECES)
                    held, size = [], 0
        yield batch_of(held, _PIECES)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch_of([reported(r["conv"], r["counts"], r["cost"], r["audit"], r["digest"]) for r in b.to_pylist()], _REPORT)

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces come sorted; one at a time is held."""
        conv, counts, cost, audit, lines, digest = None, None, 0, [], 0, None
        for b in batches:
            for k in range(b.num_rows):
                r = {n: c[k].as_py() for n, c in zip(b.schema.names, b.columns, strict=True)}
                if digest is None or r["conv"] != conv:
                    if digest is not None:
                        yield batch_of([reported(conv, counts, cost, "".join(audit), digest.hexdigest())], _REPORT)
                    conv, counts, cost, audit, lines, digest = r["conv"], None, 0, [], 0, sha256()
                if r["counts"] is not None:
                    counts = r["counts"] if counts is None else merged(counts, r["counts"])
                if r["lines"]:
                    digest.update((("\n" if lines else "") + r["said"]).encode())
                lines, cost = lines + r["lines"], cost + r["cost"]
                audit.append(r["audit"])
        if digest is not None:
            yield batch_of([reported(conv, counts, cost, "".join(audit), digest.hexdigest())], _REPORT)

    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    made = small_batches(rows).select(*_NARROW, "text").mapInArrow(cut, "conv long, part long, nth long, counts array<long>, cost long, audit string, lines long, said string, whole boolean, digest string")
    if not spans:
        return made.mapInArrow(whole, schema)
    made = checkpointed(made)  # both halves read it
    apart = made.where(~F.col("whole")).repartition("conv").sortWithinPartitions("conv", "part", "nth")
    return made.where("whole").mapInArrow(whole, schema).unionByName(apart.mapInArrow(stitch, schema))
