"""Chat formatting with role repair at the least cost.

Legal chats are [system] (user assistant)* [user]: an automaton whose states are
the role of the last turn. Each turn of a conversation is kept, given another
role, merged into the turn before it or preceded by empty turns; dynamic
programming over the automaton chooses the cheapest repair of the whole
conversation. A turn is a min-plus matrix between states, and these multiply in
any grouping: turns are dealt by range of (conversation, turn), so one
conversation may lie over many tasks. Each task sends the matrix of its first
and its last conversation only; the driver joins these (two small matrices for
each task) into the states at the tasks' borders, and each task then repairs
its own stretch between them.

The result has a row for each turn with its piece of the rendered chat; pieces
in order make up the chat, so no conversation is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.common import checkpoint_dir, small_batches, table

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = -1, 0, 1, 2
#: Other names of the roles, in lower case.
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "model": "assistant", "ai": "assistant", "gpt": "assistant", "agent": "assistant", "developer": "system"}


@dataclass(frozen=True)
class Costs:
    relabel: int = 3
    #: A turn whose role is missing or unknown takes any role at this price.
    name: int = 1
    merge: int = 1
    insert: int = 2


@dataclass(frozen=True)
class Template:
    opening: str = "<|{role}|>\n"
    closing: str = "<|end|>\n"
    joint: str = "\n\n"


#: Empty turns that make a move legal: from state, to role.
INSERTED = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
#: A chat that has a system turn only needs a user turn after it.
AT_END = {START: (), SYSTEM: (USER,), USER: (), ASSISTANT: ()}
STATES = (START, SYSTEM, USER, ASSISTANT)
#: state -> (cost, new turns): the best way to be there.
Row = dict[int, tuple[int, int]]


def role_of(name: str | None) -> int | None:
    name = (name or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else None


def moves(state: int, role: int | None, costs: Costs) -> list[tuple[int, int, bool, tuple[int, ...]]]:
    """(cost, new state, merged, inserted roles) of the ways to take a turn."""
    out = []
    for to in (SYSTEM, USER, ASSISTANT):
        price = 0 if to == role else costs.name if role is None else costs.relabel
        if to == state:
            out.append((price + costs.merge, to, True, ()))
        if (state, to) in INSERTED:
            empty = INSERTED[state, to]
            out.append((price + costs.insert * len(empty), to, False, empty))
    return out


def forward(entry: Row, roles: list[int | None], costs: Costs) -> list[Row]:
    """The best cost, then the fewest new turns, of each state after each turn."""
    rows = [entry]
    for r in roles:
        now: Row = {}
        for s, (c, n) in rows[-1].items():
            for price, to, merged, empty in moves(s, r, costs):
                new = (c + price, n + len(empty) + (not merged))
                if to not in now or new < now[to]:
                    now[to] = new
        rows.append(now)
    return rows


def backward(rows: list[Row], roles: list[int | None], costs: Costs, end: int) -> list[tuple[int, bool, tuple[int, ...]]]:
    """(role, merged, inserted) of each turn of the best way to ``end``; of
    equally good ways the one by the lower state, and unmerged."""
    out = []
    for i in range(len(roles) - 1, -1, -1):
        c, n = rows[i + 1][end]
        s, merged, empty = min((s, m, e) for s, (c0, n0) in rows[i].items() for price, to, m, e in moves(s, roles[i], costs) if to == end and (c0 + price, n0 + len(e) + (not m)) == (c, n))
        out.append((end, merged, empty))
        end = s
    return out[::-1]


def final(row: Row, costs: Costs) -> int:
    return min(row, key=lambda s: (row[s][0] + costs.insert * len(AT_END[s]), row[s][1] + len(AT_END[s]), s))


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple]]]:
    """Runs of one conversation in a task: (conv_id, [(turn, role, text), ...])."""
    key, held = None, []
    for b in batches:
        for c, t, r, x in zip(*(b.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text")), strict=True):
            if held and c != key:
                yield key, held
                held = []
            key = c
            held.append((t, r, x))
    if held:
        yield key, held


def _summaries(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[pa.RecordBatch]:
    """One row for each task with turns: its first and its last conversation,
    and the matrix of each (state before, state after, cost, new turns)."""
    edges = []
    count = 0
    for key, held in stretches(batches):
        roles = [role_of(r) for _, r, _ in held]
        matrix = [v for s in STATES for t, (c, n) in forward({s: (0, 0)}, roles, costs)[-1].items() for v in (s, t, c, n)]
        edges, count = [*edges[:1], (key, matrix)], count + 1
    if edges:
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({
            "task": pa.array([at] * len(edges), pa.int32()), "last": pa.array([i > 0 for i in range(len(edges))]), "conv_id": pa.array([k for k, _ in edges], pa.int64()), "matrix": pa.array([m for _, m in edges], pa.list_(pa.int64())),
        })


@dataclass(frozen=True)
class Border:
    """How a stretch of a conversation that lies over several tasks begins and
    ends; ``whole`` if no more of it follows."""

    entry: Row
    end: int
    whole: bool


def borders(rows: list[tuple[int, bool, int | None, list[int]]], costs: Costs) -> dict[tuple[int, bool], Border]:
    """For (task, whether it is the task's last and not its first conversation).

    ``rows`` holds (task, last, conv_id, matrix) in order."""
    chains: list[list] = []
    for task, last, key, flat in rows:
        m: dict[int, Row] = {}
        for s, t, c, n in zip(*[iter(flat)] * 4, strict=True):
            m.setdefault(s, {})[t] = (c, n)
        if not chains or chains[-1][-1][1] != key:
            chains.append([])
        chains[-1].append(((task, last), key, m))
    out: dict[tuple[int, bool], Border] = {}
    for chain in chains:
        if len(chain) == 1:
            continue
        best: list[Row] = [{START: (0, 0)}]
        for _, _, m in chain:
            now: Row = {}
            for s, (c, n) in best[-1].items():
                for t, (c1, n1) in m.get(s, {}).items():
                    if t not in now or (c + c1, n + n1) < now[t]:
                        now[t] = (c + c1, n + n1)
            best.append(now)
        end = final(best[-1], costs)
        for k in range(len(chain) - 1, -1, -1):
            where, _, m = chain[k]
            before = min(s for s, (c, n) in best[k].items() if end in m.get(s, {}) and (c + m[s][end][0], n + m[s][end][1]) == best[k + 1][end])
            out[where] = Border({before: best[k][before]}, end, k == len(chain) - 1)
            end = before
    return out


RESULT = "conv_id long, turn long, position long, role string, action string, inserted int, rendered string, cost long"
ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("action", pa.string()), ("inserted", pa.int32()), ("rendered", pa.string()), ("cost", pa.int64())])


def repaired(held: list[tuple], border: Border | None, costs: Costs, t: Template) -> list[tuple]:
    """The result's columns after conv_id for a stretch of a conversation."""
    roles = [role_of(r) for _, r, _ in held]
    entry = border.entry if border else {START: (0, 0)}
    rows = forward(entry, roles, costs)
    end = border.end if border else final(rows[-1], costs)
    ways = backward(rows, roles, costs, end)
    ((state, (_, position)),) = entry.items()
    out = []
    opened = state != START
    for (turn, _, text), role, (to, merged, empty) in zip(held, roles, ways, strict=True):
        piece = t.joint if merged else t.closing if opened else ""
        for e in empty:
            piece += t.opening.format(role=ROLES[e]) + t.closing
        if not merged:
            piece += t.opening.format(role=ROLES[to])
        position += len(empty) + (not merged)
        own = 0 if to == role else costs.name if role is None else costs.relabel
        cost = own + costs.merge * merged + costs.insert * len(empty)
        action = "+".join([*["relabel"] * (to != role), *["merge"] * merged, *["insert"] * bool(empty)]) or "keep"
        out.append([turn, position - 1, ROLES[to], action, len(empty), piece + (text or ""), cost])
        opened = True
    if border is None or border.whole:
        tail = AT_END[end]
        out[-1][5] += t.closing + "".join(t.opening.format(role=ROLES[e]) + t.closing for e in tail)
        out[-1][4] += len(tail)
        out[-1][6] += costs.insert * len(tail)
    return [tuple(x) for x in out]


def format_chats(chats: DataFrame, costs: Costs = Costs(), template: Template = Template()) -> DataFrame:
    """A row for each turn: its place among the new turns of its conversation
    from 0, its role, what was done, how many empty turns go before it (after
    the last turn of a lone system prompt: also behind it), its piece of the
    rendered chat and its cost.

    Turns are ordered by ``turn``, null first, then role and text; repeated
    rows are turns of their own. Roles are trimmed and lower-cased and may be
    aliases; a null or unknown role is given one. Null text is empty. Turns
    without conv_id are one conversation. An empty table gives no rows.
    """
    spark = chats.sparkSession
    small_batches(spark)
    checkpoint_dir(spark)
    c = chats.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    order = ["conv_id", "turn", "role", F.xxhash64("text"), "text"]
    # Stored as dealt: both passes must find the same stretches.
    dealt = c.repartitionByRange(*order[:4]).sortWithinPartitions(*order).checkpoint(eager=True)
    edges = dealt.select("conv_id", "role", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("text")).mapInArrow(lambda it: _summaries(it, costs), "task int, last boolean, conv_id long, matrix array<long>")
    known = borders([tuple(r) for r in edges.orderBy("task", "last").collect()], costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
            rows.clear()
            return out

        # Only the first and the last conversation of a task may go on elsewhere.
        before: tuple | None = None
        border = known.get((task, False))
        for key, held in stretches(batches):
            if before:
                rows += [(before[0], *x) for x in repaired(before[1], border, costs, template)]
                border = None
                if len(rows) > 1000:
                    yield batch()
            else:
                first = key, held
            before = (key, held)
        if before:
            border = border if before[1] is first[1] else known.get((task, True))
            rows += [(before[0], *x) for x in repaired(before[1], border, costs, template)]
            yield batch()

    return dealt.mapInArrow(run, RESULT)


def op6_chat_formatting(spark, sf_dir):
    return format_chats(table(spark, sf_dir, "conversations"))
