"""Chat formatting: the cheapest repair of a conversation's roles, then its rendered messages.

A legal conversation is system?, then user and assistant in turn, the assistant last.
An automaton over the role of the last message says what may follow.  For each turn
the repair may keep it, merge it into the message before, give it another role, or
put an empty message before it; at the end it may add an empty answer.  Dynamic
programming finds the repair of least cost; ties are broken in the order of ACTIONS.

A conversation may be of any length, so none is gathered: turns are sorted over all
partitions, each partition sums up a conversation's run of turns as a small matrix
(cheapest cost from each state to each state), the matrices of runs that cross
partitions are joined on the driver (two for each partition at most), and each
partition then writes its own run's repair.

Turns are ordered by turn, then role, then a hash of the text; a null turn comes
first.  Roles are compared without case or outer space; a null or unknown role takes
whatever role costs least.  A null text is an empty text.  Equal rows are turns of
their own.  A null conv_id is a conversation like any other.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, shuffle_partitions, text_bytes

# States: nothing yet, and the role of the last message.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = ["", "system", "user", "assistant"]
#: Roles that mean one of the three.
ALIASES = {"human": USER, "prompter": USER, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT, "developer": SYSTEM}
#: Which role may follow which state.
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: Costs of a merge, another role, an empty message; a system message is dearer to relabel than the others.
MERGE, RELABEL, RELABEL_SYSTEM, EMPTY = 1.0, 3.0, 4.0, 2.0
#: In the order in which ties are broken.
ACTIONS = ["keep", "merge", "insert", "relabel"]
FAR = float("inf")
#: Bytes of text of a partition at most, about; rows written at once.
PART_BYTES, WRITTEN = 32 << 20, 4096

Step = tuple[float, int, str, int]  # cost, state after, action, role of an empty message before (0: none)


def steps(state: int, role: int) -> list[Step]:
    """What may be done with a turn of this role after this state. role 0: unknown."""
    out: list[Step] = []
    roles = (role,) if role else (SYSTEM, USER, ASSISTANT)
    for r in roles:
        if (state, r) in LEGAL:
            out.append((0.0 if role else RELABEL / 2, r, "keep" if role else "relabel", 0))
        if state == r:
            out.append((MERGE if role else MERGE + RELABEL / 2, r, "merge", 0))
        for e in (USER, ASSISTANT):
            if (state, e) in LEGAL and (e, r) in LEGAL:
                out.append((EMPTY + (0 if role else RELABEL / 2), r, "insert", e))
    if role:
        price = RELABEL_SYSTEM if role == SYSTEM else RELABEL
        out += [(price, r, "relabel", 0) for r in (SYSTEM, USER, ASSISTANT) if r != role and (state, r) in LEGAL]
        if state not in (START, role):
            out.append((price + MERGE, state, "merge", 0))
    return out


_STEPS = {(s, r): steps(s, r) for s in range(4) for r in range(4)}
#: Cost of ending after each state, and the empty messages that it takes.
_END = {START: (2 * EMPTY, (USER, ASSISTANT)), SYSTEM: (2 * EMPTY, (USER, ASSISTANT)), USER: (EMPTY, (ASSISTANT,)), ASSISTANT: (0.0, ())}


def role_of(role: str | None) -> int:
    key = (role or "").strip().lower()
    return ROLES.get(key) or ALIASES.get(key) or 0


def _order(step: Step) -> tuple:
    return step[0], ACTIONS.index(step[2]), step[1], step[3]


def solve(roles: list[int], start: int) -> tuple[list[float], list[dict[int, tuple[int, Step]]]]:
    """Least cost of each state after the turns, and for each turn and state the state before and the step."""
    costs = [FAR] * 4
    costs[start] = 0.0
    back = []
    for role in roles:
        best: dict[int, tuple] = {}
        for s in range(4):
            if costs[s] < FAR:
                for step in _STEPS[s, role]:
                    key = (costs[s] + step[0], *_order(step)[1:], s)
                    if step[1] not in best or key < best[step[1]][0]:
                        best[step[1]] = (key, s, step)
        costs = [best[s][0][0] if s in best else FAR for s in range(4)]
        back.append({s: (b[1], b[2]) for s, b in best.items()})
    return costs, back


def matrix(roles: list[int]) -> list[list[float]]:
    return [solve(roles, s)[0] for s in range(4)]


def path(roles: list[int], start: int, end: int) -> list[Step]:
    """The cheapest steps from one state to another."""
    _, back = solve(roles, start)
    out, at = [], end
    for b in reversed(back):
        at, step = b[at]
        out.append(step)
    return out[::-1]


def render_open(role: int) -> str:
    return f"<|{NAMES[role]}|>\n"


CLOSE = "<|end|>\n"


def render(step: Step, state: int, text: str) -> str:
    """What a turn adds to the rendered conversation; a message is closed when the next begins."""
    _, role, action, empty = step
    if action == "merge":
        return "\n" + text
    before = CLOSE if state else ""
    if empty:
        before += render_open(empty) + CLOSE
    return before + render_open(role) + text


def render_end(state: int) -> str:
    return (CLOSE if state else "") + "".join(render_open(r) + CLOSE for r in _END[state][1])


def repaired(conversations: DataFrame) -> DataFrame:
    """One row for each turn: conv_id, turn, role, new_role, action, inserted, cost and rendered; other columns are left out.

    rendered holds what the turn adds to its conversation, the last turn's with the
    end; `rendered_conversations` joins them.  inserted is the role of an empty
    message put before the turn, or null.  cost is that of the turn's step, the last
    turn's with the end's.
    """
    spark = conversations.sparkSession
    kind = conversations.schema["conv_id"].dataType
    rows = conversations.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    keys = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "tie")]
    # Written down once: what is worked out about a partition must hold when it is read again.
    parts = max(shuffle_partitions(spark), -(-text_bytes(conversations.select(F.col("text").cast("string"))) // PART_BYTES))
    rows = cut(spark, rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))

    def summed(batches):
        open_conv, held, first, part = None, [], True, None
        out = []
        for b in batches:
            for conv, role, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):  # noqa: B007
                if held and conv != open_conv:
                    if first:
                        out.append((part, 0, open_conv, matrix(held)))
                        first = False
                    held = []
                open_conv = conv
                held.append(role_of(role))
        if held:
            out.append((part, 0 if first else 1, open_conv, matrix(held)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in out], pa.int32()),
                pa.array([x[1] for x in out], pa.int32()),
                pa.array([x[2] for x in out], pa.string()),
                pa.array([[c for r in x[3] for c in r] for x in out], pa.list_(pa.float64())),
            ],
            ["part", "edge", "conv", "costs"],
        )

    edges = sorted(rows.select("conv", "role", "part").mapInArrow(summed, "part int, edge int, conv string, costs array<double>").collect(), key=lambda r: (r["part"], r["edge"]))
    known = spark.sparkContext.broadcast(_joined([(r["part"], r["edge"], r["conv"], [r["costs"][i : i + 4] for i in range(0, 16, 4)]) for r in edges]))

    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()]
    names = ["conv_id", "turn", "role", "new_role", "action", "inserted", "cost", "rendered"]

    def solved(run: list[tuple], edge: int | None) -> list[tuple]:
        """A run's repaired rows. edge: which of its partition's edge runs it is, if it is one."""
        state, end, last = known.value.get((run[0][4], edge), (START, None, True)) if edge is not None else (START, None, True)
        roles = [role_of(r[2]) for r in run]
        if end is None:
            end = _cheapest_end(solve(roles, state)[0])
        out = []
        for i, (row, step) in enumerate(zip(run, path(roles, state, end), strict=True)):
            piece, cost = render(step, state, row[3] or ""), step[0]
            state = step[1]
            if i == len(run) - 1 and last:
                piece, cost = piece + render_end(state), cost + _END[state][0]
            out.append((row[0], row[1], row[2], NAMES[state], step[2], NAMES[step[3]] or None, cost, piece))
        return out

    def arrow(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def write(batches):
        held: list[tuple] = []  # the run that hasn't ended
        out: list[tuple] = []
        first = True
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if held and row[0] != held[0][0]:
                    out += solved(held, 0 if first else None)
                    held, first = [], False
                    if len(out) >= WRITTEN:
                        yield arrow(out)
                        out = []
                held.append(row)
        if held:
            out += solved(held, 0 if first else 1)
        if out:
            yield arrow(out)

    schema = "conv_id string, turn long, role string, new_role string, action string, inserted string, cost double, rendered string"
    done = rows.select("conv", "turn", "role", "text", "part").mapInArrow(write, schema)
    return done.withColumn("conv_id", F.col("conv_id").cast(kind) if not isinstance(kind, T.StringType) else F.col("conv_id"))


def _cheapest_end(costs: list[float]) -> int:
    return min(range(4), key=lambda s: (costs[s] + _END[s][0], -s))


def _joined(edges: list[tuple]) -> dict[tuple[int, int], tuple[int, int, bool]]:
    """For each edge run: the state before it, the state after it, and whether its conversation ends there."""
    out: dict[tuple[int, int], tuple[int, int, bool]] = {}
    i = 0
    while i < len(edges):
        j = i + 1
        while j < len(edges) and edges[j][2] == edges[i][2] and edges[j][0] != edges[j - 1][0]:
            j += 1
        chain = edges[i:j]
        costs, back = [0.0, FAR, FAR, FAR], []
        for e in chain:
            best = [min(((costs[s] + e[3][s][t], s) for s in range(4))) for t in range(4)]
            costs, back = [b[0] for b in best], [*back, [b[1] for b in best]]
        state = _cheapest_end(costs)
        for k in range(len(chain) - 1, -1, -1):
            before = back[k][state]
            out[chain[k][0], chain[k][1]] = (before, state, k == len(chain) - 1)
            state = before
        i = j
    return out


def digests(conversations: DataFrame) -> DataFrame:
    """`repaired` with a digest of what each turn adds, in place of the text."""
    return repaired(conversations).withColumn("rendered_sha256", F.sha2(F.col("rendered").cast("binary"), 256)).withColumn("n_chars", F.length("rendered").cast("long")).drop("rendered")


def repair(turns: list[tuple[str | None, str | None]]) -> tuple[float, str]:
    """One conversation's least cost and rendered text, on the driver: the same steps without a cluster."""
    roles = [role_of(r) for r, _ in turns]
    costs, _ = solve(roles, START)
    end = _cheapest_end(costs)
    out, state = "", START
    for (_, text), step in zip(turns, path(roles, START, end), strict=True):
        out += render(step, state, text or "")
        state = step[1]
    return costs[end] + _END[end][0], out + render_end(state)
