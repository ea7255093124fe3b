"""Chat formatting by minimum-cost role repair.

A conversation is legal if its roles follow an automaton: an optional system turn,
then user and assistant in turns, the assistant last. Dynamic programming over the
automaton's states chooses, for each turn, to keep it, to give it another role, to
merge it into the turn before, or to put an empty turn before it, at least total cost.

Conversations are cut into segments of bounded size, so that one conversation may hold
any share of all turns: the least costs from state to state of consecutive segments
combine like matrices, which fixes the states at the borders; then each segment is
repaired by itself.
"""

from __future__ import annotations

import ast
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import written

ROLES = ("", "system", "user", "assistant")      # state 0: before the first turn
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = ((SYSTEM, USER), (USER,), (ASSISTANT,), (USER,))
FINAL = (ASSISTANT,)
MERGE, RELABEL, INSERT = 2, 3, 4
#: Turns of a segment at most.
SEGMENT = 4096
NEVER = 1 << 200
#: Costs are counted in this unit; what is below it decides between equal costs.
UNIT = 1 << 64

OPEN, CLOSE, JOINT = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"


def _way(s: int, t: int, role: int) -> tuple[int, str, int] | None:
    """Cheapest way from state ``s`` to ``t`` over a turn of ``role`` (0: unknown): cost, what
    is done, role of an inserted turn."""
    change = 0 if role == t else RELABEL
    kind = "keep" if role == t else "relabel"
    ways = []
    if t in LEGAL[s]:
        ways.append((change, kind, 0))
    if s == t != START:
        ways.append((change + MERGE, "merge" if role == t else "relabel+merge", 0))
    ways += [(change + INSERT, "insert+" + kind, x) for x in LEGAL[s] if t in LEGAL[x]]
    return min(ways, key=lambda w: w[0]) if ways and t != START else None


#: By role, state and next state.
WAYS = [[[_way(s, t, r) for t in range(4)] for s in range(4)] for r in range(4)]
#: The least cost to end in each state, and the role of an inserted last turn.
END = [(0, 0) if s in FINAL else min(((INSERT, x) for x in LEGAL[s] if x in FINAL), default=(2 * INSERT, 0)) for s in range(4)]
_ODD = [0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1 for k in range(16)]


def role_of(role: str | None) -> int:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES else START


def step_costs(role: int, turn: int | None) -> list[list[int]]:
    """Costs from state to state over one turn. Equal costs are told apart by a hash of the
    turn's number, so the choice doesn't depend on how conversations are cut."""
    h = xxhash.xxh3_64_intdigest(str(turn).encode())
    return [[NEVER if (w := WAYS[role][s][t]) is None else w[0] * UNIT + ((h * _ODD[4 * s + t] & (1 << 64) - 1) >> 40)
             for t in range(4)] for s in range(4)]


def combined(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """Least costs over two stretches in a row."""
    return [[min(a[s][m] + b[m][t] for m in range(4)) for t in range(4)] for s in range(4)]


UNMOVED = [[0 if s == t else NEVER for t in range(4)] for s in range(4)]


def segment_costs(turns: Iterable[tuple[int, int | None]]) -> list[list[int]]:
    out = UNMOVED
    for role, turn in turns:
        out = combined(out, step_costs(role, turn))
    return out


def borders(segments: list[list[list[int]]]) -> tuple[list[tuple[int, int]], int]:
    """Entry and exit state of each segment of one conversation, and the total cost."""
    ahead = [[0, NEVER, NEVER, NEVER]]
    for m in segments:
        ahead.append([min(ahead[-1][s] + m[s][t] for s in range(4)) for t in range(4)])
    last = min(range(4), key=lambda t: ahead[-1][t] + END[t][0] * UNIT)
    total, out = (ahead[-1][last] + END[last][0] * UNIT) // UNIT, []
    for m, f in zip(reversed(segments), reversed(ahead[:-1])):
        first = min(range(4), key=lambda s: f[s] + m[s][last])
        out.append((first, last))
        last = first
    return out[::-1], total


def repair(turns: list[tuple[int, int | None, str]], first: int = START, last: int | None = None, ends: bool = True
           ) -> list[tuple[int, str, int, str]]:
    """Repairs one segment from entry to exit state: (number of the turn, what is done,
    role, rendered piece) in order. A conversation is rendered as its pieces in a row.

    ``turns``: role, turn number, text. Without ``last``, the cheapest end is taken."""
    cost, back = [NEVER] * 4, []
    cost[first] = 0
    for role, turn, _ in turns:
        c = step_costs(role, turn)
        back.append([min(range(4), key=lambda s: cost[s] + c[s][t]) for t in range(4)])
        cost = [cost[back[-1][t]] + c[back[-1][t]][t] for t in range(4)]
    if last is None:
        last = min(range(4), key=lambda t: cost[t] + END[t][0] * UNIT)
    states = [last]
    for b in reversed(back):
        states.append(b[states[-1]])
    states.reverse()
    out = []
    for k, (role, _, text) in enumerate(turns):
        s, t = states[k], states[k + 1]
        _, kind, extra = WAYS[role][s][t]
        if kind.startswith("insert+"):
            out.append((k, "insert", extra, (CLOSE if s else "") + OPEN.format(ROLES[extra])))
            s, kind = extra, kind[len("insert+"):]
        out.append((k, kind, t, JOINT + text if "merge" in kind else (CLOSE if s else "") + OPEN.format(ROLES[t]) + text))
    if ends and turns:
        tail = CLOSE
        if (extra := END[last][1]):
            out.append((len(turns), "insert", extra, CLOSE + OPEN.format(ROLES[extra]) + CLOSE))
        else:
            k, kind, t, piece = out[-1]
            out[-1] = (k, kind, t, piece + tail)
    return out


def _segmented(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str, segment: int) -> DataFrame:
    """``conv_id, turn, role, text, chunk, place``: turns in order, cut into chunks of at
    most ``segment`` rows whatever the conversations' sizes. Null turns come last; ties are
    in the order of role, text and the input."""
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                                F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                                F.monotonically_increasing_id().alias("source"))
    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", F.xxhash64("text"), "source"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    # within a partition, places are consecutive numbers
    return written(ranged.withColumn("chunk", F.floor(F.col("place") / segment)).drop("source"), "turns")


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of rows that agree in their first two columns."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if held and row[:2] != held[0][:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def pieces(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           segment: int = SEGMENT) -> DataFrame:
    """``conv_id, turn, chunk, place, sub, action, role, piece``: the repaired conversations,
    one row for each kept, relabelled or merged turn and for each inserted one.

    Pieces in the order of ``chunk, place, sub`` are the rendered conversation (ChatML);
    ``action`` is keep, relabel, merge, relabel+merge or insert. Roles are compared without
    case and outer spaces; null and unknown roles are relabelled. Null texts are empty
    turns. Null conversation ids are one conversation. Null turns come last; ties are in
    the order of role and text; repeated rows are turns of their own (and so merged). An
    empty table gives an empty result; other columns are not read."""
    rows = _segmented(conversations, conv_id, turn, role, text, segment)
    known = F.when(F.lower(F.trim("role")).isin(list(ROLES[1:])), F.lower(F.trim("role")))
    light = rows.select("chunk", "conv_id", "place", known.alias("role"), "turn")

    def measure(batches):
        out = [(r[0][0], r[0][1], str(segment_costs((role_of(x[3]), x[4]) for x in r))) for r in _runs(batches)]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(
            (pa.int64(), pa.int64(), pa.string()))], ["chunk", "conv_id", "costs"])

    costs = light.repartition("chunk").sortWithinPartitions("chunk", "conv_id", "place").mapInArrow(
        measure, "chunk long, conv_id long, costs string")

    def fix(batches):
        # runs agree in the conversation; the first column repeats it
        for r in _runs(batches):
            states, _ = borders([ast.literal_eval(x[3]) for x in r])
            yield pa.RecordBatch.from_arrays([
                pa.array([x[2] for x in r], pa.int64()), pa.array([x[1] for x in r], pa.int64()),
                pa.array([s[0] for s in states], pa.int32()), pa.array([s[1] for s in states], pa.int32()),
                pa.array([k == len(r) - 1 for k in range(len(r))], pa.bool_())], ["chunk", "conv_id", "first", "last", "ends"])

    # one row for each segment: a conversation's rows here are fewer by the size of a segment
    fixed = (costs.select(F.col("conv_id").alias("c"), "conv_id", "chunk", "costs").repartition("c")
             .sortWithinPartitions("c", "chunk").mapInArrow(fix, "chunk long, conv_id long, first int, last int, ends boolean"))
    none = F.lit(None)
    heads = fixed.select("chunk", "conv_id", none.cast("long").alias("place"), none.cast("string").alias("role"),
                         none.cast("long").alias("turn"), none.cast("string").alias("text"), "first", "last", "ends")
    body = rows.select("chunk", "conv_id", "place", known.alias("role"), "turn", "text", none.cast("int").alias("first"),
                       none.cast("int").alias("last"), none.cast("boolean").alias("ends"))

    def mend(batches):
        for r in _runs(batches):
            head, turns = r[0], r[1:]
            got = repair([(role_of(x[3]), x[4], x[5]) for x in turns], head[6], head[7], head[8])
            last = len(turns) - 1
            cols = [(head[1], turns[min(k, last)][4], head[0], turns[min(k, last)][2],
                     2 if k > last else 0 if a == "insert" else 1, a, ROLES[t], p) for k, a, t, p in got]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for c in cols], t) for k, t in enumerate(kinds)],
                                             ["conv_id", "turn", "chunk", "place", "sub", "action", "role", "piece"])

    return heads.unionByName(body).repartition("chunk").sortWithinPartitions(
        "chunk", "conv_id", F.col("place").asc_nulls_first()).mapInArrow(
        mend, "conv_id long, turn long, chunk long, place long, sub int, action string, role string, piece string")


def rendered(repaired: DataFrame) -> DataFrame:
    """``conv_id, text`` of whole conversations. For conversations that fit a row; longer ones
    stay as their ordered pieces."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "place", "sub", "piece"))), lambda x: x["piece"])
    return repaired.groupBy("conv_id").agg(F.array_join(parts, "").alias("text"))


def summary(repaired: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_out, n_merged, n_relabelled, n_inserted, cost, n_bytes, digest``
    for each conversation; ``digest`` sums hashes of the pieces with their turns."""
    count = lambda c: F.sum(c.cast("long"))
    action = F.col("action")
    merged, relabelled, inserted = action.endswith("merge"), action.startswith("relabel"), action == "insert"
    return repaired.groupBy("conv_id").agg(
        count(~inserted).alias("n_turns"), count(~merged).alias("n_out"), count(merged).alias("n_merged"),
        count(relabelled).alias("n_relabelled"), count(inserted).alias("n_inserted"),
        F.sum(F.when(merged, MERGE).otherwise(0) + F.when(relabelled, RELABEL).otherwise(0) + F.when(inserted, INSERT).otherwise(0))
        .cast("long").alias("cost"),
        F.sum(F.octet_length("piece")).cast("long").alias("n_bytes"),
        F.sum(F.xxhash64("turn", "sub", "piece").bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))).alias("digest"))
