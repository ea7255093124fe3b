"""Repair of damaged conversations by a square-root checkpointed dynamic program.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``. Each turn is
kept (0), given the next legal role (3) or deleted (4, always for blank and duplicate
turns); empty turns may be inserted anywhere (3); a truncated turn that stays adds 3.
Of the cheapest edits, the sequence whose initials (D, I, K, R) are least in ASCII order
is taken.

The costs to finish are computed backwards from the end, as one vector with a cost for
each state. Only the vectors at checkpoints are stored; walking forward, each block's
vectors are computed again from the checkpoint behind it, and the least tight edit is
emitted. This happens on two levels. A conversation may hold any share of all turns, so
its turns are cut into segments: a segment's costs from state to state form a small
matrix, matrices in reverse order give the vectors at the segments' borders, and each
segment is then walked by its own task, with checkpoints every ``sqrt(n)`` turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import slices, written

#: Costs of the contract.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEVER = 1 << 60

#: States: nothing yet, after a system, a user and an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or relabelled turn, and that turn's role.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = (None, None, "user", "assistant")
#: The cost to end in each state.
END = (0, 2 * INSERT, INSERT, 0)

#: Faults of a turn; the first that holds counts.
SOUND, BLANK, DUPLICATE, CUT = range(4)
#: Turns of a segment at most (a power of two), and bytes of repaired text in one row.
SEGMENT, BODY_BYTES = 4096, 1 << 20

WHITE = " \t\n\x0b\x0c\r"


def code(initial: str, fault: int) -> int:
    """A turn as the program sees it: its role's initial and its fault."""
    return ("sua".find(initial) + 1 if initial else 0) + 4 * fault


def _kept(state: int, turn: int) -> int | None:
    """State after keeping a turn, if that is legal."""
    role = turn & 3
    if role == 1:
        return SYSTEM if state == START else None
    return role if role and NEXT[state] == role else None


def _step(turn: int, state: int, ahead: list[int]) -> int:
    """Least cost to finish from before a turn, without insertions before it."""
    cost = DELETE + ahead[state]
    fault = turn >> 2
    if fault not in (BLANK, DUPLICATE):
        extra = TRUNCATED if fault == CUT else 0
        if (k := _kept(state, turn)) is not None:
            cost = min(cost, extra + ahead[k])
        cost = min(cost, extra + REROLE + ahead[NEXT[state]])
    return cost


def before(turn: int, ahead: list[int]) -> list[int]:
    """The vector of costs before a turn from that behind it."""
    out = [_step(turn, s, ahead) for s in range(4)]
    for _ in range(2):                       # two insertions lead to any state that insertions reach
        for s in range(4):
            out[s] = min(out[s], INSERT + out[NEXT[s]])
    return out


def transfer(turns: Iterable[int]) -> list[list[int]]:
    """Costs of a segment from each entry state to each exit state: ``out[exit][entry]``."""
    turns = list(turns)
    out = []
    for t in range(4):
        v = [0 if s == t else NEVER for s in range(4)]
        for turn in reversed(turns):
            v = before(turn, v)
        out.append(v)
    return out


def behind(matrix: list[list[int]], ahead: list[int]) -> list[int]:
    """The vector at a segment's entry from that at its exit."""
    return [min(matrix[t][s] + ahead[t] for t in range(4)) for s in range(4)]


def walk(turns: list[int], ahead: list[int], state: int, ends: bool) -> Iterator[tuple[str, int, int]]:
    """The least tight edits of a segment as ``(edit, number of the turn, state after it)``.

    ``ahead`` is the vector behind the segment; ``ends`` says that nothing follows it."""
    n = len(turns)
    size = isqrt(n) + 1
    stored = {}
    v = ahead
    for i in range(n - 1, -1, -1):           # backward: vectors at checkpoints only
        if (i + 1) % size == 0 or i == n - 1:
            stored[i // size] = v
        v = before(turns[i], v)
    for block in range((n + size - 1) // size):
        first, last = block * size, min(n, (block + 1) * size)
        vectors = [stored[block]]
        for i in range(last - 1, first - 1, -1):
            vectors.append(before(turns[i], vectors[-1]))
        vectors.reverse()                    # vectors[i - first]: before turn i; the last: behind the block
        for i in range(first, last):
            here, then, turn = vectors[i - first], vectors[i - first + 1], turns[i]
            fault = turn >> 2
            extra = TRUNCATED if fault == CUT else 0
            while DELETE + then[state] != here[state] and here[state] == INSERT + here[NEXT[state]]:
                state = NEXT[state]
                yield "I", i, state
            if DELETE + then[state] == here[state]:
                yield "D", i, state
                continue
            k = _kept(state, turn)
            if k is not None and extra + then[k] == here[state]:
                state = k
                yield "K", i, state
            else:
                state = NEXT[state]
                yield "R", i, state
    while ends and END[state]:
        state = NEXT[state]
        yield "I", n, state


def exits(turns: list[int], ahead: list[int]) -> list[int]:
    """Exit state of a segment for each entry state."""
    out = []
    for last in range(4):
        for _, _, last in walk(turns, ahead, last, False):
            pass
        out.append(last)
    return out


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` after the damage: by crc32 of ``conv_id:turn`` modulo 20, 0
    drops a turn, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's."""
    key = F.crc32(F.concat(_text(conv_id), F.lit(":"), _text(turn)).cast("binary")) % 20
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                                _text(role).alias("role"), _text(text).alias("text"), key.alias("damage")).filter("damage <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _placed(turns: DataFrame, segment: int) -> DataFrame:
    """The turns in order with ``place``, ``chunk`` and ``digest``. Places are consecutive within a
    partition, so that a chunk holds at most ``segment`` turns whatever the conversations' sizes."""
    rows = turns.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return written(ranged.withColumn("chunk", F.floor(F.col("place") / segment)), "turns")


def _faults(rows: DataFrame) -> DataFrame:
    """``chunk, conv_id, place, initial, fault`` of the turns, without their texts. The first of
    equal turns is found by a grouped minimum and put back by its place, so that a turn repeated
    any number of times is no hot key."""
    shown = F.rtrim(F.col("text"), F.lit(WHITE))
    light = rows.select("chunk", "conv_id", "place", F.substring("role", 1, 1).alias("initial"), (shown == "").alias("blank"),
                        F.substring(shown, -1, 1).isin(".", "!", "?").alias("closed"))
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(~F.col("closed"), CUT).otherwise(SOUND)
    return light.join(firsts, "place", "left").select("chunk", "conv_id", "place", "initial", fault.alias("fault"))


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


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kind)], schema=kind)


_SEGMENTS = pa.schema([("chunk", pa.int64()), ("conv_id", pa.int64()), ("matrix", pa.list_(pa.int64())), ("blank", pa.int64()), ("duplicate", pa.int64()),
                       ("truncated", pa.int64()), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string())])
_BORDERS = pa.schema([("chunk", pa.int64()), ("conv_id", pa.int64()), ("ahead", pa.list_(pa.int64())), ("nth", pa.int64()), ("ends", pa.bool_()),
                      ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
                      ("several", pa.bool_())])
_EXITS = pa.schema([("chunk", pa.int64()), ("conv_id", pa.int64()), ("exits", pa.list_(pa.int64()))])
_ENTRIES = pa.schema([("chunk", pa.int64()), ("conv_id", pa.int64()), ("entry", pa.int64())])
_EDITS = pa.schema([("chunk", pa.int64()), ("conv_id", pa.int64()), ("place", pa.int64()), ("edits", pa.string()), ("entry", pa.int64()), ("several", pa.bool_())])
_PARTS = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("part", pa.int64()), ("audit", pa.string()), ("body", pa.binary()), ("several", pa.bool_())])
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _ddl(kind: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in kind)


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _measure(batches):
    """A row for each segment: its matrix, its faults, and its first and last initial."""
    out = []
    for r in _runs(batches):
        turns = [code(x[3], x[4]) for x in r]
        faults = [x[4] for x in r]
        broken = sum(not _legal(a[3], b[3]) for a, b in zip(r, r[1:]))
        out.append((r[0][0], r[0][1], [c for row in transfer(turns) for c in row], faults.count(BLANK), faults.count(DUPLICATE),
                    faults.count(CUT), broken, r[0][3], r[-1][3]))
        if len(out) == 1024:
            yield _batch(out, _SEGMENTS)
            out = []
    yield _batch(out, _SEGMENTS)


def _square(flat: list[int]) -> list[list[int]]:
    return [flat[4 * t:4 * t + 4] for t in range(4)]


def _borders(batches):
    """From a conversation's segments, last one first: the vector behind each (the stored
    checkpoints) and the totals so far, which are the conversation's with its first segment."""
    out, held, ahead, total, follows = [], None, None, None, None
    for b in batches:
        for conv, chunk, matrix, *counts, head, tail in zip(*(c.to_pylist() for c in b.columns)):
            again = held is not None and held[1] == conv
            if held:
                out.append((*held, again or held[3] > 1))
            if not again:
                ahead, total, follows = list(END), [0, 0, 0, 0], None
            total = [x + y for x, y in zip(total, counts)]
            if follows is not None and not _legal(tail, follows):
                total[3] += 1
            nth, at_exit, ends = held[3] + 1 if again else 1, ahead, follows is None
            ahead, follows = behind(_square(matrix), ahead), head
            held = (chunk, conv, at_exit, nth, ends, *total, ahead[START])
        yield _batch(out, _BORDERS)
        out = []
    if held:
        yield _batch([(*held, held[3] > 1)], _BORDERS)


def _leave(batches):
    """For a segment of a long conversation, the exit state for each entry state."""
    for r in _runs(batches):
        if r[0][5] is None or len(r) == 1:
            continue                          # no header: a conversation of one segment
        yield _batch([(r[0][0], r[0][1], exits([code(x[3], x[4]) for x in r[1:]], r[0][5]))], _EXITS)


def _enter(batches):
    """Entry state of each segment of a long conversation, in order."""
    own, state = object(), START
    for b in batches:
        out = []
        for conv, chunk, to in zip(*(c.to_pylist() for c in b.columns)):
            if conv != own:
                own, state = conv, START
            out.append((chunk, conv, state))
            state = to[state]
        yield _batch(out, _ENTRIES)


def _edit(batches):
    """The edits at each turn of a segment, each letter followed by the state that it leads to."""
    for r in _runs(batches):
        head, turns = r[0], r[1:]
        entry, edits = head[6] or START, [""] * len(turns)
        for letter, i, state in walk([code(x[3], x[4]) for x in turns], head[5], entry, head[7]):
            edits[min(i, len(turns) - 1)] += f"{letter}{state}"
        yield _batch([(head[0], head[1], x[2], e, entry, head[8]) for x, e in zip(turns, edits)], _EDITS)


def _render(batches):
    """Audit and repaired text of each segment from its turns and their edits, in parts of bounded
    size; of a conversation of one segment, the text's digest. No segment's texts are held."""
    own, out = None, []
    for b in slices(batches, 7):
        for chunk, conv, _, edits, entry, several, role, text in zip(*(c.to_pylist() for c in b.columns)):
            if edits is not None:                        # a turn's edits come before its text
                if own is None or own[:2] != (chunk, conv):
                    if own is not None:
                        out.append(_part(own, last=True))
                    own = (chunk, conv, several, [0, 0], [], [], hashlib.sha256())
                    started = entry != START
                now = edits
                continue
            for letter, state in zip(now[::2], now[1::2]):
                own[4].append(letter)
                if letter == "D":
                    continue
                name, said = (role, text) if letter == "K" else (NAMES[int(state)], "" if letter == "I" else text)
                piece = f"{chr(10) if started else ''}{name}:{said}".encode()
                started = True
                if own[2]:
                    own[5].append(piece)
                    own[3][1] += len(piece)
                    if own[3][1] >= BODY_BYTES:
                        yield _batch([_part(own)], _PARTS)
                else:
                    own[6].update(piece)
        yield _batch(out, _PARTS)
        out = []
    if own is not None:
        yield _batch([_part(own, last=True)], _PARTS)


def _part(own: tuple, last: bool = False) -> tuple:
    chunk, conv, several, at, audit, body, sha = own
    row = (conv, chunk, at[0], "".join(audit), b"".join(body) if several else sha.hexdigest().encode(), several)
    at[:] = at[0] + 1, 0
    audit.clear()
    body.clear()
    return row


def _join_parts(batches):
    """Digest of conversations whose parts come in order; of each, only its audit is kept."""
    own, audit, sha = object(), [], None
    for b in batches:
        for conv, _, _, edits, body in zip(*(c.to_pylist() for c in b.columns)):
            if sha is None or conv != own:
                if sha is not None:
                    yield _batch([(own, "".join(audit), sha.hexdigest())], _DIGESTS)
                own, audit, sha = conv, [], hashlib.sha256()
            audit.append(edits)
            sha.update(body)
    if sha is not None:
        yield _batch([(own, "".join(audit), sha.hexdigest())], _DIGESTS)


def repaired(turns: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, borders, parts)`` of damaged conversations (``conv_id, turn, role, text``).

    ``rows``: the turns in order with their places. ``borders``: for each segment its checkpoint
    vector; a conversation's row with the largest ``nth`` has its totals. ``parts``: ``conv_id,
    chunk, part, audit, body, several``, the edits and the repaired text in order (in conversations
    of one segment, where ``several`` is false, the body is the text's SHA-256 instead)."""
    rows = _placed(turns, segment)
    light = written(_faults(rows), "faults")
    none = lambda kind: F.lit(None).cast(kind)
    ordered = lambda df, *more: df.repartition("chunk").sortWithinPartitions("chunk", "conv_id", F.col("place").asc_nulls_first(), *more)
    segments = ordered(light).mapInArrow(_measure, _ddl(_SEGMENTS))
    # rows from here on are fewer than turns by the size of a segment
    borders = written(segments.select("conv_id", "chunk", "matrix", "blank", "duplicate", "truncated", "illegal", "head", "tail")
                      .repartition("conv_id").sortWithinPartitions(F.col("conv_id"), F.col("chunk").desc()).mapInArrow(_borders, _ddl(_BORDERS)), "borders")
    heads = borders.select("chunk", "conv_id", none("long").alias("place"), none("string").alias("initial"), none("int").alias("fault"), "ahead")
    left = ordered(heads.filter("several").unionByName(light.withColumn("ahead", none("array<long>")))).mapInArrow(_leave, _ddl(_EXITS))
    entries = (left.select("conv_id", "chunk", "exits").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
               .mapInArrow(_enter, _ddl(_ENTRIES)))
    # a header for each segment, from its border and, in long conversations, its entry
    known = borders.select("chunk", "conv_id", "ahead", none("long").alias("entry"), "ends", "several").unionByName(
        entries.select("chunk", "conv_id", none("array<long>").alias("ahead"), "entry", none("boolean").alias("ends"), none("boolean").alias("several")))
    heads = known.groupBy("chunk", "conv_id").agg(*[F.max(c).alias(c) for c in ("ahead", "entry", "ends", "several")]).select(
        "chunk", "conv_id", none("long").alias("place"), none("string").alias("initial"), none("int").alias("fault"), "ahead", "entry", "ends", "several")
    body = light.select("*", none("array<long>").alias("ahead"), none("long").alias("entry"), none("boolean").alias("ends"), none("boolean").alias("several"))
    edits = ordered(heads.unionByName(body)).mapInArrow(_edit, _ddl(_EDITS))
    both = edits.select("*", none("string").alias("role"), none("string").alias("text")).unionByName(
        rows.select("chunk", "conv_id", "place", none("string").alias("edits"), none("long").alias("entry"), none("boolean").alias("several"), "role", "text"))
    parts = ordered(both, F.col("edits").asc_nulls_last()).mapInArrow(_render, _ddl(_PARTS))
    return rows, borders, parts


def summary(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            segment: int = SEGMENT) -> DataFrame:
    """Damages conversations, repairs them, and returns a row for each original ``conv_id``:
    ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Null roles and texts are one space, also in the key of the damage. Null turns come first and
    don't count for gaps; ties of turns are in the order of role and the text's SHA-256; repeated
    rows are duplicates. A null conversation id is one conversation. A conversation without rows
    after the damage has zeros, an empty audit and the digest of nothing. An empty table gives an
    empty result; other columns are not read. The audit has one letter for each edit, so a
    conversation's audit must fit a row; its texts need not: they are hashed as they pass."""
    rows, borders, parts = repaired(damaged(conversations, conv_id, turn, role, text), segment)
    parts = written(parts, "parts")
    single = parts.filter("not several").select("conv_id", "audit", F.col("body").cast("string").alias("repaired_sha256"))
    # SHA-256 runs over a text from its start: the parts of a long conversation pass one task, one by one
    long = (parts.filter("several").select("conv_id", "chunk", "part", "audit", "body").repartition("conv_id")
            .sortWithinPartitions("conv_id", "chunk", "part").mapInArrow(_join_parts, _ddl(_DIGESTS)))
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")
    totals = borders.groupBy("conv_id").agg(*[F.max_by(c, "nth").alias(c) for c in counts])
    spans = rows.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    # each side has at most a row for a conversation: grouping keeps null ids, which a join would not
    sides = (conversations.select(F.col(conv_id).cast("long").alias("conv_id")).distinct(), spans, totals, single, long)
    columns = {"gaps": "long", **{c: "long" for c in counts}, "audit": "string", "repaired_sha256": "string"}
    together = None
    for side in sides:
        full = side.select("conv_id", *[(F.col(c) if c in side.columns else F.lit(None)).cast(k).alias(c) for c, k in columns.items()])
        together = full if together is None else together.unionByName(full)
    grouped = together.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in columns])
    return grouped.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *counts)],
                          F.coalesce("audit", F.lit("")).alias("audit"),
                          F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
