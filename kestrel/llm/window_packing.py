"""Packing of token sequences into windows by non-negative least squares.

Documents are cut into full windows and a rest shorter than a window. The lengths of all
rests form a histogram of bounded size. Shallow combinations of lengths (two or three)
that fill a window exactly are enumerated, non-negative least squares finds how often to
repeat each so that the combinations use up the histogram, the repeat counts are rounded
within what is there, and the residual lengths are packed greedily, cutting a rest where
nothing fits. What is left at the very end is shorter than a window and goes into windows
of powers of two, which need no padding.

The plan speaks of numbers, not of documents: "the rests number lo to hi of this length
go to the windows from s on". Its size depends on the window alone. Documents learn their
numbers from counts by task and length, so nothing is sorted and no length is a hot key.
"""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import hold, slices, written

WINDOW = 2048
#: The id that ends each document.
END_ID = 1
#: One triple of lengths in this many is offered to the solver; each length is in about equally many.
TRIPLES = 16
ROUNDS = 400
#: Ids of words that a worker keeps; past it the memory starts anew.
CACHE_IDS = 4_000_000


# ---------------------------------------------------------------------------
# ids
# ---------------------------------------------------------------------------

def _parted(texts: pa.Array) -> pa.Array:
    """The texts with fewer different words and the same ids: the tokenizer lowers letters itself
    (but for special strings, so texts with such are left), and always cuts between a letter and
    one of these marks."""
    if not pc.any(pc.match_substring(texts, "<|")).as_py():
        texts = pc.ascii_lower(texts)
    return pc.replace_substring_regex(texts, "([a-zA-ZÀ-ÖØ-öø-ÿ])([.,;:!?])", "\\1 \\2")


class WordIds:
    """Ids of texts, by the library, word by word: the tokenizer drops white space and no token
    spans it, so a text's ids are those of its words in a row."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec)
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.first, self.count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(4096, np.uint32), 0

    def _room(self, words: int, ids: int) -> None:
        while len(self.first) < words:
            self.first, self.count = (np.concatenate([x, np.zeros(len(x), x.dtype)]) for x in (self.first, self.count))
        while len(self.ids) < ids:
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), self.ids.dtype)])

    def slots(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.slot]
        if new and self.used > CACHE_IDS:
            self.forget()
            new = words
        for i in range(0, len(new), 4096):
            some = new[i:i + 4096]
            got = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            sizes = np.bincount(np.array(got.word_ids, np.int64), minlength=len(some))
            at = len(self.slot)
            self._room(at + len(some), self.used + int(sizes.sum()))
            self.count[at:at + len(some)] = sizes
            self.first[at:at + len(some)] = self.used + np.cumsum(sizes) - sizes
            self.ids[self.used:self.used + int(sizes.sum())] = got.ids
            self.used += int(sizes.sum())
            self.slot.update(zip(some, range(at, at + len(some))))
        return np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null: empty), each text followed by its end, and their lengths."""
        lists = pc.ascii_split_whitespace(_parted(pc.fill_null(texts, "")))
        words = lists.flatten().dictionary_encode()
        slots = self.slots(words.dictionary.to_pylist())
        at = words.indices.to_numpy(zero_copy_only=False)
        sizes = self.count[slots].astype(np.int32)[at]
        upto = np.cumsum(sizes, dtype=np.int32)                     # a slice has fewer than 2**31 ids
        shift = self.first[slots].astype(np.int32)[at] - (upto - sizes)
        flat = self.ids[np.repeat(shift, sizes) + np.arange(int(sizes.sum(dtype=np.int64)), dtype=np.int32)]
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        upto = np.concatenate([[0], upto]).astype(np.int64)[ends]
        return np.insert(flat, upto, END_ID), np.diff(upto, prepend=0) + 1


@functools.lru_cache(maxsize=2)
def word_ids(spec: str) -> WordIds:
    return WordIds(spec)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


# ---------------------------------------------------------------------------
# the plan
# ---------------------------------------------------------------------------

def combinations(counts: np.ndarray, window: int) -> np.ndarray:
    """Pairs and triples of the lengths that occur which fill a window: rows of three lengths in
    descending order, 0 for none."""
    there = np.flatnonzero(counts)
    there = there[there > 0]
    pairs = there[(2 * there >= window) & (window - there > 0)]
    pairs = pairs[counts[window - pairs] > 0]
    out = [np.stack([pairs, window - pairs, np.zeros_like(pairs)], axis=1)]
    for a in there[3 * there >= window].tolist():
        b = there[(there <= a) & (2 * there >= window - a) & (there < window - a) & ((a + 3 * there) % TRIPLES == 0)]
        c = window - a - b
        ok = counts[c] > 0
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(out).astype(np.int64)


def repeats(counts: np.ndarray, combos: np.ndarray) -> np.ndarray:
    """Non-negative least squares: how often to use each combination, so that what they use is
    nearest to the histogram. Projected gradient steps with momentum."""
    if not len(combos):
        return np.zeros(0)
    flat, n = combos.ravel(), len(counts)
    real = (combos > 0).astype(float)
    want = counts.astype(float)
    use = lambda x: np.bincount(flat, weights=np.repeat(x, 3) * real.ravel(), minlength=n)
    back = lambda r: (r[combos] * real).sum(axis=1)
    v = np.ones(len(combos))
    for _ in range(20):                         # the largest eigenvalue bounds the step
        v = back(use(v))
        size = np.linalg.norm(v)
        v /= size
    step, x, y, t = 1.0 / (1.05 * size), np.zeros(len(combos)), np.zeros(len(combos)), 1.0
    for _ in range(ROUNDS):
        new = np.maximum(0.0, y - step * back(use(y) - want))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


class Plan:
    """Which rests go where. ``rows``: length of the rest, first and last number, ids already used,
    length of the piece, first window, windows, offset there, number of the first among its like."""

    def __init__(self, counts: np.ndarray, window: int = WINDOW):
        self.window, self.windows, self.combined = window, 0, 0
        self.rows: list[tuple[int, ...]] = []
        self.count = counts.astype(np.int64).copy()
        self.count[0] = 0
        self.pool: dict[int, list[tuple[int, int, int, int]]] = {
            int(l): [(int(l), 0, int(self.count[l]), 0)] for l in np.flatnonzero(self.count)}
        combos = combinations(self.count, window)
        solved = repeats(self.count, combos)
        for k in np.argsort(-solved, kind="stable"):
            lengths = [int(l) for l in combos[k] if l]
            m = min([int(solved[k] + 0.5), *(int(self.count[l]) // lengths.count(l) for l in lengths)])
            if solved[k] < 0.5:
                break
            if m:
                self._apply([(l, l, 1) for l in lengths], m)
        self.combined = self.windows
        left = int((self.count * np.arange(len(self.count))).sum())
        while left >= window:
            left -= window * self._apply(*self._pattern(window))
        while left:
            target = 1 << (left.bit_length() - 1)
            self._apply(*self._pattern(target))
            left -= target

    def _pattern(self, target: int) -> tuple[list[tuple[int, int, int]], int]:
        """Pieces (length of the rest, of the piece, how many) that fill one window, largest first,
        and how often there is enough for them."""
        used: dict[int, int] = {}
        pieces: list[list[int]] = []
        free = self.count.copy()                # what is left beyond one window of the pattern
        room, m = target, 0

        def take(l: int, cut: int, c: int = 1) -> None:
            nonlocal room, m
            used[l] = used.get(l, 0) + c
            free[l] -= c
            m = min(m or 1 << 62, int(self.count[l]) // used[l])
            if pieces and pieces[-1][:2] == [l, cut]:
                pieces[-1][2] += c
            else:
                pieces.append([l, cut, c])
            room -= cut * c

        while room:
            fits = np.flatnonzero(free[:room + 1])
            if free[room] if room < len(free) else False:
                take(room, room)
            elif len(fits):
                other = fits[(free[room - fits] > 0) & ((2 * fits != room) | (free[fits] > 1))]
                if len(other) and m:
                    best = int(other[-1])
                    take(best, best)
                else:
                    l = int(fits[-1])
                    c = min(room // l, int(free[l]), max(1, int(self.count[l]) // m - used.get(l, 0)) if m else 1)
                    take(l, l, c)
            else:
                take(int(np.flatnonzero(free)[-1]), room)
        return [tuple(p) for p in pieces], m

    def _apply(self, pieces: list[tuple[int, int, int]], m: int) -> int:
        at, rest = 0, []
        for l, cut, c in pieces:
            j, need = 0, c * m
            self.count[l] -= need
            while need:
                origin, lo, hi, done = self.pool[l].pop()
                if hi - lo > need:
                    self.pool[l].append((origin, lo + need, hi, done))
                    hi = lo + need
                self.rows.append((origin, lo, hi, done, cut, self.windows, m, at, j))
                if cut < l:
                    rest.append((l - cut, (origin, lo, hi, done + cut)))
                j, need = j + hi - lo, need - (hi - lo)
            at += cut * c
        for l, some in rest:
            self.pool.setdefault(l, []).append(some)
            self.count[l] += some[2] - some[1]
        self.windows += m
        return m

    def table(self) -> np.ndarray:
        return np.array(sorted(self.rows), np.int64).reshape(-1, 9)


def pieces_of(table: np.ndarray, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
    """For rests of these lengths and numbers: the row of the rest, ids used before, length of the
    piece, window and offset of every piece."""
    key = length * (1 << 48) + number
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    base = table[:, 0] * (1 << 48)
    lo, hi = np.searchsorted(ranked, base + table[:, 1]), np.searchsorted(ranked, base + table[:, 2])
    n = hi - lo
    row = np.repeat(np.arange(len(table)), n)
    at = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    _, first, _, done, size, window, m, offset, j = table[row].T
    k = j + number[at] - first
    return at, done, size, window + k % m, offset + k // m * size


# ---------------------------------------------------------------------------
# the job
# ---------------------------------------------------------------------------

def rests(docs: DataFrame, spec: str, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, task, local, rest, doc_tokens, first, crcs, ids``: each document's number of ids,
    the crcs of its full windows (numbered from ``first`` in their task), and the ids of its rest,
    which is the ``local``-th of its length in this task."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches):
        own = word_ids(shared.value)
        hold("words", own.forget)
        task, seen, full = TaskContext.get().partitionId(), np.zeros(window, np.int64), 0
        for b in slices(batches):
            ids, sizes = own.encode(b.column(1))
            ends, rest, fulls = np.cumsum(sizes), sizes % window, sizes // window
            order = np.argsort(rest, kind="stable")
            kinds, starts, n = np.unique(rest[order], return_index=True, return_counts=True)
            local = np.empty(len(rest), np.int64)
            local[order] = np.arange(len(rest)) - np.repeat(starts, n) + seen[rest[order]]
            seen[kinds] += n
            first = full + np.cumsum(fulls) - fulls
            full += int(fulls.sum())
            begin = ends - sizes
            crcs = [[crc(ids[s + k * window:s + (k + 1) * window]) for k in range(f)] for s, f in zip(begin.tolist(), fulls.tolist())]
            tails = [ids[e - r:e].astype("<u4").tobytes() for e, r in zip(ends.tolist(), rest.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(len(rest), task)), pa.array(local), pa.array(rest), pa.array(sizes), pa.array(first),
                 pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary())],
                ["doc_id", "task", "local", "rest", "doc_tokens", "first", "crcs", "ids"])

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, task long, local long, rest long, doc_tokens long, first long, crcs array<long>, ids binary")


def pack(docs: DataFrame, spec: str, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece.

    Windows hold ``window`` ids (a power of two) but for the last ones, which hold smaller powers
    of two, so there is no padding. Null and empty texts are one id, the end; repeated rows and
    rows with a null id are documents of their own; a text of any length is cut; an empty table
    gives an empty result; other columns are not read. ``spec`` is the tokenizer's json file, a
    bounded vocabulary. The driver sees the histogram of rests (``window`` counts) and the plan,
    whose size depends on the window alone."""
    spark = docs.sparkSession
    found = written(rests(docs, spec, window, doc_id, text), "rests")
    # one row for each task and length: documents with equal lengths are counted, not moved
    by_task = written(found.groupBy("rest", "task").agg(F.count(F.lit(1)).alias("n")), "counts")
    counts = np.zeros(window, np.int64)
    for r in by_task.groupBy("rest").agg(F.sum("n").alias("n")).collect():      # at most ``window`` rows
        counts[r["rest"]] = r["n"]
    plan = Plan(counts, window)
    shared, windows = spark.sparkContext.broadcast(plan.table()), plan.windows
    before = F.sum("n").over(Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = by_task.select("rest", "task", F.coalesce(before, F.lit(0)).alias("base"))
    numbered = found.filter("rest > 0").join(bases, ["rest", "task"]).select(
        "doc_id", "rest", (F.col("base") + F.col("local")).alias("number"), "doc_tokens", "ids")

    def run(batches):
        table = shared.value
        for b in slices(batches, 4):
            rest, number, total = (b.column(k).to_numpy() for k in (1, 2, 3))
            at, done, size, sequence, offset = pieces_of(table, rest, number)
            ids = b.column(4).to_pylist()
            sums = [zlib.crc32(ids[i][4 * d:4 * (d + s)]) for i, d, s in zip(at.tolist(), done.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array(total[at] - rest[at] + done), pa.array(size), pa.array(sums, pa.int64()),
                 pa.array(total[at]), pa.array(sequence), pa.array(offset)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    # full windows are sequences of their own, numbered by task and order there
    full = found.filter(F.size("crcs") > 0).select("doc_id", "doc_tokens", "task", "first", F.posexplode("crcs").alias("k", "crc")).select(
        "doc_id", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens",
        (F.lit(windows) + F.shiftleft(F.col("task"), 32) + F.col("first") + F.col("k")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return numbered.mapInArrow(run, kind).unionByName(full)
