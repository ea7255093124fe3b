"""Language-model scoring with a probabilistic suffix tree.

Tokens are words and one end for each text. The tree predicts a token from the words
before it. A context (one to three words) is retained if it occurs often enough in the
training texts and the distribution of its next tokens diverges from that of its suffix. It
lists the tokens that follow it several times; their chances are smoothed towards the
suffix's, and all other tokens share what is left as they do after the suffix. At the
root, tokens have the distribution of all words by absolute discounting, whose mass for one
unknown word covers words that no training text holds: the same event space as the base
score's.

The least counts are absolute, so the tree grows with the text. It is a table: counts of
(context, next) are grouped rows, each length is a few joins. Texts meet words and the
tree's rows by a join: the most frequent ones from broadcast tables of bounded size, all
others through a shuffle. Words and grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import CLEAN, buckets, discard, give_back, mixed, remainder, segment_sums, settings, slices, written

#: Longest context; the least count of a context, and of a token that a context lists.
DEPTH, LEAST_CONTEXT, LEAST_FOLLOWER = 3, 20, 5
#: Divergence: nats that a context's symbols must gain over its suffix, for each symbol it distinguishes.
LEAST_GAIN = 1.0
#: Rows of the tree that all tasks hold, at most; the others are joined through a shuffle.
FREQUENT_ROWS = 1 << 21
#: And one row of so many at most, so that a GB of text sends as much through the shuffle whether the tree is
#: small or large. Rounds in which texts are scored, at most; one more for each FREQUENT_ROWS of the other rows.
HELD_SHARE, ROUNDS = 2, 8
#: Bits of the largest bitmap (16 MB).
MARK_BITS = 27
#: Tells a context's own row from that of a gram of the same words.
CONTEXT = 0x5DEECE66D1234567
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Words of the broadcast table, at most; the other words are joined through a shuffle.
FREQUENT_WORDS = 1 << 19
#: Entries that a counting task combines at once, bytes of text of a slice, and bytes hashed at once.
HELD, SLICE, BLOCK_BYTES = 1 << 21, 1 << 20, 1 << 17
#: Bytes of text that are scored at once; buckets, and rows, of a batch that leaves a counting task.
SCORED, SENT_BUCKETS, SENT_ROWS = 1 << 18, 8, 1 << 16
MOD, HELD_OUT = 7, 2
#: Bits of a word's place among the frequent ones.
PLACE_BITS = FREQUENT_WORDS.bit_length()
#: The key of an end, and a random number for each byte: 0 for white space, A-Z as a-z.
END = np.uint64(1)
_BYTE = mixed(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + np.uint64(1))
_BYTE[[0x20, *range(0x09, 0x0E)]] = 0


def token_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of all texts, A-Z lower-cased, one end (``END``) after each text; and the
    number of each text's tokens. A word's key is a sum over its bytes of a random number of the byte
    times a power for its place, then mixed."""
    column = pc.fill_null(column, "").cast(pa.binary())
    _, edges, data = column.buffers()
    edges = np.frombuffer(edges, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data or b"", np.uint8)[edges[0]:edges[-1]]
    edges -= edges[0]
    word = _BYTE[data] != 0
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    first = edges[:-1][edges[:-1] < edges[1:]]
    begin[first] = word[first]                          # words end with their text
    starts = np.flatnonzero(begin)
    bounds = np.r_[starts, len(data)]
    key, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):                              # some bytes at a time, whole words
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + BLOCK_BYTES)) - 1)
        sizes = np.diff(bounds[at:to + 1])
        own, begins = _BYTE[data[bounds[at]:bounds[to]]], bounds[at:to] - bounds[at]
        own *= powers(int(sizes.max()))[np.arange(len(own)) - np.repeat(begins, sizes)]
        key[at:to] = mixed(np.add.reduceat(own, begins))
        at = to
    lengths = np.diff(np.searchsorted(starts, edges)) + 1
    out = np.full(len(starts) + len(lengths), END)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(lengths) - 1] = False
    out[inner] = key
    return out, lengths


@functools.lru_cache(maxsize=2)
def _powers(bits: int) -> np.ndarray:
    return np.cumprod(np.full(1 << bits, _STEP))


def powers(n: int) -> np.ndarray:
    return _powers(max(12, n.bit_length()))


def joined(parts: list) -> list[np.ndarray]:
    """The columns of all ``parts``, which is emptied, so that no more than one column is there twice."""
    columns = [list(x) for x in zip(*parts)]
    parts.clear()
    return [np.concatenate(columns.pop(0)) for _ in range(len(columns))]


def gathered(batches, make, most: int = HELD):
    """Lists of the arrays that ``make`` gives for each slice, joined while they hold ``most`` entries or less."""
    parts, held = [], 0
    for b in slices(batches, 0, 1 << 14, SLICE):
        parts.append(make(b))
        held += max(map(len, parts[-1]))
        if held > most:
            held = 0
            yield joined(parts)
    if held:
        yield joined(parts)


def as_batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names.split())


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, c, n``: occurrences of each token in training texts and in all texts.
    Tasks combine before the shuffle."""
    src = docs.select(F.col(text).cast("string").alias("text"),
                      F.coalesce(remainder(doc_id, MOD) != HELD_OUT, F.lit(True)).alias("learn"))

    def make(b):
        key, lengths = token_keys(b.column(0))
        return key, np.repeat(b.column(1).to_numpy(zero_copy_only=False).astype(np.uint8), lengths)

    def arrays(batches):
        for own in gathered(batches, make):
            own.append(np.ones(len(own[0]), np.uint8))
            yield own

    return summed(src, arrays, "c n")


def summed(src: DataFrame, arrays, sums: str) -> DataFrame:
    """``key`` and sums, of the arrays that ``arrays`` gives in each task, added up by key. Tasks combine, and ship
    a bucket's rows as bytes; buckets are ranges of the key, so no key is in a heavy one. Lists of arrays are
    emptied while they are added up, and leave in batches of bounded size."""
    names, deal = ["key", *sums.split()], buckets(src.sparkSession)

    def added(columns):
        key = columns.pop(0)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        out = [key[first]]
        while columns:
            out.append(np.add.reduceat(columns.pop(0)[order], first, dtype=np.int64))
        return out

    def spread(batches):
        for columns in arrays(batches):
            if not len(columns[0]):
                continue
            key, *columns = added(columns)
            columns = [key, *(x.astype(np.uint32) for x in columns)]
            cuts = [*np.searchsorted(key, np.arange(1 << deal, dtype=np.uint64) << np.uint64(64 - deal)).tolist(), len(key)]
            every = [(i, x, y) for i, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
            for some in (every[i:i + SENT_BUCKETS] for i in range(0, len(every), SENT_BUCKETS)):
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in some], pa.int32()),
                                                  *(pa.array([c[x:y].tobytes() for _, x, y in some], pa.binary()) for c in columns)], ["bucket", *names])

    def rows(parts):
        out = as_batch(" ".join(names), *added(joined(parts)))
        for i in range(0, out.num_rows, SENT_ROWS):
            yield out.slice(i, SENT_ROWS)

    def merge(batches):
        own, parts, size = None, [], 0
        for b in batches:
            for i in range(b.num_rows):
                bucket, *blobs = (x[i].as_py() for x in b.columns)
                if own is not None and bucket != own:
                    yield from rows(parts)
                    parts, size = [], 0
                own = bucket
                parts.append([np.frombuffer(blobs[0], np.uint64)] + [np.frombuffer(x, np.uint32).astype(np.int64) for x in blobs[1:]])
                size += len(parts[-1][0])
                if size > HELD:                        # the same keys of many tasks are one entry
                    parts, size = [added(joined(parts))], 0
        if own is not None:
            yield from rows(parts)

    return (src.mapInArrow(spread, "bucket int, " + ", ".join(f"{x} binary" for x in names)).repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(merge, ", ".join(f"{x} long" for x in names)))


def longer(d: int, before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Keys of grams of ``d + 1`` words from those of their first ``d`` words and their last ``d`` words."""
    with np.errstate(over="ignore"):
        return mixed(last * _STEP + before + np.uint64(d))


def grams(key: np.ndarray, depth: int) -> list[np.ndarray]:
    """For d = 0 .. ``depth``: a key of the d + 1 words that end at each place. Meaningless where d words
    don't precede."""
    out = [key]
    for d in range(1, depth + 1):
        out.append(longer(d, np.r_[np.uint64(0), out[-1][:-1]][:len(key)], out[-1]))
    return out


@dataclass
class Marks:
    """A bitmap of keys by their lowest bits and by their upper half's. Its size is bounded; where more
    keys than bits meet it marks too much, which costs rows that a join drops later, not results."""
    words: np.ndarray

    def _bits(self, key: np.ndarray) -> np.ndarray:
        place = key & np.uint64(64 * len(self.words) - 1)
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)

    def hold(self, key: np.ndarray) -> np.ndarray:
        out = self._bits(key)
        some = np.flatnonzero(out)
        out[some] = self._bits(key[some] >> np.uint64(32))
        return out


def marks(keys: DataFrame, most_bits: int = MARK_BITS) -> Marks:
    """Marks of the only column, some 64 bits for each key up to ``2 ** most_bits``: the driver
    gets 64 bits at once, never the keys."""
    bits = min(max(10, (64 * keys.count()).bit_length()), most_bits)
    (name,) = keys.columns
    place = F.col("key").bitwiseAND((1 << bits) - 1)
    got = (keys.select(F.explode(F.array(name, F.shiftrightunsigned(name, 32))).alias("key"))
           .select(F.shiftright(place, 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(key & 63 AS int))").alias("bit"))
           .groupBy("at").agg(F.bit_or("bit").alias("word")).toArrow())
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[got.column("at").to_numpy()] = got.column("word").to_numpy().view(np.uint64)
    return Marks(words)


def training(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.filter(F.coalesce(remainder(doc_id, MOD) != HELD_OUT, F.lit(True))).select(F.col(text).cast("string").alias("text"))


def candidates(d: int, contexts: Marks, ends: Marks):
    """Makes of a slice the keys of its tokens, and the places of those that follow ``d`` words: only where
    ``contexts`` marks the words before, and ``ends`` marks the gram without its first word. Also the keys
    of both."""
    def make(b):
        key, lengths = token_keys(b.column(0))
        last = grams(key, d - 1)[-1]
        at = np.flatnonzero(ends.hold(last))
        at = at[places(lengths)[at] >= d]
        at = at[contexts.hold(last[at - 1])]
        return key, at, last[at - 1], last[at]
    return make


def packed(key: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted numbers as their steps, and counts, byte by byte of all: the upper bytes compress away."""
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes() for x in (np.diff(key, prepend=np.uint64(0)), n.astype(np.uint32))]
    return pa.compress(b"".join(planes), "zstd", asbytes=True)


def unpacked(blob: bytes, size: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob, 12 * size, "zstd", asbytes=True), np.uint8)
    steps, n = (np.ascontiguousarray(raw[x:y].reshape(-1, size).T) for x, y in ((0, 8 * size), (8 * size, 12 * size)))
    return [np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64), n.view(np.uint32).ravel().astype(np.int64)]


def pair_counts(docs: DataFrame, doc_id: str, text: str, d: int, shared: Broadcast, least: int) -> DataFrame:
    """``gram, ctx, below, n`` of the candidates that occur ``least`` times in training texts. ``shared`` has the
    marks of contexts and ends, and a table of frequent words: grams of up to three of them travel as their
    places there, sorted and packed, which takes a few bytes an entry, so all are added up in one pass. The
    others travel as two keys."""
    coded, deal = (d + 1) * PLACE_BITS <= 64, buckets(docs.sparkSession)

    def make(b):
        contexts, ends, words = shared.value
        key, at, ctx, below = candidates(d, contexts, ends)(b)
        if not coded:
            return np.zeros(0, np.uint64), ctx, below
        place = words.find(key)
        gram, known = np.zeros(len(at), np.uint64), np.ones(len(at), bool)
        for i in range(d, -1, -1):
            own = place[at - i]
            known &= own >= 0
            gram = (gram << np.uint64(PLACE_BITS)) | own.astype(np.uint64)
        return gram[known], ctx[~known], below[~known]

    def added(key, n, *rest):
        """Sums of distinct keys, in order, and ``rest`` of the first of each."""
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        return [key[first], np.add.reduceat(n[order], first) if len(key) else n, *(x[order[first]] for x in rest)]

    def spread(batches):
        for parts in gathered(batches, make):
            gram, ctx, below = parts
            parts.clear()
            gram.sort()
            first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, np.int64)
            n, gram = np.diff(np.r_[first, len(gram)]), gram[first]
            bucket = (mixed(gram) >> np.uint64(64 - deal)).astype(np.uint16)
            order = np.argsort(bucket, kind="stable")      # in the order of the grams within a bucket
            gram, n = gram[order], n[order]
            cuts = np.searchsorted(bucket[order], np.arange((1 << deal) + 1)).tolist()
            key, m, ctx, below = added(longer(d, ctx, below), np.ones(len(ctx), np.int64), ctx, below)
            ends = [*np.searchsorted(key, np.arange(1 << deal, dtype=np.uint64) << np.uint64(64 - deal)).tolist(), len(key)]
            for i in range(0, 1 << deal, SENT_BUCKETS):
                got = [(j, cuts[j + 1] - cuts[j], packed(gram[cuts[j]:cuts[j + 1]], n[cuts[j]:cuts[j + 1]]),
                        *(x[ends[j]:ends[j + 1]].tobytes() for x in (ctx, below, m.astype(np.uint32))))
                       for j in range(i, min(i + SENT_BUCKETS, 1 << deal)) if cuts[j + 1] > cuts[j] or ends[j + 1] > ends[j]]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), (pa.int32(), pa.int32(), *[pa.binary()] * 4))],
                                                     ["bucket", "size", "grams", "ctx", "below", "n"])

    def rows(near, far):
        columns = [[], [], []]
        if near:
            gram, n = added(*joined(near))
            gram, n = gram[n >= least], n[n >= least]
            words = [shared.value[2].key[(gram >> np.uint64(PLACE_BITS * i) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)] for i in range(d, -1, -1)]
            ctx, below = words[:-1], words[1:]
            for k in range(1, d):                          # keys of longer and longer grams
                ctx, below = ([longer(k, x, y) for x, y in zip(own, own[1:])] for own in (ctx, below))
            for column, x in zip(columns, (ctx[0], below[0], n)):
                column.append(x)
        if far:
            _, n, ctx, below = added(*joined(far))
            for column, x in zip(columns, (ctx, below, n)):
                column.append(x[n >= least])
        ctx, below, n = (np.concatenate(x) for x in columns)
        out = as_batch("gram ctx below n", longer(d, ctx, below), ctx, below, n)
        for i in range(0, out.num_rows, SENT_ROWS):
            yield out.slice(i, SENT_ROWS)

    def merge(batches):
        own, near, far, sizes = None, [], [], [0, 0]
        for b in batches:
            for i in range(b.num_rows):
                bucket, size, blob, *others = (x[i].as_py() for x in b.columns)
                if own is not None and bucket != own:
                    yield from rows(near, far)
                    near, far, sizes = [], [], [0, 0]
                own = bucket
                if size:
                    near.append(unpacked(blob, size))
                if others[0]:
                    ctx, below = (np.frombuffer(x, np.uint64) for x in others[:2])
                    far.append([longer(d, ctx, below), np.frombuffer(others[2], np.uint32).astype(np.int64), ctx, below])
                sizes = [sizes[0] + size, sizes[1] + len(others[0]) // 8]
                if sizes[0] > HELD:                        # the same grams of many tasks are one entry
                    near, sizes[0] = [added(*joined(near))], 0
                if sizes[1] > HELD:
                    far, sizes[1] = [added(*joined(far))], 0
        if own is not None:
            yield from rows(near, far)

    return (training(docs, doc_id, text).mapInArrow(spread, "bucket int, size int, grams binary, ctx binary, below binary, n binary")
            .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, "gram long, ctx long, below long, n long"))


def places(lengths: np.ndarray) -> np.ndarray:
    """Each token's place in its text."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def grow(docs: DataFrame, words: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH,
         least_context: int = LEAST_CONTEXT, least_follower: int = LEAST_FOLLOWER, least_gain: float = LEAST_GAIN) -> DataFrame:
    """The tree as rows ``key, value, n``. A retained context (key ``^ CONTEXT``) has log10 of the factor
    by which it changes its suffix's chance of the tokens that it doesn't list; a token that it
    lists (key of context and token) has log10 of its chance against that at the root.

    ``words`` has ``gram, n, root`` (log10 chance) of the words. A context's count is that of the gram
    it is, since an end follows every word; so each length needs one pass, and only over the
    contexts that are frequent, and the suffixes of whose grams are."""
    level = words.filter(F.col("n") >= least_follower).select("gram", "n", "root", F.col("root").alias("p"))
    often = F.floor(F.log2("n") * 8) >= F.lit(commonest(level, FREQUENT_WORDS))
    (top,) = sorted_rows(level.filter(often).select("gram").toArrow())
    entries, steps = [], []
    for d in range(1, depth + 1):
        alive = level.filter(F.col("n") >= least_context)
        contexts = marks(alive.select("gram"))
        if not contexts.words.any():
            break
        shared = docs.sparkSession.sparkContext.broadcast((contexts, marks(level.select("gram")), Table(top)))
        pairs = pair_counts(docs, doc_id, text, d, shared, least_follower)
        rated = written(pairs.join(alive.select(F.col("gram").alias("ctx"), F.col("n").alias("total")), "ctx")
                        .join(level.select(F.col("gram").alias("below"), F.col("p").alias("base"), "root"), "below"), "pairs")
        shared.destroy()                                 # neither the driver nor executors keep what was for one length
        del shared, contexts
        give_back()
        n, total, base = F.col("n"), F.col("total"), F.pow(F.lit(10.0), F.col("base"))
        own = rated.groupBy("ctx").agg(F.max("total").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("listed"),
                                       F.sum(base).alias("covered"), F.sum(n * F.ln(n / total / base)).alias("gain"))
        rest, room, k = total - F.col("listed"), F.greatest(F.lit(1e-9), 1 - F.col("covered")), F.col("kinds") + 1
        gain = F.col("gain") + F.when(rest > 0, rest * F.ln(rest / total / room)).otherwise(0.0)
        kept = written(own.filter(gain >= least_gain * (F.col("kinds") + (rest > 0).cast("int")))
                       .select("ctx", "total", k.alias("k"), F.log10((rest + k * room) / (total + k) / room).alias("factor")), "contexts")
        p = F.when(F.col("k").isNotNull(), F.log10((n + F.col("k") * base) / (total + F.col("k")))).otherwise(F.col("base"))
        level = written(rated.join(kept.select("ctx", "k"), "ctx", "left")
                        .select("gram", "n", "root", p.alias("p"), F.col("k").isNotNull().alias("listed")), "level")
        steps += [rated, kept, level]
        entries += [kept.select(F.col("ctx").bitwiseXOR(CONTEXT).alias("key"), F.col("factor").alias("value"), F.col("total").alias("n")),
                    level.filter("listed").select(F.col("gram").alias("key"), (F.col("p") - F.col("root")).alias("value"), "n")]
    empty = docs.sparkSession.createDataFrame([], "key long, value double, n long")
    rows = written(functools.reduce(DataFrame.union, entries, empty), "tree")
    discard(*steps)
    return rows


def commonest(rows: DataFrame, room: int):
    """The least ``floor(log2(n) * 8)`` of the most frequent rows that fit into ``room``."""
    sizes = rows.groupBy(F.floor(F.log2("n") * 8).alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()
    least = float("inf")
    for s, k in sorted(((r["s"], r["k"]) for r in sizes), reverse=True):
        if k > room:
            break
        least, room = s, room - k
    return least


class Table:
    """Places of keys in a sorted array, found by their first bits."""

    def __init__(self, key: np.ndarray):
        self.key, self.shift = key, 64 - max(10, len(key).bit_length())
        self.start = np.searchsorted(key >> np.uint64(self.shift), np.arange((1 << 64 - self.shift) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those that aren't there."""
        out = np.full(len(key), -1, np.int32)
        bucket = (key >> np.uint64(self.shift)).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            hit = self.key[at] == key[left]
            out[left[hit]] = at[hit]
            more = ~hit & (at + 1 < end)
            left, at, end = left[more], at[more] + 1, end[more]
        return out


@dataclass
class Tree:
    """What tasks hold of the tree: its most frequent rows, and marks of the others."""
    near: Table
    value: np.ndarray
    far: Marks

    def look(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (nan: none here), and whether a row elsewhere may have the key."""
        at = self.near.find(key)
        return self.value[at], self.far.hold(key) & (at < 0)

    def change(self, key: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """For each token log10 of its chance against the root's, from its longest contexts down to the
        first that lists it. Where one row elsewhere may change that, also arrays of place, key, and what
        comes on top of the row's value if it is there. Where several may, 0, and what counts: arrays of
        8 * place + code (twice the length, plus one for a listed token), key, value (nan: elsewhere)."""
        own, inside = grams(key, DEPTH), places(lengths)
        got, known = {}, np.zeros(len(key), np.int8)
        for d in range(DEPTH, 0, -1):                    # the longest first: nothing shorter matters once a token is known to be listed
            at = np.flatnonzero((inside >= d) & (known == 0))
            for code in (2 * d, 2 * d + 1):              # tokens are looked up where the context is known or likely
                which = own[d][at] if code % 2 else own[d - 1][at - 1] ^ np.uint64(CONTEXT)
                value, elsewhere = self.look(which)
                some = np.flatnonzero(elsewhere | ~np.isnan(value))
                at, which, value, elsewhere = at[some], which[some], value[some], elsewhere[some]
                got[code] = at, which, value
            known[at[~elsewhere]] = d                    # the longest context that is known to list the token
        far, depth = np.zeros(len(key), np.int8), np.zeros(len(key), np.int8)
        counting, likely = [], []
        for code in sorted(got):
            d, (at, which, value) = code // 2, got[code]
            counts = known[at] <= d if code % 2 else known[at] < d
            counting.append([x[counts] for x in (at, which, value)])
            at, which, value = counting[-1]
            some = np.isnan(value)
            far[at[some]] += 1
            depth[at[some]] = d * (code % 2)             # a token's row replaces all up to its length
            likely.append((at[some], which[some]))
        out, extra, rows = np.zeros(len(key)), np.zeros(len(key)), []
        for code, (at, which, value) in enumerate(counting, 2):
            now = (far[at] < 2) & ~np.isnan(value)
            out[at[now]] += value[now]
            now &= depth[at] >= code // 2
            extra[at[now]] -= value[now]
            later = far[at] > 1
            rows.append((8 * at[later] + code, which[later], value[later]))
        at, which = (np.concatenate(x) for x in zip(*likely))
        at, which = at[far[at] == 1], which[far[at] == 1]
        one = [at, which, extra[at]]
        rows = [np.concatenate(x) for x in zip(*rows)]
        return out, *([x[np.argsort(c[0])] for x in c] for c in (one, rows))


def folded(rows: DataFrame) -> DataFrame:
    """``uid, y`` from ``uid, at, value``: the changes of each text's unsure places."""
    value = lambda code: F.max(F.when(F.col("code") == code, F.col("value")))
    code = F.col("at").bitwiseAND(7)
    value = lambda c: F.max(F.when(code == c, F.col("value")))
    wide = rows.groupBy("uid", F.shiftright("at", 3)).agg(*[value(c).alias(f"v{c}") for c in range(2, 2 * DEPTH + 2)])
    total = F.lit(0.0)
    for d in range(1, DEPTH + 1):
        total = F.coalesce(F.col(f"v{2 * d + 1}"), total + F.coalesce(F.col(f"v{2 * d}"), F.lit(0.0)))
    return wide.select("uid", total.alias("y")).groupBy("uid").agg(F.sum("y").alias("y"))


def root(words: DataFrame) -> tuple[int, int, float]:
    """Training tokens, kinds of them, and the discount of each kind's count."""
    n, v, once, twice = words.agg(F.sum("c"), *(F.sum(x.cast("long")) for x in (
        F.col("c") > 0, F.col("c") == 1, F.col("c") == 2))).first()
    n, v, once, twice = (int(x or 0) for x in (n, v, once, twice))
    return n, v, min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.1


def sorted_rows(table: pa.Table) -> list[np.ndarray]:
    """The columns in the order of the first one, the keys."""
    key, *rest = (c.to_numpy() for c in table.columns)
    order = np.argsort(key.view(np.uint64))
    return [key.view(np.uint64)[order], *(x[order].astype(float) for x in rest)]


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", frequent: int = FREQUENT_WORDS,
          frequent_rows: int = FREQUENT_ROWS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for
    every row: learns from the texts whose crc32(id) mod 7 is not 2 (a null id
    counts as training) and scores all of them.

    Null and empty texts consist of their end. Without training texts every token is
    unknown and certain: both scores are 0. Repeated rows count and are scored each; an empty table gives an empty
    result; other columns are not read."""
    with settings(docs.sparkSession, CLEAN):
        return _score(docs, doc_id, text, frequent, frequent_rows)


def _score(docs: DataFrame, doc_id: str, text: str, frequent: int, frequent_rows: int) -> DataFrame:
    spark = docs.sparkSession
    words = written(word_counts(docs, doc_id, text), "words")
    n, v, discount = root(words)
    chance = F.log10(F.when(F.col("c") > 0, F.col("c") - discount).otherwise(discount * v) / n) if n else F.col("c") * 0.0
    rated = words.select("key", "c", "n", chance.alias("chance"))

    step = F.floor(F.log2("n") * 8)
    least = commonest(rated, frequent)
    held = lambda rows: sorted_rows(rows.toArrow())
    top, c, x = held(rated.filter(step >= F.lit(least)).select("key", "c", "chance"))
    values = np.vstack([np.column_stack([np.log10(c + 1), c > 0, x]), np.zeros((1, 3))])     # the last row: not there
    known = rated.select(F.col("key").alias("gram"), F.col("c").alias("n"), F.col("chance").alias("root"))
    rows = grow(docs, known, doc_id, text)
    n_rows = rows.count()
    row_least = commonest(rows, min(frequent_rows, n_rows // HELD_SHARE))
    near, change = held(rows.filter(step >= F.lit(row_least)).select("key", "value"))
    # as exact as the held ones, so that a score doesn't depend on where a row is
    far = rows.filter(step < F.lit(row_least)).select("key", F.col("value").cast("float").cast("double").alias("value"))
    tree = Tree(Table(near), np.append(change, np.nan).astype(np.float32), marks(far.select("key")))
    shared = spark.sparkContext.broadcast((Table(top), values, tree))
    held_rows = len(change)
    del tree, near, change, top, values, c, x
    give_back()

    def read(batches):
        slot, values, tree = shared.value
        uid = TaskContext.get().partitionId() << 40
        for b in slices(batches, 1, 0, SCORED):
            key, lengths = token_keys(b.column(1))
            at = slot.find(key)
            sums = segment_sums(values[at], lengths)
            change, (at_one, key_one, extra), (place, which, value) = tree.change(key, lengths)
            sums[:, 2] += segment_sums(change, lengths)
            ends = np.r_[0, np.cumsum(lengths)]
            lists = lambda at, x: pa.ListArray.from_arrays(pa.array(np.searchsorted(at, ends).astype(np.int32)), x)
            rare = lists(np.flatnonzero(at < 0), pa.array(key[at < 0].view(np.int64)))
            likely = lists(at_one, pa.StructArray.from_arrays([pa.array(key_one.view(np.int64)), pa.array(extra)], ["key", "extra"]))
            unsure = lists(place // 8, pa.StructArray.from_arrays(
                [pa.array(place), pa.array(which.view(np.int64), mask=~np.isnan(value)), pa.array(value, from_pandas=True)], ["at", "key", "value"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(uid, uid + len(lengths))), b.column(0), b.column(2), pa.array(lengths),
                 *(pa.array(sums[:, k]) for k in range(3)), rare, likely, unsure],
                ["uid", "doc_id", "held_out", "n_tokens", "base", "known", "chance", "rare", "likely", "unsure"])
            uid += len(lengths)

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                      (remainder(doc_id, MOD) == HELD_OUT).alias("held_out"))

    def scores(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        parts = written(texts.mapInArrow(read, "uid long, doc_id long, held_out boolean, n_tokens long, base double, "
                                               "known double, chance double, rare array<long>, "
                                               "likely array<struct<key:long,extra:double>>, unsure array<struct<at:long,key:long,value:float>>"), "parts")
        rest = (parts.select("uid", F.explode("rare").alias("key"))
                .join(rated.filter(step < F.lit(least)).select("key", "c"), "key")
                .groupBy("uid").agg(F.sum(F.log10(F.col("c") + 1)).alias("b"), F.sum((F.col("c") > 0).cast("double")).alias("k"),
                                    F.sum(chance).alias("x")))
        one = parts.select("uid", F.inline("likely")).join(far, "key").select("uid", (F.col("value") + F.col("extra")).alias("y"))
        several = parts.select("uid", F.inline("unsure"))
        found = several.filter("value IS NULL").drop("value").join(far, "key").select("uid", "at", "value")
        several = folded(several.filter("value IS NOT NULL").select("uid", "at", "value").union(found))
        tree_rest = one.union(several).groupBy("uid").agg(F.sum("y").alias("y"))
        or0 = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        return parts, parts.join(rest, "uid", "left").join(tree_rest, "uid", "left").select(
            "doc_id", "held_out", "n_tokens", (F.col("known") + or0("k")).cast("long").alias("n_known"),
            F.lit(n).cast("long").alias("train_tokens"),
            (F.col("base") + or0("b") - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
            (F.col("chance") + or0("x") + or0("y")).alias("score"))

    rounds = min(ROUNDS, 1 + (n_rows - held_rows) // FREQUENT_ROWS)
    done = [] if rounds > 1 else [scores(src)[1]]
    for r in range(rounds if rounds > 1 else 0):         # what a round ships is gone when the next one begins
        parts, out = scores(src.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == r))
        done.append(written(out, "scores"))
        discard(parts)
    shared.destroy()                                     # all texts are read
    return functools.reduce(DataFrame.union, done)
