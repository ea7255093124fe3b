"""Benchmark decontamination by latent semantic retrieval.

Passages of documents (overlapping windows of words) and of benchmark items are TF-IDF
vectors over the words of the benchmark. A randomised singular value decomposition of
all passages, computed where the documents are, gives a space in which passages close
to an item are candidates, and so are places that hold a run of an item's words; the
longest common subsequence of words and a check of the item's answer decide, so that
paraphrases and inserted words are found too.

The benchmark is the stated query set: it is taken in blocks of at most ``RANK`` pieces,
each with a space of its own that holds every piece, against all documents.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import hold, mixed, slices, written

#: Items that the driver reads at once.
BLOCK_ITEMS = 4096
#: Hash buckets of words; the last number stands for words that the benchmark doesn't have.
BUCKETS = (1 << 16) - 1
#: Words in more than this share of the documents are left out, but for the rarest words of each item.
COMMON, RAREST = 0.02, 8
#: Dimensions of the space, and passes over the documents that refine it.
RANK, PASSES = 256, 2
#: Share of its length that each piece of an item keeps in the space, at least.
KEPT = 0.95
#: Windows are two strides long, so each run of a stride's words lies in one of them; longer items
#: are sought by pieces of a stride and a half.
STRIDE = 32
PIECE = 48
#: Strides of the windows that items are sought in: the least one whose run holds the item, so that
#: what stands beside a short item weighs little more than the item. Blocks of a stride handled at once.
STRIDES, HELD_BLOCKS = (8, 16, STRIDE), 16_384
#: Least cosine of a candidate.
COSINE = 0.4
#: An item is found if this share of its words is a common subsequence; or the lower share, and the
#: answer's share of the answer. Items of fewer words must occur word for word.
NEAR, LOOSE, ANSWER, SHORT = 0.7, 0.5, 0.8, 8

_MARKS = bytes(32 if 33 <= b < 127 and not chr(b).isalnum() else b for b in range(256))
_SENTENCE = re.compile(r"[.!?]+(?:\s+|$)")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "replace").translate(_MARKS).split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def answer_of(text: str) -> list[bytes]:
    """The last sentence of an item of several, else the last third of its words."""
    sentences = [w for s in _SENTENCE.split(text) if (w := words_of(s))]
    if len(sentences) > 1:
        return sentences[-1]
    words = words_of(text)
    return words[-(-2 * len(words) // 3):]


def common_subsequence(a: np.ndarray, places: dict[int, int], m: int) -> int:
    """Length of the longest common subsequence of ``a`` and a sequence of ``m`` symbols
    given as bit masks of each symbol's places (bit-parallel)."""
    full = (1 << m) - 1
    v = full
    for x in a.tolist():
        if mask := places.get(x):
            u = v & mask
            v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def _places(a: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        out[x] = out.get(x, 0) | 1 << i
    return out


class Item:
    def __init__(self, item_id: int, text: str):
        self.id = item_id
        self.words = hashes(words_of(text))
        self.answer = hashes(answer_of(text))
        self.places, self.answer_places = _places(self.words), _places(self.answer)
        self.stride = next((s for s in STRIDES if len(self.words) <= s + 1), STRIDE)
        self.pieces = [self.words[i:i + PIECE] for i in range(0, max(1, len(self.words) - PIECE // 2), PIECE)]

    def found(self, near: np.ndarray) -> tuple[int, bool, bool]:
        """Common words, whether the answer is there, and the verdict for a stretch of words."""
        m = len(self.words)
        common = common_subsequence(near, self.places, m)
        if m < SHORT:
            whole = any(np.array_equal(near[i:i + m], self.words) for i in np.flatnonzero(near == self.words[0])) if m else False
            return common, whole, whole
        k = len(self.answer)
        answer = common_subsequence(near, self.answer_places, k) >= ANSWER * k
        return common, answer, common >= NEAR * m or (common >= LOOSE * m and answer)


@dataclass
class Space:
    items: list[Item]
    feature: np.ndarray                  # (BUCKETS,): number of each bucket's feature, -1 if none
    weight: np.ndarray                   # (features,): inverse document frequencies
    basis: np.ndarray                    # (features, rank): the decomposition's, then those added for pieces
    values: np.ndarray                   # singular values of the decomposition
    targets: np.ndarray                  # (pieces, rank): unit vectors of the items' pieces
    owner: np.ndarray                    # item of each piece
    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]   # by length: sorted keys, items, and places in them


def _vectors(space: Space, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF vectors of word sequences as a dense matrix, and their lengths."""
    out = np.zeros((len(pieces), len(space.weight)))
    for i, p in enumerate(pieces):
        f = space.feature[(p % np.uint64(BUCKETS)).astype(np.int64)]
        np.add.at(out[i], f[f >= 0], space.weight[f[f >= 0]])
    return out, np.sqrt((out * out).sum(axis=1))


def run_keys(words: np.ndarray, n: int) -> np.ndarray:
    """A key of each run of ``n`` words."""
    key = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        key *= np.uint64(0x9E3779B97F4A7C15)
        key += words[i:i + len(key)]
    return mixed(key)


def _runs(items: list[Item]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of ``SHORT`` words of the items, and all of the shorter items."""
    rows: dict[int, list] = {}
    for k, i in enumerate(items):
        n = min(SHORT, len(i.words))
        rows.setdefault(n, []).extend((key, k, n * j) for j, key in enumerate(run_keys(i.words, n)[::n].tolist()))
    return {n: (np.array([x[0] for x in own], np.uint64), np.array([x[1] for x in own]), np.array([x[2] for x in own]))
            for n, own in ((n, sorted(x)) for n, x in rows.items())}


def _windows(lengths: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Number of stride-long blocks of each document, and each one's first block."""
    blocks = np.maximum(1, -(-lengths // stride))
    return blocks, np.cumsum(blocks) - blocks


def _block_sums(feature: np.ndarray, doc: np.ndarray, place: np.ndarray, first: np.ndarray, total: int,
                rows: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the features' rows in each block, and each occurrence's block."""
    block = first[doc] + place // stride
    out = np.zeros((total, rows.shape[1]), np.float32)
    _add_rows(out, block, rows, feature)
    return out, block


def _add_rows(out: np.ndarray, to: np.ndarray, rows: np.ndarray, take: np.ndarray) -> None:
    """Adds ``rows[take]`` to the rows ``to`` (in rising order) of ``out``: the first row of
    each place, then the second, and so on, as most places have one or two."""
    if not len(to):
        return
    new = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    size = np.diff(np.r_[new, len(to)])
    for k in range(int(size.max())):
        at = new[size > k] + k
        out[to[at]] += rows[take[at]]


def _encoded(docs: DataFrame, text: str, feature: np.ndarray) -> DataFrame:
    """``n, features, places``: of each text, its number of words and where it has
    words of the benchmark."""
    shared = docs.sparkSession.sparkContext.broadcast(feature)

    def run(batches):
        table = shared.value
        hold("passages", lambda: None)
        for b in slices(batches, 0):
            n, fs, ps = [], [], []
            for t in b.column(0).to_pylist():
                h = hashes(words_of(t))
                f = table[(h % np.uint64(BUCKETS)).astype(np.int64)]
                at = np.flatnonzero(f >= 0)
                n.append(len(h))
                fs.append(f[at].astype(np.uint16).tobytes())
                ps.append(at.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(fs, pa.binary()), pa.array(ps, pa.binary())],
                                             ["n", "features", "places"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "n long, features binary, places binary")


def _occurrences(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature, document in the batch, and place of each occurrence; documents' lengths."""
    fs, ps = b.column(1).to_pylist(), b.column(2).to_pylist()
    n = np.fromiter((len(f) // 2 for f in fs), np.int64, len(fs))
    return (np.frombuffer(b"".join(fs), np.uint16).astype(np.int64), np.repeat(np.arange(len(fs)), n),
            np.frombuffer(b"".join(ps), np.uint32).astype(np.int64), b.column(0).to_numpy())


def _frequencies(encoded: DataFrame, features: int) -> np.ndarray:
    """Documents that hold each feature (at most BUCKETS of them)."""
    def run(batches):
        total = np.zeros(features, np.int64)
        for b in slices(batches, 1):
            f, doc, _, _ = _occurrences(b)
            total += np.bincount(np.unique(doc * features + f) % features, minlength=features)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["f", "n"])

    out = np.zeros(features, np.int64)
    for r in encoded.mapInArrow(run, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():
        out[r["f"]] = r["n"]
    return out


def _gram(encoded: DataFrame, kept: np.ndarray, weight: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A'Ax for the matrix A of all windows' TF-IDF vectors (window rows, feature columns).

    A task adds up its windows; partial sums meet in two more rounds, of about the root
    of the number of tasks and of one, each holding one matrix at a time."""
    shared = encoded.sparkSession.sparkContext.broadcast((kept, weight, (weight[:, None] * x).astype(np.float32)))
    shape = x.shape

    def run(batches):
        kept, weight, rows = shared.value
        total = np.zeros(shape)
        for b in slices(batches, 1):
            f, doc, place, lengths = _occurrences(b)
            f = kept[f]
            f, doc, place = f[f >= 0], doc[f >= 0], place[f >= 0]
            blocks, first = _windows(lengths)
            sums, block = _block_sums(f, doc, place, first, int(blocks.sum()), rows)
            last = first + blocks - 1
            window = sums.copy()                       # a window: a block and the next one of its text
            window[:-1] += sums[1:]
            window[last] = sums[last]
            both = window.copy()                       # what a block's words meet: its two windows
            both[1:] += window[:-1]
            both[first] = window[first]
            order = np.argsort(f.astype(np.uint16), kind="stable")
            _add_rows(total, f[order], both, block[order])
        yield one(total * weight[:, None])

    def one(total):
        return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()),
                                           pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["task", "y"])

    def add(batches):
        total, some = np.zeros(shape), False
        for b in batches:
            for y in b.column(1):
                total += np.frombuffer(y.as_buffer(), np.float32).reshape(shape)
                some = True
        if some:
            yield one(total)

    kind, tasks = "task int, y binary", encoded.rdd.getNumPartitions()
    part = encoded.mapInArrow(run, kind)
    if tasks > 1:
        part = part.repartition(math.isqrt(tasks), "task").mapInArrow(add, kind).coalesce(1).mapInArrow(add, kind)
    return sum((np.frombuffer(r["y"], np.float32).reshape(shape).astype(float) for r in part.collect()), np.zeros(shape))


def fit(docs: DataFrame, items: list[Item], text: str = "text") -> Space:
    """The space of one block of items over the passages of all documents."""
    buckets = np.unique(np.concatenate([np.zeros(0, np.uint64), *(i.words for i in items)]) % np.uint64(BUCKETS)).astype(np.int64)
    feature = np.full(BUCKETS, -1, np.int32)
    feature[buckets] = np.arange(len(buckets))
    encoded = written(_encoded(docs, text, feature), "encoded")
    n = encoded.count()
    frequency = _frequencies(encoded, len(buckets)) if len(buckets) else np.zeros(0, np.int64)

    keep = frequency <= COMMON * n
    for i in items:
        f = np.unique(feature[(i.words % np.uint64(BUCKETS)).astype(np.int64)])
        keep[f[np.argsort(frequency[f], kind="stable")[:RAREST]]] = True
    kept = np.where(keep, np.cumsum(keep) - 1, -1).astype(np.int64)
    feature = np.where(feature >= 0, kept[np.maximum(feature, 0)] if len(kept) else -1, -1).astype(np.int32)
    weight = np.log1p(n / np.maximum(frequency[keep], 1)) if len(kept) else np.zeros(0)

    pieces = [p for i in items for p in i.pieces]
    owner = np.repeat(np.arange(len(items)), [len(i.pieces) for i in items])
    space = Space(items, feature, weight, np.zeros((len(weight), 0)), np.zeros(0), np.zeros((len(pieces), 0)), owner, _runs(items))
    if not len(weight):
        return space
    own, size = _vectors(space, pieces)
    windows = encoded.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / STRIDE)))).first()[0] or 0
    # the items weigh as much as the documents' windows, so that the space holds both
    share = max(1.0, windows / len(pieces))
    rank = min(RANK, len(weight))
    x = np.random.default_rng(4).normal(size=(len(weight), rank))
    for _ in range(PASSES):
        basis, _ = np.linalg.qr(x)
        x = _gram(encoded, kept, weight, basis) + share * own.T @ (own @ basis)
    values, turn = np.linalg.eigh((basis.T @ x + x.T @ basis) / 2)
    space.basis = _holding(basis @ turn[:, ::-1], own, size).astype(np.float32)
    space.values = np.sqrt(np.maximum(values[::-1], 0))
    space.targets = ((own @ space.basis) / np.maximum(size, 1e-9)[:, None]).astype(np.float32)
    assert (np.linalg.norm(space.targets, axis=1)[size > 0] >= KEPT - 1e-3).all()
    return space


def _holding(basis: np.ndarray, own: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The basis, and directions for what it leaves out of the pieces that keep less than ``KEPT``."""
    left = own - (own @ basis) @ basis.T
    left = left[np.linalg.norm(own @ basis, axis=1) < KEPT * size]
    if not len(left):
        return basis
    _, s, added = np.linalg.svd(left, full_matrices=False)
    return np.hstack([basis, added[s > 1e-6 * s[0]].T])


def candidates(space: Space, words: list[np.ndarray]) -> list[tuple[int, int, int, float]]:
    """``document, first word of the window, item, cosine`` of all windows near an item.
    A window's length is taken as if its words were distinct; where they aren't, the
    cosine is too high, at most 1."""
    least = min((i.stride for i in space.items), default=STRIDE)
    ends = np.cumsum([len(w) // least + 1 for w in words])
    out, at = [], 0
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD_BLOCKS, side="right")))
        out += [(at + d, *rest) for d, *rest in _near(space, words[at:to], least)]
        at = to
    return out


def _near(space: Space, words: list[np.ndarray], stride: int) -> list[tuple[int, int, int, float]]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.concatenate([np.zeros(0, np.uint64), *words])
    if not len(flat) or not space.basis.shape[1]:
        return []
    f = space.feature[(flat % np.uint64(BUCKETS)).astype(np.int64)]
    at = np.flatnonzero(f >= 0)
    doc = np.repeat(np.arange(len(words)), lengths)[at]
    place = at - (np.cumsum(lengths) - lengths)[doc]
    blocks, first = _windows(lengths, stride)
    w = space.weight[:, None]
    sums, _ = _block_sums(f[at], doc, place, first, int(blocks.sum()), np.hstack([w * space.basis, w * w]).astype(np.float32), stride)
    own = np.array([i.stride for i in space.items])[space.owner]
    out = []
    while True:
        of = np.repeat(np.arange(len(words)), blocks)
        targets = np.flatnonzero(own == stride)
        if len(targets):
            last = first + blocks - 1
            window = sums.copy()
            window[:-1] += sums[1:]
            window[last] = sums[last]
            some = np.flatnonzero(window[:, -1] > 0)
            for i in range(0, len(some), 4096):
                rows = some[i:i + 4096]
                cosine = window[rows, :-1] @ space.targets[targets].T / np.sqrt(window[rows, -1:])
                a, b = np.nonzero(cosine >= COSINE)
                d = of[rows[a]]
                out += zip(d.tolist(), ((rows[a] - first[d]) * stride).tolist(), space.owner[targets[b]].tolist(),
                           np.minimum(cosine[a, b], 1.0).tolist())
        if stride == STRIDE:
            return out
        stride *= 2                                        # two blocks become one
        inside, fine = np.arange(len(sums)) - first[of], sums
        blocks, first = _windows(lengths, stride)
        to, odd = first[of] + inside // 2, inside % 2 == 1
        sums = np.zeros((int(blocks.sum()), fine.shape[1]), np.float32)
        sums[to[~odd]] = fine[~odd]
        sums[to[odd]] += fine[odd]


def copied(space: Space, words: list[np.ndarray]) -> list[tuple[int, int, int, None]]:
    """``document, first word, item`` of the places that hold a run of an item, as if all of
    the item stood there. Of a short item, the first place of each document."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.concatenate([np.zeros(0, np.uint64), *words])
    doc = np.repeat(np.arange(len(words)), lengths)
    before = np.cumsum(lengths) - lengths
    out = []
    for n, (keys, item, offset) in space.runs.items():
        key = run_keys(flat, n)
        some = np.zeros(1 << 16, bool)                     # most places are told apart by a few bits
        some[keys & np.uint64(0xFFFF)] = True
        at = np.flatnonzero(some[key & np.uint64(0xFFFF)])
        at = at[doc[at] == doc[at + n - 1]]
        if n < SHORT:
            at = at[np.unique(np.stack([doc[at].astype(np.uint64), key[at]]), axis=1, return_index=True)[1]]
        low, high = (np.searchsorted(keys, key[at], side=x) for x in ("left", "right"))
        for p, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
            d = int(doc[p])
            for k in range(a, b):
                out.append((d, p - int(before[d]) - int(offset[k]), int(item[k]), None))
    return out


def _cosine(space: Space, words: np.ndarray, start: int, k: int) -> float:
    """The largest cosine of a piece of an item and as many words where it should stand."""
    best = 0.0
    for j, t in enumerate(np.flatnonzero(space.owner == k).tolist()):
        piece = space.items[k].pieces[j]
        v, size = _vectors(space, [words[max(0, start + j * PIECE):max(0, start + j * PIECE + len(piece))]])
        best = max(best, float((v @ space.basis @ space.targets[t])[0] / max(size[0], 1e-9)))
    return min(best, 1.0)


def judged(space: Space, texts: list[str | None]) -> list[dict[int, tuple[float, int, bool]]]:
    """For each text, the items found in it: (cosine, common words, answer)."""
    words = [hashes(words_of(t)) for t in texts]
    out: list[dict] = [{} for _ in texts]
    for d, start, k, cosine in chain(sorted(candidates(space, words), key=lambda c: -c[3]), copied(space, words)):
        item = space.items[k]
        if k in out[d]:
            continue
        m = len(item.words)
        common, answer, found = item.found(words[d][max(0, start - m):start + 2 * STRIDE + m])
        if found:
            out[d][k] = (_cosine(space, words[d], start, k) if cosine is None else cosine, common, answer)
    return out


def blocks(benchmark: DataFrame, item_id: str, text: str):
    """The items in blocks of at most ``RANK`` pieces, or one longer item (null ids or texts left out)."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(text).cast("string").alias("t")).dropna().distinct()
    count = -(-rows.count() // BLOCK_ITEMS)
    for k in range(count):
        part = rows.filter(F.pmod(F.xxhash64("id", "t"), F.lit(count)) == k).orderBy("id", "t").collect()
        block, held = [], 0
        for i in (i for i in (Item(r["id"], r["t"]) for r in part) if len(i.words)):
            if block and held + len(i.pieces) > RANK:
                yield block
                block, held = [], 0
            block.append(i)
            held += len(i.pieces)
        if block:
            yield block


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
            item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, cosine, n_common, n_item, answer``: every item found in a
    document of ``docs``, once for each row and item.

    ``n_common`` of the item's ``n_item`` words are a common subsequence with the words
    around a window; ``answer``: the item's answer is there. Null, empty and word-less
    texts and items match nothing; repeated rows match each; a null id stays null; empty
    tables give an empty result; other columns are not read."""
    spark = docs.sparkSession
    kind = "doc_id long, item_id long, cosine double, n_common long, n_item long, answer boolean"
    out = spark.createDataFrame([], kind)
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    for items in blocks(benchmark, item_id, item_text):
        shared = spark.sparkContext.broadcast(fit(docs, items, text))

        def run(batches, shared=shared):
            space = shared.value
            for b in slices(batches):
                rows = [(d, space.items[k].id, c, n, len(space.items[k].words), a)
                        for d, got in zip(b.column(0).to_pylist(), judged(space, b.column(1).to_pylist()))
                        for k, (c, n, a) in sorted(got.items())]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                                 ["doc_id", "item_id", "cosine", "n_common", "n_item", "answer"])

        out = out.unionByName(src.mapInArrow(run, kind))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    at = docs.columns.index(text)
    out = docs
    for items in blocks(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(fit(docs, items, text))

        def run(batches, shared=shared):
            for b in slices(batches, at):
                yield b.filter(pa.array([not got for got in judged(shared.value, b.column(at).to_pylist())], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
