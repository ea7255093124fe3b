"""Toxicity: a linear-chain conditional random field tags toxic tokens.

Token labels come from labelled documents: a token of a toxic document is labelled
toxic if its word is significantly more frequent in toxic documents than in others.
The field has two states; its features are the word, its beginnings and its end,
hashed. Forward-backward marginals give each document's spans (offsets) and, through
a logistic fit on their maximum and sum, its score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import WordTable, remainder, slices

#: Training sample: at most so many labelled documents of each class, none longer than this.
#: Bounds the driver's data; scoring has no bound.
PER_CLASS, TRAIN_CHARS = 1200, 20_000
BUCKETS, ROUNDS, RATE, L2 = 1 << 18, 30, 0.5, 1e-3
#: A word counts as toxic from this likelihood-ratio statistic and this ratio of frequencies on.
SIGNIFICANT, RATIO = 15.0, 4.0
#: Tokens of a block: long documents are chains of blocks whose transfer matrices are joined.
BLOCK = 128
THRESHOLD, SPAN_PROBABILITY = 0.3, 0.5
MOD, HELD_OUT = 4, 2

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").split()


def features(words: list[bytes]) -> np.ndarray:
    """Buckets of each word's features: (words, 4)."""
    h = xxhash.xxh3_64_intdigest
    flat = []
    for w in words:
        w = w.strip(_EDGES)
        flat += (h(w, 1), h(w[:5], 2), h(w[:7], 3), h(w[-4:], 4))
    return (np.array(flat, np.uint64) % np.uint64(BUCKETS)).astype(np.int64).reshape(-1, 4)


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS, np.float32))
    links: np.ndarray = field(default_factory=lambda: np.array([[1.0, 0.05], [1.0, 0.05]]))
    document: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0]))
    table: WordTable | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "table": None}

    def unary(self, words: list[bytes]) -> np.ndarray:
        """Log-odds of the toxic state that each word adds."""
        if self.table is None:
            self.table = WordTable(1, lambda new: self.weights[features(new)].sum(axis=1))
        slots = self.table.slots(words)
        return self.table.values[slots, 0].astype(np.float64)


@dataclass
class Blocks:
    """Token sequences cut into blocks, as columns of (BLOCK, blocks) arrays."""
    place: np.ndarray          # (BLOCK, blocks): token number, -1 beyond the end
    active: np.ndarray         # blocks still running at each step; blocks are in order of falling length
    steps: list                # for each block ordinal: the blocks and their documents


def cut(lengths: np.ndarray, size: int = BLOCK) -> Blocks:
    starts = np.cumsum(lengths) - lengths
    count = -(-lengths // size)
    doc = np.repeat(np.arange(len(lengths)), count)
    ordinal = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    n = np.minimum(size, lengths[doc] - ordinal * size)
    order = np.argsort(-n, kind="stable")
    doc, ordinal, n = doc[order], ordinal[order], n[order]
    t = np.arange(size)[:, None]
    place = np.where(t < n, (starts[doc] + ordinal * size) + t, -1)
    by = np.argsort(ordinal, kind="stable")
    ends = np.searchsorted(ordinal[by], np.arange(int(ordinal.max(initial=-1)) + 2))
    steps = [(by[a:b], doc[by[a:b]]) for a, b in zip(ends, ends[1:])]
    return Blocks(place, (t < n).sum(axis=1), steps)


def chain(e: np.ndarray, active: np.ndarray, links: np.ndarray, enter: np.ndarray, leave: np.ndarray,
          pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state inside blocks: (steps, blocks), and the summed
    marginals of state pairs. ``e``: factors of the toxic state; ``enter``: forward
    messages before the block, ``leave``: backward messages after it (blocks, 2)."""
    (a00, a01), (a10, a11) = links
    f0, f1 = np.zeros_like(e), np.zeros_like(e)
    x0, x1 = enter[:, 0].copy(), enter[:, 1].copy()
    for t, m in enumerate(active):
        if not m:
            break
        n0 = x0[:m] * a00 + x1[:m] * a10
        n1 = (x0[:m] * a01 + x1[:m] * a11) * e[t, :m]
        z = n0 + n1
        f0[t, :m] = x0[:m] = n0 / z
        f1[t, :m] = x1[:m] = n1 / z
    p, both = np.zeros_like(e), np.zeros((2, 2))
    b0, b1 = leave[:, 0].copy(), leave[:, 1].copy()
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        if not m:
            continue
        y0, y1, et = b0[:m], b1[:m], e[t, :m]
        up = f1[t, :m] * y1
        p[t, :m] = up / (f0[t, :m] * y0 + up)
        if pairs:
            q0, q1 = (f0[t - 1, :m], f1[t - 1, :m]) if t else (enter[:m, 0], enter[:m, 1])
            c = np.array([[q0 * a00 * y0, q0 * a01 * et * y1], [q1 * a10 * y0, q1 * a11 * et * y1]])
            both += (c / c.sum(axis=(0, 1))).sum(axis=2)
        n0, n1 = a00 * y0 + a01 * et * y1, a10 * y0 + a11 * et * y1
        z = n0 + n1
        b0[:m], b1[:m] = n0 / z, n1 / z
    return p, both


def transfers(e: np.ndarray, active: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Each block's product of step matrices, up to a factor: (blocks, 2, 2)."""
    (a00, a01), (a10, a11) = links
    left = np.zeros((e.shape[1], 2))
    right = np.zeros((e.shape[1], 2))
    left[:, 0] = right[:, 1] = 1.0
    for t, m in enumerate(active):
        if not m:
            break
        x, y = left[:m], right[:m]
        n, k = x * a00 + y * a10, (x * a01 + y * a11) * e[t, :m, None]
        z = (n + k).sum(axis=1, keepdims=True)
        left[:m], right[:m] = n / z, k / z
    return np.stack([left, right], axis=2)


def marginals(u: np.ndarray, lengths: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Probability of the toxic state of every token of sequences laid end to end.
    Before each sequence stands an untoxic state."""
    if not len(u):
        return np.zeros(0)
    cuts = cut(lengths)
    e = np.where(cuts.place >= 0, np.exp(np.clip(u, -30, 30))[cuts.place], 1.0)
    blocks = e.shape[1]
    enter, leave = np.zeros((blocks, 2)), np.ones((blocks, 2))
    enter[:, 0] = 1.0
    if len(cuts.steps) > 1:
        step = transfers(e, cuts.active, links)
        carry = np.zeros((len(lengths), 2))
        carry[:, 0] = 1.0
        for at, doc in cuts.steps:
            enter[at] = carry[doc]
            x = np.einsum("bi,bij->bj", carry[doc], step[at])
            carry[doc] = x / x.sum(axis=1, keepdims=True)
        carry = np.ones((len(lengths), 2))
        for at, doc in reversed(cuts.steps):
            leave[at] = carry[doc]
            x = np.einsum("bij,bj->bi", step[at], carry[doc])
            carry[doc] = x / x.sum(axis=1, keepdims=True)
    p, _ = chain(e, cuts.active, links, enter, leave)
    out = np.zeros(len(u))
    real = cuts.place >= 0
    out[cuts.place[real]] = p[real]
    return out


def toxic_words(docs: list[list[bytes]], labels: np.ndarray) -> set[bytes]:
    """Words (without edge marks) that toxic documents hold significantly more often."""
    seen: dict[bytes, list[int]] = {}
    for words, label in zip(docs, labels):
        for w in {w.strip(_EDGES) for w in words}:
            seen.setdefault(w, [0, 0])[label] += 1
    n = np.bincount(labels, minlength=2)
    out = set()
    for w, (b, a) in seen.items():
        if w and (a + 0.5) / (n[1] + 1) >= RATIO * (b + 0.5) / (n[0] + 1):
            expected = (a + b) * n / n.sum()
            g = 2 * (a * np.log(a / expected[1]) + (b * np.log(b / expected[0]) if b else 0.0))
            if g >= SIGNIFICANT:
                out.add(w)
    return out


def fit(texts: list[str], labels: list[int], shares: tuple[float, float]) -> Model:
    """Trains on labelled texts. ``shares``: weight of a sampled row of class 0 and 1."""
    model = Model()
    y = np.array(labels, np.int64)
    docs = [words_of(t) for t in texts]
    seeds = toxic_words(docs, y) if len(set(labels)) == 2 else set()
    lengths = np.array([len(d) for d in docs], np.int64)
    flat = [w for d in docs for w in d]
    if seeds:
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        word = np.fromiter(map(vocabulary.__getitem__, flat), np.int64, len(flat))
        feats = features(list(vocabulary))
        is_seed = np.fromiter((w.strip(_EDGES) in seeds for w in vocabulary), bool, len(vocabulary))
        gold = (is_seed[word] & (np.repeat(y, lengths) == 1)).astype(np.float64)
        _train(model, word, feats, gold, lengths)
    p = marginals(model.unary(flat), lengths, model.links)
    model.document = _logistic(_summary(p, lengths), y, np.where(y == 1, shares[1], shares[0]))
    model.table = None
    return model


def _train(model: Model, word: np.ndarray, feats: np.ndarray, gold: np.ndarray, lengths: np.ndarray) -> None:
    """Likelihood ascent (per-weight rates) over blocks as sequences of their own."""
    cuts = cut(lengths)
    real = cuts.place >= 0
    blocks = cuts.place.shape[1]
    enter, leave = np.zeros((blocks, 2)), np.ones((blocks, 2))
    enter[:, 0] = 1.0
    target = np.where(real, gold[cuts.place], 0.0)
    before = np.vstack([np.zeros(blocks), target[:-1]])
    seen = np.array([[((1 - i - (1 - 2 * i) * before) * (1 - j - (1 - 2 * j) * target) * real).sum() for j in (0, 1)] for i in (0, 1)])
    w, theta = np.zeros(BUCKETS), np.log(model.links)
    gw, gt = np.full(BUCKETS, 1e-2), np.full((2, 2), 1e-2)
    words = len(feats)
    for _ in range(ROUNDS):
        u = w[feats].sum(axis=1)[word]
        e = np.where(real, np.exp(np.clip(u, -30, 30))[cuts.place], 1.0)
        p, both = chain(e, cuts.active, np.exp(theta), enter, leave, pairs=True)
        miss = np.zeros(len(word))
        miss[cuts.place[real]] = (target - p)[real]
        by_word = np.bincount(word, weights=miss, minlength=words)
        grad = np.bincount(feats.ravel(), weights=np.repeat(by_word, feats.shape[1]), minlength=BUCKETS) - L2 * w
        gw += grad * grad
        w += RATE * grad / np.sqrt(gw)
        step = seen - both
        gt += step * step
        theta = np.clip(theta + RATE * step / np.sqrt(gt), -8, 8)
    model.weights, model.links = w.astype(np.float32), np.exp(theta)


def _summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A document's largest marginal and the logarithm of their sum, beside a one."""
    out = np.zeros((len(lengths), 3))
    out[:, 0] = 1.0
    full = np.flatnonzero(lengths)
    if len(full):
        starts = (np.cumsum(lengths) - lengths)[full]
        out[full, 1] = np.maximum.reduceat(p, starts)
        out[full, 2] = np.log1p(np.add.reduceat(p, starts))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps with a small ridge."""
    b = np.zeros(x.shape[1])
    if not len(y):
        return Model().document
    ridge = 0.05 * np.eye(len(b))
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (y - q)) - ridge @ b
        step = np.linalg.solve((x * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + ridge, grad)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Learns from labelled rows whose crc32(id) mod 4 is not 2. The sample: at most
    ``PER_CLASS`` documents of each class in the order of a hash; rows weigh so that
    the classes count as in all labelled training rows. A document with several
    labels is toxic if one says so; null labels and ids are left out."""
    known = (labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(toxic).cast("int").alias("toxic"))
             .filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(remainder("doc_id", MOD) != HELD_OUT)
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id")
    picked = {r["doc_id"]: r["toxic"] for r in known.withColumn("n", F.row_number().over(order))
              .filter(F.col("n") <= PER_CLASS).select("doc_id", "toxic").collect()}
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")) \
        .filter(F.col("doc_id").isin(list(picked)) if picked else F.lit(False)).filter(F.length("text") <= TRAIN_CHARS)
    sample = sorted(rows.dropDuplicates(["doc_id", "text"]).collect())
    y = [picked[r["doc_id"]] for r in sample]
    return fit([r["text"] for r in sample], y, tuple(total.get(c, 0) / max(1, y.count(c)) for c in (0, 1)))


def tagged(model: Model, texts: list[str | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Scores, and the spans of toxic tokens as (start, end) character offsets."""
    docs = [words_of(t) for t in texts]
    lengths = np.array([len(d) for d in docs], np.int64)
    p = marginals(model.unary([w for d in docs for w in d]), lengths, model.links)
    score = 1 / (1 + np.exp(-np.clip(_summary(p, lengths) @ model.document, -30, 30)))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    starts = np.cumsum(lengths) - lengths
    hits = np.flatnonzero(p >= SPAN_PROBABILITY)
    owner = np.searchsorted(starts, hits, side="right") - 1
    for d in np.unique(owner):
        places = [m.span() for m in _TOKEN.finditer(texts[d])]
        last = -2
        for k in (hits[owner == d] - starts[d]).tolist():
            if k == last + 1:
                spans[d][-1] = (spans[d][-1][0], places[k][1])
            else:
                spans[d].append(places[k])
            last = k
    return score, spans


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted, spans array<struct<start, end>>`` for
    every row; ``spans`` are character offsets of runs of toxic tokens.

    Null and empty texts get the score of a text without toxic tokens and no spans.
    Without labels of both classes there are no toxic words, and all scores are
    equal. Repeated rows are scored each, a null id gives a null ``held_out``, an
    empty table an empty result, other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)     # BUCKETS floats

    def run(batches):
        own = shared.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in slices(batches):
            s, spans = tagged(own, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)),
                 pa.array([[{"start": x, "end": y} for x, y in d] for d in spans], kind)],
                ["doc_id", "held_out", "score", "predicted", "spans"])

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                      (remainder(doc_id, MOD) == HELD_OUT).alias("held_out"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, "
                               "spans array<struct<start:int,end:int>>")
