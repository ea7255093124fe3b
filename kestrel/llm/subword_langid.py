"""Language identification: averaged hashed subword embeddings, a linear softmax,
stochastic gradient descent in numpy, calibrated rejection.

A text's vector is the mean of the embeddings of the hashed byte n-grams of its
words. As the softmax is linear, a word adds a fixed vector of logits, so a task
computes each word once. Training takes a bounded sample of labelled rows.

The softmax only tells learned languages apart, and is sure of texts in others. Rejection
therefore also asks how usual the n-grams of a text's letters are in all learned languages
together: texts mixed of two of them are, other languages and random letters aren't. Digits
and marks belong to no language and don't count. The bound lies between
held-back pieces and negatives: pieces of each language under the counts of the others, and
pieces whose words have their letters shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import WordTable, give_back, hold, ngram_hashes, remainder, segment_sums, slices

UNKNOWN = "und"
#: Training sample: at most so many documents of each language, and no more in all than so many
#: languages would give, none longer than this. Bounds the driver's data; scoring has no bound.
PER_LANGUAGE, LANGUAGES, TRAIN_CHARS = 250, 256, 20_000
BUCKETS, DIMENSIONS, SIZES = 1 << 16, 16, (1, 2, 3, 4)
#: Words of a training example: texts are cut into pieces so that short texts are learned too.
PIECE_WORDS = 24
EPOCHS, RATE = 4, 2.0
#: Share of the calibration pieces that rejection may cost, and the probability that always passes.
REJECTED_SHARE, SURE = 0.001, 0.4
#: Shares of the negatives that the bound on familiarity should reject, and of the pieces that it may cost
#: where both overlap (whole texts are more even than pieces and lose less); usual n-grams that every text
#: is given besides its own: few words are too little to reject a text by.
NEGATIVES_SHARE, STRANGE_SHARE, PRIOR = 0.99, 0.005, 40
#: Words that a task keeps, and bytes of text that it takes at once.
WORDS, TEXT_BYTES = 1 << 16, 1 << 19
MOD, HELD_OUT = 4, 2


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray                       # (BUCKETS, languages): embedding times softmax weights
    temperature: float = 1.0
    threshold: float = SURE
    familiar: np.ndarray | None = None       # log frequency of each bucket over all languages
    usual: float = 0.0                       # its mean in known texts
    least: float = -np.inf                   # texts below it are rejected
    table: WordTable | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "table": None}

    def forget(self) -> None:
        self.table = None


def words_of(text: str) -> list[bytes]:
    """Lower-cased words with border marks."""
    return [b"<" + w + b">" for w in text.lower().encode("utf-8", "replace").split()]


_NO_LETTERS = bytes(i for i in range(128) if not chr(i).isalpha())
_DIGIT = re.compile(rb"[0-9]")


def letters(words: list[bytes]) -> list[bytes]:
    """Words with border marks without ASCII marks inside; nothing is left of words with digits."""
    cores = (b"" if _DIGIT.search(w) else w.translate(None, _NO_LETTERS) for w in words)
    return [b"<" + c + b">" if c else b"" for c in cores]


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams, and the word of each."""
    h, owner = ngram_hashes(words, SIZES)
    return (h % np.uint64(BUCKETS)).astype(np.int64), owner


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], seed: int = 1) -> Model:
    """Trains on texts with labels: pieces of ``PIECE_WORDS`` words, a fifth of
    them held back for the temperature and the rejection threshold."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    code = {v: i for i, v in enumerate(languages)}
    pieces, y = [], []
    for text, label in zip(texts, labels):
        w = words_of(text)
        for i in range(0, len(w), PIECE_WORDS):
            pieces.append(w[i:i + PIECE_WORDS])
            y.append(code[label])
    rng = np.random.default_rng(seed)
    y = np.array(y, np.int64)
    order = rng.permutation(len(pieces))
    n_cal = len(pieces) // 5
    cal, fit_on = order[:n_cal], order[n_cal:]
    emb = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    soft = np.zeros((DIMENSIONS, len(languages)), np.float32)
    step, steps, size = 0, max(1, EPOCHS * -(-len(fit_on) // 64)), 64
    for _ in range(EPOCHS):
        rng.shuffle(fit_on)
        for at in range(0, len(fit_on), size):
            rows = fit_on[at:at + size]
            flat = [w for r in rows for w in pieces[r]]
            if not flat:
                continue
            doc = np.repeat(np.arange(len(rows)), [len(pieces[r]) for r in rows])
            bucket, owner = subwords(flat)
            order2 = np.argsort(doc[owner], kind="stable")
            bucket, of = bucket[order2], doc[owner][order2]
            n = np.bincount(of, minlength=len(rows))
            mean = (segment_sums(emb[bucket], n) / np.maximum(n, 1)[:, None]).astype(np.float32)
            grad = _softmax(mean @ soft)
            grad[np.arange(len(rows)), y[rows]] -= 1
            rate = RATE * (1 - step / steps) + 0.01
            back = (grad @ soft.T) / np.maximum(n, 1)[:, None]
            soft -= rate * (mean.T @ grad) / len(rows) * 4
            np.subtract.at(emb, bucket, (rate * back)[of].astype(np.float32))
            step += 1
    model = Model(languages, emb @ soft)
    if len(cal):
        z = raw(model, [pieces[i] for i in cal])
        model.temperature = _temperature(z, y[cal])
        top = _softmax(z / model.temperature).max(axis=1)
        model.threshold = float(min(SURE, np.quantile(top, REJECTED_SHARE)))
        _calibrate(model, pieces, y, fit_on, cal, rng)
    model.table = None
    return model


def _calibrate(model: Model, pieces: list[list[bytes]], y: np.ndarray, fit_on: np.ndarray, cal: np.ndarray, rng) -> None:
    """Familiarity and its bound. Languages weigh the same. Where negatives and known pieces overlap, the
    bound costs the known ones ``STRANGE_SHARE``."""
    count = np.zeros((len(model.languages), BUCKETS))
    for k in range(len(model.languages)):
        count[k] = np.bincount(subwords(letters([w for r in fit_on[y[fit_on] == k] for w in pieces[r]]))[0], minlength=BUCKETS)
    share = (count + 0.5) / (count + 0.5).sum(axis=1, keepdims=True)
    model.familiar = np.log(share.mean(axis=0))
    own = {r: letters(pieces[r]) for r in cal}
    familiar = lambda table, docs: _familiarity(*_log_frequency(table, docs), model.usual)
    sums, n = _log_frequency(model.familiar, list(own.values()))
    model.usual = float(sums.sum() / max(1, n.sum()))
    known = _familiarity(sums, n, model.usual)
    shuffled = [[b"<" + bytes(rng.permutation(np.frombuffer(w[1:-1], np.uint8))) + b">" for w in d if w] for d in own.values()]
    strangers = [familiar(model.familiar, shuffled)]
    if len(model.languages) > 1:
        total = share.sum(axis=0)
        strangers += [familiar(np.log((total - share[k]) / (len(share) - 1)), [own[r] for r in cal[y[cal] == k]])
                      for k in range(len(model.languages))]
    bound = float(np.quantile(known, STRANGE_SHARE))
    strange = max(float(np.quantile(x, NEGATIVES_SHARE)) for x in strangers if len(x))
    model.least = (bound + strange) / 2 if strange < bound else bound


def _familiarity(sums: np.ndarray, n: np.ndarray, usual: float) -> np.ndarray:
    return (sums + PRIOR * usual) / (n + PRIOR)


def _log_frequency(table: np.ndarray, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``table`` over the n-grams of each document, and their number."""
    bucket, owner = subwords([w for d in docs for w in d])
    of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])[owner]
    return np.bincount(of, table[bucket], minlength=len(docs)), np.bincount(of, minlength=len(docs))


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that makes held-back labels likeliest (grid)."""
    best, at = np.inf, 1.0
    for t in np.geomspace(0.05, 20, 61):
        loss = -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
        if loss < best - 1e-9:
            best, at = loss, float(t)
    return at


def sums_of(model: Model, docs: list[list[bytes]]) -> np.ndarray:
    """Sums over documents given as word lists: logits and their number of n-grams, then log frequency
    of the letters' n-grams and their number."""
    if model.table is None:
        familiar = np.zeros(BUCKETS) if model.familiar is None else model.familiar

        def over(values, words):
            bucket, owner = subwords(words)
            order = np.argsort(owner, kind="stable")
            n = np.bincount(owner, minlength=len(words))
            return np.hstack([segment_sums(values[bucket[order]], n), n[:, None]])
        model.table = WordTable(model.logits.shape[1] + 3, lambda words: np.hstack([over(model.logits, words),
                                                                                   over(familiar[:, None], letters(words))]), WORDS)
    slots = model.table.slots([w for d in docs for w in d])
    return segment_sums(model.table.values[slots], np.array([len(d) for d in docs], np.int64))


def raw(model: Model, docs: list[list[bytes]]) -> np.ndarray:
    """Mean logits of documents (zeros without words)."""
    sums = sums_of(model, docs)
    return _means(sums)


def _means(sums: np.ndarray) -> np.ndarray:
    return sums[:, :-3] / np.maximum(sums[:, -3:-2], 1)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learns from rows with a non-null language whose crc32(id) mod 4 is not 2
    (a null id counts as training). The sample: at most ``PER_LANGUAGE`` rows of
    each language in the order of a hash; of more than ``LANGUAGES`` languages, the first
    rows of each until there are ``PER_LANGUAGE * LANGUAGES``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")) \
        .filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= TRAIN_CHARS)
                & (F.coalesce(remainder("doc_id", MOD), F.lit(0)) != HELD_OUT))
    hashed = F.xxhash64("doc_id", F.lit("langid"))
    # ids first: texts are read only for the sample; rows without an id are told apart by their text
    rows = rows.withColumn("t", F.xxhash64("text"))
    picked = (rows.select("doc_id", "lang", "t", hashed.alias("h"))
              .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "t")))
              .filter(F.col("n") <= PER_LANGUAGE)
              .orderBy("n", "lang").limit(PER_LANGUAGE * LANGUAGES).select("doc_id", "lang", "t").alias("p"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("doc_id", "lang", "t")]
    sample = rows.alias("r").join(F.broadcast(picked), same, "left_semi") \
        .dropDuplicates(["doc_id", "lang", "t"]).orderBy("doc_id", "lang", "t").collect()
    return fit([r["text"] for r in sample], [r["lang"] for r in sample])


_LETTER = regex.compile(r"\p{L}")


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, calibrated probability and rejection of each text."""
    ok = np.array([bool(model.languages) and t is not None and _LETTER.search(t) is not None for t in texts], bool)
    lang = [UNKNOWN] * len(texts)
    score, strange = np.zeros(len(texts)), np.zeros(len(texts), bool)
    at = np.flatnonzero(ok)
    if len(at):
        sums = sums_of(model, [words_of(texts[i]) for i in at])
        p = _softmax(_means(sums) / model.temperature)
        strange[at] = _familiarity(sums[:, -2], sums[:, -1], model.usual) < model.least
        top = p.argmax(axis=1)
        score[at] = p[np.arange(len(at)), top]
        for i, k in zip(at, top):
            lang[i] = model.languages[k]
    return lang, score, ~ok | (score < model.threshold) | strange


def _shared(docs: DataFrame, model: Model):
    return docs.sparkSession.sparkContext.broadcast(model)    # BUCKETS x languages floats


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` for every row.

    ``und`` with score 0 where the text is null or has no letter, or when nothing
    was learned; such rows are rejected, and so are texts whose calibrated
    probability or familiarity is below the model's bounds. Equal probabilities: the language
    first in alphabetical order. Repeated rows are scored each, a null id gives a
    null ``held_out``, an empty table an empty result, other columns are not read."""
    shared = _shared(docs, model)

    def run(batches):
        own = shared.value
        hold("language", own.forget)
        for b in slices(batches, most_bytes=TEXT_BYTES):
            lang, score, rejected = predict(own, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"])
        own.forget()
        give_back()

    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                      (remainder(doc_id, MOD) == HELD_OUT).alias("held_out"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    shared = _shared(docs, model)
    at = docs.columns.index(text)

    def run(batches):
        own = shared.value
        hold("language", own.forget)
        for b in slices(batches, at, most_bytes=TEXT_BYTES):
            _, _, rejected = predict(own, b.column(at).to_pylist())
            yield b.filter(pa.array(~rejected))
        own.forget()
        give_back()

    return docs.mapInArrow(run, docs.schema)
