"""Language ID (10), toxicity (9) and language-model scores (7): held-out accuracy, brute force, edges."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
from conftest import SF01
from llm_cases import ROWS, empty, frame
from pyspark.sql import functions as F

from kestrel.llm import crf_toxicity as T
from kestrel.llm import subword_langid as L
from kestrel.llm import suffix_tree_lm as M


def crc(i, mod):
    return None if i is None else zlib.crc32(str(i).encode()) % mod


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = {r["doc_id"]: r for r in L.identify(docs, L.train(docs)).collect()}
    held = [r for r in docs.collect() if crc(r["doc_id"], 4) == 2]
    assert all(got[r["doc_id"]]["held_out"] for r in held) and sum(x["held_out"] for x in got.values()) == len(held)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.98
    assert np.mean([x["rejected"] for x in got.values()]) < 0.01


def test_unlearned_languages_are_rejected(spark):
    """Each language left out of the training, random letters, and texts mixed of two learned languages."""
    docs = [r for r in spark.read.parquet(f"{SF01}/documents.parquet").collect() if r["text"]]
    learn = [r for r in docs if crc(r["doc_id"], 4) != 2 and len(r["text"]) <= L.TRAIN_CHARS]
    held = [r for r in docs if crc(r["doc_id"], 4) == 2]
    rejected = lambda model, texts: np.mean(L.predict(model, texts)[2])
    languages = sorted({r["lang"] for r in docs})
    for left_out in languages:
        some = [r for r in learn if r["lang"] != left_out][:600]
        model = L.fit([r["text"] for r in some], [r["lang"] for r in some])
        assert rejected(model, [r["text"] for r in held if r["lang"] == left_out]) >= 0.8
        assert rejected(model, [r["text"] for r in held if r["lang"] != left_out]) <= 0.02
    r = random.Random(3)
    letters = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(r.randint(60, 400))) for _ in range(200)]
    assert rejected(model, letters) >= 0.95
    learned = [x["text"].split() for x in held if x["lang"] != left_out]
    mixed = [" ".join(r.choice(learned)[:40] + r.choice(learned)[:40]) for _ in range(200)]
    assert rejected(model, mixed) <= 0.02


def test_language_sample_with_null_and_repeated_ids(spark):
    rows = [(None, f"wort haus baum nummer {chr(97 + k)}", "de") for k in range(5)] + [(7, "word house tree", "en")] * 4 + [(None, "wort haus baum nummer a", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(docs)
    assert model.languages == ["de", "en"] or crc(7, 4) == 2
    assert len(L.identify(docs, model).collect()) == len(rows)


def test_language_edges(spark):
    model = L.train(frame(spark))
    assert model.languages == ["a", "b"]
    rows = L.identify(frame(spark), model).collect()
    assert len(rows) == len(ROWS)
    for r, (i, t) in zip(rows, ROWS):
        assert r["doc_id"] == i and r["held_out"] == (None if i is None else crc(i, 4) == 2)
        letters = any(c.isalpha() for c in t or "")
        assert (r["lang_pred"] == "und") == (not letters) and (0 < r["score"] <= 1 if letters else r["score"] == 0)
        assert letters or r["rejected"]
    kept = L.accepted(frame(spark), model)
    assert kept.columns == frame(spark).columns and kept.count() == sum(not r["rejected"] for r in rows)
    assert L.identify(empty(spark), model).collect() == []
    nothing = L.train(empty(spark))
    assert {r["lang_pred"] for r in L.identify(frame(spark), nothing).collect()} == {"und"}


def test_language_word_memory_is_bounded(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("abcdefgh") for _ in range(6)) + " " for _ in range(300)]
    model = L.fit(texts[:40], ["x", "y"] * 20)
    want = L.raw(model, [L.words_of(t) for t in texts])
    model.table.limit = 7
    model.table._reset()
    got = np.vstack([L.raw(model, [L.words_of(t)]) for t in texts])
    assert np.allclose(got, want, atol=1e-5) and len(model.table.slot) <= 7


def test_language_keeps_no_words_behind_a_task(spark, monkeypatch):
    """Words that a task keeps are few, are forgotten at its end, and unused memory goes back."""
    model = L.fit(["some text with words"] * 20, ["x", "y"] * 10)
    L.raw(model, [[b"<word>"]])
    assert model.table.limit <= 1 << 16
    calls, frames = [], []
    monkeypatch.setattr(L, "give_back", lambda: calls.append(model.table))
    monkeypatch.setattr(L, "_shared", lambda docs, m: type("Shared", (), {"value": m}))

    class Docs:
        columns, schema = ["doc_id", "text"], None
        mapInArrow = lambda self, run, schema: frames.extend(run([pa.record_batch({"doc_id": [1, 2], "text": ["words and text", None]})]))

    L.accepted(Docs(), model)
    assert calls == [None] and sum(b.num_rows for b in frames) <= 2


def test_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    for lengths in ([3, 0, 5], [7], [1, 1, 0]):
        u, links = r.normal(0, 2, sum(lengths)), np.exp(r.normal(0, 1, (2, 2)))
        want, at = [], 0
        for n in lengths:
            q, z = np.zeros(n), 0.0
            for s in itertools.product((0, 1), repeat=n):
                w, before = 1.0, 0
                for t, x in enumerate(s):
                    w *= links[before, x] * (math.exp(u[at + t]) if x else 1)
                    before = x
                z, q = z + w, q + w * np.array(s)
            want += list(q / z)
            at += n
        for size in (2, 3, 128):                       # also as chains of several blocks
            default, T.cut.__defaults__ = T.cut.__defaults__, (size,)
            try:
                assert np.allclose(T.marginals(u, np.array(lengths), links), want)
            finally:
                T.cut.__defaults__ = default


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    label = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = T.score(docs, T.train(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(r["score"], r["predicted"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    toxic, clean = [h for h in held if h[2]], [h for h in held if not h[2]]
    assert np.mean([h[1] for h in toxic]) > 0.85 and np.mean([h[1] for h in clean]) < 0.04
    wins = np.mean([a[0] > b[0] for a in toxic for b in clean])
    assert wins > 0.9


def test_toxicity_edges(spark):
    bad = [(100 + k, f"some text {k} with awful, words here") for k in range(60)]
    good = [(200 + k, f"some text {k} with kind words here") for k in range(60)]
    labels = spark.createDataFrame([(i, 1, "x") for i, _ in bad] + [(i, 0, "x") for i, _ in good] + [(None, 1, "x"), (1, None, "x")],
                                   "doc_id long, toxic int, text string")
    docs = frame(spark, ROWS + bad + good)
    model = T.train(docs, labels)
    rows = T.score(docs, model).collect()
    assert len(rows) == len(ROWS) + 120
    texts = dict(bad + good)
    for r in rows:
        if r["doc_id"] in dict(bad):
            t = texts[r["doc_id"]]
            assert r["predicted"] == 1 and [t[s["start"]:s["end"]] for s in r["spans"]] == ["awful,"]
        elif r["doc_id"] in dict(good):
            assert r["predicted"] == 0 and r["spans"] == []
    blank = {r["score"] for r in rows if r["doc_id"] in (5, 6, 7)}
    assert len(blank) == 1 and blank.pop() < 0.3
    assert T.score(empty(spark), model).collect() == []
    unlabelled = T.train(docs, labels.limit(0))
    assert len({round(r["score"], 9) for r in T.score(docs, unlabelled).collect()}) == 1


def base_scores(rows, learns):
    c = collections.Counter()
    for i, t in rows:
        if learns(i):
            c.update((t or "").encode().lower().split() + [b""])
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split() + [b""]
        out.append((i, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)))
    return out


def test_lm_edges_and_base_score(spark):
    learns = lambda i: crc(i, 7) != 2
    for frequent in (M.FREQUENT_WORDS, 5, 0):           # with most words through the shuffle, too
        rows = M.score(frame(spark), frequent=frequent).collect()
        got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows), key=str)
        assert got == sorted(base_scores(ROWS, learns), key=str)
    assert M.score(empty(spark)).collect() == []
    only_held = [(i, "a b a") for i in range(300) if crc(i, 7) == 2]
    assert {(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in M.score(frame(spark, only_held)).collect()} == {(0, 0, 0.0, 0.0)}


def test_lm_equals_direct_tree(spark):
    """Scores against a tree grown from plain counts in Python."""
    r = random.Random(5)
    after = {"aa": "bbbc", "ab": "aac", "ac": "abcd", "ba": "cccb", "bb": "a", "bc": "dda", "ca": "a", "cb": "bbbd", "cc": "ab",
             "cd": "a", "da": "bc", "db": "c", "dd": "a"}
    rows = []
    for i in range(400):
        w = ["a", "b"]
        for _ in range(r.randint(3, 60)):
            w.append(r.choice(after.get(w[-2] + w[-1], "abc")))
        rows.append((i, " ".join(w) + (" rare%d" % i if i % 9 == 0 else "")))
    learn = [t.split() + [""] for i, t in rows if crc(i, 7) != 2]
    c = collections.Counter(x for t in learn for x in t)
    n, v = sum(c.values()), len(c)
    once, twice = (sum(k == m for k in c.values()) for m in (1, 2))
    cut = min(0.9, max(0.1, once / (once + 2 * twice)))
    chance = lambda w: ((c[w] - cut) if c[w] else cut * v) / n
    trees = {}

    def p(x, w):
        """Chance of ``w`` after the words ``x``, from the longest retained suffix of ``x``."""
        while x and x not in trees:
            x = x[1:]
        if not x:
            return chance(w)
        listed, factor = trees[x]
        return listed[w] if w in listed else factor * p(x[1:], w)

    for d in range(1, M.DEPTH + 1):
        count = collections.defaultdict(collections.Counter)
        for t in learn:
            for k in range(d, len(t)):
                count[tuple(t[k - d:k])][t[k]] += 1
        for x, row in count.items():
            total = sum(row.values())
            row = {w: m for w, m in row.items() if m >= M.LEAST_FOLLOWER}
            if total < M.LEAST_CONTEXT or not row:
                continue
            below = {w: p(x[1:], w) for w in row}
            rest, room, k = total - sum(row.values()), max(1e-9, 1 - sum(below.values())), len(row) + 1
            gain = sum(m * math.log(m / total / below[w]) for w, m in row.items()) + (rest * math.log(rest / total / room) if rest else 0)
            if gain >= M.LEAST_GAIN * (len(row) + (rest > 0)):
                trees[x] = {w: (m + k * below[w]) / (total + k) for w, m in row.items()}, (rest + k * room) / (total + k) / room
    assert {1, 2, 3} <= {len(x) for x in trees}
    for x in trees:                                      # distributions over all words and one unknown
        assert abs(sum(p(x, w) for w in c) + p(x, "unknown") - 1) < 1e-6
    for frequent, frequent_rows in ((M.FREQUENT_WORDS, M.FREQUENT_ROWS), (2, 12), (0, 0)):    # held rows, some and all through the shuffle
        got = M.score(frame(spark, rows), frequent=frequent, frequent_rows=frequent_rows).collect()
        assert len(got) == len(rows)
        for r in got:
            t = dict(rows)[r["doc_id"]].split() + [""]
            want = sum(math.log10(p(tuple(t[max(0, k - M.DEPTH):k]), w)) for k, w in enumerate(t))
            assert abs(r["score"] - want) < 1e-6 * abs(want), r


def test_lm_rounds_score_all_texts_and_hold_a_share(spark, monkeypatch):
    """Rare rows are met in several rounds, which leave nothing behind; a share of a small tree goes through the shuffle."""
    r = random.Random(5)
    texts = [" ".join(r.choices(["a", "b", "c", "d"], [8, 4, 2, 1], k=r.randint(0, 30))) for _ in range(300)]
    rows = [(None if k % 50 == 0 else k // 2, None if k % 40 == 0 else t) for k, t in enumerate(texts)]
    rooms, folders = [], []
    commonest, written = M.commonest, M.written
    monkeypatch.setattr(M, "commonest", lambda t, room: (rooms.append((t.count(), room)), commonest(t, room))[1])
    monkeypatch.setattr(M, "written", lambda df, name: (folders.append(name), written(df, name))[1])
    flat = lambda got: sorted((str(x["doc_id"]), x["n_tokens"], x["n_known"], round(x["base_score"], 6), round(x["score"], 5)) for x in got)
    want = flat(M.score(frame(spark, rows)).collect())
    assert rooms[-1][0] > 4 and rooms[-1][1] == rooms[-1][0] // 2 and folders.count("parts") == 1
    folders.clear()
    monkeypatch.setattr(M, "FREQUENT_ROWS", 1)
    monkeypatch.setattr(M, "ROUNDS", 2)
    assert flat(M.score(frame(spark, rows)).collect()) == want and len(want) == len(rows)
    assert folders.count("parts") == folders.count("scores") == 2


def test_lm_tree_grows_with_the_text(spark):
    def tree(sf):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
        words = M.word_counts(docs)
        n = M.root(words)[0]
        known = words.filter("c > 0").select(F.col("key").alias("gram"), F.col("c").alias("n"), F.log10(F.col("c") / n).alias("root"))
        return M.grow(docs, known).count()
    assert tree("sf0.1") >= 5 * tree("sf0.01")


def test_lm_marks(spark):
    keys = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63 - 1, 3000)
    df = spark.createDataFrame([(int(k),) for k in keys], "key long")
    other = np.random.default_rng(2).integers(0, 2 ** 64 - 1, 3000, np.uint64)
    for got in (M.marks(df), M.marks(df, 12)):
        assert got.hold(keys.view(np.uint64)).all()
    assert M.marks(df).hold(other).mean() < 0.15 and not M.marks(df.limit(0)).hold(other).any()
    table = M.Table(np.sort(keys.view(np.uint64)))
    assert (table.key[table.find(keys.view(np.uint64))] == keys.view(np.uint64)).all() and (table.find(other) == -1).all()


def test_lm_token_keys(monkeypatch):
    """Equal words have equal keys, others different ones, wherever blocks and slices cut."""
    texts = [t for _, t in ROWS] + ["a\u00a0b \x1c c", " x", "x ", "ab a b"]
    for block in (1 << 20, 1, 50):
        monkeypatch.setattr(M, "BLOCK_BYTES", block)
        for column in (pa.array(texts), pa.array(["zz z", *texts, "q"]).slice(1, len(texts))):
            key, lengths = M.token_keys(column)
            words = [w for t in texts for w in [*(t or "").encode().lower().split(), b""]]
            assert lengths.tolist() == [len((t or "").encode().split()) + 1 for t in texts] and len(key) == len(words)
            assert len(set(zip(words, key.tolist()))) == len(set(words)) == len(set(key.tolist()))
    assert [len(x) for x in M.token_keys(pa.array([], pa.string()))] == [0, 0]


def test_lm_beats_the_base_on_held_out_texts(spark):
    rows = [r for r in M.score(spark.read.parquet(f"{SF01}/documents.parquet")).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > 0.9 * sum(r["base_score"] for r in rows)
    assert rows


def test_counted_tokens_are_held_once():
    import tracemalloc
    n, k = 1 << 16, 8
    batches = [pa.record_batch([pa.array(["x"])], ["text"])] * k
    tracemalloc.start()
    try:
        at = tracemalloc.get_traced_memory()[0]
        own, = [(tracemalloc.get_traced_memory()[0] - at, len(own[0])) for own in M.gathered(batches, lambda b: [np.zeros(n, np.uint64) for _ in range(3)])]
    finally:
        tracemalloc.stop()
    assert own[1] == n * k
    assert own[0] < 1.3 * 3 * 8 * n * k


def test_lm_grams_of_rare_and_frequent_words_are_counted(spark):
    """Counts of grams that travel as places of frequent words and as keys, and of both in one table."""
    r = random.Random(3)
    rows = [(k, " ".join(r.choices("abcdefgh", [30, 20, 10, 8, 6, 4, 2, 1], k=r.randint(0, 30)))) for k in range(400)]
    learn = [t.split() + [""] for k, t in rows if crc(k, 7) != 2]
    docs, found = frame(spark, rows), []
    words = M.word_counts(docs).select(F.col("key").alias("gram"), F.col("c").alias("n"), F.lit(-1.0).alias("root")).filter("n > 0").localCheckpoint()
    every = M.marks(words.select("gram"))
    for room in (0, 3, M.FREQUENT_WORDS):
        least = M.commonest(words, room)
        (top,) = M.sorted_rows(words.filter(F.floor(F.log2("n") * 8) >= F.lit(least)).select("gram").toArrow())
        assert len(top) == min(len(top), room) and (room < 3 or len(top) > 1)
        shared = spark.sparkContext.broadcast((every, every, M.Table(top)))
        found.append(sorted((x["gram"], x["ctx"], x["below"], x["n"]) for x in M.pair_counts(docs, "doc_id", "text", 1, shared, 5).collect()))
    pairs = collections.Counter(p for t in learn for p in zip(t, t[1:]))
    assert found[0] == found[1] == found[2] and sorted(x[3] for x in found[0]) == sorted(n for n in pairs.values() if n >= 5)
    key = np.sort(np.random.default_rng(1).integers(0, 2 ** 64 - 1, 1000, np.uint64))
    for n in (1000, 1):
        again = M.unpacked(M.packed(key[:n], np.arange(n) + 1), n)
        assert (again[0] == key[:n]).all() and (again[1] == np.arange(n) + 1).all()


def test_lm_counts_each_length_in_one_pass(spark):
    """A pass over the texts for the words, one for each length, and one that scores; none is run again."""
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        passes.add(1)
        yield from batches

    r = random.Random(5)
    docs = frame(spark, [(k, " ".join(r.choices("abcd", k=30))) for k in range(400)]).select("doc_id", "text").coalesce(1)
    M.score(docs.mapInArrow(counted, docs.schema)).write.format("noop").mode("overwrite").save()
    assert passes.value == 1 + M.DEPTH + 1


def test_lm_broadcasts_go_with_their_step(spark, monkeypatch):
    """Neither the driver nor executors keep the tables of a length, or of the scores, once texts have met them."""
    made, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: (made.append(broadcast(self, value)), made[-1])[1])
    r = random.Random(5)
    found = M.score(frame(spark, [(k, " ".join(r.choices("abcd", k=30))) for k in range(400)]))
    assert len(made) == M.DEPTH + 1 and not any(x._jbroadcast.isValid() for x in made)
    assert found.count() == 400
