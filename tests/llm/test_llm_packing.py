"""Packing (12): ids against the library, the plan and the query against their contracts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest

from llm_cases import KIND, ROWS, empty, frame

from kestrel.llm import window_packing as W

SPEC = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return lambda s: [*t.encode(s or "", add_special_tokens=False).ids, 1]


def test_ids_equal_the_library(library, monkeypatch):
    r = random.Random(5)
    letters = list("aAbTthe sS'é́Σσςİı\x1c\x85\xa0 \t\n\r\x0b\x0c12²Ⅷ½😀中.,!?-_# 　") + [
        "<|endoftext|>", "<|startoftext|>", "'ll", "'RE", "ẞ", "\x00", "K"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(4000)] + [None, "", " "]
    own = W.WordIds(SPEC)
    monkeypatch.setattr(W, "CACHE_IDS", 500)            # words are forgotten on the way
    for i in range(0, len(texts), 600):
        some = texts[i:i + 600]
        ids, sizes = own.encode(pa.array(some, pa.string()))
        want = [library(t) for t in some]
        assert sizes.tolist() == list(map(len, want))
        assert ids.tolist() == [x for w in want for x in w]


def histograms():
    r = np.random.default_rng(3)
    for window in (2, 16, 64, 2048):
        for n in (0, 1, 7, 300, 20_000):
            yield window, np.bincount(np.minimum(window - 1, r.exponential(window / 4, n).astype(int)), minlength=window)
            yield window, np.bincount(r.integers(window // 2, window, n), minlength=window)
    hot = np.zeros(2048, int)
    hot[[1, 3, 1025, 2000]] = 10**6, 10**6, 33_333, 10**5
    yield 2048, hot


@pytest.mark.parametrize("window,counts", list(histograms()))
def test_plan_uses_every_id_once_without_padding(window, counts):
    plan = W.Plan(counts, window)
    if counts.sum() > 10**6:
        small = W.Plan(counts // 1000, window)          # a plan doesn't grow with the documents
        assert len(plan.rows) < 2 * len(small.rows) + 1000
        plan, counts = small, counts // 1000
    length = np.repeat(np.arange(window), counts)
    number = np.concatenate([np.arange(c) for c in counts])
    number, length = number[length > 0], length[length > 0]
    at, done, size, sequence, offset = W.pieces_of(plan.table(), length, number)
    gapless(at, done, size, length)
    totals = np.bincount(sequence, weights=size, minlength=plan.windows).astype(int)
    gapless(sequence, offset, size, totals)
    assert ((totals == window) | ((totals > 0) & (totals & (totals - 1) == 0))).all()
    assert (totals < window).sum() <= window.bit_length()


def gapless(group, start, size, totals):
    order = np.lexsort((start, group))
    end = {}
    for g, s, n in zip(group[order].tolist(), start[order].tolist(), size[order].tolist()):
        assert s == end.get(g, 0) and n > 0
        end[g] = s + n
    assert end == {g: t for g, t in enumerate(totals.tolist()) if t}


def test_least_squares_uses_most_of_a_dense_histogram():
    counts = np.random.default_rng(1).integers(500, 900, 2048)
    counts[0] = 0
    combos = W.combinations(counts, 2048)
    assert (combos.sum(axis=1) == 2048).all() and len({tuple(c) for c in combos.tolist()}) == len(combos)
    x = W.repeats(counts, combos)
    used = np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=2048)
    used[0] = 0
    assert (x >= 0).all() and abs(used - counts).sum() < 0.5 * counts.sum()
    # no single repeat count can be changed for the better (the conditions of the optimum), nearly
    gradient = ((used - counts)[combos] * (combos > 0)).sum(axis=1)
    assert gradient.min() > -40 and abs(gradient[x > 1]).max() < 40
    plan = W.Plan(counts)
    cut = len(plan.rows)
    assert plan.combined > 0.2 * plan.windows and cut < 40_000


def check(rows, pieces, library, window=2048):
    """``rows``: (doc_id, text). Every id of every document stands once, in order, somewhere."""
    docs = {}
    for i, t in rows:
        ids = library(t)
        docs.setdefault(i, []).append(ids)
    got = {}
    for p in pieces:
        got.setdefault(p["doc_id"], []).append(p)
    assert set(got) == set(docs)
    for i, all_ids in docs.items():
        assert len({len(x) for x in all_ids}) == 1 or i in (None,)
        want = sorted((len(x), sum(x)) for x in all_ids)
        sums = sorted((p["doc_tokens"], p["start"], p["length"]) for p in got[i])
        assert sum(p["length"] for p in got[i]) == sum(n for n, _ in want)
        if len(all_ids) == 1:
            ids, at = np.array(all_ids[0], "<u4"), 0
            for total, start, length in sums:
                assert start == at and total == len(ids)
                at += length
            for p in got[i]:
                assert p["ids_crc32"] == zlib.crc32(ids[p["start"]:p["start"] + p["length"]].tobytes())
    places = {}
    for p in pieces:
        places.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    short = 0
    for s in places.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)
        short += at < window
    assert short <= window.bit_length()


@pytest.mark.parametrize("window", [8, 64, 2048])
def test_query_keeps_every_id(spark, library, window):
    pieces = W.pack(frame(spark), SPEC, window).collect()
    check(ROWS, pieces, library, window)


def test_empty_table(spark):
    assert W.pack(empty(spark), SPEC).collect() == []
    assert W.pack(spark.createDataFrame([(1, None)], "doc_id long, text string"), SPEC).collect()[0]["length"] == 1
    assert KIND


def test_all_given_documents(spark, library):
    from __spark_entry__ import queries
    src = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    check([tuple(r) for r in src], queries()["op12_packing"](spark, "/root/testdata/sf0.01").collect(), library)
