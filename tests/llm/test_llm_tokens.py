"""Token counts (8) and SentencePiece (2) against the libraries and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from llm_cases import KIND, ROWS, empty, frame

from kestrel.llm import bpe_count, sentencepiece_nbest as S

SPEC = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
PROTO = open(P.path("piece_bpe_32k.model"), "rb").read()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return lambda s: len(t.encode(s or "", add_special_tokens=False).ids)


def test_counts_equal_the_library(library):
    r = random.Random(3)
    letters = list("aAbTthe sS'é́Σσςİı\x1c\x85\xa0 \t\n\r12²Ⅷ½😀中.,!?-_#") + [
        "<|endoftext|>", "<|startoftext|>", "'ll", "'RE", "ẞ", "\x00", "K"]
    own = bpe_count.counter(SPEC)
    for _ in range(3000):
        s = "".join(r.choice(letters) for _ in range(r.randint(0, 14)))
        assert own.count(s) == library(s), repr(s)


def test_small_memory_gives_the_same_counts(library, monkeypatch):
    monkeypatch.setattr(bpe_count, "CACHE_WORDS", 3)
    own = bpe_count.MergeCounter(bpe_count.json.loads(SPEC))
    texts = [t for _, t in ROWS]
    assert [own.count(t) for t in texts] == [library(t) for t in texts]


def test_count_frame(spark, library):
    got = sorted(map(tuple, bpe_count.token_counts(frame(spark), SPEC, limit=100).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), library(t), library(t) > 100) for i, t in ROWS), key=str)
    assert got == want
    assert bpe_count.token_counts(empty(spark), SPEC).collect() == []


def brute(model, text):
    """All segmentations with their scores, the best first."""
    u = "".join(model.units(text)).replace(" ", S.SPACE)
    out = []

    def go(j, score, ids):
        if j == 0:
            out.append((score, ids))
        else:
            for i, label, s in model.edges(u, j):
                go(i, score + s, label + ids)
    go(len(u), 0.0, b"")
    return sorted(out, key=lambda x: -x[0])


def test_n_best_equals_brute_force():
    r, model = random.Random(2), S.pieces(PROTO)
    for _ in range(400):
        text = "".join(r.choice("ab é\nth  in€.,&'-s(") for _ in range(r.randint(1, 9)))
        every, got = brute(model, text), model.encode(text, 5)
        assert [g[0] for g in got] == [b[0] for b in every[:5]]
        scores = dict((ids, s) for s, ids in every)
        assert all(scores[i] == s for s, i in got)
        assert len(scores) == len(every) and len({i for _, i in got}) == len(got)
        assert model.decode(got[0][1]) == text


def test_units_join_to_the_text_and_no_piece_spans_them():
    model = S.pieces(PROTO)
    pairs = {p[i:i + 2] for p in model.score for i in range(len(p) - 1)}
    r = random.Random(6)
    for _ in range(500):
        text = "".join(r.choice("ab é\n\tT.,:;!?&$%#*|-_'\"()[]{}<>/\\=+~`^@09漢€  ") for _ in range(r.randint(1, 30)))
        units = model.units(text)
        assert "".join(units) == " " + text
        marked = [u.replace(" ", S.SPACE) for u in units]
        assert all(a[-1] + b[0] not in pairs for a, b in zip(marked, marked[1:]))


def test_long_units_and_small_memory_agree(monkeypatch):
    model, text = S.pieces(PROTO), "thtion" * 300 + " the " + "é" * 50
    want = model.encode(text, 3)
    monkeypatch.setattr(S, "HELD_CHARS", 10)
    monkeypatch.setattr(S, "CACHE_UNITS", 0)
    model._forget(3)
    assert model.encode(text, 3) == want


def test_encode_frame(spark):
    rows = {(r["doc_id"], tuple(r["pieces"])): r for r in S.encode(frame(spark), PROTO, n=2).collect()}
    model = S.pieces(PROTO)
    for i, t in ROWS:
        ids = tuple(np.frombuffer(model.encode(t, 2)[0][1], np.int32).tolist())
        r = rows[(i, ids)]
        assert r["round_trip"] == ("▁" not in (t or "")) and r["n_pieces"] == len(ids)
        assert all(o["score"] <= r["score"] for o in r["others"])
    back = {r["doc_id"]: r["text"] for r in S.decode(S.encode(frame(spark), PROTO, n=1), PROTO).collect()}
    assert back[8] == dict(ROWS)[8] and back[13] == dict(ROWS)[13].replace("▁", " ")
    assert S.encode(empty(spark), PROTO).collect() == []


def test_digests(spark):
    model = S.pieces(PROTO)
    got = {r["doc_id"]: r for r in S.digests(frame(spark), PROTO).collect()}
    best = model.encode(dict(ROWS)[4], 3)
    assert got[4]["pieces_crc"] == zlib.crc32(best[0][1]) and got[4]["n_best"] == 3
    assert got[4]["last_score"] == best[2][0] <= got[4]["score"] == best[0][0]
    assert (got[5]["n_pieces"], got[5]["n_best"], got[5]["score"], got[5]["round_trip"]) == (0, 1, 0.0, True)
    assert S.digests(spark.createDataFrame([], KIND), PROTO).collect() == []
