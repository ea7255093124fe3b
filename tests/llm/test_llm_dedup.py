"""Exact (6) and near (3) duplicates against brute force."""

import collections
import hashlib
import re

import pytest
from conftest import SF001
from llm_cases import ROWS, empty, frame
from pyspark.sql import functions as F

from kestrel.llm import odd_sketch as O
from kestrel.llm import stream_dedup as D
from kestrel.llm.components import components


def test_exact_edges(spark):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = collections.defaultdict(list)
    for i, t in ROWS:
        groups[norm(t)].append(i)
    want = sorted(((i, min((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]),
                    hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in ROWS), key=str)
    rows = D.duplicates(frame(spark)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=str) == want
    kept = collections.Counter(r["text_sha256"] for r in rows if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])


def test_exact_empty(spark):
    assert D.duplicates(empty(spark)).collect() == []
    assert D.unique(empty(spark)).collect() == []


def test_equal_digests_of_unequal_texts(spark):
    """A digest of one letter: full bytes decide."""
    weak = lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)
    rows = [(k, f"text {k % 40}") for k in range(120)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in D.duplicates(frame(spark, rows), digest=weak).collect()}
    assert got == {k: (k % 40, 3, k < 40) for k in range(120)}


def test_unique_keeps_columns_and_one_row_of_each_text(spark):
    src = frame(spark)
    out = D.unique(src)
    assert out.columns == src.columns
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    texts = [norm(r["text"]) for r in out.collect()]
    assert sorted(texts) == sorted({norm(t) for _, t in ROWS})


def test_state_goes_on(spark, tmp_path):
    """A second run over new files meets the digests of the first."""
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    kind = "doc_id long, digest string, file string, row long"
    for rows in ([(5, "a", "f", 0), (6, "b", "f", 1)], [(2, "a", "g", 0), (9, "c", "g", 1)]):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(src)
        D.start(spark.readStream.schema(kind).parquet(src), out, check).awaitTermination()
    got = {r["digest"]: (r["keep"]["doc_id"], r["n"]) for r in D.entries(spark, out).collect()}
    assert got == {"a": (2, 2), "b": (6, 1), "c": (9, 1)}


def brute(rows, words):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(words, len(w))
        sets[i] = {b" ".join(w[k:k + n]) for k in range(len(w) - n + 1)} if w else set()
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_near_equals_brute_force(spark, words):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], words)
    rows = O.near_duplicates(docs, words).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_chains_of_near_copies(spark):
    """Each text is similar to its neighbours only; one long chain is one component."""
    base = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(base[5 * k:5 * k + 60])) for k in range(40)]
    want = brute(rows, 2)
    assert len({c for _, c in want.values()}) == 1
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in O.near_duplicates(frame(spark, rows), 2).collect()}
    assert got == want


def test_many_copies_around_the_threshold(spark, monkeypatch):
    """Copies of one text with edits: most pairs lie near 0.8, on either side."""
    import random
    r = random.Random(8)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(260):
        w = base.copy()
        for _ in range(r.choice([1, 3, 5, 6, 7, 8])):
            w[r.randrange(len(w))] = f"x{r.randrange(10 ** 6)}"
        rows.append((k, " ".join(w)))
    want = brute(rows, 2)
    assert 1 < len({c for _, c in want.values()}) < 200
    monkeypatch.setattr(O, "BLOCK", 16)                # each bucket in many blocks
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in O.near_duplicates(frame(spark, rows), 2).collect()}
    assert got == want


def test_near_edges(spark):
    known = [(i, t) for i, t in ROWS if i is not None]
    want = brute(known, 2)
    rows = O.near_duplicates(frame(spark), 2).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
    out = O.representatives(frame(spark), 2)
    assert out.columns == frame(spark).columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted((r["doc_id"] for r in rows if r["kept"]), key=str)
    assert O.near_duplicates(empty(spark)).collect() == []


def test_texts_that_share_an_id_are_one_node(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(5, a), (5, b), (1, a), (7, b)]
    got = {(r["doc_id"], r["component_id"]) for r in O.near_duplicates(frame(spark, rows), 2).collect()}
    assert got == {(5, 1), (1, 1), (7, 1)}


def test_estimates_follow_similarity():
    import numpy as np
    r = np.random.default_rng(0)
    for share in (0.6, 0.8, 0.95):
        errors = []
        for _ in range(60):
            n = 1000
            common = round(2 * n * share / (1 + share))
            x = np.unique(r.integers(0, 1 << 63, 2 * n - common, dtype=np.uint64))
            s = [np.frombuffer(O.signature(p)[1], np.uint64) for p in (x[:n], x[n - common:])]
            errors.append(O.estimate(np.bitwise_count(s[0] ^ s[1]).sum()) - share)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 30)] + [(40, 41), (41, 42), (50, 50), (None, 3), (60, 40)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, **{k: 40 for k in (40, 41, 42, 60)}}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
