"""Phrase collocations (11) against plain counting."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from llm_cases import ROWS, empty, frame

from kestrel.llm import phrase_graph as G

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(docs):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    return f, n


def brute(docs, least, top):
    f, n = counts(docs)
    out, by_lang = [], {}
    long = [(lang, p, c) for (lang, p), c in f.items() if len(p) == 3 and c >= least]
    for (lang, p), a in f.items():
        if len(p) == 1 or a < least:
            continue
        if len(p) == 2 and any(o == lang and p in (q[:2], q[1:]) and 100 * c >= 50 * a for o, q, c in long):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    for lang, found in by_lang.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r)[:8] for r in df.collect())


def texts(seed, n):
    r = random.Random(seed)
    word = ["a", "B", "c", "dé", "É", "e\x0b", "x y", "\x1cz", "it's", "no.", "well,", "\n", "\t", "", "漢"]
    passage = "We met at The old mill by night and left before dawn"
    out = []
    for _ in range(n):
        t = " ".join(r.choice(word) for _ in range(r.randint(0, 40)))
        out.append((r.choice(["en", "en", "en", None, "fr"]), t + (" " + passage if r.random() < 0.3 else "")))
    return out


KIND = "lang string, text string, x string, y string, z string, n long, f long, rank long, phrase string, before string"


def rows(spark, docs):
    return spark.createDataFrame([(*d, "x", "y", "z", 1, 2, 3, "p", "b") for d in docs], KIND).repartition(3)


@pytest.mark.parametrize("bits", [G.MARK_BITS, 10])
def test_equals_plain_counting(spark, bits, monkeypatch):
    docs = texts(1, 150)
    monkeypatch.setattr(G, "MARK_BITS", bits)           # hashes that meet change nothing
    monkeypatch.setattr(G.graph, "__defaults__", (*G.graph.__defaults__[:-1], bits))
    want = brute(docs, 10, 2000)
    assert got(G.collocations(rows(spark, docs))) == want and len(want) > 40


def test_small_slices_and_a_short_list(spark, monkeypatch):
    docs = texts(2, 120)
    monkeypatch.setattr(G, "GRAPH_BYTES", 100)
    assert got(G.collocations(rows(spark, docs), least=3, top=7)) == brute(docs, 3, 7)


def test_awkward_rows(spark):
    docs = [(r["lang"], r["text"]) for r in frame(spark).collect()]
    assert got(G.collocations(frame(spark), least=2)) == brute(docs, 2, 2000)
    assert G.collocations(empty(spark)).collect() == []
    assert got(G.collocations(frame(spark, [r for r in ROWS if not r[1]]))) == []
    loop = [("en", "a b " * 500)] * 2                    # a ring of nodes
    assert got(G.collocations(rows(spark, loop))) == brute(loop, 10, 2000)


def test_local_flow_gives_the_shorter_counts():
    docs = texts(3, 30)
    g = G.LocalGraph(pa.array([x or "und" for x, _ in docs]), pa.array([t for _, t in docs]))
    f, n = counts(docs)
    found = Counter()
    for r in g.rows([h == h for h in g.hashes]).to_pylist():
        found[r["lang"], tuple(w for w in (r["x"], r["y"], r["z"]) if w is not None)] += r["n"]
    totals = {k: v for k, v in found.items() if not k[1]}
    assert totals == {(lang, ()): v for lang, v in n.items()}
    assert {k: v for k, v in found.items() if k[1]} == dict(f)


def test_paths_are_the_passages(spark):
    passage = "we met at the old mill by night and left before dawn".split()
    docs = [("en", f"x{i} " + " ".join(passage) + f" y{i}") for i in range(12)] + [("en", "old mill stones")] * 3 + [(None, "p q r s")] * 10
    found = {(r["lang"], r["phrase"]): (r["n_words"], r["n"]) for r in G.paths(G.graph(rows(spark, docs))).collect()}
    # the path breaks where "old mill" also occurs elsewhere; the nodes at a path's ends are not unary
    assert found == {("en", "we met at the old mill"): (6, 12), ("en", "old mill by night and left before dawn"): (8, 12), ("und", "p q r s"): (4, 10)}
    lengths = {r["phrase"]: r["path_words"] for r in G.collocations(rows(spark, docs)).collect()}
    assert lengths["met at the"] == 6 and lengths["by night and"] == 8 and lengths["the old mill"] == 6 and lengths["old mill by"] == 8


def test_scores_beyond_64_bits(spark):
    big = 10**12
    kind = "lang string, x string, y string, z string, n long"
    grams = spark.createDataFrame([("en", "p", None, None, big + 7), ("en", "q", None, None, big + 9), ("en", "p", "q", None, big - 1)], kind)
    row = G.candidates(grams).collect()[0]
    assert row["score"] == 10**6 * (big - 1) ** 2 // ((big + 7) * (big + 9))


def test_blocks_add_up_to_the_rows():
    """What travels in blocks, unpacked and added up in any order, is the rows of both graphs."""
    docs = texts(3, 30) + [("a\nb \x00", "a\nb a b c"), ("", "\x00 \x00 \x00"), ("en", "")]
    want, blocks = Counter(), {}
    for part in (docs[:20], docs[20:]):
        g = G.LocalGraph(pa.array([x or "und" for x, _ in part]), pa.array([t for _, t in part]))
        every = [h == h for h in g.hashes]
        for r in g.rows(every).to_pylist():
            want[r["lang"], r["x"], r["y"], r["z"]] += r["n"]
        for r in g.blocks(every, 3).to_pylist():
            bucket, *block = r.values()
            blocks.setdefault(bucket, []).append(G.unpacked(*block))
    assert len(blocks) == 8
    found = Counter()
    for own in blocks.values():
        for some in (own, own[::-1], [G.added(own[:1]), *own[1:]]):
            rows = G.as_rows(*G.added(some)).to_pylist()
            assert len({tuple(r.values())[:4] for r in rows}) == len(rows)
        for r in rows:
            found[r["lang"], r["x"], r["y"], r["z"]] += r["n"]
    assert found == want


def test_counted_texts_are_read_twice(spark):
    """One pass marks, one counts; neither runs again where shuffle files go with their step."""
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        passes.add(1)
        yield from batches

    docs = rows(spark, texts(3, 200)).coalesce(1)
    assert G.collocations(docs.mapInArrow(counted, docs.schema), least=5).count()
    assert passes.value == 2


def test_shuffle_files_go_with_their_step(spark, monkeypatch):
    """All that is shuffled before the phrases are asked for goes when its step has ended, the marks' too."""
    (key, value), = G.CLEAN.items()
    steps, written, old = [], G.written, spark.conf.get(key, None)
    monkeypatch.setattr(G, "written", lambda df, name: (steps.append((name, spark.conf.get(key))), written(df, name))[1])
    found = G.collocations(rows(spark, texts(3, 200)), least=5)
    assert {"marks", "graph", "nodes", "jumps"} == {name for name, _ in steps} and {x for _, x in steps} == {value}
    assert spark.conf.get(key, None) == old and found.count()


def test_long_words_are_added_up_in_parts(spark, monkeypatch):
    """Blocks of a bucket are added up whenever they hold many bytes; counts stay whole."""
    monkeypatch.setattr(G, "HELD", 1000)
    monkeypatch.setattr(G, "GRAPH_ROWS", 5)
    docs = [("en", f"{'long' * 100} {'word' * 100} end")] * 60
    assert got(G.collocations(rows(spark, docs))) == brute(docs, 10, 2000)
