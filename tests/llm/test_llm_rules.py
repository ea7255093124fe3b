"""Chat repair (1), decontamination (4) and licences (5): brute force and edges."""

import itertools
import random

import duckdb
import numpy as np
import pytest
from conftest import SF001, SF01
from llm_cases import ROWS, empty, frame, words

from kestrel.llm import chat_repair as C
from kestrel.llm import license_rules as R
from kestrel.llm import lsa_decontam as D


def least_cost(roles):
    """By trying everything: each turn's role, merged or not, inserted turns before it."""
    best = 10 ** 9

    def go(k, state, cost):
        nonlocal best
        if cost >= best:
            return
        if k == len(roles):
            for x in [None, *C.LEGAL[state]]:
                if (x or state) in C.FINAL and (x is None or x in C.LEGAL[state]):
                    best = min(best, cost + (C.INSERT if x else 0))
            return
        for t in (1, 2, 3):
            change = 0 if roles[k] == t else C.RELABEL
            if t in C.LEGAL[state]:
                go(k + 1, t, cost + change)
            if t == state:
                go(k + 1, t, cost + change + C.MERGE)
            for x in C.LEGAL[state]:
                if t in C.LEGAL[x]:
                    go(k + 1, t, cost + change + C.INSERT)
    go(0, 0, 0)
    return best


def action_cost(action):
    return (C.MERGE * ("merge" in action) + C.RELABEL * ("relabel" in action) + C.INSERT * (action == "insert"))


def legal(pieces):
    state = 0
    for _, action, role, _ in pieces:
        if "merge" in action:
            assert role == state
        else:
            assert role in C.LEGAL[state]
            state = role
    return state in C.FINAL


def test_repair_is_cheapest_and_legal():
    for n in (1, 2, 3, 4):
        for roles in itertools.product(range(4), repeat=n):
            got = C.repair([(r, k, f"t{k}") for k, r in enumerate(roles)])
            assert sum(action_cost(a) for _, a, _, _ in got) == least_cost(roles), (roles, got)
            assert legal(got)
            text = "".join(p for *_, p in got)
            assert text.count("<|im_start|>") == text.count("<|im_end|>") == sum("merge" not in a for _, a, _, _ in got)
            assert [k for k, a, *_ in got if a != "insert"] == list(range(n))


def test_segments_do_not_change_the_repair():
    r = random.Random(4)
    for _ in range(60):
        turns = [(r.randrange(4), k, str(k)) for k in range(r.randint(1, 25))]
        whole = C.repair(turns)
        cuts = sorted({0, len(turns), *(r.randrange(len(turns) + 1) for _ in range(4))})
        parts = [turns[a:b] for a, b in zip(cuts, cuts[1:])]
        states, cost = C.borders([C.segment_costs((x[0], x[1]) for x in p) for p in parts])
        got = [x[1:] for k, (p, s) in enumerate(zip(parts, states)) for x in C.repair(p, s[0], s[1], k == len(parts) - 1)]
        assert got == [x[1:] for x in whole]
        assert cost == sum(action_cost(a) for _, a, _, _ in whole)


@pytest.mark.parametrize("segment", [4096, 2])
def test_chat_frame(spark, segment):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", "there"), (1, 2, "Assistant ", "yes"), (2, 5, None, None), (2, None, "tool", "x"),
            (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (None, 1, "user", ""), (None, 2, "system", "s")]
    rows += [(4, k, r, f"m{k}") for k, r in enumerate(["user", "assistant"] * 6)]
    src = spark.createDataFrame([(*x, 1, "p", 3) for x in rows], "conv_id long, turn long, role string, text string, chunk int, piece string, place int")
    got = C.pieces(src, segment=segment)
    texts = {r["conv_id"]: r["text"] for r in C.rendered(got).collect()}
    for conv in (1, 2, 3, 4, None):
        own = sorted(((t is None, t or 0, r or "", C.role_of(r), t, x or "") for c, t, r, x in rows if c == conv))
        assert texts[conv] == "".join(p for *_, p in C.repair([o[3:] for o in own])), conv
    assert texts[1] == "<|im_start|>user\nhi\n\nthere<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
    summary = {r["conv_id"]: r for r in C.summary(got).collect()}
    assert {c: summary[c]["n_turns"] for c in summary} == {1: 3, 2: 2, 3: 2, 4: 12, None: 2}
    assert summary[1]["cost"] == C.MERGE and summary[4]["cost"] == 0
    assert summary[3]["cost"] == least_cost([3, 3]) and summary[None]["cost"] == least_cost([2, 1])
    assert C.pieces(src.limit(0)).collect() == []


def test_common_subsequence():
    r = np.random.default_rng(1)
    for _ in range(100):
        a, b = r.integers(0, 6, r.integers(0, 30)), r.integers(0, 6, r.integers(1, 20))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert D.common_subsequence(a, D._places(b), len(b)) == table[-1, -1]


def test_benchmark_items_in_documents(spark):
    docs, items = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "benchmark"))
    flat = lambda t: b" " + b" ".join(D.words_of(t)) + b" "
    texts = [(r["item_id"], flat(r["text"])) for r in items.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for w in [flat(r["text"])] for i, t in texts if t in w}
    got = {(r["doc_id"], r["item_id"]) for r in D.matches(docs, items).collect()}
    assert want <= got and len(got - want) <= 2 and want


def test_paraphrases_and_edges(spark):
    item = words(50, 40)
    w = item.split()
    dropped = " ".join(x for k, x in enumerate(w) if k % 6)                      # some words left out
    padded = " ".join(x if k % 5 else x + " " + words(60 + k, 1) for k, x in enumerate(w))
    half = " ".join(w[:18])                                                      # less than half of it
    rows = ROWS + [(20, words(51, 100) + " " + dropped + " " + words(52, 100)), (21, words(53, 70) + ", " + padded.upper()),
                   (22, words(54, 100) + " " + half + " " + words(55, 40)), (23, item), (23, item), (None, item), (24, words(56, 300))]
    items = spark.createDataFrame([(1, item, 5), (2, None, 5), (None, item, 5), (3, "", 5), (4, "!!", 5), (5, "rareword", 5), (6, words(70, 400), 5)],
                                  "item_id long, text string, doc_id long")
    rows += [(25, words(57, 50) + " rareword " + words(58, 50)), (26, words(59, 100) + " " + words(70, 400) + " " + words(61, 10))]
    got = sorted(((r["doc_id"], r["item_id"]) for r in D.matches(frame(spark, rows), items).collect()), key=str)
    assert got == sorted([(20, 1), (21, 1), (23, 1), (23, 1), (None, 1), (25, 5), (26, 6)], key=str)
    out = D.clean(frame(spark, rows), items)
    assert out.columns == frame(spark).columns and out.count() == len(rows) - 7
    assert D.matches(empty(spark), items).collect() == [] and D.clean(empty(spark), items).collect() == []
    assert D.matches(frame(spark), items.limit(0)).collect() == []


def test_recall_of_retrieval_against_brute_force(spark):
    """Paraphrased items put into documents: those that the subsequence rule accepts when it is
    shown the whole document must be retrieved."""
    docs, items = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "benchmark"))
    r = random.Random(12)
    texts = [x["text"] for x in docs.collect() if len(x["text"]) < 3000]
    block = next(D.blocks(items, "item_id", "text"))
    own = {x["item_id"]: x["text"].split() for x in items.collect()}
    rows = []
    for k in range(150):
        item = block[k % len(block)]
        w = [x for x in own[item.id] if r.random() > 0.25]
        w = [x if r.random() > 0.1 else words(1000 + k, 1) for x in w]
        host = r.choice(texts).split()
        at = r.randrange(len(host) + 1)
        rows.append((10_000 + k, " ".join(host[:at] + w + host[at:])))
    want = {(i, item.id) for i, t in rows for item in block if item.found(D.hashes(D.words_of(t)))[2]}
    mixed = frame(spark, [(x["doc_id"], x["text"]) for x in docs.collect()] + rows)
    got = {(x["doc_id"], x["item_id"]) for x in D.matches(mixed, items).collect()}
    assert len(want) > 80 and len(want & got) >= 0.95 * len(want)


def test_space_is_near_the_exact_decomposition(spark):
    """The randomised basis holds the items: cosines there equal those of the full vectors."""
    docs, items = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "benchmark"))
    block = next(D.blocks(items, "item_id", "text"))
    space = D.fit(docs, block)
    own, size = D._vectors(space, [p for i in block for p in i.pieces])
    assert np.allclose(space.basis.T @ space.basis, np.eye(space.basis.shape[1]), atol=1e-3)
    kept = np.linalg.norm(own @ space.basis, axis=1) / size
    assert kept.min() > 0.95 and (np.diff(space.values) <= 1e-6 * space.values[0]).all()


def test_many_items_with_words_of_their_own(spark):
    """More pieces than the space has dimensions: each is held, and word-for-word copies are retrieved."""
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    r = random.Random(31)
    texts = [t for t in sorted(x["text"] for x in docs.select("text").collect()) if 60 <= len(t.split()) < 500]
    passages = [" ".join(t.split()[at:at + 40]) for t in texts for at in range(0, len(t.split()) - 40, 40)]
    items = list(enumerate(r.sample(sorted(set(passages)), 1000)))
    rows = []
    for k, t in items[::5]:
        host = r.choice(texts).split()
        at = r.randrange(len(host) + 1)
        rows.append((k, " ".join([*host[:at], t, *host[at:]])))
    found, held = set(), 0
    for block in D.blocks(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text"):
        space = D.fit(docs, block)
        own, size = D._vectors(space, [p for i in block for p in i.pieces])
        assert (np.linalg.norm(own @ space.basis, axis=1) >= 0.949 * size).all()
        held += len(block)
        found |= {(rows[d][0], space.items[k].id) for d, _, k, _ in D.candidates(space, [D.hashes(D.words_of(t)) for _, t in rows])}
    assert held == 1000 and len({(i, i) for i, _ in rows} & found) >= 0.99 * len(rows)


def test_short_items_in_prose_of_benchmark_words(spark):
    """Word-for-word copies of items of 3 to 20 words between words of other items are all found; most
    of 8 words or more by their windows alone, also those that lost a word."""
    r = random.Random(77)
    known = words(78, 900).split()
    items = [(k, " ".join(r.choice(known) for _ in range(3 + k % 18))) for k in range(200)]
    rows = [(k, " ".join([*r.choices(known, k=90), t, *r.choices(known, k=90)])) for k, t in items]
    for k, t in items:
        w = t.split()
        del w[len(w) // 2]
        rows.append((1000 + k, " ".join([*r.choices(known, k=90), *w, *r.choices(known, k=90)])))
    docs = frame(spark, rows + [(10_000 + k, words(9000 + k, 200)) for k in range(300)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in D.matches(docs, bench).collect()}
    assert {(k, k) for k, _ in items} <= got
    space = D.fit(docs, next(D.blocks(bench, "item_id", "text")))
    near = {(rows[d][0] % 1000, space.items[k].id) for d, _, k, _ in D.candidates(space, [D.hashes(D.words_of(t)) for _, t in rows])}
    long = [k for k, t in items if len(t.split()) >= 8]
    assert len({(k, k) for k in long} & near) >= 0.97 * len(long)


def test_licences(spark, tmp_path):
    mit = dict((n, t) for n, t in R.STATEMENTS if "Permission is hereby granted, free" in t)["MIT"]
    wrapped = "# " + mit.replace("\n", "\n# ")
    rows = ROWS + [(30, "Text.\nReleased under the MIT License."), (31, f"Copyright x\n\n{wrapped}\n\nmore"),
                   (32, "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                        "following disclaimer. All rights reserved."), (33, "released under the mit license in part"),
                   (34, next(t for n, t in R.STATEMENTS if n == "BSD-3-Clause" and len(t) > 90))]
    df = frame(spark, rows)
    got = R.scan(df)
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[30]["license"] == "MIT" and by[31]["licenses"] == "MIT" and by[31]["n_known"] == 4
    assert by[32]["licenses"] == "all-rights-reserved" and by[32]["n_known"] == 2
    assert by[33]["n_known"] == 0 and by[33]["license"] is None and by[5]["n_known"] == 0
    assert by[34]["license"] == "BSD-3-Clause" and by[34]["licenses"] == "BSD-2-Clause,BSD-3-Clause"
    df.write.parquet(f"{tmp_path}/documents")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = duck.execute(R.oracle_sql()).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    assert R.scan(empty(spark)).collect() == []


def test_licences_of_both_layouts(spark):
    """A notice on a line of its own and a wrapped statement are both found, in either order."""
    mpl = next(t for n, t in R.STATEMENTS if n == "MPL-2.0").replace("terms of", "terms\nof").replace("with this", "with\nthis")
    mit = next(t for _, t in R.STATEMENTS if "Permission is hereby granted, free" in t)
    rows = [(1, f"About\nLicensed under CC BY 4.0.\n\n{mpl}"), (2, f"{mpl}\n\nAbout\nLicensed under CC BY 4.0.\n"),
            (3, f"About\nLicensed under CC BY 4.0.\nmore\n\n{mit}"), (4, mpl), (5, "About\nLicensed under CC BY 4.0.\nmore")]
    got = {r["doc_id"]: (r["licenses"], r["license"]) for r in R.scan(frame(spark, rows)).collect()}
    assert got == {1: ("CC-BY-4.0,MPL-2.0", "MPL-2.0"), 2: ("CC-BY-4.0,MPL-2.0", "MPL-2.0"), 3: ("CC-BY-4.0,MIT", "MIT"),
                   4: ("MPL-2.0", "MPL-2.0"), 5: ("CC-BY-4.0", "CC-BY-4.0")}
