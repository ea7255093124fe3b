"""The bucketed text index: segments, plans without a shuffle of the index, and scoring by bounds."""

import random

import numpy as np
import pytest

from kestrel.functions import embed as E
from kestrel.operators import keyword as KW
from kestrel.operators import metrics as ME


def _docs(spark, rows):
    return spark.createDataFrame(rows, "id long, content string")


def _text(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "the", "rare" if r.random() < 0.05 else "eps", "zeta"]) for _ in range(n))


ROWS = [(i, _text(i, 5 + i % 60)) for i in range(1, 400)]


def _q(spark, *texts):
    return KW.query_terms(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id long, text string"))


def _scores(index, q, limit=None):
    return sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in KW.keyword_rank(index, q, limit).collect())


def plain_score(words, terms):
    """Sum over minimal covers, by trying all intervals of matched positions."""
    hits = [(p, w) for p, w in enumerate(words) if w in terms]
    spans = [(i, j) for i in range(len(hits)) for j in range(i, len(hits)) if {w for _, w in hits[i:j + 1]} == set(terms)]
    least = [(i, j) for i, j in spans if not any((a, b) != (i, j) and i <= a and b <= j for a, b in spans)]
    return sum(0.1 / (1 + (hits[j][0] - hits[i][0]) - (j - i)) for i, j in least)


def test_scores_equal_all_intervals(spark, monkeypatch):
    monkeypatch.setattr(KW, "PART_DOCS", 37)
    index = KW.build_index(_docs(spark, ROWS).repartition(3))
    queries = ["alpha beta", "rare", "gamma rare delta", "missing alpha", "the"]
    got = {(a, b): s for a, b, s, _ in _scores(index, _q(spark, *queries))}
    want = {}
    for k, q in enumerate(queries):
        terms = {w for w in q.split() if w != "the"}
        for i, t in ROWS:
            words = t.split()
            if terms and terms <= set(words):
                want[k, i] = plain_score(words, terms)
    assert set(got) == set(want)
    assert all(got[x] == pytest.approx(want[x], abs=1e-8) for x in want)


def test_top_k_by_bounds_equals_the_full_ranking(spark):
    index = KW.build_index(_docs(spark, ROWS).repartition(2))
    q = _q(spark, "alpha beta", "zeta", "gamma rare")
    every = _scores(index, q)
    want = []
    for k in range(3):
        own = sorted((-s, i) for a, i, s, _ in every if a == k)[:20]
        want += [(k, i, -s, 1 + sum(t < s for t, _ in own)) for s, i in own]
    assert _scores(index, q, 20) == sorted(want)


def test_few_documents_are_scored():
    """Most matches hold a term once or twice; those that cannot reach the best stay unscored."""
    rng = np.random.default_rng(3)
    ids = np.arange(5000, dtype=np.int64)
    counts = np.minimum(rng.geometric(0.6, 5000), 40).astype(np.int32)
    counts[rng.choice(5000, 60, replace=False)] = 200
    positions = np.concatenate([np.sort(rng.choice(2000, c, replace=False)) for c in counts]).astype(np.int32)
    both = [(ids, counts, positions), (ids, counts, np.concatenate([np.sort(rng.choice(np.arange(2000, 4000), c, replace=False)) for c in counts]).astype(np.int32))]
    for terms in (both[:1], both):
        got, best, scored = KW.top_covers(terms, ids, 20)
        full = KW.cover_scores(terms, ids)
        order = np.lexsort((ids, -full))[:20]
        assert got.tolist() == ids[order].tolist() and best.tolist() == full[order].tolist()
        if len(terms) == 1:
            assert scored < 0.2 * len(ids)


def test_an_append_reads_new_documents_only(spark, monkeypatch):
    first, more = ROWS[:300], ROWS[300:]
    index = KW.build_index(_docs(spark, first))
    files = set(index.entries.inputFiles())
    grown = KW.append(index, _docs(spark, more))
    assert files < set(grown.entries.inputFiles())                   # the first segment's files stay as they are
    assert {r["segment"] for r in grown.entries.select("segment").distinct().collect()} == {1, 2}
    q = _q(spark, "alpha beta", "rare gamma")
    want = _scores(KW.build_index(_docs(spark, ROWS)), q)
    assert _scores(grown, q) == want
    merged = KW.merge(grown)
    assert _scores(merged, q) == want and len(merged.entries.inputFiles()) <= len(grown.entries.inputFiles())
    monkeypatch.setattr(KW, "_packed", None)                          # nothing is tokenised again
    assert _scores(KW.open_index(spark, merged.path), q) == want
    few = KW.open_index(spark, merged.path).within(_docs(spark, ROWS).filter("id % 3 = 0"))
    assert [x[:3] for x in _scores(few, q)] == [x[:3] for x in want if x[1] % 3 == 0]


def test_repeated_and_null_ids_are_refused(spark):
    index = KW.build_index(_docs(spark, [(1, "alpha"), (2, None), (3, "")]))
    assert [r["id"] for r in KW.keyword_match(index, _q(spark, "alpha")).collect()] == [1]
    for rows in ([(1, "beta")], [(5, "beta"), (5, "beta")], [(None, "beta")]):
        with pytest.raises(ValueError):
            KW.append(index, _docs(spark, rows))
    with pytest.raises(ValueError):
        KW.build_index(_docs(spark, [(1, "a"), (1, "a")]))
    assert KW.keyword_match(KW.build_index(_docs(spark, [])), _q(spark, "alpha")).collect() == []


def _exchanged_scans(plan):
    """Scans of the index that are shuffled before they meet the query terms."""
    out, todo = [], [(plan, False)]
    while todo:
        p, under = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append((p.initialPlan(), under))
            continue
        if "Join" in name:
            under = False
        elif name.startswith("ShuffleExchange"):
            under = True
        elif "FileSourceScan" in name and "kestrel_terms" in p.toString():
            out.append(under)
        children = p.children()
        todo += [(children.apply(i), under) for i in range(children.length())]
    return out


@pytest.mark.parametrize("broadcast", ["-1", "10MB"])
def test_the_index_is_not_shuffled(spark, broadcast):
    index = KW.build_index(_docs(spark, ROWS))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        plan = KW.cover_density(index, _q(spark, "alpha beta"))._jdf.queryExecution().executedPlan()
        scans = _exchanged_scans(plan)
        assert len(scans) == 2 and not any(scans)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_rank_keeps_null_scores_and_groups(spark):
    rows = [("a", 1.0, 1), ("a", None, 2), (None, 3.0, 3), (None, 2.0, 4), ("a", 1.0, 5), (None, None, 6)]
    df = spark.createDataFrame(rows, "g string, s double, id long")
    got = {r["id"]: r["rank"] for r in ME.rank_in_group(df, ["g"], "s", tie_cols=["id"]).collect()}
    assert got == {1: 1, 5: 1, 2: 3, 3: 1, 4: 2, 6: 3}


def test_embedding_keeps_rows_and_shuffles_nothing(spark):
    rows = [(1, "alpha beta"), (1, "gamma"), (None, "alpha beta"), (None, None), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = E.embed_documents(df, dim=16)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted((str(r["id"]), tuple(r["embedding"])) for r in out.collect())
    assert len(got) == 5
    alone = {t: tuple(E.embed_documents(spark.createDataFrame([(9, t)], df.schema), dim=16).first()["embedding"]) for _, t in rows}
    assert got == sorted((str(i), alone[t]) for i, t in rows)
