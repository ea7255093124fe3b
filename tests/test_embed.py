import hashlib
import re

import numpy as np
import pytest

from kestrel.functions import embed as E


def by_hand(text, dim):
    v = np.zeros(dim)
    for w in re.findall(r"[^\W_]+", (text or "").lower()):
        h = hashlib.md5(w.encode()).hexdigest()
        v[int(h[:8], 16) % dim] += 1 if h[8] < "8" else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def test_default_model(spark):
    rows = [(1, "The prénom, the Größe; 42 times"), (2, ""), (3, None), (4, "... !!"), (5, "a a a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r["embedding"] for r in E.embed_documents(df, dim=16).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    for i, t in rows:
        assert got[i] == pytest.approx(by_hand(t, 16), abs=1e-6)
    plan = E.embed_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_callers_model_runs_once_per_worker_in_batches(spark):
    df = spark.createDataFrame([(k, "x" * k) for k in range(300)], "doc_id long, text string")
    got = E.embed_documents(df, model_factory=lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()
    assert {r["id"]: r["embedding"] for r in got} == {k: [float(k), 1.0] for k in range(300)}


def test_output_forms():
    assert E.normalise_output(np.ones((2, 1, 3))).shape == (2, 3)
    assert E.normalise_output(np.float32([1, 2]).tobytes()).tolist() == [[1.0, 2.0]]
    assert E.normalise_output([1.0, 2.0]).shape == (1, 2)
