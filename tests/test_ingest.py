"""Batches are inserted whole and once, whatever is repeated or interrupted."""

import pytest
from pyspark.sql import functions as F

from kestrel.session import shared_path
from kestrel.sources import ingest as I

KIND = ("source_id long, content string, embedding array<float>, author string, date string, category string, "
        "tags array<string>, source string, metadata string")


def _batch(spark, ids, text="x"):
    return spark.createDataFrame([(i, f"{text}{i}", [1.0], None, "", "en", ["t"], "s", None) for i in ids], KIND)


def _rows(df):
    return sorted((r["id"], r["content"]) for r in df.collect())


@pytest.mark.parametrize("mode,first", [("null", 1), ("empty", 0)])
def test_a_batch_is_inserted_once(spark, mode, first):
    path = shared_path(spark, "tables/test", unique=True)
    one = _batch(spark, range(5))
    named = lambda b: I.ingest(spark, b, path, mode, name=I.batch_name(b))
    a = _rows(named(one))
    assert a == [(first + k, f"x{k}") for k in range(5)]
    assert _rows(named(one.repartition(3).orderBy(F.rand(1)))) == a       # the same rows in another order
    b = _rows(named(_batch(spark, range(3), "y")))
    assert b == a + [(first + 5 + k, f"y{k}") for k in range(3)]
    # the same content as a batch of its own
    c = _rows(I.ingest(spark, one, path, mode))
    assert len(c) == 13 and len({i for i, _ in c}) == 13


def test_an_interrupted_batch_leaves_one_copy(spark, monkeypatch):
    path = shared_path(spark, "tables/test", unique=True)
    I.ingest(spark, _batch(spark, range(4)), path)
    noted = I._noted

    def stops(spark_, path_, name, start, n, done):
        if done:
            raise RuntimeError("interrupted")
        noted(spark_, path_, name, start, n, done)

    monkeypatch.setattr(I, "_noted", stops)
    second = _batch(spark, range(3), "y")
    with pytest.raises(RuntimeError):
        I.ingest(spark, second, path, name="second")
    monkeypatch.setattr(I, "_noted", noted)
    assert len(_rows(I.table_at(spark, path))) == 4                       # written, not yet there
    third = _rows(I.ingest(spark, _batch(spark, range(2), "z"), path))
    assert third[4:] == [(8, "z0"), (9, "z1")]                            # behind the reserved ids
    assert _rows(I.ingest(spark, second, path, name="second")) == sorted(third + [(5, "y0"), (6, "y1"), (7, "y2")])


def test_caller_ids_are_checked(spark):
    path = shared_path(spark, "tables/test", unique=True)
    I.ingest(spark, _batch(spark, [3, 9]), path, id_col="source_id")
    for ids in ([9], [4, 4], [None]):
        with pytest.raises(ValueError):
            I.ingest(spark, _batch(spark, ids, "q"), path, id_col="source_id")
    assert [i for i, _ in _rows(I.ingest(spark, _batch(spark, [5], "q"), path))] == [3, 9, 10]   # behind the largest
    assert _rows(I.ingest(spark, _batch(spark, []), shared_path(spark, "tables/none", unique=True))) == []

