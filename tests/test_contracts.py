"""Named tests for the contracts S2-S9 and ingest behaviour."""

import json

import pytest
from pyspark.sql import functions as F

from kestrel.operators import filters as FL
from kestrel.operators import stats as ST
from kestrel.sources import ingest as I

BATCH = "source_id long, content string, embedding array<float>, author string, date string, " \
        "category string, tags array<string>, source string, metadata string"


def batch(spark):
    rows = [
        (1, "one", [1.0, 0.0], "ann", "2024-01-05", "cs", ["x", "y"], "s1", '{"n":1}'),
        (2, "two", [0.0, 1.0], None, "", None, None, None, None),
        (3, "three", [1.0, 1.0], "bob", None, "", [], "s2", "{}"),
        (4, "four", [2.0, 1.0], "", "2023-12-31", "math", ["y"], "", '{"tags":["old"],"n":4}'),
    ]
    return spark.createDataFrame(rows, BATCH)


def test_s2_s4_null_mode(spark):
    out = {r["id"]: r for r in I.to_null_form(batch(spark), start=1).collect()}
    assert sorted(out) == [1, 2, 3, 4]                                     # S7: from start, in order
    assert out[2]["author"] is None and out[2]["date"] is None             # S2 NULL defaults
    assert out[2]["metadata"] == "{}"                                      # B11
    assert str(out[1]["date"]) == "2024-01-05"


def test_s2_empty_mode_and_tag_fold(spark):
    out = {r["id"]: r for r in I.to_empty_form(batch(spark), start=10).collect()}
    assert sorted(out) == [10, 11, 12, 13]
    assert out[11]["author"] == "" and out[11]["date"] == "" and out[11]["category"] == ""
    assert json.loads(out[10]["metadata"]) == {"n": 1, "tags": ["x", "y"]}
    assert json.loads(out[12]["metadata"]) == {}                           # empty tags not folded
    assert json.loads(out[13]["metadata"]) == {"n": 4, "tags": ["y"]}      # existing key replaced


def test_content_is_cut_only_if_asked_for(spark):
    b = batch(spark).withColumn("content", F.repeat(F.lit("z"), 70000))
    lens = lambda **kw: {r["l"] for r in I.to_empty_form(b, start=0, **kw).select(F.length("content").alias("l")).collect()}
    assert lens() == {70000} and lens(max_chars=I.MAX_CONTENT_CHARS) == {65000}


def test_tags_are_folded_into_parsed_json(spark):
    cases = [('{"tags":["a]b"],"n":1}', ["x"], {"n": 1, "tags": ["x"]}),
             ('{"o":{"tags":["k"]},"n":1}', ["y"], {"o": {"tags": ["k"]}, "n": 1, "tags": ["y"]}),
             ('{"q":"say \\"tags\\": [1]"}', ['a"b', "c]"], {"q": 'say "tags": [1]', "tags": ['a"b', "c]"]}),
             ("not json", ["z"], {"tags": ["z"]}), (None, ["z"], {"tags": ["z"]}), ('{"n":2}', [], {"n": 2}), ('{"n":2}', None, {"n": 2})]
    df = spark.createDataFrame([(k, m, t) for k, (m, t, _) in enumerate(cases)], "k int, m string, t array<string>")
    got = {r["k"]: json.loads(r["j"]) for r in df.select("k", I.fold_tags(F.col("m"), F.col("t")).alias("j")).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(cases)}


def test_next_id_raises_on_an_unreadable_table(spark, tmp_path):
    assert I.next_id(spark, str(tmp_path / "none"), "null") == 1
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):
        I.next_id(spark, str(broken), "null")


def test_s3_date_to_null_vs_text(spark):
    null_rows = I.to_null_form(batch(spark), start=1)
    text_rows = I.to_empty_form(batch(spark), start=1)
    f = {"date_to": "2024-12-31"}
    assert sorted(r["id"] for r in FL.apply_filters(null_rows, f).collect()) == [1, 4]
    # text mode keeps the unknown dates ('' <= '2024-...')
    assert sorted(r["id"] for r in FL.apply_filters(text_rows, f, "text").collect()) == [1, 2, 3, 4]


def test_s5_falsy_tag(spark):
    null_rows = I.to_null_form(batch(spark), start=1)
    text_rows = I.to_empty_form(batch(spark), start=1)
    assert FL.apply_filters(null_rows, {"tags": ""}).count() == 0          # applied
    assert FL.apply_filters(text_rows, {"tags": ""}, "text").count() == 4  # skipped
    assert sorted(r["id"] for r in FL.apply_filters(text_rows, {"tags": "y"}, "text").collect()) == [1, 4]


def test_s6_none_value_keeps_nothing(spark):
    null_rows = I.to_null_form(batch(spark), start=1)
    assert FL.apply_filters(null_rows, {"author": None}).count() == 0
    assert FL.apply_filters(null_rows, {"bogus": 1}).count() == 4          # unknown keys ignored
    assert FL.apply_filters(null_rows, None).count() == 4


def test_s9_categories(spark):
    null_rows = I.to_null_form(batch(spark), start=1)
    assert [r["category"] for r in ST.distinct_categories(null_rows).collect()] == ["cs", "math"]


def test_consecutive_ids_across_partitions(spark):
    df = spark.range(0, 1000, numPartitions=7).select(F.col("id").alias("k"))
    out = I.with_consecutive_ids(df.repartition(5), ["k"], start=100)
    got = sorted((r["k"], r["id"]) for r in out.collect())
    assert [i for _, i in got] == list(range(100, 1100))


def test_append_and_next_id(spark, tmp_path):
    path = str(tmp_path / "docs")
    t1 = I.ingest(spark, batch(spark), path=path, mode="null")
    assert t1.count() == 4
    t2 = I.ingest(spark, batch(spark), path=path, mode="null")
    assert sorted(r["id"] for r in t2.collect()) == list(range(1, 9))


def test_dimension_violations(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in I.dimension_violations(v, 2).collect()] == [(2, 1)]
    try:
        I.require_dimension(v, 2)
        raise AssertionError("expected a ValueError")
    except ValueError:
        pass


def test_vector_text_roundtrip(spark):
    v = spark.createDataFrame([(1, [0.1, -2.5, 3.0e-7])], "id long, embedding array<float>")
    assert I.vector_text_roundtrip(v).first()["exact"] is True
