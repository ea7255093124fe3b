"""Document tables: what a filter leaves unread, values that folders can't hold, names for SQL."""

import datetime

import pytest
from pyspark.sql import functions as F

from kestrel.operators import filters as FL
from kestrel.session import shared_path
from kestrel.sources import ingest as I
from kestrel.sources import layout as LA
from kestrel.sources import tables as S


def _scan(df):
    """Rows of ``df`` and the scan of its table's files, with its metrics."""
    rows = df.collect()
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif name == "FileSourceScanExec" and "author" in p.requiredSchema().toString():
            found.append(p)
        kids = p.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    assert len(found) == 1
    metric = lambda m: found[0].metrics().apply(m).value()
    return rows, found[0].toString(), metric("numFiles"), metric("numOutputRows")


def _batch(spark, n):
    """Authors of two rows each, four categories (one of them holds a third of the rows), dates in no order."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("source_id"), F.concat(F.lit("text "), i.cast("string")).alias("content"),
        F.lit(None).cast("array<float>").alias("embedding"), F.concat(F.lit("writer"), (i % (n // 2)).cast("string")).alias("author"),
        F.date_add(F.lit("2020-01-01").cast("date"), ((i * 7919) % 1000).cast("int")).cast("string").alias("date"),
        F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (i % 3).cast("string"))).alias("category"),
        F.array(F.lit("t")).alias("tags"), F.lit("s").alias("source"), F.lit(None).cast("string").alias("metadata"))


@pytest.fixture(scope="module")
def table(spark):
    path = shared_path(spark, "tables/layout", unique=True)
    rows = I.to_null_form(_batch(spark, 40_000), "source_id")
    # small row groups, as a large table has many
    LA.write(rows, f"{path}/data/batch=one", **{"parquet.block.size": str(64 << 10), "parquet.page.size": str(8 << 10),
                                                "parquet.block.size.row.check.min": "100", "parquet.page.size.row.check.min": "100"})
    I._noted(spark, path, "one", 0, 40_000, False)
    I._noted(spark, path, "one", 0, 40_000, True)
    return path


def test_category_prunes_partitions(spark, table):
    whole = _scan(I.table_at(spark, table).select("id", "author"))
    rows, plan, files, read = _scan(FL.apply_filters(I.table_at(spark, table), {"category": "c1"}).select("id", "author"))
    assert len(rows) == read == sum(i % 3 == 1 for i in range(40_000))
    assert files < whole[2] and "category_key" in plan[plan.index("PartitionFilters"):]


def test_dates_and_authors_skip_row_groups(spark, table):
    late = {"date_from": "2022-09-01"}
    rows, _, _, read = _scan(FL.apply_filters(I.table_at(spark, table), late).select("id", "author"))
    assert rows and read < 8_000
    rows, _, _, read = _scan(FL.apply_filters(I.table_at(spark, table), {"author": "writer77"}).select("id", "author"))
    assert sorted(r["id"] for r in rows) == [77, 20_077] and read < 20_000
    assert _scan(FL.apply_filters(I.table_at(spark, table), {"author": "writerless"}).select("id", "author"))[3] < 4_000


def test_empty_null_and_odd_categories_stay_apart(spark):
    values = [None, "", "=", "a/b", "a b ", "A", "a", "ü%20", "__HIVE_DEFAULT_PARTITION__", "1", "01", "x" * 80]
    batch = _batch(spark, 2 * len(values)).drop("category").join(
        spark.createDataFrame([(k, v) for k, v in enumerate(values * 2)], "source_id long, category string"), "source_id")
    for mode in ("null", "empty"):
        path = shared_path(spark, "tables/odd", unique=True)
        got = {r["id"]: r["category"] for r in I.ingest(spark, batch, path, mode, id_col="source_id").collect()}
        assert got == {k: v if mode == "null" else v or "" for k, v in enumerate(values * 2)}
    assert [r["id"] for r in FL.apply_filters(I.table_at(spark, path, "empty"), {"category": ""}, "text").orderBy("id").collect()] == [0, 1, 12, 13]
    with pytest.raises(Exception, match="80 bytes"):
        I.ingest(spark, batch.withColumn("category", F.lit("y" * 81)), shared_path(spark, "tables/long", unique=True))


def test_declared_table(spark):
    path = shared_path(spark, "tables/declared", unique=True)
    I.ingest(spark, _batch(spark, 60), path, name="one")
    I.declare_table(spark, "declared_docs", path)
    count = "SELECT count(*) AS n, count(DISTINCT category) AS c, min(date) AS d FROM declared_docs"
    assert spark.sql(count).first()["n"] == 60
    I.ingest(spark, _batch(spark, 40), path, name="two")
    view = I.declare_table(spark, "declared_docs", path)                 # once more after an insert
    r = spark.sql(count).first()
    assert (r["n"], r["c"]) == (100, 3) and r["d"] == datetime.date(2020, 1, 1)
    types = lambda schema: [(f.name, f.dataType.simpleString()) for f in schema]
    assert types(view.schema) == types(S.DOCUMENT_SCHEMA)
    columns = {c.name: c for c in spark.catalog.listColumns("declared_docs_rows")}
    assert {n for n, c in columns.items() if c.isPartition} == {"batch", "category_key"}
    assert columns["embedding"].dataType == "array<float>" and columns["date"].dataType == "date"
    pruned = spark.sql("SELECT id, author FROM declared_docs WHERE category = 'hot'")
    assert pruned.count() == 34 and "category_key" in _scan(pruned)[1].split("PartitionFilters")[1]
