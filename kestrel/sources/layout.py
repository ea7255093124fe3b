"""Physical layout of document tables (A1, B1-B8): partitions, sorting, Bloom filters, DDL.

Rows lie in partitions by category, sorted by date in them, so a category filter opens that
category's folders only and a date filter skips files and row groups by their statistics.
Author and source carry Bloom filters (Parquet uses a column's dictionary instead where the
column has few values): row groups without a wanted value are skipped.

A partition's folder is named by ``category_key``, the category behind a mark, as folder names
can't tell an empty text from NULL. Readers get the category back from the key alone, hence
filters on ``category`` are partition filters.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY, MARK = "category_key", "="
#: Longest category in bytes: a folder name holds 255 and escapes may triple it.
MOST_BYTES = 80
#: Parquet options: filters sized by the number of values that a row group really holds.
OPTIONS = {"parquet.bloom.filter.enabled#author": "true", "parquet.bloom.filter.enabled#source": "true",
           "parquet.bloom.filter.adaptive.enabled": "true"}


def category_key(category: Column) -> Column:
    """The partition of a category: NULL's own, else the marked text. A longer one than
    ``MOST_BYTES`` fails when written."""
    fits = F.octet_length(category) <= MOST_BYTES
    return F.when(category.isNull() | fits, F.concat(F.lit(MARK), category)) \
        .otherwise(F.raise_error(F.concat(F.lit("category longer than 80 bytes: "), category)).cast("string"))


def _category() -> Column:
    return F.expr(f"substring({KEY}, {len(MARK) + 1})").alias("category")


def stored_schema(schema: T.StructType, *partitions: str) -> T.StructType:
    """The columns of the files of a table with ``schema``, then its partitions."""
    own = [f for f in schema.fields if f.name != "category"]
    return T.StructType([*own, *(T.StructField(p, T.StringType()) for p in (*partitions, KEY))])


def write(rows: DataFrame, path: str, **options: str) -> None:
    """``rows`` to ``path``, in place of what is there. Ranges of (category, date, id) are cut by
    a sample of the rows, so a category of any size is spread over many files, and small ones share
    a task."""
    keyed = rows.withColumn(KEY, category_key(F.col("category"))).drop("category")
    (keyed.repartitionByRange(KEY, "date", "id").sortWithinPartitions(KEY, "date", "id")
     .write.mode("overwrite").option("partitionOverwriteMode", "static").options(**{**OPTIONS, **options})
     .partitionBy(KEY).parquet(path))


def shaped(stored: DataFrame, schema: T.StructType) -> DataFrame:
    """Stored rows with the columns of the table."""
    return stored.select(*[_category() if f.name == "category" else F.col(f.name) for f in schema.fields])


def read(spark: SparkSession, path: str, schema: T.StructType, *partitions: str) -> DataFrame | None:
    """The files below ``path`` as they lie (see :func:`shaped`), None where there are none."""
    try:
        return spark.read.schema(stored_schema(schema, *partitions)).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def ddl(name: str, path: str, schema: T.StructType, *partitions: str) -> str:
    """``CREATE TABLE`` of the stored rows at ``path``."""
    whole = stored_schema(schema, *partitions)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in whole.fields)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    options = ", ".join(f"'{k}' = '{v}'" for k, v in OPTIONS.items())
    return (f"CREATE TABLE IF NOT EXISTS `{name}` ({columns}) USING parquet OPTIONS ({options}) "
            f"PARTITIONED BY ({', '.join((*partitions, KEY))}) LOCATION '{place}'")


def declare(spark: SparkSession, name: str, path: str, schema: T.StructType, *partitions: str) -> DataFrame:
    """Declares the files below ``path`` as a table of the session's catalog and registers their
    partitions, so that a filtered query lists the folders of its partitions only. Can be called
    again after inserts. Returns the stored rows."""
    spark.sql(ddl(name, path, schema, *partitions))
    spark.sql(f"MSCK REPAIR TABLE `{name}`")
    return spark.table(f"`{name}`")
