"""Ingest and export.

A batch (see :func:`kestrel.sources.tables.ingest_batch`) has columns
``content, embedding, author, date (text, '' = unknown), category, tags,
source, metadata (JSON object text without tags)`` and optionally a caller id.

Two target forms:
  ``null``  relational: missing -> NULL, ``''`` date -> NULL, DATE typed,
            metadata ``'{}'`` when absent, ids allocated after the current max.
  ``empty`` collection: missing -> ``''``, text date, content cut only to a
            length that is asked for, tags folded into the metadata when
            non-empty, caller ids or sequential ids from the current row count.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.embed import embed_documents
from kestrel.functions.vectors import parse_vector_text, vector_to_text
from kestrel.session import shared_path
from kestrel.sources import layout
from kestrel.sources.tables import COLLECTION_SCHEMA, DOCUMENT_SCHEMA

# Fixed value: the longest content of the collection form, for callers who want the cut.
MAX_CONTENT_CHARS = 65000


def with_consecutive_ids(df: DataFrame, order_cols: list[str], start: int = 0,
                         name: str = "id") -> DataFrame:
    """Consecutive ids ``start, start+1, ...`` in the order of ``order_cols``.

    Distributed: a range-partitioned sort, then per-partition row counts (one
    row per partition reaches the driver) turned into offsets that are joined
    back. The sorted frame is checkpointed to the shared folder so that the
    counts and the numbering see the same layout even after a lost executor.
    """
    from kestrel.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    ordered = (df.orderBy(*order_cols)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_mid", F.monotonically_increasing_id())
               .checkpoint(eager=True))
    counts = (ordered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
              .orderBy("_pid").collect())
    offsets, acc = [], 0
    for r in counts:
        offsets.append((int(r["_pid"]), acc, int(r["_m0"])))
        acc += int(r["_n"])
    spark = df.sparkSession
    off = spark.createDataFrame(offsets, "_pid int, _off long, _m0 long")
    return (ordered.join(F.broadcast(off), "_pid")
            .withColumn(name, F.lit(int(start)) + F.col("_off") + F.col("_mid") - F.col("_m0"))
            .drop("_pid", "_mid", "_off", "_m0"))


def fold_tags(metadata, tags) -> "F.Column":
    """JSON metadata with the top-level ``tags`` set from the list when it is non-empty.
    The object is parsed: other fields keep their values, nested ones too. Text that is
    no JSON object counts as an empty one."""
    meta = F.coalesce(metadata, F.lit("{}"))
    fields = F.coalesce(F.try_variant_get(F.try_parse_json(meta), "$", "map<string,variant>"),
                        F.create_map().cast("map<string,variant>"))
    rest = F.map_filter(fields, lambda k, v: k != "tags")
    own = F.create_map(F.lit("tags"), F.parse_json(F.to_json(tags)))
    folded = F.to_json(F.to_variant_object(F.map_concat(rest, own)))
    return F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, folded).otherwise(meta)


def to_null_form(batch: DataFrame, id_col: str | None = None, start: int = 1) -> DataFrame:
    """Relational rows (A3). ``id_col`` keeps caller ids; otherwise ids are
    allocated consecutively from ``start`` in the order of ``source_id``."""
    rows = batch.select(
        *( [F.col(id_col).cast("long").alias("id")] if id_col else [F.col("source_id")] ),
        F.col("content"), F.col("embedding"), F.col("author"),
        F.to_date(F.nullif(F.col("date"), F.lit(""))).alias("date"),
        F.col("category"), F.col("tags"), F.col("source"),
        F.coalesce(F.col("metadata"), F.lit("{}")).alias("metadata"),
        F.current_timestamp().alias("created_at"))
    if not id_col:
        rows = with_consecutive_ids(rows, ["source_id"], start).drop("source_id")
    return rows.select(*[f.name for f in DOCUMENT_SCHEMA.fields])


def to_empty_form(batch: DataFrame, id_col: str | None = None, start: int = 0,
                  max_chars: int | None = None) -> DataFrame:
    """Collection rows (A4). Texts stay whole unless ``max_chars`` asks for a cut."""
    content = F.col("content") if max_chars is None else F.substring(F.col("content"), 1, max_chars)
    rows = batch.select(
        *( [F.col(id_col).cast("long").alias("id")] if id_col else [F.col("source_id")] ),
        content.alias("content"),
        F.col("embedding"),
        F.coalesce(F.col("author"), F.lit("")).alias("author"),
        F.coalesce(F.col("date").cast("string"), F.lit("")).alias("date"),
        F.coalesce(F.col("category"), F.lit("")).alias("category"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        fold_tags(F.col("metadata"), F.col("tags")).alias("metadata"))
    if not id_col:
        rows = with_consecutive_ids(rows, ["source_id"], start).drop("source_id")
    return rows.select(*[f.name for f in COLLECTION_SCHEMA.fields])


_LEDGER = "batch string, start long, n long, done boolean"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """``batch, start, n, done`` of the table at ``path``: a row when a batch's ids are reserved, and one
    when its rows are there."""
    try:
        return spark.read.schema(_LEDGER).parquet(f"{path}/ledger")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)                     # no table yet
    raise ValueError(f"{path} holds files, but no ledger of batches")


def table_at(spark: SparkSession, path: str, mode: str = "null") -> DataFrame:
    """The rows of all batches that are done."""
    schema = DOCUMENT_SCHEMA if mode == "null" else COLLECTION_SCHEMA
    stored = layout.read(spark, f"{path}/data", schema, "batch")
    return spark.createDataFrame([], schema) if stored is None else _done(spark, path, schema, stored)


def _done(spark: SparkSession, path: str, schema: T.StructType, stored: DataFrame) -> DataFrame:
    done = ledger(spark, path).filter("done").select("batch").distinct()
    # batches are folders, so that Spark can leave out those that aren't done
    return layout.shaped(stored.join(done, "batch", "left_semi"), schema)


def declare_table(spark: SparkSession, name: str, path: str, mode: str = "null") -> DataFrame:
    """The table at ``path`` under a name for SQL (A1): ``name`` are the rows of batches that are done,
    ``name_rows`` the catalog table with its declared columns and partitions. Call again after inserts."""
    schema = DOCUMENT_SCHEMA if mode == "null" else COLLECTION_SCHEMA
    rows = _done(spark, path, schema, layout.declare(spark, f"{name}_rows", f"{path}/data", schema, "batch"))
    rows.createOrReplaceTempView(f"`{name}`")
    return rows


def next_id(spark: SparkSession, path: str, mode: str) -> int:
    """Where a new batch starts: behind all ids that were ever reserved or used, from 1 (null form,
    SERIAL-like) or 0 (empty form)."""
    first = 1 if mode == "null" else 0
    end = ledger(spark, path).agg(F.max(F.col("start") + F.col("n"))).first()[0]
    return first if end is None else int(end)


def batch_name(batch: DataFrame) -> str:
    """A name for a batch by its content: the same rows have the same name, in any order."""
    parts = batch.select(F.xxhash64(*[F.to_json(F.struct(c)) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(c)
                                      for c, f in ((f.name, f) for f in batch.schema)]).alias("h"))
    r = parts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s"), F.bit_xor("h").alias("x")).first()
    return f"{r['n']}-{r['s'] or 0}-{r['x'] or 0}".replace("--", "-m")


def ingest(spark: SparkSession, batch: DataFrame, path: str | None = None, mode: str = "null",
           id_col: str | None = None, name: str | None = None) -> DataFrame:
    """Insert a batch into the table at ``path`` (a fresh table under the
    shared folder when not given) and return the whole table (A3, A4, H4).

    A batch has a name and a folder. Its ids are reserved in the ledger, its rows written, and the
    batch marked as done; readers see batches that are done. With a name from the caller (such as
    ``batch_name(batch)``), the insert can be repeated: a batch that is done is not inserted again,
    and one that was interrupted keeps its ids, and its folder is written anew. Without, each call
    is a batch of its own. Caller ids must be there, differ, and be new (``ValueError`` before
    anything is written). One writer at a time."""
    path = path or shared_path(spark, f"tables/documents_{mode}", unique=True)
    name = name or uuid.uuid4().hex
    past = [r.asDict() for r in ledger(spark, path).filter(F.col("batch") == name).collect()]     # two rows at most
    if any(r["done"] for r in past):
        return table_at(spark, path, mode)
    n = batch.count()
    if id_col:
        ids = batch.select(F.col(id_col).cast("long").alias("id"))
        bad = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").limit(5).collect()
        bad = bad or ids.join(table_at(spark, path, mode).select("id"), "id", "left_semi").limit(5).collect()
        if bad:
            raise ValueError(f"ids that repeat, are null or are in the table: {[r['id'] for r in bad]}")
        start, size = ids.agg(F.min("id"), F.max("id")).first()
        start, size = (start, size - start + 1) if n else (0, 0)
    elif past:
        start, size = past[0]["start"], past[0]["n"]
    else:
        start, size = next_id(spark, path, mode), n
    if not past:
        _noted(spark, path, name, start, size, False)
    rows = to_null_form(batch, id_col, start) if mode == "null" else to_empty_form(batch, id_col, start)
    layout.write(rows, f"{path}/data/batch={name}")
    _noted(spark, path, name, start, size, True)
    return table_at(spark, path, mode)


def _noted(spark: SparkSession, path: str, name: str, start: int, n: int, done: bool) -> None:
    spark.createDataFrame([(name, int(start), int(n), done)], _LEDGER).coalesce(1).write.mode("append").parquet(f"{path}/ledger")


# ---------------------------------------------------------------------------
# loading and export
# ---------------------------------------------------------------------------

def load_raw_documents(documents: DataFrame, num_samples: int | None = None) -> DataFrame:
    """Documents (the first ``num_samples`` if asked for): ``id`` = 0-based position,
    ``content``, ``title`` default ``''``, ``authors`` default ``[]`` (A5)."""
    cols = documents.columns
    title = F.coalesce(F.col("title"), F.lit("")) if "title" in cols else F.lit("")
    authors = (F.coalesce(F.col("authors"), F.array().cast("array<string>")) if "authors" in cols
               else F.array().cast("array<string>"))
    rows = documents if num_samples is None else documents.orderBy("doc_id").limit(num_samples)
    rows = rows.select("doc_id", F.col("text").alias("content"), title.alias("title"), authors.alias("authors"))
    return with_consecutive_ids(rows, ["doc_id"], 0).select("id", "content", "title", "authors")


def load_sample_embeddings(cache: DataFrame | None, documents: DataFrame, num_samples: int | None = None,
                           dim: int = 64) -> DataFrame:
    """The cached vectors if there is a cache (the first ``num_samples`` by id if asked
    for), else the embedded documents (A6, A7)."""
    if cache is not None:
        rows = cache.select(F.col("vec_id").alias("id"), "embedding")
        return rows if num_samples is None else rows.orderBy("id").limit(num_samples)
    return embed_documents(load_raw_documents(documents, num_samples), "id", "content", dim)


def export_embeddings(table: DataFrame, limit: int | None = None) -> DataFrame:
    """``id, embedding`` of rows with a vector, ordered by id, the first ``limit`` if
    asked for (A8, A9, G4)."""
    rows = table.select("id", "embedding").filter(F.col("embedding").isNotNull()).orderBy("id")
    return rows if limit is None else rows.limit(limit)


def vector_text_roundtrip(table: DataFrame) -> DataFrame:
    """Vector -> ``[a,b,..]`` text -> ARRAY<FLOAT> (I13): ``id, dim, exact``."""
    txt = table.select("id", "embedding", vector_to_text(F.col("embedding")).alias("txt"))
    return txt.select("id", F.size("embedding").cast("long").alias("dim"),
                      (parse_vector_text(F.col("txt")) == F.col("embedding")).alias("exact"))


def dimension_violations(vectors: DataFrame, dim: int, id_col: str = "vec_id") -> DataFrame:
    """Vectors whose size is not ``dim`` (B12): ``id, dim``."""
    return (vectors.filter(F.coalesce(F.size("embedding"), F.lit(-1)) != dim)
            .select(F.col(id_col).alias("id"), F.size("embedding").cast("long").alias("dim")))


def require_dimension(vectors: DataFrame, dim: int, id_col: str = "vec_id") -> None:
    """Strict form of B12: raise with a few offending ids."""
    bad = dimension_violations(vectors, dim, id_col).limit(5).collect()
    if bad:
        raise ValueError(f"vectors of wrong dimension (expected {dim}): {[tuple(r) for r in bad]}")


def collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection form of the fixture corpus (caller ids kept)."""
    from kestrel.sources.tables import ingest_batch
    return to_empty_form(ingest_batch(spark, sf_dir), id_col="source_id")
