"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or data Spark derives from them) in
full. Computed columns carry the same names as in :mod:`kestrel.plans.oracle`.
Doubles are rounded to 6 decimals for the oracle compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators import ann as AN
from kestrel.operators import block_index as BI
from kestrel.operators import filters as FL
from kestrel.operators import metrics as ME
from kestrel.operators import hybrid as HY
from kestrel.operators import keyword as KW
from kestrel.operators import rag as RG
from kestrel.operators import knn as K
from kestrel.operators import stats as ST
from kestrel.session import materialized, shared_path
from kestrel.sources import embed_cache as EC
from kestrel.sources import ingest as I
from kestrel.sources import tables as S

R6 = 6

# Fixed query parameters of the registered plans.
FILTERED = {"category": "en", "date_to": "2021-12-31"}


def _round(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), R6))
    return df


def knn_l2(spark: SparkSession, sf: str) -> DataFrame:
    return _round(K.knn(S.corpus(spark, sf), S.query_vectors(spark, sf), k=5, metric="l2"), "distance")


def knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _round(K.knn(S.corpus(spark, sf), S.query_vectors(spark, sf), k=5, metric="l2",
                        filters=FILTERED), "distance")


def knn_l2_squared(spark, sf):
    return _round(K.knn(S.corpus(spark, sf), S.query_vectors(spark, sf), k=5, metric="l2_squared"),
                  "distance")


def knn_ip(spark, sf):
    return _round(K.knn(S.corpus(spark, sf), S.query_vectors(spark, sf), k=5, metric="ip"), "score")


def knn_batch(spark, sf):
    """The question table as queries."""
    return _round(K.knn(S.corpus(spark, sf), S.hybrid_queries(spark, sf), k=10, metric="l2"), "distance")


SINGLE_ID = 7


def knn_single(spark, sf):
    """One query vector as a literal: a projection and a top-k, no join."""
    row = S.read_table(spark, sf, "embeddings").filter(F.col("vec_id") == SINGLE_ID).select("embedding").first()
    return _round(K.knn_single(S.corpus(spark, sf), row["embedding"], k=5, metric="l2"), "distance")


SPARSE = {"author": "author3", "category": "es"}


def knn_k_exceeds_n(spark, sf):
    return _round(K.knn(S.corpus(spark, sf), S.query_vectors(spark, sf), k=50, metric="l2",
                        filters=SPARSE), "distance")


TEXT_FILTERS = {"date_to": "2021-06-30", "tags": "src3"}


def knn_filtered_text(spark, sf):
    return _round(K.knn(I.collection(spark, sf), S.query_vectors(spark, sf), k=5, metric="l2_squared",
                        filters=TEXT_FILTERS, mode="text"), "distance")


def _label_ids(spark, sf):
    return S.read_table(spark, sf, "labels").select(F.col("doc_id").alias("id"))


def _query_ids(spark, sf):
    return _label_ids(spark, sf).filter(F.col("id") % S.QUERY_EVERY == 0)


def search_by_id(spark, sf):
    return _round(K.search_by_id(S.corpus(spark, sf), _query_ids(spark, sf), k=5, strict=False),
                  "distance")


def unknown_ids(spark, sf):
    return K.unknown_ids(S.vectors(spark, sf), _label_ids(spark, sf))


def lookup_by_id(spark, sf):
    return K.lookup_by_id(S.texts(spark, sf), _label_ids(spark, sf))


def _filter_query(filters, cols, mode="null"):
    def run(spark, sf):
        src = S.texts(spark, sf) if mode == "null" else I.collection(spark, sf)
        return FL.apply_filters(src, filters, mode).select("id", *cols)
    return run


CONJ = {"author": "author3", "category": "en", "date_from": "2020-03-01", "date_to": "2022-06-30",
        "tags": "en", "unknown_key": "ignored"}


def dimension_violations(spark, sf):
    """The stored vectors, some of them without their last component."""
    short = F.when(F.col("vec_id") % 97 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    return I.dimension_violations(S.read_table(spark, sf, "embeddings").withColumn("embedding", short), 64)


def valid_queries(spark, sf):
    return ST.valid_queries(S.query_texts(spark, sf))


def document_count(spark, sf):
    return ST.document_count(S.texts(spark, sf))


def distinct_categories(spark, sf):
    return ST.distinct_categories(S.texts(spark, sf))


def corpus_stats(spark, sf):
    return ST.corpus_stats(S.corpus(spark, sf))


def sample_queries(spark, sf):
    return ST.sample_queries(S.texts(spark, sf).select("id"), n=50, seed=42)


def export_embeddings(spark, sf):
    return I.export_embeddings(S.corpus(spark, sf))


def parse_vector_text(spark, sf):
    return I.vector_text_roundtrip(S.vectors(spark, sf))


def load_raw_documents(spark, sf):
    return I.load_raw_documents(S.read_table(spark, sf, "documents"))


def load_sample_embeddings(spark, sf):
    return I.load_sample_embeddings(S.read_table(spark, sf, "embeddings"),
                                    S.read_table(spark, sf, "documents"), dim=64)


def embed_documents(spark, sf):
    from kestrel.functions.embed import embed_documents as emb
    return emb(S.read_table(spark, sf, "documents"), dim=64)


def embed_cached(spark, sf):
    """The documents of even id are embedded first; then all, of which the cache holds some."""
    docs, path = S.read_table(spark, sf, "documents"), shared_path(spark, "embeddings", unique=True)
    EC.fill(docs.filter(F.col("doc_id") % 2 == 0), path, "hashed-64")
    return EC.embed(docs, path, id_col="doc_id")


def _json_fields(df, *extra):
    return df.select(*extra,
        "id", F.length("content").cast("long").alias("content_len"), "author", "date", "category",
        "source", F.get_json_object("metadata", "$.tags").alias("meta_tags"),
        F.get_json_object("metadata", "$.n_chars").cast("long").alias("meta_n_chars"))


def ingest_null_defaults(spark, sf):
    table = I.ingest(spark, S.ingest_batch(spark, sf), mode="null")
    return _json_fields(table, F.array_join("tags", ",").alias("tags"))


def _schema_check(table, schema):
    """``col_name, data_type, n_rows, n_null`` of an ingested table against its
    declaration (A1): a missing column or another type raises."""
    found = {f.name: f.dataType.simpleString() for f in table.schema}
    for f in schema.fields:
        if found.get(f.name) != f.dataType.simpleString():
            raise ValueError(f"{f.name}: {found.get(f.name)} for {f.dataType.simpleString()}")
    one = table.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(F.when(F.col(f.name).isNull(), 1)).alias(f.name) for f in schema.fields])
    return one.select("n_rows", F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("col_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f.name).alias("n_null"))
        for f in schema.fields])).alias("c")).select("c.col_name", "c.data_type", "n_rows", "c.n_null")


def schema_documents(spark, sf):
    return _schema_check(I.ingest(spark, S.ingest_batch(spark, sf), mode="null"), S.DOCUMENT_SCHEMA)


def schema_collection(spark, sf):
    return _schema_check(I.ingest(spark, S.ingest_batch(spark, sf), mode="empty"), S.COLLECTION_SCHEMA)


def ingest_empty_defaults(spark, sf):
    table = I.ingest(spark, S.ingest_batch(spark, sf), mode="empty")
    return _json_fields(table)


def _doc_postings(spark, sf):
    return KW.postings(S.read_table(spark, sf, "documents"), "doc_id", "text")


def postings(spark, sf):
    return _doc_postings(spark, sf)


def term_stats(spark, sf):
    return KW.term_stats(_doc_postings(spark, sf))


def query_terms(spark, sf):
    return KW.query_terms(S.query_texts(spark, sf))


#: Stored indexes of this session: (application, what, folder, tables' state) -> index. As in a
#: database, an index is built once and serves every query until its tables change.
_STORED: dict[tuple, object] = {}


def _stored(spark, sf, what, tables, build):
    key = (spark.sparkContext.applicationId, what, sf, S.version(spark, sf, *tables))
    if key not in _STORED:
        _STORED[key] = build()
    return _STORED[key]


def _stored_table(spark, sf):
    """The corpus as an ingested table with its physical layout."""
    def build():
        path = shared_path(spark, "tables/documents", unique=True)
        I.ingest(spark, S.ingest_batch(spark, sf), path, id_col="source_id")
        return path
    return I.table_at(spark, _stored(spark, sf, "table", ["documents", "embeddings"], build))


def _stored_filter(filters, cols):
    def run(spark, sf):
        return FL.apply_filters(_stored_table(spark, sf), filters).select("id", *cols)
    return run


def _corpus_index(spark, sf):
    return _stored(spark, sf, "keywords", ["documents"], lambda: KW.build_index(S.texts(spark, sf)))


def keyword_match(spark, sf):
    return KW.keyword_match(_corpus_index(spark, sf), KW.query_terms(S.query_texts(spark, sf)))


def keyword_rank(spark, sf):
    ranked = KW.keyword_rank(_corpus_index(spark, sf), KW.query_terms(S.query_texts(spark, sf)))
    return _round(ranked, "score").select("query_id", "id", "score", "rank")


def semantic_rank(spark, sf):
    return HY.semantic_rank(S.corpus(spark, sf), S.hybrid_queries(spark, sf)).select(
        "query_id", "id", "distance", "rank")


def _hybrid(spark, sf, k=5, filters=None):
    return HY.hybrid_search(S.corpus(spark, sf), S.hybrid_queries(spark, sf), k=k, filters=filters,
                            index=_corpus_index(spark, sf))


def hybrid_rrf(spark, sf):
    return _round(_hybrid(spark, sf), "rrf_score")


def hybrid_rrf_batch(spark, sf):
    return _round(_hybrid(spark, sf, k=10), "rrf_score")


def retrieve_hybrid(spark, sf):
    """Hybrid retrieval with filters on both branches."""
    return _round(HY.retrieve(S.corpus(spark, sf), S.hybrid_queries(spark, sf), k=5, use_hybrid=True,
                              filters={"category": "en"}, index=_corpus_index(spark, sf)), "rrf_score")


def retrieve_vector(spark, sf):
    return _round(HY.retrieve(S.corpus(spark, sf), S.hybrid_queries(spark, sf), k=5, use_hybrid=False,
                              filters={"source": "src3"}), "distance")


def retrieve_ivf(spark, sf):
    """Plain vector retrieval through the stored index, with a filter."""
    return _round(HY.retrieve(S.corpus(spark, sf), S.hybrid_queries(spark, sf), k=5, use_hybrid=False, filters={"source": "src3"},
                              strategy="ivfflat", ann=_blocks(spark, sf), nprobe=NPROBE), "distance")


def _vector_hits(spark, sf):
    return K.knn(S.corpus(spark, sf), S.query_vectors(spark, sf), k=5, metric="l2")


def hydrate_hits(spark, sf):
    return _round(RG.hydrate(_vector_hits(spark, sf), S.texts(spark, sf)), "distance")


def hit_cards(spark, sf):
    return RG.hit_cards(RG.hydrate(_vector_hits(spark, sf), S.texts(spark, sf)))


def _hybrid_hydrated(spark, sf):
    return RG.hydrate(_hybrid(spark, sf), S.texts(spark, sf), score="rrf_score")


def rag_context(spark, sf):
    return RG.contexts(_hybrid_hydrated(spark, sf))


def rag_prompts(spark, sf):
    return RG.prompts(S.hybrid_queries(spark, sf), _hybrid_hydrated(spark, sf))


def rag_response(spark, sf):
    q = S.hybrid_queries(spark, sf)
    hits = HY.retrieve(S.corpus(spark, sf), q, k=5, use_hybrid=False, filters={"category": "en"})
    resp = RG.responses(q, RG.hydrate(hits, S.texts(spark, sf)), engine="exact")
    return resp.select("query_id", "query", "retrieval_engine", "answer",
                       F.size("documents").cast("long").alias("n_documents"),
                       F.array_join(F.transform("documents", lambda d: d["id"].cast("string")), ",").alias("doc_ids"))


def rag_batch(spark, sf):
    from kestrel.functions.embed import embed_documents as emb
    q = S.query_texts(spark, sf)
    q = q.join(emb(q, "query_id", "text", 64).withColumnRenamed("id", "query_id"), "query_id")
    hits = HY.retrieve(S.corpus(spark, sf), q, k=5, use_hybrid=True, index=_corpus_index(spark, sf))
    return RG.prompts(q, RG.hydrate(hits, S.texts(spark, sf), score="rrf_score"))


def assemble_chunks(spark, sf):
    conv = S.read_table(spark, sf, "conversations")
    lines = conv.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("seq"),
                        F.to_json(F.struct(F.col("text").alias("response"))).alias("line"))
    return RG.assemble_chunks(lines)


# IVF and LSH settings of the registered plans: recall of 0.9 or more (README)
NLIST, NPROBE = 200, 50
BANDS, BITS, PROBES, LEAST = 32, 8, 16, 4
# (lists, probes) of the evaluation matrix
IVF_SETTINGS = ((16, 4), (100, 10), (200, 20), (200, 50))


def _ivf(spark, sf, nlist=NLIST):
    return AN.ivf_build(S.corpus(spark, sf), nlist=nlist)


def ivf_assign(spark, sf):
    return _ivf(spark, sf).table.select("id", "cluster")


def ivf_probes(spark, sf):
    return AN.probes(_ivf(spark, sf), S.query_vectors(spark, sf), NPROBE).select("query_id", "cluster")


def _blocks(spark, sf, nlist=NLIST):
    return _stored(spark, sf, ("blocks", nlist), ["documents", "embeddings"], lambda: BI.build(S.corpus(spark, sf), nlist=nlist))


def ivf_search(spark, sf):
    return _round(BI.search(_blocks(spark, sf), S.query_vectors(spark, sf), k=5, nprobe=NPROBE), "distance")


def ivf_exhaustive(spark, sf):
    return _round(BI.search(_blocks(spark, sf), S.query_vectors(spark, sf), k=5, nprobe=NLIST), "distance")


def ivf_reloaded_search(spark, sf):
    """The index opened again from its folder and searched by another number of probes."""
    index = BI.load(spark, _blocks(spark, sf).path)
    return _round(BI.search(index, S.query_vectors(spark, sf), k=5, nprobe=2 * NPROBE), "distance")


def ivf_filtered(spark, sf):
    return _round(BI.search(_blocks(spark, sf), S.query_vectors(spark, sf), k=5, nprobe=NPROBE, filters=FILTERED), "distance")


def ivf_filtered_sparse(spark, sf):
    return _round(BI.search(_blocks(spark, sf), S.query_vectors(spark, sf), k=5, nprobe=NPROBE, filters=SPARSE), "distance")


def ivf_adaptive(spark, sf):
    """Rings are opened until the bound rules out the rest: the rows of exact search."""
    return _round(BI.search_exact(_blocks(spark, sf), S.query_vectors(spark, sf), k=5)[0], "distance")


def ivf_adaptive_filtered(spark, sf):
    return _round(BI.search_exact(_blocks(spark, sf), S.query_vectors(spark, sf), k=5, metric="l2_squared", filters=SPARSE)[0], "distance")


def ann_lsh_codes(spark, sf):
    return AN.lsh_codes(S.corpus(spark, sf), bands=BANDS, bits=BITS)


def _lsh_hits(spark, sf, k=5):
    return AN.lsh_search(S.corpus(spark, sf), S.query_vectors(spark, sf), k=k, bands=BANDS, bits=BITS, probes=PROBES, least=LEAST)


def _lsh_filtered(filters):
    def run(spark, sf):
        return _round(AN.lsh_search(S.corpus(spark, sf), S.query_vectors(spark, sf), k=5, bands=BANDS, bits=BITS, probes=PROBES, least=LEAST,
                                    filters=filters), "distance")
    return run


def ann_lsh(spark, sf):
    return _round(_lsh_hits(spark, sf), "distance")


def _truth(spark, sf, k=5):
    return ME.exact_truth(K.knn(S.corpus(spark, sf), S.query_vectors(spark, sf), k=k))


def _lsh_quality(spark, sf, gt_k=5):
    return ME.recall_precision(_lsh_hits(spark, sf), _truth(spark, sf, gt_k), 5)


def recall_at_k(spark, sf):
    q = _lsh_quality(spark, sf)
    return _round(q.select(F.lit("lsh").alias("strategy"), "k", "n_queries", "recall", "precision"),
                  "recall", "precision")


def recall_vs_gt(spark, sf):
    q = _lsh_quality(spark, sf, gt_k=50)
    return _round(q.select(F.lit("lsh").alias("strategy"), "k", F.lit(50).cast("long").alias("gt_k"),
                           "n_queries", "recall", "precision"), "recall", "precision")


def f1_at_k(spark, sf):
    return _round(_lsh_quality(spark, sf).select(F.lit("lsh").alias("strategy"), "k", "f1"), "f1")


def mrr(spark, sf):
    return _round(_lsh_quality(spark, sf).select(F.lit("lsh").alias("strategy"), "k", "mrr"), "mrr")


def _samples(spark, sf):
    return ME.samples_from_events(S.read_table(spark, sf, "events"))


LAT_COLS = ("cold_ms", "warm_ms", "p50_ms", "p95_ms", "p99_ms", "throughput_qps")


def latency_summary(spark, sf):
    return _round(ME.latency_summary(_samples(spark, sf)), *LAT_COLS)


def latency_percentiles(spark, sf):
    return _round(ME.latency_percentiles(_samples(spark, sf)), "p50_ms", "p95_ms", "p99_ms")


def latency_speedup(spark, sf):
    return _round(ME.latency_speedup(ME.latency_summary(_samples(spark, sf)), "view"), "warm_ms", "speedup")


def latency_target_check(spark, sf):
    return _round(ME.latency_target_check(ME.latency_summary(_samples(spark, sf))), "warm_ms")


def _strategy_row(name, hits, truth, share):
    q = ME.recall_precision(hits, truth, 5)
    return q.select(F.lit(name).alias("strategy"), "k", "n_queries", "recall", "precision", "f1", "mrr",
                    share.alias("share"))


def eval_matrix(spark, sf):
    corpus, qv = S.corpus(spark, sf), S.query_vectors(spark, sf)
    exact = materialized(K.knn(corpus, qv, k=5))
    truth = ME.exact_truth(exact)
    rows = [_strategy_row("exact", exact, truth, F.lit(1.0))]
    for nlist, nprobe in IVF_SETTINGS:
        index = _blocks(spark, sf, nlist)
        rows.append(_strategy_row(f"ivf_{nlist}_{nprobe}", BI.search(index, qv, k=5, nprobe=nprobe), truth,
                                  F.lit(BI.share(index, qv, 5, nprobe))))
    met = AN.lsh_levels(corpus, qv, BANDS, BITS, probes=PROBES, least=LEAST).filter(F.col("level") == LEAST)
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()
    rows.append(_strategy_row(f"lsh_{BANDS}_{BITS}", _lsh_hits(spark, sf), truth,
                              met.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar() / (n(qv) * n(S.vectors(spark, sf)))))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return _round(out, "recall", "precision", "f1", "mrr", "share")


def _recall_rows(spark, sf):
    corpus, qv = S.corpus(spark, sf), S.query_vectors(spark, sf)
    exact = materialized(K.knn(corpus, qv, k=5))
    row = lambda kind, hits: ME.recall_precision(hits, ME.exact_truth(exact), 5).select(
        F.lit("kestrel").alias("engine"), F.lit(kind).alias("index_type"), "*")
    return row("exact", exact).unionByName(row("lsh", _lsh_hits(spark, sf)))


def eval_report(spark, sf):
    return _round(ME.report_rows(ME.latency_summary(_samples(spark, sf)), _recall_rows(spark, sf)), "value")


def eval_report_header(spark, sf):
    """The nested report, its header and the sizes of its lists."""
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    report = ME.report_json(ME.latency_summary(_samples(spark, sf)), _recall_rows(spark, sf), count(S.vectors(spark, sf)), 64,
                            count(S.query_vectors(spark, sf)))
    return report.select("dataset_size", "dimension", "num_queries", F.size("latency_results").cast("long").alias("n_latency"),
                         F.array_join(F.transform("recall_results", lambda r: F.concat_ws("/", r["engine"], r["index_type"])), ",")
                         .alias("recall_of"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "knn_l2": knn_l2,
    "knn_filtered": knn_filtered,
    "knn_l2_squared": knn_l2_squared,
    "knn_ip": knn_ip,
    "knn_batch": knn_batch,
    "knn_single": knn_single,
    "knn_k_exceeds_n": knn_k_exceeds_n,
    "knn_filtered_text": knn_filtered_text,
    "search_by_id": search_by_id,
    "unknown_ids": unknown_ids,
    "lookup_by_id": lookup_by_id,
    "filter_author": _filter_query({"author": "author3"}, ["author"]),
    "filter_category": _filter_query({"category": "fr"}, ["category"]),
    "filter_date_range": _filter_query({"date_from": "2020-06-01", "date_to": "2021-06-30"}, ["date"]),
    "filter_date_text": _filter_query({"date_to": "2021-06-30"}, ["date"], mode="text"),
    "filter_tag": _filter_query({"tags": "src3"}, ["source"]),
    "filter_tag_json": _filter_query({"tags": "src3"}, ["source"], mode="text"),
    "filter_source": _filter_query({"source": "src5"}, ["source"]),
    "filter_conjunction": _filter_query(CONJ, ["author", "category", "date", "source"]),
    "stored_filter_author": _stored_filter({"author": "author3"}, ["author"]),
    "stored_filter_category": _stored_filter({"category": "fr"}, ["category"]),
    "stored_filter_date_range": _stored_filter({"date_from": "2020-06-01", "date_to": "2021-06-30"}, ["date"]),
    "stored_filter_conjunction": _stored_filter(CONJ, ["author", "category", "date", "source"]),
    "dimension_violations": dimension_violations,
    "valid_queries": valid_queries,
    "document_count": document_count,
    "distinct_categories": distinct_categories,
    "corpus_stats": corpus_stats,
    "sample_queries": sample_queries,
    "export_embeddings": export_embeddings,
    "parse_vector_text": parse_vector_text,
    "load_raw_documents": load_raw_documents,
    "load_sample_embeddings": load_sample_embeddings,
    "embed_documents": embed_documents,
    "embed_cached": embed_cached,
    "ingest_null_defaults": ingest_null_defaults,
    "ingest_empty_defaults": ingest_empty_defaults,
    "schema_documents": schema_documents,
    "schema_collection": schema_collection,
    "postings": postings,
    "term_stats": term_stats,
    "query_terms": query_terms,
    "keyword_match": keyword_match,
    "keyword_rank": keyword_rank,
    "semantic_rank": semantic_rank,
    "hybrid_rrf": hybrid_rrf,
    "hybrid_rrf_batch": hybrid_rrf_batch,
    "retrieve_vector": retrieve_vector,
    "retrieve_hybrid": retrieve_hybrid,
    "hydrate_hits": hydrate_hits,
    "hit_cards": hit_cards,
    "rag_context": rag_context,
    "rag_prompts": rag_prompts,
    "rag_response": rag_response,
    "rag_batch": rag_batch,
    "assemble_chunks": assemble_chunks,
    "ivf_assign": ivf_assign,
    "ivf_probes": ivf_probes,
    "ivf_search": ivf_search,
    "ivf_exhaustive": ivf_exhaustive,
    "ivf_reloaded_search": ivf_reloaded_search,
    "ivf_filtered": ivf_filtered,
    "ivf_filtered_sparse": ivf_filtered_sparse,
    "ivf_adaptive": ivf_adaptive,
    "ivf_adaptive_filtered": ivf_adaptive_filtered,
    "lsh_filtered": _lsh_filtered(FILTERED),
    "lsh_filtered_sparse": _lsh_filtered(SPARSE),
    "retrieve_ivf": retrieve_ivf,
    "ann_lsh_codes": ann_lsh_codes,
    "ann_lsh": ann_lsh,
    "recall_at_k": recall_at_k,
    "recall_vs_gt": recall_vs_gt,
    "f1_at_k": f1_at_k,
    "mrr": mrr,
    "latency_summary": latency_summary,
    "latency_percentiles": latency_percentiles,
    "latency_speedup": latency_speedup,
    "latency_target_check": latency_target_check,
    "eval_matrix": eval_matrix,
    "eval_report": eval_report,
    "eval_report_header": eval_report_header,
}
