"""Edge cases of SURVEY section 5: empty inputs, no filter match, no hits."""

from conftest import SF01, vec_frame
from kestrel.operators import hybrid as HY
from kestrel.operators import knn as K
from kestrel.operators import rag as RG
from kestrel.sources import ingest as I
from kestrel.sources import tables as S


def test_empty_corpus_and_empty_queries(spark):
    empty = spark.createDataFrame([], "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [0.0, 1.0])], "query_id long, embedding array<float>")
    assert K.knn(empty, q, k=5).count() == 0
    noq = spark.createDataFrame([], "query_id long, embedding array<float>")
    assert K.knn(vec_frame(spark, [(1, [0.0, 1.0])]), noq, k=5).count() == 0


def test_no_filter_match_gives_no_hits_and_fixed_answer(spark):
    corpus = S.corpus(spark, SF01)
    q = S.hybrid_queries(spark, SF01)
    hits = HY.retrieve(corpus, q, k=5, use_hybrid=False, filters={"category": "no-such"})
    assert hits.count() == 0
    out = RG.prompts(q, RG.hydrate(hits, corpus)).collect()
    assert out and all(r["prompt"] is None and r["answer"] == RG.NO_HITS_ANSWER for r in out)


def test_null_metadata_defaults(spark):
    corpus = S.corpus(spark, SF01)
    ids = corpus.filter("metadata IS NULL").select("id").limit(3)
    rows = K.lookup_by_id(corpus, ids).collect()
    assert rows and all(r["metadata"] == "{}" and r["distance"] == 0.0 for r in rows)


def test_duplicate_requested_ids_collapse(spark):
    corpus = S.corpus(spark, SF01)
    ids = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    assert K.lookup_by_id(corpus, ids).count() == 2


def test_raw_documents_are_numbered_in_order(spark):
    docs = S.read_table(spark, SF01, "documents")
    ids = sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    every = {r["id"]: r["content"] for r in I.load_raw_documents(docs.repartition(5)).collect()}
    assert every == {k: texts[i] for k, i in enumerate(ids)}
    assert sorted(r["id"] for r in I.load_raw_documents(docs, 300).collect()) == list(range(300))


def test_documents_without_a_vector_are_documents(spark):
    corpus = S.corpus(spark, SF01)
    bare = corpus.filter("embedding IS NULL").select("id").limit(2)
    assert corpus.count() == S.read_table(spark, SF01, "documents").count()
    assert K.lookup_by_id(corpus, bare).count() == 2
    hits = K.knn(corpus, S.query_vectors(spark, SF01), k=3)
    assert hits.join(corpus.filter("embedding IS NULL"), "id").count() == 0
