"""run() against a plain version of its stages."""

import re
import sys

import numpy as np
import public_tokenizers as P
from conftest import ROOT, SF001

sys.path.insert(0, ROOT)

import corpus_pipeline  # noqa: E402
from kestrel.llm import lsa_decontam as D  # noqa: E402
from kestrel.llm import sentencepiece_nbest as S  # noqa: E402
from kestrel.llm import stream_dedup, subword_langid  # noqa: E402
from test_llm_dedup import brute  # noqa: E402


def test_pipeline_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = subword_langid.train(docs)
    ids = sorted(rows)
    _, _, rejected = subword_langid.predict(model, [rows[i] for i in ids])
    left = {i: rows[i] for i, no in zip(ids, rejected) if not no}
    assert len(left) > 0.98 * len(rows)
    seen = {}
    for i in sorted(left):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i]), i)
    left = {i: left[i] for i in seen.values()}
    label = brute(left.items(), 5)
    left = {i: t for i, t in left.items() if label[i][1] == i}
    flat = lambda t: b" " + b" ".join(D.words_of(t)) + b" "
    items = [flat(r["text"]) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(x in flat(t) for x in items)}
    pieces = S.pieces(open(P.path("piece_bpe_32k.model"), "rb").read())
    want = {i: np.frombuffer(pieces.encode(t, 1)[0][1], np.int32).tolist() for i, t in left.items()}
    got = corpus_pipeline.run(spark, SF001).collect()
    assert {r["doc_id"]: list(r["pieces"]) for r in got} == want and len(got) == len(want)
    assert all(r["round_trip"] and r["n_pieces"] == len(r["pieces"]) for r in got)


def test_stages_keep_the_columns():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "encoding"]
    assert stream_dedup and corpus_pipeline.ORACLE_SQL is None


def test_encoding_returns_the_following_segmentations(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(20)
    pieces = S.pieces(open(P.path("piece_bpe_32k.model"), "rb").read())
    want = {r["doc_id"]: [(round(x, 3), np.frombuffer(ids, np.int32).tolist()) for x, ids in pieces.encode(r["text"])[1:]] for r in docs.collect()}
    got = {r["doc_id"]: [(round(o["score"], 3), list(o["pieces"])) for o in r["others"]]
           for r in corpus_pipeline.encoding(spark, docs, SF001).collect()}
    assert got == want and all(len(o) == S.N_BEST - 1 for o in got.values())
