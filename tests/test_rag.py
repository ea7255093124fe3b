import json

from kestrel.operators import rag as RG


def test_chunks_blank_and_missing(spark):
    lines = spark.createDataFrame(
        [(1, 0, json.dumps({"response": "Hel"})), (1, 2, json.dumps({"response": "!"})),
         (1, 1, json.dumps({"response": "lo"})), (1, 3, "   "), (1, 4, json.dumps({"done": True})),
         (2, 0, json.dumps({"other": 1}))], "request_id long, seq long, line string")
    out = {r["request_id"]: r["response"] for r in RG.assemble_chunks(lines).collect()}
    assert out == {1: "Hello!", 2: ""}


def _hits(spark):
    return spark.createDataFrame(
        [(1, 2, 20, 0.5, "second", None), (1, 1, 10, 0.25, "first", '{"author":"","tags":["t1","t2"]}')],
        "query_id long, rank long, id long, distance double, content string, metadata string")


def test_context_and_prompt_and_no_hits(spark):
    q = spark.createDataFrame([(1, "What?"), (2, "Nothing?")], "query_id long, text string")
    out = {r["query_id"]: r for r in RG.prompts(q, _hits(spark)).collect()}
    assert "Document 10: first\n\nDocument 20: second" in out[1]["prompt"]
    assert out[1]["prompt"].endswith("Question: What?\nAnswer:")
    assert out[1]["answer"] is None and out[1]["n_hits"] == 2
    assert out[2]["prompt"] is None and out[2]["answer"] == RG.NO_HITS_ANSWER


def test_cards_defaults(spark):
    cards = {r["id"]: r for r in RG.hit_cards(_hits(spark).fillna({"metadata": "{}"})).collect()}
    assert cards[10]["score"] == "0.2500" and cards[10]["author"] == "arXiv"
    assert cards[10]["category"] == "cs.AI" and cards[10]["tags"] == "t1,t2"
    assert cards[20]["tags"] == ""


def test_answer_step_runs_on_executors(spark):
    q = spark.createDataFrame([(1, "What?"), (2, "Nothing?")], "query_id long, text string")
    answered = RG.answer_with(RG.prompts(q, _hits(spark)), lambda ps: [f"len={len(p)}" for p in ps])
    out = {r["query_id"]: r["answer"] for r in answered.collect()}
    assert out[1].startswith("len=") and out[2] == RG.NO_HITS_ANSWER


def test_responses(spark):
    q = spark.createDataFrame([(1, "What?"), (2, "Nothing?")], "query_id long, text string")
    out = {r["query_id"]: r for r in RG.responses(q, _hits(spark), "exact").collect()}
    assert [d["id"] for d in out[1]["documents"]] == [10, 20]
    assert out[2]["documents"] == [] and out[2]["answer"] == RG.NO_HITS_ANSWER
