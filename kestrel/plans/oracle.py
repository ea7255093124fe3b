"""DuckDB SQL for every value-checked query of the catalog.

Each string runs on DuckDB with the driver tables registered as views. The
corpus view and a few shared pieces are CTEs prepended to the queries.
Doubles are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from kestrel.functions.text import STOP_WORDS, TOKEN_PATTERN
from kestrel.operators import rag as RG
from kestrel.sources.tables import COLLECTION_SCHEMA, DOCUMENT_SCHEMA

CORPUS_CTE = """corpus AS (
  SELECT d.doc_id AS id, d.text AS content, e.embedding,
         CASE WHEN d.doc_id % 11 = 0 THEN NULL
              ELSE concat('author', CAST(d.doc_id % 17 AS VARCHAR)) END AS author,
         CASE WHEN d.doc_id % 13 = 0 THEN NULL
              ELSE CAST(DATE '2020-01-01' + CAST(d.doc_id % 1000 AS INTEGER) AS DATE) END AS date,
         d.lang AS category, [d.lang, d.source] AS tags, d.source,
         CASE WHEN d.doc_id % 7 = 0 THEN NULL
              ELSE concat('{"tags":["', d.lang, '","', d.source, '"],"n_chars":',
                          CAST(d.n_chars AS VARCHAR), '}') END AS metadata
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"""

# collection form: '' defaults, text date, tags folded into the metadata
COLLECTION_CTE = """collection AS (
  SELECT id, content, embedding, coalesce(author, '') AS author,
         coalesce(CAST(date AS VARCHAR), '') AS date, coalesce(category, '') AS category,
         coalesce(source, '') AS source,
         CASE WHEN len(tags) > 0
              THEN CASE WHEN metadata IS NULL THEN concat('{"tags":', to_json(tags), '}')
                        ELSE concat('{"n_chars":', json_extract_string(metadata, '$.n_chars'),
                                    ',"tags":', to_json(tags), '}') END
              ELSE coalesce(metadata, '{}') END AS metadata
  FROM corpus)"""

QUERIES_CTE = "queries AS (SELECT vec_id AS query_id, embedding AS q_emb FROM embeddings WHERE vec_id % 50 = 0)"

HYBRID_QUERIES_CTE = """hq AS (
  SELECT b.item_id AS query_id, b.text, e.embedding AS q_emb
  FROM benchmark b JOIN embeddings e ON b.item_id = e.vec_id)"""


def stop_words_sql() -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)


def tokens_cte(source: str, id_col: str, text_col: str, name: str = "tok") -> str:
    """All tokens with 0-based positions, as rows (id, pos, term)."""
    return f"""{name} AS (
  SELECT {id_col} AS id, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS pos, unnest(t) AS term
  FROM (SELECT {id_col}, regexp_extract_all(lower({text_col}), '{TOKEN_PATTERN}') AS t FROM {source}))"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def dist_sql(metric: str, a: str, b: str) -> str:
    if metric == "l2":
        return f"list_distance({a}::DOUBLE[], {b}::DOUBLE[])"
    if metric == "l2_squared":
        return f"list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"


def knn_sql(metric: str, k: int, source: str = "corpus", where: str = "",
            queries: str = "queries", name: str | None = None) -> str:
    name = name or ("score" if metric == "ip" else "distance")
    order = f"{name} DESC, id" if metric == "ip" else f"{name}, id"
    return f"""SELECT query_id, rank, id, round({name}, 6) AS {name} FROM (
  SELECT query_id, id, {name}, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank
  FROM (SELECT q.query_id, c.id, {dist_sql(metric, 'c.embedding', 'q.q_emb')} AS {name}
        FROM {source} c CROSS JOIN {queries} q WHERE c.embedding IS NOT NULL AND ({where or 'true'})))
WHERE rank <= {k}"""


def _q(*ctes: str):
    return lambda body: with_ctes(*ctes) + body


_C = _q(CORPUS_CTE, QUERIES_CTE)



def keyword_ctes(question_sql: str, where: str = "true") -> list[str]:
    """CTEs: post (corpus postings), qt, nt, m (matches), sc (scores)."""
    sw = stop_words_sql()
    return [
        tokens_cte(f"(SELECT * FROM corpus c WHERE {where})", "id", "content"),
        f"post AS (SELECT id, term, pos FROM tok WHERE term NOT IN ({sw}))",
        f"""qt AS (SELECT DISTINCT query_id, term FROM (
  SELECT query_id, unnest(regexp_extract_all(lower(text), '{TOKEN_PATTERN}')) AS term FROM ({question_sql}))
  WHERE term NOT IN ({sw}))""",
        "nt AS (SELECT query_id, count(*) AS n_terms FROM qt GROUP BY query_id)",
        """m AS (SELECT h.query_id, h.id FROM (
  SELECT qt.query_id, dt.id, count(*) AS n_hit FROM qt JOIN (SELECT DISTINCT id, term FROM post) dt
  ON qt.term = dt.term GROUP BY qt.query_id, dt.id) h JOIN nt ON h.query_id = nt.query_id
  WHERE h.n_hit = nt.n_terms)""",
        """mpr AS (SELECT p.id, p.pos, p.term, qt.query_id,
  row_number() OVER (PARTITION BY qt.query_id, p.id ORDER BY p.pos) AS rn
  FROM post p JOIN qt ON p.term = qt.term JOIN m ON m.query_id = qt.query_id AND m.id = p.id)""",
        """la AS (SELECT mpr.query_id, mpr.id, mpr.pos, mpr.rn,
  max(CASE WHEN mpr.term = t.term THEN mpr.pos END) OVER w AS last_pos,
  max(CASE WHEN mpr.term = t.term THEN mpr.rn END) OVER w AS last_rn
  FROM mpr JOIN qt t ON mpr.query_id = t.query_id
  WINDOW w AS (PARTITION BY mpr.query_id, mpr.id, t.term ORDER BY mpr.pos
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
        """lf AS (SELECT l.query_id, l.id, l.pos, l.rn, min(l.last_pos) AS lft, min(l.last_rn) AS left_rn,
  count(l.last_pos) AS n_seen FROM la l GROUP BY l.query_id, l.id, l.pos, l.rn)""",
        """cv AS (SELECT lf.query_id, lf.id, lft, left_rn, min(pos) AS q, min(rn) AS q_rn
  FROM lf JOIN nt ON lf.query_id = nt.query_id WHERE n_seen = n_terms
  GROUP BY lf.query_id, lf.id, lft, left_rn)""",
        """sc AS (SELECT query_id, id,
  round(sum(0.1::DOUBLE / (1 + ((q - lft) - (q_rn - left_rn)))), 9) AS score
  FROM cv GROUP BY query_id, id)""",
    ]


BENCH_Q = "SELECT item_id AS query_id, text FROM benchmark"


def hybrid_ctes(k: int = 5, candidates: int = 20, c: int = 60, where: str = "true", questions: str = HYBRID_QUERIES_CTE) -> list[str]:
    return [CORPUS_CTE, questions, *keyword_ctes("SELECT query_id, text FROM hq", where),
            f"""sem AS (SELECT query_id, id, rank() OVER (PARTITION BY query_id ORDER BY distance) AS s_rank
  FROM ({knn_sql('l2', candidates, queries='hq', where=where)}))""",
            f"""kw AS (SELECT query_id, id, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS k_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM sc)
  WHERE rn <= {candidates})""",
            f"""fused AS (SELECT coalesce(s.query_id, k.query_id) AS query_id, coalesce(s.id, k.id) AS id,
  coalesce(1.0::DOUBLE / ({c} + s.s_rank), 0.0) + coalesce(1.0::DOUBLE / ({c} + k.k_rank), 0.0) AS rrf_score
  FROM sem s FULL OUTER JOIN kw k ON s.query_id = k.query_id AND s.id = k.id)""",
            f"""hyb AS (SELECT query_id, rank, id, rrf_score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, id) AS rank FROM fused)
  WHERE rank <= {k})"""]


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PROMPT_SQL = (f"concat({literal(RG.PROMPT_HEAD)}, ctx.context, {literal(RG.PROMPT_QUESTION)}, hq.text, "
              f"{literal(RG.PROMPT_TAIL)})")

CONTEXT_SQL = ("string_agg(concat('Document ', CAST(h.id AS VARCHAR), ': ', c.content), chr(10) || chr(10) "
               "ORDER BY h.rank, h.id)")



#: Settings of the registered searches, as in the catalog.
BANDS, BITS, PROBES, LEAST, ENOUGH = 32, 8, 16, 4, 125
NLIST, NPROBE = 200, 50
IVF_SETTINGS = ((16, 4), (100, 10), (200, 20), (200, 50))


def lsh_dots_cte(name: str, source: str, id_col: str, emb_col: str, dim: int = 64) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT ev.id, p.band, p.bit, sum(ev.v * p.s) AS dot
  FROM (SELECT {id_col} AS id, CAST(generate_subscripts({emb_col}, 1) - 1 AS BIGINT) AS d,
               CAST(unnest({emb_col}) AS DOUBLE) AS v FROM {source}) ev
  JOIN (SELECT l AS band, j AS bit, dd AS d,
               CASE WHEN substr(md5(concat(l, ':', j, ':', dd)), 1, 1) < '8' THEN 1.0 ELSE -1.0 END AS s
        FROM range({BANDS}) t1(l), range({BITS}) t2(j), range({dim}) t3(dd)) p ON ev.d = p.d
  GROUP BY ev.id, p.band, p.bit)"""


def lsh_codes_cte(name: str, dots: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT id, CAST(band AS INTEGER) AS band,
  CAST(sum(CASE WHEN dot >= 0 THEN (CAST(1 AS BIGINT) << CAST(bit AS INTEGER)) ELSE 0 END) AS BIGINT) AS code
  FROM {dots} GROUP BY id, band)"""


def lsh_ctes(where: str | None = None) -> list[str]:
    """``cand`` (query_id, id) and ``lsh`` (query_id, rank, id, distance): pairs that meet in enough bands."""
    met = """met AS MATERIALIZED (SELECT q.id AS query_id, c.id, count(*) AS hits FROM qprobes q JOIN ccodes c
  ON q.band = c.band AND q.code = c.code GROUP BY q.id, c.id)"""
    pick = f"cand AS (SELECT query_id, id FROM met WHERE hits >= {LEAST})"
    if where:
        pick = f"""levels AS (SELECT query_id, least(hits, {LEAST}) AS level, count(*) AS n FROM met GROUP BY ALL),
above AS (SELECT query_id, level, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY level DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM levels),
taken AS (SELECT query_id, min(level) AS level FROM above WHERE above < {ENOUGH} GROUP BY query_id),
cand AS (SELECT m.query_id, m.id FROM met m JOIN taken t ON t.query_id = m.query_id WHERE m.hits >= t.level)"""
    return [CORPUS_CTE, QUERIES_CTE, f"kept AS (SELECT * FROM corpus c WHERE {where or 'true'})",
            lsh_dots_cte("cdots", "kept", "id", "embedding"), lsh_codes_cte("ccodes", "cdots"),
            lsh_dots_cte("qdots", "queries", "query_id", "q_emb"), lsh_codes_cte("qcodes", "qdots"),
            f"""qprobes AS MATERIALIZED (SELECT id, band, code FROM (
  SELECT f.id, f.band, xor(c.code, f.flip) AS code,
         row_number() OVER (PARTITION BY f.id, f.band ORDER BY f.cost, xor(c.code, f.flip)) AS n
  FROM (SELECT d.id, CAST(d.band AS INTEGER) AS band, x.flip,
               sum(CASE WHEN (x.flip >> CAST(d.bit AS INTEGER)) & 1 = 1 THEN d.dot * d.dot ELSE 0.0 END) AS cost
        FROM qdots d CROSS JOIN range({1 << BITS}) x(flip) GROUP BY d.id, d.band, x.flip) f
  JOIN qcodes c ON c.id = f.id AND c.band = f.band) WHERE n <= {PROBES})""",
            met, pick,
            f"""lsh AS (SELECT query_id, rank, id, distance FROM (
  SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
    SELECT cand.query_id, cand.id, {dist_sql('l2', 'c.embedding', 'q.q_emb')} AS distance
    FROM cand JOIN corpus c ON c.id = cand.id JOIN queries q ON q.query_id = cand.query_id) s)
  WHERE rank <= 5)"""]


LSH_CTES = lsh_ctes()


def quality_ctes(results: str, truth_k: int, p: str = "") -> list[str]:
    """Quality of a result CTE; the names of its CTEs begin with ``p``."""
    return [f"{p}truth AS MATERIALIZED (SELECT query_id, id FROM ({knn_sql('l2', truth_k)}))",
            f"{p}ntr AS (SELECT query_id, count(*) AS n_truth FROM {p}truth GROUP BY query_id)",
            f"""{p}hits AS (SELECT r.query_id, count(*) AS n_hit, min(r.rank) AS first_hit
  FROM (SELECT query_id, id, min(rank) AS rank FROM {results} WHERE rank <= 5 GROUP BY query_id, id) r
  JOIN {p}truth t ON r.query_id = t.query_id AND r.id = t.id GROUP BY r.query_id)""",
            f"""{p}qq AS (SELECT ntr.query_id, n_truth, coalesce(n_hit, 0) AS n_hit, first_hit
  FROM {p}ntr ntr LEFT JOIN {p}hits hits ON hits.query_id = ntr.query_id)""",
            f"""{p}qa AS (SELECT count(*) AS n_queries, coalesce(avg(n_hit / n_truth), 0.0) AS recall,
  coalesce(avg(n_hit / 5.0), 0.0) AS precision, coalesce(avg(coalesce(1.0 / first_hit, 0.0)), 0.0) AS mrr FROM {p}qq)"""]


def ivf_ctes(nlist: int, nprobe: int, p: str = "iv", steps: int = 4, where: str | None = None, queries: str = "queries") -> list[str]:
    """Oversampled seeds and Lloyd steps over all vectors: ``{p}a`` (id, v, cluster, ok), ``{p}p``
    (query_id, cluster), ``{p}h`` (query_id, rank, id, distance), ``{p}s`` (share), ``{p}c`` (centroids)."""
    def nearest(points, key, vec, cents, n, name="cluster", more=""):
        return (f"SELECT {key}, {vec} AS v, {name}{more} FROM (SELECT x.*, c.{name}, row_number() OVER (PARTITION BY x.{key} "
                f"ORDER BY list_distance(x.{vec}, c.v), c.{name}) AS n FROM {points} x CROSS JOIN {cents} c) WHERE n <= {n}")

    out = [f"{p}v AS MATERIALIZED (SELECT id, embedding::DOUBLE[] AS v, coalesce({where or 'true'}, false) AS ok FROM corpus c WHERE embedding IS NOT NULL)",
           f"{p}s0 AS MATERIALIZED (SELECT id AS centre, v FROM {p}v ORDER BY md5(concat(id, ':0')), id LIMIT 1)"]
    for k in range(1, 5):
        out += [f"""{p}d{k} AS MATERIALIZED (SELECT x.id, any_value(x.v) AS v, round(min(list_distance(x.v, c.v) * list_distance(x.v, c.v)), 6) AS d2
  FROM {p}v x CROSS JOIN {p}s{k - 1} c GROUP BY x.id)""",
                f"""{p}s{k} AS MATERIALIZED (SELECT centre, v FROM {p}s{k - 1} UNION ALL SELECT id, v FROM {p}d{k}
  WHERE CAST(CAST('0x' || substr(md5(concat(id, ':{k}')), 1, 8) AS BIGINT) AS DOUBLE)
        * (SELECT CAST(sum(CAST(d2 AS DECIMAL(28,6))) AS DOUBLE) FROM {p}d{k}) < {float(2 * nlist * 2 ** 32)} * d2)"""]
    out += [f"{p}w AS MATERIALIZED ({nearest(p + 'v', 'id', 'v', p + 's4', 1, 'centre')})",
            f"""{p}c0 AS MATERIALIZED (SELECT cluster, v FROM (SELECT list_transform(s.v, lambda z: round(z, 6)) AS v,
  CAST(row_number() OVER (ORDER BY coalesce(w.n, 0) DESC, s.centre) - 1 AS INTEGER) AS cluster
  FROM {p}s4 s LEFT JOIN (SELECT centre, count(*) AS n FROM {p}w GROUP BY centre) w ON w.centre = s.centre) WHERE cluster < {nlist})"""]
    for k in range(steps):
        out += [f"{p}a{k} AS MATERIALIZED ({nearest(p + 'v', 'id', 'v', f'{p}c{k}', 1)})",
                f"""{p}c{k + 1} AS MATERIALIZED (SELECT cluster, list(m ORDER BY d) AS v FROM (
  SELECT cluster, d, round(sum(z) / count(*), 6) AS m FROM (SELECT cluster, generate_subscripts(v, 1) AS d, unnest(v) AS z FROM {p}a{k})
  GROUP BY cluster, d) GROUP BY cluster
  UNION ALL SELECT cluster, v FROM {p}c{k} WHERE cluster NOT IN (SELECT cluster FROM {p}a{k}))"""]
    need = f"greatest(5, {nprobe} * (SELECT count(*) FROM {p}v) / (SELECT count(*) FROM {p}c))" if where else "5"
    return out + [
        f"{p}c AS (SELECT * FROM {p}c{steps})",
        f"{p}a AS MATERIALIZED ({nearest(p + 'v', 'id', 'v', f'{p}c{steps}', 1, more=', ok')})",
        f"{p}q AS (SELECT query_id, q_emb::DOUBLE[] AS qv FROM {queries})",
        f"{p}n AS (SELECT cluster, count(*) AS n FROM {p}a WHERE ok GROUP BY cluster)",
        f"""{p}p AS MATERIALIZED (SELECT query_id, qv AS v, cluster FROM (
  SELECT q.query_id, q.qv, c.cluster, row_number() OVER w AS nth,
         coalesce(sum(n.n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM {p}q q CROSS JOIN {p}c c JOIN {p}n n ON n.cluster = c.cluster
  WINDOW w AS (PARTITION BY q.query_id ORDER BY list_distance(c.v, q.qv), c.cluster)) WHERE nth <= {nprobe} OR ahead < {need})""",
        f"""{p}h AS (SELECT query_id, rank, id, distance FROM (SELECT query_id, id, distance,
  row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
  SELECT q.query_id, a.id, list_distance(a.v, q.v) AS distance FROM {p}p q JOIN {p}a a ON a.cluster = q.cluster WHERE a.ok)) WHERE rank <= 5)""",
        f"""{p}s AS (SELECT (SELECT count(*) FROM {p}p q JOIN {p}a a ON a.cluster = q.cluster WHERE a.ok)
  / ((SELECT count(*) FROM {queries}) * (SELECT count(*) FROM {p}v WHERE ok)) AS share)"""]


EXACT_CTE = "exact AS (" + knn_sql("l2", 5) + ")"


def matrix_row(name: str, p: str, share: str) -> str:
    return (f"SELECT '{name}' AS strategy, CAST(5 AS BIGINT) AS k, n_queries, round(recall, 6) AS recall, "
            "round(precision, 6) AS precision, round(CASE WHEN recall + precision > 0 THEN 2 * recall * precision / "
            f"(recall + precision) ELSE 0.0 END, 6) AS f1, round(mrr, 6) AS mrr, round({share}, 6) AS share FROM {p}qa")


def matrix_sql() -> str:
    ctes = [*LSH_CTES, EXACT_CTE, *quality_ctes("exact", 5, "x"), *quality_ctes("lsh", 5, "l")]
    rows = [matrix_row("exact", "x", "1.0::DOUBLE"),
            matrix_row(f"lsh_{BANDS}_{BITS}", "l", "(SELECT count(*) FROM cand) / ((SELECT count(*) FROM queries) * "
                                       "(SELECT count(*) FROM corpus WHERE embedding IS NOT NULL))")]
    for k, (nlist, nprobe) in enumerate(IVF_SETTINGS):
        ctes += [*ivf_ctes(nlist, nprobe, f"i{k}"), *quality_ctes(f"i{k}h", 5, f"j{k}")]
        rows.append(matrix_row(f"ivf_{nlist}_{nprobe}", f"j{k}", f"(SELECT share FROM i{k}s)"))
    return with_ctes(*ctes) + " UNION ALL ".join(rows)


def embedded_sql(source: str, key: str, text: str, dim: int = 64) -> str:
    """The hashed bag of words of a table's texts: ``id, embedding``."""
    return f"""
  SELECT id, list_transform(range({dim}), lambda d: CAST(CASE WHEN norm > 0 THEN coalesce(m[d], 0.0) / norm ELSE 0.0 END AS FLOAT)) AS embedding
  FROM (SELECT id, map_from_entries(list((d, v)) FILTER (d IS NOT NULL)) AS m, sqrt(sum(v * v)) AS norm FROM (
    SELECT id, d, sum(s)::DOUBLE AS v FROM (
      SELECT id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % {dim} AS d, CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END AS s FROM (
        SELECT id, md5(w) AS h FROM (SELECT {key} AS id, unnest(CASE WHEN len(t) > 0 THEN t ELSE [NULL] END) AS w FROM (
          SELECT {key}, regexp_extract_all(lower({text}), '{TOKEN_PATTERN}') AS t FROM {source}))))
    GROUP BY id, d) GROUP BY id)"""


PROMPTS_SQL = ("SELECT hq.query_id, coalesce(ctx.n_hits, 0) AS n_hits, "
               f"CASE WHEN coalesce(ctx.n_hits, 0) > 0 THEN {PROMPT_SQL} END AS prompt, "
               "CASE WHEN coalesce(ctx.n_hits, 0) = 0 THEN 'No documents found matching your query.' END AS answer "
               "FROM hq LEFT JOIN ctx ON ctx.query_id = hq.query_id")


def schema_sql(form: str) -> str:
    """Columns of the declared table, its rows and its nulls."""
    schema = DOCUMENT_SCHEMA if form == "documents" else COLLECTION_SCHEMA
    nulls = {"author", "date", "embedding"} if form == "documents" else {"embedding"}
    row = lambda f: (f"SELECT '{f.name}' AS col_name, '{f.dataType.simpleString()}' AS data_type, count(*) AS n_rows, "
                     + (f"count(*) FILTER ({f.name} IS NULL)" if f.name in nulls else "CAST(0 AS BIGINT)") + " AS n_null FROM corpus")
    return " UNION ALL ".join(map(row, schema.fields))


SAMPLES_CTES = [
    """s AS (SELECT event_type AS engine, 'flat' AS index_type, ts, event_id AS sample_id, value AS seconds
  FROM events)""",
    """sq AS (SELECT *, row_number() OVER (PARTITION BY engine, index_type ORDER BY ts, sample_id) AS seq FROM s)""",
    """warm AS (SELECT *, row_number() OVER (PARTITION BY engine, index_type ORDER BY seconds, seq) AS pos,
  count(*) OVER (PARTITION BY engine, index_type) AS n FROM sq WHERE seq > 5)""",
    """pct AS (SELECT engine, index_type,
  max(CASE WHEN pos = CAST(floor(n * 0.5::DOUBLE) AS BIGINT) + 1 THEN seconds * 1000.0 END) AS p50_ms,
  max(CASE WHEN pos = CAST(floor(n * 0.95::DOUBLE) AS BIGINT) + 1 THEN seconds * 1000.0 END) AS p95_ms,
  max(CASE WHEN pos = CAST(floor(n * 0.99::DOUBLE) AS BIGINT) + 1 THEN seconds * 1000.0 END) AS p99_ms
  FROM warm GROUP BY engine, index_type)""",
    """base AS (SELECT engine, index_type,
  avg(CASE WHEN seq <= 5 THEN seconds END) * 1000.0 AS cold_ms,
  avg(CASE WHEN seq > 5 THEN seconds END) * 1000.0 AS warm_ms,
  count(CASE WHEN seq > 5 THEN 1 END) AS nw, sum(CASE WHEN seq > 5 THEN seconds END) AS tw
  FROM sq GROUP BY engine, index_type)""",
    """summ AS (SELECT b.engine, b.index_type, cold_ms, warm_ms, p50_ms, p95_ms, p99_ms,
  CASE WHEN coalesce(tw, 0) > 0 THEN nw / tw ELSE 0.0 END AS throughput_qps
  FROM base b LEFT JOIN pct p ON p.engine = b.engine AND p.index_type = b.index_type)"""]

SQL: dict[str, str] = {
    "knn_l2": _C(knn_sql("l2", 5)),
    "knn_filtered": _C(knn_sql("l2", 5, where="c.category = 'en' AND c.date <= DATE '2021-12-31'")),
    "knn_l2_squared": _C(knn_sql("l2_squared", 5)),
    "knn_ip": _C(knn_sql("ip", 5)),
    "knn_batch": with_ctes(CORPUS_CTE, HYBRID_QUERIES_CTE) + knn_sql("l2", 10, queries="hq"),
    "knn_single": with_ctes(CORPUS_CTE, "queries AS (SELECT vec_id AS query_id, embedding AS q_emb FROM embeddings WHERE vec_id = 7)")
        + "SELECT rank, id, distance FROM (" + knn_sql("l2", 5) + ")",
    "knn_k_exceeds_n": _C(knn_sql("l2", 50, where="c.author = 'author3' AND c.category = 'es'")),
    "knn_filtered_text": _q(CORPUS_CTE, COLLECTION_CTE, QUERIES_CTE)(knn_sql(
        "l2_squared", 5, source="collection",
        where="c.date <= '2021-06-30' AND "
              "coalesce(list_contains(CAST(json_extract(c.metadata, '$.tags') AS VARCHAR[]), 'src3'), false)")),
    "search_by_id": _q(CORPUS_CTE, """queries AS (
  SELECT DISTINCT c.id AS query_id, c.embedding AS q_emb FROM labels l JOIN corpus c ON c.id = l.doc_id
  WHERE c.embedding IS NOT NULL AND l.doc_id % 50 = 0)""")(
        knn_sql("l2_squared", 5)),
    "unknown_ids": _q(CORPUS_CTE)(
        "SELECT DISTINCT doc_id AS id FROM labels WHERE doc_id NOT IN (SELECT id FROM corpus WHERE embedding IS NOT NULL)"),
    "lookup_by_id": _q(CORPUS_CTE)(
        "SELECT id, content, 0.0::DOUBLE AS distance, coalesce(metadata, '{}') AS metadata FROM corpus "
        "WHERE id IN (SELECT doc_id FROM labels)"),
    "filter_author": _q(CORPUS_CTE)("SELECT id, author FROM corpus WHERE author = 'author3'"),
    "filter_category": _q(CORPUS_CTE)("SELECT id, category FROM corpus WHERE category = 'fr'"),
    "filter_date_range": _q(CORPUS_CTE)(
        "SELECT id, date FROM corpus WHERE date >= DATE '2020-06-01' AND date <= DATE '2021-06-30'"),
    "filter_date_text": _q(CORPUS_CTE, COLLECTION_CTE)(
        "SELECT id, date FROM collection WHERE date <= '2021-06-30'"),
    "filter_tag": _q(CORPUS_CTE)("SELECT id, source FROM corpus WHERE list_contains(tags, 'src3')"),
    "filter_tag_json": _q(CORPUS_CTE, COLLECTION_CTE)(
        "SELECT id, source FROM collection WHERE "
        "coalesce(list_contains(CAST(json_extract(metadata, '$.tags') AS VARCHAR[]), 'src3'), false)"),
    "filter_source": _q(CORPUS_CTE)("SELECT id, source FROM corpus WHERE source = 'src5'"),
    "filter_conjunction": _q(CORPUS_CTE)(
        "SELECT id, author, category, date, source FROM corpus WHERE author = 'author3' AND category = 'en' "
        "AND date >= DATE '2020-03-01' AND date <= DATE '2022-06-30' AND list_contains(tags, 'en')"),
    "dimension_violations": "SELECT vec_id AS id, CAST(63 AS BIGINT) AS dim FROM embeddings WHERE vec_id % 97 = 0",
    "valid_queries": "SELECT item_id AS query_id, text FROM benchmark WHERE length(trim(text)) > 0",
    "document_count": _q(CORPUS_CTE)("SELECT count(*) AS n_documents FROM corpus"),
    "distinct_categories": _q(CORPUS_CTE)(
        "SELECT DISTINCT category FROM corpus WHERE category IS NOT NULL AND category <> '' "
        "ORDER BY category"),
    "corpus_stats": _q(CORPUS_CTE)(
        "SELECT count(*) AS n_documents, count(embedding) AS n_vectors, "
        "CAST(count(DISTINCT nullif(category, '')) AS BIGINT) AS n_categories, "
        "(SELECT array_to_string(list_sort(list(category)), ',') FROM (SELECT DISTINCT category FROM corpus "
        "WHERE category IS NOT NULL AND category <> '')) AS categories FROM corpus"),
    "sample_queries": _q(CORPUS_CTE)(
        "SELECT id FROM corpus ORDER BY md5(concat(CAST(id AS VARCHAR), ':42')), id LIMIT 50"),
    "export_embeddings": _q(CORPUS_CTE)("SELECT id, embedding FROM corpus WHERE embedding IS NOT NULL ORDER BY id"),
    "parse_vector_text": _q(CORPUS_CTE)(
        "SELECT id, CAST(len(embedding) AS BIGINT) AS dim, "
        "CAST(string_split(trim(CAST(embedding AS VARCHAR), '[]'), ',') AS FLOAT[]) = embedding AS exact "
        "FROM corpus WHERE embedding IS NOT NULL"),
    "load_raw_documents": "SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS id, "
                          "text AS content, '' AS title, CAST([] AS VARCHAR[]) AS authors "
                          "FROM documents",
    "ingest_null_defaults": _q(CORPUS_CTE)(
        "SELECT CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS id, CAST(length(content) AS BIGINT) AS content_len, "
        "author, date, category, source, NULL::VARCHAR AS meta_tags, "
        "CASE WHEN metadata IS NULL THEN NULL ELSE CAST(json_extract_string(metadata, '$.n_chars') AS BIGINT) END "
        "AS meta_n_chars, array_to_string(tags, ',') AS tags FROM corpus"),
    "ingest_empty_defaults": _q(CORPUS_CTE, COLLECTION_CTE)(
        "SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS BIGINT) AS id, "
        "CAST(length(content) AS BIGINT) AS content_len, author, date, category, source, "
        "CAST(json_extract(metadata, '$.tags') AS VARCHAR) AS meta_tags, "
        "CAST(json_extract_string(metadata, '$.n_chars') AS BIGINT) AS meta_n_chars FROM collection"),
    "postings": with_ctes(tokens_cte("documents", "doc_id", "text")) +
        f"SELECT id, term, pos FROM tok WHERE term NOT IN ({stop_words_sql()})",
    "term_stats": with_ctes(tokens_cte("documents", "doc_id", "text")) +
        f"SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM tok WHERE term NOT IN ({stop_words_sql()}) "
        "GROUP BY term",
    "query_terms": with_ctes(*keyword_ctes(BENCH_Q)[2:3]) + "SELECT query_id, term FROM qt",
    "keyword_match": with_ctes(CORPUS_CTE, *keyword_ctes(BENCH_Q)[:5]) + "SELECT query_id, id FROM m",
    "keyword_rank": with_ctes(CORPUS_CTE, *keyword_ctes(BENCH_Q)) +
        "SELECT query_id, id, round(score, 6) AS score, "
        "rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS rank FROM sc",
    "semantic_rank": with_ctes(CORPUS_CTE, HYBRID_QUERIES_CTE) +
        "SELECT query_id, id, distance, rank() OVER (PARTITION BY query_id ORDER BY distance) AS rank "
        f"FROM ({knn_sql('l2', 20, queries='hq')})",
    "hybrid_rrf": with_ctes(*hybrid_ctes()) +
        "SELECT query_id, rank, id, round(rrf_score, 6) AS rrf_score FROM hyb",
    "hybrid_rrf_batch": with_ctes(*hybrid_ctes(k=10)) +
        "SELECT query_id, rank, id, round(rrf_score, 6) AS rrf_score FROM hyb",
    "retrieve_vector": with_ctes(CORPUS_CTE, HYBRID_QUERIES_CTE) +
        knn_sql("l2", 5, queries="hq", where="c.source = 'src3'"),
    "hydrate_hits": with_ctes(CORPUS_CTE, QUERIES_CTE) +
        f"SELECT h.query_id, h.rank, h.id, h.distance, c.content, coalesce(c.metadata, '{{}}') AS metadata "
        f"FROM ({knn_sql('l2', 5)}) h JOIN corpus c ON c.id = h.id",
    "hit_cards": with_ctes(CORPUS_CTE, QUERIES_CTE) +
        "SELECT h.query_id, h.rank AS position, h.id, printf('%.4f', h.d) AS score, "
        "coalesce(nullif(json_extract_string(c.metadata, '$.author'), ''), 'arXiv') AS author, "
        "coalesce(nullif(json_extract_string(c.metadata, '$.category'), ''), 'cs.AI') AS category, "
        "coalesce(array_to_string(CAST(json_extract(c.metadata, '$.tags') AS VARCHAR[]), ','), '') AS tags "
        "FROM (SELECT query_id, rank, id, d FROM (SELECT q.query_id, c.id, "
        + dist_sql("l2", "c.embedding", "q.q_emb") + " AS d, row_number() OVER (PARTITION BY q.query_id ORDER BY "
        + dist_sql("l2", "c.embedding", "q.q_emb") + ", c.id) AS rank FROM corpus c CROSS JOIN queries q WHERE c.embedding IS NOT NULL) "
        "WHERE rank <= 5) h JOIN corpus c ON c.id = h.id",
    "rag_context": with_ctes(*hybrid_ctes()) +
        f"SELECT h.query_id, count(*) AS n_hits, {CONTEXT_SQL} AS context "
        "FROM hyb h JOIN corpus c ON c.id = h.id GROUP BY h.query_id",
    "rag_prompts": with_ctes(*hybrid_ctes(), "ctx AS (SELECT h.query_id, count(*) AS n_hits, "
                             f"{CONTEXT_SQL} AS context FROM hyb h JOIN corpus c ON c.id = h.id GROUP BY h.query_id)") +
        PROMPTS_SQL,
    "rag_response": with_ctes(CORPUS_CTE, HYBRID_QUERIES_CTE) +
        "SELECT hq.query_id, hq.text AS query, 'exact' AS retrieval_engine, "
        "CASE WHEN count(h.id) = 0 THEN 'No documents found matching your query.' END AS answer, "
        "count(h.id) AS n_documents, coalesce(string_agg(CAST(h.id AS VARCHAR), ',' ORDER BY h.rank), '') AS doc_ids "
        f"FROM hq LEFT JOIN ({knn_sql('l2', 5, queries='hq', where='c.category = ' + chr(39) + 'en' + chr(39))}) h "
        "ON h.query_id = hq.query_id GROUP BY hq.query_id, hq.text",
    "assemble_chunks": "SELECT conv_id AS request_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS response "
                       "FROM conversations GROUP BY conv_id",
    "ivf_exhaustive": _C(knn_sql("l2", 5)),
    "ivf_assign": with_ctes(CORPUS_CTE, QUERIES_CTE, *ivf_ctes(NLIST, NPROBE)) + "SELECT id, cluster FROM iva",
    "ivf_probes": with_ctes(CORPUS_CTE, QUERIES_CTE, *ivf_ctes(NLIST, NPROBE)) + f"""SELECT query_id, cluster FROM (
  SELECT q.query_id, c.cluster, row_number() OVER (PARTITION BY q.query_id ORDER BY list_distance(c.v, q.qv), c.cluster) AS n
  FROM ivq q CROSS JOIN ivc c) WHERE n <= {NPROBE}""",
    "ivf_adaptive": _C(knn_sql("l2", 5)),
    "ivf_adaptive_filtered": _C(knn_sql("l2_squared", 5, where="c.author = 'author3' AND c.category = 'es'")),
    "ivf_filtered": with_ctes(CORPUS_CTE, QUERIES_CTE, *ivf_ctes(NLIST, NPROBE, where="c.category = 'en' AND c.date <= DATE '2021-12-31'")) +
        "SELECT query_id, rank, id, round(distance, 6) AS distance FROM ivh",
    "ivf_filtered_sparse": with_ctes(CORPUS_CTE, QUERIES_CTE, *ivf_ctes(NLIST, NPROBE, where="c.author = 'author3' AND c.category = 'es'")) +
        "SELECT query_id, rank, id, round(distance, 6) AS distance FROM ivh",
    "retrieve_ivf": with_ctes(CORPUS_CTE, HYBRID_QUERIES_CTE, *ivf_ctes(NLIST, NPROBE, where="c.source = 'src3'", queries="hq")) +
        "SELECT query_id, rank, id, round(distance, 6) AS distance, 'ivf' AS strategy FROM ivh",
    "ivf_search": with_ctes(CORPUS_CTE, QUERIES_CTE, *ivf_ctes(NLIST, NPROBE)) +
        "SELECT query_id, rank, id, round(distance, 6) AS distance FROM ivh",
    "ivf_reloaded_search": with_ctes(CORPUS_CTE, QUERIES_CTE, *ivf_ctes(NLIST, 2 * NPROBE)) +
        "SELECT query_id, rank, id, round(distance, 6) AS distance FROM ivh",
    "eval_matrix": matrix_sql(),
    "eval_report_header": with_ctes(CORPUS_CTE, QUERIES_CTE) +
        "SELECT (SELECT count(*) FROM corpus WHERE embedding IS NOT NULL) AS dataset_size, CAST(64 AS BIGINT) AS dimension, "
        "(SELECT count(*) FROM queries) AS num_queries, (SELECT count(DISTINCT event_type) FROM events) AS n_latency, "
        "'kestrel/exact,kestrel/lsh' AS recall_of",
    "embed_documents": embedded_sql("documents", "doc_id", "text"),
    "load_sample_embeddings": "SELECT vec_id AS id, embedding FROM embeddings",
    "retrieve_hybrid": with_ctes(*hybrid_ctes(where="c.category = 'en'")) +
        "SELECT query_id, rank, id, round(rrf_score, 6) AS rrf_score FROM hyb",
    "rag_batch": with_ctes(*hybrid_ctes(questions="hq AS (SELECT b.item_id AS query_id, b.text, e.embedding AS q_emb FROM benchmark b "
                                        "JOIN (" + embedded_sql("benchmark", "item_id", "text") + ") e ON e.id = b.item_id)"),
                           "ctx AS (SELECT h.query_id, count(*) AS n_hits, "
                           f"{CONTEXT_SQL} AS context FROM hyb h JOIN corpus c ON c.id = h.id GROUP BY h.query_id)") + PROMPTS_SQL,
    "schema_documents": with_ctes(CORPUS_CTE) + schema_sql("documents"),
    "schema_collection": with_ctes(CORPUS_CTE) + schema_sql("collection"),
    "lsh_filtered": with_ctes(*lsh_ctes("c.category = 'en' AND c.date <= DATE '2021-12-31'")) +
        "SELECT query_id, rank, id, round(distance, 6) AS distance FROM lsh",
    "lsh_filtered_sparse": with_ctes(*lsh_ctes("c.author = 'author3' AND c.category = 'es'")) +
        "SELECT query_id, rank, id, round(distance, 6) AS distance FROM lsh",
    "ann_lsh_codes": with_ctes(CORPUS_CTE, lsh_dots_cte("cdots", "corpus", "id", "embedding"), lsh_codes_cte("ccodes", "cdots")) +
        "SELECT id, band, code FROM ccodes",
    "ann_lsh": with_ctes(*LSH_CTES) + "SELECT query_id, rank, id, round(distance, 6) AS distance FROM lsh",
    "recall_at_k": with_ctes(*LSH_CTES, *quality_ctes("lsh", 5)) +
        "SELECT 'lsh' AS strategy, CAST(5 AS BIGINT) AS k, n_queries, round(recall, 6) AS recall, "
        "round(precision, 6) AS precision FROM qa",
    "recall_vs_gt": with_ctes(*LSH_CTES, *quality_ctes("lsh", 50)) +
        "SELECT 'lsh' AS strategy, CAST(5 AS BIGINT) AS k, CAST(50 AS BIGINT) AS gt_k, n_queries, "
        "round(recall, 6) AS recall, round(precision, 6) AS precision FROM qa",
    "f1_at_k": with_ctes(*LSH_CTES, *quality_ctes("lsh", 5)) +
        "SELECT 'lsh' AS strategy, CAST(5 AS BIGINT) AS k, round(CASE WHEN recall + precision > 0 "
        "THEN 2 * recall * precision / (recall + precision) ELSE 0.0 END, 6) AS f1 FROM qa",
    "mrr": with_ctes(*LSH_CTES, *quality_ctes("lsh", 5)) +
        "SELECT 'lsh' AS strategy, CAST(5 AS BIGINT) AS k, round(mrr, 6) AS mrr FROM qa",
    "latency_summary": with_ctes(*SAMPLES_CTES) +
        "SELECT engine, index_type, round(cold_ms, 6) AS cold_ms, round(warm_ms, 6) AS warm_ms, "
        "round(p50_ms, 6) AS p50_ms, round(p95_ms, 6) AS p95_ms, round(p99_ms, 6) AS p99_ms, "
        "round(throughput_qps, 6) AS throughput_qps FROM summ",
    "latency_percentiles": with_ctes(*SAMPLES_CTES) +
        "SELECT engine, index_type, round(p50_ms, 6) AS p50_ms, round(p95_ms, 6) AS p95_ms, "
        "round(p99_ms, 6) AS p99_ms FROM pct",
    "latency_speedup": with_ctes(*SAMPLES_CTES) +
        "SELECT engine, index_type, round(warm_ms, 6) AS warm_ms, round((SELECT warm_ms FROM summ "
        "WHERE engine = 'view' AND index_type = 'flat') / warm_ms, 6) AS speedup FROM summ",
    "latency_target_check": with_ctes(*SAMPLES_CTES) +
        "SELECT engine, index_type, round(warm_ms, 6) AS warm_ms, 20.0::DOUBLE AS target_ms, "
        "warm_ms <= 20.0 AS meets_target FROM summ",
    "eval_report": with_ctes(*SAMPLES_CTES, *LSH_CTES, *quality_ctes("lsh", 5), EXACT_CTE, *quality_ctes("exact", 5, "x")) +
        """SELECT 'latency' AS section, engine, index_type, m.metric, round(m.value, 6) AS value
FROM summ, LATERAL (SELECT unnest(['cold_ms','warm_ms','p50_ms','p95_ms','p99_ms','throughput_qps']) AS metric,
                           unnest([cold_ms, warm_ms, p50_ms, p95_ms, p99_ms, throughput_qps]) AS value) m
UNION ALL SELECT 'recall', 'kestrel', 'lsh', 'recall@5', round(recall, 6) FROM qa
UNION ALL SELECT 'recall', 'kestrel', 'lsh', 'avg_precision', round(precision, 6) FROM qa
UNION ALL SELECT 'recall', 'kestrel', 'exact', 'recall@5', round(recall, 6) FROM xqa
UNION ALL SELECT 'recall', 'kestrel', 'exact', 'avg_precision', round(precision, 6) FROM xqa""",
}

# the same rows by another path
SQL |= {f"stored_{name}": SQL[name] for name in ("filter_author", "filter_category", "filter_date_range", "filter_conjunction")}
SQL["embed_cached"] = SQL["embed_documents"]
