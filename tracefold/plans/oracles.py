"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from tracefold.functions import queryprep, tagging
from tracefold.operators.chunking import LANGUAGES
from tracefold.plans.catalog import DERIVED, ONE_QUERY


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _tok(x: str) -> str:
    """Tokens; two passes stand in for look-around."""
    camel = f"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_filter(regexp_extract_all(lower(regexp_replace({camel}, '[_.\\-/:\\\\]', ' ', 'g')), '[a-z0-9]+'), lambda t: len(t) BETWEEN 2 AND 60)"


def _split(x: str) -> str:
    camel = f"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"lower(trim(regexp_replace(regexp_replace({camel}, '[^a-zA-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')))"


def _boiler(x: str) -> str:
    for p, flags in (("^.*auto.?generated.*$", "gim"), ("^.*DO NOT EDIT.*$", "gim"), ("^.*copyright.*$", "gim"), ("^#!.*$", "gm")):
        x = f"regexp_replace({x}, '(?{flags[1:]}){p}', '', 'g')"
    return _strip(f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


_INDEX = f"""
tok AS (SELECT doc_id AS id, {_tok("text")} AS tokens FROM documents),
post AS (SELECT id, len(tokens) AS dl, unnest(tokens) AS term FROM tok),
postings AS (SELECT id, dl, term, count(*) AS tf FROM post GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
stats AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok)"""


def _bm25(queries: str, factor: float = 2.5, k1: float = 1.5, b: float = 0.75) -> str:
    """CTEs up to ``scored`` (query_id, id, score); ``queries`` gives query_id and text."""
    return f"""{_INDEX},
asked AS ({queries}),
qpost AS (SELECT query_id, unnest({_tok("text")}) AS term FROM asked),
qterms AS (SELECT query_id, term, count(*) AS qtf FROM qpost GROUP BY ALL),
scored AS (
  SELECT query_id, id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * qtf * {factor} * tf / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) AS score
  FROM qterms JOIN dfs USING (term) JOIN postings USING (term), stats GROUP BY 1, 2
)"""


def _top(source: str, k: int) -> str:
    return f"SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM {source} QUALIFY rank <= {k}"


_BATCH = "SELECT item_id::BIGINT AS query_id, text FROM benchmark"
_DOT = "round(list_reduce(list_transform(range(1, len(q.v) + 1), lambda j: q.v[j] * c.v[j]), lambda a, b: a + b), 6)"
_VECS = "vecs AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"


def _lists(k: int = 20) -> str:
    """CTEs ``lexical`` and ``near``: the two lists of the hybrid queries."""
    return f"""{_bm25(_BATCH)},
lexical AS ({_top("(SELECT * FROM scored WHERE score > 0)", k)}), {_VECS},
products AS (SELECT q.id AS query_id, c.id, {_DOT} AS score FROM vecs q JOIN asked ON asked.query_id = q.id, vecs c),
near AS ({_top("products", k)})"""


def _fused(wb: float = 1, wd: float = 1, name: str = "fused") -> str:
    return f"""{name} AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, id))::INT AS rank FROM (
    SELECT query_id, id, b.rank AS bm25_rank, b.score AS bm25_score, d.rank AS dense_rank, d.score AS dense_score,
           round(coalesce({wb}.0 / (b.rank + 60), 0.0) + coalesce({wd}.0 / (d.rank + 60), 0.0), 6)::DOUBLE AS fused_score
    FROM lexical b FULL JOIN near d USING (query_id, id)
  )
)"""


_DENSE = f"""{_VECS}, products AS (SELECT q.id AS query_id, c.id, {_DOT} AS score FROM vecs q, vecs c WHERE q.id % 100 = 0)"""


def _evaluated(results: str, qrels: str, k: int = 10) -> str:
    """CTE ``quality`` from CTEs of results and judgements; ``config`` is carried."""
    return f"""
judged AS (SELECT r.*, coalesce(q.rel, 0) AS rel FROM (SELECT * FROM {results} WHERE rank <= {k}) r LEFT JOIN {qrels} q USING (query_id, id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY rel DESC, rank) AS best, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY config, query_id ORDER BY rank) / rank AS prec FROM judged),
got AS (
  SELECT config, query_id, sum(rel / log2(rank + 1)) AS dcg, sum(rel / log2(best + 1)) AS own, min(CASE WHEN rel > 0 THEN rank END) AS first,
         sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS found, sum(CASE WHEN rel > 0 THEN prec END) AS precs
  FROM placed GROUP BY 1, 2
),
ideal AS (SELECT query_id, sum(CASE WHEN place <= {k} THEN rel / log2(place + 1) END) AS ideal, count(*) AS relevant FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, id) AS place FROM {qrels} WHERE rel > 0) GROUP BY 1),
quality AS (
  SELECT config, query_id, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(coalesce(CASE WHEN own > 0 THEN dcg / own END, 0), 6) AS ndcg_retrieved,
         round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(found / relevant, 0), 6) AS recall, round(coalesce(precs / least(relevant, {k}), 0), 6) AS map
  FROM (SELECT DISTINCT query_id FROM {qrels}) JOIN (SELECT DISTINCT config FROM {results}) ON true LEFT JOIN ideal USING (query_id) LEFT JOIN got USING (config, query_id)
)"""


def _any(x: str, patterns: tuple[str, ...]) -> str:
    return f"regexp_matches({x}, '(?i)" + "|".join(f"(?:{p})" for p in patterns) + "')"


_Q = _strip(DERIVED["asked"])
_CATEGORY = f"""CASE WHEN len({_Q}) > 200 AND regexp_matches(lower({_Q}), '{"|".join(queryprep.STATEMENT_MARKS)}') THEN 'problem_stmt'
  WHEN {_any(_Q, queryprep.HOW)} THEN 'how_it_works' WHEN {_any(_Q, queryprep.WHERE)} THEN 'where_is'
  WHEN {_any(_Q, queryprep.BUG)} OR regexp_matches({_Q}, '{queryprep.BUG_NAMES}') THEN 'bug_fix' WHEN len({_Q}) > 150 THEN 'problem_stmt' ELSE 'general' END"""
_SPELT = DERIVED["asked"]
for _short, _long in queryprep.CONTRACTIONS.items():
    _SPELT = f"regexp_replace({_SPELT}, '(?i)\\b{_short.replace(chr(39), chr(39) * 2)}\\b', '{_long}', 'g')"
_EXPANDED = f"concat_ws(' ', {DERIVED['asked']}, " + ", ".join(f"CASE WHEN contains(lower({DERIVED['asked']}), '{k}') THEN '{' '.join(v)}' END" for k, v in queryprep.SYNONYMS.items()) + ")"

_CODE = DERIVED["coded"]
_DOC = f"""CASE WHEN regexp_matches({_CODE}, '(?s)\"\"\".*?\"\"\"') THEN {_strip(f"regexp_extract({_CODE}, '(?s)\"\"\"(.*?)\"\"\"', 1)")}
  WHEN regexp_matches({_CODE}, '(?s)/\\*.*?\\*/') THEN {_strip(f"regexp_extract({_CODE}, '(?s)/\\*(.*?)\\*/', 1)")} ELSE '' END"""
_WORDS_SPLIT = f"array_to_string(list_transform(regexp_extract_all({_boiler(_CODE)}, '\\s+|\\S+'), lambda t: CASE WHEN len(t) > 3 AND regexp_matches(t, '[a-z][A-Z]|_[a-z]') THEN {_split('t')} ELSE t END), '')"
_FP, _SYM = DERIVED["file_path"], DERIVED["symbol"]
_LINES = "string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10))"
_STOP = ", ".join(f"'{w}'" for w in queryprep.STOP)
_MANIFESTS = "manifests AS (SELECT event_id::VARCHAR AS snapshot_id, 'Repo' || user_id AS repo_name, '/srv/code/repo' || user_id AS repo_path, ts, floor(value)::BIGINT AS chunk_count FROM events)"
_LATEST = "latest AS (SELECT lower(repo_name) AS repo_key, * FROM manifests QUALIFY row_number() OVER (PARTITION BY lower(repo_name) ORDER BY ts DESC, snapshot_id) = 1)"

_ADDRESS = _strip(DERIVED["address"])
_OWNER_REPO = r"^(?:(?i:https?|ssh)://(?:[^/@]*@)?(?i:(?:www\.)?github\.com)(?::[0-9]+)?/+|(?i:git@github\.com:)/*|)([a-zA-Z0-9_.-]+)/+([a-zA-Z0-9_.-]+?)(?i:\.git)?(?:[/?#].*)?$"
_PLAIN = f"regexp_replace(regexp_replace({DERIVED['marked']}, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[*`_#]', '', 'g')"
_IMPORTS = f"""regexp_extract_all({DERIVED['importing']}, '(?:from\\s+|import\\s+)["'']?([\\w./-]+)["'']?', 1)"""
_OWN_FILE = "CASE WHEN doc_id % 2 = 0 THEN source || '/' || lang || '.py' ELSE 'main.py' END"

ORACLES = {
    "rrf_hybrid": f"WITH {_lists()}, {_fused()} SELECT * FROM fused",
    "tokenise_counts": f"SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {_tok('text')} AS t FROM documents)",
    "term_df_top": f"WITH {_INDEX} SELECT term, df FROM dfs ORDER BY df DESC, term LIMIT 50",
    "corpus_stats": f"WITH {_INDEX} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
    "bm25_topk_single": f"WITH {_bm25(f'SELECT 1::BIGINT AS query_id, {chr(39)}{ONE_QUERY}{chr(39)} AS text')} {_top('(SELECT * FROM scored WHERE score > 0)', 10)}",
    "bm25_topk_batch": f"WITH {_bm25(_BATCH)} {_top('(SELECT * FROM scored WHERE score > 0)', 10)}",
    "tokenise_identifiers": f"SELECT p_partkey, identifier, array_to_string({_tok('identifier')}, ' ') AS tokens, {_split('identifier')} AS split FROM (SELECT p_partkey, {DERIVED['identifier']} AS identifier FROM part)",
    "strip_boilerplate": f"SELECT doc_id, clean, clean <> headed AS changed FROM (SELECT doc_id, headed, {_boiler('headed')} AS clean FROM (SELECT doc_id, {DERIVED['headed']} AS headed FROM documents))",
    "extract_docstring": f"SELECT doc_id, {_DOC} AS docstring FROM documents",
    "normalize_document": f"SELECT doc_id, concat_ws(chr(10), {_split(_SYM)}, nullif({_DOC}, ''), {_WORDS_SPLIT}) AS normalized FROM documents",
    "chunk_identity": f"""SELECT doc_id, substr(sha256({_FP} || '::' || {_SYM} || '::1'), 1, 16) AS chunk_id, substr(sha256({_FP} || '::' || {_SYM}), 1, 16) AS lineage_id,
        substr(sha256(text), 1, 32) AS content_hash, substr(regexp_replace({_FP}, '[^\\w.-]+', '_', 'g'), 1, 48) || '__' || substr(lang, 1, 40) AS snapshot_id, '{LANGUAGES["py"]}' AS language FROM documents""",
    "line_window_chunks": f"""WITH cut AS (SELECT doc_id, {_LINES} AS lines FROM documents), numbered AS (SELECT *, len(lines) AS n, unnest(range(0, 1 + greatest(0, ceil((len(lines) - 10) / 7.0))::INT)) AS k FROM cut)
        SELECT doc_id, (k * 7 + 1)::INT AS start_line, least(k * 7 + 10, n)::INT AS end_line, array_to_string(lines[k * 7 + 1 : k * 7 + 10], chr(10)) AS code FROM numbered""",
    "tag_chunks": f"""SELECT doc_id, regexp_matches(p, '{tagging.TEST_PATH}') OR regexp_matches(s, '{tagging.TEST_SYMBOL}') OR {" OR ".join(f"contains(text, '{m}')" for m in tagging.TEST_CODE)} AS is_test,
        regexp_matches(p, '{tagging.CONFIG_PATH}') AS is_config, regexp_matches(p, '{tagging.GENERATED_PATH}') AS is_generated, 'block' AS chunk_type FROM (SELECT doc_id, text, {_FP} AS p, {_SYM} AS s FROM documents)""",
    "query_category": f"SELECT conv_id, turn, {_CATEGORY} AS query_type FROM conversations",
    "expand_query": f"SELECT conv_id, turn, {_EXPANDED} AS expanded, {_SPELT} AS spelt_out FROM conversations",
    "matched_terms": f"""WITH {_bm25(_BATCH)}, best AS ({_top("(SELECT * FROM scored WHERE score > 0)", 5)}),
        words AS (SELECT b.query_id, b.id, lower(d.text) AS body, regexp_extract_all(lower(a.text), '[a-z0-9_]+') AS w FROM best b JOIN asked a USING (query_id) JOIN documents d ON d.doc_id = b.id),
        firsts AS (SELECT *, list_filter(w, lambda t, i: list_position(w, t) = i AND len(t) > 2 AND t NOT IN ({_STOP}) AND contains(body, t)) AS hit FROM words)
        SELECT query_id, id, array_to_string(hit[1:5], ' ') AS terms FROM firsts""",
    "dense_topk": f"WITH {_DENSE} {_top('products', 10)}",
    "rrf_weighted_nlists": f"""WITH {_VECS},
        asked AS (SELECT id AS query_id, v, 1.0 AS w FROM vecs WHERE id % 100 = 0 UNION ALL SELECT id, list_transform(v, lambda x: -x), 0.5 FROM vecs WHERE id % 100 = 0 UNION ALL SELECT id - 1, v, 2.0 FROM vecs WHERE id % 100 = 1),
        products AS (SELECT q.query_id, q.w, c.id, {_DOT} AS score FROM asked q, vecs c),
        best AS (SELECT *, row_number() OVER (PARTITION BY query_id, w ORDER BY score DESC, id) AS rank FROM products QUALIFY rank <= 15),
        parts AS (SELECT query_id, id, round(sum(w::DOUBLE / (rank + 60)), 6) AS fused_score FROM best GROUP BY 1, 2)
        SELECT query_id, id, fused_score, (row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, id))::INT AS rank FROM parts""",
    "high_confidence_gate": f"""WITH {_lists()}, {_fused()}, two AS (SELECT query_id, max(CASE WHEN rank = 1 THEN fused_score END) AS top, max(CASE WHEN rank = 2 THEN fused_score END) AS second FROM fused WHERE rank <= 2 GROUP BY 1)
        SELECT query_id, top, second, CASE WHEN second IS NULL THEN true WHEN top = 0 THEN false ELSE (top - second) / top >= 0.02 END AS confident FROM two""",
    "single_retriever_fallback": f"""WITH {_lists()}, l2 AS (SELECT * FROM lexical WHERE query_id % 3 <> 0), n2 AS (SELECT * FROM near WHERE query_id % 3 <> 1),
        both_ AS (SELECT query_id, id, b.rank AS br, b.score AS bs, d.rank AS dr, d.score AS ds FROM l2 b FULL JOIN n2 d USING (query_id, id)),
        n AS (SELECT *, count(br) OVER (PARTITION BY query_id) AS nb, count(dr) OVER (PARTITION BY query_id) AS nd FROM both_),
        s AS (SELECT query_id, id, CASE WHEN nb > 0 AND nd > 0 THEN round(coalesce(1.0 / (br + 60), 0) + coalesce(1.0 / (dr + 60), 0), 6) WHEN nd > 0 THEN ds ELSE bs END::DOUBLE AS fused_score FROM n)
        SELECT query_id, id, fused_score, (row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, id))::INT AS rank FROM s""",
    "post_filter_vs_prefilter": f"""WITH {_bm25(_BATCH)}, best AS ({_top("scored", 10)}), german AS (SELECT s.* FROM scored s JOIN documents ON doc_id = id WHERE lower(lang) = 'de')
        SELECT 'after' AS filtered, best.* FROM best JOIN documents ON doc_id = id WHERE lower(lang) = 'de' UNION ALL SELECT 'before', * FROM ({_top("german", 10)})""",
    "rerank_passthrough": f"WITH {_lists()}, {_fused()} SELECT query_id, id, fused_score, fused_score AS rerank_score, rank FROM fused",
    "lineage_collapse": """WITH rows_ AS (SELECT role AS query_id, conv_id || '-' || turn AS id, 'L' || (conv_id % 50) AS lineage_id, (len(text) % 97)::DOUBLE AS fused_score FROM conversations),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, id) AS r FROM rows_),
        grouped AS (SELECT query_id, lineage_id, min(r) AS r, coalesce(array_to_string((list(id ORDER BY r))[2:], ' '), '') AS others FROM ranked GROUP BY 1, 2)
        SELECT query_id, id, lineage_id, fused_score, (row_number() OVER (PARTITION BY query_id ORDER BY r))::INT AS rank, others FROM grouped JOIN ranked USING (query_id, lineage_id, r)""",
    "latest_snapshot_per_repo": f"WITH {_MANIFESTS}, {_LATEST} SELECT repo_key, snapshot_id, chunk_count FROM latest",
    "repo_list": f"WITH {_MANIFESTS} SELECT repo_name, snapshot_id, chunk_count FROM manifests QUALIFY row_number() OVER (PARTITION BY repo_name ORDER BY ts DESC, repo_path DESC, chunk_count DESC, snapshot_id) = 1",
    "health_rollup": f"WITH {_MANIFESTS}, {_LATEST} SELECT count(*) AS repositories, coalesce(sum(chunk_count), 0)::BIGINT AS chunks FROM latest",
    "repo_name_match": "SELECT DISTINCT s_suppkey, s_name AS repo_name FROM supplier, (SELECT lpad(n_nationkey::VARCHAR, 3, '0') AS wanted FROM nation) WHERE contains('/srv/' || lower(s_name), wanted)",
    "lineage_history": "SELECT conv_id::VARCHAR AS lineage_id, turn::VARCHAR AS snapshot_id, 'c' || turn AS original_commit, text AS code, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS version FROM conversations",
    "adjacent_versions": "SELECT conv_id, turn, len(text) AS n_new, len(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS n_old FROM conversations",
    "embedding_cache_miss": """WITH h AS (SELECT doc_id, substr(sha256(text), 1, 32) AS content_hash FROM documents)
        SELECT content_hash, count(*) AS n, min(doc_id) AS first_doc FROM h WHERE doc_id % 2 = 1 AND content_hash NOT IN (SELECT content_hash FROM h WHERE doc_id % 2 = 0) GROUP BY 1""",
    "incremental_build": f"""SELECT {_FP} AS file_path, doc_id, (len(text) + CASE WHEN doc_id % 10 = 3 THEN 1 ELSE 0 END)::INT AS n, 'carry' AS mode FROM documents WHERE doc_id % 10 <> 7
        UNION ALL SELECT {_FP}, doc_id, len(text)::INT, 'delta' FROM documents WHERE doc_id % 10 = 3""",
    "ndcg_mrr_recall_map": f"""WITH {_DENSE}, best AS (SELECT 'x' AS config, * FROM ({_top("products", 10)})), asked AS (SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 100 = 0),
        qrels AS (SELECT query_id, vec_id AS id, 1 AS rel FROM asked JOIN embeddings USING (label)), {_evaluated("best", "qrels")}
        SELECT query_id, ndcg, ndcg_retrieved, mrr, recall, map FROM quality""",
    "ablation_grid": f"""WITH {_lists()}, {_fused()}, {_fused(2, 1, "fused_b")}, {_fused(1, 2, "fused_d")},
        results AS (SELECT 'bm25_only' AS config, query_id, id, rank FROM lexical UNION ALL SELECT 'dense_only', query_id, id, rank FROM near UNION ALL SELECT 'hybrid', query_id, id, rank FROM fused
          UNION ALL SELECT 'hybrid_lexical', query_id, id, rank FROM fused_b UNION ALL SELECT 'hybrid_dense', query_id, id, rank FROM fused_d),
        qrels AS (SELECT query_id, e.vec_id AS id, 1 AS rel FROM asked JOIN embeddings q ON q.vec_id = query_id JOIN embeddings e ON e.label = q.label), {_evaluated("results", "qrels")}
        SELECT config, count(*) AS n_queries, round(avg(ndcg), 4) AS ndcg, round(avg(mrr), 4) AS mrr, round(avg(recall), 4) AS recall, round(avg(map), 4) AS map FROM quality GROUP BY 1""",
    "stream_jobs": "SELECT r_regionkey::VARCHAR AS job_id, 'done' AS status, r_name AS message FROM region",
    "job_state_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "event_telemetry": "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2",
    "embedding_text": f"SELECT doc_id, concat_ws(chr(10), nullif({_SYM}, ''), nullif({_DOC}, ''), {_CODE}) AS embedded FROM documents",
    "markdown_inline": f"SELECT doc_id, {_strip(f"regexp_replace({_PLAIN}, '^[\\s*\\->0-9.]+', '')")} AS plain FROM documents",
    "unicode_clean": f"SELECT doc_id, regexp_replace(nfc_normalize({DERIVED['composed']}), '[\\x00-\\x08\\x0B-\\x1F\\x7F\\x{{80}}-\\x{{9F}}]', '', 'g') AS clean FROM documents",
    "repository_addresses": f"""SELECT page_id, regexp_matches(a, '^(https?://|git@|ssh://)') OR regexp_matches(a, '^[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+$') AS is_remote,
nullif(regexp_extract(a, '{_OWNER_REPO}', 1), '') AS owner, nullif(regexp_extract(a, '{_OWNER_REPO}', 2), '') AS repo FROM (SELECT page_id, coalesce({_ADDRESS}, '') AS a FROM pages)""",
    "related_files": f"""SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:3], '|') AS related FROM (
SELECT doc_id, list_filter({_IMPORTS}, lambda x: (contains(x, '/') OR x LIKE '%.py') AND x NOT LIKE '.%' AND x <> own) AS l FROM (SELECT *, {_OWN_FILE} AS own FROM documents))""",
    "search_results": f"WITH {_lists()}, {_fused()} SELECT query_id, id, rank, count(*) OVER (PARTITION BY query_id) AS total_results, round(greatest(0, least(100, coalesce(dense_score, fused_score, 0) * 100)), 4) AS match_percent FROM fused QUALIFY rank <= 5",
    "version_list": f"WITH {_MANIFESTS} SELECT snapshot_id, 'c' || snapshot_id AS original_commit, 'build ' || chunk_count AS commit_message, chunk_count, repo_name FROM manifests",
    "path_history": """SELECT snapshot_id, start_line, code, row_number() OVER (ORDER BY turn DESC) AS version FROM (
SELECT turn, turn::VARCHAR AS snapshot_id, conv_id AS start_line, text AS code FROM conversations QUALIFY row_number() OVER (PARTITION BY turn ORDER BY conv_id, role) = 1)""",
    "bm25_bare_topk": f"WITH {_bm25(_BATCH, 1.0, 1.2, 0.5)} {_top('(SELECT * FROM scored WHERE score > 0)', 10)}",
    "rerank_scored": f"""WITH {_lists()}, {_fused()}, judged AS (
SELECT f.query_id, f.id, f.fused_score, f.rank AS old, len(list_intersect(string_split(coalesce(b.text, ''), ' '), string_split(substr(coalesce(d.text, ''), 1, 1000), ' ')))::DOUBLE AS s
FROM fused f JOIN benchmark b ON b.item_id = f.query_id LEFT JOIN documents d ON d.doc_id = f.id)
SELECT query_id, id, fused_score, CASE WHEN old <= 10 THEN s ELSE fused_score END AS rerank_score,
row_number() OVER (PARTITION BY query_id ORDER BY old > 10, CASE WHEN old <= 10 THEN -s END, old)::INT AS rank FROM judged""",
}
