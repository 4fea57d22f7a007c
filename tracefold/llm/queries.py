"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tracefold.llm import best_fit_packing, bilinear_lm, block_knn, html_main_text, language_id, lookup_sharding, preference_format, quality_rules, sentencepiece_codec, setsketch_dedup
from tracefold.llm.common import fold, read


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(read(spark, sf_dir, "documents"))


#: Limits at which small tables lose documents as well.
STRICT = {"min_docs": 1.0, "share": 0.0, "min_left": 0.9}


def quality_rules_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules at limits where depletion decides on small tables too."""
    return quality_rules.quality_verdicts(read(spark, sf_dir, "documents"), **STRICT)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_codec.digest_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


SHARDS, TABLE_SIZE = [f"shard-{k:02d}" for k in range(64)], 6421


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over 64 shards; the prime is over 100 times their number."""
    return lookup_sharding.place(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", SHARDS, TABLE_SIZE)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_knn.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_format.format_pairs(*preference_format.derived_pairs(read(spark, sf_dir, "conversations")))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main_text.extract(read(spark, sf_dir, "pages"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    learn = F.coalesce(fold(F.col("doc_id")) != 1, F.lit(True))
    scored = bilinear_lm.learn_and_score(docs, learn)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return best_fit_packing.pack(best_fit_packing.measure(docs), rows=docs.count())


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    learn = F.coalesce(fold(F.col("doc_id")) != 0, F.lit(True))
    model = language_id.fit(docs, learn)
    found = language_id.identify(docs, model)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch_dedup.near_duplicates(read(spark, sf_dir, "documents"), words=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "quality_rules_strict": quality_rules_strict,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_sharding": op3_sharding,
        "op4_nearest_neighbours": op4_nearest_neighbours,
        "op5_language_id": op5_language_id,
        "op6_html_extraction": op6_html_extraction,
        "op7_preference_format": op7_preference_format,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_near_duplicates": op10_near_duplicates,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _quality_sql(), "quality_rules_strict": _quality_sql(**STRICT), "op10_near_duplicates": _NEAR_SQL, "op3_sharding": _SHARDING_SQL, "op4_nearest_neighbours": _NEAREST_SQL, "op7_preference_format": _PREFERENCE_SQL}


_SHARDING_SQL = f"""
WITH RECURSIVE {lookup_sharding.table_sql(f"SELECT k, 'shard-' || lpad(k::VARCHAR, 2, '0') AS name FROM range({len(SHARDS)}) t(k)", TABLE_SIZE)},
keyed AS (SELECT doc_id, source, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {TABLE_SIZE} AS slot FROM documents)
SELECT doc_id, source, keyed.slot, name AS shard
FROM keyed LEFT JOIN (SELECT turns.slot, name FROM turns, counted, names WHERE k = t % n) filled ON filled.slot = keyed.slot
"""

_PREFERENCE_SQL = """
WITH turns AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations),
lasts AS (SELECT pair_id, max(turn) AS last FROM turns WHERE role = 'assistant' GROUP BY 1),
answers AS (SELECT xor(pair_id, 1) AS pair_id, turn AS last, min(text) AS other FROM turns WHERE role = 'assistant' GROUP BY 1, 2),
rejected AS (
  SELECT t.* FROM turns t LEFT JOIN lasts USING (pair_id) WHERE last IS NULL OR turn < last
  UNION ALL
  SELECT pair_id, last, 'assistant', coalesce(other, '') FROM lasts LEFT JOIN answers USING (pair_id, last)
),
sides AS (SELECT 'chosen' AS side, * FROM turns UNION ALL SELECT 'rejected', * FROM rejected),
clean AS (SELECT side, pair_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM sides WHERE pair_id IS NOT NULL AND turn IS NOT NULL),
counts AS (
  SELECT pair_id, turn, role, text, count(*) FILTER (side = 'chosen') AS c, count(*) FILTER (side = 'rejected') AS r FROM clean GROUP BY ALL
),
ends AS (SELECT pair_id, min(turn) AS ending FROM counts WHERE c <> r GROUP BY 1),
marked AS (SELECT counts.*, ending IS NULL OR turn < ending AS common FROM counts LEFT JOIN ends USING (pair_id)),
parts AS (
  SELECT pair_id, 'prompt' AS side, turn, role, text, c AS copies FROM marked WHERE common
  UNION ALL SELECT pair_id, 'chosen', turn, role, text, c FROM marked WHERE NOT common AND c > 0
  UNION ALL SELECT pair_id, 'rejected', turn, role, text, r FROM marked WHERE NOT common AND r > 0
)
SELECT pair_id, side, turn, role, copies, repeat('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), copies::INT) AS segment,
       CASE WHEN side <> 'prompt' AND role = 'assistant' THEN 1 ELSE 0 END::INT AS loss
FROM parts
"""

_NEAREST_SQL = """
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda j: (q.v[j] - c.v[j]) * (q.v[j] - c.v[j])), lambda a, b: a + b)) AS score FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

def _quality_sql(min_docs: float = 20.0, share: float = 0.002, min_left: float = 0.3) -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row_, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
lines AS (SELECT row_, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
worded AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT row_, count(*) - count(DISTINCT line) AS n_dup_lines FROM worded GROUP BY 1),
tokens AS (SELECT row_, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
places AS (SELECT row_, p, {" || ' ' || ".join(["word"] + [f"lead(word, {k}) OVER ordered" for k in range(1, 8)])} AS shingle FROM tokens WINDOW ordered AS (PARTITION BY row_ ORDER BY p)),
windows AS (SELECT row_, p, count(*) OVER (PARTITION BY row_, shingle) AS times FROM places WHERE shingle IS NOT NULL),
inside AS (SELECT DISTINCT row_, unnest(range(p, p + 8)) AS q FROM windows WHERE times > 1),
repeats AS (SELECT row_, count(*) AS n_repeat_words FROM inside GROUP BY 1),
keyed AS (SELECT row_, host, t, {_ASCII_LOWER.format("array_to_string(lw, ' ')")} AS line_key, len(lw) AS n FROM worded),
hosts AS (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY 1),
frequent AS (SELECT host, line_key FROM (SELECT host, line_key, count(DISTINCT t) AS n FROM keyed GROUP BY 1, 2) JOIN hosts USING (host) WHERE n > greatest({min_docs}, docs * {share})),
gone AS (SELECT row_, sum(n) AS n_gone FROM keyed JOIN frequent USING (host, line_key) GROUP BY 1),
base AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, (len(ws) - coalesce(n_gone, 0))::BIGINT AS words_left
  FROM w LEFT JOIN dups USING (row_) LEFT JOIN repeats USING (row_) LEFT JOIN gone USING (row_)
),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_left, NOT base_failed AND words_left >= {min_left} * n_words AS kept FROM judged
"""

_NEAR_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda p: array_to_string(ws[p : p + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w
  )
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, b FROM reach JOIN both_ ON other = a)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""
