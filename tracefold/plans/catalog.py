"""The registered queries of the engine and their oracle SQL.

Driver tables hold no code, so queries on text rules work on columns derived
from them by one expression that both engines evaluate (``DERIVED``).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.functions import ids, queryprep, tagging, text
from tracefold.operators import bm25, chunking, dense, fusion, metrics, readme, versions
from tracefold.sources import scratch
from tracefold.plans import ablation
from tracefold.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]

#: Columns made from the tables; the expressions mean the same in Spark and DuckDB.
DERIVED = {
    "identifier": "concat(split_part(p_name, ' ', 1), upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2), '_', p_brand, 'HTTP', split_part(p_type, ' ', 1))",
    "headed": "concat(CASE doc_id % 4 WHEN 0 THEN concat('#!/bin/sh', chr(10)) WHEN 1 THEN concat('# Auto-generated file', chr(10), chr(10), chr(10), chr(10)) WHEN 2 THEN concat('# Copyright holders', chr(10), '# DO NOT EDIT', chr(10)) ELSE '' END, text)",
    "coded": "concat('def ', lang, 'Reader_', source, '():', chr(10), CASE doc_id % 3 WHEN 0 THEN concat('    \"\"\"Reads ', source, '. \"\"\"', chr(10)) WHEN 1 THEN concat('    /* block of ', lang, ' */', chr(10)) ELSE '' END, '    return parseHTTP_', lang, chr(10))",
    "asked": "concat(CASE (conv_id + turn) % 6 WHEN 0 THEN 'how does this work? ' WHEN 1 THEN 'where is the parser ' WHEN 2 THEN 'please fix the crash in ' WHEN 3 THEN 'I can''t tell why it''s slow: ' WHEN 4 THEN 'sort and parse http config ' ELSE '' END, text)",
    "file_path": "concat(source, '/', lang, '/', CASE doc_id % 5 WHEN 0 THEN 'test_' WHEN 1 THEN 'config_' WHEN 2 THEN 'generated_' ELSE '' END, doc_id, '.py')",
    "marked": "concat('- 1. **', lang, '** see [the ', source, ' page](http://host/', doc_id, ') or `', source, '_', lang, '` # ', text)",
    "composed": "concat('Cafe\u0301 ', chr(7), chr(127), 'n\u0303', chr(9), lang, chr(13), chr(10), text)",
    "importing": "concat('from ', source, '/', lang, '.py import x', chr(10), 'import os', chr(10), 'import \"lib/', doc_id % 9, '\"', chr(10), 'from ./near.py import y', chr(10), 'from tool.py import z', chr(10), 'import lib/', doc_id % 3, chr(10), text)",
    "address": "CASE page_id % 9 WHEN 0 THEN concat('https://github.com/owner', page_id, '/repo.git') WHEN 1 THEN concat('git@github.com:own/rep-', page_id, '.git') WHEN 2 THEN concat('own_', page_id, '/name.x') WHEN 3 THEN concat('/srv/code of/', page_id) WHEN 4 THEN concat(' https://www.github.com/a/b', page_id, '/tree/main?x=1#y ') WHEN 5 THEN concat('ssh://git@github.com/a/c', page_id) WHEN 6 THEN concat('https://github.com/', page_id) WHEN 7 THEN '' ELSE url END",
    "symbol": "concat(CASE doc_id % 7 WHEN 0 THEN 'test_' WHEN 1 THEN 'TestOf' ELSE 'read_' END, lang)",
}


def _table(spark: SparkSession, sf_dir: str, name: str, **derived: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return rows.withColumns({k: F.expr(DERIVED[v]) for k, v in derived.items()}) if derived else rows


def _queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), "text")


def _index(spark: SparkSession, sf_dir: str) -> bm25.Index:
    return bm25.build(_table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


def _one_query(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(1).cast("long").alias("query_id"), F.lit(ONE_QUERY).alias("text"))


ONE_QUERY = "license version and the public work of the"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and every hundredth as a query."""
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return rows, rows.filter(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "embedding")


def _lists(spark: SparkSession, sf_dir: str, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """A lexical and a dense list for the same queries: benchmark items and the vectors of their ids."""
    asked = _queries_of(spark, sf_dir)
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    near = rows.join(asked.select("query_id"), F.col("id") == F.col("query_id")).select("query_id", "embedding")
    return bm25.search_once(_table(spark, sf_dir, "documents"), "doc_id", F.col("text"), asked, k), dense.search(rows, near, k)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and dense top-k for every benchmark text, fused."""
    return fusion.fuse(*_lists(spark, sf_dir)).select("query_id", "id", "bm25_rank", "bm25_score", "dense_rank", "dense_score", "fused_score", "rank")


def tokenise_counts(spark, sf_dir):
    tokens = _table(spark, sf_dir, "documents").select("doc_id", text.tokenise(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


def term_df_top(spark, sf_dir):
    return _index(spark, sf_dir).term_df.orderBy(F.desc("df"), "term").limit(50)


def corpus_stats(spark, sf_dir):
    return _index(spark, sf_dir).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_topk_single(spark, sf_dir):
    return bm25.search_once(_table(spark, sf_dir, "documents"), "doc_id", F.col("text"), _one_query(spark), 10)


def bm25_topk_batch(spark, sf_dir):
    return bm25.search_once(_table(spark, sf_dir, "documents"), "doc_id", F.col("text"), _queries_of(spark, sf_dir), 10)


def tokenise_identifiers(spark, sf_dir):
    parts = _table(spark, sf_dir, "part", identifier="identifier")
    return parts.select("p_partkey", "identifier", F.array_join(text.tokenise(F.col("identifier")), " ").alias("tokens"), text.split_identifier(F.col("identifier")).alias("split"))


def strip_boilerplate(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents", headed="headed")
    return docs.select("doc_id", text.strip_boilerplate(F.col("headed")).alias("clean"), (text.strip_boilerplate(F.col("headed")) != F.col("headed")).alias("changed"))


def extract_docstring(spark, sf_dir):
    return _table(spark, sf_dir, "documents", coded="coded").select("doc_id", text.extract_docstring(F.col("coded")).alias("docstring"))


def normalize_document(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents", coded="coded", symbol="symbol")
    return docs.select("doc_id", text.normalize_document(F.col("coded"), F.col("symbol")).alias("normalized"))


def chunk_identity(spark, sf_dir):
    c = F.col
    docs = _table(spark, sf_dir, "documents", file_path="file_path", symbol="symbol")
    return docs.select("doc_id", ids.chunk_id(c("file_path"), c("symbol"), F.lit(1)).alias("chunk_id"), ids.lineage_id(c("file_path"), c("symbol")).alias("lineage_id"), ids.content_hash(c("text")).alias("content_hash"), text.make_snapshot_id(c("file_path"), c("lang")).alias("snapshot_id"), chunking.language_of(c("file_path")).alias("language"))


def line_window_chunks(spark, sf_dir):
    files = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source"))
    return chunking.line_windows(files, 10, 3)


def tag_chunks(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents", file_path="file_path", symbol="symbol")
    tags = tagging.tags(F.col("file_path"), F.col("symbol"), F.col("text"), F.lit("python"), F.lit(None).cast("string"), F.col("source"))
    return docs.withColumn("t", tags).select("doc_id", "t.is_test", "t.is_config", "t.is_generated", "t.chunk_type")


def query_category(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations", asked="asked")
    return turns.select("conv_id", "turn", queryprep.category(F.col("asked")).alias("query_type"))


def expand_query(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations", asked="asked")
    return turns.select("conv_id", "turn", queryprep.expand_keywords(F.col("asked")).alias("expanded"), queryprep.expand_contractions(F.col("asked")).alias("spelt_out"))


def clean_queries(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations", asked="asked").select("conv_id", "turn", "asked")
    return queryprep.clean_queries(turns, "asked").select("conv_id", "turn", "query_type", "cleaned", "was_cleaned")


def matched_terms(spark, sf_dir):
    docs, asked = _table(spark, sf_dir, "documents"), _queries_of(spark, sf_dir)
    hits = bm25.search_once(docs, "doc_id", F.col("text"), asked, 5)
    rows = hits.join(asked, "query_id").withColumnRenamed("text", "query").join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    return rows.select("query_id", "id", F.array_join(queryprep.matched_terms(F.col("query"), F.col("text")), " ").alias("terms"))


def dense_topk(spark, sf_dir):
    rows, asked = _vectors(spark, sf_dir)
    return dense.search(rows, asked, 10)


def dense_ann_recall(spark, sf_dir):
    rows, asked = _vectors(spark, sf_dir)
    found = dense.InvertedFile(rows, cells=16).search(asked, 10, probes=14)
    return dense.recall(found, dense.search(rows, asked, 10))


def rrf_weighted_nlists(spark, sf_dir):
    """Every hundredth vector as a query, with three lists each: of its own vector, of its opposite and of the next one's."""
    rows, asked = _vectors(spark, sf_dir)
    opposite = asked.select("query_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    following = rows.filter(F.col("id") % 100 == 1).select((F.col("id") - 1).alias("query_id"), "embedding")
    return fusion.fuse_many([dense.search(rows, q, 15) for q in (asked, opposite, following)], weights=[1.0, 0.5, 2.0])


def high_confidence_gate(spark, sf_dir):
    return fusion.high_confidence(fusion.fuse(*_lists(spark, sf_dir)), 0.02)


def single_retriever_fallback(spark, sf_dir):
    lexical, near = _lists(spark, sf_dir)
    rows = fusion.fuse_or_fall_back(lexical.filter("query_id % 3 <> 0"), near.filter("query_id % 3 <> 1"))
    return rows.select("query_id", "id", "fused_score", "rank")


def post_filter_vs_prefilter(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    asked = _queries_of(spark, sf_dir)
    scored = bm25.scores(bm25.build_for(_table(spark, sf_dir, "documents"), "doc_id", F.col("text"), bm25.query_terms(asked)), asked)
    after = fusion.post_filter(bm25.ranked(scored, 10).join(docs, "id"), lang="DE")
    before = bm25.ranked(fusion.post_filter(scored.join(docs, "id"), lang="DE"), 10)
    out = "query_id", "id", "score", "rank"
    return after.select(F.lit("after").alias("filtered"), *out).unionByName(before.select(F.lit("before").alias("filtered"), *out))


def rerank_passthrough(spark, sf_dir):
    rows = fusion.fuse(*_lists(spark, sf_dir))
    done = fusion.rerank(rows, F.lit(""), F.lit(""), None, first=5, confident=fusion.high_confidence(rows, 0.02))
    return done.select("query_id", "id", "fused_score", "rerank_score", "rank")


def lineage_collapse(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    w = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "id")
    rows = turns.select(F.col("role").alias("query_id"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.lit("L"), (F.col("conv_id") % 50).cast("string")).alias("lineage_id"), (F.length("text") % 97).cast("double").alias("fused_score"))
    best = fusion.collapse_lineages(rows.withColumn("rank", F.row_number().over(w)))
    return best.select("query_id", "id", "lineage_id", "fused_score", "rank", F.array_join(F.transform("other_versions", lambda o: o["id"]), " ").alias("others"))


def _manifests(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    return events.select(F.col("event_id").cast("string").alias("snapshot_id"), F.concat(F.lit("Repo"), F.col("user_id").cast("string")).alias("repo_name"), F.concat(F.lit("/srv/code/repo"), F.col("user_id").cast("string")).alias("repo_path"), "ts", F.floor("value").cast("long").alias("chunk_count"))


def latest_snapshot_per_repo(spark, sf_dir):
    return versions.latest_snapshots(_manifests(spark, sf_dir)).select("repo_key", "snapshot_id", "chunk_count")


def repo_list(spark, sf_dir):
    return versions.repositories(_manifests(spark, sf_dir)).select("repo_name", "snapshot_id", "chunk_count")


def health_rollup(spark, sf_dir):
    return versions.health(_manifests(spark, sf_dir))


def repo_name_match(spark, sf_dir):
    repos = _table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("repo_name"), F.concat(F.lit("/srv/"), "s_name").alias("repo_path"))
    wanted = _table(spark, sf_dir, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("wanted"))
    return versions.matching(repos, wanted).select("s_suppkey", "repo_name")


def _versioned(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    return turns.select(F.col("turn").cast("string").alias("snapshot_id"), F.col("conv_id").cast("string").alias("lineage_id"), F.lit(1).alias("start_line"), F.col("role").alias("chunk_id"), F.col("text").alias("code"))


def _turn_manifests(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select(F.col("turn").cast("string").alias("snapshot_id"), "turn").distinct()
    return turns.select("snapshot_id", F.concat(F.lit("c"), "snapshot_id").alias("original_commit"), F.lit("").alias("commit_message"), F.timestamp_seconds(F.col("turn") * 3600).alias("ts"))


def lineage_history(spark, sf_dir):
    found = versions.lineage_history(_versioned(spark, sf_dir), _turn_manifests(spark, sf_dir))
    return found.select("lineage_id", "snapshot_id", "original_commit", "code", F.col("version").cast("long").alias("version"))


def adjacent_versions(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").withColumn("back", -F.col("turn"))
    return versions.adjacent(rows, "conv_id", "back", "text").select("conv_id", "turn", F.length("text").cast("long").alias("n_new"), F.length("older_code").cast("long").alias("n_old"))


def version_diff_lines(spark, sf_dir):
    return versions.version_diffs(_table(spark, sf_dir, "conversations").withColumn("back", -F.col("turn")), "conv_id", "back", "text")


def embedding_cache_miss(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"))
    cache = docs.filter("doc_id % 2 = 0").select("content_hash").distinct()
    return docs.filter("doc_id % 2 = 1").join(cache, "content_hash", "left_anti").groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def incremental_build(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents", file_path="file_path").select("file_path", "doc_id", F.length("text").alias("n"))
    changed = rows.filter("doc_id % 10 = 3").withColumn("n", F.col("n") + 1)
    removed = rows.filter("doc_id % 10 = 7").select("file_path")
    carried = versions.carry_forward(rows, changed, removed).withColumn("mode", F.lit("carry"))
    return carried.unionByName(versions.delta(rows, changed).withColumn("mode", F.lit("delta")))


def _label_qrels(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "label")
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return asked.join(rows.withColumnRenamed("vec_id", "id"), "label").select("query_id", "id", F.lit(1).alias("rel"))


def ndcg_mrr_recall_map(spark, sf_dir):
    rows, asked = _vectors(spark, sf_dir)
    return metrics.evaluate(dense.search(rows, asked, 10), _label_qrels(spark, sf_dir), 10)


def ablation_grid(spark, sf_dir):
    lexical, near = _lists(spark, sf_dir)
    near = near.select("query_id", "id", "score", "rank")
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "label")
    asked = _queries_of(spark, sf_dir).select("query_id").join(rows.withColumnRenamed("vec_id", "query_id"), "query_id")
    qrels = asked.join(rows.withColumnRenamed("vec_id", "id"), "label").select("query_id", "id", F.lit(1).alias("rel"))
    return ablation.grid(lexical, near, qrels)


def readme_analysis(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo_name"), F.concat(F.lit("# Project "), "source", F.lit("\n\n"), "text", F.lit("\n## Features\n- **Fast**: with `core/main.py`\n- plain item of a list\n")).alias("content"))
    out = readme.analyse_readmes(docs)
    return out.select("doc_id", "title", "summary", F.array_join("features", "|").alias("features"), F.array_join("key_modules", "|").alias("modules"), F.array_join("suggested_questions", "|").alias("questions"))


def readme_title_summary(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# Project "), "source", F.lit("\n\n"), "text").alias("content"))
    title, summary = readme.title_and_summary(F.col("content"))
    return docs.select("doc_id", title.alias("title"), F.length(summary).cast("long").alias("n_summary"))


def code_chunks(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents", coded="coded", file_path="file_path")
    files = docs.select(F.col("source").alias("repo_name"), "file_path", F.concat("coded", F.lit("\n\nclass Holder:\n    x = 1\n    y = 2\n")).alias("source"))
    return chunking.chunk_files(files).select("repo_name", "file_path", "symbol_name", "chunk_type", "start_line", "end_line", "signature", "docstring", "chunk_id")



def embedding_text(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents", coded="coded", symbol="symbol")
    return docs.select("doc_id", text.text_for_embedding(F.col("symbol"), text.extract_docstring(F.col("coded")), F.col("coded")).alias("embedded"))


def markdown_inline(spark, sf_dir):
    return _table(spark, sf_dir, "documents", marked="marked").select("doc_id", text.clean_markdown_inline(F.col("marked")).alias("plain"))


def unicode_clean(spark, sf_dir):
    return _table(spark, sf_dir, "documents", composed="composed").select("doc_id", text.unicode_normalize(F.col("composed")).alias("clean"))


def repository_addresses(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages", address="address")
    named = pages.withColumn("_o", text.parse_owner_repo(F.col("address")))
    return named.select("page_id", text.is_remote_git_url(F.col("address")).alias("is_remote"), F.col("_o.owner").alias("owner"), F.col("_o.repo").alias("repo"))


def related_files(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents", importing="importing")
    own = F.concat("source", F.lit("/"), "lang", F.lit(".py"))
    return docs.select("doc_id", F.array_join(queryprep.related_files(F.col("importing"), F.when(F.col("doc_id") % 2 == 0, own).otherwise("main.py")), "|").alias("related"))


def search_results(spark, sf_dir):
    """The first five fused results of each query, with the number before the cut and a percentage."""
    rows = fusion.trim(fusion.fuse(*_lists(spark, sf_dir)), 5)
    return rows.select("query_id", "id", "rank", "total_results", F.round(queryprep.match_percent(F.col("dense_score"), F.col("fused_score")), 4).alias("match_percent"))


def bm25_bare_topk(spark, sf_dir):
    """Lexical search with other parameters and without the constant factor."""
    asked = _queries_of(spark, sf_dir)
    index = bm25.build_for(_table(spark, sf_dir, "documents"), "doc_id", F.col("text"), bm25.query_terms(asked))
    return bm25.search(index, asked, 10, k1=1.2, b=0.5, variant="bare")


def shared_words(queries: list[str], texts: list[str]) -> list[float]:
    """A scorer for tests and comparisons: the distinct words that query and text share."""
    return [float(len(set(q.split(" ")) & set(t.split(" ")))) for q, t in zip(queries, texts, strict=True)]


def rerank_scored(spark, sf_dir):
    """The first ten fused results of each query in the order of a scorer, the rest after them."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("passage"))
    asked = _queries_of(spark, sf_dir).withColumnRenamed("text", "query")
    rows = fusion.fuse(*_lists(spark, sf_dir)).join(asked, "query_id").join(docs, "id", "left")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return fusion.rerank(rows, blank(F.col("passage")), blank(F.col("query")), shared_words, first=10).select("query_id", "id", "fused_score", "rerank_score", "rank")

def version_list(spark, sf_dir):
    rows = _manifests(spark, sf_dir).withColumns({"original_commit": F.concat(F.lit("c"), "snapshot_id"), "tag": F.lit(None).cast("string"), "commit_message": F.concat(F.lit("build "), "chunk_count")})
    return versions.version_list(rows).select("snapshot_id", "original_commit", "commit_message", "chunk_count", "repo_name")


def path_history(spark, sf_dir):
    """The versions of one path: its first chunk in each snapshot."""
    turns = _table(spark, sf_dir, "conversations")
    chunks = turns.select(F.col("turn").cast("string").alias("snapshot_id"), F.lit("chat.py").alias("file_path"), F.col("conv_id").alias("start_line"), F.col("role").alias("chunk_id"), F.lit("x").alias("lineage_id"), F.col("text").alias("code"))
    found = versions.lineage_history(chunks, _turn_manifests(spark, sf_dir), file_path="chat.py")
    return found.select("snapshot_id", "start_line", "code", F.col("version").cast("long").alias("version"))

def job_state_latest(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return jobs.latest_states(events, "user_id", ("ts", "event_id")).select("user_id", "event_id", "event_type")


def event_telemetry(spark, sf_dir):
    return jobs.telemetry(_table(spark, sf_dir, "events"))


def stream_jobs(spark, sf_dir):
    """A job file for each region, run through the stream; the last state of each job."""
    from tracefold.streaming.replay import replay_jobs

    rows = _table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("job_id"), F.col("r_name").alias("repo_path"), F.lit(None).cast("string").alias("commit_sha"), F.lit(False).alias("force_full"))
    base = os.path.join(scratch.shared_dir(spark), uuid.uuid4().hex)
    return jobs.latest_states(replay_jobs(rows, os.path.join(base, "jobs")), order=("ts", "status")).select("job_id", "status", "message")


NAMES = (
    "tokenise_counts term_df_top corpus_stats bm25_topk_single bm25_topk_batch tokenise_identifiers strip_boilerplate extract_docstring normalize_document "
    "chunk_identity line_window_chunks tag_chunks query_category expand_query clean_queries matched_terms dense_topk dense_ann_recall rrf_weighted_nlists "
    "high_confidence_gate single_retriever_fallback post_filter_vs_prefilter rerank_passthrough lineage_collapse latest_snapshot_per_repo repo_list health_rollup "
    "repo_name_match lineage_history adjacent_versions version_diff_lines embedding_cache_miss incremental_build ndcg_mrr_recall_map ablation_grid "
    "readme_analysis readme_title_summary code_chunks job_state_latest event_telemetry stream_jobs "
    "embedding_text markdown_inline unicode_clean repository_addresses related_files search_results version_list path_history bm25_bare_topk rerank_scored"
).split()


def queries() -> dict[str, Query]:
    return {"rrf_hybrid": flagship} | {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    from tracefold.plans.oracles import ORACLES

    return dict(ORACLES)
