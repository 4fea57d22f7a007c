"""The engine as an object: index repositories, search them, look at their history."""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.functions import queryprep, text
from tracefold.operators import bm25, dense, fusion, versions
from tracefold.operators.chunking import chunk_files
from tracefold.sources import git
from tracefold.sources.scratch import written
from tracefold.sources.files import SnapshotStore, scan_repository


@dataclass(frozen=True)
class SearchOptions:
    """What a search may set; every field is part of the cache key."""

    top_k: int = 10
    repo: str | None = None
    snapshot: str | None = None
    language: str | None = None
    chunk_type: str | None = None
    prefilter: bool = False
    hybrid: bool = True
    rerank: bool = False
    expand: bool = False
    collapse: bool = True
    global_rank: bool = True
    candidates: int = 100
    rerank_first: int = 30
    rrf_k: int = fusion.RRF_K
    weights: tuple[float, float] = (1.0, 1.0)
    margin: float = 0.15

    def __post_init__(self) -> None:
        if not 1 <= self.top_k <= 50:
            raise ValueError("top_k must be from 1 to 50")


@dataclass
class SearchResponse:
    results: DataFrame | None
    snapshots: list[str]
    options: SearchOptions
    timings_ms: dict[str, float] = field(default_factory=dict)
    error: str | None = None


class ResultCache:
    """The rows of recent searches, by everything that determines them."""

    def __init__(self, most: int = 1024, seconds: float = 3600.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.seconds, self.clock, self.rows = most, seconds, clock, OrderedDict()

    @staticmethod
    def key(query: str, snapshots: list[str], options: SearchOptions) -> str:
        return hashlib.sha256(json.dumps([query, sorted(snapshots), repr(options)]).encode()).hexdigest()

    def get(self, key: str) -> list | None:
        found = self.rows.get(key)
        if found is None or self.clock() - found[0] > self.seconds:
            self.rows.pop(key, None)
            return None
        self.rows.move_to_end(key)
        return found[1]

    def put(self, key: str, rows: list) -> None:
        self.rows[key] = (self.clock(), rows)
        self.rows.move_to_end(key)
        while len(self.rows) > self.most:
            self.rows.popitem(last=False)

    def clear(self) -> None:
        self.rows.clear()


class Engine:
    """Indexing and search over a snapshot store."""

    def __init__(self, spark: SparkSession, root: str, encoder: dense.Encoder | None = None, model_id: str = "hashed-words-384", scorer: Callable | None = None, index_paths: bool = False):
        self.spark, self.store, self.scorer, self.index_paths = spark, SnapshotStore(spark, root), scorer, index_paths
        self.encoder, self.model_id, self.cache = encoder or dense.hashed_words(), model_id, ResultCache()

    # Indexing

    def index_repository(self, folder: str, commit: str | None = None, force: bool = False, mode: str = "carry") -> str:
        """Index a folder as a snapshot and return its id; an existing one is kept unless ``force``."""
        commit = commit or git.head_commit(folder)
        name = folder.rstrip("/").rsplit("/", 1)[-1]
        return self.index_files(scan_repository(self.spark, folder, name), name, commit, repo_path=folder, force=force, mode=mode, message=git.commit_subject(folder), tag=git.commit_tag(folder))

    def index_files(self, files: DataFrame, repo_name: str, commit: str, *, repo_path: str | None = None, force: bool = False, mode: str = "carry", message: str = "", tag: str | None = None) -> str:
        """Index ``files`` (repo_name, file_path, source).

        With an older snapshot of the repository only files whose content is new
        are chunked; ``carry`` takes the other chunks over, ``delta`` leaves them
        out, ``full`` chunks everything.
        """
        began = time.monotonic()
        one = self.spark.range(1).select(text.make_snapshot_id(F.lit(repo_name), F.lit(commit)).alias("s"))
        snapshot = one.first()["s"]
        if not force and self.store.has(snapshot):
            return snapshot
        listing = files.select("repo_name", "file_path", "source", F.sha2(F.coalesce("source", F.lit("")).cast("binary"), 256).alias("content_hash"))
        older = self._latest(repo_name, snapshot) if mode != "full" else None
        if older:
            before = self.store.read("files", [older])
            changes = versions.changed_between(before, listing)
            fresh = chunk_files(listing.join(changes.filter("change <> 'removed'"), "file_path", "left_semi"))
            old = self.store.read("chunks", [older]).drop("snapshot_id")
            chunks = fresh if mode == "delta" else versions.carry_forward(old, fresh, changes)
        else:
            chunks = chunk_files(listing)
        self.store.write("chunks", chunks, snapshot)
        self.store.write("files", listing.select("repo_name", "file_path", "content_hash"), snapshot)
        saved = self.store.read("chunks", [snapshot])
        body = bm25.indexed_text(F.col("symbol_name"), F.col("docstring"), F.col("code"), F.col("file_path") if self.index_paths else None)
        index = bm25.build(saved, "chunk_id", body)
        self.store.write("postings", index.postings, snapshot)
        self.store.write("term_df", index.term_df, snapshot)
        self.store.write("corpus_stats", index.stats, snapshot)
        known = self.store.read("embedding_cache")
        known = None if known is None else known.filter(F.col("snapshot_id") != snapshot).drop("snapshot_id")
        passage = text.normalize_document(F.col("code"), F.col("symbol_name"))
        # New vectors are written to a partition of their own and read back: a text reaches the encoder once.
        self.store.write("embedding_cache", dense.missing_embeddings(saved, passage, self.encoder, known, self.model_id), snapshot)
        added = self.store.read("embedding_cache", [snapshot])
        caches = [x for x in (known, None if added is None else added.drop("snapshot_id")) if x is not None]
        vectors = dense.from_cache(saved.select("chunk_id", "symbol_name", "code"), passage, reduce(DataFrame.unionByName, caches), self.model_id)
        self.store.write("vectors", vectors.select("chunk_id", "embedding"), snapshot)
        n_texts = saved.select(dense.text_hash(passage)).distinct().count()
        n_new = 0 if added is None else added.count()
        row = (snapshot, commit, tag, message, saved.count(), self.model_id, time.monotonic() - began, n_new, n_texts - n_new, repo_path or repo_name, repo_name)
        names = "snapshot_id string, original_commit string, tag string, commit_message string, chunk_count long, model_name string, build_time_seconds double, n_embedded long, n_cached long, repo_path string, repo_name string"
        self.store.add_manifest(self.spark.createDataFrame([row], names).withColumn("ts", F.current_timestamp()))
        self.cache.clear()
        return snapshot

    def _latest(self, repo_name: str, but: str) -> str | None:
        found = self.store.manifests()
        if found is None:
            return None
        row = versions.latest_snapshots(found.filter((F.col("repo_name") == repo_name) & (F.col("snapshot_id") != but))).first()
        return row["snapshot_id"] if row else None

    # Search

    def snapshots(self, options: SearchOptions) -> list[str]:
        found = self.store.manifests()
        if found is None:
            return []
        if options.snapshot:
            rows = found.filter((F.col("snapshot_id") == options.snapshot) | (F.col("original_commit") == options.snapshot))
        else:
            rows = versions.versions_to_search(found, options.repo)
        return [r["snapshot_id"] for r in rows.select("snapshot_id").collect()]

    def search_batch(self, queries: DataFrame, options: SearchOptions = SearchOptions()) -> SearchResponse:
        """Results for a table of queries (query_id, text): one plan, whatever their number."""
        marks, began = {}, time.monotonic()

        def mark(name: str) -> None:
            marks[name] = (time.monotonic() - began) * 1000

        ids = self.snapshots(options)
        mark("resolve")
        if not ids:
            return SearchResponse(None, [], options, marks, "nothing is indexed")
        cleaned = queryprep.clean_queries(queries, expand=options.expand)
        chunks = self.store.read("chunks", ids)
        if options.prefilter:
            chunks = fusion.post_filter(chunks, language=options.language, chunk_type=options.chunk_type)
        lexical = self._lexical(cleaned, ids, options, chunks if options.prefilter else None)
        vectors = self.store.read("vectors", ids)
        if options.prefilter:
            vectors = vectors.join(chunks.select("snapshot_id", "chunk_id"), ["snapshot_id", "chunk_id"], "left_semi")
        # Written, so that a query is encoded once, however many snapshots there are.
        asked = written(cleaned.select("query_id", dense.encode_column(F.col("cleaned"), self.encoder).alias("embedding")))
        near = None
        for s in ids:  # a matrix product per snapshot, as ranks are per snapshot
            own = dense.search(vectors.filter(F.col("snapshot_id") == s), asked, options.candidates, "chunk_id").withColumn("snapshot_id", F.lit(s))
            near = own if near is None else near.unionByName(own)
        mark("retrieve")
        by = ("query_id", "snapshot_id")
        merged = fusion.fuse_or_fall_back(lexical, near, options.hybrid, options.rrf_k, options.weights, by)
        merged = fusion.reranked_by(merged, "fused_score") if options.global_rank else merged.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "snapshot_id", "id")))
        # Codes join late, for the candidates alone.
        rows = merged.join(chunks.withColumnRenamed("chunk_id", "id"), ["snapshot_id", "id"])
        if not options.prefilter:
            rows = fusion.post_filter(rows, language=options.language, chunk_type=options.chunk_type)
        rows = fusion.reranked_by(rows, "fused_score")
        if options.rerank:
            rows = rows.join(cleaned.select("query_id", "cleaned"), "query_id")
            sure = fusion.high_confidence(rows, options.margin)
            rows = fusion.rerank(rows, F.concat_ws("\n", "symbol_name", "code"), F.col("cleaned"), self.scorer, options.rerank_first, sure)
        if options.collapse:
            rows = fusion.collapse_lineages(rows, extra=("snapshot_id",))
        rows = fusion.trim(rows, options.top_k).join(queries.select("query_id", F.col("text").alias("query")), "query_id")
        body = F.concat_ws(" ", "code", "docstring", "symbol_name", "file_path")
        rows = rows.withColumn("matched_terms", queryprep.matched_terms(F.col("query"), body)).withColumn("match_percent", queryprep.match_percent(F.col("dense_score"), F.col("fused_score"))).withColumn("related_files", queryprep.related_files(F.col("code"), F.col("file_path")))
        mark("plan")
        return SearchResponse(rows.orderBy("query_id", "rank"), ids, options, marks)

    def _lexical(self, queries: DataFrame, ids: list[str], options: SearchOptions, only: DataFrame | None) -> DataFrame:
        """BM25 with the statistics of each snapshot."""
        terms = bm25.query_terms(queries, "cleaned")
        stats = self.store.read("corpus_stats", ids)
        weighed = self.store.read("term_df", ids).join(terms, "term").join(stats, "snapshot_id")
        weighed = weighed.select("query_id", "snapshot_id", "term", (bm25.idf(F.col("n"), F.col("df")) * F.col("qtf") * (bm25.K1 + 1)).alias("w"), "avgdl")
        part = F.col("w") * F.col("tf") / (F.col("tf") + bm25.K1 * (1 - bm25.B + bm25.B * F.col("dl") / F.col("avgdl")))
        postings = self.store.read("postings", ids)
        if only is not None:
            postings = postings.join(only.select("snapshot_id", F.col("chunk_id").alias("id")), ["snapshot_id", "id"], "left_semi")
        scored = postings.join(weighed, ["snapshot_id", "term"]).groupBy("query_id", "snapshot_id", "id").agg(F.round(F.sum(part), 6).alias("score")).filter("score > 0")
        w = Window.partitionBy("query_id", "snapshot_id").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= options.candidates)

    def search(self, query: str, options: SearchOptions = SearchOptions()) -> list:
        """Rows for one query, from the cache if it was asked lately."""
        key = self.cache.key(query, self.snapshots(options), options)
        rows = self.cache.get(key)
        if rows is None:
            response = self.search_batch(self.spark.createDataFrame([(1, query)], "query_id long, text string"), options)
            rows = [] if response.results is None else response.results.collect()
            self.cache.put(key, rows)
        return rows

    # History and overviews

    def versions(self, repo_name: str | None = None) -> DataFrame | None:
        found = self.store.manifests()
        return None if found is None else versions.version_list(found, repo_name)

    def history(self, lineage: str | None = None, file_path: str | None = None) -> DataFrame:
        return versions.lineage_history(self.store.read("chunks"), self.store.manifests(), lineage, file_path)

    def diffs(self, lineage: str) -> DataFrame:
        return versions.version_diffs(self.history(lineage), "lineage_id", "version")

    def snippet(self, chunk_id: str, snapshot: str | None = None) -> DataFrame:
        ids = self.snapshots(SearchOptions(snapshot=snapshot))
        return self.store.read("chunks", ids).filter(F.col("chunk_id") == chunk_id)

    def repositories(self) -> DataFrame:
        return versions.repositories(self.store.manifests())

    def health(self) -> DataFrame:
        return versions.health(self.store.manifests())
