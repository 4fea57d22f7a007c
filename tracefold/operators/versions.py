"""Snapshots, lineages and repositories: latest versions, histories, diffs, incremental builds."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MANIFEST = (
    "snapshot_id string, original_commit string, tag string, commit_message string, ts timestamp, chunk_count long, model_name string, "
    "build_time_seconds double, n_embedded long, n_cached long, repo_path string, repo_name string"
)


def basename(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(F.coalesce(path, F.lit("")), r"\\", "/"), r"([^/]*)/*\z", 1)


def repo_key(repo_name: Column, repo_path: Column, snapshot: Column) -> Column:
    """The name of a repository, else its folder, else its snapshot, in lower case."""
    filled = lambda c: F.when(c != "", c)
    return F.lower(F.coalesce(filled(repo_name), filled(basename(repo_path)), snapshot))


def latest_snapshots(manifests: DataFrame) -> DataFrame:
    """The newest snapshot of each repository; rows without a snapshot id don't count."""
    keyed = manifests.filter(F.coalesce("snapshot_id", F.lit("")) != "").withColumn("repo_key", repo_key(F.col("repo_name"), F.col("repo_path"), F.col("snapshot_id")))
    w = Window.partitionBy("repo_key").orderBy(F.desc("ts"), "snapshot_id")
    return keyed.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def name_matches(repo_name: Column, repo_path: Column, wanted: Column) -> Column:
    """Whether a repository goes by the name ``wanted`` (a name, folder, path or address)."""
    name = F.lower(F.coalesce(repo_name, F.lit("")))
    path = F.lower(F.regexp_replace(F.coalesce(repo_path, F.lit("")), r"\\", "/"))
    want = F.regexp_replace(F.rtrim(F.regexp_replace(F.lower(F.trim(wanted)), r"\\", "/"), F.lit("/")), r"\.git\z", "")
    base, want_base = basename(path), basename(want)
    return (want_base != "") & ((want == name) | (want == base) | path.contains(want) | name.endswith(want) | (want_base == base) | name.endswith(want_base))


def matching(manifests: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of ``manifests`` that any row of ``names`` (column ``wanted``) matches.

    The predicate has no equality to hash on, so this is a nested-loop semi join;
    manifests are one row a snapshot, and names come from a request.
    """
    return manifests.join(names, name_matches(F.col("repo_name"), F.col("repo_path"), F.col("wanted")), "left_semi")


def versions_to_search(manifests: DataFrame, repo_filter: str | None = None) -> DataFrame:
    """The newest snapshot of every repository, or of those that a comma-separated filter names."""
    if repo_filter and repo_filter.strip().lower() not in ("", "all"):
        names = [n.strip() for n in repo_filter.split(",") if n.strip()]
        manifests = matching(manifests, manifests.sparkSession.createDataFrame([(n,) for n in names], "wanted string"))
    return latest_snapshots(manifests)


def lineage_history(chunks: DataFrame, manifests: DataFrame, lineage: str | None = None, file_path: str | None = None) -> DataFrame:
    """One row per snapshot and lineage (or path), newest first by ``version`` 1, 2, ...

    Filters on snapshots and lineages reach the scan; manifests add commit and time.
    """
    rows = chunks
    if lineage is not None:
        rows = rows.filter(F.col("lineage_id") == lineage)
    if file_path is not None:
        rows = rows.filter(F.col("file_path") == file_path)
    key = "file_path" if file_path is not None else "lineage_id"
    first = Window.partitionBy("snapshot_id", key).orderBy("start_line", "chunk_id")
    one = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    named = one.join(manifests.select("snapshot_id", "original_commit", "commit_message", "ts"), "snapshot_id", "left")
    return named.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("snapshot_id"))))


def adjacent(history: DataFrame, by: str, order: str, code: str = "code") -> DataFrame:
    """Each row with the next older one's code (null for the oldest); ``order`` rises from new to old."""
    return history.withColumn("older_code", F.lead(code).over(Window.partitionBy(by).orderBy(order)))


_DIFF = "array<struct<type string, line string, line_no_a int, line_no_b int>>"


def diff_lines(a: str, b: str) -> list[tuple[str, str, int | None, int | None]]:
    """A unified diff with three lines of context as typed lines with both line numbers."""
    out: list[tuple[str, str, int | None, int | None]] = []
    for group in difflib.SequenceMatcher(None, old := a.splitlines(), new := b.splitlines()).get_grouped_opcodes(3):
        for what, i1, i2, j1, j2 in group:
            if what == "equal":
                out += [("context", old[i], i + 1, j1 + i - i1 + 1) for i in range(i1, i2)]
                continue
            out += [("remove", old[i], i + 1, None) for i in range(i1, i2)] + [("add", new[j], None, j + 1) for j in range(j1, j2)]
    return out


def _diff(a: Column, b: Column) -> Column:
    @F.pandas_udf(_DIFF)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([diff_lines(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return run(a, b)


def version_diffs(history: DataFrame, by: str, order: str, code: str = "code") -> DataFrame:
    """Diff lines between each version and the next older one (``older_code`` to ``code``)."""
    pairs = adjacent(history, by, order, code).filter("older_code is not null").select(by, order, _diff(F.col("older_code"), F.col(code)).alias("_d"))
    return pairs.select(by, order, F.posexplode("_d").alias("line_index", "d")).select(by, order, "line_index", "d.*")


def carry_forward(old: DataFrame, changed: DataFrame, removed: DataFrame | None = None, key: str = "file_path") -> DataFrame:
    """A full snapshot from the last one: rows of files not rebuilt or removed, and the rebuilt rows."""
    gone = changed.select(key).distinct()
    if removed is not None:
        gone = gone.unionByName(removed.select(key)).distinct()
    return old.join(gone, key, "left_anti").select(*changed.columns).unionByName(changed)


def delta(current: DataFrame, changed_files: DataFrame, key: str = "file_path") -> DataFrame:
    """Only the rows of changed files."""
    return current.join(changed_files.select(key).distinct(), key, "left_semi").select(*current.columns)


def changed_between(old: DataFrame, new: DataFrame, key: str = "file_path", content: str = "content_hash") -> DataFrame:
    """``file_path`` and ``change`` (added, removed, changed) between two listings with content hashes."""
    a, b = old.select(key, F.col(content).alias("_a")), new.select(key, F.col(content).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change is not null")


def repositories(manifests: DataFrame) -> DataFrame:
    """One row per repository name, its newest snapshot."""
    w = Window.partitionBy("repo_name").orderBy(F.desc("ts"), F.desc("repo_path"), F.desc("chunk_count"), "snapshot_id")
    return manifests.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def health(manifests: DataFrame) -> DataFrame:
    """Repositories, and chunks in their newest snapshots."""
    return latest_snapshots(manifests).agg(F.count("*").alias("repositories"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))


def version_list(manifests: DataFrame, repo_name: str | None = None) -> DataFrame:
    rows = manifests if repo_name is None else manifests.filter(F.lower("repo_name") == repo_name.lower())
    return rows.select("snapshot_id", "original_commit", "tag", "commit_message", "ts", "chunk_count", "repo_name").orderBy(F.desc("ts"), "snapshot_id")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Iterator", "annotations")]
