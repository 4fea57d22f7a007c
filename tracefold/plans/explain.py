"""A rule-based plain-English role for a chunk, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path words, the role they suggest, and how hard such code is to read.
ROLES = (
    (("search", "query"), "Core Search Functionality", "Advanced"),
    (("bm25",), "Keyword Matching Engine", "Moderate"),
    (("embed", "encoder"), "AI Embedding & Neural Vectorizer", "Advanced"),
    (("cache",), "Performance & Latency Optimization", "Simple"),
    (("lineage", "version"), "Version History & AST Lineage", "Moderate"),
    (("chunk", "normalize"), "Code Parsing & Structure Analysis", "Moderate"),
    (("main", "api"), "Backend API Entry Point", "Simple"),
)


def explanation(file_path: Column, symbol: Column, docstring: Column, code: Column) -> Column:
    """headline, purpose (first docstring line), role, complexity, handles_errors."""
    low = F.lower(file_path)
    hit = lambda words: low.rlike("|".join(words))
    role, level = F.lit("Code Infrastructure"), F.lit("Moderate")
    for words, name, hard in reversed(ROLES):
        role, level = F.when(hit(words), name).otherwise(role), F.when(hit(words), hard).otherwise(level)
    named = F.coalesce(symbol, F.lit("")) != ""
    first = F.regexp_replace(F.substring_index(F.trim(F.coalesce(docstring, F.lit(""))), "\n", 1), "^[\"'\\s]+|[\"'\\s]+$", "")
    # The sentences.
    return F.struct(
        F.when(named, F.concat(F.lit("Function/Class: "), symbol)).otherwise(F.concat(F.lit("Code Block in "), file_path)).alias("headline"),
        F.when(first != "", first).otherwise(F.concat(F.lit("Executes specialized operations in "), file_path, F.lit("."))).alias("purpose"),
        role.alias("role"),
        level.alias("complexity"),
        (code.contains("try:") & code.contains("except")).alias("handles_errors"),
    )
