"""Tags of a chunk from its path, symbol and code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TEST_PATH = r"(?i)(test_|_test\.|\.test\.|spec\.)"
CONFIG_PATH = r"(?i)(config|settings|setup|\.env|\.toml|\.yaml|\.yml|\.ini|Dockerfile)"
GENERATED_PATH = r"(?i)(generated|auto.?gen|\.pb\.go|\.pb\.py)"
TEST_SYMBOL = r"^(test_|Test[A-Z])"
TEST_CODE = ("@pytest.mark", "unittest.TestCase", "describe(", "it(", "expect(")


def is_test(path: Column, symbol: Column, code: Column) -> Column:
    marked = F.coalesce(symbol, F.lit("")).rlike(TEST_SYMBOL)
    for mark in TEST_CODE:
        marked = marked | F.coalesce(code, F.lit("")).contains(mark)
    return F.coalesce(path, F.lit("")).rlike(TEST_PATH) | marked


def tags(path: Column, symbol: Column, code: Column, language: Column, chunk_type: Column, repo: Column) -> Column:
    p = F.coalesce(path, F.lit(""))
    return F.struct(
        is_test(path, symbol, code).alias("is_test"),
        p.rlike(CONFIG_PATH).alias("is_config"),
        p.rlike(GENERATED_PATH).alias("is_generated"),
        language.alias("language"),
        F.coalesce(chunk_type, F.lit("block")).alias("chunk_type"),
        repo.alias("repo_name"),
    )
