"""The driver contract: registered queries agree with their oracle SQL."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"op3_sharding"}


def plain(x):
    return "nan" if x != x else [plain(y) for y in x] if isinstance(x, (list, tuple)) else x


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, sf, tables, name):
    found = entry.queries()[name](spark, sf)
    want = tables.sql(entry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(want.columns)
    by = lambda columns, rows: sorted(str([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in rows)
    assert by(found.columns, map(tuple, found.collect())) == by(want.columns, want.fetchall())


def test_derived_inputs_trigger_the_rules(spark, sf):
    q = entry.queries()
    assert q["strip_boilerplate"](spark, sf).filter("changed").count() > 0
    assert q["clean_queries"](spark, sf).filter("was_cleaned").count() > 0
    assert q["query_category"](spark, sf).select("query_type").distinct().count() >= 4
    assert q["extract_docstring"](spark, sf).filter("docstring <> ''").count() > 0
    assert q["expand_query"](spark, sf).filter("expanded <> spelt_out").count() > 0
    assert q["tag_chunks"](spark, sf).filter("is_test and not is_config").count() > 0


def test_rows_only_queries_run(spark, sf):
    q = entry.queries()
    for name in ("dense_ann_recall", "version_diff_lines", "readme_analysis", "readme_title_summary", "code_chunks", "stream_jobs"):
        assert q[name](spark, sf).count() > 0, name
    assert entry.entry(spark).count() > 0


def test_entry_works_without_the_optional_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert out.stdout.split()[1:] == ["False", "False"], out.stderr
