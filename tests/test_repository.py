"""Chunking, versions, snapshots, README analysis, jobs and the service."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from tracefold.operators import chunking, readme, versions
from tracefold.plans.explain import explanation
from tracefold.plans.service import Engine, ResultCache, SearchOptions
from tracefold.sources import git
from tracefold.sources.files import scan_repository
from tracefold.streaming import jobs

FILES = "repo_name string, file_path string, source string"


@pytest.mark.parametrize(
    "n,want",
    [(0, [(1, 0)]), (1, [(1, 1)]), (45, [(1, 45)]), (50, [(1, 50)]), (51, [(1, 50), (46, 51)]), (95, [(1, 50), (46, 95)]), (96, [(1, 50), (46, 95), (91, 96)]), (101, [(1, 50), (46, 95), (91, 101)])],
)
def test_line_windows(spark, n, want):
    for end in ("", "\n") if n else ("",):
        rows = spark.createDataFrame([("r", "a.txt", "\n".join(f"l{k}" for k in range(1, n + 1)) + end)], FILES)
        got = chunking.line_windows(rows).orderBy("start_line").collect()
        assert [(r.start_line, r.end_line) for r in got] == want
        assert all(r.code == "\n".join(f"l{k}" for k in range(r.start_line, r.end_line + 1)) for r in got)


PYTHON = '''import os

class Cart:
    """Holds items."""

    def total(self, x):
        """Adds up.
        Twice."""
        return x

def tiny(): return 1

async def load(
    a):
    return a
'''
SCRIPT = """export class Box {
  size() {
    // } not a brace
    return "}";
  }
}
const run = async (x) => {
  return x;
};
function tiny() { return 1; }
"""


def test_definitions(spark):
    rows = [("r", "cart.py", PYTHON), ("r", "box.ts", SCRIPT), ("r", "bad.py", "def (:\n"), ("r", "x.go", "func (s *T) Do(a int) int {\n  return a\n}\n"), ("r", "Makefile", "all:\n"), ("r", "m.rb", "class A\n  def b\n    1\n  end\nend\n"), ("r", "empty.py", None)]
    got = chunking.chunk_files(spark.createDataFrame(rows, FILES)).orderBy("file_path", "start_line").collect()
    by = {}
    for r in got:
        by.setdefault(r.file_path, []).append((r.symbol_name, r.chunk_type, r.start_line, r.end_line))
    assert by["cart.py"] == [("Cart", "class", 3, 9), ("total", "function", 6, 9), ("load", "function", 13, 15)]
    assert by["box.ts"] == [("Box", "class", 1, 6), ("size", "function", 2, 5), ("run", "function", 7, 9)]
    assert by["bad.py"] == [("block_1", "block", 1, 1)] and by["x.go"] == [("Do", "function", 1, 3)] and by["Makefile"] == [("block_1", "block", 1, 1)]
    assert by["m.rb"] == [("A", "class", 1, 5), ("b", "function", 2, 4)] and by["empty.py"] == [("block_1", "block", 1, 0)]
    total = next(r for r in got if r.symbol_name == "total")
    assert total.docstring.startswith("Adds up.") and total.signature == "def total(self, x):" and total.code.startswith("def total")
    assert {r.language for r in got if r.file_path == "Makefile"} == {"unknown"}


def test_notebook(spark):
    cells = [{"cell_type": "code", "source": ["a = 1\n", "b = 2"]}, {"cell_type": "code", "source": "  "}, {"cell_type": "markdown", "source": "Title\ntext"}]
    rows = spark.createDataFrame([(json.dumps({"cells": cells}),), ("{bad",), ('{"cells": []}',)], "s string")
    got = [r[0] for r in rows.select(chunking.notebook_source(F.col("s"))).collect()]
    assert got == ["# --- Cell 1 ---\na = 1\nb = 2\n\n# --- Markdown Cell 3 ---\n# Title\n# text", "{bad", '{"cells": []}']


def test_diff_lines():
    got = versions.diff_lines("a\nb\nc", "a\nx\nc\nd")
    assert got == [("context", "a", 1, 1), ("remove", "b", 2, None), ("add", "x", None, 2), ("context", "c", 3, 3), ("add", "d", None, 4)]
    assert versions.diff_lines("a", "a") == []


def test_name_match(spark):
    rows = spark.createDataFrame([("Shop", "C:\\code\\Shop"), ("vault", "/srv/auth-vault"), (None, None)], "repo_name string, repo_path string")
    for wanted, names in (("https://x/o/shop.git/", {"Shop"}), ("auth-vault", {"vault"}), ("code", {"Shop"}), ("nothing", set())):
        found = versions.matching(rows, spark.createDataFrame([(wanted,)], "wanted string")).collect()
        assert {r.repo_name for r in found} == names


README = """<!-- badge: hidden -->
# :rocket: Shop Engine
![logo](x.png)

A small shop that sells **things** to [people](http://x).

## Features
- **Payments**: takes `money`
- short
- a plain feature of this shop
## Modules
`services/payment.py`, `api/main.py`
Where does the total come from exactly?
## Questions to ask
- How is tax computed
"""


def test_readme(spark):
    got = readme.analyse(README, "shop")
    assert got["title"] == ":rocket: Shop Engine".lstrip(":") or "Shop Engine" in got["title"]
    assert got["summary"] == "A small shop that sells things to people."
    assert got["features"] == ["Payments: takes money", "a plain feature of this shop"] and got["key_modules"] == ["services/payment.py", "api/main.py"]
    assert got["suggested_questions"][:3] == ["Where does the total come from exactly?", "How is tax computed?", "Where is Payments implemented in the codebase?"]
    assert len(got["suggested_questions"]) == 8 and set(got["categories"]) == {c[0] for c in readme.CATEGORIES}
    assert readme.analyse("", "x")["has_readme"] is False
    rows = readme.analyse_readmes(spark.createDataFrame([("shop", README), ("none", None)], "repo_name string, content string")).collect()
    assert {r.repo_name: r.has_readme for r in rows} == {"shop": True, "none": False}
    files = spark.createDataFrame([("a", "docs/README.md"), ("a", "readme_x.txt"), ("a", "README_b.md"), ("b", "documentation/README"), ("b", "src/README.md"), ("c", "x.md"), ("d", "README"), ("d", "readme.md")], "repo_name string, file_path string")
    assert {r.repo_name: r.file_path for r in readme.find_readmes(files).collect()} == {"a": "README_b.md", "b": "documentation/README", "d": "readme.md"}


def test_explanation(spark):
    row = spark.range(1).select(explanation(F.lit("app/query.py"), F.lit("run"), F.lit('"Runs it."\nmore'), F.lit("try:\n x\nexcept: y")).alias("e")).first().e
    assert tuple(row) == ("Function/Class: run", "Runs it.", "Core Search Functionality", "Advanced", True)


def test_jobs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, path in enumerate(["good", "bad"]):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"job_id": f"j{k}", "repo_path": path, "force_full": False}))

    def build(_, job):
        if job["repo_path"] == "bad":
            raise ValueError("no such folder")
        return "snap"

    def run():
        jobs.run_jobs(jobs.job_stream(spark, str(tmp_path / "in")), build, str(tmp_path / "events"), str(tmp_path / "ck")).awaitTermination()
        return {r.job_id: r.status for r in jobs.latest_states(spark.read.parquet(str(tmp_path / "events"))).collect()}

    assert run() == {"j0": "done", "j1": "error"}
    n = spark.read.parquet(str(tmp_path / "events")).count()
    (tmp_path / "in" / "9.json").write_text(json.dumps({"job_id": "j9", "repo_path": "late"}))
    assert run() == {"j0": "done", "j1": "error", "j9": "done"} and spark.read.parquet(str(tmp_path / "events")).count() == n + 2
    stuck = spark.createDataFrame([("x", "running", "")], "job_id string, status string, message string")
    assert jobs.after_restart(stuck).first().status == "error"


def test_cache_key_and_age():
    now = [0.0]
    cache = ResultCache(most=2, seconds=10, clock=lambda: now[0])
    a, b = (cache.key("q", ["s"], SearchOptions(language=x)) for x in (None, "python"))
    assert a != b and cache.key("q", ["s", "t"], SearchOptions()) != a
    cache.put(a, [1])
    assert cache.get(a) == [1]
    now[0] = 11
    assert cache.get(a) is None
    with pytest.raises(ValueError):
        SearchOptions(top_k=51)


def test_service(spark, tmp_path):
    repo = tmp_path / "shop"
    (repo / "services").mkdir(parents=True)
    (repo / "node_modules").mkdir()
    (repo / "node_modules" / "x.py").write_text("hidden = 1\n")
    (repo / "services" / "cart.py").write_text("def calculate_total(items):\n    # sums prices\n    total = sum(items)\n    return total\n")
    (repo / "services" / "auth.py").write_text("def check_password(user):\n    # verifies the login\n    return user.password\n\n\ndef log_out(user):\n    user.token = None\n    return user\n")
    (repo / "raw.md").write_bytes(b"# Shop\n\xff broken byte\n")
    listed = {r.file_path: r for r in scan_repository(spark, str(repo)).collect()}
    assert set(listed) == {"services/cart.py", "services/auth.py", "raw.md"} and "\ufffd" in listed["raw.md"].source
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=repo, check=True, capture_output=True)
    run("init", "-q")
    run("add", "services", "raw.md")
    run("commit", "-qm", "first state")
    assert git.commit_subject(str(repo)) == "first state" and git.head_commit(str(repo / "services")).startswith("local-")

    engine = Engine(spark, str(tmp_path / "store"))
    assert engine.search("anything") == []
    one = engine.index_repository(str(repo))
    assert engine.index_repository(str(repo)) == one and engine.versions().count() == 1
    top = engine.search("calculate total of the cart")
    assert top[0].symbol_name == "calculate_total" and top[0].matched_terms
    assert engine.search("calculate total of the cart") == top
    assert {r.language for r in engine.search("shop", SearchOptions(language="MARKDOWN"))} == {"markdown"}
    assert engine.search("password", SearchOptions(repo="nowhere-else")) == []

    (repo / "services" / "cart.py").write_text("def calculate_total(items):\n    # sums prices\n    total = sum(items) + 1\n    return total\n")
    (repo / "raw.md").unlink()
    run("add", "-A", "services", "raw.md")
    run("commit", "-qm", "second state")
    two = engine.index_repository(str(repo))
    assert two != one and git.changed_files(str(repo), "HEAD~1", "HEAD") == ["raw.md", "services/cart.py"]
    kept = engine.store.read("chunks", [two])
    assert {r.file_path for r in kept.collect()} == {"services/cart.py", "services/auth.py"}
    full = Engine(spark, str(tmp_path / "full"))
    same = full.store.read("chunks", [full.index_repository(str(repo), mode="full")])
    assert sorted(map(str, kept.drop("snapshot_id").collect())) == sorted(map(str, same.drop("snapshot_id").collect()))
    manifest = engine.store.manifests().filter(F.col("snapshot_id") == two).first()
    assert manifest.n_embedded == 1 and manifest.n_cached == 2 and manifest.commit_message == "second state"
    lineage = kept.filter("symbol_name = 'calculate_total'").first().lineage_id
    assert [r.version for r in engine.history(lineage).orderBy("version").collect()] == [1, 2]
    diff = engine.diffs(lineage).collect()
    assert {(r.type, r.line.strip()) for r in diff if r.type != "context"} == {("remove", "total = sum(items)"), ("add", "total = sum(items) + 1")}
    assert engine.health().first().repositories == 1 and engine.repositories().count() == 1
    old = engine.search("calculate total", SearchOptions(snapshot=one))
    assert {r.snapshot_id for r in old} == {one}
    assert engine.snippet(old[0].id, one).count() == 1
    again = engine.search("log out", SearchOptions(rerank=True, hybrid=False, prefilter=True, language="python"))
    assert again and all(r.language == "python" for r in again)
