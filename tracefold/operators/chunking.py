"""Files to chunks: functions and classes where code can be read, windows of lines elsewhere."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions import ids, tagging
from tracefold.functions.text import LINE_BREAK, strip

# Languages by file extension.
LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java",
    "rs": "rust", "c": "c", "cpp": "cpp", "cc": "cpp", "rb": "ruby", "php": "php", "ipynb": "python", "md": "markdown",
    "markdown": "markdown", "txt": "text", "rst": "text", "sh": "bash", "bash": "bash", "yaml": "yaml", "yml": "yaml",
    "toml": "toml", "sql": "sql", "r": "r",
}
#: Languages that are always cut into windows of lines.
PROSE = ("markdown", "text", "bash", "yaml", "toml", "sql", "r", "unknown")
BRACES = ("javascript", "typescript", "go", "java", "rust", "c", "cpp", "php")
MOST_LINES, LEAST_LINES = 1024, 3


def language_of(path: Column) -> Column:
    """The language of a path's last extension, ``unknown`` for others."""
    ext = F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)\z", 1))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, ext), F.lit("unknown"))


def notebook_source(source: Column) -> Column:
    """Code cells, and text cells as comments, of a notebook; other sources unchanged."""
    cells = F.from_json(source, "cells array<struct<cell_type string, source string>>")["cells"]
    body = lambda c: F.coalesce(F.array_join(F.from_json(c["source"], "array<string>"), ""), c["source"], F.lit(""))
    commented = lambda t: F.array_join(F.transform(F.split(F.regexp_replace(t, f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK), lambda x: F.concat(F.lit("# "), x)), "\n")
    parts = F.transform(
        cells,
        lambda c, k: F.when(strip(body(c)) == "", F.lit(None))
        .when(c["cell_type"] == "code", F.concat(F.lit("# --- Cell "), (k + 1).cast("string"), F.lit(" ---\n"), body(c)))
        .when(c["cell_type"].isin("markdown", "raw"), F.concat(F.lit("# --- Markdown Cell "), (k + 1).cast("string"), F.lit(" ---\n"), commented(body(c)))),
    )
    joined = F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n\n")
    return F.when(joined != "", joined).otherwise(source)


def line_windows(files: DataFrame, size: int = 50, overlap: int = 5) -> DataFrame:
    """One row per window: start_line, end_line, code; the other columns stay.

    Windows start every ``size - overlap`` lines until one reaches the end.  An
    empty file has one window that ends at line 0.
    """
    step = size - overlap
    text = F.coalesce("source", F.lit(""))
    rows = F.split(F.regexp_replace(text, f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK)
    others = [c for c in files.columns if c != "source"]
    # The lines are made once a file, and the windows are cut before they become rows: no row carries all lines.
    cut = files.select(*others, F.inline(F.array(F.struct(rows.alias("_lines"), (text == "").alias("_empty")))))
    n = F.when(F.col("_empty"), 0).otherwise(F.size("_lines"))
    # The window at s is the last once s + size >= n.
    last = F.ceil(F.greatest(n - size, F.lit(0)) / step).cast("int")
    window = lambda k: F.struct((k * step + 1).cast("int").alias("start_line"), F.least(k * step + size, n).cast("int").alias("end_line"), F.array_join(F.slice("_lines", (k * step + 1).cast("int"), F.lit(size)), "\n").alias("code"))
    return cut.select(*others, F.inline(F.transform(F.sequence(F.lit(0), last), window)))


def _python(source: str) -> Iterator[tuple[str, str, int, int, str, str]]:
    """symbol, kind, first and last line, code and docstring of definitions, outer ones first."""
    rows = source.splitlines()

    def walk(node: ast.AST) -> Iterator[tuple]:
        for child in ast.iter_child_nodes(node):
            kind = "class" if isinstance(child, ast.ClassDef) else "function" if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)) else None
            if kind and child.end_lineno - child.lineno + 1 >= LEAST_LINES:
                own = rows[child.lineno - 1 : child.end_lineno]
                own[0] = own[0].encode()[child.col_offset :].decode(errors="replace")
                first = child.body[0]
                text = first.value.value if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str) else ""
                yield child.name, kind, child.lineno, child.end_lineno, "\n".join(own), text.strip()
            yield from walk(child)

    yield from walk(ast.parse(source))


_HEADS = {
    "class": re.compile(r"^\s*(?:(?:export|default|public|private|protected|abstract|final|static|pub(?:\([^)]*\))?)\s+)*(?:class|interface|impl(?:<[^>]*>)?|struct|trait)\s+(\w+)"),
    "function": re.compile(
        r"^\s*(?:(?:export|default|public|private|protected|static|final|async|abstract|pub(?:\([^)]*\))?|unsafe|inline|extern|const)\s+)*"
        r"(?:(?:function\s*\*?|func(?:\s*\([^)]*\))?|fn|def)\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|\w+\s*=>)|(?:[\w:<>,*&\[\]]+\s+)+[*&]?(\w+)\s*\([^;{}]*\)\s*(?:throws\s+[\w, .]+|const|noexcept)?\s*\{?\s*$|[*#]?(\w+)\s*\([^;{}]*\)\s*(?::\s*[^={;]+)?\{\s*$)"
    ),
}
_NOT_NAMES = frozenset("if for while switch return else catch new throw do try case sizeof".split())
_LITERAL = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)


def _braced(source: str) -> Iterator[tuple[str, str, int, int, str, str]]:
    """Definitions by their heads and balanced braces; strings and comments are blanked first."""
    rows = source.splitlines()
    bare = _LITERAL.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source).splitlines()
    for k, row in enumerate(bare):
        for kind, head in _HEADS.items():
            m = head.match(row)
            name = next((g for g in m.groups() if g), "") if m else ""
            if not m or name in _NOT_NAMES:
                continue
            depth, opened, end = 0, False, None
            for j in range(k, len(bare)):
                for ch in bare[j]:
                    if ch == "{":
                        depth, opened = depth + 1, True
                    elif ch == "}":
                        depth -= 1
                if opened and depth <= 0:
                    end = j
                    break
                if not opened and (";" in bare[j] or j > k + 8):
                    break
            if end is not None and end - k + 1 >= LEAST_LINES:
                yield name, kind, k + 1, end + 1, "\n".join(rows[k : end + 1]).strip(), ""
            break


def _ruby(source: str) -> Iterator[tuple[str, str, int, int, str, str]]:
    rows = source.splitlines()
    for k, row in enumerate(rows):
        m = re.match(r"^(\s*)(class|def)\s+(?:self\.)?([\w:?!=]+)", row)
        if not m:
            continue
        end = next((j for j in range(k + 1, len(rows)) if re.match(rf"^{m[1]}end\b", rows[j])), None)
        if end is not None and end - k + 1 >= LEAST_LINES:
            yield m[3], "class" if m[2] == "class" else "function", k + 1, end + 1, "\n".join(rows[k : end + 1]).strip(), ""


def definitions(source: str, language: str) -> list[tuple[str, str, int, int, str, str]]:
    """The definitions of a source, or none if it can't be read."""
    try:
        found = list(_python(source) if language == "python" else _ruby(source) if language == "ruby" else _braced(source) if language in BRACES else ())
    except (SyntaxError, ValueError, RecursionError):
        return []
    return [(n, kind, a, b, "\n".join(code.splitlines()[:MOST_LINES]) if b - a >= MOST_LINES else code, doc) for n, kind, a, b, code, doc in found]


_DEFINITIONS = "array<struct<symbol_name string, chunk_type string, start_line int, end_line int, code string, docstring string>>"


def _definitions(source: Column, language: Column) -> Column:
    @F.pandas_udf(_DEFINITIONS)
    def run(source: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([definitions(s or "", x or "") for s, x in zip(source, language, strict=True)])

    return run(source, language)


def signature(code: Column) -> Column:
    """The first line with text, without margins, up to 200 characters."""
    return F.substring(strip(F.regexp_extract(code, r"(?U)\A\s*([^\n\r]*)", 1)), 1, 200)


def chunk_files(files: DataFrame, language: Column | None = None, size: int = 50, overlap: int = 5) -> DataFrame:
    """Chunks of ``files`` (repo_name, file_path, source), with ids and tags.

    Files that no definition was found in are cut into windows of lines.  The
    parser runs only over files of languages it can read.
    """
    typed = files.select("repo_name", "file_path", F.coalesce("source", F.lit("")).alias("source"), (language_of(F.col("file_path")) if language is None else language).alias("language"))
    is_notebook = F.col("file_path").endswith(".ipynb")
    typed = typed.withColumn("source", F.when(is_notebook, notebook_source(F.col("source"))).otherwise(F.col("source")))
    prose = typed.filter(F.col("language").isin(*PROSE))
    read = typed.filter(~F.col("language").isin(*PROSE)).withColumn("_found", _definitions(F.col("source"), F.col("language")))
    parsed = read.filter(F.size("_found") > 0).select("repo_name", "file_path", "language", F.explode("_found").alias("d")).select("repo_name", "file_path", "language", "d.*")
    rest = read.filter(F.size("_found") == 0).drop("_found")
    windows = line_windows(prose.unionByName(rest), size, overlap).withColumns({"symbol_name": F.concat(F.lit("block_"), F.col("start_line").cast("string")), "chunk_type": F.lit("block"), "docstring": F.lit("")})
    return with_identity(parsed.unionByName(windows))


def with_identity(chunks: DataFrame) -> DataFrame:
    """Adds signature, ids and tags to chunks."""
    c = F.col
    return chunks.select(
        "repo_name", "file_path", "symbol_name", signature(c("code")).alias("signature"), "docstring", "language", "chunk_type", "start_line", "end_line", "code",
        ids.chunk_id(c("file_path"), c("symbol_name"), c("start_line")).alias("chunk_id"),
        ids.lineage_id(c("file_path"), c("symbol_name")).alias("lineage_id"),
        ids.content_hash(c("code")).alias("content_hash"),
        tagging.tags(c("file_path"), c("symbol_name"), c("code"), c("language"), c("chunk_type"), c("repo_name")).alias("tags"),
    )
