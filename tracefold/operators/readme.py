"""What a README says of its repository: title, summary, features, modules, questions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = (
    "struct<has_readme boolean, title string, summary string, features array<string>, key_modules array<string>, "
    "suggested_questions array<string>, categories map<string,array<string>>>"
)
NAMES = ("README.md", "readme.md", "README.markdown", "readme.markdown", "README.rst", "readme.rst", "README.txt", "readme.txt", "README", "readme")
EXTENSIONS = {"md": 0, "markdown": 1, "rst": 2, "txt": 3}

# Words of a file name, and the question its module leads to (kind, question).
MODULE_QUESTIONS = (
    (("main", "app"), "architecture", "Where is the main application setup defined in `{}`?"),
    (("auth", "jwt", "security"), "logic", "How is authentication and security handled in `{}`?"),
    (("pay", "checkout", "cart"), "logic", "How does transaction processing work in `{}`?"),
    (("fhir", "patient", "record"), "logic", "How are patient health records validated in `{}`?"),
    (("api", "route", "controller"), "architecture", "Where are API endpoints registered in `{}`?"),
    ((), "architecture", "What is the primary role of `{}` in this codebase?"),
)
# Words of the content (any of them; all of those in a tuple) and the questions they lead to.
CONTENT_QUESTIONS = (
    (("android", "sensor", "biometric"), "architecture", "Where are background sensor services initialized in {}?"),
    (("android", "sensor", "biometric"), "logic", "How does the policy engine evaluate real-time device context?"),
    (("openclaw", "agent"), "feature", "Where is AI agent orchestration and decision-making configured?"),
    (("calendar",), "feature", "How does calendar intelligence schedule focus and automate device modes?"),
    (("stripe", "payment"), "logic", "Where is payment gateway integration and signature verification handled?"),
    (("inventory", "cart"), "logic", "How does the cart manage inventory reservations and discount pricing?"),
    (("oauth", "pkce"), "feature", "How does the OAuth2 PKCE authorization code exchange work?"),
    (("jwt", "token"), "logic", "Where is JWT token issuance and cryptographic verification configured?"),
    (("argon2", "password"), "logic", "Where is password hashing and credential validation defined?"),
    (("fhir", "hl7"), "logic", "How are FHIR clinical patient records ingested and validated?"),
    (("hipaa", "phi"), "config", "Where is HIPAA compliant field-level data encryption enforced?"),
    (("bm25",), "logic", "How does BM25 keyword matching compute scores?"),
    (("tree-sitter", "ast chunk"), "logic", "How does Tree-Sitter AST chunking parse code?"),
    ((("embedding", "vector"),), "logic", "Where are dense vector embeddings generated?"),
)
# Categories of questions with their words and how many they show.
CATEGORIES = (
    ("Architecture & Structure", ("where", "structure", "setup", "layout", "module", "api", "entry", "service"), 4),
    ("Features & Capabilities", ("how", "feature", "calendar", "sensor", "payment", "token", "patient", "checkout", "cart", "agent", "mode"), 4),
    ("Algorithms & Logic", ("step", "calculate", "flow", "verify", "encrypt", "validate", "rate", "decision", "score", "lock"), 4),
    ("Configuration & Setup", ("config", "env", "setting", "build", "secret", "permission", "depend"), 3),
)

# What counts as a module name, and what is no prose.
_MODULE = re.compile(r"`([a-zA-Z0-9_\-/]+\.(?:py|tsx|ts|jsx|js|json|rs|go|html|css|yaml|yml|kt|java))`")
_NO_PROSE = re.compile(r"[#\-`>$]|\*\s|!\[|<(?:img|a|div|p)|\[[^\]]+\]:\s*https?://|https?://|\[[^\]]+\]\(https?://[^)]+\)$", re.I)
_IMAGE = re.compile(r"!\[[^]]*\]\(")


def plain(text: str) -> str:
    """Inline marks dropped; the same as ``clean_markdown_inline`` on columns."""
    text = re.sub(r"[*`_#]", "", re.sub(r"\[([^\]]+)\]\([^)]+\)", r"\1", text))
    return re.sub(r"^[\s*\->\d.]+", "", text).strip()


class _Ordered(list):
    """Distinct values in order, up to a number."""

    def __init__(self, most: int | None = None):
        super().__init__()
        self.most = most

    def put(self, value: str) -> None:
        if value and value not in self and (self.most is None or len(self) < self.most):
            self.append(value)


def _title(rows: list[str]) -> str:
    for row in rows:
        if row.startswith("#"):
            found = re.sub(r"^[^\w\s]+", "", plain(row)).strip()
            if len(found) > 3:
                return found
    return ""


def _summary(rows: list[str]) -> str:
    fenced = False
    for row in rows:
        if row.startswith("```"):
            fenced = not fenced
        elif not fenced and len(row) > 20 and not _NO_PROSE.match(row) and not (row.count("|") >= 2 and _IMAGE.search(row)):
            found = re.sub(r"\s+", " ", re.sub(r"!\[[^]]*\]\([^)]+\)", "", plain(row)).strip())
            if len(found) > 20:
                return found
    return ""


def _questions(rows: list[str]) -> _Ordered:
    out, inside = _Ordered(), False
    for row in rows:
        # Words of headings that open a list of questions, and lengths of questions.
        if re.match(r"#{1,3}\s+.*(?:question|faq|common\s+codebase)", row, re.I):
            inside = True
            continue
        inside = inside and not row.startswith("#")
        text = plain(row)
        if inside and len(text) > 8:
            out.put(text if text.endswith("?") else text + "?")
        elif not inside and text.endswith("?") and 15 < len(text) < 140:
            out.put(text)
    return out


def _features(rows: list[str]) -> _Ordered:
    out, inside = _Ordered(8), False
    for row in rows:
        # Words of headings that open a list of features, and the marks of features.
        if re.match(r"#{1,3}\s+.*(?:feature|highlight|capabilit|overview)", row, re.I):
            inside = True
            continue
        if row.startswith("#") and not row.startswith("###"):
            inside = False
        bold = re.match(r"[\s*\->]+\s+\*\*([^*]+)\*\*[:\s]*(.*)$", row)
        if bold:
            out.put(": ".join(x for x in map(plain, bold.groups()) if x) if plain(bold[2]) else plain(bold[1]))
        elif re.match(r"#{2,4}\s+\*\*[^*]+\*\*$", row):
            out.put(plain(row))
        elif inside and row[:1] in ("-", "*") and len(plain(row)) > 10:
            out.put(plain(row))
    return out


def analyse(content: str | None, repo: str) -> dict:
    """The record of one README; a fallback without content."""
    # The sentences below and their order.
    if not content:
        entry, model, conf = f"Where is the main entry point defined in {repo}?", "Where are the core data models and helper functions located?", "How are configuration settings and dependencies managed?"
        return {
            "has_readme": False, "title": f"{repo} Codebase", "features": [], "key_modules": [],
            "summary": f"No README file found for {repo}. Connect or index this repository to explore code symbols.",
            "suggested_questions": [entry, "How is error handling and logging structured?", model, conf],
            "categories": {"Architecture": [entry], "Logic & Models": [model], "Configuration": [conf]},
        }
    rows = [x.strip() for x in re.sub(r"<!--.*?-->", "", content, flags=re.S).splitlines()]
    title = _title(rows) or f"{repo} Architecture"
    features, modules, low = _features(rows), _Ordered(10), content.lower()
    for row in rows:
        for name in _MODULE.findall(row):
            modules.put(name)
    asked: dict[str, list[str]] = {"feature": [], "architecture": [], "logic": [], "config": []}
    for item in features:
        name = re.sub(r"^[\d.\-\s]+", "", item.split(":")[0].strip()).strip()
        if len(name) > 3:
            asked["feature"].append(f"Where is {name} implemented in the codebase?")
            asked["logic"].append(f"How does {name} work step-by-step?")
    for module in modules[:5]:
        base = module.rsplit("/", 1)[-1].lower()
        kind, question = next((k, q) for words, k, q in MODULE_QUESTIONS if not words or any(w in base for w in words))
        asked[kind].append(question.format(module))
    for words, kind, question in CONTENT_QUESTIONS:
        if any(all(part in low for part in ((w,) if isinstance(w, str) else w)) for w in words):
            asked[kind].append(question.format(repo))
    asked["config"] += [f"How are environment variables and system settings configured in {repo}?", "Where are project dependencies and build scripts defined?"]
    fallback = [
        f"Where is the main entry point and service layout defined for {title}?", f"How does {title} handle request processing and error recovery?",
        f"Where are core data models and business logic located in `{repo}`?", f"How are configuration settings and secrets managed in {repo}?",
    ]
    shown = _Ordered(8)
    for question in [*_questions(rows), *asked["feature"], *asked["architecture"], *asked["logic"], *asked["config"], *fallback]:
        shown.put(question.strip())
    by = {name: [q for q in shown if any(w in q.lower() for w in words)][:most] for name, words, most in CATEGORIES}
    by["Configuration & Setup"] = by["Configuration & Setup"] or [f"How are configuration settings managed in {repo}?"]
    return {
        "has_readme": True, "title": title, "summary": _summary(rows) or f"{title} repository documentation and codebase architecture overview.",
        "features": features[:6], "key_modules": modules[:8], "suggested_questions": list(shown), "categories": by,
    }


def analyse_readmes(readmes: DataFrame, content: str = "content", repo: str = "repo_name") -> DataFrame:
    """``readmes`` with the fields of ``RECORD``."""

    @F.pandas_udf(RECORD)
    def run(content: pd.Series, repo: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([analyse(c, r or "Repository") for c, r in zip(content, repo, strict=True)])

    return readmes.withColumn("_r", run(content, repo)).select(*readmes.columns, "_r.*")


def find_readmes(files: DataFrame) -> DataFrame:
    """The README of each repository among ``files`` (repo_name, file_path, ...).

    At the root a usual name is best, then any name that begins with ``readme``
    by extension, then usual names in ``docs`` and ``documentation``.
    """
    folder = F.regexp_extract("file_path", r"^(.*?)/?[^/]*\z", 1)
    name = F.regexp_extract("file_path", r"([^/]*)\z", 1)
    usual = F.array_position(F.array(*[F.lit(n) for n in NAMES]), name)
    ext = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in EXTENSIONS.items() for x in p]), F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1))), F.lit(4))
    group: Column = F.when((folder == "") & (usual > 0), 0).when((folder == "") & F.lower(name).startswith("readme"), 1).when((folder == "docs") & (usual > 0), 2).when((folder == "documentation") & (usual > 0), 3)
    best = F.struct(group.alias("g"), F.when(group == 1, ext).otherwise(usual).alias("o"), F.lower(name).alias("n"))
    ranked = files.withColumn("_best", best).filter(F.col("_best.g").isNotNull())
    return ranked.groupBy("repo_name").agg(F.min_by(F.struct(*files.columns), "_best").alias("f")).select("f.*")


def title_and_summary(content: Column) -> tuple[Column, Column]:
    """Native versions of the first heading of over three characters and the first line of prose (code fences not tracked)."""
    from tracefold.functions.text import clean_markdown_inline, lines, strip

    rows = F.transform(lines(F.regexp_replace(content, r"(?s)<!--.*?-->", "")), strip)
    heads = F.transform(F.filter(rows, lambda r: r.startswith("#")), lambda r: strip(F.regexp_replace(clean_markdown_inline(r), r"^(?U:[^\w\s])+", "")))
    prose = F.filter(rows, lambda r: (F.length(r) > 20) & ~r.rlike(r"^(?:[#\-`>$]|\*\s|!\[|(?i:<(?:img|a|div|p)|\[[^\]]+\]:\s*https?://|https?://))"))
    first = lambda a: F.get(a, F.lit(0))
    return first(F.filter(heads, lambda h: F.length(h) > 3)), first(F.filter(F.transform(prose, clean_markdown_inline), lambda p: F.length(p) > 20))
