"""Query analysis and cleaning on a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.text import strip

# Triggers of the query types, in the order they are tried.
HOW = (r"\bhow\s+(does|do|is|to|can|should)\b", r"\bexplain\b", r"\bwhat\s+is\b", r"\bunderstand\b")
WHERE = (r"\bwhere\s+is\b", r"\bfind\s+(function|class|method|file)\b", r"\blocate\b", r"\bshow\s+me\b")
BUG = (r"\b(fix|error|exception|traceback|bug|crash|fail)\b", r"\bsegfault\b|\bsegmentation fault\b")
BUG_NAMES = r"\bAttributeError\b|\bTypeError\b|\bValueError\b"
STATEMENT_MARKS = ("input format", "output format", "sample input", "sample output", "constraints", "examples:", "example:", "note:")

# Contractions and what they stand for.
CONTRACTIONS = {
    "won't": "will not", "can't": "cannot", "don't": "do not", "doesn't": "does not", "isn't": "is not", "wasn't": "was not",
    "weren't": "were not", "haven't": "have not", "hasn't": "has not", "hadn't": "had not", "wouldn't": "would not",
    "shouldn't": "should not", "couldn't": "could not", "mustn't": "must not", "i'm": "i am", "i've": "i have", "i'll": "i will",
    "i'd": "i would", "it's": "it is", "that's": "that is", "there's": "there is", "they're": "they are", "we're": "we are",
    "we've": "we have", "you're": "you are", "you've": "you have", "let's": "let us",
}

# Search words and the words they bring along.
SYNONYMS = {
    "sort": ["order", "arrange", "rank"],
    "parse": ["tokenize", "lex", "decode", "deserialize"],
    "serialize": ["encode", "marshal", "dump"],
    "http": ["request", "response", "rest", "api"],
    "async": ["asynchronous", "await", "coroutine", "concurrent"],
    "error": ["exception", "failure", "bug", "crash"],
    "config": ["configuration", "settings", "options"],
    "db": ["database", "sql", "query", "store"],
    "auth": ["authentication", "authorization", "login", "token"],
}

# Padding of questions, and words dropped from them.
FILLER = (
    r"\b(where\s+is|where\s+are|how\s+does|how\s+do|how\s+are|how\s+is|what\s+is|what\s+are|show\s+me|find|locate|explain|"
    r"implemented\s+in\s+the\s+codebase|in\s+the\s+codebase|step[- ]by[- ]step|in\s+this\s+codebase|in\s+this\s+repository|"
    r"the\s+primary\s+role\s+of|defined\s+for|handled\s+in)\b"
)
STOP = ("the", "a", "an", "of", "and", "or", "to", "for", "with", "this", "that", "in", "on", "at", "is", "are", "does", "do", "work", "works")


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))


def _has_mark(text: Column) -> Column:
    return F.lower(text).rlike("|".join(STATEMENT_MARKS))


def category(query: Column) -> Column:
    """The type of a query: the first rule that holds decides."""
    q = strip(query)
    return (
        F.when((F.length(q) > 200) & _has_mark(q), "problem_stmt")
        .when(_any(q, HOW), "how_it_works")
        .when(_any(q, WHERE), "where_is")
        .when(_any(q, BUG) | q.rlike("(?U)" + BUG_NAMES), "bug_fix")
        .when(F.length(q) > 150, "problem_stmt")
        .otherwise("general")
    )


def expand_contractions(query: Column) -> Column:
    spelt = query
    for short, long in CONTRACTIONS.items():
        spelt = F.regexp_replace(spelt, rf"(?iU)\b{short}\b", long)
    return F.when(query.contains("'"), spelt).otherwise(query)  # every one has an apostrophe


def expand_keywords(query: Column) -> Column:
    """Appends the companions of every search word that occurs anywhere, inside words too."""
    low = F.lower(query)
    return F.concat_ws(" ", query, *[F.when(low.contains(k), " ".join(v)) for k, v in SYNONYMS.items()])


def strip_statement_boilerplate(text: Column) -> Column:
    """The task of a contest statement without formats, samples and numbers.

    A fold over paragraphs: marked ones go, numeric ones go once a marked one
    was seen, and after that the second paragraph kept is the last.
    """
    # Fixed value: paragraphs of nothing but numbers.
    numeric = r"^[\d\s,\[\]\(\)\{\}\.\-\+\*\/\n]+\z"
    state = F.aggregate(
        F.split(strip(text), r"\n{2,}"),
        F.struct(F.array().cast("array<string>").alias("got"), F.lit(False).alias("seen"), F.lit(False).alias("over")),
        lambda s, p: F.when(s["over"], s)
        .when(_has_mark(p) | (s["seen"] & strip(p).rlike(numeric)), F.struct(s["got"].alias("got"), F.lit(True).alias("seen"), s["over"].alias("over")))
        .otherwise(F.struct(F.concat(s["got"], F.array(p)).alias("got"), s["seen"].alias("seen"), (s["seen"] & (F.size(s["got"]) >= 1)).alias("over"))),
    )
    out = F.regexp_replace(F.array_join(state["got"], "\n\n"), " {2,}", " ")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def search_terms(query: Column) -> Column:
    """Keywords of a question, then the paths in backticks with their stems."""
    paths = F.regexp_extract_all(query, F.lit("`([^`]+)`"), F.lit(1))
    name = lambda p: F.regexp_extract(p, r"([^/]*)/*\z", 1)
    stem = lambda p: F.when(p.rlike(r"[/\\.]"), F.regexp_replace(name(p), r"(?<=.)\.[^.]*\z", "")).otherwise(p)
    # A path is always added, its stem only if not there yet.
    named = F.aggregate(
        paths,
        F.array().cast("array<string>"),
        lambda got, p: F.when((stem(p) != "") & ~F.array_contains(F.concat(got, F.array(p)), stem(p)), F.concat(got, F.array(p, stem(p)))).otherwise(F.concat(got, F.array(p))),
    )
    text = F.regexp_replace(query, "`[^`]+`", " ")
    text = F.regexp_replace(text, "(?iU)" + FILLER, " ")
    text = F.regexp_replace(F.regexp_replace(text, "[?!]+", " "), r"(?U)[^\w\s./\\_+-]", " ")
    words = F.filter(F.split(strip(F.regexp_replace(text, r"(?U)\s+", " ")), " "), lambda t: (F.length(t) > 1) & ~F.lower(t).isin(*STOP))
    joined = strip(F.array_join(F.concat(words, named), " "))
    return F.when(joined != "", joined).otherwise(strip(query))


def _once(rows: DataFrame, **made: Column) -> DataFrame:
    """``rows`` with further columns that Catalyst doesn't copy into the expressions that use them."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def clean_queries(queries: DataFrame, text_col: str = "text", expand: bool = False) -> DataFrame:
    """``queries`` with query_type, cleaned (what the retrievers get) and was_cleaned.

    Each step reads the columns of the one before, so every pattern runs once a row at most.
    """
    rows = _once(queries, _q=strip(F.col(text_col)))
    rows = _once(rows, query_type=category(F.col("_q")), _spelt=expand_contractions(F.col("_q")))
    kind = F.col("query_type")
    rows = _once(rows, _task=F.when(kind == "problem_stmt", strip_statement_boilerplate(F.col("_spelt"))).otherwise(F.col("_spelt")))
    task = F.col("_task")
    rows = _once(rows, _wordy=kind.isin("where_is", "how_it_works", "general") & (task.contains("`") | task.rlike("(?iU)" + FILLER)))
    rows = _once(rows, _text=F.when(F.col("_wordy"), search_terms(task)).otherwise(task))
    # The characters that stay.
    text = F.regexp_replace("_text", r"[^\x09\x0A\x0D\x20-\x7E\u00A0-\uFFFF]", " ")
    rows = _once(rows, _clean=strip(F.regexp_replace(F.regexp_replace(text, " {2,}", " "), r"\n{3,}", "\n\n")))
    rows = rows.withColumn("cleaned", expand_keywords(F.col("_clean")) if expand else F.col("_clean")).withColumn("was_cleaned", F.col("cleaned") != F.col("_q"))
    return rows.drop("_q", "_spelt", "_task", "_wordy", "_text", "_clean")


def matched_terms(query: Column, content: Column, stop: tuple[str, ...] = STOP, most: int = 5) -> Column:
    """Up to ``most`` distinct words of the query, over two characters, that the content holds."""
    terms = F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9_]+"), F.lit(0)))
    low = F.lower(content)
    return F.slice(F.filter(terms, lambda t: (F.length(t) > 2) & ~t.isin(*stop) & low.contains(t)), 1, most)


def match_percent(dense: Column, fused: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(dense, fused, F.lit(0.0)) * 100))


def related_files(code: Column, file_path: Column, most: int = 3) -> Column:
    """Paths named by import lines, other than the file's own."""
    found = F.regexp_extract_all(code, F.lit(r"""(?:from\s+|import\s+)["']?([\w./-]+)["']?"""), F.lit(1))
    wanted = F.filter(found, lambda p: (p.contains("/") | p.endswith(".py")) & ~p.startswith(".") & (p != file_path))
    return F.slice(F.array_distinct(wanted), 1, most)
