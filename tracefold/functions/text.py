"""Text functions over columns; all but NFC run inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Java's classes are ASCII by default; (?U) makes \w, \s and \b cover Unicode.
CAMEL = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
STRIP = r"^(?U:\s)+|(?U:\s)+\z"
#: Where a text breaks into lines: LF, CR LF, CR, VT, FF, FS to RS, NEL and the two Unicode separators.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    """Without white space at either end (not just spaces)."""
    return F.regexp_replace(text, STRIP, "")


def tokenise(text: Column) -> Column:
    """Lower-case search tokens of 2 to 60 characters, identifiers split into words."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), CAMEL, " ")
    spaced = F.lower(F.regexp_replace(spaced, r"[_.\-/:\\]", " "))
    return F.filter(F.regexp_extract_all(spaced, F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t).between(2, 60))


def split_identifier(name: Column) -> Column:
    """``parseHTTPResponse`` or ``parse_http_response`` to ``parse http response``."""
    spaced = F.regexp_replace(F.regexp_replace(name, CAMEL, " "), r"(?U)[^a-zA-Z0-9\s]", " ")
    return F.lower(strip(F.regexp_replace(spaced, r"(?U)\s+", " ")))


def split_identifiers_in_text(text: Column) -> Column:
    """Splits the identifiers among the words of a text; white space stays as it is."""
    parts = F.regexp_extract_all(text, F.lit(r"(?U)\s+|\S+"), F.lit(0))
    is_identifier = lambda t: (F.length(t) > 3) & t.rlike("[a-z][A-Z]|_[a-z]")
    return F.array_join(F.transform(parts, lambda t: F.when(is_identifier(t), split_identifier(t)).otherwise(t)), "")


def lines(text: Column) -> Column:
    """The lines of a text; a break at the very end opens no further line."""
    return F.split(F.regexp_replace(text, f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK)


def extract_docstring(code: Column) -> Column:
    """The first docstring or block comment, else the line comments at the top; empty if none."""
    found = [(rf"(?s){p}", code.rlike(rf"(?s){p}")) for p in (r'"""(.*?)"""', r"'''(.*?)'''", r"/\*(.*?)\*/")]
    comment = r"^(?U:\s)*(?:#|//)(?U:\s)*(.*)"
    # Blank lines among the comments are passed over; anything else ends them.
    state = F.aggregate(
        F.filter(lines(code), lambda line: strip(line) != ""),
        F.struct(F.lit(False).alias("over"), F.array().cast("array<string>").alias("got")),
        lambda s, line: F.when(s["over"] | ~line.rlike(comment), F.struct(F.lit(True).alias("over"), s["got"].alias("got"))).otherwise(
            F.struct(F.lit(False).alias("over"), F.concat(s["got"], F.array(strip(F.regexp_extract(line, comment, 1)))).alias("got"))
        ),
    )
    out = F.array_join(state["got"], " ")
    for pattern, hit in reversed(found):
        out = F.when(hit, strip(F.regexp_extract(code, pattern, 1))).otherwise(out)
    return out


# Lines that carry no meaning for retrieval.
BOILERPLATE_LINES = (r"(?dmi)^.*auto.?generated.*$", r"(?dmi)^.*DO NOT EDIT.*$", r"(?dmi)^.*copyright.*$", r"(?dm)^#!.*$")


def strip_boilerplate(code: Column) -> Column:
    """Blanks generated-file, licence and shebang lines and closes the gaps."""
    for pattern in BOILERPLATE_LINES:
        code = F.regexp_replace(code, pattern, "")
    return strip(F.regexp_replace(code, r"\n{3,}", "\n\n"))


def normalize_document(code: Column, symbol: Column | None = None, *, split_ids: bool = True, extract_docs: bool = True, strip_boiler: bool = True) -> Column:
    """Symbol words, docstring and cleaned code, one below the other."""
    clean = strip_boilerplate(code) if strip_boiler else code
    parts = [split_identifiers_in_text(clean) if split_ids else clean]
    if extract_docs:
        doc = extract_docstring(code)
        parts.insert(0, F.when(doc != "", doc))
    if symbol is not None:
        parts.insert(0, F.when(symbol != "", split_identifier(symbol)))
    return F.concat_ws("\n", *parts)


def text_for_embedding(symbol: Column, docstring: Column, code: Column) -> Column:
    blank = lambda c: F.when(c != "", c)
    return F.concat_ws("\n", blank(symbol), blank(docstring), code)


@F.pandas_udf(StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def unicode_normalize(text: Column) -> Column:
    """Canonical composition, and no control characters but line ends and tabs."""
    return F.regexp_replace(_nfc(text), r"[\p{Cc}&&[^\n\t]]", "")


def clean_markdown_inline(text: Column) -> Column:
    """Links unwrapped, emphasis and code marks dropped, leading bullets and numbers cut."""
    out = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1")
    out = F.regexp_replace(out, "[*`_#]", "")
    return strip(F.regexp_replace(out, r"^(?U:[\s*\->\d.])+", ""))


def is_remote_git_url(path: Column) -> Column:
    """A URL or remote address, or a plain ``owner/name`` pair (local folders are the caller's to rule out)."""
    p = strip(F.coalesce(path, F.lit("")))
    return p.rlike(r"^(?:https?://|git@|ssh://)") | p.rlike(r"^[a-zA-Z0-9_\-.]+/[a-zA-Z0-9_\-.]+\z")


def parse_owner_repo(url: Column) -> Column:
    """``owner`` and ``repo`` of common addresses of the public code host, else null."""
    raw = F.regexp_replace(strip(url), "^['\"]+|['\"]+\\z", "")
    low = F.lower(raw)
    web = low.rlike("^(?:https?|ssh)://")
    host = F.lower(F.regexp_extract(raw, r"^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]*)", 1))
    path = F.when(low.startswith("git@github.com:"), F.substring_index(raw, ":", -1))
    path = path.when(web, F.when(host.isin("github.com", "www.github.com"), F.regexp_extract(raw, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)))
    path = path.otherwise(F.regexp_extract(raw, r"^([^?#]*)", 1))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    owner, repo = F.get(parts, F.lit(0)), F.regexp_replace(F.get(parts, F.lit(1)), r"(?i)\.git\z", "")
    legal = r"^[a-zA-Z0-9_.-]+\z"
    return F.when(owner.rlike(legal) & repo.rlike(legal), F.struct(owner.alias("owner"), repo.alias("repo")))


def make_snapshot_id(repo: Column, commit: Column) -> Column:
    """``repo__commit`` with unsafe characters replaced and both parts cut short."""
    safe = lambda c, n, other: F.coalesce(F.nullif(F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[^\w.-]+", "_"), 1, n), F.lit("")), F.lit(other))
    return F.concat(safe(repo, 48, "repo"), F.lit("__"), safe(commit, 40, "local"))
