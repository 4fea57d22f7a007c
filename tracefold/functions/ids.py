"""Stable identities: prefixes of SHA-256 sums in hexadecimal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _prefix(text: Column, n: int) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, n)


def chunk_id(file_path: Column, symbol: Column, start_line: Column) -> Column:
    return _prefix(F.concat_ws("::", file_path, symbol, start_line.cast("string")), 16)


def lineage_id(file_path: Column, symbol: Column, repo: Column | None = None) -> Column:
    """The same for all versions of a symbol of a file; ``repo`` keeps equal paths of repositories apart."""
    return _prefix(F.concat_ws("::", *([] if repo is None else [repo]), file_path, symbol), 16)


def content_hash(code: Column) -> Column:
    return _prefix(code, 32)
