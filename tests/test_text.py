"""Golden values of text functions, ids and query analysis."""

import pytest
from pyspark.sql import functions as F

from tracefold.functions import ids, queryprep, text


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "given,want", [("parseHTTPResponse", "parse http response"), ("my_variable_name", "my variable name"), ("PascalCaseClass", "pascal case class"), ("", "")]
)
def test_split_identifier(spark, given, want):
    assert one(spark, text.split_identifier(F.col("t")), t=given) == want


@pytest.mark.parametrize(
    "given,want",
    [("parseHTTPResponse", "parse http response"), ("a.b.c x9 JSONParser/v2", "x9 json parser v2"), ("getURLFor_id-2024", "get url for id 2024"), (None, ""), ("x" * 61 + " ok", "ok")],
)
def test_tokenise(spark, given, want):
    assert " ".join(one(spark, text.tokenise(F.col("t").cast("string")), t=given)) == want


def test_identifiers_in_text_keep_white_space(spark):
    assert one(spark, text.split_identifiers_in_text(F.col("t")), t="a  getItem\n\tmy_var if aB") == "a  get item\n\tmy var if aB"


@pytest.mark.parametrize(
    "code,want",
    [
        ('def f():\n    """Does it.\n    Well."""\n', "Does it.\n    Well."),
        ("x = 1 /* block */", "block"),
        ("# one\n\n// two\nx = 1\n# three", "one two"),
        ("x = '''s''' + \"\"\"d\"\"\"", "d"),
        ("pass", ""),
        ("", ""),
    ],
)
def test_docstring(spark, code, want):
    assert one(spark, text.extract_docstring(F.col("t")), t=code) == want


def test_boilerplate_and_document(spark):
    code = "#!/bin/sh\n# Copyright X\n# AUTO-GENERATED\n\n\n\n# DO NOT EDIT this\nreadFile()\n"
    assert one(spark, text.strip_boilerplate(F.col("t")), t=code) == "readFile()"
    assert one(spark, text.normalize_document(F.lit("readFile()\n"), F.lit("readAll"))) == "read all\nread file"
    assert one(spark, text.text_for_embedding(F.lit("s"), F.lit(""), F.lit("c"))) == "s\nc"
    assert one(spark, text.unicode_normalize(F.col("t")), t="e\u0301\x00\tb\x07\n") == "é\tb\n"


def test_markdown_and_addresses(spark):
    assert one(spark, text.clean_markdown_inline(F.col("t")), t=" - **[Fast](http://x)** `code` #1") == "Fast code 1"
    for given, want in (("https://a/b", True), ("git@x:y", True), ("owner/repo", True), ("a/b/c", False), ("", False), ("plain", False)):
        assert one(spark, text.is_remote_git_url(F.col("t")), t=given) is want
    for given, want in (
        ("https://github.com/Own/repo.git?x#y", ("Own", "repo")), ("git@github.com:o/r.git", ("o", "r")), ("o/r#frag", ("o", "r")),
        ("https://elsewhere.org/o/r", None), ("solo", None), ("o/r$", None),
    ):
        got = one(spark, text.parse_owner_repo(F.col("t")), t=given)
        assert (tuple(got) if got else None) == want
    assert one(spark, text.make_snapshot_id(F.lit("my repo!"), F.lit("abc/1"))) == "my_repo___abc_1"
    assert one(spark, text.make_snapshot_id(F.lit(""), F.lit(""))) == "repo__local"


def test_ids(spark):
    assert one(spark, ids.chunk_id(F.lit("services/cart.py"), F.lit("calculate_cart_total"), F.lit(25))) == "bd7c45d93c226cb8"
    assert one(spark, ids.lineage_id(F.lit("services/cart.py"), F.lit("calculate_cart_total"))) == "ea1969afc9cfa8d7"
    assert one(spark, ids.content_hash(F.lit(""))) == "e3b0c44298fc1c149afbf4c8996fb924"


@pytest.mark.parametrize(
    "query,kind",
    [
        ("how does the HTTP parser work?", "how_it_works"), ("where is the cart total", "where_is"), ("fix the login crash", "bug_fix"), ("sort a list", "general"),
        ("a ValueError here", "bug_fix"), ("a valueerror here", "general"), ("x" * 151, "problem_stmt"), ("how to do it? sample input " + "x " * 100, "problem_stmt"), ("   ", "general"),
    ],
)
def test_category(spark, query, kind):
    assert one(spark, queryprep.category(F.col("t")), t=query) == kind


def test_cleaning(spark):
    rows = [
        (1, "Where is the total computed in `services/cart.py`?"),
        (2, "I can't parse it, it's slow"),
        (3, "Given a list of numbers, return the largest one that is even and smaller than a bound given by the user.\n\n"
            "Do it fast, and without sorting, since the list is long and has to be read once only.\n\nInput Format\n1 2\n\n3 4 5\n\nSample Output\n3\n\nIgnored tail"),
        (4, "  tab\x01ular   text  "),
    ]
    got = {r.query_id: r for r in queryprep.clean_queries(spark.createDataFrame(rows, "query_id long, text string")).collect()}
    assert got[1].cleaned == "total computed services/cart.py cart" and got[1].was_cleaned
    assert got[2].cleaned == "I cannot parse it, it is slow"
    assert got[3].query_type == "problem_stmt" and got[3].cleaned.endswith("read once only.\n\nIgnored tail") and "Input" not in got[3].cleaned
    assert got[4].cleaned == "tab ular text"
    assert one(spark, queryprep.expand_keywords(F.col("t")), t="feedback sort") == "feedback sort order arrange rank database sql query store"


def test_client_values(spark):
    assert one(spark, queryprep.matched_terms(F.lit("the cart total of carts cart"), F.lit("Cart Total"))) == ["cart", "total"]
    assert one(spark, queryprep.match_percent(F.lit(None).cast("double"), F.lit(0.5))) == 50
    assert one(spark, queryprep.match_percent(F.lit(7.0), F.lit(0.5))) == 100
    assert one(spark, queryprep.related_files(F.lit("from a/b import c\nimport './d.py'\nimport os\nfrom x.py"), F.lit("z.py"))) == ["a/b", "x.py"]
