import pytest
from pyspark.sql import functions as F

from waxgraph.functions import text as X


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "raw,want",
    [
        (None, ""),
        ("  a\t b  c \n", "a b c"),
        ('x+y-z&&|!(a){b}[c]^"d~*?:e\\/f', "x y z a b c d e f"),
        ("+-&|", ""),
        ("a" * 119 + " bc", "a" * 119 + " "),
        ("é" * 200, "é" * 120),
    ],
)
def test_clean_term(spark, raw, want):
    assert one(spark, X.clean_term, raw) == want


def test_terms_keep_repeats(spark):
    assert one(spark, X.terms, "Goldie  TIMELESS goldie") == ["goldie", "timeless", "goldie"]
    assert one(spark, X.terms, "") == []


def test_tokens(spark):
    assert one(spark, X.tokens, "Ünï-cødé №5, R2D2_x") == ["ünï", "cødé", "5", "r2d2", "x"]


@pytest.mark.parametrize(
    "raw,want",
    [(None, 60), ("", 60), ("12", 12), (" 7 ", 7), ("0", 1), ("-5", 1), ("301", 300), ("6.5", 60), ("x", 60),
     ("9" * 50, 300), ("-" + "9" * 50, 1), ("+4", 4)],
)
def test_clamp_limit(spark, raw, want):
    assert one(spark, X.clamp_limit, raw) == want


def test_suggest_limit_and_seeds(spark):
    assert [one(spark, X.clamp_suggest_limit, v) for v in ("50", "0", "abc", "15")] == [20, 1, 10, 15]
    assert [one(spark, X.seed_count, v, "int") for v in (60, 3, 1, 300, 7)] == [15, 1, 1, 75, 1]


def test_has_text(spark):
    cases = {None: False, "": False, " \t\n": False, " ": False, " ": False, " x ": True}
    for value, want in cases.items():
        assert one(spark, X.has_text, value) is want


def test_subtitle(spark):
    schema = "kind string, artists array<string>, labels array<string>, year string, profile string"
    rows = [
        ("Release", ["A", "B"], ["L"], "1995", "ignored"),
        ("Release", [], [], "1995", ""),
        ("Release", [], [], "", ""),
        ("Artist", [], [], "", "a bio"),
        ("Label", [], [], "", ""),
    ]
    df = spark.createDataFrame(rows, schema)
    found = df.select(X.subtitle(*[F.col(c) for c in df.columns])).collect()
    assert [r[0] for r in found] == ["A, B · L · 1995", "1995", "Release", "a bio", "Label"]


def test_display_title(spark):
    df = spark.createDataFrame([(None, "t"), ("", ""), ("n", "t")], "name string, title string")
    assert [r[0] for r in df.select(X.display_title()).collect()] == ["t", "(untitled)", "n"]


def test_node_size(spark):
    sizes = [one(spark, X.node_size, d, "long") for d in (0, 10, -3, 10**6)]
    assert sizes == pytest.approx([4.0, 23.8, 4.0, 26.0])


def test_site_links(spark):
    df = spark.createDataFrame([("Group", "5"), ("Label", None), ("Master", "5")], "kind string, id string")
    found = [r[0] for r in df.select(X.site_link("https://site/", F.col("kind"), F.col("id"))).collect()]
    assert found == ["https://site/artist/5", None, None]


def test_units(spark):
    sizes = [one(spark, X.human_bytes, v, "long") for v in (None, 0, 500, 2048, 5 * 2**20, 3 * 2**30, 2**45)]
    assert sizes == ["-", "-", "500 B", "2.0 KiB", "5.0 MiB", "3.0 GiB", "32.0 TiB"]
    times = [one(spark, X.human_seconds, v, "long") for v in (None, 5, 65, 3725)]
    assert times == ["-", "5s", "1m 05s", "1h 02m"]
