import pytest

LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 6, "a", "en"),
    (2, "The quick brown fox jumps over the lazy dog. " * 6, "a", "en"),
    (2, "The quick brown fox jumps over the lazy dog. " * 6, "a", "en"),
    (3, None, None, None),
    (4, "", "b", ""),
    (5, " \t\n\u00a0 ", "b", "en"),
    (6, LONG, "b", "en"),
    (7, "short", None, "de"),
    (8, "é" * 300 + " ünïcode 中文 text\x1cwith\x85odd blanks", "c", "fr"),
    (None, "no id at all but some words to keep in the text", "c", "en"),
    (9, " ".join(f"u{k}" for k in range(60)) + " tail one", "a", "en"),
    (10, "head two " + " ".join(f"u{k}" for k in range(60)), "a", "en"),
    (11, "same same same same", "d", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, ties, repeats, a long text, odd blanks, and columns whose names clash with results."""
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string, lang string")
    for name in ("n_words", "score", "fp", "size", "target", "whole", "bucket", "u", "v"):
        df = df.selectExpr("*", f"'x' AS {name}")
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df):
    clean = lambda v: None if isinstance(v, float) and v != v else v
    return sorted((tuple(clean(v) for v in r) for r in df.collect()), key=repr)


def inputs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
