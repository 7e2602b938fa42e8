import pytest

LONG = "some quite ordinary words stand here again and again " * 4000


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    return [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (4, LONG, "en", "b", len(LONG)),
        (5, "one two", "en", "b", 7),
        (6, "one two", "de", None, 7),
        (6, "one two", "de", None, 7),
        (None, "a row without an id but with several words", "en", "a", 10),
        (7, "Größe 😀 \u0301 ünïcode\r\n|| ## end", None, "c", None),
    ]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """Documents of the edge cases, with extra columns whose names clash with results'."""
    df = spark.createDataFrame(edge_rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("n_lines", "score", "media", "host", "rule", "component_id", "start", "n_tokens", "accepted", "lang_pred", "item_id", "digest", "token"):
        df = df.selectExpr("*", f"'x' AS {c}")
    return df
