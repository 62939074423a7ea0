import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, mark string, h string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, ties, and extra columns whose names the operators use inside."""
    long = " ".join(f"word{i % 977} tail{i % 13}" for i in range(6000))
    texts = [
        (1, "alpha beta gamma delta\nshared line of text\nshort\nALPHA  "),
        (2, "  SHARED line of text\t\nown words here\nshort"),
        (3, None),
        (4, ""),
        (5, long),
        (6, long + " end"),
        (5, long),
        (7, "a b c a b c a b c a b c"),
        (8, "one"),
        (9, "one"),
        (None, "shared line of text\nnull id"),
        (10, "İstanbul ΣΑΣ <|endoftext|> don't \x1c x日本語 3½\n\n\nshared line of text"),
        (11, "\n\n \t"),
        (12, "### %%% && \n" * 30),
    ]
    rows = [(i, t, "en" if n % 2 else None, "s" if n % 3 else None, len(t) if t else None, n, n, "m", "h") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
