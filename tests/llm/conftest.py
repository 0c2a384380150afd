import pytest


@pytest.fixture(autouse=True, scope="session")
def _code(spark):
    from marketlens.llm._shared import ship_code

    ship_code(spark)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, repeats, clashing names."""
    words = " ".join(f"w{i % 977} and" for i in range(30_000))
    rows = [
        (1, None, "en", "s", 0),
        (2, "", None, "s", 0),
        (None, "some words without an id at all", "en", None, None),
        (3, "one two three four five six seven", "en", "s", 1),
        (3, "one two three four five six seven", "en", "s", 1),
        (4, "one two three four five six seven", "de", "s", 1),
        (5, "  \t\n ", "de", "s", 1),
        (6, words, "en", "s", len(words)),
        (7, "nospace" * 4000, "en", "s", 1),
        (8, "!!! ... ???", "en", "s", 1),
        (9, "a  b \n c d ▁x <|endoftext|> </s> </s>", "en", "s", 1),
    ]
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, hits string, score double, "
        "quality_score string, assign_spans string, label int, id long, cls long"
    )
    return spark.createDataFrame([r + ("x", 0.5, "y", "z", 1, 2, 3) for r in rows], schema)


@pytest.fixture(scope="session")
def nothing(spark, odd):
    return odd.where("1 = 0")
