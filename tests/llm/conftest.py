import pytest
from pyspark.sql import Row  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, size int, target string, component_id int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, ties, and extra columns that clash."""
    long = "lorem ipsum dolor " * 4000 + "x" * 30000
    texts = [None, "", " \t\n", "a b c", "a b c", long, "mail me at joe.doe@mail.example.com or +1 (555) 010-9999.", "ÀÉ ß 你好 😀 don't", "idiot " * 30 + "idiot", "1.2.3.4 300.1.1.1 4111 1111 1111 1111", "Released under the MIT License. Ok."]
    rows = [(i, t, ["en", None, "de"][i % 3], ["s", None][i % 2], None, "s", i, "t", 1) for i, t in enumerate(texts)]
    rows += [rows[3], rows[5], (None, "no id here", "en", "s", 3, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
