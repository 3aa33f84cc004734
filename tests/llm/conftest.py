import os
import random

import pytest

from conftest_paths import SF  # noqa: E402
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score string, runs int, n_deleted int, component_id string, ids int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, repeated ids, columns that clash with outputs."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    long = " ".join(rng.choices(words, k=60_000)) + ". " + "x" * 300_000
    rows = [
        (1, "one two three four five six seven. eight nine ten", "en", "s", 9, "a", 1, 2, "b", 3), (2, None, None, None, None, None, None, None, None, None),
        (3, "", "en", "s", 0, "", 0, 0, "", 0), (None, "null id text with some words in it", "en", "s", 1, "x", 1, 1, "y", 1), (None, None, None, None, None, None, None, None, None, None),
        (4, "same row twice, the same row", "en", "s", 1, "x", 1, 1, "y", 1), (4, "same row twice, the same row", "en", "s", 1, "x", 1, 1, "y", 1),
        (4, "same id, other text", "de", "s", 1, "x", 1, 1, "y", 1), (5, "   \n\t \n", "en", "s", 1, "x", 1, 1, "y", 1), (6, long, "en", "s", 1, "x", 1, 1, "y", 1),
        (7, "Ünïcode 中文 😀 text with   odd  spaces\r\n\r\n", "en", "s", 1, "x", 1, 1, "y", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(spark):
    """Texts of the smallest given table by id."""
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
