import os

import pytest

from factsieve.llm.queries import tokenizer_path


@pytest.fixture(scope="session")
def tokenizer():
    return tokenizer_path()


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and columns that clash with results."""
    prose = "the quick brown fox jumps over the lazy dog while rain falls on the old stone bridge near town"
    rows = [
        (1, prose, "en", "a", 1, "x", 5),
        (1, prose, "en", "a", 1, "x", 5),
        (2, prose + " today", "en", "a", None, None, None),
        (None, prose, None, None, None, "y", 1),
        (None, None, None, None, None, None, None),
        (3, None, "en", "a", 0, "x", 0),
        (4, "", "de", "b", 0, "x", 0),
        (5, " \n\t ", "de", "b", 0, "x", 0),
        (6, "12 !!! ###", "de", "b", 0, "x", 0),
        (7, "word " * 30_000 + "end", "en", "b", 0, "x", 0),
        (8, "É" * 20_000, "fr", "b", 0, "x", 0),
        (9, "one", "fr", "b", 0, "x", 0),
        (10, "a\x00b \x1f c d <|endoftext|> 'S", "fr", "b", 0, "x", 0),
    ]
    names = "doc_id long, text string, lang string, source string, n_chars long, score string, `length` long"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    assert os.path.isdir(FOLDER)
    return FOLDER
