import random

import pytest

SF = "/root/testdata/sf0.001"

WORDS = "the of and to in that is was for with as on be at by this have from or one had not but what all were when we there can".split()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Copies, shared passages, ties, repeated rows, nulls, empty and long texts, and a column that clashes."""
    rnd = random.Random(5)
    passage = " ".join(rnd.choices(WORDS, k=60))
    rows = [(i, " ".join(rnd.choices(WORDS, k=rnd.randint(1, 120))) + ("\n" + passage if i % 3 == 0 else "")) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "Café naïve 中文 \U0001f600 " * 20), (204, "a " * 400), (205, "x" * 70000), (None, "null id here"), (None, None)]
    rows += [(206, "AAA " * 300 + passage.upper()), (5, rows[5][1])]
    return spark.createDataFrame([(i, t, "other", 1, 2) for i, t in rows], "doc_id long, text string, fp string, spans int, n_words int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
