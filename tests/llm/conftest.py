import pytest

from turnstile.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, at string, row string, base string, kept string"
LINE = "the old mill by the river was sold to a new owner in spring"


@pytest.fixture(scope="session")
def shared(spark):
    return common.shared_dir(spark)


@pytest.fixture(scope="session")
def odd(spark, shared):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use inside."""
    body = "\n".join(f"{LINE} number {i} and then some more words follow" for i in range(6))
    rows = [
        (1, body), (2, body), (2, body), (3, body.replace("number 2", "number two")), (4, ""), (5, None), (None, body), (6, " \n\t\n"),
        (7, " ".join(f"w{i * 7919 % 10007}" for i in range(30000))), (8, LINE + "\n" + LINE.replace("sold", "let")), (9, "\x00 é 😀 ▁ password = 'hunter2hunter2'"),
    ]
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None, None, "x", "y", "z", "b", "k") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def none(spark, shared):
    return spark.createDataFrame([], SCHEMA)
