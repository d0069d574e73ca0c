import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, repeated rows, nulls in every column, empty and long texts, and ties."""
    rng = random.Random(5)
    out = [(i, words(rng, rng.randint(30, 120)) + ".\n" + words(rng, 30), "en", f"s{i % 3}", 1) for i in range(40)]
    text = out[3][1]
    out += [(50 + i, text, "en", "s0", 1) for i in range(6)]
    out += [(60 + i, text.replace("the", "a", i + 1), "en", None, 1) for i in range(3)]
    out += [(70, None, "en", "s1", None), (71, "", None, "s1", 0), (72, " \n\t ", "xx", None, 3), (73, "one", "en", "s2", 3), (74, "one two", None, "s2", 3)]
    out += [(None, out[5][1], "en", "s1", 1), (None, None, None, None, None), (80, words(rng, 30_000), "en", "s2", 9)]
    out += [(81, "x y z. " * 60, "en", "s2", 9), (81, "x y z. " * 60, "en", "s2", 9), (82, "é ü\u00a0ß " + words(rng, 40), "de", "é", 9)]
    out += [(83, out[7][1] + " " + words(rng, 20), "en", "s1", 2), (84, words(rng, 5) + " " + " ".join(out[7][1].split()[10:40]), "en", "s1", 2)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
