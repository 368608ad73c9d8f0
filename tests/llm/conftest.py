import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, word int, texts string"


def words(rng, n, letters="abcdé"):
    return [("".join(rng.choice(letters) for _ in range(rng.randint(1, 4)))) for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty, blank and long texts, shared passages, copies, repeated rows, ids that are null or repeat."""
    rng = random.Random(11)
    shared = [" ".join(words(rng, 60)) for _ in range(4)]
    out = []
    for i in range(70):
        own = " ".join(words(rng, rng.choice([0, 1, 3, 12, 40])))
        part = rng.choice(shared).split()
        a = rng.randint(0, 30)
        text = rng.choice([own, own + " " + " ".join(part[a:a + rng.randint(5, 60)]), own.upper() + "\n\t" + rng.choice(shared), shared[0]])
        out.append((i, text, rng.choice(["xx", "yy", None])))
    out += [(100, None, "xx"), (101, "", "yy"), (102, " \n\t ", None), (103, " ".join(words(rng, 30_000)), "xx"), (None, shared[1], "xx"),
            (None, None, None), (104, "12 % !!", "yy"), (105, "日本語 テキスト � \x00 é", "yy"), (3, "another text with the id three", "xx")]
    return out + out[:6]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names clash with those that operators use."""
    return spark.createDataFrame([(*r, "s", 0, 5, "r", 1, "t") for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
