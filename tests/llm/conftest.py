import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        T.StructField("id", T.StringType()),
        T.StructField("cls", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("spans", T.StringType()),
    ]
)


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choice("aeioubdglmnrst") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) for i in range(0, n, 12))


@pytest.fixture(scope="session")
def rows():
    """Small documents: copies, near copies, a shared passage, nulls, empty and long texts, repeated rows and ids."""
    rng = random.Random(5)
    long = prose(rng, 9000)
    base = prose(rng, 150)
    near = base.split(" ")
    near[40] = "otherword"
    passage = prose(rng, 70)
    texts = [
        base, base, " ".join(near), long, None, "", "", "   \n\t ", "one", "a b c d",
        prose(rng, 60) + "\n" + passage + "\n" + prose(rng, 60), prose(rng, 80) + "\n" + passage,
        "écrit à λόγος Σ 漢字 🙂 " * 30, "word " * 120, "A#B$ *** " * 20,
        *[prose(rng, rng.randint(5, 200)) for _ in range(25)],
    ]
    made = [(i, t, "en", None if i % 7 == 3 else f"s{i % 4}", 0, "x", "y", 1, "z") for i, t in enumerate(texts)]
    made += [made[0], made[3], (None, "no id here at all, only a text of some words", None, None, None, None, None, None, None)]
    made.append((2, "the id 2 again with another text", "en", "s1", 0, "x", "y", 1, "z"))
    return made


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
