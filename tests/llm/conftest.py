import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket string, rec int, size int, score string, shard string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows, and extra columns whose names clash."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    long = " ".join(word() for _ in range(9000))
    base = [word() for _ in range(120)]
    near = list(base)
    near[60] = "changed"
    texts = [None, "", " \t\n", "one", "Two words", " ".join(base), " ".join(near), " ".join(base).upper(), long, "x\n" * 50, "\n".join(base), " ".join(base) + " " + " ".join(word() for _ in range(80))]
    texts += [" ".join(word() for _ in range(rng.randint(1, 200))) for _ in range(30)] + [" ".join(base)] * 5
    rows = [(i * 3, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t), "b", i, -1, "s", "h") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id here", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
