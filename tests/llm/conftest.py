import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _rows():
    rng = random.Random(7)
    words = ["alpha", "Beta,", "gamma", "delta.", "épsilon", "ζeta", "the", "of", "naïve", "x1", "50%", "#tag", "don't", "漢字", "I'll"]

    def prose(n):
        return " ".join(rng.choice(words) + (str(rng.randrange(300)) if rng.random() < 0.5 else "") for _ in range(n))

    passage = prose(60)
    base = prose(120).split()
    rows = [(i, prose(rng.randrange(1, 200)), "en", "s0", 1) for i in range(20)]
    rows += [(20 + i, f"{prose(30)}\n{passage}\n{prose(30)}", "en", "s0", 1) for i in range(8)]
    for i in range(6):
        near = list(base)
        near[i * 7] = f"edit{i}"
        rows.append((30 + i, " ".join(near), "de", "s1", 2))
    rows += [(40 + i, prose(0) if i % 2 else rows[3][1], None, None, None) for i in range(4)]
    rows += [(50, None, None, None, None), (51, "", "en", "s0", 0), (52, " \n\t ", "en", "s0", 4), (53, "one", "en", "s0", 3), (54, "a b c d", "en", "s0", 7)]
    rows += [(60, "z" * 30_000, "en", "s0", 1), (61, prose(9000).replace(" ", "\n"), "en", "s0", 1), (62, "ab" * 700, "en", "s0", 1)]
    rows += [(63, "BUY!! " * 90, "en", "s0", 1), (64, "same words here " * 40, "en", "s0", 1)]
    return rows


ROWS = _rows()


@pytest.fixture(scope="session")
def odd(spark):
    """Copies, near copies, passages, empty, null, blank and very long texts."""
    return spark.createDataFrame(ROWS, COLUMNS).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def hostile(spark, odd):
    """As ``odd``, with repeated rows, a null id and columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    more = spark.createDataFrame([(3, ROWS[3][1], "en", "s0", 1), (None, "no id here", None, None, None)], COLUMNS)
    names = ("kept", "part", "ids", "shard", "cell", "bucket", "component_id", "start", "n_words", "key", "label", "features")
    return odd.union(more).withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
