import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cell string, bucket string, key string, shard string, size string, salt string, run string"


def words(dice, n, pool=4000):
    return [f"w{dice.randrange(pool)}" for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages and odd cases, by doc_id."""
    dice = random.Random(7)
    base = [words(dice, dice.choice([60, 120, 300])) for _ in range(30)]
    out = [" ".join(b) for b in base]
    passage = words(dice, 70)
    for k in range(6):  # near copies of the first text
        near = list(base[0])
        near[dice.randrange(len(near))] = f"edit{k}"
        out.append(" ".join(near))
    out += [" ".join(base[1])] * 3
    for k in range(5):
        own = words(dice, 100)
        out.append(" ".join(own[:40] + passage + own[40:]))
    out += [None, "", "  \n\t ", "one two", "One  two", "three", "word " * 5000, "é è Ünïcode\x0btab 日本語 " * 30, "x" * 70, "x" * 300]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(k, t, [None, "en", "de"][k % 3], [None, "a", "b", "c"][k % 4], None if t is None else len(t), *("clash",) * 7) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
