from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: The same with columns whose names the operators use inside.
CLASHING = SCHEMA + ", id long, row string, key string, n long, rest string, part int, size long, group_size long, kept boolean"


@pytest.fixture(scope="session")
def corpus():
    """Plain rows: copies, near copies, ties, repeated rows, nulls, empty and long texts."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(1, 160)), "en", f"s{i % 5}" if i % 11 else None) for i in range(160)]
    rows += [(160 + i, rows[3][1], "de", "s0") for i in range(40)]  # exact copies
    base = text(200).split()
    for i in range(30):  # near copies
        changed = list(base)
        changed[rng.randrange(200)] = "zz"
        rows.append((200 + i, " ".join(changed), "en", "s1"))
    rows += [(230, "", "en", "s2"), (231, None, None, None), (232, "one two", "fr", "s3"), (233, "One  two\n", "fr", "s3")]
    rows += [(234, text(9000), "en", "s4"), (235, "x" * 50_000, "en", "s4"), (236, "ünï çödé 日本語 " * 40, "es", "s4")]
    rows += [rows[7], rows[7], (None, text(60), "en", "s0"), (None, rows[3][1], "en", "s0"), (None, None, None, None)]
    return [(a, b, c, d, len(b or "")) for a, b, c, d in rows]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def clashing(spark, corpus):
    return spark.createDataFrame([(*r, 1, "r", "k", 2, "z", 3, 4, 5, False) for r in corpus], CLASHING)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
