import random

import pytest

WORDS = "the bridge opens again in spring nobody had expected so many visitors and small museum soon ran out of tickets".split()


def prose(pick: random.Random, n: int) -> str:
    return " ".join(pick.choice(WORDS) + str(pick.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls everywhere, empty and long texts, copies, near copies, repeated rows, clashing names."""
    pick = random.Random(5)
    base = prose(pick, 120)
    changed = base.split()
    changed[60] = "other"
    long = prose(pick, 4000)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base.replace(" ", "  "), "en", None), (4, " ".join(changed), "de", "b"),
        (5, None, "en", "b"), (6, "", None, "b"), (7, " \t\n ", "en", "c"), (8, "one two", "en", "c"), (9, "one two", "en", None),
        (10, long, "fr", "a"), (11, long + " end", "fr", "a"), (12, "x" * 1500, "en", "a"), (13, "ab cd " * 200, "en", "a"),
        (14, base.upper(), "en", "a"), (15, "Größe 漢字 \U0001f600 é", "de", "b"), (None, base, "en", "a"),
        (None, None, None, None), (16, "same row", "en", "a"), (16, "same row", "en", "a"), (17, " odd space\x1f", "en", "a"),
    ]
    rows += [(100 + i, prose(pick, 60 + i), "en", "a" if i % 3 else "b") for i in range(30)]
    full = [(*r, 7, "size", "rank", "text_sha256", i) for i, r in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, size string, ids string, keys string, n int"
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def empty(hard):
    return hard.filter("false")
