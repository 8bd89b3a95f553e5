import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, copy string, spans string"


def words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n)]


def odd_rows():
    """Texts of all kinds: null, empty, very long, copies, near copies, repeated rows and ids, rows without an id."""
    base = words(1, 120)
    near = [*base[:60], "other", *base[61:]]
    long = words(2, 30_000)
    texts = [
        None, "", "  \n", "one", "two words", "A few Words only", " ".join(base), " ".join(base), " ".join(near), "\t".join(base).upper(),
        " ".join(long), " ".join(long), " ".join([*long[:500], "x", *long[500:]]), " ".join(words(3, 60) + base[:40] + words(4, 60)),
        " ".join(words(3, 60)), "é" * 80, "é" * 81, "a" * 400, "ab" * 300, "abc " * 200, "mail me@example.org now", "\U0001f600 token=abcdef0123456789",
        "12345 !!", " ".join(base),
    ]
    rows = [(n, t, ["en", None, "de"][n % 3], [None, "a", "b", "é"][n % 4], None if t is None else len(t), "s", "z", "c", "p") for n, t in enumerate(texts)]
    rows.append(rows[8])  # a repeated row
    rows.append((3, "an id that is there already, with another text", "en", "a", 46, "s", "z", "c", "p"))
    rows.append((None, " ".join(base), "en", "a", 3, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def distinct(odd):
    """Rows with an id of their own, for plain versions."""
    return odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
