import random

import pytest

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "vo", "xa", "ze") for b in ("n", "st", "rd", "mple", "ga")]


def prose(seed: int, n: int) -> str:
    """n random words, a line break now and then."""
    r = random.Random(seed)
    return "".join(r.choice(WORDS) + ("\n" if r.random() < 0.06 else " ") for _ in range(n)).strip()


SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, slot string, "
          "n_words string, block int, lang_pred string")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, clashing column names."""
    base = prose(1, 150)
    rows = [(k, prose(k + 10, 30 + 7 * k)) for k in range(30)]
    rows += [(40, base), (41, base), (42, base + " another end"), (43, None), (44, ""), (45, "   \t\n "),
             (46, "one"), (47, "one two three four"), (48, prose(3, 30000)), (49, "no letters: " + base), (50, "123 456"),
             (None, base), (None, None), (51, "Été ça va " * 20), (40, base)]
    table = [(i, t, None if n % 7 == 0 else "en", None if n % 5 == 0 else f"s{n % 3}", None if t is None else len(t),
              1.5, "x", None, n, None) for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(table, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def rows_of():
    def take(df):
        return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    return take
