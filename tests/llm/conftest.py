import pytest

from opporta import runtime

WORDS = "the harbour committee met on a cold day and asked for new plans of each quay wall before rain could come again".split()


@pytest.fixture(scope="session", autouse=True)
def package(spark):
    runtime.ship_package(spark)


def prose(n: int, seed: int = 0) -> str:
    """Some deterministic text of n words in lines."""
    out = []
    for i in range(n):
        seed = (seed * 1103515245 + 12345) % 2**31
        out.append(WORDS[seed >> 8 & 15] + ("." if i % 11 == 10 else "") + ("\n" if i % 37 == 36 else ""))
    return " ".join(out)


#: Rows that every operator has to take: nulls in any column, empty, white and very long texts, repeated rows, copies.
ODD = [
    (1, prose(300, 1), "en", "a"), (2, prose(300, 1), "en", "a"), (2, prose(300, 1), "en", "a"), (3, prose(300, 1).replace("cold", "warm", 1), "en", None),
    (4, None, "en", "b"), (5, "", None, "b"), (6, " \t\n ", "de", None), (None, "short text", "en", "c"), (None, None, None, None), (7, "Ünïcode 日本語   . \x00 x" * 3, "ja", "c"),
    (8, prose(6000, 8), "en", "a"), (9, "12 34 !!", "en", "a"), (10, "x " + prose(300, 1)[:900] + " y", "en", "d"), (-5, "a" * 3000, "en", "d"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """`ODD` with columns whose names the operators use inside."""
    rows = [(i, t, lang, source, len(t) if t is not None else None, 7, "x", 0.5) for i, t, lang, source in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, fp int, language string, row_of double").repartition(3).cache()


@pytest.fixture(scope="session")
def no_rows(spark, odd):
    return spark.createDataFrame([], odd.schema)
