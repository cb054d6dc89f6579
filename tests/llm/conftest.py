import random

import pytest

EMPTY = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank and very long texts, null keys, repeated rows, exact and near copies, and ties."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "rho", "tau", "phi", "chi", "psi"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(80)) for _ in range(6)]
    near = base[0].replace(" ", "  ", 1) + " tail"
    long_ = "\n".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(12)) for _ in range(4000))
    texts = [*base, base[0], near, near.upper(), "one", "one", "One two", "", " \t\n", None, long_, long_ + " end"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    return [*rows, rows[1], (None, base[2], None, None, None), (None, None, "en", "s", 0)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with extra columns whose names the operators use inside."""
    df = spark.createDataFrame(odd_rows, EMPTY)
    return df.selectExpr("*", "1 as key", "2 as n", "'x' as node", "3 as component", "4 as t0", "'y' as _broken", "5 as words")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], EMPTY)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
