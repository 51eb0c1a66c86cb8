import pytest

CLASHING = ("range_id", "shard_id", "repetition", "_r", "_parts", "_first", "_s", "_e", "_n", "_bad", "_toxicity", "_gone", "_twice", "_row", "score", "keep", "toxic", "c", "sig", "item_id", "h", "words")
ODD = [
    (1, "plain words here and there, all of them", "en", "a", 5),
    (1, "plain words here and there, all of them", "en", "a", 5),
    (2, None, None, None, None),
    (3, "", "en", "", 0),
    (None, "plain words here and there, all of them", "en", "a", 1),
    (4, "... !!! ---", "en", "a", 11),
    (5, "long word " * 150_000, "en", "b", 1_500_000),
    (6, "été ÜBER straße 東京", "fr", "b", 20),
    (7, "one", None, "c", 3),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward documents, with columns named like those that operators add."""
    rows = [(*r, *(f"mine-{c}" for c in CLASHING)) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def load(spark, sf_dir):
    return lambda name, d=None: spark.read.parquet(f"{d or sf_dir}/{name}.parquet")
