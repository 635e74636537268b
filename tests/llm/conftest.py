import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use for results; an input may have them too
CLASH = ["size", "shard", "slot", "start", "length", "ids", "n_words", "score", "taken", "label", "key", "id", "cell", "part",
         "tail", "path", "features", "target", "source_size", "copies", "kept", "component_id", "vector", "comp"]


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls everywhere, empty and blank texts, a very long text, repeated rows, equal texts, odd characters."""
    rng = random.Random(3)
    long = words(rng, 60_000, 5000)
    return [(1, "Hello  world", "en", "a", 12), (1, "Hello  world", "en", "a", 12), (1, "Hello  world", "en", "a", 12),
            (2, None, None, None, None), (None, None, None, None, None), (None, "one two three four", "en", "a", 1),
            (3, "", "en", "b", 0), (4, " \n\t ", "en", None, 4), (5, long, "en", "b", len(long)),
            (6, "Ünïcode naïve “quotes” 你好 İ é don't I'LL 12345", "de", "c", 3),
            (7, "a <|endoftext|> b<|startoftext|>", "en", "c", 3), (8, "HELLO world", "en", "c", 3), (9, words(rng, 300), "fr", "d", 3),
            (10, "x" * 30_000, "en", "d", 1), (11, "\n".join(["same line here"] * 40), "en", "d", 5), (12, "one", "en", "a", 3),
            (13, "ONE", "en", "a", 3), (14, "one two", "en", "a", 3)]


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(edge_rows, DOCS).repartition(3)
    return df.withColumns({c: F.lit("other") for c in CLASH})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers
    return public_tokenizers.path
