import pytest

#: A text with much in it: long, with copies of its own lines, digits and characters outside ASCII.
LONG = "Ünder the Bridge 12 waters. " * 4000 + "x" * 50_000


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named as outputs."""
    rows = [
        (1, "a b c d e f g h i j k", "en", "s0"), (1, "a b c d e f g h i j k", "en", "s0"), (2, None, "en", "s0"), (3, "", None, None), (None, "a b c d e f g h i j k", "de", "s1"),
        (None, None, None, None), (4, " \n\t ", "en", "s1"), (5, LONG, "en", "s1"), (6, LONG + " y", "en", "s0"), (7, "A B c d e f g h i j k", "fr", "s2"), (8, "one two", "en", "s2"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = ["size", "shard", "slot", "start", "row", "tie", "bucket", "fingerprint", "component_id", "score", "features", "kept", "base", "terms", "n_words", "n_hit", "spans", "items", "target", "words", "rank", "mark", "hash", "section", "n_tokens", "copy"]
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("old").alias(n) for n in names))


@pytest.fixture(scope="session")
def no_rows(odd_rows):
    return odd_rows.where("false")
