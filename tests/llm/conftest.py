import pytest
from samples import rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = {"key": "k", "size": "s", "bucket": "b", "row": "r", "stats": "x", "gone": "g", "kept": "q", "words": "w", "one": "o", "n": "n", "spans": "z", "taken": "t", "word_length": "l"}
#: Names that need quotes, or that helper columns once had.
EXTRA |= dict.fromkeys(["a.b", "a`b c", "__id", "__drop", "__copies", "__copy", "__key", "__row", "row", "nth", "text_key", "leaf", "of_id"], "y")


@pytest.fixture(scope="session")
def doc_rows():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(doc_rows, SCHEMA).withColumns({k: F.lit(v) for k, v in EXTRA.items()}).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
