import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from texts, with columns that clash with operators' own."""

    def make(texts, ids=None, **extra):
        rows = [(i if ids is None else ids[i], t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for k, v in extra.items():
            from pyspark.sql import functions as F

            df = df.withColumn(k, F.lit(v))
        return df

    return make


@pytest.fixture(scope="session")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
