from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from texts or (id, text) pairs, with columns whose names clash with those of the operators."""

    def build(*texts, clash: bool = False):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", f"src{k % 5}", None if t is None else len(t)) for k, (i, t) in enumerate(pairs)]
        df = spark.createDataFrame(rows, DOCUMENTS)
        if clash:
            from pyspark.sql import functions as F

            for name in ("id", "key", "label", "n", "kept", "spans", "score", "text_key", "component", "node", "body"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return build


@pytest.fixture
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


