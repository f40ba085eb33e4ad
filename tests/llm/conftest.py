import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]); missing parts are NULL."""
    def make(*rows):
        return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCS)
    return make


@pytest.fixture(scope="session")
def clashing():
    """Columns whose names operators use inside, added to a table."""
    from pyspark.sql import functions as F

    def add(df):
        for name in ("a", "b", "n", "key", "band", "sig", "node", "size", "score", "cell", "codes", "t", "v", "path", "host", "prefix", "component", "h1", "quality"):
            if name not in df.columns:
                df = df.withColumn(name, F.lit(7))
        return df
    return add
