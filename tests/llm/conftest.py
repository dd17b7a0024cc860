import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from texts import corpus  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    data = [(i, t, "xx", "s", len(t or ""), 1.5, "clash") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score double, fp string").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark, docs):
    return docs.limit(0)
