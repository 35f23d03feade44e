"""Tables of awkward rows."""

from __future__ import annotations

import pytest
from awkward_rows import CLASHING, COLUMNS, rows


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.createDataFrame(rows(), COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def clashing(spark, corpus):
    from pyspark.sql import functions as F

    return corpus.withColumns({c: F.lit("theirs") for c in CLASHING})
