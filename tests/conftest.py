import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from plinth import session  # noqa: E402

#: Made when tests are collected, so that modules can hold column expressions.
SPARK = session.build("local[4]", 4, "3g")


@pytest.fixture(scope="session")
def spark():
    return SPARK


@pytest.fixture
def value(spark):
    """The value of a column expression, alone or over one text."""
    from pyspark.sql import functions as F

    def one(expression, text="__none__"):
        df = spark.range(1) if text == "__none__" else spark.createDataFrame([(text,)], "x string")
        column = expression if text == "__none__" else expression(F.col("x"))
        return df.select(column.alias("v")).first().v

    return one
