import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from callboard import session  # noqa: E402
from callboard.sources import working  # noqa: E402

SMALL = "/root/testdata/sf0.001"
ORACLE_FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    spark = session.build("callboard-tests", 8)
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="callboard-tests-"))
    yield spark
    working.release(spark)
    spark.stop()


@pytest.fixture(scope="session")
def seed(spark):
    import seed as rows

    return rows.tables(spark)


@pytest.fixture
def make(spark):
    """Frame from rows and a DDL schema; text is cast, so dates and decimals stay readable."""

    def build(rows, schema):
        from pyspark.sql import functions as F
        from pyspark.sql import types as T

        kinds = T.StructType.fromDDL(schema)
        loose = T.StructType(
            [
                f if isinstance(f.dataType, (T.BooleanType, T.IntegerType, T.LongType)) else T.StructField(f.name, T.StringType())
                for f in kinds
            ]
        )
        texts = [tuple(v if v is None or isinstance(v, (bool, int)) and not isinstance(t.dataType, T.StringType) else str(v)
                       for v, t in zip(row, loose)) for row in rows]
        frame = spark.createDataFrame(texts, loose)
        return frame.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds])

    return build


def rows(df, *columns):
    """Rows as a sorted list of tuples, numbers and dates as text."""
    picked = df.select(*columns) if columns else df
    return sorted(
        (tuple(None if v is None else v if isinstance(v, (bool, int)) else str(v) for v in r) for r in picked.collect()),
        key=repr,
    )
