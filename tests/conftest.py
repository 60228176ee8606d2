import os
import sys
import tempfile
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    with tempfile.TemporaryDirectory() as shared:
        session = (
            SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
            .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", shared).config("spark.driver.memory", "4g").getOrCreate()
        )
        session.sparkContext.setLogLevel("ERROR")
        yield session
        session.stop()


@pytest.fixture(scope="session")
def sf():
    return DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows_of(df) -> list[tuple]:
    """Values as text, columns by name, rows sorted."""
    columns = sorted(df.columns)
    table = df.select(*columns).toArrow() if hasattr(df, "toArrow") else df.select(", ".join(f'"{c}"' for c in columns)).to_arrow_table()
    return sorted(tuple("null" if v is None else str(v) for v in row.values()) for row in table.to_pylist())


@pytest.fixture(scope="session")
def same():
    def check(df, relation):
        assert sorted(df.columns) == sorted(relation.columns)
        assert rows_of(df) == rows_of(relation)

    return check
