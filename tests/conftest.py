import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    import os

    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """Checks a query's rows against its DuckDB SQL over the same tables."""
    import duckdb

    def norm(v):
        if v is None or v != v:
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    def run(sf_dir, query, sql):
        con = duckdb.connect()
        for path in Path(sf_dir).glob("*.parquet"):
            con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
        df = query(spark, sf_dir)
        cols = sorted(df.columns)
        got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
        answer = con.execute(sql)
        names = [d[0] for d in answer.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted(tuple(norm(r[i]) for i in at) for r in answer.fetchall())

    return run
