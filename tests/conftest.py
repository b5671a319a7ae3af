import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from foliomill.session import _importable_by_workers

    _importable_by_workers(s)
    yield s
    s.stop()


DATA = Path("/root/testdata/sf0.001")


def same_as_oracle(spark, name, queries, oracles):
    """Runs a query and its SQL over the smallest tables and compares the rows."""
    import duckdb
    import numpy as np

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")

    def plain(x):
        if isinstance(x, (list, tuple, np.ndarray)):
            return "[" + ",".join(map(plain, x)) + "]"
        if x is None or isinstance(x, float) and x != x:
            return "null"
        if isinstance(x, (float, np.floating)):
            return f"{float(x):.6g}"
        return str(x).lower() if isinstance(x, (bool, np.bool_)) else str(x)

    def rows(df):
        return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))

    a, b = queries[name](spark, str(DATA)).toPandas(), con.execute(oracles[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
