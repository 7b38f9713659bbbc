import os
import sys
from pathlib import Path

import pandas
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = Path(os.environ.get("TEST_DATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}").config("spark.sql.warehouse.dir", f"{shared}/warehouse").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def medium():
    return str(DATA / "sf0.01")


def rows_of(frame):
    """Rows as tuples in column-name order, sorted; floats to 9 significant digits."""
    cols = sorted(frame.columns)

    def plain(v):
        if v is pandas.NA:
            return None
        if isinstance(v, float):  # whole numbers beside nulls come as floats
            return None if v != v else int(v) if v.is_integer() and abs(v) < 1e9 else float(f"{v:.9g}")
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return tuple(plain(x) for x in v)
        return None if v is None or v != v else v

    return cols, sorted((tuple(plain(v) for v in r) for r in frame[cols].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Checks a query against its DuckDB counterpart on a folder of tables."""
    import duckdb

    def check(query, sql, folder):
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for p in Path(folder).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
        cols, want = rows_of(con.execute(sql).df().astype(object))
        got_cols, got = rows_of(query(spark, folder).toPandas().astype(object))
        assert got_cols == cols
        assert want, "the SQL finds nothing, so nothing is compared"
        assert got == want

    return check
