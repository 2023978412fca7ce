import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def same(spark, small, duck):
    """Holds a registered query against its SQL."""

    def rows(cols, data):
        return sorted((tuple(repr(r[c].tolist() if hasattr(r[c], "tolist") else r[c]) for c in cols) for r in data))

    def check(query, sql):
        df = query(spark, small)
        cols = sorted(df.columns)
        got = [r.asDict() for r in df.collect()]
        cur = duck.execute(sql)
        names = [d[0] for d in cur.description]
        want = [dict(zip(names, r)) for r in cur.fetchall()]
        assert cols == sorted(names)
        assert rows(cols, got) == rows(cols, want)
        return got

    return check
