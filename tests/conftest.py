import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "nodes edges files source_texts unresolved_refs removed_nodes transcript_entries members documents eval_items events".split()


@pytest.fixture(scope="session")
def spark():
    from arborweft.session import local_session

    s = local_session("4", memory="6g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


def write_all(spark, tmp, change):
    """A copy of the data set with `change(name, df)` applied to each table."""
    for t in TABLES:
        change(t, spark.read.parquet(f"{DATA}/{t}.parquet")).coalesce(1).write.mode("overwrite").parquet(f"{tmp}/{t}.parquet")
    return str(tmp)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    return write_all(spark, tmp_path_factory.mktemp("empty"), lambda _, df: df.limit(0))


@pytest.fixture(scope="session")
def dirty_dir(spark, tmp_path_factory):
    """Every row twice, a row of nulls, and extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    def change(_, df):
        null = spark.createDataFrame([tuple(None for _ in df.columns)], df.schema)
        out = df.union(df).union(null)
        for c in ("key", "x", "use", "part", "n", "v", "comp", "at", "label", "edge_kind", "rank", "seq"):
            if c not in out.columns:
                out = out.withColumn(c, F.lit("clash"))
        return out

    return write_all(spark, tmp_path_factory.mktemp("dirty"), change)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))
