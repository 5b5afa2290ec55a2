import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(pdf):
    """Column names and rows in text; whole numbers are equal whether or not a column's nulls have made them floats."""
    names = sorted(pdf.columns)
    found = pdf[names].astype(object).where(pdf[names].notna(), None).values.tolist()
    return names, sorted(repr([int(x) if isinstance(x, float) and x.is_integer() else x for x in r]) for r in found)


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(f, sql):
        assert rows(f(spark, SF).toPandas()) == rows(duck.sql(sql).df())

    return check
