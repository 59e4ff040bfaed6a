"""Every query of the catalogue against its SQL in DuckDB."""

import math

import duckdb
import pandas as pd
import pytest

from cairn.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df):
    def text(x):
        if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x):
            return "~"
        if isinstance(x, bool) or type(x).__name__ in ("bool_", "bool"):
            return str(bool(x))
        try:
            return f"{float(x):.8g}" if not isinstance(x, str) else x
        except (TypeError, ValueError):
            return str(x)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, DATA).toPandas()
    assert len(found)
    if name in catalog.SQL:
        assert normal(found) == normal(duck.sql(catalog.SQL[name]).df())


def test_partitioning_changes_nothing(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        results = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append([normal(catalog.QUERIES[q](spark, DATA).toPandas()) for q in ("training_prep", "lineage_split", "phase_mix", "permute")])
        assert results[0] == results[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
