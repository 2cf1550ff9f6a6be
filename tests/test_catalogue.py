"""Every query of the catalogue against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from sievelake.plans import catalogue, oracles

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "array<int>": "INTEGER[]", "array<string>": "VARCHAR[]"}


def plain(x):
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    if name not in oracles.ORACLE_SQL:
        assert name == "merge_fuzzy" and got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    r = con.sql(oracles.ORACLE_SQL[name])
    at = {c: k for k, c in enumerate(r.columns)}
    assert sorted(at) == names
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == {c: str(t) for c, t in zip(r.columns, r.types)}
    assert got == sorted((tuple(plain(x[at[c]]) for c in names) for x in r.fetchall()), key=repr)


def test_numbers_do_not_gather(spark, monkeypatch):
    """The rows are stored by ranges of their order (that plan is looked at as it is stored), and stay in as many partitions."""
    from sievelake.functions import numbering

    plans, cut = [], numbering.cut
    monkeypatch.setattr(numbering, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    rows = catalogue.final_sort(spark, SF)
    assert len(plans) == 1 and "rangepartitioning" in plans[0] and "SinglePartition" not in plans[0]
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
