"""The registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest.plans import queries as plans

SF = "/root/testdata/sf0.001"


def normal(value):
    return bytes(value).hex() if isinstance(value, (bytes, bytearray)) else round(value, 9) if isinstance(value, float) else value


def compared(spark, query, sql):
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    df, wanted = query(spark, SF), con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(wanted.columns)
    order = [wanted.columns.index(c) for c in columns]
    got = sorted(repr([normal(r[c]) for c in columns]) for r in df.collect())
    assert got == sorted(repr([normal(r[i]) for i in order]) for r in wanted.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    compared(spark, plans.QUERIES[name], plans.ORACLE_SQL[name])


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")
def test_entry_and_checksums(spark):
    import zlib

    assert {r.status for r in entry.entry(spark).collect()} == {0}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.image_id: r.crc32 for r in plans.image_crc32(spark, SF).collect()} == {k: zlib.crc32(t.encode()) for k, t in texts.items()}


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_candidates_come_from_all_orders(spark, tmp_path):
    orders, customers = [(k, 3 * k % 17) for k in (1, 199, 200, 201, 202, 500, 7499, 150_000, 600_000)], range(1, 31)
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(c,) for c in customers], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    wanted = sorted((c, o) for c in customers for o, b in orders if o % 5 == c % 5 and b % 2 == c % 2 and o % 11 > c % 2 + 3)
    assert max(o for _, o in wanted) > 200
    assert sorted(map(tuple, plans.device_candidates(spark, str(tmp_path)).collect())) == wanted
