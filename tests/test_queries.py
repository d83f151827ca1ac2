"""Every registered query of the lake against its oracle, on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from memlake.plans.all_queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return round(float(v), 5) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[k]) for k in at) for r in cur.fetchall()), key=repr)


def test_entry_lists_everything():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_capitals_are_single_letters_as_in_sql(spark, tmp_path):
    texts = ["ßab", "  ßAB", "ŉa", "ﬁne", "ΐa", "ᾳa", "ΑΣ b ΑΣ", "İx aİ", "ẞa", "\x0bab", " \x0bab", "\t\n\f\r ab", " ab", "ǆa", "éa", "1a", "a\x00B", "", " ", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["scl21_capitalize"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == con.execute(ORACLES["scl21_capitalize"] + " ORDER BY doc_id").fetchall()
