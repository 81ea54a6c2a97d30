"""Every library query against its DuckDB SQL on the smallest tables, value by value."""

import datetime
import decimal
import math

import duckdb
import pytest

from rostrum.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in catalogue.ORACLES:
        assert columns
        return
    answer = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in answer.fetchall())


def test_fuzzy_block_join(spark, tmp_path):
    """Customers of any key, hot names among them, against brute force."""
    from collections import Counter

    names = ["cab", "kab", "dab", "cxyz", "cxyz", "ccd", "kxy", "", "stuvw", "stuvx"] + ["cold"] * 300 + ["kold", "c7777", "mnopq", "mnopq"]
    rows = [(k * 37, n, k % 2 if len(n) < 4 else 1) for k, n in enumerate(names)] + [(100_000 + k, f"name{k * k * 1001}", 3) for k in range(40)]
    spark.createDataFrame([(*r, 0.0, "") for r in rows], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    other = [(k, n.replace("c", "k"), z) for k, n, z in rows]
    near = [(a, b, d) for a, n, z in rows for b, m, y in other if z == y and abs(len(n) - len(m)) < 2 and (d := far(n, m)) <= 1]
    left, right = Counter(a for a, _, _ in near), Counter(b for _, b, _ in near)
    want = sorted(x for x in near if left[x[0]] == 1 and right[x[1]] == 1)
    assert len(want) > 20
    got = catalogue.QUERIES["fuzzy_block_join"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
