"""Every registered query against its SQL, over the smallest whole tables."""

import glob
import math
import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(round(float(v), 6) + 0.0)
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_all_queries(spark):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    sqls = contract.oracle_sql()

    def check(item):
        name, job = item
        df = job(spark, SF)
        cols = sorted(df.columns)
        mine = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
        if name not in sqls:
            return None if mine else f"{name}: no rows"
        cur = con.cursor().execute(sqls[name])
        names = [d[0] for d in cur.description]
        if sorted(names) != cols:
            return f"{name}: columns {cols} and {sorted(names)}"
        theirs = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
        return None if mine == theirs else f"{name}: {len(mine)} rows and {len(theirs)}"

    # the corpus queries have tests of their own in tests/llm
    mine = {k: v for k, v in contract.queries().items() if not k.startswith("op") and k != "pipeline"}
    with ThreadPoolExecutor(4) as pool:
        wrong = [w for w in pool.map(check, mine.items()) if w]
    assert not wrong, wrong


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() >= 0 and "legs" in df.columns


def test_inventory_is_complete():
    families = {"s": 13, "n": 13, "r": 8, "b": 8, "a": 19, "k": 8, "q": 6, "p": 12, "h": 12, "f": 11, "m": 11, "d": 20, "t": 10, "o": 6}
    have = {name.split("_")[0] for name in contract.queries()}
    assert not [f"{f}{i:02}" for f, n in families.items() for i in range(1, n + 1) if f"{f}{i:02}" not in have]
