"""Every query with SQL against it on the smallest tables; the others must run."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def db(small):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in sorted(Path(small).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_names_agree():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, db, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = Counter(tuple(repr(plain(r[c])) for c in cols) for r in df.collect())
    if name in SQL:
        r = db.execute(SQL[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        want = Counter(tuple(repr(plain(x[i])) for i in at) for x in r.fetchall())
        assert got == want


def test_entry(spark, small):
    assert entry.entry(spark).columns == ["src_table", "ref_field", "src_seq", "orphan_kind", "ref_month"]
