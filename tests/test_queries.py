"""Every query with an oracle gives the rows its SQL gives."""

import glob
import os

import duckdb
import pytest

from lociweave.plans import registry


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in registry.ORACLES:
        assert got
        return
    db = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    said = db.execute(registry.ORACLES[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in said.fetchall()), key=repr)
    assert got == want
