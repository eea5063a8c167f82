import duckdb
import pytest

from wavemill.plans import registry
from wavemill.plans.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return None if v is None else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", registry.QUERIES)
def test_matches_duckdb(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    got = db.execute(registry.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    theirs = sorted((tuple(plain(v) for v in r) for r in got.fetchall()), key=key)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key)
    assert ours == theirs
