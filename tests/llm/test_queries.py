import duckdb
import pytest

import corpus_pipeline
from wavemill.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", registry.ORACLES)
def test_matches_duckdb(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = c.execute(registry.ORACLES[name])
    names = [d[0] for d in got.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(str, got.fetchall()))


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "scores"] and out.count() > 0
    assert out.where("size(scores) = 0 or scores[0] <> 0").count() == 0
