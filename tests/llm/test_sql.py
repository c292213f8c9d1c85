"""The base columns against another engine's SQL, on the fixture's texts and on tricky ones."""

from collections import Counter

import duckdb
import pytest
from test_scans import PERSONAL, TRICKY, noise

from driftloom.llm.queries import BASE, oracle_sql


@pytest.fixture(scope="module")
def more(spark, docs, tmp_path_factory):
    top = tmp_path_factory.mktemp("more")
    texts = TRICKY + PERSONAL + [noise(i) for i in range(40)] + ["a b c a b c\n\na b c\n \t\n$$ #", "x\x0by\x0cz"]
    extra = spark.createDataFrame([(1000 + i, t, "en", "s", 0) for i, t in enumerate(texts)], docs.schema)
    docs.unionByName(extra).coalesce(1).write.parquet(f"{top}/documents.parquet")
    return str(top)


@pytest.mark.parametrize("name", sorted(BASE))
def test_against_sql(spark, more, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{more}/documents.parquet/*.parquet'")
    got, expected = BASE[name](spark, more), con.execute(oracle_sql()[name])
    names = [c[0] for c in expected.description]
    assert names == got.columns
    assert Counter(map(tuple, got.collect())) == Counter(expected.fetchall())
