import random

import pytest
from prose_maker import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    """Nulls, empty and long texts, exact and near copies, repeated rows, ties."""
    rng = random.Random(5)
    texts = [None, "", " \n\t", "one", "a b c", "Ünïcode ñ wörds é", prose(rng, 9000)]
    texts += [prose(rng, rng.randint(5, 400)) for _ in range(60)]
    base = prose(rng, 300).split()
    for _ in range(25):
        own = list(base)
        own[rng.randrange(300)] = "changed"
        texts.append(" ".join(own))
    texts += [" ".join(base)] * 20
    texts += ["line one here\nline two\nline one here\n\n" + prose(rng, 60), "THE AND!! OF!! " * 40, "x ### y $$$ z " * 30]
    out = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return out + out[10:13]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def tables(spark, docs, tmp_path_factory):
    """A folder of tables as the queries read them."""
    top = tmp_path_factory.mktemp("tables")
    docs.coalesce(2).write.parquet(f"{top}/documents.parquet")
    texts = [r.text for r in docs.where("length(text) > 400").orderBy("doc_id").limit(6).collect()]
    bench = [(i, " ".join(t.split()[10:45])) for i, t in enumerate(texts)] + [(50, None), (51, ""), (52, "quite unseen words that no text here has in any order at all")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    labels = [(i, int(i % 4 != 0), 0) for i in range(0, 90, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
