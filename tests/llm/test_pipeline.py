from collections import Counter

import corpus_pipeline
from driftloom.llm.simhash import one_of_each
from test_neardup import first_of_each
from test_packing import check
from test_filters import brute_counts
from driftloom.llm import cascade


def test_stages_against_brute_force(spark, tables, rows):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "pii_sanitisation", "packing"]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    quality = corpus_pipeline.quality_rules(spark, docs, tables)
    expected = [r for r in rows if not any(f(cascade.Text((r[1] or "").encode())) for f in cascade.RULES.values())]
    assert quality.columns == columns and Counter(tuple(r) for r in quality.collect()) == Counter(expected)
    assert all(brute_counts(r[1])[0] >= 50 for r in expected)

    names = first_of_each(expected)
    once = {r for r in expected if r[0] in names}
    dedup = corpus_pipeline.near_dedup(spark, spark.createDataFrame(expected, docs.schema), tables)
    assert dedup.columns == columns and Counter(tuple(r) for r in dedup.collect()) == Counter(once)

    clean = corpus_pipeline.decontamination(spark, spark.createDataFrame(sorted(once), docs.schema), tables)
    items = [r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect() if r.text]
    left = [tuple(r) for r in clean.collect()]
    assert clean.columns == columns and 0 < len(left) < len(once)
    assert all(r in left for r in once if not any(i in r[1] for i in items)) and not any(i in r[1] for r in left for i in items)

    private = corpus_pipeline.pii_sanitisation(spark, clean, tables)
    assert private.columns == columns and all(r.n_chars == len(r.text) for r in private.collect())


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    docs = corpus_pipeline.pii_sanitisation(spark, corpus_pipeline.decontamination(spark, corpus_pipeline.near_dedup(spark, corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{tables}/documents.parquet"), tables), tables), tables), tables)
    check(out.collect(), {r.doc_id: r.text for r in docs.collect()}, digest=False)


def test_empty_and_extra_columns(spark, empty):
    assert one_of_each(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c", 5, 6), (1, "a b c", 5, 6), (2, "a b c", 7, 8), (None, "x y z", 1, 1)], "doc_id long, text string, key int, fp int")
    assert sorted((r.doc_id or 0, r.key) for r in one_of_each(df).collect()) == [(0, 1), (1, 5)]


CLASHING = "kept int, spans string, `a.b` int, key string, own int, __dl_kept int, __dl_spans string, __dl_key string, bands int, item_id long, score string"


def test_every_stage_keeps_extra_columns(spark, tables, rows):
    """Names that the operators use, with values that come back as they were; and each stage on an empty table."""
    fields = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING
    extra = lambda i: (7, f"s{i}", i, "k", 5, 3, "x", "y", 1, i, "z")
    docs = spark.createDataFrame([(*r, *extra(r[0])) for r in rows], fields)
    empty = spark.createDataFrame([], fields)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert got and all(tuple(r)[5:] == extra(r[0]) for r in got), name
        assert stage(spark, empty, tables).collect() == [], name
    assert corpus_pipeline.packing(spark, empty, tables).collect() == []
    assert len({r.doc_id for r in corpus_pipeline.packing(spark, docs, tables).collect()}) == len({r[0] for r in rows})
