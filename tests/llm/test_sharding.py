from collections import Counter, defaultdict
from math import comb

import numpy as np

from driftloom.llm.queries import op2_sharding
from driftloom.llm.sharding import communication_matrix, hypergeometric, shard_rows


def test_query(spark, tables, rows):
    out = op2_sharding(spark, tables).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    texts = {r[0]: r[1] for r in rows}
    shards = defaultdict(list)
    for r in out:
        shards[r.shard].append(r.slot)
        assert r.size == len((texts[r.doc_id] or "").encode()) + 8 and r.law == "rows" and r.grown_shard is None
    sizes = [len(shards[k]) for k in range(24)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([], "row long, block int, shard int, n string")
    assert shard_rows(df, 5).count() == 0
    some = spark.createDataFrame([(1, 2, 3, "a")] * 7, "row long, block int, bucket int, first string")
    out = shard_rows(some, 3)
    assert out.columns == ["row", "block", "bucket", "first", "shard", "slot"] and out.count() == 7


def test_names_of_its_own(spark):
    """Columns that bear the names this uses come back with their values."""
    names = ["__dl_row", "__DL_block", "___dl_rank", "__dl_ends", "__dl_bucket", "a.b", "id", "Slot"]
    df = spark.createDataFrame([tuple(f"{n}{i}" for n in names) for i in range(100)], names)
    out = shard_rows(df, 7)
    assert out.columns == [*names[:-1], "shard", "slot"]
    assert sorted(tuple(r)[:-2] for r in out.collect()) == sorted(tuple(r)[:-1] for r in df.collect())


def test_scratch_leaves_nothing(spark):
    import os
    import urllib.parse

    from driftloom.llm.common import OPEN, scratch

    with scratch(spark):
        assert shard_rows(spark.range(50), 3).count() == 50
        paths = [urllib.parse.urlparse(p).path for p in OPEN.get()]
        assert paths and all(os.path.isdir(p) for p in paths)
    assert not any(os.path.exists(p) for p in paths)


def test_matrix_sums_and_law():
    rows, cols = [5, 0, 7, 3], [4, 4, 4, 3]
    seen = Counter()
    for seed in range(4000):
        m = communication_matrix(rows, cols, seed)
        assert m.sum(1).tolist() == rows and m.sum(0).tolist() == cols
        seen[int(m[0, 0])] += 1
    for k in range(5):  # the first cell is hypergeometric: 4 of 15 are good, 5 drawn
        p = comb(4, k) * comb(11, 5 - k) / comb(15, 5)
        assert abs(seen[k] / 4000 - p) < 0.035


def test_large_populations():
    rng = np.random.default_rng(1)
    got = np.array([hypergeometric(rng, 10**10, 2 * 10**10, 3 * 10**9) for _ in range(40)])
    sd = (3e9 * (1 / 3) * (2 / 3) * 0.9) ** 0.5
    assert abs(got.mean() - 1e9) < 5 * sd / 40**0.5 and 0.5 * sd < got.std() < 1.7 * sd


def test_orders_are_uniform(spark):
    """Over many seeds each row is equally often in each shard."""
    df = spark.range(6).coalesce(1)
    hits = Counter()
    for seed in range(30):
        for r in shard_rows(df, 3, seed=seed * 1000, blocks=2).collect():
            hits[r.id, r.shard] += 1
    assert all(1 <= hits[i, s] <= 22 for i in range(6) for s in range(3))


def test_one_table_is_written(spark):
    """Only the numbered rows go to the shared folder, and shards and slots come out whole."""
    from driftloom.llm.common import OPEN, scratch

    with scratch(spark):
        rows = shard_rows(spark.range(0, 5000, 1, 7), 24).collect()
        assert len(OPEN.get()) == 1
    assert sorted(r.id for r in rows) == list(range(5000))
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) and len(v) in (208, 209) for v in shards.values())
