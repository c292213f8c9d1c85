import itertools
import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from prose_maker import prose
from driftloom.llm import cascade, neardup
from driftloom.llm.neardup import near_copies


def shingle_set(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def first_of_each(rows):
    """Ids that name a group of rows linked at Jaccard 0.8, by brute force."""
    sets, root = {r[0]: shingle_set(r[1]) for r in rows}, {r[0]: r[0] for r in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if jaccard(sets[a], sets[b]) >= 0.8:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i for i in root if top(i) == i}


def planted(copies=40):
    """Pairs of a text and a copy with words changed, at similarities 0.7 to 0.95, and a group of 40 copies of one text."""
    rng, rows, wanted = random.Random(11), [], []
    for k in range(60):
        words = prose(rng, 300).split()
        own = list(words)
        for p in rng.sample(range(300), 1 + k % 12):
            own[p] = f"changed{p}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(own))]
        wanted.append(jaccard(shingle_set(rows[-2][1]), shingle_set(rows[-1][1])))
    base = prose(rng, 300).split()
    for k in range(copies):
        own = list(base)
        for p in rng.sample(range(300), 4):
            own[p] = f"other{k}x{p}"
        rows.append((1000 + k, " ".join(own)))
    return rows, wanted


def test_planted_copies(spark, tables):
    rows, similarity = planted()
    assert sum(0.8 <= s < 0.9 for s in similarity) > 10 and sum(s >= 0.9 for s in similarity) > 10 and sum(s < 0.8 for s in similarity) > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, tables).collect()}
    assert left == first_of_each(rows)


def test_stage_on_the_tables(spark, tables, rows):
    kept = [r for r in rows if not any(f(cascade.Text((r[1] or "").encode())) for f in cascade.RULES.values())]
    docs = spark.createDataFrame(kept, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, tables).collect()) == sorted(first_of_each(kept))


def test_defined_cases(spark):
    docs = spark.createDataFrame([(7, None), (3, ""), (None, " "), (5, "a b c"), (6, "A  B C"), (9, "a b d")], "doc_id long, text string")
    assert {(r.id, r.component_id) for r in near_copies(docs).collect()} == {(7, 3), (3, 3), (None, 3), (5, 5), (6, 5), (9, 9)}
    assert near_copies(docs.where("doc_id > 99")).count() == 0


@pytest.mark.parametrize("wide", [3, 4096])
def test_overlaps(monkeypatch, wide):
    monkeypatch.setattr(neardup, "WIDE", wide)
    rng = random.Random(wide)
    lists = [[rng.sample(range(40), rng.randint(0, 20)) for _ in range(n)] for n in (7, 5)]
    a, b = (neardup.flat(pa.chunked_array([pa.array(x, pa.list_(pa.int32()))])) for x in lists)
    wanted = lambda x, y: [[len(set(i) & set(j)) for j in y] for i in x]
    assert neardup.overlaps(a, b, (7, 5)).tolist() == wanted(*lists)
    own = neardup.overlaps(a, a, (7, 7))  # the diagonal is not asked for
    assert all(own[i, j] == wanted(lists[0], lists[0])[i][j] for i in range(7) for j in range(7) if i != j)
    none = neardup.flat(pa.chunked_array([pa.array([[], []], pa.list_(pa.int32()))]))
    assert neardup.overlaps(none, b, (2, 5)).tolist() == [[0] * 5] * 2


def test_linked():
    rng = np.random.default_rng(3)
    for _ in range(50):
        near = rng.random((6, 4)) < 0.2
        rows, columns = neardup.linked(near, False)
        root = list(range(10))
        for i, j in zip(*np.nonzero(near)):
            x, y = sorted((root[i], root[6 + j]))
            root = [x if r == y else r for r in root]
        assert rows.tolist() == root[:6] and all(c == (r if r < 6 else 6) for c, r in zip(columns, root[6:]))
    chain = np.eye(5, k=1, dtype=bool)
    assert neardup.linked(chain | chain.T, True)[0].tolist() == [0] * 5


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_group_just_below_the_threshold(spark, monkeypatch, block):
    """300 variants of one text, most pairs below 0.8, in one block or many: the groups of brute force."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(block)
    base, rows = prose(rng, 150).split(), []
    for k in range(40 if block == 1 else 300):
        own = list(base)
        for p in rng.sample(range(150), rng.randint(1, 5)):
            own[p] = f"other{rng.randrange(3)}x{p}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.id for r in near_copies(docs).collect() if r.id == r.component_id}
    assert found == first_of_each(rows) and len(found) > 1


def test_candidates_by_golay_keys():
    """Words of two wrong bits meet under a Golay key; sets at similarity 0.8 share a key, sets without common values none."""
    from driftloom.llm import golay

    rng = np.random.default_rng(2)
    own = neardup.codes(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    wrong = np.array([sum(1 << int(p) for p in rng.choice(golay.BITS, 2, replace=False)) for _ in own], dtype=np.uint64)
    both = [neardup.golay_keys(x) for x in (own, own ^ wrong)]
    assert all(set(both[0][1][both[0][0] == i]) & set(both[1][1][both[1][0] == i]) for i in range(len(own)))
    missed = met = 0
    for _ in range(600):
        x = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        alike = np.concatenate([x[20:], rng.integers(0, 1 << 63, 20, dtype=np.uint64)])  # 180 of 220: 0.818
        other = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        keys = [set(neardup.golay_keys(neardup.codes(s))[1]) for s in (x, alike, other)]
        missed += not keys[0] & keys[1]
        met += bool(keys[0] & keys[2])
    assert missed == 0 and met <= 1
