import itertools
import random
from collections import Counter

import numpy as np
from xxhash import xxh64_intdigest

from driftloom.llm import simhash
from driftloom.llm.golay import decode_table, fuzzy_keys
from driftloom.llm.queries import op8_simhash_golay
from driftloom.llm.simhash import components, forest, keys_of, links, near_duplicates


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks):
    """(id, fingerprint) rows -> id -> smallest id reachable over links of at most 4 bits."""
    fps = sorted({f for _, f in marks})
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            root[top(a)] = top(b)
    least = {}
    for i, f in marks:
        least[top(f)] = min(i, least.get(top(f), i))
    return {(i, f): least[top(f)] for i, f in marks}


def test_query_against_brute_force(spark, tables, rows):
    out = op8_simhash_golay(spark, tables).collect()
    marks = [(r[0], brute_fingerprint(r[1])) for r in rows]
    expected = brute_components(marks)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in out) == Counter((i, f"{f:016x}", expected[i, f]) for i, f in marks)


def test_no_text_links_to_null(spark):
    docs = spark.createDataFrame([(7, None), (3, ""), (None, " "), (5, "a b c d e")], "doc_id long, text string")
    got = {r.id: r.component_id for r in near_duplicates(docs).collect()}
    assert got == {7: 3, 3: 3, None: 3, 5: 5}


def test_empty(spark, empty):
    assert near_duplicates(empty).count() == 0


def test_golay():
    table = decode_table()
    assert np.bincount(table).tolist() == [2048] * 4096  # perfect
    rng = random.Random(3)
    for _ in range(500):
        w = rng.getrandbits(23)
        v = w ^ sum(1 << p for p in rng.sample(range(23), rng.randint(0, 2)))
        a, b = (set(fuzzy_keys(np.array([x]))[1].tolist()) for x in (w, v))
        assert a & b


def test_keys_meet_at_four_bits():
    rng = random.Random(4)
    for segments in (5, 6):
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 4)))
            a, b = (set(np.concatenate([k for _, k in keys_of(np.array([v], dtype=np.uint64), segments)]).tolist()) for v in (x, y))
            assert a & b


def chains(rng, count, length):
    out = []
    for _ in range(count):
        x = rng.getrandbits(64)
        for _ in range(length):
            out.append(x)
            x ^= sum(1 << p for p in rng.sample(range(64), rng.randint(1, 5)))
    return out


def test_links_connect_all(spark):
    """Also with blocks so small that keys overflow into them."""
    rng = random.Random(6)
    hub = rng.getrandbits(64)
    fps = chains(rng, 30, 6) + [hub ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(30), 2)]
    fps = list(dict.fromkeys(fps))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    distinct = spark.createDataFrame(signed, "fp long")
    expected = brute_components([(f, f) for f in fps])
    for block_rows in (20_000, 40):
        roots = {r.node % (1 << 64): r.root for r in components(links(distinct, block_rows=block_rows)).collect()}
        groups = Counter()
        for f in fps:
            groups[expected[f, f], roots.get(f, f - (1 << 64) if f >> 63 else f)] += 1
        assert len(groups) == len(set(expected.values()))


def test_memory_of_whole_keys():
    """Keys are worked on as they end: no more than a chunk and a key are held, and each row is copied a few times."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    key = np.sort(rng.integers(0, 4000, 200_000))
    fp = rng.integers(0, 1 << 60, 200_000, dtype=np.uint64)
    read = []

    def batches():
        for i in range(0, 200_000, 1000):
            read.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(key[i : i + 1000]), pa.array(fp[i : i + 1000].view(np.int64))], names=["key", "fp"])

    def marked(it):
        for _ in it:
            yield len(read)

    planted = np.flatnonzero(key[1:] == key[:-1])[::50]
    fp[planted + 1] = fp[planted] ^ np.uint64(5)
    at = list(marked(simhash.link_rows(batches(), None, chunk=5000)))
    assert at[0] <= 6 and len(at) > 30
    got = {tuple(sorted(p)) for b in simhash.link_rows(batches(), None, chunk=5000) for p in zip(*(b.column(i).to_numpy().view(np.uint64).tolist() for i in (0, 1)), strict=True)}
    assert {tuple(sorted((int(fp[i]), int(fp[i + 1])))) for i in planted if (int(fp[i]) ^ int(fp[i + 1])).bit_count() <= 4} <= got


def test_segments_grow():
    assert [simhash.segments_for(n) for n in (10, 10**8, 10**9, 10**11)] == [5, 5, 6, 7]


def test_hot_hub(spark):
    """A node with most of the edges is a hot key of every join."""
    hub, n = 5000, 12000
    edges = [(hub, i) for i in range(n) if i != hub] + [(n + 1, n + 2), (n + 2, n + 3), (n + 5, n + 4)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, n)} | {n + 2: n + 1, n + 3: n + 1, n + 5: n + 4}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_columns_with_its_own_names(spark):
    df = spark.createDataFrame([(1, "a b c", 5, "x"), (1, "a b c", 5, "x"), (2, "d e f", 7, "y")], "doc_id long, text string, __dl_key int, `key.fp` string")
    out = simhash.one_of_each(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == [(1, "a b c", 5, "x"), (2, "d e f", 7, "y")]


def test_forest_is_linear():
    x = np.uint64(0x123456789ABCDEF)
    near = np.unique(np.array([x ^ np.uint64(1 << a) ^ np.uint64(1 << b) for a in range(64) for b in range(a)]))
    a, b = forest(near)
    assert sum(map(len, b)) == len(near) - 1


def test_runs_across_batches():
    import pyarrow as pa

    rng = random.Random(8)
    key = np.sort(np.array([rng.randrange(40) for _ in range(3000)]))
    fp = np.array([rng.getrandbits(6) for _ in range(3000)], dtype=np.uint64)
    batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + 70]), pa.array(fp[i : i + 70].view(np.int64))], names=["key", "fp"]) for i in range(0, 3000, 70)]
    passed = list(simhash.link_rows(iter(batches), 60, chunk=100))
    over = sum(b.num_rows for b in passed if b.num_rows and b.column(2)[0].as_py() == 1)
    sizes = Counter(key.tolist())
    assert over == sum(n for n in sizes.values() if n > 60)
