"""Near-duplicates by word shingles: rows of one group are linked by pairs whose shingle sets have Jaccard similarity 0.8 or more.

Candidates come by Golay-code fuzzy hashing.  Each of TABLES tables takes EXACT + FUZZY min-hashes of a set: the first ones are
the part free of error, EACH bits of each other one stand side by side in a 23-bit word.  A key is (table, part free of error,
one of the word's fuzzy Golay codes, 5.3 on average), so words of at most two differing bits always share one, words of three or
four in 0.6 of the cases.  A pair at similarity 0.8 shares a key with probability 0.99995, and more above (computed).
Verification: the exact similarity of the two sets.  A key's members are called a band.
First each set is tested once, against the least-ranked of all members of its bands (the rank is a hash): one test a set connects
a group of copies.  Then every band that isn't connected is cut into blocks of about ``BLOCK`` members and ``BLOCK_VALUES``
shingles, and each two blocks meet in one task, which tests the pairs of different components in their least common band: the
sizes of all intersections are a product of two 0-1 matrices, and only links that connect components leave the task.  So every
pair of a band is tested or connected.  Joins on bands broadcast or salt the keys that hold over a thousandth of the rows.  Sets
travel as 32-bit hashes: among 20,000 shingles a tenth of one is expected to be taken for another.

Equal sets meet first: all steps but the first and last run over distinct sets.  Nothing is collected.
Defined cases: null and empty texts have the empty set and are copies of each other; texts of fewer words than a shingle are
one shingle; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest, xxh64_intdigest

from driftloom.llm.common import bytes_of, column_of, join_hot, quoted, slices, written
from driftloom.llm.golay import BITS, fuzzy_keys
from driftloom.llm.simhash import components, least_of_groups, named_rows, row_key

TABLES, EXACT, FUZZY, EACH = 15, 2, 8, 3
BLOCK, BLOCK_VALUES, WIDE = 1024, 1 << 20, 4096
SENT = 1 << 20  # so many pairs may be broadcast
DRAW = np.random.default_rng(8)
HASHES = TABLES * (EXACT + FUZZY)
FACTORS = DRAW.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = DRAW.integers(0, 1 << 63, HASHES, dtype=np.uint64)
PLACES = np.arange(FUZZY, dtype=np.uint64) * np.uint64(EACH)
WORD = np.uint64((1 << BITS) - 1)


def shingles(raw: bytes, words: int) -> np.ndarray:
    """The sorted distinct XXH64 values of the word shingles of a UTF-8 text."""
    found = raw.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    last = ends[words - 1 :] or ends[-1:]
    digests = b"".join([xxh64_digest(joined[a : b - 1], 42) for a, b in zip([0, *ends[:-1]], last, strict=False)])
    return np.unique(np.frombuffer(digests, dtype=">u8").astype(np.uint64))


def codes(of: np.ndarray) -> np.ndarray:
    """For each table 64 bits: a hash of the table and its part free of error, and below it the 23-bit word."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(of), 2048):
        least = np.minimum(least, (of[at : at + 2048, None] * FACTORS + SHIFTS).min(axis=0))
    rows = least.reshape(TABLES, EXACT + FUZZY)
    free = np.array([xxh64_intdigest(r[:EXACT].tobytes(), k) for k, r in enumerate(rows)], dtype=np.uint64)
    bits = (rows[:, EXACT:] >> np.uint64(20)) & np.uint64((1 << EACH) - 1)  # a least value's high bits are zeros
    return free & ~WORD | (bits << PLACES).sum(axis=1, dtype=np.uint64) & WORD


def golay_keys(all_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, keys): the keys under which each code meets others."""
    rows, index = fuzzy_keys(all_codes & WORD)
    return rows, (all_codes[rows] >> np.uint64(BITS) << np.uint64(12)) | index.astype(np.uint64)


def banded(distinct: DataFrame) -> DataFrame:
    """(band, node): the keys of each set (own, codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                rows, keys = golay_keys(column_of(b, "codes").flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                own = column_of(b, "own").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(own[rows // TABLES])], names=["band", "node"])

    return distinct.select("own", "codes").mapInArrow(run, "band long, node long")


def marks(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """id, key (see row_key), own (a hash of the shingle set) and its codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(x, words) for x in bytes_of(b)]
            own = np.array([xxh64_intdigest(s.tobytes(), 1) for s in sets], dtype=np.uint64).view(np.int64)
            found = pa.array([codes(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([column_of(b, "id"), column_of(b, "key"), pa.array(own), found], names=["id", "key", "own", "codes"])

    rows = docs.select(quoted(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), quoted(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, key binary, own long, codes array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(own, s, m) with the shingle set and its size for each row (own, key) of ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = pa.array([np.unique(shingles(x, words).astype(np.uint32)).view(np.int32) for x in bytes_of(b)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([column_of(b, "own"), s, pa.compute.list_value_length(s).cast(pa.int64())], names=["own", "s", "m"])

    texts = docs.select(row_key(id_col, text_col).alias("key"), quoted(text_col).alias("text"))
    return texts.join(wanted, "key").dropDuplicates(["key"]).select("own", "text").mapInArrow(run, "own long, s array<int>, m long")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (node, x) whose sets' Jaccard similarity is at least ``least``, as (a, b).  A node x of many pairs is salted.
    Of at most SENT pairs the nodes are broadcast, so that no other sets are shuffled."""
    pairs = written(pairs)
    count = pairs.count()
    most = count // 1000 + 100
    if count <= SENT:
        ids = pairs.select(F.explode(F.array("node", "x")).alias("own")).distinct()
        sets = sets.join(F.broadcast(ids), "own", "left_semi")
    counts = pairs.groupBy("x").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / F.lit(most)).cast("int"))
    salted = join_hot(pairs, counts, "x", most).select("node", "x", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("salt"))
    centres = sets.select(F.col("own").alias("x"), F.col("s").alias("sx")).join(counts, "x").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("x", "salt", "sx")
    both = salted.join(sets.select(F.col("own").alias("node"), "s"), "node").join(centres, ["x", "salt"])
    common = both.select("node", "x", (F.size("s") + F.size("sx")).alias("n"), F.size(F.array_intersect("s", "sx")).alias("common"))
    return common.where(F.col("common") >= least * (F.col("n") - F.col("common")) - 1e-9).select(F.col("node").alias("a"), F.col("x").alias("b"))


def first_tests(left: DataFrame) -> DataFrame:
    """(node, x): each node with the least-ranked (by a hash, from 0 to 1) of the members of its bands."""
    ranked = left.withColumn("r", F.shiftrightunsigned(F.xxhash64("node", F.lit(0)), 1) / F.lit(float(1 << 63)))
    least = written(ranked.groupBy("band").agg(F.min(F.struct("r", F.col("node").alias("x"))).alias("c"), F.count("*").alias("n")))
    met = join_hot(left, least, "band", left.count() // 1000 + 100).where("node <> c.x")
    return met.groupBy("node").agg(F.min("c").alias("c")).select("node", "c.x")


def flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists and, for each, the place of its list."""
    lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), pa.compute.list_parent_indices(lists).to_numpy(zero_copy_only=False)


def overlaps(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """How many values each list of ``a`` shares with each of ``b`` (see flat): products of 0-1 matrices over the shared values."""
    seen, times = np.unique(np.concatenate([a[0], b[0]]), return_counts=True)
    shared, out = seen[times > (2 if a is b else 1)], np.zeros(shape)  # with itself every value counts twice
    cut = []
    for values, places in (a, b):
        at = np.minimum(np.searchsorted(shared, values), max(len(shared) - 1, 0))
        at, places = (x[shared[at] == values] if len(shared) else x[:0] for x in (at, places))
        order = np.argsort(at, kind="stable")
        cut.append((at[order], places[order]))
    for lo in range(0, len(shared), WIDE):
        side = []
        for (at, places), n in zip(cut, shape, strict=True):
            i, j = np.searchsorted(at, [lo, lo + WIDE])
            side.append(np.zeros((n, min(WIDE, len(shared) - lo)), np.float32))
            side[-1][places[i:j], at[i:j] - lo] = 1
        out += side[0] @ side[1].T
    return out


def linked(near: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Components of a bipartite graph given by its matrix: for each row and each column the least row of its component (of a
    column without links: the number of rows).  With ``same``, columns are the rows."""
    rows, columns = np.arange(near.shape[0]), np.full(near.shape[1], near.shape[0])
    while True:
        columns = np.minimum(columns, np.where(near, rows[:, None], near.shape[0]).min(axis=0, initial=near.shape[0]))
        if same:
            columns = np.minimum(columns, rows)
        least = np.minimum(rows, np.where(near, columns[None, :], near.shape[0]).min(axis=1, initial=near.shape[0]))
        if same:
            least = np.minimum(least, columns)
        if (least == rows).all():
            return rows, columns
        rows = least


def test_cell(cell: pa.Table, least: float) -> pa.Table:
    """Tests each pair of two blocks of one band (or of one block) that lies in different components and shares no lower band.
    Gives (a, b): links that connect what the pairs at ``least`` or more connect, fewer than members."""
    band, low, high = (cell.column(c)[0].as_py() for c in ("band", "low", "high"))
    same = low == high
    left = cell.filter(pa.compute.equal(cell.column("block"), low))
    right = left if same else cell.filter(pa.compute.equal(cell.column("block"), high))
    comp = [x.column("comp").to_numpy() for x in (left, right)]
    test = comp[0][:, None] != comp[1][None, :]
    if test.any():
        earlier = []
        for x in (left, right)[: 1 if same else 2]:
            values, places = flat(x.column("bands"))
            earlier.append((values[values < band], places[values < band]))
        test &= overlaps(earlier[0], earlier[-1], test.shape) == 0
    node = [x.column("node").to_numpy() for x in (left, right)]
    if not test.any():
        return pa.table({"a": node[0][:0], "b": node[0][:0]})
    sets = [flat(x.column("s")) for x in (left, right)[: 1 if same else 2]]
    sizes = [np.bincount(p, minlength=len(n)) for (_, p), n in zip((sets[0], sets[-1]), node, strict=True)]
    common = overlaps(sets[0], sets[-1], test.shape)
    near = test & (common >= least * (sizes[0][:, None] + sizes[1][None, :] - common) - 1e-9)
    of_rows, of_columns = linked(near, same)
    a, b = [node[0]], [node[0][of_rows]]
    if not same:
        met = of_columns < len(node[0])
        a, b = [*a, node[1][met]], [*b, node[0][of_columns[met]]]
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.table({"a": a[a != b], "b": b[a != b]})


def block_tests(left: DataFrame, roots: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links between the components ``roots``, from all pairs that share a band and lie in different ones."""
    known = written(left.join(roots, "node", "left").join(sets.select(F.col("own").alias("node"), "m"), "node").select("band", "node", "m", F.coalesce("root", "node").alias("comp")))
    stats = known.groupBy("band").agg(F.count("*").alias("n"), F.sum("m").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    parts = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("m") / BLOCK_VALUES)).cast("int")
    apart = written(stats.where("lo <> hi").select("band", "n", parts.alias("parts")))
    live = join_hot(known.drop("m"), apart, "band", known.count() // 1000 + 100)
    by_node = live.groupBy("node", "comp").agg(F.collect_list(F.struct("band", "parts")).alias("of"))  # at most 24 a table
    full = by_node.join(sets.select(F.col("own").alias("node"), "s"), "node").withColumn("bands", F.col("of.band"))
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    each = full.select("node", "comp", "s", "bands", F.explode("of").alias("o")).select("node", "comp", "s", "bands", "o.band", "o.parts")
    each = each.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = each.select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "comp", "bands", "s")
    return cells.groupBy("band", "low", "high").applyInArrow(lambda cell: test_cell(cell, least), "a long, b long")


def groups(left: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(node, root) for the sets that share a group with others; ``left`` has (band, node), bands of two nodes at least."""
    edges = written(similar(first_tests(left), sets, least))
    return components(edges.unionByName(written(block_tests(left, components(edges), sets, least))))


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """id, key, component_id: one row per document; the component is named by its smallest non-null id."""
    rows = written(marks(docs, id_col, text_col, words))
    distinct = written(rows.groupBy("own").agg(F.min("id").alias("least"), F.min("key").alias("key"), F.first("codes").alias("codes"), F.count("*").alias("n")))
    each = banded(distinct)
    left = written(each.join(each.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "band", "left_semi"))
    wanted = distinct.join(left.select(F.col("node").alias("own")).distinct(), "own", "left_semi").select("own", "key")
    roots = groups(left, written(sets_of(docs, wanted, id_col, text_col, words)), least)
    named = written(least_of_groups(distinct.select("own", "least", "n"), roots, "own"))
    return join_hot(rows.select("id", "key", "own"), named, "own", rows.count() // 1000 + 100).select("id", "key", "component_id")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row whose id names it."""
    return named_rows(docs, near_copies(docs, id_col=id_col, text_col=text_col, **options), id_col=id_col, text_col=text_col)
