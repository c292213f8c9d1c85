"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints: 64 bits, a bit being set if it is set in over half of the XXH64 values of the text's word shingles.
Candidates: the 64 bits are cut into ``segments``.  Of 4 errors at most 4 segments are touched, so segments - 4 of them are
free of error (every choice is tried); the bits of the other segments are cut into two halves of at most 23 bits, of which
one has at most 2 errors, and its fuzzy Golay keys meet.  A key is (choice, half, error-free bits, codeword index): 25 bits
with 5 segments, 32 with 6, 39 with 7.  The number of distinct fingerprints sets the number of segments; all are exact.
Verification: fingerprints of one key are compared by Hamming distance; only a spanning forest of the links goes on, so
output is linear in the group's size.  A key with more than ``block_rows`` distinct fingerprints is cut into blocks that
are compared pair by pair in separate tasks.  Components: alternating large-star and small-star rounds over written tables.

Copies meet first: all steps but the first and last run over distinct fingerprints.  Nothing is collected.  Joins on
fingerprints, nodes and roots broadcast the keys that hold over a thousandth of the rows, of which there are a thousand at most.
Defined cases: null and empty texts have fingerprint zero and link like any other; texts of fewer words than a shingle are
one shingle; equal rows fall in one component; a component's id is the smallest non-null id in it; an empty table gives
no rows; columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from driftloom.llm.common import bytes_of, column_of, dropped, join_hot, quoted, slices, unused, written
from driftloom.llm.golay import BITS, fuzzy_keys

MAX_BITS = 4
ZERO = 0


def fingerprint(raw: bytes, shingle: int) -> int:
    """Unsigned 64-bit fingerprint of a UTF-8 text; A-Z count as a-z."""
    words = raw.lower().split()
    if not words:
        return ZERO
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    last = ends[shingle - 1 :] or ends[-1:]
    digests = b"".join([xxh64_digest(joined[a : b - 1], 42) for a, b in zip(starts, last, strict=False)])
    bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8)).reshape(-1, 64)
    n = len(bits)
    count = np.zeros(64, dtype=np.int64)
    whole = n // 255 * 255
    if whole:
        count += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    count += np.add.reduce(bits[whole:], axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """A 128-bit key of a row's id and text; null differs from empty."""
    whole = F.concat_ws("\0", F.coalesce(quoted(id_col).cast("string"), F.lit("null")), F.when(quoted(text_col).isNull(), "n").otherwise("t"), quoted(text_col))
    return F.unhex(F.md5(whole.cast("binary")))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """id, key (see row_key) and fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.fromiter((fingerprint(x, shingle) for x in bytes_of(b)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([column_of(b, "id"), column_of(b, "key"), pa.array(fp.view(np.int64))], names=["id", "key", "fp"])

    rows = docs.select(quoted(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), quoted(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, key binary, fp long")


def layout(segments: int) -> list[tuple[list[int], list[int], list[int]]]:
    """For each choice of error-free segments: their bits, and the bits of the two halves of the rest."""
    cuts = [64 * i // segments for i in range(segments + 1)]
    out = []
    for free in combinations(range(segments), segments - MAX_BITS):
        own = [p for s in free for p in range(cuts[s], cuts[s + 1])]
        rest = [p for p in range(64) if p not in own]
        half = len(rest) // 2
        out.append((own, rest[:half][:BITS], rest[half:][:BITS]))
    return out


def gathered(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits side by side; runs of neighbouring bits move together."""
    out, at, i = np.zeros_like(fp), 0, 0
    while i < len(bits):
        j = i
        while j + 1 < len(bits) and bits[j + 1] == bits[j] + 1:
            j += 1
        width = j - i + 1
        out |= ((fp >> np.uint64(bits[i])) & np.uint64((1 << width) - 1)) << np.uint64(at)
        at, i = at + width, j + 1
    return out


def keys_of(fp: np.ndarray, segments: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, keys) for each choice and half."""
    for k, (own, *halves) in enumerate(layout(segments)):
        exact = gathered(fp, own)
        for h, half in enumerate(halves):
            rows, index = fuzzy_keys(gathered(fp, half))
            yield rows, (((np.uint64(2 * k + h) << np.uint64(len(own))) | exact[rows]) << np.uint64(12)) | index.astype(np.uint64)


def forest(fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Breadth first: links that connect what is connected at MAX_BITS; each found fingerprint leaves the search."""
    ends: tuple[list, list] = ([], [])
    left = fp
    while left.size > 1:
        stack, left = [left[0]], left[1:]
        while stack and left.size:
            p = stack.pop()
            near = np.bitwise_count(left ^ p) <= MAX_BITS
            if near.any():
                found = left[near]
                ends[0].append(np.full(found.size, p))
                ends[1].append(found)
                left = left[~near]
                stack.extend(found)
    return ends


def group_links(key: np.ndarray, fp: np.ndarray, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys: short runs by shifted comparison, long ones by forest()."""
    n = len(key)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    for s, m in zip(starts[sizes > small], sizes[sizes > small], strict=True):
        x, y = forest(np.unique(fp[s : s + m]))
        a += x
        b += y
    after = np.repeat(starts + sizes, sizes) - np.arange(n) - 1  # rows of the run that follow
    rows = np.flatnonzero((after > 0) & (np.repeat(sizes, sizes) <= small))
    shift = 1
    while rows.size:
        x, y = fp[rows], fp[rows + shift]
        near = np.bitwise_count(x ^ y) <= MAX_BITS
        a.append(x[near])
        b.append(y[near])
        shift += 1
        rows = rows[after[rows] >= shift]
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    x, y = np.concatenate(a), np.concatenate(b)
    low, high = np.minimum(x, y), np.maximum(x, y)
    pairs = np.unique(np.stack([low, high]), axis=1) if low.size else np.zeros((2, 0), np.uint64)
    return pairs[0], pairs[1]


def link_rows(batches: Iterator[pa.RecordBatch], block_rows: int | None, chunk: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key -> links (a, b, kind 0); a key of over ``block_rows`` rows passes through (key, fp, kind 1),
    or is worked on whole if that is None.  About ``chunk`` rows or one key's are held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, most = 0, chunk if block_rows is None else max(chunk, block_rows)
    over: int | None = None

    def rows(a: np.ndarray, b: np.ndarray, kind: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), kind, np.int32))], names=["a", "b", "kind"])

    def work(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = group_links(k, f)
        if len(a):
            yield rows(a, b, 0)

    for batch in batches:
        k = column_of(batch, "key").to_numpy(zero_copy_only=False)
        f = column_of(batch, "fp").to_numpy(zero_copy_only=False).view(np.uint64)
        if over is not None:
            same = int(np.searchsorted(k, over, side="right")) if len(k) and k[0] == over else 0
            if same:
                yield rows(k[:same], f[:same], 1)
                k, f = k[same:], f[same:]
            if len(k):
                over = None
        held.append((k, f))
        size += len(k)
        if size < most:
            continue
        k, f = (np.concatenate(x) for x in zip(*held, strict=True))
        last = int(np.searchsorted(k, k[-1], side="left"))
        yield from work_bounded(k[:last], f[:last], block_rows, rows, work)
        held, size = [(k[last:], f[last:])], len(k) - last
        if block_rows is not None and size > block_rows:
            over = int(k[-1])
            yield rows(k[last:], f[last:], 1)
            held, size = [], 0
        most = max(most, 2 * size) if block_rows is None else most  # one long key is not joined to itself again and again
    if held:
        yield from work_bounded(*(np.concatenate(x) for x in zip(*held, strict=True)), block_rows, rows, work)


def work_bounded(k: np.ndarray, f: np.ndarray, block_rows: int | None, rows, work) -> Iterator[pa.RecordBatch]:
    """Large runs of a key go out as they are, the others are worked on."""
    if not len(k):
        return
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    sizes = np.diff(np.append(starts, len(k)))
    large = np.repeat(sizes > (block_rows or len(k)), sizes)
    if large.any():
        yield rows(k[large], f[large], 1)
        k, f = k[~large], f[~large]
    yield from work(k, f)


def segments_for(fingerprints: int) -> int:
    """So many that random fingerprints share a key in tens: a key of 5, 6, 7 segments has 25, 32, 39 bits, and a fingerprint
    about five keys for each choice and half."""
    return 5 if fingerprints < 1 << 27 else 6 if fingerprints < 1 << 34 else 7


def links(distinct: DataFrame, *, segments: int | None = None, block_rows: int = 20_000) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all pairs at MAX_BITS or fewer bits."""
    segments = segments or segments_for(distinct.count())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_fp = column_of(b, "fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fp), 4096):
                fp = all_fp[at : at + 4096]
                parts = list(keys_of(fp, segments))
                key = np.concatenate([k for _, k in parts])
                own = fp[np.concatenate([r for r, _ in parts])]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own.view(np.int64))], names=["key", "fp"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return link_rows(batches, block_rows)

    kinds = "a long, b long, kind int"
    keyed = distinct.select("fp").mapInArrow(emit, "key long, fp long")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written(keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(scan, kinds))
    direct, over = found.where("kind = 0").select("a", "b"), found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if over.isEmpty():
        return direct
    blocks = over.groupBy("key").agg(F.ceil(F.count("*") / (block_rows // 2)).cast("int").alias("blocks"))
    cut = over.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return link_rows(batches, None)

    return direct.unionByName(written(pairs.repartition(n, "key").sortWithinPartitions("key").mapInArrow(compare, kinds)).select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots: root is the smallest node reachable.  Large-star and small-star rounds
    (Kiveris et al. 2014) over written tables, until a round changes nothing; their number grows with the logarithm of the
    longest path."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    before = mark(now)
    while before[0]:
        most = before[0] // 1000 + 100
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = join_hot(both.where("b > a"), least, "a", most).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct())
        small_least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        joined = join_hot(large, small_least, "a", most)
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b")))
        new = written(small.distinct())
        dropped(large)
        dropped(now)
        now, after = new, mark(new)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def least_of_groups(distinct: DataFrame, roots: DataFrame | None, node: str) -> DataFrame:
    """(node, component_id, n) for the rows (node, least, n) of ``distinct``: the least of ``least`` over a node's group.  Nodes
    that are not in ``roots`` are groups of their own."""
    alone = distinct.select(node, F.col("least").alias("component_id"), "n")
    if roots is None:
        return alone
    roots = roots.withColumnRenamed("node", node).unionByName(roots.select(F.col("root").alias(node), "root").distinct())
    members = written(distinct.join(roots, node))
    named = members.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m")).withColumnRenamed("m", "n")
    grouped = join_hot(members.withColumnRenamed("n", "rows"), named, "root", members.count() // 1000 + 100)
    return alone.join(members.select(node), node, "left_anti").unionByName(grouped.select(node, "component_id", F.col("rows").alias("n")))


def named_rows(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component in ``found`` (id, key, component_id) the row whose id names it (a component of null ids keeps its rows
    of different texts), rows that repeat id and text once.  The texts are shuffled once, by row_key."""
    own = unused(docs.columns, "__dl_") + "key"
    kept = written(found.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("key").alias(own)).distinct())
    keyed = docs.withColumn(own, row_key(id_col, text_col)).dropDuplicates([own])
    return keyed.join(kept, own, "left_semi").drop(own)


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near-duplicates (see named_rows)."""
    return named_rows(docs, near_duplicates(docs, id_col=id_col, text_col=text_col, **options), id_col=id_col, text_col=text_col)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, segments: int | None = None) -> DataFrame:
    """id, key, fp (signed long), component_id: one row per document."""
    marks = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    distinct = written(marks.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    named = written(least_of_groups(distinct, components(links(distinct, segments=segments)), "fp"))
    return join_hot(marks, named, "fp", marks.count() // 1000 + 100).select("id", "key", "fp", "component_id")
