"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix (DataFrame functions only).

1. Rows get a block (a logical source partition) by a hash of their row number.
2. Blocks are counted; the number of rows that each block sends to each shard is drawn from the multivariate
   hypergeometric law, by halving the list of blocks again and again (at most MAX_BLOCKS x shards numbers, on the driver).
   Draws among fewer than 10^9 rows are exact; among more, the law is inverted in floating point within 40 deviations.
3. Each block permutes its rows (order of a keyed hash) and deals them by the drawn counts.
4. The exchange goes by shard and a random sub-bucket; each (shard, bucket) permutes again, and bucket offsets make slots
   gapless.  Sub-buckets keep a task's rows bounded however few shards there are.

The row number needs one fixed order, so the rows are first written to the shared folder: pass narrow rows.  Nothing else is
written: step 3 has one result for the written rows, so what step 4 counts is what it joins.
Defined cases: equal rows and null values are dealt as rows of their own; an empty table gives no rows; extra columns keep
their values whatever their names, but columns named shard or slot, in either case, give way to the result's.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.common import quoted, unused, written

MAX_BLOCKS = 65536
BUCKET_ROWS = 500_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Draws how many of ``sample`` rows out of good + bad are good; numpy's limit is 1e9 rows, above it the law is inverted."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, sample)) if sample and good else 0
    lo, hi = max(0, sample - bad), min(sample, good)
    total = good + bad
    mean = sample * good / total
    sd = max(1.0, (mean * (bad / total) * (total - sample) / (total - 1)) ** 0.5)
    lo, hi = max(lo, int(mean - 40 * sd)), min(hi, int(mean + 40 * sd) + 1)
    k = np.arange(lo, hi, dtype=np.float64)
    steps = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    cdf = np.cumsum(np.exp(logs - logs.max()))
    return lo + int(np.searchsorted(cdf, rng.random() * cdf[-1]))


def communication_matrix(rows: list[int], columns: list[int], seed: int) -> np.ndarray:
    """A random matrix with these row and column sums, as a uniform shuffle makes it."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(rows), len(columns)), dtype=np.int64)
    sums = np.concatenate([[0], np.cumsum(np.asarray(rows, dtype=np.int64))])
    stack = [(0, len(rows), [int(c) for c in columns])]
    while stack:
        a, b, cols = stack.pop()
        if b - a == 1:
            out[a] = cols
            continue
        mid = (a + b) // 2
        left, rest = int(sums[mid] - sums[a]), int(sums[b] - sums[a])
        part = []
        for c in cols:
            rest -= c
            got = hypergeometric(rng, c, rest, left)
            part.append(got)
            left -= got
        stack += [(a, mid, part), (mid, b, [c - p for c, p in zip(cols, part, strict=True)])]
    return out


def shard_rows(df: DataFrame, shards: int, *, seed: int = 17, blocks: int | None = None) -> DataFrame:
    """``df`` with shard (int) and slot (long): counts of shards differ by one at most, and every order is equally likely."""
    spark = df.sparkSession
    kept = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    tag = unused(kept, "__dl_")
    row, block, rank, ends, bucket, n, first = (tag + x for x in ("row", "block", "rank", "ends", "bucket", "n", "first"))
    base = written(df.select(*map(quoted, kept), F.monotonically_increasing_id().alias(row)))
    total, partitions = base.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, min(MAX_BLOCKS, blocks or max(partitions, -(-total // BUCKET_ROWS))))
    base = base.withColumn(block, F.pmod(F.xxhash64(row, F.lit(seed)), F.lit(blocks)).cast("int"))
    found = {r[0]: r[1] for r in base.groupBy(block).count().collect()}  # at most MAX_BLOCKS rows
    names = sorted(found)
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([found[b] for b in names], sizes, seed) if names else np.zeros((0, shards), np.int64)
    drawn = spark.createDataFrame([(b, [int(x) for x in np.cumsum(m)]) for b, m in zip(names, matrix, strict=True)], f"{block} int, {ends} array<long>")
    buckets = max(-(-partitions // shards), -(-total // (shards * BUCKET_ROWS)), 1)

    within = F.row_number().over(Window.partitionBy(block).orderBy(F.xxhash64(row, F.lit(seed + 1)), row))
    key = F.xxhash64(row, F.lit(seed + 2))
    sent = (
        base.withColumn(rank, within)
        .join(F.broadcast(drawn), block)  # at most MAX_BLOCKS x shards numbers
        .withColumn("shard", F.size(F.filter(ends, lambda e: e < F.col(rank))).cast("int"))
        .withColumn(bucket, F.pmod(F.shiftrightunsigned(key, 20), F.lit(buckets)).cast("int"))
        .drop(ends, rank, block)
    )
    counts = sent.groupBy("shard", bucket).agg(F.count("*").alias(n))
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(first))
    place = F.row_number().over(Window.partitionBy("shard", bucket).orderBy(F.xxhash64(row, F.lit(seed + 3)), row))
    return (
        sent.join(offsets, ["shard", bucket])
        .withColumn("slot", (F.col(first) + place - 1).cast("long"))
        .select(*map(quoted, kept), "shard", "slot")
    )
