"""N-gram language model in an Elias-Fano trie (order 3 by default), built and queried in parallel.

Tokens are words (A-Z as a-z, runs of other than space and \\t \\n \\v \\f \\r) and one end for each text; a start stands
before each text as context only.

Level 1 is the vocabulary: the words' 64-bit hashes in order; a word's id is its rank.  Level k >= 2 holds the k-grams in the
order of (place of the first k - 1 words in level k - 1, id of the last word): these context-relative keys are made monotone
by their context's base and coded by Elias-Fano, as are the pointers from contexts to their children and the running counts.
A k-gram is looked up by one successor search from its context's base.  Each k-gram has its discounted probability
(c - D) / c(context) and each context its interpolation weight D N(context) / c(context), both as 8-bit codes of a
logarithmic scale; absolute discounting, D = n1 / (n1 + 2 n2), down to (c + 1) / (N + V + 1) for single tokens.  All n-grams
of all training texts are counted; none is pruned.

A level is cut into shards by key, so that each holds about ``shard_tokens`` tokens; a frequent context is cut by its
children's ids.  The texts are cut into tokens twice: for the vocabulary, and to write each text's ids (32 bits a token as long
as they fit) to the shared folder, which the passes of all higher levels and of the scores read.  Every pass counts in each task and sends each shard one Elias-Fano coded block, so a shuffle
moves a few bytes for each distinct n-gram of a task.  Shard files lie in the shared folder, are written once under names
of their own (a repeated task writes another file, of which one is used), and are memory-mapped by the scoring tasks.
To the driver come a few numbers for each shard.  There are at most MAX_SHARDS shards, and keys have 64 bits: a corpus whose
contexts x words do not fit is refused with an error.

Defined cases: null and empty texts are one end; equal rows score alike and count as often as they occur; without training
texts every token is unknown; an empty table gives no rows; columns other than the two named are not read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from driftloom.llm.common import bytes_of, column_of, fold_column, quoted, shared_dir, slices, written
from driftloom.llm.elias_fano import EliasFano

END = xxh64_digest(b"")  # no word is empty
SLICE = 3 << 20  # bytes of text
SLICE_IDS = 3 << 20  # bytes of ids
FLUSH = 6_000_000
MAX_SHARDS = 65536  # files of a level; beyond them shards grow
OPEN_SHARDS = 1024
CODES = 255


# ---- files ----


def save(uri: str, segments: list[np.ndarray]) -> None:
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    raw = [np.ascontiguousarray(s).tobytes() for s in segments]
    sizes = [-(-len(r) // 8) for r in raw]
    with fs.open_output_stream(path) as out:
        out.write(np.array([len(raw), *sizes], dtype=np.uint64).tobytes())
        for r, n in zip(raw, sizes, strict=True):
            out.write(r + b"\0" * (8 * n - len(r)))


def mapped(uri: str) -> list[np.ndarray]:
    """The segments of a file as memory-mapped arrays; a file that isn't on a mounted file system is mapped from a nameless copy."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    if isinstance(fs, pyarrow.fs.LocalFileSystem):
        words = np.memmap(path, dtype=np.uint64, mode="r")
    else:
        with tempfile.TemporaryFile() as copy, fs.open_input_stream(path) as source:
            while part := source.read(1 << 24):
                copy.write(part)
            copy.flush()
            words = np.memmap(copy, dtype=np.uint64, mode="r")
    sizes = words[1 : 1 + int(words[0])].astype(np.int64)
    ends = 1 + len(sizes) + np.cumsum(sizes)
    return [np.asarray(words[e - n : e]) for e, n in zip(ends, sizes, strict=True)]


def to_codes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes of positive values on a logarithmic scale, and the scale (least log and step)."""
    if not len(values):
        return np.zeros(0, np.uint8), np.array([0.0, 0.0])
    logs = np.log10(values)
    low = float(logs.min())
    step = max((float(logs.max()) - low) / CODES, 1e-12)
    return np.rint((logs - low) / step).astype(np.uint8), np.array([low, step])


def scale(segment: np.ndarray) -> np.ndarray:
    low, step = segment.view(np.float64)
    return 10.0 ** (low + step * np.arange(CODES + 1))


# ---- the trie ----


@dataclass
class Level:
    """bounds: first key of each shard; offsets: number of entries before each shard; grams, weights: the shards' files ("" for
    a shard without entries); hot: weights of the contexts that are cut over shards."""

    bounds: np.ndarray
    offsets: np.ndarray
    grams: list[str]
    weights: list[str] = field(default_factory=list)
    hot: dict[int, float] = field(default_factory=dict)
    opened: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"opened": {}}

    @property
    def size(self) -> int:
        return int(self.offsets[-1])

    def part(self, kind: str, s: int):
        got = self.opened.get((kind, s))
        if got is None:
            if len(self.opened) >= OPEN_SHARDS:  # maps, and copies from a store that isn't mounted, are let go
                self.opened.clear()
            if kind == "grams":
                keys, counts = mapped(self.grams[s])
                got = EliasFano(keys), EliasFano(counts)
            else:
                alpha, a_scale, weight, w_scale, pointers = mapped(self.weights[s])
                got = alpha.view(np.uint8), scale(a_scale), weight.view(np.uint8), scale(w_scale), EliasFano(pointers)
            self.opened[kind, s] = got
        return got

    def by_shard(self, sorted_keys: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        cuts = np.searchsorted(sorted_keys, bounds, side="left")
        ends = np.append(cuts[1:], len(sorted_keys))
        for s in np.flatnonzero(ends > cuts):
            yield int(s), int(cuts[s]), int(ends[s])

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of sorted keys in the level, -1 where a key isn't there."""
        out = np.full(len(keys), -1, dtype=np.int64)
        for s, a, b in self.by_shard(keys, self.bounds):
            if self.grams[s]:
                found = self.part("grams", s)[0].find(keys[a:b] - self.bounds[s])
                out[a:b] = np.where(found >= 0, found + self.offsets[s], -1)
        return out

    def counts(self, places: np.ndarray) -> np.ndarray:
        """Counts of sorted places."""
        out = np.zeros(len(places), dtype=np.int64)
        for s, a, b in self.by_shard(places, self.offsets[:-1]):
            own, running = places[a:b] - self.offsets[s], self.part("grams", s)[1]
            out[a:b] = (running.access(own + 1) - running.access(own)).astype(np.int64)
        return out

    def alpha(self, places: np.ndarray) -> np.ndarray:
        """Discounted probabilities of sorted places."""
        out = np.zeros(len(places))
        for s, a, b in self.by_shard(places, self.offsets[:-1]):
            codes, values, *_ = self.part("weights", s)
            out[a:b] = values[codes[places[a:b] - self.offsets[s]]]
        return out

    def weight(self, contexts: np.ndarray, width: int) -> np.ndarray:
        """Interpolation weights of sorted contexts; 1 for those without children."""
        out = np.ones(len(contexts))
        for s, a, b in self.by_shard(contexts.astype(np.uint64) * np.uint64(width), self.bounds):
            if self.weights[s]:
                _, _, codes, values, pointers = self.part("weights", s)
                at = contexts[a:b] - int(self.bounds[s]) // width
                inside = at < pointers.n - 1
                out[a:b][inside] = values[codes[at[inside]]]
        for context, value in self.hot.items():
            out[np.searchsorted(contexts, context, side="left") : np.searchsorted(contexts, context, side="right")] = value
        return out


@dataclass
class Trie:
    levels: list[Level]
    tokens: int
    texts: int

    @property
    def words(self) -> int:
        return self.levels[0].size

    @property
    def kind(self) -> np.dtype:
        return np.dtype(np.int32 if self.words < 1 << 31 else np.int64)

    @property
    def width(self) -> int:
        """Keys are context x width + id; the id ``words`` is the start."""
        return self.words + 1

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        unique, back = np.unique(hashes, return_inverse=True)
        return self.levels[0].find(unique)[back]

    def context(self, ids: np.ndarray, first: np.ndarray, level: int) -> np.ndarray:
        """The context of each token at a level: the place below of the tokens before it, -1 if there is none."""
        context = np.where(first, self.words, np.roll(ids, 1)) if len(ids) else ids
        for below in self.levels[1 : level - 1]:
            key, ok = self.keys(context, ids)
            unique, back = np.unique(key, return_inverse=True)
            place = np.full(len(ids), -1, dtype=np.int64)
            place[ok] = below.find(unique)[back]
            context = np.where(first, -1, np.roll(place, 1))
        return context

    def keys(self, context: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = (context >= 0) & (ids >= 0)
        return context[ok].astype(np.uint64) * np.uint64(self.width) + ids[ok].astype(np.uint64), ok

    def score(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: its count, log10 of (c + 1) / (N + V + 1), and log10 of the model's probability."""
        return self.score_ids(self.ids(hashes), first)

    def score_ids(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        unique, back = np.unique(ids, return_inverse=True)
        own = np.zeros(len(unique), dtype=np.int64)
        own[unique >= 0] = self.levels[0].counts(unique[unique >= 0])
        count = own[back]
        p = (count + 1) / (self.tokens + self.words + 1)
        base = np.log10(p)
        context = np.where(first, self.words, np.roll(ids, 1)) if len(ids) else ids
        known = np.where(ids >= 0, ids, self.words)  # the start is nobody's child: such a key is never found
        for level in self.levels[1:]:
            ok = context >= 0
            unique, back = np.unique(context[ok].astype(np.uint64) * np.uint64(self.width) + known[ok].astype(np.uint64), return_inverse=True)
            found = level.find(unique)
            hit = found >= 0
            alpha = np.zeros(len(unique))
            alpha[hit] = level.alpha(found[hit])  # places are in the order of their keys
            weight = level.weight((unique // np.uint64(self.width)).astype(np.int64), self.width)
            p[ok] = alpha[back] + weight[back] * p[ok]
            place = np.full(len(ids), -1, dtype=np.int64)
            place[ok] = found[back]
            context = np.where(first, -1, np.roll(place, 1))
        return count, base, np.log10(p)


# ---- passes over the texts ----


def tokens_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, whether each begins a text, and the number of tokens of each text."""
    parts, sizes = [], []
    for raw in raws:
        own = [xxh64_digest(w) for w in raw.lower().split()]
        own.append(END)
        parts += own
        sizes.append(len(own))
    hashes = np.frombuffer(b"".join(parts), dtype=">u8").astype(np.uint64)
    first = np.zeros(len(hashes), dtype=bool)
    if len(hashes):
        first[np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)] = True
    return hashes, first, np.array(sizes, dtype=np.int64)


def ids_of(batch: pa.RecordBatch, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like tokens_of, from the column ``ids`` of ``encoded``; a text has one token at least."""
    raws = column_of(batch, "ids").to_pylist()
    sizes = np.array([len(r) for r in raws], dtype=np.int64) // kind.itemsize
    ids = np.frombuffer(b"".join(raws), dtype=kind).astype(np.int64)
    first = np.zeros(len(ids), dtype=bool)
    first[np.cumsum(sizes) - sizes] = True
    return ids, first, sizes


def encoded(rows: DataFrame, trie: Trie, kept: list[str]) -> DataFrame:
    """The columns ``kept`` and, for ``text``, the ids of its tokens as bytes (-1: not in the vocabulary), written."""
    kind = trie.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=SLICE):
            hashes, _, sizes = tokens_of(bytes_of(b))
            raw, ends = trie.ids(hashes).astype(kind).tobytes(), np.cumsum(sizes) * kind.itemsize
            ids = [raw[a:e] for a, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(column_of(b, c) for c in kept), pa.array(ids, pa.binary())], names=[*kept, "ids"])

    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept), "ids binary"])
    return written(rows.select(*kept, "text").mapInArrow(run, schema))


def blocks(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """A row for each shard: its keys and running counts."""
    cuts = np.append(np.searchsorted(keys, bounds, side="left"), len(keys))
    rows = []
    for s in np.flatnonzero(cuts[1:] > cuts[:-1]):
        a, b = cuts[s], cuts[s + 1]
        rows.append((int(s), EliasFano.encode(keys[a:b] - bounds[s]).tobytes(), EliasFano.encode(np.cumsum(counts[a:b])).tobytes()))
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.large_binary()).cast(pa.binary()), pa.array(cols[2], pa.binary())], names=["shard", "keys", "counts"])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def count_keys(texts: DataFrame, bounds: np.ndarray, keys_of: Callable[[pa.RecordBatch], np.ndarray], column: str, limit: int) -> DataFrame:
    """(shard, keys, counts): what each task has counted, in one block for each shard and FLUSH tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in slices(batches, column, limit):
            held.append(np.unique(keys_of(b), return_counts=True))
            size += len(held[-1][0])
            if size >= FLUSH:
                yield blocks(*summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])), bounds)
                held, size = [], 0
        if held:
            yield blocks(*summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])), bounds)

    return texts.select(column).mapInArrow(run, "shard int, keys binary, counts binary")


def decoded(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    k, c = (EliasFano(np.frombuffer(x, dtype=np.uint64)).all() for x in (keys, counts))
    return k, np.diff(c.astype(np.int64), prepend=0)


def merged(counted: DataFrame, bounds: np.ndarray, width: int, folder: str) -> list:
    """Writes the gram file of each shard; a row of figures for each: entries, tokens, entries of count 1 and 2, and the
    first and the last context with their numbers of children."""
    spark = counted.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def close() -> pa.RecordBatch:
            keys, counts = summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            uri = f"{folder}/{shard:05d}-{uuid.uuid4().hex[:12]}"
            save(uri, [EliasFano.encode(keys), EliasFano.encode(np.concatenate([[0], np.cumsum(counts)]))])
            context = (keys + np.uint64(bounds[shard])) // np.uint64(width)
            ends = [int(context[0]), int((context == context[0]).sum()), int(context[-1]), int((context == context[-1]).sum())] if width > 1 else [0] * 4
            row = [int(shard), uri, len(keys), int(counts.sum()), int((counts == 1).sum()), int((counts == 2).sum()), *ends]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=[f.name for f in schema])

        for b in batches:
            for s, k, c in zip(*(column_of(b, n).to_pylist() for n in ("shard", "keys", "counts")), strict=True):
                if s != shard and held:
                    yield close()
                    held = []
                shard = s
                held.append(decoded(k, c))
                if len(held) == 16:
                    held = [summed(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))]
        if held:
            yield close()

    from pyspark.sql import types as T

    names = ("shard", "uri", "n", "tokens", "ones", "twos", "first", "first_n", "last", "last_n")
    schema = T.StructType([T.StructField(n, T.StringType() if n == "uri" else T.LongType()) for n in names])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return counted.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(run, schema).collect()  # a row for each shard


def level_of(rows: list, bounds: np.ndarray) -> Level:
    files, sizes = [""] * len(bounds), np.zeros(len(bounds), dtype=np.int64)
    for r in rows:
        files[r.shard], sizes[r.shard] = r.uri, r.n
    return Level(bounds, np.concatenate([[0], np.cumsum(sizes)]), files)


def over_shards(spark, shards: list[int], work: Callable[[int], list[tuple]], schema: str, names: list[str]) -> list:
    """Runs ``work`` for each shard in a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column(0).to_pylist():
                rows = work(shards[s])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    return spark.range(0, len(shards), 1, len(shards)).mapInArrow(run, schema).collect() if shards else []


def frequent(spark, level: Level, least: float) -> list[tuple[int, int]]:
    """(place, count) of the entries counted more than ``least`` times: at most tokens / least rows."""

    def work(s: int) -> list[tuple]:
        counts = np.diff(level.part("grams", s)[1].all().astype(np.int64))
        return [(int(level.offsets[s] + i), int(counts[i])) for i in np.flatnonzero(counts > least)]

    return [(r.place, r.n) for r in over_shards(spark, [s for s, g in enumerate(level.grams) if g], work, "place long, n long", ["place", "n"])]


def check_keys(contexts: int, width: int) -> None:
    """Keys are 64 bits: contexts x words must stay below 2 ** 64."""
    if contexts * width >= 1 << 64:
        raise OverflowError(f"{contexts} contexts x {width} words do not fit keys of 64 bits: use a lower order or less text")


def bounds_for(contexts: int, width: int, shards: int, hot: list[tuple[int, int]], least: float) -> np.ndarray:
    """First keys of about ``shards`` shards of equal width; a context of ``hot`` is cut further, by its children's ids."""
    keys = {width * (contexts * i // shards) for i in range(shards)} | {0}
    for place, n in hot:
        parts = int(n // least) + 1
        keys |= {place * width + width * j // parts for j in range(parts)} | {(place + 1) * width}
    return np.array(sorted(k for k in keys if k < contexts * width or k == 0), dtype=np.uint64)


def weigh(spark, level: Level, below: Level, trie: Trie, rows: list, folder: str, start: bool, hot: list[tuple[int, int]]) -> None:
    """Writes the weight file of each shard: codes of grams and contexts, their scales, pointers."""
    ones, twos = sum(r.ones for r in rows), sum(r.twos for r in rows)
    discount = ones / (ones + 2 * twos) if ones else 0.5
    discount = min(max(discount, 0.1), 0.95)
    width, words, texts = trie.width, trie.words, trie.texts
    children: dict[int, int] = {}
    for r in rows:
        for context, n in {(r.first, r.first_n), (r.last, r.last_n)}:
            children[context] = children.get(context, 0) + n

    def work(s: int) -> list[tuple]:
        keys, running = level.part("grams", s)
        key, count = keys.all() + level.bounds[s], np.diff(running.all().astype(np.int64))
        context = (key // np.uint64(width)).astype(np.int64)
        c0 = int(level.bounds[s]) // width
        n = np.bincount(context - c0)
        pointers = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(c0, c0 + len(n))
        totals = np.ones(len(n), dtype=np.int64)
        inside = (at < words) if start else np.ones(len(n), dtype=bool)
        totals[inside] = below.counts(at[inside])
        totals[~inside] = texts
        for place in {int(context[0]), int(context[-1])}:
            n[place - c0] = children[place]
        alpha, a_scale = to_codes((count - discount) / totals[context - c0])
        weight = np.where(n > 0, discount * np.maximum(n, 1) / np.maximum(totals, 1), 1.0)  # without children: all goes to the level below
        codes, w_scale = to_codes(weight)
        uri = f"{folder}/{s:05d}-{uuid.uuid4().hex[:12]}"
        save(uri, [alpha, a_scale, codes, w_scale, EliasFano.encode(pointers)])
        return [(s, uri)]

    level.hot = {place: discount * children[place] / n for place, n in hot if place in children}
    level.weights = [""] * len(level.grams)
    level.opened = {}
    for r in over_shards(spark, [s for s, g in enumerate(level.grams) if g], work, "shard long, uri string", ["shard", "uri"]):
        level.weights[r.shard] = r.uri


def build(texts: DataFrame, **options) -> Trie:
    """A trie from all rows of ``texts`` (column text)."""
    return trained(texts.select("text", F.lit(False).alias("held_out")), [], **options)[0]


def trained(rows: DataFrame, kept: list[str], *, order: int = 3, shard_tokens: int = 2_000_000) -> tuple[Trie, DataFrame]:
    """A trie from the rows of ``rows`` (columns text, held_out and ``kept``) that are not held out, and all rows ``encoded``."""
    spark, folder = rows.sparkSession, shared_dir(rows.sparkSession)
    texts = rows.where("not held_out").select("text")
    size = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    shards = int(min(MAX_SHARDS, max(1, (size.b or 0) / 6 // shard_tokens)))
    bounds = np.array([(1 << 64) * i // shards for i in range(shards)], dtype=np.uint64)
    found = merged(count_keys(texts, bounds, lambda b: tokens_of(bytes_of(b))[0], "text", SLICE), bounds, 1, f"{folder}/1")  # words have no context
    trie = Trie([level_of(found, bounds)], sum(r.tokens for r in found), size.n)
    coded = encoded(rows, trie, ["held_out", *kept])
    for k in range(2, order + 1):
        below, contexts = trie.levels[-1], trie.width if k == 2 else trie.levels[-1].size
        check_keys(contexts, trie.width)
        least = max(1.0, trie.tokens / shards)
        hot = frequent(spark, below, least) + ([(trie.words, size.n)] if k == 2 and size.n > least else [])
        bounds = bounds_for(contexts, trie.width, shards, hot, least)

        def keys_of(b: pa.RecordBatch, k: int = k) -> np.ndarray:
            ids, first, _ = ids_of(b, trie.kind)
            return trie.keys(trie.context(ids, first, k), ids)[0]

        found = merged(count_keys(coded.where("not held_out"), bounds, keys_of, "ids", SLICE_IDS), bounds, trie.width, f"{folder}/{k}")
        level = level_of(found, bounds)
        weigh(spark, level, below, trie, found, f"{folder}/{k}w", k == 2, hot)
        trie.levels.append(level)
    return trie, coded


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned from the documents not held out."""
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text")).withColumn("held_out", fold_column("doc_id", folds) == held_fold)
    trie, coded = trained(rows, ["doc_id"], **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "ids", SLICE_IDS):
            ids, first, sizes = ids_of(b, trie.kind)
            count, base, model = trie.score_ids(ids, first)
            starts = np.cumsum(sizes) - sizes
            known = np.add.reduceat((count > 0).astype(np.int64), starts)
            cols = [column_of(b, "doc_id"), column_of(b, "held_out"), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), trie.tokens))]
            cols += [pa.array(np.add.reduceat(x, starts)) for x in (base, model)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return coded.select("doc_id", "held_out", "ids").mapInArrow(run, schema)
