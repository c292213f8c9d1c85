"""Benchmark decontamination: rare words as seeds find candidate passages, Smith-Waterman alignment scores them.

1. A passage at the threshold matches at least k words of the item, k being half the least score.  Of the item's words the
   commonest in the benchmark, k // 2 places at most, are no seeds; a document that holds too few of the other places to
   match k with those, anywhere or within the span of 2, is no candidate.  Rarity prunes only what can't reach the threshold.
2. Such a passage spans at most 3 words - least score places of the document, as every word it leaves unmatched costs a point.
   Regions are the runs of places with k of the item's words in that span; they cover every passage at the threshold.
3. Regions are looked at through windows of twice the span that overlap by half.  A window that has fewer than k words in common
   with the item, each as often as both hold it, is left out, and so is one whose longest common subsequence with the item is
   shorter.
4. Local alignment over words (match 2, mismatch -1, gap -1) scores each region; paraphrased and edited copies keep most of
   an exact copy's score.  What lies before and after a passage that is found is aligned again, so that neighbouring copies
   each give a row.  A document is contaminated where score >= threshold * 2 * item words, and never by less than
   ``least_words`` words' worth (an item shorter than that counts only when whole).  No item is left out by default, so one of
   a word or two is found wherever these stand: ``shortest`` sets the fewest words that an item must have to be evidence.
So whatever aligns at the threshold is found, however it was edited: there is no loss to measure.

The benchmark goes to the executors in blocks of at most ``block_bytes`` bytes of text; each block is one pass over the
documents, which are never shuffled.  Words are runs of word characters in lower case.
Defined cases: null and empty texts and items hit nothing; equal rows each give their rows; equal items each report;
empty tables give no rows; columns other than those named are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import column_of, map_rows, quoted, slices, texts_of

WORD = re.compile(r"\w+")
OTHER = re.compile(r"[^\w\x00-\x7f]+")  # no word characters beyond ASCII
SPACED = bytes(c if c >= 128 or WORD.match(chr(c)) else 32 for c in range(256))
MATCH, MISMATCH, GAP = 2, -1, -1
SCHEMA = "doc_id long, item_id long, score double, item_words long, start long, end long"
ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("item_words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local score and the passage's first and last aligned word."""
    m = len(passage)
    ramp = np.arange(m + 1, dtype=np.int64) * -GAP
    score = np.zeros(m + 1, dtype=np.int64)
    first = np.arange(m + 1, dtype=np.int64)  # where the alignment that ends here began
    best, at, since = 0, 0, 0
    for w in item:
        fits = np.where(passage == w, MATCH, MISMATCH)
        diagonal, above = score[:-1] + fits, score[1:] + GAP
        new, own = np.zeros(m + 1, dtype=np.int64), np.arange(m + 1, dtype=np.int64)
        new[1:] = np.maximum(np.maximum(diagonal, above), 0)
        own[1:] = np.where(new[1:] == 0, own[1:], np.where(diagonal >= above, first[:-1], first[1:]))
        raised = new + ramp
        top = np.maximum.accumulate(raised)
        source = np.maximum.accumulate(np.where(raised == top, np.arange(m + 1), 0))
        score, first = top - ramp, own[source]
        k = int(score.argmax())
        if score[k] > best:
            best, at, since = int(score[k]), k, int(first[k])
    return best, since, at - 1


def words_of(text: str) -> list[bytes]:
    """The matches of WORD in the text in lower case, as UTF-8."""
    low = text.lower()
    return (low if low.isascii() else OTHER.sub(" ", low)).encode().translate(SPACED).split()


@dataclass
class Index:
    """A block of the benchmark: word numbers, items as word numbers, and for each word the items in which it is a seed."""

    words: dict[bytes, int] = field(default_factory=dict)
    items: list[tuple[int, np.ndarray]] = field(default_factory=list)
    kinds: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # by item: its words in order, and how often each stands
    least: list[float] = field(default_factory=list)  # by item: the score that counts
    seeds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # the items of word 0, of word 1, ...
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # how often the word stands in that item
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # where each word's items begin
    hits: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # by item: seeds that a candidate holds at least
    span: np.ndarray = field(default_factory=lambda: np.zeros(0))  # by item: places that a passage covers less than

    @staticmethod
    def of(rows: list[tuple[int, str]], threshold: float, least_words: int, shortest: int = 1) -> Index:
        out = Index()
        for item_id, text in rows:
            found = words_of(text or "")
            if len(found) >= max(1, shortest):
                out.items.append((item_id, np.array([out.words.setdefault(w, len(out.words)) for w in found], dtype=np.int64)))
                out.least.append(needed(len(found), threshold, least_words))
        common = np.zeros(len(out.words), dtype=np.int64)
        for _, w in out.items:
            common[np.unique(w)] += 1
        words, items, counts, hits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for i, (_, w) in enumerate(out.items):
            k = out.matches(i)
            kinds, places = np.unique(w, return_counts=True)
            out.kinds.append((kinds, places))
            order = np.argsort(-common[kinds], kind="stable")
            pruned = int(np.searchsorted(np.cumsum(places[order]), k // 2, side="right"))  # so many kinds fill at most k // 2 places
            own = order[pruned:]
            words.append(kinds[own])
            items.append(np.full(len(own), i))
            counts.append(places[own])
            hits.append(k - int(places[order[:pruned]].sum()))
        word = np.concatenate(words)
        by_word = np.argsort(word, kind="stable")
        out.seeds, out.places = np.concatenate(items)[by_word], np.concatenate(counts)[by_word]
        out.first = np.searchsorted(word[by_word], np.arange(len(out.words) + 1))
        out.hits = np.array(hits, dtype=np.int64)
        out.span = np.array([3 * len(w) - least for (_, w), least in zip(out.items, out.least, strict=True)])
        return out

    def matches(self, i: int) -> int:
        """Words of the item that a passage at its least score matches at least."""
        return math.ceil(self.least[i] / MATCH - 1e-9)

    def numbers(self, text: str) -> np.ndarray:
        return np.array(list(map(self.words.get, words_of(text), repeat(-1))), dtype=np.int64)

    def seeds_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``words``, place in ``seeds``) of every item that a word seeds."""
        first = self.first[words]
        sizes = self.first[words + 1] - first
        return np.repeat(np.arange(len(words)), sizes), np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())

    def candidates(self, w: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The items of which a text holds enough seeds within the span; the words ``w`` stand at ``places``."""
        at = self.seeds_of(np.unique(w))[1]
        enough = np.bincount(self.seeds[at], weights=self.places[at], minlength=len(self.items)) >= self.hits
        if not enough.any():
            return np.zeros(0, np.int64)
        word, at = self.seeds_of(w)
        item = self.seeds[at]
        own = np.flatnonzero(enough[item])
        own = own[np.argsort(item[own].astype(np.int32), kind="stable")]  # places stay in order within an item
        item, place = item[own], places[word[own]]
        more = np.maximum(self.hits, 1)[item] - 1
        begin = np.flatnonzero(np.arange(len(item)) + more < len(item))
        end = begin + more[begin]
        near = (item[end] == item[begin]) & (place[end] - place[begin] < self.span[item[begin]])
        return np.unique(item[begin[near]])

    def regions(self, w: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, from, to): the places of a text where a passage at the item's least score can be."""
        slot, known = np.zeros(len(self.words), dtype=np.int64), np.flatnonzero(w >= 0)
        w = w[known]
        for i in self.candidates(w, known).tolist():
            item, k, since, until = self.items[i][1], self.matches(i), None, 0
            kinds, often = self.kinds[i]
            slot[kinds] = np.arange(1, len(kinds) + 1)
            of = slot[w]
            slot[kinds] = 0
            own = np.flatnonzero(of)
            of, places = of[own], known[own]
            if np.minimum(np.bincount(of, minlength=len(kinds) + 1)[1:], often).sum() < k:
                continue
            ends = places[k - 1 :]
            starts = places[: len(ends)]
            near = ends - starts < self.span[i]
            starts, ends = starts[near], ends[near]
            if not len(starts):
                continue
            cut = np.flatnonzero(starts[1:] > ends[:-1]) + 1
            cut = windows(starts[np.concatenate([[0], cut])].tolist(), ends[np.concatenate([cut - 1, [-1]])].tolist(), math.ceil(self.span[i]))
            for a, z, b, e in enough_in_common(np.array(cut), of, places, often, k):
                if common_words(item, kinds[of[b:e] - 1]) >= k:
                    if since is not None and a > until:
                        yield i, since, until
                        since = None
                    since, until = a if since is None else since, z
            if since is not None:
                yield i, since, until


def enough_in_common(cut: np.ndarray, of: np.ndarray, places: np.ndarray, often: np.ndarray, k: int) -> Iterator[tuple[int, int, int, int]]:
    """The windows (from, to) with k words in common with an item, each at most as often as both hold it, and the numbers of
    their first and last known words; ``of`` numbers the item's words from 1.  Counted for many windows at a time."""
    step = max(1, (1 << 18) // len(often))
    bounds = np.searchsorted(places, cut)
    first = 0
    while first < len(cut):
        last = max(first + 1, int(np.searchsorted(bounds[:, 1], bounds[first, 0] + step, side="right")))
        b = int(bounds[first, 0])
        here = of[b : bounds[last - 1, 1]]
        if last == first + 1:
            if np.minimum(np.bincount(here, minlength=len(often) + 1)[1:], often).sum() >= k:
                yield (*cut[first].tolist(), *bounds[first].tolist())
            first = last
            continue
        running = np.zeros((len(here) + 1, len(often)), dtype=np.int32)
        running[np.arange(1, len(here) + 1), here - 1] = 1
        running = running.cumsum(axis=0)
        both = np.minimum(running[bounds[first:last, 1] - b] - running[bounds[first:last, 0] - b], often).sum(axis=1)
        for j in np.flatnonzero(both >= k).tolist():
            yield (*cut[first + j].tolist(), *bounds[first + j].tolist())
        first = last


def windows(starts: list[int], ends: list[int], span: int) -> list[tuple[int, int]]:
    """Each run from a start to an end (included), or windows over it, of which one holds whatever is no longer than the span."""
    out = []
    for a, z in zip(starts, ends, strict=True):
        while z + 1 - a > 2 * span:
            out.append((a, a + 2 * span))
            a += span
        out.append((a, z + 1))
    return out


def common_words(item: np.ndarray, passage: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for each word of the item."""
    masks: dict[int, int] = {}
    for k, x in enumerate(item.tolist()):
        masks[x] = masks.get(x, 0) | 1 << k
    every = (1 << len(item)) - 1
    left = every
    for m in map(masks.get, passage.tolist()):
        if m:
            u = left & m
            left = ((left + u) | (left - u)) & every
    return len(item) - left.bit_count()


def needed(words: int, threshold: float, least_words: int) -> float:
    return max(threshold * MATCH * words, MATCH * min(words, least_words))


def indexes(benchmark: DataFrame, item_col: str, item_text_col: str, threshold: float, least_words: int, shortest: int, block_bytes: int) -> Iterator[Index]:
    """The benchmark in blocks of about ``block_bytes``."""
    bench = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("t is not null")
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        rows = bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).orderBy("i", "t").collect()  # about block_bytes
        index = Index.of([(r.i, r.t) for r in rows], threshold, least_words, shortest)
        if index.items:
            yield index


def passages(index: Index, text: str) -> Iterator[tuple]:
    """(item id, score, item words, start, end) of the text's passages that copy an item."""
    w, spans = index.numbers(text), None
    for i, a, z in index.regions(w):
        (item_id, item), k, todo = index.items[i], index.matches(i), [(a, z)]
        while todo:
            a, z = todo.pop()
            best, first, last = align(item, w[a:z])
            if best >= index.least[i]:
                spans = spans or [m.span() for m in WORD.finditer(text.lower())]
                yield item_id, best / (MATCH * len(item)), len(item), spans[a + first][0], spans[a + last][1]
                todo += [(b, e) for b, e in ((a, a + first), (a + last + 1, z)) if common_words(item, w[b:e]) >= k]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 threshold: float = 0.5, least_words: int = 8, shortest: int = 1, block_bytes: int = 16 << 20) -> DataFrame:
    """A row (doc_id, item_id, score from 0 to 1, item_words, start, end) for each passage that copies an item; start and end
    are code points.  Passages of one item in one document that do not overlap each give a row."""
    spark, docs = docs.sparkSession, docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))

    def scan(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                rows = [(d, *p) for d, text in zip(column_of(b, "doc_id").to_pylist(), texts_of(b), strict=True) for p in passages(sent.value, text)]
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(ARROW)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ARROW, strict=True)], schema=ARROW)

        return run

    out = None
    for index in indexes(benchmark, item_col, item_text_col, threshold, least_words, shortest, block_bytes):
        part = docs.mapInArrow(scan(spark.sparkContext.broadcast(index)), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                         threshold: float = 0.5, least_words: int = 8, shortest: int = 1, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` in which no passage copies an item, all columns as they are; nothing is shuffled."""

    def keep(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, text_col):
                clean = [next(passages(sent.value, text), None) is None for text in texts_of(b, text_col)]
                yield b.filter(pa.array(clean, pa.bool_()))

        return run

    out = docs
    for index in indexes(benchmark, item_col, item_text_col, threshold, least_words, shortest, block_bytes):
        out = map_rows(out, keep(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return out
