"""Information-theoretic sanitisation of personal data.

Protected entities are the fixed patterns' matches (email, ip, card, phone).  Over the whole corpus the operator counts, by
lines: how often each entity occurs, how often each term stands within ``reach`` words of it, and how often each such term
occurs at all.  A term t reveals an entity e where the pointwise mutual information log2(P(t, e) / P(t)P(e)) =
log2(P(e | t) / P(e)) surely reaches ``share`` of the entity's information content -log2 P(e).  In a document that holds e,
such terms are generalised, or removed where the term gives e away entirely (it never stands in a line without e).
Documents without entities stay as they are.

Few observations count for less: P(e | t) is taken at its lower confidence bound (Wilson's, ``z`` deviations), and copies are
no evidence: the number of observations is that of different texts.  No pair is left out for its count alone.

Counts are shuffled as rows of hashes (the texts are not), partly summed in each task; entities and terms of many rows are
broadcast, the others meet in a shuffle.  Pairs to be applied go to the executors as sorted arrays, in blocks of at most
``block`` pairs; each block is a pass.
Offsets are code points, ends exclusive.  Defined cases: null and empty texts have no spans (a null text stays null);
equal rows are treated alike; an empty table gives no rows; extra columns stay unless one bears the name ``spans_col``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from driftloom.llm.common import column_of, join_hot, map_rows, quoted, slices, texts_of, written

PARTIAL = 400_000
KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match can't begin inside a run of digits: what fails from the run's first digit fails from the others too.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
LINE = re.compile(r"[^\n]+")
OTHER = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end), sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if not any(c in text for c in "0123456789"):
        return out
    if text.count(".") >= 3:
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = OTHER.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(OTHER.sub("", m[0])) <= 15]
    return sorted(out)


def code(text: str) -> int:
    """A signed 64-bit hash."""
    h = xxh64_intdigest(text.encode())
    return h - (1 << 64) if h >> 63 else h


def entity(text: str, span: tuple[int, int, int]) -> int:
    value = text[span[0] : span[2]]
    return code(KINDS[span[1]] + ":" + (value.lower() if span[1] == 0 else value if span[1] == 1 else OTHER.sub("", value)))


def contexts(text: str, spans: list[tuple[int, int, int]], reach: int) -> Iterator[tuple[int, set[str]]]:
    """(entity, terms) for each entity in each line that holds a span, once a line."""
    at = 0
    for m in LINE.finditer(text):
        own = []
        while at < len(spans) and spans[at][0] < m.end():
            own.append(spans[at])
            at += 1
        if not own:
            continue
        words = [(w.start(), w[0].lower()) for w in TERM.finditer(text, m.start(), m.end())]
        words = [w for w, free in zip(words, outside([(a, a + len(w)) for a, w in words], own), strict=True) if free]
        starts = [s for s, _ in words]
        found: dict[int, set[str]] = {}
        for span in own:
            k = bisect_left(starts, span[0])
            found.setdefault(entity(text, span), set()).update(w for _, w in words[max(0, k - reach) : k + reach])
        yield from found.items()


def outside(words: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[bool]:
    """For each of the words (start, end), by start: does it overlap none of the spans, by start?"""
    out, at, covered_to = [], 0, 0
    for a, b in words:
        while at < len(spans) and spans[at][0] < b:
            covered_to = max(covered_to, spans[at][2])
            at += 1
        out.append(covered_to <= a)
    return out


def gather(docs: DataFrame, text_col: str, reach: int) -> DataFrame:
    """(entity, term, own): a row for each entity, line and near term with a hash of the whole text; term 0 stands for the line
    itself, and entity and term 0 carry a count of lines in ``own``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = 0
        for b in slices(batches):
            e_col: list[int] = []
            t_col: list[int] = []
            o_col: list[int] = []
            for text in texts_of(b):
                lines += text.count("\n") + 1
                spans = base_spans(text)
                own = code(text) if spans else 0
                for e, terms in contexts(text, spans, reach) if spans else ():
                    e_col += [e] * (len(terms) + 1)
                    t_col += [0, *map(code, terms)]
                    o_col += [own] * (len(terms) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (e_col, t_col, o_col)], names=["entity", "term", "own"])
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (0, 0, lines)], names=["entity", "term", "own"])

    return docs.select(quoted(text_col).alias("text")).mapInArrow(run, "entity long, term long, own long")


def count_terms(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, lines): lines of the corpus that hold each term, counted in each task before the shuffle."""

    def rows_of(found: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(map(code, found)), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["term", "lines"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in slices(batches):
            for text in texts_of(b):
                for line in text.lower().split("\n"):
                    found.update(set(TERM.findall(line)))
            if len(found) > PARTIAL:
                yield rows_of(found)
                found = Counter()
        yield rows_of(found)

    return docs.select(quoted(text_col).alias("text")).mapInArrow(run, "term long, lines long").groupBy("term").agg(F.sum("lines").alias("lines"))


def surely(hits, trials, z: float):
    """The lower end of Wilson's interval for a share of ``hits`` (a share) in ``trials``."""
    return (hits + z * z / (2 * trials) - z * F.sqrt(hits * (1 - hits) / trials + z * z / (4 * trials * trials))) / (1 + z * z / trials)


def revealing(docs: DataFrame, *, text_col: str = "text", reach: int = 20, share: float = 0.8, z: float = 1.645) -> DataFrame:
    """(entity, term, whole): the pairs over the disclosure threshold; whole where the term gives the entity away."""
    rows = written(gather(docs, text_col, reach))
    most = rows.count() // 1000 + 100
    lines = float(max(1, rows.where("entity = 0 and term = 0").agg(F.sum("own")).first()[0] or 0))
    pairs = written(rows.where("term <> 0").groupBy("entity", "term").agg(F.count("*").alias("joint"), F.countDistinct("own").alias("texts")))
    entities = rows.where("entity <> 0").groupBy("entity").agg(F.count_if(F.col("term") == 0).alias("of_entity"), F.count_if(F.col("term") != 0).alias("n"))
    terms = written(pairs.groupBy("term").agg(F.count("*").alias("n")).join(count_terms(docs, text_col), "term"))
    known = written(join_hot(pairs, terms, "term", most))
    known = join_hot(known, written(entities), "entity", most)
    of_term = F.greatest("lines", "joint")
    low = surely(F.col("joint") / of_term, of_term * F.col("texts") / F.col("joint"), z)
    known = known.withColumn("pmi", F.log2(low * lines / F.col("of_entity"))).withColumn("information", F.log2(F.lit(lines) / F.col("of_entity")))
    return known.where((F.col("pmi") >= share * F.col("information")) & (F.col("pmi") > 0)).select("entity", "term", (F.col("joint") >= F.col("lines")).alias("whole"))


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("end", T.IntegerType())]))
ARROW_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))
REMOVED = len(KINDS)


def covered(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with entities and terms replaced; a span inside a longer one goes with it."""
    out, at = [], 0
    for start, rank, end in sorted(spans, key=lambda s: (s[0], -s[2])):
        if start < at:
            at = max(at, end)
            continue
        out += [text[at:start], "" if rank == REMOVED else f"<{KINDS[rank].upper()}>"]
        at = end
    return "".join([*out, text[at:]])


class Pairs:
    """Sorted arrays: the terms of each entity, and whether each gives it away."""

    def __init__(self, entity: np.ndarray, term: np.ndarray, whole: np.ndarray):
        order = np.argsort(entity, kind="stable")
        self.entity, self.first = np.unique(entity[order], return_index=True)
        self.first, self.term, self.whole = np.append(self.first, len(entity)), term[order], whole[order]

    def of(self, entity: int) -> Iterator[tuple[int, bool]]:
        k = int(np.searchsorted(self.entity, entity))
        if k < len(self.entity) and self.entity[k] == entity:
            own = slice(self.first[k], self.first[k + 1])
            yield from zip(self.term[own].tolist(), self.whole[own].tolist(), strict=True)


def sanitise(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, replace: bool = False, block: int = 1 << 21, spans_col: str = "spans", **options) -> DataFrame:
    """Columns ``keep`` (all by default) and ``spans_col``: (start, rank, end) by start, then rank; rank is a place in KINDS, and
    REMOVED for a term that goes entirely.  With ``replace`` the text column holds the sanitised text."""
    pairs = written(revealing(docs, text_col=text_col, **options))
    blocks = max(1, -(-pairs.count() // block))
    keep = [c for c in (docs.columns if keep is None else keep) if c != spans_col]
    now = docs.select(*map(quoted, dict.fromkeys([*keep, text_col]))).withColumn(spans_col, F.lit(None).cast(SPAN))
    schema = now.schema
    for k in range(blocks):
        got = pairs.where(F.pmod(F.xxhash64("entity"), F.lit(blocks)) == k).toArrow()  # about ``block`` pairs
        table = Pairs(*(got[c].to_numpy() for c in ("entity", "term", "whole")))
        now = map_rows(now, marker(docs.sparkSession.sparkContext.broadcast(table), text_col, spans_col, replace and k == blocks - 1), schema)
        if k < blocks - 1:
            now = written(now)
    return now.select(*map(quoted, keep), spans_col)


def marker(sent, text_col: str, spans_col: str, replace: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for b in slices(batches, text_col):
            texts, all_spans = texts_of(b, text_col), []
            earlier = column_of(b, spans_col).to_pylist()
            for text, before in zip(texts, earlier, strict=True):
                base = base_spans(text)
                spans = {(s["start"], s["rank"], s["end"]) for s in before or ()} | set(base)
                terms: dict[int, bool] = {}
                for e in {entity(text, s) for s in base}:
                    for t, whole in table.of(e):
                        terms[t] = whole or terms.get(t, False)
                if terms:
                    known: dict[str, bool | None] = {}
                    words = [(m.start(), m.end()) for m in TERM.finditer(text)]
                    for (a, z), free in zip(words, outside(words, base), strict=True):
                        w = text[a:z].lower()
                        if w not in known:
                            known[w] = terms.get(code(w))
                        if known[w] is not None and free:
                            spans.add((a, REMOVED if known[w] else KINDS.index("term"), z))
                all_spans.append(sorted(spans))
            cols = [b.column(i) for i in range(b.num_columns)]
            cols[b.schema.get_field_index(spans_col)] = pa.array([[{"start": a, "rank": k, "end": z} for a, k, z in s] for s in all_spans], ARROW_SPAN)
            if replace:
                i = b.schema.get_field_index(text_col)
                nulls = b.column(i).is_null().to_pylist()
                cols[i] = pa.array([None if n else covered(t, s) if s else t for t, s, n in zip(texts, all_spans, nulls, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return run


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, the hash of the base spans and all spans as text."""
    names = F.array(*map(F.lit, [*KINDS, "removed"]))
    base = F.filter("spans", lambda s: s["rank"] < KINDS.index("term"))

    def line(s):
        return F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))

    def count(rank: int):
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")

    return found.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate([*KINDS, "removed"])),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"),
    )
