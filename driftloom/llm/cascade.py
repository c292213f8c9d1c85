"""Quality rules as a short-circuit cascade.

Each rule looks at lazily computed properties of one text, and a text leaves at its first rejection.  The order is planned on
a bounded sample: the rule that rejects most per second comes first; the others are measured again on the texts that it
leaves, whose properties it may have computed already, and so on.  The order changes the time taken, never the verdict: a text
is kept when no rule rejects it.

Words are runs of other than space and \\t \\n \\v \\f \\r.  Counts for reports: n_words, word_chars (code points in
words), n_symbols (of #*$%&|<>), n_dup_lines (lines with a word that equal an earlier line), n_repeat_words (words in
three-word windows that occur twice or more in the text).

Defined cases: a null or empty text has no words and fails; equal rows get equal verdicts; an empty table gives no rows;
extra columns stay as they are unless they bear the name of a result column, which is then replaced (the verdict's can be named
otherwise).
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.llm.common import bytes_of, map_rows, quoted, slices

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
NOT_STARTS = bytes(range(0x80, 0xC0))
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_SHARE = 512, 1 << 16, 1 / 16


class Text:
    """One text's properties, each computed when first asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, NOT_STARTS + SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def dup_line_bytes(self) -> int:
        """Bytes in lines that equal an earlier line."""
        return sum(map(len, self.lines)) - sum(map(len, set(self.lines)))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        grams = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(grams)) == len(grams):
            return 0
        found, end, total = Counter(grams), 0, 0
        for i, g in enumerate(grams):
            if found[g] > 1:
                total += i + 3 - max(i, end)
                end = i + 3
        return total

    @cached_property
    def upper_share(self) -> float:
        raw = self.raw
        upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        lower = len(raw) - len(raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
        return upper / max(1, upper + lower)

    @cached_property
    def wordlike(self) -> float:
        """Share of words that hold a letter (any byte above ASCII counts as one)."""
        return sum(1 for x in self.words if x.upper() != x.lower() or not x.isascii()) / max(1, self.n_words)

    @cached_property
    def top_share(self) -> float:
        return max(Counter(self.words).values(), default=0) / max(1, self.n_words)


Rule = Callable[[Text], bool]

RULES: dict[str, Rule] = {
    "few_words": lambda t: t.n_words < 50,
    "repeated_windows": lambda t: 100 * t.n_repeat_words > 50 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > 2 * t.n_words,
    "duplicate_lines": lambda t: 10 * t.dup_line_bytes > 3 * len(t.raw),
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 16 * t.n_words,
    "shouting": lambda t: t.upper_share > 0.5,
    "few_wordlike": lambda t: t.wordlike < 0.6,
    "one_word": lambda t: t.top_share > 0.3,
    "ellipsis_lines": lambda t: 10 * sum(x.rstrip().endswith((b"...", "…".encode())) for x in t.lines) > 5 * len(t.lines),
    "bullet_lines": lambda t: 10 * sum(x.lstrip().startswith((b"- ", b"* ", "•".encode())) for x in t.lines) > 9 * len(t.lines),
}


def sample(docs: DataFrame, *, text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[bytes]:
    """At most ``rows`` texts of at most SAMPLE_BYTES: random rows of as few partitions as hold so many."""
    text = quoted(text_col)
    short = docs.select(F.coalesce(text.cast("binary"), F.lit(b"")).alias("raw")).where(F.octet_length("raw") <= SAMPLE_BYTES)
    return [bytes(r.raw) for r in short.sample(SAMPLE_SHARE, 7).limit(rows).collect()]  # at most rows x SAMPLE_BYTES


def profile(raws: list[bytes], rules: dict[str, Rule] | None = None) -> list[tuple[str, float, float]]:
    """(rule, mean seconds, share rejected) in the order planned: each rule on the texts that those before it leave."""
    left, texts, out = dict(rules or RULES), [Text(r) for r in raws], []
    while left:
        tried = {}
        for name, rule in left.items():
            own = [Text(t.raw) for t in texts]
            for new, t in zip(own, texts, strict=True):
                new.__dict__.update(t.__dict__)
            began = time.perf_counter()
            hits = [bool(rule(t)) for t in own]
            tried[name] = (time.perf_counter() - began) / max(1, len(own)), sum(hits) / max(1, len(own)), [t for t, h in zip(own, hits, strict=True) if not h]
        best = ranked({k: (cost, rate) for k, (cost, rate, _) in tried.items()})[0]
        cost, rate, texts = tried[best]
        out.append((best, cost, rate))
        del left[best]
    return out


def ranked(costs: dict[str, tuple[float, float]]) -> list[str]:
    """Rules by falling rejection per second, the cheaper first among equals."""
    return sorted(costs, key=lambda k: (-costs[k][1] / max(costs[k][0], 1e-9), costs[k][0], k))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def cascade(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, counts: bool = True, rules: dict[str, Rule] | None = None, order: list[str] | None = None, kept_col: str = "kept") -> DataFrame:
    """Columns ``keep`` (all by default) with ``kept_col``, and the five counts and ``base_failed`` if ``counts``."""
    rules = rules or RULES
    order = order or [name for name, _, _ in profile(sample(docs, text_col=text_col), rules)]
    added = [*(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType())] if counts else []
    added.append(T.StructField(kept_col, T.BooleanType()))
    names = {f.name for f in added}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    base = docs.select(*map(quoted, dict.fromkeys([*keep, text_col])))
    schema = T.StructType([*(base.schema[c] for c in keep), *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = [rules[k] for k in order]
        for b in slices(batches, text_col):
            cols: list[list] = [[] for _ in added]
            for raw in bytes_of(b, text_col):
                t = Text(raw)
                kept = not any(rule(t) for rule in steps)
                if counts:
                    failed = t.n_words < 50 or 100 * t.n_repeat_words > 50 * t.n_words
                    row = (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, kept and not failed)
                else:
                    row = (kept,)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.bool_() for f in added]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*keep, *(f.name for f in added)])

    return map_rows(base, run, schema)
