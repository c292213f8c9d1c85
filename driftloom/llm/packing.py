"""Hierarchical multi-length packing.

Every document is tokenised and closed with an end id.  Strings of special tokens in a text are ordinary text, as the
vocabulary files' own description has it (``specials`` gives them their ids instead).  Whole windows of the longest context are cut off first; what
remains is routed to the smallest context tier (powers of two) that holds it.  Tiers are packed from the longest down:
the gap behind a long piece is filled with the largest fitting pieces of the shorter tiers, and one short piece is cut
where nothing fits exactly, so no window has padding.  Sequences of one tier are then dealt into step groups of equal
token count whose attention costs (sum of squared piece lengths) are balanced.

Packing works on a bounded buffer of tokens inside each input partition: nothing is shuffled, nothing is collected, and
a lost task is redone from its own input.  What does not fill a window stays in the buffer; at the end of a partition
the last partial window is cut at powers of two.  Ids of sequences and groups hold the partition number.

Defined cases: null and empty texts are one end id; equal rows are packed like any other rows; a null doc_id is kept;
an empty table gives no rows; columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from driftloom.llm.common import column_of, quoted, slices, texts_of

SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "tier int, sequence_tokens long, step_group long"
)
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("sequence_tokens", pa.int64()), ("step_group", pa.int64()),
])


@lru_cache(maxsize=4)
def encoder(path: str, specials: bool = False):
    """text -> uint32 ids, those of the vocabulary's own library without added tokens.  A file of ranks next to a .json
    vocabulary of the same name is used for speed where specials are ordinary text; both give the same ids (tests hold them
    against each other)."""
    ranks = path.removesuffix(".json") + ".tiktoken"
    try:
        import base64

        import public_tokenizers
        import tiktoken

        if specials:
            raise FileNotFoundError(path)
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        return lambda text: np.asarray(enc.encode_to_numpy(text, disallowed_special=()), dtype=np.uint32)
    except (ImportError, FileNotFoundError):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.encode_special_tokens = not specials
        return lambda text: np.asarray(tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


class Pool:
    """Pieces by length; the largest length at most x, or the smallest above x, is found with one bit operation."""

    def __init__(self, top: int):
        self.by_length: list[list] = [[] for _ in range(top + 1)]
        self.mask = 0

    def add(self, piece) -> None:
        n = piece[2]
        self.by_length[n].append(piece)
        self.mask |= 1 << n

    def pop(self, n: int):
        piece = self.by_length[n].pop()
        if not self.by_length[n]:
            self.mask &= ~(1 << n)
        return piece

    def largest(self, most: int) -> int:
        """0 if there is none."""
        return max(0, (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def smallest_above(self, n: int) -> int:
        rest = self.mask >> (n + 1)
        return n + (rest & -rest).bit_length() if rest else 0


class Packer:
    """Packs pieces (document index, start, length) into full windows; see the module's docstring."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tuple(sorted(tiers))
        self.top = self.tiers[-1]
        self.pool = Pool(self.top)

    def add(self, doc, tokens: int) -> list[list]:
        """Sequences that the document fills alone; the rest goes to the pool."""
        whole, rest = divmod(tokens, self.top)
        out = [[(doc, k * self.top, self.top)] for k in range(whole)]
        if rest in self.tiers:
            out.append([(doc, whole * self.top, rest)])
        elif rest:
            self.pool.add((doc, whole * self.top, rest))
        return out

    def full_windows(self) -> list[list]:
        """Packs all but what cannot fill one more window; the rest stays in the pool."""
        out, pool = [], self.pool
        for tier, below in zip(self.tiers[::-1], [*self.tiers[-2::-1], 0], strict=True):
            while (n := pool.largest(tier)) > below:
                window, gap = [pool.pop(n)], tier - n
                while gap:
                    if m := pool.largest(min(gap, self.top)):
                        window.append(pool.pop(m))
                        gap -= m
                    elif m := pool.smallest_above(gap):
                        doc, start, size = pool.pop(m)
                        window.append((doc, start, gap))
                        pool.add((doc, start + gap, size - gap))
                        gap = 0
                    else:
                        break
                if gap:
                    for piece in window:
                        pool.add(piece)
                    return out
                out.append(window)
        return out

    def tail(self) -> list[list]:
        """Empties the pool: what is left is cut at powers of two, the largest first."""
        pieces, out, pool = [], [], self.pool
        while n := pool.largest(self.top):
            pieces.append(pool.pop(n))
        pieces.reverse()
        left = sum(p[2] for p in pieces)
        while left:
            room = min(self.top, 1 << (left.bit_length() - 1))
            left -= room
            window = []
            while room:
                doc, start, size = pieces.pop()
                take = min(room, size)
                window.append((doc, start, take))
                room -= take
                if take < size:
                    pieces.append((doc, start + take, size - take))
            out.append(window)
        return out


def step_groups(windows: list[list], step_tokens: int) -> list[int]:
    """A group number for each window: groups hold one tier and ``step_tokens`` tokens; windows are dealt to and fro by
    falling attention cost, so that groups of a tier cost nearly the same."""
    by_tier: dict[int, list[int]] = {}
    for i, w in enumerate(windows):
        by_tier.setdefault(sum(p[2] for p in w), []).append(i)
    group, first = [0] * len(windows), 0
    for size in sorted(by_tier):
        own = sorted(by_tier[size], key=lambda i: -sum(p[2] ** 2 for p in windows[i]))
        n = max(1, -(-len(own) * size // step_tokens))
        for k, i in enumerate(own):
            turn, at = divmod(k, n)
            group[i] = first + (at if turn % 2 == 0 else n - 1 - at)
        first += n
    return group


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
                   tiers: tuple[int, ...] = (256, 512, 1024, 2048), step_tokens: int = 1 << 16, buffer_tokens: int = 1 << 22, specials: bool = False) -> DataFrame:
    """One row per piece, with its token ids (little-endian unsigned 32-bit), its place and its step group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer_path, specials), Packer(tiers)
        part = TaskContext.get().partitionId() << 40
        tokens: dict[int, np.ndarray] = {}
        names: dict[int, int | None] = {}
        count = sequences = groups = held = 0
        ready: list[list] = []

        def flush() -> pa.RecordBatch:
            nonlocal sequences, groups, ready, held
            group = step_groups(ready, step_tokens)
            rows: list[tuple] = []
            for k, w in enumerate(ready):
                size, at = sum(p[2] for p in w), 0
                tier = next((t for t in packer.tiers if t >= size), packer.top)
                for d, start, n in w:
                    ids = tokens[d]
                    rows.append((names[d], start, n, ids[start : start + n].tobytes(), len(ids), part | sequences + k, at, tier, size, part | groups + group[k]))
                    at += n
            sequences += len(ready)
            groups += max(group, default=-1) + 1
            ready = []
            keep = {p[0] for own in packer.pool.by_length for p in own}
            for d in [d for d in tokens if d not in keep]:
                del tokens[d], names[d]
            held = sum(map(len, tokens.values()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(ARROW)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ARROW, strict=True)], schema=ARROW)

        for b in slices(batches, text_col):
            for name, text in zip(column_of(b, id_col).to_pylist(), texts_of(b, text_col), strict=True):
                ids = tokens[count] = np.append(encode(text), np.uint32(end_id))
                names[count] = name
                ready += packer.add(count, len(ids))
                held += len(ids)
                count += 1
                if held >= buffer_tokens:
                    ready += packer.full_windows()
                    yield flush()
        ready += packer.full_windows() + packer.tail()
        yield flush()

    return docs.select(quoted(id_col), quoted(text_col)).mapInArrow(run, SCHEMA)
