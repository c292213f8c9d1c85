"""Language identification, words first, then ever shorter character n-grams.

Training counts the words of each language over all training rows, and from the counted words their character n-grams (word
ends marked), orders 1 to ``longest``.  The model holds every counted entry: the counts are cut by hash into shards of about
``shard_entries`` entries, each written once as sorted keys with log frequencies, and the shards' files are memory-mapped by
the scoring tasks.  So a task's memory does not grow with the corpus, and nothing is pruned.

A word in the model scores by its log frequency in each language (half an occurrence where a language lacks it).  A word
outside it falls back to its n-grams of the longest order of which the model knows any, by the mean of their log frequencies.
A text's sum over its words gives the language (the first by name among equals) and, by the softmax, the score.

Words are runs of letters in lower case.  Defined cases: null texts and texts without a letter are ``und`` with score 0, and
so is every text where there are no training rows; equal rows get equal results; an empty table gives no rows; extra columns
are not read, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from driftloom.llm.common import column_of, fold_column, quoted, shared_dir, slices, texts_of, written
from driftloom.llm.eflm import mapped, save

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
PARTIAL = 400_000
SLICE = 2 << 20
SEED = 42  # that of the engine's own hash of text


def grams(word: str, order: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def hashes(keys: list[str]) -> np.ndarray:
    return np.fromiter((xxh64_intdigest(k.encode(), SEED) for k in keys), dtype=np.uint64, count=len(keys))


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, key, n) over all rows, summed in each task before the shuffle."""

    def rows_of(counts: dict[str, Counter]) -> pa.RecordBatch:
        langs = [k for k, c in counts.items() for _ in c]
        keys = [w for c in counts.values() for w in c]
        values = [n for c in counts.values() for n in c.values()]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.string()), pa.array(values, pa.int64())], names=["lang", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for b in slices(batches, "text"):
            for lang, text in zip(column_of(b, "lang").to_pylist(), texts_of(b), strict=True):
                counts.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            if sum(map(len, counts.values())) > PARTIAL:
                yield rows_of(counts)
                counts = {}
        yield rows_of(counts)

    parts = docs.select(quoted(text_col).alias("text"), quoted(lang_col).alias("lang")).mapInArrow(run, "lang string, key string, n long")
    return parts.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, longest: int) -> DataFrame:
    """(lang, h, n) of the words' n-grams by their hashes."""

    def rows_of(counts: dict[str, Counter]) -> pa.RecordBatch:
        langs = [k for k, c in counts.items() for _ in c]
        keys = np.concatenate([np.zeros(0, np.uint64), *(hashes(list(c)) for c in counts.values())])
        values = [n for c in counts.values() for n in c.values()]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys.view(np.int64)), pa.array(values, pa.int64())], names=["lang", "h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for b in batches:
            for lang, word, n in zip(*(column_of(b, c).to_pylist() for c in ("lang", "key", "n")), strict=True):
                own = counts.setdefault(lang, Counter())
                for order in range(1, longest + 1):
                    for g in grams(word, order):
                        own[g] += n
            if sum(map(len, counts.values())) > PARTIAL:
                yield rows_of(counts)
                counts = {}
        yield rows_of(counts)

    return words.mapInArrow(run, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))


class Table:
    """Log frequencies by hash and language.  A shard's file holds sorted keys, where each key's entries begin, their languages
    and their log frequencies; ``files`` has "" for a shard without entries.  ``floor``: a row for what a language lacks."""

    def __init__(self, files: list[str], floor: np.ndarray):
        self.files, self.floor, self.opened = files, floor, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"opened": {}}

    def shard(self, s: int) -> tuple[np.ndarray, ...]:
        if s not in self.opened:
            keys, first, langs, logs = mapped(self.files[s])
            self.opened[s] = keys, first.view(np.int64), langs.view(np.uint32), logs.view(np.float32)
        return self.opened[s]

    def rows(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, log frequency in each language) for each of the keys."""
        known, out = np.zeros(len(keys), dtype=bool), np.tile(self.floor, (len(keys), 1))
        if not self.files or not len(keys):
            return known, out
        order = np.argsort(keys)
        part = shard_of(keys[order], len(self.files))
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
            if not self.files[part[a]]:
                continue
            own, first, langs, logs = self.shard(int(part[a]))
            wanted = keys[order[a:b]]
            at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            hit = own[at] == wanted
            at, place = at[hit], order[a:b][hit]
            known[place] = True
            sizes = first[at + 1] - first[at]
            entry = np.repeat(first[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            out[np.repeat(place, sizes), langs[entry]] = logs[entry]
        return known, out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def stored(counts: DataFrame, langs: dict[str, int], shard_entries: int) -> Table:
    """Writes (lang, h, n) as a Table; ``langs`` gives the sum over each language, in the order of the model."""
    spark, folder = counts.sparkSession, shared_dir(counts.sparkSession)
    totals, names = np.array(list(langs.values()), dtype=float), list(langs)
    shards = max(1, -(-counts.count() // shard_entries))
    number = F.create_map(*[F.lit(x) for i, name in enumerate(names) for x in (name, i)])
    shard = F.shiftrightunsigned(F.shiftrightunsigned("h", 32) * F.lit(shards), 32).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            keys, lang, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((lang, keys))
            keys, lang, n = keys[order], lang[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            uri = f"{folder}/{now:06d}-{uuid.uuid4().hex[:12]}"
            save(uri, [keys[first], np.append(first, len(keys)).astype(np.int64), lang.astype(np.uint32), np.log(n / totals[lang]).astype(np.float32)])
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([uri])], names=["shard", "uri"])

        for b in batches:
            parts = column_of(b, "shard").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else np.zeros(0, np.int64)
            for a, z in zip(cuts, [*cuts[1:], len(parts)], strict=False):
                if parts[a] != now and held:
                    yield close()
                    held = []
                now = int(parts[a])
                held.append(tuple(column_of(b, c).to_numpy(zero_copy_only=False)[a:z] for c in ("h", "l", "n")))
                held[-1] = (held[-1][0].view(np.uint64), held[-1][1].astype(np.int64), held[-1][2])
        if held:
            yield close()

    tasks = min(shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = counts.select(shard.alias("shard"), "h", number[F.col("lang")].alias("l"), "n").repartition(tasks, "shard").sortWithinPartitions("shard")
    files = [""] * shards
    for r in rows.mapInArrow(run, "shard int, uri string").collect():  # a row for each shard
        files[r.shard] = r.uri
    return Table(files, np.log(0.5 / totals))


class Model:
    """``words`` and ``parts`` give log frequencies of words and of n-grams; small to send, as the tables are files."""

    def __init__(self, langs: list[str], words: Table, parts: Table, longest: int):
        self.langs, self.words, self.parts, self.longest = langs, words, parts, longest

    def fallback(self, words: list[str]) -> np.ndarray:
        """A row for each word: the mean over its known n-grams of the longest order of which any is known, 0 without any."""
        out, left = np.zeros((len(words), len(self.langs))), np.arange(len(words))
        for order in range(self.longest, 0, -1):
            if not len(left):
                break
            own = [grams(words[i], order) for i in left]
            sizes = np.array([len(g) for g in own])
            unique, back = np.unique(hashes([g for x in own for g in x]), return_inverse=True)
            known, rows = self.parts.rows(unique)
            of = np.repeat(np.arange(len(left)), sizes)[known[back]]
            count = np.bincount(of, minlength=len(left))
            for k in range(len(self.langs)):
                out[left, k] = np.where(count > 0, np.bincount(of, weights=rows[back[known[back]], k], minlength=len(left)) / np.maximum(count, 1), out[left, k])
            left = left[count == 0]
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text; the texts' distinct words are looked up together."""
        numbers: dict[str, int] = {}
        ids = [np.array([numbers.setdefault(w, len(numbers)) for w in WORD.findall(t.lower())], dtype=np.int64) for t in texts]
        words = list(numbers)
        lettered = np.fromiter((any(map(str.isalpha, w)) for w in words), dtype=bool, count=len(words))
        if self.langs:
            known, rows = self.words.rows(hashes(words))
            unseen = np.flatnonzero(~known)
            rows[unseen] = self.fallback([words[i] for i in unseen])
        out = []
        for own in ids:
            if not self.langs or not lettered[own].any():
                out.append((UNKNOWN, 0.0))
                continue
            total = sum(rows[own[a : a + 65536]].sum(axis=0) for a in range(0, len(own), 65536))
            k = int(total.argmax())
            out.append((self.langs[k], float(1 / np.exp(total - total[k]).sum())))
        return out


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = 5, shard_entries: int = 1 << 20) -> Model:
    """A model from rows with text and language."""
    words = written(word_counts(docs.where(quoted(lang_col).isNotNull() & quoted(text_col).isNotNull()), text_col, lang_col))
    totals = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()}  # a row for each language
    if not totals:
        return Model([], Table([], np.zeros(0)), Table([], np.zeros(0)), longest)
    parts = written(gram_counts(words, longest))
    gram_totals = {r.lang: r.n for r in parts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()}
    return Model(list(totals), stored(words.select("lang", F.xxhash64("key").alias("h"), "n"), totals, shard_entries), stored(parts, gram_totals, shard_entries), longest)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, **options) -> DataFrame:
    """doc_id, held_out (fold 0, from which nothing is learned), lang_pred, score."""
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"), quoted(lang_col).alias("lang")).withColumn("held_out", fold_column("doc_id", folds) == 0)
    model = train(rows.where("not held_out"), **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=SLICE):
            found = model.predict(texts_of(b))
            yield pa.RecordBatch.from_arrays([column_of(b, "doc_id"), column_of(b, "held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
