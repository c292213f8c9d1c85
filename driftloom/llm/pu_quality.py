"""Quality classifier by positive-unlabelled learning (non-negative unbiased risk, squared loss).

Texts become a few statistics (length, symbols, case, repetition, ...), each cut into fixed bins; a one-hot vector of bins
feeds a linear scorer g.  With the loss (1 - yg)^2 / 4 the PU risk

    prior E_p[(1 - g)^2] / 4 + max(0, E_u[(1 + g)^2] / 4 - prior E_p[(1 + g)^2] / 4)

needs only the first and second moments of the one-hot vectors over positives and over unlabelled text.  They are summed
over all training documents in one pass as matrices of fixed size; the driver then minimises the risk exactly as it would
over all rows, stepping back along the second term wherever it turns negative.

Positives are the trusted labels 1 outside the held-out fold, unlabelled are all documents outside it; labels 0 are not used.
The class prior comes from the score tails (best bin estimate): the least ratio of the unlabelled to the positive tail, with
a confidence allowance.  It starts at ``first_prior`` and is estimated once, after a first fit.

The score is (1 + g) / 2 in [0, 1], the squared loss's estimate of P(good | text).
Defined cases: null and empty texts have the statistics of no words; equal rows score alike; without positives every score
is ``first_prior``; an empty table gives no rows; repeated labels of an id count once (the greatest); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.cascade import Text
from driftloom.llm.common import bytes_of, column_of, fold_column, quoted, slices, written

#: For each statistic, the upper ends of its bins but the last.
BINS: dict[str, tuple[float, ...]] = {
    "words": (1, 10, 25, 50, 100, 300, 1000, 5000),
    "symbols": (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0),
    "upper": (0.0, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.7),
    "duplicate_lines": (0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9),
    "repeated_windows": (0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.8),
    "word_length": (2.5, 3.5, 4.5, 5.5, 6.5, 8.0, 10.0, 14.0),
    "wordlike": (0.3, 0.5, 0.7, 0.8, 0.9, 0.95, 0.98, 0.995),
    "top_word": (0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5, 0.8),
    "distinct": (0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95),
    "shouts": (0.0, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 0.8),
    "digits": (0.0, 0.005, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5),
    "line_words": (2, 5, 10, 20, 40, 80, 150, 300),
}
NAMES = tuple(BINS)
WIDTH = 9
SIZE = WIDTH * len(NAMES) + 1  # and a constant


def statistics(raw: bytes) -> list[float]:
    t = Text(raw)
    n = max(1, t.n_words)
    return [
        t.n_words,
        t.n_symbols / n,
        t.upper_share,
        t.n_dup_lines / max(1, len(t.lines)),
        t.n_repeat_words / n,
        t.word_chars / n,
        t.wordlike,
        t.top_share,
        len(set(t.words)) / n,
        (raw.count(b"!") + raw.count(b"?")) / n,
        (len(raw) - len(raw.translate(None, b"0123456789"))) / max(1, len(raw)),
        n / max(1, len(t.lines)),
    ]


def bins_of(values: np.ndarray) -> np.ndarray:
    """Bin numbers, a row for each text."""
    return np.stack([np.searchsorted(np.array(BINS[k]), values[:, i], side="left") for i, k in enumerate(NAMES)], axis=1).astype(np.uint8)


def one_hot(bins: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bins), SIZE))
    out[:, -1] = 1
    rows = np.arange(len(bins))
    for i in range(len(NAMES)):
        out[rows, i * WIDTH + bins[:, i]] = 1
    return out


def features(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            values = np.array([statistics(x) for x in bytes_of(b, text_col)], dtype=np.float64).reshape(b.num_rows, len(NAMES))
            packed = [x.tobytes() for x in bins_of(values)]
            yield pa.RecordBatch.from_arrays([column_of(b, id_col).cast(pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "bins"])

    return docs.select(quoted(id_col), quoted(text_col)).mapInArrow(run, "doc_id long, bins binary")


def unpacked(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(column_of(b, "bins").to_pylist()), dtype=np.uint8).reshape(b.num_rows, len(NAMES))


def moments(rows: DataFrame, groups: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Second moments (the last row holds the first ones, the corner the count) over rows with ``positive`` and over all rows.
    Partial sums are matrices of fixed size, added in ``groups`` tasks and then on the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE, SIZE))
        for b in batches:
            bins, positive = unpacked(b), column_of(b, "positive").to_numpy(zero_copy_only=False)
            for at in range(0, len(bins), 8192):
                x = one_hot(bins[at : at + 8192])
                p = x[positive[at : at + 8192]]
                total[0] += p.T @ p
                total[1] += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SIZE, SIZE))
        for b in batches:
            for x in column_of(b, "sums").to_pylist():
                total += np.frombuffer(x).reshape(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    total = np.zeros((2, SIZE, SIZE))
    for r in rows.mapInArrow(add, "sums binary").repartition(groups).mapInArrow(merge, "sums binary").collect():  # ``groups`` rows
        total += np.frombuffer(r.sums).reshape(total.shape)
    return total[0], total[1]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, ridge: float = 1e-3, steps: int = 3000) -> np.ndarray:
    """Weights of g by gradient steps on the non-negative risk."""
    p, u = positive / max(1, positive[-1, -1]), unlabelled / max(1, unlabelled[-1, -1])
    w = np.zeros(SIZE)
    rate = 1.0 / (0.5 * (np.linalg.eigvalsh(u)[-1] + 2 * prior * np.linalg.eigvalsh(p)[-1]) + ridge)

    def below(m: np.ndarray, sign: int) -> float:  # E[(1 + sign g)^2] / 4
        return (1 + 2 * sign * m[-1] @ w + w @ m @ w) / 4

    def slope(m: np.ndarray, sign: int) -> np.ndarray:
        return (sign * m[-1] + m @ w) / 2

    for _ in range(steps):
        if below(u, 1) - prior * below(p, 1) < 0:
            step = -(slope(u, 1) - prior * slope(p, 1))
        else:
            step = prior * slope(p, -1) + slope(u, 1) - prior * slope(p, 1) + 2 * ridge * w
        w = w - rate * step
    return w


def tails(rows: DataFrame, weights: np.ndarray, cells: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Counts by score cell over positives and over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, cells), dtype=np.int64)
        for b in batches:
            cell = np.minimum((scores(unpacked(b), weights) * cells).astype(int), cells - 1)
            found[1] += np.bincount(cell, minlength=cells)
            found[0] += np.bincount(cell[column_of(b, "positive").to_numpy(zero_copy_only=False)], minlength=cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(found[0]), pa.array(found[1])], names=["cell", "p", "u"])

    out = np.zeros((2, cells))
    for r in rows.mapInArrow(run, "cell long, p long, u long").groupBy("cell").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).collect():  # ``cells`` rows
        out[:, r.cell] = r.p, r.u
    return out[0], out[1]


def best_bin_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The least, over score thresholds, of the tail ratio plus its confidence width."""
    p, u = positive[::-1].cumsum(), unlabelled[::-1].cumsum()
    n, m = max(1, p[-1]), max(1, u[-1])
    width = (np.log(40) / (2 * n)) ** 0.5 + (np.log(40) / (2 * m)) ** 0.5
    q_p, q_u = p / n, u / m
    ok = q_p > 0
    bound = np.full(len(p), np.inf)
    bound[ok] = (q_u[ok] + width) / q_p[ok]
    k = int(bound.argmin())
    return float(np.clip(q_u[k] / q_p[k], 0.01, 0.99)) if np.isfinite(bound[k]) else 0.5


def scores(bins: np.ndarray, weights: np.ndarray) -> np.ndarray:
    g = np.full(len(bins), weights[-1])
    for i in range(len(NAMES)):
        g += weights[i * WIDTH + bins[:, i].astype(int)]
    return np.clip((1 + g) / 2, 0, 1)


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, first_prior: float = 0.5, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out (fold 0), score, predicted."""
    seen = written(features(docs, id_col=id_col, text_col=text_col)).withColumn("held_out", fold_column("doc_id", folds) == 0)
    trusted = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id")).distinct().withColumn("positive", F.lit(True))
    training = written(seen.where("not held_out").join(trusted, "doc_id", "left").select("bins", F.coalesce("positive", F.lit(False)).alias("positive")))
    positive, unlabelled = moments(training)
    if positive[-1, -1]:
        weights = fit(positive, unlabelled, first_prior)
        weights = fit(positive, unlabelled, best_bin_prior(*tails(training, weights)))
    else:
        weights = np.zeros(SIZE)
        weights[-1] = 2 * first_prior - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = scores(unpacked(b), weights) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([column_of(b, "doc_id"), column_of(b, "held_out"), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return seen.select("doc_id", "held_out", "bins").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
