"""Communities of symbols: correlation matrix, random-matrix denoising, modularity, two-level Louvain, spectral bisection.

Matrices over symbols are dense and small (N up to ``LIMIT``, checked before they come to the driver); what runs over rows
(correlations, aggregation, modularity) stays relational."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 5000


class Matrix(NamedTuple):
    values: np.ndarray
    rows: int
    names: list[str]


def correlation_matrix(panel: DataFrame, value: str = "std_ret") -> Matrix:
    """Correlations of all symbols with the number of times."""
    from driftloom.operators.discovery import correlations

    names = sorted(r[0] for r in panel.select("symbol").distinct().limit(LIMIT + 1).collect())
    if len(names) > LIMIT:
        raise ValueError(f"over {LIMIT} symbols: keep the matrix long and use the relational operators")
    place = {n: i for i, n in enumerate(names)}
    out = np.eye(len(names))
    for r in correlations(panel, value).where("sym1 < sym2").collect():  # at most LIMIT squared / 2
        out[place[r.sym1], place[r.sym2]] = out[place[r.sym2], place[r.sym1]] = np.nan if r.corr is None else r.corr
    return Matrix(out, panel.select("ts").distinct().count(), names)


def noise_edge(n: int, t: int) -> tuple[float, float]:
    """Least and greatest eigenvalue of a random correlation matrix."""
    r = (n / t) ** 0.5
    return (1 - r) ** 2, (1 + r) ** 2


def noise_density(spark, ratio: float, points: int = 100) -> DataFrame:
    """(lambda, density) of random eigenvalues for ``ratio`` = times / symbols."""
    low, high = noise_edge(1, ratio)
    rows = spark.range(points + 1).select((F.lit(low) + F.col("id") * F.lit((high - low) / points)).alias("lambda"))
    inside = F.greatest((F.lit(high) - F.col("lambda")) * (F.col("lambda") - F.lit(low)), F.lit(0.0))
    return rows.withColumn("density", F.lit(ratio) / (2 * np.pi * F.col("lambda")) * F.sqrt(inside))


def denoised(corr: np.ndarray, t: int) -> np.ndarray:
    """The part of the matrix above the noise edge without its largest mode (the market)."""
    values, vectors = np.linalg.eigh(corr)
    keep = np.flatnonzero(values > noise_edge(len(corr), t)[1])[:-1]
    return (vectors[:, keep] * values[keep]) @ vectors[:, keep].T


def top_share(corr: np.ndarray) -> float:
    """Percent of the variance in the largest mode."""
    values = np.linalg.eigvalsh(corr)
    return float(values[-1] / values.sum() * 100)


def without_market(corr: np.ndarray) -> np.ndarray:
    """The largest mode taken out, the diagonal scaled back to one."""
    values, vectors = np.linalg.eigh(corr)
    rest = corr - values[-1] * np.outer(vectors[:, -1], vectors[:, -1])
    scale = np.sqrt(np.diag(rest))
    return rest / np.outer(scale, scale)


def shuffled_edges(returns: DataFrame, symbols: list[str], repeats: int = 250, seed: int = 0) -> DataFrame:
    """(repeat, low, high): extreme eigenvalues when each symbol's times are shuffled, one task for each repeat.  The panel of
    at most LIMIT symbols goes to each task as one broadcast matrix."""
    rows = returns.groupBy("ts").pivot("symbol", symbols).agg(F.first("std_ret")).na.drop().orderBy("ts").select(*symbols).toPandas()
    sent = returns.sparkSession.sparkContext.broadcast(rows.to_numpy())

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for k in b["id"]:
                rng = np.random.default_rng([seed, int(k)])
                values = np.linalg.eigvalsh(np.corrcoef(rng.permuted(sent.value, axis=0), rowvar=False))
                out.append((int(k), float(values[0]), float(values[-1])))
            yield pd.DataFrame(out, columns=["repeat", "low", "high"])

    return returns.sparkSession.range(0, repeats, 1, min(repeats, 64)).mapInPandas(run, "repeat long, low double, high double")


def norm(corr: np.ndarray) -> float:
    """The sum over pairs, each once, and the diagonal."""
    return float(np.triu(corr).sum())


def move_gain(labels: np.ndarray, node: int, target: int, m: np.ndarray, total: float) -> float:
    """Change of modularity when ``node`` moves to community ``target``; its own term cancels."""
    row = m[node]
    own = row[labels == labels[node]].sum() - row[node]
    return float((row[(labels == target)].sum() - own) / total)


def local_moves(m: np.ndarray, total: float, seed: int, start: np.ndarray | None = None) -> np.ndarray:
    """Sweeps in seeded random order; a node moves to the community with the greatest positive gain (the lowest number among
    equals), until a sweep moves none."""
    n = len(m)
    labels = np.arange(n) if start is None else start.copy()
    rng = np.random.default_rng(seed)
    diagonal = np.diag(m)
    moved = True
    while moved:
        moved = False
        for node in rng.permutation(n):
            sums = np.bincount(labels, weights=m[node], minlength=n)
            own = labels[node]
            gain = (sums - (sums[own] - diagonal[node])) / total
            gain[own] = 0.0
            gain[np.bincount(labels, minlength=n) == 0] = 0.0
            best = int(gain.argmax())
            if gain[best] > 1e-12:
                labels[node], moved = best, True
    return np.unique(labels, return_inverse=True)[1]


def aggregated(m: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Sums over pairs of communities."""
    hot = np.eye(labels.max() + 1)[labels]
    return hot.T @ m @ hot


def louvain(m: np.ndarray, corr: np.ndarray, seed: int = 0) -> np.ndarray:
    """Two levels: moves of nodes, then moves of the found communities."""
    total = norm(corr)
    first = local_moves(m, total, seed)
    return local_moves(aggregated(m, first), total, seed + 1)[first]


def modularity(m: np.ndarray, labels: np.ndarray, corr: np.ndarray) -> float:
    return float(sum(np.triu(m[np.ix_(labels == k, labels == k)]).sum() for k in np.unique(labels)) / norm(corr))


def bisected(m: np.ndarray) -> np.ndarray:
    """True where the leading eigenvector is positive."""
    return np.linalg.eigh(m)[1][:, -1] > 0


def recursive_bisection(m: np.ndarray, corr: np.ndarray, least: int = 2, gain: float = 1e-5) -> np.ndarray:
    """Splits while modularity grows by more than ``gain`` and parts have over ``least`` members."""
    labels, todo, following = np.zeros(len(m), dtype=int), [0], 1
    while todo:
        part = todo.pop()
        members = np.flatnonzero(labels == part)
        if len(members) <= least:
            continue
        side = bisected(m[np.ix_(members, members)])
        if side.all() or not side.any():
            continue
        tried = labels.copy()
        tried[members[~side]] = following
        if modularity(m, tried, corr) - modularity(m, labels, corr) > gain:
            labels = tried
            todo += [part, following]
            following += 1
    return labels


def canonical(labels: np.ndarray, names: list[str]) -> list[tuple[str, str]]:
    """(community, symbol) rows; communities are numbered by falling size, then by their first symbol."""
    groups = [sorted(names[i] for i in np.flatnonzero(labels == k)) for k in np.unique(labels)]
    groups.sort(key=lambda g: (-len(g), g[0]))
    return [(f"Community {i}", s) for i, g in enumerate(groups, 1) for s in g]


def communities(panel: DataFrame, method: str = "louvain", seed: int = 0) -> DataFrame:
    """(community, symbol) from a panel of standardised returns."""
    found = correlation_matrix(panel)
    m = denoised(found.values, found.rows)
    labels = louvain(m, found.values, seed) if method == "louvain" else recursive_bisection(m, found.values)
    return panel.sparkSession.createDataFrame(canonical(labels, found.names), "community string, symbol string")


def aggregate_graph(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Relational form of ``aggregated``: edges (sym1, sym2, w), labels (symbol, community) -> (c1, c2, w)."""
    a = labels.select(F.col("symbol").alias("sym1"), F.col("community").alias("c1"))
    b = labels.select(F.col("symbol").alias("sym2"), F.col("community").alias("c2"))
    return edges.join(a, "sym1").join(b, "sym2").groupBy("c1", "c2").agg(F.sum("w").alias("w"))


def graph_modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Relational form of ``modularity`` where w is both the matrix and the norm: the share of w inside communities."""
    a = labels.select(F.col("symbol").alias("sym1"), F.col("community").alias("c1"))
    b = labels.select(F.col("symbol").alias("sym2"), F.col("community").alias("c2"))
    rows = edges.where("sym1 <= sym2").join(a, "sym1").join(b, "sym2")
    return rows.agg(F.try_divide(F.sum(F.when(F.col("c1") == F.col("c2"), F.col("w"))), F.sum("w")).alias("modularity"))
