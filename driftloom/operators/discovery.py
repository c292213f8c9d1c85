"""Finding pairs: correlations, cointegration over full samples and windows, residual checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions import timeseries, unitroot
from driftloom.functions.timeseries import ljung_box


def correlations(panel: DataFrame, value: str = "price") -> DataFrame:
    """(sym1, sym2, corr) for all ordered pairs, over the times that both have."""
    a = panel.select("ts", F.col("symbol").alias("sym1"), F.col(value).alias("a"))
    b = panel.select("ts", F.col("symbol").alias("sym2"), F.col(value).alias("b"))
    return a.join(b, "ts").groupBy("sym1", "sym2").agg(F.corr("a", "b").alias("corr"))


def high_correlation(corr: DataFrame, threshold: float = 0.8) -> DataFrame:
    return corr.where((F.col("sym1") < F.col("sym2")) & (F.abs("corr") >= threshold))


def grouped_test(rows: DataFrame, keys: list[str], columns: list[str], test: Callable[..., dict], fields: str) -> DataFrame:
    """A row of ``fields`` for each key: ``test`` gets the columns as arrays in time order; a test that can't be made gives nulls
    (a last field ``reason``, if asked for, says why)."""
    schema = T.StructType([*(rows.schema[k] for k in keys), *T.StructType.fromDDL(fields).fields])
    names = [f.name for f in T.StructType.fromDDL(fields).fields]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ts", kind="stable")
        try:
            found = test(*(part[c].to_numpy(dtype=float) for c in columns))
        except (ValueError, np.linalg.LinAlgError) as e:
            found = {"reason": str(e)}
        return pd.DataFrame([[*(part[k].iloc[0] for k in keys), *(found.get(n) for n in names)]], columns=schema.names)

    return rows.select(*dict.fromkeys([*keys, "ts", *columns])).groupBy(*keys).applyInPandas(run, schema)


COINT = "t double, pvalue double, crit1 double, crit5 double, crit10 double, lags long"


def cointegration(pairs: DataFrame, keys: list[str] | None = None, most: int | None = None, rule: str | None = "aic") -> DataFrame:
    """Engle-Granger test of s1 on s2 for each key; with ``rule`` None at exactly ``most`` lags."""
    test = partial(unitroot.engle_granger, most=most, rule=rule)
    return grouped_test(pairs.where("s1 is not null and s2 is not null"), keys or ["pair", "sym1", "sym2"], ["s1", "s2"], test, COINT)


def cointegrated(pairs: DataFrame, significance: float = 0.05) -> DataFrame:
    """Pairs with a p-value below ``significance``, the smallest first."""
    return cointegration(pairs).where(F.col("pvalue") < significance).orderBy("pvalue", "pair")


def cointegrated_windows(windows: DataFrame, significance: float = 0.05, min_pass: float = 0.5, most: int | None = None, rule: str | None = "aic") -> DataFrame:
    """(pair, windows, passed, pass_fraction, mean_p) over the windows in which the test could be made."""
    tests = cointegration(windows, ["pair", "window_id"], most, rule).where("pvalue is not null and not isnan(pvalue)")
    rows = tests.groupBy("pair").agg(F.count("*").alias("windows"), F.count_if(F.col("pvalue") < significance).alias("passed"), F.avg("pvalue").alias("mean_p"))
    rows = rows.withColumn("pass_fraction", F.col("passed") / F.col("windows")).where(F.col("pass_fraction") >= min_pass)
    return rows.orderBy(F.desc("pass_fraction"), "mean_p", "pair")


def residuals(pairs: DataFrame) -> DataFrame:
    """(pair, ts, residual) of s1 on s2 over the full sample."""
    from driftloom.operators.spread import with_spread

    return with_spread(pairs, None).select("pair", "ts", F.col("spread").alias("residual"))


def white_noise(resid: DataFrame, significance: float = 0.05) -> DataFrame:
    """Ljung-Box at lag one for each pair: q, pvalue, white."""
    def test(x: np.ndarray) -> dict:
        q, p = ljung_box(x, 1)
        return {"q": float(q[0]), "pvalue": float(p[0]), "white": bool(p[0] >= significance)}

    return grouped_test(resid, ["pair"], ["residual"], test, "q double, pvalue double, white boolean")


def stationarity(rows: DataFrame, keys: list[str], column: str, adf_lags: int | None = None, kpss_lags: str | int = "auto") -> DataFrame:
    """ADF and KPSS of a series for each key; lags are chosen by the series unless they are given."""
    def test(x: np.ndarray) -> dict:
        x = x[~np.isnan(x)]
        a, k = unitroot.adf(x, adf_lags, rule="aic" if adf_lags is None else None), unitroot.kpss(x, lags=kpss_lags)
        return {"adf": a.stat, "adf_p": a.pvalue, "adf_lags": a.lags, "kpss": k[0], "kpss_p": k[1]}

    return grouped_test(rows, keys, [column], test, "adf double, adf_p double, adf_lags long, kpss double, kpss_p double")


def autocorrelations(rows: DataFrame, keys: list[str], column: str, lags: int = 3) -> DataFrame:
    """A row for each key: r (autocorrelations from lag 1), high (upper confidence bounds), partial (by Yule and Walker), burg,
    q (Ljung-Box at the last lag) and sigma2 (innovation variance of the last order)."""
    def test(x: np.ndarray) -> dict:
        x = x[~np.isnan(x)]
        r, c = timeseries.acf(x, lags=lags), timeseries.acovf(x, lags=lags)
        return {
            "r": r[1:].tolist(), "high": timeseries.acf_bounds(r, len(x))[1:, 1].tolist(), "partial": timeseries.pacf(x, lags, "yw")[1:].tolist(),
            "burg": timeseries.pacf(x, lags, "burg")[1:].tolist(), "q": float(timeseries.q_stat(r[1:], len(x))[0][-1]), "sigma2": timeseries.levinson_durbin(c, lags)[0],
        }

    fields = "r array<double>, high array<double>, partial array<double>, burg array<double>, q double, sigma2 double"
    return grouped_test(rows, keys, [column], test, fields)


def pair_tests(pairs: DataFrame, keys: list[str] | None = None, lag: int = 1) -> DataFrame:
    """A row for each key: ccf (cross correlations of s1 moved forward by 0, 1, 2 against s2), and the F statistics of ``lag``
    lags of s2 helping to predict s1 (f12) and of s1 helping to predict s2 (f21)."""
    def test(a: np.ndarray, b: np.ndarray) -> dict:
        both = np.column_stack([a, b])
        f = [timeseries.granger(x, lag)[lag]["ssr_f"][0] for x in (both, both[:, ::-1])]
        return {"ccf": timeseries.ccf(a, b, lags=3).tolist(), "f12": f[0], "f21": f[1]}

    return grouped_test(pairs.where("s1 is not null and s2 is not null"), keys or ["pair"], ["s1", "s2"], test, "ccf array<double>, f12 double, f21 double")


def breaks(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """A row for each key: ratio (squares of the last third against the first) and extremes (the range unit-root statistic)."""
    def test(x: np.ndarray) -> dict:
        x = x[~np.isnan(x)]
        return {"ratio": timeseries.variance_break(x)[0], "extremes": unitroot.range_unit_root(x)[0]}

    return grouped_test(rows, keys, [column], test, "ratio double, extremes double")


def community_scan(panel: DataFrame, communities: DataFrame, significance: float = 0.05) -> DataFrame:
    """Cointegrated pairs inside each community (symbol, community): the pairs come from the symbol list, then one join on ts."""
    from driftloom.operators.panel import pair_frame

    a = communities.select(F.col("symbol").alias("sym1"), "community")
    b = communities.select(F.col("symbol").alias("sym2"), "community")
    pairs = a.join(b, "community").where("sym1 < sym2").select("sym1", "sym2")
    return cointegrated(pair_frame(panel, pairs), significance)


def cross_scan(panel: DataFrame, communities: DataFrame, first: str, second: str, significance: float = 0.05) -> DataFrame:
    """Cointegrated pairs between two communities."""
    from driftloom.operators.panel import cross_pairs, pair_frame

    return cointegrated(pair_frame(panel, cross_pairs(communities.where(F.col("community") == first), communities.where(F.col("community") == second))), significance)
