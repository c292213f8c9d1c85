"""Autocorrelation, partial and cross correlation, Levinson-Durbin, innovations, Ljung-Box, variance breaks, independence,
Granger causality, ARMA orders."""

from __future__ import annotations

import math

import numpy as np

from driftloom.functions.special import chi2_sf, f_sf, normal_cdf, normal_quantile
from driftloom.functions.unitroot import least_squares, trend_terms


def has_missing(x: np.ndarray) -> bool:
    return bool(np.isnan(np.asarray(x, dtype=float)).any())


def acovf(x: np.ndarray, *, adjusted: bool = False, demean: bool = True, missing: str = "none", lags: int | None = None) -> np.ndarray:
    """Autocovariances by the Fourier transform.  missing: none, raise, conservative (gaps add nothing), drop."""
    x = np.asarray(x, dtype=float)
    gaps = np.isnan(x)
    if gaps.any():
        if missing == "raise":
            raise ValueError("the series has missing values")
        if missing == "drop":
            x, gaps = x[~gaps], gaps[~gaps]
    keep = missing == "conservative" and gaps.any()
    if demean:
        x = x - (x[~gaps].mean() if keep else x.mean())
    if keep:
        x = np.where(gaps, 0.0, x)
    n = len(x)
    size = 1 << (2 * n - 1).bit_length()
    sums = np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2, size)[:n]
    if keep:
        here = (~gaps).astype(float)
        count = np.fft.irfft(np.abs(np.fft.rfft(here, size)) ** 2, size)[:n].round() if adjusted else np.full(n, here.sum())
        out = sums / np.maximum(count, 1)
    else:
        out = sums / (np.arange(n, 0, -1) if adjusted else n)
    return out if lags is None else out[: lags + 1]


def default_lags(n: int) -> int:
    return max(1, min(int(10 * math.log10(n)), n - 1))


def acf(x: np.ndarray, *, adjusted: bool = False, lags: int | None = None, missing: str = "none") -> np.ndarray:
    lags = default_lags(len(x)) if lags is None else lags
    c = acovf(x, adjusted=adjusted, missing=missing, lags=lags)
    return c / c[0]


def acf_bounds(r: np.ndarray, n: int, alpha: float = 0.05, bartlett: bool = True) -> np.ndarray:
    """Confidence bounds (low, high) of autocorrelations r[0], r[1], ...: r[0] is certain; by Bartlett's formula r[k] has the
    variance (1 + 2 (r[1]^2 + ... + r[k-1]^2)) / n, without it 1 / n."""
    r = np.asarray(r, dtype=float)
    lag, squares = np.arange(len(r)), r**2
    earlier = squares.cumsum() - squares - 1.0 if bartlett else np.zeros(len(r))  # r[0] is 1
    deviation = np.sqrt(np.where(lag > 0, 1 + 2 * np.maximum(earlier, 0.0), 0.0) / n)
    return r[:, None] + normal_quantile(1 - alpha / 2) * deviation[:, None] * np.array([-1.0, 1.0])


def q_stat(r: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative Ljung-Box statistics and p-values of autocorrelations r[1], r[2], ..."""
    k = np.arange(1, len(r) + 1)
    q = n * (n + 2) * np.cumsum(r**2 / (n - k))
    return q, np.array([chi2_sf(float(v), int(df)) for v, df in zip(q, k, strict=True)])


def ljung_box(x: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(x, dtype=float)
    x = x[~np.isnan(x)]
    if len(x) <= lags + 1 or np.ptp(x) == 0:
        raise ValueError("the series is too short or constant")
    return q_stat(acf(x, lags=lags)[1:], len(x))


def levinson_durbin(c: np.ndarray, order: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(innovation variance, AR coefficients, partial autocorrelations from lag 0, variances by order) from autocovariances."""
    phi, pacf, sigma = np.zeros(0), np.ones(order + 1), np.zeros(order + 1)
    sigma[0] = c[0]
    for k in range(1, order + 1):
        reflection = (c[k] - phi @ c[k - 1 : 0 : -1]) / sigma[k - 1] if k > 1 else c[1] / sigma[0]
        phi = np.append(phi - reflection * phi[::-1], reflection)
        pacf[k], sigma[k] = reflection, sigma[k - 1] * (1 - reflection**2)
    return float(sigma[-1]), phi, pacf, sigma


def from_pacf(pacf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(AR coefficients, autocorrelations) from partial autocorrelations that start at lag 0."""
    if np.any(np.abs(pacf[1:]) >= 1):
        raise ValueError("partial autocorrelations must lie within (-1, 1)")
    phi, r = np.zeros(0), [1.0]
    for a in pacf[1:]:
        before = np.array(r[::-1])
        r.append(float(phi @ before[: len(phi)] + a * (1 - (phi @ np.array(r[1:]) if len(phi) else 0.0))) if len(phi) else float(a))
        phi = np.append(phi - a * phi[::-1], a)
    return phi, np.array(r)


def pacf(x: np.ndarray, lags: int | None = None, method: str = "ywadjusted") -> np.ndarray:
    """Partial autocorrelations from lag 0.  Methods: yw, ywadjusted, ywm, ols, ols-inefficient, ols-adjusted, ld, ldadjusted, burg."""
    x = np.asarray(x, dtype=float)
    n = len(x)
    lags = max(1, min(int(10 * math.log10(n)), n // 2 - 1)) if lags is None else lags
    if lags > n // 2:
        raise ValueError("at most half of the series can be lags")
    if method in ("yw", "ywm", "ywmle", "ywunadjusted", "ld", "ldb", "ldunadjusted"):
        return levinson_durbin(acovf(x, lags=lags), lags)[2]
    if method in ("ywadjusted", "ywadj", "lda", "ldadjusted"):
        return levinson_durbin(acovf(x, adjusted=True, lags=lags), lags)[2]
    if method == "burg":
        return burg(x, lags)
    out = np.ones(lags + 1)
    if method == "ols-inefficient":
        design = np.column_stack([x[lags - k : n - k] for k in range(1, lags + 1)])
        for k in range(1, lags + 1):
            out[k] = least_squares(x[lags:], np.column_stack([np.ones(n - lags), design[:, :k]])).beta[-1]
        return out
    if method not in ("ols", "ols-adjusted"):
        raise ValueError(f"unknown method {method}")
    for k in range(1, lags + 1):
        design = np.column_stack([np.ones(n - k), *(x[k - j : n - j] for j in range(1, k + 1))])
        out[k] = least_squares(x[k:], design).beta[-1] * (n / (n - k) if method == "ols-adjusted" else 1)
    return out


def burg(x: np.ndarray, lags: int) -> np.ndarray:
    """By forward and backward prediction errors."""
    forward = backward = x - x.mean()
    out = np.ones(lags + 1)
    for k in range(1, lags + 1):
        f, b = forward[1:], backward[:-1]
        out[k] = a = 2 * (f @ b) / (f @ f + b @ b)
        forward, backward = f - a * b, b - a * f
    return out


def ccovf(x: np.ndarray, y: np.ndarray, *, adjusted: bool = True, demean: bool = True) -> np.ndarray:
    """Covariances of x moved forward by 0, 1, ... against y."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    if demean:
        x, y = x - x.mean(), y - y.mean()
    n = len(x)
    size = 1 << (2 * n - 1).bit_length()
    sums = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size)[:n]
    return sums / (np.arange(n, 0, -1) if adjusted else n)


def ccf(x: np.ndarray, y: np.ndarray, *, adjusted: bool = True, lags: int | None = None) -> np.ndarray:
    out = ccovf(x, y, adjusted=adjusted) / (np.std(x) * np.std(y))
    return out if lags is None else out[:lags]


def variance_break(resid: np.ndarray, share: float | int = 1 / 3, alternative: str = "two-sided", use_f: bool = True) -> tuple[float, float]:
    """(statistic, p-value): squares of the last part against those of the first.  ``share``: a part of the series or a number."""
    resid = np.asarray(resid, dtype=float)
    n = len(resid)
    h = int(share) if share >= 1 else int(round(n * share))
    first, last = resid[:h], resid[-h:]
    first, last = first[~np.isnan(first)], last[~np.isnan(last)]
    if len(first) < 2 or len(last) < 2:
        raise ValueError("too few values in a part")
    ratio, na, nb = float(last @ last) / float(first @ first), len(last), len(first)
    if alternative not in ("two-sided", "increasing", "decreasing"):
        raise ValueError("alternative must be two-sided, increasing or decreasing")
    stat = 1 / ratio if alternative == "decreasing" else ratio
    upper = f_sf(stat, na, nb) if use_f else chi2_sf(na * stat, nb)
    return stat, 2 * min(upper, 1 - upper) if alternative == "two-sided" else upper


def innovations(c: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(theta, variances) of the one-step predictors from autocovariances c[0], c[1], ... (taken as 0 beyond the last): the
    prediction of value t is the sum of theta[t, j - 1] times the error at t - j.  The covariance matrix is L D L', so the
    rows of L read backwards are theta and D holds the variances."""
    whole = np.concatenate([np.asarray(c, dtype=float), np.zeros(max(0, steps - len(c)))])
    at = np.arange(steps)
    root = np.linalg.cholesky(whole[np.abs(at[:, None] - at[None, :])])
    unit = root / np.diag(root)
    theta = np.zeros((steps, max(steps - 1, 0)))
    for t in range(1, steps):
        theta[t, :t] = unit[t, :t][::-1]
    return theta, np.diag(root) ** 2


def innovations_filter(x: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """The one-step prediction errors of a series without mean by ``theta`` (see innovations)."""
    errors = np.zeros(len(x))
    for t, v in enumerate(np.asarray(x, dtype=float)):
        own = theta[t, : min(t, theta.shape[1])]
        errors[t] = v - own @ errors[t - len(own) : t][::-1]
    return errors


def bds(x: np.ndarray, most: int = 2, epsilon: float | None = None, distance: float = 1.5) -> tuple[np.ndarray, np.ndarray]:
    """(statistics, two-sided p-values) of the independence test of Brock, Dechert, Scheinkman and LeBaron (1996) for the
    embedding dimensions 2 to ``most``.  Values are near within ``epsilon``, by default ``distance`` deviations.  Memory grows
    with the square of the series."""
    x = np.asarray(x, dtype=float)
    n = len(x)
    if not 2 <= most < n - 1:
        raise ValueError("the dimension must lie between 2 and the length less 2")
    near = np.abs(x[:, None] - x[None, :]) < (distance * x.std(ddof=1) if epsilon is None else epsilon)
    pairs = lambda a: (a.sum() - len(a)) / (len(a) * (len(a) - 1))
    c, degree = pairs(near), near.sum(axis=1)
    k = (degree @ degree - 3 * near.sum() + 2 * n) / (n * (n - 1) * (n - 2))
    out, run = [], near
    for m in range(2, most + 1):
        run = run[1:, 1:] & near[: n - m + 1, : n - m + 1]
        powers = sum(k ** (m - j) * c ** (2 * j) for j in range(1, m))
        variance = 4 * (k**m + 2 * powers + (m - 1) ** 2 * c ** (2 * m) - m**2 * k * c ** (2 * m - 2))
        out.append(math.sqrt(n - m + 1) * (pairs(run) - pairs(near[m - 1 :, m - 1 :]) ** m) / math.sqrt(variance))
    return np.array(out), np.array([2 * normal_cdf(-abs(v)) for v in out])


def granger(x: np.ndarray, most: int, constant: bool = True) -> dict[int, dict[str, tuple[float, float]]]:
    """For each lag to ``most``: does the second column help to predict the first?  (statistic, p-value) of ssr_f, ssr_chi2,
    lr and params_f."""
    x = np.asarray(x, dtype=float)
    if x.ndim != 2 or x.shape[1] != 2 or not np.isfinite(x).all():
        raise ValueError("two columns of finite values are needed")
    if len(x) <= 3 * most + int(constant):
        raise ValueError("too few rows for the lags")
    out = {}
    for lag in range(1, most + 1):
        y = x[lag:, 0]
        own = np.column_stack([x[lag - k : len(x) - k, 0] for k in range(1, lag + 1)])
        other = np.column_stack([x[lag - k : len(x) - k, 1] for k in range(1, lag + 1)])
        fixed = trend_terms(len(y), "c" if constant else "n")
        short, long = least_squares(y, np.column_stack([own, fixed])), least_squares(y, np.column_stack([own, other, fixed]))
        if long.ssr <= 1e-12 * max(short.ssr, 1e-300):
            raise ValueError("the regression fits perfectly")
        n, free = len(y), len(y) - 2 * lag - int(constant)
        f = (short.ssr - long.ssr) / long.ssr / lag * free
        chi2 = n * (short.ssr - long.ssr) / long.ssr
        ratio = n * math.log(short.ssr / long.ssr)
        out[lag] = {"ssr_f": (f, f_sf(f, lag, free)), "ssr_chi2": (chi2, chi2_sf(chi2, lag)), "lr": (ratio, chi2_sf(ratio, lag)), "params_f": (f, f_sf(f, lag, free))}
    return out


def arma_order(y: np.ndarray, ar: int = 4, ma: int = 2, criterion: str = "bic", trend: str = "c") -> tuple[tuple[int, int], np.ndarray]:
    """(orders with the least criterion, criterion by AR and MA order), by the two-step regression of Hannan and Rissanen: a
    long autoregression gives innovations, on whose lags and the series' lags each model is fitted by least squares over one
    common sample.  An approximation of exact likelihood, with the same grid and choice."""
    y = np.asarray(y, dtype=float)
    n = len(y)
    long = min(max(ar, ma) + int(round(math.log(n) ** 1.5)), n // 4)
    lagged = lambda v, k, start: v[start - k : n - k]
    first = np.column_stack([*(lagged(y, k, long) for k in range(1, long + 1)), trend_terms(n - long, trend)])
    innovations = np.concatenate([np.zeros(long), least_squares(y[long:], first).resid])
    start = long + max(ar, ma)
    target, fixed = y[start:], trend_terms(n - start, trend)
    table = np.zeros((ar + 1, ma + 1))
    for p in range(ar + 1):
        for q in range(ma + 1):
            columns = [*(lagged(y, k, start) for k in range(1, p + 1)), *(lagged(innovations, k, start) for k in range(1, q + 1))]
            design = np.column_stack([*columns, fixed]) if columns or fixed.shape[1] else np.zeros((len(target), 0))
            ssr = least_squares(target, design).ssr if design.shape[1] else float(target @ target)
            size = p + q + fixed.shape[1] + 1
            table[p, q] = len(target) * (math.log(2 * math.pi * ssr / len(target)) + 1) + (2 if criterion == "aic" else math.log(len(target))) * size
    p, q = np.unravel_index(table.argmin(), table.shape)
    return (int(p), int(q)), table
