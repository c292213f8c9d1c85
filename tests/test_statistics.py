"""Kernels against closed forms, published values and plain loops."""

import math

import numpy as np
import pytest

from driftloom.functions import special as S
from driftloom.functions import timeseries as T
from driftloom.functions import unitroot as U

#: Published statistics and p-values of cointegration tests.
PUBLISHED = [
    (-5.9361281110890936, 2.226879441145696e-06), (-5.322460366276805, 4.028249525466259e-05), (-4.412695029285439, 0.0016978944404160037),
    (-3.9089516612841257, 0.009640857709934197), (-3.589134470027508, 0.025270230806595306), (-3.3575777531597604, 0.04728559715951105),
    (-5.03934128772058, 0.00013929184287726158), (-4.251167937346904, 0.0030473459661710333), (-3.3483920476865556, 0.04841457631286845),
    (-5.894147200568977, 2.7371018288052224e-06), (-3.850536072395203, 0.011592139257977044), (-3.3371539551873717, 0.049825953638771694),
]


@pytest.mark.parametrize("t,p", PUBLISHED)
def test_published_p_values(t, p):
    assert U.mackinnon_p(t, "c", 2) == pytest.approx(p, rel=1e-9)


def test_tails():
    assert S.normal_cdf(1.959963984540054) == pytest.approx(0.975)
    assert S.normal_quantile(0.975) == pytest.approx(1.959963984540054)
    for x in (0.1, 1.0, 5.0, 30.0):
        assert S.chi2_sf(x, 2) == pytest.approx(math.exp(-x / 2))
        assert S.chi2_sf(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2))
        assert S.chi2_sf(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)))
        assert S.f_sf(x, 2, 10) == pytest.approx((1 + 2 * x / 10) ** -5)
        assert S.t_sf2(x, 1) == pytest.approx(1 - 2 / math.pi * math.atan(x))
        assert S.f_sf(x, 1, 7) == pytest.approx(S.t_sf2(math.sqrt(x), 7))


def ar(seed, n, phi, noise=1.0):
    rng, out = np.random.default_rng(seed), [0.0]
    for e in rng.normal(size=n - 1) * noise:
        out.append(phi * out[-1] + e)
    return np.array(out)


def slow_adf(x, lags, trend):
    d = np.diff(x)
    rows, y = [], []
    for t in range(lags, len(d)):
        rows.append([x[t], *(d[t - k] for k in range(1, lags + 1)), *([1.0] if "c" in trend else []), *([t] if trend == "ct" else [])])
        y.append(d[t])
    a, y = np.array(rows), np.array(y)
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    e = y - a @ beta
    cov = np.linalg.inv(a.T @ a) * (e @ e) / (len(y) - a.shape[1])
    return beta[0] / math.sqrt(cov[0, 0]), len(y) * math.log(e @ e / len(y)) + 2 * a.shape[1]


@pytest.mark.parametrize("trend", ["n", "c", "ct"])
def test_adf(trend):
    x = ar(1, 300, 0.95)
    for lags in (0, 3, 7):
        assert U.adf(x, lags, trend, None).stat == pytest.approx(slow_adf(x, lags, trend)[0])
    most = 9
    aic = [slow_adf(x[most - k :], k, trend)[1] for k in range(most + 1)]
    assert U.adf(x, most, trend).lags == int(np.argmin(aic))
    with pytest.raises(ValueError):
        U.adf(np.ones(50))


def test_adf_power():
    assert U.adf(ar(2, 500, 0.5)).pvalue < 0.01 < U.adf(ar(3, 500, 1.0)).pvalue


def test_engle_granger():
    rng = np.random.default_rng(4)
    walk = 50 + rng.normal(size=600).cumsum()
    linked = U.engle_granger(2 + 1.5 * walk + ar(5, 600, 0.6), walk)
    apart = U.engle_granger(rng.normal(size=600).cumsum(), walk)
    assert linked["pvalue"] < 0.01 and linked["t"] < linked["crit1"] and apart["pvalue"] > 0.05
    same = U.engle_granger(3 + 2 * walk, walk)
    assert same["t"] == -math.inf and same["pvalue"] == 0


def test_kpss_and_range():
    assert U.kpss(ar(6, 400, 0.3))[1] > 0.05 and U.kpss(ar(7, 400, 1.0))[1] <= 0.05
    x = ar(8, 200, 1.0)
    stat, p, _ = U.range_unit_root(x)
    new = sum(x[t] > max(x[:t]) or x[t] < min(x[:t]) for t in range(1, 200))
    assert stat == pytest.approx(new / math.sqrt(200)) and 0.01 <= p <= 0.95
    with pytest.raises(ValueError):
        U.range_unit_root(x[:10])


def test_break():
    x = ar(9, 200, 0.2)
    x[120:] += 8
    stat, p, _, where = U.break_test(x)
    assert p < 0.05 and abs(where - 120) < 12
    assert U.break_test(ar(10, 200, 1.0))[1] > 0.05


def test_autocorrelation():
    x = ar(11, 200, 0.6)
    d = x - x.mean()
    slow = np.array([d[k:] @ d[: 200 - k] / 200 for k in range(20)])
    assert T.acovf(x, lags=19) == pytest.approx(slow)
    assert T.acovf(x, adjusted=True, lags=3)[3] == pytest.approx(slow[3] * 200 / 197)
    gaps = x.copy()
    gaps[[5, 50]] = np.nan
    assert np.isfinite(T.acovf(gaps, missing="conservative", lags=5)).all() and len(T.acovf(gaps, missing="drop")) == 198
    with pytest.raises(ValueError):
        T.acovf(gaps, missing="raise")
    q, p = T.ljung_box(x, 5)
    r = slow / slow[0]
    assert q[4] == pytest.approx(200 * 202 * sum(r[k] ** 2 / (200 - k) for k in range(1, 6))) and p[4] < 0.01


def test_partial_autocorrelation():
    x = ar(12, 3000, 0.6)
    for method in ("yw", "ywadjusted", "ols", "ols-adjusted", "ols-inefficient", "ld", "ldadjusted", "burg"):
        got = T.pacf(x, 4, method)
        assert got[0] == 1 and got[1] == pytest.approx(0.6, abs=0.05) and abs(got[2]) < 0.06
    c = T.acovf(x, lags=6)
    sigma, phi, pacf, _ = T.levinson_durbin(c, 6)
    matrix = np.array([[c[abs(i - j)] for j in range(6)] for i in range(6)])
    assert phi == pytest.approx(np.linalg.solve(matrix, c[1:7]))
    back, r = T.from_pacf(pacf)
    assert back == pytest.approx(phi) and r == pytest.approx(c / c[0]) and sigma > 0


def test_cross_covariance():
    rng = np.random.default_rng(13)
    x, y = rng.normal(size=100), rng.normal(size=100)
    a, b = x - x.mean(), y - y.mean()
    assert T.ccovf(x, y)[7] == pytest.approx(a[7:] @ b[:93] / 93)
    assert T.ccf(x, x)[0] == pytest.approx(1)


def test_variance_break_and_granger():
    rng = np.random.default_rng(14)
    e = np.concatenate([rng.normal(size=100), rng.normal(size=100), 4 * rng.normal(size=100)])
    assert T.variance_break(e)[1] < 0.001 and T.variance_break(rng.normal(size=300))[1] > 0.01
    x = rng.normal(size=500)
    y = np.concatenate([[0], 0.8 * x[:-1]]) + 0.3 * rng.normal(size=500)
    assert T.granger(np.column_stack([y, x]), 2)[1]["ssr_f"][1] < 1e-6 < T.granger(np.column_stack([x, y]), 2)[1]["ssr_f"][1]


def test_variance_break_with_gaps():
    """The ratio in both forms; degrees of freedom keep their places when the ratio is turned round."""
    x = np.random.default_rng(3).normal(size=90)
    x[[2, 5, 88]] = np.nan
    first, last = x[:30][~np.isnan(x[:30])], x[60:][~np.isnan(x[60:])]
    ratio = (last @ last) / (first @ first)
    assert T.variance_break(x, alternative="increasing") == pytest.approx((ratio, S.f_sf(ratio, 29, 28)))
    assert T.variance_break(x, alternative="decreasing") == pytest.approx((1 / ratio, S.f_sf(1 / ratio, 29, 28)))
    assert T.variance_break(x, alternative="increasing", use_f=False) == pytest.approx((ratio, S.chi2_sf(29 * ratio, 28)))


def test_bounds_and_bandwidth():
    x = ar(16, 300, 0.5)
    r = T.acf(x, lags=6)
    low, high = T.acf_bounds(r, 300).T
    assert low[0] == high[0] == 1
    for k in range(1, 7):
        half = 1.959963984540054 * math.sqrt((1 + 2 * sum(r[j] ** 2 for j in range(1, k))) / 300)
        assert (low[k], high[k]) == pytest.approx((r[k] - half, r[k] + half))
    assert np.ptp(T.acf_bounds(r, 300, bartlett=False)[1:] - r[1:, None], axis=0) == pytest.approx([0, 0])
    e = x - x.mean()
    cover = int(300 ** (2 / 9))
    gamma = {k: e[abs(k) :] @ e[: 300 - abs(k)] for k in range(-cover, cover + 1)}
    s0, s1 = sum(gamma.values()), sum(abs(k) * g for k, g in gamma.items())
    assert U.kpss_lags(e) == int(1.1447 * (s1 / s0) ** (2 / 3) * 300 ** (1 / 3))


def test_tables_agree():
    """At the published critical values of long series the published p-values are 1, 5 and 10 percent, nearly."""
    for series, trend in U.CRITICAL:
        for level, c in zip((0.01, 0.05, 0.10), U.mackinnon_critical(trend, series, 1e9), strict=True):
            assert U.mackinnon_p(c, trend, series) == pytest.approx(level, rel=0.08)
    assert all(math.isnan(c) for c in U.mackinnon_critical("n", 2, 100))
    with pytest.raises(ValueError):
        U.mackinnon_p(-3.0, "c", 3)


def test_lags_to_half():
    assert len(T.pacf(ar(17, 40, 0.3), 20, "yw")) == 21
    with pytest.raises(ValueError):
        T.pacf(ar(17, 40, 0.3), 21, "burg")


def test_innovations():
    c = np.array([1.25, 0.5])  # a moving average with factor 0.5
    theta, variance = T.innovations(c, 60)
    assert theta[1, 0] == pytest.approx(0.4) and variance[0] == pytest.approx(1.25) and variance[-1] == pytest.approx(1) and theta[-1, 0] == pytest.approx(0.5)
    rng = np.random.default_rng(18)
    e = rng.normal(size=61)
    x = e[1:] + 0.5 * e[:-1]
    errors = T.innovations_filter(x, theta)
    whole = np.array([[c[abs(i - j)] if abs(i - j) < 2 else 0 for j in range(60)] for i in range(60)])
    assert (errors**2 / variance).sum() == pytest.approx(x @ np.linalg.solve(whole, x))


def test_bds():
    rng = np.random.default_rng(19)
    x = rng.normal(size=300)
    stat, p = T.bds(x, 3)
    assert (p > 0.01).all()
    eps, n = 1.5 * x.std(ddof=1), 300
    near = [[abs(a - b) < eps for b in x] for a in x]
    c2 = sum(near[i][j] and near[i + 1][j + 1] for i in range(n - 1) for j in range(i + 1, n - 1)) / ((n - 1) * (n - 2) / 2)
    c1 = sum(near[i][j] for i in range(1, n) for j in range(i + 1, n)) / ((n - 1) * (n - 2) / 2)
    assert math.copysign(1, c2 - c1**2) == math.copysign(1, stat[0])
    assert (T.bds(ar(20, 300, 0.8), 3)[1] < 1e-6).all()


def test_arma_order():
    assert T.arma_order(ar(15, 2000, 0.7), 3, 2)[0] == (1, 0)
