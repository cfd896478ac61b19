"""Unit-root tests of one series by their definitions, to compare with."""

import math

import numpy as np

from pluvia.operators.structure import KPSS_CRITICAL, KPSS_PVALUES, mackinnon_p


def adf(y: np.ndarray) -> tuple[float, float, int, int]:
    """Statistic, p-value, lags (by AIC on a common sample) and observations."""
    n = len(y)
    max_lag = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    if max_lag < 0 or np.ptp(y) == 0:
        return math.nan, math.nan, 0, n
    dy = np.diff(y)

    def design(lags: int) -> tuple[np.ndarray, np.ndarray]:
        rows = len(dy) - lags
        cols = [np.ones(rows), y[lags:-1]]
        cols += [dy[lags - k:len(dy) - k] for k in range(1, lags + 1)]
        return np.column_stack(cols), dy[lags:]

    x, target = design(max_lag)
    q, _ = np.linalg.qr(x)
    ssr = target @ target - np.cumsum((q.T @ target) ** 2)
    rows = len(target)
    k = np.arange(2, max_lag + 3)
    aic = rows * (np.log(2 * np.pi) + np.log(np.maximum(ssr[1:], 1e-300) / rows) + 1) + 2 * k
    lags = int(np.argmin(aic))
    x, target = design(lags)
    coef, *_ = np.linalg.lstsq(x, target, rcond=None)
    resid = target - x @ coef
    sigma2 = resid @ resid / (len(target) - x.shape[1])
    se = math.sqrt(sigma2 * np.linalg.inv(x.T @ x)[1, 1])
    stat = float(coef[1] / se)
    return stat, mackinnon_p(stat), lags, len(target)


def kpss(y: np.ndarray, regression: str) -> tuple[float, float, int]:
    n = len(y)
    if regression == "ct":
        t = np.arange(1, n + 1)
        e = y - np.polyval(np.polyfit(t, y, 1), t)
    else:
        e = y - y.mean()
    if not np.any(np.abs(e) > 1e-12):
        return math.nan, math.nan, 0
    cov_lags = int(n ** (2 / 9))
    s0, s1 = e @ e / n, 0.0
    for k in range(1, cov_lags + 1):
        g = e[k:] @ e[:-k] / (n / 2)
        s0 += g
        s1 += k * g
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    lrv = e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
    stat = float(np.sum(np.cumsum(e) ** 2) / n ** 2 / (lrv / n))
    return stat, float(np.interp(stat, KPSS_CRITICAL[regression], KPSS_PVALUES)), lags
