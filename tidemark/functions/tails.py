"""Tail probabilities without SciPy: incomplete gamma and beta functions and what follows from them."""

from __future__ import annotations

import math
from statistics import NormalDist


def _gamma_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - scale * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return scale * h


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return _gamma_upper(df / 2, x / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x)) if x > 0 else 1.0


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def normal_sf(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_inc(a, b, mid) < p else (lo, mid)
    return (lo + hi) / 2


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Exact limits of a binomial share."""
    low = beta_quantile(alpha / 2, k, n - k + 1) if k else 0.0
    return low, beta_quantile(1 - alpha / 2, k + 1, n - k) if k < n else 1.0


def binomial_two_sided(k: int, n: int) -> float:
    """Exact test of a half: the probability of all outcomes no likelier than k."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(n + 1)]
    edge = logs[k] + math.log1p(1e-7)
    return min(1.0, math.fsum(math.exp(x) for x in logs if x <= edge))


def wilcoxon_exact(w_plus: float, n: int) -> float:
    """Two-sided probability of the signed-rank sum without ties."""
    counts = [1]
    for r in range(1, n + 1):
        wider = counts + [0] * r
        for i, c in enumerate(counts):
            wider[i + r] += c
        counts = wider
    w, total = min(w_plus, n * (n + 1) / 2 - w_plus), 2**n
    return min(1.0, 2 * sum(counts[: int(math.floor(w)) + 1]) / total)


def mde(n: int, sd: float | None, alpha: float = 0.05, power: float = 0.8) -> float | None:
    """The least effect that a two-sided test would find with this power."""
    if not n or n < 2 or sd is None:
        return None
    return (normal_quantile(1 - alpha / 2) + normal_quantile(power)) * sd / math.sqrt(n)
