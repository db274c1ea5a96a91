"""Special functions in NumPy: gamma, beta, normal, t, F, chi-square, hypergeometric."""

from __future__ import annotations

import math
from bisect import bisect_left
from functools import lru_cache

import numpy as np

log_gamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])
_LOG_FACTORIALS = np.array([math.lgamma(i + 1) for i in range(256)])


def log_factorial(k) -> np.ndarray:
    """Logarithms of k! for arrays of whole numbers: a table, from 256 on Stirling's series."""
    k = np.asarray(k)
    x = np.maximum(k, 255).astype(float)
    far = (x + 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - 1 / 1260 / (x * x)) / (x * x)) / x
    return np.where(k < 256, _LOG_FACTORIALS[np.clip(k, 0, 255)], far)


def normal_sf(z):
    """P(Z >= z)."""
    return 0.5 * _erfc(np.asarray(z, dtype=float) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """z with P(Z <= z) = p, by bisection in the tail's logarithm."""
    if not 0 < p < 1:
        return -math.inf if p <= 0 else math.inf
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if 0.5 * math.erfc(-mid / math.sqrt(2)) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * f


def t_sf(t: float, df: float) -> float:
    """P(T >= t)."""
    half = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1.0 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def hypergeometric_support(n: int, k: int, m: int) -> tuple[int, int]:
    """Least and largest overlap of ``m`` draws with ``k`` marked ones among ``n``."""
    return max(0, m + k - n), min(k, m)


def log_hypergeometric(n: int, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Overlaps and the logarithms of their probabilities."""
    lo, hi = hypergeometric_support(n, k, m)
    x = np.arange(lo, hi + 1)
    choose = lambda a, b: log_factorial(a) - log_factorial(b) - log_factorial(a - b)
    return x, choose(k, x) + choose(n - k, m - x) - choose(n, m)


def hypergeometric_tail(x: int, n: int, k: int, m: int, upper: bool = True) -> float:
    """P(X >= x), or with ``upper`` false P(X <= x)."""
    xs, logs = log_hypergeometric(n, k, m)
    chosen = logs[xs >= x] if upper else logs[xs <= x]
    return float(min(1.0, np.exp(chosen).sum())) if len(chosen) else 0.0


def hypergeometric_quantile(p: float, n: int, k: int, m: int) -> int:
    """The least x with P(X <= x) >= p."""
    xs, logs = log_hypergeometric(n, k, m)
    return int(xs[np.searchsorted(np.cumsum(np.exp(logs)), p * (1 - 1e-12))])


@lru_cache(maxsize=100_000)
def fisher_2x2(a: int, b: int, c: int, d: int, level: float = 0.95) -> tuple[float, float, float, float]:
    """(odds ratio, lower, upper, two-sided p) of a 2 x 2 table; the odds ratio is the conditional maximum-likelihood one.

    Tables with an empty margin have p 1 and no odds ratio (NaN).
    """
    n, k, m = a + b + c + d, a + c, a + b
    if min(a + b, c + d, a + c, b + d) == 0:
        return math.nan, 0.0, math.inf, 1.0
    xs, logs = log_hypergeometric(n, k, m)
    at = logs[xs == a][0]
    p = float(min(1.0, np.exp(logs[logs <= at + 1e-7]).sum()))

    falls = -np.diff(logs)  # they rise, so tilted probabilities have one peak

    def tilted(log_or: float) -> tuple[np.ndarray, np.ndarray]:
        """Counts and their probabilities, without those that a double has no room for."""
        peak, end = int(np.searchsorted(falls, log_or)), len(xs)
        least = logs[peak] + xs[peak] * log_or - 745
        left = bisect_left(range(peak), least, key=lambda i: logs[i] + xs[i] * log_or)
        right = peak + bisect_left(range(peak, end), -least, key=lambda i: -(logs[i] + xs[i] * log_or))
        x = xs[left:right]
        w = logs[left:right] + x * log_or
        w = np.exp(w - w.max())
        return x, w / w.sum()

    def solve(f, target: float) -> float:
        lo, hi = -60.0, 60.0
        for _ in range(120):
            mid = (lo + hi) / 2
            if mid in (lo, hi):  # no double lies between
                break
            if f(*tilted(mid)) < target:
                lo = mid
            else:
                hi = mid
        return math.exp((lo + hi) / 2)

    alpha = (1 - level) / 2
    lo, hi = int(xs[0]), int(xs[-1])
    ratio = 0.0 if a == lo else math.inf if a == hi else solve(lambda x, w: float((w * x).sum()), a)
    lower = 0.0 if a == lo else solve(lambda x, w: float(w[x >= a].sum()), alpha)
    upper = math.inf if a == hi else solve(lambda x, w: -float(w[x <= a].sum()), -alpha)
    return ratio, lower, upper, p


def _first(lo: np.ndarray, hi: np.ndarray, holds) -> np.ndarray:
    """The least i in [lo, hi) from which ``holds`` is true, else hi; for all pairs of bounds at once."""
    lo, hi = lo.copy(), hi.copy()
    while (lo < hi).any():
        mid = (lo + hi) // 2
        yes = holds(mid) | (lo >= hi)
        lo, hi = np.where(yes, lo, mid + 1), np.where(yes & (lo < hi), mid, hi)
    return lo


def _three_rows(rows: tuple[int, int, int], seen: tuple[int, int, int]) -> float:
    """p of a table of three rows and two columns with these row totals and this first column.

    With the smallest row's cell held, the tables' probabilities rise to one peak and fall, so those no likelier than the
    seen table lie left and right of a stretch whose ends are found by bisection. Of them all count whose
    probability could change a double: the others together have less than 1e-16 of the seen table's own.
    A row's logarithms are computed once for each count, not for each table.
    """
    order = np.argsort(rows)
    u, r, s = (int(rows[i]) for i in order)
    k = int(sum(seen))
    n = u + r + s
    const = float((log_factorial([u, r, s, k, n - k]).sum() - log_factorial(n)))

    def part(total, x):
        return -(log_factorial(x) + log_factorial(total - x))

    def bounds(l):
        m = k - l
        lo, hi = np.maximum(0, m - s), np.minimum(r, m) + 1  # cells of the second row: [lo, hi)
        peak = np.clip((m + 1) * (r + 1) // (r + s + 2), lo, hi - 1)
        held = const + part(u, l)
        return m, lo, hi, peak, held, held + part(r, peak) + part(s, m - peak)

    at = const
    for i in order:
        at += float(part(rows[i], seen[i]))
    first, l, last = max(0, k - r - s), int(seen[order[0]]), min(u, k)
    many = math.log((last + 1 - first) * (r + 1))
    if at + many < -746:  # all tables no likelier than the seen one together are less than a double can say
        return 0.0
    most, least = at + max(1e-7, 4 * float(np.spacing(log_factorial(n)))), at - 37 - many  # beyond some 10 million hits rounding is larger than 1e-7
    first += bisect_left(range(first, l), True, key=lambda x: bool(bounds(x)[-1] >= least))  # peaks rise to the highest and fall as well
    last = l + bisect_left(range(l + 1, last + 1), True, key=lambda x: bool(bounds(x)[-1] < least))
    m, lo, hi, peak, held, top = bounds(np.arange(first, last + 1))

    def value(i):
        i = np.clip(i, lo, hi - 1)
        return held + part(r, i) + part(s, m - i)

    whole = top <= most  # no table of these is likelier
    left = _first(lo, peak + 1, lambda i: value(i) >= least), np.where(whole, peak + 1, _first(lo, peak + 1, lambda i: value(i) > most))
    right = np.where(whole, peak + 1, _first(peak, hi, lambda i: value(i) <= most)), _first(peak, hi, lambda i: value(i) < least)
    begin, end = np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]])
    some = begin < end
    begin, end, m, held = begin[some], end[some], np.concatenate([m, m])[some], np.concatenate([held, held])[some]
    y, z = int(begin.min()), int((m - end).min()) + 1
    second, third = part(r, np.arange(y, int(end.max()))), part(s, np.arange(z, int((m - begin).max()) + 1))[::-1]
    back = z + len(third) - 1 - m  # place in ``third`` of the table without hits in the second row
    stretches = zip(begin.tolist(), end.tolist(), back.tolist(), held.tolist(), strict=True)
    return min(1.0, math.fsum(float(np.exp(second[b - y : e - y] + third[b + a : e + a] + h).sum()) for b, e, a, h in stretches))


def fisher_table(table: list[list[int]]) -> float:
    """p of Fisher's exact test of an r x c table: the total probability of tables no likelier than the one seen.

    Of tables of three rows and two columns only those near the seen one's probability are summed, so the work follows the
    counts. Others with the same margins are enumerated column by column; equal remaining
    margins are enumerated once.
    """
    t = np.array(table, dtype=np.int64)
    t = t[t.sum(axis=1) > 0][:, t.sum(axis=0) > 0]
    rows, cols = t.sum(axis=1), t.sum(axis=0)
    if min(t.shape) < 2:
        return 1.0
    if 2 in t.shape and t.size in (4, 6):
        t = t if t.shape[1] == 2 else t.T
        t = np.vstack([t, np.zeros((3 - len(t), 2), dtype=np.int64)])
        return _three_rows(tuple(t.sum(axis=1).tolist()), tuple(t[:, 0].tolist()))
    logf = np.array([math.lgamma(i + 1) for i in range(int(t.sum()) + 1)])
    const = logf[rows].sum() + logf[cols].sum() - logf[int(t.sum())]
    seen = const - logf[t].sum()
    layer: dict[tuple[int, ...], dict[float, float]] = {tuple(rows): {0.0: 1.0}}

    def fillings(left: tuple[int, ...], need: int):
        if len(left) == 1:
            if need <= left[0]:
                yield (need,)
            return
        for x in range(max(0, need - sum(left[1:])), min(left[0], need) + 1):
            for rest in fillings(left[1:], need - x):
                yield (x, *rest)

    for col in cols[:-1]:
        nxt: dict[tuple[int, ...], dict[float, float]] = {}
        for left, sums in layer.items():
            for x in fillings(left, int(col)):
                key = tuple(np.subtract(left, x))
                cost = logf[list(x)].sum()
                into = nxt.setdefault(key, {})
                for s, n in sums.items():
                    k = round(s + cost, 9)
                    into[k] = into.get(k, 0.0) + n
        layer = nxt
    total = 0.0
    for left, sums in layer.items():
        cost = logf[list(left)].sum()
        total += sum(n * math.exp(const - s - cost) for s, n in sums.items() if const - s - cost <= seen + 1e-7)
    return float(min(1.0, total))


def binomial_test(x: int, n: int, p: float) -> float:
    """Two-sided p: the total probability of counts no likelier than ``x``."""
    if n == 0:
        return 1.0
    k = np.arange(n + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) + np.where(k > 0, k * np.log(p), 0) + np.where(n - k > 0, (n - k) * np.log1p(-p), 0)
    return float(min(1.0, np.exp(logs[logs <= logs[x] + 1e-7]).sum()))


def binomial_tail(x: int, n: int, p: float) -> float:
    """P(X >= x) of ``n`` trials that succeed with probability ``p``."""
    if x <= 0:
        return 1.0
    k = np.arange(x, n + 1)
    logs = log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0) + k * math.log(p) + (n - k) * math.log1p(-p)
    return float(min(1.0, np.exp(logs).sum()))


def binomial_interval(x: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact interval of a proportion (Clopper and Pearson)."""
    alpha = (1 - level) / 2

    def solve(a: float, b: float, target: float) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if beta_inc(a, b, mid) < target else (lo, mid)
        return (lo + hi) / 2

    return 0.0 if x == 0 else solve(x, n - x + 1, alpha), 1.0 if x == n else solve(x + 1, n - x, 1 - alpha)


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out += 1 / (x * x)
        x += 1
    f = 1 / (x * x)
    return out + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def trigamma_inverse(y: float) -> float:
    x = 0.5 + 1 / y
    for _ in range(60):
        step = trigamma(x) * (1 - trigamma(x) / y) / _tetragamma(x)
        x += step
        if -step / x < 1e-10:
            break
    return x


def _tetragamma(x: float) -> float:
    h = 1e-4 * x
    return (trigamma(x + h) - trigamma(x - h)) / (2 * h)
