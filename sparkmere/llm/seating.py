"""Table counts of Pitman-Yor restaurants, drawn by Gibbs sampling: numpy only.

A restaurant's seating is kept as the number of tables of each dish, which is all that its own and its parent's
probabilities need; the other details are summed out. With c customers of a dish, discount d, strength s, T' tables of other
dishes in the restaurant and the parent's probability p of the dish, the number t of its tables has the conditional

    P(t) ~ S(c, t) * p^t * (s + d T') (s + d (T' + 1)) ... (s + d (T' + t - 1)),

S the generalised Stirling numbers of discount d: the sum over all ways to seat c customers at t tables. Drawing from it
takes all customers of the dish away and seats them again at once. Up to EXACT customers it is drawn exactly. Beyond, S is
taken by its saddle point (the generating function of S(., t) is ((1 - (1 - z)^d) / d)^t / t!), whose error, a function of
t / c^d once c is large, is corrected by the exact numbers of KNOWN customers; t is moved by Metropolis steps. There is no
greatest number of customers.

Random numbers are hashes of the restaurant, the dish and the sweep, so they don't depend on where a dish is seated.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .words import U64, mix

EXACT, KNOWN, STEPS = 64, 2048, 6


def uniform(h: np.ndarray, sweep: int, draw: int) -> np.ndarray:
    """Numbers between 0 and 1, both aside, from hashes."""
    z = mix(h + U64(((sweep * 64 + draw + 1) * 0xD1342543DE82EF95) & (2**64 - 1)))
    return ((z >> U64(12)).astype(np.float64) + 0.5) * 2.0**-52


@lru_cache(maxsize=8)
def log_stirling_table(discount: float, most: int = EXACT) -> np.ndarray:
    """log S(c, t) for c, t <= most, by S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t)."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    t = np.arange(1, most + 1)
    for c in range(most):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(c - discount * t > 0, np.log(np.maximum(c - discount * t, 1e-300)) + out[c, 1:], -np.inf)
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay)
    return out


def lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma for x > 0, by Stirling's series beyond 8."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift -= np.where(low, np.log(np.where(low, y, 1.0)), 0.0)
        y = np.where(low, y + 1, y)
    i = 1 / (y * y)
    return shift + (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i / 1680))) / y


def _solve(f, low: np.ndarray) -> np.ndarray:
    """Where the falling function `f` passes 0, between `low` and 0."""
    high = np.full_like(low, -1e-13)
    for _ in range(60):
        mid = 0.5 * (low + high)
        up = f(mid) > 0
        low, high = np.where(up, mid, low), np.where(up, high, mid)
    return 0.5 * (low + high)


@lru_cache(maxsize=8)
def _error(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """The saddle point's error against log(t / c^d), of c = KNOWN customers."""
    row, t = np.full(KNOWN + 1, -np.inf), np.arange(1.0, KNOWN + 1)
    row[0] = 0
    for c in range(KNOWN):
        stay = np.where(c > discount * t, np.log(np.maximum(c - discount * t, 1e-300)) + row[1:], -np.inf)
        row[1:] = np.logaddexp(row[:-1], stay)
        row[0] = -np.inf
    return np.log(t) - discount * np.log(KNOWN), _saddle(np.full(KNOWN, float(KNOWN)), t, discount) - row[1:]


def log_stirling(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(c, t) for large c."""
    at, error = _error(discount)
    x = np.log(t) - discount * np.log(c)
    below = np.minimum(x - at[0], 0) * (error[1] - error[0]) / (at[1] - at[0])
    return np.where(t < c, _saddle(c, t, discount) - np.interp(x, at, error) - below, 0.0)


def _saddle(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """y = 1 - z is sought by its log; S(c, c) = 1."""
    d, ratio = discount, np.log(c / t)
    y = _solve(lambda v: np.log(d) + np.log(-np.expm1(v)) + (d - 1) * v - np.log(-np.expm1(d * v)) - ratio, -(np.log(c) + 5) / (1 - d))
    log_z, phi = np.log(-np.expm1(y)), -np.expm1(d * y) / d
    spread = t * (c / t + (1 - d) * np.exp(2 * log_z + (d - 2) * y) / phi - (c / t) ** 2)
    got = lgamma(c + 1) - lgamma(t + 1) + t * np.log(phi) - c * log_z - 0.5 * np.log(2 * np.pi * np.maximum(spread, 1e-300))
    return np.where(t < c, got, 0.0)


def mode(c: np.ndarray, theta: np.ndarray, base: np.ndarray, discount: float) -> np.ndarray:
    """About the likeliest number of tables."""
    d, a = discount, np.log(base * theta)
    y = _solve(lambda v: np.log(-np.expm1(v)) + (d - 1) * v + a - np.log1p(base * np.expm1(d * v)) - np.log(c), -(np.log(c) + np.abs(a) + 5) / (1 - d))
    share = -base * np.expm1(d * y)
    return np.clip(theta * share / d / (1 - share), 1, c)


def draw_tables(c: np.ndarray, t: np.ndarray, theta: np.ndarray, base: np.ndarray, discount: float, h: np.ndarray, sweep: int) -> np.ndarray:
    """New numbers of tables of dishes with c > 0 customers and t tables.

    theta: strength + discount * the tables of the restaurant's other dishes; base: the parent's probability of the dish; h:
    a hash of restaurant and dish. In the first sweep (0) the walk of large dishes begins at the mode, else at t.
    """
    out = np.ones(len(c), np.int64)
    some = np.flatnonzero((c > 1) & (c <= EXACT))
    some = some[np.argsort(c[some], kind="stable")]
    ends = np.searchsorted(c[some], np.arange(2, EXACT + 2))
    table = log_stirling_table(discount)
    for n in range(2, EXACT + 1):
        i = some[ends[n - 2] : ends[n - 1]]
        if len(i):
            j = np.arange(n)
            w = np.cumsum(np.log(theta[i][:, None] + discount * j) + np.log(base[i])[:, None], axis=1) + table[n, 1 : n + 1]
            w = np.cumsum(np.exp(w - w.max(1, keepdims=True)), axis=1)
            out[i] = 1 + (w < (uniform(h[i], sweep, 0) * w[:, -1])[:, None]).sum(1)
    big = np.flatnonzero(c > EXACT)
    if len(big):
        n, th, p, hb = c[big].astype(np.float64), theta[big], base[big], h[big]
        best = mode(n, th, p, discount)
        at = np.round(best) if sweep == 0 else np.clip(t[big], 1, c[big]).astype(np.float64)
        weight = lambda x: lgamma(th / discount + x) + x * np.log(discount * p) + log_stirling(n, x, discount)
        gap = np.minimum(np.maximum(1.0, 0.1 * best), np.minimum(best - 1, n - best))
        bend = 2 * weight(best) - weight(best - gap) - weight(best + gap)
        step = np.clip(2 * gap / np.sqrt(np.maximum(bend, 1e-2)), 1.0, n)
        now = weight(at)
        for k in range(STEPS):
            u, v, a = (uniform(hb, sweep, 1 + 3 * k + e) for e in range(3))
            to = at + np.round(step * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v))
            inside = (to >= 1) & (to <= n)
            new = weight(np.where(inside, to, at))
            go = inside & (np.log(a) < new - now)
            at, now = np.where(go, to, at), np.where(go, new, now)
        out[big] = at.astype(np.int64)
    return out
