"""Exponential smoothing in state-space form, its form and constants chosen by likelihood, for blocks of products.

Errors are additive; the trend is none, additive or damped; the season is none or additive over seven days. Innovations are
linear in the start states, so for given constants the best start states, and with them the likelihood, come from least
squares over the responses to each start state. The constants are then searched by a simplex inside their
bounds, every product with its own, all in lockstep: a round tries all points that a step may need, for all products in one
run through the days. Of the forms the one with the least AICc is taken, the first (simplest) of equals.
"""

from __future__ import annotations

from itertools import product

import numpy as np

from marketlens.operators.models import Block, Fit

TRENDS = ("none", "additive", "damped")
FORMS = [(t, s) for t in TRENDS for s in (False, True)]
ROUNDS = 30
CHUNK = 64  # products that go through the days together
PERIOD = 7


def _constants(u: np.ndarray, trend: str, season: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(alpha, beta, gamma, phi) from points of the unit cube, the last axis; the bounds keep every model stable."""
    rest = iter(range(1, u.shape[-1]))
    alpha = 1e-4 + 0.9998 * u[..., 0]
    zero = np.zeros_like(alpha)
    beta = alpha * u[..., next(rest)] if trend != "none" else zero
    gamma = (1 - alpha) * u[..., next(rest)] if season else zero
    phi = 0.8 + 0.18 * u[..., next(rest)] if trend == "damped" else zero + (trend != "none")
    return alpha, beta, gamma, phi


def _size(trend: str, season: bool) -> tuple[int, int]:
    """(constants, start states) of a form; the seasons' start states sum to 0."""
    return 1 + (trend != "none") + season + (trend == "damped"), 1 + (trend != "none") + (PERIOD - 1) * season


def _starts(shape: tuple[int, ...], trend: str, season: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level, slope, seasons) whose first entry is zero and whose others are the unit start states."""
    _, q = _size(trend, season)
    level, slope, seasons = np.zeros((q + 1, *shape)), np.zeros((q + 1, *shape)), np.zeros((PERIOD, q + 1, *shape))
    level[1] = 1
    if trend != "none":
        slope[2] = 1
    if season:
        for r in range(PERIOD - 1):
            seasons[r, q - PERIOD + 2 + r] = 1
            seasons[PERIOD - 1, q - PERIOD + 2 + r] = -1
    return level, slope, seasons


def _solve(y: np.ndarray, there: np.ndarray, u: np.ndarray, trend: str, season: bool) -> tuple[np.ndarray, np.ndarray]:
    """(sum of squares, start states) for points ``u`` (candidates, products, constants) at their best start states."""
    alpha, beta, gamma, phi = _constants(u, trend, season)
    level, slope, seasons = _starts(alpha.shape, trend, season)
    gram = np.zeros((level.shape[0], *level.shape))
    for t in range(len(y)):
        base = level + phi * slope
        s = seasons[t % PERIOD]
        e = -(base + s)
        e[0] += y[t]
        e *= there[t]
        level, slope = base + alpha * e, phi * slope + beta * e
        s += gamma * e
        gram += e[:, None] * e
    gram = gram.reshape(*gram.shape[:2], -1).transpose(2, 0, 1)
    a, r = gram[:, 1:, 1:], gram[:, 1:, 0]
    q = a.shape[1]
    ridge = (1e-10 * np.trace(a, axis1=1, axis2=2) / q + 1e-12)[:, None, None] * np.eye(q)
    x = -np.linalg.solve(a + ridge, r[..., None])[..., 0]
    sse = gram[:, 0, 0] + 2 * (x * r).sum(1) + np.einsum("pi,pij,pj->p", x, a, x)
    return np.maximum(sse, 1e-9).reshape(alpha.shape), x.T.reshape(q, *alpha.shape)


def _search(y: np.ndarray, there: np.ndarray, trend: str, season: bool) -> tuple[np.ndarray, np.ndarray]:
    """(least sum of squares, its point) of each product, by a bounded simplex."""
    d, _ = _size(trend, season)
    p = y.shape[1]
    value = lambda u: _solve(y, there, u, trend, season)[0]
    grid = np.array(list(product((0.05, 0.25, 0.5, 0.9), *[(0.05, 0.5)] * (d - 1))))
    tried = np.concatenate([value(np.tile(g[:, None], (1, p, 1))) for g in np.array_split(grid, -(-len(grid) // 8))])
    corners = np.tile(grid[tried.argmin(0)], (d + 1, 1, 1))  # the simplex begins at the best point of a coarse grid
    for k in range(d):
        corners[k + 1, :, k] += np.where(corners[k + 1, :, k] > 0.5, -0.2, 0.2)
    f = value(corners)
    for _ in range(ROUNDS):
        order = np.argsort(f, axis=0, kind="stable")
        corners, f = np.take_along_axis(corners, order[..., None], 0), np.take_along_axis(f, order, 0)
        middle, worst = corners[:-1].mean(0), corners[-1]
        steps = [middle + k * (middle - worst) for k in (1.0, 2.0, 0.5, -0.5)]  # reflect, expand, contract outside, inside
        shrunk = corners[:1] + 0.5 * (corners[1:] - corners[:1])
        tried = np.clip(np.concatenate([steps, shrunk]), 0.0, 1.0)
        g = value(tried)
        reflect, expand, outside, inside = g[:4]
        far = reflect < f[0]
        pick = np.where(far, np.where(expand < reflect, 1, 0), np.where(reflect < f[-2], 0, np.where((reflect < f[-1]) & (outside <= reflect), 2, np.where((reflect >= f[-1]) & (inside < f[-1]), 3, -1))))
        take = np.maximum(pick, 0)[None]
        moved, at = np.take_along_axis(g[:4], take, 0)[0], np.take_along_axis(tried[:4], take[..., None], 0)[0]
        move = pick >= 0
        corners[-1], f[-1] = np.where(move[:, None], at, tried[-1]), np.where(move, moved, g[-1])
        corners[1:-1] = np.where(move[None, :, None], corners[1:-1], tried[4:-1])
        f[1:-1] = np.where(move, f[1:-1], g[4:-1])
    best = f.argmin(0)[None]
    return np.take_along_axis(f, best, 0)[0], np.take_along_axis(corners, best[..., None], 0)[0]


def criterion(sse: np.ndarray, n: np.ndarray, trend: str, season: bool) -> np.ndarray:
    """AICc; infinite where a form has too many numbers for the days."""
    k = sum(_size(trend, season)) + 1
    spare = n - k - 1
    value = n * np.log(sse / np.maximum(n, 1)) + 2 * k + 2 * k * (k + 1) / np.maximum(spare, 1)
    return np.where((spare > 0) & (n >= (2 * PERIOD if season else 4)), value, np.inf)


def _ends(y: np.ndarray, n: np.ndarray, u: np.ndarray, x: np.ndarray, trend: str, season: bool) -> tuple[np.ndarray, ...]:
    """(level, slope, seasons, phi) behind each product's last day, from its start states."""
    alpha, beta, gamma, phi = _constants(u, trend, season)
    units = _starts((1,), trend, season)
    level, slope = (units[i][1:, 0] @ x for i in (0, 1)) if len(x) else (0, 0)
    seasons = np.einsum("rq,qp->rp", units[2][:, 1:, 0], x)
    for t in range(len(y)):
        on = t < n
        base, s = level + phi * slope, seasons[t % PERIOD]
        e = y[t] - base - s
        level, slope = np.where(on, base + alpha * e, level), np.where(on, phi * slope + beta * e, slope)
        seasons[t % PERIOD] = np.where(on, s + gamma * e, s)
    return level, slope, seasons, phi


def ets(b: Block) -> tuple[Fit, np.ndarray, np.ndarray]:
    """(fit, number of the form taken, AICc by form) of every product; ``past`` isn't to be had."""
    scores, forms = np.full((len(FORMS), len(b.n)), np.inf), np.zeros(len(b.n), int)
    states = np.zeros((3 + PERIOD, len(b.n)))  # level, slope, phi, seasons
    for a in range(0, len(b.n), CHUNK):
        part = b.of(np.arange(a, min(a + CHUNK, len(b.n))))
        there = part.there[: part.n.max()]
        y = np.where(there, part.y[: len(there)], 0.0)
        mine, points = slice(a, a + len(part.n)), []
        for f, form in enumerate(FORMS):
            sse, u = _search(y, there, *form)
            scores[f, mine] = criterion(sse, part.n, *form)
            points.append(u)
        forms[mine] = scores[:, mine].argmin(0)
        for f, form in enumerate(FORMS):
            those = np.flatnonzero(forms[mine] == f)
            if len(those):
                u = points[f][those]
                _, x = _solve(y[:, those], there[:, those], u[None], *form)
                level, slope, seasons, phi = _ends(y[:, those], part.n[those], u, x[:, 0], *form)
                states[:, a + those] = np.concatenate([[level, slope, phi], seasons])
    level, slope, phi, seasons = states[0], states[1], states[2], states[3:]

    def ahead(h: int) -> np.ndarray:
        reach = np.cumsum(phi ** np.arange(1, h + 1)[:, None], axis=0)
        return np.maximum(level + reach * slope + np.take_along_axis(seasons, (b.n + np.arange(h)[:, None]) % PERIOD, 0), 0)

    return Fit(ahead, lambda: np.full(b.y.shape, np.nan), np.isfinite(scores).any(0)), forms, scores
