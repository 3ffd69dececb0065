"""Sequential kernels over one series; each is at most as long as the calendar."""

from __future__ import annotations

from math import lgamma, pi

import numpy as np


def half_gammas(n: int) -> np.ndarray:
    """ln gamma(i / 2) for i from 0 to n; the first isn't used."""
    return np.array([0.0, *[lgamma(i / 2) for i in range(1, n + 1)]])


def student_log_pdf(x: float, nu: np.ndarray, mean: np.ndarray, scale: np.ndarray, gammas: np.ndarray | None = None) -> np.ndarray:
    """Log density of Student's t with whole degrees of freedom nu."""
    nu = np.asarray(nu)
    i = np.rint(nu).astype(int)
    gammas = half_gammas(int(i.max()) + 1) if gammas is None else gammas
    z = (x - mean) / scale
    return gammas[i + 1] - gammas[i] - np.log(nu * pi) / 2 - np.log(scale) - (nu + 1) / 2 * np.log1p(z * z / nu)


def bocpd(z: np.ndarray, hazard: float = 1 / 24) -> np.ndarray:
    """Probability that the current run has at most one value, under a Normal-Gamma model; missing values are passed over."""
    out, gammas = np.full(len(z), np.nan), half_gammas(len(z) + 4)
    run, mean, kappa, alpha, beta = np.ones(1), np.zeros(1), np.ones(1), np.ones(1), np.ones(1)
    for t in np.flatnonzero(np.isfinite(z)):
        x = z[t]
        weight = run * np.exp(student_log_pdf(x, 2 * alpha, mean, np.sqrt(beta * (kappa + 1) / (alpha * kappa)), gammas))
        run = np.r_[weight.sum() * hazard, weight * (1 - hazard)]
        run /= run.sum()
        out[t] = run[:2].sum()
        beta = np.r_[1, beta + kappa * (x - mean) ** 2 / (2 * (kappa + 1))]
        mean, kappa, alpha = np.r_[0, (kappa * mean + x) / (kappa + 1)], np.r_[1, kappa + 1], np.r_[1, alpha + 0.5]
    return out


def costs(x: np.ndarray) -> np.ndarray:
    """costs[a, b]: squared deviations of x[a:b] from its mean."""
    one, two = np.r_[0, np.cumsum(x)], np.r_[0, np.cumsum(x * x)]
    n = np.maximum(np.arange(len(one))[None, :] - np.arange(len(one))[:, None], 1)
    return np.maximum(two[None, :] - two[:, None] - (one[None, :] - one[:, None]) ** 2 / n, 0)


def optimal_cuts(cost: np.ndarray, n: int, penalty: float, least: int = 2, grid: int = 5) -> list[int]:
    """Starts of the segments after the first that minimise cost plus penalty a cut; cuts are multiples of grid."""
    ends = [b for b in range(grid, n, grid) if b >= least] + [n]
    best, back = {0: -penalty}, {0: 0}
    for b in ends:
        starts = [a for a in best if b - a >= least]
        if starts:
            total = [best[a] + cost[a, b] + penalty for a in starts]
            i = int(np.argmin(total))
            best[b], back[b] = total[i], starts[i]
    cuts, at = [], n
    while back.get(at, 0):
        at = back[at]
        cuts.append(at)
    return cuts


def binary_cuts(cost: np.ndarray, n: int, penalty: float, least: int = 2, grid: int = 5) -> list[int]:
    """Starts found by splitting segments at the best multiple of grid as long as it gains more than penalty."""
    cuts, todo = [], [(0, n)]
    while todo:
        a, b = todo.pop()
        at = np.array([c for c in range(a + grid - a % grid, b, grid) if c - a >= least and b - c >= least], int)
        if len(at):
            gain = cost[a, b] - cost[a, at] - cost[at, b]
            if gain.max() > penalty:
                c = int(at[gain.argmax()])
                cuts.append(c)
                todo += [(a, c), (c, b)]
    return cuts


def segment_score(x: np.ndarray, method: str = "pelt", penalties: tuple = (0.5, 1, 2, 4, 8, 16, 32), start: int = 6, grid: int = 5) -> np.ndarray:
    """The largest of rising penalties, in variances of differences, at which a cut still falls on this or the last month.

    Cuts fall on a grid of months, so only the month after one of them can score; the others aren't searched.
    """
    out, cost = np.zeros(len(x)), costs(x)
    find = optimal_cuts if method == "pelt" else binary_cuts
    for t in range(start, len(x)):
        if (t - 1) % grid and t % grid:
            continue
        unit = np.var(np.diff(x[: t + 1])) or 1e-6
        for p in penalties:
            if not any(c >= t - 1 for c in find(cost, t + 1, p * unit, grid=grid)):
                break
            out[t] = p
    return out
