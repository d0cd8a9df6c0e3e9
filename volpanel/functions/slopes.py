"""Median of all pairwise slopes without holding the pairs.

Of points sorted by x, the pair (i, j) has a slope of at most t if and only if the residual y - t * x does not rise
from i to j. So the number of such slopes is a number of inversions, which a merge sort counts in O(n log n). The rank
wanted is closed in by bisection until few slopes are left between two thresholds; those pairs change their order
between the two residuals, are listed, and the slope is selected among them.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np

#: Curves of so many pairs at most are taken at once.
AT_ONCE = 50_000


def inversions(values: np.ndarray) -> int:
    """Number of i < j with values[j] <= values[i]."""
    n = len(values)
    # equal values count, so later ones come first among them
    rank = np.empty(n, np.int64)
    rank[np.lexsort((-np.arange(n), values))] = np.arange(n)
    total, width = 0, 1
    while width < n:
        block = np.arange(n) // (2 * width)
        left = np.arange(n) // width % 2 == 0
        # ranks of the right halves among those of the left half of their block
        keys = np.sort(block[left] * n + rank[left])
        other = block[~left] * n + rank[~left]
        ends = np.searchsorted(keys, (block[~left] + 1) * n)
        total += int((ends - np.searchsorted(keys, other)).sum())
        width *= 2
    return total


def between(x: np.ndarray, y: np.ndarray, low: float, high: float) -> np.ndarray:
    """Slopes above ``low`` and up to ``high``: of the pairs that change their order between the two residuals."""
    before, after = y - low * x, y - high * x
    seen: list[tuple[float, int]] = []
    found: list[tuple[int, int]] = []
    for j in np.lexsort((-np.arange(len(x)), before)).tolist():
        at = bisect_left(seen, (after[j], -1))
        found += [(i, j) if i < j else (j, i) for _, i in seen[at:]]
        insort(seen, (after[j], j))
    pairs = np.array(found, int).reshape(-1, 2)
    return np.sort((y[pairs[:, 1]] - y[pairs[:, 0]]) / (x[pairs[:, 1]] - x[pairs[:, 0]]))


def ranked_slope(x: np.ndarray, y: np.ndarray, k: int) -> float:
    """The k-th smallest slope (from 1) of points with rising x."""
    steps = np.diff(y) / np.diff(x)
    # neighbours have the extreme slopes; the margin keeps rounded residuals from hiding them
    margin = 1e-6 * (float(np.abs(steps).max()) + float(np.ptp(y) / (x[-1] - x[0]))) + 1e-300
    low, high = float(steps.min()) - margin, float(steps.max()) + margin
    below, upto = 0, len(x) * (len(x) - 1) // 2
    while upto - below > 4 * len(x):
        middle = low + (high - low) / 2
        if not low < middle < high:
            return high  # all that is left are equal slopes
        count = inversions(y - middle * x)
        if count >= k:
            high, upto = middle, count
        else:
            low, below = middle, count
    found = between(x, y, low, high)
    return float(found[min(max(k - below - 1, 0), len(found) - 1)]) if len(found) else high


def median_slope(x: np.ndarray, y: np.ndarray, at_once: int = AT_ONCE) -> tuple[float | None, int]:
    """Median of the slopes of all pairs of points with distinct x, and the number of pairs."""
    pairs = len(x) * (len(x) - 1) // 2
    if not pairs:
        return None, 0
    if pairs <= at_once:
        i, j = np.triu_indices(len(x), 1)
        return float(np.median((y[j] - y[i]) / (x[j] - x[i]))), pairs
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    upper = ranked_slope(x, y, pairs // 2 + 1)
    return (upper if pairs % 2 else (ranked_slope(x, y, pairs // 2) + upper) / 2), pairs
