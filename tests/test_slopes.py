"""Median slopes by counting inversions against all pairs."""

import itertools
import tracemalloc

import numpy as np
import pytest

from volpanel.functions.slopes import inversions, median_slope, ranked_slope


def test_inversions_count_pairs_that_do_not_rise():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 64, 101):
        v = rng.integers(0, 9, n).astype(float)
        assert inversions(v) == sum(b <= a for a, b in itertools.combinations(v, 2))


@pytest.mark.parametrize("n", [2, 3, 10, 41, 160])
def test_selection_equals_the_sorted_slopes(n):
    rng = np.random.default_rng(n)
    x = np.sort(rng.choice(np.arange(5 * n), n, replace=False)).astype(float)
    for y in (rng.normal(size=n), np.round(rng.normal(size=n), 1), -0.97 * x + rng.normal(size=n) * 1e-3, 2.0 * x, np.zeros(n)):
        i, j = np.triu_indices(n, 1)
        slopes = np.sort((y[j] - y[i]) / (x[j] - x[i]))
        for k in {1, len(slopes) // 3 + 1, len(slopes)}:
            assert ranked_slope(x, y, k) == pytest.approx(slopes[k - 1], rel=1e-9, abs=1e-12)
        assert median_slope(x, y, at_once=0) == (pytest.approx(np.median(slopes), rel=1e-9, abs=1e-12), len(slopes))
    shuffled = rng.permutation(n)
    assert median_slope(x[shuffled], y[shuffled], at_once=0)[0] == pytest.approx(median_slope(x, y)[0], abs=1e-12)


def test_ten_thousand_strikes_in_bounded_memory():
    rng = np.random.default_rng(3)
    x = np.arange(10_000) * 0.05 + 1
    y = -0.98 * x + rng.normal(size=10_000) * 0.01
    tracemalloc.start()
    slope, pairs = median_slope(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs == 49_995_000 and slope == pytest.approx(-0.98, abs=1e-4)
    assert peak < 40e6  # all pairs would be 400 MB a column
    below = sum(int(((y[i + 1 :] - y[i]) / (x[i + 1 :] - x[i]) < slope).sum()) for i in range(9_999))
    assert abs(below - pairs / 2) <= 1
