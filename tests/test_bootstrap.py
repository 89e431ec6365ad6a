import numpy as np

from codegauge.operators import stats


def plain(values, counts, seed, resamples):
    rng, flat = np.random.default_rng(seed), np.repeat(values, counts)
    means = [flat[rng.integers(0, len(flat), size=len(flat))].mean() for _ in range(resamples)]
    return tuple(np.percentile(means, [2.5, 97.5]))


def test_lots_draw_as_all_at_once(monkeypatch):
    rng = np.random.default_rng(1)
    values, counts = rng.normal(size=101), rng.integers(1, 5, 101)
    want = plain(values, counts, 7, 600)
    assert stats.bootstrap_interval(values, counts, 7, 600) == want
    monkeypatch.setattr(stats, "DRAWS", 1000)
    assert stats.bootstrap_interval(values, counts, 7, 600) == want


def test_many_rows_are_drawn_by_distinct_values():
    rng = np.random.default_rng(2)
    values, counts = rng.normal(size=300), rng.integers(1, 1 << 30, 300)
    low, high = stats.bootstrap_interval(values, counts, 3, 1000)
    n, mean = counts.sum(), np.average(values, weights=counts)
    error = np.sqrt(np.average((values - mean) ** 2, weights=counts) / n)
    assert abs(low - (mean - 1.96 * error)) < 0.3 * error and abs(high - (mean + 1.96 * error)) < 0.3 * error


def test_few_values_and_none():
    assert stats.bootstrap_interval(np.array([0.5]), np.array([9]), 1, 50) == (0.5, 0.5)
    assert all(np.isnan(x) for x in stats.bootstrap_interval(np.array([]), np.array([], int), 1, 50))
