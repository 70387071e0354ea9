"""Neighbours and counts over ranks against all pairs."""

import time

import numpy as np
import pytest

from netloom.functions.kdtree import KDTree
from netloom.functions.rank_points import count_squares, kth_distances
from netloom.operators.independence import knn_mi, nearest_rows, ranks


@pytest.mark.parametrize("n", [7, 33, 100, 1500])
@pytest.mark.parametrize("d", [2, 3, 4])
def test_rank_points_equal_all_pairs(n, d):
    r = np.random.default_rng(n + d)
    for x in (r.normal(size=(n, d)), np.cumsum(r.normal(size=(n, d)), 1) // 0.5, np.repeat(r.normal(size=(n, 1)), d, 1)):
        x = np.column_stack([ranks(c) for c in x.T]).astype(np.int64)
        gaps = np.abs(x[:, None] - x[None])
        for k in (1, 5):
            eps = kth_distances(x, k)
            assert (eps == np.sort(gaps.max(2), 1)[:, k]).all()
            for e in (eps, np.zeros(n, int), np.full(n, n)):
                assert (count_squares(x[:, 0], x[:, 1], e) == (gaps[:, :, :2].max(2) < e[:, None]).sum(1)).all()
    with pytest.raises(ValueError):
        kth_distances(x, n)


def test_nearest_rows_search_only_a_few_of_equal_rows():
    r = np.random.default_rng(2)
    for z in (r.integers(0, 4, (300, 1)), r.integers(0, 3, (300, 2)), r.normal(size=(300, 1)), np.zeros((50, 1))):
        assert (nearest_rows(z.astype(float), 6) == KDTree(z).neighbours(6)[1]).all()


def test_a_statistic_of_many_rows_takes_seconds():
    """A permutation of 60,000 rows took ten seconds, and its neighbours in a column of few values minutes."""
    r = np.random.default_rng(3)
    n = 60_000
    z = r.integers(0, 25, n).astype(float)
    began = time.process_time()
    assert nearest_rows(z[:, None], 6).shape == (n, 6)
    assert abs(knn_mi(ranks(r.normal(size=n)), ranks(r.normal(size=n)), ranks(z)[:, None], 5)) < 1
    assert time.process_time() - began < 4
