import numpy as np
import pytest

from netloom.functions.kdtree import KDTree


@pytest.mark.parametrize("n,d,k", [(1, 1, 1), (7, 3, 7), (400, 1, 3), (900, 4, 6), (500, 2, 499)])
def test_neighbours_and_counts_against_all_pairs(n, d, k):
    rng = np.random.default_rng(n + d)
    x = rng.normal(size=(n, d)).round(1)  # with ties
    far = np.abs(x[:, None] - x[None]).max(2)
    tree = KDTree(x, 5)
    dist, rows = tree.neighbours(k)
    order = np.lexsort((np.broadcast_to(np.arange(n), far.shape), far))[:, :k]
    assert np.array_equal(rows, order) and np.array_equal(dist, np.take_along_axis(far, order, 1))
    eps = rng.choice([0.0, 0.1, 0.5, 3.0, 100.0], n)
    assert np.array_equal(tree.count_inside(eps), (far < eps[:, None]).sum(1))
    other = rng.normal(size=(30, d)).round(1)
    far = np.abs(other[:, None] - x[None]).max(2)
    dist, rows = tree.query(other, k)
    assert np.array_equal(rows, np.lexsort((np.broadcast_to(np.arange(n), far.shape), far))[:, :k])


def test_equal_points_and_empty_input():
    tree = KDTree(np.ones((1000, 2)))
    assert (tree.neighbours(3)[0] == 0).all() and (tree.count_inside(np.full(1000, 0.5)) == 1000).all() and (tree.count_inside(np.zeros(1000)) == 0).all()
    assert KDTree(np.zeros((0, 2))).count_inside(np.zeros(0)).tolist() == []
    with pytest.raises(ValueError):
        KDTree(np.zeros((2, 2))).query(np.zeros((1, 2)), 3)
