import numpy as np
import pytest

from netloom.operators import box_sums
from netloom.operators.box_sums import BoxSums, Plain, kernel_sums
from netloom.operators.kde import pair_sums


@pytest.mark.parametrize("share", [False, True])
@pytest.mark.parametrize("d", [1, 2])
@pytest.mark.parametrize("size", [2, 6, 40])
def test_boxes_equal_all_pairs(d, size, share):
    """Dense and sparse rows with weights and far rows; points in boxes of many and of few points, and far from every row."""
    rng = np.random.default_rng(1)
    t, p = rng.uniform(-size, size, (2000, d)), rng.uniform(-size, size, (1500, d))
    t[:5] *= 30
    p[:50] *= 50
    p[100] = 1e6
    w = np.log(rng.integers(1, 5, len(t)))
    sums = kernel_sums(t, w, share)
    assert isinstance(sums, BoxSums)
    want, whole = Plain(t, w, share).logs(p), Plain(t[:, 1:], w).logs(p[:, 1:])
    for got in (sums.logs(p), sums.logs(p[::-1])[::-1], np.concatenate([sums.logs(x[None]) for x in p[:120]] + [sums.logs(p[120:])])):
        if share:  # right to a part of all weight, not of the share
            assert np.exp(got - whole) == pytest.approx(np.exp(want - whole), abs=1e-11)
        else:
            assert got == pytest.approx(want, rel=1e-11, abs=1e-11)


def test_work_grows_with_rows_and_points(monkeypatch):
    """The pairs that are looked at one by one; before, all 400 million were."""
    seen, plain = [], box_sums.pairs
    monkeypatch.setattr(box_sums, "pairs", lambda p, t, *a: seen.append(len(p) * len(t)) or plain(p, t, *a))
    rng = np.random.default_rng(2)
    for share in (False, True):
        kernel_sums(rng.uniform(-8, 8, (20_000, 2)), share=share).logs(rng.uniform(-8, 8, (20_000, 2)))
    assert sum(seen) < 20_000 * 20_000 / 100


def test_moments_beyond_their_bound_are_made_anew(monkeypatch):
    rng = np.random.default_rng(3)
    t, p = rng.uniform(-8, 8, (3000, 2)), rng.uniform(-8, 8, (3000, 2))
    monkeypatch.setattr(box_sums, "KEPT", 1000)
    sums = kernel_sums(t)
    for part in np.split(p, 3):
        assert sums.logs(part) == pytest.approx(Plain(t, np.zeros(len(t))).logs(part), abs=1e-11)


def test_sums_over_pairs():
    x = np.random.default_rng(4).normal(1e5, 1, (900, 1))
    for s in (0.05, 0.5):
        want = np.triu(np.exp(-0.5 * ((x - x.T) / s) ** 2), 1).sum()
        assert pair_sums(x, [np.array([s])]) == pytest.approx([want], rel=1e-9)
