import math

import numpy as np
import pytest

from netloom.functions import special as s
from netloom.functions.weighted_chi2 import hbe_complement, lpb4_complement


def test_tails_against_closed_forms():
    for x in (0.01, 0.5, 1, 3, 10, 60):
        assert s.chi2_sf(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-10)
        assert s.chi2_sf(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-9)
        assert s.chi2_sf(x, 4) == pytest.approx(math.exp(-x / 2) * (1 + x / 2), rel=1e-10)
        assert s.t_two_sided(x, 1) == pytest.approx(1 - 2 * math.atan(x) / math.pi, rel=1e-9)
        assert s.t_two_sided(-x, 2) == pytest.approx(1 - x / math.sqrt(2 + x * x), rel=1e-8)
        assert s.gamma_p(2.5, x) + s.gamma_q(2.5, x) == pytest.approx(1)
    assert s.chi2_sf(0, 3) == 1 and s.t_two_sided(math.inf, 3) == 0


def test_digamma_and_friends():
    assert s.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-12)
    x = np.array([0.3, 1.7, 25.0])
    assert s.digamma(x + 1) == pytest.approx(s.digamma(x) + 1 / x)
    assert s.normal_cdf(np.array([0.0, 1.96]))[1] == pytest.approx(0.9750021048517795)
    assert s.log_sum_exp(np.array([[-1000.0, -1000.0]]))[0] == pytest.approx(-1000 + math.log(2))


def test_simplex_search():
    p, v = s.nelder_mead(lambda many: [(z[0] - 1) ** 2 + 10 * (z[1] + 2) ** 2 for z in many], np.array([5.0, 5.0]), 1e-10, 1e-10)
    assert p == pytest.approx([1, -2], abs=1e-3) and v < 1e-5


@pytest.mark.parametrize("weights", [[1, 1, 1, 1, 1], [3, 2, 1, 0.5, 0.1], [5, 1, 1, 1]])
def test_weighted_sums(weights):
    w = np.array(weights, float)
    draws = (np.random.default_rng(0).standard_normal((400_000, len(w))) ** 2) @ w
    for q in (0.5, 0.9, 0.99):
        x = np.quantile(draws, q)
        assert hbe_complement(w, x) == pytest.approx(1 - q, abs=0.04)  # three cumulants only
        try:
            assert lpb4_complement(w, x) == pytest.approx(1 - q, abs=0.01)
        except ValueError:
            pass
    assert hbe_complement(np.ones(3), 4.0) == pytest.approx(s.chi2_sf(4.0, 3), rel=1e-9)
