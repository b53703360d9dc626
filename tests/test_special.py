import math

import numpy as np
import pytest

from labquarry.functions import special as s


@pytest.mark.parametrize(("t", "df", "p"), [(2.0, 10, 0.036694), (1.0, 1, 0.25), (0.0, 5, 0.5), (-2.0, 10, 0.963306), (12.706, 1, 0.025)])
def test_t(t, df, p):
    assert float(s.t_sf(t, df)) == pytest.approx(p, abs=2e-6)


@pytest.mark.parametrize(("f", "a", "b", "p"), [(4.0, 2, 10, 0.052922), (1.0, 5, 5, 0.5), (161.4476, 1, 1, 0.05)])
def test_f(f, a, b, p):
    assert float(s.f_sf(f, a, b)) == pytest.approx(p, abs=2e-6)


@pytest.mark.parametrize(("x", "k", "p"), [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (18.307, 10, 0.05), (0.0, 3, 1.0)])
def test_chi2(x, k, p):
    assert float(s.chi2_sf(x, k)) == pytest.approx(p, abs=2e-6)


def test_identities():
    a, b, x = np.array([0.5, 2, 30, 200]), np.array([3, 0.7, 40, 150]), np.array([0.1, 0.6, 0.45, 0.55])
    assert np.allclose(s.betainc(a, b, x), 1 - s.betainc(b, a, 1 - x), atol=1e-13)
    assert np.allclose(s.chi2_sf([1.0, 3.0, 9.0], 2), np.exp([-0.5, -1.5, -4.5]), rtol=1e-12)
    assert s.normal_quantile(0.975) == pytest.approx(1.959963984540054, abs=1e-9)
    assert s.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-7)
    assert float(s.t_sf(1.5, 1e7)) == pytest.approx(float(s.normal_sf(1.5)), abs=1e-7)
    assert math.isnan(float(s.betainc(-1, 1, 0.5)))
