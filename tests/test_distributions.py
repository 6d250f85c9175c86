"""Distribution functions against published table values."""

import pytest

from statloom.functions import dist


@pytest.mark.parametrize(
    ("got", "wanted"),
    [
        (lambda: dist.norm_isf(0.025), 1.959964),
        (lambda: dist.t_isf(0.025, 10), 2.228139),
        (lambda: dist.t_isf(0.05, 1), 6.313752),
        (lambda: dist.t_sf(1.96, 1e6), 0.024998),
        (lambda: dist.chi2_isf(0.05, 1), 3.841459),
        (lambda: dist.chi2_isf(0.01, 10), 23.209251),
        (lambda: dist.f_sf(4.26, 2, 9), 0.0500),
        (lambda: dist.f_sf(2.71, 5, 20), 0.0500),
        (lambda: dist.studentized_range_isf(0.05, 3, 10), 3.877),
        (lambda: dist.studentized_range_isf(0.05, 5, 20), 4.232),
        (lambda: dist.studentized_range_isf(0.05, 4, 1e9), 3.633),
    ],
)
def test_table_values(got, wanted):
    assert got() == pytest.approx(wanted, abs=1e-3)


def test_tails_are_symmetric():
    assert dist.t_p(-2.5, 7) == pytest.approx(dist.t_p(2.5, 7))
    assert dist.t_p(2.5, 7, "greater") + dist.t_p(2.5, 7, "less") == pytest.approx(1)
