"""The control-variate queries change their input, and lessen its scatter."""

import numpy as np
import pytest

from halogrid.operators.variates import smooth
from halogrid.queries import QUERIES


@pytest.mark.parametrize(("name", "share"), [("zcv_apply", 0.3), ("lcv_apply", 0.9)])
def test_scatter_falls(spark, name, share):
    rows = sorted(QUERIES[name](spark, "/root/testdata/sf0.001").collect(), key=lambda r: r.k)[1:]
    assert len(rows) >= 21
    for ell in (0, 2, 4):
        before, after = (np.array([r[f"{c}{ell}"] for r in rows]) for c in ("measured", "p"))
        trend = smooth(before, 11)
        assert np.isfinite(after).all() and np.abs(after - before).max() > 0.01 * np.abs(before).max()
        assert np.std(after - trend) < share * np.std(before - trend)
