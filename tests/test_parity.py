"""Kept tensors against those from scratch, for windows shorter than a stream and over saved state."""

import numpy as np
import pytest
from test_catalogue import test_same_rows as same_rows

from flowloom.operators.entropy import BUCKETS, rolling_of_row, width
from flowloom.operators.wavelets import bands_of_rows
from flowloom.plans import parity  # noqa: F401
from flowloom.streaming.incremental import RollingBands


@pytest.mark.parametrize("name", ["tensor_parity", "stream_tensors"])
def test_same(spark, name):
    same_rows(spark, name)


@pytest.mark.parametrize(("wavelet", "level", "span"), [("haar", 4, 256), ("db4", 4, 256), ("sym4", 3, 128), ("haar", 3, 128), ("db4", 1, 64)])
def test_each_window(wavelet, level, span):
    rng = np.random.default_rng(level)
    x = np.round(rng.gamma(1, 3, span * 2 + 37), 2) * (rng.random(span * 2 + 37) > 0.3)
    names = [f"cD{j}" for j in range(1, level + 1)] + [f"cA{level}"]
    cuts = {b: np.quantile(np.abs(rng.normal(0, 4, 500)), np.arange(1, 16) / 16) for b in names}
    rolling = RollingBands(cuts, wavelet, level, span)
    for k, value in enumerate(x):
        if k % 50 == 0:
            rolling = RollingBands(cuts, wavelet, level, span).load(rolling.save())
        rolling.push(value)
        got = rolling.series()
        if k + 1 < span:
            assert got is None
            continue
        want = bands_of_rows(x[None, k + 1 - span : k + 1], wavelet, level, "dwt")
        for b in names:
            h = rolling_of_row(want[b][0], cuts[b], width(b), BUCKETS)
            assert got[b].shape == h.shape
            assert np.abs(got[b] - h).max(initial=0) < 1e-12
