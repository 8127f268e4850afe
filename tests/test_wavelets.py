import numpy as np
import pytest

from flowloom.operators import wavelets


@pytest.mark.parametrize("name", sorted(wavelets.FILTERS))
def test_energy_and_reconstruction(spark, name):
    x = np.sin(np.arange(64) / 3.0).tolist()
    df = spark.createDataFrame([(x,)], "x array<double>")
    row = wavelets.reconstruct(wavelets.decompose(df, "x", 64, name, 3), 64, name, 3).first()
    assert np.allclose(row.rebuilt, x, atol=1e-8)
    assert np.isclose(sum(v * v for b in row.bands.values() for v in b), sum(v * v for v in x))


def test_level_guard():
    with pytest.raises(ValueError):
        wavelets.check(100, 3, "db4")
