"""Experiments against SQL; images by plain interpolation; the rule for the transform; trained baselines give a score a window."""

import pytest
from test_catalogue import test_same_rows as same_rows

from flowloom.operators import experiments as ops
from flowloom.plans import catalogue, experiments

NAMES = [n for n in dir(experiments) if n in catalogue.QUERIES and getattr(experiments, n).__module__ == experiments.__name__]


@pytest.mark.parametrize("name", [n for n in NAMES if n in catalogue.ORACLES])
def test_same(spark, name):
    same_rows(spark, name)


@pytest.mark.parametrize("name", [n for n in NAMES if n not in catalogue.ORACLES])
def test_scores(spark, name):
    rows = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(0 <= r.p <= 1 and r.window_id % 4 == 0 for r in rows)


def test_bilinear_image(spark):
    rows = [[0.0, 1.0, 4.0], [2.0, 2.0, 2.0]]
    got = sorted(ops.image_bilinear(spark.createDataFrame([(1, "len", rows)], "window_id long, channel string, rows array<array<double>>"), 5).collect(), key=lambda r: r.r)
    for r in got:
        for c, v in enumerate(r.row):
            x, y = c * 2 / 4, r.r / 4
            k = min(1, int(x))
            top, low = (row[k] + (row[k + 1] - row[k]) * (x - k) for row in rows)
            assert abs(v - (top + (low - top) * y)) < 1e-12


def test_rule_for_the_stationary_transform():
    run = lambda f, half, flip: {"macro_f1": f, "low": f - half, "high": f + half, "flip_rate": flip}
    assert ops.prefer_stationary(run(0.9, 0.002, 0.1), run(0.91, 0.002, 0.1))
    assert not ops.prefer_stationary(run(0.9, 0.02, 0.1), run(0.91, 0.02, 0.1))
    assert ops.prefer_stationary(run(0.9, 0.02, 0.1), run(0.896, 0.02, 0.05))
    assert not ops.prefer_stationary(run(0.9, 0.02, 0.1), run(0.89, 0.02, 0.01))


def test_exact_quantiles(spark):
    import numpy as np

    from flowloom.operators.quantiles import exact

    rng = np.random.default_rng(2)
    rows = [("a", float(x)) for x in rng.normal(size=3000)] + [("b", 1.0)] * 2000 + [("b", float(x)) for x in rng.integers(0, 3, 500)] + [("c", 5.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.quantiles for r in exact(df, ["g"], "x", [0, 0.1, 0.5, 0.999, 1]).collect()}
    assert set(got) == {"a", "b", "c"}
    for g, q in got.items():
        assert np.allclose(q, np.quantile([x for k, x in rows if k == g], [0, 0.1, 0.5, 0.999, 1]), atol=1e-12)
    assert exact(df.where("g = 'd'"), ["g"], "x", [0.5]).count() == 0
