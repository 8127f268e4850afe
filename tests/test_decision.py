"""The choice of a transform against plain figures, and the other queries against SQL."""

import hashlib

import numpy as np
import pytest
from test_catalogue import test_same_rows as same_rows

from flowloom.operators import experiments
from flowloom.plans import catalogue, decision

NAMES = [n for n, f in catalogue.QUERIES.items() if f.__module__ == decision.__name__ and n in catalogue.ORACLES]


@pytest.mark.parametrize("name", NAMES)
def test_same(spark, name):
    same_rows(spark, name)


def plain_f1(rows, weight=lambda w: 1):
    n = {k: sum(weight(r[2]) for r in rows if (r[3], r[4]) == k) for k in ((1, 1), (0, 1), (1, 0), (0, 0))}
    half = lambda a: 2 * a / d if (d := 2 * a + n[0, 1] + n[1, 0]) else 0.0
    return (half(n[1, 1]) + half(n[0, 0])) / 2


def test_decision(spark):
    rng = np.random.default_rng(1)
    rows = []
    for kind, right, flips in (("dwt", 0.8, 0.3), ("swt", 0.8, 0.05)):
        for seed in (1, 2, 3):
            for w in range(90):
                y = bool(w % 3)
                hit = bool(y) if rng.random() < right else not y
                rows.append((kind, seed, w, y, hit, None if w == 5 else bool(hit != (rng.random() < flips))))
    df = spark.createDataFrame(rows, "transform string, seed int, window_id long, y boolean, hit boolean, shifted boolean")
    got = {r.transform: r for r in experiments.transform_runs(df).collect()}
    figures = {}
    for kind in ("dwt", "swt"):
        mine = [r for r in rows if r[0] == kind]
        each = [plain_f1([r for r in mine if r[1] == s]) for s in (1, 2, 3)]
        u = lambda r, b: int(hashlib.md5(f"{r}:{b}".encode()).hexdigest()[:8], 16) / 2**32
        f = [plain_f1(mine, lambda w: sum(u(r, w // 8) >= t for t in experiments.POISSON)) for r in range(200)]
        flip = np.mean([r[4] != r[5] for r in mine if r[5] is not None])
        figures[kind] = {"macro_f1": np.mean(each), "low": np.quantile(f, 0.025), "high": np.quantile(f, 0.975), "flip_rate": flip}
        assert got[kind].seeds == 3 and abs(got[kind].sd - np.std(each, ddof=1)) < 1e-9
        for k, v in figures[kind].items():
            assert abs(got[kind][k] - v) < 1e-9
    (row,) = experiments.transform_decision(experiments.transform_runs(df)).collect()
    assert row.stationary == experiments.prefer_stationary(figures["dwt"], figures["swt"])
    assert experiments.transform_decision(experiments.transform_runs(df.where("transform = 'dwt'"))).count() == 0


def test_choice_is_the_same_each_time(spark):
    first, again = (catalogue.QUERIES["transform_choice"](spark, "/root/testdata/sf0.001").collect() for _ in range(2))
    assert first == again and len(first) == 1 and first[0].dwt_seeds == 3
