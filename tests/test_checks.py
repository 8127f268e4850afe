"""Checks against SQL, and their edge cases."""

import math

import pytest
from test_catalogue import test_same_rows as same_rows

from flowloom.operators import audit, metrics
from flowloom.plans import catalogue, checks

NAMES = [n for n, f in catalogue.QUERIES.items() if f.__module__ == checks.__name__]


@pytest.mark.parametrize("name", NAMES)
def test_same(spark, name):
    same_rows(spark, name)


def test_temperature_edges(spark):
    fit = lambda rows: metrics.fit_temperature(spark.createDataFrame(rows, "y boolean, z double")).first()
    assert fit([]).tau == 1.0
    assert 0.01 <= fit([(True, 2.0), (False, -1.0), (True, 3.0)]).tau < 0.05  # no error: it sharpens until the rounds end
    rows = [(True, 4.0)] * 3 + [(False, 4.0)] + [(False, -4.0)] * 3 + [(True, -4.0)] + [(None, 1.0), (True, None)]
    assert math.isclose(fit(rows).tau, 4 / math.log(3), rel_tol=1e-9)  # three in four are right


def test_islands_over_chunks(spark):
    rows = [("a", 0, 5, 1), ("a", 100, 9_000, 2), ("a", 8_000, 8_001, 1), ("a", 9_010, 9_011, 1), ("a", 90_000, 90_001, 1), ("b", 5, 5, 1), ("b", 3_599, 3_600, 1), ("b", 3_605, 3_605, 1)]
    got = audit.merged(spark.createDataFrame(rows, "k string, first_s long, last_s long, n long"), ["k"], 10)
    assert sorted(map(tuple, got.collect())) == [("a", 0, 5, 1), ("a", 100, 9_011, 4), ("a", 90_000, 90_001, 1), ("b", 5, 5, 1), ("b", 3_599, 3_605, 2)]
