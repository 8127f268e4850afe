"""Values carried over chunks and stretches, segments spread over chunks, ranges of one time."""

from pyspark.sql import functions as F

from flowloom.operators import audit, timeline


def test_carried_over_stretches(spark):
    rows = [("a", 0, 5), ("a", 1, None), ("a", 7, 8), ("a", 100, 9), ("b", 50, 1)]
    got = timeline.carried(spark.createDataFrame(rows, "k string, chunk long, last long"), ["k"], "last", "before", many=4)
    assert sorted((r.k, r.chunk, r.before) for r in got.collect()) == [("a", 0, None), ("a", 1, 5), ("a", 7, None), ("a", 100, 8), ("b", 50, None)]
    alone = timeline.carried(spark.createDataFrame([(3, 1), (9, 2)], "chunk long, last long"), [], "last", "before", many=4)
    assert sorted((r.chunk, r.before) for r in alone.collect()) == [(3, None), (9, 1)]


def test_spread(spark):
    got = timeline.spread(spark.createDataFrame([("x", 5, 15), ("y", 7, 7)], "k string, a long, b long"), "a", "b", "n", chunk=4)
    assert sorted((r.k, r.n) for r in got.collect()) == [("x", n) for n in range(5, 16)] + [("y", 7)]


def test_places_where_all_have_one_time(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("row_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("event_ts"))
    assert sorted((r.row_id, r.place) for r in audit.position(df).collect()) == [(k, k + 1) for k in range(500)]
