"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.scratch import folder


def exact(df: DataFrame, by: list[str], value: str, shares: list[float], parts: int = 256) -> DataFrame:
    """(by, quantiles): for each group its values at the shares of its range of ranks, interpolated between neighbours.

    Equal values are counted before they meet. Approximate quantiles only cut each group into about ``parts`` parts of like
    size; counts of the parts tell which ones hold the wanted ranks, and only those are put in order, each on its own.
    Null values don't count; a group without others has no row. The counts are written once, as four steps read them.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    path = f"{folder(df.sparkSession)}/counts"
    counted.write.parquet(path)
    each = df.sparkSession.read.schema(counted.schema).parquet(path)
    cuts = each.groupBy(*by).agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 4 * parts).alias("cuts"))
    joined = each.join(cuts, by) if by else each.crossJoin(F.broadcast(cuts))  # a row for each group
    placed = joined.select(*by, "v", "n", F.size(F.filter("cuts", lambda c: c < F.col("v"))).alias("part"))
    sums = placed.groupBy(*by, "part").agg(F.sum("n").alias("held"))
    up = Window.partitionBy(*by).orderBy("part")  # at most ``parts`` rows a group
    spans = sums.select(*by, "part", F.sum("held").over(up).alias("end"), "held", F.sum("held").over(Window.partitionBy(*by)).alias("total")).withColumn("begin", F.col("end") - F.col("held"))
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(q)).alias("q")) for k, q in enumerate(shares)])).alias("s")
    place = F.col("s.q") * (F.col("total") - 1)
    within = lambda rank: (rank >= F.col("begin")) & (rank < F.col("end"))
    asked = spans.select(*by, "part", "begin", "end", "total", at).withColumn("place", place).where(within(F.floor("place")) | within(F.ceil("place")))
    asked = asked.select(*by, "part", "begin", F.col("s.k").alias("k"), "place")
    needed = asked.select(*by, "part", "begin").distinct()
    run = Window.partitionBy(*by, "part").orderBy("v")
    ranked = placed.join(needed, [*by, "part"]).withColumn("upto", F.col("begin") + F.sum("n").over(run)).withColumn("from", F.col("upto") - F.col("n")).drop("begin")
    covers = lambda rank: (rank >= F.col("from")) & (rank < F.col("upto"))
    low, high = F.floor("place"), F.ceil("place")
    hit = ranked.join(asked.drop("begin"), [*by, "part"]).where(covers(low) | covers(high))
    ends = hit.groupBy(*by, "k", "place").agg(F.max(F.when(covers(low), F.col("v"))).alias("a"), F.max(F.when(covers(high), F.col("v"))).alias("b"))
    x = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((high - F.col("place")) * F.col("a") + (F.col("place") - low) * F.col("b"))
    one = ends.select(*by, F.struct("k", x.cast("double").alias("x")).alias("x"))
    return one.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("x")), lambda s: s["x"]).alias("quantiles"))
