"""Work along one time axis without one task for all of it: chunks of bins with a halo from the chunk before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def with_halo(df: DataFrame, key: str, before: int, chunk: int = CHUNK) -> DataFrame:
    """Adds __chunk and __own: each row goes to its chunk, and to later ones that look back at it over ``before`` keys."""
    first, last = F.floor(F.col(key) / chunk), F.floor((F.col(key) + before) / chunk)
    return df.withColumn("__chunk", F.explode(F.sequence(first, last))).withColumn("__own", F.col("__chunk") == F.floor(F.col(key) / chunk))


def own(df: DataFrame) -> DataFrame:
    return df.where("__own").drop("__chunk", "__own")


def frame(key: str) -> Window:
    """A chunk's window in order of the key."""
    return Window.partitionBy("__chunk").orderBy(key)


def running_total(df: DataFrame, key: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to each key: sums within chunks, plus the sums of the chunks before."""
    cut = df.withColumn("__chunk", F.floor(F.col(key) / chunk)).withColumn("__value", value)
    sums = cut.groupBy("__chunk").agg(F.sum("__value").alias("__sum"))
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row for each chunk
    base = sums.select("__chunk", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = cut.withColumn("__inside", F.sum("__value").over(frame(key)))
    return inside.join(base, "__chunk").withColumn(name, F.col("__base") + F.col("__inside")).drop("__chunk", "__value", "__inside", "__base")


def ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """df with __range: numbers of even parts of its rows that follow the order, found by Spark's range partitioning.

    Written once, since parts must be the same for all steps that use them; a time with very many rows is parted too where
    the order tells its rows apart.
    """
    from flowloom.operators.scratch import folder

    spark = df.sparkSession
    cut = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id().cast("long"))
    path = f"{folder(spark)}/ranges"
    cut.write.parquet(path)
    return spark.read.schema(cut.schema).parquet(path)


def spread(segs: DataFrame, first: str, last: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """Each row of segs once for each whole number from ``first`` to ``last``, as ``name``; grown in parallel chunks."""
    starts = segs.withColumn("__s", F.explode(F.expr(f"sequence({first}, {last}, {chunk}L)"))).repartition("__s")
    return starts.withColumn(name, F.explode(F.sequence("__s", F.least(F.col("__s") + (chunk - 1), F.col(last))))).drop("__s")


def carried(chunks: DataFrame, by: list[str], value: str, name: str, many: int = CHUNK) -> DataFrame:
    """Adds the ``value`` of the chunk before each (column chunk; by groups), however far back that is; null for the first.

    Chunks are compared within stretches of ``many`` numbers; only one row of each stretch meets the others.
    """
    cut = chunks.withColumn("__stretch", F.floor(F.col("chunk") / many))
    ends = cut.groupBy(*by, "__stretch").agg(F.max_by(F.struct(value), "chunk").alias("__end"))
    before = ends.select(*by, "__stretch", F.lag("__end").over(Window.partitionBy(*by).orderBy("__stretch")).alias("__before"))
    inside = Window.partitionBy(*by, "__stretch").orderBy("chunk")
    first = F.row_number().over(inside) == 1
    return cut.join(before, [*by, "__stretch"]).withColumn(name, F.when(first, F.col("__before")[value]).otherwise(F.lag(value).over(inside))).drop("__stretch", "__before")


def running_max(df: DataFrame, order: list[str], chunk: Column, value: Column, name: str) -> DataFrame:
    """Adds the greatest ``value`` of all rows before each, in an order that ``chunk`` follows: of its chunk and those before."""
    cut = df.withColumn("__chunk", chunk).withColumn("__value", value)
    most = cut.groupBy("__chunk").agg(F.max("__value").alias("__most"))
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)  # one row for each chunk
    base = most.select("__chunk", F.max("__most").over(before).alias("__base"))
    inside = F.max("__value").over(Window.partitionBy("__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return cut.join(base, "__chunk").withColumn(name, F.greatest("__base", inside)).drop("__chunk", "__value", "__base")
