"""Queries that hold tensors and probabilities kept bin by bin in a stream's state against those of the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.arithmetic import digits
from flowloom.operators.scratch import folder
from flowloom.plans.catalogue import bands_of, edges_of, query, signals_of
from flowloom.plans.experiments import TENSOR
from flowloom.plans.serving import CLOSED, FILES, disturbed
from flowloom.streaming import bins, incremental

SPAN, LEVEL = 256, 4


def streamed(spark: SparkSession, d: str, wavelets: tuple[str, ...]) -> dict[str, tuple[DataFrame, dict]]:
    """For each wavelet the tensors of the disturbed stream's closed bins, and the edges they were made with.

    Closed bins come in several triggers, so that state goes from one to the next.
    """
    top = folder(spark)
    closed = bins.run_to_table(bins.closed_bins(bins.flow_stream(spark, disturbed(spark, d), FILES)), f"{top}/closed")
    table, parts = f"{top}/ordered", 3
    ends = closed.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).first()
    for k in range(parts):  # a trigger takes the file written next
        low, high = (ends.a + (ends.b - ends.a + 1) * x // parts for x in (k, k + 1))
        closed.where((F.col("bin") >= low) & (F.col("bin") < high)).coalesce(1).write.mode("append").parquet(table)  # one row a bin
    out = {}
    for wavelet in wavelets:
        cuts = incremental.cuts_of(edges_of(bands_of(spark, d, wavelet, LEVEL)))
        again = spark.readStream.schema(closed.schema).option("maxFilesPerTrigger", 1).parquet(table)
        out[wavelet] = bins.run_to_table(incremental.tensors_online(again, cuts, wavelet, LEVEL, SPAN), f"{top}/{wavelet}"), cuts
    return out


@query(f"""WITH {CLOSED}, c AS (SELECT min(t // 600) AS a, max(t // 600) AS b FROM flows WHERE (t // 600 + 1) * 600 <= (SELECT t FROM last) - 1200)
 SELECT wavelet, greatest(b - a + 1 - 255, 0) * 15 AS compared, 0::BIGINT AS only_one_side, true AS tensors_within, true AS p_within FROM c, (VALUES ('haar'), ('db4')) w(wavelet)""")
def tensor_parity(spark, d):
    """Tensors and probabilities after each closed bin against those of all windows of the batch: within 1e-5 and 1e-4."""
    out = None
    for wavelet, (online, cuts) in streamed(spark, d, ("haar", "db4")).items():
        last = online.agg(F.max("bin").alias("last"))  # one row
        batch = incremental.tensors_of_batch(signals_of(spark, d), cuts, wavelet, LEVEL, SPAN).crossJoin(F.broadcast(last)).where("bin <= last")
        keys = ["bin", "channel", "band"]
        both = online.select(*keys, F.col("values").alias("x"), F.col("p").alias("px")).join(batch.select(*keys, F.col("values").alias("y"), F.col("p").alias("py")), keys, "full")
        far = F.array_max(F.zip_with("x", "y", lambda a, b: F.abs(a.cast("float") - b.cast("float"))))
        one = both.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("compared"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("only_one_side"), F.coalesce(F.max(far) <= 1e-5, F.lit(True)).alias("tensors_within"), F.coalesce(F.max(F.abs(F.col("px") - F.col("py"))) <= 1e-4, F.lit(True)).alias("p_within"))
        one = one.select(F.lit(wavelet).alias("wavelet"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {TENSOR}, {CLOSED}, c AS (SELECT max(t // 600) AS b FROM flows WHERE (t // 600 + 1) * 600 <= (SELECT t FROM last) - 1200) SELECT window_id, channel, band, t, v FROM tensor, c WHERE window_id * 256 + 255 <= b")
def stream_tensors(spark, d):
    """The kept tensors at the ends of tumbling windows: those of the batch's windows that are closed."""
    online, _ = streamed(spark, d, ("haar",))["haar"]
    ends = online.where(F.col("bin") % SPAN == SPAN - 1)
    cells = ends.select(F.floor(F.col("bin") / SPAN).alias("window_id"), "channel", "band", F.posexplode("values").alias("t", "v"))
    return cells.withColumns({"t": F.col("t").cast("long"), "v": digits(F.col("v"), 8) + 0})
