"""Queries of the serving path: requests to answers, tiers, streams with state, counters and parity with the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import contract
from flowloom.functions.arithmetic import digits, ratio
from flowloom.operators import windows
from flowloom.operators.scratch import folder
from flowloom.operators.timeline import frame, own, with_halo
from flowloom.plans.catalogue import BINS, CHUNK, FLOWS, query, read, requests


def answers(raw: DataFrame, column: str = "request") -> DataFrame:
    """status and body (JSON) for each request: 200 with the response, or 422 with what is wrong. Rejected ones get no verdict."""
    checked = contract.validated(raw, column)
    flow = F.col("parsed.flow_id")
    verdict = contract.stub_verdict(flow)
    good = F.to_json(F.struct(flow.alias("flow_id"), verdict.alias("verdict"), contract.confidence(verdict).alias("confidence"), F.lit(contract.VERSION).alias("model_version"), F.lit(1.5).alias("latency_ms")))
    bad = F.to_json(F.struct(F.col("error").alias("detail")))
    return checked.select(*[c for c in raw.columns if c != column], F.when(F.col("valid"), 200).otherwise(422).alias("status"), F.when(F.col("valid"), good).otherwise(bad).alias("body"))


@query(f"""WITH r AS (SELECT event_id AS row_id, 'flow-' || event_id AS flow_id, (6 * ({CHUNK.format(1)} + {CHUNK.format(9)} + {CHUNK.format(17)}) + {CHUNK.format(25)}) % 10 AS r, event_id % 11 AS k FROM events),
 v AS (SELECT *, CASE WHEN r < 8 THEN 'benign' WHEN r = 8 THEN 'suspicious' ELSE 'malicious' END AS verdict FROM r)
 SELECT row_id, CASE WHEN k < 6 THEN 200 ELSE 422 END AS status, CASE WHEN k < 6 THEN '{{"flow_id":"' || flow_id || '","verdict":"' || verdict || '","confidence":' || CASE WHEN r = 8 THEN '0.5' ELSE '0.95' END || ',"model_version":"{contract.VERSION}","latency_ms":1.5}}'
 ELSE '{{"detail":"' || CASE k WHEN 6 THEN 'flow_id' WHEN 7 THEN 'duration_ms' WHEN 8 THEN 'protocol' WHEN 9 THEN 'timestamp' ELSE 'tier' END || '"}}' END AS body FROM v""")
def contract_answers(spark, d):
    """Request JSON to answer JSON in one operator."""
    return answers(requests(read(spark, d)))


def closed_shares(spark: SparkSession, d: str, span: int = 32) -> DataFrame:
    """(bin, full, p): the share of attacks in the ``span`` bins up to each, and whether there are as many."""
    spine = windows.dense(windows.bins(read(spark, d)))
    w = frame("bin").rowsBetween(1 - span, 0)
    sums = own(with_halo(spine, "bin", span - 1).withColumns({"n": F.sum("n_flows").over(w), "bad": F.sum("n_attack").over(w), "full": F.count("*").over(w) == span}))
    return sums.select("bin", "full", ratio(F.col("bad"), F.col("n")).alias("p"))


def said(p, full):
    """Verdict and confidence; before a whole window is closed: benign, 0."""
    verdict = F.when(~full, "benign").when(p >= 0.7, "malicious").when(p >= 0.3, "suspicious").otherwise("benign")
    return verdict, F.when(~full, 0.0).when(verdict == "benign", 1 - p).otherwise(p)


WINDOWED = f"{BINS}, shares AS (SELECT bin, count(*) OVER w = 32 AS whole, CASE WHEN sum(n_flows) OVER w = 0 THEN 0.0 ELSE CAST(sum(n_attack) OVER w AS DOUBLE) / sum(n_flows) OVER w END AS p FROM dense WINDOW w AS (ORDER BY bin ROWS 31 PRECEDING))"
SAID = "CASE WHEN NOT whole THEN 'benign' WHEN p >= 0.7 THEN 'malicious' WHEN p >= 0.3 THEN 'suspicious' ELSE 'benign' END AS verdict, round(CASE WHEN NOT whole THEN 0.0 WHEN p >= 0.3 THEN p ELSE 1 - p END, 9) AS confidence"


@query(f"WITH {WINDOWED}, asked AS (SELECT row_id, t // 600 - 3 AS bin FROM flows), j AS (SELECT row_id, coalesce(whole, false) AS whole, coalesce(p, 0.0) AS p FROM asked LEFT JOIN shares USING (bin)) SELECT row_id, {SAID} FROM j")
def tier_fast(spark, d):
    """Each request gets the verdict of the last closed window: of the bin before the two that may still change."""
    shares = closed_shares(spark, d)
    asked = read(spark, d).select("row_id", (windows.bin_of(F.col("event_ts")) - 3).alias("bin"))
    j = asked.join(shares, "bin", "left").select("row_id", F.coalesce("full", F.lit(False)).alias("full"), F.coalesce("p", F.lit(0.0)).alias("p"))
    verdict, confidence = said(F.col("p"), F.col("full"))
    return j.select("row_id", verdict.alias("verdict"), digits(confidence).alias("confidence"))


@query(f"WITH {WINDOWED}, mean AS (SELECT bin, whole, avg(p) OVER (ORDER BY bin ROWS 3 PRECEDING) AS p FROM shares), asked AS (SELECT row_id, t // 600 - 1 AS bin FROM flows), j AS (SELECT row_id, coalesce(whole, false) AS whole, coalesce(p, 0.0) AS p FROM asked LEFT JOIN mean USING (bin)) SELECT row_id, {SAID} FROM j")
def tier_deep(spark, d):
    """Deep requests: windows rebuilt up to the freshest bin, averaged over four offsets."""
    shares = closed_shares(spark, d)
    mean = own(with_halo(shares, "bin", 3).withColumn("mean", F.avg("p").over(frame("bin").rowsBetween(-3, 0))))
    asked = read(spark, d).select("row_id", (windows.bin_of(F.col("event_ts")) - 1).alias("bin"))
    j = asked.join(mean, "bin", "left").select("row_id", F.coalesce("full", F.lit(False)).alias("full"), F.coalesce("mean", F.lit(0.0)).alias("p"))
    verdict, confidence = said(F.col("p"), F.col("full"))
    return j.select("row_id", verdict.alias("verdict"), digits(confidence).alias("confidence"))


#: Files that a trigger reads.
FILES = 4


def disturbed(spark: SparkSession, d: str) -> str:
    """The events as files of four triggers: shuffled within each, every ninth flow repeated in its file, and in the last
    trigger copies of the first one's flows under new ids, which come too late.
    """
    e = spark.read.parquet(f"{d}/events.parquet")
    a, b = e.agg(F.min("ts"), F.max("ts")).first()
    cuts = [a + (b - a) * k / 4 for k in range(5)]
    path = f"{folder(spark)}/in"
    for k in range(4):
        own_ = e.where((F.col("ts") >= F.lit(cuts[k])) & ((F.col("ts") < F.lit(cuts[k + 1])) | F.lit(k == 3)))
        rows = own_.unionByName(own_.where("event_id % 9 = 0"))
        if k == 3:
            rows = rows.unionByName(e.where((F.col("ts") < F.lit(cuts[1])) & (F.col("event_id") % 5 == 0)).withColumn("event_id", F.col("event_id") + 10**9))
        rows.repartition(FILES).write.mode("append").parquet(path)
    return path


CLOSED = f"{FLOWS}, last AS (SELECT max(t) AS t FROM flows)"


@query(f"WITH {CLOSED} SELECT protocol AS stream_id, t // 600 AS bin, count(*) AS n_flows, CAST(sum(byte_count) AS BIGINT) AS sum_bytes, CAST(sum(packet_count) AS BIGINT) AS sum_packets, count(*) FILTER (WHERE label_binary) AS n_attack FROM flows WHERE (t // 600 + 1) * 600 <= (SELECT t FROM last) - 1200 GROUP BY 1, 2")
def stream_bins_disturbed(spark, d):
    """Closed bins of three streams over four triggers: out of order, with repeated flows, and with flows that come too late."""
    from flowloom.streaming import bins

    flows = bins.flow_stream(spark, disturbed(spark, d), FILES).withColumn("stream_id", F.col("protocol"))
    return bins.run_to_table(bins.closed_bins(flows), f"{folder(spark)}/run").drop("closed_at")


@query("WITH e AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM events) SELECT count(*) AS dropped FROM events, e WHERE epoch_us(ts) < a + (b - a) / 4.0::DOUBLE AND event_id % 5 = 0")
def stream_late_counter(spark, d):
    """The flows of the disturbed stream that came too late, as the stream itself counts them."""
    from flowloom.streaming import bins

    closed = bins.closed_bins(bins.flow_stream(spark, disturbed(spark, d), FILES))
    return bins.late_rows(closed, f"{folder(spark)}/run").agg(F.sum("dropped").alias("dropped"))


@query(f"""WITH {CLOSED}, b AS (SELECT protocol AS stream_id, t // 600 AS bin, count(*) AS n, count(*) FILTER (WHERE label_binary) AS bad FROM flows WHERE (t // 600 + 1) * 600 <= (SELECT t FROM last) - 1200 GROUP BY 1, 2),
 w AS (SELECT stream_id, bin, bin - min(bin) OVER (PARTITION BY stream_id) >= 31 AS whole, CAST(sum(bad) OVER x AS DOUBLE) / sum(n) OVER x AS p FROM b WINDOW x AS (PARTITION BY stream_id ORDER BY bin RANGE BETWEEN 31 PRECEDING AND CURRENT ROW))
 SELECT stream_id, bin, CASE WHEN NOT whole THEN 'benign' WHEN p >= 0.7 THEN 'malicious' WHEN p >= 0.3 THEN 'suspicious' ELSE 'benign' END AS verdict, round(CASE WHEN NOT whole THEN 0.0 ELSE greatest(p, 1 - p) END, 9) AS confidence FROM w""")
def stream_verdicts(spark, d):
    """A verdict for each closed bin of each stream, from the state of its last 32 bins; idle bins count as zeros."""
    from flowloom.streaming import bins

    top = folder(spark)
    flows = bins.flow_stream(spark, disturbed(spark, d), FILES).withColumn("stream_id", F.col("protocol"))
    closed = bins.run_to_table(bins.closed_bins(flows), f"{top}/closed")
    again = spark.readStream.schema(closed.schema).option("maxFilesPerTrigger", 100_000).parquet(f"{top}/closed/out")
    out = bins.run_to_table(bins.verdicts(again), f"{top}/verdicts")
    return out.select("stream_id", "bin", "verdict", digits(F.col("confidence")).alias("confidence"))


@query(f"WITH {CLOSED}, c AS (SELECT t // 600 AS bin, count(*) AS n FROM flows WHERE (t // 600 + 1) * 600 <= (SELECT t FROM last) - 1200 GROUP BY 1) SELECT count(*) AS compared, CAST(0 AS BIGINT) AS only_one_side, CAST(0 AS BIGINT) AS largest_difference FROM c")
def stream_batch_parity(spark, d):
    """Closed bins of the disturbed streams, added up, against the batch's bins: how far they differ."""
    from flowloom.streaming import bins

    flows = bins.flow_stream(spark, disturbed(spark, d), FILES)
    online = bins.run_to_table(bins.closed_bins(flows), f"{folder(spark)}/run").select("bin", *[F.col(c).alias(f"on_{c}") for c in ("n_flows", "sum_bytes", "sum_packets")])
    batch = windows.bins(read(spark, d))
    last = read(spark, d).agg(F.unix_timestamp(F.to_timestamp(F.max("event_ts"))).alias("t"))
    batch = batch.crossJoin(F.broadcast(last)).where((F.col("bin") + 1) * 600 <= F.col("t") - 1200)
    both = batch.join(online, "bin", "full")
    far = F.greatest(*[F.abs(F.col(c) - F.col(f"on_{c}")) for c in ("n_flows", "sum_bytes", "sum_packets")])
    return both.agg(F.count_if(F.col("n_flows").isNotNull() & F.col("on_n_flows").isNotNull()).alias("compared"), F.count_if(F.col("n_flows").isNull() | F.col("on_n_flows").isNull()).alias("only_one_side"), F.max(far).cast("long").alias("largest_difference"))


@query("SELECT CASE event_id % 11 WHEN 6 THEN 'flow_id' WHEN 7 THEN 'duration_ms' WHEN 8 THEN 'protocol' WHEN 9 THEN 'timestamp' WHEN 10 THEN 'tier' ELSE 'accepted' END AS counter, count(*) AS n FROM events GROUP BY 1")
def stream_counters(spark, d):
    """Accepted and rejected requests of a stream by reason, added up over its triggers; rejected ones go no further."""
    from flowloom.streaming import bins

    top = folder(spark)
    requests(read(spark, d)).repartition(3).write.json(f"{top}/in")
    stream = spark.readStream.schema("row_id long, request string").option("maxFilesPerTrigger", 1).json(f"{top}/in")
    bins.count_by_trigger(contract.validated(stream).select(F.coalesce("error", F.lit("accepted")).alias("counter")), "counter", top)
    return spark.read.parquet(f"{top}/counters").groupBy("counter").agg(F.sum("n").alias("n"))


@query(f"WITH {BINS} SELECT * FROM bins")
def csv_replay(spark, d):
    """The flows as CSV files, replayed as a stream of one file a trigger into running sums; the last state of each bin."""
    from flowloom.streaming import bins

    top = folder(spark)
    f = read(spark, d).select("row_id", F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_ts"), "byte_count", "packet_count", "label_binary")
    f.repartition(4).write.option("header", True).csv(f"{top}/in")
    stream = spark.readStream.schema("row_id long, event_ts timestamp_ntz, byte_count long, packet_count long, label_binary boolean").option("header", True).option("maxFilesPerTrigger", 1).csv(f"{top}/in")
    bins.upsert_bins(stream, top)
    return spark.read.parquet(f"{top}/sums").groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("n_flows", "sum_bytes", "sum_packets", "n_attack")])
