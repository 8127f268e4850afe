"""Queries of the service stream over a replay with faults: closed bins and verdicts, answers, dead letters, counters, the fast tier."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import contract
from flowloom.functions.arithmetic import digits
from flowloom.functions.timestamps import epoch_s
from flowloom.operators.scratch import folder
from flowloom.plans.catalogue import FLOWS, query, read, requests
from flowloom.sources.flows import from_events
from flowloom.streaming.service import Rules, Service, answered_from_state

TRIGGERS = 6
RULES = Rules(resets=10)
NEW = 10**9  # ids of replayed flows


def fed(spark: SparkSession, d: str) -> DataFrame:
    """The events as they reach the service, with the trigger that each comes in: one quarter of their time a trigger, with what
    goes wrong on the way. A table in a folder for each trigger.

    Of the last 900 seconds before a quarter's end, every fourth flow comes a trigger later (still in time) and every third comes
    again then; every ninth flow of all comes twice. The fourth trigger has copies of flows of the first quarter under new ids:
    late. Then all starts again: the first quarter, and the second, under new ids.
    """
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("t", epoch_s(F.col("ts")))
    a, b = e.agg(F.min("t"), F.max("t")).first()
    quarter = lambda t: F.floor((t - a) * 4 / (b - a + 1))
    e = e.withColumns({"q": quarter(F.col("t")), "near": (quarter(F.col("t")) < 3) & (quarter(F.col("t") + 900) > quarter(F.col("t")))})
    again = lambda rows, k: rows.withColumn("event_id", F.col("event_id") + k * NEW)
    moved = F.col("near") & (F.col("event_id") % 4 == 0)
    own = e.withColumn("trigger", F.col("q") + moved.cast("int"))
    sent = own.unionByName(own.where("event_id % 9 = 0")).unionByName(own.where("near AND event_id % 3 = 0").withColumn("trigger", F.col("q") + 1))
    first, second = own.where("q = 0"), own.where("q = 1")
    extra = ((first.where("event_id % 5 = 0"), 1, 3), (first, 2, 4), (second, 3, 5))
    for rows, k, trigger in extra:
        sent = sent.unionByName(again(rows, k).withColumn("trigger", F.lit(trigger).cast("long")))
    table = f"{folder(spark)}/fed"
    sent.write.partitionBy("trigger").parquet(table)
    return spark.read.schema(sent.schema).parquet(table)


def sent_in(events: DataFrame, trigger: int) -> DataFrame:
    """The requests of one trigger of ``fed``, dealt evenly over the session's partitions; some are broken."""
    part = events.where(F.col("trigger") == trigger).repartition("event_id")
    return requests(from_events(part)).withColumn("trigger", F.lit(trigger))


def run_through(spark: SparkSession, part: Callable[[int], DataFrame]) -> Service:
    """A service after all triggers, in whose folder ``requests`` is the table that its stream reads.

    Each trigger's requests are written in as many files as they have partitions, and the stream goes on over all files that are
    new: so a trigger is spread over all cores, however much of the input it has.
    """
    service = Service(spark, folder(spark), RULES)
    for k in range(TRIGGERS):
        part(k).write.mode("append").parquet(f"{service.top}/requests")
        service.run(spark.readStream.schema("row_id long, request string, trigger int").parquet(f"{service.top}/requests"))
    return service


def served(spark: SparkSession, d: str, _done: dict[tuple[str, str], str] = {}) -> Service:  # noqa: B006
    """The service after the replay. Its tables serve all queries of a session on the same data; where they are gone, it runs anew."""
    key = spark.sparkContext.applicationId, d
    if key in _done:
        top = spark._jvm.org.apache.hadoop.fs.Path(f"{_done[key]}/state")
        if top.getFileSystem(spark._jsc.hadoopConfiguration()).exists(top):
            return Service(spark, _done[key], RULES)
    events = fed(spark, d)
    service = run_through(spark, lambda k: sent_in(events, k))
    _done[key] = service.top
    return service


FED = f"""{FLOWS}, ends AS (SELECT min(t) AS a, max(t) - min(t) + 1 AS len FROM flows), timed AS (SELECT f.*, (t - a) * 4 // len AS q, (t + 900 - a) * 4 // len > (t - a) * 4 // len AND (t - a) * 4 // len < 3 AS near FROM flows f, ends),
 own AS (SELECT *, q + CASE WHEN near AND row_id % 4 = 0 THEN 1 ELSE 0 END AS trig FROM timed),
 sent AS (SELECT row_id, trig, t, byte_count, packet_count, protocol FROM own UNION ALL SELECT row_id, trig, t, byte_count, packet_count, protocol FROM own WHERE row_id % 9 = 0
  UNION ALL SELECT row_id, q + 1, t, byte_count, packet_count, protocol FROM own WHERE near AND row_id % 3 = 0
  UNION ALL SELECT row_id + {NEW}, 3, t, byte_count, packet_count, protocol FROM own WHERE q = 0 AND row_id % 5 = 0
  UNION ALL SELECT row_id + {2 * NEW}, 4, t, byte_count, packet_count, protocol FROM own WHERE q = 0 UNION ALL SELECT row_id + {3 * NEW}, 5, t, byte_count, packet_count, protocol FROM own WHERE q = 1),
 asked AS (SELECT *, protocol AS stream_id, CASE row_id % 11 WHEN 6 THEN 'flow_id' WHEN 7 THEN 'duration_ms' WHEN 8 THEN 'protocol' WHEN 9 THEN 'timestamp' WHEN 10 THEN 'tier' END AS error FROM sent)"""
STEPS = f"""{FED}, once AS (SELECT row_id, stream_id, t // 600 AS bin, t, byte_count, packet_count, min(trig) AS trig FROM asked WHERE error IS NULL GROUP BY ALL),
 arrived AS (SELECT trig, stream_id, bin, count(*) AS n, CAST(sum(byte_count) AS DOUBLE) AS sum_bytes, CAST(sum(packet_count) AS DOUBLE) AS sum_packets, count(*) FILTER (WHERE packet_count >= 26) AS bad, max(t) AS last FROM once GROUP BY ALL),
 steps AS (SELECT DISTINCT -1::BIGINT AS trig, stream_id, NULL::BIGINT AS clock, 0::BIGINT AS behind, 0::BIGINT AS gen, 0::BIGINT AS late, NULL::BIGINT AS was_done, false AS reset FROM arrived
  UNION ALL
  SELECT trig + 1, stream_id, CASE WHEN restart THEN any_last ELSE greatest(clock, new_last) END, CASE WHEN restart OR n_new > 0 THEN 0 ELSE behind + n_late END, gen + CASE WHEN restart THEN 1 ELSE 0 END, late + CASE WHEN restart THEN 0 ELSE n_late END, clock // 600 - 3, restart
  FROM (SELECT *, n_new = 0 AND n_late > 0 AND behind + n_late >= 10 AS restart FROM (SELECT s.trig, s.stream_id, s.clock, s.behind, s.gen, s.late, coalesce(sum(n) FILTER (WHERE a.bin <= s.clock // 600 - 3), 0)::BIGINT AS n_late,
    coalesce(sum(n) FILTER (WHERE s.clock IS NULL OR a.bin > s.clock // 600 - 3), 0)::BIGINT AS n_new, max(last) AS any_last, max(last) FILTER (WHERE s.clock IS NULL OR a.bin > s.clock // 600 - 3) AS new_last
   FROM steps s LEFT JOIN arrived a ON a.trig = s.trig + 1 AND a.stream_id = s.stream_id WHERE s.trig < 5 GROUP BY ALL))),
 counted AS (SELECT s.stream_id, s.gen, a.bin, sum(n)::BIGINT AS n_flows, sum(sum_bytes) AS sum_bytes, sum(sum_packets) AS sum_packets, sum(bad)::BIGINT AS n_suspect FROM arrived a JOIN steps s ON a.trig = s.trig AND a.stream_id = s.stream_id
  WHERE s.reset OR s.was_done IS NULL OR a.bin > s.was_done GROUP BY ALL),
 spans AS (SELECT c.stream_id, c.gen, min(c.bin) AS first, max(s.done) AS done FROM counted c JOIN (SELECT stream_id, gen, arg_max(clock, trig) // 600 - 3 AS done FROM steps GROUP BY ALL) s USING (stream_id, gen) GROUP BY ALL),
 closed AS (SELECT s.stream_id, s.gen AS generation, s.bin, coalesce(n_flows, 0) AS n_flows, coalesce(sum_bytes, 0) AS sum_bytes, coalesce(sum_packets, 0) AS sum_packets, coalesce(n_suspect, 0) AS n_suspect
  FROM (SELECT stream_id, gen, unnest(range(first, done + 1)) AS bin FROM spans) s LEFT JOIN counted c USING (stream_id, gen, bin)),
 judged AS (SELECT *, CASE WHEN NOT warm THEN 0.0 WHEN sum(n_flows) OVER w = 0 THEN 0.0 ELSE CAST(sum(n_suspect) OVER w AS DOUBLE) / sum(n_flows) OVER w END AS p
  FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, generation ORDER BY bin) >= 32 AS warm FROM closed) WINDOW w AS (PARTITION BY stream_id, generation ORDER BY bin ROWS 31 PRECEDING)),
 verdicts AS (SELECT *, CASE WHEN NOT warm THEN 'benign' WHEN p >= 0.7 THEN 'malicious' WHEN p >= 0.3 THEN 'suspicious' ELSE 'benign' END AS verdict, CASE WHEN NOT warm THEN 0.0 WHEN p >= 0.3 THEN p ELSE 1 - p END AS confidence FROM judged),
 cache AS (SELECT s.trig, s.stream_id, v.verdict, v.confidence FROM steps s JOIN verdicts v ON v.stream_id = s.stream_id AND v.generation = s.gen AND v.bin = s.clock // 600 - 3)"""


@query(f"WITH RECURSIVE {STEPS} SELECT stream_id, generation, bin, n_flows, sum_bytes, sum_packets, n_suspect, warm, round(p, 9) AS p, verdict, round(confidence, 9) AS confidence FROM verdicts")
def serve_closed_bins(spark, d):
    """Each closed bin of each stream, idle ones too, with its window's verdict; streams start anew when all is replayed."""
    rows = served(spark, d).table("closed")
    return rows.withColumns({c: digits(F.col(c)) for c in ("p", "confidence")})


@query(f"WITH RECURSIVE {STEPS} SELECT a.row_id, CASE WHEN error IS NULL THEN 200 ELSE 422 END AS status, error, CASE WHEN error IS NULL THEN coalesce(verdict, 'benign') END AS verdict, CASE WHEN error IS NULL THEN round(coalesce(confidence, 0), 9) END AS confidence FROM asked a LEFT JOIN cache c ON c.trig = a.trig - 1 AND c.stream_id = a.stream_id")
def serve_answers(spark, d):
    """The answer to each request, repeated, late and broken ones too, from the state before its trigger."""
    return served(spark, d).table("answers").select("row_id", "status", "error", "verdict", digits(F.col("confidence")).alias("confidence"))


@query(f"WITH {FED} SELECT row_id, error, trig AS trigger FROM asked WHERE error IS NOT NULL")
def serve_dead_letters(spark, d):
    """The rejected requests as the sink keeps them, each once for each time it came."""
    return spark.read.parquet(f"{served(spark, d).top}/dead").select("row_id", "error", F.col("trigger").cast("long").alias("trigger"))


@query(f"""WITH RECURSIVE {STEPS} SELECT 'rejected_' || error AS counter, count(*) AS n FROM asked WHERE error IS NOT NULL GROUP BY 1 UNION ALL SELECT 'valid', count(*) FROM asked WHERE error IS NULL UNION ALL SELECT 'first_seen', count(*) FROM once
 UNION ALL SELECT 'warm_up', count(*) FROM verdicts WHERE NOT warm UNION ALL SELECT 'late', sum(late)::BIGINT FROM steps WHERE trig = 5 UNION ALL SELECT 'resets', sum(gen)::BIGINT FROM steps WHERE trig = 5""")
def serve_counters(spark, d):
    """Valid, first seen, rejected by reason, late and warm-up counts, and restarts."""
    return served(spark, d).counters()


@query(f"WITH RECURSIVE {STEPS} SELECT f.row_id, coalesce(verdict, 'benign') AS verdict, round(coalesce(confidence, 0), 9) AS confidence FROM flows f LEFT JOIN cache c ON c.trig = 5 AND c.stream_id = f.protocol WHERE f.row_id % 11 < 6")
def serve_fast_tier(spark, d):
    """Requests after the replay, answered from the kept state of their stream alone."""
    state = served(spark, d).table("state")
    return answered_from_state(requests(read(spark, d)), state).select("row_id", "verdict", digits(F.col("confidence")).alias("confidence"))


@query(f"WITH RECURSIVE {STEPS}, clean AS (SELECT count(*) AS n FROM verdicts) SELECT n AS compared, 0::BIGINT AS only_one_side, 0::BIGINT AS different FROM clean")
def serve_without_malformed(spark, d):
    """Closed bins of the replay against those of one without its malformed requests: how many differ."""
    service = served(spark, d)
    whole, sent = service.table("closed"), spark.read.parquet(f"{service.top}/requests")
    valid = lambda k: contract.validated(sent.where(F.col("trigger") == k)).where("valid").select("row_id", "request", "trigger")
    clean = run_through(spark, valid).table("closed")
    keys, sums = ["stream_id", "generation", "bin"], [c for c in whole.columns if c not in ("stream_id", "generation", "bin")]
    both = whole.withColumn("x", F.struct(*sums)).select(*keys, "x").join(clean.withColumn("y", F.struct(*sums)).select(*keys, "y"), keys, "full")
    return both.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("compared"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("only_one_side"), F.count_if(F.col("x") != F.col("y")).alias("different"))
