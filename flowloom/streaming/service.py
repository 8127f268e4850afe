"""The serving path as one stream: requests in, answers out, with window state, counters and dead letters.

Each trigger is one ordinary Spark job over its requests and the tables that the trigger before wrote; it writes its own to
``<name>/trigger=<number>``, so a repeated trigger replaces what it wrote and lost executors cost no state. Flows are summed by
stream and bin before they meet the state of their stream: a stream with most of the flows is spread like any other.

Event time is each stream's own. A bin is closed once the stream's clock (its latest flow up to the trigger before) has passed
its end by ``lateness`` bins. Flows of closed bins are late: not counted, answered from the state, and counted apart. If
``resets`` late flows come in a row, the stream starts anew, with the flows of that trigger (a replay from the beginning).
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.functions import contract
from flowloom.functions.arithmetic import ratio
from flowloom.functions.timestamps import epoch_s
from flowloom.operators.windows import DELTA, SPAN

SUMS = ("n_flows", "sum_bytes", "sum_packets", "n_suspect")
BIN = "stream_id string, bin long, n_flows long, sum_bytes double, sum_packets double, n_suspect long"
KEPT = {
    "state": "stream_id string, generation long, clock long, behind long, late long, first_seen long, first_bin long, next_bin long, verdict string, confidence double",
    "live": BIN,
    "recent": BIN,
    "seen": "flow_id string, stream_id string, bin long",
}
CHUNK = 4096


@dataclasses.dataclass(frozen=True)
class Rules:
    """What the service does with its flows; see the module."""

    delta: int = DELTA
    span: int = SPAN
    lateness: int = 2
    resets: int = 100
    low: float = 0.3
    high: float = 0.7
    #: The packets from which a flow counts as suspect: the stand-in for a trained model behind the same contract.
    packets: int = 26

    def score(self, sums: dict[str, Column]) -> Column:
        """The probability of an attack by a window's sums. Other scorers override this."""
        return ratio(sums["n_suspect"], sums["n_flows"])

    def closed(self, clock: Column) -> Column:
        """The last bin that a clock has closed; null without a clock."""
        return F.floor(clock / self.delta) - self.lateness - 1

    def said(self, p: Column, warm: Column) -> tuple[Column, Column]:
        """Verdict and confidence; before a whole window is closed: benign, 0."""
        verdict = F.when(~warm, "benign").when(p >= self.high, "malicious").when(p >= self.low, "suspicious").otherwise("benign")
        return verdict, F.when(~warm, 0.0).when(verdict == "benign", 1 - p).otherwise(p)


def flows_of(checked: DataFrame, rules: Rules) -> DataFrame:
    """The flows of valid requests (columns of ``contract.validated``), by stream and bin. A flow's protocol names its stream."""
    r = F.col("parsed")
    t = epoch_s(F.try_to_timestamp(r["timestamp"]).cast("timestamp_ntz"))
    f = r["features"]
    return checked.where("valid").select(r["flow_id"].alias("flow_id"), f["protocol"].alias("stream_id"), t.alias("t"), F.floor(t / rules.delta).alias("bin"), f["byte_count"].alias("bytes"), f["packet_count"].alias("packets"))


def summed(flows: DataFrame, rules: Rules) -> DataFrame:
    """Sums and the latest time of each stream's bins."""
    return flows.groupBy("stream_id", "bin").agg(F.count("*").alias("n_flows"), F.sum("bytes").alias("sum_bytes"), F.sum("packets").alias("sum_packets"), F.count_if(F.col("packets") >= rules.packets).alias("n_suspect"), F.max("t").alias("last"))


def advanced(state: DataFrame, arrived: DataFrame, rules: Rules) -> DataFrame:
    """Each stream's state after a trigger, but for what closing bins changes; adds done (the last closed bin) and reset."""
    done = rules.closed(F.col("clock"))
    late = F.coalesce(F.col("bin") <= done, F.lit(False))
    met = arrived.join(state.select("stream_id", "clock"), "stream_id", "left")
    n = met.groupBy("stream_id").agg(F.sum(F.when(late, F.col("n_flows")).otherwise(0)).alias("n_late"), F.sum(F.when(late, 0).otherwise(F.col("n_flows"))).alias("n_new"), F.max("last").alias("any_last"), F.max(F.when(~late, F.col("last"))).alias("new_last"))
    j = state.join(n, "stream_id", "full").select("stream_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("generation", "behind", "late", "first_seen", "n_late", "n_new")), "clock", "any_last", "new_last", "first_bin", "next_bin", "verdict", "confidence")
    behind = F.when(F.col("n_new") > 0, 0).otherwise(F.col("behind") + F.col("n_late"))
    j = j.withColumn("behind", behind).withColumn("reset", (F.col("n_late") > 0) & (F.col("behind") >= rules.resets))
    fresh = lambda c, otherwise: F.when(F.col("reset"), None).otherwise(otherwise).alias(c)
    out = j.select(
        "stream_id",
        (F.col("generation") + F.col("reset").cast("long")).alias("generation"),
        F.when(F.col("reset"), F.col("any_last")).otherwise(F.greatest("clock", "new_last")).alias("clock"),
        F.when(F.col("reset"), 0).otherwise(F.col("behind")).cast("long").alias("behind"),
        (F.col("late") + F.when(F.col("reset"), 0).otherwise(F.col("n_late"))).cast("long").alias("late"),
        (F.col("first_seen") + F.col("n_late") + F.col("n_new")).cast("long").alias("first_seen"),
        *(fresh(c, F.col(c)) for c in ("first_bin", "next_bin", "verdict", "confidence")),
        "reset",
        done.alias("was_done"),
    )
    return out.withColumn("done", rules.closed(F.col("clock")))


def spine(streams: DataFrame) -> DataFrame:
    """(stream_id, bin): all bins from ``start`` to ``done``, grown in parallel chunks."""
    starts = streams.where("start <= done").select("stream_id", "done", F.explode(F.expr(f"sequence(start, done, {CHUNK}L)")).alias("s")).repartition("stream_id", "s")
    return starts.select("stream_id", F.explode(F.sequence("s", F.least(F.col("s") + (CHUNK - 1), F.col("done")))).alias("bin"))


def judged(bins: DataFrame, first: DataFrame, rules: Rules) -> DataFrame:
    """Adds warm (a whole window is closed), p, verdict and confidence to a stream's bins without gaps.

    Windows look back over chunks with a halo, so that a long catch-up isn't one task. first: (stream_id, first_bin, ...).
    """
    chunk = F.floor(F.col("bin") / CHUNK)
    cut = bins.withColumn("__chunk", F.explode(F.sequence(chunk, F.floor((F.col("bin") + rules.span - 1) / CHUNK))))
    w = Window.partitionBy("stream_id", "__chunk").orderBy("bin").rowsBetween(1 - rules.span, 0)
    summed_up = cut.select("stream_id", "bin", "__chunk", *SUMS, *(F.sum(c).over(w).alias(f"w_{c}") for c in SUMS)).where(F.col("__chunk") == chunk).drop("__chunk")
    j = summed_up.join(first, "stream_id")
    warm = F.col("bin") - F.col("first_bin") + 1 >= rules.span
    j = j.withColumn("warm", warm).withColumn("p", F.when(warm, rules.score({c: F.col(f"w_{c}") for c in SUMS})).otherwise(0.0))
    verdict, confidence = rules.said(F.col("p"), F.col("warm"))
    return j.withColumn("verdict", verdict).withColumn("confidence", confidence)


class Service:
    """Runs requests (column ``request``; others are passed on) through triggers; its tables are in ``top``.

    answers: the requests with status, error, verdict and confidence, of the state before the trigger. closed: each closed
    bin, idle ones too, with generation, sums, warm, p, verdict and confidence. dead: rejected requests with their error. What later triggers need (``KEPT``) is held for the last two only.
    """

    def __init__(self, spark: SparkSession, top: str, rules: Rules | None = None):
        self.spark, self.top, self.rules = spark, top, rules or Rules()

    def path(self, name: str, trigger: int) -> str:
        return f"{self.top}/{name}/trigger={trigger}"

    def before(self, name: str, trigger: int) -> DataFrame:
        """A kept table as the trigger before left it; empty for the first."""
        if not trigger:
            return self.spark.createDataFrame([], KEPT[name])
        return self.spark.read.schema(KEPT[name]).parquet(self.path(name, trigger - 1))

    def put(self, df: DataFrame, name: str, trigger: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name, trigger))
        return self.spark.read.schema(df.schema).parquet(self.path(name, trigger))

    def forget(self, trigger: int) -> None:
        """Deletes tables of two triggers ago; the last one's are needed if this one is repeated."""
        for name in (*KEPT, "fresh", "advanced"):
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name, trigger - 2))
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)

    def step(self, batch: DataFrame, trigger: int) -> None:
        """One trigger."""
        rules, state, before, recent, seen = self.rules, *(self.before(n, trigger) for n in ("state", "live", "recent", "seen"))
        checked = contract.validated(batch).withColumn("request", F.when(~F.col("valid"), F.col("request")))  # only the dead keep theirs
        checked = checked.persist()  # read by three of the writes below
        dead = checked.where("NOT valid").drop("parsed", "valid")
        self.put(dead, "dead", trigger)
        given = checked.withColumn("stream_id", F.col("parsed.features.protocol")).join(state.select("stream_id", "verdict", "confidence"), "stream_id", "left")
        cached = lambda c, cold: F.when(F.col("valid"), F.coalesce(c, F.lit(cold))).alias(c)
        self.put(given.select(*(c for c in batch.columns if c != "request"), F.when(F.col("valid"), 200).otherwise(422).alias("status"), "error", cached("verdict", "benign"), cached("confidence", 0.0)), "answers", trigger)

        # a flow counts once: not if it was counted in a bin that is still open, nor twice in a trigger
        flows = flows_of(checked, rules)
        row = F.struct(*(c for c in flows.columns if c != "flow_id"))
        once = flows.groupBy("flow_id").agg(F.min(row).alias("f")).select("flow_id", "f.*").join(seen.select("flow_id"), "flow_id", "left_anti")
        once = self.put(once, "fresh", trigger)
        arrived = summed(once, rules)
        now = self.put(advanced(state, arrived, rules), "advanced", trigger)

        marks = now.select("stream_id", "reset", "was_done", "done")
        counted = arrived.drop("last").join(marks, "stream_id").where("reset OR was_done IS NULL OR bin > was_done")
        kept = before.join(marks, "stream_id").where("NOT reset AND bin > was_done")  # what was still open
        live = kept.select("stream_id", "bin", *SUMS).unionByName(counted.select("stream_id", "bin", *SUMS)).groupBy("stream_id", "bin").agg(*(F.sum(c).alias(c) for c in SUMS))
        live = self.put(live, "live", trigger)
        first_open = live.groupBy("stream_id").agg(F.min("bin").alias("first_open"))
        streams = now.join(first_open, "stream_id", "left").withColumn("start", F.coalesce("next_bin", "first_open"))
        closes = F.coalesce(F.col("start") <= F.col("done"), F.lit(False))
        streams = streams.withColumn("first_bin", F.coalesce("first_bin", F.when(closes, F.col("start"))))
        shut = spine(streams).join(live, ["stream_id", "bin"], "left").select("stream_id", "bin", *(F.coalesce(c, F.lit(0)).alias(c) for c in SUMS))
        past = recent.join(marks.where("NOT reset"), "stream_id", "left_semi")
        known = past.unionByName(shut)
        after = streams.select("stream_id", "generation", "first_bin", "start")
        closed = judged(known, after, rules).where("bin >= start").select("stream_id", "generation", "bin", *SUMS, "warm", "p", "verdict", "confidence")
        closed = self.put(closed, "closed", trigger)

        last = closed.join(now.select("stream_id", F.col("done").alias("bin")), ["stream_id", "bin"], "left_semi").select("stream_id", F.col("verdict").alias("new_verdict"), F.col("confidence").alias("new_confidence"))
        held = streams.join(last, "stream_id", "left").withColumn("next_bin", F.when(closes, F.col("done") + 1).otherwise(F.col("next_bin")))
        self.put(held.select("stream_id", "generation", "clock", "behind", "late", "first_seen", "first_bin", "next_bin", F.coalesce("new_verdict", "verdict").alias("verdict"), F.coalesce("new_confidence", "confidence").alias("confidence")), "state", trigger)
        window = known.join(marks, "stream_id").where(F.col("bin") > F.col("done") - (rules.span - 1))
        self.put(window.select("stream_id", "bin", *SUMS), "recent", trigger)
        ids = seen.join(marks.where("NOT reset"), "stream_id", "left_semi").unionByName(once.select("flow_id", "stream_id", "bin"))
        self.put(ids.join(marks, "stream_id").where("bin > done").select("flow_id", "stream_id", "bin"), "seen", trigger)
        checked.unpersist()
        if trigger > 1:
            self.forget(trigger)

    def run(self, requests: DataFrame) -> Service:
        """All requests that a stream has now."""
        requests.writeStream.foreachBatch(self.step).option("checkpointLocation", f"{self.top}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return self

    def table(self, name: str) -> DataFrame:
        """answers, closed or dead of all triggers; state, live, recent or seen as the last one left it."""
        if name not in KEPT:
            return self.spark.read.parquet(f"{self.top}/{name}").drop("trigger")
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}")
        found = root.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(root)
        last = max(int(x.getPath().getName().removeprefix("trigger=")) for x in found)
        return self.spark.read.schema(KEPT[name]).parquet(self.path(name, last))

    def counters(self) -> DataFrame:
        """(counter, n): requests that were valid, and rejected ones by reason; flows seen for the first time, and late ones of
        these; closed bins before a whole window was; restarts.
        """
        count = F.count("*").alias("n")
        asked = self.table("answers").groupBy(F.coalesce(F.concat(F.lit("rejected_"), "error"), F.lit("valid")).alias("counter")).agg(count)
        warm_up = self.table("closed").where("NOT warm").agg(F.lit("warm_up").alias("counter"), count)
        sums = self.table("state").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("first_seen", "late", "generation")))
        held = sums.select(F.explode(F.create_map(F.lit("first_seen"), "first_seen", F.lit("late"), "late", F.lit("resets"), "generation")).alias("counter", "n"))
        return asked.unionByName(warm_up).unionByName(held)


def answered_from_state(requests: DataFrame, state: DataFrame) -> DataFrame:
    """The fast tier: each valid request's cached verdict, by its stream, from the kept state alone; cold streams are benign, 0."""
    checked = contract.validated(requests).where("valid").withColumn("stream_id", F.col("parsed.features.protocol"))
    j = checked.join(state.select("stream_id", "verdict", "confidence"), "stream_id", "left")
    return j.select(*(c for c in requests.columns if c != "request"), F.coalesce("verdict", F.lit("benign")).alias("verdict"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
