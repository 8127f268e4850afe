"""Flow streams: closed bins with a watermark, deduplication, and window verdicts with state."""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from flowloom.operators.windows import DELTA
from flowloom.sources.flows import from_events

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def flow_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Flows of the events files in a folder, as a stream of ``files`` files a trigger."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)
    return from_events(raw).withColumn("event_ts", F.to_timestamp("event_ts"))


def closed_bins(flows: DataFrame, delta: int = DELTA, lateness: int = 2, dedupe: bool = True) -> DataFrame:
    """(bin, n_flows, sum_bytes, sum_packets, n_attack) of bins that the watermark has passed; later flows are dropped and counted by Spark.

    With ``dedupe`` a flow_id counts once within the watermark's delay. With a column stream_id each stream has its own bins.
    """
    marked = flows.withWatermark("event_ts", f"{lateness * delta} seconds")
    if dedupe:
        marked = marked.dropDuplicatesWithinWatermark(["flow_id"])
    keys = ["stream_id"] if "stream_id" in flows.columns else []
    sums = marked.groupBy(F.window("event_ts", f"{delta} seconds"), *keys).agg(F.count("*").alias("n_flows"), F.sum("byte_count").alias("sum_bytes"), F.sum("packet_count").alias("sum_packets"), F.count_if("label_binary").alias("n_attack"))
    return sums.select(*keys, F.floor(F.unix_timestamp("window.start") / delta).alias("bin"), "n_flows", "sum_bytes", "sum_packets", "n_attack", F.col("window.end").alias("closed_at"))


class WindowState:
    """The last ``span`` bins of a stream, filled with zeros where bins are missing. Starts anew after ``resets`` bins in a row
    that lie before the last one. Pure Python, so that batch and stream share it.
    """

    def __init__(self, span: int, resets: int = 100):
        self.span, self.resets = span, resets
        self.last, self.seen, self.behind, self.sums = -1, 0, 0, []

    def load(self, last: int, seen: int, behind: int, sums: list[int]) -> WindowState:
        self.last, self.seen, self.behind, self.sums = last, seen, behind, list(sums)
        return self

    def add(self, bin_: int, flows: int, attacks: int) -> tuple[str, float] | None:
        """The verdict after a closed bin, or None if the bin is behind. Fewer than ``span`` bins: benign, confidence 0."""
        if self.last >= 0 and bin_ <= self.last:
            self.behind += 1
            if self.behind < self.resets:
                return None
            self.last, self.seen, self.sums = -1, 0, []
        self.behind = 0
        gap = min(self.span, bin_ - self.last - 1) if self.last >= 0 else 0
        self.seen += gap + 1 if self.last < 0 else bin_ - self.last
        self.sums = (self.sums + [0, 0] * gap + [flows, attacks])[-2 * self.span :]
        self.last = bin_
        if self.seen < self.span:
            return "benign", 0.0
        n, bad = sum(self.sums[::2]), sum(self.sums[1::2])
        p = bad / n if n else 0.0
        return ("malicious" if p >= 0.7 else "suspicious" if p >= 0.3 else "benign"), max(p, 1 - p)


def verdicts(closed: DataFrame, span: int = 32, resets: int = 100) -> DataFrame:
    """One verdict for each closed bin: keyed by stream_id (one stream unless the column exists), state in the state store."""

    def answer(key, parts, state) -> Iterator:
        import pandas as pd

        window = WindowState(span, resets)
        if state.exists:
            window.load(*state.get)
        out = []
        for row in sorted((r for pdf in parts for r in pdf.itertuples(index=False)), key=lambda r: r.bin):
            if said := window.add(int(row.bin), int(row.n_flows), int(row.n_attack)):
                out.append((key[0], int(row.bin), *said))
        state.update((window.last, window.seen, window.behind, window.sums))
        yield pd.DataFrame(out, columns=["stream_id", "bin", "verdict", "confidence"])

    keyed = closed if "stream_id" in closed.columns else closed.withColumn("stream_id", F.lit("all"))
    schema, held = "stream_id string, bin long, verdict string, confidence double", "last long, seen long, behind long, sums array<long>"
    return keyed.select("stream_id", "bin", "n_flows", "n_attack").groupBy("stream_id").applyInPandasWithState(answer, schema, held, "append", "NoTimeout")


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over all there is, into Parquet, and reads that; ``folder`` also has the checkpoint."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


class Dropped(StreamingQueryListener):
    """Collects, for each trigger of the queries it hears of, the rows that state operators dropped behind the watermark."""

    def __init__(self):
        self.rows: dict[tuple[str, int], int] = {}
        self.ended = threading.Event()

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        progress = json.loads(event.progress.json)
        self.rows[progress["id"], progress["batchId"]] = sum(o["numRowsDroppedByWatermark"] for o in progress["stateOperators"])

    def onQueryTerminated(self, event):
        self.ended.set()


def late_rows(stream: DataFrame, folder: str) -> DataFrame:
    """(trigger, dropped): runs a stream as ``run_to_table`` does, and tells how many rows came too late for it, by trigger."""
    spark, heard = stream.sparkSession, Dropped()
    spark.streams.addListener(heard)
    try:
        run_to_table(stream, folder)
        heard.ended.wait(60)  # events come on their own thread
    finally:
        spark.streams.removeListener(heard)
    return spark.createDataFrame([(trigger, n) for (_, trigger), n in sorted(heard.rows.items())], "trigger long, dropped long")


def count_by_trigger(stream: DataFrame, column: str, folder: str) -> None:
    """Writes, for each trigger, how often each value of a column came; a repeated trigger replaces its own counts."""

    def save(batch: DataFrame, trigger: int) -> None:
        batch.groupBy(column).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/counters/trigger={trigger}")

    stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def upsert_bins(flows: DataFrame, folder: str, delta: int = DELTA) -> None:
    """Writes, for each trigger, the sums that its flows add to their bins; a repeated trigger replaces its own."""
    from flowloom.operators.windows import bins

    def save(batch: DataFrame, trigger: int) -> None:
        bins(batch, delta).write.mode("overwrite").parquet(f"{folder}/sums/trigger={trigger}")

    flows.writeStream.foreachBatch(save).option("checkpointLocation", f"{folder}/replayed").trigger(availableNow=True).start().awaitTermination()
