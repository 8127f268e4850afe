"""Checks of flow tables: validity, labels and time, duplicates, overlaps, gaps and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.arithmetic import ratio
from flowloom.operators.timeline import carried, ranges
from flowloom.sources.flows import BENIGN


def validity(flows: DataFrame) -> DataFrame:
    """One row: rows, unparsed timestamps, negative durations, flows without packets, missing ids, non-finite durations."""
    return flows.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("event_ts").isNull()).alias("unparsed_timestamps"),
        F.count_if(F.col("duration_ms") < 0).alias("negative_duration"),
        F.count_if(F.col("packet_count") == 0).alias("zero_packet_flows"),
        F.count_if(F.col("flow_id").isNull()).alias("missing_flow_id"),
        F.count_if(F.isnan("duration_ms") | (F.abs("duration_ms") == float("inf"))).alias("non_finite_duration"),
    )


def labels_and_time(flows: DataFrame) -> DataFrame:
    """Per label the flows with a timestamp and their first and last one."""
    return flows.where("event_ts IS NOT NULL").groupBy("label_type").agg(F.count("*").alias("n"), F.min("event_ts").alias("first_seen"), F.max("event_ts").alias("last_seen"))


def label_grouping_sets(flows: DataFrame) -> DataFrame:
    """Counts by protocol and label, day and label, label, and in all, with the share of all rows."""
    at = flows.select("protocol", F.to_date("event_ts").alias("day"), "label_type")
    label = F.col("label_type")
    sets = at.groupingSets([["protocol", "label_type"], ["day", "label_type"], ["label_type"], []], "protocol", "day", label)
    return sets.agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


def benign_and_attack(flows: DataFrame) -> DataFrame:
    """Per protocol: benign by its label, attack as the rest; a null label counts as attack."""
    benign = F.count_if(F.col("label_type") == BENIGN)
    return flows.groupBy("protocol").agg(F.count("*").alias("n"), benign.alias("n_benign"), (F.count("*") - benign).alias("n_attack"))


def duplicates(flows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: groups of equal rows with more than one, and the rows beyond the first of each."""
    n = flows.groupBy(*columns).agg(F.count("*").alias("n"))
    return n.agg(F.count_if(F.col("n") > 1).alias("groups"), F.sum(F.col("n") - 1).alias("extra_rows"))


def overlapping_ranges(flows: DataFrame, part: str) -> DataFrame:
    """Pairs of parts (files, labels) whose time ranges overlap, with the overlap in seconds. One row for each part meets the others."""
    ranges = flows.groupBy(part).agg(F.min("event_ts").alias("a"), F.max("event_ts").alias("b"))
    x, y = ranges.select(F.col(part).alias("x"), F.col("a").alias("xa"), F.col("b").alias("xb")), ranges.select(F.col(part).alias("y"), F.col("a").alias("ya"), F.col("b").alias("yb"))
    pairs = x.join(y, (F.col("x") < F.col("y")) & (F.col("xa") <= F.col("yb")) & (F.col("ya") <= F.col("xb")))
    seconds = F.unix_timestamp(F.least("xb", "yb")) - F.unix_timestamp(F.greatest("xa", "ya"))
    return pairs.select("x", "y", seconds.alias("overlap_s"))


def shared_rows(flows: DataFrame, columns: list[str], part: str) -> DataFrame:
    """Equal rows (by columns) that occur in more than one part: their digest and the number of parts."""
    return flows.groupBy(F.xxhash64(*columns).alias("row_hash")).agg(F.count_distinct(part).alias("parts")).where("parts > 1")


def gaps(flows: DataFrame, seconds: int, part: str | None = None) -> DataFrame:
    """Stretches of more than ``seconds`` without flows, in all or for each ``part`` (file): the flows' seconds before and after.

    Only distinct seconds are compared, in chunks of days; a chunk also sees the last second of the chunks before.
    """
    day, by = 86_400, [part] if part else []
    t = flows.where("event_ts IS NOT NULL").select(*by, F.unix_timestamp("event_ts").alias("t")).distinct()
    last = t.groupBy(*by, F.floor(F.col("t") / day).alias("day")).agg(F.max("t").alias("last"))
    before = last.select(*by, "day", F.lag("last").over(Window.partitionBy(*by).orderBy("day")).alias("carried"))  # one row for each day
    at = t.withColumn("day", F.floor(F.col("t") / day)).join(before, [*by, "day"])
    prev = F.coalesce(F.lag("t").over(Window.partitionBy(*by, "day").orderBy("t")), F.col("carried"))
    return at.select(*by, prev.alias("before_s"), F.col("t").alias("after_s")).where(F.col("after_s") - F.col("before_s") > seconds).withColumn("gap_s", F.col("after_s") - F.col("before_s"))


def merged(spans: DataFrame, by: list[str], apart: int, chunks: tuple[int, ...] = (3_600, 86_400, 86_400 * 32)) -> DataFrame:
    """(by, first_s, last_s, n): islands of spans (first_s, last_s, n) that overlap or lie at most ``apart`` seconds apart.

    Spans that begin in the same chunk of time are merged first, then what they became in longer chunks, and at last all of a
    group. Each level sees only the islands of the one below, so no task gets all spans of a group unless they are apart.
    """
    for size in (*chunks, None):
        key = [*by, F.floor(F.col("first_s") / size).alias("chunk")] if size else [*by, F.lit(0).alias("chunk")]
        cut = spans.select(*key, "first_s", "last_s", "n")
        order = Window.partitionBy(*by, "chunk").orderBy("first_s", "last_s")
        reach = F.max("last_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
        begins = F.coalesce(F.col("first_s") > reach + apart, F.lit(True)).cast("int")
        numbered = cut.withColumn("begins", begins).withColumn("island", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        spans = numbered.groupBy(*by, "chunk", "island").agg(F.min("first_s").alias("first_s"), F.max("last_s").alias("last_s"), F.sum("n").alias("n"))
    return spans.select(*by, "first_s", "last_s", "n")


def label_islands(flows: DataFrame, apart: int, part: str | None = None) -> DataFrame:
    """(part,) label_type, first_s, last_s, n: the stretches of time in which a label's flows run on, each from its begin to its
    end, with at most ``apart`` seconds between. A label in one stretch is contiguous. Spans are counted by seconds first.
    """
    by = [part, "label_type"] if part else ["label_type"]
    ms = F.greatest(F.coalesce("duration_ms", F.lit(0.0)), F.lit(0.0))
    start = F.unix_timestamp("event_ts")
    end = F.floor((F.unix_micros(F.to_timestamp("event_ts")) + F.floor(ms * 1000)) / 1_000_000)
    seconds = flows.where("event_ts IS NOT NULL").groupBy(*by, start.alias("first_s")).agg(F.max(end).alias("last_s"), F.count("*").alias("n"))
    return merged(seconds, by, apart)


def past_end(flows: DataFrame, part: str) -> DataFrame:
    """Per ``part`` (file): its last flow's begin, the flows that end after it, and by how many seconds at most."""
    end = F.unix_micros(F.to_timestamp("event_ts")) + F.floor(F.greatest(F.coalesce("duration_ms", F.lit(0.0)), F.lit(0.0)) * 1000)
    at = flows.where("event_ts IS NOT NULL").select(part, F.unix_micros(F.to_timestamp("event_ts")).alias("begin"), end.alias("end"))
    last = at.groupBy(part).agg(F.max("begin").alias("last"))
    met = at.groupBy(part, "end").agg(F.count("*").alias("n")).join(last, part)
    late = F.col("end") > F.col("last")
    return met.groupBy(part).agg(F.timestamp_micros(F.max("last")).cast("timestamp_ntz").alias("capture_end"), F.sum(F.when(late, F.col("n")).otherwise(0)).alias("past_end"), (F.max(F.when(late, F.col("end") - F.col("last")).otherwise(0)) / 1e6).alias("furthest_s"))


def outliers(flows: DataFrame, by: str, columns: list[str], far: float = 3.5) -> DataFrame:
    """(by, field, n, median, mad, outliers): values further from their group's median than ``far`` times the median deviation
    (scaled to a standard deviation), both exact. Nulls don't count; where half the values are equal, all others are far.
    """
    from flowloom.operators.quantiles import exact

    each = flows.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select(by, "s.field", "s.x").where("x IS NOT NULL")
    counted = each.groupBy(by, "field", "x").agg(F.count("*").alias("n"))  # equal values meet as one
    keys = [by, "field"]
    middle = exact(each, keys, "x", [0.5]).select(*keys, F.col("quantiles")[0].alias("median"))
    away = each.join(F.broadcast(middle), keys).select(*keys, F.round(F.abs(F.col("x") - F.col("median")), 9).alias("away"))
    spread = exact(away, keys, "away", [0.5]).select(*keys, F.col("quantiles")[0].alias("mad"))
    both = counted.join(F.broadcast(middle.join(spread, keys)), keys)
    out = F.round(F.abs(F.col("x") - F.col("median")), 9) > F.round(far * 1.4826 * F.col("mad"), 9)
    return both.groupBy(*keys).agg(F.sum("n").alias("n"), F.first("median").alias("median"), F.first("mad").alias("mad"), F.sum(F.when(out, F.col("n")).otherwise(0)).alias("outliers"))


def order_breaks(flows: DataFrame, part: str | None = None, chunk: int = 4096) -> DataFrame:
    """Steps of the timestamp in order of row_id, steps back and repeats: one row, or one for each ``part`` (file).

    Chunks of row_id are compared on their own, each with the last row of the chunk before it, however far back that is.
    """
    by = [part] if part else []
    at = flows.select(*by, "row_id", "event_ts").withColumn("chunk", F.floor(F.col("row_id") / chunk))
    last = at.groupBy(*by, "chunk").agg(F.max_by("event_ts", "row_id").alias("last"))
    joined = at.join(carried(last, by, "last", "carried").drop("last"), [*by, "chunk"])
    inside = Window.partitionBy(*by, "chunk").orderBy("row_id")
    first = F.row_number().over(inside) == 1
    step = joined.withColumn("prev", F.when(first, F.col("carried")).otherwise(F.lag("event_ts").over(inside)))
    sums = [F.count("prev").alias("steps"), F.count_if(F.col("event_ts") < F.col("prev")).alias("backwards"), F.count_if(F.col("event_ts") == F.col("prev")).alias("repeats")]
    return step.groupBy(part).agg(*sums) if part else step.agg(*sums)


def by_file(flows: DataFrame) -> DataFrame:
    """Per file: rows, benign, attack as the rest, labels with counts (JSON, by name), timestamps, durations and packets.

    running_rows and running_attack add up the files in order of their names.
    """
    benign = F.count_if(F.col("label_type") == BENIGN)
    one = flows.groupBy("source_file").agg(F.count("*").alias("n_rows"), benign.alias("n_benign"), (F.count("*") - benign).alias("n_attack"), F.count_if(F.col("event_ts").isNull()).alias("unparsed"), F.min("event_ts").alias("first_seen"), F.max("event_ts").alias("last_seen"), F.count_if(F.col("duration_ms") < 0).alias("negative_duration"), F.count_if(F.col("packet_count") == 0).alias("zero_packets"))
    labels = flows.groupBy("source_file", "label_type").count().groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("label_type", F.lit("")).alias("k"), F.col("count").alias("n")))).alias("x"))
    said = F.concat(F.lit("{"), F.array_join(F.transform("x", lambda p: F.concat(F.lit('"'), p["k"], F.lit('":'), p["n"].cast("string"))), ","), F.lit("}"))
    files = Window.orderBy("source_file")  # one row for each file
    return one.join(labels.select("source_file", said.alias("labels")), "source_file").withColumns({"running_rows": F.sum("n_rows").over(files), "running_attack": F.sum("n_attack").over(files)})


def percent(part: Column, whole: Column) -> Column:
    """part / whole as a percentage with four digits, 0/0 as 0."""
    return F.format_string("%.4f%%", ratio(part, whole) * 100)


def span(flows: DataFrame, start: float, end: float) -> DataFrame:
    """The flows of a contiguous stretch of time, from one share of the whole range to another (never a sample of rows)."""
    ends = flows.agg(F.unix_micros(F.to_timestamp(F.min("event_ts"))).alias("a"), F.unix_micros(F.to_timestamp(F.max("event_ts"))).alias("b"))
    at = F.unix_micros(F.to_timestamp("event_ts"))
    inside = (at >= F.col("a") + F.floor((F.col("b") - F.col("a")) * start)) & (at < F.col("a") + F.floor((F.col("b") - F.col("a")) * end))
    return flows.crossJoin(F.broadcast(ends)).where(inside).drop("a", "b")


def position(flows: DataFrame) -> DataFrame:
    """Adds the place of each flow in the order of (event_ts, row_id): its rank within a range of it and the flows of ranges before."""
    cut = ranges(flows.where("event_ts IS NOT NULL"), ["event_ts", "row_id"])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    base = cut.groupBy("__range").count().select("__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__range").orderBy("event_ts", "row_id")
    return cut.join(base, "__range").withColumn("place", F.col("__base") + F.row_number().over(inside)).drop("__base", "__range")


def coverage(flows: DataFrame) -> DataFrame:
    """The share of rows with a usable value, for each field of the contract; ok from 99.9 %."""
    good = {"byte_count": F.col("byte_count") >= 0, "packet_count": F.col("packet_count") >= 0, "duration_ms": F.col("duration_ms") >= 0, "protocol": F.col("protocol").isNotNull(), "timestamp": F.col("event_ts").isNotNull()}
    one = flows.agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in good.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), ratio(F.col(k), F.col("n")).alias("share")) for k in good])).alias("x")).select("x.field", "x.share", (F.col("x.share") >= 0.999).alias("ok"))
