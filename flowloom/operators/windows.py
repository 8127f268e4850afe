"""Bins, signals, tumbling and sliding windows and their labels, segments and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.arithmetic import ratio
from flowloom.functions.timestamps import epoch_s
from flowloom.operators.timeline import frame, own, running_total, spread, with_halo

DELTA, SPAN, TAIL = 600, 32, 4


def bin_of(ts: Column, delta: int = DELTA) -> Column:
    return F.floor(epoch_s(ts) / delta)


def bins(flows: DataFrame, delta: int = DELTA) -> DataFrame:
    """Sums per bin of ``delta`` seconds: order-independent and mergeable."""
    return flows.where("event_ts IS NOT NULL").groupBy(bin_of(F.col("event_ts"), delta).alias("bin")).agg(F.count("*").alias("n_flows"), F.sum("byte_count").alias("sum_bytes"), F.sum("packet_count").alias("sum_packets"), F.count_if("label_binary").alias("n_attack"))


def dense(binned: DataFrame, chunk: int = 4096) -> DataFrame:
    """All bins from the first to the last, with zeros for those without flows. The spine grows in parallel chunks."""
    ends = binned.agg(F.min("bin").alias("a"), F.max("bin").alias("b"))
    starts = ends.select(F.explode(F.expr(f"sequence(a, b, {chunk}L)")).alias("s"), "b")
    spine = starts.select(F.explode(F.sequence("s", F.least(F.col("s") + (chunk - 1), F.col("b")))).alias("bin"))
    return spine.join(binned, "bin", "left").select("bin", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in binned.columns if c != "bin"])


def signals(binned: DataFrame) -> DataFrame:
    """Mean packet size (0 for empty bins), and log packet and flow counts."""
    return binned.select("bin", ratio(F.col("sum_bytes"), F.col("sum_packets")).alias("len"), F.log1p(F.col("sum_packets").cast("double")).alias("rate_pkts"), F.log1p(F.col("n_flows").cast("double")).alias("rate_flows"))


def tail_labels(flows: DataFrame, delta: int = DELTA, span: int = SPAN, tail: int = TAIL, share: float = 0.5, least: int = 5) -> DataFrame:
    """Tumbling windows of ``span`` bins: flows, and flows and attacks in the last ``tail`` bins; attack windows by share and count.

    Windows exist where flows are. Flows with a null label count as flows, not as attacks. An empty tail has the share 0.
    """
    size = delta * span
    at = flows.where("event_ts IS NOT NULL").select(epoch_s(F.col("event_ts")).alias("t"), F.col("label_binary").alias("attack"))
    at = at.select(F.floor(F.col("t") / size).alias("window_id"), (F.pmod("t", F.lit(size)) >= size - delta * tail).alias("in_tail"), "attack")
    sums = at.groupBy("window_id").agg(F.count("*").alias("window_total_flows"), F.count_if("in_tail").alias("tail_total_flows"), F.count_if(F.col("in_tail") & F.col("attack")).alias("tail_attack_flows"), F.count_if(~F.col("in_tail") & F.col("attack")).alias("head_attack_flows"))
    part = ratio(F.col("tail_attack_flows"), F.col("tail_total_flows"))
    return sums.withColumn("tail_attack_fraction", part).withColumn("is_attack_window", (F.col("tail_attack_fraction") >= share) & (F.col("tail_attack_flows") >= least))


def sliding(spine: DataFrame, span: int = SPAN, tail: int = TAIL, stride: int = 1) -> DataFrame:
    """Windows of ``span`` bins on a dense spine, ending at ``bin``: sums, tail sums, attack fraction and boundary flag."""
    first = spine.agg(F.min("bin").alias("bin0"))  # one row
    w = frame("bin").rowsBetween(1 - span, 0)
    t = frame("bin").rowsBetween(1 - tail, 0)
    cut = with_halo(spine, "bin", span - 1)
    full = own(cut.select("*", F.sum("n_flows").over(w).alias("w_flows"), F.sum("n_flows").over(t).alias("tail_flows"), F.sum("n_attack").over(t).alias("tail_attack")))
    out = full.crossJoin(F.broadcast(first)).where((F.col("bin") - F.col("bin0") >= span - 1) & ((F.col("bin") - F.col("bin0") - (span - 1)) % stride == 0))
    part = ratio(F.col("tail_attack"), F.col("tail_flows"))
    return out.select((F.col("bin") - (span - 1)).alias("start"), F.col("bin").alias("last"), "w_flows", "tail_flows", "tail_attack", part.alias("attack_fraction"), ((part > 0) & (part < 1)).alias("is_boundary"))


def majority_type(flows: DataFrame, delta: int = DELTA, span: int = SPAN) -> DataFrame:
    """The most frequent attack type of each tumbling window; ties go to the first by name."""
    each = flows.where("label_binary").groupBy(F.floor(epoch_s(F.col("event_ts")) / (delta * span)).alias("window_id"), "label_type").agg(F.count("*").alias("n"))
    top = each.groupBy("window_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "label_type")).alias("top"))
    return top.select("window_id", F.col("top.label_type").alias("attack_type"), (-F.col("top.k")).alias("n"))


def bin_labels(flows: DataFrame, delta: int = DELTA) -> DataFrame:
    """(bin, attack) on the dense spine: attack where more than half of the bin's flows are; empty bins are benign."""
    return dense(bins(flows, delta)).select("bin", (F.col("n_attack") * 2 > F.col("n_flows")).alias("attack"))


def segments(labelled: DataFrame) -> DataFrame:
    """Maximal runs of bins with the same label: segment_id, first and last bin, length."""
    cut = with_halo(labelled, "bin", 1)
    changed = own(cut.withColumn("change", F.coalesce((F.lag("attack").over(frame("bin")) != F.col("attack")).cast("int"), F.lit(0))))
    numbered = running_total(changed, "bin", F.col("change"), "segment_id")
    return numbered.groupBy("segment_id").agg(F.first("attack").alias("attack"), F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"), F.count("*").alias("n_bins"))


def blocked_split(segs: DataFrame, gap: int = 1) -> DataFrame:
    """Each segment's first 70 % of bins train, the next 15 % validate, the rest test; the first ``gap`` bins of a later block are dropped."""
    size = F.col("n_bins")
    a, b = F.floor(size * 70 / 100), F.floor(size * 85 / 100)
    pos = F.col("bin") - F.col("first_bin")
    each = spread(segs, "first_bin", "last_bin", "bin")
    split = F.when(pos < a, "train").when(pos < b, F.when(pos - a < gap, "gap").otherwise("val")).otherwise(F.when(pos - b < gap, "gap").otherwise("test"))
    return each.select("segment_id", "bin", split.alias("split"))


def session_split(flows: DataFrame) -> DataFrame:
    """Two sessions by capture date, never mixed within a day: the first half of the dates trains, the second tests."""
    day = F.to_date("event_ts")
    first = F.min(day)
    cut = flows.agg(F.date_add(first, F.floor((F.datediff(F.max(day), first) + 1) / 2).cast("int")).alias("cut"))  # one row
    return flows.crossJoin(F.broadcast(cut)).select("row_id", F.when(day < F.col("cut"), "train").otherwise("test").alias("split"))


def overlapping(windows: DataFrame, span: int = SPAN) -> DataFrame:
    """Pairs of windows in different splits that overlap in time (start, split); found by blocks of ``span`` bins."""
    cells = F.sequence(F.floor(F.col("start") / span), F.floor((F.col("start") + span - 1) / span))
    left = windows.select(F.col("start").alias("a"), F.col("split").alias("a_split"), F.explode(cells).alias("cell"))
    right = left.select(F.col("a").alias("b"), F.col("a_split").alias("b_split"), "cell")
    return left.join(right, "cell").where((F.col("a") < F.col("b")) & (F.col("b") < F.col("a") + span) & (F.col("a_split") != F.col("b_split"))).select("a", "a_split", "b", "b_split").distinct()


def without_gaps(windows: DataFrame, gaps: DataFrame, span: int = SPAN) -> DataFrame:
    """Windows (start) that overlap no gap (first, last), by blocks of ``span`` bins."""
    cell = lambda a, b: F.explode(F.sequence(F.floor(a / span), F.floor(b / span))).alias("cell")
    w = windows.select("*", cell(F.col("start"), F.col("start") + span - 1))
    g = gaps.select("first", "last", cell(F.col("first"), F.col("last")))
    hit = w.join(g, "cell").where((F.col("start") <= F.col("last")) & (F.col("first") <= F.col("start") + span - 1)).select("start").distinct()
    return windows.join(hit, "start", "left_anti")
