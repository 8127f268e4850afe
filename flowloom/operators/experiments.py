"""Parts of experiments: window means, grids, seeded draws, images, augmentation, disturbances and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.arithmetic import ratio
from flowloom.functions.timestamps import epoch_s
from flowloom.operators.timeline import ranges, running_max


def seeded(text: Column) -> Column:
    """A number below 2 ** 32 that md5 draws from a text: the same in each run."""
    return F.conv(F.substring(F.md5(text.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def window_mean(flows: DataFrame, size: int = 19_200) -> DataFrame:
    """window_id, n and the mean of p of the flows in each tumbling window."""
    return flows.where("event_ts IS NOT NULL").groupBy(F.floor(epoch_s(F.col("event_ts")) / size).alias("window_id")).agg(F.count("*").alias("n"), F.avg("p").alias("p"))


def grid(flows: DataFrame, settings) -> DataFrame:
    """Per setting (delta, span): windows with flows, those with mostly attacks, and the most flows of one."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("delta"), F.lit(b).alias("span")) for a, b in settings])).alias("s")
    at = flows.where("event_ts IS NOT NULL").select(epoch_s(F.col("event_ts")).alias("t"), "label_binary", each).select("s.delta", "s.span", F.floor(F.col("t") / (F.col("s.delta") * F.col("s.span"))).alias("window_id"), "label_binary")
    w = at.groupBy("delta", "span", "window_id").agg(F.count("*").alias("n"), F.count_if("label_binary").alias("bad"))
    return w.groupBy("delta", "span").agg(F.count("*").alias("n_windows"), F.count_if(2 * F.col("bad") > F.col("n")).alias("attack_windows"), F.max("n").alias("largest"))


def grid_scores(flows: DataFrame, settings) -> DataFrame:
    """Per setting (delta, span): windows and the macro-F1 of calling a window an attack by the flows before its last eighth, where
    the truth is what that eighth holds (half of its flows or more attacks, at least 5). All settings in one pass.
    """
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("delta"), F.lit(b).alias("span")) for a, b in settings])).alias("s")
    at = flows.where("event_ts IS NOT NULL").select(epoch_s(F.col("event_ts")).alias("t"), "label_binary", each).select("s.*", "t", "label_binary").withColumn("size", F.col("delta") * F.col("span"))
    tail = F.pmod("t", "size") >= F.col("size") - F.col("delta") * F.floor(F.col("span") / 8)
    w = at.groupBy("delta", "span", F.floor(F.col("t") / F.col("size")).alias("window_id")).agg(F.count_if(tail).alias("n"), F.count_if(tail & F.col("label_binary")).alias("bad"), F.count_if(~tail).alias("head"), F.count_if(~tail & F.col("label_binary")).alias("head_bad"))
    y, hit = (F.col("bad") >= 5) & (2 * F.col("bad") >= F.col("n")), (F.col("head") > 0) & (2 * F.col("head_bad") >= F.col("head"))
    m = w.groupBy("delta", "span").agg(F.count("*").alias("n_windows"), F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"), F.count_if(y & ~hit).alias("fn"), F.count_if(~y & ~hit).alias("tn"))
    return m.withColumn("macro_f1", macro_f1(*map(F.col, ("tp", "fp", "fn", "tn"))))


def image(tensor: DataFrame, size: int, bands: tuple[str, ...] = ("cA4", "cD4", "cD3", "cD2", "cD1")) -> DataFrame:
    """window_id, channel, r and row (array): tensors (band, v) as square images, rows and columns repeated."""
    place = F.coalesce(*[F.when(F.col("band") == b, k) for k, b in enumerate(bands)])
    rows = F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: F.floor(r * len(bands) / size) == place)
    row = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda c: F.get("v", F.floor(c * F.size("v") / size).cast("int")))
    return tensor.select("window_id", "channel", F.explode(rows).alias("r"), row.alias("row"))


def image_bilinear(image_of: DataFrame, size: int) -> DataFrame:
    """window_id, channel, r and row: tensors with rows (array of arrays, in order of bands) resized by bilinear interpolation."""

    def at(k, n):
        return k * (n - 1) / F.lit(float(size - 1))

    def mix(a, b, f):
        return a + (b - a) * f

    rows, wide = F.size("rows"), F.size(F.get("rows", F.lit(0)))
    y = at(F.col("r"), rows)
    low = F.floor(y).cast("int")
    upper = F.least(low + 1, rows - 1)
    cell = lambda r, c: F.get(F.get("rows", r), c)

    def column(c):
        x = at(c, wide)
        left = F.floor(x).cast("int")
        right = F.least(left + 1, wide - 1)
        return mix(mix(cell(low, left), cell(low, right), x - left), mix(cell(upper, left), cell(upper, right), x - left), y - low)

    spread = image_of.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return spread.select("window_id", "channel", "r", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), column).alias("row"))


def augmented(rows: DataFrame, span: int, masked: int = 8) -> DataFrame:
    """Rows (window_id, k, x) with ``masked`` bins at a drawn place set to 0 and the others scaled by a drawn 0.9 to 1.1."""
    first = seeded(F.concat_ws(":", "window_id", F.lit(0))) % (span - masked + 1)
    gain = 1 + (seeded(F.concat_ws(":", "window_id", F.lit(1))) % 2001 - 1000) / 10_000.0
    return rows.withColumn("x", F.when((F.col("k") >= first) & (F.col("k") < first + masked), 0.0).otherwise(F.col("x") * gain))


def shifted(spine: DataFrame, span: int, copies: int, most: int) -> DataFrame:
    """Per copy and window: bins and flows, where each copy's windows begin at a drawn number of bins below ``most``."""
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")
    at = spine.select("bin", "n_flows", copy).withColumn("window_id", F.floor((F.col("bin") - seeded(F.concat_ws(":", "copy", F.lit(2))) % most) / span))
    return at.groupBy("copy", "window_id").agg(F.count("*").alias("n"), F.sum("n_flows").alias("n_flows"))


def moved(flows: DataFrame, seconds: Column) -> DataFrame:
    """Flows with their timestamps moved by whole seconds."""
    at = F.timestamp_micros(F.unix_micros(F.to_timestamp("event_ts")) + seconds * 1_000_000)
    return flows.withColumn("event_ts", at.cast("timestamp_ntz"))


def disorder(flows: DataFrame, delay: Column) -> DataFrame:
    """One row: flows, those that arrive after a later one when each comes ``delay`` seconds late, and the furthest of them."""
    at = flows.where("event_ts IS NOT NULL").select("row_id", epoch_s(F.col("event_ts")).alias("t"), (F.unix_micros(F.to_timestamp("event_ts")) + delay * 1_000_000).alias("arrival"))
    seen = running_max(ranges(at, ["arrival", "row_id"]), ["arrival", "row_id"], F.col("__range"), F.col("t"), "seen")
    late = F.col("t") < F.col("seen")
    return seen.agg(F.count("*").alias("n"), F.count_if(late).alias("out_of_order"), F.coalesce(F.max(F.when(late, F.col("seen") - F.col("t"))), F.lit(0)).alias("furthest_s"))


def macro_f1(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    return (ratio(2 * tp, 2 * tp + fp + fn) + ratio(2 * tn, 2 * tn + fp + fn)) / 2


def paired_bootstrap(rows: DataFrame, block: int = 8, replicates: int = 200) -> DataFrame:
    """One row: mean and 95 % interval of the difference of macro-F1 of two detectors (booleans a and b, truth y)."""
    names = [f"{k}{n}" for k in "ab" for n in ("tp", "fp", "fn", "tn")]
    cell = {"tp": lambda h: F.col("y") & h, "fp": lambda h: ~F.col("y") & h, "fn": lambda h: F.col("y") & ~h, "tn": lambda h: ~F.col("y") & ~h}
    sums = rows.groupBy(F.floor(F.col("window_id") / block).alias("block")).agg(*[F.count_if(cell[x[1:]](F.col(x[0]))).alias(x) for x in names])
    numbered = sums.withColumn("i", F.row_number().over(Window.orderBy("block")) - 1)  # one row for each block
    size = numbered.agg(F.count("*").alias("m"))  # one row
    draws = numbered.select(F.col("i").alias("j")).crossJoin(F.broadcast(size)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    drawn = draws.select("r", (seeded(F.concat_ws(":", "r", "j")) % F.col("m")).alias("i")).join(numbered, "i").groupBy("r").agg(*[F.sum(x).alias(x) for x in names])
    score = lambda k: macro_f1(*[F.col(f"{k}{n}") for n in ("tp", "fp", "fn", "tn")])
    return drawn.select((score("a") - score("b")).alias("x")).agg(F.count("*").alias("replicates"), F.avg("x").alias("mean"), F.percentile("x", 0.025).alias("low"), F.percentile("x", 0.975).alias("high"))


def best_cut(scored: DataFrame) -> DataFrame:
    """One row: the score from which on windows are best called attacks, by macro-F1; the least of several."""
    from flowloom.operators.metrics import curve

    total = scored.agg(F.count("*").alias("n"))
    c = curve(scored).crossJoin(F.broadcast(total))
    tp, fp, fn = F.col("tp"), F.col("n_above") - F.col("tp"), F.col("all_pos") - F.col("tp")
    f = macro_f1(tp, fp, fn, F.col("n") - tp - fp - fn)
    return c.agg(F.max(F.struct(f.alias("f"), (-F.col("p")).alias("less"))).alias("x")).select((-F.col("x.less")).alias("cut"))


#: How often a block counts in a replicate, by where a uniform draw falls: the Poisson distribution of mean 1.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)


def bootstrap_macro_f1(rows: DataFrame, by: str, block: int = 8, replicates: int = 200) -> DataFrame:
    """(by, low, high): the 95 % interval of macro-F1 of each group (boolean y and hit) over replicates.

    Each block of windows counts a drawn number of times, independently of the others: no numbering, and all groups share
    the draws. A block's sums are one row before they are multiplied.
    """
    count = {"tp": F.col("y") & F.col("hit"), "fp": ~F.col("y") & F.col("hit"), "fn": F.col("y") & ~F.col("hit"), "tn": ~F.col("y") & ~F.col("hit")}
    sums = rows.groupBy(by, F.floor(F.col("window_id") / block).alias("block")).agg(*[F.count_if(c).alias(k) for k, c in count.items()])
    drawn = sums.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("u", seeded(F.concat_ws(":", "r", "block")) / 2.0**32)
    times = sum((F.col("u") >= t).cast("int") for t in POISSON)
    f = drawn.groupBy(by, "r").agg(*[F.sum(F.col(k) * times).alias(k) for k in count]).withColumn("f", macro_f1(*map(F.col, count)))
    return f.groupBy(by).agg(F.percentile("f", 0.025).alias("low"), F.percentile("f", 0.975).alias("high"))


def transform_runs(rows: DataFrame) -> DataFrame:
    """A row for each transform of (transform, seed, window_id, y, hit, shifted): mean and deviation of macro-F1 over seeds, its
    interval, and the share of windows whose verdict flips when they begin one bin later (shifted; null where there is none).
    """
    hit = lambda a, b: F.count_if((F.col("y") if a else ~F.col("y")) & (F.col("hit") if b else ~F.col("hit")))
    each = rows.groupBy("transform", "seed").agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn")).withColumn("f", macro_f1(*map(F.col, ("tp", "fp", "fn", "tn"))))
    mean = each.groupBy("transform").agg(F.count("*").alias("seeds"), F.avg("f").alias("macro_f1"), F.coalesce(F.stddev_samp("f"), F.lit(0.0)).alias("sd"))
    flips = rows.where("shifted IS NOT NULL").groupBy("transform").agg(F.avg((F.col("hit") != F.col("shifted")).cast("double")).alias("flip_rate"))
    return mean.join(bootstrap_macro_f1(rows, "transform"), "transform").join(flips, "transform", "left").withColumn("flip_rate", F.coalesce("flip_rate", F.lit(0.0)))


def transform_decision(runs: DataFrame) -> DataFrame:
    """One row: the figures of both transforms (dwt_, swt_), the gain, and whether the stationary one replaces the plain one; the
    rule is ``prefer_stationary``'s. Empty unless both were run.
    """
    side = lambda k: runs.where(F.col("transform") == k).select(*[F.col(c).alias(f"{k}_{c}") for c in runs.columns if c != "transform"])
    both = side("dwt").crossJoin(F.broadcast(side("swt"))).withColumn("gain", F.col("swt_macro_f1") - F.col("dwt_macro_f1"))  # one row each
    apart = (F.col("gain") >= 0.005) & (F.col("swt_low") > F.col("dwt_high"))
    calmer = (F.col("dwt_flip_rate") > 0) & (F.col("swt_flip_rate") <= F.col("dwt_flip_rate") / 2) & (F.col("gain") >= -0.005)
    return both.withColumn("stationary", apart | calmer)


def prefer_stationary(plain: dict[str, float], stationary: dict[str, float]) -> bool:
    """Whether the stationary transform replaces the plain one, from macro_f1, low and high (its interval) and flip_rate of
    each: at least 0.005 more macro-F1 with intervals apart, or at most half the flips at no more than 0.005 less.
    """
    gain = stationary["macro_f1"] - plain["macro_f1"]
    if gain >= 0.005 and stationary["low"] > plain["high"]:
        return True
    return plain["flip_rate"] > 0 and stationary["flip_rate"] <= plain["flip_rate"] / 2 and gain >= -0.005
