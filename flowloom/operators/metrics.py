"""Scores of classified windows (columns y: boolean, p: probability of attack)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.arithmetic import ratio
from flowloom.operators.quantiles import exact


def confusion(scored: DataFrame, cut: float = 0.5) -> DataFrame:
    """One row: the confusion matrix, precision, recall and F1 of both classes, macro-F1 and Matthews' coefficient."""
    hit = F.col("p") >= cut
    m = scored.agg(F.count_if(F.col("y") & hit).alias("tp"), F.count_if(~F.col("y") & hit).alias("fp"), F.count_if(F.col("y") & ~hit).alias("fn"), F.count_if(~F.col("y") & ~hit).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    m = m.withColumns({"precision_attack": ratio(tp, tp + fp), "recall_attack": ratio(tp, tp + fn), "f1_attack": ratio(2 * tp, 2 * tp + fp + fn), "f1_benign": ratio(2 * tn, 2 * tn + fp + fn)})
    root = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return m.withColumn("macro_f1", (F.col("f1_attack") + F.col("f1_benign")) / 2).withColumn("mcc", ratio(tp * tn - fp * fn, root))


def curve(scored: DataFrame) -> DataFrame:
    """Per distinct score, from the highest: windows and attacks at or above it, precision and recall. Ties go together.

    Only one row for each distinct score meets the running sum, which goes along slices of the scores on their own, with the
    sums of the slices above (at most 4,097 for probabilities).
    """
    each = scored.groupBy("p").agg(F.count("*").alias("n"), F.count_if("y").alias("pos")).withColumn("slice", F.floor(F.col("p") * 4096))
    total = scored.agg(F.count_if("y").alias("all_pos"))
    above = Window.orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each slice
    sums = each.groupBy("slice").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    base = sums.select("slice", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"), F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("pos0"))
    down = Window.partitionBy("slice").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    run = each.join(base, "slice").select("p", "pos", (F.col("n0") + F.sum("n").over(down)).alias("n_above"), (F.col("pos0") + F.sum("pos").over(down)).alias("tp"))
    return run.crossJoin(F.broadcast(total)).select("p", "pos", "n_above", "tp", "all_pos", ratio(F.col("tp"), F.col("n_above")).alias("precision"), ratio(F.col("tp"), F.col("all_pos")).alias("recall"))


def average_precision(scored: DataFrame) -> DataFrame:
    """One row: step-wise average precision."""
    return curve(scored).agg(F.coalesce(F.sum(F.col("precision") * ratio(F.col("pos"), F.col("all_pos"))), F.lit(0.0)).alias("average_precision"))


def thresholds(scored: DataFrame, precision: float = 0.99, recall: float = 0.99) -> DataFrame:
    """One row: the lowest score with at least that precision (null if none), and the highest with at least that recall."""
    return curve(scored).agg(F.min(F.when(F.col("precision") >= precision, F.col("p"))).alias("tau_high"), F.max(F.when(F.col("recall") >= recall, F.col("p"))).alias("tau_low"))


def verdict(p, low: float, high: float):
    """(verdict, confidence): malicious from ``high``, suspicious from ``low``, else benign; confidence grows away from the middle."""
    v = F.when(p >= high, "malicious").when(p >= low, "suspicious").otherwise("benign")
    return v, F.when(v == "benign", 1 - p).when(v == "malicious", p).otherwise(F.lit(0.5))


def calibrated(logit, temperature: float):
    return 1 / (1 + F.exp(-logit / temperature))


def best_temperature(scored: DataFrame, grid: list[float]) -> DataFrame:
    """One row: the temperature of the grid with the least negative log-likelihood (columns y, z)."""
    taus = F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("tau")
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), 1 / (1 + F.exp(-F.col("z") / F.col("tau")))))
    nll = scored.select("y", "z", taus).groupBy("tau").agg(F.sum(-F.log(F.when(F.col("y"), p).otherwise(1 - p))).alias("nll"))
    return nll.agg(F.min(F.struct("nll", "tau")).alias("best")).select("best.tau", "best.nll")


def logit(p, least: float = 0.001):
    """The logit of a probability, kept ``least`` away from 0 and 1."""
    q = F.greatest(F.lit(least), F.least(F.lit(1 - least), p))
    return F.log(q / (1 - q))


def fit_temperature(scored: DataFrame, low: float = 0.01, high: float = 100.0, rounds: int = 50) -> DataFrame:
    """One row: tau, the temperature with the least negative log-likelihood of y (boolean) by logits z, nll at tau and at 1, and
    the rounds it took.

    Newton's method on 1 / tau, in which the likelihood is convex. Equal logits are counted once; each round adds up two
    derivatives over them, and one row comes to the driver. tau stays within low and high (scores without an error would
    send it to 0, those no better than chance to infinity). Without rows tau is 1.
    """
    counts = scored.where(F.col("z").isNotNull() & F.col("y").isNotNull()).groupBy("z").agg(F.count("*").cast("double").alias("n"), F.count_if("y").cast("double").alias("pos")).persist()
    beta, done = 1.0, 0
    for done in range(1, rounds + 1):
        p = 1 / (1 + F.exp(-F.col("z") * beta))
        r = counts.agg(F.sum((F.col("n") * p - F.col("pos")) * F.col("z")).alias("g"), F.sum(F.col("n") * p * (1 - p) * F.col("z") ** 2).alias("h")).first()
        if not r.h:
            break
        after = min(1 / low, max(1 / high, beta - r.g / r.h))
        moved, beta = abs(after - beta), after
        if moved < 1e-12 * beta:
            break
    loss = lambda b: F.sum(F.col("n") * F.log1p(F.exp(-F.abs(F.col("z") * b))) + F.greatest(F.col("z") * b, F.lit(0.0)) * F.col("n") - F.col("pos") * F.col("z") * b)
    out = counts.agg(F.lit(1 / beta).alias("tau"), loss(beta).alias("nll"), loss(1.0).alias("nll_before"), F.lit(done).alias("rounds"))
    row = out.first()
    counts.unpersist()
    return scored.sparkSession.createDataFrame([row], out.schema)


def block_bootstrap(scored: DataFrame, key: str = "window_id", block: int = 8, replicates: int = 200) -> DataFrame:
    """One row: mean and 95 % interval of accuracy over replicates that draw blocks of windows by md5, and their number."""
    right = scored.groupBy(F.floor(F.col(key) / block).alias("block")).agg(F.count_if((F.col("p") >= 0.5) == F.col("y")).alias("ok"), F.count("*").alias("n"))
    numbered = right.withColumn("b", F.row_number().over(Window.orderBy("block")) - 1)  # one row for each block
    size = numbered.agg(F.count("*").alias("m"))  # one row
    draws = numbered.select(F.col("b").alias("i")).crossJoin(F.broadcast(size)).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", "r", "i")), 1, 8), 16, 10).cast("long") % F.col("m")
    drawn = draws.select("r", pick.alias("b")).join(numbered, "b").groupBy("r").agg((F.sum("ok") / F.sum("n")).alias("acc"))
    return drawn.agg(F.count("*").alias("replicates"), F.avg("acc").alias("mean"), F.percentile("acc", 0.025).alias("low"), F.percentile("acc", 0.975).alias("high"))


def latency(samples: DataFrame, group: str, column: str) -> DataFrame:
    """Per group the exact median, 95th and 99th percentile of a column, and the number of its values."""
    q = exact(samples, [group], column, [0.5, 0.95, 0.99])
    n = samples.groupBy(group).agg(F.count("*").alias("n"))
    return q.join(n, group).select(group, *[F.col("quantiles")[k].alias(c) for k, c in enumerate(("p50", "p95", "p99"))], "n")
