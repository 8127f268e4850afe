"""Queries of the choice of a transform, and of what training leaves behind: statistics, stacked tensors, split indexes, feasibility."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.functions.arithmetic import digits
from flowloom.operators import entropy, experiments, wavelets, windows
from flowloom.operators.scratch import folder
from flowloom.operators.timeline import frame, own, with_halo
from flowloom.plans import catalogue
from flowloom.plans.catalogue import BINS, FLOWS, ORACLES, SEGMENTS, query, read, series_of, signals_of
from flowloom.plans.experiments import CONFIG, TENSOR, config_hash, labels_of, parts

CHANNELS, SPAN, LEVEL, SEEDS = ("len", "rate_pkts", "rate_flows"), 32, 3, (1, 2, 3)
BANDS = ("cA3", "cD1", "cD2", "cD3")


# --- the transform ---
def energies(spark: SparkSession, d: str, kind: str, later: int) -> DataFrame:
    """(window_id, a column for each channel and band): log energies of windows of 32 bins that begin ``later`` bins later."""
    signals = signals_of(spark, d).withColumn("bin", F.col("bin") - later)
    b = wavelets.decompose(wavelets.window_arrays(signals, list(CHANNELS), SPAN), "x", SPAN, "haar", LEVEL, kind)
    each = b.select("window_id", "channel", F.explode("bands").alias("band", "coefs"))
    cells = each.select("window_id", F.concat_ws("_", "channel", "band").alias("name"), F.log1p(wavelets.energy(F.col("coefs"))).alias("v"))
    return cells.groupBy("window_id").pivot("name", [f"{c}_{b}" for c in CHANNELS for b in BANDS]).agg(F.first("v"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """(transform, seed, window_id, y, hit, shifted): a forest for each transform and seed, on the windows that don't train."""
    from flowloom.operators import models

    names, labels, out = [f"{c}_{b}" for c in CHANNELS for b in BANDS], labels_of(spark, d, SPAN), []
    for kind in ("dwt", "swt"):
        at = f"{folder(spark)}/{kind}"
        rows = energies(spark, d, kind, 0).withColumn("later", F.lit(0)).unionByName(energies(spark, d, kind, 1).withColumn("later", F.lit(1)))
        rows.join(labels, "window_id").write.parquet(at)
        train, test = parts(spark.read.parquet(at))
        for seed in SEEDS:
            p = models.fit_and_score(train.where("later = 0"), test, names, "forest", seed).select("window_id", "later", "y", (F.col("p") >= 0.5).alias("hit"))
            one = p.groupBy("window_id").agg(F.first("y").alias("y"), F.max(F.when(F.col("later") == 0, F.col("hit"))).alias("hit"), F.max(F.when(F.col("later") == 1, F.col("hit"))).alias("shifted"))
            out.append(one.where("hit IS NOT NULL").select(F.lit(kind).alias("transform"), F.lit(seed).alias("seed"), "*"))
    return reduce(DataFrame.unionByName, out)


@query()
def transform_choice(spark, d):
    """Whether the stationary transform replaces the plain one: three seeds of each, intervals, flips, and the rule."""
    at = f"{folder(spark)}/runs"
    runs(spark, d).write.parquet(at)
    return experiments.transform_decision(experiments.transform_runs(spark.read.parquet(at)))


SETTINGS = ((300, 32), (300, 64), (600, 16), (600, 32), (1200, 16))


@query(f"""WITH {FLOWS}, grid(delta, span) AS (VALUES {', '.join(map(str, SETTINGS))}), w AS (SELECT delta, span, t // (delta * span) AS window_id, count(*) FILTER (WHERE tail) AS n, count(*) FILTER (WHERE tail AND label_binary) AS bad, count(*) FILTER (WHERE NOT tail) AS head, count(*) FILTER (WHERE NOT tail AND label_binary) AS head_bad
  FROM (SELECT *, t % (delta * span) >= delta * span - delta * (span // 8) AS tail FROM flows, grid) GROUP BY ALL), c AS (SELECT delta, span, bad >= 5 AND 2 * bad >= n AS y, head > 0 AND 2 * head_bad >= head AS hit FROM w),
 m AS (SELECT delta, span, count(*) AS n_windows, count(*) FILTER (WHERE y AND hit) AS tp, count(*) FILTER (WHERE NOT y AND hit) AS fp, count(*) FILTER (WHERE y AND NOT hit) AS fn, count(*) FILTER (WHERE NOT y AND NOT hit) AS tn FROM c GROUP BY 1, 2),
 f AS (SELECT *, (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0)::DOUBLE, 0)) / 2 AS macro_f1 FROM m)
 SELECT delta, span, n_windows, round(macro_f1, 9) AS macro_f1, delta * span AS wait_s, row_number() OVER (ORDER BY round(macro_f1, 9) DESC, delta * span, delta) AS place FROM f""")
def settings_by_macro_f1(spark, d):
    """Settings of bin width and span by macro-F1, ties by the time until a window is whole."""
    m = experiments.grid_scores(read(spark, d), SETTINGS).select("delta", "span", "n_windows", digits(F.col("macro_f1")).alias("macro_f1"), (F.col("delta") * F.col("span")).alias("wait_s"))
    order = Window.orderBy(F.desc("macro_f1"), "wait_s", "delta")  # a row for each setting
    return m.withColumn("place", F.row_number().over(order))


# --- tensors ---
CLASSES = f"{BINS}, cls AS (SELECT bin // 256 AS window_id, sum(n_attack) * 2 > sum(n_flows) AS attack FROM dense GROUP BY 1)"


@query(f"WITH {CLASSES}, {TENSOR} SELECT attack, channel, band, t, count(*) AS n, round(avg(v), 6) + 0 AS mean FROM tensor JOIN cls USING (window_id) GROUP BY ALL")
def class_mean_spectrogram(spark, d):
    """The mean tensor of benign and of attack windows, cell by cell."""
    cls = windows.bins(read(spark, d)).groupBy(F.floor(F.col("bin") / 256).alias("window_id")).agg((F.sum("n_attack") * 2 > F.sum("n_flows")).alias("attack"))
    t = series_of(spark, d).select("window_id", "channel", "band", F.posexplode(entropy.resampled(F.col("h"), 16)).alias("t", "v"))
    return t.join(cls, "window_id").groupBy("attack", "channel", "band", F.col("t").cast("long").alias("t")).agg(F.count("*").alias("n"), (digits(F.avg("v"), 6) + 0).alias("mean"))


@query(f"WITH {TENSOR} SELECT channel, band, count(*) AS n, count(*) FILTER (WHERE isnan(v) OR isinf(v) OR v < 0 OR v > 1) AS bad, round(min(v), 6) + 0 AS least, round(max(v), 6) + 0 AS most, round(var_pop(v), 6) + 0 AS variance, count(*) > 1 AND var_pop(v) > 0 AS varies FROM tensor GROUP BY 1, 2")
def tensor_quality(spark, d):
    """Per channel and band: cells, those that aren't finite or lie outside 0 to 1, range and variance."""
    t = series_of(spark, d).select("channel", "band", F.explode(entropy.resampled(F.col("h"), 16)).alias("v"))
    out = F.isnan("v") | (F.abs("v") == float("inf")) | ~F.col("v").between(0, 1)
    q = t.groupBy("channel", "band").agg(F.count("*").alias("n"), F.count_if(out).alias("bad"), F.min("v").alias("least"), F.max("v").alias("most"), F.var_pop("v").alias("variance"))
    return q.select("channel", "band", "n", "bad", *[(digits(F.col(c), 6) + 0).alias(c) for c in ("least", "most", "variance")], ((F.col("n") > 1) & (F.col("variance") > 0)).alias("varies"))


@query(f"""WITH {TENSOR}, cut AS (SELECT min(window_id) + CAST(floor((max(window_id) - min(window_id) + 1) * 0.7::DOUBLE) AS BIGINT) AS w FROM tensor), stats AS (SELECT channel, avg(v) AS mean, stddev_pop(v) AS sd FROM tensor, cut WHERE window_id < w GROUP BY 1)
 SELECT window_id, channel, CAST(CASE band WHEN 'cA4' THEN 0 ELSE 5 - CAST(substr(band, 3) AS INT) END AS BIGINT) AS b, t, round((v - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) + 0 AS v FROM tensor JOIN stats USING (channel)""")
def stacked_tensors(spark, d):
    """Tensors less the mean and over the deviation of training windows, stacked as channels x bands x time; statistics and
    tensors are stored under the hash of their configuration and read back.
    """
    top, config = folder(spark), config_hash(CONFIG | {"normalised": True})
    t = series_of(spark, d).select("window_id", "channel", "band", F.transform(entropy.resampled(F.col("h"), 16), lambda v: digits(v, 8)).alias("values"))
    t.write.parquet(f"{top}/tensors")
    t = spark.read.parquet(f"{top}/tensors")
    first = t.agg((F.min("window_id") + F.floor((F.max("window_id") - F.min("window_id") + 1) * 0.7)).alias("w"))  # one row
    train = t.crossJoin(F.broadcast(first)).where("window_id < w")
    entropy.channel_stats(train).withColumn("config", F.lit(config)).write.partitionBy("config").parquet(f"{top}/norm_stats")
    stats = spark.read.parquet(f"{top}/norm_stats").where(F.col("config") == config).drop("config")
    entropy.stacked(entropy.normalised(t, stats), CHANNELS).withColumn("config", F.lit(config)).write.partitionBy("config").parquet(f"{top}/stacked")
    x = spark.read.parquet(f"{top}/stacked").where(F.col("config") == config)
    names = F.array(*map(F.lit, CHANNELS))
    one = x.select("window_id", F.posexplode("x").alias("c", "rows")).select("window_id", F.element_at(names, F.col("c") + 1).alias("channel"), F.posexplode("rows").alias("b", "row"))
    return one.select("window_id", "channel", F.col("b").cast("long").alias("b"), F.posexplode("row").alias("t", "v")).withColumns({"t": F.col("t").cast("long"), "v": digits(F.col("v"), 6) + 0})


# --- splits ---
@query(f"SELECT split, n, sha256, true AS intact FROM ({ORACLES['split_index_hash']})")
def split_index_stored(spark, d):
    """The split index written by split with its digests, read back, and held against them."""
    from flowloom.plans.experiments import index_digest

    top = folder(spark)
    catalogue.split_blocked_temporal(spark, d).select("split", "bin").write.partitionBy("split").parquet(f"{top}/index")
    index_digest(catalogue.split_blocked_temporal(spark, d).select("split", "bin")).write.parquet(f"{top}/digests")
    found = index_digest(spark.read.parquet(f"{top}/index")).select("split", F.col("sha256").alias("found"))
    kept = spark.read.parquet(f"{top}/digests").join(found, "split", "full")
    return kept.select("split", "n", "sha256", F.coalesce(F.col("sha256") == F.col("found"), F.lit(False)).alias("intact"))


@query(f"""WITH {SEGMENTS}, b AS (SELECT d.bin, n_flows, n_attack, split FROM dense d JOIN split s USING (bin)), w AS (SELECT bin, count(*) OVER w AS n, min(split) OVER w AS a, max(split) OVER w AS z, CAST(sum(n_attack) OVER t AS DOUBLE) AS bad, sum(n_flows) OVER t AS flows FROM b
  WINDOW w AS (ORDER BY bin RANGE BETWEEN 7 PRECEDING AND CURRENT ROW), t AS (ORDER BY bin RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)), k AS (SELECT a AS split, flows > 0 AND bad / nullif(flows, 0) >= 0.5 AS attack FROM w WHERE n = 8 AND a = z AND a <> 'gap')
 SELECT split, count(*) AS windows, count(*) FILTER (WHERE coalesce(attack, false)) AS attack_windows, count(*) FILTER (WHERE NOT coalesce(attack, false)) AS benign_windows, CASE WHEN least(count(*) FILTER (WHERE coalesce(attack, false)), count(*) FILTER (WHERE NOT coalesce(attack, false))) < 30 THEN 'BLOCK' ELSE 'PASS' END AS verdict FROM k GROUP BY 1""")
def feasibility_by_split(spark, d):
    """Per split the windows of 8 bins that lie in it as a whole, by class of their last 4 bins; BLOCK below 30 of a class."""
    f = read(spark, d)
    b = windows.dense(windows.bins(f)).join(windows.blocked_split(windows.segments(windows.bin_labels(f))).select("bin", "split"), "bin")
    w, t = frame("bin").rangeBetween(-7, 0), frame("bin").rangeBetween(-3, 0)
    cut = own(with_halo(b, "bin", 7).withColumns({"n": F.count("*").over(w), "a": F.min("split").over(w), "z": F.max("split").over(w), "bad": F.sum("n_attack").over(t), "flows": F.sum("n_flows").over(t)}))
    k = cut.where("n = 8 AND a = z AND a <> 'gap'").select(F.col("a").alias("split"), F.coalesce(F.try_divide(F.col("bad").cast("double"), F.col("flows")) >= 0.5, F.lit(False)).alias("attack"))
    m = k.groupBy("split").agg(F.count("*").alias("windows"), F.count_if("attack").alias("attack_windows"), F.count_if(~F.col("attack")).alias("benign_windows"))
    return m.withColumn("verdict", F.when(F.least("attack_windows", "benign_windows") < 30, "BLOCK").otherwise("PASS"))
