"""Queries of experiments: time spans, grids of settings, seeds, images and augmentation, disturbances, artifacts, baselines."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.functions.arithmetic import digits, ratio
from flowloom.operators import audit, entropy, experiments, metrics, windows
from flowloom.operators.scratch import folder
from flowloom.plans import catalogue
from flowloom.plans.catalogue import BINS, FLOWS, ORACLES, SCORED, SEGMENTS, TAILS, bands_of, bands_sql, query, read, scored, series_of, signals_of

MD5 = "('0x' || substr(md5({}), 1, 8))::BIGINT"


# --- time ---
@query(f"WITH {FLOWS}, e AS (SELECT epoch_us(min(event_ts)) AS a, epoch_us(max(event_ts)) AS b FROM flows) SELECT row_id, event_ts FROM flows, e WHERE epoch_us(event_ts) >= a + CAST(floor((b - a) * 0.25::DOUBLE) AS BIGINT) AND epoch_us(event_ts) < a + CAST(floor((b - a) * 0.5::DOUBLE) AS BIGINT)")
def contiguous_span(spark, d):
    """The flows of the second quarter of the time range."""
    return audit.span(read(spark, d), 0.25, 0.5).select("row_id", "event_ts")


@query(f"WITH {FLOWS} SELECT row_id, event_ts, row_number() OVER (ORDER BY event_ts, row_id) AS place FROM flows WHERE event_ts IS NOT NULL")
def event_time_order(spark, d):
    """All flows in the stable order of (event_ts, row_id), with their place in it."""
    return audit.position(read(spark, d)).select("row_id", "event_ts", "place").orderBy("event_ts", "row_id")


@query(f"WITH {FLOWS} SELECT row_id, event_ts + to_microseconds(CAST(floor(duration_ms * 1000) AS BIGINT)) AS ended_at FROM flows")
def flow_end_time(spark, d):
    """When each flow ended: its start and its duration."""
    return read(spark, d).select("row_id", F.timestamp_micros(F.unix_micros(F.to_timestamp("event_ts")) + F.floor(F.col("duration_ms") * 1000)).cast("timestamp_ntz").alias("ended_at"))


# --- scores of flows, grids, seeds ---
P = "1 / (1 + exp(-(packet_count - 25) / 10.0::DOUBLE))"


@query(f"WITH {FLOWS} SELECT t // 19200 AS window_id, count(*) AS n, round(avg({P}), 9) AS p FROM flows GROUP BY 1")
def flow_scores_to_windows(spark, d):
    """The mean of the flows' scores in each window."""
    p = 1 / (1 + F.exp(-(F.col("packet_count") - 25) / 10.0))
    return experiments.window_mean(read(spark, d).withColumn("p", p)).select("window_id", "n", digits(F.col("p")).alias("p"))


GRID = ((300, 32), (600, 16), (600, 32), (1200, 16))
GRIDDED = f"{FLOWS}, grid(delta, span) AS (VALUES {', '.join(map(str, GRID))}), w AS (SELECT delta, span, t // (delta * span) AS window_id, count(*) AS n, count(*) FILTER (WHERE label_binary) AS bad FROM flows, grid GROUP BY 1, 2, 3), g AS (SELECT delta, span, count(*) AS n_windows, count(*) FILTER (WHERE 2 * bad > n) AS attack_windows, CAST(max(n) AS BIGINT) AS largest FROM w GROUP BY 1, 2)"


@query(f"WITH {GRIDDED} SELECT * FROM g")
def config_grid(spark, d):
    """Windows of each setting of bin width and span, in one pass over the flows."""
    return experiments.grid(read(spark, d), GRID)


@query(f"WITH {GRIDDED} SELECT delta, span, n_windows, attack_windows FROM g ORDER BY abs(2 * attack_windows - n_windows), delta, span LIMIT 1")
def best_configuration(spark, d):
    """The setting whose windows are most evenly benign and attack: a top-1 report."""
    g = experiments.grid(read(spark, d), GRID)
    return g.orderBy(F.abs(2 * F.col("attack_windows") - F.col("n_windows")), "delta", "span").limit(1).select("delta", "span", "n_windows", "attack_windows")


@query(f"WITH {SCORED}, s AS (SELECT r AS seed, avg(CASE WHEN (p >= 0.5) = y THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM scored, range(3) x(r) WHERE {MD5.format('window_id || chr(58) || r')} % 10 < 7 GROUP BY 1) SELECT count(*) AS seeds, round(avg(accuracy), 9) AS mean, round(stddev_samp(accuracy), 9) AS sd FROM s")
def seeds_mean_sd(spark, d):
    """Mean and standard deviation of the accuracy over three seeded parts of the windows."""
    rows = scored(spark, d).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(2))))
    rows = rows.where(experiments.seeded(F.concat_ws(":", "window_id", "seed")) % 10 < 7)
    each = rows.groupBy("seed").agg(F.avg(((F.col("p") >= 0.5) == F.col("y")).cast("double")).alias("accuracy"))
    return each.agg(F.count("*").alias("seeds"), digits(F.avg("accuracy")).alias("mean"), digits(F.stddev_samp("accuracy")).alias("sd"))


OTHER_SIDE = SCORED.replace("scored AS", "scored0 AS") + ", scored AS (SELECT window_id, NOT y AS y, 1 - p AS p FROM scored0)"


@query(ORACLES["pr_curve_ap"].replace(SCORED, OTHER_SIDE))
def pr_curve_ap_benign(spark, d):
    """Average precision with the benign windows as the positive ones."""
    return metrics.average_precision(scored(spark, d).select((~F.col("y")).alias("y"), (1 - F.col("p")).alias("p"))).select(digits(F.col("average_precision")).alias("average_precision"))


@query(f"""WITH {SCORED}, b AS (SELECT window_id // 8 AS block, y, p >= 0.5 AS a, p >= 0.3 AS b FROM scored), c AS (SELECT block, {', '.join(f"count(*) FILTER (WHERE {'' if y else 'NOT '}y AND {'' if h else 'NOT '}{k}) AS {k}{'tfpn'[0 if y == h else 1]}{'p' if h else 'n'}" for k in 'ab' for y in (1, 0) for h in (1, 0))} FROM b GROUP BY 1),
 k AS (SELECT row_number() OVER (ORDER BY block) - 1 AS i, *, count(*) OVER () AS m FROM c), r AS (SELECT r, {MD5.format('r || chr(58) || j')} % (SELECT max(m) FROM k) AS i FROM range(200) x(r), range((SELECT max(m) FROM k)) z(j)),
 s AS (SELECT r, {', '.join(f'sum({x}) AS {x}' for x in ('atp', 'afp', 'afn', 'atn', 'btp', 'bfp', 'bfn', 'btn'))} FROM r JOIN k USING (i) GROUP BY r),
 f AS (SELECT r, {', '.join(f"(coalesce(2 * {k}tp / nullif(2 * {k}tp + {k}fp + {k}fn, 0)::DOUBLE, 0) + coalesce(2 * {k}tn / nullif(2 * {k}tn + {k}fp + {k}fn, 0)::DOUBLE, 0)) / 2 AS {k}" for k in 'ab')} FROM s)
 SELECT count(*) AS replicates, round(avg(a - b), 9) AS mean, round(quantile_cont(a - b, 0.025), 9) AS low, round(quantile_cont(a - b, 0.975), 9) AS high FROM f""")
def paired_bootstrap_macro_f1(spark, d):
    """The difference of two cuts' macro-F1 over replicates that draw the same blocks of windows for both."""
    rows = scored(spark, d).select("window_id", "y", (F.col("p") >= 0.5).alias("a"), (F.col("p") >= 0.3).alias("b"))
    m = experiments.paired_bootstrap(rows)
    return m.select("replicates", *[digits(F.col(c)).alias(c) for c in ("mean", "low", "high")])


# --- images, augmentation, classes ---
TENSOR = f"tensor AS ({ORACLES['entropy_tensor']})"


@query(f"WITH {TENSOR}, rows_ AS (SELECT *, CASE band WHEN 'cA4' THEN 0 ELSE 5 - CAST(substr(band, 3) AS INT) END AS b FROM tensor) SELECT window_id, channel, CAST(r AS INT) AS r, CAST(c AS INT) AS c, v FROM range(64) y(r), range(64) x(c), rows_ WHERE b = r * 5 // 64 AND t = c * 16 // 64")
def image_nearest(spark, d):
    """Tensors as images of 64 x 64: rows and columns repeated, so that bands keep sharp edges."""
    t = series_of(spark, d).select("window_id", "channel", "band", entropy.resampled(F.col("h"), 16).alias("v"))
    return experiments.image(t, 64).select("window_id", "channel", "r", F.posexplode("row").alias("c", "v")).withColumn("v", digits(F.col("v"), 8) + 0)


@query(f"WITH {BINS}, w AS (SELECT bin // 32 AS window_id, bin % 32 AS k, rate_flows AS x FROM signals), m AS (SELECT window_id, {MD5.format('window_id || chr(58) || 0')} % 25 AS first, 1 + ({MD5.format('window_id || chr(58) || 1')} % 2001 - 1000) / 10000.0::DOUBLE AS gain FROM (SELECT DISTINCT window_id FROM w)) SELECT window_id, k, round(CASE WHEN k >= first AND k < first + 8 THEN 0.0 ELSE x * gain END, 9) AS x FROM w JOIN m USING (window_id)")
def augmented_windows(spark, d):
    """Windows with eight masked bins and a gain of 0.9 to 1.1, by seeded draws; never flipped or mixed."""
    w = signals_of(spark, d).select(F.floor(F.col("bin") / 32).alias("window_id"), (F.col("bin") % 32).alias("k"), F.col("rate_flows").alias("x"))
    return experiments.augmented(w, 32).select("window_id", "k", digits(F.col("x")).alias("x"))


@query(f"WITH {BINS}, o AS (SELECT r AS copy, {MD5.format('r || chr(58) || 2')} % 8 AS shift FROM range(3) x(r)) SELECT CAST(copy AS INT) AS copy, (bin - shift) // 32 AS window_id, count(*) AS n, CAST(sum(n_flows) AS BIGINT) AS n_flows FROM dense, o GROUP BY 1, 2")
def offset_windows(spark, d):
    """Three copies of the windows, each shifted by a seeded number of bins."""
    return experiments.shifted(windows.dense(windows.bins(read(spark, d))), 32, 3, 8)


@query(f"WITH {bands_sql('db4', 4, 256)}, energy AS (SELECT window_id, channel, band, sum(coef * coef) AS e FROM bands GROUP BY ALL), cls AS (SELECT bin // 256 AS window_id, sum(n_attack) * 2 > sum(n_flows) AS attack FROM dense GROUP BY 1) SELECT attack, channel, band, count(*) AS n, round(avg(e), 2) AS mean_energy FROM energy JOIN cls USING (window_id) GROUP BY 1, 2, 3")
def class_band_energy(spark, d):
    """The mean energy of each band for benign and attack windows."""
    from flowloom.operators import wavelets

    e = bands_of(spark, d, "db4", 4).select("window_id", "channel", F.explode("bands").alias("band", "coefs")).withColumn("e", wavelets.energy(F.col("coefs")))
    cls = windows.bins(read(spark, d)).groupBy(F.floor(F.col("bin") / 256).alias("window_id")).agg((F.sum("n_attack") * 2 > F.sum("n_flows")).alias("attack"))
    return e.join(cls, "window_id").groupBy("attack", "channel", "band").agg(F.count("*").alias("n"), digits(F.avg("e"), 2).alias("mean_energy"))


@query(f"WITH {TENSOR} SELECT channel, band, t, round(avg(v), 6) + 0 AS mean, round(stddev_pop(v), 6) + 0 AS sd, count(*) AS n FROM tensor GROUP BY 1, 2, 3")
def tensor_mean_spectrogram(spark, d):
    """The mean tensor over all windows, cell by cell."""
    t = series_of(spark, d).select("channel", "band", F.posexplode(entropy.resampled(F.col("h"), 16)).alias("t", "v"))
    return t.groupBy("channel", "band", F.col("t").cast("long").alias("t")).agg((digits(F.avg("v"), 6) + 0).alias("mean"), (digits(F.stddev_pop("v"), 6) + 0).alias("sd"), F.count("*").alias("n"))


# --- disturbances ---
def bins_sql(t: str) -> str:
    return f"WITH {FLOWS} SELECT ({t}) // 600 AS bin, count(*) AS n_flows, CAST(sum(byte_count) AS BIGINT) AS sum_bytes, CAST(sum(packet_count) AS BIGINT) AS sum_packets, count(*) FILTER (WHERE label_binary) AS n_attack FROM flows GROUP BY 1"


@query(bins_sql(f"t + {MD5.format('flow_id')} % 61 - 30"))
def robustness_jitter(spark, d):
    """Bins after each timestamp moves by up to 30 seconds."""
    return windows.bins(experiments.moved(read(spark, d), experiments.seeded(F.col("flow_id")) % 61 - 30))


@query(bins_sql("t - 137"))
def robustness_phase(spark, d):
    """Bins that begin 137 seconds later."""
    return windows.bins(experiments.moved(read(spark, d), F.lit(-137)))


@query(f"WITH {FLOWS}, a AS (SELECT row_id, t, epoch_us(event_ts) + 1000000 * ({MD5.format('flow_id')} % 1200) AS arrival FROM flows), s AS (SELECT row_id, t, row_number() OVER (ORDER BY arrival, row_id) AS place FROM a), m AS (SELECT *, max(t) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM s) SELECT count(*) AS n, count(*) FILTER (WHERE t < seen) AS out_of_order, CAST(coalesce(max(seen - t) FILTER (WHERE t < seen), 0) AS BIGINT) AS furthest_s FROM m")
def robustness_out_of_order(spark, d):
    """Flows that arrive up to two bins late: how many are out of order, and by how much at most."""
    return experiments.disorder(read(spark, d), experiments.seeded(F.col("flow_id")) % 1200)


# --- artifacts ---
CONFIG = {"bin_width_s": 600, "window_bins": 256, "wavelet": "haar", "level": 4, "entropy_bins": 16}


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


@query(f"SELECT *, '{config_hash(CONFIG)}' AS config FROM ({ORACLES['entropy_edges']})")
def fit_artifacts(spark, d):
    """The edges fitted on training windows, written under the hash of their configuration and read back by it."""
    path = f"{folder(spark)}/edges"
    catalogue.entropy_edges(spark, d).withColumn("config", F.lit(config_hash(CONFIG))).write.partitionBy("config").parquet(path)
    return spark.read.parquet(path).where(F.col("config") == config_hash(CONFIG))


@query(f"WITH {TENSOR} SELECT window_id, channel, band, t, v, '{config_hash(CONFIG)}' AS config FROM tensor")
def tensor_store(spark, d):
    """Tensors as arrays, written under the hash of their configuration and read back."""
    path = f"{folder(spark)}/tensors"
    t = series_of(spark, d).select("window_id", "channel", "band", entropy.resampled(F.col("h"), 16).alias("values"), F.lit(config_hash(CONFIG)).alias("config"))
    t.write.partitionBy("config").parquet(path)
    back = spark.read.parquet(path).where(F.col("config") == config_hash(CONFIG))
    return back.select("window_id", "channel", "band", F.posexplode("values").alias("t", "v"), "config").withColumns({"t": F.col("t").cast("long"), "v": digits(F.col("v"), 8) + 0})


def index_digest(s: DataFrame) -> DataFrame:
    """Per split of (split, bin): the bins' number, and a digest of the digests of their chunks, in order."""
    chunk = s.groupBy("split", F.floor(F.col("bin") / 4096).alias("chunk")).agg(F.array_sort(F.collect_list("bin")).alias("bins"))
    one = chunk.select("split", F.struct("chunk", F.sha2(F.array_join(F.transform("bins", lambda b: b.cast("string")), ",").cast("binary"), 256).alias("h")).alias("x"), F.size("bins").alias("n"))
    return one.groupBy("split").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("x")).alias("xs")).select("split", "n", F.sha2(F.array_join(F.transform("xs", lambda x: x["h"]), ",").cast("binary"), 256).alias("sha256"))


@query(f"WITH {SEGMENTS}, c AS (SELECT split, bin // 4096 AS chunk, sha256(string_agg(bin, ',' ORDER BY bin)) AS h, count(*) AS n FROM split GROUP BY 1, 2) SELECT split, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, ',' ORDER BY chunk)) AS sha256 FROM c GROUP BY 1")
def split_index_hash(spark, d):
    """The bins of each split, and a digest of them: of the digests of their chunks, in order."""
    return index_digest(catalogue.split_blocked_temporal(spark, d).select("split", "bin"))


@query(f"WITH {TAILS}, f AS (SELECT row_id, t // 19200 AS window_id FROM flows), s AS (SELECT row_id, CASE WHEN window_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM f UNION ALL SELECT row_id, 'test' FROM f WHERE row_id % 97 = 0 AND window_id % 5 <> 0), n AS (SELECT row_id FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1) SELECT count(*) AS leaked FROM n")
def leak_planted(spark, d):
    """Flows in two splits, where some were put into both."""
    f = read(spark, d).select("row_id", F.floor(F.unix_timestamp(F.to_timestamp("event_ts")) / 19200).alias("window_id"))
    s = f.select("row_id", F.when(F.col("window_id") % 5 == 0, "test").otherwise("train").alias("split"))
    s = s.unionByName(f.where("row_id % 97 = 0 AND window_id % 5 <> 0").select("row_id", F.lit("test").alias("split")))
    return s.groupBy("row_id").agg(F.count_distinct("split").alias("n")).where("n > 1").agg(F.count("*").alias("leaked"))


# --- baselines (trained models: no SQL) ---
def parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("window_id % 4 <> 0"), rows.where("window_id % 4 = 0")


def labels_of(spark: SparkSession, d: str, span: int) -> DataFrame:
    return windows.bins(read(spark, d)).groupBy(F.floor(F.col("bin") / span).alias("window_id")).agg((F.sum("n_attack") * 2 > F.sum("n_flows")).alias("y"))


@query()
def baseline_flow_forest(spark, d):
    """A forest on the fields of each flow; windows get the mean of their flows' scores."""
    from flowloom.operators import models

    f = read(spark, d).select(F.floor(F.unix_timestamp(F.to_timestamp("event_ts")) / 19200).alias("window_id"), "event_ts", F.col("label_binary").alias("y"), F.col("duration_ms"), F.col("byte_count").cast("double").alias("byte_count"), F.col("packet_count").cast("double").alias("packet_count"), (F.col("protocol") == "TCP").cast("double").alias("tcp"), (F.col("protocol") == "UDP").cast("double").alias("udp"))
    flows = models.fit_and_score(*parts(f), ["duration_ms", "byte_count", "packet_count", "tcp", "udp"], "forest")
    return flows.groupBy("window_id").agg(F.count("*").alias("n"), F.avg("p").alias("p"))


@query()
def baseline_entropy_boosted(spark, d):
    """Boosted trees on each window's mean, least and largest single-scale entropy."""
    from flowloom.operators import models

    e = catalogue.single_scale_entropy(spark, d).groupBy(F.floor(F.col("bin") / 32).alias("window_id")).agg(F.avg("h").alias("mean"), F.min("h").alias("low"), F.max("h").alias("high"))
    return models.fit_and_score(*parts(e.join(labels_of(spark, d, 32), "window_id")), ["mean", "low", "high"], "boosted").select("window_id", "y", "p")


@query()
def entropy_threshold_detector(spark, d):
    """The single-scale entropy below which training windows are best called attacks (by macro-F1), applied to the others."""
    e = catalogue.single_scale_entropy(spark, d).groupBy(F.floor(F.col("bin") / 32).alias("window_id")).agg(F.avg("h").alias("h")).join(labels_of(spark, d, 32), "window_id")
    train, test = parts(e)
    cut = experiments.best_cut(train.select("y", (1 - F.col("h")).alias("p")))
    return test.crossJoin(F.broadcast(cut)).select("window_id", "y", (1 - F.col("h")).alias("p"), (1 - F.col("h") >= F.col("cut")).alias("attack"))


@query()
def baseline_stats_boosted(spark, d):
    """Boosted trees on the statistics of each window's bins."""
    from flowloom.operators import models

    s = catalogue.window_stats(spark, d).join(labels_of(spark, d, 32), "window_id")
    return models.fit_and_score(*parts(s), ["mean", "sd", "skew", "median"], "boosted").select("window_id", "y", "p")


@query()
def baseline_tensor_logistic(spark, d):
    """Logistic regression on the flattened tensor of each window."""
    from flowloom.operators import models

    t = series_of(spark, d).select("window_id", F.concat_ws("_", "channel", "band").alias("part"), entropy.resampled(F.col("h"), 16).alias("v"))
    cells = t.select("window_id", F.posexplode("v").alias("t", "v"), "part").withColumn("cell", F.concat_ws("_", "part", "t"))
    names = sorted(f"{c}_{b}_{k}" for c in ("len", "rate_pkts", "rate_flows") for b in ("cA4", "cD1", "cD2", "cD3", "cD4") for k in range(16))
    flat = cells.groupBy("window_id").pivot("cell", names).agg(F.first("v"))
    return models.fit_and_score(*parts(flat.join(labels_of(spark, d, 256), "window_id")), names, "logistic").select("window_id", "y", "p")
