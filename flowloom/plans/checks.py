"""Queries of checks: outliers, ends of captures, contiguity, gaps by file, whole-row duplicates, calibration, rebuilt windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.functions.arithmetic import digits
from flowloom.operators import audit, metrics, wavelets
from flowloom.plans.captures import BLOCK, CAPTURE, capture_folders, captured
from flowloom.plans.catalogue import BINS, FLOWS, SCORED, bands_of, query, read, scored, signals_of
from flowloom.sources import flows as sources

FIELDS = ("byte_count", "packet_count", "duration_ms")


# --- audit ---
@query(f"""WITH {FLOWS}, e AS (SELECT label_type, field, x FROM (SELECT label_type, CAST(byte_count AS DOUBLE) AS byte_count, CAST(packet_count AS DOUBLE) AS packet_count, duration_ms FROM flows) UNPIVOT (x FOR field IN ({', '.join(FIELDS)}))),
 m AS (SELECT label_type, field, quantile_cont(x, 0.5) AS median FROM e GROUP BY ALL), a AS (SELECT label_type, field, x, median, round(abs(x - median), 9) AS away FROM e JOIN m USING (label_type, field)),
 s AS (SELECT label_type, field, quantile_cont(away, 0.5) AS mad FROM a GROUP BY ALL)
 SELECT label_type, field, count(*) AS n, round(any_value(median), 9) AS median, round(any_value(mad), 9) AS mad, count(*) FILTER (WHERE away > round(3.5 * 1.4826 * mad, 9)) AS outliers FROM a JOIN s USING (label_type, field) GROUP BY ALL""")
def audit_outliers(spark, d):
    """Sizes, packets and durations far from their label's median."""
    o = audit.outliers(read(spark, d), "label_type", list(FIELDS))
    return o.select("label_type", "field", "n", digits(F.col("median")).alias("median"), digits(F.col("mad")).alias("mad"), "outliers")


ENDS = "epoch_us(event_ts) + CAST(floor(greatest(coalesce(duration_ms, 0), 0) * 1000) AS BIGINT)"


@query(f"WITH {CAPTURE}, l AS (SELECT source_file, max(event_ts) AS capture_end FROM cap GROUP BY 1) SELECT source_file, any_value(capture_end) AS capture_end, count(*) FILTER (WHERE {ENDS} > epoch_us(capture_end)) AS past_end, greatest(max({ENDS} - epoch_us(capture_end)), 0) / 1e6::DOUBLE AS furthest_s FROM cap JOIN l USING (source_file) WHERE event_ts IS NOT NULL GROUP BY 1")
def capture_past_end(spark, d):
    """The flows of each file that end after its last one began."""
    return audit.past_end(captured(spark, d), "source_file")


def islands_sql(source: str, rows: str, by: str, apart: int) -> str:
    """Islands by a running maximum of ends."""
    return f"""WITH {source}, e AS (SELECT {by}, CAST(floor(epoch(event_ts)) AS BIGINT) AS a, CAST(floor(({ENDS}) / 1000000.0) AS BIGINT) AS b FROM {rows} WHERE event_ts IS NOT NULL),
 m AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY {by} ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {apart} THEN 1 ELSE 0 END AS begins FROM e),
 i AS (SELECT *, sum(begins) OVER (PARTITION BY {by} ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT {by}, min(a) AS first_s, max(b) AS last_s, count(*) AS n FROM i GROUP BY {by}, island"""


@query(islands_sql(FLOWS, "flows", "protocol, label_type", 900))
def audit_label_islands(spark, d):
    """The stretches of each protocol's labels, at most 15 minutes apart within one."""
    return audit.label_islands(read(spark, d), 900, "protocol")


@query(f"SELECT label_type, count(*) AS islands, CAST(sum(n) AS BIGINT) AS n, count(*) = 1 AS contiguous FROM ({islands_sql(CAPTURE, 'cap', 'source_file, label_type', 3600)}) GROUP BY label_type")
def capture_label_contiguity(spark, d):
    """In how many stretches of files' time, an hour apart or more, each label's flows lie."""
    i = audit.label_islands(captured(spark, d), 3600, "source_file")
    return i.groupBy("label_type").agg(F.count("*").alias("islands"), F.sum("n").alias("n")).withColumn("contiguous", F.col("islands") == 1)


@query(f"WITH {CAPTURE}, s AS (SELECT DISTINCT source_file, CAST(floor(epoch(event_ts)) AS BIGINT) AS t FROM cap WHERE event_ts IS NOT NULL), g AS (SELECT source_file, lag(t) OVER (PARTITION BY source_file ORDER BY t) AS before_s, t AS after_s FROM s) SELECT source_file, before_s, after_s, after_s - before_s AS gap_s FROM g WHERE after_s - before_s > 1800")
def capture_gaps(spark, d):
    """Stretches of more than half an hour without flows in each file."""
    return audit.gaps(captured(spark, d), 1800, "source_file")


#: The columns of the capture files, as ``captures.capture_folders`` writes them.
HEADER = ("Flow ID", "Timestamp", "Label", "Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets", "Total Length of Bwd Packets", "Protocol", "Unused")


def columns_sql(name: str, keep: str, header: tuple[str, ...], usable: bool) -> str:
    values = ", ".join(f"({k}, '{c}', {str(c != 'Unused').lower()})" for k, c in enumerate(header))
    return f"SELECT source_file, k AS place, c AS name, r AS required, {str(usable).lower()} AS usable FROM (SELECT DISTINCT '{name}' || CASE WHEN row_id >= {BLOCK} THEN '-' || row_id // {BLOCK} ELSE '' END || '.csv' AS source_file FROM flows WHERE {keep}), (VALUES {values}) v(k, c, r)"


FILES_OF = (("a", "row_id % 3 = 0", HEADER, True), ("b", "row_id % 3 = 1", HEADER[::-1], True), ("e", "row_id % 3 = 2", HEADER[3:] + HEADER[:3], True), ("c", "row_id % 30 = 2", HEADER[:4], False), ("d", "row_id % 6 = 0", HEADER, True))


@query(f"WITH {FLOWS} {' UNION ALL '.join(columns_sql(*f) for f in FILES_OF)} UNION ALL SELECT 'junk.csv', 0, '_c0', false, false")
def capture_schemas(spark, d):
    """The columns of each capture file in order, and whether it has those that are needed."""
    return sources.schemas(spark, capture_folders(spark, d))


WHOLE = "flow_id, event_ts, byte_count, packet_count, duration_ms, protocol, label_type"


@query(f"WITH {CAPTURE}, g AS (SELECT count(*) AS n FROM cap GROUP BY {WHOLE}) SELECT count(*) FILTER (WHERE n > 1) AS groups, CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM g")
def capture_duplicates(spark, d):
    """Whole rows that occur more than once in all files, and how many are beyond the first."""
    return audit.duplicates(captured(spark, d), WHOLE.split(", "))


# --- calibration ---
LOGITS = f"{SCORED}, z AS (SELECT window_id, y, ln(greatest(0.001, least(0.999, p)) / (1 - greatest(0.001, least(0.999, p)))) AS z FROM scored)"
NEWTON = f"""{LOGITS}, newton AS (SELECT 0 AS k, 1.0::DOUBLE AS beta UNION ALL SELECT k + 1, least(100.0::DOUBLE, greatest(0.01::DOUBLE, beta - sum((1 / (1 + exp(-z * beta)) - CASE WHEN y THEN 1 ELSE 0 END) * z) / sum(z * z / (1 + exp(-z * beta)) * (1 - 1 / (1 + exp(-z * beta))))))
 FROM newton, z WHERE k < 40 GROUP BY k, beta), fitted AS (SELECT beta FROM newton ORDER BY k DESC LIMIT 1)"""
LOSS = "sum(ln(1 + exp(-abs(z * {0}))) + greatest(z * {0}, 0) - CASE WHEN y THEN z * {0} ELSE 0 END)"


@query(f"WITH RECURSIVE {NEWTON} SELECT round(any_value(1 / beta), 6) AS tau, round({LOSS.format('beta')}, 6) AS nll, round({LOSS.format('1')}, 6) AS nll_before FROM z, fitted")
def temperature_fit(spark, d):
    """The temperature that best fits the windows' scores, and the likelihood with and without it."""
    t = metrics.fit_temperature(scored(spark, d).select("y", metrics.logit(F.col("p")).alias("z")))
    return t.select(*(digits(F.col(c), 6).alias(c) for c in ("tau", "nll", "nll_before")))


@query(f"WITH RECURSIVE {NEWTON} SELECT window_id, round(1 / (1 + exp(-z * beta)), 6) AS p FROM z, fitted")
def calibrated_scores(spark, d):
    """Each window's score at the fitted temperature."""
    z = scored(spark, d).select("window_id", "y", metrics.logit(F.col("p")).alias("z"))
    tau = metrics.fit_temperature(z).first().tau
    return z.select("window_id", digits(metrics.calibrated(F.col("z"), tau), 6).alias("p"))


# --- rebuilt windows ---
REBUILT = (("haar", 4), ("db4", 4), ("sym4", 3))


@query(f"WITH {BINS}, x AS (SELECT bin // 256 AS window_id, channel, bin % 256 AS k, v FROM signals UNPIVOT (v FOR channel IN (len, rate_pkts, rate_flows))), f AS (SELECT window_id, channel FROM x GROUP BY ALL HAVING count(*) = 256) SELECT wavelet, window_id, channel, k, round(v, 6) + 0 AS x FROM x JOIN f USING (window_id, channel), (VALUES ('haar'), ('db4'), ('sym4')) w(wavelet)")
def swt_rebuilt(spark, d):
    """Windows rebuilt from their undecimated bands by three wavelets: the windows themselves."""
    out = None
    for wavelet, level in REBUILT:
        b = wavelets.reconstruct_stationary(bands_of(spark, d, wavelet, level, "swt"), wavelet, level)
        one = b.select(F.lit(wavelet).alias("wavelet"), "window_id", "channel", F.posexplode("rebuilt").alias("k", "x"))
        out = one if out is None else out.unionByName(one)
    return out.withColumns({"k": F.col("k").cast("long"), "x": digits(F.col("x"), 6) + 0})


@query(f"WITH {BINS}, f AS (SELECT bin // 256 AS window_id FROM signals GROUP BY 1 HAVING count(*) = 256) SELECT wavelet, kind, 3 * count(*) AS windows, true AS within FROM f, (VALUES ('haar'), ('db4'), ('sym4')) w(wavelet), (VALUES ('dwt'), ('swt')) k(kind) GROUP BY ALL")
def reconstruction_error(spark, d):
    """Whether both transforms of each wavelet give windows back within 1e-8 of the largest value."""
    out = None
    for wavelet, level in REBUILT:
        for kind in ("dwt", "swt"):
            b = bands_of(spark, d, wavelet, level, kind)
            b = wavelets.reconstruct(b, 256, wavelet, level) if kind == "dwt" else wavelets.reconstruct_stationary(b, wavelet, level)
            off = F.array_max(F.zip_with("x", "rebuilt", lambda a, r: F.abs(a - r)))
            size = F.greatest(F.array_max(F.transform("x", F.abs)), F.lit(1.0))
            one = b.agg(F.lit(wavelet).alias("wavelet"), F.lit(kind).alias("kind"), F.count("*").alias("windows"), F.coalesce(F.max(off / size) <= 1e-8, F.lit(True)).alias("within"))
            out = one if out is None else out.unionByName(one)
    return out.where("windows > 0")
