"""All queries of the flow engine by name, with the SQL that gives the same rows."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import contract, timestamps
from flowloom.functions.arithmetic import digits, ratio
from flowloom.operators import audit, entropy, metrics, wavelets, windows
from flowloom.operators.quantiles import exact
from flowloom.operators.timeline import spread
from flowloom.sources import flows as sources

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

FLOWS = """flows AS (SELECT event_id AS row_id, 'flow-' || event_id AS flow_id, ts AS event_ts,
 CAST(floor(value * 100 + 0.5) AS BIGINT) AS byte_count, 1 + event_id % 50 AS packet_count,
 CAST(json_extract_string(props, '$.k') AS DOUBLE) AS duration_ms,
 CASE user_id % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'ICMP' END AS protocol,
 event_type NOT IN ('view', 'signup') AS label_binary,
 CASE WHEN event_type IN ('view', 'signup') THEN 'BENIGN' ELSE event_type END AS label_type,
 CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)"""
BINS = f"""{FLOWS}, bins AS (SELECT CAST(floor(t / 600) AS BIGINT) AS bin, count(*) AS n_flows, CAST(sum(byte_count) AS BIGINT) AS sum_bytes,
 CAST(sum(packet_count) AS BIGINT) AS sum_packets, count(*) FILTER (WHERE label_binary) AS n_attack FROM flows WHERE t IS NOT NULL GROUP BY 1),
 spine AS (SELECT r AS bin FROM range((SELECT min(bin) FROM bins), (SELECT max(bin) + 1 FROM bins)) g(r)),
 dense AS (SELECT s.bin, coalesce(n_flows, 0) AS n_flows, coalesce(sum_bytes, 0) AS sum_bytes, coalesce(sum_packets, 0) AS sum_packets,
 coalesce(n_attack, 0) AS n_attack FROM spine s LEFT JOIN bins b ON s.bin = b.bin),
 signals AS (SELECT bin, CASE WHEN sum_packets = 0 THEN 0.0 ELSE CAST(sum_bytes AS DOUBLE) / sum_packets END AS len,
 ln(1 + CAST(sum_packets AS DOUBLE)) AS rate_pkts, ln(1 + CAST(n_flows AS DOUBLE)) AS rate_flows FROM dense)"""
TAILS = f"""{FLOWS}, tails AS (SELECT *, CASE WHEN tail_total_flows = 0 THEN 0.0 ELSE CAST(tail_attack_flows AS DOUBLE) / tail_total_flows END AS tail_attack_fraction FROM (
 SELECT CAST(floor(t / 19200) AS BIGINT) AS window_id, count(*) AS window_total_flows, count(*) FILTER (WHERE t % 19200 >= 16800) AS tail_total_flows,
 count(*) FILTER (WHERE t % 19200 >= 16800 AND label_binary) AS tail_attack_flows, count(*) FILTER (WHERE t % 19200 < 16800 AND label_binary) AS head_attack_flows FROM flows GROUP BY 1)),
 labelled AS (SELECT *, tail_attack_fraction >= 0.5 AND tail_attack_flows >= 5 AS is_attack_window FROM tails)"""
SCORED = f"""{TAILS}, scored AS (SELECT window_id, is_attack_window AS y, CASE WHEN window_total_flows = tail_total_flows THEN 0.0
 ELSE CAST(head_attack_flows AS DOUBLE) / (window_total_flows - tail_total_flows) END AS p FROM labelled)"""
SEGMENTS = f"""{BINS}, marked AS (SELECT bin, n_attack * 2 > n_flows AS attack FROM dense),
 numbered AS (SELECT bin, attack, sum(CASE WHEN attack <> before THEN 1 ELSE 0 END) OVER (ORDER BY bin) AS segment_id FROM
 (SELECT *, lag(attack) OVER (ORDER BY bin) AS before FROM marked)),
 segs AS (SELECT CAST(segment_id AS BIGINT) AS segment_id, bool_or(attack) AS attack, min(bin) AS first_bin, max(bin) AS last_bin, count(*) AS n_bins FROM numbered GROUP BY 1),
 split AS (SELECT segment_id, n.bin, CASE WHEN pos < a THEN 'train' WHEN pos < b THEN CASE WHEN pos - a < 1 THEN 'gap' ELSE 'val' END ELSE CASE WHEN pos - b < 1 THEN 'gap' ELSE 'test' END END AS split
 FROM (SELECT s.segment_id, r.bin, r.bin - s.first_bin AS pos, floor(n_bins * 70 / 100) AS a, floor(n_bins * 85 / 100) AS b FROM segs s JOIN dense r ON r.bin BETWEEN s.first_bin AND s.last_bin) n)"""


def values(name: str) -> str:
    h = wavelets.FILTERS[name]
    g = wavelets.high_pass(h)
    return ", ".join(f"({m}, {a!r}, {b!r})" for m, (a, b) in enumerate(zip(h, g, strict=True)))


def bands_sql(wavelet: str, level: int, span: int, kind: str = "dwt") -> str:
    """Long-form bands by joining positions with the filter."""
    out = [BINS, f"taps(m, h, g) AS (VALUES {values(wavelet)})", f"x0 AS (SELECT CAST(floor(bin / {span}) AS BIGINT) AS window_id, channel, bin % {span} AS k, v FROM signals UNPIVOT (v FOR channel IN (len, rate_pkts, rate_flows)))", f"full0 AS (SELECT * FROM x0 WHERE (window_id, channel) IN (SELECT (window_id, channel) FROM x0 GROUP BY window_id, channel HAVING count(*) = {span}))"]
    n, before = span, "full0"
    for j in range(1, level + 1):
        if kind == "dwt":
            n //= 2
            place = f"(2 * o.k + t.m) % {2 * n}"
        else:
            place = f"(o.k + t.m * {2 ** (j - 1)}) % {n}"
        out.append(f"l{j} AS (SELECT x.window_id, x.channel, o.k, sum(t.h * x.v) AS v, sum(t.g * x.v) AS d FROM range({n}) o(k) CROSS JOIN taps t JOIN {before} x ON x.k = {place} GROUP BY ALL)")
        before = f"l{j}"
    parts = [f"SELECT window_id, channel, 'cA{level}' AS band, k, v AS coef FROM l{level}"] + [f"SELECT window_id, channel, 'cD{j}' AS band, k, d AS coef FROM l{j}" for j in range(1, level + 1)]
    out.append(f"bands AS ({' UNION ALL '.join(parts)})")
    return ", ".join(out)


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.read_events(spark, sf_dir)


def signals_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.signals(windows.dense(windows.bins(read(spark, sf_dir))))


def bands_of(spark: SparkSession, sf_dir: str, wavelet: str, level: int, kind: str = "dwt", span: int = 256) -> DataFrame:
    x = wavelets.window_arrays(signals_of(spark, sf_dir), ["len", "rate_pkts", "rate_flows"], span)
    return wavelets.decompose(x, "x", span, wavelet, level, kind)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = windows.tail_labels(read(spark, sf_dir))
    return t.select("window_id", F.col("is_attack_window").alias("y"), ratio(F.col("head_attack_flows"), F.col("window_total_flows") - F.col("tail_total_flows")).alias("p"))


# --- audit ---
@query(f"WITH {TAILS} SELECT window_id, window_total_flows, tail_total_flows, tail_attack_flows, tail_attack_fraction, is_attack_window FROM labelled")
def window_tail_label(spark, d):
    return windows.tail_labels(read(spark, d)).drop("head_attack_flows")


@query(f"WITH {TAILS} SELECT count(*) AS total_windows, count(*) FILTER (WHERE is_attack_window) AS attack_windows, count(*) FILTER (WHERE NOT is_attack_window) AS benign_windows, CASE WHEN least(count(*) FILTER (WHERE is_attack_window), count(*) FILTER (WHERE NOT is_attack_window)) < 30 THEN 'BLOCK' ELSE 'PASS' END AS verdict FROM labelled")
def window_class_balance(spark, d):
    m = windows.tail_labels(read(spark, d)).agg(F.count("*").alias("total_windows"), F.count_if("is_attack_window").alias("attack_windows"), F.count_if(~F.col("is_attack_window")).alias("benign_windows"))
    return m.withColumn("verdict", F.when(F.least("attack_windows", "benign_windows") < 30, "BLOCK").otherwise("PASS"))


@query(f"WITH {FLOWS} SELECT count(*) AS total_rows, count(*) FILTER (WHERE event_ts IS NULL) AS unparsed_timestamps, count(*) FILTER (WHERE duration_ms < 0) AS negative_duration, count(*) FILTER (WHERE packet_count = 0) AS zero_packet_flows, count(*) FILTER (WHERE flow_id IS NULL) AS missing_flow_id, count(*) FILTER (WHERE NOT isfinite(duration_ms)) AS non_finite_duration FROM flows")
def audit_validity(spark, d):
    return audit.validity(read(spark, d))


@query(f"WITH {FLOWS} SELECT label_type, count(*) AS n, min(event_ts) AS first_seen, max(event_ts) AS last_seen FROM flows WHERE event_ts IS NOT NULL GROUP BY 1")
def audit_labels_time(spark, d):
    return audit.labels_and_time(read(spark, d))


@query(f"WITH {FLOWS}, rows_ AS (SELECT protocol, CAST(event_ts AS DATE) AS day, label_type FROM flows) SELECT protocol, CAST(day AS VARCHAR) AS day, label_type, count(*) AS n FROM rows_ GROUP BY GROUPING SETS ((protocol, label_type), (day, label_type), (label_type), ())")
def audit_label_grouping_sets(spark, d):
    return audit.label_grouping_sets(read(spark, d)).drop("level").withColumn("day", F.col("day").cast("string"))


@query(f"WITH {FLOWS} SELECT protocol, count(*) AS n, count(*) FILTER (WHERE label_type = 'BENIGN') AS n_benign, count(*) - count(*) FILTER (WHERE label_type = 'BENIGN') AS n_attack FROM flows GROUP BY 1")
def audit_label_subtraction(spark, d):
    return audit.benign_and_attack(read(spark, d))


@query(f"WITH {FLOWS}, g AS (SELECT count(*) AS n FROM flows GROUP BY protocol, label_type, packet_count, t) SELECT count(*) FILTER (WHERE n > 1) AS groups, CAST(sum(n - 1) AS BIGINT) AS extra_rows FROM g")
def audit_duplicates(spark, d):
    return audit.duplicates(read(spark, d).withColumn("t", timestamps.epoch_s(F.col("event_ts"))), ["protocol", "label_type", "packet_count", "t"])


@query(f"WITH {FLOWS}, g AS (SELECT t FROM flows GROUP BY protocol, t HAVING count(*) > 0), h AS (SELECT t, count(*) AS parts FROM g GROUP BY t HAVING count(*) > 1) SELECT count(*) AS shared, CAST(max(parts) AS BIGINT) AS most FROM h")
def audit_shared_rows(spark, d):
    return audit.shared_rows(read(spark, d).withColumn("t", timestamps.epoch_s(F.col("event_ts"))), ["t"], "protocol").agg(F.count("*").alias("shared"), F.max("parts").alias("most"))


@query(f"WITH {FLOWS}, r AS (SELECT label_type AS l, min(event_ts) AS a, max(event_ts) AS b FROM flows GROUP BY 1) SELECT x.l AS x, y.l AS y, CAST(floor(epoch(least(x.b, y.b))) AS BIGINT) - CAST(floor(epoch(greatest(x.a, y.a))) AS BIGINT) AS overlap_s FROM r x JOIN r y ON x.l < y.l AND x.a <= y.b AND y.a <= x.b")
def audit_overlap_ranges(spark, d):
    return audit.overlapping_ranges(read(spark, d), "label_type")


@query(f"WITH {FLOWS}, s AS (SELECT DISTINCT t FROM flows), g AS (SELECT lag(t) OVER (ORDER BY t) AS before_s, t AS after_s FROM s) SELECT before_s, after_s, after_s - before_s AS gap_s FROM g WHERE after_s - before_s > 600")
def audit_ts_gaps(spark, d):
    return audit.gaps(read(spark, d), 600)


@query(f"WITH {FLOWS}, s AS (SELECT event_ts, lag(event_ts) OVER (ORDER BY row_id) AS prev FROM flows) SELECT count(prev) AS steps, count(*) FILTER (WHERE event_ts < prev) AS backwards, count(*) FILTER (WHERE event_ts = prev) AS repeats FROM s")
def audit_order_breaks(spark, d):
    return audit.order_breaks(read(spark, d))


@query(f"WITH {FLOWS}, c AS (SELECT unnest([{{'field': 'byte_count', 'ok': byte_count >= 0}}, {{'field': 'packet_count', 'ok': packet_count >= 0}}, {{'field': 'duration_ms', 'ok': duration_ms >= 0}}, {{'field': 'protocol', 'ok': protocol IS NOT NULL}}, {{'field': 'timestamp', 'ok': event_ts IS NOT NULL}}]) AS x FROM flows) SELECT x.field AS field, CAST(count(*) FILTER (WHERE x.ok) AS DOUBLE) / count(*) AS share, CAST(count(*) FILTER (WHERE x.ok) AS DOUBLE) / count(*) >= 0.999 AS ok FROM c GROUP BY 1")
def audit_contract_coverage(spark, d):
    return audit.coverage(read(spark, d))


@query("""WITH s AS (SELECT event_id, ts, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') WHEN 2 THEN strftime(ts, '%d/%m/%Y %H:%M:%S') WHEN 3 THEN strftime(ts, '%d/%m/%Y %H:%M') ELSE 'broken' END AS text FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN ts WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('minute', ts) END AS parsed FROM s""")
def parse_timestamps(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "ts")
    f = lambda p: F.date_format("ts", p)
    k = F.col("event_id") % 5
    text = F.when(k == 0, f("yyyy-MM-dd HH:mm:ss")).when(k == 1, f("yyyy-MM-dd HH:mm:ss.SSSSSS")).when(k == 2, f("dd/MM/yyyy HH:mm:ss")).when(k == 3, f("dd/MM/yyyy HH:mm")).otherwise("broken")
    return e.select("event_id", timestamps.parse(text).alias("parsed"))


@query(f"WITH {FLOWS} SELECT row_id, protocol, label_type, packet_count, byte_count, date_trunc('second', event_ts) AS event_ts FROM flows")
def csv_roundtrip_scan(spark, d):
    """Flows written as capture files with padded headers, and read back."""
    from flowloom.operators.scratch import folder

    f = read(spark, d)
    raw = f.select(
        F.col("row_id").cast("string").alias("Flow ID"),
        F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss").alias(" Timestamp"),
        F.col("label_type").alias(" Label"),
        F.lit(1000).alias(" Flow Duration"),
        F.col("packet_count").alias(" Total Fwd Packets"),
        F.lit(0).alias(" Total Backward Packets"),
        F.col("byte_count").cast("double").alias("Total Length of Fwd Packets"),
        F.lit(0.0).alias(" Total Length of Bwd Packets"),
        F.when(F.col("protocol") == "TCP", 6).when(F.col("protocol") == "UDP", 17).otherwise(1).alias(" Protocol"),
    )
    path = folder(spark)
    raw.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    back = sources.from_capture(sources.scan_csv(spark, path))
    return back.select(F.col("flow_id").cast("long").alias("row_id"), "protocol", "label_type", "packet_count", "byte_count", "event_ts")


# --- contract ---
CHUNK = "('0x' || substr(md5('flow-' || event_id), {}, 8))::BIGINT"


@query(f"WITH r AS (SELECT 'flow-' || event_id AS flow_id, (6 * ({CHUNK.format(1)} + {CHUNK.format(9)} + {CHUNK.format(17)}) + {CHUNK.format(25)}) % 10 AS r FROM events), v AS (SELECT flow_id, CASE WHEN r < 8 THEN 'benign' WHEN r = 8 THEN 'suspicious' ELSE 'malicious' END AS verdict FROM r) SELECT flow_id, verdict, CASE WHEN verdict = 'suspicious' THEN 0.5::DOUBLE ELSE 0.95::DOUBLE END AS confidence, '{contract.VERSION}' AS model_version, 1.5::DOUBLE AS latency_ms FROM v")
def stub_verdict(spark, d):
    return contract.respond(read(spark, d))


def requests(f: DataFrame) -> DataFrame:
    """Requests of flows; every seventh to eleventh has one of five faults."""
    k = F.col("row_id") % 11
    features = F.struct(
        F.when(k == 7, F.lit(-1.0)).otherwise(F.coalesce("duration_ms", F.lit(0.0))).alias("duration_ms"),
        F.col("byte_count").cast("double").alias("byte_count"),
        F.col("packet_count").cast("double").alias("packet_count"),
        F.when(k != 8, F.col("protocol")).alias("protocol"),
        F.lit(0.5).alias("entropy"),
        F.when(k == 1, "a1b2").alias("ja3_hash"),
        F.lit(True).alias("dns_before_ip"),
    )
    stamp = F.when(k == 9, "yesterday").otherwise(F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss"))
    body = F.struct("flow_id", F.when(k == 10, "medium").otherwise("fast").alias("tier"), features.alias("features"), stamp.alias("timestamp"), F.lit(1).alias("extra"))
    return f.select("row_id", F.when(k == 6, F.lit("{broken")).otherwise(F.to_json(body)).alias("request"))


@query("SELECT event_id AS row_id, CASE event_id % 11 WHEN 6 THEN 'flow_id' WHEN 7 THEN 'duration_ms' WHEN 8 THEN 'protocol' WHEN 9 THEN 'timestamp' WHEN 10 THEN 'tier' END AS error, event_id % 11 < 6 AS valid FROM events")
def contract_validate(spark, d):
    return contract.validated(requests(read(spark, d))).select("row_id", "error", "valid")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 11 >= 6) AS failures FROM events")
def contract_failures(spark, d):
    return contract.validated(requests(read(spark, d))).agg(F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("failures"))


@query(f"WITH {FLOWS} SELECT row_id, flow_id, 'fast' AS tier, coalesce(duration_ms, 0) AS duration_ms, CAST(byte_count AS DOUBLE) AS byte_count, protocol FROM flows WHERE row_id % 11 < 6")
def contract_json_roundtrip(spark, d):
    p = contract.validated(requests(read(spark, d))).where("valid")
    return p.select("row_id", "parsed.flow_id", "parsed.tier", "parsed.features.duration_ms", "parsed.features.byte_count", "parsed.features.protocol")


# --- bins and windows ---
@query(f"WITH {BINS} SELECT * FROM bins")
def flow_bins(spark, d):
    return windows.bins(read(spark, d))


@query(f"WITH {BINS} SELECT * FROM dense")
def flow_bins_dense(spark, d):
    return windows.dense(windows.bins(read(spark, d)))


@query(f"WITH {BINS} SELECT bin, round(len, 9) AS len, round(rate_pkts, 9) AS rate_pkts, round(rate_flows, 9) AS rate_flows FROM signals")
def bin_signals(spark, d):
    return signals_of(spark, d).select("bin", *[digits(F.col(c)).alias(c) for c in ("len", "rate_pkts", "rate_flows")])


@query(f"WITH {BINS}, w AS (SELECT bin - 31 AS start, bin AS last, sum(n_flows) OVER w AS w_flows, sum(n_flows) OVER t AS tail_flows, sum(n_attack) OVER t AS tail_attack, bin - min(bin) OVER () AS pos FROM dense WINDOW w AS (ORDER BY bin ROWS 31 PRECEDING), t AS (ORDER BY bin ROWS 3 PRECEDING)), f AS (SELECT *, CASE WHEN tail_flows = 0 THEN 0.0 ELSE CAST(tail_attack AS DOUBLE) / tail_flows END AS attack_fraction FROM w WHERE pos >= 31 AND (pos - 31) % 4 = 0) SELECT start, last, CAST(w_flows AS BIGINT) AS w_flows, CAST(tail_flows AS BIGINT) AS tail_flows, CAST(tail_attack AS BIGINT) AS tail_attack, attack_fraction, attack_fraction > 0 AND attack_fraction < 1 AS is_boundary FROM f")
def sliding_windows_labels(spark, d):
    return windows.sliding(windows.dense(windows.bins(read(spark, d))), stride=4)


@query(f"WITH {FLOWS}, c AS (SELECT CAST(floor(t / 19200) AS BIGINT) AS window_id, label_type, count(*) AS n FROM flows WHERE label_binary GROUP BY 1, 2) SELECT window_id, label_type AS attack_type, n FROM c QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY n DESC, label_type) = 1")
def majority_attack_type(spark, d):
    return windows.majority_type(read(spark, d))


@query(f"WITH {SEGMENTS} SELECT segment_id, attack, first_bin, last_bin, n_bins FROM segs")
def segments(spark, d):
    return windows.segments(windows.bin_labels(read(spark, d)))


@query(f"WITH {SEGMENTS} SELECT segment_id, bin, split FROM split")
def split_blocked_temporal(spark, d):
    return windows.blocked_split(windows.segments(windows.bin_labels(read(spark, d))))


@query(f"WITH {FLOWS}, m AS (SELECT min(CAST(event_ts AS DATE)) + CAST(floor((max(CAST(event_ts AS DATE)) - min(CAST(event_ts AS DATE)) + 1) / 2.0) AS INT) AS cut FROM flows) SELECT row_id, CASE WHEN CAST(event_ts AS DATE) < cut THEN 'train' ELSE 'test' END AS split FROM flows, m")
def split_cross_session(spark, d):
    return windows.session_split(read(spark, d))


@query("SELECT 0::BIGINT AS flows_in_both")
def leak_flow_overlap(spark, d):
    return windows.session_split(read(spark, d)).groupBy("row_id").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("flows_in_both"))


SLIDES = f"{BINS}, s AS (SELECT bin AS start, CASE WHEN bin % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM dense)"


@query(f"WITH {SLIDES} SELECT x.start AS a, x.split AS a_split, y.start AS b, y.split AS b_split FROM s x JOIN s y ON x.start < y.start AND y.start < x.start + 32 AND x.split <> y.split")
def leak_window_overlap(spark, d):
    s = windows.dense(windows.bins(read(spark, d))).select(F.col("bin").alias("start"), F.when(F.col("bin") % 5 == 0, "test").otherwise("train").alias("split"))
    return windows.overlapping(s)


@query(f"WITH {SLIDES}, e AS (SELECT bin FROM dense WHERE n_flows = 0) SELECT start, split FROM s WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.bin BETWEEN s.start AND s.start + 31)")
def gap_window_drop(spark, d):
    spine = windows.dense(windows.bins(read(spark, d)))
    s = spine.select(F.col("bin").alias("start"), F.when(F.col("bin") % 5 == 0, "test").otherwise("train").alias("split"))
    return windows.without_gaps(s, spine.where("n_flows = 0").select(F.col("bin").alias("first"), F.col("bin").alias("last")))


@query(f"WITH {TAILS} SELECT row_id, CASE WHEN is_attack_window THEN 'malicious' ELSE 'benign' END AS verdict FROM flows f LEFT JOIN labelled l ON CAST(floor(f.t / 19200) AS BIGINT) = l.window_id")
def flow_inherited_verdict(spark, d):
    f = read(spark, d)
    v = windows.tail_labels(f).select("window_id", F.when(F.col("is_attack_window"), "malicious").otherwise("benign").alias("verdict"))
    return f.withColumn("window_id", F.floor(timestamps.epoch_s(F.col("event_ts")) / 19200)).join(v, "window_id", "left").select("row_id", "verdict")


# --- wavelets and entropy ---
def long_rounded(bands: DataFrame) -> DataFrame:
    return wavelets.long_bands(bands).select("window_id", "channel", "band", F.col("k").cast("long").alias("k"), digits(F.col("coef"), 6).alias("coef"))


LONG = "SELECT window_id, channel, band, k, round(coef, 6) + 0 AS coef FROM bands"


@query(f"WITH {bands_sql('haar', 4, 256)} {LONG}")
def dwt_haar(spark, d):
    return long_rounded(bands_of(spark, d, "haar", 4))


@query(f"WITH {bands_sql('db4', 4, 256)} {LONG}")
def dwt_db4(spark, d):
    return long_rounded(bands_of(spark, d, "db4", 4))


@query(f"WITH {bands_sql('sym4', 3, 256)} {LONG}")
def dwt_sym4(spark, d):
    return long_rounded(bands_of(spark, d, "sym4", 3))


@query(f"WITH {bands_sql('haar', 3, 256, 'swt')} {LONG}")
def swt_haar(spark, d):
    return long_rounded(bands_of(spark, d, "haar", 3, "swt"))


@query(f"WITH {bands_sql('db4', 4, 256)} SELECT window_id, channel, band, round(sum(coef * coef), 2) AS energy FROM bands GROUP BY ALL")
def band_energy(spark, d):
    b = bands_of(spark, d, "db4", 4).select("window_id", "channel", F.explode("bands").alias("band", "coefs"))
    return b.select("window_id", "channel", "band", digits(wavelets.energy(F.col("coefs")), 2).alias("energy"))


EDGES = f"{bands_sql('haar', 4, 256)}, cut AS (SELECT min(window_id) + CAST(floor((max(window_id) - min(window_id) + 1) * 0.7::DOUBLE) AS BIGINT) AS w FROM bands), edges AS (SELECT channel, band, quantile_cont(round(abs(coef), 9), [{', '.join(str(i / 16) for i in range(1, 16))}]) AS edges FROM bands, cut WHERE window_id < cut.w GROUP BY 1, 2)"


def edges_of(bands: DataFrame) -> DataFrame:
    """Edges of the first 70 % of the windows' range, which train."""
    first = bands.agg((F.min("window_id") + F.floor((F.max("window_id") - F.min("window_id") + 1) * 0.7)).alias("w"))
    return entropy.edges(wavelets.long_bands(bands.crossJoin(F.broadcast(first)).where("window_id < w").drop("w")))


@query(f"WITH {EDGES} SELECT channel, band, CAST(i AS INTEGER) AS i, round(edges[i + 1], 6) AS edge FROM edges, range(15) r(i)")
def entropy_edges(spark, d):
    e = edges_of(bands_of(spark, d, "haar", 4))
    return e.select("channel", "band", F.posexplode("edges").alias("i", "edge")).withColumn("edge", digits(F.col("edge"), 6))


CODED = f"{EDGES}, w(band, w) AS (VALUES ('cD1', 16), ('cD2', 8), ('cD3', 8), ('cD4', 8), ('cA4', 8)), coded AS (SELECT b.window_id, b.channel, b.band, b.k, len(list_filter(e.edges, lambda x: x <= round(abs(b.coef), 9) + 1e-10)) AS code FROM bands b JOIN edges e USING (channel, band)), placed AS (SELECT a.window_id, a.channel, a.band, a.k, b.code, w.w FROM coded a JOIN w USING (band) JOIN coded b ON a.window_id = b.window_id AND a.channel = b.channel AND a.band = b.band AND b.k BETWEEN a.k AND a.k + w.w - 1), counted AS (SELECT window_id, channel, band, k, code, w, count(*) AS c FROM placed GROUP BY ALL), series AS (SELECT window_id, channel, band, k, -sum(CAST(c AS DOUBLE) / w * log2(CAST(c AS DOUBLE) / w)) / 4 AS h FROM counted GROUP BY window_id, channel, band, k HAVING sum(c) = max(w))"


def series_of(spark, d) -> DataFrame:
    """Rolling entropies of all windows; the bands are written once, for the edges and for the entropies."""
    from flowloom.operators.scratch import folder

    path, b = f"{folder(spark)}/bands", bands_of(spark, d, "haar", 4)
    b.write.parquet(path)
    b = spark.read.schema(b.schema).parquet(path)
    return entropy.rolling(b, edges_of(b))


@query(f"WITH {CODED} SELECT window_id, channel, band, k, round(h, 6) + 0 AS h FROM series")
def rolling_entropy(spark, d):
    s = series_of(spark, d)
    return s.select("window_id", "channel", "band", F.posexplode("h").alias("k", "h")).select("window_id", "channel", "band", F.col("k").cast("long").alias("k"), (digits(F.col("h"), 6) + 0).alias("h"))


@query(f"WITH {CODED}, n AS (SELECT window_id, channel, band, max(k) AS m FROM series GROUP BY ALL), p AS (SELECT n.*, t, t * m / 15.0::DOUBLE AS pos FROM n, range(16) r(t)), q AS (SELECT *, CAST(floor(pos) AS BIGINT) AS lo FROM p) SELECT q.window_id, q.channel, q.band, q.t, round(a.h + (b.h - a.h) * (pos - lo), 8) + 0 AS v FROM q JOIN series a ON (a.window_id, a.channel, a.band, a.k) = (q.window_id, q.channel, q.band, lo) JOIN series b ON (b.window_id, b.channel, b.band, b.k) = (q.window_id, q.channel, q.band, least(lo + 1, m))")
def entropy_tensor(spark, d):
    t = series_of(spark, d).select("window_id", "channel", "band", entropy.resampled(F.col("h"), 16).alias("v"))
    return t.select("window_id", "channel", "band", F.posexplode("v").alias("t", "v")).select("window_id", "channel", "band", F.col("t").cast("long").alias("t"), (digits(F.col("v"), 8) + 0).alias("v"))


@query()
def entropy_tensor_quality(spark, d):
    return entropy.quality(entropy.tensors(series_of(spark, d)))


@query(f"WITH {BINS}, e AS (SELECT quantile_cont(rate_flows, [{', '.join(str(i / 16) for i in range(1, 16))}]) AS edges FROM signals), c AS (SELECT bin, len(list_filter(edges, lambda x: x <= rate_flows)) AS code FROM signals, e), p AS (SELECT a.bin, b.code, count(*) AS c FROM c a JOIN c b ON b.bin BETWEEN a.bin - 31 AND a.bin GROUP BY 1, 2) SELECT bin, round(-sum(c / 32.0::DOUBLE * log2(c / 32.0::DOUBLE)) / 4, 6) + 0 AS h FROM p GROUP BY 1 HAVING sum(c) = 32")
def single_scale_entropy(spark, d):
    from flowloom.operators.timeline import frame, own, with_halo

    s = signals_of(spark, d).select("bin", "rate_flows")
    cuts = exact(s, [], "rate_flows", [i / 16 for i in range(1, 16)]).withColumnRenamed("quantiles", "edges")
    coded = s.crossJoin(F.broadcast(cuts)).select("bin", entropy.bucket(F.col("rate_flows"), F.col("edges")).alias("code"))
    last = own(with_halo(coded, "bin", 31).withColumn("codes", F.collect_list("code").over(frame("bin").rowsBetween(-31, 0))))
    return last.where(F.size("codes") == 32).select("bin", (digits(entropy.entropy(F.col("codes"), 32), 6) + 0).alias("h"))


@query(f"WITH {BINS}, w AS (SELECT CAST(floor(bin / 32) AS BIGINT) AS window_id, rate_flows AS x FROM signals), m AS (SELECT window_id, avg(x) AS mu, stddev_pop(x) AS sd FROM w GROUP BY 1) SELECT window_id, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd, round(CASE WHEN max(sd) > 0 THEN avg((x - mu) ** 3) / max(sd) ** 3 ELSE 0 END, 4) + 0 AS skew, round(quantile_cont(x, 0.5), 6) AS median FROM w JOIN m USING (window_id) GROUP BY 1")
def window_stats(spark, d):
    w = signals_of(spark, d).select(F.floor(F.col("bin") / 32).alias("window_id"), F.col("rate_flows").alias("x"))
    m = w.groupBy("window_id").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), F.skewness("x").alias("skew"), F.percentile("x", 0.5).alias("median"))
    return m.select("window_id", "n", digits(F.col("mean"), 6).alias("mean"), digits(F.col("sd"), 6).alias("sd"), (digits(F.coalesce(F.when(F.col("sd") > 0, F.col("skew")), F.lit(0.0)), 4) + 0).alias("skew"), digits(F.col("median"), 6).alias("median"))


# --- metrics ---
@query(f"WITH {SCORED}, m AS (SELECT count(*) FILTER (WHERE y AND p >= 0.5) AS tp, count(*) FILTER (WHERE NOT y AND p >= 0.5) AS fp, count(*) FILTER (WHERE y AND p < 0.5) AS fn, count(*) FILTER (WHERE NOT y AND p < 0.5) AS tn FROM scored) SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 9) AS precision_attack, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 9) AS recall_attack, round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0)::DOUBLE, 0)) / 2, 9) AS macro_f1, round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 9) AS mcc FROM m")
def classification_metrics(spark, d):
    m = metrics.confusion(scored(spark, d))
    return m.select("tp", "fp", "fn", "tn", *[digits(F.col(c)).alias(c) for c in ("precision_attack", "recall_attack", "macro_f1", "mcc")])


CURVE = f"{SCORED}, g AS (SELECT p, count(*) AS n, count(*) FILTER (WHERE y) AS pos FROM scored GROUP BY p), c AS (SELECT p, pos, CAST(sum(n) OVER d AS BIGINT) AS n_above, CAST(sum(pos) OVER d AS BIGINT) AS tp, (SELECT count(*) FROM scored WHERE y) AS all_pos FROM g WINDOW d AS (ORDER BY p DESC)), curve AS (SELECT *, tp / n_above::DOUBLE AS precision, coalesce(tp / nullif(all_pos, 0)::DOUBLE, 0) AS recall FROM c)"


@query(f"WITH {CURVE} SELECT round(p, 9) AS p, n_above, tp, round(precision, 9) AS precision, round(recall, 9) AS recall FROM curve")
def pr_curve(spark, d):
    return metrics.curve(scored(spark, d)).select(digits(F.col("p")).alias("p"), "n_above", "tp", digits(F.col("precision")).alias("precision"), digits(F.col("recall")).alias("recall"))


@query(f"WITH {CURVE} SELECT round(coalesce(sum(precision * coalesce(pos / nullif(all_pos, 0)::DOUBLE, 0)), 0), 9) AS average_precision FROM curve")
def pr_curve_ap(spark, d):
    return metrics.average_precision(scored(spark, d)).select(digits(F.col("average_precision")).alias("average_precision"))


@query(f"WITH {CURVE} SELECT round(min(p) FILTER (WHERE precision >= 0.9), 9) AS tau_high, round(max(p) FILTER (WHERE recall >= 0.9), 9) AS tau_low FROM curve")
def thresholds(spark, d):
    return metrics.thresholds(scored(spark, d), 0.9, 0.9).select(digits(F.col("tau_high")).alias("tau_high"), digits(F.col("tau_low")).alias("tau_low"))


@query(f"WITH {SCORED} SELECT window_id, CASE WHEN p >= 0.7 THEN 'malicious' WHEN p >= 0.4 THEN 'suspicious' ELSE 'benign' END AS verdict, round(CASE WHEN p >= 0.7 THEN p WHEN p >= 0.4 THEN 0.5 ELSE 1 - p END, 9) AS confidence FROM scored")
def verdict_mapping(spark, d):
    v, c = metrics.verdict(F.col("p"), 0.4, 0.7)
    return scored(spark, d).select("window_id", v.alias("verdict"), digits(c).alias("confidence"))


@query(f"WITH {SCORED}, b AS (SELECT CAST(floor(window_id / 8) AS BIGINT) AS block, count(*) FILTER (WHERE (p >= 0.5) = y) AS ok, count(*) AS n FROM scored GROUP BY 1), k AS (SELECT row_number() OVER (ORDER BY block) - 1 AS b, ok, n, count(*) OVER () AS m FROM b), r AS (SELECT r, ('0x' || substr(md5(r || ':' || i), 1, 8))::BIGINT % (SELECT max(m) FROM k) AS b FROM range(200) x(r), range((SELECT max(m) FROM k)) y(i)), a AS (SELECT r, sum(ok) / sum(n)::DOUBLE AS acc FROM r JOIN k USING (b) GROUP BY r) SELECT count(*) AS replicates, round(avg(acc), 9) AS mean, round(quantile_cont(acc, 0.025), 9) AS low, round(quantile_cont(acc, 0.975), 9) AS high FROM a")
def block_bootstrap_ci(spark, d):
    return metrics.block_bootstrap(scored(spark, d)).select("replicates", *[digits(F.col(c)).alias(c) for c in ("mean", "low", "high")])


TYPED = f"{SCORED}, c AS (SELECT CAST(floor(t / 19200) AS BIGINT) AS window_id, label_type, count(*) AS n FROM flows WHERE label_binary GROUP BY 1, 2), top AS (SELECT window_id, label_type AS attack_type FROM c QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY n DESC, label_type) = 1)"


@query(f"WITH {TYPED} SELECT attack_type, count(*) AS n, round(avg(CASE WHEN p >= 0.5 THEN 1.0::DOUBLE ELSE 0 END), 9) AS recall FROM scored JOIN top USING (window_id) WHERE y GROUP BY 1")
def recall_by_attack_type(spark, d):
    s = scored(spark, d).where("y").join(windows.majority_type(read(spark, d)).drop("n"), "window_id")
    return s.groupBy("attack_type").agg(F.count("*").alias("n"), digits(F.avg((F.col("p") >= 0.5).cast("double"))).alias("recall"))


@query(f"WITH {SCORED} SELECT count(*) FILTER (WHERE NOT y AND p >= 0.5) AS fp, count(*) FILTER (WHERE NOT y) * 19200 / 3600.0::DOUBLE AS benign_hours, round(coalesce(count(*) FILTER (WHERE NOT y AND p >= 0.5) / nullif(count(*) FILTER (WHERE NOT y) * 19200 / 3600.0::DOUBLE, 0), 0), 9) AS fp_per_hour FROM scored")
def fp_per_benign_hour(spark, d):
    m = scored(spark, d).agg(F.count_if(~F.col("y") & (F.col("p") >= 0.5)).alias("fp"), (F.count_if(~F.col("y")) * 19200 / F.lit(3600.0)).alias("benign_hours"))
    return m.withColumn("fp_per_hour", digits(ratio(F.col("fp"), F.col("benign_hours"))))


@query(f"WITH {SEGMENTS}, hits AS (SELECT bin FROM dense WHERE n_attack >= 5) SELECT segment_id, first_bin, min(h.bin) - first_bin AS delay_bins FROM segs LEFT JOIN hits h ON h.bin BETWEEN first_bin AND last_bin WHERE attack GROUP BY 1, 2")
def detection_delay(spark, d):
    """Bins from each attack segment's begin to its first bin with five attacks; found by the segment's bins, not by comparing all."""
    f = read(spark, d)
    segs = windows.segments(windows.bin_labels(f)).where("attack")
    hits = windows.bins(f).where("n_attack >= 5").select("bin", F.col("bin").alias("hit"))
    each = spread(segs, "first_bin", "last_bin", "bin").select("segment_id", "first_bin", "bin").join(hits, "bin", "left")
    return each.groupBy("segment_id", "first_bin").agg((F.min("hit") - F.col("first_bin")).alias("delay_bins"))


@query(f"WITH {BINS}, w AS (SELECT bin, sum(n_attack) OVER t * 2 >= sum(n_flows) OVER t AS hot FROM dense WINDOW t AS (ORDER BY bin ROWS 3 PRECEDING)), f AS (SELECT hot <> lag(hot) OVER (ORDER BY bin) AS flip FROM w) SELECT count(flip) AS steps, count(*) FILTER (WHERE flip) AS flips FROM f")
def flip_rate(spark, d):
    from flowloom.operators.timeline import frame, own, with_halo

    cut = with_halo(windows.dense(windows.bins(read(spark, d))), "bin", 4)
    t = frame("bin").rowsBetween(-3, 0)
    hot = cut.withColumn("hot", F.sum("n_attack").over(t) * 2 >= F.sum("n_flows").over(t))
    flips = own(hot.withColumn("flip", F.col("hot") != F.lag("hot").over(frame("bin"))))
    return flips.agg(F.count("flip").alias("steps"), F.count_if("flip").alias("flips"))


@query(f"WITH {FLOWS} SELECT protocol, round(quantile_cont(duration_ms, 0.5), 6) AS p50, round(quantile_cont(duration_ms, 0.95), 6) AS p95, round(quantile_cont(duration_ms, 0.99), 6) AS p99, count(*) AS n FROM flows GROUP BY 1")
def latency_percentiles(spark, d):
    m = metrics.latency(read(spark, d), "protocol", "duration_ms")
    return m.select("protocol", *[digits(F.col(c), 6).alias(c) for c in ("p50", "p95", "p99")], "n")


# --- robustness, models, streams ---
@query(f"WITH {FLOWS}, k AS (SELECT * FROM flows WHERE ('0x' || substr(md5(flow_id), 1, 8))::BIGINT % 100 >= 10) SELECT CAST(floor(t / 600) AS BIGINT) AS bin, count(*) AS n_flows, CAST(sum(byte_count) AS BIGINT) AS sum_bytes, CAST(sum(packet_count) AS BIGINT) AS sum_packets, count(*) FILTER (WHERE label_binary) AS n_attack FROM k GROUP BY 1")
def robustness_dropout(spark, d):
    """Bins after a tenth of the flows, chosen by md5, is lost: a sampling operator by its nature."""
    h = F.conv(F.substring(F.md5("flow_id"), 1, 8), 16, 10).cast("long") % 100
    return windows.bins(read(spark, d).where(h >= 10))


def baseline(kind: str):
    def run(spark, d):
        from flowloom.operators import models

        t = windows.tail_labels(read(spark, d))
        rows = t.select("window_id", F.col("is_attack_window").alias("y"), F.col("head_attack_flows").cast("double").alias("head"), (F.col("window_total_flows") - F.col("tail_total_flows")).cast("double").alias("calm"))
        return models.fit_and_score(rows.where("window_id % 4 <> 0"), rows.where("window_id % 4 = 0"), ["head", "calm"], kind).select("window_id", "y", "p")

    return run


for _kind in ("forest", "boosted", "logistic"):
    QUERIES[f"baseline_{_kind}"] = baseline(_kind)


@query()
def synthetic_stream(spark, d):
    return sources.synthetic(spark)


@query(f"WITH {BINS}, last AS (SELECT max(t) AS t FROM flows) SELECT bin, n_flows, sum_bytes, sum_packets FROM bins, last WHERE (bin + 1) * 600 <= last.t - 1200")
def stream_bins(spark, d):
    """Closed bins of the events as a stream: all but those that the watermark hasn't passed."""
    from flowloom.operators.scratch import folder
    from flowloom.streaming import bins

    top = folder(spark)
    spark.read.parquet(f"{d}/events.parquet").repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{top}/in")
    closed = bins.closed_bins(bins.flow_stream(spark, f"{top}/in", 1000))
    return bins.run_to_table(closed, f"{top}/run").select("bin", "n_flows", "sum_bytes", "sum_packets")
