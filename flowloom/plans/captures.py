"""Queries over capture files, from folders to reports: scan, inventory, checks, manifests, reports and intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators import audit, windows
from flowloom.operators.scratch import folder
from flowloom.plans.catalogue import FLOWS, query, read
from flowloom.sources import flows as sources


#: Tasks that write a day.
SALTS = 8
#: Rows of a capture file by ids, so that their number grows with the rows.
BLOCK = 1_000_000


def write_files(rows: DataFrame, path: str, ending: str = ".csv", header: bool = True) -> None:
    """Capture files (a fixture): the rows of each ``file`` in order of row_id, all files side by side."""
    spark = rows.sparkSession
    names = [c for c in rows.columns if c not in ("file", "row_id")]
    rows.repartition("file").sortWithinPartitions("file", "row_id").select(*names, "file").write.mode("append").option("header", header).option("ignoreLeadingWhiteSpace", False).partitionBy("file").csv(f"{path}/.parts")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    top = hadoop(f"{path}/.parts")
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder_ in store.listStatus(top):
        name = folder_.getPath().getName()
        if name.startswith("file="):
            for x in store.listStatus(folder_.getPath()):
                if x.getPath().getName().endswith(".csv"):
                    store.rename(x.getPath(), hadoop(f"{path}/{name.removeprefix('file=')}{ending}"))


def capture_folders(spark: SparkSession, d: str) -> list[str]:
    """The events as capture files: a, b and e with other orders of columns, d with rows of a again, c without some, junk, an
    absent folder. Each has a file for each BLOCK of ids: a.csv, a-1.csv and so on.
    """
    f = read(spark, d)
    raw = f.select(
        "row_id",
        F.col("flow_id").alias("Flow ID"),
        F.when(F.col("row_id") % 13 == 0, "never").when(F.col("row_id") % 2 == 0, F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("event_ts", "dd/MM/yyyy HH:mm:ss")).alias(" Timestamp"),
        F.col("label_type").alias(" Label"),
        F.when(F.col("row_id") % 17 == 0, F.lit("-5")).when(F.col("row_id") % 19 == 0, F.lit("much")).otherwise(F.lit("2000")).alias(" Flow Duration"),
        F.when(F.col("row_id") % 23 == 0, F.lit(0)).otherwise(F.col("packet_count")).alias(" Total Fwd Packets"),
        F.lit(0).alias(" Total Backward Packets"),
        F.col("byte_count").cast("double").alias("Total Length of Fwd Packets"),
        F.lit(1.0).alias(" Total Length of Bwd Packets"),
        F.when(F.col("protocol") == "TCP", 6).when(F.col("protocol") == "UDP", 17).otherwise(99).alias(" Protocol"),
        F.lit("x").alias(" Unused"),
    )
    names = [c for c in raw.columns if c != "row_id"]
    top, block = folder(spark), F.floor(F.col("row_id") / BLOCK)
    named = lambda name: F.concat(F.lit(name), F.when(block > 0, F.concat(F.lit("-"), block)).otherwise("")).alias("file")
    write_files(raw.where("row_id % 3 = 0").select("row_id", *names, named("a")), f"{top}/one")
    write_files(raw.where("row_id % 3 = 1").select("row_id", *names[::-1], named("b")), f"{top}/one")
    write_files(raw.where("row_id % 3 = 2").select("row_id", *names[3:], *names[:3], named("e")), f"{top}/one")
    write_files(raw.where("row_id % 30 = 2").select("row_id", *names[:4], named("c")), f"{top}/two")
    write_files(raw.where("row_id % 6 = 0").select("row_id", *names, named("d")), f"{top}/two")
    write_files(raw.agg(F.lit(0).alias("row_id"), F.lit("").alias("v"), F.lit("junk").alias("file")), f"{top}/two", header=False)
    return [f"{top}/one", f"{top}/two", f"{top}/absent"]


CAPTURE = f"""{FLOWS}, files(file, every, rest) AS (VALUES ('a', 3, 0), ('b', 3, 1), ('e', 3, 2), ('d', 6, 0)),
 cap AS (SELECT file || CASE WHEN row_id >= {BLOCK} THEN '-' || row_id // {BLOCK} ELSE '' END || '.csv' AS source_file, row_id, flow_id, CASE WHEN row_id % 13 <> 0 THEN date_trunc('second', event_ts) END AS event_ts, byte_count + 1 AS byte_count,
 CASE WHEN row_id % 23 = 0 THEN 0 ELSE packet_count END AS packet_count, CASE WHEN row_id % 17 = 0 THEN -0.005 WHEN row_id % 19 = 0 THEN NULL ELSE 2.0 END AS duration_ms,
 CASE WHEN protocol = 'ICMP' THEN '99' ELSE protocol END AS protocol, label_type <> 'BENIGN' AS label_binary, label_type FROM flows JOIN files ON row_id % every = rest)"""


def captured(spark: SparkSession, d: str) -> DataFrame:
    return sources.from_capture(sources.scan_all(spark, capture_folders(spark, d)))


@query(f"WITH {CAPTURE} SELECT source_file, flow_id, event_ts, byte_count, packet_count, CAST(duration_ms AS DOUBLE) AS duration_ms, protocol, label_binary, label_type FROM cap")
def capture_scan(spark, d):
    """All usable files of the folders by their own headers; others, junk and absent folders are skipped."""
    return captured(spark, d).select("source_file", "flow_id", "event_ts", "byte_count", "packet_count", "duration_ms", "protocol", "label_binary", "label_type")


PER_FILE = f"""{CAPTURE}, one AS (SELECT source_file, count(*) AS n_rows, count(*) FILTER (WHERE label_type = 'BENIGN') AS n_benign, count(*) - count(*) FILTER (WHERE label_type = 'BENIGN') AS n_attack,
 count(*) FILTER (WHERE event_ts IS NULL) AS unparsed, min(event_ts) AS first_seen, max(event_ts) AS last_seen, count(*) FILTER (WHERE duration_ms < 0) AS negative_duration, count(*) FILTER (WHERE packet_count = 0) AS zero_packets FROM cap GROUP BY 1),
 labels AS (SELECT source_file, '{{' || string_agg('"' || label_type || '":' || n, ',' ORDER BY label_type) || '}}' AS labels FROM (SELECT source_file, label_type, count(*) AS n FROM cap GROUP BY 1, 2) GROUP BY 1),
 per_file AS (SELECT one.*, labels, CAST(sum(n_rows) OVER (ORDER BY source_file) AS BIGINT) AS running_rows, CAST(sum(n_attack) OVER (ORDER BY source_file) AS BIGINT) AS running_attack FROM one JOIN labels USING (source_file))"""


@query(f"WITH {PER_FILE} SELECT *, printf('%.4f%%', 100.0 * unparsed / n_rows) AS unparsed_share FROM per_file")
def capture_inventory(spark, d):
    """Rows, labels, time range and faults of each file, with running totals and a formatted share."""
    return audit.by_file(captured(spark, d)).withColumn("unparsed_share", audit.percent(F.col("unparsed"), F.col("n_rows")))


@query(f"WITH {CAPTURE}, s AS (SELECT source_file, event_ts, lag(event_ts) OVER (PARTITION BY source_file ORDER BY row_id) AS prev FROM cap) SELECT source_file, count(prev) AS steps, count(*) FILTER (WHERE event_ts < prev) AS backwards, count(*) FILTER (WHERE event_ts = prev) AS repeats FROM s GROUP BY 1")
def capture_order(spark, d):
    """Steps back and repeats of the timestamp within each file."""
    return audit.order_breaks(captured(spark, d), "source_file")


@query(f"WITH {CAPTURE}, g AS (SELECT count(DISTINCT source_file) AS parts, count(*) AS n FROM cap GROUP BY flow_id, event_ts, byte_count, packet_count, duration_ms, protocol, label_type) SELECT parts, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows FROM g GROUP BY 1")
def capture_shared_rows(spark, d):
    """How many different whole rows occur in how many files."""
    return captured(spark, d).groupBy("flow_id", "event_ts", "byte_count", "packet_count", "duration_ms", "protocol", "label_type").agg(F.count_distinct("source_file").alias("parts"), F.count("*").alias("n")).groupBy("parts").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"))


@query(f"WITH {CAPTURE}, r AS (SELECT source_file AS f, min(event_ts) AS a, max(event_ts) AS b FROM cap GROUP BY 1) SELECT x.f AS x, y.f AS y, CAST(epoch(least(x.b, y.b)) AS BIGINT) - CAST(epoch(greatest(x.a, y.a)) AS BIGINT) AS overlap_s FROM r x JOIN r y ON x.f < y.f AND x.a <= y.b AND y.a <= x.b")
def capture_overlaps(spark, d):
    """Files whose time ranges overlap."""
    return audit.overlapping_ranges(captured(spark, d), "source_file")


@query(f"WITH {CAPTURE}, l AS (SELECT DISTINCT label_type FROM cap) SELECT label_type, row_number() OVER (ORDER BY label_type) - 1 AS code FROM l")
def capture_label_map(spark, d):
    """The distinct labels and their codes, by name."""
    from pyspark.sql import Window

    labels = captured(spark, d).select("label_type").distinct()
    return labels.withColumn("code", (F.row_number().over(Window.orderBy("label_type")) - 1).cast("long"))  # one row for each label


def manifest_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One JSON object for each file: path, size_bytes, rows, sha256 and labels; unreadable files have their error."""
    files = sources.files_in(spark, paths)
    rows = sources.scan_all(spark, paths)
    about = sources.manifest(spark, files).withColumn("source_file", F.element_at(F.split("path", "/"), -1))
    counts = audit.by_file(sources.from_capture(rows)).select("source_file", F.col("n_rows").alias("rows"), "labels") if rows is not None else spark.createDataFrame([], "source_file string, rows long, labels string")
    return about.join(counts, "source_file", "left").select("source_file", "path", "size_bytes", "rows", "sha256", F.from_json("labels", "map<string,long>").alias("labels"), "error")


@query(f"WITH {PER_FILE} SELECT source_file, n_rows AS rows, labels FROM per_file UNION ALL SELECT DISTINCT 'c' || CASE WHEN row_id >= {BLOCK} THEN '-' || row_id // {BLOCK} ELSE '' END || '.csv', NULL::BIGINT, NULL FROM flows WHERE row_id % 30 = 2 UNION ALL SELECT 'junk.csv', NULL, NULL")
def capture_manifest(spark, d):
    """The manifest written as JSON, one object a file, and read back (sizes and digests are tested apart)."""
    path = f"{folder(spark)}/manifest"
    manifest_of(spark, capture_folders(spark, d)).write.json(path)
    back = spark.read.schema("source_file string, rows long, labels map<string,long>").json(path)
    entries = F.array_sort(F.map_entries("labels"))
    text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"].cast("string"))), ","), F.lit("}"))
    return back.select("source_file", "rows", F.when(F.col("labels").isNotNull(), text).alias("labels"))


def lines_of(row: DataFrame, lines: dict[int, object]) -> DataFrame:
    """(place, line) of one row's lines."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("place"), c.alias("line")) for k, c in lines.items()])).alias("x")).select("x.place", "x.line")


def report_lines(flows: DataFrame, delta: int = 1, span: int = 256, tail: int = 16) -> DataFrame:
    """A Markdown report of the checks as (place, line): validity, labels and time, windows and a verdict."""
    head = lines_of(audit.validity(flows), {
        0: F.lit("# Dataset audit"),
        1: F.format_string("- rows: %d", "total_rows"),
        2: F.concat(F.format_string("- unparsable timestamps: %d (", "unparsed_timestamps"), audit.percent(F.col("unparsed_timestamps"), F.col("total_rows")), F.lit(")")),
        3: F.format_string("- negative durations: %d", "negative_duration"),
        4: F.format_string("- flows without packets: %d", "zero_packet_flows"),
    })
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    labels = audit.labels_and_time(flows).select(F.lit(5).alias("place"), F.concat(F.lit("- **"), "label_type", F.lit("**: "), F.col("n").cast("string"), F.lit(" flows from "), stamp("first_seen"), F.lit(" to "), stamp("last_seen")).alias("line"))
    w = windows.tail_labels(flows, delta, span, tail).agg(F.count("*").alias("n"), F.count_if("is_attack_window").alias("bad")).withColumn("good", F.col("n") - F.col("bad"))
    verdict = F.when((F.col("good") < 30) | (F.col("bad") < 30), "BLOCK").otherwise("PASS")
    ends = lines_of(w, {6: F.format_string("- windows benign:attack: %d:%d", "good", "bad"), 7: F.concat(F.lit("**Verdict: "), verdict, F.lit("**"))})
    return head.unionByName(labels).unionByName(ends)


@query(f"""WITH {CAPTURE}, v AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_ts IS NULL) AS u, count(*) FILTER (WHERE duration_ms < 0) AS neg, count(*) FILTER (WHERE packet_count = 0) AS z FROM cap),
 w AS (SELECT count(*) FILTER (WHERE a >= 5 AND 2 * a >= n) AS bad, count(*) AS n FROM (SELECT count(*) FILTER (WHERE t % 256 >= 240) AS n, count(*) FILTER (WHERE t % 256 >= 240 AND label_binary) AS a FROM (SELECT *, CAST(epoch(event_ts) AS BIGINT) AS t FROM cap WHERE event_ts IS NOT NULL) GROUP BY t // 256))
 SELECT 0 AS place, '# Dataset audit' AS line UNION ALL SELECT 1, '- rows: ' || n FROM v UNION ALL SELECT 2, '- unparsable timestamps: ' || u || ' (' || printf('%.4f%%', 100.0 * u / n) || ')' FROM v
 UNION ALL SELECT 3, '- negative durations: ' || neg FROM v UNION ALL SELECT 4, '- flows without packets: ' || z FROM v
 UNION ALL SELECT 5, '- **' || label_type || '**: ' || count(*) || ' flows from ' || strftime(min(event_ts), '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(max(event_ts), '%Y-%m-%d %H:%M:%S') FROM cap WHERE event_ts IS NOT NULL GROUP BY label_type
 UNION ALL SELECT 6, '- windows benign:attack: ' || (n - bad) || ':' || bad FROM w UNION ALL SELECT 7, '**Verdict: ' || CASE WHEN n - bad < 30 OR bad < 30 THEN 'BLOCK' ELSE 'PASS' END || '**' FROM w""")
def capture_report(spark, d):
    """The Markdown report written as text and read back, in parts by place."""
    path = f"{folder(spark)}/report"
    report_lines(captured(spark, d)).select(F.col("place").cast("string").alias("place"), F.col("line").alias("value")).write.partitionBy("place").text(path)
    return spark.read.text(path).select(F.col("place").cast("int").alias("place"), F.col("value").alias("line"))


@query(f"WITH {FLOWS} SELECT window_id, n AS window_total_flows, tn AS tail_total_flows, ta AS tail_attack_flows, CASE WHEN tn = 0 THEN 0.0 ELSE CAST(ta AS DOUBLE) / tn END AS tail_attack_fraction, ta >= 5 AND 2 * ta >= tn AS is_attack_window FROM (SELECT t // 256 AS window_id, count(*) AS n, count(*) FILTER (WHERE t % 256 >= 240) AS tn, count(*) FILTER (WHERE t % 256 >= 240 AND label_binary) AS ta FROM flows GROUP BY 1)")
def window_tail_label_256(spark, d):
    """Tumbling windows of 256 seconds labelled by their last 16: share of 0.5 and at least 5 attack flows."""
    return windows.tail_labels(read(spark, d), 1, 256, 16).drop("head_attack_flows")


@query(f"WITH {CAPTURE} SELECT source_file, CAST(event_ts AS DATE) AS day, count(*) AS n, CAST(sum(byte_count) AS BIGINT) AS total_bytes FROM cap WHERE CAST(event_ts AS DATE) = (SELECT min(CAST(event_ts AS DATE)) + 1 FROM cap) GROUP BY 1, 2")
def capture_interim_day(spark, d):
    """Capture files as Parquet by day; one day is read back, from its own folder only."""
    path = f"{folder(spark)}/interim"
    captured(spark, d).withColumn("day", F.to_date("event_ts")).repartition("day", F.pmod(F.xxhash64("row_id"), F.lit(SALTS))).write.partitionBy("day").parquet(path)
    back = spark.read.parquet(path)
    second = back.agg(F.date_add(F.min("day"), 1)).first()[0]
    return back.where(F.col("day") == F.lit(second)).groupBy("source_file", "day").agg(F.count("*").alias("n"), F.sum("byte_count").alias("total_bytes"))


@query("""WITH n AS (SELECT range AS id, range >= 1000 AS bad FROM range(1500)), h AS (SELECT *, ('0x' || substr(md5(id || ':0'), 1, 8))::BIGINT % 10000 AS h0, ('0x' || substr(md5(id || ':1'), 1, 8))::BIGINT % 10000 AS h1, ('0x' || substr(md5(id || ':2'), 1, 8))::BIGINT % 10000 AS h2 FROM n)
 SELECT 'flow-' || id AS flow_id, make_timestamp(1791021600000000 + CASE WHEN bad THEN 100000000 + id * 10000 ELSE id * 100000 END) AS timestamp,
 CASE WHEN bad THEN 1 + 9 * h0 / 10000.0::DOUBLE ELSE 10 + 490 * h0 / 10000.0::DOUBLE END AS duration_ms, CASE WHEN bad THEN 64 + h1 % 65 ELSE 100 + h1 % 9901 END AS byte_count,
 CASE WHEN bad THEN 1 + h2 % 3 ELSE 5 + h2 % 46 END AS packet_count, CASE WHEN bad THEN 'UDP' ELSE 'TCP' END AS protocol, CASE WHEN bad THEN 'attack' ELSE 'benign' END AS label FROM h""")
def synthetic_jsonl(spark, d):
    """The synthetic stream written as JSON lines and read back."""
    path = f"{folder(spark)}/stream"
    sources.synthetic(spark).write.json(path)
    back = spark.read.schema("flow_id string, timestamp timestamp, duration_ms double, byte_count long, packet_count long, protocol string, label string").json(path)
    return back.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
