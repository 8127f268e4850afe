"""Flow records from the events table, from capture CSV files, and from a generator; manifests of input files."""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.timestamps import parse

BENIGN = "BENIGN"
#: Columns that a capture file must have.
REQUIRED = ("Timestamp", "Label", "Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets", "Total Length of Bwd Packets", "Protocol", "Flow ID")
TYPES = dict(zip(REQUIRED, ("string", "string", "bigint", "bigint", "bigint", "double", "double", "int", "string"), strict=True))


def from_events(events: DataFrame) -> DataFrame:
    """Flow records of the events table."""
    kind = F.when(F.col("event_type").isin("view", "signup"), BENIGN).otherwise(F.col("event_type"))
    return events.select(
        F.col("event_id").alias("row_id"),
        F.concat(F.lit("flow-"), F.col("event_id")).alias("flow_id"),
        F.col("ts").alias("event_ts"),
        F.floor(F.col("value") * 100 + 0.5).alias("byte_count"),
        (1 + F.col("event_id") % 50).alias("packet_count"),
        F.get_json_object("props", "$.k").cast("double").alias("duration_ms"),
        F.element_at(F.array(F.lit("TCP"), F.lit("UDP"), F.lit("ICMP")), (F.col("user_id") % 3 + 1).cast("int")).alias("protocol"),
        (kind != BENIGN).alias("label_binary"),
        kind.alias("label_type"),
    )


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def files_in(spark: SparkSession, paths: list[str], ending: str = ".csv") -> list[str]:
    """The files with an ending in folders, and files named as such, in order. Absent paths are skipped."""
    out = []
    for path in paths:
        top = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = top.getFileSystem(spark._jsc.hadoopConfiguration())
        if store.exists(top):
            out += [str(x.getPath().toString()) for x in store.listStatus(top) if x.isFile() and x.getPath().getName().endswith(ending)]
    return sorted(out)


def header_of(spark: SparkSession, file: str) -> list[str] | None:
    """The column names of a CSV file as they stand there; None if it can't be read or is empty."""
    from pyspark.errors import PySparkException

    try:
        return spark.read.option("header", True).csv(file).columns or None
    except PySparkException:
        return None


def headers(spark: SparkSession, paths: list[str], at_once: int = 16) -> dict[str, list[str] | None]:
    """The column names of all CSV files in folders; Spark reads the first line of up to ``at_once`` files at a time."""
    files = files_in(spark, paths)
    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(files, pool.map(lambda f: header_of(spark, f), files), strict=True))


def schemas(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_file, place, name, required, usable): each file's columns in order, whether they are needed, and whether the file
    has all that are. Files that can't be read have no rows.
    """
    rows = []
    for file, names in headers(spark, paths).items():
        trimmed = [c.strip() for c in names or []]
        rows += [(file.rsplit("/", 1)[-1], k, c, c in REQUIRED, not set(REQUIRED) - set(trimmed)) for k, c in enumerate(trimmed)]
    return spark.createDataFrame(rows, "source_file string, place int, name string, required boolean, usable boolean")


def scan_all(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The rows of all capture files in folders: the required columns with their types, and where they come from.

    Names are trimmed. Files are read by their own headers, one scan for all files with the same one, whatever the order of
    their columns; a file without a required column or that can't be read is skipped, as is an absent path. Cells that don't
    parse are null. source_file is the file's name; source_block and row_id order its rows. None without any such file.
    """
    alike: dict[tuple[str, ...], list[str]] = {}
    for file, names in headers(spark, paths).items():
        if names and not set(REQUIRED) - {c.strip() for c in names}:
            alike.setdefault(tuple(names), []).append(file)
    out = None
    for names, files in alike.items():
        raw = spark.read.option("header", True).option("mode", "PERMISSIVE").schema(", ".join(f"`c{k}` string" for k in range(len(names)))).option("enforceSchema", True).csv(files)
        place = {c.strip(): k for k, c in reversed(list(enumerate(names)))}
        one = raw.select(*[F.expr(f"try_cast(c{place[c]} AS {t})").alias(c) for c, t in TYPES.items()], F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("source_block"))
        out = one if out is None else out.unionByName(one)
    return None if out is None else out.withColumn("row_id", F.monotonically_increasing_id())


def scan_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """One capture file or folder; see ``scan_all``."""
    return scan_all(spark, [path])


def from_capture(raw: DataFrame) -> DataFrame:
    """Flow records of capture rows, with source_file and source_block; protocol numbers get names.

    row_id numbers the rows of the scan: equal rows keep their own, in the order of their file.
    """
    names = F.create_map(*[F.lit(x) for pair in ((1, "ICMP"), (6, "TCP"), (17, "UDP")) for x in pair])
    return raw.select(
        "row_id",
        F.col("Flow ID").alias("flow_id"),
        parse(F.col("Timestamp")).alias("event_ts"),
        (F.col("Total Length of Fwd Packets") + F.col("Total Length of Bwd Packets")).cast("long").alias("byte_count"),
        (F.col("Total Fwd Packets") + F.col("Total Backward Packets")).alias("packet_count"),
        (F.col("Flow Duration") / 1000.0).alias("duration_ms"),
        F.coalesce(names[F.col("Protocol")], F.col("Protocol").cast("string")).alias("protocol"),
        (F.col("Label") != BENIGN).alias("label_binary"),
        F.col("Label").alias("label_type"),
        "source_file",
        "source_block",
    )


def manifest(spark: SparkSession, paths: list[str], chunk: int = 8 << 20) -> DataFrame:
    """path, size_bytes, size_mib, sha256 and error of files, read in chunks by the workers (local or mounted paths).

    A file that can't be read has an error and nulls; the others are not affected.
    """

    def digest(batches):
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                h, n = hashlib.sha256(), 0
                try:
                    with open(path.removeprefix("file://").removeprefix("file:"), "rb") as f:
                        while part := f.read(chunk):
                            h.update(part)
                            n += len(part)
                    rows.append((path, n, n / 2**20, h.hexdigest(), None))
                except OSError as e:
                    rows.append((path, None, None, None, type(e).__name__))
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "size_bytes", "size_mib", "sha256", "error"])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInArrow(digest, "path string, size_bytes long, size_mib double, sha256 string, error string")


def synthetic(spark: SparkSession, benign: int = 1000, attack: int = 500) -> DataFrame:
    """A stream of benign TCP flows at 10 a second, then a burst of UDP attack flows at 100 a second; the same each time."""
    n = spark.range(benign + attack)
    bad = F.col("id") >= benign
    h = lambda k: F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{k}")).cast("binary")), 1, 8), 16, 10).cast("long") % 10_000
    micros = F.when(bad, 100_000_000 + F.col("id") * 10_000).otherwise(F.col("id") * 100_000)
    return n.select(
        F.concat(F.lit("flow-"), F.col("id")).alias("flow_id"),
        F.timestamp_micros(F.lit(1_791_021_600_000_000) + micros).alias("timestamp"),
        F.when(bad, 1 + 9 * h(0) / 10_000).otherwise(10 + 490 * h(0) / 10_000).alias("duration_ms"),
        F.when(bad, 64 + h(1) % 65).otherwise(100 + h(1) % 9901).alias("byte_count"),
        F.when(bad, 1 + h(2) % 3).otherwise(5 + h(2) % 46).alias("packet_count"),
        F.when(bad, "UDP").otherwise("TCP").alias("protocol"),
        F.when(bad, "attack").otherwise("benign").alias("label"),
    )
