"""Requests and responses of the scoring contract: schemas, validation and the stub's answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.arithmetic import md5_mod10

FEATURES = "duration_ms double, byte_count double, packet_count double, protocol string, entropy double, ja3_hash string, dns_before_ip boolean"
REQUEST = f"flow_id string, tier string, features struct<{FEATURES.replace(' ', ':').replace(',:', ',')}>, timestamp string"
RESPONSE = "flow_id string, verdict string, confidence double, model_version string, latency_ms double"
VERSION = "flowloom-stub-0.0.0"


def stub_verdict(flow_id: Column) -> Column:
    """benign, suspicious or malicious by the digest of the id: 8 : 1 : 1."""
    r = md5_mod10(flow_id)
    return F.when(r < 8, "benign").when(r == 8, "suspicious").otherwise("malicious")


def confidence(verdict: Column) -> Column:
    return F.when(verdict == "suspicious", 0.5).otherwise(0.95)


def respond(requests: DataFrame) -> DataFrame:
    """Responses to valid requests (column flow_id)."""
    verdict = stub_verdict(F.col("flow_id"))
    return requests.select("flow_id", verdict.alias("verdict")).withColumns({"confidence": confidence(F.col("verdict")), "model_version": F.lit(VERSION), "latency_ms": F.lit(1.5)})


def error(r: Column) -> Column:
    """Why a parsed request is rejected; null if it isn't. Only ja3_hash may be null."""
    f = r["features"]
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf"))
    return (
        F.when(r.isNull() | r["flow_id"].isNull(), "flow_id")
        .when(r["tier"].isNull() | ~r["tier"].isin("fast", "deep"), "tier")
        .when(f.isNull(), "features")
        .when(~number(f["duration_ms"]), "duration_ms")
        .when(~number(f["byte_count"]), "byte_count")
        .when(~number(f["packet_count"]), "packet_count")
        .when(f["protocol"].isNull(), "protocol")
        .when(~number(f["entropy"]), "entropy")
        .when(f["dns_before_ip"].isNull(), "dns_before_ip")
        .when(r["timestamp"].isNull() | F.try_to_timestamp(r["timestamp"]).isNull(), "timestamp")
    )


def validated(raw: DataFrame, column: str = "request") -> DataFrame:
    """Adds parsed (struct), error and valid to rows of request JSON; unknown fields are ignored.

    The struct comes from explode of an array of one: a later filter on error or valid then stays behind the parsing, where a
    plain column would be parsed again for each of the fields that the filter looks at.
    """
    return raw.select("*", F.explode(F.array(F.from_json(column, REQUEST))).alias("parsed")).withColumn("error", error(F.col("parsed"))).withColumn("valid", F.col("error").isNull())
