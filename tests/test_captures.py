"""Capture files: manifests with sizes and digests, odd files, order of rows, and each query against its SQL."""

import hashlib
import json

import pytest
from test_catalogue import test_same_rows as same_rows

from flowloom.operators import audit
from flowloom.plans import captures, catalogue
from flowloom.sources import flows


@pytest.mark.parametrize("name", [n for n in catalogue.ORACLES if n.startswith(("capture_", "synthetic_jsonl", "window_tail_label_256"))])
def test_same(spark, name):
    same_rows(spark, name)


def test_manifest(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x" * 3_000_000)
    (tmp_path / "empty.csv").write_bytes(b"")
    rows = {r.path: r for r in flows.manifest(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/empty.csv", f"{tmp_path}/none.csv"], chunk=1 << 20).collect()}
    a = rows[f"{tmp_path}/a.csv"]
    assert (a.size_bytes, a.sha256, a.error) == (3_000_000, hashlib.sha256(b"x" * 3_000_000).hexdigest(), None) and abs(a.size_mib - 3e6 / 2**20) < 1e-9
    assert rows[f"{tmp_path}/empty.csv"].size_bytes == 0
    assert rows[f"{tmp_path}/none.csv"].error == "FileNotFoundError" and rows[f"{tmp_path}/none.csv"].sha256 is None
    assert flows.scan_all(spark, [str(tmp_path), f"{tmp_path}/absent"]) is None
    got = [json.loads(x) for x in captures.manifest_of(spark, [str(tmp_path)]).toJSON().collect()]
    assert sorted(x["source_file"] for x in got) == ["a.csv", "empty.csv"]


def test_order_breaks_with_gaps_in_ids(spark):
    rows = [(1, "2020-01-01 00:00:01"), (10, "2020-01-01 00:00:03"), (5000, "2020-01-01 00:00:02"), (9000, "2020-01-01 00:00:02"), (10**9, None)]
    df = spark.createDataFrame(rows, "row_id long, event_ts string").selectExpr("row_id", "CAST(event_ts AS timestamp) AS event_ts")
    assert tuple(audit.order_breaks(df).first()) == (4, 1, 1)
