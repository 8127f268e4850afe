"""Requests, tiers and streams against SQL; the state's restart after repeated flows from before."""

import pytest
from test_catalogue import test_same_rows as same_rows

from flowloom.plans import catalogue, serving
from flowloom.streaming.bins import WindowState

NAMES = ["contract_answers", "tier_fast", "tier_deep", "stream_bins_disturbed", "stream_verdicts", "stream_batch_parity", "stream_counters", "stream_late_counter", "csv_replay"]


@pytest.mark.parametrize("name", NAMES)
def test_same(spark, name):
    assert name in catalogue.ORACLES
    same_rows(spark, name)


def test_contract_payloads(spark):
    """The accepted and rejected payloads of the contract."""
    features = '"features":{"duration_ms":1.0,"byte_count":2,"packet_count":3,"protocol":"TCP","entropy":0.5,"ja3_hash":%s,"dns_before_ip":true},"timestamp":"2026-01-01T00:00:00Z"'
    ok = '{"flow_id":"f1","tier":"fast",' + features % '"0f1e2d3c"' + "}"
    rows = [(0, ok), (1, ok.replace('"0f1e2d3c"', "null")), (2, '{"flow_id":"f1","tier":"fast","features":{"duration_ms":1.0},"timestamp":"2026-01-01T00:00:00Z"}'), (3, ok.replace("fast", "slow")), (4, ok.replace("2026-01-01T00:00:00Z", "soon")), (5, ok.replace(":2,", ":-2,")), (6, ok.replace("}", ',"more":1}', 1)), (7, None), (8, "no json")]
    got = {r.id: (r.status, r.body) for r in serving.answers(spark.createDataFrame(rows, "id int, request string")).collect()}
    assert [got[i][0] for i in range(9)] == [200, 200, 422, 422, 422, 422, 200, 422, 422]
    assert got[0][1].startswith('{"flow_id":"f1","verdict":"') and got[3][1] == '{"detail":"tier"}'


def test_state_starts_anew_after_repeated_flows_from_before():
    state = WindowState(span=2, resets=3)
    assert state.add(10, 4, 4) == ("benign", 0.0)
    assert state.add(11, 4, 4) == ("malicious", 1.0)
    assert state.add(3, 1, 0) is None and state.add(4, 1, 0) is None  # behind: not counted
    assert state.add(5, 1, 0) == ("benign", 0.0) and state.seen == 1  # the third in a row: a replay
    assert state.add(9, 1, 0) == ("benign", 1.0)  # idle bins are zeros
