"""The service stream against SQL, and what a repeated trigger and a restart leave behind."""

import pytest
from test_catalogue import DATA
from test_catalogue import test_same_rows as same_rows

from flowloom.plans import catalogue, service
from flowloom.streaming.service import Rules, Service, answered_from_state


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n.startswith("serve_")])
def test_same(spark, name):
    same_rows(spark, name)


def batch(spark, *flows):
    """Requests for (flow_id, second, packets)."""
    body = '{"flow_id":"%s","tier":"fast","features":{"duration_ms":1.0,"byte_count":10.0,"packet_count":%d,"protocol":"TCP","entropy":0.5,"ja3_hash":null,"dns_before_ip":true},"timestamp":"2026-01-01T00:%02d:%02d"}'
    rows = [(k, body % (f, n, t // 60, t % 60) if t is not None else "{broken") for k, (f, t, n) in enumerate(flows)]
    return spark.createDataFrame(rows, "row_id long, request string")


def closed(s):
    start = min(r.bin for r in s.table("closed").collect())
    return sorted((r.generation, r.bin - start, r.n_flows, r.warm, r.verdict) for r in s.table("closed").collect())


def test_triggers(spark, tmp_path):
    s = Service(spark, f"file://{tmp_path}", Rules(delta=10, span=3, lateness=1, resets=3))
    s.step(batch(spark, ("a", 1, 50), ("a", 1, 50), ("b", 2, 1), ("c", 12, 50), ("x", None, 0)), 0)
    assert s.table("closed").count() == 0  # the clock is at 12: no bin is a bin behind it
    for _ in range(2):  # a repeated trigger leaves what one leaves
        s.step(batch(spark, ("a", 1, 50), ("d", 3, 50), ("e", 45, 1), ("e2", 45, 1)), 1)
        assert closed(s) == [(0, 0, 3, False, "benign"), (0, 1, 1, False, "benign"), (0, 2, 0, True, "malicious")]  # an idle bin too; a came before
        (state,) = s.table("state").collect()
        assert (state.generation, state.late, state.first_seen, state.verdict) == (0, 0, 6, "malicious")
    s.step(batch(spark, ("f", 4, 1), ("g", 47, 1)), 2)
    s.step(batch(spark, ("h", 4, 1), ("i", 5, 1)), 3)
    assert s.table("state").first().behind == 2 and s.table("state").first().late == 3
    s.step(batch(spark), 4)
    s.step(batch(spark, ("j", 6, 1)), 5)  # the third in a row: all starts anew
    (state,) = s.table("state").collect()
    assert (state.generation, state.behind, state.verdict) == (1, 0, None)
    s.step(batch(spark, ("k", 40, 60)), 6)
    assert [r for r in closed(s) if r[0] == 1] == [(1, 0, 1, False, "benign"), (1, 1, 0, False, "benign"), (1, 2, 0, True, "benign")]
    assert {r.counter: r.n for r in s.counters().collect()} == {"valid": 14, "rejected_flow_id": 1, "warm_up": 4, "first_seen": 12, "late": 3, "resets": 1}
    answers = {(r.row_id, r.status, r.verdict) for r in spark.read.parquet(f"file://{tmp_path}/answers/trigger=2").collect()}
    assert answers == {(0, 200, "malicious"), (1, 200, "malicious")}
    assert [r.error for r in s.table("dead").collect()] == ["flow_id"]


def test_a_trigger_has_as_many_tasks_as_the_session(spark):
    """Not a fixed number: its requests are dealt over the session's partitions, about evenly."""
    settings = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sizes = service.sent_in(service.fed(spark, DATA), 0).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(sizes) == 9 and max(sizes) < 3 * sum(sizes) / 9


def test_requests_are_parsed_once(spark):
    """A filter on valid doesn't go below the parsing, where each field that it looks at would parse the request again."""
    state = spark.createDataFrame([("TCP", "benign", 1.0)], "stream_id string, verdict string, confidence double")
    for df in (catalogue.QUERIES["contract_json_roundtrip"](spark, DATA), answered_from_state(batch(spark, ("a", 1, 50)), state)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
