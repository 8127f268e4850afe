from flowloom.streaming.bins import WindowState


def test_cold_start_gap_and_reset():
    w = WindowState(span=3, resets=2)
    assert w.add(10, 4, 4) == ("benign", 0.0)
    assert w.add(13, 4, 4) == ("malicious", 1.0)  # the empty bins count as zeros
    assert w.add(12, 1, 0) is None
    assert w.add(12, 1, 0) == ("benign", 0.0)  # behind twice in a row: starts anew
