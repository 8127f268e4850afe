"""Entropy tensors of a stream's last window, kept up to date bin by bin, and the same from scratch for all windows of a batch.

A window's coefficients whose filter doesn't wrap around its end are those of the whole stream at the same place, whatever the
window: each is computed once, when its last bin closes, and so are its bucket and the entropies that end with it. Only the few
that wrap belong to one window and are computed for it. Both forms use the same filters, edges and rounding.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators.entropy import BUCKETS, rolling_of_row, width
from flowloom.operators.timeline import CHUNK, with_halo
from flowloom.operators.wavelets import FILTERS, bands_of_rows, check, high_pass

CHANNELS = ("len", "rate_pkts", "rate_flows")
TENSORS = "stream_id string, bin long, channel string, band string, values array<double>, p double"


def codes_of(coefs: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bucket numbers; magnitudes count to 9 digits, as everywhere."""
    return np.searchsorted(cuts, np.round(np.abs(coefs), 9) + 1e-10, "right")


def entropies(codes: np.ndarray, w: int, k: int = BUCKETS) -> np.ndarray:
    """Normalised entropies of all stretches of w bucket numbers."""
    if len(codes) < w:
        return np.zeros(0)
    runs = np.cumsum(np.vstack([np.zeros(k), np.eye(k)[codes]]), axis=0)
    p = (runs[w:] - runs[:-w]) / w
    return -(np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0)).sum(axis=1) / math.log2(k)


def at_length(series: np.ndarray, size: int) -> np.ndarray:
    """Linear interpolation at ``size`` points from the first to the last value."""
    return np.interp(np.linspace(0, len(series) - 1, size), np.arange(len(series)), series)


def attack_probability(values: list[np.ndarray]) -> float:
    """The stand-in for a trained model: a logistic function of the mean entropy."""
    return 1 / (1 + math.exp(8 * (float(np.mean([v.mean() for v in values])) - 0.5)))


class RollingBands:
    """The last ``span`` values of one channel, with what later windows share: coefficients, buckets and entropies by place."""

    def __init__(self, cuts: dict[str, np.ndarray], wavelet: str, level: int, span: int):
        check(span, level, wavelet)
        self.low, self.high = np.array(FILTERS[wavelet]), np.array(high_pass(FILTERS[wavelet]))
        self.cuts, self.level, self.span, self.size = cuts, level, span, 2 * span
        self.names = [f"cD{j}" for j in range(1, level + 1)] + [f"cA{level}"]
        self.count = 0
        self.means = np.zeros((level + 1, self.size))
        self.codes, self.entropy = np.zeros((level + 1, self.size), np.int64), np.zeros((level + 1, self.size))
        self.details = np.zeros((level + 1, self.size))

    def save(self) -> dict[str, np.ndarray]:
        return {"count": np.array(self.count), "means": self.means, "details": self.details, "codes": self.codes, "entropy": self.entropy}

    def load(self, held: dict[str, np.ndarray]) -> RollingBands:
        self.count = int(held["count"])
        for name in ("means", "details", "codes", "entropy"):
            setattr(self, name, held[name].copy())
        return self

    def push(self, x: float) -> None:
        """Takes the next bin's value: one new coefficient, bucket and entropy for each band."""
        at, taps, ring = self.count, len(self.low), self.size
        self.means[0, at % ring] = x
        self.count += 1
        for j in range(1, self.level + 1):
            place = at - (taps - 1) * (2**j - 1)  # the last whose filter has all of its bins
            if place < 0:
                break
            seen = self.means[j - 1, (place + np.arange(taps) * 2 ** (j - 1)) % ring]
            self.means[j, place % ring], self.details[j, place % ring] = seen @ self.low, seen @ self.high
            for b, value in ((j - 1, self.details[j, place % ring]), *([(self.level, self.means[j, place % ring])] if j == self.level else [])):
                self.codes[b, place % ring] = codes_of(np.array([value]), self.cuts[self.names[b]])[0]
                w = width(self.names[b])
                first = place - (w - 1) * 2**j
                if first >= 0:
                    self.entropy[b, first % ring] = entropies(self.codes[b, (first + np.arange(w) * 2**j) % ring], w)[0]

    def series(self) -> dict[str, np.ndarray] | None:
        """The entropies of each band over the last whole window; None before there is one."""
        if self.count < self.span:
            return None
        start, taps, ring = self.count - self.span, len(self.low), self.size
        a, out = self.means[0, (start + np.arange(self.span)) % ring], {}
        for j in range(1, self.level + 1):
            n, step = len(a) // 2, 2**j
            whole = min(n, max(0, (self.span - 1 - (taps - 1) * (step - 1)) // step + 1))
            places = (start + np.arange(whole) * step) % ring
            wrapped = a[(2 * np.arange(whole, n)[:, None] + np.arange(taps)) % len(a)]
            for b, tail in ((j - 1, wrapped @ self.high), *([(self.level, wrapped @ self.low)] if j == self.level else [])):
                w = width(self.names[b])
                done = max(0, whole - w + 1)
                codes = np.append(self.codes[b, places[done:]], codes_of(tail, self.cuts[self.names[b]]))
                out[self.names[b]] = np.append(self.entropy[b, places[:done]], entropies(codes, w))
            a = np.append(self.means[j, places], wrapped @ self.low)
        return out


def signal(n_flows: float, sum_bytes: float, sum_packets: float) -> tuple[float, float, float]:
    return (sum_bytes / sum_packets if sum_packets else 0.0, math.log1p(sum_packets), math.log1p(n_flows))


def rows_of(stream: str, bin_: int, series: dict[str, dict[str, np.ndarray]], size: int) -> list[tuple]:
    values = {(c, b): at_length(h, size) for c, bands in series.items() for b, h in bands.items()}
    p = attack_probability(list(values.values()))
    return [(stream, bin_, c, b, v.tolist(), p) for (c, b), v in values.items()]


def tensors_online(closed: DataFrame, cuts: dict[str, dict[str, np.ndarray]], wavelet: str = "haar", level: int = 4, span: int = 256, size: int = 16) -> DataFrame:
    """A tensor (one row a channel and band) and a probability for each closed bin of a stream, from kept state.

    closed: a stream of bins (bin, n_flows, sum_bytes, sum_packets; stream_id or one stream), in order from trigger to trigger.
    Idle bins are zeros and have their tensors too. Bins that come again or behind are left out.
    """

    def answer(key, parts, state) -> Iterator[pd.DataFrame]:
        rolling, last = {c: RollingBands(cuts[c], wavelet, level, span) for c in CHANNELS}, None
        if state.exists:
            last, held = state.get
            saved = np.load(io.BytesIO(held))
            for c in CHANNELS:
                rolling[c].load({k.removeprefix(f"{c}."): saved[k] for k in saved.files if k.startswith(f"{c}.")})
        out = []
        for row in sorted((r for pdf in parts for r in pdf.itertuples(index=False)), key=lambda r: r.bin):
            if last is not None and row.bin <= last:
                continue
            for bin_ in range(row.bin if last is None else last + 1, row.bin + 1):
                values = signal(row.n_flows, row.sum_bytes, row.sum_packets) if bin_ == row.bin else (0.0, 0.0, 0.0)
                for c, x in zip(CHANNELS, values, strict=True):
                    rolling[c].push(x)
                if rolling[CHANNELS[0]].count >= span:
                    out += rows_of(key[0], bin_, {c: rolling[c].series() for c in CHANNELS}, size)
                if len(out) > 4096:
                    yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in TENSORS.split(", ")])
                    out = []
            last = row.bin
        if last is not None:
            buffer = io.BytesIO()
            np.savez(buffer, **{f"{c}.{k}": v for c in CHANNELS for k, v in rolling[c].save().items()})
            state.update((last, buffer.getvalue()))
        yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in TENSORS.split(", ")])

    keyed = closed if "stream_id" in closed.columns else closed.withColumn("stream_id", F.lit("all"))
    return keyed.select("stream_id", "bin", "n_flows", "sum_bytes", "sum_packets").groupBy("stream_id").applyInPandasWithState(answer, TENSORS, "last long, held binary", "append", "NoTimeout")


def tensors_of_batch(signals: DataFrame, cuts: dict[str, dict[str, np.ndarray]], wavelet: str = "haar", level: int = 4, span: int = 256, size: int = 16) -> DataFrame:
    """The same rows for all windows of a dense spine (bin and the channels), each window from scratch; in chunks with a halo."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        out = []
        if len(pdf) >= span:
            found = {c: bands_of_rows(np.lib.stride_tricks.sliding_window_view(pdf[c].to_numpy(), span), wavelet, level, "dwt") for c in CHANNELS}
            for k in np.flatnonzero(pdf["__own"].to_numpy()[span - 1 :]):
                series = {c: {b: rolling_of_row(rows[k], cuts[c][b], width(b), BUCKETS) for b, rows in bands.items()} for c, bands in found.items()}
                out += rows_of("all", int(pdf["bin"].iloc[k + span - 1]), series, size)
        return pd.DataFrame(out, columns=[f.split(" ")[0] for f in TENSORS.split(", ")])

    return with_halo(signals.select("bin", *CHANNELS), "bin", span - 1, CHUNK).groupBy("__chunk").applyInPandas(work, TENSORS)


def cuts_of(edges: DataFrame) -> dict[str, dict[str, np.ndarray]]:
    """Edges (channel, band, edges) by channel and band: a row for each, few by their nature."""
    out: dict[str, dict[str, np.ndarray]] = {c: {} for c in CHANNELS}
    for r in edges.collect():
        out[r.channel][r.band] = np.array(r.edges)
    return out
