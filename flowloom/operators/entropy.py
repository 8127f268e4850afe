"""Rolling Shannon entropy of wavelet bands: quantile edges, buckets, entropies and fixed-size tensors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.quantiles import exact

BUCKETS, SPAN = 16, 32


def edges(coefs: DataFrame, k: int = BUCKETS) -> DataFrame:
    """(channel, band, edges): k - 1 inner quantiles of the magnitudes, of the rows given (the training rows)."""
    sizes = coefs.select("channel", "band", F.round(F.abs("coef"), 9).alias("size"))
    return exact(sizes, ["channel", "band"], "size", [i / k for i in range(1, k)]).withColumnRenamed("quantiles", "edges")


def width(band: str, span: int = SPAN) -> int:
    """The window of a band: span over 2**level of the band, rounded half to even, at least 8."""
    return max(8, round(span / 2 ** int(band[2:])))


def bucket(x: Column, cuts: Column) -> Column:
    """The number of edges up to x."""
    return F.size(F.filter(cuts, lambda e: e <= x))


def entropy(values: Column, w: int, k: int = BUCKETS) -> Column:
    """Normalised entropy of w bucket numbers."""
    def term(i):
        p = F.size(F.filter(values, lambda v: v == i)) / float(w)
        return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), term), F.lit(0.0), lambda s, x: s + x) / math.log2(k)


def rolling_of_row(coefs: np.ndarray, cuts: np.ndarray, w: int, k: int) -> np.ndarray:
    """Entropies of all stretches of w coefficients: bucket counts by running sums."""
    codes = np.searchsorted(cuts, np.round(np.abs(coefs), 9) + 1e-10, "right")  # magnitudes count to 9 digits
    runs = np.cumsum(np.vstack([np.zeros(k), np.eye(k)[codes]]), axis=0)
    p = (runs[w:] - runs[:-w]) / w
    return -(np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0)).sum(axis=1) / math.log2(k)


def rolling(bands: DataFrame, cuts: DataFrame, span: int = SPAN, k: int = BUCKETS) -> DataFrame:
    """(window_id, channel, band, h): entropies at all positions where the band's window fits. Edges are few: one row a channel and band."""
    rows = bands.select("window_id", "channel", F.explode("bands").alias("band", "coefs")).join(F.broadcast(cuts), ["channel", "band"])

    @F.pandas_udf("array<double>")
    def series(band: pd.Series, coefs: pd.Series, edges: pd.Series) -> pd.Series:
        return pd.Series([rolling_of_row(c, e, width(b, span), k).tolist() for b, c, e in zip(band, coefs, edges, strict=True)])

    return rows.select("window_id", "channel", "band", series("band", "coefs", "edges").alias("h"))


def resampled(x: Column, size: int) -> Column:
    """Linear interpolation at ``size`` points from the first to the last value; constant for one value."""
    n = F.size(x)

    def at(t):
        pos = t * (n - 1) / float(size - 1)
        low = F.floor(pos).cast("int")
        a, b = F.element_at(x, low + 1), F.element_at(x, F.least(low + 2, n))
        return a + (b - a) * (pos - low)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)


def tensors(series: DataFrame, size: int = 16) -> DataFrame:
    """(window_id, channel, band, values): series at a common length, in single precision."""
    return series.select("window_id", "channel", "band", resampled(F.col("h"), size).cast("array<float>").alias("values"))


def quality(tensor: DataFrame) -> DataFrame:
    """Per channel and band: values that aren't finite or lie outside 0..1, least, largest and variance."""
    v = tensor.select("channel", "band", F.explode(F.col("values").cast("array<double>")).alias("v"))
    return v.groupBy("channel", "band").agg(F.count_if(F.isnan("v") | ~F.col("v").between(0, 1)).alias("bad"), F.min("v").alias("least"), F.max("v").alias("most"), F.var_pop("v").alias("variance"))


def channel_stats(tensor: DataFrame) -> DataFrame:
    """(channel, mean, sd) of all cells of tensors: those of training windows."""
    return tensor.select("channel", F.explode(F.col("values").cast("array<double>")).alias("v")).groupBy("channel").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))


def normalised(tensor: DataFrame, stats: DataFrame) -> DataFrame:
    """Values less the mean, over the standard deviation, of ``channel_stats``: a row for each channel."""
    by = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    return tensor.join(F.broadcast(stats), "channel").select("window_id", "channel", "band", F.transform("values", lambda v: (v - F.col("mean")) / by).alias("values"))


def stacked(tensor: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """(window_id, x): channels x bands x time as nested arrays; bands from the coarsest to the finest."""
    level = -F.substring("band", 3, 9).cast("int")
    order = F.when(F.col("band").startswith("cA"), level - 1).otherwise(level)
    rows = tensor.groupBy("window_id", "channel").agg(F.array_sort(F.collect_list(F.struct(order.alias("order"), "values"))).alias("rows"))
    place = F.array_position(F.array(*map(F.lit, channels)), F.col("channel"))
    one = rows.select("window_id", F.struct(place.alias("place"), F.transform("rows", lambda r: r["values"]).alias("rows")).alias("c"))
    return one.groupBy("window_id").agg(F.array_sort(F.collect_list("c")).alias("cs")).select("window_id", F.transform("cs", lambda c: c["rows"]).alias("x"))
