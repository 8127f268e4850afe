"""Wavelet bands of windows as array columns: decimated and undecimated transforms, synthesis and energies.

Convention: band coefficient k sums h[m] x[(2 k + m) mod n], periodic in the window.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Orthonormal scaling filters.
FILTERS = {
    "haar": (1 / math.sqrt(2), 1 / math.sqrt(2)),
    "db4": (0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278),
    "sym4": (0.03222310060407815, -0.012603967262263831, -0.09921954357695636, 0.29785779560560505, 0.8037387518052163, 0.497618667632563, -0.02963552764599851, -0.07576571478950221),
}


def high_pass(h: tuple[float, ...]) -> tuple[float, ...]:
    return tuple((-1) ** m * x for m, x in enumerate(reversed(h)))


def check(length: int, level: int, wavelet: str) -> None:
    """Fails for a length that isn't divisible by 2**level, and for more levels than the filter allows."""
    taps = len(FILTERS[wavelet])
    most = int(math.log2(length / (taps - 1))) if taps > 2 else int(math.log2(length))
    if length % 2**level or level > most:
        raise ValueError(f"{wavelet} on {length} bins: level {level} is not possible (at most {most}, length divisible by 2**level)")


def bands_of_rows(x: np.ndarray, wavelet: str, level: int, kind: str) -> dict[str, np.ndarray]:
    """Bands of each row of x."""
    low = np.array(FILTERS[wavelet])
    high, out, a = np.array(high_pass(FILTERS[wavelet])), {}, x
    for j in range(1, level + 1):
        n = a.shape[1]
        k = np.arange(n // 2) * 2 if kind == "dwt" else np.arange(n)
        at = (k[:, None] + np.arange(len(low)) * (1 if kind == "dwt" else 2 ** (j - 1))) % n
        out[f"cD{j}"], a = a[:, at] @ high, a[:, at] @ low
    return {f"cA{level}": a, **out}


def decompose(df: DataFrame, column: str, length: int, wavelet: str = "db4", level: int = 4, kind: str = "dwt") -> DataFrame:
    """Adds bands: a map of cA<level>, cD<level> ... cD1 to arrays. Windows are transformed batch by batch."""
    check(length, level, wavelet)

    @F.pandas_udf("map<string,array<double>>")
    def bands(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        found = bands_of_rows(np.stack(x.to_numpy()), wavelet, level, kind)
        return pd.Series([{name: rows[i].tolist() for name, rows in found.items()} for i in range(len(x))])

    return df.withColumn("bands", bands(column))


def reconstruct(df: DataFrame, length: int, wavelet: str = "db4", level: int = 4) -> DataFrame:
    """Adds rebuilt: the window from its decimated bands."""
    low, high = np.array(FILTERS[wavelet]), np.array(high_pass(FILTERS[wavelet]))

    @F.pandas_udf("array<double>")
    def rebuilt(bands: pd.Series) -> pd.Series:
        out = []
        for b in bands:
            b = dict(b)
            a = np.array(b[f"cA{level}"])
            for j in range(level, 0, -1):
                d, n = np.array(b[f"cD{j}"]), 2 * len(a)
                x = np.zeros(n)
                at = (np.arange(len(a))[:, None] * 2 + np.arange(len(low))) % n
                np.add.at(x, at, a[:, None] * low + d[:, None] * high)
                a = x
            out.append(a.tolist())
        return pd.Series(out)

    return df.withColumn("rebuilt", rebuilt("bands"))


def reconstruct_stationary(df: DataFrame, wavelet: str = "db4", level: int = 4) -> DataFrame:
    """Adds rebuilt: the window from its undecimated bands. Each level is the mean of the syntheses from both of its phases."""
    low, high = np.array(FILTERS[wavelet]), np.array(high_pass(FILTERS[wavelet]))

    @F.pandas_udf("array<double>")
    def rebuilt(bands: pd.Series) -> pd.Series:
        if not len(bands):
            return pd.Series([], dtype=object)
        each = [dict(b) for b in bands]
        a = np.stack([b[f"cA{level}"] for b in each])
        for j in range(level, 0, -1):
            d, n = np.stack([b[f"cD{j}"] for b in each]), a.shape[1]
            at = (np.arange(n)[:, None] - np.arange(len(low)) * 2 ** (j - 1)) % n
            a = (a[:, at] @ low + d[:, at] @ high) / 2
        return pd.Series(a.tolist())

    return df.withColumn("rebuilt", rebuilt("bands"))


def energy(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)


def window_arrays(spine: DataFrame, channels: list[str], span: int) -> DataFrame:
    """(window_id, channel, x): the channels of tumbling windows of ``span`` bins; only full windows."""
    each = spine.select(F.floor(F.col("bin") / span).alias("window_id"), "bin", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in channels])).alias("s"))
    rows = each.groupBy("window_id", "s.channel").agg(F.array_sort(F.collect_list(F.struct("bin", F.col("s.v").alias("v")))).alias("x"))
    return rows.where(F.size("x") == span).select("window_id", "channel", F.col("x.v").alias("x"))


def long_bands(bands: DataFrame) -> DataFrame:
    """(window_id, channel, band, k, coef)"""
    return bands.select("window_id", "channel", F.explode("bands").alias("band", "coefs")).select("window_id", "channel", "band", F.posexplode("coefs").alias("k", "coef"))
