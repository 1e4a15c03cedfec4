"""Peaks of a signal by wavelets: ridges of Mexican-hat coefficients across scales, bounds in the valleys, signal-to-noise from the finest scale."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: In points.
SCALES = (2, 3, 4, 6, 8, 12, 16)
#: Normal deviations of a median absolute deviation.
MAD = 1.4826
LEVEL = 0.9


def mexican_hat(scale: float) -> np.ndarray:
    """Over five scales to either side, with a sum of 0."""
    x = np.arange(-int(5 * scale), int(5 * scale) + 1) / scale
    w = (1 - x**2) * np.exp(-(x**2) / 2) * 2 / (np.sqrt(3 * scale) * np.pi**0.25)
    return w - w.mean()


def coefficients(y: np.ndarray, scales=SCALES) -> np.ndarray:
    """A row for each scale; beyond its ends the signal goes on as it ends."""
    out = np.empty((len(scales), len(y)))
    for k, s in enumerate(scales):
        w = mexican_hat(s)
        out[k] = np.convolve(np.pad(y, len(w) // 2, "edge"), w, "valid")
    return out


def ridges(c: np.ndarray, scales=SCALES) -> list[list[tuple[int, int]]]:
    """(scale number, place) of the positive maxima that belong together, from coarse to fine: each maximum is followed by the nearest free one of the next finer
    scale, the left one of two, if no further than that scale; stronger ridges choose first."""
    tops = [np.flatnonzero((r[1:-1] > r[:-2]) & (r[1:-1] >= r[2:]) & (r[1:-1] > 0)) + 1 for r in c]
    going, ended = [], []
    for k in range(len(scales) - 1, -1, -1):
        free, later = list(tops[k]), []
        for ridge in sorted(going, key=lambda r: -c[r[-1]]):
            near = [p for p in free if abs(p - ridge[-1][1]) <= scales[k]]
            if near:
                best = min(near, key=lambda p: (abs(p - ridge[-1][1]), p))
                free.remove(best)
                later.append([*ridge, (k, int(best))])
            else:
                ended.append(ridge)
        going = later + [[(k, int(p))] for p in free]
    return ended + going


def valley(y: np.ndarray, at: int, end: int) -> int:
    """Where the signal stops falling on the way from ``at`` to ``end``, both inclusive."""
    way = 1 if end >= at else -1
    path = y[at : end + 1] if way > 0 else y[end : at + 1][::-1]
    rises = np.flatnonzero(np.diff(path) > 0)
    return at + way * (int(rises[0]) if len(rises) else len(path) - 1)


def find(y: np.ndarray, scales=SCALES, least_snr: float = 3.0, least_ridge: int = 3) -> list[tuple[int, int, int, float, float]]:
    """(lo, hi, apex, scale, snr) of the peaks, in order of their apex. A ridge of at least ``least_ridge`` scales is a peak if its highest coefficient is
    ``least_snr`` times the noise, the median absolute deviation of the finest coefficients (a thousandth of the range at least). It reaches to the valleys of the signal smoothed over
    three points, three scales to either side at most. Peaks between whose apexes the signal stays level (``LEVEL`` of its height) are one, the strongest."""
    y = np.asarray(y, float)
    if len(y) < 5 or not np.ptp(y) > 0:
        return []
    c = coefficients(y, scales)
    noise = max(MAD * np.median(np.abs(c[0] - np.median(c[0]))), np.ptp(y) / 1000)
    m = np.convolve(np.pad(y, 1, "edge"), np.ones(3) / 3, "valid")
    found = []
    for ridge in ridges(c, scales):
        k, place = max(ridge, key=lambda x: c[x])
        snr = c[k, place] / noise
        if len(ridge) < least_ridge or snr < least_snr:
            continue
        reach = int(np.ceil(3 * scales[k]))
        near = slice(max(0, ridge[-1][1] - int(scales[0])), ridge[-1][1] + int(scales[0]) + 1)
        apex = near.start + int(np.argmax(m[near]))
        lo, hi = valley(m, apex, max(0, apex - reach)), valley(m, apex, min(len(y) - 1, apex + reach))
        found.append((lo, hi, apex, float(scales[k]), float(snr)))
    kept: list[tuple[int, int, int, float, float]] = []
    low = m.min()
    for p in sorted(found, key=lambda p: (-p[4], p[2])):
        same = [q for q in kept if m[min(p[2], q[2]) : max(p[2], q[2]) + 1].min() - low >= LEVEL * (max(m[p[2]], m[q[2]]) - low)]
        if same:  # the same top: it reaches as far as both
            q = same[0]
            kept[kept.index(q)] = (min(p[0], q[0]), max(p[1], q[1]), *q[2:])
        else:
            kept.append(p)
    return sorted(kept, key=lambda p: p[2])


def peaks(values: Column, scales=SCALES, least_snr: float = 3.0) -> Column:
    """The peaks of each signal, an array of structs."""

    @F.pandas_udf("array<struct<lo:int,hi:int,apex:int,scale:double,snr:double>>")
    def run(y: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("lo", "hi", "apex", "scale", "snr"), p, strict=True)) for p in find(v, scales, least_snr)] for v in y])

    return run(values)
