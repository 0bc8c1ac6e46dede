"""Largest-triangle decimation of line series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def keep(x: np.ndarray, y: np.ndarray, buckets: int) -> np.ndarray:
    """Places that stay: the ends, per bucket the point of the largest triangle with the point
    kept before and the next bucket's mean, and the extremes. Only finite points compete and
    count in means; a bucket without any keeps its first."""
    n = len(x)
    if buckets < 3 or n <= buckets + 2:
        return np.arange(n)
    ok = np.isfinite(y)
    edges = np.minimum(np.floor(np.arange(buckets) * ((n - 2) / (buckets - 2))).astype(int) + 1, n - 1)
    kept = [0]
    for lo, hi, nxt in zip(edges[:-2], edges[1:-1], edges[2:]):
        ahead = np.flatnonzero(ok[hi:nxt]) + hi
        mx, my = (x[ahead].mean(), y[ahead].mean()) if len(ahead) else (0.0, 0.0)
        last = kept[-1]
        ly = y[last] if ok[last] else 0.0
        area = np.abs((x[last] - mx) * (y[lo:hi] - ly) - (x[last] - x[lo:hi]) * (my - ly))
        area = np.where(np.isfinite(area), area, -1.0 if not len(ahead) else -np.inf)
        kept.append(lo + int(np.argmax(area)) if len(area) else lo)
    kept.append(n - 1)
    if ok.any():
        shown = np.where(ok, y, np.nan)
        kept += [int(np.nanargmin(shown)), int(np.nanargmax(shown))]
    return np.unique(kept)


def points_for(width: float) -> int:
    """Points that a line of a plot so wide is thinned to: one for two pixels, and 80 at least."""
    return max(80, int(np.floor(width / 2 + 0.5)))


def decimate(points: DataFrame, buckets: int, over: int = 200) -> DataFrame:
    """``points(session_id, pos, x, series, y)`` with long series thinned; those of ``over`` points or fewer stay.

    A series is one session's, so a group is bounded by the log's cap on a session's calls.
    """

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "pos"])
        if len(pdf) <= over:
            return pdf
        return pdf.iloc[keep(pdf.x.to_numpy(float), pdf.y.to_numpy(float), buckets)]

    rows = points.select("session_id", "pos", "x", "series", "y")
    return rows.groupBy("session_id", "series").applyInPandas(thin, rows.schema)
