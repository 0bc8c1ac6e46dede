"""Axis arithmetic for charts: a few numbers on the driver."""

from __future__ import annotations

from bisect import bisect_left
from datetime import datetime, timedelta
from math import ceil, floor, inf, isfinite, log10
from zoneinfo import ZoneInfo

# Cadences of time ticks in seconds, and the most ticks on an axis.
CADENCES = (1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 10800, 21600, 43200, 86400)
MOST = 7


def _nice(x: float) -> float:
    """Least of 1, 2, 5, 10 times a power of ten that is not below ``x``."""
    power = 10.0 ** floor(log10(x))
    return next(m for m in (1, 2, 5, 10) if x / power <= m or m == 10) * power


def nice_ceil(x: float) -> float:
    return _nice(x) if isfinite(x) and x > 0 else 1


def tidy(x: float) -> float:
    whole = floor(x + 0.5)
    return whole if abs(x - whole) < 1e-9 else float(f"{x:.12g}")


def nice_ticks(lo: float, hi: float, target: int = 5) -> list[float]:
    if not (isfinite(lo) and isfinite(hi)):
        return []
    if hi <= lo:
        return [tidy(lo)]
    step = _nice((hi - lo) / max(1, target))
    out, v = [], floor(lo / step) * step
    while not out or v - step < hi:
        out.append(tidy(v))
        v += step
    return out


def int_ticks(lo: float, hi: float, target: int = 10) -> list[int]:
    a, b = floor(lo + 0.5), floor(hi + 0.5)
    if hi <= lo:
        return [a]
    if hi - lo <= target:
        return list(range(a, b + 1))
    return [int(v) for v in nice_ticks(lo, hi, min(target, 8)) if v == int(v)] or [a, b]


def time_ticks(lo: int, hi: int, zone: str = "UTC") -> list[int]:
    """Ticks between two millisecond times at the coarsest-needed cadence, on local boundaries."""
    if hi <= lo:
        return [lo]
    cadence = next((c for c in CADENCES if (hi - lo) / (c * 1000) <= MOST), CADENCES[-1]) * 1000
    start = datetime.fromtimestamp(lo / 1000, ZoneInfo(zone))
    if cadence < CADENCES[-1] * 1000:
        shift = int(start.utcoffset().total_seconds() * 1000)
        first = ceil((lo + shift) / cadence) * cadence - shift
        return list(range(first, hi + 1, cadence)) or [lo]
    day = start.replace(hour=0, minute=0, second=0, microsecond=0, tzinfo=None)
    at = lambda d: int(d.replace(tzinfo=ZoneInfo(zone)).timestamp() * 1000)
    if at(day) < lo:
        day += timedelta(days=1)
    out = []
    while at(day) <= hi:
        out.append(at(day))
        day += timedelta(days=1)
    return out or [lo]


def nearest_index(xs: list[float], v: float) -> int:
    """Place of the value of an ascending list that is nearest, the lower on ties; -1 for none."""
    if not xs:
        return -1
    k = min(max(bisect_left(xs, v), 1), len(xs) - 1) if len(xs) > 1 else 0
    return k if not k or abs(xs[k - 1] - v) > abs(xs[k] - v) else k - 1


def linear(domain: tuple[float, float], span: tuple[float, float]):
    (a, b), (x, y) = domain, span
    if b <= a:
        return lambda v: (x + y) / 2 if v == a else float("nan")
    return lambda v: x + (v - a) * (y - x) / (b - a) if isfinite(v) else float("nan")


def pad_domain(lo: float = inf, hi: float = -inf, flat: bool = False) -> tuple[float, float]:
    known = [v for v in (lo, hi) if isfinite(v)]
    if len(known) == 2 and hi > lo:
        return lo, hi
    if flat:
        top = lo if isfinite(lo) else 1
        return 0, top * 2 if top > 0 else 1
    return (known[0] - 0.5, known[-1] + 0.5) if known else (-1, 1)
