"""Display formats. Fixed decimals round the binary value's exact decimal half up, which needs decimals."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from math import floor, isfinite

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "–"


def fixed(x: float, digits: int) -> str:
    return str(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def sig3(x: float) -> str:
    return fixed(x, 0 if x >= 100 else 1 if x >= 10 else 2)


def _whole(x: float) -> int:
    """Nearest integer, halves up."""
    return floor(x + 0.5)


def duration(ms: float | None) -> str:
    if ms is None:
        return DASH
    if ms < 1000:
        return f"{_whole(ms)}ms"
    if ms < 60_000:
        return fixed(ms / 1000, 2 if ms < 10_000 else 1) + "s"
    if ms < 3_600_000:
        return f"{int(ms // 60_000)}m{_whole(ms % 60_000 / 1000)}s"
    hours, minutes = divmod(_whole(ms / 60_000), 60)
    return f"{hours}h{minutes:02d}m"


def _ladder(x: float, units: list[tuple[float, str]], most: float) -> str:
    for size, unit in units[:-1]:
        if float(text := sig3(x / size)) < most:
            return text + unit
    size, unit = units[-1]
    return sig3(x / size) + unit


def tokens(n: int | None) -> str:
    if n is None:
        return DASH
    return str(n) if n < 10_000 else _ladder(n, [(1e3, "k"), (1e6, "M")], 1000)


def size(n: int | None) -> str:
    if n is None:
        return DASH
    return f"{n} B" if n < 1024 else _ladder(n, [(1024, " KB"), (1024**2, " MB"), (1024**3, " GB")], 1024)


def rate(x: float) -> str:
    return sig3(x) + " t/s" if isfinite(x) else DASH


def percent(part: float | None, base: float | None) -> str:
    return DASH if part is None or base is None or base <= 0 else sig3(part / base * 100) + "%"


def measure(text: str) -> tuple[str, str | None]:
    """Number and unit, parted at the last space."""
    head, _, unit = text.rpartition(" ")
    return (head, unit) if head and unit else (text, None)


# The same as columns. format_number rounds the binary value's exact decimal, halves to even; only multiples of a
# power of two can be halves, so those are moved up by less than the next one is away.


def _fixed(x: Column, digits: int) -> Column:
    whole = 1 << 20
    even = F.when(x * whole == F.floor(x * whole), x + 1e-7).otherwise(x)
    return F.replace(F.format_number(even, digits), F.lit(","), F.lit(""))


def _sig3(x: Column) -> Column:
    return F.when(x >= 100, _fixed(x, 0)).when(x >= 10, _fixed(x, 1)).otherwise(_fixed(x, 2))


def _nearest(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long").cast("string")


def _steps(x: Column, units: list[tuple[float, str]], most: float) -> Column:
    out = None
    for size_, unit in units[:-1]:
        t = _sig3(x / size_)
        fits = t.cast("double") < most
        out = F.when(fits, F.concat(t, F.lit(unit))) if out is None else out.when(fits, F.concat(t, F.lit(unit)))
    size_, unit = units[-1]
    last = F.concat(_sig3(x / size_), F.lit(unit))
    return last if out is None else out.otherwise(last)


def _or_dash(known: Column, text: Column) -> Column:
    return F.when(known, text).otherwise(F.lit(DASH))


def duration_text(ms: Column) -> Column:
    minutes = F.floor(ms / 60_000 + 0.5).cast("long")
    long = F.concat(F.floor(minutes / 60).cast("string"), F.lit("h"), F.lpad(F.pmod(minutes, F.lit(60)).cast("string"), 2, "0"), F.lit("m"))
    text = (
        F.when(ms < 1000, F.concat(_nearest(ms), F.lit("ms")))
        .when(ms < 10_000, F.concat(_fixed(ms / 1000, 2), F.lit("s")))
        .when(ms < 60_000, F.concat(_fixed(ms / 1000, 1), F.lit("s")))
        .when(ms < 3_600_000, F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m"), _nearest(F.pmod(ms, F.lit(60_000)) / 1000), F.lit("s")))
        .otherwise(long)
    )
    return _or_dash(ms.isNotNull(), text)


def tokens_text(n: Column) -> Column:
    text = F.when(n < 10_000, n.cast("long").cast("string")).otherwise(_steps(n, [(1e3, "k"), (1e6, "M")], 1000))
    return _or_dash(n.isNotNull(), text)


def size_text(n: Column) -> Column:
    text = F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(_steps(n, [(1024, " KB"), (1024**2, " MB"), (1024**3, " GB")], 1024))
    return _or_dash(n.isNotNull(), text)


def rate_text(tps: Column) -> Column:
    finite = tps.isNotNull() & ~F.isnan(tps) & (F.abs(tps) < float("inf"))
    return _or_dash(finite, F.concat(_sig3(tps), F.lit(" t/s")))


def percent_text(part: Column, base: Column) -> Column:
    return _or_dash(part.isNotNull() & (base > 0), F.concat(_sig3(part / base * 100), F.lit("%")))


def clock(ms, with_date: bool = False):
    """Local time of milliseconds in the session's zone: HH:mm, or with the date first."""
    return F.coalesce(F.date_format(F.timestamp_millis(ms), "MM-dd HH:mm" if with_date else "HH:mm"), F.lit(DASH))


def full_time(ms):
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss xxx")
