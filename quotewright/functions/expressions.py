"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contracts import BAR


def bucket(ts: Column | str, width: int = BAR) -> Column:
    """Start of the half-open interval that holds ``ts``."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ts - F.pmod(ts, F.lit(width).cast("long"))


def finite(c: Column) -> Column:
    """False for null, NaN and infinities."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def holds(c: Column) -> Column:
    """The predicate with null as false."""
    return F.coalesce(c, F.lit(False))


def price_check(c: Column, *prices: Column) -> Column:
    """A comparison of prices that NaN never fulfils, as IEEE comparisons do; Spark orders NaN above all numbers."""
    for p in prices:
        c = c & ~F.isnan(p)
    return holds(c)


def ratio(n: Column, d: Column, empty: float = 0.0) -> Column:
    """``n / d``, and ``empty`` where ``d`` is zero."""
    return F.when(d != 0, n / d).otherwise(F.lit(empty))


def imbalance(up: Column, down: Column) -> Column:
    """(up - down) / (up + down), and 0 where both are 0."""
    return ratio((up - down).cast("double"), (up + down).cast("double"))


def action(long: Column, short: Column, threshold: float = 0.0) -> Column:
    """flat unless the greater return exceeds the threshold; a tie above it is short."""
    return F.when(F.greatest(long, short) <= threshold, "flat").when(long > short, "long").otherwise("short")


def realized(act: Column, long: Column, short: Column) -> Column:
    return F.when(act == "long", long).when(act == "short", short).otherwise(F.lit(0.0))


def lot_weight(horizon: Column, symbols: int = 8, horizons: int = 3) -> Column:
    """Capital share of one lot: equal sleeves, each spread over the lots open at a time."""
    return F.lit(1.0) / symbols / horizons / (horizon.cast("double") / 5)


def elapsed_seconds_log1p(seconds: Column) -> Column:
    """The logarithm of one plus a bar's elapsed seconds; null stays null, a negative or non-finite value is an error."""
    valid = (seconds >= 0) & finite(seconds)
    return F.when(seconds.isNull(), F.lit(None).cast("double")).when(valid, F.log1p(seconds)).otherwise(F.raise_error(F.lit("elapsed seconds must be finite and not negative")).cast("double"))
