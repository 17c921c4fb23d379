"""Builders of small tables, with times as microseconds."""

from __future__ import annotations

import datetime as dt

from quotewright.contracts import BAR, SECOND

TICKS = "symbol string, ts long, seq long, bid double, ask double, mid double, spread double"
START = int(dt.datetime(2022, 1, 3, tzinfo=dt.UTC).timestamp()) * SECOND


def us(*parts: int) -> int:
    return int(dt.datetime(*parts, tzinfo=dt.UTC).timestamp()) * SECOND


def ticks(spark, rows, symbol="EURUSD"):
    """rows: (seconds after START, bid, ask)."""
    return spark.createDataFrame([(symbol, START + int(t * SECOND), i, b, a, (b + a) / 2, a - b) for i, (t, b, a) in enumerate(rows)], TICKS)


def bar_ticks(spark, offsets, bids, width=0.0002, symbol="EURUSD"):
    """One tick a bar, a second after each offset in minutes."""
    return ticks(spark, [(m * 60 + 1, b, b + width) for m, b in zip(offsets, bids, strict=True)], symbol)


def by(rows, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}


BAR_SECONDS = BAR // SECOND
