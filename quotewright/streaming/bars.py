"""Watermark-final quote bars from a receipt-time stream.

A bar is final when its symbol's next tick of a later interval is received. Spark's own watermark is one for the
whole query and drops late rows silently; here each symbol has its own, and late or repeated input ends that symbol's
stream with an error row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..contracts import BAR, COMPUTE_ALLOWANCE, PRICES

RECEIPT_SCHEMA = "symbol string, provider_ts long, received_at long, ingest_seq long, bid double, ask double, mid double, spread double"
OPEN = ["bar_start", "first_tick", "last_tick", *[f"{p}_{k}" for p in PRICES for k in ("open", "high", "low", "close")], "spread_sum", "quote_count", "first_received_at", "last_received_at", "first_ingest_seq", "last_ingest_seq"]
_LONG = {"bar_start", "first_tick", "last_tick", "quote_count", "first_received_at", "last_received_at", "first_ingest_seq", "last_ingest_seq"}
STATE_SCHEMA = "failed boolean, last_provider long, last_received long, last_seq long, open boolean, " + ", ".join(f"{c} {'long' if c in _LONG else 'double'}" for c in OPEN)
OUTPUT = [
    "symbol", "bar_start", "bar_end", "first_tick", "last_tick", *[f"{p}_{k}" for p in PRICES for k in ("open", "high", "low", "close")], "spread_mean", "quote_count", "staleness_ns",
    "first_received_at", "last_received_at", "watermark_provider_ts", "watermark_ingest_seq", "bar_finalized_at", "feature_available_at", "first_ingest_seq", "last_ingest_seq", "invalidated_boundary", "error",
]
_DOUBLE = {f"{p}_{k}" for p in PRICES for k in ("open", "high", "low", "close")} | {"spread_mean"}
OUTPUT_SCHEMA = ", ".join(f"{c} {'string' if c in ('symbol', 'error') else 'double' if c in _DOUBLE else 'long'}" for c in OUTPUT)


class BarStream:
    """One symbol's stream: the open bar, the last tick's marks, and whether the stream has failed."""

    def __init__(self, symbol: str, state: tuple | None = None):
        self.symbol = symbol
        self.failed, self.provider, self.received, self.seq, is_open = state[:5] if state else (False, None, None, None, False)
        self.bar: dict | None = dict(zip(OPEN, state[5:], strict=True)) if is_open else None

    def state(self) -> tuple:
        bar = self.bar or dict.fromkeys(OPEN)
        return (self.failed, self.provider, self.received, self.seq, self.bar is not None, *(bar[c] for c in OPEN))

    def push(self, tick: dict) -> list[dict]:
        """Rows that this tick completes: a final bar, or the error that ends the stream."""
        if self.failed:
            return []
        p, r, s = int(tick["provider_ts"]), int(tick["received_at"]), int(tick["ingest_seq"])
        error = None
        if self.provider is not None:
            if p < self.provider:
                error = "provider time regressed"
            elif r < self.received:
                error = "receipt time regressed"
            elif s <= self.seq:
                error = "ingest sequence must increase"
        if error:
            self.failed, self.bar = True, None
            late = p - p % BAR + BAR if error.startswith("provider") else None
            return [{"symbol": self.symbol, "error": error, "invalidated_boundary": late}]
        start, out = p - p % BAR, []
        if self.bar is not None and start > self.bar["bar_start"]:
            out.append(self._final(p, r, s))
            self.bar = None
        if self.bar is None:
            self.bar = dict.fromkeys(OPEN, 0) | {"bar_start": start, "first_tick": p, "first_received_at": r, "first_ingest_seq": s, "spread_sum": 0.0}
            for q in PRICES:
                for k in ("open", "high", "low"):
                    self.bar[f"{q}_{k}"] = float(tick[q])
        b = self.bar
        for q in PRICES:
            v = float(tick[q])
            b[f"{q}_high"], b[f"{q}_low"], b[f"{q}_close"] = max(b[f"{q}_high"], v), min(b[f"{q}_low"], v), v
        b["spread_sum"] += float(tick["spread"])
        b["quote_count"] += 1
        b["last_tick"], b["last_received_at"], b["last_ingest_seq"] = p, r, s
        self.provider, self.received, self.seq = p, r, s
        return out

    def _final(self, p: int, r: int, s: int) -> dict:
        b = self.bar
        end = b["bar_start"] + BAR
        return {c: b[c] for c in OPEN if c != "spread_sum"} | {
            "symbol": self.symbol, "bar_end": end, "spread_mean": b["spread_sum"] / b["quote_count"], "staleness_ns": (end - b["last_tick"]) * 1000,
            "watermark_provider_ts": p, "watermark_ingest_seq": s, "bar_finalized_at": r, "feature_available_at": r + COMPUTE_ALLOWANCE,
        }


def _update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    stream = BarStream(key[0], state.get if state.exists else None)
    ticks = pd.concat(list(batches), ignore_index=True).sort_values("ingest_seq", kind="stable")
    out = [row for tick in ticks.to_dict("records") for row in stream.push(tick)]
    state.update(tuple(stream.state()))
    if out:
        frame = pd.DataFrame(out, columns=OUTPUT)
        for c in OUTPUT:
            if c not in _DOUBLE and c not in ("symbol", "error"):
                frame[c] = frame[c].astype("Int64")
        yield frame


def stream_bars(receipts: DataFrame) -> DataFrame:
    """Final bars, and error rows, of a streaming DataFrame of receipt-time ticks.

    Within a micro-batch ticks are taken in ingest order; across micro-batches any regression fails the symbol's stream. The
    state is one open bar a symbol, and bars do not depend on how the input is cut into micro-batches.
    """
    return receipts.groupBy("symbol").applyInPandasWithState(_update, OUTPUT_SCHEMA, STATE_SCHEMA, "append", "NoTimeout")
