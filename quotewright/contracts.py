"""Names, constants and dataclasses that operators share. Times are BIGINT microseconds since the epoch, in UTC."""

from __future__ import annotations

from dataclasses import dataclass

# The eight pairs and six non-dollar currencies, in canonical order.
PAIRS = ("AUDUSD", "EURCHF", "EURJPY", "EURUSD", "GBPJPY", "GBPUSD", "USDCAD", "USDJPY")
CURRENCIES = ("AUD", "CAD", "CHF", "EUR", "GBP", "JPY")
HORIZONS = (15, 30, 60)
ARMS = ("control", "candidate")

SECOND = 1_000_000
MINUTE = 60 * SECOND
BAR = 5 * MINUTE
#: An execution may come this long after its due time, inclusive.
LATENCY = 5 * MINUTE
PRICE_TOLERANCE = 1e-12
MAX_CLOCK_LEAD = 100_000
COMPUTE_ALLOWANCE = 1 * SECOND
PUBLICATION_DEADLINE = 5 * MINUTE

TICK_COLUMNS = ("symbol", "ts", "seq", "bid", "ask", "mid", "spread")
PRICES = ("bid", "ask", "mid", "spread")
FEATURES_V1 = (
    "mid_return_1", "mid_return_3", "mid_return_12", "realized_volatility_12", "realized_volatility_72", "spread_bps", "spread_zscore_72", "mid_range_bps",
    "quote_count_log1p", "staleness_seconds", "elapsed_seconds", "hour_sin", "hour_cos", "weekday_sin", "weekday_cos",
)
IMBALANCES = ("bid_ask_update", "mid_tick", "spread_change")


@dataclass(frozen=True)
class WalkForwardPlan:
    """Expanding folds: each trains from ``train_start`` up to ``purge`` before its validation window."""

    train_start: int
    first_validation: int
    end: int
    step_months: int = 1
    #: Windows of a fixed length instead of calendar months.
    step: int | None = None
    purge: int = 65 * MINUTE
    horizons: tuple[int, ...] = HORIZONS

    def __post_init__(self) -> None:
        if not self.train_start < self.first_validation < self.end:
            raise ValueError("train start, first validation and end must ascend")
        if self.purge < max(self.horizons) * MINUTE + LATENCY:
            raise ValueError("the purge must cover the longest horizon and the latency")
        if self.step is not None and self.step <= self.purge:
            raise ValueError("windows must be longer than the purge")
        if list(self.horizons) != sorted(set(self.horizons)) or any(h <= 0 or h % 5 for h in self.horizons):
            raise ValueError("horizons must be ascending multiples of five minutes")


@dataclass(frozen=True)
class PortfolioConfig:
    initial_capital: float = 100_000.0
    symbols: int = 8
    horizons: int = 3
    target_volatility: float = 0.10
    maximum_leverage: float = 2.0
    drawdown_limit: float = 0.10
    lookback: int = 5_760
    minimum_observations: int = 288
    periods_per_year: float = 72_576.0


@dataclass(frozen=True)
class ScreenGates:
    minimum_trades: int = 100
    minimum_mean_bps: float = 0.0
    minimum_positive_symbols: int = 5
