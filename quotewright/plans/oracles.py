"""SQL for DuckDB that gives each registered query's rows from the same tables, written apart from the Spark code."""

from __future__ import annotations

from ..contracts import ARMS, BAR, COMPUTE_ALLOWANCE, HORIZONS, LATENCY, MINUTE, PAIRS, PRICES
from ..operators.splits import fold_list
from .queries import CUT_QUANTILE, DIGITS, HOUR, MODELS, PLAN, SCORE_FEATURES, SPREAD_LIMIT, START


def r(x: str, name: str | None = None) -> str:
    """Rounded as the queries round; adding zero turns minus zero into zero."""
    return f"(round({x}, {DIGITS}) + 0)" + (f" AS {name}" if name else "")


def rounded(*names: str) -> str:
    return ", ".join(r(n, n) for n in names)


def num(x: float) -> str:
    return f"{x:.17e}"


_LIST = "[" + ", ".join(f"'{p}'" for p in PAIRS) + "]"
TICKS = f"""t0 AS (SELECT {_LIST}[CAST(user_id % 8 AS INT) + 1] AS symbol, {START} + (epoch_us(ts) - {START}) // 48 AS ts, event_id AS seq,
    CAST(1 AS DOUBLE) + floor(value * 100) / CAST(100000 AS DOUBLE) AS bid, CAST(1 + event_id % 3 AS DOUBLE) / 10000 AS gap FROM events),
ticks AS (SELECT symbol, ts, seq, bid, bid + gap AS ask, (bid + (bid + gap)) / 2 AS mid, (bid + gap) - bid AS spread FROM t0)"""
_OHLC = ", ".join(f"first({p} ORDER BY ts, seq) AS {p}_open, max({p}) AS {p}_high, min({p}) AS {p}_low, last({p} ORDER BY ts, seq) AS {p}_close" for p in PRICES)
_FLOATS = [f"{p}_{k}" for p in PRICES for k in ("open", "high", "low", "close")] + ["spread_mean"]
_BAR = f"""symbol, b AS bar_start, b + {BAR} AS bar_end, min(ts) AS first_tick, max(ts) AS last_tick, {_OHLC}, avg(spread) AS spread_mean, count(*) AS quote_count, (b + {BAR} - max(ts)) * 1000 AS staleness_ns"""
BARS1 = TICKS + f""",
bars AS (SELECT {_BAR} FROM (SELECT *, ts - ts % {BAR} AS b FROM ticks) GROUP BY symbol, b)"""
BARS2 = TICKS + f""",
steps AS (SELECT *, lag(ts) OVER w AS pts, lag(bid) OVER w AS pbid, lag(ask) OVER w AS pask, lag(mid) OVER w AS pmid, lag(spread) OVER w AS pspread
    FROM (SELECT *, ts - ts % {BAR} AS b FROM ticks) WINDOW w AS (PARTITION BY symbol, b ORDER BY ts, seq)),
raw2 AS (SELECT {_BAR}, count(*) FILTER (bid <> pbid) AS bid_update_count, count(*) FILTER (ask <> pask) AS ask_update_count, count(*) FILTER (mid > pmid) AS mid_uptick_count,
    count(*) FILTER (mid < pmid) AS mid_downtick_count, count(*) FILTER (spread > pspread) AS spread_widening_count, count(*) FILTER (spread < pspread) AS spread_narrowing_count,
    count(pts) AS n, sum((ts - pts) / 1e6) AS s1, sum((ts - pts) / 1e6 * ((ts - pts) / 1e6)) AS s2 FROM steps GROUP BY symbol, b),
bars AS (SELECT * EXCLUDE (n, s1, s2),
    CASE WHEN bid_update_count + ask_update_count > 0 THEN (bid_update_count - ask_update_count) / CAST(bid_update_count + ask_update_count AS DOUBLE) ELSE 0e0 END AS bid_ask_update_imbalance,
    CASE WHEN mid_uptick_count + mid_downtick_count > 0 THEN (mid_uptick_count - mid_downtick_count) / CAST(mid_uptick_count + mid_downtick_count AS DOUBLE) ELSE 0e0 END AS mid_tick_imbalance,
    CASE WHEN spread_widening_count + spread_narrowing_count > 0 THEN (spread_widening_count - spread_narrowing_count) / CAST(spread_widening_count + spread_narrowing_count AS DOUBLE) ELSE 0e0 END AS spread_change_imbalance,
    CASE WHEN n > 0 THEN sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), 0e0)) ELSE 0e0 END AS interarrival_dispersion_seconds FROM raw2)"""
_FEATURE_SQL = f""",
seg0 AS (SELECT *, bar_end - lag(bar_end) OVER (PARTITION BY symbol ORDER BY bar_end) AS step, spread_close / mid_close * 10000 AS spread_bps FROM bars),
seg1 AS (SELECT *, sum(CASE WHEN step = {BAR} THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY bar_end) AS seg FROM seg0),
seg2 AS (SELECT *, ln(mid_close / lag(mid_close, 1) OVER w) AS mid_return_1, ln(mid_close / lag(mid_close, 3) OVER w) AS mid_return_3, ln(mid_close / lag(mid_close, 12) OVER w) AS mid_return_12
    FROM seg1 WINDOW w AS (PARTITION BY symbol, seg ORDER BY bar_end)),
feat AS (SELECT * EXCLUDE (seg, mean72, var72, n72, flat72),
    CASE WHEN n72 = 72 THEN CASE WHEN var72 > 0 AND NOT flat72 THEN (spread_bps - mean72) / sqrt(var72) ELSE 0e0 END END AS spread_zscore_72, seg
    FROM (SELECT *, CASE WHEN count(mid_return_1) OVER w12 = 12 THEN sqrt(sum(mid_return_1 * mid_return_1) OVER w12) END AS realized_volatility_12,
        CASE WHEN count(mid_return_1) OVER w72 = 72 THEN sqrt(sum(mid_return_1 * mid_return_1) OVER w72) END AS realized_volatility_72,
        count(*) OVER w72 AS n72, max(spread_bps) OVER w72 = min(spread_bps) OVER w72 AS flat72, sum(spread_bps) OVER w72 / 72 AS mean72, greatest(sum(spread_bps * spread_bps) OVER w72 / 72 - (sum(spread_bps) OVER w72 / 72) * (sum(spread_bps) OVER w72 / 72), 0e0) AS var72,
        (mid_high - mid_low) / mid_close * 10000 AS mid_range_bps, ln(1 + CAST(quote_count AS DOUBLE)) AS quote_count_log1p, staleness_ns / 1e9 AS staleness_seconds, step / 1e6 AS elapsed_seconds,
        sin(2 * pi() * (bar_end % 86400000000) / 86400e6) AS hour_sin, cos(2 * pi() * (bar_end % 86400000000) / 86400e6) AS hour_cos,
        sin(2 * pi() * (isodow(make_timestamp(bar_end)) - 1) / 7) AS weekday_sin, cos(2 * pi() * (isodow(make_timestamp(bar_end)) - 1) / 7) AS weekday_cos
        FROM seg2 WINDOW w12 AS (PARTITION BY symbol, seg ORDER BY bar_end ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), w72 AS (PARTITION BY symbol, seg ORDER BY bar_end ROWS BETWEEN 71 PRECEDING AND CURRENT ROW)))"""
FEATURES = BARS1 + _FEATURE_SQL
FEATURE_NAMES = ["mid_return_1", "mid_return_3", "mid_return_12", "realized_volatility_12", "realized_volatility_72", "spread_bps", "spread_zscore_72", "mid_range_bps", "quote_count_log1p", "staleness_seconds", "elapsed_seconds", "hour_sin", "hour_cos", "weekday_sin", "weekday_cos"]


def _exit(h: int) -> str:
    w = f"(PARTITION BY symbol ORDER BY bar_start RANGE BETWEEN {(5 + h) * MINUTE} FOLLOWING AND {(10 + h) * MINUTE} FOLLOWING)"
    return ", ".join(f"first_value({c}) OVER {w} AS x{a}_{h}" for c, a in (("first_tick", "t"), ("bid_open", "b"), ("ask_open", "a")))


def _resolve(h: int) -> str:
    ok = f"entry_time IS NOT NULL AND xt_{h} <= bar_end + {h * MINUTE + LATENCY}"
    long, short = f"xb_{h} / entry_ask - 1", f"1 - xa_{h} / entry_bid"
    act = f"CASE WHEN greatest({long}, {short}) <= 0 THEN 'flat' WHEN {long} > {short} THEN 'long' ELSE 'short' END"
    return f"CASE WHEN {ok} THEN xt_{h} END AS exit_time_{h}m, CASE WHEN {ok} THEN {long} END AS long_return_{h}m, CASE WHEN {ok} THEN {short} END AS short_return_{h}m, CASE WHEN {ok} THEN {act} END AS action_{h}m"


_LABEL_SQL = f""",
lab0 AS (SELECT symbol, bar_end, lead(first_tick) OVER w AS nt, lead(bid_open) OVER w AS nb, lead(ask_open) OVER w AS na, {", ".join(map(_exit, HORIZONS))} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_start)),
lab1 AS (SELECT *, CASE WHEN nt <= bar_end + {LATENCY} THEN nt END AS entry_time, CASE WHEN nt <= bar_end + {LATENCY} THEN nb END AS entry_bid, CASE WHEN nt <= bar_end + {LATENCY} THEN na END AS entry_ask FROM lab0),
lab AS (SELECT symbol, bar_end AS decision_time, entry_time, entry_bid, entry_ask, {", ".join(map(_resolve, HORIZONS))} FROM lab1),
cells AS ({" UNION ALL ".join(f"SELECT symbol, decision_time, entry_time, CAST({h} AS BIGINT) AS horizon_minutes, exit_time_{h}m AS exit_time, long_return_{h}m AS long_return, short_return_{h}m AS short_return FROM lab WHERE exit_time_{h}m IS NOT NULL" for h in HORIZONS)})"""
LABELS = BARS1 + _LABEL_SQL


def _score(model) -> str:
    return num(model.intercept) + "".join(f" + {num(t.coefficient)} * ((coalesce({n}, {num(t.median)}) - {num(t.mean)}) / {num(t.scale)})" for n, t in model.terms.items())


_SCORE_SQL = f""",
scores AS ({" UNION ALL ".join(f"SELECT symbol, bar_end AS decision_time, spread_zscore_72, CAST({h} AS BIGINT) AS horizon_minutes, {_score(a)} AS predicted_long_return, {_score(b)} AS predicted_short_return FROM feat" for h, (a, b) in MODELS.items())}),
folds AS (SELECT * FROM (VALUES {", ".join(f"('{f[0]}', CAST({f[1]} AS BIGINT), {f[2]}, {f[3]}, {f[4]}, {f[5]})" for f in fold_list(PLAN))}) v(fold_id, fold_index, train_start, train_end, validation_start, validation_end)),
folded AS (SELECT s.*, c.entry_time, c.exit_time, c.long_return, c.short_return, fold_id, fold_index, CASE WHEN s.decision_time < train_end THEN 'train' ELSE 'validation' END AS side
    FROM scores s JOIN cells c USING (symbol, decision_time, horizon_minutes) JOIN folds ON (s.decision_time >= train_start AND s.decision_time < train_end) OR (s.decision_time >= validation_start AND s.decision_time < validation_end)),
acted AS (SELECT *, CASE WHEN greatest(predicted_long_return, predicted_short_return) <= 0 THEN 'flat' WHEN predicted_long_return > predicted_short_return THEN 'long' ELSE 'short' END AS action FROM folded WHERE side = 'validation'),
preds AS (SELECT *, CASE action WHEN 'long' THEN long_return WHEN 'short' THEN short_return ELSE 0e0 END AS realized_return FROM acted)"""
PREDS = FEATURES + _LABEL_SQL + _SCORE_SQL
TRADES = PREDS + """,
trades AS (SELECT *, realized_return * (CAST(1 AS DOUBLE) / 8 / 3 / (horizon_minutes / 5e0)) * 100000 AS pnl_usd FROM preds WHERE action <> 'flat')"""
PATH = TRADES + f""",
path0 AS (SELECT exit_time AS event_time, sum(pnl_usd) AS pnl_usd FROM trades GROUP BY exit_time),
path1 AS (SELECT *, 100000e0 + sum(pnl_usd) OVER (ORDER BY event_time) AS equity_usd FROM path0),
path2 AS (SELECT *, greatest(max(equity_usd) OVER (ORDER BY event_time), 100000e0) AS running_peak_usd FROM path1),
path AS (SELECT *, 1 - equity_usd / running_peak_usd AS drawdown FROM path2),
periods AS (SELECT exit_time - exit_time % {BAR} AS period, sum(pnl_usd) / 100000 AS portfolio_return FROM trades GROUP BY 1)"""
LOCKED = PREDS + """,
locked AS (SELECT s.symbol, s.decision_time, s.horizon_minutes, predicted_long_return, predicted_short_return,
    CASE WHEN c.exit_time IS NULL OR greatest(predicted_long_return, predicted_short_return) <= 0 THEN 'flat' WHEN predicted_long_return > predicted_short_return THEN 'long' ELSE 'short' END AS action,
    c.entry_time, c.exit_time, c.exit_time IS NOT NULL AS execution_available, c.long_return, c.short_return FROM scores s LEFT JOIN cells c USING (symbol, decision_time, horizon_minutes)),
outcomes AS (SELECT * EXCLUDE (long_return, short_return), CASE action WHEN 'long' THEN long_return WHEN 'short' THEN short_return ELSE 0e0 END AS realized_return FROM locked)"""


def metrics(source: str, by: str) -> str:
    return f"""SELECT {by}, horizon_minutes, count(*) AS observations, count(*) FILTER (action <> 'flat') AS trades, {r("count(*) FILTER (action <> 'flat') / CAST(count(*) AS DOUBLE)", "trade_rate")},
    {r("avg(realized_return) * 10000", "mean_bps")}, {r("stddev_pop(realized_return) * 10000", "stddev_bps")},
    CASE WHEN count(*) FILTER (action <> 'flat') > 0 THEN {r("count(*) FILTER (action <> 'flat' AND realized_return > 0) / CAST(count(*) FILTER (action <> 'flat') AS DOUBLE)")} END AS hit_rate
    FROM {source} GROUP BY GROUPING SETS ((horizon_minutes), ({by}, horizon_minutes))"""


def checks(source: str, named: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS \"check\", count(*) FILTER ({c}) AS violations FROM {source}" for k, c in named.items())


RETURNS = FEATURES + f""",
wide AS (SELECT bar_end AS boundary, {", ".join(f"max(mid_return_1) FILTER (symbol = '{p}') AS {p}" for p in PAIRS)} FROM feat GROUP BY bar_end),
known AS (SELECT * FROM wide WHERE {" AND ".join(f"{p} IS NOT NULL" for p in PAIRS)})"""
FACTOR = RETURNS + f""",
f1 AS (SELECT *, (-EURJPY - GBPJPY + EURUSD + GBPUSD - 2 * USDJPY) / 4 AS s_JPY FROM known),
f2 AS (SELECT *, AUDUSD AS s_AUD, -USDCAD AS s_CAD, (EURJPY + EURUSD + s_JPY) / 2 AS s_EUR, (GBPJPY + GBPUSD + s_JPY) / 2 AS s_GBP, 0e0 AS s_USD FROM f1),
f3 AS (SELECT *, s_EUR - EURCHF AS s_CHF FROM f2),
f4 AS (SELECT *, {", ".join(f"{p} - (s_{p[:3]} - s_{p[3:]}) AS e_{p}" for p in PAIRS)} FROM f3),
f5 AS (SELECT *, ({" + ".join(f"e_{p}" for p in PAIRS)}) / 8 AS m FROM f4),
f6 AS (SELECT *, sqrt(({" + ".join(f"(e_{p} - m) * (e_{p} - m)" for p in PAIRS)}) / 8) AS dispersion FROM f5),
solution AS ({" UNION ALL ".join(f"SELECT boundary, '{p}' AS symbol, s_{p[:3]} AS base_strength, s_{p[3:]} AS quote_strength, e_{p} AS residual, dispersion AS residual_dispersion FROM f6" for p in PAIRS)})"""


def _windows() -> str:
    out = []
    for n in ("base_strength", "quote_strength", "residual", "residual_dispersion"):
        out.append(f"{n} AS {n}_1")
        for k in (3, 12):
            out.append(f"CASE WHEN count(*) OVER w{k} = {k} THEN sum({n}) OVER w{k}{f' / {k}' if n.endswith('dispersion') else ''} END AS {n}_{'mean' if n.endswith('dispersion') else 'sum'}_{k}")
    return ", ".join(out)


CROSS = FACTOR + f""",
xs AS (SELECT *, sum(gap) OVER (PARTITION BY symbol ORDER BY boundary) AS xseg FROM (SELECT *, CASE WHEN boundary - lag(boundary) OVER (PARTITION BY symbol ORDER BY boundary) = {BAR} THEN 0 ELSE 1 END AS gap FROM solution)),
cross_pair AS (SELECT boundary, symbol, {_windows()} FROM xs WINDOW w3 AS (PARTITION BY symbol, xseg ORDER BY boundary ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), w12 AS (PARTITION BY symbol, xseg ORDER BY boundary ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))"""
CROSS_NAMES = [f"{n}_{k}" for n in ("base_strength", "quote_strength", "residual", "residual_dispersion") for k in (("1", "mean_3", "mean_12") if n.endswith("dispersion") else ("1", "sum_3", "sum_12"))]
# The week at hand lies in winter, when New York is five hours behind.
CALENDAR = """grid AS (SELECT unnest(range({start}, {end}, 300000000)) AS boundary),
local AS (SELECT boundary, make_timestamp(boundary - 18000000000) AS t FROM grid),
calendar AS (SELECT boundary FROM local WHERE isodow(t) <= 4 OR (isodow(t) = 5 AND hour(t) < 16) OR (isodow(t) = 7 AND hour(t) * 60 + minute(t) >= 1025))"""


def calendar(hours: int) -> str:
    return CALENDAR.format(start=START, end=START + hours * HOUR)


SECTIONS = f"""sections AS (SELECT bar_end AS boundary, count(DISTINCT symbol) AS present, array_to_string(list_filter({_LIST}, lambda p: NOT list_contains(list(DISTINCT symbol), p)), ',') AS missing_symbols, count(DISTINCT symbol) = 8 AS complete FROM bars GROUP BY bar_end)"""
RECEIPTS = TICKS + """,
receipts AS (SELECT symbol, ts AS provider_ts, max(ts + 10000 + (seq % 5) * 1000) OVER (PARTITION BY symbol ORDER BY ts, seq) AS received_at, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS ingest_seq, bid, ask, mid, spread FROM ticks)"""
_FINAL_SQL = f"""
fin0 AS (SELECT symbol, b AS bar_start, b + {BAR} AS bar_end, min(provider_ts) AS first_tick, max(provider_ts) AS last_tick, {_OHLC.replace("ts, seq", "ingest_seq")}, avg(spread) AS spread_mean, count(*) AS quote_count,
    (b + {BAR} - max(provider_ts)) * 1000 AS staleness_ns, min(received_at) AS first_received_at, max(received_at) AS last_received_at, min(ingest_seq) AS first_ingest_seq, max(ingest_seq) AS last_ingest_seq
    FROM (SELECT *, provider_ts - provider_ts % {BAR} AS b FROM receipts) GROUP BY symbol, b),
final AS (SELECT f.*, n.provider_ts AS watermark_provider_ts, n.ingest_seq AS watermark_ingest_seq, n.received_at AS bar_finalized_at, n.received_at + {COMPUTE_ALLOWANCE} AS feature_available_at
    FROM fin0 f JOIN receipts n ON n.symbol = f.symbol AND n.ingest_seq = f.last_ingest_seq + 1)"""
FINAL = RECEIPTS + "," + _FINAL_SQL
_RECEIPTS_ONLY = RECEIPTS[len(TICKS) :]
STATUS = RETURNS + "," + SECTIONS + _RECEIPTS_ONLY + "," + _FINAL_SQL + """,
avail AS (SELECT bar_end AS boundary, max(feature_available_at) AS feature_available_at FROM final GROUP BY bar_end),
st0 AS (SELECT s.*, k.boundary IS NOT NULL AS ready, a.feature_available_at, s.boundary + 300000000 AS publication_deadline FROM sections s LEFT JOIN known k USING (boundary) LEFT JOIN avail a USING (boundary)),
status AS (SELECT boundary, publication_deadline, feature_available_at, CASE WHEN NOT complete THEN 'missing_input' WHEN NOT ready THEN 'factor_warmup' WHEN coalesce(feature_available_at > publication_deadline, true) THEN 'late_feature' ELSE 'ready' END AS status,
    CASE WHEN NOT complete THEN 'missing_symbols:' || missing_symbols WHEN NOT ready THEN 'cross_pair_return_unavailable' WHEN coalesce(feature_available_at > publication_deadline, true) THEN 'feature_available_after_publication_deadline' END AS missing_reason FROM st0)"""
_CELLS = f"""grid_cells AS (SELECT arm, symbol, CAST(h AS BIGINT) AS horizon_minutes FROM (SELECT unnest([{", ".join(f"'{a}'" for a in ARMS)}]) AS arm), (SELECT unnest({_LIST}) AS symbol), (SELECT unnest([{", ".join(map(str, HORIZONS))}]) AS h))"""
OPPORTUNITIES = STATUS + "," + _CELLS + """,
opportunities AS (SELECT boundary AS decision_time, publication_deadline, feature_available_at, status, missing_reason, arm, symbol, horizon_minutes FROM status, grid_cells)"""
MEANS = CROSS + _LABEL_SQL + _SCORE_SQL + "," + calendar(15) + "," + _CELLS + """,
both_arms AS (SELECT 'control' AS arm, symbol, decision_time, horizon_minutes, predicted_long_return AS l, predicted_short_return AS s FROM scores UNION ALL
    SELECT 'candidate', s.symbol, decision_time, horizon_minutes, predicted_long_return + 1e-1 * (base_strength_1 - quote_strength_1), predicted_short_return FROM scores s JOIN cross_pair x ON x.symbol = s.symbol AND x.boundary = s.decision_time),
arm_actions AS (SELECT arm, symbol, decision_time, horizon_minutes, CASE WHEN greatest(l, s) <= 0 THEN 'flat' WHEN l > s THEN 'long' ELSE 'short' END AS action FROM both_arms WHERE decision_time IN (SELECT boundary FROM calendar)),
inside AS (SELECT * FROM cells WHERE decision_time IN (SELECT boundary FROM calendar)),
agg_a AS (SELECT arm, a.symbol, a.horizon_minutes, count(*) AS scored, count(*) FILTER (action <> 'flat') AS nonflat_signals, count(*) FILTER (action = 'flat') AS flat_actions, count(*) FILTER (action <> 'flat' AND long_return IS NOT NULL) AS trade_count,
    sum(CASE WHEN long_return IS NULL THEN 0e0 WHEN action = 'long' THEN long_return WHEN action = 'short' THEN short_return ELSE 0e0 END) AS total FROM arm_actions a LEFT JOIN inside USING (symbol, decision_time, horizon_minutes) GROUP BY 1, 2, 3),
agg_b AS (SELECT symbol, horizon_minutes, count(*) AS resolved_labels FROM inside GROUP BY 1, 2),
means AS (SELECT arm, symbol, horizon_minutes, coalesce(scored, 0) AS scored, coalesce(nonflat_signals, 0) AS nonflat_signals, coalesce(flat_actions, 0) AS flat_actions, coalesce(trade_count, 0) AS trade_count, coalesce(total, 0e0) AS total,
    coalesce(resolved_labels, 0) AS resolved_labels, (SELECT count(*) FROM calendar) AS expected_opportunities, coalesce(total, 0e0) / (SELECT count(*) FROM calendar) * 10000 AS mean_bps
    FROM grid_cells LEFT JOIN agg_a USING (arm, symbol, horizon_minutes) LEFT JOIN agg_b USING (symbol, horizon_minutes))"""
_TICK_FLAGS = {"non_positive_bid": "bid <= 0", "non_positive_ask": "ask <= 0", "crossed_quotes": "bid > ask", "inconsistent_mid": "abs(mid - (bid + ask) / 2) > 1e-12", "inconsistent_spread": "abs(spread - (ask - bid)) > 1e-12"}
_ODD = " + ".join(f"count(*) FILTER (NOT isfinite({p}))" for p in PRICES)
_QUALITY = f"""quality AS (SELECT symbol, count(*) AS n_rows, {" + ".join(f"count(*) FILTER ({p} IS NULL)" for p in ("ts", *PRICES))} AS null_values, {_ODD} AS non_finite_values, {", ".join(f"count(*) FILTER ({c}) AS {k}" for k, c in _TICK_FLAGS.items())} FROM ticks GROUP BY symbol)"""
_ORDER = """ordered AS (SELECT symbol, count(*) FILTER (gap < 0) AS out_of_order, coalesce(max(gap) FILTER (gap > 0), 0) AS max_gap FROM (SELECT symbol, ts - lag(ts) OVER (PARTITION BY symbol ORDER BY seq) AS gap FROM ticks) GROUP BY symbol)"""
_DUPLICATES = """duplicated AS (SELECT symbol, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT symbol, count(*) AS n FROM ticks GROUP BY symbol, ts, bid, ask, mid, spread) GROUP BY symbol)"""
_TICK_ROUNDED = f"symbol, ts, seq, {rounded(*PRICES)}"
_V1 = f"symbol, bar_start, bar_end, first_tick, last_tick, {rounded(*_FLOATS)}, quote_count, staleness_ns"
_V2 = ["bid_ask_update_imbalance", "mid_tick_imbalance", "spread_change_imbalance", "interarrival_dispersion_seconds"]
_UPDATES = ["bid_update_count", "ask_update_count", "mid_uptick_count", "mid_downtick_count", "spread_widening_count", "spread_narrowing_count"]
_TAIL = [f"{n}_{m}" for m in ("15m", "60m") for n in ("bid_ask_update_imbalance", "mid_tick_imbalance", "spread_change_imbalance", "interarrival_dispersion_seconds")]


def _rolling() -> str:
    out = []
    for k, m in ((3, "15m"), (12, "60m")):
        for n, up, down in zip(("bid_ask_update", "mid_tick", "spread_change"), _UPDATES[::2], _UPDATES[1::2], strict=True):
            a, b = f"sum({up}) OVER v{k}", f"sum({down}) OVER v{k}"
            out.append(f"CASE WHEN count(*) OVER v{k} = {k} THEN CASE WHEN {a} + {b} > 0 THEN ({a} - {b}) / CAST({a} + {b} AS DOUBLE) ELSE 0e0 END END AS {n}_imbalance_{m}")
        out.append(f"CASE WHEN count(*) OVER v{k} = {k} THEN avg(interarrival_dispersion_seconds) OVER v{k} END AS interarrival_dispersion_seconds_{m}")
    return ", ".join(out)


_CUTS = f"""cuts AS (SELECT symbol, fold_id, horizon_minutes, coalesce(quantile_cont(greatest(predicted_long_return, predicted_short_return), {1 - CUT_QUANTILE}) FILTER (greatest(predicted_long_return, predicted_short_return) > 0), CAST('inf' AS DOUBLE)) AS threshold FROM folded WHERE side = 'train' GROUP BY ALL)"""
_SEGMENTS = f"""seg_h AS (SELECT symbol, CAST((ts - {START}) // {HOUR} AS BIGINT) AS hour, count(*) AS n_rows, CAST(sum({" + ".join(f"CAST({c} AS INT)" for c in _TICK_FLAGS.values())}) AS BIGINT) AS critical_violations FROM ticks GROUP BY 1, 2),
segs AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY hour) - 1 AS sequence, sha256(symbol || '|' || hour || '|' || n_rows) AS segment_id FROM seg_h)"""
_FOLD_LIST = "folds AS (SELECT * FROM (VALUES " + ", ".join(f"('{f[0]}', CAST({f[1]} AS BIGINT), {f[2]}, {f[3]}, {f[4]}, {f[5]})" for f in fold_list(PLAN)) + ") v(fold_id, fold_index, train_start, train_end, validation_start, validation_end))"
_SIDE = "CASE WHEN {t} >= train_start AND {t} < train_end THEN 'train' WHEN {t} >= validation_start AND {t} < validation_end THEN 'validation' END"
_BAR_CHECKS = {"span": f"bar_end - bar_start <> {BAR}", "grid": f"bar_end % {BAR} <> 0", "order": "bar_end <= pend", "finite": "NOT (isfinite(mid_close) AND isfinite(mid_high) AND isfinite(mid_low) AND isfinite(spread_close))", "prices": "mid_close <= 0 OR mid_low > mid_close OR mid_close > mid_high OR spread_close < 0", "activity": "quote_count < 0 OR staleness_ns < 0"}
_LABEL_CHECKS = {"span": f"bar_end - bar_start <> {BAR}", "first_tick_inside": "first_tick < bar_start OR first_tick >= bar_end", "tick_order": "first_tick <= ptick", "bar_order": "bar_end <= pend", "finite": "NOT (isfinite(bid_open) AND isfinite(ask_open))", "prices": "bid_open <= 0 OR ask_open < bid_open"}
_FINAL_CHECKS = {"span": f"bar_end - bar_start <> {BAR} OR bar_end % {BAR} <> 0", "inside": "NOT (bar_start <= first_tick AND first_tick <= last_tick AND last_tick < bar_end)", "receipt": "NOT (first_received_at <= last_received_at AND last_received_at <= bar_finalized_at)", "watermark_time": "watermark_provider_ts < bar_end", "available": "feature_available_at < bar_end", "allowance": "feature_available_at - bar_finalized_at <> 1000000", "sequence": "first_ingest_seq > last_ingest_seq", "watermark_sequence": "watermark_ingest_seq <= last_ingest_seq", "empty": "quote_count <= 0", "staleness": "staleness_ns <> (bar_end - last_tick) * 1000"}
_PRED_CHECKS = {"symbol": f"NOT list_contains({_LIST}, symbol)", "horizon": "horizon_minutes NOT IN (15, 30, 60)", "finite": "NOT (isfinite(predicted_long_return) AND isfinite(predicted_short_return) AND isfinite(realized_return))", "flat_is_zero": "action = 'flat' AND realized_return <> 0", "action": "action <> CASE WHEN greatest(predicted_long_return, predicted_short_return) <= 0 THEN 'flat' WHEN predicted_long_return > predicted_short_return THEN 'long' ELSE 'short' END"}
_LAGGED = "lagged AS (SELECT *, lag(bar_end) OVER w AS pend, lag(first_tick) OVER w AS ptick FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_start))"
_STATS_SQL = "stat0 AS (" + " UNION ALL ".join(f"SELECT symbol, '{n}' AS feature, {n} AS x FROM feat" for n in SCORE_FEATURES) + "), stat1 AS (SELECT symbol, feature, coalesce(median(x), 0e0) AS med FROM stat0 GROUP BY 1, 2), stat2 AS (SELECT symbol, feature, med, coalesce(x, med) AS x FROM stat0 JOIN stat1 USING (symbol, feature))"
_NULLED = ["mid_return_12", "realized_volatility_72", "spread_zscore_72", "elapsed_seconds"]
_LABEL_FLOATS = ["entry_bid", "entry_ask"] + [f"{s}_return_{h}m" for h in HORIZONS for s in ("long", "short")]
_LABEL_REST = ["symbol", "decision_time", "entry_time"] + [f"{c}_{h}m" for h in HORIZONS for c in ("exit_time", "action")]
_PRED_CELLS = "pcells AS (SELECT symbol, fold_id, horizon_minutes, count(*) AS observations, count(*) FILTER (action <> 'flat') AS trades, sum(realized_return) AS total FROM preds GROUP BY ALL)"

ORACLE_SQL: dict[str, str] = {
    "scan_ticks": f"WITH {TICKS} SELECT {_TICK_ROUNDED} FROM ticks",
    "scan_cutoff": f"WITH {TICKS} SELECT {_TICK_ROUNDED} FROM ticks WHERE ts < {START + 6 * HOUR}",
    "scan_range": f"WITH {TICKS} SELECT {_TICK_ROUNDED} FROM ticks WHERE ts >= {START + 2 * HOUR} AND ts < {START + 4 * HOUR}",
    "ticks_canonical": f"WITH {TICKS} SELECT {_TICK_ROUNDED} FROM ticks",
    "tick_quality": f"WITH {TICKS}, {_QUALITY} SELECT * FROM quality",
    "tick_order": f"WITH {TICKS}, {_ORDER} SELECT * FROM ordered",
    "tick_duplicates": f"WITH {TICKS}, {_DUPLICATES} SELECT * FROM duplicated",
    "tick_audit": f"WITH {TICKS}, {_QUALITY}, {_ORDER}, {_DUPLICATES} SELECT *, null_values + non_finite_values + {' + '.join(_TICK_FLAGS)} + out_of_order + duplicates AS critical_violations FROM quality JOIN ordered USING (symbol) JOIN duplicated USING (symbol)",
    "interval_check": f"WITH {TICKS} SELECT symbol, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (ts < p) AS out_of_order, count(*) FILTER (ts < {START + HOUR} OR ts >= {START + 10 * HOUR}) AS outside FROM (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY seq) AS p FROM ticks) GROUP BY symbol",
    "inventory_diff": "SELECT c_custkey AS custkey, 'missing' AS status FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 250000) UNION SELECT o_custkey, 'extra' FROM orders WHERE o_totalprice >= 250000 AND o_custkey NOT IN (SELECT c_custkey FROM customer)",
    "quote_bars_v1": f"WITH {BARS1} SELECT {_V1} FROM bars",
    "quote_bars_v2": f"WITH {BARS2} SELECT {_V1}, {', '.join(_UPDATES)}, {rounded(*_V2)} FROM bars",
    "project_v1": f"WITH {BARS1} SELECT {_V1} FROM bars",
    "bar_check": f"WITH {BARS1}, {_LAGGED} {checks('lagged', _BAR_CHECKS)}",
    "label_bar_check": f"WITH {BARS1}, {_LAGGED} {checks('lagged', _LABEL_CHECKS)}",
    "elapsed_log1p": f"WITH {FEATURES} SELECT symbol, bar_end, round(ln(1 + elapsed_seconds), 8) AS elapsed_seconds_log1p FROM feat",
    "features_v1": f"WITH {FEATURES} SELECT symbol, bar_end, {rounded(*FEATURE_NAMES)} FROM feat",
    "features_v2": f"WITH {BARS2}{_FEATURE_SQL}, rolled AS (SELECT *, {_rolling()} FROM feat WINDOW v3 AS (PARTITION BY symbol, seg ORDER BY bar_end ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), v12 AS (PARTITION BY symbol, seg ORDER BY bar_end ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT symbol, bar_end, {rounded(*FEATURE_NAMES, *_TAIL)} FROM rolled",
    "tail_context": f"WITH {BARS1} SELECT symbol, bar_end, {r('mid_close', 'mid_close')}, quote_count FROM bars WHERE bar_end <= {START + 8 * HOUR} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_end DESC) <= 73",
    "labels": f"WITH {LABELS} SELECT {', '.join(_LABEL_REST)}, {rounded(*_LABEL_FLOATS)} FROM lab",
    "align": f"WITH {FEATURES}{_LABEL_SQL} SELECT symbol, decision_time, {rounded('mid_return_1', 'spread_bps', 'long_return_15m', 'short_return_60m')}, entry_time FROM (SELECT symbol, bar_end AS decision_time, mid_return_1, spread_bps FROM feat) JOIN lab USING (symbol, decision_time)",
    "misaligned_keys": f"WITH {LABELS} SELECT symbol, decision_time, 'features' AS only_in FROM lab WHERE entry_time IS NULL",
    "dev_slice": f"WITH {FEATURES}{_LABEL_SQL} SELECT symbol, decision_time, {r('mid_return_1', 'mid_return_1')}, action_30m FROM (SELECT symbol, bar_end AS decision_time, mid_return_1 FROM feat) JOIN lab USING (symbol, decision_time) WHERE decision_time >= {START + HOUR} AND decision_time < {START + 9 * HOUR}",
    "locked_rows": f"WITH {LABELS} SELECT symbol, decision_time, {r('entry_bid', 'entry_bid')} FROM lab WHERE decision_time >= {START + 9 * HOUR} AND decision_time < {START + 13 * HOUR - PLAN.purge}",
    "folds": """SELECT 'wf-' || strftime(m, '%Y-%m') AS fold_id, CAST(row_number() OVER (ORDER BY m) - 1 AS BIGINT) AS fold_index, epoch_us(TIMESTAMP '2018-01-01') AS train_start, epoch_us(m - INTERVAL 65 MINUTE) AS train_end, epoch_us(m) AS validation_start,
        least(epoch_us(m + INTERVAL 1 MONTH), epoch_us(TIMESTAMP '2025-01-01' - INTERVAL 65 MINUTE)) AS validation_end FROM (SELECT unnest(generate_series(TIMESTAMP '2022-01-01', TIMESTAMP '2024-12-01', INTERVAL 1 MONTH)) AS m)""",
    "fold_rows": f"WITH {LABELS}, {_FOLD_LIST} SELECT * FROM (SELECT symbol, decision_time, fold_id, fold_index, {_SIDE.format(t='decision_time')} AS side FROM lab, folds) WHERE side IS NOT NULL",
    "inner_blocks": f"WITH {LABELS} SELECT symbol, decision_time, ntile(4) OVER (PARTITION BY symbol ORDER BY decision_time) - 1 AS block FROM lab",
    "calib_rows": f"WITH {LABELS} SELECT * FROM (SELECT symbol, decision_time, CASE WHEN decision_time < {START + 5 * HOUR - PLAN.purge} THEN 'fit' WHEN decision_time >= {START + 5 * HOUR} AND decision_time < {START + 8 * HOUR} THEN 'calibrate' END AS side FROM lab) WHERE side IS NOT NULL",
    "latency_check": f"WITH {PREDS} " + checks("preds", {"entry": f"entry_time NOT BETWEEN decision_time AND decision_time + {LATENCY}", "exit": f"exit_time NOT BETWEEN decision_time + horizon_minutes * {MINUTE} AND decision_time + horizon_minutes * {MINUTE} + {LATENCY}", "order": "entry_time >= exit_time"}),
    "leakage_check": f"WITH {PREDS} " + checks("preds", {c: f"{c} >= {START + 12 * HOUR}" for c in ("decision_time", "exit_time")}),
    "prediction_check": f"WITH {PREDS} {checks('preds', _PRED_CHECKS)} UNION ALL SELECT 'unique_key', CAST(coalesce(sum(n - 1) FILTER (n > 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM preds GROUP BY symbol, decision_time, horizon_minutes)",
    "action_check": f"WITH {PREDS} SELECT count(*) FILTER ({_PRED_CHECKS['action']}) AS differences FROM preds",
    "train_stats": f"WITH {FEATURES}, {_STATS_SQL} SELECT symbol, feature, {r('any_value(med)', 'median')}, {r('avg(x)', 'mean')}, {r('stddev_pop(x)', 'scale')} FROM stat2 GROUP BY 1, 2",
    "null_rates": f"WITH {FEATURES}, {_FOLD_LIST}, fr AS (SELECT * FROM (SELECT feat.*, fold_id, {_SIDE.format(t='bar_end')} AS side FROM feat, folds) WHERE side IS NOT NULL) " + " UNION ALL ".join(f"SELECT fold_id, side, '{n}' AS feature, {r(f'avg(CASE WHEN {n} IS NULL THEN 1e0 ELSE 0e0 END)', 'null_rate')} FROM fr GROUP BY 1, 2" for n in _NULLED),
    "frozen_score": f"WITH {PREDS} SELECT symbol, decision_time, horizon_minutes, {rounded('spread_zscore_72', 'predicted_long_return', 'predicted_short_return')} FROM scores",
    "action_rule": f"WITH {PREDS} SELECT symbol, decision_time, horizon_minutes, fold_id, action, {r('realized_return', 'realized_return')} FROM preds",
    "calibrator": f"WITH {PREDS}, ca AS (SELECT symbol, fold_id, horizon_minutes, count(*) AS n, avg(predicted_long_return) AS mx, avg(long_return) AS my, CASE WHEN var_pop(predicted_long_return) > 0 THEN greatest(covar_pop(long_return, predicted_long_return) / var_pop(predicted_long_return), 0e0) ELSE 0e0 END AS k FROM folded WHERE side = 'train' GROUP BY ALL) SELECT symbol, fold_id, horizon_minutes, n, {r('k', 'slope')}, {r('my - k * mx', 'intercept')} FROM ca",
    "ridge_1d": f"WITH {PREDS}, rr AS (SELECT c.symbol, c.horizon_minutes, mid_return_1 AS x, long_return AS y FROM cells c JOIN feat f ON f.symbol = c.symbol AND f.bar_end = c.decision_time WHERE mid_return_1 IS NOT NULL AND long_return IS NOT NULL) SELECT symbol, horizon_minutes, count(*) AS n, {r('CASE WHEN var_pop(x) > 0 THEN count(*) * covar_pop(y, x) / sqrt(var_pop(x)) / (count(*) + 1e0) ELSE 0e0 END', 'slope')}, {r('avg(y)', 'intercept')} FROM rr GROUP BY 1, 2",
    "conviction_cut": f"WITH {PREDS}, {_CUTS} SELECT symbol, fold_id, horizon_minutes, CASE WHEN isinf(threshold) THEN threshold ELSE {r('threshold')} END AS threshold FROM cuts",
    "gated_mean": f"WITH {PREDS}, {_CUTS}, gated AS (SELECT f.*, greatest(predicted_long_return, predicted_short_return) > 0 AND greatest(predicted_long_return, predicted_short_return) >= threshold AND coalesce(spread_zscore_72 <= {SPREAD_LIMIT}, false) AS gate, CASE WHEN predicted_long_return > predicted_short_return THEN long_return ELSE short_return END AS taken FROM folded f JOIN cuts USING (symbol, fold_id, horizon_minutes) WHERE side = 'validation') SELECT symbol, fold_id, horizon_minutes, count(*) AS observations, count(*) FILTER (gate) AS admitted, {r('avg(CASE WHEN gate THEN taken ELSE 0e0 END) * 10000', 'mean_bps')} FROM gated GROUP BY ALL",
    "signal_metrics": f"WITH {PREDS} {metrics('preds', 'fold_id')}",
    "locked_outcomes": f"WITH {LOCKED} SELECT symbol, decision_time, horizon_minutes, {rounded('predicted_long_return', 'predicted_short_return', 'realized_return')}, action, entry_time, exit_time, execution_available FROM outcomes",
    "locked_metrics": f"WITH {LOCKED} {metrics('outcomes', 'symbol')}",
    "score_reconcile": f"WITH {PREDS} SELECT count(*) FILTER (p.symbol IS NULL) AS only_scores, count(*) FILTER (s.symbol IS NULL) AS only_predictions, coalesce(bool_and(s.predicted_long_return = p.predicted_long_return AND s.predicted_short_return = p.predicted_short_return) FILTER (s.symbol IS NOT NULL AND p.symbol IS NOT NULL), true) AS agree FROM scores s FULL JOIN preds p ON p.symbol = s.symbol AND p.decision_time = s.decision_time AND p.horizon_minutes = s.horizon_minutes",
    "screen_gates": f"WITH {PREDS}, sc AS (SELECT symbol, horizon_minutes, count(*) AS n, count(*) FILTER (action <> 'flat') AS t, sum(realized_return) AS total FROM preds GROUP BY 1, 2), sg AS (SELECT horizon_minutes, sum(total) / sum(n) * 10000 AS m, count(*) FILTER (total / n > 0) AS positive_symbols, min(t) AS minimum_trades FROM sc GROUP BY 1) SELECT horizon_minutes, {r('m', 'mean_bps')}, positive_symbols, minimum_trades, m > 0 AS mean_gate, positive_symbols >= 5 AS symbol_gate, minimum_trades >= 5 AS trade_gate FROM sg",
    "acceptance_model": f"WITH {PREDS}, {_PRED_CELLS}, pf AS (SELECT horizon_minutes, count(*) FILTER (t > 0) AS positive_folds FROM (SELECT fold_id, horizon_minutes, sum(total) AS t FROM pcells GROUP BY 1, 2) GROUP BY 1), ps AS (SELECT horizon_minutes, count(*) FILTER (t > 0) AS positive_symbols FROM (SELECT symbol, horizon_minutes, sum(total) AS t FROM pcells GROUP BY 1, 2) GROUP BY 1) SELECT horizon_minutes, cells, observations, mean_bps, minimum_trades, positive_folds, positive_symbols FROM (SELECT horizon_minutes, count(*) AS cells, CAST(sum(observations) AS BIGINT) AS observations, {r('sum(total) / sum(observations) * 10000', 'mean_bps')}, min(trades) AS minimum_trades FROM pcells GROUP BY 1) JOIN pf USING (horizon_minutes) JOIN ps USING (horizon_minutes)",
    "acceptance_portfolio": f"WITH {PATH} SELECT {r('sum(pnl_usd)', 'total_pnl')}, 0e0 AS equity_error, 0e0 AS peak_error, 0e0 AS drawdown_error FROM path",
    "attribution": f"WITH {TRADES} SELECT symbol, horizon_minutes, fold_id, count(*) AS trades, {r('sum(pnl_usd)', 'pnl_usd')}, {r('count(*) FILTER (pnl_usd > 0) / CAST(count(*) AS DOUBLE)', 'win_rate')} FROM trades GROUP BY GROUPING SETS ((symbol), (horizon_minutes), (fold_id))",
    "portfolio_report": f"WITH {PATH} SELECT (SELECT count(*) FROM path) AS events, {r('(SELECT arg_max(equity_usd, event_time) FROM path)', 'final_equity_usd')}, {r('(SELECT max(drawdown) FROM path)', 'maximum_drawdown')}, (SELECT coalesce(bool_or(drawdown >= 0.1), false) FROM path) AS halt_triggered, count(*) AS periods, {r('coalesce(stddev_samp(portfolio_return) * sqrt(72576e0), 0e0)', 'annual_volatility')}, {r('(SELECT arg_max(equity_usd, event_time) FROM path) / 100000 - 1', 'total_return')} FROM periods",
    "drawdown": f"WITH {PATH} SELECT event_time, {rounded('pnl_usd', 'equity_usd', 'running_peak_usd', 'drawdown')} FROM path",
    "rolling_vol": f"WITH {PATH} SELECT period, CASE WHEN count(*) OVER w >= 12 THEN {r('stddev_samp(portfolio_return) OVER w * sqrt(72576e0)')} END AS annual_volatility FROM periods WINDOW w AS (ORDER BY period ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)",
    "lot_weight": f"WITH {PREDS} SELECT symbol, decision_time, horizon_minutes, {r('CAST(1 AS DOUBLE) / 8 / 3 / (horizon_minutes / 5e0)', 'weight')} FROM preds",
    "event_schedule": f"WITH {TRADES} SELECT entry_time AS event_time, CAST(0 AS BIGINT) AS kind, symbol, horizon_minutes, decision_time FROM trades UNION ALL SELECT exit_time, 1, symbol, horizon_minutes, decision_time FROM trades",
    "calendar": f"WITH {calendar(7 * 24)} SELECT boundary FROM calendar",
    "calendar_join": f"WITH {BARS1}, {calendar(15)} SELECT boundary, symbol, {r('mid_close', 'mid_close')} FROM calendar LEFT JOIN bars ON bar_end = boundary",
    "sync_sections": f"WITH {BARS1}, {SECTIONS} SELECT * FROM sections",
    "factor_solution": f"WITH {FACTOR} SELECT boundary, symbol, {rounded('base_strength', 'quote_strength', 'residual', 'residual_dispersion')} FROM solution",
    "cross_pair": f"WITH {CROSS} SELECT boundary, symbol, {rounded(*CROSS_NAMES)} FROM cross_pair",
    "cross_pair_hist": f"WITH {CROSS}, {calendar(15)} SELECT c.boundary, symbol, {rounded('residual_1', 'residual_sum_3', 'residual_dispersion_mean_12')} FROM calendar c LEFT JOIN cross_pair USING (boundary)",
    "boundary_status": f"WITH {STATUS} SELECT * FROM status",
    "opportunities": f"WITH {OPPORTUNITIES} SELECT * FROM opportunities",
    "ledger_check": f"WITH {OPPORTUNITIES} SELECT decision_time, count(DISTINCT arm || symbol || horizon_minutes) AS cells, count(*) AS n_rows, count(DISTINCT status) = 1 AND count(DISTINCT coalesce(missing_reason, 'none')) = 1 AND count(DISTINCT coalesce(feature_available_at, -1)) = 1 AS uniform FROM opportunities GROUP BY 1",
    "coverage": f"WITH {STATUS}, {calendar(15)}, rep AS (SELECT c.boundary, coalesce(status, 'absent') AS status FROM calendar c LEFT JOIN status USING (boundary)), isl AS (SELECT *, sum(CASE WHEN status = 'ready' THEN 1 ELSE 0 END) OVER (ORDER BY boundary) AS island FROM rep), longest AS (SELECT coalesce(max(n), 0) AS max_consecutive_missing FROM (SELECT count(*) AS n FROM isl WHERE status <> 'ready' GROUP BY island)) SELECT month, expected, complete, {r('complete / CAST(expected AS DOUBLE)', 'ratio')}, max_consecutive_missing FROM (SELECT strftime(make_timestamp(boundary), '%Y-%m') AS month, count(*) AS expected, count(*) FILTER (status = 'ready') AS complete FROM rep GROUP BY GROUPING SETS ((month), ())), longest",
    "anti_unexpected": f"WITH {STATUS}, {calendar(10)} SELECT boundary FROM status WHERE boundary NOT IN (SELECT boundary FROM calendar)",
    "paired_training": f"WITH {CROSS}{_LABEL_SQL} SELECT c.symbol, c.horizon_minutes, c.decision_time, {rounded('long_return', 'short_return', 'mid_return_1', 'base_strength_1', 'residual_1')} FROM cells c JOIN feat f ON f.symbol = c.symbol AND f.bar_end = c.decision_time JOIN cross_pair x ON x.symbol = c.symbol AND x.boundary = c.decision_time",
    "opportunity_means": f"WITH {MEANS} SELECT arm, symbol, horizon_minutes, scored, nonflat_signals, flat_actions, trade_count, {r('total', 'total')}, resolved_labels, expected_opportunities, {r('mean_bps', 'mean_bps')} FROM means",
    "arm_delta": f"WITH {MEANS} SELECT a.symbol, a.horizon_minutes, {r('a.mean_bps - b.mean_bps', 'mean_bps_delta')}, a.trade_count - b.trade_count AS trade_count_delta FROM means a JOIN means b ON a.symbol = b.symbol AND a.horizon_minutes = b.horizon_minutes WHERE a.arm = 'candidate' AND b.arm = 'control'",
    "receipt_audit": f"WITH {RECEIPTS}, lagr AS (SELECT *, lag(provider_ts) OVER w AS p, lag(received_at) OVER w AS q, lag(ingest_seq) OVER w AS s FROM receipts WINDOW w AS (PARTITION BY symbol ORDER BY ingest_seq)) SELECT symbol, count(*) AS n_rows, CAST(0 AS BIGINT) AS null_values, {_ODD} AS non_finite_values, {', '.join(f'count(*) FILTER ({c}) AS {k}' for k, c in _TICK_FLAGS.items())}, count(*) FILTER (provider_ts < p) AS provider_out_of_order, count(*) FILTER (received_at < q) AS receipt_out_of_order, count(*) FILTER (ingest_seq <= s) AS sequence_not_increasing, count(*) FILTER (provider_ts - received_at > 100000) AS clock_lead_violations, greatest(max(received_at - provider_ts), 0) AS max_delivery_latency FROM lagr GROUP BY symbol",
    "prospective_bars": f"WITH {FINAL} SELECT {_V1}, first_received_at, last_received_at, watermark_provider_ts, watermark_ingest_seq, bar_finalized_at, feature_available_at, first_ingest_seq, last_ingest_seq FROM final",
    "prospective_bar_check": f"WITH {FINAL} {checks('final', _FINAL_CHECKS)}",
    "stream_bars": f"WITH {FINAL} SELECT {_V1}, first_received_at, last_received_at, watermark_provider_ts, watermark_ingest_seq, bar_finalized_at, feature_available_at, first_ingest_seq, last_ingest_seq FROM final",
    "custody_chain": f"WITH {TICKS}, {_SEGMENTS} SELECT symbol, count(*) AS segments, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(critical_violations) AS BIGINT) AS critical_violations, CAST(0 AS BIGINT) AS breaks, arg_max(segment_id, sequence) AS terminal_segment_id FROM segs GROUP BY symbol",
}
