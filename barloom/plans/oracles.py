"""The same queries in DuckDB SQL, written apart from the Spark plans."""

from __future__ import annotations

from .queries import ADDS, AS_OF, BASE, CALENDAR, CYCLES, EVENTS_CALENDAR, PAIRS, PAYLOADS, SCAN_DATE, SIGNAL_DATE, SPAN, STATUSES, SYMBOL, WIDE_GAP

# Exchange holidays, written out apart from the library's.
HOLIDAYS = (
    "2023-01-26", "2023-03-07", "2023-03-30", "2023-04-04", "2023-04-07", "2023-04-14", "2023-05-01", "2023-06-28", "2023-08-15", "2023-09-19", "2023-10-02", "2023-10-24", "2023-11-14", "2023-11-27", "2023-12-25",
    "2024-01-26", "2024-03-08", "2024-03-25", "2024-03-29", "2024-04-11", "2024-04-17", "2024-05-01", "2024-06-17", "2024-07-17", "2024-08-15", "2024-10-02", "2024-11-01", "2024-11-15", "2024-12-25",
    "2025-02-26", "2025-03-14", "2025-03-31", "2025-04-10", "2025-04-14", "2025-04-18", "2025-05-01", "2025-08-15", "2025-08-27", "2025-10-02", "2025-10-21", "2025-10-22", "2025-11-05", "2025-12-25",
    "2026-01-26", "2026-03-03", "2026-03-26", "2026-03-31", "2026-04-03", "2026-04-14", "2026-05-01", "2026-06-26", "2026-10-02", "2026-10-12", "2026-11-09", "2026-11-27", "2026-12-25",
)
ITEM_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
BRAND = f"""brand AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, first(px ORDER BY {ITEM_ORDER}) AS open_price, max(px) AS high_price, min(px) AS low_price,
    last(px ORDER BY {ITEM_ORDER}) AS close_price, last(px ORDER BY {ITEM_ORDER}) AS adj_close, CAST(sum(l_quantity) AS INTEGER) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS px FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
USER = """usr AS (SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS date, first(value ORDER BY event_id) AS open_price, max(value) AS high_price, min(value) AS low_price,
    last(value ORDER BY event_id) AS close_price, last(value ORDER BY event_id) AS adj_close, CAST(count(*) AS INTEGER) AS volume FROM events GROUP BY 1, 2)"""
UNIVERSE = """uni AS (SELECT DISTINCT p_brand AS symbol, 'NSE' AS exchange, 'Maker of ' || p_brand AS company_name, 'Goods' AS sector,
    CASE p_brand WHEN 'Brand#11' THEN false WHEN 'Brand#13' THEN NULL ELSE true END AS is_active FROM part)"""


def frame(source: str, name: str = "ind", volume: float = 1.5, rsi: int = 50, lookback: int = 21) -> str:
    """CTEs of the indicators of every bar of a source, and of a rule with the given limits."""
    return f"""{name}_c AS (SELECT *, count(*) OVER w AS n, adj_close - lag(adj_close) OVER w AS ch, lag(adj_close) OVER w AS pa FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY date)),
  {name}_w AS (SELECT *, coalesce(sum(CASE WHEN ch > 0 THEN ch END) OVER r14, 0) / 14 AS gain, coalesce(sum(CASE WHEN ch <= 0 THEN abs(ch) END) OVER r14, 0) / 14 AS loss,
      avg(adj_close) OVER r20 AS a20, avg(adj_close) OVER r50 AS a50, avg(adj_close) OVER r200 AS a200,
      sum(CASE WHEN volume > 0 THEN volume END) OVER r20 AS vs, count(CASE WHEN volume > 0 THEN 1 END) OVER r20 AS vn,
      coalesce(sum(CASE WHEN high_price IS NOT NULL AND low_price IS NOT NULL AND pa IS NOT NULL THEN greatest(high_price - low_price, abs(high_price - pa), abs(low_price - pa)) END) OVER r14, 0) / 14 AS tr,
      max(CASE WHEN high_price > 0 THEN high_price END) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {lookback - 1} PRECEDING AND 1 PRECEDING) AS recent_high
    FROM {name}_c WINDOW r14 AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING), r20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING),
      r50 AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING), r200 AS (PARTITION BY symbol ORDER BY date ROWS 199 PRECEDING)),
  {name}_v AS (SELECT *, CASE WHEN n >= 15 THEN CASE WHEN loss = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + gain / loss) END END AS rsi,
      CASE WHEN n >= 20 THEN a20 END AS sma20, CASE WHEN n >= 50 THEN a50 END AS sma50, CASE WHEN n >= 200 THEN a200 END AS sma200,
      CASE WHEN n >= 20 AND vn > 0 THEN CAST(vs // vn AS BIGINT) END AS avg_volume20, CASE WHEN n >= 15 THEN tr END AS atr14 FROM {name}_w),
  {name}_f AS (SELECT *, adj_close > sma20 AS above_sma20, adj_close > sma50 AS above_sma50, adj_close > sma200 AS above_sma200, n >= {lookback} AS enough_bars, adj_close > recent_high AS breaks_out,
      (adj_close - recent_high) / recent_high < {WIDE_GAP} AS gap_small, volume > avg_volume20 * {volume} AS volume_confirms, rsi > {rsi} AS rsi_strong FROM {name}_v),
  {name} AS (SELECT *, above_sma20 AS trend_up, coalesce(enough_bars AND breaks_out AND gap_small AND volume_confirms AND rsi_strong AND above_sma20, false) AS matched,
      CASE WHEN coalesce(enough_bars AND breaks_out AND gap_small AND volume_confirms AND rsi_strong AND above_sma20, false) THEN least(1e0, 5e-1 + CASE WHEN rsi > 60 THEN 1e-1 ELSE 0 END + CASE WHEN above_sma50 THEN 1e-1 ELSE 0 END
        + CASE WHEN volume > avg_volume20 * 2.0 THEN 1e-1 ELSE 0 END + CASE WHEN above_sma200 THEN 1e-1 ELSE 0 END) ELSE 0e0 END AS confidence FROM {name}_f)"""


def calendar(start: str, end: str, closures=(), special=(), name: str = "cal") -> str:
    days = lambda xs: "(" + ", ".join(f"DATE '{x}'" for x in xs) + ")" if xs else "(NULL)"
    return f"""{name}_s AS (SELECT CAST(d AS DATE) AS date, CASE WHEN d IN {days(closures)} THEN 'UNEXPECTED_CLOSURE' WHEN d IN {days(special)} THEN 'SPECIAL_SESSION' WHEN d IN {days(HOLIDAYS)} THEN 'HOLIDAY'
      WHEN isodow(d) >= 6 THEN 'WEEKEND' ELSE 'TRADING' END AS session FROM (SELECT CAST(unnest(generate_series(DATE '{start}', DATE '{end}', INTERVAL 1 DAY)) AS DATE) AS d)),
  {name}_t AS (SELECT *, session IN ('TRADING', 'SPECIAL_SESSION') AS is_trading FROM {name}_s),
  {name} AS (SELECT *, CAST(sum(CAST(is_trading AS INTEGER)) OVER (ORDER BY date) AS INTEGER) AS le, CAST(sum(CAST(is_trading AS INTEGER)) OVER (ORDER BY date) - CAST(is_trading AS INTEGER) AS INTEGER) AS lt FROM {name}_t)"""


def added(date: str, n: str) -> str:
    """A scalar subquery: the day n trading days on."""
    return f"""(SELECT t.date FROM cal h JOIN cal t ON t.is_trading AND t.le = CASE WHEN {n} > 0 THEN h.le + {n} WHEN {n} < 0 THEN h.lt + 1 + {n} WHEN h.is_trading THEN h.le END WHERE h.date = {date})"""


B = f"WITH {BRAND}"
I = f"WITH {BRAND}, {frame('brand')}"  # noqa: E741
LONG_CALENDAR = calendar("2022-12-01", "2028-12-31")
LENIENT = f"WITH {BRAND}, {frame('brand', volume=0.5, rsi=30)}"
SHORT = f"{LENIENT}, {frame('brand', 'brief', 0.5, 30, 6)}"
SIG = f"{I}, sig AS (SELECT symbol, date AS scan_date, 'Breakout Confirmed' AS rule_name, round(confidence, 6) AS confidence FROM ind WHERE matched)"
RET = f"""{SIG}, {calendar(*CALENDAR)}, due AS (SELECT sig.*, h AS horizon_days FROM sig, (SELECT unnest([5, 10, 20]) AS h)),
  placed AS (SELECT due.*, t.date AS exit_date FROM due JOIN cal c ON c.date = scan_date JOIN cal t ON t.is_trading AND t.le = c.le + horizon_days),
  ret AS (SELECT p.symbol, p.scan_date, p.rule_name, p.horizon_days, e.close_price AS entry_price, x.close_price AS exit_price, (x.close_price - e.close_price) / e.close_price AS fr
    FROM placed p JOIN brand e ON e.symbol = p.symbol AND e.date = p.scan_date JOIN brand x ON x.symbol = p.symbol AND x.date = p.exit_date
    WHERE e.close_price <> 0 AND p.scan_date <= {added("DATE '2002-12-30'", "(-p.horizon_days)")})"""
values = lambda rows, names: "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v + "'" for v in r) + ")" for r in rows) + f") t({names})"
STATES = f"(SELECT a AS ingestion_status, b AS scan_status, CAST(n AS INTEGER) AS stocks_ingested FROM (SELECT unnest({list(STATUSES)}) AS a), (SELECT unnest({list(STATUSES)}) AS b), (SELECT unnest([NULL, 0, 5]) AS n))"
R6 = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
FIRED = f"""fired AS (SELECT u.symbol, c.date AS scan_date, u.confidence FROM (SELECT symbol, date, confidence, matched, coalesce(lead(date) OVER (PARTITION BY symbol ORDER BY date), DATE '%s' + 1) AS nxt FROM ind) u
    JOIN cal c ON c.is_trading AND c.date >= u.date AND c.date < u.nxt WHERE u.matched)"""
PAYLOAD_ROWS = f"p AS (SELECT symbol, CAST(body AS JSON) AS j FROM {values(PAYLOADS, 'symbol, body')})"
ONE = "SELECT symbol, date, {} AS {} FROM ind"

# Fixed value: the wide rule's parameters as stored with each signal.
WIDE_SNAPSHOT = '{"baseConfidence":0.5,"confidenceIncrement":0.1,"lookbackWindow":21,"maxConfidenceCap":1.0,"maxGap":0.6,"rsiPeriod":14,"rsiThresholdConfidence":60.0,"rsiThresholdMatch":50.0,"smaLongPeriod":200,"smaMediumPeriod":50,"smaShortPeriod":20,"volumeMultiplierConfidence":2.0,"volumeMultiplierMatch":1.5}'
STATE_COLUMNS = "trading_date, ingestion_status, scan_status, data_source_status, execution_mode, last_ingestion_time, last_scan_time, stocks_ingested, signals_generated, error_message"
STATE_ROWS = f"""(SELECT CAST(a AS DATE) AS trading_date, b AS ingestion_status, c AS scan_status, d AS data_source_status, CAST(e AS VARCHAR) AS execution_mode, CAST(f AS TIMESTAMP) AS last_ingestion_time, CAST(g AS TIMESTAMP) AS last_scan_time, CAST(h AS INTEGER) AS stocks_ingested, CAST(i AS INTEGER) AS signals_generated, CAST(k AS VARCHAR) AS error_message FROM (VALUES
  ('2024-01-29', 'SUCCESS', 'SUCCESS', 'HEALTHY', 'API', '2024-01-29 19:01:00', '2024-01-29 19:03:00', 3, 2, NULL), ('2024-01-30', 'SUCCESS_NO_DATA', 'SKIPPED', 'NO_DATA', NULL, '2024-01-30 19:01:00', '2024-01-30 19:02:00', 0, NULL, 'no bars'),
  ('2024-01-31', 'FAILED', 'PENDING', 'UNHEALTHY', NULL, '2024-01-31 19:01:00', NULL, NULL, NULL, 'timed out'), ('2024-02-01', 'PENDING', 'PENDING', 'UNKNOWN', NULL, NULL, NULL, NULL, NULL, NULL)) t(a, b, c, d, e, f, g, h, i, k))"""

ORACLES = {
    "bars_brand": f"{B} SELECT * FROM brand",
    "bars_user": f"WITH {USER} SELECT * FROM usr",
    "bars_etype": """SELECT event_type AS symbol, date_trunc('hour', ts) AS date, first(value ORDER BY event_id) AS open_price, max(value) AS high_price, min(value) AS low_price,
      last(value ORDER BY event_id) AS close_price, last(value ORDER BY event_id) AS adj_close, CAST(count(*) AS INTEGER) AS volume FROM events GROUP BY 1, 2""",
    "price_count": f"{B} SELECT count(*) AS n FROM brand",
    "active_universe": f"WITH {UNIVERSE} SELECT * FROM uni WHERE is_active",
    "universe_seed": "SELECT 'IT' AS sector, CAST(5 AS BIGINT) AS n",
    "symbol_lookup": f"WITH {UNIVERSE} SELECT * FROM uni WHERE symbol = '{SYMBOL}'",
    "history_by_symbol": f"{B} SELECT * FROM brand WHERE symbol = '{SYMBOL}'",
    "history_asof": f"{B} SELECT * FROM brand WHERE date <= DATE '{AS_OF}'",
    "bars_on_date": f"{B} SELECT * FROM brand WHERE date = DATE '{AS_OF}'",
    "bars_between": f"{B} SELECT * FROM brand WHERE symbol = '{SYMBOL}' AND date BETWEEN DATE '{SPAN[0]}' AND DATE '{SPAN[1]}'",
    "dates_between": f"{B} SELECT date FROM brand WHERE symbol = '{SYMBOL}' AND date BETWEEN DATE '{SPAN[0]}' AND DATE '{SPAN[1]}'",
    "point_lookup": f"{SIG} SELECT b.* FROM brand b JOIN sig ON b.symbol = sig.symbol AND b.date = sig.scan_date",
    "existing_bars": f"WITH {BRAND}, {UNIVERSE} SELECT symbol, DATE '{AS_OF}' AS date FROM uni WHERE EXISTS (SELECT 1 FROM brand b WHERE b.symbol = uni.symbol AND b.date = DATE '{AS_OF}')",
    "top10_signals": f"{SIG} SELECT * FROM sig ORDER BY scan_date DESC, symbol, rule_name LIMIT 10",
    "top10_runs": f"{SIG} SELECT scan_date AS run_date, count(*) AS stocks_flagged FROM sig GROUP BY 1 ORDER BY 1 DESC LIMIT 10",
    "latest_bar": f"{B} SELECT * FROM brand QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1",
    "latest_date": f"{B} SELECT symbol, max(date) AS latest_date FROM brand GROUP BY symbol",
    "signals_by_date": f"{LENIENT} SELECT symbol, date AS scan_date, 'Breakout Confirmed' AS rule_name, round(confidence, 6) AS confidence FROM ind WHERE matched AND date = DATE '{SIGNAL_DATE}'",
    "signal_metadata": f"{LENIENT} SELECT symbol, date AS scan_date, round(adj_close, 6) AS close, CAST(volume AS BIGINT) AS volume, {R6('rsi', 'sma20')}, avg_volume20 FROM ind WHERE matched",
    "two_rules": f"""{SHORT} SELECT symbol, date AS scan_date, 'Breakout Confirmed' AS rule_name, round(confidence, 6) AS confidence FROM ind WHERE matched
      UNION ALL SELECT symbol, date, 'Breakout Short', round(confidence, 6) FROM brief WHERE matched""",
    "eligible_signals": f"""{RET} SELECT symbol, scan_date, rule_name, horizon_days FROM due WHERE scan_date <= {added("DATE '2000-06-30'", "(-due.horizon_days)")}
      AND NOT EXISTS (SELECT 1 FROM ret r WHERE r.horizon_days <> 10 AND r.symbol = due.symbol AND r.scan_date = due.scan_date AND r.horizon_days = due.horizon_days)""",
    "scan_eval": f"""{I} SELECT symbol, date, n, volume, {R6("rsi", "sma20", "sma50", "sma200")}, avg_volume20, {R6("recent_high")}, enough_bars, breaks_out, gap_small, volume_confirms, rsi_strong, trend_up, matched, {R6("confidence")}
      FROM (SELECT * FROM ind WHERE date <= DATE '{AS_OF}') QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1""",
    "scan_asof": f"WITH {USER}, {frame('usr')}, {calendar(*EVENTS_CALENDAR)}, {FIRED % '2024-02-09'} SELECT symbol, scan_date, round(confidence, 6) AS confidence FROM fired",
    "scan_for_date": f"""WITH {BRAND}, {UNIVERSE}, {frame('brand', volume=0.5, rsi=30)} SELECT symbol, DATE '{SCAN_DATE}' AS scan_date, 'Breakout Confirmed' AS rule_name, round(confidence, 6) AS confidence
      FROM (SELECT * FROM ind WHERE date <= DATE '{SCAN_DATE}' AND symbol IN (SELECT symbol FROM uni WHERE is_active) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) WHERE matched""",
    "run_summary": f"""WITH {BRAND}, {UNIVERSE}, {frame('brand', volume=0.5, rsi=30)}, l AS (SELECT * FROM ind WHERE date <= DATE '{SCAN_DATE}' AND symbol IN (SELECT symbol FROM uni WHERE is_active) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)
      SELECT DATE '{SCAN_DATE}' AS run_date, CAST(count(*) AS INTEGER) AS stocks_scanned, CAST(count(*) FILTER (matched) AS INTEGER) AS stocks_flagged, 'SUCCESS' AS status FROM l""",
    "status_counts": f"""{SIG}, {UNIVERSE} SELECT 'bars' AS kind, count(*) AS n FROM brand UNION ALL SELECT 'active', count(*) FROM uni WHERE is_active UNION ALL SELECT 'signals', count(*) FROM sig""",
    "outcomes_by_horizon": f"{RET} SELECT CAST(horizon_days AS INTEGER) AS horizon_days, count(*) AS n FROM ret GROUP BY 1",
    "signals_per_date": f"{SIG} SELECT scan_date, count(*) AS n FROM sig GROUP BY 1",
    "dup_bars": "SELECT CAST(l_orderkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "distinct_symbols": f"{B} SELECT count(DISTINCT symbol) AS n FROM brand",
    "date_span": f"{B} SELECT min(date) AS first_date, max(date) AS last_date FROM brand",
    "total_volume": f"{B} SELECT CAST(sum(volume) AS BIGINT) AS total_volume FROM brand",
    "null_violations": f"{B} SELECT count(*) AS bars, " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS null_{c}" for c in ("symbol", "date", "open_price", "high_price", "low_price", "close_price", "adj_close", "volume")) + " FROM brand",
    "rsi14": f"{I} " + ONE.format("round(rsi, 6)", "rsi14"),
    **{n: f"{I} " + ONE.format(f"round({n}, 6)", n) for n in ("sma20", "sma50", "sma200", "atr14", "recent_high")},
    "avg_volume20": f"{I} " + ONE.format("avg_volume20", "avg_volume20"),
    "trend_flags": f"{I} SELECT symbol, date, above_sma20, above_sma50, above_sma200 FROM ind",
    "indicator_bundle": f"{I} SELECT symbol, date, {R6('rsi', 'sma20', 'sma50', 'sma200')}, avg_volume20, above_sma20, above_sma50, above_sma200 FROM ind",
    "breakout_conditions": f"{I} SELECT symbol, date, enough_bars, breaks_out, gap_small, volume_confirms, rsi_strong, trend_up, matched FROM ind",
    "breakout_signals": f"{SIG} SELECT * FROM sig",
    "breakout_confidence": f"{I} SELECT symbol, date, round(confidence, 6) AS confidence FROM ind",
    "rule_snapshot": f"{SIG} SELECT DISTINCT rule_name, '1.1' AS rule_version, '{WIDE_SNAPSHOT}' AS parameter_snapshot FROM sig",
    "calendar_sessions": f"WITH {calendar('2022-12-01', '2028-12-31', ['2024-02-05'], ['2024-03-02'])} SELECT date, session, is_trading, le, lt FROM cal",
    "next_trading_day": f"WITH {calendar(*EVENTS_CALENDAR)} SELECT day, {added('day', '1')} AS result FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)",
    "previous_trading_day": f"WITH {calendar(*EVENTS_CALENDAR)} SELECT day, {added('day', '(-1)')} AS result FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)",
    "add_trading_days": f"WITH {LONG_CALENDAR} SELECT day, n, {added('day', 'n')} AS result FROM (SELECT CAST(day AS DATE) AS day, n FROM {values(ADDS, 'day, n')})",
    "trading_days_between": f"WITH {LONG_CALENDAR} SELECT a, b, (SELECT le FROM cal WHERE date = b) - (SELECT le FROM cal WHERE date = a) AS days FROM (SELECT CAST(a AS DATE) AS a, CAST(b AS DATE) AS b FROM {values(PAIRS, 'a, b')})",
    "forward_returns": f"{RET} SELECT symbol, scan_date, rule_name, CAST(horizon_days AS INTEGER) AS horizon_days, entry_price, exit_price, round(fr, 9) AS forward_return, TIMESTAMP '2002-12-30' AS computed_at FROM ret",
    "can_ingest": f"SELECT *, ingestion_status IN ('PENDING', 'FAILED') AS can_ingest FROM {STATES}",
    "can_scan": f"SELECT *, ingestion_status = 'SUCCESS' AND coalesce(stocks_ingested, 0) > 0 AND scan_status IN ('PENDING', 'FAILED') AS can_scan FROM {STATES}",
    "simulate_cycles": f"""WITH {USER}, {frame('usr')}, {calendar(*EVENTS_CALENDAR)}, {FIRED % EVENTS_CALENDAR[1]},
      cyc AS (SELECT CAST(c.le - b.le AS INTEGER) AS cycle, c.date AS trading_date FROM cal c, cal b WHERE b.date = DATE '{BASE}' AND c.is_trading AND c.le > b.le AND c.le <= b.le + {CYCLES}),
      ok AS (SELECT f.symbol, f.scan_date FROM fired f WHERE f.scan_date IN (SELECT trading_date FROM cyc) AND EXISTS (SELECT 1 FROM usr WHERE usr.date = f.scan_date)),
      done AS (SELECT t.date AS trading_date FROM ok, (SELECT unnest([5, 10, 20]) AS h) hs JOIN cal c ON c.date = ok.scan_date JOIN cal t ON t.is_trading AND t.le = c.le + h
        WHERE EXISTS (SELECT 1 FROM usr e WHERE e.symbol = ok.symbol AND e.date = ok.scan_date AND e.close_price <> 0) AND EXISTS (SELECT 1 FROM usr e WHERE e.symbol = ok.symbol AND e.date = t.date))
      SELECT cycle, trading_date, (SELECT count(*) FROM usr WHERE date = trading_date) AS ingested,
        CASE WHEN EXISTS (SELECT 1 FROM usr WHERE date = trading_date) THEN (SELECT count(DISTINCT symbol) FROM usr WHERE date <= trading_date) ELSE 0 END AS scanned,
        (SELECT count(*) FROM ok WHERE scan_date = trading_date) AS signals, (SELECT count(*) FROM done WHERE done.trading_date = cyc.trading_date) AS outcomes FROM cyc""",
    "table_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")),
    "ingest_count_by_date": f"WITH {BRAND}, {UNIVERSE} SELECT date, count(*) AS n FROM brand WHERE symbol IN (SELECT symbol FROM uni WHERE is_active) GROUP BY date",
    "ingest_gaps": f"WITH {BRAND}, {UNIVERSE} SELECT uni.symbol, max(date) AS latest_date, CAST(DATE '2002-01-31' - max(date) AS INTEGER) AS days FROM uni LEFT JOIN brand USING (symbol) GROUP BY uni.symbol",
    "fresh_bars": f"{B} SELECT symbol, date FROM brand WHERE date > DATE '{AS_OF}'",
    "dq_price_spike": f"""{B} SELECT symbol, date, false AS has_null, coalesce(abs((close_price - p) / p) > 0.4, false) AS price_spike, least(open_price, high_price, low_price, close_price, adj_close) < 0.01 AS price_too_low,
      volume = 0 AS zero_volume, CAST(date - pd AS INTEGER) AS days_since FROM (SELECT *, lag(close_price) OVER w AS p, lag(date) OVER w AS pd FROM brand WINDOW w AS (PARTITION BY symbol ORDER BY date))""",
    "dq_accepted": f"""{B}, before AS (SELECT symbol, max(date) AS date, arg_max(close_price, date) AS close_price FROM brand WHERE date <= DATE '{AS_OF}' GROUP BY symbol),
      rows AS (SELECT symbol, date, close_price, least(open_price, high_price, low_price, close_price, adj_close) AS low, true AS fresh FROM brand WHERE date >= DATE '1999-07-01' UNION ALL SELECT symbol, date, close_price, close_price, false FROM before),
      seen AS (SELECT *, lag(close_price) OVER (PARTITION BY symbol ORDER BY date) AS p FROM rows)
      SELECT symbol, date FROM seen WHERE fresh AND symbol NOT IN (SELECT symbol FROM seen WHERE fresh AND (abs((close_price - p) / p) > 400 OR low < 0.01))""",
    "quote_tickers": f"WITH {UNIVERSE} SELECT symbol, CASE WHEN symbol < 'Brand#3' THEN symbol || '.NS' ELSE symbol END AS ticker, CAST(epoch(TIMESTAMP '{SPAN[0]} 00:00:00') AS BIGINT) AS first_second, CAST(epoch(TIMESTAMP '{SPAN[1]} 23:59:59') AS BIGINT) AS last_second FROM uni",
    "latest_quotes": "SELECT * FROM (VALUES ('AAA', DATE '2024-01-04', 4.0::DOUBLE, 4.5::DOUBLE, 3.5::DOUBLE, 4.25::DOUBLE, 4.25::DOUBLE, 2147483647::INTEGER), ('BBB', DATE '2024-01-03', 3.0, 3.5, 2.5, 3.25, 3.25, NULL)) t(symbol, date, open_price, high_price, low_price, close_price, adj_close, volume)",
    "closures": "SELECT CAST(date AS DATE) AS date, reason, TIMESTAMP '2024-01-02 08:00:00' AS created_at FROM (VALUES ('2024-01-03', 'storm'), ('2024-01-04', 'the owner''s feast')) t(date, reason)",
    "states": f"SELECT {STATE_COLUMNS} FROM {STATE_ROWS}",
    "state_of_date": f"SELECT {STATE_COLUMNS} FROM {STATE_ROWS} WHERE trading_date = DATE '2024-01-30'",
    "parse_quotes": f"""WITH {PAYLOAD_ROWS}, t AS (SELECT symbol, j, unnest(range(CAST(json_array_length(j, '$.chart.result[0].timestamp') AS BIGINT))) AS i FROM p WHERE json_array_length(j, '$.chart.result[0].timestamp') > 0),
      v AS (SELECT symbol, CAST(make_timestamp(CAST(j->('$.chart.result[0].timestamp[' || i || ']') AS BIGINT) * 1000000) AS DATE) AS date, {", ".join(f"CAST(j->('$.chart.result[0].indicators.quote[0].{c}[' || i || ']') AS DOUBLE) AS {c}_price" for c in ("open", "high", "low", "close"))},
        CAST(j->('$.chart.result[0].indicators.adjclose[0].adjclose[' || i || ']') AS DOUBLE) AS adj, json_array_length(j, '$.chart.result[0].indicators.quote[0].volume') AS vn, CAST(j->('$.chart.result[0].indicators.quote[0].volume[' || i || ']') AS BIGINT) AS vol, i FROM t)
      SELECT symbol, date, open_price, high_price, low_price, close_price, coalesce(adj, close_price) AS adj_close, CASE WHEN vn > i THEN CAST(least(greatest(coalesce(vol, 0), 0), 2147483647) AS INTEGER) END AS volume FROM v WHERE close_price IS NOT NULL AND close_price <> 0""",
    "quote_status": f"WITH {PAYLOAD_ROWS} SELECT symbol, CASE WHEN coalesce(json_array_length(j, '$.chart.result[0].timestamp'), 0) > 0 THEN 'OK' ELSE 'SYMBOL_NOT_FOUND' END AS status FROM p",
}
ORACLES["quotes_source"] = f"{B} SELECT * FROM brand WHERE date BETWEEN DATE '{SPAN[0]}' AND DATE '{SPAN[1]}'"
ORACLES["atomic_append"] = ORACLES["bars_brand"]
ETYPE = f"etype AS ({ORACLES['bars_etype']})"
ORACLES["asof_events"] = f"""WITH {ETYPE} SELECT e.event_id, e.event_type AS symbol, b.known_at, b.close_price FROM events e
  ASOF LEFT JOIN (SELECT symbol, close_price, date + INTERVAL 1 HOUR AS known_at FROM etype) b ON e.event_type = b.symbol AND e.ts >= b.known_at"""
ORACLES["indicators_sliced"] = f"WITH {ETYPE}, {frame('etype')} SELECT symbol, date, n, {R6('rsi', 'sma20', 'sma50', 'sma200', 'atr14', 'recent_high')}, avg_volume20, above_sma20, above_sma50, above_sma200 FROM ind"
ORACLES["scan_incremental"] = f"SELECT symbol, date, n, volume, rsi, sma20, sma50, sma200, avg_volume20, recent_high, matched FROM ({ORACLES['scan_eval']})"
ORACLES["isolated_signals"] = f"""{LENIENT} SELECT symbol, date AS scan_date, 'Plain Breakout' AS rule_name, CAST(NULL AS VARCHAR) AS error FROM ind WHERE matched AND symbol <> 'Brand#22'
  UNION ALL SELECT symbol, max(date), 'Plain Breakout', 'ValueError' FROM brand WHERE symbol = 'Brand#22' GROUP BY symbol"""
ORACLES["scan_run"] = f"SELECT run_date, CAST(stocks_scanned AS BIGINT) AS stocks_scanned, CAST(stocks_flagged AS BIGINT) AS stocks_flagged, CAST(stocks_flagged AS BIGINT) AS signals_stored, status, true AS timed FROM ({ORACLES['run_summary']})"
ORACLES["trailing_stop"] = f"""WITH RECURSIVE {BRAND}, s AS (SELECT symbol, date, adj_close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM brand),
  r(symbol, i, date, peak, action, value) AS (SELECT symbol, i, date, adj_close, 'enter', adj_close FROM s WHERE i = 1
    UNION ALL SELECT s.symbol, s.i, s.date, CASE WHEN r.peak IS NULL THEN s.adj_close WHEN s.adj_close < greatest(r.peak, s.adj_close) * 5e-1 THEN NULL ELSE greatest(r.peak, s.adj_close) END,
      CASE WHEN r.peak IS NULL THEN 'enter' WHEN s.adj_close < greatest(r.peak, s.adj_close) * 5e-1 THEN 'leave' END,
      CASE WHEN r.peak IS NULL THEN s.adj_close WHEN s.adj_close < greatest(r.peak, s.adj_close) * 5e-1 THEN greatest(r.peak, s.adj_close) END FROM r JOIN s ON s.symbol = r.symbol AND s.i = r.i + 1)
  SELECT symbol, date, action, value FROM r WHERE action IS NOT NULL"""
ORACLES["missing_trading_days"] = f"""WITH {BRAND}, {calendar(*CALENDAR)}, spans AS (SELECT symbol, date, lead(date) OVER (PARTITION BY symbol ORDER BY date) AS nxt FROM brand WHERE date BETWEEN DATE '{CALENDAR[0]}' AND DATE '{CALENDAR[1]}')
  SELECT symbol, min(c.date) AS first_missing, max(c.date) AS last_missing, CAST(count(*) AS INTEGER) AS days FROM spans JOIN cal c ON c.is_trading AND c.date > spans.date AND c.date < spans.nxt GROUP BY symbol, spans.date"""
ORACLES["streamed_signals"] = ORACLES["scan_asof"]
ORACLES["bucketed_bundle"] = ORACLES["indicator_bundle"]
ORACLES["bucketed_latest"] = ORACLES["latest_bar"]
ORACLES["batch_total"] = "SELECT count(*) AS cycles, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("ingested", "scanned", "signals", "outcomes")) + f" FROM ({ORACLES['simulate_cycles']})"
