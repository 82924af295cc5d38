"""The registered queries in SQL for DuckDB, written on their own terms.

Nothing here is generated from the Spark code: projected rows are a union with a
range, sources are ranked by a window, admission is a fold over a list.
"""

from __future__ import annotations

# Colours, refusal messages, labels and refused names equal the operators'.
GREEN, RED = "rgba(144,238,144,0.3)", "rgba(255,182,193,0.3)"
BULL, BEAR = "rgba(38,166,154,0.9)", "rgba(239,83,80,0.9)"


def _bars(ticker: str = "p_brand", join: bool = True) -> str:
    source = "lineitem JOIN part ON l_partkey = p_partkey" if join else "lineitem"
    return f"""
    SELECT {ticker} AS ticker, CAST(l_shipdate AS DATE) AS time,
           arg_min(l_extendedprice, (l_orderkey, l_extendedprice)) AS open,
           max(l_extendedprice) AS high,
           min(l_extendedprice) AS low,
           arg_max(l_extendedprice, (l_orderkey, l_extendedprice)) AS close,
           count(*) AS volume
    FROM {source}
    GROUP BY ALL"""


BRAND_BARS = _bars()
SUPPLIER_BARS = _bars("'S' || l_suppkey", join=False)


def _mid(n: int) -> str:
    frame = f"(PARTITION BY ticker ORDER BY time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"""CASE WHEN count(high) OVER {frame} = {n} AND count(low) OVER {frame} = {n}
        THEN (max(high) OVER {frame} + min(low) OVER {frame}) / 2 END"""


def _cloud(bars: str, t: int = 9, k: int = 26, lag: int = 26, b: int = 52, s: int = 26) -> str:
    """CTEs ending in `cloud`."""
    return f"""
    bars AS ({bars}),
    based AS (
      SELECT *, {_mid(t)} AS tenkan_sen, {_mid(k)} AS kijun_sen, {_mid(b)} AS mid_b,
             lead(close, {lag}) OVER (PARTITION BY ticker ORDER BY time) AS chikou_span
      FROM bars),
    ends AS (SELECT ticker, max(time) AS last FROM bars GROUP BY ticker),
    longer AS (
      SELECT ticker, time, open, high, low, close, volume, tenkan_sen, kijun_sen, chikou_span,
             (tenkan_sen + kijun_sen) / 2 AS mid_a, mid_b, false AS is_projected
      FROM based
      UNION ALL
      SELECT ticker, last + CAST(i AS INTEGER), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
             NULL, NULL, true
      FROM ends, range(1, {s + 1}) AS r(i)),
    shifted AS (
      SELECT *, lag(mid_a, {s}) OVER (PARTITION BY ticker ORDER BY time) AS senkou_span_a,
             lag(mid_b, {s}) OVER (PARTITION BY ticker ORDER BY time) AS senkou_span_b
      FROM longer),
    cloud AS (
      SELECT ticker, time, open, high, low, close, volume, tenkan_sen, kijun_sen, chikou_span,
             senkou_span_a, senkou_span_b,
             CASE WHEN senkou_span_a > senkou_span_b THEN '{GREEN}' ELSE '{RED}' END AS cloud_color,
             is_projected
      FROM shifted)"""


BRAND_CLOUD = "WITH " + _cloud(BRAND_BARS)

_LONG = " UNION ALL ".join(
    f"SELECT ticker, '{line}' AS line, time, {line} AS value FROM cloud WHERE {line} IS NOT NULL"
    for line in ("tenkan_sen", "kijun_sen", "chikou_span", "senkou_span_a", "senkou_span_b")
)

_BANDS = """
    SELECT ticker, time,
           CASE WHEN senkou_span_a >= senkou_span_b THEN senkou_span_a END AS bull_top,
           CASE WHEN senkou_span_a >= senkou_span_b THEN senkou_span_b END AS bull_bottom,
           CASE WHEN senkou_span_a < senkou_span_b THEN senkou_span_b END AS bear_top,
           CASE WHEN senkou_span_a < senkou_span_b THEN senkou_span_a END AS bear_bottom
    FROM cloud WHERE senkou_span_a IS NOT NULL AND senkou_span_b IS NOT NULL"""

_NORMAL = """
    normal AS (
      SELECT 'S' || l_suppkey AS ticker,
             CASE WHEN l_linenumber <> 7 THEN CAST(l_shipdate AS DATE) END AS time,
             l_extendedprice AS open,
             CASE WHEN l_discount <> 0 THEN l_extendedprice END AS high,
             l_quantity AS low, l_extendedprice AS close, CAST(l_linenumber AS BIGINT) AS volume
      FROM lineitem)"""

# One listing: series files by year, dated and undated snapshots, the registry.
_OBJECTS = """
    lines AS (
      SELECT replace(p_brand, '#', '') AS symbol, CAST(l_shipdate AS DATE) AS day, l_returnflag,
             l_shipdate
      FROM lineitem JOIN part ON l_partkey = p_partkey),
    objects AS (
      SELECT 'cache/' || symbol || '_' || strftime(day, '%Y-%m-%d') || '.json' AS key,
             count(*) * 64 AS size, max(l_shipdate) AS last_modified
      FROM lines GROUP BY symbol, day
      UNION ALL
      SELECT 'data/' || symbol || '_' || year(day) || '_data.csv', count(*) * 64, max(l_shipdate)
      FROM lines GROUP BY symbol, year(day)
      UNION ALL
      SELECT 'cache/' || symbol || '_' || l_returnflag || '.json', count(*) * 64, max(l_shipdate)
      FROM lines GROUP BY symbol, l_returnflag
      UNION ALL
      SELECT 'data/available_tickers.txt', count(*) * 64, max(l_shipdate) FROM lines)"""

_DATED = (
    _OBJECTS
    + """,
    dated AS (
      SELECT *, TRY_CAST(regexp_extract(key, '_([0-9-]+)[.]json$', 1) AS DATE) AS cache_date
      FROM objects WHERE key LIKE 'cache/%')"""
)

_EXPIRED = """cache_date IS NOT NULL
      AND CAST(cache_date AS TIMESTAMP) < TIMESTAMP '1998-09-01 12:00:00' - INTERVAL 7 DAY"""

_CATALOG = """
    SELECT split_part(split_part(key, '/', -1), '_', 1) AS ticker, key, size, last_modified
    FROM objects WHERE key LIKE 'data/%' AND key LIKE '%.csv' AND contains(key, '_1998_data.csv')"""

# A month's bars are the snapshot of its last day, fresh if its lines are even in number.
_SNAPSHOT = f"""
    bars AS ({BRAND_BARS}),
    snapshot AS (
      SELECT ticker, time, open, high, low, close, volume
      FROM (SELECT *, sum(volume) OVER (PARTITION BY ticker) AS lines FROM bars
            WHERE last_day(time) = DATE '1998-06-30')
      WHERE lines % 2 = 0)"""

_LANDING = f"""
    landing AS (
      {_bars("CASE WHEN p_size > 40 THEN p_brand ELSE 'B' || split_part(p_brand, '#', 2) END")}),
    valid AS (SELECT * FROM landing WHERE NOT contains(ticker, '#')),
    collected AS (
      SELECT * FROM valid WHERE time >= DATE '1997-01-01' AND time < DATE '1997-12-31')"""

_REGISTRY_LINES = """
    registry_lines AS (
      SELECT 'B' || split_part(p_brand, '#', 2) AS ticker FROM part WHERE p_size = 50)"""

_MERGE = """
    existing AS (SELECT DISTINCT ticker FROM registry_lines),
    fresh AS (
      SELECT ticker, row_number() OVER (ORDER BY ticker) AS n
      FROM (SELECT DISTINCT ticker FROM {new} WHERE ticker NOT IN (SELECT ticker FROM existing))),
    free AS (SELECT 24 - count(*) AS slots FROM existing)"""

_ACCESS_SUMMARY = """
    SELECT upper(event_type) AS ticker, 'data_access' AS action, count(*) AS attempts,
           count(*) FILTER (WHERE event_type <> 'error') AS succeeded,
           count(*) FILTER (WHERE event_type = 'error') AS failed,
           min(ts) AS first_seen, max(ts) AS last_seen
    FROM events GROUP BY event_type"""


def _admitted(key: str, seconds: int) -> str:
    """Per key the list of admitted instants, folded over its ordered instants.

    Every element is a list of one instant, so that the fold's state, the admitted
    instants so far, has the elements' type.
    """
    return f"""
    folded AS (
      SELECT {key}, count(*) AS requests,
             list_reduce(
               list_prepend(CAST([] AS BIGINT[]), list([epoch_us(ts)] ORDER BY ts, event_id)),
               lambda kept, now:
                 CASE WHEN len(list_filter(kept[-5:], lambda t: now[1] - t < CAST({seconds} AS BIGINT) * 1000000)) >= 5
                      THEN kept ELSE list_concat(kept, now) END) AS admitted
      FROM events GROUP BY {key})"""


_AUDIT = f"""
    WITH {_admitted("user_id", 86_400)}
    SELECT event_id, user_id, ts, list_contains(admitted, epoch_us(ts)) AS admitted
    FROM events JOIN folded USING (user_id)"""


def _summary(key: str, seconds: int) -> str:
    return f"""
    WITH {_admitted(key, seconds)}
    SELECT {key}, requests, CAST(len(admitted) AS BIGINT) AS admitted,
           CAST(requests - len(admitted) AS BIGINT) AS refused
    FROM folded"""


_NAMES = r"""
    typed AS (
      SELECT c_custkey, CASE c_custkey % 10
          WHEN 0 THEN chr(32) || chr(9) || lower(c_mktsegment) || chr(10)
          WHEN 1 THEN 'a' || right(c_name, 4)
          WHEN 2 THEN 'A@' || right(c_name, 2)
          WHEN 3 THEN 'test '
          WHEN 4 THEN '   '
          WHEN 5 THEN ''
          WHEN 6 THEN 'delete'
          WHEN 7 THEN 'x' || right(c_name, 3) || '  '
          WHEN 8 THEN 'drop' END AS ticker
      FROM customer),
    cleaned AS (
      SELECT *, regexp_replace(upper(ticker), '^\s+|\s+$', '', 'g') AS clean FROM typed),
    judged AS (
      SELECT *, CASE
          WHEN ticker IS NULL OR ticker = '' THEN 'Ticker must be a non-empty string'
          WHEN length(clean) < 1 OR length(clean) > 5 THEN 'Ticker must be 1-5 characters long'
          WHEN NOT regexp_full_match(clean, '[A-Z0-9]+')
            THEN 'Ticker must contain only letters and numbers'
          WHEN clean IN ('TEST', 'SPAM', 'HACK', 'NULL', 'ADMIN', 'DELETE', 'DROP', 'EXEC')
            THEN 'Ticker ''' || clean || ''' is not allowed' END AS reason
      FROM cleaned)"""

_RANKED = """
    provider AS (SELECT * FROM bars),
    offered AS (
      SELECT *, 1 AS rank, 's3_cache' AS source, 'AWS S3 cache' AS label FROM snapshot
      UNION ALL
      SELECT *, 2, 's3_csv', 'AWS S3 CSV' FROM bars
      WHERE CAST(split_part(ticker, '#', 2) AS INTEGER) % 2 = 0 AND year(time) = 1998
      UNION ALL
      SELECT *, 3, 'local_csv', 'local CSV backup' FROM bars
      WHERE ticker = 'Brand#25' AND year(time) = 1999
      UNION ALL
      SELECT *, 4, 'yahoo_finance', 'Yahoo Finance' FROM provider)"""


def oracle_sql() -> dict[str, str]:
    bars = f"WITH bars AS ({BRAND_BARS})"
    suppliers = f"WITH bars AS ({SUPPLIER_BARS})"
    sizes = (
        suppliers + ", sizes AS (SELECT ticker, count(*) AS count FROM bars GROUP BY ticker)"
    )
    cloud = BRAND_CLOUD + " SELECT * FROM cloud"
    arrivals = _MERGE.format(new="valid")
    collected = _MERGE.format(new="collected")
    return {
        "ichimoku_cloud": cloud,
        "ichimoku_blocks": cloud,
        "ichimoku_fast": f"WITH {_cloud(SUPPLIER_BARS, 5, 10, 10, 20, 10)} SELECT * FROM cloud",
        "cloud_parameters": f"""WITH {_cloud(SUPPLIER_BARS, 5, 10, 10, 20, 10)}
            SELECT count(*) AS count, CAST(5 AS BIGINT) AS conversion_len,
                   CAST(10 AS BIGINT) AS base_len, CAST(10 AS BIGINT) AS lagging_len,
                   CAST(20 AS BIGINT) AS leading_span_b_len, CAST(10 AS BIGINT) AS cloud_shift
            FROM cloud""",
        "tenkan_sen": f"{bars} SELECT ticker, time, {_mid(9)} AS tenkan_sen FROM bars",
        "kijun_sen": f"{bars} SELECT ticker, time, {_mid(26)} AS kijun_sen FROM bars",
        "chikou_span": f"""{bars}
            SELECT ticker, time, lead(close, 26) OVER (PARTITION BY ticker ORDER BY time)
                AS chikou_span FROM bars""",
        "senkou_span_a": BRAND_CLOUD
        + " SELECT ticker, time, senkou_span_a, is_projected FROM cloud",
        "senkou_span_b": BRAND_CLOUD
        + " SELECT ticker, time, senkou_span_b, is_projected FROM cloud",
        "future_rows": BRAND_CLOUD
        + " SELECT ticker, time, open, high, low, close, volume, is_projected FROM cloud",
        "cloud_color": BRAND_CLOUD
        + " SELECT ticker, cloud_color, count(*) AS rows FROM cloud GROUP BY ALL",
        "line_series": f"{BRAND_CLOUD} {_LONG}",
        "candles": f"""{BRAND_CLOUD}
            SELECT ticker, time, open, high, low, close,
                   CASE WHEN open > close THEN '{BEAR}' ELSE '{BULL}' END AS color
            FROM cloud WHERE NOT is_projected""",
        "volume_bars": f"""{BRAND_CLOUD}
            SELECT ticker, time, volume AS value,
                   CASE WHEN close > open THEN '{BULL}' ELSE '{BEAR}' END AS color
            FROM cloud WHERE NOT is_projected""",
        "cloud_bands": f"{BRAND_CLOUD} {_BANDS}",
        "cloud_bands_long": f"{BRAND_CLOUD} {_BANDS}",
        "preview": f"""{bars}
            SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY time) AS INTEGER) AS row
            FROM bars QUALIFY row <= 5""",
        "last_bars": f"""{bars}
            SELECT * FROM bars
            QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY time DESC) = 1""",
        "records_json": f"""{BRAND_CLOUD}
            SELECT CAST(to_json(struct_pack(ticker, time := CAST(time AS VARCHAR), open, high, low,
                close, volume, tenkan_sen, kijun_sen, chikou_span, senkou_span_a, senkou_span_b,
                cloud_color, is_projected)) AS VARCHAR) AS record FROM cloud""",
        "normalize_bars": f"WITH {_NORMAL} SELECT * FROM normal",
        "bar_quality": f"""WITH {_NORMAL}
            SELECT ticker, count(*) AS rows,
                   count(*) FILTER (WHERE time IS NULL) AS unreadable_days,
                   count(time) - count(DISTINCT time) AS repeated_days,
                   count(*) FILTER (WHERE open IS NULL OR high IS NULL OR low IS NULL
                                    OR close IS NULL) AS missing_prices,
                   count(*) FILTER (WHERE high < low) AS inverted_prices
            FROM normal GROUP BY ticker""",
        "date_range": f"""{suppliers}
            SELECT * FROM bars WHERE time >= DATE '1997-01-01' AND time < DATE '1997-12-31'""",
        "landing": f"WITH {_LANDING} SELECT * FROM collected",
        "series_counts": f"{sizes} SELECT * FROM sizes",
        "size_guard": f"""{sizes}
            SELECT bars.* FROM bars JOIN sizes USING (ticker) WHERE count <= 530""",
        "size_guard_refused": f"{sizes} SELECT * FROM sizes WHERE count > 530",
        "csv_guard": f"""{suppliers}
            SELECT ticker, CAST(sum(length(concat_ws(',', time, open, high, low, close, volume)) + 1)
                AS BIGINT) + 32 AS bytes
            FROM bars GROUP BY ticker HAVING bytes > 26000""",
        "scan_csv": BRAND_BARS,
        "scan_parquet": BRAND_BARS,
        "ticker_validate": f"""WITH {_NAMES}
            SELECT c_custkey, ticker, CASE WHEN reason IS NULL THEN clean END AS symbol,
                   reason IS NULL AS is_valid, reason FROM judged""",
        "ticker_exists": f"""WITH {_OBJECTS}, catalog AS ({_CATALOG}),
            requested AS (SELECT replace(p_brand, '#', '') AS ticker FROM part
                          UNION SELECT p_type FROM part)
            SELECT ticker, ticker IN (SELECT ticker FROM catalog) AS exists FROM requested""",
        "registry_list": f"WITH {_REGISTRY_LINES} SELECT ticker FROM registry_lines",
        "registry_count": f"WITH {_REGISTRY_LINES} SELECT count(*) AS count FROM registry_lines",
        "registry_merge": f"""WITH {_LANDING}, {_REGISTRY_LINES}, {arrivals}
            SELECT ticker FROM existing
            UNION ALL SELECT ticker FROM fresh, free WHERE n <= slots""",
        "registry_refused": f"""WITH {_LANDING}, {_REGISTRY_LINES}, {arrivals}
            SELECT ticker FROM fresh, free WHERE n > slots""",
        "collect_ingest": f"""WITH {_LANDING}, {_REGISTRY_LINES}, {collected},
            sizes AS (SELECT ticker, count(*) FILTER (time >= DATE '1997-01-01' AND time < DATE '1997-12-31')
                AS rows_processed FROM valid GROUP BY ticker)
            SELECT ticker,
                   CASE WHEN rows_processed = 0 THEN 'no_data'
                        WHEN ticker IN (SELECT ticker FROM fresh, free WHERE n > slots)
                        THEN 'registry_full' ELSE 'stored' END AS status,
                   rows_processed, ends_with(ticker, '3') AS data_existed
            FROM sizes""",
        "collect_invalid": f"""WITH {_LANDING}
            SELECT DISTINCT ticker, 'Ticker must be 1-5 characters long' AS reason
            FROM landing WHERE contains(ticker, '#')""",
        "collect_registry": f"""WITH {_LANDING}, {_REGISTRY_LINES}, {collected}
            SELECT ticker FROM existing
            UNION ALL SELECT ticker FROM fresh, free WHERE n <= slots""",
        "csv_guard_kept": f"""{suppliers}
            SELECT * FROM bars WHERE ticker IN (
              SELECT ticker FROM bars GROUP BY ticker
              HAVING sum(length(concat_ws(',', time, open, high, low, close, volume)) + 1) + 32 <= 26000)""",
        "bars_from_records": cloud,
        "scan_csv_named": _bars("replace(p_brand, '#', '')"),
        "scan_objects": f"""{bars}
            SELECT replace(ticker, '#', '') || '_1998_data.csv' AS key,
                   CAST(sum(length(concat_ws(',', time, open, high, low, close, volume)) + 1)
                       AS BIGINT) + 32 AS size
            FROM bars GROUP BY ticker""",
        "scan_snapshots": f"""{bars}
            SELECT * EXCLUDE (lines)
            FROM (SELECT *, sum(volume) OVER (PARTITION BY ticker) AS lines FROM bars WHERE year(time) = 1998)
            WHERE lines % 2 = 0""",
        "scan_registry": f"""WITH {_LANDING}, {_REGISTRY_LINES}
            SELECT ticker FROM registry_lines UNION SELECT ticker FROM valid""",
        "snapshot_expire": f"""{bars}
            SELECT *, DATE '1998-08-26' AS cache_date FROM bars WHERE year(time) = 1996""",
        "snapshot_refresh": f"""{bars}
            SELECT *, DATE '1998-08-26' AS cache_date FROM bars WHERE year(time) = 1996
            UNION ALL
            SELECT *, DATE '1998-08-25' FROM bars WHERE year(time) = 1995 AND NOT ends_with(ticker, '1')
            UNION ALL
            SELECT *, DATE '1998-09-01' FROM bars WHERE ends_with(ticker, '1')""",
        "snapshot_compact": f"""{bars}
            SELECT *, DATE '1998-08-26' AS cache_date FROM bars WHERE year(time) = 1996
            UNION ALL
            SELECT *, DATE '1998-08-25' FROM bars WHERE year(time) = 1995 AND NOT ends_with(ticker, '1')
            UNION ALL
            SELECT *, DATE '1998-09-01' FROM bars WHERE ends_with(ticker, '1')""",
        "source_cascade": f"""WITH {_SNAPSHOT}, {_RANKED}
            SELECT * EXCLUDE (rank) FROM offered
            QUALIFY rank = min(rank) OVER (PARTITION BY ticker)""",
        "source_cascade_rows": f"""WITH {_SNAPSHOT}, {_RANKED}
            SELECT * EXCLUDE (rank) FROM offered
            QUALIFY rank = min(rank) OVER (PARTITION BY ticker)""",
        "series_read": f"{bars} SELECT * FROM bars WHERE ticker IN ('Brand#12', 'Brand#35')",
        "present_tickers": f"{bars} SELECT DISTINCT ticker FROM bars",
        "indicator_update": cloud,
        "snapshot_read": f"WITH {_SNAPSHOT} SELECT * FROM snapshot",
        "snapshot_write": BRAND_BARS,
        "snapshot_expired": f"WITH {_DATED} SELECT * FROM dated WHERE {_EXPIRED}",
        "snapshot_expired_ticker": f"""WITH {_DATED}
            SELECT * FROM dated WHERE {_EXPIRED} AND starts_with(key, 'cache/Brand12_')""",
        "snapshot_live": f"WITH {_DATED} SELECT * FROM dated WHERE NOT ({_EXPIRED})",
        "snapshot_all": f"WITH {_DATED} SELECT * FROM dated",
        "catalog_listing": f"WITH {_OBJECTS} {_CATALOG}",
        "cache_status": f"""WITH {_OBJECTS}
            SELECT count(*) AS total_files, CAST(sum(size) AS BIGINT) AS total_size,
                   round(sum(size) / 1048576, 2) AS size_mb
            FROM objects WHERE key LIKE 'cache/%'""",
        "cache_status_by_ticker": f"""WITH {_OBJECTS}
            SELECT split_part(split_part(key, '/', -1), '_', 1) AS ticker, count(*) AS files
            FROM objects WHERE key LIKE 'cache/%' GROUP BY ALL""",
        "store_metrics": f"""WITH {_OBJECTS}
            SELECT count(*) FILTER (WHERE key LIKE 'data/%') AS data_files,
                   count(*) FILTER (WHERE key LIKE 'cache/%') AS cache_files FROM objects""",
        "access_log_summary": _ACCESS_SUMMARY,
        "access_log_append": _ACCESS_SUMMARY,
        "access_stream": _ACCESS_SUMMARY,
        "admission_audit": _AUDIT,
        "admission_stream": _AUDIT,
        "admission_summary": _summary("event_type", 14_400),
        "admission_segments": _summary("event_type", 14_400),
        "admission_minute": _summary("user_id, event_type", 60),
    }
