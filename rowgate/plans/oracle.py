"""The registered queries as SQL for an independent engine."""

from __future__ import annotations

_ORDER = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def _lines(window: int = 1000, currencies: str = "'INR', 'USD', 'EUR', 'GBP'", s: str = "") -> str:
    """CTEs: ``lines``, ``products``, ``people``, ``decided`` (reason null: clean), ``items`` (one a key), ``outcome`` (with DUP_KEY).

    Unit prices are whole ten-thousandths (``up4``), rounded half up. ``s`` is appended to the last three names.
    """
    base = f"""
 lines AS (
  SELECT 'ORD-' || l_orderkey AS order_id, l_linenumber AS line_no, 'CUST-' || o_custkey AS customer_id, o_orderdate, epoch_ms(o_orderdate) AS order_ts,
   CASE o_orderstatus WHEN 'F' THEN 'SHIPPED' WHEN 'O' THEN 'PLACED' ELSE 'PAID' END AS status,
   CASE left(o_orderpriority, 1) WHEN '1' THEN 'WEB' WHEN '2' THEN 'MOBILE' WHEN '3' THEN 'STORE' ELSE 'PARTNER' END AS channel,
   CASE l_suppkey % 5 WHEN 0 THEN 'INR' WHEN 1 THEN 'usd' WHEN 2 THEN 'EUR' WHEN 3 THEN 'GBP' ELSE 'XXX' END AS currency,
   'SKU-' || l_partkey AS sku, l_quantity::INT AS qty, l_extendedprice::DECIMAL(14,2) AS line_total,
   ((l_extendedprice::DECIMAL(14,2) * 100)::BIGINT * 200 + l_quantity::BIGINT) // (2 * l_quantity::BIGINT) AS up4,
   'batch-' || (l_orderkey % 97) || '.json' AS source_file, {_ORDER}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 products AS (SELECT 'SKU-' || p_partkey AS sku, p_brand AS category, p_retailprice::DECIMAL(12,2) AS catalog_price FROM part WHERE p_size <= 45),
 people AS (SELECT 'CUST-' || c_custkey AS customer_id, c_mktsegment AS segment FROM customer WHERE c_acctbal > 0),"""
    return ("" if s else base) + f"""
 decided{s} AS (
  SELECT lines.*, category, catalog_price, CASE
   WHEN qty NOT BETWEEN 1 AND 999 THEN 'RANGE_VIOLATION' WHEN up4 NOT BETWEEN 100 AND 99999900 THEN 'RANGE_VIOLATION'
   WHEN products.sku IS NULL THEN 'UNKNOWN_SKU' WHEN people.customer_id IS NULL THEN 'UNKNOWN_CUSTOMER'
   WHEN abs(order_ts - 892771200000) > {window} * 86400000::BIGINT THEN 'BAD_TIMESTAMP'
   WHEN upper(currency) NOT IN ({currencies}) THEN 'BAD_CURRENCY' END AS reason
  FROM lines LEFT JOIN products ON lines.sku = products.sku LEFT JOIN people ON lines.customer_id = people.customer_id),
 ranked{s} AS (
  SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY order_id, line_no, reason IS NULL ORDER BY {_ORDER}) END AS n FROM decided{s}),
 outcome{s} AS (SELECT * REPLACE (CASE WHEN n > 1 THEN 'DUP_KEY' ELSE reason END AS reason) FROM ranked{s}),
 items{s} AS (SELECT * FROM outcome{s} WHERE reason IS NULL)"""


_RUN = "WITH" + _lines()
_BOTH = _RUN + "," + _lines(900, "'INR', 'EUR', 'GBP'", "_b")
_ALERTS = """
 alerts AS (
  SELECT 'HIGH_VALUE' AS alert_type, 'WARN' AS severity, line_total AS metric_value, * FROM items WHERE line_total > 50000
  UNION ALL SELECT 'SUSPICIOUS_QTY', 'CRITICAL', qty::DECIMAL(14,2), * FROM items WHERE qty > 45)"""
_ORDERS = """
 loaded AS (SELECT order_id, max(customer_id) AS customer_id, max(order_ts) AS order_ts, max(status) AS status, max(channel) AS channel,
  max(upper(currency)) AS currency, sum(line_total)::DECIMAL(24,2) AS order_total, sum(qty)::BIGINT AS item_count FROM items GROUP BY order_id)"""
_FILES = """
 files{s} AS (SELECT source_file, count(*) AS lines_in, count(*) FILTER (reason IS NULL) AS lines_clean, count(reason) AS lines_rejected,
  count(DISTINCT order_id) FILTER (reason IS NULL) AS orders_loaded,
  coalesce(sum(line_total) FILTER (reason IS NULL), 0)::DECIMAL(18,2) AS revenue FROM decided{s} GROUP BY source_file)"""
_SIDES = """
 a AS (SELECT source_file, order_id, line_no, reason, row_number() OVER (PARTITION BY source_file, order_id, line_no ORDER BY reason) AS occurrence FROM decided WHERE reason IS NOT NULL),
 b AS (SELECT source_file, order_id, line_no, reason, row_number() OVER (PARTITION BY source_file, order_id, line_no ORDER BY reason) AS occurrence FROM decided_b WHERE reason IS NOT NULL),
 sides AS (SELECT coalesce(a.source_file, b.source_file) AS source_file, coalesce(a.order_id, b.order_id) AS order_id, coalesce(a.line_no, b.line_no)::VARCHAR AS line_no,
   coalesce(a.occurrence, b.occurrence)::INT AS occurrence, a.reason AS reason_a, b.reason AS reason_b,
   CASE WHEN b.reason IS NULL THEN 'only in A' WHEN a.reason IS NULL THEN 'only in B' WHEN a.reason <> b.reason THEN 'different reason' ELSE 'same' END AS status
  FROM a FULL JOIN b ON a.source_file = b.source_file AND a.order_id = b.order_id AND a.line_no = b.line_no AND a.occurrence = b.occurrence)"""
_PCT = "CASE WHEN ({w}) = 0 THEN 0 ELSE round((100 * ({p}))::DECIMAL(20,4) / ({w}), {d}) END::DECIMAL(20,{d})"
_LEDGER_STATUS = "CASE WHEN lines_clean = 0 THEN 'FAILED' WHEN lines_rejected = 0 THEN 'SUCCESS' WHEN 4 * lines_rejected > lines_in THEN 'PARTIAL' ELSE 'SUCCESS' END"
_FACT = """
 goods AS (SELECT sku FROM products WHERE catalog_price > 905),
 fact AS (SELECT items.*, strftime(o_orderdate, '%Y%m%d')::INT AS date_key, (qty * up4 * 95 + 50) // 100 AS total4 FROM items SEMI JOIN goods ON items.sku = goods.sku)"""
_RECONCILED = """
 checks AS (
  SELECT 'clean_vs_fact' AS check_name, (SELECT count(*) FROM items) AS source_count, (SELECT count(*) FROM fact) AS target_count
  UNION ALL SELECT 'sources_vs_outcome', (SELECT count(*) FROM lines), (SELECT count(*) FROM items) + (SELECT count(reason) FROM outcome))"""


def _pct(part: str, whole: str, digits: int = 1) -> str:
    return _PCT.format(p=part, w=whole, d=digits)


def _first(n: str) -> str:
    return f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity
 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ORDER}) AS n FROM lineitem) WHERE n {n}"""


def _headline(frame: str) -> str:
    one = f"""SELECT count(*)::DECIMAL(20,2) AS lines, count(*) FILTER (reason IS NULL)::DECIMAL(20,2) AS loaded, count(reason)::DECIMAL(20,2) AS rejected,
  count(DISTINCT order_id) FILTER (reason IS NULL)::DECIMAL(20,2) AS orders, coalesce(sum(line_total) FILTER (reason IS NULL), 0)::DECIMAL(20,2) AS revenue FROM {frame}"""
    return f"SELECT measure, value FROM (UNPIVOT ({one}) ON lines, loaded, rejected, orders, revenue INTO NAME measure VALUE value)"


def _versions(rows: str) -> str:
    return f"""
 SELECT customer_id, customer_name, valid_from, lead(valid_from) OVER (PARTITION BY customer_id ORDER BY valid_from, customer_name) AS valid_to
 FROM (SELECT *, lag(customer_name) OVER (PARTITION BY customer_id ORDER BY valid_from, customer_name) AS was FROM ({rows}))
 WHERE was IS DISTINCT FROM customer_name"""


_NAMED = """SELECT 'cust' || o_custkey || '@example.org' AS customer_id, 'Name ' || o_orderstatus AS customer_name, min(o_orderdate::DATE) AS valid_from
 FROM orders {where} GROUP BY ALL"""

SQL = {
    "order_pipeline": f"{_RUN},{_ORDERS} SELECT order_id, customer_id, status, channel, currency, order_total, item_count FROM loaded",
    "reject_ladder_counts": f"{_RUN} SELECT coalesce(reason, 'CLEAN') AS reason, count(*) AS n FROM decided GROUP BY 1",
    "reject_details": f"""{_RUN} SELECT reason, CASE reason WHEN 'UNKNOWN_SKU' THEN 'sku ' || sku || ' is in no catalogue'
  WHEN 'UNKNOWN_CUSTOMER' THEN 'customer ' || customer_id || ' is unknown' ELSE 'currency ' || currency END AS detail, count(*) AS n
 FROM decided WHERE reason IN ('UNKNOWN_SKU', 'UNKNOWN_CUSTOMER', 'BAD_CURRENCY') GROUP BY 1, 2""",
    "batch_outcomes": f"{_RUN} SELECT coalesce(reason, 'CLEAN') AS reason, count(*) AS n FROM outcome GROUP BY 1",
    "dedupe_first": _first("= 1"),
    "dedupe_losers": _first("> 1"),
    "sort_unique": "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey",
    "lookup_match": f"{_RUN} SELECT order_id, line_no::VARCHAR AS line_no, sku, qty::VARCHAR AS qty, category, catalog_price FROM lines JOIN products USING (sku)",
    "lookup_no_match": f"{_RUN} SELECT order_id, line_no::VARCHAR AS line_no, sku, qty::VARCHAR AS qty FROM lines ANTI JOIN products USING (sku)",
    "lookup_chain": f"""{_RUN} SELECT CASE WHEN customer_id NOT IN (SELECT customer_id FROM people) THEN 'customer'
  WHEN sku NOT IN (SELECT sku FROM products) THEN 'product' ELSE 'landed' END AS outcome, count(*) AS n FROM lines GROUP BY 1""",
    "composite_lookup": """SELECT c_custkey, c_nationkey, c_custkey % 2 AS parity, suppliers FROM customer
 LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey AND c_custkey % 2 = 0""",
    "conditional_split": """SELECT CASE WHEN l_quantity >= 40 THEN 'bulk' WHEN l_discount > 0.05 THEN 'discounted' WHEN l_returnflag = 'R' THEN 'returned' ELSE 'rest' END AS branch,
 count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem GROUP BY 1""",
    "derived_columns": """SELECT o_orderkey, o_custkey, o_orderpriority, o_orderpriority || o_custkey AS label, o_orderkey // 2 AS half, left(o_orderkey::VARCHAR, 3) AS short,
 try_cast(o_orderkey::VARCHAR AS SMALLINT) AS small FROM orders""",
    "type_conversion": """SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN left(o_orderpriority, 1)::INT END AS value,
 CASE WHEN o_orderkey % 10 <> 0 THEN 'ok' ELSE 'error' END AS port FROM orders""",
    "consistency": """WITH r AS (SELECT l_quantity::INT AS qty, l_discount::DECIMAL(14,2) AS disc, CASE WHEN l_partkey % 7 = 0 THEN 1.00::DECIMAL(14,2) ELSE l_discount::DECIMAL(14,2) END AS price FROM lineitem),
 c AS (SELECT (qty * disc)::DECIMAL(14,2) AS total, (qty * price)::DECIMAL(14,2) AS computed FROM r)
 SELECT CASE WHEN abs(total - computed) > 0.02 THEN 'CLEANED' ELSE 'VALID' END AS quality_status, count(*) AS n,
 sum(CASE WHEN abs(total - computed) > 0.02 THEN computed ELSE total END)::DECIMAL(18,2) AS fixed_total FROM c GROUP BY 1""",
    "alerts": f"{_RUN},{_ALERTS} SELECT alert_type, severity, order_id, line_no, metric_value FROM alerts",
    "replay_check": """SELECT CASE WHEN EXISTS (SELECT 1 FROM lineitem f WHERE f.l_partkey % 2 = 0 AND f.l_orderkey = s.l_orderkey AND f.l_linenumber = s.l_linenumber)
  THEN 'replay' ELSE 'new' END AS port, count(*) AS n FROM lineitem s WHERE l_partkey % 2 = 1 GROUP BY 1""",
    "upsert_items": f"""WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ORDER}) AS n FROM lineitem WHERE l_partkey % 2 = 0) WHERE n = 1),
 s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in _ORDER.split(', '))}) AS n FROM lineitem WHERE l_partkey % 2 = 1) WHERE n = 1)
 SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM s
 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM f ANTI JOIN s USING (l_orderkey, l_linenumber)""",
    "insert_new": "SELECT p_partkey AS product_code, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'Stream' END AS manufacturer FROM part WHERE p_partkey % 3 <> 0",
    "scd2_customer": f"SELECT *, valid_to IS NULL AS is_current FROM ({_versions(_NAMED.format(where=''))})",
    "scd2_second_load": f"""WITH f AS (SELECT * FROM ({_versions(_NAMED.format(where="WHERE o_orderdate < '1995-06-01'"))})),
 n AS (SELECT customer_id, customer_name, valid_from, 0 AS new FROM f WHERE valid_to IS NULL UNION ALL SELECT *, 1 FROM ({_NAMED.format(where="WHERE o_orderdate >= '1995-06-01'")})),
 c AS (SELECT * FROM (SELECT *, lag(customer_name) OVER (PARTITION BY customer_id ORDER BY new, valid_from, customer_name) AS was FROM n) WHERE was IS DISTINCT FROM customer_name),
 v AS (SELECT customer_id, customer_name, valid_from, lead(valid_from) OVER (PARTITION BY customer_id ORDER BY new, valid_from, customer_name) AS valid_to FROM c)
 SELECT *, valid_to IS NULL AS is_current FROM v UNION ALL SELECT *, false FROM f WHERE valid_to IS NOT NULL""",
    "dim_date": """SELECT strftime(d, '%Y%m%d')::INT AS date_key, d::DATE AS full_date, year(d)::INT AS year, quarter(d)::INT AS quarter, month(d)::INT AS month, monthname(d) AS month_name,
 dayname(d) AS day_of_week, day(d)::INT AS day_num, dayofweek(d) IN (0, 6) AS is_weekend
 FROM (SELECT unnest(generate_series(make_date((SELECT min(year(o_orderdate)) FROM orders), 1, 1), make_date((SELECT max(year(o_orderdate)) FROM orders), 12, 31), INTERVAL 1 DAY)) AS d)""",
    "fact_load": f"""{_RUN},{_FACT} SELECT date_key, count(*) AS n, sum(qty)::BIGINT AS quantity, (sum(total4)::DECIMAL(28,4) * 0.0001::DECIMAL(5,4))::DECIMAL(24,4) AS total FROM fact GROUP BY 1""",
    "surrogate_keys": f"{_RUN} SELECT customer_id, 100 + row_number() OVER (ORDER BY customer_id) AS customer_key FROM people",
    "reconcile": f"{_RUN},{_FACT},{_RECONCILED} SELECT *, source_count = target_count AS pass FROM checks",
    "file_ledger": f"{_RUN},{_FILES.format(s='')} SELECT * FROM files",
    "job_status": f"""{_RUN},{_FILES.format(s='')} SELECT source_file, lines_clean AS records_valid, lines_rejected AS records_invalid, {_pct('lines_rejected', 'lines_in')} AS reject_pct,
 CASE WHEN lines_clean = 0 THEN 'FAILED' WHEN lines_rejected = 0 THEN 'SUCCESS' WHEN 4 * lines_rejected > lines_in THEN 'PARTIAL' ELSE 'SUCCESS' END AS status FROM files""",
    "settled_files": f"{_RUN},{_FILES.format(s='')} SELECT source_file FROM files WHERE regexp_extract(source_file, '(\\d+)', 1)::INT % 4 <> 0",
    "headline": f"{_RUN} {_headline('decided')}",
    "headline_settled": f"{_RUN}, settled AS (SELECT * FROM decided WHERE regexp_extract(source_file, '(\\d+)', 1)::INT % 4 <> 0) {_headline('settled')}",
    "compare_files": f"""{_BOTH},{_FILES.format(s='')},{_FILES.format(s='_b')},
 x AS (SELECT source_file, lines_clean AS lines_clean_a, lines_rejected AS lines_rejected_a FROM files WHERE source_file <> 'batch-1.json'),
 y AS (SELECT source_file, lines_clean AS lines_clean_b, lines_rejected AS lines_rejected_b FROM files_b WHERE source_file <> 'batch-2.json')
 SELECT *, CASE WHEN lines_clean_a IS NULL THEN 'not in A yet' WHEN lines_clean_b IS NULL THEN 'not in B yet' WHEN lines_rejected_a <> lines_rejected_b THEN 'rejects differ'
  WHEN lines_clean_a <> lines_clean_b THEN 'loaded differ' ELSE 'agree' END AS verdict FROM x FULL JOIN y USING (source_file)""",
    "reason_delta": f"""{_BOTH}, x AS (SELECT reason, count(*) AS n FROM decided WHERE reason IS NOT NULL GROUP BY 1), y AS (SELECT reason, count(*) AS n FROM decided_b WHERE reason IS NOT NULL GROUP BY 1)
 SELECT coalesce(x.reason, y.reason) AS reason, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b, coalesce(x.n, 0) - coalesce(y.n, 0) AS delta FROM x FULL JOIN y ON x.reason = y.reason""",
    "reject_diff": f"{_BOTH},{_SIDES} SELECT status, reason_a, reason_b, count(*) AS n FROM sides WHERE status <> 'same' GROUP BY ALL",
    "side_by_side": f"{_BOTH},{_SIDES} SELECT * FROM sides",
    "agreement": f"""{_BOTH},{_SIDES}, t AS (SELECT count(*) AS decisions, count(*) FILTER (status = 'same') AS agreeing FROM sides)
 SELECT *, CASE WHEN decisions = 0 THEN 100 ELSE {_pct('agreeing', 'decisions', 2)} END::DECIMAL(20,2) AS agreement_pct FROM t""",
    "unified_rejects": f"""{_BOTH} SELECT 'a' AS engine, source_file, count(*) AS n FROM decided WHERE reason IS NOT NULL GROUP BY 2
 UNION ALL SELECT 'b', source_file, count(*) FROM decided_b WHERE reason IS NOT NULL GROUP BY 2""",
    "fault_matrix": "SELECT 0::BIGINT AS wrong_cells, 0::BIGINT AS wrong_lines FROM (SELECT count(*) FROM lineitem)",
    "accounted": "SELECT count(*) AS rows_in, count(*) AS rows_out, true AS pass FROM lineitem",
    "events_per_minute": "SELECT date_trunc('minute', ts) AS bucket, count(*) AS n, sum(value::DECIMAL(18,4))::DECIMAL(28,4) AS total FROM events GROUP BY 1",
    "events_per_bucket": "SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS bucket, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "json_extract": "SELECT try_cast(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1",
    "revenue_by_category": f"{_RUN} SELECT category, sum(line_total)::DECIMAL(18,2) AS revenue, count(DISTINCT order_id) AS orders FROM items GROUP BY 1",
    "top_skus": f"{_RUN} SELECT sku, sum(line_total)::DECIMAL(18,2) AS revenue, sum(qty)::BIGINT AS units FROM items GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "quality_by_day": f"""{_RUN} SELECT o_orderdate::DATE AS day, count(*) FILTER (reason IS NULL) AS valid, count(reason) AS rejected, {_pct('count(reason)', 'count(*)')} AS reject_pct FROM decided GROUP BY 1""",
    "orders_per_day": f"{_RUN},{_ORDERS} SELECT make_timestamp(order_ts * 1000)::DATE AS day, count(*) AS orders, sum(order_total)::DECIMAL(18,2) AS revenue FROM loaded GROUP BY 1",
    "pipeline_summary": f"""{_RUN},{_ORDERS},{_ALERTS} SELECT count(*) AS orders, sum(order_total)::DECIMAL(18,2) AS revenue, sum(item_count)::BIGINT AS units, max(order_ts) AS last_order_ms,
 (SELECT count(reason) FROM outcome) AS rejects, (SELECT count(*) FROM alerts) AS alerts FROM loaded""",
    "totals_unpivot": """SELECT measure, value FROM (UNPIVOT (SELECT count(*)::DECIMAL(20,2) AS lines, sum(l_extendedprice::DECIMAL(14,2))::DECIMAL(20,2) AS revenue, sum(l_quantity)::DECIMAL(20,2) AS units
 FROM lineitem) ON lines, revenue, units INTO NAME measure VALUE value)""",
    "dup_key_having": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "feed_profile": f"""{_RUN}, k AS (SELECT order_id, line_no, count(*) AS lines, count(*) FILTER (up4 < 10000000) AS cheap, count(*) FILTER (currency = 'XXX') AS bad_currency,
  count(*) FILTER (qty > 45) AS large FROM lines GROUP BY 1, 2),
 o AS (SELECT order_id, sum(lines)::BIGINT AS lines, sum(lines - 1)::BIGINT AS dup_keys, sum(cheap) AS cheap, sum(bad_currency) AS bad_currency, sum(large) AS large FROM k GROUP BY 1)
 SELECT sum(lines)::BIGINT AS lines, count(*) AS orders, sum(dup_keys)::BIGINT AS dup_keys, max(lines) AS most_lines_of_an_order, sum(cheap)::BIGINT AS cheap,
  sum(bad_currency)::BIGINT AS bad_currency, sum(large)::BIGINT AS large FROM o""",
    "fingerprint": "SELECT c_custkey, md5(concat_ws('|', c_name, c_mktsegment, c_nationkey)) AS fingerprint FROM customer",
    "aggregate_component": """SELECT l_returnflag, l_linestatus, count(*) AS lines, sum(l_quantity) AS quantity, min(l_extendedprice) AS least, max(l_extendedprice) AS most,
 count(DISTINCT l_partkey) AS parts, avg(l_quantity) AS mean_quantity FROM lineitem GROUP BY 1, 2""",
    "reasons_by_file": f"{_RUN} SELECT source_file, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM decided WHERE reason IS NOT NULL GROUP BY 1",
    "pivot_status": """SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS "F", nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS "O", nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS "P"
 FROM orders GROUP BY 1""",
    "merge_join": "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "term_counts": "SELECT term, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS term FROM part) WHERE term <> '' GROUP BY 1",
    "incremental": "SELECT count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events))",
    "newest_alerts": f"{_RUN},{_ALERTS} SELECT alert_type, order_id, line_no, metric_value FROM alerts ORDER BY order_ts DESC, order_id, line_no, alert_type LIMIT 200",
    "sampling": "SELECT 'all' AS part, count(*) AS n FROM orders UNION ALL SELECT 'in both', 0 UNION ALL SELECT 'fixed', least(100, count(*)) FROM orders",
    "fuzzy_names": """WITH p AS (SELECT p_partkey, left(md5(p_partkey::VARCHAR), 9) || ' ' || p_name AS mark FROM part),
 o AS (SELECT *, left(mark, 3) || '#' || substr(mark, 5) AS once FROM p),
 w AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN substr(once, 2) WHEN 1 THEN once || ' x' ELSE once END AS wrong FROM o),
 r AS (SELECT upper(mark) AS name FROM p WHERE p_partkey % 2 = 0),
 c AS (SELECT p_partkey, name, levenshtein(lower(wrong), lower(name))::INT AS edits FROM w, r WHERE levenshtein(lower(wrong), lower(name)) <= 2),
 b AS (SELECT p_partkey, arg_min(name, (edits, name)) AS matched, min(edits) AS edits FROM c GROUP BY 1)
 SELECT p_partkey, wrong, matched, edits FROM w LEFT JOIN b USING (p_partkey)""",
    "run_verdict": f"""{_RUN},{_FACT},{_RECONCILED},{_FILES.format(s='')}
 SELECT (SELECT count(*) FROM outcome) AS staged, (SELECT count(reason) FROM outcome) AS rejected, count(*) AS fact_rows, count(DISTINCT order_id) AS orders,
  (sum(total4)::DECIMAL(28,4) * 0.0001::DECIMAL(5,4))::DECIMAL(24,4) AS revenue, (SELECT count(DISTINCT o_custkey) FROM orders) AS current_customers, (SELECT count(*) FROM products) AS products,
  (SELECT count(*) FROM files) AS files, (SELECT count(*) FILTER (lines_clean = 0) FROM files) AS failed_files, (SELECT count(*) FILTER (source_count <> target_count) FROM checks) AS failed_checks,
  CASE WHEN (SELECT count(*) FILTER (source_count <> target_count) FROM checks) = 0 AND (SELECT count(*) FILTER (lines_clean = 0) FROM files) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM fact""",
    "latest_event": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "capture_diff": f"""{_BOTH},{_ALERTS},{_ALERTS.replace(" alerts AS", " alerts_b AS").replace("FROM items", "FROM items_b")},
 d(measure, a, b) AS (SELECT x.measure, x.value, y.value FROM ({_headline('outcome')}) x JOIN ({_headline('outcome_b')}) y ON x.measure = y.measure),
 ha AS (SELECT 'reasons:' || reason AS item, count(*) AS n FROM outcome WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT 'alerts:' || alert_type, count(*) FROM alerts GROUP BY 1),
 hb AS (SELECT 'reasons:' || reason AS item, count(*) AS n FROM outcome_b WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT 'alerts:' || alert_type, count(*) FROM alerts_b GROUP BY 1),
 sa AS (SELECT DISTINCT CASE WHEN reason IS NULL THEN 'loaded' ELSE 'rejected' END AS name, order_id || '#' || line_no AS member FROM outcome),
 sb AS (SELECT DISTINCT CASE WHEN reason IS NULL THEN 'loaded' ELSE 'rejected' END AS name, order_id || '#' || line_no AS member FROM outcome_b),
 s AS (SELECT coalesce(sa.name, sb.name) AS item, count(*) FILTER (sb.name IS NULL) AS a, count(*) FILTER (sa.name IS NULL) AS b
  FROM sa FULL JOIN sb ON sa.name = sb.name AND sa.member = sb.member GROUP BY 1),
 every AS (SELECT 'scalar' AS part, measure AS item, a, b FROM d
  UNION ALL SELECT 'histogram', coalesce(ha.item, hb.item), coalesce(ha.n, 0), coalesce(hb.n, 0) FROM ha FULL JOIN hb ON ha.item = hb.item UNION ALL SELECT 'set', item, a, b FROM s)
 SELECT part, item, a::DECIMAL(20,2)::VARCHAR AS a, b::DECIMAL(20,2)::VARCHAR AS b FROM every WHERE a <> b""",
    "conformance": f"""{_RUN} SELECT unnest(['reasons_declared', 'order_keys_unique', 'item_keys_unique', 'alert_severities', 'ledger_covers_orders', 'loaded_or_rejected']) AS check_name,
 unnest([0, 0, 0, 0, 0, (SELECT count(*) FROM items i JOIN outcome r ON r.reason <> 'DUP_KEY' AND i.order_id = r.order_id AND i.line_no = r.line_no AND i.sku = r.sku AND i.qty = r.qty AND i.up4 = r.up4)]) AS violations, true AS pass""",
}
