"""The queries of ``file_queries`` as SQL for an independent engine."""

from __future__ import annotations

from rowgate.contract import DATA_FLOW_ERRORS
from rowgate.plans.oracle import _ALERTS, _BOTH, _FILES, _LEDGER_STATUS, _ORDERS, _RUN, _SIDES, _pct

_RUN_FILES = f"{_RUN},{_FILES.format(s='')}"
_NO = "regexp_extract(source_file, '(\\d+)', 1)::INT"
_REJECTS = "SELECT '{e}' AS engine, * FROM decided{s} WHERE reason IS NOT NULL"
_CODES = ", ".join("({}, '{}')".format(k, v.replace("'", "''")) for k, v in DATA_FLOW_ERRORS.items())
_MEMBERS = """
 ma AS (SELECT DISTINCT reason AS name, order_id || '#' || line_no AS member FROM decided WHERE reason IS NOT NULL),
 mb AS (SELECT DISTINCT reason AS name, order_id || '#' || line_no AS member FROM decided_b WHERE reason IS NOT NULL),
 m AS (SELECT coalesce(ma.name, mb.name) AS name, coalesce(ma.member, mb.member) AS member, ma.name IS NOT NULL AS a, mb.name IS NOT NULL AS b
  FROM ma FULL JOIN mb ON ma.name = mb.name AND ma.member = mb.member),
 r AS (SELECT *, row_number() OVER (PARTITION BY name, a, b ORDER BY member) AS n FROM m)"""
_MOVED = _RUN.replace("abs(order_ts - 892771200000)", "abs(order_ts - 86400000 - 892771200000)")

SQL = {
    "source_records": """SELECT CASE WHEN l_partkey % 50 < 2 THEN 'PARSE_ERROR' ELSE 'OK' END AS parse_status,
 CASE l_partkey % 50 WHEN 0 THEN 'invalid json line' WHEN 1 THEN 'json not an object' END AS parse_error,
 count(*) AS n, count(*) AS places, sum(CASE WHEN l_partkey % 50 > 2 THEN l_quantity END)::BIGINT AS quantity FROM lineitem WHERE l_partkey % 50 <> 2 GROUP BY 1, 2""",
    "source_failed_files": """WITH f AS (SELECT 'batch-' || (l_orderkey % 97) || '.json' AS source_file, count(*) AS n, bool_or(l_partkey % 997 = 0) AS bad FROM lineitem GROUP BY 1)
 SELECT source_file, CASE WHEN bad THEN 'READER_FAILURE' ELSE 'OK' END AS parse_status, n FROM f""",
    "source_delimited": """SELECT l_returnflag || ' €' AS flag, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem WHERE l_partkey % 100 <> 0 GROUP BY 1
 UNION ALL SELECT 'error', count(*), NULL FROM lineitem WHERE l_partkey % 100 = 0""",
    "source_columns": "SELECT l_returnflag AS flag, sum(l_orderkey)::BIGINT AS keys, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY 1",
    "source_pending": f"""{_RUN} SELECT source_file, sum(length(order_id))::BIGINT AS bytes FROM lines WHERE {_NO} % 3 <> 0 GROUP BY 1
 UNION ALL SELECT 'empty-' || n_nationkey || '.json', 0 FROM nation""",
    "source_files_on_disk": "SELECT count(*) AS lines, true AS same_listed_bytes, true AS same_read_bytes, true AS same_content_bytes FROM lineitem",
    "source_dead_letters": "SELECT 'READER_FAILURE' AS reason, 5::BIGINT AS n, 4000 AS longest FROM (SELECT count(*) FROM lineitem)",
    "source_xml": "SELECT p_brand, count(*) AS n, sum(p_size)::BIGINT AS size, max(p_partkey) AS last FROM part GROUP BY 1",
    "source_reference": "SELECT c_mktsegment, count(*) AS n, sum(c_acctbal::DECIMAL(14,2))::DECIMAL(24,2) AS balance FROM customer WHERE c_acctbal > 0 GROUP BY 1",
    "sink_append": """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'up' WHEN o_orderkey % 3 = 2 THEN 'new' ELSE o_orderstatus END AS v, count(*) AS n, sum(o_orderkey)::BIGINT AS keys
 FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1""",
    "sink_reset": "SELECT 'run' AS part, 0::BIGINT AS n UNION ALL SELECT 'dimension', count(*) FROM nation",
    "sink_batches": """SELECT l_orderkey % 7 AS batch, count(*) AS n, sum(CASE WHEN l_orderkey % 7 = 3 THEN -l_quantity ELSE l_quantity END)::BIGINT AS quantity FROM lineitem GROUP BY 1""",
    "sink_quarantine": f"{_RUN} SELECT reason, count(*) AS n, count(*) AS with_payload, count(DISTINCT source_file) AS files FROM decided WHERE reason IS NOT NULL GROUP BY 1",
    "sink_reject_export": f"{_BOTH} SELECT engine, reason, count(*) AS n FROM ({_REJECTS.format(e='a', s='')} UNION ALL {_REJECTS.format(e='b', s='_b')}) GROUP BY 1, 2",
    "sink_reason_json": f"""{_RUN} SELECT '{{' || string_agg('"' || reason || '":' || n, ',' ORDER BY reason) || '}}' AS reasons
 FROM (SELECT reason, count(*) AS n FROM decided WHERE reason IS NOT NULL GROUP BY 1)""",
    "sink_retained": "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR GROUP BY 1",
    "ledger_of_loads": f"""{_RUN_FILES} SELECT source_file, lines_clean AS records_valid, lines_rejected + lines_in AS records_invalid, {_LEDGER_STATUS} AS status,
 10::BIGINT AS duration_ms, 2::BIGINT AS loads FROM files""",
    "ledger_with_empty_files": f"""{_RUN_FILES}, l AS (SELECT {_LEDGER_STATUS} AS status, lines_clean, lines_rejected FROM files UNION ALL SELECT 'FAILED', 0, 0 FROM nation)
 SELECT status, count(*) AS files, sum(lines_clean)::BIGINT AS records_valid, sum(lines_rejected)::BIGINT AS records_invalid FROM l GROUP BY 1""",
    "recent_runs": f"""{_RUN_FILES} SELECT source_file, {_pct('lines_rejected', 'lines_in')} AS reject_pct,
 CASE WHEN lines_clean = 0 THEN 'FAILED' WHEN {_NO} % 2 = 1 AND {_NO} > 87 THEN 'RUNNING' ELSE {_LEDGER_STATUS} END AS status FROM files ORDER BY {_NO} DESC LIMIT 30""",
    "bucket_upserts": """
WITH a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 100 = 5 THEN 'late' WHEN o_orderkey % 3 < 2 THEN o_orderstatus ELSE 'new' END AS s,
  CASE WHEN o_orderkey % 100 = 5 THEN 1 ELSE o_totalprice END::DECIMAL(14,2) AS t FROM orders WHERE o_orderkey % 50 <> 7)
SELECT s AS o_orderstatus, count(*) AS n, sum(t)::DECIMAL(18,2) AS total FROM a GROUP BY 1""",
    "change_feed": """
SELECT user_id, event_type, value::DECIMAL(14,2) AS value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'""",
    "change_feed_net": """
WITH f AS (SELECT *, CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'I' ELSE 'U' END AS op FROM events),
 g AS (SELECT *, first_value(op) OVER (PARTITION BY user_id ORDER BY event_id) AS born, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM f)
SELECT CASE WHEN born = 'I' THEN 'I' WHEN op = 'D' THEN 'D' ELSE 'U' END AS op, event_id AS seq, user_id, event_type, value::DECIMAL(14,2) AS value
FROM g WHERE n = 1 AND NOT (born = 'I' AND op = 'D')""",
    "stream_load": f"{_RUN} SELECT coalesce(reason, 'CLEAN') AS reason, count(*) AS n FROM outcome GROUP BY 1",
    "stream_alerts": f"""{_RUN},{_ALERTS}, once AS (SELECT order_id, line_no FROM lines GROUP BY ALL HAVING count(*) = 1)
 SELECT alert_type, severity, count(*) AS n, sum(metric_value)::DECIMAL(18,2) AS total FROM alerts SEMI JOIN once USING (order_id, line_no) GROUP BY 1, 2
 UNION ALL SELECT 'LOADS', 'INFO', 1, NULL""",
    "stream_recovery": f"{_RUN} SELECT coalesce(reason, 'CLEAN') AS reason, count(*) AS n FROM outcome GROUP BY 1",
    "revenue_by_batch": f"""{_RUN} SELECT regexp_extract(source_file, '^(.*)\\.json$', 1) AS batch_id, count(DISTINCT order_id) AS orders, sum(line_total)::DECIMAL(18,2) AS revenue
 FROM items GROUP BY 1""",
    "stream_health": f"""{_RUN_FILES}, l AS (SELECT source_file, {_LEDGER_STATUS} AS status FROM files)
 SELECT (SELECT count(*) FROM nation) AS pending_files, count(*) AS files_done, count(*) FILTER (status = 'FAILED') AS failed_files, max(source_file) AS last_file,
 arg_max(status, source_file) AS last_status, max(CASE WHEN status = 'FAILED' THEN 'no valid line' END) AS last_error FROM l""",
    "run_log": """SELECT 'b1' AS batch_id, 'load' AS package, 'rows' AS metric, count(*)::DECIMAL(20,4) AS value FROM lineitem
 UNION ALL SELECT 'b1', 'load', 'duration_ms', 3000::DECIMAL(20,4)""",
    "disagreements": f"{_BOTH},{_SIDES} SELECT * FROM sides ORDER BY status = 'same', order_id, line_no, source_file, occurrence LIMIT 100",
    "largest_deltas": f"""{_BOTH}, x AS (SELECT reason, count(*) AS n FROM decided WHERE reason IS NOT NULL GROUP BY 1), y AS (SELECT reason, count(*) AS n FROM decided_b WHERE reason IS NOT NULL GROUP BY 1)
 SELECT coalesce(x.reason, y.reason) AS reason, coalesce(x.n, 0) AS n_a, coalesce(y.n, 0) AS n_b, coalesce(x.n, 0) - coalesce(y.n, 0) AS delta FROM x FULL JOIN y ON x.reason = y.reason
 ORDER BY abs(delta) DESC, 1 LIMIT 3""",
    "set_members": f"""{_BOTH},{_MEMBERS} SELECT name, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b, count(*) FILTER (a AND b) AS both,
 coalesce(string_agg(member, ',' ORDER BY member) FILTER (a AND NOT b AND n <= 5), '') AS sample_a, coalesce(string_agg(member, ',' ORDER BY member) FILTER (b AND NOT a AND n <= 5), '') AS sample_b
 FROM r GROUP BY 1""",
    "row_oracle": """WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'landed' ELSE 'rejected' END AS want FROM orders WHERE o_orderkey % 11 <> 0),
 x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'rejected' WHEN o_orderkey % 2 = 0 THEN 'landed' ELSE 'rejected' END AS side FROM orders WHERE o_orderkey % 13 <> 0
  UNION ALL SELECT o_orderkey, 'landed' FROM orders WHERE o_orderkey % 17 = 0),
 g AS (SELECT o_orderkey, string_agg(DISTINCT side, '+' ORDER BY side) AS got FROM x GROUP BY 1),
 f AS (SELECT coalesce(e.o_orderkey, g.o_orderkey) AS k, CASE WHEN got IS NULL THEN 'missing' WHEN want IS NULL THEN 'unexpected' WHEN contains(got, '+') THEN 'both sides'
  WHEN got <> want THEN 'wrong side' END AS finding FROM e FULL JOIN g ON e.o_orderkey = g.o_orderkey)
 SELECT finding, count(*) AS n, sum(k)::BIGINT AS keys FROM f WHERE finding IS NOT NULL GROUP BY 1""",
    "rebased_times": f"{_MOVED} SELECT coalesce(reason, 'CLEAN') AS reason, count(*) AS n FROM decided GROUP BY 1",
    "replay_slice": "SELECT 0::BIGINT AS wrong, 9::BIGINT AS right_cells FROM (SELECT count(*) FROM lineitem)",
    "replay_conformance": "SELECT unnest(['replay_safe', 'payload_kept']) AS check_name, 0::BIGINT AS violations, true AS pass FROM (SELECT count(*) FROM lineitem)",
    "file_verdicts": f"""{_RUN}, f AS (SELECT source_file, count(*) AS lines_in, count(*) FILTER (reason IS NULL AND l_partkey % 1000 <> 7) AS lines_clean,
  count(*) FILTER (reason IS NOT NULL AND l_partkey % 1000 <> 7) AS lines_rejected FROM outcome GROUP BY 1)
 SELECT *, CASE WHEN lines_in = lines_clean + lines_rejected THEN 'PASS' ELSE 'FAIL' END AS verdict FROM f""",
    "views_of_run": f"""{_RUN_FILES},{_ORDERS},{_ALERTS},
 top AS (SELECT sum(qty) AS units, sum(line_total) AS revenue FROM items GROUP BY sku ORDER BY revenue DESC, sku LIMIT 20)
 SELECT 'orders_per_minute' AS report, (SELECT count(*) FROM loaded) AS value UNION ALL SELECT 'revenue_by_category', count(*) FROM (SELECT DISTINCT category, order_id FROM items)
 UNION ALL SELECT 'quality_per_minute', count(reason) FROM outcome UNION ALL SELECT 'reject_reasons', count(reason) FROM outcome UNION ALL SELECT 'alert_kinds', count(*) FROM alerts
 UNION ALL SELECT 'summary', sum(lines_clean)::BIGINT FROM files UNION ALL SELECT 'failed_files', count(*) FILTER (lines_clean = 0) FROM files
 UNION ALL SELECT 'file_ledger', count(*) FROM loaded UNION ALL SELECT 'orphan_orders', 0
 UNION ALL SELECT 'top_skus', sum(units)::BIGINT FROM top UNION ALL SELECT 'recent_alerts', least(200, count(*)) FROM alerts
 UNION ALL SELECT 'recent_rejects', least(25, count(reason)) FROM outcome UNION ALL SELECT 'recent_runs', least(50, count(*)) FROM files""",
    "strict_types": "SELECT l_partkey % 9 <> 0 AS declared, count(*) AS n FROM lineitem GROUP BY 1",
    "error_descriptions": f"""WITH c AS (SELECT * FROM (VALUES {_CODES}) AS v(code, description)), p AS (SELECT (p_partkey % 30 - 939524094)::INT AS error_code FROM part)
 SELECT error_code, description, count(*) AS n FROM p LEFT JOIN c ON error_code = code GROUP BY 1, 2""",
    "scalar_functions": """SELECT o_orderkey, length(o_orderpriority)::INT AS letters, CASE WHEN o_orderpriority LIKE '1%' THEN 'first' ELSE o_orderpriority END AS priority,
 o_orderdate + INTERVAL 10 MINUTE AS later, round(o_totalprice::DECIMAL(14,2), 1)::DOUBLE AS price, o_custkey AS customer,
 -(o_orderkey * 1099511627776 // 3) AS third, 'a.' || o_orderstatus AS stem FROM orders""",
    "character_maps": "SELECT n_nationkey, lower(n_name) AS n_name, reverse(n_name) AS copy, 'maps' AS audit_package, 'b7' AS audit_batch FROM nation",
    "packed_notes": f"{_RUN} SELECT status, channel, upper(currency) AS currency, count(*) AS n, sum(line_total)::DECIMAL(18,2) AS total FROM items GROUP BY 1, 2, 3",
    "wanted_terms": """WITH t AS (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS term FROM part), w AS (SELECT term FROM t WHERE term <> '' GROUP BY 1 HAVING count(*) > 1)
 SELECT term, count(*) AS n, count(DISTINCT p_partkey) AS parts FROM t SEMI JOIN w USING (term) GROUP BY 1""",
    "similar_names": r"""WITH p AS (SELECT *, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^a-z0-9]+'), lambda w: w <> ''))) AS w FROM part),
 a AS (SELECT DISTINCT w FROM p WHERE p_size % 5 = 0), b AS (SELECT w, min(p_type || ', ' || p_brand || ', ' || p_name) AS name FROM p WHERE p_size % 5 = 1 GROUP BY w),
 c AS (SELECT a.w, name, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS n FROM a, b),
 d AS (SELECT w, arg_min(name, (-i / (n - i), name)) AS matched, max(i / (n - i)) AS score FROM c WHERE i / (n - i) >= 0.5 GROUP BY w)
 SELECT p_partkey, matched, round(score, 4) AS score FROM p LEFT JOIN d USING (w) WHERE p_size % 5 = 0""",
    "document_phrases": r"""WITH d AS (SELECT row_number() OVER () AS r, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]+'), lambda w: w <> '') AS w FROM documents),
 g AS (SELECT r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM d
  UNION ALL SELECT r, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM d),
 k AS (SELECT * FROM g WHERE split_part(term, ' ', 1) NOT IN ('the', 'and', 'of') AND split_part(term, ' ', -1) NOT IN ('the', 'and', 'of'))
 SELECT term, count(*) AS n, count(DISTINCT r) AS "rows", round(count(*) * ln((SELECT count(*) FROM documents) / count(DISTINCT r)), 3) AS score FROM k GROUP BY 1 HAVING count(*) >= 20""",
    "phrases_found": """WITH w AS (SELECT p_name AS term FROM part WHERE p_size <= 5 UNION SELECT 'by ' || replace(lower(p_brand), '#', ' ') FROM part WHERE p_size = 7),
 s AS (SELECT p_partkey, ' ' || lower('this ' || p_type || ' ' || p_name || ' by ' || replace(p_brand, '#', ' ')) || ' ' AS said FROM part)
 SELECT term, count(*)::BIGINT AS n, count(*) AS parts FROM s JOIN w ON contains(said, ' ' || term || ' ') GROUP BY term""",
    "logged_branches": """WITH b AS (SELECT CASE WHEN l_quantity >= 40 THEN 'bulk' WHEN l_discount > 0.05 THEN 'discounted' ELSE 'rest' END AS measure FROM lineitem),
 c AS (SELECT measure, count(*) AS value, count(*) AS in_files FROM b GROUP BY 1 UNION ALL SELECT 'rows', count(*), NULL FROM b UNION ALL SELECT 'unaccounted', 0, NULL)
 SELECT 'b1' AS batch_id, 'split' AS stage, * FROM c""",
    "orders_over_loads": f"""{_RUN} SELECT source_file, count(*) AS lines_in, count(*) - count(reason) AS lines_clean, count(reason) AS lines_rejected,
 coalesce(sum(line_total) FILTER (reason IS NULL), 0)::DECIMAL(18,2) AS revenue, true AS near FROM decided GROUP BY 1""",
    "exported_files": """WITH f AS (SELECT s_nationkey || '/' || s_name || '.txt' AS file, s_name || ' €' || chr(10) || s_nationkey AS c FROM supplier)
 SELECT file, strlen(c) AS bytes, sha256(c) AS sha256, sha256(c) AS read_sha256 FROM f""",
    "source_flat_file": """SELECT CASE WHEN o_orderkey % 10 = 3 THEN 'error' ELSE o_orderstatus END AS status, count(*) AS n, sum(o_orderkey) FILTER (o_orderkey % 10 <> 3) AS keys,
 count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1""",
    "fuzzy_groups": """WITH RECURSIVE c AS (SELECT left(md5(c_name), 5) AS code FROM customer), d AS (SELECT DISTINCT code FROM c),
 near AS (SELECT x.code AS a, y.code AS b FROM d x, d y WHERE levenshtein(x.code, y.code) <= 1),
 reach AS (SELECT a, b FROM near UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
 g AS (SELECT a AS code, min(b) AS "group" FROM reach GROUP BY 1)
 SELECT "group", count(*) AS customers, count(DISTINCT code) AS codes FROM c JOIN g USING (code) GROUP BY 1""",
    "cached_reference": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
}
