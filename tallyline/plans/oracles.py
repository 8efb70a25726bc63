"""Plain SQL for the registered queries, run by another engine on the same tables."""

from __future__ import annotations

RAW = """
li AS (SELECT *, row_number() OVER () + 1 AS source_row_number FROM lineitem),
loc AS (
  SELECT *, 'lineitem.parquet' AS source_file_id, strftime(l_shipdate, '%Y-%m') AS sheet_name,
         l_orderkey % 97 AS residue, CAST(l_quantity AS BIGINT) AS units
  FROM li),
raw AS (
  SELECT source_file_id, sheet_name, source_row_number, l_returnflag, residue,
    CASE WHEN residue = 0 THEN NULL WHEN residue = 1 THEN '   ' WHEN residue = 2 THEN 'True'
         WHEN residue = 3 THEN chr(9) || 'C' || l_orderkey || chr(10)
         WHEN residue = 4 THEN chr(160) || 'C' || l_orderkey
         WHEN l_returnflag = 'R' THEN ' c' || l_orderkey
         ELSE CAST(l_orderkey AS VARCHAR) END AS invoice_no_raw,
    CASE WHEN residue = 0 THEN 'missing' WHEN residue = 2 THEN 'unsupported' WHEN residue = 5 THEN NULL
         WHEN l_returnflag = 'R' OR residue < 5 THEN 'text' ELSE 'integer' END AS invoice_no_source_kind,
    'P' || (l_partkey % 8) AS stock_code_raw,
    'Part ' || l_partkey AS description_raw,
    CASE WHEN residue = 6 THEN s || '.0' WHEN residue = 7 THEN s || 'e0' ELSE s END AS quantity_raw,
    strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS invoice_date_raw,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS unit_price_raw,
    'NATION_' || (l_suppkey % 25) AS country_raw, units
  FROM (SELECT *, CAST(CASE WHEN l_returnflag = 'R' THEN -units ELSE units END AS VARCHAR) AS s FROM loc)),
typed AS (
  SELECT source_file_id, sheet_name, source_row_number, l_returnflag,
    invoice_no_raw AS invoice_no,
    coalesce(CASE WHEN invoice_no_source_kind IN ('integer', 'text') AND regexp_matches(invoice_no_raw, '[^ \t\r\n]')
      THEN CAST(regexp_matches(invoice_no_raw, '^[ \t\r\n]*[Cc]') AS VARCHAR) END, 'unknown') AS source_cancellation_marker,
    invoice_no_source_kind, stock_code_raw AS stock_code, description_raw AS description,
    quantity_raw AS quantity_source_text, TRY_CAST(quantity_raw AS BIGINT) AS quantity,
    TRY_CAST(invoice_date_raw AS TIMESTAMP) AS invoice_timestamp,
    unit_price_raw AS unit_price_source_text, country_raw AS country
  FROM raw),
runs_long AS (
  SELECT 'run-all' AS run_id, *, CAST(invoice_timestamp AS DATE) AS observed_date FROM typed
  UNION ALL
  SELECT 'run-without-returns', *, CAST(invoice_timestamp AS DATE) FROM typed WHERE l_returnflag <> 'R'),
days AS (
  SELECT run_id, source_file_id, observed_date, stock_code,
         CAST(SUM(quantity) AS BIGINT) AS sample_quantity_sum, COUNT(*) AS observed_row_count
  FROM runs_long GROUP BY ALL),
long_all AS (SELECT * FROM runs_long WHERE run_id = 'run-all'),
day_all AS (SELECT * FROM days WHERE run_id = 'run-all')
"""

DIRTY = """
dirty AS (
  SELECT source_file_id, sheet_name, source_row_number,
    CASE residue WHEN 10 THEN units || '.5' WHEN 11 THEN 'abc' WHEN 12 THEN NULL
      WHEN 13 THEN '9223372036854775808' WHEN 14 THEN units || '.0000000000000000001'
      WHEN 15 THEN units || 'e3' WHEN 16 THEN '9223372036854775807' WHEN 17 THEN '0x' || units
      ELSE quantity_raw END AS quantity_source_text,
    CASE residue WHEN 23 THEN NULL ELSE stock_code_raw END AS stock_code,
    CASE residue WHEN 22 THEN NULL ELSE unit_price_raw END AS unit_price_source_text,
    CASE residue WHEN 20 THEN left(invoice_date_raw, 7) WHEN 21 THEN replace(invoice_date_raw, '-', '/')
      ELSE invoice_date_raw END AS date_text
  FROM raw),
dirty_typed AS (
  SELECT *, TRY_CAST(date_text AS TIMESTAMP) AS invoice_timestamp,
    CASE WHEN TRY_CAST(quantity_source_text AS DECIMAL(38,19)) = floor(TRY_CAST(quantity_source_text AS DECIMAL(38,19)))
         THEN TRY_CAST(quantity_source_text AS BIGINT) END AS quantity
  FROM dirty)
"""

RUNS = """
ord AS (SELECT *, 'run-' || o_orderkey AS run_id FROM orders),
runs AS (
  SELECT run_id, o_orderkey, o_orderkey * 2 AS run_seq, 'file-' || o_custkey AS source_file_id,
    '/in/' || o_orderpriority AS input_path,
    CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'failed' ELSE 'running' END AS status,
    o_orderdate AS start_ts,
    CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderpriority = '5-LOW' THEN o_orderdate
         ELSE o_orderdate + INTERVAL 1 HOUR END AS end_ts,
    CASE WHEN o_orderstatus = 'P' THEN 'refused: ' || o_orderpriority END AS error_message
  FROM ord),
pubs AS (
  SELECT run_id, o_orderkey AS publish_seq, o_orderdate AS pub_ts FROM ord
  WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'),
published AS (
  SELECT p.*, r.end_ts FROM pubs p JOIN runs r USING (run_id) WHERE r.status = 'succeeded'),
scopes AS (
  SELECT run_id, 'file-' || o_custkey AS source_file_id, strftime(o_orderdate, '%Y-%m') AS sheet_name,
    'scope-' || o_custkey AS input_scope_id,
    CASE WHEN o_orderpriority <> '5-LOW' THEN 'rule-1' END AS aggregation_rule_id,
    CASE WHEN o_orderpriority <> '5-LOW' THEN 'rule-2' END AS transformation_rule_id
  FROM ord WHERE o_orderpriority <> '4-NOT SPECIFIED'),
written AS (
  SELECT run_id, COUNT(*) AS result_rows FROM ord JOIN lineitem ON l_orderkey = o_orderkey
  WHERE o_orderstatus = 'F' OR o_orderpriority = '2-HIGH' GROUP BY run_id),
top20 AS (SELECT * FROM published ORDER BY publish_seq DESC LIMIT 20),
listed AS (
  SELECT t.run_id, t.publish_seq, t.end_ts, t.publish_seq = (SELECT max(publish_seq) FROM published) AS is_current,
         s.source_file_id, s.sheet_name, s.input_scope_id, s.aggregation_rule_id, s.transformation_rule_id
  FROM top20 t LEFT JOIN scopes s USING (run_id)),
candidates AS (
  SELECT r.run_id, r.start_ts, COUNT(p.run_id) AS published_count
  FROM runs r LEFT JOIN pubs p USING (run_id) WHERE r.status = 'running' GROUP BY r.run_id, r.start_ts),
recovered AS (
  SELECT c.run_id, greatest(start_ts, TIMESTAMP '2001-01-01') AS at_ts,
         CASE WHEN w.run_id IS NOT NULL THEN '/results/run_id=' || c.run_id END AS artifact
  FROM candidates c LEFT JOIN written w USING (run_id) WHERE published_count = 0)
"""

EVENTS = """
ev AS (SELECT *, event_id AS place FROM events),
se AS (
  SELECT place, ts, 'evt-' || event_id AS event_id,
    strftime(CASE WHEN event_id % 13 = 5 THEN ts - INTERVAL 1 DAY ELSE ts END, '%Y-%m-%dT%H:%M:%S.%fZ') AS occurred_at,
    event_type AS product_code,
    CASE WHEN event_type = 'error' THEN -CAST(floor(value) AS BIGINT) ELSE CAST(floor(value) AS BIGINT) END AS quantity
  FROM ev),
placed AS (
  SELECT *, CAST(place % 4 AS INTEGER) AS partition, (place // 4) // 10 AS block, (place // 4) % 10 AS turn FROM se),
sent AS (
  SELECT *, block * 11 + turn + CASE WHEN turn > 0 THEN 1 ELSE 0 END AS kafka_offset, 0 AS added FROM placed
  UNION ALL
  SELECT *, block * 11 + 1, CASE WHEN ts >= TIMESTAMP '2024-01-25' THEN 1000 ELSE 0 END FROM placed WHERE turn = 0),
{variant}
canon AS (
  SELECT *, 'events' AS topic,
    '{{"event_id":"' || event_id || '","occurred_at":"' || occurred_at || '","product_code":"' || product_code
      || '","quantity":' || q || '}}' AS payload_json,
    CAST(left(occurred_at, 10) AS DATE) AS observed_date
  FROM chosen),
log AS (SELECT *, sha256(payload_json) AS payload_sha256 FROM canon),
disp AS (
  SELECT *, first_value(payload_sha256) OVER w AS existing_payload_sha256,
    CASE WHEN row_number() OVER w = 1 THEN 'accepted'
         WHEN payload_sha256 = first_value(payload_sha256) OVER w THEN 'redelivery' ELSE 'conflict' END AS disposition
  FROM log WINDOW w AS (PARTITION BY event_id ORDER BY partition, kafka_offset)),
stops AS (
  SELECT topic, partition, min(kafka_offset) FILTER (disposition = 'conflict') AS stop_offset,
    coalesce(min(kafka_offset) FILTER (disposition = 'conflict'), max(kafka_offset) + 1) AS next_offset,
    min(kafka_offset) AS low_offset
  FROM disp GROUP BY topic, partition),
attempts AS (
  SELECT d.* FROM disp d JOIN stops s USING (topic, partition)
  WHERE s.stop_offset IS NULL OR d.kafka_offset <= s.stop_offset)
"""
CONFLICT_LOG = EVENTS.format(variant="chosen AS (SELECT * EXCLUDE (quantity), quantity + added AS q FROM sent),")
CLEAN_LOG = EVENTS.format(variant="chosen AS (SELECT * EXCLUDE (quantity), quantity AS q FROM sent),")

ODD = """
ev AS (SELECT *, event_id AS place FROM events),
se AS (
  SELECT place, 'evt-' || event_id AS event_id,
    strftime(CASE WHEN event_id % 13 = 5 THEN ts - INTERVAL 1 DAY ELSE ts END, '%Y-%m-%dT%H:%M:%S.%fZ') AS occurred_at,
    event_type AS product_code,
    CASE WHEN event_type = 'error' THEN -CAST(floor(value) AS BIGINT) ELSE CAST(floor(value) AS BIGINT) END AS quantity
  FROM ev),
heads AS (
  SELECT *, '{"event_id":"' || event_id || '","occurred_at":"' || occurred_at || '","product_code":"' || product_code || '"' AS head
  FROM se),
goods AS (SELECT *, head || ',"quantity":' || quantity || '}' AS good FROM heads),
odd AS (
  SELECT place, event_id,
    CASE place % 20
      WHEN 1 THEN head || ',"quantity":3.0}' WHEN 2 THEN head || ',"quantity":true}'
      WHEN 3 THEN head || ',"quantity":"3"}' WHEN 4 THEN head || ',"quantity":9223372036854775808}'
      WHEN 5 THEN head || '}' WHEN 6 THEN head || ',"quantity":3,"extra":1}'
      WHEN 7 THEN good || ' x' WHEN 8 THEN '[' || good || ']'
      WHEN 9 THEN regexp_replace(good, '"evt-[0-9]+"', '" "')
      WHEN 10 THEN regexp_replace(good, '"product_code":"[a-z]+"', '"product_code":""')
      WHEN 11 THEN regexp_replace(good, 'T[0-9]{2}:', 'T25:')
      WHEN 12 THEN replace(good, 'Z"', '"') WHEN 13 THEN regexp_replace(good, 'T[0-9:.]+Z', 'Z')
      WHEN 14 THEN ' ' || good || chr(10) WHEN 15 THEN head || ',"quantity":-9223372036854775808}'
      WHEN 16 THEN good || ',"end":1' ELSE good END AS value
  FROM goods),
shaped AS (
  SELECT *, CASE WHEN json_valid(value) THEN CASE WHEN json_type(value) = 'OBJECT' THEN value END END AS doc FROM odd),
judged AS (
  SELECT *,
    CASE WHEN NOT json_valid(value) THEN 'malformed_json'
      WHEN doc IS NULL THEN 'not_an_object'
      WHEN list_sort(json_keys(doc)) <> ['event_id', 'occurred_at', 'product_code', 'quantity'] THEN 'wrong_fields'
      WHEN trim(doc ->> '$.event_id') = '' THEN 'blank_event_id'
      WHEN trim(doc ->> '$.product_code') = '' THEN 'blank_product_code'
      WHEN NOT regexp_full_match(doc ->> '$.occurred_at', '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?Z')
        THEN 'occurred_at_not_utc_instant'
      WHEN json_type(doc, '$.quantity') = 'UBIGINT' AND CAST(doc ->> '$.quantity' AS HUGEINT) > 9223372036854775807
        THEN 'quantity_out_of_range'
      WHEN json_type(doc, '$.quantity') NOT IN ('UBIGINT', 'BIGINT') THEN 'quantity_not_integer'
      WHEN TRY_CAST(replace(replace(doc ->> '$.occurred_at', 'T', ' '), 'Z', '') AS TIMESTAMP) IS NULL
        THEN 'occurred_at_impossible' END AS reason
  FROM shaped)
"""

DAY_COLUMNS = "observed_date, stock_code, sample_quantity_sum, observed_row_count"


def _q(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"


_LONG = """source_row_number, sheet_name, source_file_id, observed_date, stock_code, invoice_no,
  source_cancellation_marker, invoice_no_source_kind, description, quantity,
  strftime(invoice_timestamp, '%Y-%m-%d %H:%M:%S') AS invoice_timestamp, unit_price_source_text, country, run_id"""

_SHOW = "strftime({0}, '%Y-%m-%d %H:%M:%S')"

_DIFF = """
, diff AS (
  SELECT CASE WHEN bool_or(run_id = 'run-all') THEN 'removed' ELSE 'added' END AS change,
    observed_date, stock_code, source_file_id, sheet_name, source_row_number
  FROM runs_long GROUP BY ALL_KEYS HAVING count(DISTINCT run_id) = 1)
""".replace("ALL_KEYS", "observed_date, stock_code, source_file_id, sheet_name, source_row_number")

_SCOPE = """
, slices AS (
  SELECT run_id, source_file_id, sheet_name, source_row_number >> 16 AS slot, COUNT(*) AS n,
    sha256(string_agg(CAST(source_row_number AS VARCHAR), ',' ORDER BY source_row_number)) AS digest
  FROM runs_long GROUP BY ALL),
second AS (
  SELECT run_id, source_file_id, sheet_name, slot >> 16 AS slot, SUM(n) AS n,
    sha256(string_agg(slot || ':' || digest, ',' ORDER BY slot)) AS digest
  FROM slices GROUP BY run_id, source_file_id, sheet_name, slot >> 16),
tops AS (
  SELECT run_id, source_file_id, sheet_name, CAST(SUM(n) AS BIGINT) AS selected_row_count,
    sha256(string_agg(slot || ':' || digest, ',' ORDER BY slot)) AS digest
  FROM second GROUP BY run_id, source_file_id, sheet_name),
ids AS (
  SELECT run_id, source_file_id, sheet_name, selected_row_count,
    'sha256:' || sha256(source_file_id || '|' || sheet_name || '|' || digest) AS input_scope_id
  FROM tops),
scope_changed AS (
  SELECT bool_or(n = 1) AS changed FROM (
    SELECT sheet_name, input_scope_id, COUNT(DISTINCT run_id) AS n FROM ids GROUP BY ALL)),
sheets_changed AS (
  SELECT bool_or(n = 1) AS changed FROM (SELECT sheet_name, COUNT(DISTINCT run_id) AS n FROM ids GROUP BY ALL))
"""

_TOTALS = """observed_date, product_code, CAST(SUM(CAST({0} AS HUGEINT)) AS VARCHAR) AS signed_quantity_sum,
  COUNT(*) AS unique_event_count"""

_PLAN = """
, plan AS (
  SELECT 'delivery-' || (place - CASE WHEN place % 3 = 1 THEN 1 ELSE 0 END) AS delivery_id,
    CASE WHEN place % 7 = 3 THEN '' WHEN place % 2 = 0 THEN 'initial' ELSE 'late' END AS phase,
    CASE WHEN place % 11 = 4 THEN 'no-' || event_id ELSE event_id END AS event_id
  FROM se),
uniq AS (SELECT DISTINCT event_id, payload_json, payload_sha256 FROM log)
"""

ORACLES: dict[str, str] = {
    "product_day": _q(RAW, f"SELECT run_id, source_file_id, {DAY_COLUMNS} FROM day_all"),
    "typed_rows": _q(
        RAW,
        """SELECT source_file_id, sheet_name, source_row_number, invoice_no, source_cancellation_marker,
        invoice_no_source_kind, stock_code, description, quantity_source_text, quantity,
        strftime(invoice_timestamp, '%Y-%m-%d %H:%M:%S') AS invoice_timestamp, unit_price_source_text, country
        FROM typed""",
    ),
    "typed_dirty_rows": _q(
        RAW + "," + DIRTY,
        """SELECT source_row_number, sheet_name, source_file_id, quantity_source_text, quantity,
        strftime(invoice_timestamp, '%Y-%m-%d %H:%M:%S') AS invoice_timestamp FROM dirty_typed""",
    ),
    "marker_counts": _q(
        RAW,
        """SELECT source_cancellation_marker, invoice_no_source_kind, COUNT(*) AS row_count FROM typed
        GROUP BY source_cancellation_marker, invoice_no_source_kind""",
    ),
    "contributions": _q(RAW, f"SELECT {_LONG} FROM long_all"),
    "contribution_drilldown": _q(
        RAW, f"SELECT {_LONG} FROM long_all WHERE stock_code = 'P2' AND observed_date = DATE '1995-03-01'"
    ),
    "nested_contributions": _q(
        RAW,
        """SELECT observed_date, stock_code, sheet_name, source_row_number // 65536 AS page, COUNT(*) AS row_count,
        string_agg(source_row_number || ':' || source_cancellation_marker || ':' || quantity, ','
                   ORDER BY source_row_number) AS rows_text
        FROM long_all GROUP BY observed_date, stock_code, sheet_name, source_row_number // 65536""",
    ),
    "independent_recompute": _q(RAW, f"SELECT run_id, source_file_id, {DAY_COLUMNS} FROM day_all"),
    "reconcile_agreement": _q(
        RAW, "SELECT CAST(0 AS BIGINT) AS differing_rows, COUNT(*) AS group_count FROM day_all"
    ),
    "reconcile_differences": _q(
        RAW,
        f"""SELECT 'left_only' AS side, CAST(1 AS BIGINT) AS surplus, * FROM (
          SELECT {DAY_COLUMNS} FROM day_all EXCEPT SELECT {DAY_COLUMNS} FROM days WHERE run_id <> 'run-all')
        UNION ALL
        SELECT 'right_only', 1, * FROM (
          SELECT {DAY_COLUMNS} FROM days WHERE run_id <> 'run-all' EXCEPT SELECT {DAY_COLUMNS} FROM day_all)""",
    ),
    "quality_summary": _q(
        RAW,
        """SELECT 'run-all' AS run_id, CAST(SUM(observed_row_count) AS BIGINT) AS linked_row_count,
        COUNT(*) AS group_count, (SELECT bool_and(source_cancellation_marker IS NOT NULL) FROM long_all) AS marker_recorded
        FROM day_all""",
    ),
    "marker_labels": _q(
        RAW,
        """SELECT stock_code, CASE WHEN observed_date < DATE '1997-01-01' THEN 'not computed'
          WHEN source_cancellation_marker = 'true' THEN 'cancellation prefix observed'
          WHEN source_cancellation_marker = 'false' THEN 'no cancellation prefix observed'
          ELSE 'unknown' END AS marker_label, COUNT(*) AS row_count
        FROM long_all GROUP BY ALL""",
    ),
    "product_search": _q(RAW, f"SELECT source_file_id, {DAY_COLUMNS} FROM day_all WHERE stock_code ILIKE '%p5%'"),
    "result_products": _q(
        RAW,
        f"""SELECT 'available' AS data_state, {DAY_COLUMNS}, sheet_name, page, page_row_count
        FROM day_all JOIN (
          SELECT observed_date, stock_code, sheet_name, source_row_number // 65536 AS page, COUNT(*) AS page_row_count
          FROM long_all GROUP BY ALL) USING (observed_date, stock_code)""",
    ),
    "lossless_violations": _q(
        RAW + "," + DIRTY,
        """SELECT source_row_number, sheet_name, source_file_id, quantity_source_text, 'run-all' AS run_id
        FROM dirty_typed WHERE quantity IS NULL""",
    ),
    "invalid_typed": _q(
        RAW + "," + DIRTY,
        """SELECT source_row_number, sheet_name, source_file_id, 'run-all' AS run_id FROM dirty_typed
        WHERE stock_code IS NULL OR invoice_timestamp IS NULL OR unit_price_source_text IS NULL""",
    ),
    "typed_violations": _q(
        RAW + "," + DIRTY,
        """SELECT source_row_number, sheet_name, source_file_id, quantity_source_text,
        CASE WHEN quantity IS NULL THEN 'quantity_not_lossless' ELSE 'typed_field_missing' END AS reason,
        'run-all' AS run_id FROM dirty_typed
        WHERE quantity IS NULL OR stock_code IS NULL OR invoice_timestamp IS NULL OR unit_price_source_text IS NULL""",
    ),
    "selection_violations": """
        SELECT run_id, 'lineitem.parquet' AS source_file_id, sheet_name, source_row_number, times,
          CASE WHEN source_row_number < 2 THEN 'not_a_data_row' ELSE 'duplicate' END AS reason
        FROM (SELECT 'run-' || l_suppkey AS run_id, strftime(l_shipdate, '%Y') AS sheet_name,
                CAST(l_linenumber AS BIGINT) AS source_row_number, COUNT(*) AS times
              FROM lineitem GROUP BY ALL)
        WHERE source_row_number < 2 OR times > 1""",
    "count_mismatch": """
        SELECT strftime(l_shipdate, '%Y-%m') AS run_id, COUNT(*) AS expected_count,
          COUNT(*) FILTER (l_returnflag <> 'R') AS actual_count
        FROM lineitem GROUP BY 1 HAVING COUNT(*) <> COUNT(*) FILTER (l_returnflag <> 'R')""",
    "location_key_violations": """
        SELECT l_orderkey, l_linenumber, COUNT(*) AS times, 'duplicate_key' AS reason
        FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1""",
    "status_domain_violations": """
        SELECT event_type, COUNT(*) AS row_count FROM events
        WHERE event_type NOT IN ('running', 'succeeded', 'failed', 'interrupted', 'view') GROUP BY 1""",
    "land_idempotent": _q(
        RAW,
        """SELECT sheet_name, COUNT(*) FILTER (sheet_name >= '1998-01') AS new_rows, COUNT(*) AS landed_rows
        FROM raw GROUP BY sheet_name""",
    ),
    "land_twice": _q(
        RAW, "SELECT source_row_number, sheet_name, source_file_id, invoice_no_raw, quantity_raw FROM raw"
    ),
    "backfill_kind": _q(
        RAW,
        """SELECT source_row_number, sheet_name, source_file_id,
        coalesce(invoice_no_source_kind, 'late') AS invoice_no_source_kind FROM raw""",
    ),
    "register_files": """
        SELECT 'sha256:' || sha256(text) AS source_file_id, min(doc_id) AS doc_id FROM documents
        WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en' AND text IS NOT NULL)
        GROUP BY 1""",
    "file_fingerprints": """
        SELECT CAST(page_id AS VARCHAR) AS original_file_name, sha256(html || '!') AS expected_sha256,
          sha256(html) AS actual_sha256
        FROM pages WHERE page_id % 2 = 1""",
    "missing_selected": _q(
        RAW,
        """SELECT 'run-all' AS run_id, source_file_id, sheet_name, source_row_number FROM raw
        WHERE NOT l_returnflag <> 'R'""",
    ),
    "restrict_selected": _q(
        RAW,
        """SELECT source_row_number, sheet_name, source_file_id, stock_code_raw, quantity_raw FROM raw
        WHERE l_returnflag <> 'R'""",
    ),
    "scope_ids": _q(
        RAW + _SCOPE, "SELECT run_id, source_file_id, sheet_name, input_scope_id, selected_row_count FROM ids"
    ),
    "rule_defaults": _q(
        RUNS,
        """SELECT run_id, CASE WHEN sheet_name >= '1997-01' THEN input_scope_id ELSE 'again-' || run_id END AS input_scope_id,
        coalesce(aggregation_rule_id, 'sha256:' || sha256('rule of ' || sheet_name)) AS aggregation_rule_id,
        transformation_rule_id FROM scopes""",
    ),
    "row_diff": _q(
        RAW,
        """SELECT 'removed' AS change, source_file_id, sheet_name, source_row_number FROM raw
        WHERE l_returnflag = 'R' AND sheet_name IN (SELECT sheet_name FROM raw WHERE l_returnflag <> 'R')""",
    ),
    "compare_groups": _q(
        RAW + _DIFF,
        """SELECT observed_date, stock_code,
          CASE WHEN b.observed_row_count IS NULL THEN 'not_present' ELSE 'available' END AS base_state,
          CASE WHEN c.observed_row_count IS NULL THEN 'not_present' ELSE 'available' END AS current_state,
          b.sample_quantity_sum AS base_sample_quantity_sum, c.sample_quantity_sum AS current_sample_quantity_sum,
          b.observed_row_count AS base_observed_row_count, c.observed_row_count AS current_observed_row_count,
          coalesce(n.added, 0) AS added_row_count, coalesce(n.removed, 0) AS removed_row_count,
          b.sample_quantity_sum IS DISTINCT FROM c.sample_quantity_sum
            OR b.observed_row_count IS DISTINCT FROM c.observed_row_count
            OR coalesce(n.added, 0) + coalesce(n.removed, 0) > 0 AS changed
        FROM day_all b FULL OUTER JOIN (SELECT * FROM days WHERE run_id <> 'run-all') c USING (observed_date, stock_code)
        LEFT JOIN (SELECT observed_date, stock_code, COUNT(*) FILTER (change = 'added') AS added,
                     COUNT(*) FILTER (change = 'removed') AS removed FROM diff GROUP BY 1, 2) n
          USING (observed_date, stock_code)""",
    ),
    "location_diff": _q(RAW + _DIFF, "SELECT * FROM diff"),
    "nested_location_diff": _q(
        RAW + _DIFF,
        """SELECT observed_date, stock_code, change, source_file_id, sheet_name, source_row_number // 65536 AS page,
        string_agg(CAST(source_row_number AS VARCHAR), ',' ORDER BY source_row_number) AS rows_text
        FROM diff GROUP BY observed_date, stock_code, change, source_file_id, sheet_name, source_row_number // 65536""",
    ),
    "compare_basis": _q(
        RAW + _SCOPE,
        """SELECT CASE WHEN h.changed THEN 'source_sheet_or_rule_changed'
            WHEN s.changed THEN 'selection_scope_changed' ELSE 'same_input_scope_and_rule' END AS code,
          false AS source_file_changed, h.changed AS sheet_changed, s.changed AS selection_scope_changed,
          false AS aggregation_rule_changed, false AS transformation_rule_changed,
          false AS transformation_rule_unrecorded
        FROM scope_changed s, sheets_changed h""",
    ),
    "compare_basis_same": _q(
        RAW,
        """SELECT CASE WHEN count(*) > 0 THEN 'same_input_scope_and_rule' END AS code,
          false AS sheet_changed, false AS selection_scope_changed FROM raw""",
    ),
    "compare_basis_selection": _q(
        RAW,
        """SELECT CASE WHEN bool_or(l_returnflag = 'R') THEN 'selection_scope_changed' ELSE 'same_input_scope_and_rule' END AS code,
          false AS sheet_changed, bool_or(l_returnflag = 'R') AS selection_scope_changed
        FROM raw WHERE sheet_name IN (SELECT sheet_name FROM raw WHERE l_returnflag <> 'R')""",
    ),
    "selection_override": _q(
        RAW,
        """SELECT 'run-override' AS run_id, source_file_id, sheet_name, source_row_number FROM raw
        WHERE l_returnflag <> 'R'""",
    ),
    "basis_reasons": _q(
        RAW + _SCOPE,
        """SELECT 'source_sheet_or_rule_changed' AS code,
          concat_ws('; ', CASE WHEN h.changed THEN 'sheet' END,
            'transformation rule (an older result recorded none)',
            CASE WHEN s.changed THEN 'selection scope' END) AS criteria
        FROM scope_changed s, sheets_changed h""",
    ),
    "run_states": _q(
        RUNS,
        f"""SELECT run_id, run_seq, source_file_id, input_path, status, {_SHOW.format('start_ts')} AS started_at,
        {_SHOW.format('end_ts')} AS completed_at, error_message FROM runs""",
    ),
    "publication_log": _q(
        RUNS,
        f"""SELECT run_id, o_orderkey AS publish_seq, strftime(o_orderdate + CASE WHEN o_orderpriority = '5-LOW'
          THEN -INTERVAL 1 HOUR ELSE INTERVAL 1 HOUR END, '%Y-%m-%d %H:%M:%S') AS published_at
        FROM ord WHERE o_orderstatus = 'F'""",
    ),
    "current_result": _q(
        RUNS,
        f"""SELECT run_id, publish_seq, {_SHOW.format('pub_ts')} AS published_at FROM published
        WHERE publish_seq = (SELECT max(publish_seq) FROM published)""",
    ),
    "file_fingerprints_open": """
        SELECT CAST(page_id AS VARCHAR) AS original_file_name,
          CASE WHEN page_id % 3 = 2 THEN sha256(html || '!') WHEN page_id % 3 = 1 THEN sha256(html) END AS expected_sha256,
          CASE WHEN page_id % 3 <> 1 THEN sha256(html) END AS actual_sha256
        FROM pages""",
    "result_by_run": _q(
        RUNS,
        """SELECT run_id, result_rows, run_id = (SELECT run_id FROM published ORDER BY publish_seq DESC LIMIT 1) AS is_current
        FROM written WHERE run_id IN (SELECT run_id FROM published ORDER BY publish_seq DESC LIMIT 2)""",
    ),
    "published_list": _q(
        RUNS,
        f"SELECT * EXCLUDE (end_ts), {_SHOW.format('end_ts')} AS completed_at FROM listed",
    ),
    "default_pair": _q(
        RUNS,
        """SELECT (SELECT run_id FROM published ORDER BY publish_seq DESC LIMIT 1 OFFSET 1) AS base_run_id,
        (SELECT run_id FROM published ORDER BY publish_seq DESC LIMIT 1) AS current_run_id""",
    ),
    "run_history": _q(
        RUNS,
        f"""SELECT r.run_id, status, {_SHOW.format('start_ts')} AS started_at, {_SHOW.format('end_ts')} AS completed_at,
        error_message, s.sheet_name
        FROM (SELECT * FROM runs ORDER BY run_seq DESC LIMIT 20) r LEFT JOIN scopes s USING (run_id)""",
    ),
    "run_labels": _q(
        RUNS,
        """SELECT r.status AS before, CASE WHEN c.run_id IS NULL THEN r.status ELSE 'failed' END AS status,
          CASE WHEN c.run_id IS NULL THEN r.status ELSE 'recovered' END AS run_label, COUNT(*) AS run_count
        FROM runs r LEFT JOIN recovered c USING (run_id) GROUP BY ALL""",
    ),
    "recovery_candidates": _q(
        RUNS,
        f"""SELECT run_id, {_SHOW.format('start_ts')} AS started_at, published_count,
        CASE WHEN published_count > 0 THEN 'manual_review' ELSE 'recover' END AS verdict FROM candidates""",
    ),
    "recovered_runs": _q(
        RUNS,
        f"""SELECT run_id, 'failed' AS status, {_SHOW.format('at_ts')} AS at, '2001-01-01 00:00:00' AS recovered_at,
        'writer ended before publication completed' AS error_message, artifact AS recovered_artifact_path
        FROM recovered""",
    ),
    "interrupted_runs": _q(
        RUNS, f"SELECT run_id, 'interrupted' AS status, {_SHOW.format('at_ts')} AS at FROM recovered"
    ),
    "orphan_results": _q(
        RUNS,
        """SELECT run_id, result_rows FROM written
        WHERE run_id NOT IN (SELECT run_id FROM ord WHERE o_orderstatus = 'F')""",
    ),
    "data_states": _q(
        RUNS,
        """SELECT CASE WHEN source_file_id = 'file-0' THEN '' ELSE r.run_id END AS run_id,
          CASE WHEN source_file_id = 'file-0' THEN 'invalid_request' WHEN status <> 'succeeded' THEN 'not_found'
               WHEN w.run_id IS NULL THEN 'read_error' ELSE 'available' END AS data_state,
          COUNT(*) AS requests
        FROM runs r LEFT JOIN written w USING (run_id) GROUP BY 1, 2""",
    ),
    "run_summary": _q(
        RUNS,
        f"""SELECT r.run_id, status, {_SHOW.format('end_ts')} AS completed_at, stock_code, sample_quantity_sum
        FROM runs r JOIN (SELECT l_orderkey, 'P' || (l_partkey % 8) AS stock_code,
          CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS sample_quantity_sum FROM lineitem GROUP BY 1, 2) d
          ON d.l_orderkey = r.o_orderkey""",
    ),
    "event_validity": _q(
        ODD,
        """SELECT place, reason,
          CASE WHEN reason IS NULL THEN sha256('{"event_id":"' || (doc ->> '$.event_id') || '","occurred_at":"'
            || (doc ->> '$.occurred_at') || '","product_code":"' || (doc ->> '$.product_code') || '","quantity":'
            || (doc ->> '$.quantity') || '}') END AS payload_sha256,
          CASE WHEN reason IS NULL THEN CAST(doc ->> '$.quantity' AS BIGINT) END AS quantity
        FROM judged""",
    ),
    "invalid_events": _q(
        ODD, "SELECT reason, COUNT(*) AS event_count FROM judged WHERE reason IS NOT NULL GROUP BY reason"
    ),
    "canonical_events": _q(
        CLEAN_LOG, "SELECT topic, partition, kafka_offset, payload_json, payload_sha256, observed_date FROM log"
    ),
    "event_fixture_violations": _q(
        CONFLICT_LOG,
        """SELECT event_id, COUNT(*) AS times,
          CASE WHEN COUNT(DISTINCT payload_sha256) > 1 THEN 'conflicting_content' ELSE 'repeated' END AS reason
        FROM log GROUP BY event_id HAVING COUNT(*) > 1""",
    ),
    "event_collisions": _q(
        CONFLICT_LOG, "SELECT event_id FROM log GROUP BY event_id HAVING COUNT(DISTINCT payload_sha256) > 1"
    ),
    "plan_violations": _q(
        CLEAN_LOG + _PLAN,
        """SELECT delivery_id, 'field_missing' AS reason FROM plan WHERE delivery_id = '' OR phase = '' OR event_id = ''
        UNION ALL
        SELECT delivery_id, 'delivery_id_repeats' FROM plan GROUP BY delivery_id HAVING COUNT(*) > 1
        UNION ALL
        SELECT delivery_id, 'unknown_event' FROM plan WHERE event_id NOT IN (SELECT event_id FROM uniq)""",
    ),
    "delivery_plan": _q(
        CLEAN_LOG + _PLAN,
        """SELECT delivery_id, phase, event_id, payload_json, payload_sha256 FROM plan JOIN uniq USING (event_id)
        WHERE phase = 'late'""",
    ),
    "batch_product_day": _q(
        CLEAN_LOG,
        f"SELECT {_TOTALS.format('q')} FROM disp WHERE disposition = 'accepted' GROUP BY observed_date, product_code",
    ),
    "dedup_product_day": _q(
        CLEAN_LOG,
        f"""SELECT {_TOTALS.format('q')} FROM (SELECT DISTINCT event_id, observed_date, product_code, q FROM log)
        GROUP BY observed_date, product_code""",
    ),
    "wide_sum": _q(
        CLEAN_LOG,
        f"""SELECT {_TOTALS.format('(CAST(q AS HUGEINT) * 10000000000000000)')} FROM disp
        WHERE disposition = 'accepted' GROUP BY observed_date, product_code""",
    ),
    "dispositions": _q(
        CONFLICT_LOG,
        """SELECT topic, partition, kafka_offset, event_id, payload_sha256, existing_payload_sha256, disposition
        FROM disp""",
    ),
    "dispositions_twice": _q(
        CONFLICT_LOG
        + """, twice AS (
          SELECT partition, event_id, disposition FROM disp
          UNION ALL
          SELECT partition, event_id, CASE disposition WHEN 'accepted' THEN 'redelivery' ELSE disposition END FROM disp)""",
        """SELECT partition, disposition, COUNT(*) AS deliveries, COUNT(DISTINCT event_id) AS events
        FROM twice GROUP BY partition, disposition""",
    ),
    "dispositions_after_ledger": _q(
        CONFLICT_LOG
        + """, known AS (
            SELECT event_id, payload_sha256 AS known_sha FROM disp
            WHERE disposition = 'accepted' AND observed_date < DATE '2024-01-15'),
        again AS (
          SELECT d.partition, d.kafka_offset, CASE WHEN known_sha IS NULL THEN disposition
            WHEN payload_sha256 = known_sha THEN 'redelivery' ELSE 'conflict' END AS disposition
          FROM disp d LEFT JOIN known USING (event_id))""",
        """SELECT partition, disposition, COUNT(*) AS deliveries, MIN(kafka_offset) AS first_offset FROM again
        GROUP BY partition, disposition""",
    ),
    "conflict_stop": _q(CONFLICT_LOG, "SELECT * FROM stops"),
    "delivery_attempts": _q(
        CONFLICT_LOG, "SELECT topic, partition, kafka_offset, event_id, disposition FROM attempts"
    ),
    "recorded_conflicts": _q(
        CONFLICT_LOG,
        """SELECT topic, partition, kafka_offset, event_id, existing_payload_sha256,
        payload_sha256 AS incoming_payload_sha256, payload_json AS incoming_payload_json
        FROM attempts WHERE disposition = 'conflict'""",
    ),
    "ledger_product_day": _q(
        CONFLICT_LOG,
        f"SELECT {_TOTALS.format('q')} FROM attempts WHERE disposition = 'accepted' GROUP BY observed_date, product_code",
    ),
    "ledger_totals": _q(
        CONFLICT_LOG,
        """SELECT COUNT(*) FILTER (disposition = 'accepted') AS event_count,
        COUNT(*) FILTER (disposition = 'conflict') AS conflict_count, COUNT(*) AS attempt_count FROM attempts""",
    ),
    "ledger_is_empty": _q(
        CONFLICT_LOG,
        """SELECT COUNT(*) + COUNT(*) FILTER (disposition <> 'redelivery') AS materialized_rows, COUNT(*) = 0 AS is_empty
        FROM attempts""",
    ),
    "position_gaps": _q(
        CLEAN_LOG,
        """SELECT topic, partition, kafka_offset, CAST(5 AS BIGINT) AS durable_next_offset FROM (
          SELECT topic, partition, kafka_offset,
            lag(kafka_offset) OVER (PARTITION BY topic, partition ORDER BY kafka_offset) AS prev
          FROM log WHERE product_code <> 'signup')
        WHERE kafka_offset > 5 AND prev IS DISTINCT FROM kafka_offset - 1""",
    ),
    "prior_position": _q(
        CLEAN_LOG,
        """SELECT topic, partition, kafka_offset, event_id, payload_sha256,
          max(next_offset) AS durable_next_offset
        FROM log JOIN stops USING (topic, partition) WHERE product_code = 'view'
        GROUP BY topic, partition, kafka_offset, event_id, payload_sha256""",
    ),
    "stream_commits": _q(
        CLEAN_LOG, "SELECT topic, partition, max(kafka_offset) + 1 AS committed_next_offset FROM log GROUP BY topic, partition"
    ),
    "stream_attempts": _q(
        CLEAN_LOG, "SELECT topic, partition, kafka_offset, event_id, payload_sha256, disposition FROM disp"
    ),
    "stream_ledger": _q(
        CLEAN_LOG,
        f"SELECT {_TOTALS.format('q')} FROM disp WHERE disposition = 'accepted' GROUP BY observed_date, product_code",
    ),
    "stream_verdicts": """
        WITH u AS (SELECT user_id, COUNT(*) AS n, min(event_id) AS lo, user_id % 12 AS shape FROM events GROUP BY user_id),
        p AS (SELECT *, CASE shape WHEN 0 THEN '' ELSE 'c' END AS cluster_id,
            CASE shape WHEN 1 THEN 'g-other' ELSE 'g' END AS group_id,
            CASE shape WHEN 2 THEN n + 1 WHEN 3 THEN -1001 WHEN 8 THEN -1001 WHEN 4 THEN n - 2 WHEN 9 THEN 1
              ELSE n - 1 END AS broker,
            CASE shape WHEN 5 THEN n + 1 WHEN 6 THEN -1 WHEN 10 THEN lo + 1 ELSE 0 END AS low,
            CASE shape WHEN 7 THEN n - 1 ELSE n + 1 END AS high,
            CASE WHEN shape NOT IN (8, 9, 10) THEN n END AS nxt FROM u),
        v AS (SELECT *, CASE WHEN cluster_id = '' THEN 'missing_cluster_id'
            WHEN low < 0 OR high < low THEN 'invalid_watermarks'
            WHEN nxt IS NULL AND low <> 0 THEN 'log_does_not_start_at_zero'
            WHEN nxt IS NULL AND broker > 0 THEN 'empty_ledger_but_group_advanced'
            WHEN nxt IS NOT NULL AND group_id <> 'g' THEN 'different_stream'
            WHEN low > nxt THEN 'log_begins_after_checkpoint' WHEN broker > nxt THEN 'group_ahead_of_ledger'
            WHEN high < nxt THEN 'log_ends_before_checkpoint'
            WHEN broker < 0 AND nxt > 1 THEN 'uncommitted_group_too_far_behind'
            WHEN broker >= 0 AND nxt - broker > 1 THEN 'ledger_too_far_ahead' END AS reason FROM p)
        SELECT cluster_id, group_id, 't-' || user_id AS topic, 0 AS partition, reason,
          CASE WHEN reason IS NULL THEN coalesce(nxt, 0) END AS start_offset,
          CASE WHEN reason IS NULL THEN broker >= high END AS caught_up FROM v""",
    "late_day_change": _q(
        CLEAN_LOG,
        """SELECT observed_date, product_code, COUNT(*) AS late_events, CAST(SUM(q) AS BIGINT) AS late_quantity
        FROM (SELECT *, max(observed_date) OVER (PARTITION BY topic, partition ORDER BY kafka_offset
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM disp WHERE disposition = 'accepted')
        WHERE observed_date < newest GROUP BY observed_date, product_code""",
    ),
    "event_order": _q(
        CLEAN_LOG,
        """SELECT event_id, topic AS first_topic, partition AS first_partition, kafka_offset AS first_offset,
          replace(left(occurred_at, 19), 'T', ' ') AS occurred_at
        FROM disp WHERE disposition = 'accepted'""",
    ),
}

# The same answers by other means: indexes, state, bitmaps, digests and intervals.
ORACLES |= {
    "dispositions_by_index": ORACLES["dispositions_after_ledger"],
    "dispositions_by_state": ORACLES["dispositions"],
    "running_product_day": _q(
        CLEAN_LOG,
        f"SELECT {_TOTALS.format('q')} FROM disp WHERE disposition = 'accepted' GROUP BY observed_date, product_code",
    ),
    "replayed_log": ORACLES["stream_ledger"],
    "committed_products": ORACLES["result_products"],
    "row_diff_by_bitmap": ORACLES["row_diff"],
    "count_mismatch_by_bitmap": ORACLES["count_mismatch"],
    "scope_ids_by_bitmap": ORACLES["scope_ids"],
    "reconcile_differences_by_digest": ORACLES["reconcile_differences"],
    "digest_tree_agreement": "SELECT CAST(0 AS BIGINT) AS differing_leaves, COUNT(*) AS members FROM lineitem",
    "position_gaps_by_interval": ORACLES["position_gaps"],
    "prior_position_by_interval": ORACLES["prior_position"],
}
