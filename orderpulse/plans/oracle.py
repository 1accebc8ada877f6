"""Independent SQL for every named query, runnable by DuckDB.

Each statement reads the raw supplied tables through the ``sales`` /
``order_rows`` definitions below: the full item-level join, with no
pre-aggregation, so it checks the Spark plans' eager aggregation too.
Money is summed as DECIMAL and cast to DOUBLE last; ratios are computed as
DOUBLE in the same operation order as the Spark side.
"""

from __future__ import annotations

SALES_CTE = """
sales AS (
  SELECT
    l.l_orderkey AS increment_id,
    l.l_linenumber AS line_number,
    CASE o.o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'canceled'
         WHEN 'P' THEN 'order_refunded' END AS status,
    CAST(o.o_orderdate AS TIMESTAMP) AS created_at,
    CAST(o.o_orderdate AS DATE) AS Working_Date,
    o.o_orderpriority AS payment_method,
    o.o_custkey AS Customer_ID,
    p.p_type AS Category,
    CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) AS DECIMAL(18,4)) AS price,
    CAST(l.l_quantity AS INTEGER) AS qty_ordered,
    CAST(CAST(l.l_extendedprice AS DECIMAL(12,2))
         * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS grand_total
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""


def with_sales(body: str) -> str:
    return f"WITH {SALES_CTE}\n{body}"


DASHBOARD = {
    "top_categories": with_sales("""
SELECT row_number() OVER (ORDER BY total DESC, Category) AS rank, Category, total
FROM (
  SELECT Category, COALESCE(CAST(SUM(grand_total) AS DOUBLE), 0.0) AS total
  FROM sales WHERE Category IS NOT NULL
  GROUP BY Category ORDER BY total DESC, Category LIMIT 5
) t"""),
    "kpi_summary": with_sales("""
SELECT
  COUNT(*) AS total_orders,
  COALESCE(CAST(SUM(grand_total) AS DOUBLE), 0.0) AS total_sales,
  CASE WHEN COUNT(grand_total) > 0
       THEN CAST(SUM(grand_total) AS DOUBLE) / COUNT(grand_total) ELSE 0.0 END AS avg_order_value,
  CASE WHEN COUNT(*) > 0
       THEN CAST(SUM(grand_total) AS DOUBLE) / COUNT(*) ELSE 0.0 END AS avg_order_value_page,
  CASE WHEN COUNT(*) > 0
       THEN CAST(COUNT(*) FILTER (WHERE status = 'complete') * 100 AS DOUBLE) / COUNT(*)
       ELSE 0.0 END AS complete_rate
FROM sales"""),
    "avg_order_value_page": with_sales("""
SELECT CASE WHEN COUNT(*) > 0 THEN CAST(SUM(grand_total) AS DOUBLE) / COUNT(*) ELSE 0.0 END
       AS avg_order_value
FROM sales"""),
    "avg_order_value_sql": with_sales("""
SELECT CASE WHEN COUNT(grand_total) > 0
            THEN CAST(SUM(grand_total) AS DOUBLE) / COUNT(grand_total) ELSE 0.0 END AS avg_order_value
FROM sales"""),
    "complete_rate": with_sales("""
SELECT CASE WHEN COUNT(*) > 0
            THEN CAST(COUNT(*) FILTER (WHERE status = 'complete') * 100 AS DOUBLE) / COUNT(*)
            ELSE 0.0 END AS complete_rate
FROM sales"""),
    "total_sales": with_sales("""
SELECT COALESCE(CAST(SUM(grand_total) AS DOUBLE), 0.0) AS total_sales FROM sales"""),
    "total_orders": with_sales("""
SELECT COUNT(*) AS total_orders FROM sales"""),
    "daily_orders": with_sales("""
SELECT Working_Date, COUNT(*) AS orders FROM sales GROUP BY Working_Date ORDER BY Working_Date"""),
    "daily_sales": with_sales("""
SELECT Working_Date, COALESCE(CAST(SUM(grand_total) AS DOUBLE), 0.0) AS sales
FROM sales GROUP BY Working_Date ORDER BY Working_Date"""),
    "monthly_orders": with_sales("""
SELECT strftime(Working_Date, '%Y-%m') AS month, COUNT(*) AS orders
FROM sales GROUP BY 1 ORDER BY 1"""),
    "status_distribution": with_sales("""
SELECT status, COUNT(*) AS orders FROM sales GROUP BY status"""),
    "payment_distribution": with_sales("""
SELECT payment_method, COUNT(*) AS orders FROM sales GROUP BY payment_method"""),
    "customer_order_distribution": with_sales("""
SELECT orders, COUNT(*) AS customers
FROM (SELECT Customer_ID, COUNT(*) AS orders FROM sales
      WHERE Customer_ID IS NOT NULL GROUP BY Customer_ID) c
GROUP BY orders ORDER BY orders"""),
    "category_sales": with_sales("""
SELECT Category, COALESCE(CAST(SUM(grand_total) AS DOUBLE), 0.0) AS sales
FROM sales GROUP BY Category"""),
    "category_order_counts": with_sales("""
SELECT Category, COUNT(*) AS orders FROM sales GROUP BY Category"""),
}




# --- listings --------------------------------------------------------------

ORDER_ROWS = """
order_rows AS (
  SELECT
    o_orderkey AS item_id,
    CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'canceled'
         WHEN 'P' THEN 'order_refunded' END AS status,
    CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'danger'
         WHEN 'P' THEN 'warning' END AS severity,
    o_orderdate AS created_at,
    o_totalprice AS grand_total,
    o_orderpriority AS payment_method,
    o_custkey AS Customer_ID
  FROM orders
)"""


def _page_sql(page: int, per_page: int) -> str:
    return f"""WITH {ORDER_ROWS}
SELECT * FROM order_rows ORDER BY item_id LIMIT {per_page} OFFSET {(page - 1) * per_page}"""


def _strip_sql(expr: str) -> str:
    from orderpulse.functions.text import PY_WHITESPACE_CLASS_RE2 as C
    return f"regexp_replace({expr}, '^{C}+|{C}+$', '', 'g')"


def _extended() -> dict[str, str]:
    from orderpulse.plans import listing
    from orderpulse.plans.messages import PAD_LEFT, PAD_RIGHT

    def chars(s: str) -> str:
        return " || ".join(f"chr({ord(c)})" for c in s)

    padded = f"({chars(PAD_LEFT)} || event_type || {chars(PAD_RIGHT)})"
    clean = _strip_sql(padded)
    stripped_type = _strip_sql("event_type")
    present = "event_type IS NOT NULL AND event_type <> ''"
    per, page = listing.PER_PAGE, listing.PAGE
    kpi = DASHBOARD["kpi_summary"]
    return {
        "order_page": _page_sql(page, per),
        "order_page_deep": _page_sql(listing.DEEP_PAGE, per),
        "order_page_nulls": f"""WITH {ORDER_ROWS},
r AS (SELECT CASE WHEN item_id % 20 <> 0 THEN item_id END AS item_id, item_id AS item_no, status, grand_total
      FROM order_rows),
n AS (SELECT *, row_number() OVER (ORDER BY item_id NULLS FIRST, item_no) - 1 AS place FROM r)
SELECT path, item_id, item_no, status, grand_total
FROM n JOIN (VALUES ('one step', {page}), ('narrowed', {page}), ('deep', {listing.DEEP_PAGE})) p(path, number)
  ON place // {per} = number - 1""",
        "order_page_indexed": f"""WITH {ORDER_ROWS},
r AS (SELECT CASE WHEN item_id % 20 <> 0 THEN item_id END AS item_id, item_id AS item_no, status, grand_total
      FROM order_rows),
n AS (SELECT *, row_number() OVER (ORDER BY item_id NULLS FIRST, item_no) - 1 AS place FROM r)
SELECT page, item_id, item_no, status, grand_total
FROM n JOIN (VALUES (CAST({page} AS BIGINT)), ({listing.DEEP_PAGE}), ({listing.INDEX_FILE_ROWS // per + 1}), ({10 ** 12})) p(page)
  ON place // {per} = page - 1""",
        "stream_paced_bytes": f"""
SELECT {stripped_type} AS Category, COUNT(*) AS count, CAST(0 AS BIGINT) AS batches_over_limit FROM events
WHERE event_type IS NOT NULL AND {stripped_type} <> '' GROUP BY 1""",
        "order_page_after": f"""WITH {ORDER_ROWS}
SELECT * FROM order_rows WHERE item_id > {listing.AFTER_KEY} ORDER BY item_id LIMIT {per}""",
        "item_page": with_sales(f"""
SELECT increment_id, line_number, status, created_at, CAST(price AS DOUBLE) AS price, qty_ordered,
       CAST(grand_total AS DOUBLE) AS grand_total, Category, payment_method, Customer_ID
FROM sales
ORDER BY increment_id NULLS FIRST, line_number NULLS FIRST, status NULLS FIRST,
         created_at NULLS FIRST, price NULLS FIRST, qty_ordered NULLS FIRST,
         grand_total NULLS FIRST, Category NULLS FIRST, payment_method NULLS FIRST,
         Customer_ID NULLS FIRST
LIMIT {per} OFFSET {(listing.ITEM_PAGE - 1) * per}"""),
        "page_metadata": f"""
SELECT CAST({page} AS BIGINT) AS page, CAST({per} AS BIGINT) AS per_page,
       COUNT(*) AS total,
       CAST(ceil(COUNT(*) / {per}.0) AS BIGINT) AS total_pages,
       CAST(greatest(1, {page - 2}) AS BIGINT) AS start_page,
       CAST(least(CAST(ceil(COUNT(*) / {per}.0) AS BIGINT), {page + 2}) AS BIGINT) AS end_page
FROM orders""",
        "json_extract": """
SELECT event_id,
       json_extract_string(json_object('item_id', event_id, 'Category', event_type), '$.item_id') AS item_id,
       json_extract_string(json_object('item_id', event_id, 'Category', event_type), '$.Category') AS Category,
       json_extract_string(props, '$.k') AS k
FROM events""",
        "clean_categories": f"""
SELECT CAST(event_id AS BIGINT) AS item_id, {clean} AS Category
FROM events WHERE event_type IS NOT NULL AND {clean} <> ''""",
        "status_severity": f"""WITH {ORDER_ROWS}
SELECT item_id, status, severity FROM order_rows""",
        "item_listing": with_sales("""
SELECT increment_id, line_number, status,
       CASE status WHEN 'complete' THEN 'success' WHEN 'canceled' THEN 'danger'
                   WHEN 'order_refunded' THEN 'warning' END AS severity,
       created_at, CAST(price AS DOUBLE) AS price, qty_ordered,
       CAST(grand_total AS DOUBLE) AS grand_total,
       COALESCE(NULLIF(Category, ''), 'N/A') AS Category, payment_method, Customer_ID
FROM sales"""),
        "kpi_display": f"""
WITH k AS ({kpi})
SELECT total_orders,
       format('{{:.2f}}', avg_order_value) AS avg_order_value_text,
       '¥' || format('{{:,.2f}}', total_sales) AS total_sales_text,
       '¥' || format('{{:,.2f}}', avg_order_value) AS avg_order_value_money,
       format('{{:.2f}}', complete_rate) AS complete_rate_text,
       format('{{:.1f}}', complete_rate) || '%' AS complete_rate_percent
FROM k""",
        "epoch_to_timestamp": """
SELECT event_id,
       date_diff('second', TIMESTAMP '1970-01-01 00:00:00', ts) AS epoch,
       make_timestamp(date_diff('second', TIMESTAMP '1970-01-01 00:00:00', ts) * 1000000) AS ts_utc
FROM events""",
        "payload_routing": f"""
WITH c AS (SELECT event_type AS Category, COUNT(*) AS count FROM events
           WHERE {present} GROUP BY event_type)
SELECT 'envelope' AS shape, 'load' AS route, Category, count FROM c
UNION ALL SELECT 'array', 'raw', Category, count FROM c
UNION ALL SELECT 'object', 'raw', Category, count FROM c""",
        "tombstone_routing": """
SELECT CASE WHEN event_id % 10 = 0 THEN 'tombstone' ELSE 'object' END AS shape,
       CASE WHEN event_id % 10 = 0 THEN 'skip' ELSE 'raw' END AS route, COUNT(*) AS messages
FROM events GROUP BY 1, 2""",
        "result_map": DASHBOARD["payment_distribution"],
        "csv_quoted_roundtrip": """
SELECT doc_id AS item_id, sha256('he said "x", ok' || chr(10) || text || ',"') AS sha, 'z' AS last FROM documents""",
        "ensured_table": f"""
SELECT CAST(0 AS BIGINT) AS rows_before, event_type AS Category, COUNT(*) AS count FROM events GROUP BY 2""",
        "snapshot_many_parts": f"""
SELECT {stripped_type} AS category, COUNT(*) AS count FROM events
WHERE event_type IS NOT NULL AND {stripped_type} <> '' GROUP BY 1""",
        "snapshot_reload_plain": f"""
SELECT event_type AS category, COUNT(*) AS count FROM events WHERE {present} GROUP BY 1""",
        "snapshot_reload_late": f"""
SELECT stage, event_type AS category, COUNT(*) + more AS count
FROM events, (VALUES ('later batch', 3), ('after restart', 3), ('newer', 4)) s(stage, more)
WHERE {present} GROUP BY stage, more, event_type""",
        "append_compacted": f"""
SELECT event_type AS Category, COUNT(*) AS messages, CAST(SUM(event_id) AS BIGINT) AS total, MAX(event_id) AS largest
FROM events WHERE {present} GROUP BY 1""",
        "keyed_growth": """
SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE status END AS status, customer,
       CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS revision
FROM (SELECT o_orderkey, max(o_orderstatus) AS status, CAST(arg_max(o_custkey, {'a': o_orderstatus, 'b': o_custkey}) AS BIGINT) AS customer
      FROM orders GROUP BY 1)""",
        "snapshot_reload_empty": f"""
SELECT COUNT(DISTINCT event_type) AS rows_before, CAST(0 AS BIGINT) AS rows_after FROM events WHERE {present}""",
        "append_from_envelopes": f"""
SELECT event_type AS Category, COUNT(*) AS count FROM events WHERE {present} GROUP BY 1""",
        "append_from_array": f"""
SELECT event_type AS Category, COUNT(*) AS count FROM events WHERE {present} GROUP BY 1""",
        "stream_restart_counts": f"""
WITH e AS (SELECT event_id, {stripped_type} AS c FROM events WHERE event_type IS NOT NULL AND {stripped_type} <> '')
SELECT 'half' AS run, c AS Category, COUNT(*) AS count FROM e WHERE event_id % 2 = 0 GROUP BY 2
UNION ALL SELECT 'resumed', c, COUNT(*) FROM e GROUP BY 2
UNION ALL SELECT 'fresh', c, COUNT(*) FROM e GROUP BY 2""",
        "topic_start_policies": f"""
WITH e AS (SELECT event_id, {stripped_type} AS c FROM events WHERE event_type IS NOT NULL AND {stripped_type} <> '')
SELECT 'earliest' AS policy, 'first' AS run, c AS Category, COUNT(*) AS count FROM e WHERE event_id % 2 = 0 GROUP BY 3
UNION ALL SELECT 'earliest', 'resumed', c, COUNT(*) FROM e GROUP BY 3
UNION ALL SELECT 'latest', 'resumed', c, COUNT(*) FROM e WHERE event_id % 2 <> 0 GROUP BY 3""",
        "stream_reseeded_counts": f"""
SELECT {stripped_type} AS Category, COUNT(*) AS count, COUNT(*) AS in_state FROM events
WHERE event_type IS NOT NULL AND {stripped_type} <> '' GROUP BY 1""",
        "message_bytes": """
SELECT CAST(event_id AS VARCHAR) AS item_id, event_type AS Category FROM events""",
        "result_rows_roundtrip": f"""
SELECT event_type AS Category, COUNT(*) AS count FROM events WHERE {present} GROUP BY 1""",
        "csv_header_roundtrip": """
SELECT event_id AS item_id, event_type AS Category FROM events""",
        "csv_positional": """
SELECT c_mktsegment AS value FROM customer
WHERE c_mktsegment IS NOT NULL AND c_mktsegment <> 'gender'""",
        "publish_json": f"""
SELECT '{{"item_id":' || event_id || ',"Category":' || to_json({stripped_type}) || '}}' AS value
FROM events""",
        "csv_page_kpis": kpi,
        "layout_kpis": kpi,
        "dashboard_payload_rows": f"""
WITH k AS ({kpi}), d AS ({DASHBOARD["daily_orders"]}), t AS ({DASHBOARD["top_categories"]}),
s AS (SELECT section, label, value FROM (
  SELECT 'kpis' AS section, unnest(['total_orders', 'total_sales', 'avg_order_value', 'avg_order_value_page', 'complete_rate']) AS label,
         unnest([CAST(total_orders AS DOUBLE), total_sales, avg_order_value, avg_order_value_page, complete_rate]) AS value FROM k))
SELECT * FROM s
UNION ALL SELECT 'daily_orders', strftime(Working_Date, '%Y-%m-%d'), CAST(orders AS DOUBLE) FROM d WHERE Working_Date IS NOT NULL
UNION ALL SELECT 'top_categories', rank || ' ' || Category, total FROM t""",
        "stream_dashboard_payload": f"""
WITH k AS ({kpi}), d AS ({DASHBOARD["daily_orders"]}), t AS ({DASHBOARD["top_categories"]}),
s AS (SELECT section, label, value FROM (
  SELECT 'kpis' AS section, unnest(['total_orders', 'total_sales', 'avg_order_value', 'avg_order_value_page', 'complete_rate']) AS label,
         unnest([CAST(total_orders AS DOUBLE), total_sales, avg_order_value, avg_order_value_page, complete_rate]) AS value FROM k))
SELECT * FROM s
UNION ALL SELECT 'daily_orders', strftime(Working_Date, '%Y-%m-%d'), CAST(orders AS DOUBLE) FROM d WHERE Working_Date IS NOT NULL
UNION ALL SELECT 'top_categories', rank || ' ' || Category, total FROM t""",
        "stream_dashboard_kpis": kpi,
        "stream_dashboard_top_categories": DASHBOARD["top_categories"],
        "csv_raw_listing": with_sales("""
SELECT CAST(increment_id * 100 + line_number AS VARCHAR) AS item_id, status,
       CASE status WHEN 'complete' THEN 'success' WHEN 'canceled' THEN 'danger'
                   WHEN 'order_refunded' THEN 'warning' END AS severity,
       COALESCE(NULLIF(Category, ''), 'N/A') AS Category, payment_method,
       CAST(Customer_ID AS VARCHAR) AS Customer_ID
FROM sales"""),
        "csv_page_top_categories": DASHBOARD["top_categories"],
        "stream_category_counts": f"""
SELECT {stripped_type} AS Category, COUNT(*) AS count FROM events
WHERE event_type IS NOT NULL AND {stripped_type} <> '' GROUP BY 1""",
        "stream_snapshot_rows": f"""
SELECT {stripped_type} AS Category, COUNT(*) AS count FROM events
WHERE event_type IS NOT NULL AND {stripped_type} <> '' GROUP BY 1""",
        "snapshot_reload": f"""
SELECT {stripped_type} AS category, COUNT(*) AS count FROM events
WHERE event_type IS NOT NULL AND {stripped_type} <> '' GROUP BY 1""",
        "append_results": f"""
SELECT event_type AS Category, COUNT(*) AS count FROM events WHERE {present} GROUP BY 1""",
        "quarantine": """
WITH m AS (SELECT regexp_replace(text, '[\\r\\n]', ' ', 'g') AS t FROM documents
           UNION ALL VALUES ('{"Category":"a","count":1}] junk'), ('{''Category'':''a'',''count'':1}'), ('1],[2')),
s AS (
  SELECT CASE
    WHEN NOT json_valid(t) THEN 'malformed'
    WHEN json_extract(t, '$.data') IS NOT NULL THEN 'envelope'
    WHEN substr(ltrim(t), 1, 1) = '[' THEN 'array'
    WHEN json_extract(t, '$.Category') IS NOT NULL THEN 'object'
    ELSE 'other' END AS reason
  FROM m)
SELECT reason, COUNT(*) AS messages FROM s WHERE reason <> 'object' GROUP BY reason""",
        "upsert_latest": f"""
SELECT event_type AS category, min(event_id) AS count,
       max(date_diff('second', TIMESTAMP '1970-01-01 00:00:00', ts)) AS epoch
FROM events WHERE {present} GROUP BY 1""",
    }


def all_sql() -> dict[str, str]:
    """Oracle statements by query name. ``dashboard_payload`` has none: its
    result is JSON text whose formatting is Spark's own;
    ``dashboard_payload_rows`` checks what the text says."""
    out: dict[str, str] = {}
    out.update(DASHBOARD)
    out.update(_extended())
    return out
