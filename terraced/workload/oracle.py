"""The same results in SQL over the given tables, written apart from the Spark code."""

from __future__ import annotations

_STAMP = "'postgres-seed-20260307T120000Z'"
_AS_OF = "timestamp '2026-03-07 12:00:00'"

_SOURCES = """
src_customers AS (
  SELECT c_custkey AS customer_id,
         'CUST-' || lpad(c_custkey::varchar, greatest(7, length(c_custkey::varchar))::int, '0') AS customer_code,
         c_name AS customer_name, r_name AS region, c_mktsegment AS segment,
         timestamp '1992-01-01' + (c_custkey % 3650)::int * interval 1 day AS created_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
src_orders AS (
  SELECT 'ORD-' || lpad(o_orderkey::varchar, greatest(9, length(o_orderkey::varchar))::int, '0') AS order_id,
         o_custkey AS customer_id,
         CASE o_orderstatus WHEN 'O' THEN 'created' WHEN 'P' THEN 'paid' WHEN 'F' THEN 'shipped' ELSE o_orderstatus END AS status,
         o_orderdate AS order_created_at
  FROM orders
),
src_items AS (
  SELECT 'ITEM-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity::bigint AS item_id,
         'ORD-' || lpad(l_orderkey::varchar, greatest(9, length(l_orderkey::varchar))::int, '0') AS order_id,
         'SKU-' || l_partkey AS sku, l_quantity::int AS quantity, l_extendedprice::decimal(12,2) AS unit_price
  FROM lineitem
),
src_taxes AS (
  SELECT n_nationkey * 100 + percent AS tax_id, 'TAX-' || n_nationkey || '-' || percent AS tax_code,
         'Tax ' || n_name || ' ' || percent AS tax_name, r_name AS jurisdiction,
         (percent / 100.0)::decimal(6,4) AS rate, first_shipment AS effective_at,
         first_shipment - interval 30 day AS created_at
  FROM (SELECT s_nationkey, round(l_tax * 100)::int AS percent, min(l_shipdate) AS first_shipment
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
src_depot AS (
  SELECT 'DPT-' || lpad(event_id::varchar, greatest(9, length(event_id::varchar))::int, '0') AS transaction_id,
         user_id AS customer_id,
         'depot-' || substr('abcd', (json_extract_string(props, '$.k')::int % 4) + 1, 1) AS depot_code,
         event_type AS transaction_type, value::decimal(12,2) AS amount, ts AS transaction_at
  FROM events
),
"""

_EXPORTS = f"""
exp_orders AS (
  SELECT o.order_id, c.customer_code AS customer_id, o.status, count(i.item_id) AS item_count,
         round(sum(i.quantity * i.unit_price), 2)::decimal(38,2) AS order_total, o.order_created_at
  FROM src_orders o JOIN src_customers c ON c.customer_id = o.customer_id JOIN src_items i ON i.order_id = o.order_id
  GROUP BY o.order_id, c.customer_code, o.status, o.order_created_at
),
exp_items AS (
  SELECT i.order_id, i.item_id, i.sku, i.quantity, i.unit_price,
         round(i.quantity * i.unit_price, 2)::decimal(38,2) AS line_total, o.order_created_at AS loaded_at
  FROM src_items i JOIN src_orders o ON o.order_id = i.order_id
),
exp_customers AS (
  SELECT c.customer_code AS customer_id, c.customer_name, c.region, c.segment, count(DISTINCT o.order_id) AS order_count,
         coalesce(round(sum(i.quantity * i.unit_price), 2), 0)::decimal(38,2) AS total_order_value,
         min(o.order_created_at) AS first_order_at, max(o.order_created_at) AS latest_order_at,
         c.created_at AS customer_created_at
  FROM src_customers c LEFT JOIN src_orders o ON o.customer_id = c.customer_id LEFT JOIN src_items i ON i.order_id = o.order_id
  GROUP BY c.customer_code, c.customer_name, c.region, c.segment, c.created_at
),
exp_taxes AS (SELECT tax_code, tax_name, jurisdiction, rate, effective_at, created_at AS loaded_at FROM src_taxes),
exp_depot AS (
  SELECT d.transaction_id, c.customer_code AS customer_id, d.depot_code, d.transaction_type, d.amount, d.transaction_at,
         'star_schema' AS source_system, d.transaction_at AS loaded_at
  FROM src_depot d JOIN src_customers c ON c.customer_id = d.customer_id
),
"""

_PRODUCTS = f"""
orders_clean AS (
  SELECT order_id, customer_id, item_count, order_total, {_STAMP} AS load_batch, upper(trim(status)) AS order_status,
         order_created_at,
         CASE WHEN order_total >= 7500000 THEN 'HIGH' WHEN order_total >= 2800000 THEN 'MEDIUM' ELSE 'LOW' END AS order_value_band,
         {_AS_OF} AS cleaned_at
  FROM exp_orders
),
items_clean AS (
  SELECT order_id, item_id, sku, quantity, unit_price, line_total,
         row_number() OVER (PARTITION BY order_id ORDER BY item_id) AS line_number, loaded_at, {_AS_OF} AS cleaned_at
  FROM exp_items
),
order_summary AS (
  SELECT customer_id, count(*) AS order_count, sum(order_total) AS total_order_value, min(order_created_at) AS first_order_at,
         max(order_created_at) AS latest_order_at, max(load_batch) AS latest_load_batch
  FROM orders_clean GROUP BY 1
),
customers_clean AS (
  SELECT customer_id, customer_name, order_count, total_order_value, {_STAMP} AS load_batch, upper(trim(region)) AS region,
         upper(trim(segment)) AS segment, first_order_at, latest_order_at, customer_created_at,
         CASE WHEN total_order_value >= 67000000 THEN 'HIGH_VALUE' WHEN total_order_value >= 40000000 THEN 'MEDIUM_VALUE'
              ELSE 'LOW_VALUE' END AS customer_value_band,
         {_AS_OF} AS cleaned_at
  FROM exp_customers
),
taxes_clean AS (
  SELECT tax_code, tax_name, rate, {_STAMP} AS load_batch, upper(trim(jurisdiction)) AS jurisdiction, effective_at, loaded_at,
         CASE WHEN rate >= 0.06 THEN 'HIGH' WHEN rate >= 0.03 THEN 'STANDARD' ELSE 'REDUCED' END AS rate_band,
         {_AS_OF} AS cleaned_at
  FROM exp_taxes
),
depot_clean AS (
  SELECT transaction_id, customer_id, amount, {_STAMP} AS load_batch, upper(trim(depot_code)) AS depot_code,
         upper(trim(transaction_type)) AS transaction_type, transaction_at, loaded_at,
         CASE WHEN amount >= 70 THEN 'HIGH' WHEN amount >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS amount_band,
         {_AS_OF} AS cleaned_at
  FROM exp_depot
),
fact_items AS (SELECT order_id, count(*) AS item_rows, sum(line_total) AS item_revenue FROM items_clean GROUP BY 1),
revenue_star AS (
  SELECT o.order_id, o.customer_id, o.order_status, o.item_count, o.order_total, o.order_value_band, o.order_created_at,
         o.load_batch, md5(s.customer_id) AS customer_sk, md5(t.order_status) AS status_sk,
         coalesce(i.item_rows, 0) AS item_rows, coalesce(i.item_revenue, 0) AS item_revenue, {_AS_OF} AS modeled_at
  FROM orders_clean o LEFT JOIN fact_items i ON o.order_id = i.order_id
  LEFT JOIN order_summary s ON o.customer_id = s.customer_id
  LEFT JOIN (SELECT DISTINCT order_status FROM orders_clean) t ON o.order_status = t.order_status
),
value_star AS (
  SELECT c.* EXCLUDE (cleaned_at), md5(r.region) AS region_sk, md5(s.segment) AS segment_sk, {_AS_OF} AS modeled_at
  FROM customers_clean c LEFT JOIN (SELECT DISTINCT region FROM customers_clean) r ON c.region = r.region
  LEFT JOIN (SELECT DISTINCT segment FROM customers_clean) s ON c.segment = s.segment
)
"""

_ALL = "WITH" + _SOURCES + _EXPORTS + _PRODUCTS
_SRC = "WITH" + _SOURCES.rstrip().rstrip(",")

# Result types: money and rates as double, counts as bigint.
_PLAIN = {
    "order_total": "double",
    "item_revenue": "double",
    "line_total": "double",
    "unit_price": "double",
    "total_order_value": "double",
    "rate": "double",
    "amount": "double",
    "item_count": "bigint",
    "quantity": "bigint",
    "line_number": "bigint",
    "order_count": "bigint",
    "item_rows": "bigint",
}
# Decimal counts of the raw mirror and the cleaned tables compare as double too.
_WIDE = {**_PLAIN, "item_count": "double", "quantity": "double", "order_count": "double"}


def _pick(columns: str, source: str, types: dict[str, str] = _PLAIN, where: str = "", with_: str = _ALL) -> str:
    shown = [f"{c}::{types[c]} AS {c}" if c in types else c for c in columns.split()]
    return f"{with_} SELECT {', '.join(shown)} FROM {source} {where}"


def _iso(moment: str) -> str:
    fraction = f"CASE WHEN microsecond({moment}) % 1000000 <> 0 THEN strftime({moment}, '.%f') ELSE '' END"
    return f"(strftime({moment}, '%Y-%m-%dT%H:%M:%S') || {fraction} || '+00:00')"


def _pad(number: str, width: int) -> str:
    return f"lpad(({number})::varchar, greatest({width}, length(({number})::varchar))::int, '0')"


def _turn(values: str, at: str) -> str:
    items = values.split()
    return f"list_extract([{', '.join(repr(v) for v in items)}], ({at}) % {len(items)} + 1)"


ORDERS = "order_id customer_id order_status item_count order_total order_value_band order_created_at load_batch"
LINES = "order_id item_id sku quantity unit_price line_total line_number loaded_at"
ENTITY = (
    "customer_id customer_name region segment order_count total_order_value first_order_at latest_order_at "
    "customer_created_at load_batch customer_value_band"
)
TAXES = "tax_code tax_name jurisdiction rate rate_band effective_at"
DEPOT = "transaction_id customer_id depot_code transaction_type amount amount_band transaction_at"
FACT = ORDERS + " customer_sk status_sk item_rows item_revenue modeled_at"
REVENUE = "order_id customer_id customer_sk status_sk order_status order_total item_revenue item_rows order_value_band order_created_at"
SUMMARY = "customer_id order_count total_order_value first_order_at latest_order_at"


def _by(column: str, latest: bool = True, key: bool = False) -> str:
    extra = (f", {_AS_OF} AS latest_cleaned_at" if latest else "") + (f", md5({column}) AS {column}_sk" if key else "")
    return f"""{_ALL} SELECT {column}, count(*) AS customer_count, sum(order_count)::double AS total_order_count,
        sum(total_order_value)::double AS total_order_value,
        round(sum(total_order_value)::double / count(*), 4) AS avg_customer_value{extra}
        FROM customers_clean GROUP BY {column}"""


def _counts(pairs: list[tuple[str, str]], name: str = "table_name") -> str:
    rows = [f"SELECT '{label}' AS {name}, count(*) AS row_count FROM {source}" for label, source in pairs]
    return _ALL + " UNION ALL ".join(rows)


_FAULTY_ORDERS = """, lost AS (
    SELECT * REPLACE (CASE WHEN order_id NOT LIKE '%7' THEN order_total END AS order_total) FROM orders_clean),
  faulty AS (SELECT * FROM lost UNION ALL SELECT * FROM lost WHERE order_id LIKE '%50') """
_FAULTY_ITEMS = """, faulty_items AS (
    SELECT item_id, sku, unit_price, CASE WHEN sku LIKE '%9' THEN -quantity ELSE quantity END AS quantity,
           CASE WHEN sku LIKE '%13' THEN order_id || '-X' ELSE order_id END AS order_id FROM src_items) """


def _fail(check: str, table: str, column: str, source: str, rule: str) -> str:
    return (
        f"SELECT '{check}' AS check_name, '{table}' AS table_name, '{column}' AS column_name, "
        f"(SELECT count(*) FROM {source} WHERE {rule}) AS failures"
    )


def _dup(table: str, column: str, source: str) -> str:
    twice = f"(SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
    return _fail("unique", table, column, twice, "true")


def _keys(table: str, source: str, primary: str, required: str = "") -> list[str]:
    present = [_fail("not_null", table, c, source, f"{c} IS NULL") for c in (primary + " " + required).split()]
    return present + [_dup(table, c, source) for c in primary.split()]


_MANIFEST = """WITH picked AS (
  SELECT p_partkey AS k, p_type, p_brand,
         list_extract(['orders', 'Customers', 'taxes', 'depot_transactions', 'shipments'], p_partkey % 5 + 1) AS scope FROM part),
contract AS (
  SELECT 'model_' || k AS name, 'DB_' || upper(p_type) AS database, 'ACCESS' AS schema,
         CASE WHEN k % 3 = 0 THEN 'model_' || k ELSE 'T_' || k END AS alias
  FROM picked WHERE k % 10 <> 3 AND k % 7 <> 0 AND k % 4 <> 0 AND k % 9 <> 0)
"""

_REGISTRY = """WITH registry AS (
  SELECT c_custkey AS position, c_name AS key,
         CASE WHEN c_custkey % 11 <> 0
              THEN 'SDP_' || repeat(upper(c_mktsegment), (c_custkey % 13 + 1)::int) || '_' || (c_custkey // 2) END AS source_database
  FROM customer)"""


def _crc(text: str) -> str:
    """POSIX cksum of the text and a newline: bytes, then the low-first byte count."""
    octets = f"[ord(x) for x in string_split({text} || chr(10), '') if x <> '']"
    size = f"(length({text}) + 1)"
    count = f"[({size} >> s) & 255 for s in [0, 8, 16, 24] if ({size} >> s) > 0]"
    bit = (
        "list_reduce(list_concat([xor(crc, octet << 24)], [0,0,0,0,0,0,0,0]::bigint[]), lambda c, z: "
        "CASE WHEN (c & 2147483648) <> 0 THEN xor((c << 1) & 4294967295, 79764919) ELSE (c << 1) & 4294967295 END)"
    )
    fed = f"list_concat([0]::bigint[], list_concat({octets}, {count})::bigint[])"
    return f"xor(list_reduce({fed}, lambda crc, octet: {bit}), 4294967295)"


def _clone_named(branch: str) -> str:
    """CTE ``named``: registry rows with their clone name for an owner OWN and a branch."""
    return f"""{_REGISTRY},
parts AS (
  SELECT position, key, source_database, source_database || '_CI_CLO_OWN_' AS lead, upper('{branch}') AS token,
         ({_crc(f"(source_database || '_OWN_{branch}')")})::varchar AS checksum
  FROM registry WHERE source_database IS NOT NULL),
named AS (
  SELECT position, key, source_database,
    CASE WHEN length(lead) >= 120 THEN substr(lead, 1, 120)
         WHEN length(token) <= 120 - length(lead) THEN lead || token
         WHEN 120 - length(lead) - 1 - length(checksum) < 1 THEN lead || substr(checksum, 1, 120 - length(lead))
         ELSE lead || substr(token, 1, 120 - length(lead) - 1 - length(checksum)) || '_' || checksum END AS target_database
  FROM parts)"""


_SLUG = "trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_')"

_SOURCE_COUNTS = [
    ("customers", "src_customers"),
    ("orders", "src_orders"),
    ("order_items", "src_items"),
    ("taxes", "src_taxes"),
    ("depot_transactions", "src_depot"),
]
_EXPORT_COUNTS = [
    ("raw_customers", "exp_customers"),
    ("raw_orders", "exp_orders"),
    ("raw_order_items", "exp_items"),
    ("raw_taxes", "exp_taxes"),
    ("raw_depot_transactions", "exp_depot"),
]
_REGIONS = "(SELECT DISTINCT region FROM customers_clean)"
_SEGMENTS = "(SELECT DISTINCT segment FROM customers_clean)"
_STATUS = "(SELECT DISTINCT order_status FROM orders_clean)"
_FULFILLED = "(SELECT 1 FROM revenue_star WHERE order_status IN ('PAID', 'SHIPPED'))"
_HIGH = "(SELECT 1 FROM value_star WHERE customer_value_band = 'HIGH_VALUE')"

_SDP_RELATIONS = [
    ("sdp_orders.ext_orders_raw", "exp_orders"),
    ("sdp_orders.ext_order_items_raw", "exp_items"),
    ("sdp_orders.orders_clean", "orders_clean"),
    ("sdp_orders.order_items_clean", "items_clean"),
    ("sdp_orders.customer_order_summary", "order_summary"),
    ("sdp_orders.orders_order_grain", "orders_clean"),
    ("sdp_orders.orders_customer_grain", "order_summary"),
    ("sdp_orders.order_lines_order_grain", "items_clean"),
    ("sdp_customers.ext_customers_raw", "exp_customers"),
    ("sdp_customers.customers_clean", "customers_clean"),
    ("sdp_customers.customer_region_summary", _REGIONS),
    ("sdp_customers.customer_segment_summary", _SEGMENTS),
    ("sdp_customers.customers_entity_grain", "customers_clean"),
    ("sdp_customers.customers_region_grain", _REGIONS),
    ("sdp_customers.customers_segment_grain", _SEGMENTS),
    ("sdp_taxes.ext_taxes_raw", "exp_taxes"),
    ("sdp_taxes.taxes_clean", "taxes_clean"),
    ("sdp_taxes.taxes_grain", "taxes_clean"),
    ("sdp_depot_transactions.ext_depot_transactions_raw", "exp_depot"),
    ("sdp_depot_transactions.depot_transactions_clean", "depot_clean"),
    ("sdp_depot_transactions.depot_transactions_grain", "depot_clean"),
]
_CUSTOMER_RELATIONS = [
    ("edp_customers.in_customers_entity_grain", "customers_clean"),
    ("edp_customers.in_customers_region_grain", _REGIONS),
    ("edp_customers.in_customers_segment_grain", _SEGMENTS),
    ("edp_customers.customers_3nf", "customers_clean"),
    ("edp_customers.regions_3nf", _REGIONS),
    ("edp_customers.segments_3nf", _SEGMENTS),
    ("edp_customers.dim_regions", _REGIONS),
    ("edp_customers.dim_segments", _SEGMENTS),
    ("edp_customers.fct_customer_value_star", "value_star"),
    ("edp_customers.customers_complete", "value_star"),
    ("edp_customers.customers_high_value", _HIGH),
    ("edp_customers.customers_only", "value_star"),
    ("edp_taxes.in_taxes_grain", "taxes_clean"),
    ("edp_taxes.taxes_3nf", "taxes_clean"),
    ("edp_taxes.taxes_only", "taxes_clean"),
]
_TRANSACTION_RELATIONS = [
    ("edp_orders.in_orders_order_grain", "orders_clean"),
    ("edp_orders.in_orders_customer_grain", "order_summary"),
    ("edp_orders.in_order_lines_order_grain", "items_clean"),
    ("edp_orders.orders_3nf", "orders_clean"),
    ("edp_orders.order_lines_3nf", "items_clean"),
    ("edp_orders.customers_3nf", "order_summary"),
    ("edp_orders.dim_customers", "order_summary"),
    ("edp_orders.dim_order_status", _STATUS),
    ("edp_orders.fct_order_revenue_star", "revenue_star"),
    ("edp_orders.orders_complete", "revenue_star"),
    ("edp_orders.orders_fulfilled", _FULFILLED),
    ("edp_orders.orders_only", "revenue_star"),
    ("edp_depot_transactions.in_depot_transactions_grain", "depot_clean"),
    ("edp_depot_transactions.depot_transactions_3nf", "depot_clean"),
    ("edp_depot_transactions.depot_transactions_only", "depot_clean"),
]
_ACCESS = ("_grain", "_complete", "_high_value", "_only", "_fulfilled")


def _declared() -> str:
    """The declared checks with counted failures, over the same relations in SQL."""
    from terraced.plans.build import DECLARED

    source_of = {label: source for label, source in _SDP_RELATIONS + _CUSTOMER_RELATIONS + _TRANSACTION_RELATIONS}
    keyed = {
        "edp_customers.dim_regions": "(SELECT DISTINCT md5(region) AS region_sk FROM customers_clean)",
        "edp_customers.dim_segments": "(SELECT DISTINCT md5(segment) AS segment_sk FROM customers_clean)",
        "edp_orders.dim_customers": "(SELECT md5(customer_id) AS customer_sk FROM order_summary)",
        "edp_orders.dim_order_status": "(SELECT DISTINCT md5(order_status) AS status_sk FROM orders_clean)",
    }
    rows = []
    for product, _, table, present, distinct in DECLARED:
        label = f"{product}.{table}"
        source = keyed.get(label, source_of[label])
        rows += [_fail("not_null", label, c, source, f"{c} IS NULL") for c in present.split()]
        rows += [_dup(label, c, source) for c in distinct.split()]
    return _ALL + " UNION ALL ".join(rows)


def oracle_sql() -> dict[str, str]:
    n = "(k + 1)"
    sql: dict[str, str] = {}

    # Sources.
    sql["fetch_rows"] = (
        f"{_ALL} SELECT order_id, customer_id, order_total::double AS order_total, {_STAMP} AS load_batch "
        "FROM exp_orders WHERE status = 'paid'"
    )
    sql["seed_customers"] = f"""SELECT {n} AS customer_id, 'CUST-' || {_pad(n, 4)} AS customer_code,
        'Customer ' || {n} AS customer_name, {_turn("EMEA AMER APAC", "k")} AS region,
        {_turn("enterprise mid-market self-serve", "k")} AS segment,
        timestamp '2026-03-07' - (60 - {n})::int * interval 1 day AS created_at
        FROM (SELECT c_custkey AS k FROM customer)"""
    sql["seed_orders"] = f"""SELECT 'ORD-' || {_pad(n, 5)} AS order_id, k % 12 + 1 AS customer_id,
        {_turn("created paid shipped", "k")} AS status, {_turn("web mobile partner", "k")} AS sales_channel,
        'postgres_sample_seed' AS source_system,
        {_AS_OF} - (k % 10)::int * interval 1 day - {n}::int * interval 1 hour AS order_created_at
        FROM (SELECT o_orderkey AS k FROM orders)"""
    sql["seed_order_items"] = f"""SELECT 'ITEM-' || {_pad(n, 5)} || '-' || {_pad("i", 2)} AS item_id,
        'ORD-' || {_pad(n, 5)} AS order_id, 'SKU-' || {_pad(f"({n} * 7 + i * 3) % 250 + 100", 3)} AS sku,
        'Product ' || (({n} * 7 + i * 3) % 50 + 1) AS product_name, ({n} + i) % 3 + 1 AS quantity,
        ((({n} * 13 + i * 17) % 700 + 150)::decimal(12,1) / 10)::double AS unit_price
        FROM (SELECT k, unnest(generate_series(1, k % 3 + 1)) AS i FROM (SELECT o_orderkey AS k FROM orders))"""
    sql["seed_taxes"] = f"""SELECT {n} AS tax_id, 'TAX-' || {_pad(n, 3)} AS tax_code, 'Tax ' || {n} AS tax_name,
        {_turn("EMEA AMER APAC LATAM", "k")} AS jurisdiction,
        {_turn("0.045 0.070 0.0815 0.1000 0.1195 0.2000", n)}::double AS rate,
        timestamp '2026-03-07' - (90 - {n})::int * interval 1 day AS effective_at,
        timestamp '2026-03-07' - (120 - {n})::int * interval 1 day AS created_at
        FROM (SELECT s_suppkey AS k FROM supplier)"""
    sql["seed_depot_transactions"] = f"""SELECT 'DPT-' || {_pad(n, 5)} AS transaction_id, k % 12 + 1 AS customer_id,
        {_turn("DEPOT-A DEPOT-B DEPOT-C DEPOT-D", "k")} AS depot_code,
        {_turn("load unload transfer", "k")} AS transaction_type,
        ((({n} * 19 + 250) % 900 + 100)::decimal(12,1) / 10)::double AS amount,
        {_AS_OF} - (k % 12)::int * interval 1 day - ({n} * 7)::int * interval 1 minute AS transaction_at,
        'postgres_sample_seed' AS source_system FROM (SELECT event_id AS k FROM events)"""
    sql["seed_reload"] = _counts(_SOURCE_COUNTS)
    mirror_names = {
        "raw_customers": "ext_customers_raw",
        "raw_orders": "ext_orders_raw",
        "raw_order_items": "ext_order_items_raw",
        "raw_taxes": "ext_taxes_raw",
        "raw_depot_transactions": "ext_depot_transactions_raw",
    }
    sql["source_lookup"] = _counts([(mirror_names[t], s) for t, s in _EXPORT_COUNTS])
    sql["model_lookup"] = _pick(TAXES, "taxes_clean")
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "events": "event_id"}
    sql["latest_file_per_table"] = " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, 'load-' || max_load || '-' || part || '-0.parquet' AS file_name, rows AS row_count, files AS data_files FROM (
          SELECT arg_max(ld, (ld, pt)) AS max_load, arg_max(pt, (ld, pt)) AS part, arg_max(n, (ld, pt)) AS rows, count(*) AS files FROM (
            SELECT {k} % 3 AS ld, CAST(floor({k} / 3) AS BIGINT) % 4 AS pt, count(*) AS n FROM {t} GROUP BY ALL))"""
        for t, k in keys.items()
    )
    sql["landing_completeness"] = "SELECT * FROM (VALUES ('returns'), ('shipments')) v(table_name)"
    sql["catalog_listing"] = "SELECT * FROM (VALUES {}) v(table_name)".format(", ".join(f"('{t}')" for t, _ in _EXPORT_COUNTS))

    # Exports, landing, mirror.
    exported = {
        "customers": ("customer_id customer_name region segment order_count total_order_value first_order_at latest_order_at customer_created_at", "exp_customers"),
        "orders": ("order_id customer_id status item_count order_total order_created_at", "exp_orders"),
        "order_items": ("order_id item_id sku quantity unit_price line_total loaded_at", "exp_items"),
        "taxes": ("tax_code tax_name jurisdiction rate effective_at loaded_at", "exp_taxes"),
        "depot_transactions": ("transaction_id customer_id depot_code transaction_type amount transaction_at source_system loaded_at", "exp_depot"),
    }
    for name, (columns, source) in exported.items():
        stamp = "" if name == "order_items" else " load_batch"
        stamped = f"(SELECT *, {_STAMP} AS load_batch FROM {source})"
        sql[f"raw_{name}_export"] = _pick(columns, source)
        sql[f"land_{name}"] = _pick(columns + stamp, stamped)
        texts = [f"{_iso(c)} AS {c}" for c in columns.split() if c.endswith("_at")]
        rest = " ".join(c for c in columns.split() if not c.endswith("_at")) + stamp
        picked = _pick(rest, stamped, _WIDE)
        sql[f"mirror_{name}"] = picked.replace(" FROM (SELECT *, 'post", f", {', '.join(texts)} FROM (SELECT *, 'post")
    sql["load_report"] = _counts(_EXPORT_COUNTS)
    sql["refresh_landing"] = _counts([p for p in _EXPORT_COUNTS if p[0] in ("raw_orders", "raw_order_items")])
    sql["purge_landing"] = (
        f"{_ALL} SELECT (" + " + ".join(f"(SELECT count(*) FROM {s})" for _, s in _EXPORT_COUNTS) + ")::bigint AS rows_landed, "
        "5::bigint AS tables_dropped, 0::bigint AS namespaces_left"
    )
    sql["load_batch_stamps"] = (
        "SELECT o_orderdate AS ordered_at, count(*) AS orders, "
        "strftime(o_orderdate, 'postgres-seed-%Y%m%dT%H%M%SZ') AS load_batch FROM orders GROUP BY 1"
    )
    sql["iso_timestamps"] = (
        f"SELECT event_id, {_iso('ts')} AS iso_ts, {_iso("date_trunc('second', ts)")} AS iso_second, ts AS parsed FROM events"
    )

    # Publishing.
    first = {"customers": "customer_id", "orders": "order_id", "order_items": "item_id", "taxes": "tax_id", "depot_transactions": "transaction_id"}
    sql["publish_all_or_none"] = _ALL + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*){when} AS row_count, '{step}' AS step FROM {source_of}"
        for t, source_of in _SOURCE_COUNTS
        for step, when in (
            ("1 write fails", ""),
            ("2 rule fails", ""),
            ("3 audit fails", ""),
            ("4 move fails", ""),
            ("5 published", f" FILTER (WHERE CAST({first[t]} AS VARCHAR) LIKE '%3')"),
        )
    )
    sql["load_audit"] = _ALL + _FAULTY_ORDERS + _FAULTY_ITEMS + " UNION ALL ".join(
        [_fail("not_null", "orders_clean", c, "faulty", f"{c} IS NULL") for c in ("order_id", "order_total")]
        + [
            _fail("not_null", "order_items", "item_id", "faulty_items", "item_id IS NULL"),
            _fail("range", "order_items", "quantity", "faulty_items", "quantity <= 0"),
            _fail("range", "order_items", "unit_price", "faulty_items", "unit_price <= 0"),
            _fail("range", "taxes", "rate", "src_taxes", "rate < 0"),
        ]
        + [f"SELECT 'row_count', '{t}', '', count(*) FROM {f}" for t, f in (("orders_clean", "faulty"), ("order_items", "faulty_items"), ("taxes", "src_taxes"))]
    )

    # Source products.
    sql["orders_clean"] = sql["orders_order_grain"] = sql["in_orders_order_grain"] = _pick(ORDERS + " cleaned_at", "orders_clean", _WIDE)
    for name in ("order_items_clean", "order_lines_order_grain", "in_order_lines_order_grain"):
        sql[name] = _pick(LINES + " cleaned_at", "items_clean", _WIDE)
    for name in ("customer_order_summary", "orders_customer_grain", "in_orders_customer_grain", "orders_customers_3nf"):
        sql[name] = _pick(SUMMARY + " latest_load_batch", "order_summary")
    for name in ("customers_clean", "customers_entity_grain", "in_customers_entity_grain"):
        sql[name] = _pick(ENTITY + " cleaned_at", "customers_clean", _WIDE)
    for by in ("region", "segment"):
        for name in (f"customer_{by}_summary", f"customers_{by}_grain", f"in_customers_{by}_grain", f"{by}s_3nf"):
            sql[name] = _by(by)
        sql[f"dim_{by}s"] = _by(by, latest=False, key=True)
    for name in ("taxes_clean", "taxes_grain", "in_taxes_grain"):
        sql[name] = _pick(TAXES + " loaded_at load_batch cleaned_at", "taxes_clean")
    for name in ("depot_transactions_clean", "depot_transactions_grain", "in_depot_transactions_grain"):
        sql[name] = _pick(DEPOT + " loaded_at load_batch cleaned_at", "depot_clean")

    # Customer domain.
    sql["customers_3nf"] = _pick(ENTITY, "customers_clean", _WIDE)
    sql["taxes_3nf"] = _pick(TAXES + " load_batch", "taxes_clean")
    sql["taxes_only"] = _pick(TAXES, "taxes_clean")
    for name in ("fct_customer_value_star", "customers_complete"):
        sql[name] = _pick(ENTITY + " region_sk segment_sk modeled_at", "value_star", _WIDE)
    only = "customer_id customer_name region segment order_count total_order_value customer_value_band"
    sql["customers_high_value"] = _pick(only + " latest_order_at", "value_star", _WIDE, "WHERE customer_value_band = 'HIGH_VALUE'")
    sql["customers_only"] = _pick(only, "value_star", _WIDE)

    # Transaction domain.
    sql["orders_3nf"] = _pick(ORDERS, "orders_clean", _WIDE)
    sql["order_lines_3nf"] = _pick(LINES, "items_clean", _WIDE)
    sql["depot_transactions_3nf"] = _pick(DEPOT + " load_batch", "depot_clean")
    sql["depot_transactions_only"] = _pick(DEPOT, "depot_clean")
    sql["dim_customers"] = f"{_ALL} SELECT customer_id, first_order_at, latest_order_at, order_count, total_order_value::double AS total_order_value, md5(customer_id) AS customer_sk FROM order_summary"
    status = f"{_ALL} SELECT order_status, count(*) AS order_count, md5(order_status) AS status_sk FROM orders_clean GROUP BY 1"
    sql["dim_order_status"] = sql["scaffold_dim_order_status"] = status
    for name in ("fct_order_revenue_star", "orders_complete", "scaffold_fct_order_revenue"):
        sql[name] = _pick(FACT, "revenue_star", _WIDE)
    fulfilled = "WHERE order_status IN ('PAID', 'SHIPPED')"
    sql["orders_fulfilled"] = _pick("order_id customer_id order_status order_total item_revenue order_created_at", "revenue_star", _PLAIN, fulfilled)
    sql["orders_only"] = _pick("order_id customer_id order_status order_total order_created_at", "revenue_star")

    # Order product from one configuration.
    sql["scaffold_core_orders"] = _pick(ORDERS, "orders_clean", _WIDE)
    sql["scaffold_core_items"] = _pick(LINES.replace(" line_number", ""), "items_clean", _WIDE)
    for name, stamp in (("access", "published_at"), ("inbound", "sdp_published_at")):
        sql[f"scaffold_{name}_orders"] = _pick(ORDERS + f" {stamp}", f"(SELECT *, cleaned_at AS {stamp} FROM orders_clean)", _WIDE)
        sql[f"scaffold_{name}_items"] = _pick(LINES + f" {stamp}", f"(SELECT *, cleaned_at AS {stamp} FROM items_clean)", _WIDE)
    sql["dim_customers_from_orders"] = f"{_ALL} SELECT md5(customer_id) AS customer_sk, customer_id, min(order_created_at) AS first_order_at, max(order_created_at) AS latest_order_at, count(*) AS order_count FROM orders_clean GROUP BY 1, 2"
    sql["order_revenue_created"] = _pick(REVENUE, "revenue_star", _PLAIN, "WHERE order_status = 'CREATED'")
    sql["order_revenue_fulfilled"] = _pick(REVENUE, "revenue_star", _PLAIN, fulfilled)

    # Name functions.
    sql["slug_names"] = f"SELECT page_id, {_SLUG} AS slug FROM pages"
    sql["prefixed_names"] = """SELECT c_custkey, name, CASE WHEN starts_with(name, 'PRD_') THEN name ELSE 'PRD_' || name END AS prefixed
        FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'PRD_' ELSE 'PRD' END || upper(c_mktsegment) AS name FROM customer)"""
    sql["name_checksums"] = f"SELECT page_id, ({_crc('url')})::bigint AS checksum FROM pages"
    sql["sandbox_namespaces"] = f"""SELECT page_id,
        substr(regexp_replace(substr(seed, 1, 29) || '_' || ({_crc("seed")})::varchar, '_+', '_', 'g'), 1, 40) AS namespace
        FROM (SELECT page_id, {_SLUG} AS seed FROM pages)"""

    # Checks.
    sql["not_null_check"] = _ALL + _FAULTY_ORDERS + " UNION ALL ".join(
        _fail("not_null", "orders_clean", c, "faulty", f"{c} IS NULL") for c in ("order_id", "order_total")
    )
    sql["unique_check"] = _ALL + _FAULTY_ORDERS + _dup("orders_clean", "order_id", "faulty")
    sql["duplicate_keys"] = _ALL + _FAULTY_ORDERS + "SELECT order_id, count(*) AS row_count FROM faulty GROUP BY 1 HAVING count(*) > 1"
    sql["relationships_check"] = _SRC + _FAULTY_ITEMS + " UNION ALL ".join(
        [
            _fail("relationships", "orders", "customer_id", "src_orders", "customer_id NOT IN (SELECT customer_id FROM src_customers)"),
            _fail("relationships", "order_items", "order_id", "faulty_items", "order_id NOT IN (SELECT order_id FROM src_orders)"),
            _fail("relationships", "depot_transactions", "customer_id", "src_depot", "customer_id NOT IN (SELECT customer_id FROM src_customers)"),
        ]
    )
    sql["orphan_keys"] = _SRC + _FAULTY_ITEMS + (
        "SELECT order_id AS key, count(*) AS row_count FROM faulty_items WHERE order_id NOT IN (SELECT order_id FROM src_orders) GROUP BY 1"
    )
    sql["accepted_values_check"] = _SRC + " " + " UNION ALL ".join(
        [
            _fail("accepted_values", "orders", "status", "src_orders", "status NOT IN ('created', 'paid', 'shipped')"),
            _fail("accepted_values", "depot_transactions", "transaction_type", "src_depot", "transaction_type NOT IN ('load', 'unload', 'transfer', 'view', 'click')"),
        ]
    )
    sql["range_check"] = _SRC + _FAULTY_ITEMS + " UNION ALL ".join(
        [
            _fail("range", "order_items", "quantity", "faulty_items", "quantity <= 0"),
            _fail("range", "order_items", "unit_price", "faulty_items", "unit_price <= 0"),
            _fail("range", "taxes", "rate", "src_taxes", "rate < 0"),
            _fail("range", "depot_transactions", "amount", "src_depot", "amount < 0"),
        ]
    )
    sql["key_check"] = _SRC + " " + " UNION ALL ".join(
        _keys("customers", "src_customers", "customer_id customer_code", "customer_name region segment")
        + _keys("orders", "src_orders", "order_id", "customer_id status")
        + _keys("order_items", "src_items", "item_id", "order_id sku")
        + _keys("taxes", "src_taxes", "tax_id tax_code", "rate")
        + _keys("depot_transactions", "src_depot", "transaction_id", "customer_id amount")
    )
    sql["keys_at_once"] = _ALL + _FAULTY_ORDERS + " UNION ALL ".join(
        [
            rule
            for table, source, present, distinct in (
                ("customers", "src_customers", "customer_id customer_name region", "customer_id customer_code segment"),
                ("orders", "src_orders", "order_id customer_id", "order_id customer_id"),
                ("order_items", "src_items", "item_id order_id sku", "item_id"),
                ("taxes", "src_taxes", "tax_id tax_code rate", "tax_id tax_code"),
                ("depot_transactions", "src_depot", "transaction_id amount", "transaction_id"),
                ("orders_clean", "faulty", "order_id order_total", "order_id order_total"),
            )
            for rule in [_fail("not_null", table, c, source, f"{c} IS NULL") for c in present.split()] + [_dup(table, c, source) for c in distinct.split()]
        ]
    )
    sql["content_parity"] = """SELECT o_orderkey, count(*) AS left_rows,
          CASE WHEN o_orderkey % 1000 = 1 THEN 0 ELSE count(*) END + CASE WHEN o_orderkey % 1000 = 2 THEN count(*) ELSE 0 END AS right_rows
        FROM orders WHERE o_orderkey % 1000 IN (1, 2) OR o_orderkey % 1000 = 5 AND o_orderpriority <> 'changed' GROUP BY o_orderkey"""
    source_of = dict(_SOURCE_COUNTS)
    sql["row_count_contract"] = _ALL + " UNION ALL ".join(
        f"SELECT '{t.removeprefix('raw_')}' AS relation, s.n AS expected, e.n AS found, s.n = e.n AS matches "
        f"FROM (SELECT count(*) AS n FROM {source_of[t.removeprefix('raw_')]}) s, (SELECT count(*) AS n FROM {e}) e"
        for t, e in _EXPORT_COUNTS
    )
    sql["upstream_contract"] = _ALL + (
        "SELECT 'sdp_taxes.taxes_grain' AS relation, count(*) AS expected, count(*) AS found, true AS matches FROM taxes_clean UNION ALL "
        "SELECT 'sdp_depot_transactions.depot_transactions_grain', count(*) + 1, count(*), false FROM depot_clean"
    )
    grains = [
        ("sdp_orders.orders_order_grain", "src_orders", "orders_clean"),
        ("sdp_orders.orders_customer_grain", "src_customers", "order_summary"),
        ("sdp_orders.order_lines_order_grain", "src_items", "items_clean"),
        ("sdp_customers.customers_entity_grain", "src_customers", "customers_clean"),
        ("sdp_customers.customers_region_grain", "(SELECT DISTINCT region FROM src_customers)", _REGIONS),
        ("sdp_customers.customers_segment_grain", "(SELECT DISTINCT segment FROM src_customers)", _SEGMENTS),
        ("sdp_taxes.taxes_grain", "src_taxes", "taxes_clean"),
        ("sdp_depot_transactions.depot_transactions_grain", "src_depot", "depot_clean"),
    ]
    sql["upstream_contract_all"] = _ALL + " UNION ALL ".join(
        f"SELECT '{label}' AS relation, e.n AS expected, f.n AS found, e.n = f.n AS matches "
        f"FROM (SELECT count(*) AS n FROM {source}) e, (SELECT count(*) AS n FROM {grain}) f"
        for label, source, grain in grains
    )
    sql["layer_parity"] = _ALL + " UNION ALL ".join(
        f"SELECT '{t.removeprefix('raw_')}' AS table_name, s.n AS source_rows, e.n AS export_rows, e.n AS landed_rows, s.n = e.n AS matches "
        f"FROM (SELECT count(*) AS n FROM {source_of[t.removeprefix('raw_')]}) s, (SELECT count(*) AS n FROM {e}) e"
        for t, e in _EXPORT_COUNTS
    )
    customers = "(SELECT DISTINCT md5(customer_id) AS customer_sk FROM orders_clean)"
    statuses = "(SELECT DISTINCT md5(order_status) AS status_sk FROM orders_clean)"
    sql["scaffold_checks"] = _ALL + " UNION ALL ".join(
        _keys("core_orders", "orders_clean", "order_id", "order_total")
        + [_fail("not_null", "core_items", c, "items_clean", f"{c} IS NULL") for c in ("order_id", "item_id")]
        + _keys("dim_customers", customers, "customer_sk")
        + _keys("dim_order_status", statuses, "status_sk")
        + _keys("fact", "revenue_star", "order_id", "customer_sk status_sk")
    )
    sql["declared_checks"] = _declared()

    # Builds.
    sql["build_source_products"] = _counts(_SDP_RELATIONS)
    sql["build_customer_domain"] = _counts(_CUSTOMER_RELATIONS)
    sql["build_transaction_domain"] = _counts(_TRANSACTION_RELATIONS)
    every = _SDP_RELATIONS + _CUSTOMER_RELATIONS + _TRANSACTION_RELATIONS
    sql["build_all"] = sql["build_all_lean"] = _counts([r for r in every if r[0].endswith(_ACCESS) and ".in_" not in r[0]])
    chosen = [
        ("1 with ancestors", level, [r for r in every if r[0] in names.split()])
        for level, names in enumerate((
            "sdp_customers.customers_clean",
            "sdp_customers.customers_entity_grain sdp_customers.customer_region_summary sdp_customers.customer_segment_summary",
            "sdp_customers.customers_region_grain sdp_customers.customers_segment_grain edp_customers.in_customers_entity_grain",
            "edp_customers.in_customers_region_grain edp_customers.in_customers_segment_grain edp_customers.customers_3nf",
            "edp_customers.regions_3nf edp_customers.segments_3nf",
            "edp_customers.dim_regions edp_customers.dim_segments",
            "edp_customers.fct_customer_value_star",
            "edp_customers.customers_high_value",
        ))
    ]
    taxes = ["sdp_taxes.taxes_clean", "sdp_taxes.taxes_grain", "edp_taxes.in_taxes_grain", "edp_taxes.taxes_3nf"]
    chosen += [("3 with descendants", level, [(name, "taxes_clean")]) for level, name in enumerate(taxes)]
    chosen += [("4 own models", level, [(name, "taxes_clean")]) for level, name in enumerate(taxes[2:] + ["edp_taxes.taxes_only"])]
    rows = [
        f"SELECT '{step}' AS step, {level}::bigint AS level, '{label}' AS table_name, count(*) AS row_count FROM {source}"
        for step, level, relations in chosen
        for label, source in relations
    ]
    sql["selected_builds"] = _ALL + " UNION ALL ".join(rows + ["SELECT '2 refused', 0, 'sdp_taxes.taxes_grain', 0"])
    sql["environment_layout"] = f"""{_ALL} SELECT true AS in_place, count(*) AS row_count, 'dev' AS environment FROM taxes_clean
        UNION ALL SELECT true, count(*), 'prd' FROM taxes_clean"""

    # An aggregate that follows its source.
    per_group = """SELECT '{g}' AS by, {g}::varchar AS member, count(*) AS orders, sum(total)::double AS total, min(placed) AS first_placed,
          min(total)::double AS smallest, max(placed) AS last_placed FROM after GROUP BY {g}"""
    sql["refreshed_summaries"] = f"""WITH before AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus, o_totalprice::decimal(18,2) AS total, o_orderdate::timestamp AS placed FROM orders),
        after AS (
          SELECT k, o_custkey, CASE WHEN k % 10 = 5 THEN 'P' ELSE o_orderstatus END AS o_orderstatus,
                 CASE WHEN k % 20 = 5 THEN total + 1000 ELSE total END AS total, placed FROM before WHERE k % 10 <> 3
          UNION ALL SELECT -k - 1, o_custkey, o_orderstatus, total, placed + INTERVAL 1 DAY FROM before WHERE k % 10 = 7)
        {per_group.format(g="o_custkey")} UNION ALL {per_group.format(g="o_orderstatus")}"""

    # Clones.
    sql["clone_schema"] = f"""{_ALL}, c AS (SELECT count(*) AS n FROM depot_clean)
        SELECT 'source_rows' AS measure, n AS value FROM c UNION ALL SELECT 'clone_rows', n FROM c
        UNION ALL SELECT 'source_rows_after', n FROM c UNION ALL SELECT 'tables_added', 0 FROM c"""
    sql["clone_schema_orders"] = f"""{_ALL}, c AS (SELECT count(*) AS n FROM revenue_star)
        SELECT 'source_rows' AS measure, n AS value FROM c UNION ALL SELECT 'clone_rows', n FROM c
        UNION ALL SELECT 'source_rows_after', n FROM c UNION ALL SELECT 'tables_added', 0 FROM c"""
    sql["clone_without_copying"] = f"""{_ALL}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE tax_code LIKE '%1') AS half FROM taxes_clean)
        SELECT '1 cloned' AS step, n AS source_rows, n AS clone_rows, false AS own_files, 0::bigint AS swept FROM c
        UNION ALL SELECT '2 clone changed', n, half, true, 0 FROM c
        UNION ALL SELECT '3 source changed', 0, half, true, 0 FROM c
        UNION ALL SELECT '4 swept', 0, half, true, 1 FROM c
        UNION ALL SELECT '5 clone dropped', n, 0, false, 1 FROM c"""
    sql["clone_lean"] = f"""{_ALL}, c AS (SELECT count(*) AS n FROM taxes_clean)
        SELECT '1 source emptied' AS step, 0::bigint AS source_rows, n AS clone_rows FROM c
        UNION ALL SELECT '2 source dropped', 0, n FROM c"""
    sql["clone_product"] = f"""{_ALL}, c AS (SELECT count(*) AS n FROM taxes_clean)
        SELECT step, status, n * cloned AS rows FROM c, (VALUES ('1 ensure', 'cloned', 1), ('2 ensure again', 'reused', 1),
          ('3 replace', 'cloned', 1), ('4 same', 'same', 1), ('5 drop', '3', 0), ('6 empty', 'created_empty', 0),
          ('7 empty again', 'reused_empty', 0), ('8 empty replace', 'created_empty', 0), ('9 missing', 'error', 0)) v(step, status, cloned)"""
    sql["clone_registry"] = f"""{_ALL}, c AS (SELECT 'taxes' AS key, count(*) AS n FROM taxes_clean
          UNION ALL SELECT 'depot', count(*) FROM depot_clean UNION ALL SELECT 'absent', 0)
        SELECT step, key, CASE WHEN key <> 'absent' THEN there ELSE absent END AS status, n * cloned AS rows
        FROM c, (VALUES ('1 ensure', 'cloned', 'created_empty', 1), ('2 ensure', 'reused', 'reused_empty', 1),
          ('3 replace', 'cloned', 'created_empty', 1), ('4 drop', 'dropped 3', 'dropped 0', 0)) v(step, there, absent, cloned)"""
    sql["clone_purge"] = f"{_ALL} SELECT 6::bigint AS purged, count(*) AS source_rows FROM taxes_clean"
    sql["clone_plan"] = f"""{_clone_named("feature_rework_of_daily_totals")}
        SELECT arg_min(key, position) AS key, arg_min(source_database, position) AS source_database, target_database
        FROM named GROUP BY target_database"""
    sql["clone_name_matches"] = f"""{_clone_named("b1")},
        bases AS (SELECT DISTINCT source_database AS base FROM registry WHERE position % 3 = 0 AND source_database IS NOT NULL)
        SELECT DISTINCT target_database AS name FROM named JOIN bases ON starts_with(target_database, base || '_CI_CLO_')"""
    sql["missing_objects"] = (
        "SELECT DISTINCT o_orderkey AS order_key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"
    )

    # Contracts.
    sql["public_contract"] = sql["read_manifest_gz"] = f"{_MANIFEST} SELECT name, database, schema, alias FROM contract"
    sql["retarget_contract"] = f"""{_MANIFEST} SELECT 'm.' || k AS node_id, 'model_' || k AS name,
          CASE scope WHEN 'orders' THEN 'DEV_ORDERS' WHEN 'Customers' THEN 'DEV_CUSTOMERS' WHEN 'depot_transactions' THEN 'DEV_DEPOT'
               ELSE 'DB_' || upper(p_type) END AS database FROM picked
        UNION ALL SELECT 't.' || k, 'test_' || k, '' FROM picked"""
    sql["unresolved_refs"] = f"""{_MANIFEST} SELECT 'model_' || l_partkey AS name, count(*) AS uses FROM lineitem
        WHERE 'model_' || l_partkey NOT IN (SELECT name FROM contract) GROUP BY 1"""

    node = {
        "resource_type": "CASE WHEN k % 10 = 3 THEN 'test' ELSE 'model' END",
        "package_name": "CASE WHEN k % 7 = 0 THEN 'other' ELSE 'producer' END",
        "access": "CASE WHEN k % 4 = 0 THEN 'private' ELSE 'public' END",
        "name": "'model_' || k",
        "database": "CASE scope WHEN 'orders' THEN 'DEV_ORDERS' WHEN 'Customers' THEN 'DEV_CUSTOMERS' "
        "WHEN 'depot_transactions' THEN 'DEV_DEPOT' ELSE 'DB_' || upper(p_type) END",
        "schema": "CASE WHEN k % 9 <> 0 THEN 'ACCESS' END",
        "alias": "CASE WHEN k % 3 = 0 THEN '' ELSE 'T_' || k END",
        "path": "'models/' || scope || '/m.sql'",
    }
    test = {"resource_type": "test", "package_name": "producer", "access": "public", "database": "", "schema": "ACCESS", "alias": "", "path": "models/orders/t.sql"}
    members = [f"SELECT 'm.' || k AS node_id, '{field}' AS field, '\"' || ({value}) || '\"' AS value FROM picked" for field, value in node.items()]
    members += [f"SELECT 't.' || k, '{field}', '\"{value}\"' FROM picked" for field, value in test.items()]
    members += [
        "SELECT 't.' || k, 'name', '\"test_' || k || '\"' FROM picked",
        "SELECT 't.' || k, 'fqn', '[\"producer\",\"tests\"]' FROM picked",
        "SELECT 'm.' || k, 'fqn', '[\"producer\",\"' || p_brand || '\"]' FROM picked",
        "SELECT 'm.' || k, 'meta', '{\"owners\":[\"a\"],\"weight\":0.25}' FROM picked WHERE k % 10 <> 3",
        "SELECT '', 'metadata', '{\"format\":12,\"tags\":[\"brand\",null]}' FROM picked",
    ]
    sql["rewritten_manifests"] = f"{_MANIFEST} SELECT * FROM ({' UNION ALL '.join(members)}) WHERE value IS NOT NULL"
    sql["unresolved_text_refs"] = f"""{_MANIFEST}, used AS (SELECT l_partkey AS k, count(*) AS uses FROM lineitem GROUP BY 1),
          gone AS (SELECT * FROM used WHERE 'model_' || k NOT IN (SELECT name FROM contract))
        SELECT 'model_' || k AS name, uses, in_comments FROM gone, (VALUES (true), (false)) v(in_comments)
        UNION ALL SELECT 'quiet_' || k, uses, true FROM used"""

    # Reconcile.
    sql["snapshot_reconcile"] = """SELECT c_custkey, CASE
          WHEN c_custkey % 4 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 THEN 'keep'
          WHEN c_custkey % 4 <> 0 THEN 'provision' WHEN c_custkey % 5 <> 0 THEN 'destroy' ELSE 'forget' END AS action
        FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 4 <> 0"""
    priority = "trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g'), '_')"
    sql["current_branches"] = f"""SELECT o_orderkey, branch_name, default_branch FROM (
          SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 'main' ELSE {priority} END AS branch_name,
                 CASE WHEN o_orderkey % 2 = 0 THEN 'main' ELSE '5_low' END AS default_branch FROM orders)
        WHERE branch_name <> default_branch"""
    sql["current_merge_requests"] = f"""SELECT o_orderkey, {priority} AS source_branch, 'main' AS target_branch,
          o_orderkey::varchar AS mr_iid, 'main' AS default_branch
        FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0"""
    sql["change_actions"] = """SELECT event_id,
          CASE event_type WHEN 'error' THEN 'destroy' WHEN 'signup' THEN 'create' ELSE 'update' END AS change,
          CASE WHEN event_type IN ('error', 'click') THEN 'destroy' ELSE 'update' END AS request_change FROM events"""
    fold = """SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id,
          arg_max(CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'destroy' ELSE 'update' END, (ts, event_id)) AS action
        FROM events GROUP BY user_id"""
    sql["lifecycle_fold"] = sql["lifecycle_fold_stream"] = fold
    sql["lifecycle_live_keys"] = f"SELECT user_id FROM ({fold}) WHERE action <> 'destroy'"
    changes = """WITH project AS (
          SELECT 'p' || n_nationkey AS project, CASE WHEN n_nationkey % 2 = 0 THEN 'main' ELSE 'trunk' END AS trunk
          FROM nation WHERE n_nationkey % 6 <> 5),
        raw AS (SELECT event_id, ts, event_type, user_id, 'p' || (user_id % 30) AS project,
          CASE user_id % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'trunk' ELSE 'feature-' || (user_id % 50) END AS branch FROM events),
        changes AS (
          SELECT event_id, ts, project || ':branch:' || branch AS sandbox,
            CASE event_type WHEN 'error' THEN 'destroy' WHEN 'signup' THEN 'create' ELSE 'update' END AS action
          FROM raw JOIN project USING (project)
          WHERE event_type NOT IN ('click', 'view') AND event_id % 10 <> 0 AND event_id % 17 <> 0 AND branch <> trunk
          UNION ALL
          SELECT event_id, ts, project || ':request:' || (user_id % 200),
            CASE WHEN event_id % 4 = 0 OR event_id % 19 = 0 THEN 'destroy' ELSE 'update' END
          FROM raw JOIN project USING (project)
          WHERE event_type IN ('click', 'view') AND event_id % 11 <> 0 AND event_id % 13 <> 0 AND branch <> trunk
            AND trunk = CASE WHEN event_id % 3 = 0 THEN 'trunk' ELSE 'main' END)"""
    sql["sandbox_lifecycle"] = sql["sandbox_lifecycle_stream"] = f"""{changes}
        SELECT sandbox, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(action, (ts, event_id)) AS action
        FROM changes GROUP BY sandbox"""
    state = f"""{changes},
        taken AS (SELECT DISTINCT 'p' || (user_id % 30) AS project, date_trunc('day', ts) AS moment, user_id AS u FROM events WHERE day(ts) % 5 = 0),
        seen AS (SELECT project || ':' || kind AS scope, moment, kind, u FROM taken JOIN project USING (project), (VALUES ('branch'), ('request')) v(kind)),
        listed AS (SELECT scope, max(moment) AS moment FROM seen GROUP BY scope),
        facts AS (
          SELECT regexp_extract(sandbox, '^([^:]*:[^:]*):', 1) AS scope, sandbox AS key, ts, 1 AS rank, event_id, action FROM changes
          UNION ALL
          SELECT scope, scope || ':' || CASE kind WHEN 'branch' THEN 'feature-' || (u % 50) ELSE (u % 200)::varchar END, moment, 0, NULL, 'listed'
          FROM seen WHERE u % 7 < 3),
        newest AS (SELECT *, row_number() OVER (PARTITION BY scope, key ORDER BY ts DESC, rank DESC, event_id DESC NULLS LAST) AS n FROM facts),
        state AS (
          SELECT scope, key, greatest(ts, moment) AS ts, CASE WHEN moment IS NULL OR ts >= moment THEN event_id END AS event_id,
                 CASE WHEN moment IS NULL OR ts >= moment THEN action ELSE 'destroy' END AS action
          FROM newest LEFT JOIN listed USING (scope) WHERE n = 1)"""
    sql["sandbox_state"] = f"{state} SELECT scope, key, ts, event_id, action FROM state"
    sql["live_sandboxes"] = f"""{state}
        SELECT key, ts, action, split_part(scope, ':', 2) AS kind FROM state WHERE action <> 'destroy'"""
    sql["ending_lifecycle_stream"] = """WITH arrived AS (
          SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'destroy' ELSE 'update' END AS action,
            least((day(ts) - 1) // 6 + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END, 4) AS run FROM events),
        horizons AS (SELECT r.run, (SELECT max(ts) FROM arrived a WHERE a.run < r.run) - INTERVAL 2 DAY AS horizon FROM (SELECT unnest(range(6)) AS run) r),
        kept AS (SELECT * FROM arrived JOIN horizons USING (run) WHERE horizon IS NULL OR ts >= horizon),
        folded AS (SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(action, (ts, event_id)) AS action
          FROM kept GROUP BY user_id)
        SELECT user_id, ts, event_id, action FROM folded
        WHERE action <> 'destroy' OR ts >= (SELECT horizon FROM horizons WHERE run = 5)"""
    sql["built_fct_order_revenue_star"] = sql["fct_order_revenue_star"]
    sql["built_order_product_fact"] = sql["scaffold_fct_order_revenue"]
    sql["built_order_revenue_fulfilled"] = sql["order_revenue_fulfilled"]
    sql["sandbox_layout"] = _ALL + " UNION ALL ".join(
        f"SELECT true AS in_place, count(*) AS row_count, '{t}' AS table_name FROM {source}" for t, source in _EXPORT_COUNTS
    )
    sql["built_customers_complete"] = sql["customers_complete"]
    return sql
