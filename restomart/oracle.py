"""Check SQL for the registered queries: the same tables and questions in plain SQL."""

from __future__ import annotations

# Silver tables as common table expressions over the star-schema views.
SILVER = """
facts AS (
  SELECT o_orderkey AS id, o_custkey, o_orderpriority, o_orderstatus,
         CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents,
         o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS created_at
  FROM orders),
facts2 AS (
  SELECT *, CASE WHEN id % 7 <> 0 THEN total_cents * 8 // 100 END AS tax_cents,
         CASE WHEN id % 5 <> 0 THEN total_cents % 1000 END AS tip_cents
  FROM facts),
s_orders AS (
  SELECT id, ['toast', 'doordash', 'square'][1 + id % 3] AS source,
         CAST(id AS VARCHAR) AS source_order_id,
         CASE WHEN id % 97 <> 0 THEN c_nationkey END AS location_id,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'delivery' WHEN '2-HIGH' THEN 'pickup'
              WHEN '4-NOT SPECIFIED' THEN 'takeout' ELSE 'dine_in' END AS order_type,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'delivery_app' WHEN 'BUILDING' THEN 'online'
              WHEN 'FURNITURE' THEN 'third_party' ELSE 'pos' END AS channel,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'delivered'
              WHEN 'P' THEN 'cancelled' END AS status,
         created_at, created_at + INTERVAL 45 MINUTE AS closed_at,
         total_cents - coalesce(tax_cents, 0) - coalesce(tip_cents, 0) AS subtotal_cents,
         tax_cents, tip_cents, total_cents,
         CASE WHEN id % 3 = 1 THEN total_cents % 700 END AS delivery_fee_cents,
         CASE WHEN id % 3 = 1 THEN total_cents % 500 END AS service_fee_cents,
         CASE WHEN id % 3 = 1 THEN total_cents * 15 // 100 END AS commission_cents,
         CASE WHEN id % 3 = 1 THEN id % 4 = 0 END AS contains_alcohol,
         CASE WHEN id % 3 = 1 THEN id % 8 = 0 END AS is_catering
  FROM facts2 JOIN customer ON o_custkey = c_custkey),
s_locations AS (SELECT n_nationkey AS id, n_name AS name, 'America/New_York' AS timezone FROM nation),
s_categories AS (SELECT DISTINCT p_type AS id, p_type AS name FROM part),
s_products AS (
  SELECT p_partkey AS id, p_name AS name, p_brand AS description,
         CASE WHEN p_partkey % 50 <> 7 THEN p_type END AS category_id FROM part),
s_variations AS (
  SELECT p_partkey AS id, p_partkey AS product_id, p_size || ' pcs' AS name,
         'quantity' AS variation_type FROM part),
s_aliases AS (
  SELECT p_partkey AS id, p_partkey AS product_id, p_brand || ' ' || p_name AS raw_name,
         'square' AS source FROM part),
s_items0 AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id,
         l_orderkey AS order_id,
         CASE WHEN NOT (l_linenumber = 7 AND l_partkey % 11 = 0) THEN l_partkey END AS product_id,
         CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS variation_id,
         'item ' || l_partkey AS original_name,
         CAST(l_quantity AS INTEGER) AS quantity,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS total_price_cents,
         CAST(round(l_tax * 100) AS BIGINT) AS tax_percent,
         CASE WHEN l_returnflag = 'R' THEN 'no onions' END AS special_instructions
  FROM lineitem),
s_items AS (
  SELECT *, CAST(floor(CAST(total_price_cents AS DOUBLE) / quantity + 0.5) AS BIGINT)
              AS unit_price_cents,
         total_price_cents * tax_percent // 100 AS tax_cents
  FROM s_items0),
s_payments AS (
  SELECT 'p' || id AS id, id AS order_id, 'src' || id AS source_payment_id,
         ['credit', 'cash', 'wallet', 'platform', 'other'][1 + o_custkey % 5] AS payment_type,
         CASE WHEN o_custkey % 5 = 0 THEN
              ['visa', 'mastercard', 'amex', NULL][1 + o_custkey % 4] END AS card_brand,
         CASE WHEN o_custkey % 5 = 0 THEN lpad(CAST(id % 10000 AS VARCHAR), 4, '0') END AS last_four,
         total_cents AS amount_cents, tip_cents,
         CASE WHEN o_custkey % 2 = 0 THEN total_cents * 3 // 100 END AS processing_fee_cents,
         created_at + INTERVAL 1 HOUR AS created_at
  FROM facts2 WHERE id % 10 <> 0),
done AS (SELECT o.*, l.name AS location_name, l.timezone, l.id AS place,
                CAST(o.created_at AS DATE) AS order_date
         FROM s_orders o LEFT JOIN s_locations l ON l.id = o.location_id
         WHERE o.status IN ('completed', 'delivered', 'picked_up')),
sold AS (SELECT i.*, p.name AS product_name, c.name AS category_name, d.created_at, d.order_date,
                d.source, d.channel, d.order_type, d.location_name
         FROM s_items i JOIN done d ON d.id = i.order_id
         LEFT JOIN s_products p ON p.id = i.product_id
         LEFT JOIN s_categories c ON c.id = p.category_id)
"""


def over_silver(select: str, extra: str = "") -> str:
    return "WITH " + SILVER.strip() + (", " + extra.strip() if extra else "") + "\n" + select.strip()


def usd(cents: str) -> str:
    return f"CAST(CAST({cents} AS DECIMAL(38, 0)) / 100 AS DOUBLE)"


def total(cents: str, name: str, where: str | None = None, zero: bool = False) -> str:
    """Dollar total, optionally of some rows only; ``zero`` when none match."""
    body = f"sum({cents})" + (f" FILTER (WHERE {where})" if where else "")
    if zero:
        body = f"coalesce({body}, 0)"
    return f"CAST({body} AS DOUBLE) / 100 AS {name}"


def mean(cents: str, name: str) -> str:
    return f"(CAST(sum({cents}) AS DOUBLE) / 100) / count({cents}) AS {name}"


def orders_where(cond: str, name: str, key: str = "id") -> str:
    return f"count(DISTINCT {key}) FILTER (WHERE {cond}) AS {name}"


def units_where(cond: str, name: str) -> str:
    return f"CAST(coalesce(sum(quantity) FILTER (WHERE {cond}), 0) AS BIGINT) AS {name}"


KINDS = {"dine_in": "order_type = 'dine_in'", "delivery": "order_type = 'delivery'",
         "takeout": "order_type IN ('takeout', 'pickup')"}
ORIGINS = {k: f"source = '{k}'" for k in ("toast", "doordash", "square")}
UNITS = ", ".join(units_where(c, f"{k}_units") for k, c in KINDS.items())
DAY_NAME = "rpad(dayname({0}), 9, ' ')"

GOLD = {
    "gold_orders": f"""
SELECT id AS order_id, source, source_order_id, channel, order_type, status, created_at, closed_at,
  order_date, hour(created_at) AS order_hour, dayofweek(created_at) AS day_of_week,
  {DAY_NAME.format('created_at')} AS day_name, place AS location_id, location_name, timezone,
  CAST(subtotal_cents AS DOUBLE) / 100 AS subtotal, CAST(tax_cents AS DOUBLE) / 100 AS tax,
  CAST(tip_cents AS DOUBLE) / 100 AS tip, CAST(total_cents AS DOUBLE) / 100 AS total,
  CAST(coalesce(delivery_fee_cents, 0) AS DOUBLE) / 100 AS delivery_fee,
  CAST(coalesce(service_fee_cents, 0) AS DOUBLE) / 100 AS service_fee,
  CAST(coalesce(commission_cents, 0) AS DOUBLE) / 100 AS commission,
  CAST(total_cents - coalesce(tax_cents, 0) - coalesce(tip_cents, 0) AS DOUBLE) / 100 AS pretax_total,
  contains_alcohol, is_catering
FROM done""",
    "gold_order_items": """
SELECT s.id AS order_item_id, order_id, original_name AS raw_item_name,
  p.id AS product_id, product_name, category_name, v.id AS variation_id, v.name AS variation_name,
  v.variation_type, quantity, CAST(unit_price_cents AS DOUBLE) / 100 AS unit_price,
  CAST(total_price_cents AS DOUBLE) / 100 AS total_price, CAST(tax_cents AS DOUBLE) / 100 AS item_tax,
  CAST(NULL AS VARCHAR) AS modifiers,
  special_instructions, created_at AS order_created_at, order_date, hour(created_at) AS order_hour,
  source, channel, order_type, location_name
FROM sold s LEFT JOIN s_products p ON p.id = s.product_id
LEFT JOIN s_variations v ON v.id = s.variation_id""",
    "gold_daily_sales": f"""
SELECT location_name, order_date, count(DISTINCT id) AS order_count, {total('total_cents', 'revenue')},
  {mean('total_cents', 'avg_order_value')},
  {', '.join(orders_where(c, k + '_orders') for k, c in KINDS.items())},
  {', '.join(total('total_cents', k + '_revenue', c, True) for k, c in KINDS.items())},
  {', '.join(orders_where(c, k + '_orders') for k, c in ORIGINS.items())},
  {', '.join(total('total_cents', k + '_revenue', c, True) for k, c in ORIGINS.items())},
  {total('tip_cents', 'total_tips')}, {total('coalesce(delivery_fee_cents, 0)', 'total_delivery_fees')},
  {total('coalesce(commission_cents, 0)', 'total_commission')}, {total('tax_cents', 'total_tax')}
FROM done GROUP BY ALL""",
    "gold_product_performance": f"""
SELECT product_name, category_name, count(DISTINCT order_id) AS orders_containing,
  CAST(sum(quantity) AS BIGINT) AS total_units_sold, {total('total_price_cents', 'total_revenue')},
  {mean('unit_price_cents', 'avg_unit_price')}, count(DISTINCT location_name) AS locations_sold_at,
  {UNITS}, min(created_at) AS first_sale, max(created_at) AS last_sale
FROM sold WHERE product_name IS NOT NULL GROUP BY ALL""",
    "gold_hourly_trends": f"""
SELECT location_name, order_date, hour(created_at) AS order_hour,
  dayofweek(created_at) AS day_of_week, {DAY_NAME.format('created_at')} AS day_name,
  count(DISTINCT id) AS orders, {total('total_cents', 'revenue')},
  {mean('total_cents', 'avg_order_value')}, {total('tip_cents', 'tips')},
  {', '.join(orders_where(f"channel = '{c}'", c + '_orders') for c in ('pos', 'online', 'delivery_app'))}
FROM done GROUP BY ALL""",
    "gold_category_performance": f"""
SELECT category_name, location_name, count(DISTINCT product_name) AS products_in_category,
  count(DISTINCT order_id) AS orders_containing, CAST(sum(quantity) AS BIGINT) AS total_units_sold,
  {total('total_price_cents', 'total_revenue')}, {mean('unit_price_cents', 'avg_item_price')},
  {', '.join(total('total_price_cents', k + '_revenue', c, True) for k, c in ORIGINS.items())}
FROM sold WHERE category_name IS NOT NULL GROUP BY ALL""",
    "gold_product_by_location": f"""
SELECT product_name, category_name, location_name, count(DISTINCT order_id) AS orders_containing,
  CAST(sum(quantity) AS BIGINT) AS total_units_sold, {total('total_price_cents', 'total_revenue')},
  {mean('unit_price_cents', 'avg_unit_price')}, {UNITS}
FROM sold WHERE product_name IS NOT NULL GROUP BY ALL""",
    "gold_payments": f"""
SELECT payment_type, card_brand, l.name AS location_name, CAST(p.created_at AS DATE) AS payment_date,
  count(*) AS payment_count, {total('amount_cents', 'total_amount')},
  {total('p.tip_cents', 'total_tips')}, {mean('amount_cents', 'avg_payment_amount')},
  {total('processing_fee_cents', 'total_processing_fees')}
FROM s_payments p JOIN s_orders o ON o.id = p.order_id JOIN s_locations l ON l.id = o.location_id
WHERE o.status <> 'cancelled' GROUP BY ALL""",
}

REVENUE = total("total_cents", "revenue")
ITEM_REVENUE = total("total_price_cents", "revenue")
UNITS_SOLD = "CAST(sum(quantity) AS BIGINT)"
SPAN = ("span AS (SELECT CAST(min(created_at) AS DATE) AS lo, CAST(max(created_at) AS DATE) AS hi "
        "FROM s_orders)")


def _period(bounds: str) -> str:
    return over_silver(f"SELECT order_date, {REVENUE} FROM done, span "
                       f"WHERE order_date BETWEEN {bounds} GROUP BY order_date", SPAN)


RECIPES = {
    "r01_sales_by_location": f"SELECT location_name, {REVENUE} FROM done GROUP BY 1",
    "r02_revenue_on_date": f"""SELECT order_date, {REVENUE} FROM done
        WHERE order_date = DATE '1998-03-02' GROUP BY 1""",
    "r03_top_items": f"""SELECT product_name, {UNITS_SOLD} AS units, {ITEM_REVENUE} FROM sold
        WHERE product_name IS NOT NULL GROUP BY 1 ORDER BY units DESC, product_name LIMIT 10""",
    "r03_top_products": f"""SELECT product_name, category_name, {total('total_price_cents', 'total_revenue')}
        FROM sold WHERE product_name IS NOT NULL GROUP BY ALL
        ORDER BY sum(total_price_cents) DESC, product_name, category_name LIMIT 5""",
    "r04_compare_locations": f"""SELECT location_name, count(*) AS order_count, {REVENUE},
        {mean('total_cents', 'avg_order_value')} FROM done
        WHERE location_name ILIKE '%nation_3%' OR location_name ILIKE '%nation_14%' GROUP BY 1""",
    "r05_location_ranking": f"SELECT location_name, {REVENUE} FROM done GROUP BY 1",
    "r06_hourly_sales": f"SELECT hour(created_at) AS order_hour, {REVENUE} FROM done GROUP BY 1",
    "r06_hourly_sales_on_day": f"""SELECT hour(created_at) AS order_hour, {REVENUE} FROM done
        WHERE order_date = DATE '1998-03-02' GROUP BY 1""",
    "r08_top_items_at_location": f"""SELECT product_name, category_name, location_name,
        {UNITS_SOLD} AS total_units_sold, {total('total_price_cents', 'total_revenue')} FROM sold
        WHERE product_name IS NOT NULL AND location_name ILIKE '%nation_7%' GROUP BY ALL
        ORDER BY total_units_sold DESC, product_name, category_name, location_name LIMIT 10""",
    "r09_beverage_sales": f"""SELECT location_name, {ITEM_REVENUE} FROM sold
        WHERE regexp_matches(category_name, 'promo|economy', 'i') GROUP BY 1""",
    "r10_category_ranking": f"""SELECT category_name, {ITEM_REVENUE} FROM sold
        WHERE category_name IS NOT NULL GROUP BY 1""",
    "r11_delivery_vs_dine_in": f"""SELECT order_type, count(*) AS order_count, {REVENUE} FROM done
        WHERE order_type IN ('delivery', 'dine_in') GROUP BY 1""",
    "r12_source_revenue": f"""SELECT source, {REVENUE} FROM done WHERE source = 'doordash'
        GROUP BY 1""",
    "r12_source_mix": f"""SELECT source, {REVENUE}, CAST(sum(total_cents) AS DOUBLE)
        / CAST(sum(sum(total_cents)) OVER () AS DOUBLE) AS share FROM done GROUP BY 1""",
    "r13_takeout_by_location": f"""SELECT location_name,
        count(*) FILTER (WHERE {KINDS['takeout']}) AS takeout_orders FROM done GROUP BY 1""",
    "r14_peak_hours": f"""SELECT location_name, hour(created_at) AS order_hour, count(*) AS orders,
        {REVENUE}, row_number() OVER (PARTITION BY location_name
          ORDER BY count(*) DESC, hour(created_at)) AS peak_rank
        FROM done GROUP BY location_name, hour(created_at) QUALIFY peak_rank = 1""",
    "r15_order_value_by_channel": f"""SELECT channel, count(*) AS order_count,
        {mean('total_cents', 'avg_order_value')} FROM done GROUP BY 1""",
    "r16_delivery_trend": """SELECT order_date, count(*) FILTER (WHERE order_type = 'delivery')
        AS delivery_orders FROM done GROUP BY 1""",
    "r17_payment_methods": """SELECT payment_type, count(*) AS payment_count
        FROM s_payments p JOIN done d ON d.id = p.order_id WHERE place IS NOT NULL GROUP BY 1""",
    "r17_card_brands": """SELECT card_brand, count(*) AS payment_count
        FROM s_payments p JOIN done d ON d.id = p.order_id
        WHERE place IS NOT NULL AND card_brand IS NOT NULL GROUP BY 1""",
    "r18_payment_type_by_source": "SELECT source, " + ", ".join(
        f"count(*) FILTER (WHERE payment_type = '{t}') AS {t}"
        for t in ("credit", "cash", "wallet", "platform", "other"))
        + " FROM s_payments p JOIN s_orders o ON o.id = p.order_id GROUP BY 1",
    "r19_hourly_by_weekday": "SELECT hour(created_at) AS order_hour, " + ", ".join(
        total("total_cents", f"{d}_sales", f"dayofweek(created_at) = {n}", True)
        for d, n in (("friday", 5), ("saturday", 6))) + " FROM done GROUP BY 1",
    "r20_orders_by_location_over_time": "SELECT order_date, " + ", ".join(
        f"count(*) FILTER (WHERE location_name = 'NATION_{i}') AS NATION_{i}" for i in range(25))
        + " FROM done GROUP BY 1",
    "r21_category_by_source": "SELECT category_name, " + ", ".join(
        total("total_price_cents", k, c, True) for k, c in ORIGINS.items())
        + " FROM sold WHERE category_name IS NOT NULL GROUP BY 1",
    "r22_hourly_orders": "SELECT hour(created_at) AS order_hour, count(*) AS orders FROM done GROUP BY 1",
}

PERIOD_SQL = {
    "r02_revenue_yesterday": _period("hi - 1 AND hi - 1"),
    "r02_revenue_last_week": _period("hi - 6 AND hi"),
    "r02_revenue_this_month": _period("date_trunc('month', hi) AND hi"),
    "r02_revenue_first_month": _period("date_trunc('month', lo) AND last_day(lo)"),
    "r07_first_week_revenue": _period("lo AND lo + 6"),
}



# Source documents as relations --------------------------------------------------------------

def digest(*parts: str) -> str:
    return "sha256(concat_ws('|', " + ", ".join(parts) + "))"


DOCS = """
doc AS (SELECT o_orderkey AS k, o_custkey AS customer, o_orderpriority AS priority,
               o_orderstatus AS flag, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
               o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS opened,
               o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + INTERVAL 45 MINUTE AS closed
        FROM orders),
tdoc AS (SELECT *, customer % 27 AS place, sha256('order|toast|g' || k) AS oid FROM doc
         WHERE k % 13 <> 0 AND k % 17 <> 0),
tcheck AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c) - 1 AS check_no FROM (
             SELECT *, unnest(range(1, 2 + k % 3)) AS c FROM tdoc)
           WHERE (k + c) % 11 <> 0 AND (k + c) % 19 <> 0),
tline AS (SELECT *, s - 1 AS line_no FROM (
            SELECT *, unnest(range(1, 2 + (k + c) % 3)) AS s FROM tcheck)
          WHERE (k + c + s) % 7 <> 0),
tpay AS (SELECT *, p - 1 AS payment_no FROM (SELECT *, unnest(range(1, 2 + k % 2)) AS p FROM tcheck)
         WHERE (k + p) % 9 <> 0),
tkept AS (SELECT DISTINCT k FROM tline WHERE place < 25),
ddoc AS (SELECT *, customer % 27 AS place, sha256('order|doordash|x' || k) AS oid,
                CASE WHEN k % 3 = 2 THEN closed ELSE NULL END AS delivered
         FROM doc WHERE customer % 27 < 25 AND k % 6 > 0),
dline AS (SELECT *, s - 1 AS line_no FROM (SELECT *, unnest(range(1, 1 + k % 6)) AS s FROM ddoc)),
qdoc AS (SELECT *, customer % 27 AS place, sha256('order|square|q' || k) AS oid
         FROM doc WHERE customer % 27 < 25 AND k % 4 > 0),
qline AS (SELECT *, s - 1 AS line_no, (k + s) % 2500 AS pk,
                 CAST([1, 2, 0, 3][1 + (k + s) % 4] AS INTEGER) AS quantity, 1001 + k % 500 + s AS paid
          FROM (SELECT *, unnest(range(1, 1 + k % 4)) AS s FROM qdoc))
"""


def over_docs(select: str, extra: str = "") -> str:
    return "WITH " + DOCS.strip() + (", " + extra if extra else "") + "\n" + select.strip()


TOAST_ORDERS = """
SELECT oid AS id, 'toast' AS source, 'g' || k AS source_order_id, place AS location_id,
  CASE priority WHEN '1-URGENT' THEN 'delivery' WHEN '2-HIGH' THEN 'takeout' WHEN '5-LOW'
       THEN 'curbside' ELSE 'dine_in' END AS order_type,
  ['pos', 'online', 'third_party', 'kiosk'][1 + k % 4] AS channel, 'completed' AS status,
  opened AS created_at, closed AS closed_at,
  CAST(sum(cents % 10000 + 100 * c) AS BIGINT) AS subtotal_cents,
  CAST(sum(10 * c) AS BIGINT) AS tax_cents, CAST(sum(5 * c) AS BIGINT) AS tip_cents,
  CAST(sum(cents % 10000 + 110 * c) AS BIGINT) AS total_cents
FROM tcheck WHERE k IN (SELECT k FROM tkept) GROUP BY ALL"""
DASH_ORDERS = """
SELECT oid AS id, 'doordash' AS source, 'x' || k AS source_order_id, place AS location_id,
  CASE WHEN k % 5 = 0 THEN 'pickup' WHEN k % 7 = 0 THEN 'drone' ELSE 'delivery' END AS order_type,
  'delivery_app' AS channel, CASE flag WHEN 'F' THEN 'delivered' ELSE 'picked_up' END AS status,
  opened AS created_at, coalesce(delivered, closed) AS closed_at, cents AS subtotal_cents,
  cents % 900 AS tax_cents, cents % 300 AS tip_cents, cents + 1000 AS total_cents,
  cents % 700 AS delivery_fee_cents, cents % 500 AS service_fee_cents,
  cents % 400 AS commission_cents, k % 4 = 0 AS contains_alcohol, k % 8 = 0 AS is_catering
FROM ddoc"""
SQUARE_ORDERS = """
SELECT oid AS id, 'square' AS source, 'q' || k AS source_order_id, place AS location_id,
  CASE WHEN k % 5 = 0 THEN 'dine_in' ELSE ['pickup', 'delivery', 'shipment'][1 + k % 3] END
    AS order_type,
  CASE WHEN k % 3 = 0 THEN 'online' ELSE 'pos' END AS channel,
  CASE flag WHEN 'P' THEN 'cancelled' ELSE 'completed' END AS status,
  opened AS created_at, closed AS closed_at, cents - cents % 900 - cents % 300 AS subtotal_cents,
  cents % 900 AS tax_cents, cents % 300 AS tip_cents, cents AS total_cents
FROM qdoc"""

EXPORTS = {
    "p03_toast_selections": """SELECT 'g' || k AS guid, check_no, line_no,
        'item ' || (k + c + s) % 50 AS name, CASE WHEN s = 1 THEN 1 ELSE 0 END AS modifier_count
        FROM tline""",
    "p07_toast_orders": TOAST_ORDERS,
    "p10_toast_items": f"""SELECT check_no, line_no,
        {digest("'item'", "oid", "check_no", "line_no")} AS id, oid AS order_id, 'toast' AS source,
        'item ' || (k + c + s) % 50 AS original_name, CAST((k + s) % 4 AS INTEGER) AS quantity,
        CASE WHEN (k + s) % 4 <> 0 THEN CAST(floor((1000 + k % 500 + s)
          / CAST((k + s) % 4 AS DOUBLE) + 0.5) AS BIGINT) END AS unit_price_cents,
        900 + s AS total_price_cents, s AS tax_cents, NULL AS special_instructions,
        CASE WHEN s = 1 THEN '[{{"name":"extra","price":50}}]' ELSE '[]' END AS modifiers
        FROM tline WHERE place < 25""",
    "p13_toast_payments": f"""SELECT {digest("'payment'", "oid", "check_no", "payment_no")} AS id,
        oid AS order_id, 'p' || k || '-' || c || '-' || p AS source_payment_id,
        ['credit', 'cash', 'gift'][1 + (k + p) % 3] AS payment_type,
        CASE WHEN (k + p) % 3 = 0 THEN 'visa' END AS card_brand,
        CASE WHEN (k + p) % 3 = 0 THEN lpad(CAST(k % 10000 AS VARCHAR), 4, '0') END AS last_four,
        1000 + c AS amount_cents, 5 * c AS tip_cents, 30 AS processing_fee_cents,
        closed AS created_at FROM tpay WHERE k IN (SELECT k FROM tkept)""",
    "p08_doordash_orders": DASH_ORDERS,
    "p11_doordash_items": f"""SELECT 0 AS check_no, line_no,
        {digest("'item'", "oid", "0", "line_no")} AS id, oid AS order_id, 'doordash' AS source,
        'item ' || (k + s) % 50 AS original_name, CAST(1 + (k + s) % 4 AS INTEGER) AS quantity,
        500 + s AS unit_price_cents, (500 + s) * (1 + (k + s) % 4) AS total_price_cents,
        NULL AS tax_cents, CASE WHEN (k + s) % 3 = 0 THEN 'no onions' END AS special_instructions,
        '[{{"name":"cheese","price":100}}]' AS modifiers FROM dline""",
    "p14_doordash_payments": f"""SELECT {digest("'payment'", "oid", "'platform'")} AS id,
        oid AS order_id, 'dd_pay_x' || k AS source_payment_id, 'platform' AS payment_type,
        NULL AS card_brand, NULL AS last_four, cents - cents % 400 AS amount_cents,
        cents % 300 AS tip_cents, cents % 400 AS processing_fee_cents,
        coalesce(delivered, closed) AS created_at FROM ddoc""",
    "p09_square_orders": SQUARE_ORDERS,
    "p12_square_items": f"""SELECT {digest("'item'", "oid", "0", "line_no")} AS id, oid AS order_id,
        'square' AS source, CASE WHEN p_partkey IS NULL THEN 'v' || pk || '-' || s % 2
          WHEN s % 2 = 0 THEN p_name ELSE p_name || ' - ' || p_size || ' pc' END AS original_name,
        'i' || p_partkey AS catalog_id, CASE WHEN p_partkey IS NOT NULL THEN
          CASE WHEN s % 2 = 0 THEN 'Regular' ELSE p_size || ' pc' END END AS catalog_label,
        quantity, CASE WHEN quantity > 0 THEN CAST(floor(CAST(paid AS DOUBLE) / quantity + 0.5)
          AS BIGINT) END AS unit_price_cents, paid AS total_price_cents, NULL AS tax_cents,
        NULL AS special_instructions,
        CASE WHEN s = 1 THEN '[{{"modifier_id":"M1"}}]' ELSE '[]' END AS modifiers FROM qline LEFT JOIN part ON p_partkey = pk""",
    "p15_square_payments": f"""SELECT {digest("'payment'", "oid", "'qp' || k")} AS id,
        oid AS order_id, 'qp' || k AS source_payment_id,
        CASE WHEN k % 4 = 0 AND k % 5 <> 0 THEN 'credit' WHEN k % 4 = 1 THEN 'cash'
             WHEN k % 4 = 2 AND k % 3 <> 0 THEN 'wallet' ELSE 'other' END AS payment_type,
        CASE WHEN k % 4 = 0 AND k % 5 <> 0 THEN 'amex'
             WHEN k % 4 = 2 AND k % 3 <> 0 THEN 'apple_pay' END AS card_brand,
        CASE WHEN k % 4 = 0 AND k % 5 <> 0 THEN lpad(CAST(k % 10000 AS VARCHAR), 4, '0') END
          AS last_four, cents AS amount_cents, cents % 300 AS tip_cents,
        NULL AS processing_fee_cents, closed AS created_at FROM qdoc""",
    "u01_stacked_orders": f"""SELECT source, order_type, channel, status, count(*) AS orders,
        CAST(sum(total_cents) AS BIGINT) AS total_cents FROM (
          SELECT source, order_type, channel, status, total_cents FROM ({TOAST_ORDERS})
          UNION ALL SELECT source, order_type, channel, status, total_cents FROM ({DASH_ORDERS})
          UNION ALL SELECT source, order_type, channel, status, total_cents FROM ({SQUARE_ORDERS}))
        GROUP BY ALL""",
    "q04_integrity_report": """
        WITH x AS (
          SELECT 'orders' AS metric, 'toast' AS source, (SELECT count(*) FROM tdoc) AS expected,
                 (SELECT count(*) FROM tkept) AS actual
          UNION ALL SELECT 'orders', 'doordash', (SELECT count(*) FROM doc), (SELECT count(*) FROM ddoc)
          UNION ALL SELECT 'orders', 'square', (SELECT count(*) FROM doc), (SELECT count(*) FROM qdoc)
          UNION ALL SELECT 'payments', 'toast', (SELECT count(*) FROM tpay),
                 (SELECT count(*) FROM tpay WHERE k IN (SELECT k FROM tkept))
          UNION ALL SELECT 'payments', 'doordash', (SELECT count(*) FROM doc), (SELECT count(*) FROM ddoc)
          UNION ALL SELECT 'payments', 'square', (SELECT count(*) FROM doc), (SELECT count(*) FROM qdoc)),
        y AS (SELECT * FROM x UNION ALL
          SELECT metric, 'total', CAST(sum(expected) AS BIGINT), CAST(sum(actual) AS BIGINT) FROM x
          GROUP BY metric UNION ALL
          SELECT 'orders without payment', 'total', 0, (SELECT count(*) FROM tkept
            WHERE k NOT IN (SELECT k FROM tpay)))
        SELECT *, expected = actual AS ok FROM y""",
    "s02_live_exports": f"""SELECT 'loaded' AS outcome, order_type AS detail, count(*) AS records,
          CAST(sum(total_cents) AS BIGINT) AS total_cents
        FROM ({DASH_ORDERS} WHERE k % 29 <> 0 AND k % 31 <> 0 AND k % 37 <> 0) GROUP BY ALL
        UNION ALL SELECT 'set aside', 'store_id', count(*), NULL FROM doc WHERE k % 29 = 0 HAVING count(*) > 0
        UNION ALL SELECT 'set aside', 'order_subtotal', count(*), NULL FROM doc
          WHERE k % 29 <> 0 AND k % 31 = 0 HAVING count(*) > 0
        UNION ALL SELECT 'set aside', 'several', count(*), NULL FROM doc
          WHERE k % 29 <> 0 AND k % 31 <> 0 AND k % 37 = 0 HAVING count(*) > 0""",
    "s11_validation": """
        SELECT 'store_id' AS path, 'expected string' AS message, count(*) AS violations FROM doc WHERE k % 29 = 0 HAVING count(*) > 0
        UNION ALL SELECT 'dasher_tip', 'expected number', count(*) FROM doc WHERE k % 31 = 0 HAVING count(*) > 0
        UNION ALL SELECT 'is_catering', 'expected boolean', count(*) FROM doc WHERE k % 37 = 0 HAVING count(*) > 0
        UNION ALL SELECT 'order_items', 'expected array', count(*) FROM doc WHERE k % 41 = 0 HAVING count(*) > 0
        UNION ALL SELECT 'order_items.' || (s - 1) || '.category', 'expected string', count(*)
          FROM (SELECT k, unnest(range(1, 1 + k % 6)) AS s FROM doc WHERE k % 23 = 0 AND k % 41 <> 0)
          WHERE 1 + (k + s) % 4 = 2 GROUP BY s""",
    "p18_toast_raw_fields": """SELECT 'g' || k AS source_order_id, CASE priority WHEN '1-URGENT' THEN 'DELIVERY'
          WHEN '2-HIGH' THEN 'TAKE_OUT' WHEN '5-LOW' THEN 'CURBSIDE' ELSE 'DINE_IN' END AS behavior,
        cents % 10000 + 100 * min(c) AS first_check, 'item ' || (k + min(c) + 1) % 50 AS first_item
        FROM tcheck WHERE k IN (SELECT k FROM tkept) GROUP BY k, priority, cents""",
    "p18_doordash_raw_fields": """SELECT 'x' || k AS source_order_id,
        CASE WHEN k % 5 = 0 THEN 'PICKUP' WHEN k % 7 = 0 THEN 'Drone' ELSE 'MERCHANT_DELIVERY' END AS method,
        cents - cents % 400 AS payout, k % 4 = 0 AS alcohol FROM ddoc""",
    "p18_square_raw_fields": """SELECT 'q' || k AS source_order_id,
        CASE WHEN k % 3 = 0 THEN 'Square Online' ELSE 'Register' END AS register, cents AS total,
        'v' || (k + 1) % 2500 || '-1' AS first_line FROM qdoc""",
}

# Names ---------------------------------------------------------------------------------------

RAW = """
raw AS (SELECT DISTINCT CASE l_linenumber % 5 WHEN 0 THEN p_name
     WHEN 1 THEN substr(p_name, 1, spot) || substr(p_name, spot + 2)
     WHEN 2 THEN substr(p_name, 1, spot) || chr(CAST(97 + l_suppkey % 26 AS INTEGER)) || substr(p_name, spot + 1)
     WHEN 3 THEN 'Lg ' || p_name ELSE upper(p_name) || ' 12 PCS' END AS original_name
   FROM (SELECT *, CAST(l_suppkey % length(p_name) AS INTEGER) AS spot
         FROM lineitem JOIN part ON p_partkey = l_partkey)),
trimmed AS (SELECT original_name, trim(original_name) AS n FROM raw),
cut AS (SELECT original_name,
    CASE WHEN regexp_matches(n, '(?i)\\d+\\s*(pcs?|pieces?)$')
           THEN trim(regexp_replace(n, '(?i)\\s*\\d+\\s*(pcs?|pieces?)\\s*$', ''))
         WHEN regexp_matches(n, '(?i)^(lg|sm|med)\\s') THEN trim(regexp_replace(n, '^\\S+\\s+', ''))
         WHEN regexp_matches(n, '(?i)\\s(small|medium|large|xl|xxl|slice|whole pie|pint|glass|bottle|single|double|dbl)$')
           THEN 'unexpected' ELSE n END AS base,
    CASE WHEN regexp_matches(n, '(?i)\\d+\\s*(pcs?|pieces?)$')
           THEN regexp_extract(n, '(\\d+)', 1) || ' pcs'
         WHEN regexp_matches(n, '(?i)^(lg|sm|med)\\s') THEN 'Large' END AS label,
    CASE WHEN regexp_matches(n, '(?i)\\d+\\s*(pcs?|pieces?)$') THEN 'quantity'
         WHEN regexp_matches(n, '(?i)^(lg|sm|med)\\s') THEN 'size' END AS kind
  FROM trimmed),
keyed AS (SELECT *, lower(base) AS text FROM cut),
shelf AS (SELECT lower(p_name) AS product_text, min(p_partkey) AS product_id FROM part GROUP BY 1)
"""


def over_names(select: str) -> str:
    return "WITH " + RAW.strip() + "\n" + select.strip()


def _typo(term: str) -> str:
    """First word that is close to a term without being it."""
    near = (f"levenshtein(w, '{term}') BETWEEN 1 AND "
            f"(CASE WHEN least(length(w), {len(term)}) <= 5 THEN 1 ELSE 2 END) AND NOT "
            f"(length(w) = {len(term)} AND length(w) <= 6)")
    return f"list_filter(string_split_regex(low, '\\s+'), lambda w: {near})[1]"


NAMES = {
    "n01_name_features": """SELECT original_name, base, text,
        CASE WHEN kind = 'size' THEN 'Large' ELSE label END AS label,
        CASE WHEN label = 'Large' THEN NULL ELSE kind END AS kind FROM keyed""",
    "n05_find_products": """
        SELECT text, arg_min(product_id, d * 1000000000 + product_id) AS product_id FROM (
          SELECT DISTINCT text, product_id, levenshtein(text, product_text) AS d
          FROM (SELECT DISTINCT text FROM keyed), shelf)
        WHERE d <= 3 OR d <= least(5, floor(length(text) * 0.25)) GROUP BY text""",
    "n06_rule_match": f"""
        WITH m AS (SELECT original_name, low, {_typo('ring')} AS ring, {_typo('widget')} AS widget,
                          {_typo('gizmo')} AS gizmo
                   FROM (SELECT original_name, lower(trim(original_name)) AS low FROM raw)),
        r AS (SELECT *, CASE WHEN regexp_matches(low, '\\bring\\b') THEN 1 WHEN ring IS NOT NULL THEN 2
            WHEN regexp_matches(low, '\\bwidget\\b') THEN 3 WHEN widget IS NOT NULL THEN 4
            WHEN contains(low, 'hot rod') OR contains(low, 'gizmo') OR gizmo IS NOT NULL THEN 5 END
            AS step FROM m)
        SELECT original_name, CASE WHEN step <= 2 THEN 'Ring' ELSE 'Widget' END AS rule,
          nullif(CASE step
            WHEN 1 THEN trim(regexp_replace(original_name, '(?i)\\s*\\bring\\b\\s*$', ''))
            WHEN 3 THEN trim(regexp_replace(original_name, '(?i)\\s*\\bwidget\\b\\s*$', ''))
            WHEN 2 THEN trim(regexp_replace(original_name, '(?i)\\s*\\b' || ring || '\\b\\s*', ' '))
            WHEN 4 THEN trim(regexp_replace(original_name, '(?i)\\s*\\b' || widget || '\\b\\s*', ' '))
            ELSE trim(original_name) END, '') AS label
        FROM r WHERE step IS NOT NULL""",
    "n12_near_pairs": """
        SELECT text AS probe_text, product_text AS index_text,
               CAST(levenshtein(text, product_text) AS INTEGER) AS distance
        FROM (SELECT DISTINCT text FROM keyed), shelf WHERE levenshtein(text, product_text) <= 3""",
}
NAMES["n18_label_override"] = f"""SELECT original_name, coalesce(ruled.label, keyed.label) AS label,
        CASE WHEN ruled.label IS NOT NULL THEN 'semantic' ELSE kind END AS label_kind
        FROM keyed LEFT JOIN ({NAMES["n06_rule_match"]}) ruled USING (original_name)"""
# Rule of the first matching step, as in n06_rule_match, without its label.
RULED = NAMES["n06_rule_match"].strip().removeprefix("WITH").partition("SELECT original_name, CASE WHEN step <= 2")[0]

# Decisions in first-seen order, one name per step: the list of groups is carried along.
GROUPED = f"""WITH RECURSIVE {RAW.strip()}, {RULED.strip()},
sold AS (SELECT CASE l_linenumber % 5 WHEN 0 THEN p_name
     WHEN 1 THEN substr(p_name, 1, spot) || substr(p_name, spot + 2)
     WHEN 2 THEN substr(p_name, 1, spot) || chr(CAST(97 + l_suppkey % 26 AS INTEGER)) || substr(p_name, spot + 1)
     WHEN 3 THEN 'Lg ' || p_name ELSE upper(p_name) || ' 12 PCS' END AS original_name, l_orderkey
   FROM (SELECT *, CAST(l_suppkey % length(p_name) AS INTEGER) AS spot
         FROM lineitem JOIN part ON p_partkey = l_partkey)),
ranked AS (SELECT original_name, row_number() OVER (ORDER BY min(l_orderkey), original_name) - 1 AS rank
           FROM sold GROUP BY 1),
named AS (SELECT n.original_name, n.rank, k.base, k.text,
            CASE WHEN r.step <= 2 THEN 'ring' WHEN r.step >= 3 THEN 'widget' END AS rule
          FROM ranked n JOIN keyed k USING (original_name) JOIN r USING (original_name)),
ruled AS (SELECT rule, min(rank) AS closed_at FROM named WHERE rule IS NOT NULL GROUP BY 1),
fuzzy AS (SELECT row_number() OVER (ORDER BY n.rank) AS i, n.rank, text,
            {{'leader': n.rank, 'key': text, 'improper': left(base, 1) = lower(left(base, 1)),
             'size': length(base), 'closed': coalesce(closed_at, 4611686018427387904)}} AS me
          FROM named n LEFT JOIN ruled ON ruled.rule = lower(base) WHERE n.rule IS NULL),
walk AS (
  SELECT i, rank, rank AS leader, [me] AS groups FROM fuzzy WHERE i = 1
  UNION ALL
  SELECT i, rank, coalesce(found, rank), CASE WHEN found IS NULL THEN list_append(groups, me)
    ELSE list_transform(groups, lambda g: CASE WHEN g.leader = found AND (me.improper < g.improper
        OR (me.improper = g.improper AND me.size > g.size))
      THEN {{'leader': g.leader, 'key': me.key, 'improper': me.improper, 'size': me.size,
            'closed': me.closed}} ELSE g END) END
  FROM (SELECT f.i, f.rank, f.me, w.groups, list_min(list_transform(list_filter(w.groups,
          lambda g: g.closed >= f.rank AND levenshtein(g.key, f.text) <= 3), lambda g: g.leader)) AS found
        FROM walk w JOIN fuzzy f ON f.i = w.i + 1))
"""

LABELS = """WITH RECURSIVE seen AS (
  SELECT p_brand AS product_id, lower(p_name) AS text, arg_min(p_name, p_partkey) AS label,
         min(p_partkey) AS rank FROM part GROUP BY 1, 2),
tree AS (SELECT a.product_id, a.rank, min(b.rank) AS parent FROM seen a LEFT JOIN seen b
           ON b.product_id = a.product_id AND b.rank < a.rank AND levenshtein(a.text, b.text) <= 2
         GROUP BY ALL),
walk AS (SELECT product_id, rank, rank AS root FROM tree WHERE parent IS NULL
         UNION ALL SELECT t.product_id, t.rank, w.root FROM tree t JOIN walk w
           ON w.product_id = t.product_id AND w.rank = t.parent)
SELECT product_id, arg_min(label, -length(label) * 10000000000 + rank) AS name,
       arg_min(label, rank) AS source_raw_name
FROM walk JOIN seen USING (product_id, rank) GROUP BY product_id, root"""

PART_NAMES = {
    "n13_product_groups": GROUPED + """SELECT original_name, n.rank, coalesce(closed_at, leader) AS group_rank
        FROM named n LEFT JOIN ruled USING (rule) LEFT JOIN walk w ON w.rank = n.rank""",
    "n14_products": GROUPED + """, g AS (SELECT n.*, coalesce(closed_at, leader) AS product_rank
          FROM named n LEFT JOIN ruled USING (rule) LEFT JOIN walk w ON w.rank = n.rank)
        SELECT product_rank, coalesce(CASE min(rule) WHEN 'ring' THEN 'Ring' WHEN 'widget' THEN 'Widget' END,
          arg_min(base, CASE WHEN left(base, 1) = lower(left(base, 1)) THEN 1000000000000000 ELSE 0 END
                        - length(base) * 10000000000 + rank)) AS name, count(*) AS item_count
        FROM g GROUP BY 1""",
    "n14_product_keys": GROUPED + """, g AS (SELECT n.*, coalesce(closed_at, leader) AS product_rank
          FROM named n LEFT JOIN ruled USING (rule) LEFT JOIN walk w ON w.rank = n.rank)
        SELECT kind, key, max(product_rank) AS product_rank FROM (
          SELECT 'id' AS kind, original_name AS key, product_rank FROM g UNION ALL
          SELECT 'name', lower(trim(original_name)), product_rank FROM g UNION ALL
          SELECT 'name', lower(trim(base)), product_rank FROM g) GROUP BY 1, 2""",
    "n11_labels": LABELS,
    "n16_categories": """SELECT upper(left(p_type, 1)) || lower(substr(p_type, 2)) || ' & '
        || upper(left(p_brand, 1)) || lower(substr(p_brand, 2)) AS category,
        min(p_partkey) AS first_part FROM part GROUP BY 1""",
    "w01_first_names": """SELECT lower(trim(p_name)) AS name_key, p_partkey AS first_id,
        p_name AS name FROM part
        QUALIFY row_number() OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey) = 1""",
}

# One catalog sold by three sources ------------------------------------------------------------

DISHES = """
dish AS (SELECT * EXCLUDE (low), upper(left(low, 1)) || substr(low, 2) AS dish FROM (
           SELECT p_partkey, p_brand, p_type, p_size, translate(left(sha256(CAST(p_partkey AS VARCHAR)), 16),
             '0123456789abcdef', 'abcdefghijklmnop') AS low FROM part)),
line AS (SELECT l_orderkey AS k, l_linenumber, l_suppkey, CAST(l_quantity AS INTEGER) AS quantity,
           CAST(round(l_extendedprice * 100) AS BIGINT) AS paid, d.*, 'NATION_' || o_custkey % 25 AS place,
           ['square', 'toast', 'doordash'][1 + l_linenumber % 3] AS source,
           CASE WHEN p_partkey % 2 = 0 THEN p_size || ' pc' ELSE 'Lg' END AS shelf
         FROM lineitem JOIN dish d ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
sale AS (SELECT *, CASE
           WHEN source = 'square' THEN dish || CASE WHEN l_suppkey % 2 = 1 THEN ' - ' || shelf ELSE '' END
           WHEN l_suppkey % 3 = 0 THEN dish
           WHEN l_suppkey % 3 = 1 THEN CASE source WHEN 'toast' THEN upper(dish) ELSE lower(dish) END
           WHEN source = 'toast' THEN left(dish, length(dish) - 1) ELSE left(dish, 1) || substr(dish, 3) END AS original_name,
           row_number() OVER (PARTITION BY k, source ORDER BY l_linenumber, l_partkey, l_suppkey, quantity, paid) - 1 AS line_no
         FROM (SELECT *, p_partkey AS l_partkey FROM line)),
sold AS (SELECT source, lower(trim(original_name)) AS name_key, p_partkey,
           arg_min(original_name, {'a': CASE source WHEN 'toast' THEN 'g' ELSE 'x' END || k, 'b': line_no}) AS original_name,
           min({'a': CASE source WHEN 'toast' THEN 'g' ELSE 'x' END || k, 'b': line_no}) AS first
         FROM sale WHERE source <> 'square' GROUP BY ALL),
product AS (SELECT d.*, CASE WHEN p_partkey % 10 <> 3 THEN upper(left(p_type, 1)) || lower(substr(p_type, 2))
             WHEN EXISTS (SELECT 1 FROM sold s WHERE s.p_partkey = d.p_partkey AND source = 'toast') THEN 'Menu ' || p_brand
             WHEN EXISTS (SELECT 1 FROM sold s WHERE s.p_partkey = d.p_partkey) THEN 'Online ' || p_brand END AS category_name,
             (SELECT count(*) FROM sold s WHERE s.p_partkey = d.p_partkey) AS names FROM dish d)
"""


def over_dishes(select: str) -> str:
    return "WITH " + DISHES.strip() + "\n" + select.strip()


CATALOG = {
    "u02_candidates": """SELECT source, original_name, category_name, row_number() OVER (
          ORDER BY CASE source WHEN 'square' THEN 0 WHEN 'toast' THEN 1 ELSE 2 END, first) - 1 AS rank FROM (
        SELECT 'square' AS source, dish AS original_name, NULL AS category_name, {'a': 'i' || p_partkey, 'b': 0} AS first FROM dish
        UNION ALL SELECT source, original_name, CASE source WHEN 'toast' THEN 'Menu ' ELSE 'Online ' END || p_brand, first
        FROM sold JOIN dish USING (p_partkey))""",
    "a11_described_products": """SELECT dish AS name, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS description,
        category_name, 1 + names AS item_count FROM product""",
    "n15_shelf_labels": """SELECT dish AS product_name, CASE WHEN p_partkey % 2 = 0 THEN p_size || ' pcs' ELSE 'Large' END AS name,
        CASE WHEN p_partkey % 2 = 0 THEN 'quantity' ELSE 'size' END AS variation_type,
        dish || ' - ' || CASE WHEN p_partkey % 2 = 0 THEN p_size || ' pc' ELSE 'Lg' END AS source_raw_name FROM dish""",
    "j07_attached_lines": """SELECT source, CASE source WHEN 'toast' THEN 'g' WHEN 'doordash' THEN 'x' ELSE 'q' END || k
          AS source_order_id, place AS location_name, trim(original_name) AS original_name, quantity, paid AS total_price_cents,
        p.dish AS product_name, p.category_name,
        CASE WHEN source = 'square' AND l_suppkey % 2 = 1 THEN
          CASE WHEN p_partkey % 2 = 0 THEN s.p_size || ' pcs' ELSE 'Large' END END AS variation_name,
        CASE WHEN source = 'square' AND l_suppkey % 2 = 1 THEN
          CASE WHEN p_partkey % 2 = 0 THEN 'quantity' ELSE 'size' END END AS variation_type
        FROM sale s JOIN product p USING (p_partkey)""",
    "n17_aliases": """SELECT source, original_name AS raw_name, dish AS product_name FROM sold JOIN dish USING (p_partkey)
        UNION ALL SELECT 'square', dish, dish FROM dish""",
    "p16_locations": """SELECT n_name AS name, CASE WHEN n_nationkey % 5 = 4 THEN 'America/New_York'
          WHEN n_nationkey % 2 = 0 THEN 'America/Chicago' ELSE 'America/Denver' END AS timezone,
        't' || n_nationkey AS toast_id, 'd' || n_nationkey AS doordash_id, 's' || n_nationkey AS square_id,
        CASE WHEN n_nationkey % 5 <> 4 THEN 'City ' || n_regionkey END AS city, n_nationkey % 5 <> 4 AS has_square FROM nation""",
}

# Silver operators ----------------------------------------------------------------------------

TABLES = {"locations": "s_locations", "categories": "s_categories", "products": "s_products",
          "product_variations": "s_variations", "product_aliases": "s_aliases",
          "orders": "s_orders", "order_items": "s_items", "payments": "s_payments"}
REFERENCES = [
    ("products", "category_id", "categories"), ("product_variations", "product_id", "products"),
    ("product_aliases", "product_id", "products"), ("orders", "location_id", "locations"),
    ("order_items", "order_id", "orders"), ("order_items", "product_id", "products"),
    ("order_items", "variation_id", "product_variations"), ("payments", "order_id", "orders")]
DOMAINS = {
    ("orders", "source"): "'toast', 'doordash', 'square'",
    ("orders", "order_type"): "'dine_in', 'takeout', 'pickup', 'delivery'",
    ("orders", "channel"): "'pos', 'online', 'delivery_app', 'third_party'",
    ("orders", "status"): "'completed', 'delivered', 'picked_up', 'cancelled', 'refunded'",
    ("payments", "payment_type"): "'credit', 'cash', 'wallet', 'platform', 'other'",
    ("payments", "card_brand"):
        "'visa', 'mastercard', 'amex', 'discover', 'apple_pay', 'google_pay'",
    ("product_variations", "variation_type"): "'quantity', 'size', 'serving', 'strength', 'semantic'",
    ("product_aliases", "source"): "'toast', 'doordash', 'square'",
}
REQUIRED = {
    "locations": "id name", "categories": "id name", "products": "id name",
    "product_variations": "id product_id name", "product_aliases": "id product_id raw_name source",
    "orders": "id source source_order_id location_id order_type channel created_at subtotal_cents "
              "total_cents",
    "order_items": "id order_id original_name quantity unit_price_cents total_price_cents",
    "payments": "id order_id payment_type amount_cents",
}


def _rule_rows(rule: str, name: str, column: str, condition: str) -> str:
    return (f"SELECT '{rule}' AS rule, '{name}' AS table_name, '{column}' AS column_name, "
            f"count(*) AS violations FROM {TABLES[name]} t WHERE {condition}")


OPERATORS = {
    "st3_stored_payments": """SELECT payment_type, created_at, count(*) AS payments,
        CAST(sum(amount_cents) AS BIGINT) AS amount_cents FROM (
          SELECT payment_type, created_at, CASE WHEN order_id % 50 = 7 THEN 5 ELSE amount_cents END AS amount_cents FROM s_payments
          UNION ALL SELECT payment_type, created_at, amount_cents FROM s_payments WHERE order_id % 50 = 9)
        GROUP BY ALL""",
    "a09_data_range": "SELECT min(created_at) AS earliest, max(created_at) AS latest FROM s_orders",
    "a10_location_names": "SELECT DISTINCT name FROM s_locations",
    "a10_category_names": "SELECT DISTINCT name FROM s_categories",
    "c03_chart_values": """SELECT channel, CAST(sum(total_cents) AS DOUBLE) / 100 AS total,
        CAST(count(*) AS DOUBLE) AS order_count, channel AS name,
        CAST(sum(total_cents) AS DOUBLE) / 100 AS value FROM s_orders GROUP BY channel""",
    "c05_wide_to_long": """
        SELECT 'total cents' AS category, CAST(sum(total_cents) AS DOUBLE) AS value FROM s_orders
        UNION ALL SELECT 'tip cents', CAST(sum(tip_cents) AS DOUBLE) FROM s_orders
        UNION ALL SELECT 'order count', CAST(count(*) AS DOUBLE) FROM s_orders""",
    "c08_display_text": """SELECT format('{:,}', id) AS id,
        CASE WHEN is_catering THEN 'Yes' WHEN NOT is_catering THEN 'No' ELSE '-' END AS is_catering,
        coalesce(format('{:,}', tip_cents), '-') AS tip_cents, channel FROM s_orders""",
    "j04_orders_by_place_id": """SELECT location_id, count(*) AS orders FROM s_orders
        WHERE location_id IS NOT NULL GROUP BY 1""",
    "j06_order_payments": """SELECT source, count(*) AS payments,
        CAST(sum(amount_cents) AS BIGINT) AS amount_cents, CAST(sum(total_cents) AS BIGINT) AS total_cents
        FROM s_payments p JOIN s_orders o ON o.id = p.order_id GROUP BY source""",
    "j12_orders_with_items": "SELECT id, source FROM s_orders o WHERE EXISTS "
                             "(SELECT 1 FROM lineitem WHERE l_orderkey = o.id)",
    "j13_orders_without_payment": "SELECT id, source FROM s_orders o WHERE NOT EXISTS "
                                  "(SELECT 1 FROM s_payments p WHERE p.order_id = o.id)",
    "p20_location_match": "SELECT id, name FROM s_locations WHERE name ILIKE '%NATION_2%'",
    "p21_beverage_products": """SELECT id, name FROM s_products WHERE category_id IN
        (SELECT id FROM s_categories WHERE regexp_matches(name, '(?i)promo|small'))""",
    "q03_payment_coverage": """SELECT count(p.order_id) AS with_payment,
        count(*) - count(p.order_id) AS without_payment
        FROM s_orders o LEFT JOIN (SELECT DISTINCT order_id FROM s_payments) p ON p.order_id = o.id""",
    "q06_duplicate_aliases": """SELECT raw_name, source, count(*) AS copies FROM s_aliases
        GROUP BY 1, 2 HAVING count(*) > 1""",
    "q07_orphans": " UNION ALL ".join(
        _rule_rows("reference", child, column, f"{column} IS NOT NULL AND NOT EXISTS "
                   f"(SELECT 1 FROM {TABLES[parent]} p WHERE p.id = t.{column})")
        for child, column, parent in REFERENCES),
    "q08_row_rules": " UNION ALL ".join(
        [_rule_rows("domain", t, c, f"{c} NOT IN ({allowed})") for (t, c), allowed in DOMAINS.items()]
        + [_rule_rows("not_null", t, c, f"{c} IS NULL")
           for t, columns in REQUIRED.items() for c in columns.split()]),
    "q09_defaults": """SELECT source, CAST(sum(coalesce(tax_cents, 0)) AS BIGINT) AS tax_cents,
        CAST(sum(coalesce(tip_cents, 0)) AS BIGINT) AS tip_cents,
        CAST(sum(coalesce(commission_cents, 0)) AS BIGINT) AS commission_cents,
        count(*) FILTER (WHERE NOT coalesce(is_catering, false)) AS not_catering
        FROM s_orders GROUP BY 1""",
    "q10_cascading_delete": """
        SELECT 'orders' AS table_name, count(*) AS row_count FROM s_orders WHERE status <> 'cancelled'
        UNION ALL SELECT 'order_items', count(*) FROM s_items WHERE order_id NOT IN
          (SELECT id FROM s_orders WHERE status = 'cancelled')
        UNION ALL SELECT 'payments', count(*) FROM s_payments WHERE order_id NOT IN
          (SELECT id FROM s_orders WHERE status = 'cancelled')""",
    "s08_load_stats": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {view}"
        for name, view in TABLES.items()),
}

# Plain tables: codes, text, conversations, usage, query log -----------------------------------

CHAT = """chat AS (SELECT conv_id, turn, role, text, conv_id + turn AS n FROM conversations)"""
CALLS = CHAT + """,
calls AS (SELECT conv_id AS process_id, turn AS seq,
    ['grok-4.1-fast', 'gpt-5.2', 'gpt-oss-20b'][1 + n % 3] AS model, 'step ' || turn % 4 AS label,
    length(text) AS prompt_tokens, CASE WHEN turn % 2 = 0 THEN length(text) // 3 ELSE 0 END AS cached_tokens,
    length(text) // 2 AS completion_tokens FROM chat),
rates AS (SELECT * FROM (VALUES ('grok-4.1-fast', 200, 50, 500), ('gpt-5.2', 1750, 175, 14000),
    ('gpt-oss-20b', 75, 75, 300)) AS v(model, i, c, o)),
nano AS (SELECT calls.*, prompt_tokens - cached_tokens AS input_tokens,
    CAST(prompt_tokens - cached_tokens AS BIGINT) * i AS input_nano, CAST(cached_tokens AS BIGINT) * c AS cached_nano,
    CAST(completion_tokens AS BIGINT) * o AS output_nano FROM calls JOIN rates USING (model))"""
NANO_COSTS = """CAST({0}(input_nano) AS DOUBLE) / 1e9 AS input_cost,
    CAST({0}(cached_nano) AS DOUBLE) / 1e9 AS cached_cost,
    CAST({0}(output_nano) AS DOUBLE) / 1e9 AS output_cost,
    CAST({0}(input_nano + cached_nano + output_nano) AS DOUBLE) / 1e9 AS total_cost"""
KEYWORDS = ["INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "CREATE"]
STATEMENTS = CHAT + """,
log AS (SELECT conv_id, turn, ['SELECT updated_at, note FROM t -- ',
   'WITH x AS (SELECT 1) SELECT * FROM x; ', 'drop table orders ', 'SELECT 1; DELETE FROM orders ',
   ' select created_by from log ', 'Update t SET a = 1; insert into t VALUES (2) '][1 + n % 6]
   || regexp_replace(text, '[^A-Za-z ]', '', 'g') AS sql FROM chat),
found AS (SELECT *, list_filter([""" + ", ".join(f"'{k}'" for k in KEYWORDS) + """],
   lambda w: regexp_matches(upper(sql), '\\b' || w || '\\b')) AS words FROM log)"""


def _usage(keys: str) -> str:
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}"
                     for c in ("input_tokens", "cached_tokens", "completion_tokens"))
    return f"""WITH {CALLS} SELECT {keys}, count(*) AS calls, {sums},
        CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens,
        {NANO_COSTS.format('sum')} FROM nano GROUP BY {keys}"""


def _coded(table: dict[str, str], upper: bool = False) -> str:
    key = "upper(code)" if upper else "code"
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {key} {cases} ELSE lower(code) END"


OTHERS = {
    "f01_codes": f"""WITH x AS (SELECT o_orderkey, ['DINE_IN', 'TAKE_OUT', 'DELIVERY', 'PICKUP',
        'Curbside', 'CARD', 'Cash', 'AMERICAN_EXPRESS', '', 'POS', 'THIRD_PARTY', 'Shop Online']
        [1 + o_orderkey % 12] AS code FROM orders)
        SELECT o_orderkey,
          {_coded({'DINE_IN': 'dine_in', 'TAKE_OUT': 'takeout', 'DELIVERY': 'delivery'})} AS toast_type,
          {_coded({'POS': 'pos', 'THIRD_PARTY': 'third_party'})} AS toast_channel,
          {_coded({'MERCHANT_DELIVERY': 'delivery', 'PICKUP': 'pickup'})} AS doordash_type,
          {_coded({'DINE_IN': 'dine_in', 'PICKUP': 'pickup'})} AS square_type,
          CASE WHEN contains(lower(code), 'online') THEN 'online' ELSE 'pos' END AS square_channel,
          {_coded({'CARD': 'credit', 'CASH': 'cash'}, True)} AS payment,
          CASE WHEN code = '' THEN NULL ELSE {_coded({'AMERICAN_EXPRESS': 'amex'}, True)} END AS brand
        FROM x""",
    "f09_text": """WITH x AS (SELECT *, CAST(levenshtein(lower(p_name), lower(p_type)) AS INTEGER) AS d FROM part)
        SELECT p_partkey, d AS distance, least(d, 10) AS bounded,
          left(p_name, 1) <> lower(left(p_name, 1)) AS proper,
          lower(p_type) || ' ' || lower(p_name) AS clean,
          p_retailprice / CASE WHEN p_size <> 11 THEN CAST(p_size - 11 AS DOUBLE) END AS ratio FROM x""",
    "h01_conversation_list": """SELECT conv_id AS conversation_id,
          left(arg_min(text, turn) FILTER (WHERE role = 'user'), 50) AS preview,
          count(*) AS message_count, min(turn) AS created_at, max(turn) AS updated_at
        FROM conversations GROUP BY 1 ORDER BY updated_at DESC, conv_id LIMIT 50""",
    "c01_column_kinds": """SELECT 'amount' AS name, bool_and(regexp_full_match(CAST(l_quantity AS VARCHAR),
          '[0-9.]+')) AS is_numeric FROM lineitem
        UNION ALL SELECT 'code', bool_and(regexp_full_match(l_linenumber || 'd', '[0-9.]+')) FROM lineitem
        UNION ALL SELECT 'flag', bool_and(regexp_full_match(l_returnflag, '[0-9.]+')) FROM lineitem
        UNION ALL SELECT 'l_partkey', true""",
    "f10_plain_letters": "SELECT doc_id, strip_accents(text) AS text FROM documents",
    "f24_header_labels": """SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '),
          lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM part""",
    "h03_touched_conversations": """SELECT conv_id AS id, min(turn) AS created_at, max(turn) AS updated_at
        FROM conversations GROUP BY 1""",
    "h02_conversation_messages": """SELECT conv_id AS conversation_id, turn AS created_at, role,
        text AS content FROM conversations WHERE conv_id = 7""",
    "h04_history_lines": """SELECT conv_id AS conversation_id, turn AS position,
          CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text AS line
        FROM conversations QUALIFY turn < max(turn) OVER (PARTITION BY conv_id)""",
    "h05_stored_answers": """WITH x AS (SELECT conv_id AS conversation_id, turn,
          CASE WHEN turn % 3 <> 0 THEN text ELSE '  ' END AS partial,
          CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS streamed,
          CASE WHEN turn % 5 = 0 THEN '[{"type":"bar"}]' END AS charts FROM conversations)
        SELECT conversation_id, turn, 1 AS step, 'assistant' AS role, partial AS content, NULL AS charts
        FROM x WHERE trim(partial) <> '' AND (charts IS NOT NULL OR trim(streamed) = '')
        UNION ALL SELECT conversation_id, turn, 2, 'assistant', streamed, charts
        FROM x WHERE charts IS NOT NULL OR trim(streamed) <> ''""",
    "k01_audit": f"""WITH {STATEMENTS} SELECT conv_id, turn, sql,
          regexp_matches(upper(trim(sql)), '^(SELECT|WITH)') AND len(words) = 0 AS is_read_only,
          array_to_string(words, ',') AS offending FROM found""",
    "k01_offending_keywords": f"WITH {STATEMENTS} SELECT conv_id, turn, unnest(words) AS keyword FROM found",
    "k02_clean_statements": f"""WITH {CHAT}, x AS (SELECT *,
          regexp_replace(text, '[^A-Za-z ]', 'x', 'g') AS word FROM chat)
        SELECT conv_id, turn, CASE n % 4 WHEN 0 THEN 'SELECT ''' || word || '''' || chr(10) || 'FROM t'
          WHEN 1 THEN 'SELECT name FROM t WHERE a = ''' || word || ''' '
          WHEN 2 THEN 'WITH a AS (SELECT 1)' || chr(10) || '-- select ' || word || chr(10) || 'SELECT 2'
          ELSE 'SELECT 3' END AS sql FROM x""",
    "l01_call_costs": f"""WITH {CALLS} SELECT model, process_id, seq, label, prompt_tokens, cached_tokens,
          completion_tokens, input_tokens, {NANO_COSTS.format('')} FROM nano""",
    "l02_usage_by_process": _usage("process_id"),
    "l02_usage_by_model": _usage("model"),
    "w04_running_costs": f"""WITH {CALLS}, t AS (SELECT process_id, seq,
          input_nano + cached_nano + output_nano AS nano FROM nano)
        SELECT process_id, seq, CAST(nano AS DOUBLE) / 1e9 AS total_cost,
          CAST(sum(nano) OVER w AS DOUBLE) / 1e9 AS running_cost, count(*) OVER w AS running_calls
        FROM t WINDOW w AS (PARTITION BY process_id ORDER BY seq)""",
    "v01_vote": """WITH g AS (SELECT l_orderkey AS question_id,
            '[{"n":' || CAST(l_quantity % 3 AS INTEGER) || '}]' AS result, count(*) AS votes,
            min(l_linenumber) AS candidate_id
          FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2)
        SELECT question_id, candidate_id, result, votes,
          CAST(sum(votes) OVER (PARTITION BY question_id) AS BIGINT) AS successes,
          count(*) OVER (PARTITION BY question_id) AS answers,
          votes / CAST(sum(votes) OVER (PARTITION BY question_id) AS DOUBLE) AS confidence
        FROM g QUALIFY row_number() OVER (PARTITION BY question_id
          ORDER BY votes DESC, candidate_id, result) = 1""",
    "st1_live_hourly": """SELECT date_trunc('hour', ts) AS hour_start,
          'place ' || user_id % 7 AS location_name, count(*) AS orders,
          CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_cents
        FROM events WHERE event_type = 'purchase' GROUP BY 1, 2""",
    "st1_live_distinct_users": """SELECT 'place ' || user_id % 7 AS location_name, count(DISTINCT user_id) AS users,
        true AS within_bound FROM events GROUP BY 1""",
    "st2_live_distinct_orders": """SELECT CAST(event_id AS VARCHAR) AS source_order_id, ts AS created_at
        FROM events WHERE event_type = 'purchase'
        UNION ALL SELECT CAST(event_id AS VARCHAR), ts + INTERVAL 21 DAY FROM events
        WHERE event_type = 'purchase' AND event_id % 5 = 0""",
}


def build() -> dict[str, str]:
    sql = {name: over_silver(text) for name, text in {**GOLD, **RECIPES, **OPERATORS}.items()}
    sql.update(PERIOD_SQL)
    sql.update({name: over_docs(text) for name, text in EXPORTS.items()
                if name != "q04_integrity_report"})
    nested = EXPORTS["q04_integrity_report"].strip().removeprefix("WITH").lstrip()
    cut = nested.index("SELECT *, expected = actual")
    sql["q04_integrity_report"] = over_docs(nested[cut:], nested[:cut].strip())
    for name, text in NAMES.items():
        body = text.strip()
        sql[name] = (over_names(body) if not body.startswith("WITH") else
                     "WITH " + RAW.strip() + ", " + body.removeprefix("WITH").lstrip())
    sql.update({name: over_dishes(text) for name, text in CATALOG.items()})
    sql.update({name: text.strip() for name, text in {**PART_NAMES, **OTHERS}.items()})
    return sql
