"""Nested source documents and raw product names derived from the star-schema tables.

Every order becomes a document of each source, with checks, lines, payments and the flaws the
rules handle (voids, refunds, unknown places, zero quantities). Arrays are computed inside the
order's own row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from restomart.functions.names import NameConfig
from restomart.sources.exports import SEQ, Exports, SquareExport
from restomart.sources.star_adapter import table

# Rules that fit the part names.
STAR_NAMES = NameConfig(groups=[
    {"base_name": "Ring", "suffix": "ring"},
    {"base_name": "Widget", "suffix": "widget", "keywords": ["hot rod", "gizmo"]},
])


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    opened = F.col("o_orderdate") + F.make_dt_interval(hours=F.col("o_orderkey") % 24)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("customer"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("flag"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        F.date_format(opened, iso).alias("opened"),
        F.date_format(opened + F.expr("interval 45 minutes"), iso).alias("closed"))


def _build(df: DataFrame, **columns: str) -> DataFrame:
    out = df.select(*[F.expr(sql).alias(name) for name, sql in columns.items()])
    key = next(iter(columns))
    return out.withColumns({
        "file": F.lit("star"),
        "seq": F.struct(F.lit("star").alias("place"), F.lit(0).alias("position"),
                        F.col(key).alias("id")).cast(SEQ)})


def toast_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    selections = """transform(sequence(1, 1 + (k + c) % 3), s -> named_struct(
        'guid', concat('s', k, '-', c, '-', s),
        'displayName', concat('item ', (k + c + s) % 50),
        'itemGroup', named_struct('name', concat('group ', (k + s) % 5)),
        'quantity', (k + s) % 4, 'preDiscountPrice', 1000 + k % 500 + s,
        'price', 900 + s, 'tax', s, 'voided', (k + c + s) % 7 = 0,
        'modifiers', if(s = 1, array(named_struct('displayName', 'extra', 'price', 50L)),
                        cast(array() as array<struct<displayName: string, price: bigint>>))))"""
    payments = """transform(sequence(1, 1 + k % 2), p -> named_struct(
        'guid', concat('p', k, '-', c, '-', p), 'paidDate', closed,
        'type', element_at(array('CREDIT', 'CASH', 'GIFT'), cast(1 + (k + p) % 3 as int)),
        'cardType', if((k + p) % 3 = 0, 'VISA', null),
        'last4Digits', if((k + p) % 3 = 0, lpad(cast(k % 10000 as string), 4, '0'), null),
        'amount', 1000 + c, 'tipAmount', 5 * c, 'originalProcessingFee', 30L,
        'refundStatus', if((k + p) % 9 = 0, 'FULL_REFUND', 'NONE')))"""
    return _build(
        _facts(spark, sf_dir),
        guid="concat('g', k)", restaurantGuid="concat('t', customer % 27)",
        openedDate="opened", closedDate="closed", voided="k % 13 = 0", deleted="k % 17 = 0",
        diningOption="""named_struct('behavior', CASE priority WHEN '1-URGENT' THEN 'DELIVERY'
            WHEN '2-HIGH' THEN 'TAKE_OUT' WHEN '5-LOW' THEN 'CURBSIDE' ELSE 'DINE_IN' END)""",
        source="element_at(array('POS', 'ONLINE', 'THIRD_PARTY', 'Kiosk'), cast(1 + k % 4 as int))",
        checks=f"""transform(sequence(1, 1 + k % 3), c -> named_struct(
            'voided', (k + c) % 11 = 0, 'deleted', (k + c) % 19 = 0,
            'amount', cents % 10000 + 100 * c, 'taxAmount', 10 * c,
            'totalAmount', cents % 10000 + 110 * c, 'tipAmount', 5 * c,
            'selections', {selections}, 'payments', {payments}))""")


def doordash_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = """named_struct('item_id', concat('i', k, '-', s),
        'name', concat('item ', (k + s) % 50), 'category', concat('group ', (k + s) % 5),
        'quantity', 1 + (k + s) % 4, 'unit_price', 500 + s, 'total_price', (500 + s) * (1 + (k + s) % 4),
        'special_instructions', if((k + s) % 3 = 0, 'no onions', ''),
        'options', array(named_struct('name', 'cheese', 'price', 100L)))"""
    return _build(
        _facts(spark, sf_dir),
        external_delivery_id="concat('x', k)", store_id="concat('d', customer % 27)",
        order_fulfillment_method="""CASE WHEN k % 5 = 0 THEN 'PICKUP' WHEN k % 7 = 0 THEN 'Drone'
            ELSE 'MERCHANT_DELIVERY' END""",
        order_status="if(flag = 'F', 'DELIVERED', 'PICKED_UP')", created_at="opened",
        pickup_time="closed",
        delivery_time="CASE WHEN k % 3 = 0 THEN null WHEN k % 3 = 1 THEN '' ELSE closed END",
        order_items=f"""transform(filter(sequence(0, k % 6), s -> s > 0), s -> {item})""",
        order_subtotal="cents", delivery_fee="cents % 700", service_fee="cents % 500",
        dasher_tip="cents % 300", tax_amount="cents % 900",
        total_charged_to_consumer="cents + 1000", commission="cents % 400",
        merchant_payout="cents - cents % 400", contains_alcohol="k % 4 = 0",
        is_catering="k % 8 = 0")


def square_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = """named_struct('uid', concat(k, '-', s),
        'catalog_object_id', concat('v', (k + s) % 2500, '-', s % 2),
        'quantity', element_at(array('1', '2.5', '0', '3 boxes'), cast(1 + (k + s) % 4 as int)),
        'total_money', named_struct('amount', 1001 + k % 500 + s),
        'applied_modifiers', if(s = 1, array(named_struct('modifier_id', 'M1')), null))"""
    money = lambda sql: f"named_struct('amount', {sql})"
    return _build(
        _facts(spark, sf_dir),
        id="concat('q', k)", location_id="concat('s', customer % 27)",
        source="named_struct('name', if(k % 3 = 0, 'Square Online', 'Register'))",
        created_at="opened", closed_at="closed",
        state="if(flag = 'P', 'CANCELLED', 'COMPLETED')",
        line_items=f"transform(filter(sequence(0, k % 4), s -> s > 0), s -> {line})",
        fulfillments="""if(k % 5 = 0,
            cast(array() as array<struct<type: string>>), array(named_struct('type',
            element_at(array('PICKUP', 'DELIVERY', 'SHIPMENT'), cast(1 + k % 3 as int)))))""",
        total_money=money("cents"), total_tax_money=money("cents % 900"),
        total_tip_money=money("cents % 300"))


def square_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _build(
        _facts(spark, sf_dir),
        id="concat('qp', k)", order_id="concat('q', k)", created_at="closed",
        amount_money="named_struct('amount', cents)",
        tip_money="named_struct('amount', cents % 300)",
        source_type="element_at(array('CARD', 'CASH', 'WALLET', 'EXTERNAL'), cast(1 + k % 4 as int))",
        card_details="""if(k % 4 = 0 AND k % 5 <> 0, named_struct('card', named_struct(
            'card_brand', 'AMERICAN_EXPRESS', 'last_4', lpad(cast(k % 10000 as string), 4, '0'))), null)""",
        wallet_details="if(k % 4 = 2 AND k % 3 <> 0, named_struct('brand', 'APPLE_PAY'), null)")


def square_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    items = _build(
        parts, id="concat('i', p_partkey)", type="'ITEM'",
        item_data="""named_struct('name', p_name, 'description', p_brand,
            'category_id', concat('c', p_type), 'variations', array(
              named_struct('id', concat('v', p_partkey, '-0'),
                           'item_variation_data', named_struct('name', 'Regular')),
              named_struct('id', concat('v', p_partkey, '-1'),
                           'item_variation_data', named_struct('name', concat(p_size, ' pc')))))""",
        category_data="cast(null as struct<name: string>)")
    kinds = _build(
        parts.select("p_type").distinct(), id="concat('c', p_type)", type="'CATEGORY'",
        item_data=f"cast(null as {items.schema['item_data'].dataType.simpleString()})",
        category_data="named_struct('name', p_type)")
    return items.unionByName(kinds)


def raw_names(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Names as sold: part names with a lost or added letter, a size prefix or a count suffix."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    at = "cast(l_suppkey % length(p_name) as int)"
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(*keep, F.expr(f"""
        CASE l_linenumber % 5 WHEN 0 THEN p_name
          WHEN 1 THEN concat(substring(p_name, 1, {at}), substring(p_name, {at} + 2))
          WHEN 2 THEN concat(substring(p_name, 1, {at}), chr(97 + l_suppkey % 26),
                             substring(p_name, {at} + 1))
          WHEN 3 THEN concat('Lg ', p_name)
          ELSE concat(upper(p_name), ' 12 PCS') END""").alias("original_name"))


# Exports that sell one catalog ---------------------------------------------------------------

# A name per part, far from every other: letters a to p stand for the digits of a hash.
DISH = "initcap(translate(substring(sha2(cast({0} AS string), 256), 1, 16), '0123456789abcdef', 'abcdefghijklmnop'))"


def _sold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as an array, in order; an order has a handful of lines. Lines are dealt out as plain
    columns, which take less room than arrays of one or two."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("qty"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("paid"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.expr(DISH.format("p_partkey")).alias("dish"))
    named = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey").repartition("l_orderkey")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "qty", "paid", "p_brand", "dish")
    sold = named.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return sold.join(_facts(spark, sf_dir), F.col("l_orderkey") == F.col("k"))


def dish_exports(spark: SparkSession, sf_dir: str) -> Exports:
    """Exports over the line items: Toast sells every third line, DoorDash the next, Square the last, under
    the catalog's name or a spelling near it."""
    facts, parts = _sold_lines(spark, sf_dir), table(spark, sf_dir, "part")
    picked = lambda n, sql: f"transform(filter(lines, x -> x.l_linenumber % 3 = {n}), (x, i) -> {sql})"
    place = "customer % 25"
    toast = _build(
        facts, guid="concat('g', k)", restaurantGuid=f"concat('t', {place})", openedDate="opened", closedDate="closed",
        voided="false", deleted="false", diningOption="named_struct('behavior', 'DINE_IN')", source="'POS'",
        checks="array(named_struct('voided', false, 'deleted', false, 'amount', cents, 'taxAmount', 0L, 'totalAmount', cents,"
               " 'tipAmount', 0L, 'selections', " + picked(1, """named_struct('guid', concat('s', k, '-', i),
                 'displayName', CASE x.l_suppkey % 3 WHEN 0 THEN x.dish WHEN 1 THEN upper(x.dish)
                    ELSE substring(x.dish, 1, length(x.dish) - 1) END,
                 'itemGroup', named_struct('name', concat('Menu ', x.p_brand)), 'quantity', x.qty, 'preDiscountPrice', x.paid,
                 'price', x.paid, 'tax', 0L, 'voided', false, 'modifiers',
                 cast(array() as array<struct<displayName: string, price: bigint>>))""")
               + ", 'payments', cast(array() as array<struct<guid: string, paidDate: string, type: string, cardType: string,"
                 " last4Digits: string, amount: bigint, tipAmount: bigint, originalProcessingFee: bigint, refundStatus: string>>)))")
    doordash = _build(
        facts, external_delivery_id="concat('x', k)", store_id=f"concat('d', {place})",
        order_fulfillment_method="'PICKUP'", order_status="'DELIVERED'", created_at="opened", pickup_time="closed",
        delivery_time="closed", order_items=picked(2, """named_struct('item_id', concat('i', k, '-', i),
            'name', CASE x.l_suppkey % 3 WHEN 0 THEN x.dish WHEN 1 THEN lower(x.dish)
               ELSE concat(substring(x.dish, 1, 1), substring(x.dish, 3)) END, 'category', concat('Online ', x.p_brand), 'quantity', x.qty,
            'unit_price', x.paid, 'total_price', x.paid, 'special_instructions', '',
            'options', cast(array() as array<struct<name: string, price: bigint>>))"""),
        order_subtotal="cents", delivery_fee="0L", service_fee="0L", dasher_tip="0L", tax_amount="0L",
        total_charged_to_consumer="cents", commission="0L", merchant_payout="cents", contains_alcohol="false",
        is_catering="false")
    money = lambda sql: f"named_struct('amount', {sql})"
    orders = _build(
        facts, id="concat('q', k)", location_id=f"concat('s', {place})", source="named_struct('name', 'Register')",
        created_at="opened", closed_at="closed", state="'COMPLETED'", line_items=picked(0, """named_struct(
            'uid', concat(k, '-', i), 'catalog_object_id', concat('v', x.l_partkey, '-', x.l_suppkey % 2),
            'quantity', cast(x.qty as string), 'total_money', named_struct('amount', x.paid),
            'applied_modifiers', cast(null as array<struct<modifier_id: string>>))"""),
        fulfillments="cast(array() as array<struct<type: string>>)", total_money=money("cents"),
        total_tax_money=money("0L"), total_tip_money=money("0L"))
    items = _build(
        parts, id="concat('i', p_partkey)", type="'ITEM'", item_data=f"""named_struct('name', {DISH.format('p_partkey')},
            'description', if(p_partkey % 4 = 0, '', p_brand),
            'category_id', if(p_partkey % 10 = 3, null, concat('c', p_type)), 'variations', array(
              named_struct('id', concat('v', p_partkey, '-0'), 'item_variation_data', named_struct('name', 'Regular')),
              named_struct('id', concat('v', p_partkey, '-1'), 'item_variation_data', named_struct('name',
                if(p_partkey % 2 = 0, concat(p_size, ' pc'), 'Lg')))))""", category_data="cast(null as struct<name: string>)")
    kinds = _build(
        parts.select("p_type").distinct(), id="concat('c', p_type)", type="'CATEGORY'",
        item_data=f"cast(null as {items.schema['item_data'].dataType.simpleString()})",
        category_data="named_struct('name', p_type)")
    places = _build(
        table(spark, sf_dir, "nation").filter("n_nationkey % 5 <> 4"), id="concat('s', n_nationkey)", name="n_name",
        address="""named_struct('address_line_1', concat(n_nationkey, ' Main St'), 'locality', concat('City ', n_regionkey),
            'administrative_district_level_1', 'NY', 'postal_code', lpad(cast(n_nationkey as string), 5, '0'), 'country', 'US')""",
        timezone="if(n_nationkey % 2 = 0, 'America/Chicago', 'America/Denver')", status="'ACTIVE'", type="'PHYSICAL'",
        merchant_id="'M'")
    return Exports(toast, doordash, SquareExport(places, items.unionByName(kinds), orders, square_payments(spark, sf_dir)))


def dish_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locations as they are configured, with each source's id."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("int").alias("position"), F.col("n_name").alias("name"),
        *[F.concat(F.lit(p), "n_nationkey").alias(c) for p, c in (("t", "toast_id"), ("d", "doordash_id"), ("s", "square_id"))])
