"""Input tables for the registered queries, derived from the data folder by plain SQL.

The same text runs in Spark and in DuckDB; what differs between the two is written once per engine in ``WORDS``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from suasion.sources.tables import table

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages")
WORDS = {
    "spark": {"MS": "timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)", "K": "cast(regexp_extract(props, '[0-9]+', 0) as int)", "STR": "string", "BIG": "bigint", "DBL": "double", "OPEN": "{{", "CLOSE": "}}"},
    "duck": {"MS": "(epoch_us(ts) // 1000)", "K": "cast(regexp_extract(props, '[0-9]+', 0) as int)", "STR": "varchar", "BIG": "bigint", "DBL": "double", "OPEN": "{", "CLOSE": "}"},
}
PATTERN = "case event_type when 'view' then 'urgency.countdown' when 'click' then 'scarcity.stock' when 'purchase' then 'pricing.drip' when 'signup' then 'anchoring.reference_price' else 'nagging.repeat_interstitial' end"
STAGE = "case event_id % 5 when 0 then 'browse' when 1 then 'pdp' when 2 then 'cart' when 3 then 'checkout' else 'payment' end"

TABLES = {
    # category of a shop; shops not listed are 'other'
    "b_allowlist": """
        select 'shop' || cast(i as {STR}) || '.com' as site, case i % 4 when 0 then 'fashion' when 1 then 'travel' when 2 then 'grocery' else 'electronics' end as category
        from (select distinct user_id % 40 as i from {events}) s""",
    # one detection for each event: a reporter's day is a batch
    "b_detections": """
        select event_id, cast(user_id as {STR}) || ':' || cast(cast(floor({MS} / 86400000) as {BIG}) as {STR}) as batch_id, """ + PATTERN + """ as pattern_id,
               """ + PATTERN + """ || '@1' as detector_id, """ + STAGE + """ as funnel_stage, 'https://' || case when user_id % 7 < 3 then 'www.' when user_id % 7 < 5 then 'secure.eu.' else '' end || 'shop' || cast(user_id % 60 as {STR}) || '.com' as origin,
               least(value / 500, 1.0) as confidence, {MS} as ts_ms, cast(floor(value * 37) as {BIG}) % 3000 as visible_ms, event_id % 7 = 0 as ephemeral, event_id % 11 <> 0 as prominent,
               {K} as k, user_id
        from {events}""",
    # page-view messages: a user's visit to a shop page, what was on screen and whether an add followed
    "b_views": """
        select user_id as view_id, 'https://www.shop' || cast(user_id % 60 as {STR}) || '.com' as origin, case when event_id % 2 = 0 then 'pdp' else 'browse' end as funnel_stage,
               {MS} as ts_ms, event_id as seq, """ + PATTERN + """ as pattern_id, event_type = 'purchase' as added
        from {events}""",
    # outcome rows as a reporter's batch carries them: the page baseline and one row for the technique seen
    "b_outcome_rows": """
        select cast(user_id as {STR}) || ':' || cast(cast(floor({MS} / 86400000) as {BIG}) as {STR}) as batch_id, p.pattern_id, case when event_id % 2 = 0 then 'pdp' else 'browse' end as funnel_stage,
               'shop' || cast(user_id % 20 as {STR}) || '.com' as site, 'fashion' as origin_category, '1.0.1' as rulepack_version, cast(floor({MS} / 86400000) as {BIG}) as day_bucket,
               case when {K} % 10 < 3 then 1 else 0 end as added_to_cart
        from {events} e join (select event_type as et, """ + PATTERN + """ as pattern_id from (select distinct event_type from {events}) a union all select event_type, '_page' from (select distinct event_type from {events}) b) p on e.event_type = p.et""",
    # repeat sightings of offers
    "b_timers": """
        select 'https://shop.example' as origin, cast(user_id as {STR}) as offer_key, 'c' || cast({K} % 2 as {STR}) as container, {MS} as ts_ms, event_id as seq,
               case when user_id % 2 = 0 then {MS} + 7200000 else 1800000000000 end as end_ms
        from {events} where event_type = 'view'""",
    "b_stock": """
        select 'https://shop.example' as origin, cast(user_id % 20 as {STR}) || ':' || cast({K} as {STR}) as offer_key, {MS} as ts_ms, event_id as seq,
               case when {K} % 10 = 0 then 3 else cast(floor(value) as {BIG}) % 12 end as n
        from {events}""",
    "b_prices": """
        select 'https://shop.example' as origin, cast(user_id as {STR}) as offer_key, {MS} as ts_ms, cast(round(value * 100) as {BIG}) as minor from {events}""",
    "b_ref_prices": """
        select 'https://shop.example' as origin, cast(user_id as {STR}) as offer_key, {MS} as ts_ms, cast(99999 as {BIG}) as minor from {events} where user_id % 3 = 0 or event_id % 2 = 0""",
    "b_viewers": """
        select 'https://shop.example' as origin, cast(user_id % 20 as {STR}) || ':' || event_type as offer_key, {MS} as ts_ms, event_id as seq,
               case user_id % 3 when 0 then cast(17 as {BIG}) when 1 then cast(45 + event_id % 3 as {BIG}) else cast(floor(value * 7) as {BIG}) % 97 end as n
        from (select event_id, ts, (user_id % 20) as user_id, event_type, value from {events}) e""",
    # an order as a session: its lines are charges met at later and later stages
    "b_fees": """
        select l_orderkey as session_id, 'https://shop.example' as origin, case l_linenumber % 4 when 1 then 'pdp' when 2 then 'cart' when 3 then 'checkout' else 'payment' end as stage,
               case when l_partkey % 7 = 0 then 'Accident Protection Plan' when l_partkey % 7 = 1 then 'Gift wrap' when l_partkey % 7 = 2 then 'Service fee' when l_partkey % 7 = 3 then 'Promo discount' when l_partkey % 7 = 4 then 'Resort fee' when l_partkey % 7 = 5 then 'Estimated tax' else 'Mystery charge' end as label,
               cast(round(l_extendedprice * l_tax * 100) as {BIG}) as amount
        from {lineitem}""",
    "b_snapshots": """
        select o_orderkey as session_id, 'https://shop.example' as origin, s.stage, cast(round(o_totalprice * 100) as {BIG}) as subtotal
        from {orders} cross join (select 'pdp' as stage union all select 'cart' union all select 'checkout' union all select 'payment') s""",
    "b_adds": """
        select o_orderkey as session_id, 'https://shop.example' as origin, o_custkey as seq from {orders} where o_orderstatus <> 'P'""",
    "b_choices": """
        select l_orderkey as session_id, 'https://shop.example' as origin, case when l_suppkey % 2 = 0 then 'protection' else 'gift_wrap' end as addon_key,
               l_returnflag <> 'N' as selected, cast(l_partkey as {BIG}) * 1000000 + l_suppkey * 10 + l_linenumber as seq
        from {lineitem}""",
    # text lines of the corpus, with the site they came from
    "b_corpus": """
        select source as site, doc_id, text from {documents}""",
    "b_money": """
        select l_orderkey, l_linenumber, cast(round(l_extendedprice * 100) as {BIG}) as was_minor, cast(round(l_extendedprice * 100) as {BIG}) - cast(round(l_extendedprice * 100) as {BIG}) * cast(round(l_discount * 100) as {BIG}) / 100 as now_raw
        from {lineitem}""",
}


def _needed(names: tuple[str, ...]) -> list[str]:
    return [n for n in TABLES if n in names]


def _text(name: str, engine: str) -> str:
    out = TABLES[name]
    for key, value in WORDS[engine].items():
        out = out.replace("{" + key + "}", value)
    return out.strip()


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly to more tasks than there are cores: for narrow rows of small files of which much is made."""
    spark = rows.sparkSession
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def frame(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """One bridge table in Spark, from the tables of the folder or those ``given`` in their place."""
    text = _text(name, "spark")
    used = {t: given[t] if t in given else table(spark, sf_dir, t) for t in BASE if "{" + t + "}" in text}
    return spark.sql(text, **used)


def oracle(body: str, *names: str) -> str:
    """DuckDB SQL with the named bridge tables in front."""
    parts = [f"{n} AS ({re.sub(r'{(\w+)}', r'\1', _text(n, 'duck'))})" for n in _needed(names)]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        body = body[5:]
        return "WITH " + ", ".join([*parts, body])
    return "WITH " + ", ".join(parts) + " " + body


COPY = (
    "Only 3 left in stock", "Selling fast", "Only 3 rooms left at this rate", "2 sizes left", "Ships in 3 business days", "Low stock items alerts", "While supplies last. Terms and conditions apply", "Almost sold out",
    "Deal ends in 04:12", "Limited time offer, ends 09/21", "Book by Jan 7, 2027", "Open until 21:00", "Hurry, sale ends Sunday", "Your cart is reserved for 09:59",
    "23 people are viewing this right now", "17 sold in the last 24 hours", "1,203 reviews", "482 products found", "Sarah in Denver just bought this", "People want this",
    "You're $30 away from free shipping", "Only $30 until free shipping", "Free shipping on orders over $50", "Shipping: $5.99", "Add $12 more to get a gift",
    "No thanks, I don't want to save money", "No thanks", "I like paying full price", "I understand this may result in a higher overall price", "Add to bag",
)


def _copy_case(column: str) -> str:
    arms = " ".join("when {} then '{}'".format(i, t.replace("'", "''")) for i, t in enumerate(COPY))
    return f"case {column} {arms} end"


TABLES["b_copy"] = """
    select page_id, idx, stage, raw_text, lower(raw_text) as text, has_progress, is_control, in_dialog, ephemeral, accessible_name, has_progress as has_progress_child, cast(null as {STR}) as container_path, '' as container_text, 'body>div' || cast(idx as {STR}) || case when idx % 3 = 0 then '' else '>span' end as selector_path
    from (
      select l_orderkey as page_id, l_linenumber * 1000 + l_partkey % 1000 as idx, case l_linenumber % 3 when 0 then 'pdp' when 1 then 'cart' else 'checkout' end as stage, """ + _copy_case("(l_orderkey + l_partkey) % 30") + """ as raw_text,
             l_suppkey % 5 = 0 as has_progress, l_suppkey % 2 = 0 as is_control, l_suppkey % 3 = 0 as in_dialog, l_suppkey % 7 = 0 as ephemeral, case when l_suppkey % 11 = 0 then 'Close' else '' end as accessible_name
      from (select l_orderkey, l_partkey, l_linenumber, min(l_suppkey) as l_suppkey from {lineitem} group by l_orderkey, l_partkey, l_linenumber) u
    ) x"""
TABLES["b_price_copy"] = """
    select l_orderkey as page_id, l_linenumber as idx, l_partkey, was, now, 'Was $' || cast(cast(floor(was / 100) as {BIG}) as {STR}) || '.' || lpad(cast(was % 100 as {STR}), 2, '0') || ' Now $' || cast(cast(floor(now / 100) as {BIG}) as {STR}) || '.' || lpad(cast(now % 100 as {STR}), 2, '0') as text
    from (select l_orderkey, l_linenumber, l_partkey, cast(round(l_extendedprice * 100) as {BIG}) as was, cast(round(l_extendedprice * 100) as {BIG}) - cast(floor(l_extendedprice * l_discount) as {BIG}) * 100 as now from {lineitem}) p"""
PRICE = "'$' || cast(cast(floor(minor / 100) as {BIG}) as {STR}) || '.' || lpad(cast(minor % 100 as {STR}), 2, '0')"
ONE_LINE = "(select l_orderkey, l_linenumber, min(l_suppkey) as l_suppkey, min(l_partkey) as l_partkey, min(l_quantity) as l_quantity, cast(round(min(l_extendedprice) * 10) as {BIG}) as minor from {lineitem} group by l_orderkey, l_linenumber)"
# struck prices and live ones beside them, and a live one around each container's
TABLES["b_nodes"] = """
    select page_id, idx, 'pdp' as stage, selector_path, struck, minor, raw_text, lower(raw_text) as text, case k % 5 when 0 then 'was more' when 1 then 'now 20% off' when 2 then 'you save -15%' else '' end as container_text
    from (
      select l_orderkey as page_id, l_linenumber as idx, case when l_linenumber % 2 = 1 then 'body>div' || cast(l_suppkey % 2 as {STR}) || '>p' || cast(l_linenumber as {STR}) || '>s' else 'body>div' || cast(l_suppkey % 2 as {STR}) || '>p' || cast(l_linenumber as {STR}) end as selector_path,
             l_linenumber % 2 = 1 as struck, minor, l_partkey as k, """ + PRICE + """ as raw_text from """ + ONE_LINE + """ u
      union all select distinct l_orderkey, 100, 'body>div0', false, cast(100 as {BIG}), l_orderkey, 'List price $1.00' from {lineitem} where l_orderkey % 2 = 0
    ) n"""
# a price, and for each second one a node inside that often says the same price
TABLES["b_charm"] = """
    select page_id, idx, 'pdp' as stage, selector_path, area, cents_child, two, minor, """ + PRICE + """ || case when two then ' or $12.95' else '' end as raw_text
    from (
      select l_orderkey as page_id, l_linenumber as idx, 'body>div' || cast(cast(floor((l_linenumber + 1) / 2.0) as {BIG}) as {STR}) || case when l_linenumber % 2 = 0 then '>b' else '' end as selector_path, cast(l_quantity * 20 as {DBL}) as area, l_partkey % 4 = 0 as cents_child, l_suppkey % 4 = 0 as two,
             case when l_orderkey % 3 = 0 then minor else min(minor) over (partition by l_orderkey, floor((l_linenumber + 1) / 2.0)) end as minor
      from """ + ONE_LINE + """ u
    ) n"""
# packs of a container; some say no quantity, some two prices
TABLES["b_options"] = """
    select page_id, idx, 'pdp' as stage, container_path, minor, quantity, counted, single, badge, raw_text, lower(raw_text) as text
    from (
      select l_orderkey as page_id, l_linenumber as idx, 'body>div' || cast(l_suppkey % 2 as {STR}) as container_path, minor, cast(l_quantity as {BIG}) as quantity, l_partkey % 7 <> 0 as counted, l_suppkey % 9 <> 0 as single, l_partkey % 3 = 0 as badge,
             case when l_partkey % 7 = 0 then 'One size ' else cast(cast(l_quantity as {BIG}) as {STR}) || ' pack ' end || """ + PRICE + """ || case when l_suppkey % 9 = 0 then ' was $1.00' else '' end || case when l_partkey % 3 = 0 then ' Best value' else '' end as raw_text
      from """ + ONE_LINE + """ u
    ) n"""
# stock claims that a container says in several nodes
TABLES["b_split"] = """
    select page_id, idx, 'pdp' as stage, text, text as raw_text, container_path, container_text, coalesce(container_path, 'body') || '>p' || cast(idx as {STR}) as selector_path, false as has_progress_child
    from (
      select l_orderkey as page_id, l_linenumber as idx, case l_partkey % 6 when 0 then '3' when 1 then 'only' when 2 then 'left at' when 3 then 'at this price' when 4 then 'stock, order' else case when l_orderkey % 3 = 0 then 'low stock' else 'free' end end as text,
             case l_suppkey % 4 when 0 then 'body>a' when 1 then 'body>a>b' when 2 then 'body>c' end as container_path, case when l_suppkey % 5 < 2 then 'only 3 left at this price' when l_suppkey % 5 < 4 then 'low stock, order soon' else 'free returns' end as container_text
      from """ + ONE_LINE + """ u
    ) n"""
TABLES["b_lines"] = """
    select source as site, doc_id, text from {documents}"""
TABLES["b_labels"] = """
    select d.doc_id as ord, d.source as site, case when l.toxic = 1 then 1 else 0 end as label, cast(d.n_chars % 1000 as {DBL}) / 1000 as score, case l.quality when 1 then 'a.one' else 'b.two' end as pattern_id
    from {documents} d join {labels} l on d.doc_id = l.doc_id"""
# what was logged of the labelled texts: a score under the log threshold is not
TABLES["b_fired"] = """
    select d.doc_id as ord, cast(d.n_chars % 1000 as {DBL}) / 1000 as score from {documents} d join {labels} l on d.doc_id = l.doc_id where d.n_chars % 1000 >= 350"""
TABLES["b_label_log"] = """
    select event_type as pattern_id, cast(user_id as {STR}) as key, event_id as seq, event_id % 2 as label, event_id % 9 = 0 as undo, case when event_id % 5 = 0 then 'scarcity' when event_id % 7 = 0 then 'other' end as also_pattern from {events}"""
TABLES["b_titles"] = """
    select p_partkey, p_name || ' ' || lower(p_type) || ' | ' || p_brand as title, p_brand, p_size from {part}"""
TABLES["b_meta"] = """
    select o_orderkey as page_id, case o_orderkey % 7 when 0 then '/checkout/step' when 1 then '/cart' when 2 then '/products/x' when 3 then '/p/9' when 4 then '/payment' when 5 then '/collections/all' else '/about' end as path,
           o_custkey % 11 = 0 as has_cc_field, o_custkey % 5 = 0 as has_address, o_custkey % 3 = 0 as has_contact, o_custkey % 4 = 0 as has_postal, o_custkey % 6 = 0 as has_steps, o_orderkey % 3 = 0 as has_quantity, o_orderkey % 4 = 0 as has_remove, o_orderkey % 5 = 0 as has_total,
           o_custkey % 2 = 0 as has_product_ld, o_custkey % 7 = 0 as og_product, case when o_orderkey % 13 = 0 then 1 else 0 end as place_order, o_orderkey % 5 as cart_rows, o_custkey % 4 as summary_rows, o_orderkey % 2 as checkout_cta, o_custkey % 6 as add_to_cart,
           o_orderkey % 8 as booking_cta, case when o_custkey % 17 = 0 then 2 else 0 end as per_unit_rows, o_orderkey % 25 as priced_texts
    from {orders}"""
TABLES["b_controls"] = """
    select l_orderkey as page_id, l_linenumber as idx, 'pdp' as stage, 'body>div' as container_path, case l_partkey % 5 when 0 then 'accept all' when 1 then 'no thanks' when 2 then 'add to cart' when 3 then 'yes, sign me up' else 'not now' end as raw_text,
           cast((l_quantity - 1) * 100 as {DBL}) as area, case when l_suppkey % 2 = 0 then 700 else 400 end as weight, case l_suppkey % 3 when 0 then 'rgb(0, 0, 0)' when 1 then 'rgb(118, 118, 118)' else 'rgb(204, 204, 204)' end as color, 'rgb(255, 255, 255)' as background, 'body>div' || cast(l_linenumber % 2 as {STR}) || '>p' || cast(l_linenumber as {STR}) as selector_path,
           case l_partkey % 4 when 0 then 'wait, before you go' when 1 then 'take 10% off today' when 2 then 'join the waitlist' else 'hold on for free shipping' end as exit_text
    from (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey, min(l_quantity) as l_quantity from {lineitem} group by l_orderkey, l_linenumber) u"""
# markdowns, two nodes a container, some with a saving that is told truly, falsely or not at all
TABLES["b_framing"] = """
    select page_id, idx, 'pdp' as stage, struck, a, b, pct, kind, named, 'body>c>p' || cast(idx as {STR}) as selector_path, 'body>c' as container_path, said as container_text, said as text, said as raw_text
    from (
      select *, case when kind = 4 then 'ship $4.99 ' else '' end || case when named then 'was ' else '' end || '$' || cast(cast(floor(a / 100) as {BIG}) as {STR}) || '.' || lpad(cast(a % 100 as {STR}), 2, '0') || ' now $' || cast(cast(floor(b / 100) as {BIG}) as {STR}) || '.' || lpad(cast(b % 100 as {STR}), 2, '0')
             || case kind when 0 then ' ' || cast(pct as {STR}) || '% off' when 4 then ' save ' || cast(pct as {STR}) || '%' when 1 then ' ' || cast(pct + 7 as {STR}) || '% off' when 2 then ' save $' || cast(cast(floor((a - b) / 100) as {BIG}) as {STR}) || '.' || lpad(cast((a - b) % 100 as {STR}), 2, '0') else '' end as said
      from (
        select cast(floor(p_partkey / 2.0) as {BIG}) as page_id, p_partkey % 2 as idx, p_partkey % 4 = 0 as struck, (p_partkey % 900 + 5) * 100 as a, (p_partkey % 900 + 5) * (100 - (p_partkey * 7 % 17 + 1) * 5) as b, (p_partkey * 7 % 17 + 1) * 5 as pct, p_partkey * 3 % 5 as kind, p_partkey % 3 <> 0 as named from {part}
      ) x
    ) y"""
# ticked inputs: the option's price is in its row, in its container, or nowhere
TABLES["b_inputs"] = """
    select page_id, idx, stage, input_type, checked, touched, group_name, dollars, words, k, case k % 5 when 0 then '' when 1 then words || ' free' when 2 then words || ' $1.00 $2.00' else words || ' ' || price end as row_text,
           case when k % 6 = 0 then '' else words || ' ' || price end as container_text, case when k % 6 = 0 then words else '' end as label, case when k % 12 = 0 then words else words || ' ' || price end as raw_text
    from (
      select l_orderkey as page_id, l_linenumber as idx, case l_partkey % 3 when 0 then 'checkout' when 1 then 'pdp' else 'payment' end as stage, case when l_linenumber % 3 = 0 then 'checkbox' else 'radio' end as input_type, l_partkey % 8 <> 0 as checked, l_partkey % 9 = 0 as touched, case when l_orderkey % 10 = 0 then '' else 'g' end as group_name,
             cast(l_quantity as {BIG}) as dollars, l_suppkey as k, '$' || cast(cast(l_quantity as {BIG}) as {STR}) || '.00' as price,
             case l_partkey % 5 when 0 then 'protection plan' when 1 then 'ship to multiple addresses' when 2 then 'remember me and insurance' when 3 then 'leave a tip' else 'express shipping' end as words
      from """ + ONE_LINE + """ u
    ) n"""
