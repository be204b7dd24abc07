"""Independent DuckDB SQL for each named query, over the raw test tables.

Written from the query definitions, not from the Spark code: plain joins, GROUP BY,
``row_number`` windows and CASE expressions.  Three conventions make exact comparison
possible:

* money sums are taken over the shortest decimal text of each amount with 18 places and cast
  to double (``XSUM``): independent of the summation order, and of the places that the Spark
  side keeps;
* rounding goes through the shortest decimal text of the double (``R2``): Spark rounds
  that text half up (263.59499999999997 -> 263.59), while DuckDB's own ``round`` works
  on the binary value;
* DuckDB's day of week counts from 0 = Sunday, Spark's from 1 = Sunday.
"""

from __future__ import annotations


def _round_text(x: str, places: int) -> str:
    return f"round(CAST(CAST(CAST(({x}) AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18)), {places})"


def R2(x: str) -> str:
    return f"CAST({_round_text(x, 2)} AS DOUBLE)"


def R6(x: str) -> str:
    return f"CAST({_round_text(x, 6)} AS DOUBLE)"


def XSUM(x: str) -> str:
    return f"CAST(sum(CAST(CAST(CAST(({x}) AS DOUBLE) AS VARCHAR) AS DECIMAL(38,18))) AS DOUBLE)"


def XAVG(x: str) -> str:
    return f"({XSUM(x)} / CAST(count({x}) AS DOUBLE))"


def _R3(x: str) -> str:
    return f"CAST({_round_text(x, 3)} AS DOUBLE)"


_DISCOUNT = f"""CASE WHEN (l_orderkey + l_partkey) % 31 <> 0
                     THEN CAST({_round_text("l_extendedprice * l_discount", 2)} AS DOUBLE) END"""

def _coordinate(sign: str, whole: int, places: int) -> str:
    text = f"'{sign}' || CAST(o % {whole} AS VARCHAR) || '.' || lpad(CAST(o % {10**places} AS VARCHAR), {places}, '0')"
    return f"CAST(round(CAST({text} AS DECIMAL(12,6)), 2) AS DOUBLE)"


MODEL = {
    "m_ab": """
SELECT c_custkey AS customer_id,
       CASE WHEN c_custkey % 11 = 5 THEN 'variant_b' WHEN c_custkey % 2 = 0 THEN 'target' ELSE 'control' END AS is_target
FROM (SELECT c_custkey FROM customer UNION ALL SELECT c_custkey + 10000000 FROM customer WHERE c_custkey % 50 = 7)""",
    "m_consumer": """
SELECT c_custkey AS customer_id, c_acctbal >= 0 AS active,
       TIMESTAMP '2020-01-01 00:00:00' + to_days(CAST(c_custkey % 1000 AS INTEGER)) AS created_at
FROM customer""",
    "m_restaurant": """
SELECT s_suppkey AS id, s_acctbal >= 0 AS enabled, CAST(1 + s_suppkey % 3 AS INTEGER) AS price_range,
       s_acctbal AS average_ticket, n_name AS merchant_city, r_name AS merchant_state,
       TIMESTAMP '2020-01-01 00:00:00' + to_days(CAST(s_suppkey % 500 AS INTEGER)) AS created_at,
       CASE WHEN s_suppkey % 8 > 0 THEN CAST(s_suppkey % 90 AS INTEGER) END AS delivery_time,
       CAST(s_suppkey % 40 AS DOUBLE) AS minimum_order_value
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "m_items": f"""
SELECT l_orderkey, l_suppkey, CAST(l_partkey AS VARCHAR) AS name, {_DISCOUNT} AS discount,
       CAST(l_quantity AS VARCHAR) AS quantity
FROM lineitem""",
    "m_lines": """
SELECT l_orderkey, min(l_suppkey) + CASE WHEN l_orderkey % 10 = 9 THEN 10000000 ELSE 0 END AS merchant_id,
       count(*) AS item_count, coalesce(sum(CAST(discount AS DECIMAL(18,2))), 0) AS discount_sum,
       CASE WHEN count(discount) = count(*) THEN sum(CAST(discount AS DECIMAL(18,2))) END AS strict_sum,
       string_agg(concat_ws(':', name, coalesce(CAST(discount AS VARCHAR), '-'), quantity), '|'
                  ORDER BY concat_ws(':', name, coalesce(CAST(discount AS VARCHAR), '-'), quantity)) AS items
FROM m_items GROUP BY l_orderkey""",
    "m_orders_a": f"""
SELECT o_orderkey AS order_id,
       CASE WHEN o_orderkey % 400 = 0 THEN NULL WHEN o_orderkey % 50 = 7 THEN o_custkey + 10000000
            ELSE o_custkey END AS customer_id,
       l.merchant_id, {_R3("o_totalprice + (o_orderkey % 7) * CAST(0.001 AS DOUBLE)")} AS order_total_amount,
       o_orderdate AS order_created_at, o_orderpriority = '1-URGENT' AS order_scheduled,
       l.item_count, l.discount_sum, l.strict_sum, l.items
FROM orders LEFT JOIN m_lines l ON o_orderkey = l.l_orderkey""",
    "m_orders_b": f"""
SELECT CASE WHEN event_id % 20 = 1 THEN event_id - 1 ELSE event_id END AS order_id,
       user_id * 10 + CAST(json_extract_string(props, '$.k') AS INTEGER) % 10
         + CASE WHEN event_id % 50 = 7 THEN 10000000 ELSE 0 END AS customer_id,
       {_R3("value + (event_id % 7) * CAST(0.001 AS DOUBLE)")} AS order_total_amount,
       ts AS order_created_at, event_type = 'signup' AS order_scheduled
FROM events""",
    "m_typed": f"""
SELECT lpad(CAST(customer_id AS VARCHAR), 11, '0') AS cpf, CAST(customer_id AS VARCHAR) AS customer_id,
       'customer ' || CAST(customer_id AS VARCHAR) AS customer_name,
       'city ' || CAST(o % 30 AS VARCHAR) AS delivery_address_city, 'BR' AS delivery_address_country,
       CASE WHEN o % 3 > 0 THEN 'district ' || CAST(o % 7 AS VARCHAR) END AS delivery_address_district,
       CAST(o * 7 AS VARCHAR) AS delivery_address_external_id,
       CASE WHEN o % 90 <> 0 THEN {_coordinate('-', 60, 3)} END AS delivery_address_latitude,
       {_coordinate('', 180, 2)} AS delivery_address_longitude, 'S' || CAST(o % 27 AS VARCHAR) AS delivery_address_state,
       lpad(CAST(o % 99999 AS VARCHAR), 8, '0') AS delivery_address_zip_code, items,
       CAST(merchant_id AS VARCHAR) AS merchant_id, {_coordinate('', 45, 4)} AS merchant_latitude,
       {_coordinate('-', 99, 1)} AS merchant_longitude,
       CASE WHEN o % 101 <> 7 THEN order_created_at END AS order_created_at, CAST(o AS VARCHAR) AS order_id,
       ['ANDROID', 'IOS', 'DESKTOP'][1 + o % 3] AS origin_platform,
       CASE WHEN o % 4 = 0 THEN order_created_at + INTERVAL 1 DAY END AS order_scheduled_date,
       CASE WHEN o % 67 <> 0 THEN order_scheduled END AS order_scheduled,
       CASE WHEN o % 77 <> 0 THEN order_total_amount END AS order_total_amount
FROM (SELECT *, order_id AS o FROM m_orders_a) WHERE o % 97 <> 5""",
    "m_x_a": """
SELECT p.*, c.active, c.created_at AS customer_created_at, ab.is_target AS ab_group
FROM m_orders_a p
LEFT JOIN m_consumer c ON p.customer_id = c.customer_id
LEFT JOIN m_ab ab ON p.customer_id = ab.customer_id
LEFT JOIN m_restaurant r ON p.merchant_id = r.id""",
    "m_abt_a": """
SELECT p.*, ab.is_target AS ab_group, c.active, c.created_at AS customer_created_at,
       r.created_at AS merchant_created_at, r.delivery_time AS merchant_delivery_time,
       r.minimum_order_value AS merchant_minimum_order_value, r.enabled AS merchant_enabled, r.price_range AS merchant_price_range,
       r.average_ticket AS merchant_average_ticket, r.merchant_city, r.merchant_state
FROM m_orders_a p
LEFT JOIN m_consumer c ON p.customer_id = c.customer_id
INNER JOIN m_ab ab ON p.customer_id = ab.customer_id
LEFT JOIN m_restaurant r ON p.merchant_id = r.id
WHERE p.customer_id IS NOT NULL""",
    "m_abt_b": """
SELECT p.*, ab.is_target AS ab_group, c.active
FROM m_orders_b p
LEFT JOIN m_consumer c ON p.customer_id = c.customer_id
INNER JOIN m_ab ab ON p.customer_id = ab.customer_id
WHERE p.customer_id IS NOT NULL""",
}
MODEL_DEPS = {
    "m_lines": ["m_items"],
    "m_orders_a": ["m_lines"],
    "m_typed": ["m_orders_a"],
    "m_x_a": ["m_orders_a", "m_consumer", "m_ab", "m_restaurant"],
    "m_abt_a": ["m_orders_a", "m_consumer", "m_ab", "m_restaurant"],
    "m_abt_b": ["m_orders_b", "m_consumer", "m_ab"],
}

_DAYPART = """CASE WHEN hour(order_created_at) >= 0 AND hour(order_created_at) < 6 THEN 'late_night'
     WHEN hour(order_created_at) >= 6 AND hour(order_created_at) < 12 THEN 'morning'
     WHEN hour(order_created_at) >= 12 AND hour(order_created_at) < 14 THEN 'lunch'
     WHEN hour(order_created_at) >= 14 AND hour(order_created_at) < 18 THEN 'afternoon'
     ELSE 'evening' END"""
_DOW = "CAST(dayofweek(order_created_at) + 1 AS INTEGER)"
_DAYTYPE = f"""CASE WHEN {_DOW} IN (1, 7) OR ({_DOW} = 6 AND hour(order_created_at) >= 18)
     THEN 'weekend' ELSE 'weekday' END"""
_VALID = "customer_id IS NOT NULL AND order_id IS NOT NULL AND order_created_at IS NOT NULL"

_CUSTOMER_METRICS = f"""
SELECT customer_id, count(DISTINCT order_id) AS order_count, {XSUM('order_total_amount')} AS revenue,
       avg(CAST(order_scheduled AS DOUBLE)) AS scheduled_share, min(ab_group) AS ab_group
FROM {{abt}} GROUP BY customer_id"""


def _dominant(label_expr: str, name: str, count_expr: str) -> str:
    return f"""
SELECT customer_id, {name} FROM (
  SELECT customer_id, {name}, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, {name} ASC) AS rn
  FROM (SELECT customer_id, {label_expr} AS {name}, {count_expr} AS n
        FROM m_abt_b WHERE {_VALID} GROUP BY 1, 2)
) WHERE rn = 1"""


def _segment_report(segment: str) -> str:
    rev = XSUM("revenue")
    return f"""
SELECT {segment}, ab_group,
       count(DISTINCT customer_id) AS customer_count,
       CAST(sum(order_count) AS BIGINT) AS order_count,
       {R2(rev)} AS revenue,
       {R2(f'{rev} / count(DISTINCT customer_id)')} AS revenue_per_customer,
       {R2(f'{rev} / sum(order_count)')} AS avg_ticket,
       {R2('avg(scheduled_share)')} AS avg_scheduled_share
FROM seg GROUP BY {segment}, ab_group"""


def _top(column: str) -> str:
    return f"""
SELECT customer_id, {column}, n AS order_rows FROM (
  SELECT customer_id, {column}, count(*) AS n, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, {column}) AS place
  FROM m_abt_a WHERE customer_id IS NOT NULL AND {column} IS NOT NULL GROUP BY customer_id, {column}
) WHERE place = 1"""


_FEATURES = f"""
SELECT customer_id, order_count, revenue, avg_ticket, last_order_at, first_order_at, ab_group, active_days,
       CASE WHEN order_count > 1 THEN active_days / (order_count - 1) END AS avg_days_between_orders
FROM (
  SELECT customer_id, count(DISTINCT order_id) AS order_count,
         {XSUM('order_total_amount')} AS revenue, {XAVG('order_total_amount')} AS avg_ticket,
         max(order_created_at) AS last_order_at, min(order_created_at) AS first_order_at,
         min(ab_group) AS ab_group,
         CAST(datediff('day', min(order_created_at), max(order_created_at)) AS INTEGER) AS active_days
  FROM m_abt_a GROUP BY customer_id)"""
_CLUSTER_INPUT = """
SELECT customer_id, order_count, revenue, avg_ticket, avg_days_between_orders, ab_group FROM features
WHERE customer_id IS NOT NULL AND order_count IS NOT NULL AND revenue IS NOT NULL
  AND avg_ticket IS NOT NULL AND avg_days_between_orders IS NOT NULL"""
_LABELLED = "SELECT *, CAST(customer_id % 4 AS INTEGER) AS cluster FROM cluster_input"
_PROFILES = f"""
SELECT cluster, CASE WHEN big THEN 'big_spender' WHEN pos = 1 THEN 'occasional'
                     WHEN pos = n THEN 'loyal' ELSE 'regular' END AS profile
FROM (
  SELECT cluster, big,
         row_number() OVER (PARTITION BY big ORDER BY mean_orders, cluster) AS pos,
         count(*) OVER (PARTITION BY big) AS n
  FROM (
    SELECT cluster, mean_orders,
           row_number() OVER (ORDER BY mean_revenue DESC, cluster) = 1 AS big
    FROM (SELECT cluster, avg(order_count) AS mean_orders, {XAVG('revenue')} AS mean_revenue
          FROM labelled GROUP BY cluster)))"""


def _means(key: str, source: str) -> str:
    return f"""
SELECT {key}, {R2('avg(order_count)')} AS mean_order_count, {R2(XAVG('revenue'))} AS mean_revenue,
       {R2('avg(avg_ticket)')} AS mean_avg_ticket, {R2('avg(avg_days_between_orders)')} AS mean_days_between_orders
FROM {source} GROUP BY {key}"""


# Query-local CTEs (name -> SQL) and the final SELECT, per query.
_PROFILE_CTES = [("features", _FEATURES), ("cluster_input", _CLUSTER_INPUT), ("labelled", _LABELLED)]
_WITH_PROFILES = [
    *_PROFILE_CTES,
    ("profiles", _PROFILES),
    ("named", "SELECT l.*, p.profile FROM labelled l LEFT JOIN profiles p USING (cluster)"),
]

_PROFILE_COUNTS = ("pc", "SELECT profile, count(*) AS customer_count FROM named GROUP BY profile")
_PROFILE_SHARES = f"""
SELECT profile, customer_count, {R2('customer_count / sum(customer_count) OVER () * 100')} AS customer_pct FROM pc"""
_GROUPS = ("cg", "SELECT customer_id, min(ab_group) AS ab_group FROM m_abt_a GROUP BY customer_id")
_GROUP_SUMMARY = f"""
SELECT profile, cg.ab_group, count(DISTINCT customer_id) AS customer_count,
       {R2(XSUM('revenue'))} AS revenue, {R2(XAVG('revenue'))} AS mean_revenue,
       {R2('avg(avg_ticket)')} AS mean_avg_ticket, {R2('avg(order_count)')} AS mean_order_count
FROM (SELECT * EXCLUDE (ab_group) FROM named) n LEFT JOIN cg USING (customer_id)
WHERE cg.ab_group IS NOT NULL AND profile IS NOT NULL
GROUP BY profile, cg.ab_group"""
_POINT_FEATURES = ["order_count", "revenue", "avg_ticket", "avg_days_between_orders"]


def _away(p: str, c: str) -> str:
    return "(" + " + ".join(f"({p}[{i}] - {c}[{i}]) * ({p}[{i}] - {c}[{i}])" for i in range(1, 5)) + ")"


def _exact_kmeans(k: int = 4, most_steps: int = 300, grid: int = 10_000, candidates: int = 12) -> list[tuple[str, str]]:
    """CTEs up to ``fitted``: the clustered customers with their label, by Lloyd's steps in whole numbers."""

    def whole(f: str) -> str:
        z = f"CASE WHEN stddev_pop({f}) OVER () = 0 THEN 0.0 ELSE ({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () END"
        return f"CAST(floor(({z}) * {grid} + 0.5) AS BIGINT)"

    ctes = [
        ("features", _FEATURES),
        ("cluster_input", _CLUSTER_INPUT),
        ("pts AS MATERIALIZED", f"SELECT *, [{', '.join(whole(f) for f in _POINT_FEATURES)}] AS p FROM cluster_input"),
        (
            "drawn",
            f"""SELECT p AS x, row_number() OVER (ORDER BY md5(CAST(customer_id AS VARCHAR)), customer_id) AS place
                FROM pts QUALIFY place <= {candidates}""",
        ),
        ("seeds0", "SELECT CAST([] AS BIGINT[][]) AS c"),
    ]
    nearest = f"list_min(list_transform(c, lambda y: {_away('p', 'y')}))"
    for i in range(1, k + 1):
        # the least of a number and the NULL of no seed is the number
        ctes.append((
            f"seeds{i}",
            f"""SELECT list_append(any_value(c), any_value(x)) AS c FROM seeds{i - 1}, pts, drawn
                GROUP BY place ORDER BY sum(least({nearest}, {_away('p', 'x')})), place LIMIT 1""",
        ))
    mean = "[" + ", ".join(
        f"CAST((sum(p[{i}]) - ((sum(p[{i}]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)" for i in range(1, 5)
    ) + "]"
    shift = " + ".join(_away(f"moved[{j}]", f"c[{j}]") for j in range(1, k + 1))
    moved = "[" + ", ".join(f"coalesce(any_value(m) FILTER (j = {j}), any_value(c)[{j}])" for j in range(1, k + 1)) + "]"
    away = f"list_transform(c, lambda x: {_away('p', 'x')})"
    ctes.append((
        "steps(n, c, shift) AS",
        f"""SELECT 0, c, CAST(1000000000 AS BIGINT) FROM seeds{k}
            UNION ALL
            SELECT n + 1, moved, CAST({shift} AS BIGINT) FROM (
              SELECT n, any_value(c) AS c, {moved} AS moved FROM (
                SELECT n, any_value(c) AS c, j, {mean} AS m FROM (
                  SELECT n, c, p, list_position({away}, list_min({away})) AS j
                  FROM steps, pts WHERE n < {most_steps} AND shift > {grid * grid // 10_000}
                ) GROUP BY n, j
              ) GROUP BY n)""",
    ))
    ctes.append(("centres", "SELECT c FROM steps ORDER BY n DESC LIMIT 1"))
    ctes.append((
        "fitted AS MATERIALIZED",
        f"""SELECT pts.*, CAST(list_position({away}, list_min({away})) - 1 AS INTEGER) AS cluster,
                   list_min({away}) AS away FROM pts, centres""",
    ))
    return ctes


_FITTED = [*_exact_kmeans(), ("labelled", "SELECT * EXCLUDE (p, away) FROM fitted")]
_FITTED_PROFILES = [*_FITTED, *_WITH_PROFILES[-2:]]


QUERIES: dict[str, tuple[list[str], list[tuple[str, str]], str]] = {
    "exploratory_join": (
        ["m_x_a"],
        [],
        """SELECT order_id, customer_id, merchant_id, order_total_amount, order_created_at, order_scheduled, items,
                  customer_created_at, active, ab_group FROM m_x_a""",
    ),
    "abt": (["m_abt_a"], [], "SELECT * EXCLUDE (item_count, discount_sum, strict_sum) FROM m_abt_a"),
    "typed_orders": (
        ["m_typed"],
        [],
        """SELECT t.* FROM (SELECT order_id FROM m_orders_a) o
           LEFT JOIN m_typed t ON t.order_id = CAST(o.order_id AS VARCHAR)""",
    ),
    "typed_items": (
        ["m_items", "m_orders_a"],
        [],
        """SELECT o.order_id, name, CAST(discount AS VARCHAR) AS discount, quantity
           FROM m_orders_a o JOIN m_items i ON o.order_id = i.l_orderkey""",
    ),
    "silver_restaurant": (
        ["m_restaurant"],
        [],
        "SELECT * REPLACE (CAST(id AS VARCHAR) AS id) FROM m_restaurant",
    ),
    "gold_layer": (
        ["m_typed", "m_ab", "m_consumer", "m_restaurant"],
        [],
        """SELECT t.*, ab.is_target AS ab_group, c.created_at AS customer_created_at, c.active,
                  r.created_at AS merchant_created_at, r.enabled AS merchant_enabled,
                  r.price_range AS merchant_price_range, r.average_ticket AS merchant_average_ticket,
                  r.delivery_time AS merchant_delivery_time, r.minimum_order_value AS merchant_minimum_order_value,
                  r.merchant_city, r.merchant_state
           FROM m_typed t
           JOIN m_ab ab ON t.customer_id = CAST(ab.customer_id AS VARCHAR)
           LEFT JOIN m_consumer c ON t.customer_id = CAST(c.customer_id AS VARCHAR)
           LEFT JOIN m_restaurant r ON t.merchant_id = CAST(r.id AS VARCHAR)""",
    ),
    "quality_malformed": (
        ["m_orders_a"],
        [("w", "SELECT * FROM m_orders_a WHERE order_id % 97 <> 5")],
        """SELECT 'record' AS column_name, count(*) AS value_count,
                  count(*) FILTER (WHERE order_id % 97 = 5) AS lost_count FROM m_orders_a
           UNION ALL SELECT 'items', count(items), 0 FROM w
           UNION ALL SELECT 'delivery_address_latitude', count(*), count(*) FILTER (WHERE order_id % 90 = 0) FROM w
           UNION ALL SELECT 'delivery_address_longitude', count(*), 0 FROM w
           UNION ALL SELECT 'merchant_latitude', count(*), 0 FROM w
           UNION ALL SELECT 'merchant_longitude', count(*), 0 FROM w
           UNION ALL SELECT 'order_created_at', count(*), count(*) FILTER (WHERE order_id % 101 = 7) FROM w
           UNION ALL SELECT 'order_scheduled_date', count(*) FILTER (WHERE order_id % 4 = 0), 0 FROM w
           UNION ALL SELECT 'order_scheduled', count(*), count(*) FILTER (WHERE order_id % 67 = 0) FROM w
           UNION ALL SELECT 'order_total_amount', count(*), count(*) FILTER (WHERE order_id % 77 = 0) FROM w""",
    ),
    "group_order_share": (
        ["m_x_a"],
        [("g", "SELECT ab_group, count(DISTINCT order_id) AS order_count FROM m_x_a GROUP BY ab_group")],
        f"""SELECT ab_group, order_count,
                   {R2('CAST(100.0 AS DOUBLE) * order_count / sum(order_count) OVER ()')} AS order_pct FROM g""",
    ),
    "group_revenue_share": (
        ["m_x_a"],
        [("g", f"SELECT ab_group, {R2(XSUM('order_total_amount'))} AS revenue FROM m_x_a GROUP BY ab_group")],
        f"""SELECT ab_group, revenue,
                   {R2('CAST(100.0 AS DOUBLE) * revenue / CAST(sum(CAST(revenue AS DECIMAL(38,2))) OVER () AS DOUBLE)')}
                   AS revenue_pct FROM g""",
    ),
    "group_summary_raw": (
        ["m_x_a"],
        [],
        f"""SELECT ab_group, count(DISTINCT order_id) AS order_count,
                   {R2(XSUM('order_total_amount'))} AS revenue, {R2(XAVG('order_total_amount'))} AS avg_ticket
            FROM m_x_a GROUP BY ab_group""",
    ),
    "group_kpis": (
        ["m_abt_a"],
        [],
        f"""SELECT ab_group, count(DISTINCT customer_id) AS customer_count, count(DISTINCT order_id) AS order_count,
                   {R2(XSUM('order_total_amount'))} AS revenue, {R2(XAVG('order_total_amount'))} AS avg_ticket,
                   {R2(XSUM('order_total_amount') + ' / count(DISTINCT customer_id)')} AS revenue_per_customer
            FROM m_abt_a WHERE customer_id IS NOT NULL GROUP BY ab_group ORDER BY ab_group""",
    ),
    "group_customers": (
        ["m_abt_a"],
        [],
        "SELECT ab_group, count(DISTINCT customer_id) AS customer_count FROM m_abt_a GROUP BY ab_group",
    ),
    "group_summary_share": (
        ["m_abt_a"],
        [
            (
                "g",
                f"""SELECT ab_group, count(DISTINCT order_id) AS order_count,
                           count(DISTINCT customer_id) AS customer_count,
                           {R2(XSUM('order_total_amount'))} AS revenue, {R2(XAVG('order_total_amount'))} AS avg_ticket
                    FROM m_abt_a GROUP BY ab_group""",
            )
        ],
        f"""SELECT ab_group, customer_count, order_count, revenue, avg_ticket,
                   {R2('CAST(100.0 AS DOUBLE) * order_count / sum(order_count) OVER ()')} AS order_pct,
                   {R2('CAST(100.0 AS DOUBLE) * revenue / CAST(sum(CAST(revenue AS DECIMAL(38,2))) OVER () AS DOUBLE)')}
                   AS revenue_pct
            FROM g""",
    ),
    "orders_per_customer": (
        ["m_abt_a"],
        [],
        f"""SELECT ab_group, count(DISTINCT order_id) AS order_count, count(DISTINCT customer_id) AS customer_count,
                   {R2('count(DISTINCT order_id) / count(DISTINCT customer_id)')} AS orders_per_customer
            FROM m_abt_a GROUP BY ab_group""",
    ),
    "order_discounts": (
        ["m_orders_a"],
        [],
        """SELECT order_id, CAST(item_count AS INTEGER) AS item_count, CAST(discount_sum AS DOUBLE) AS order_discount
           FROM m_orders_a""",
    ),
    "order_discounts_strict": (
        ["m_orders_a"],
        [],
        """SELECT order_id, CAST(item_count AS INTEGER) AS item_count, CAST(strict_sum AS DOUBLE) AS order_discount
           FROM m_orders_a""",
    ),
    "total_discount_strict": (
        ["m_abt_a"],
        [],
        "SELECT CAST(sum(strict_sum) AS DOUBLE) AS total_discount FROM m_abt_a",
    ),
    "total_discount": (
        ["m_abt_a"],
        [],
        "SELECT CAST(sum(discount_sum) AS DOUBLE) AS total_discount FROM m_abt_a",
    ),
    "campaign_viability": (
        ["m_abt_a"],
        [
            (
                "b",
                f"""SELECT ab_group, count(DISTINCT order_id) AS n, count(DISTINCT customer_id) AS c,
                           {XSUM('order_total_amount')} AS v FROM m_abt_a GROUP BY ab_group""",
            ),
            (
                "w",
                """SELECT max(CASE WHEN ab_group = 'target' THEN n END) AS tn,
                          max(CASE WHEN ab_group = 'target' THEN c END) AS tc,
                          max(CASE WHEN ab_group = 'target' THEN v END) AS tv,
                          max(CASE WHEN ab_group = 'control' THEN n END) AS cn,
                          max(CASE WHEN ab_group = 'control' THEN c END) AS cc,
                          max(CASE WHEN ab_group = 'control' THEN v END) AS cv
                   FROM b""",
            ),
        ],
        f"""SELECT tn AS target_order_count, tc AS target_customer_count, {R2('tv')} AS target_revenue,
                   {R2('tv / tn')} AS target_avg_ticket, {R2('tv / tc')} AS target_revenue_per_customer,
                   cn AS control_order_count, cc AS control_customer_count, {R2('cv')} AS control_revenue,
                   {R2('cv / cn')} AS control_avg_ticket, {R2('cv / cc')} AS control_revenue_per_customer,
                   {R2('tv - cv')} AS incremental_revenue,
                   {R2('tv / tc - cv / cc')} AS incremental_revenue_per_customer,
                   {R2('(tv / tc - cv / cc) * tc')} AS incremental_revenue_estimated,
                   {R2('10.0::DOUBLE * tn')} AS campaign_cost,
                   {R2('(tv - cv) - 10.0::DOUBLE * tn')} AS net_total,
                   {R2('(tv / tc - cv / cc) * tc - 10.0::DOUBLE * tn')} AS net_per_customer
            FROM w""",
    ),
    "customer_metrics": (["m_abt_b"], [], _CUSTOMER_METRICS.format(abt="m_abt_b")),
    "order_daypart": (
        ["m_abt_b"],
        [],
        f"""SELECT customer_id, order_id, order_created_at, order_total_amount, order_scheduled, ab_group,
                   CAST(hour(order_created_at) AS INTEGER) AS order_hour, {_DAYPART} AS daypart
            FROM m_abt_b WHERE {_VALID}""",
    ),
    "dominant_daypart": (["m_abt_b"], [], _dominant(_DAYPART, "daypart", "count(*)")),
    "daypart_report": (
        ["m_abt_b"],
        [
            ("cm", _CUSTOMER_METRICS.format(abt="m_abt_b")),
            ("dom", _dominant(_DAYPART, "daypart", "count(*)")),
            ("seg", "SELECT cm.*, dom.daypart FROM cm LEFT JOIN dom USING (customer_id)"),
        ],
        _segment_report("daypart"),
    ),
    "order_daytype": (
        ["m_abt_b"],
        [],
        f"""SELECT customer_id, order_id, order_total_amount, order_scheduled, order_created_at, ab_group,
                   {_DOW} AS day_of_week, CAST(hour(order_created_at) AS INTEGER) AS order_hour,
                   {_DAYTYPE} AS day_type
            FROM m_abt_b WHERE {_VALID}""",
    ),
    "dominant_daytype": (["m_abt_b"], [], _dominant(_DAYTYPE, "day_type", "count(order_id)")),
    "daytype_report": (
        ["m_abt_b"],
        [
            ("cm", _CUSTOMER_METRICS.format(abt="m_abt_b")),
            ("dom", _dominant(_DAYTYPE, "day_type", "count(order_id)")),
            ("seg", "SELECT cm.*, dom.day_type FROM cm LEFT JOIN dom USING (customer_id)"),
        ],
        _segment_report("day_type"),
    ),
    "customer_price_range": (
        ["m_abt_a"],
        [],
        """SELECT customer_id, avg(merchant_price_range) AS avg_price_range
           FROM (SELECT DISTINCT customer_id, merchant_id, merchant_price_range FROM m_abt_a
                 WHERE merchant_price_range IS NOT NULL)
           GROUP BY customer_id""",
    ),
    "price_tier": (
        ["m_abt_a"],
        [
            (
                "p",
                """SELECT customer_id, avg(merchant_price_range) AS avg_price_range
                   FROM (SELECT DISTINCT customer_id, merchant_id, merchant_price_range FROM m_abt_a
                         WHERE merchant_price_range IS NOT NULL)
                   GROUP BY customer_id""",
            )
        ],
        """SELECT customer_id, avg_price_range,
                  CASE WHEN avg_price_range <= 1.5 THEN 'budget' WHEN avg_price_range <= 2.5 THEN 'mid'
                       ELSE 'premium' END AS price_tier FROM p""",
    ),
    "price_tier_report": (
        ["m_abt_a"],
        [
            ("cm", _CUSTOMER_METRICS.format(abt="m_abt_a")),
            (
                "p",
                """SELECT customer_id, avg(merchant_price_range) AS avg_price_range
                   FROM (SELECT DISTINCT customer_id, merchant_id, merchant_price_range FROM m_abt_a
                         WHERE merchant_price_range IS NOT NULL)
                   GROUP BY customer_id""",
            ),
            (
                "t",
                """SELECT customer_id, CASE WHEN avg_price_range <= 1.5 THEN 'budget'
                                            WHEN avg_price_range <= 2.5 THEN 'mid' ELSE 'premium' END AS price_tier
                   FROM p""",
            ),
            ("seg", "SELECT cm.*, t.price_tier FROM cm LEFT JOIN t USING (customer_id)"),
        ],
        _segment_report("price_tier"),
    ),
    "quality_missing_consumer": (
        ["m_orders_a", "m_ab", "m_consumer"],
        [
            (
                "t",
                """SELECT customer_id, 1 AS o, 0 AS a, 0 AS c FROM m_orders_a
                   UNION ALL SELECT customer_id, 0, 1, 0 FROM m_ab
                   UNION ALL SELECT customer_id, 0, 0, 1 FROM m_consumer""",
            ),
            (
                "p",
                """SELECT customer_id, max(o) AS o, max(a) AS a, max(c) AS c FROM t
                   WHERE customer_id IS NOT NULL GROUP BY customer_id""",
            ),
        ],
        """SELECT CAST(sum(o) AS BIGINT) AS order_customers,
                  CAST(sum(CASE WHEN o = 1 AND c = 0 THEN 1 ELSE 0 END) AS BIGINT) AS order_customers_missing_consumer,
                  CAST(sum(a) AS BIGINT) AS ab_customers,
                  CAST(sum(CASE WHEN a = 1 AND c = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ab_customers_missing_consumer,
                  CAST(sum(CASE WHEN (o = 1 OR a = 1) AND c = 0 THEN 1 ELSE 0 END) AS BIGINT)
                       AS known_customers_missing_consumer,
                  CAST(sum(c) AS BIGINT) AS consumer_customers
           FROM p""",
    ),
    "quality_null_customer": (
        ["m_orders_a"],
        [
            (
                "g",
                f"""SELECT count(*) AS order_rows,
                           count(*) FILTER (WHERE customer_id IS NULL) AS null_customer_rows,
                           count(DISTINCT order_id) AS order_count,
                           count(DISTINCT CASE WHEN customer_id IS NULL THEN order_id END) AS null_customer_orders,
                           {XSUM('order_total_amount')} AS revenue,
                           {XSUM('CASE WHEN customer_id IS NULL THEN order_total_amount END')}
                               AS null_customer_revenue
                    FROM m_orders_a""",
            )
        ],
        f"""SELECT *, {R2('CAST(100.0 AS DOUBLE) * null_customer_orders / order_count')} AS null_order_pct,
                      {R2('CAST(100.0 AS DOUBLE) * null_customer_revenue / revenue')} AS null_revenue_pct
            FROM g""",
    ),
    "quality_repeated_orders": (
        ["m_orders_b"],
        [],
        """SELECT order_id, count(*) AS row_count, count(DISTINCT customer_id) AS distinct_customer_id,
                  count(DISTINCT order_created_at) AS distinct_order_created_at
           FROM m_orders_b GROUP BY order_id
           HAVING count(DISTINCT customer_id) > 1 OR count(DISTINCT order_created_at) > 1""",
    ),
    "quality_duplicate_keys": (
        ["m_consumer", "m_ab", "m_restaurant"],
        [
            ("k1", "SELECT customer_id, count(*) AS n FROM m_consumer GROUP BY customer_id"),
            ("k2", "SELECT customer_id, count(*) AS n FROM m_ab GROUP BY customer_id"),
            ("k3", "SELECT id, count(*) AS n FROM m_restaurant GROUP BY id"),
        ],
        """SELECT 'consumer' AS table_name, CAST(sum(n) AS BIGINT) AS row_count, count(*) AS key_count,
                  count(*) FILTER (WHERE n > 1) AS duplicated_keys FROM k1
           UNION ALL
           SELECT 'ab_test_ref', CAST(sum(n) AS BIGINT), count(*), count(*) FILTER (WHERE n > 1) FROM k2
           UNION ALL
           SELECT 'restaurant', CAST(sum(n) AS BIGINT), count(*), count(*) FILTER (WHERE n > 1) FROM k3""",
    ),
    "latest_order": (
        ["m_orders_b"],
        [],
        """SELECT order_id, customer_id, order_total_amount, order_created_at, order_scheduled FROM (
             SELECT *, row_number() OVER (
                 PARTITION BY order_id
                 ORDER BY order_created_at DESC NULLS LAST, customer_id DESC NULLS LAST,
                          order_total_amount DESC NULLS LAST, order_scheduled DESC NULLS LAST) AS rn
             FROM m_orders_b) WHERE rn = 1""",
    ),
    "customer_features": (["m_abt_a"], [], _FEATURES),
    "cluster_input": (["m_abt_a"], [("features", _FEATURES)], _CLUSTER_INPUT),
    "scaled_features": (
        ["m_abt_a"],
        [("features", _FEATURES), ("cluster_input", _CLUSTER_INPUT)],
        "SELECT customer_id, "
        + ", ".join(
            f"{R6(f'CASE WHEN stddev_pop({f}) OVER () = 0 THEN 0.0 ELSE ({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () END')} AS z_{f}"
            for f in ["order_count", "revenue", "avg_ticket", "avg_days_between_orders"]
        )
        + " FROM cluster_input",
    ),
    "cluster_means": (["m_abt_a"], _PROFILE_CTES, _means("cluster", "labelled")),
    "cluster_sizes": (
        ["m_abt_a"],
        _PROFILE_CTES,
        "SELECT cluster, count(*) AS customer_count FROM labelled GROUP BY cluster ORDER BY cluster",
    ),
    "cluster_profiles": (["m_abt_a"], [*_PROFILE_CTES, ("profiles", _PROFILES)], "SELECT * FROM profiles"),
    "profile_means": (["m_abt_a"], _WITH_PROFILES, _means("profile", "named")),
    "profile_shares": (
        ["m_abt_a"],
        [*_WITH_PROFILES, _PROFILE_COUNTS],
        _PROFILE_SHARES,
    ),
    "customer_clusters": (["m_abt_a"], _FITTED, "SELECT * FROM labelled"),
    "cluster_centres": (
        ["m_abt_a"],
        _FITTED,
        """SELECT CAST(number AS INTEGER) AS cluster, count(away) AS customer_count, any_value(x)[1] AS centre_order_count,
                  any_value(x)[2] AS centre_revenue, any_value(x)[3] AS centre_avg_ticket,
                  any_value(x)[4] AS centre_avg_days_between_orders, CAST(coalesce(sum(away), 0) AS BIGINT) AS inertia
           FROM (SELECT unnest(c) AS x, unnest(range(len(c))) AS number FROM centres)
           LEFT JOIN fitted ON cluster = number GROUP BY number""",
    ),
    "fitted_cluster_means": (["m_abt_a"], _FITTED, _means("cluster", "labelled")),
    "fitted_cluster_profiles": (["m_abt_a"], [*_FITTED, ("profiles", _PROFILES)], "SELECT * FROM profiles"),
    "fitted_profile_shares": (["m_abt_a"], [*_FITTED_PROFILES, _PROFILE_COUNTS], _PROFILE_SHARES),
    "customer_groups": (
        ["m_abt_a"],
        [],
        "SELECT customer_id, min(ab_group) AS ab_group FROM m_abt_a GROUP BY customer_id",
    ),
    "kmeans_checks": (
        ["m_abt_a"],
        [("features", _FEATURES), ("cluster_input", _CLUSTER_INPUT)],
        """SELECT 'customers_given' AS check_name, count(*) AS value FROM cluster_input
           UNION ALL SELECT 'customers_labelled', count(*) FROM cluster_input
           UNION ALL SELECT 'customers_given_with_group', count(ab_group) FROM cluster_input
           UNION ALL SELECT 'customers_with_group', count(ab_group) FROM cluster_input
           UNION ALL SELECT 'clusters_with_customers', 4
           UNION ALL SELECT 'customers_of_no_cluster', 0
           UNION ALL SELECT 'customers_nearer_to_another_centre', 0""",
    ),
    "customer_group": (
        ["m_abt_a"],
        [
            ("features", _FEATURES),
            ("cluster_input", _CLUSTER_INPUT),
            ("cg", "SELECT customer_id, min(ab_group) AS ab_group FROM m_abt_a GROUP BY customer_id"),
        ],
        """SELECT cg.ab_group, count(*) AS customer_count
           FROM cluster_input c JOIN cg USING (customer_id) WHERE cg.ab_group IS NOT NULL GROUP BY cg.ab_group""",
    ),
    "profile_group_summary": (["m_abt_a"], [*_WITH_PROFILES, _GROUPS], _GROUP_SUMMARY),
    "fitted_profile_group_summary": (["m_abt_a"], [*_FITTED_PROFILES, _GROUPS], _GROUP_SUMMARY),
    "undeclared_fields": (
        ["m_orders_a"],
        [("w", "SELECT order_id AS o FROM m_orders_a WHERE order_id % 97 <> 5")],
        """SELECT 'app_version' AS field_name, count(*) AS value_count, 'STRING' AS value_type FROM w WHERE o % 3 = 0
           UNION ALL SELECT 'loyalty', count(*), 'OBJECT<tier: BIGINT>' FROM w WHERE o % 10 = 4
           UNION ALL SELECT 'courier_id', count(*), 'BIGINT' FROM w WHERE o % 5 = 2""",
    ),
    "undeclared_item_fields": (
        [],
        [("i", "SELECT l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey")],
        """SELECT 'line' AS field_name, count(*) AS value_count, 'BIGINT' AS value_type FROM i WHERE p % 5 = 0
           UNION ALL SELECT 'tags', count(*), 'ARRAY<STRING>' FROM i WHERE p % 9 = 0""",
    ),
    "item_states": (
        ["m_orders_a"],
        [],
        """SELECT CASE WHEN item_count IS NULL THEN 'absent' ELSE 'items' END AS items_state, count(*) AS order_rows,
                  CAST(coalesce(sum(item_count), 0) AS BIGINT) AS item_count
           FROM m_orders_a GROUP BY 1""",
    ),
    "sql_abt_period": (
        ["m_abt_a"],
        [],
        """SELECT * EXCLUDE (item_count, discount_sum, strict_sum) FROM m_abt_a
           WHERE order_created_at >= TIMESTAMP '1996-01-01' AND order_created_at < TIMESTAMP '1996-04-01'""",
    ),
    "gold_month_rewrite": (
        ["m_abt_a"],
        [("g", "SELECT *, coalesce(strftime(order_created_at, '%Y-%m'), 'none') AS order_month FROM m_abt_a")],
        f"""SELECT order_month, count(*) AS row_count, order_month = '1995-03' AS rewritten,
                   {R2(XSUM("CASE WHEN order_month = '1995-03' THEN 2 * order_total_amount ELSE order_total_amount END"))}
                   AS revenue
            FROM g GROUP BY order_month""",
    ),
    "top_merchant": (["m_abt_a"], [], _top("merchant_id")),
    "top_city": (["m_abt_a"], [], _top("merchant_city")),
}



def _ordered(name: str, order: str) -> tuple[list[str], list[tuple[str, str]], str]:
    """The query of ``name`` with each row's number in the given order."""
    models, local, final = QUERIES[name]
    rows = [*local, ("ordered_rows", final)]
    return models, rows, f"SELECT CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS position, * FROM ordered_rows"


_QUARTER = "(SELECT * FROM m_abt_a WHERE strftime(order_created_at, '%Y-%m') IN ('1996-01', '1996-02', '1996-03'))"
#: Queries that reach a result another way: the same SQL.
QUERIES |= {
    "ordered_group_kpis": _ordered("group_kpis", "ab_group"),
    "ordered_daypart_report": _ordered("daypart_report", "daypart NULLS FIRST, ab_group NULLS FIRST"),
    "ordered_cluster_sizes": _ordered("cluster_sizes", "cluster"),
    "sql_exploratory_join": QUERIES["exploratory_join"],
    "sql_abt": QUERIES["abt"],
    "abt_shuffled": QUERIES["abt"],
    "catalog_gold": QUERIES["gold_layer"],
    "typed_items_variant": QUERIES["typed_items"],
    "bitmap_group_kpis": QUERIES["group_kpis"],
    "bitmap_group_customers": QUERIES["group_customers"],
    "bitmap_group_summary_share": QUERIES["group_summary_share"],
    "bitmap_orders_per_customer": QUERIES["orders_per_customer"],
    "bitmap_campaign_viability": QUERIES["campaign_viability"],
    "bitmap_quarter_kpis": (["m_abt_a"], [], QUERIES["group_kpis"][2].replace("m_abt_a", _QUARTER)),
    "quality_observed": (
        *QUERIES["quality_malformed"][:2],
        QUERIES["quality_malformed"][2]
        + """ UNION ALL SELECT 'customer_id', count(*), count(*) FILTER (WHERE customer_id IS NULL OR order_id % 97 = 5)
             FROM m_orders_a""",
    ),
    "streamed_latest_order": (
        ["m_orders_b"],
        [("latest", QUERIES["latest_order"][2])],
        """SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(customer_id AS VARCHAR) AS customer_id, order_total_amount,
                  order_created_at, order_scheduled FROM latest""",
    ),
}


def _model_closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for dep in MODEL_DEPS.get(n, []):
            visit(dep)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def sql(name: str) -> str:
    models, local, final = QUERIES[name]
    ctes = [(m, MODEL[m]) for m in _model_closure(models)] + list(local)
    with_clause = ",\n".join(f"{n if ' AS' in n else n + ' AS'} ({body}\n)" for n, body in ctes)
    # a CTE that names its columns is one that reads itself
    start = "WITH RECURSIVE" if any("(" in n for n, _ in ctes) else "WITH"
    return f"{start} {with_clause}\n{final}" if ctes else final


def all_sql() -> dict[str, str]:
    return {name: sql(name) for name in QUERIES}
