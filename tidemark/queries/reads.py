"""Entity reads: nesting, keys, spans, semi joins, bridges, gaps, orphans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import reads as R
from tidemark.operators.rank import best_per_group, latest_per_channel, survivor_per_group
from tidemark.functions.text import canonical_page_id
from tidemark.queries.registry import ADS, EVENTS, LIFETIME, ORGANIC, PAGES, SEARCH, query
from tidemark.sources import tables as T


@query(
    "a2_orders_with_children",
    """SELECT o_orderkey AS id, c_name AS customer, COALESCE(n, 0) AS products, first_product, last_product FROM orders
    LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN (SELECT l_orderkey, CAST(COUNT(*) AS INT) AS n, MIN(l_partkey) AS first_product, MAX(l_partkey) AS last_product FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def orders_with_children(spark, folder):
    orders = T.table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    lines = T.table(spark, folder, "lineitem").select("l_orderkey", F.col("l_partkey").alias("product_id"), "l_quantity")
    customers = T.table(spark, folder, "customer").select("c_custkey", F.col("c_name").alias("customer"))
    expanded = R.expand_children(orders, "o_custkey", customers, "c_custkey")
    nested = R.nest_in_parts(expanded, "id", lines, "l_orderkey", "products")
    products = F.transform("products", lambda p: p["product_id"])
    return nested.groupBy("id", "customer").agg(
        F.sum(F.coalesce(F.size(products), F.lit(0))).cast("int").alias("products"),
        F.min(F.array_min(products)).alias("first_product"),
        F.max(F.array_max(products)).alias("last_product"),
    )


@query(
    "a2_children_in_parts",
    """WITH l AS (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 7 AS part FROM orders)
    SELECT c_custkey AS id, CAST(part AS INT) AS part, CAST(part * 7 AS BIGINT) AS before, COUNT(o_orderkey) AS orders, MIN(o_orderkey) AS first_order, MAX(o_orderkey) AS last_order
    FROM customer LEFT JOIN l ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
)
def children_in_parts(spark, folder):
    """Customers with their orders, at most seven to a row, in order."""
    customers = T.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    orders = T.table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    nested = R.nest_in_parts(customers, "id", orders, "o_custkey", "orders", at_most=7)
    numbers = F.transform("orders", lambda o: o["o_orderkey"])
    return nested.select(
        "id",
        F.col("orders_part").alias("part"),
        F.col("orders_before").alias("before"),
        F.coalesce(F.size(numbers), F.lit(0)).cast("bigint").alias("orders"),
        F.array_min(numbers).alias("first_order"),
        F.array_max(numbers).alias("last_order"),
    )


@query(
    "a2_facts_with_entities",
    f"""WITH {ADS} SELECT p_name AS ad, s_name AS ad_group, n_name AS account, COUNT(*) AS facts FROM ad
    LEFT JOIN part ON ad = p_partkey LEFT JOIN supplier ON ad_group = s_suppkey LEFT JOIN nation ON acc = n_nationkey GROUP BY 1, 2, 3""".replace("p_name AS ad,", "p_name AS ad,"),
)
def facts_with_entities(spark, folder):
    wide = R.facts_with_entities(T.ads_star(spark, folder), ["ad", "adGroup", "account"])
    return wide.groupBy(
        F.col("ad.name").alias("ad"), F.col("adGroup.name").alias("ad_group"), F.col("account.name").alias("account")
    ).agg(F.count("*").alias("facts"))


@query(
    "c12_denormalised_configs",
    f"""WITH {EVENTS}, c AS (SELECT DISTINCT name, acc, k FROM ev)
    SELECT name, c_name AS account_label, COUNT(*) AS configs FROM c LEFT JOIN customer ON acc = c_custkey GROUP BY 1, 2""",
)
def denormalised_configs(spark, folder):
    configs = R.denormalised_configs(T.normal_event_star(spark, folder))
    return configs.groupBy("name", "account_label").agg(F.count("*").alias("configs"))


@query("a6_table_preview", "SELECT event_id AS id, event_type, value FROM events ORDER BY event_id DESC LIMIT 500")
def table_preview(spark, folder):
    events = T.table(spark, folder, "events").select(F.col("event_id").alias("id"), "event_type", "value")
    return R.latest_rows(events)


@query(
    "b18_key_lookup",
    """SELECT c_custkey AS id, c_name AS name, 'acc-' || c_custkey AS platform_id FROM customer WHERE 'acc-' || c_custkey IN ('acc-7', 'acc-70')""",
)
def key_lookup(spark, folder):
    accounts = T.entities(spark, folder)["channeled_accounts"]
    return R.by_key(accounts, {"platform_id": ["acc-7", "acc-70"]}).select("id", "name", "platform_id")


@query(
    "b18_json_key_lookup",
    "SELECT c_custkey AS id, c_mktsegment = 'BUILDING' AS found FROM customer WHERE c_mktsegment = 'BUILDING'",
)
def json_key_lookup(spark, folder):
    campaigns = T.entities(spark, folder)["channeled_campaigns"]
    return R.by_key(campaigns, {"data.objective": "BUILDING"}).select("id", F.lit(True).alias("found"))


@query("b18_key_exists", "SELECT COUNT(*) > 0 AS exists FROM customer WHERE c_name = 'Customer#000000007'")
def key_exists(spark, folder):
    return R.exists(T.entities(spark, folder)["channeled_accounts"], {"name": "Customer#000000007"})


@query(
    "b21_pages_by_metric",
    f"WITH {ORGANIC}, {PAGES} SELECT id, url FROM pg WHERE id IN (SELECT page_id FROM og WHERE name = 'likes' AND value > 200)",
)
def pages_by_metric(spark, folder):
    pages = T.entities(spark, folder)["pages"].select("id", "url")
    return R.pages_by_metric(pages, T.organic_facts(spark, folder), "likes", 200.0, ">")


@query(
    "b22_pages_by_campaign",
    f"WITH {ORGANIC}, {PAGES} SELECT id, url FROM pg WHERE id IN (SELECT page_id FROM og WHERE acc IN (3, 4))",
)
def pages_by_campaign(spark, folder):
    pages = T.entities(spark, folder)["pages"].select("id", "url")
    return R.pages_by_campaign(pages, T.organic_facts(spark, folder), [3, 4], "channeled_account_id")


def _page_accounts(spark, folder):
    pages = T.table(spark, folder, "pages").select("page_id", F.expr("page_id % 25").alias("account_id"), "url")
    accounts = T.table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("long").alias("account_id"), F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("channel")
    )
    return pages, accounts


@query(
    "b25_pages_of_channel",
    "SELECT page_id, url FROM pages WHERE page_id % 25 IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
)
def pages_of_channel(spark, folder):
    pages, accounts = _page_accounts(spark, folder)
    return R.pages_of_channel(pages, accounts, "Region_2").select("page_id", "url")


@query("b25_pages_of_unknown_channel", "SELECT page_id, url FROM pages")
def pages_of_unknown_channel(spark, folder):
    pages, accounts = _page_accounts(spark, folder)
    return R.pages_of_channel(pages, accounts, "nowhere", in_aggregate=True).select("page_id", "url")


@query(
    "c4_semi_join_on_dimension",
    f"WITH {ADS} SELECT name, COUNT(*) AS facts FROM ad WHERE gender IS NOT NULL GROUP BY name",
)
def semi_join_on_dimension(spark, folder):
    facts = T.ads_facts(spark, folder)
    return facts.filter(F.map_contains_key("dims", F.lit("gender"))).groupBy("name").agg(F.count("*").alias("facts"))


@query(
    "c5_excluded_dimension_sets",
    """WITH f AS (SELECT l_quantity AS value, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_returnflag || l_linestatus END AS s,
      CASE WHEN l_returnflag = 'A' THEN 'query' WHEN l_returnflag = 'R' THEN 'device' ELSE 'age' END AS key FROM lineitem),
      sets AS (SELECT DISTINCT s AS set_id, key FROM f WHERE s IS NOT NULL)
    SELECT s AS dimension_set_id, COUNT(*) AS facts FROM f WHERE s NOT IN (SELECT set_id FROM sets WHERE key IN ('query', 'country', 'device')) GROUP BY s""",
)
def excluded_dimension_sets(spark, folder):
    from tidemark.operators.weighted import keep_requested_dimension_sets

    key = F.when(F.col("l_returnflag") == "A", "query").when(F.col("l_returnflag") == "R", "device").otherwise("age")
    in_set = F.col("l_linenumber") != 1
    facts = T.table(spark, folder, "lineitem").select(
        F.when(in_set, F.concat("l_returnflag", "l_linestatus")).alias("dimension_set_id"),
        F.when(in_set, F.create_map(key, F.col("l_linestatus"))).alias("dims"),
    )
    kept = keep_requested_dimension_sets(facts, [], facts)
    return kept.groupBy("dimension_set_id").agg(F.count("*").alias("facts"))


@query("c10_order_product_bridge", "SELECT DISTINCT l_orderkey AS order_id, l_partkey AS product_id FROM lineitem")
def order_product_bridge(spark, folder):
    lines = T.table(spark, folder, "lineitem")
    return R.distinct_pairs(lines, F.col("l_orderkey"), F.col("l_partkey"), ("order_id", "product_id"))


@query("d13_count_with_filter", "SELECT COUNT(*) AS count FROM events WHERE event_type = 'click'")
def count_with_filter(spark, folder):
    return R.count_rows(T.table(spark, folder, "events"), {"event_type": "click"})


@query("d14_date_span", f"WITH {EVENTS} SELECT MIN(d) AS min_date, MAX(d) AS max_date FROM ev WHERE name = 'clicks' AND acc = 5")
def date_span(spark, folder):
    return R.date_span(T.event_facts(spark, folder), {"name": "clicks", "channeled_account_id": 5})


@query("d15_last_loaded_day", f"WITH {EVENTS} SELECT channel, acc AS channeled_account_id, MAX(d) AS last_day FROM ev GROUP BY 1, 2")
def last_loaded_day(spark, folder):
    return R.last_loaded_day(T.event_facts(spark, folder))


@query("d15_last_loaded_day_of_page", f"WITH {SEARCH} SELECT 'search' AS channel, page AS page_id, MAX(d) AS last_day FROM se GROUP BY 2")
def last_loaded_day_of_page(spark, folder):
    return R.last_loaded_day(T.search_facts(spark, folder), "page_id")


@query("d16_distinct_days", f"WITH {EVENTS} SELECT DISTINCT d AS metric_date FROM ev")
def distinct_days(spark, folder):
    return R.distinct_days(T.event_facts(spark, folder))


@query("d17_duplicate_groups", "SELECT l_orderkey, COUNT(*) AS count FROM lineitem GROUP BY 1 HAVING COUNT(*) > 1")
def duplicate_groups(spark, folder):
    return R.duplicate_groups(T.table(spark, folder, "lineitem"), "l_orderkey")


@query(
    "f6_latest_row_by_platform_id",
    """SELECT event_type AS channel, platform_id, value FROM (SELECT *, CAST(event_id AS VARCHAR) AS platform_id,
    row_number() OVER (PARTITION BY event_type ORDER BY length(CAST(event_id AS VARCHAR)) DESC, CAST(event_id AS VARCHAR) DESC) AS rn FROM events) WHERE rn = 1""",
)
def latest_row_by_platform_id(spark, folder):
    rows = T.table(spark, folder, "events").select(
        F.col("event_type").alias("channel"), F.col("event_id").cast("string").alias("platform_id"), "value"
    )
    return latest_per_channel(rows)


@query("f6_latest_row_by_time", "SELECT event_type AS channel, MAX(ts) AS platform_created_at FROM events GROUP BY 1")
def latest_row_by_time(spark, folder):
    rows = T.table(spark, folder, "events").select(F.col("event_type").alias("channel"), F.col("ts").alias("platform_created_at"))
    return latest_per_channel(rows, "platform_created_at")


_SURVIVORS = """keyed AS (SELECT page_id AS id, url, regexp_replace(url, '^https?://([^/]+).*$', '\\1') AS host FROM pages),
    best AS (SELECT host, id AS survivor_id FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY length(url) DESC, id) AS rn FROM keyed) WHERE rn = 1)"""


@query(
    "f7_survivor_of_duplicates",
    f"WITH {_SURVIVORS} SELECT k.host, k.id AS duplicate_id, b.survivor_id FROM keyed k JOIN best b ON k.host = b.host WHERE k.id <> b.survivor_id",
)
def survivor_of_duplicates(spark, folder):
    pages = T.table(spark, folder, "pages").select(
        F.col("page_id").alias("id"), "url", F.regexp_replace("url", r"^https?://([^/]+).*$", "$1").alias("host")
    )
    return survivor_per_group(pages, "host")


@query(
    "h1_missing_days",
    """WITH seen AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events),
    days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-06', DATE '2024-02-03', INTERVAL 1 DAY)) AS DATE) AS d)
    SELECT u.user_id, days.d AS missing_day FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN days ANTI JOIN seen s ON s.user_id = u.user_id AND s.d = days.d""",
)
def missing_days(spark, folder):
    facts = T.table(spark, folder, "events").select("user_id", F.to_date("ts").alias("metric_date"))
    return R.missing_days(facts, "2024-02-04", 30, by=("user_id",))


@query(
    "h2_new_keys",
    "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45)",
)
def new_keys(spark, folder):
    from tidemark.ingest.merge import new_keys as fresh

    parts = T.table(spark, folder, "part").select(F.col("p_partkey").alias("id"))
    sold = T.table(spark, folder, "lineitem").filter("l_returnflag = 'A' AND l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return fresh(parts, sold, ["id"])


@query(
    "h5_orphans",
    """SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AND c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error')""",
)
def orphans(spark, folder):
    customers = T.table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    orders, events = T.table(spark, folder, "orders").filter("o_totalprice > 400000"), T.table(spark, folder, "events").filter("event_type = 'error'")
    users = [(orders, "o_custkey"), (events, "user_id")]
    return R.orphans(customers, "id", users)


@query(
    "h5_without_orphans",
    """SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)""",
)
def without_orphans(spark, folder):
    parts = T.table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return R.without_orphans(parts, "id", [(T.table(spark, folder, "lineitem").filter("l_quantity > 49"), "l_partkey")])


@query(
    "i17_dimension_rows",
    f"WITH {ADS}, s AS (SELECT DISTINCT gender || age AS dimension_set_id, gender, age FROM ad) SELECT dimension_set_id, 'gender' AS dimension_key, gender AS dimension_value FROM s UNION ALL SELECT dimension_set_id, 'age', age FROM s",
)
def dimension_rows(spark, folder):
    sets = T.ads_facts(spark, folder).groupBy("dimension_set_id").agg(F.any_value("dims").alias("dims"))
    return R.dimension_rows(sets)
