"""Loads of metrics and entities, and merges into stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.keys import surrogate_id
from tidemark.ingest import commerce, entities, merge, metrics
from tidemark.ingest.storage import MetricStore
from tidemark.ingest.versions import VersionedStore
from tidemark.operators.rank import survivor_per_group
from tidemark.operators.normalise import normalise_metrics
from tidemark.functions.text import canonical_page_id
from tidemark.queries.reads import _SURVIVORS
from tidemark.queries.registry import EVENTS, query
from tidemark.session import shared_folder, staged
from tidemark.sources import tables as T
from tidemark.streaming.incremental import follow_files, read_merged

DAY_KEYS = ["user_id", "event_type", "day"]


def _daily_values(spark, folder):
    events = T.table(spark, folder, "events")
    return events.select("user_id", "event_type", F.to_date("ts").alias("day"), "value", "event_id")


@query(
    "j1_last_write_wins",
    """SELECT user_id, event_type, day, value, event_id FROM (SELECT *, CAST(ts AS DATE) AS day,
    row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def last_write_wins(spark, folder):
    return merge.last_write_wins(_daily_values(spark, folder), DAY_KEYS, "event_id")


_HALVES = """old AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, MAX(value) AS value, MIN(event_id) AS event_id FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY ALL),
    new AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, MAX(value) + 1 AS value, MIN(event_id) AS event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL)"""


def _halves(spark, folder):
    """Two overlapping loads: before the 20th, and from the 10th on."""
    values = _daily_values(spark, folder)

    def daily(part, extra):
        return part.groupBy(*DAY_KEYS).agg((F.max("value") + extra).alias("value"), F.min("event_id").alias("event_id"))

    old = daily(values.filter(F.col("day") < F.lit("2024-01-20").cast("date")), 0)
    new = daily(values.filter(F.col("day") >= F.lit("2024-01-10").cast("date")), 1)
    return old, new


@query(
    "j2_insert_ignore",
    f"WITH {_HALVES} SELECT user_id, event_type, day, R(COALESCE(o.value, n.value)) AS value, COALESCE(o.event_id, n.event_id) AS event_id FROM old o FULL JOIN new n USING (user_id, event_type, day)",
)
def insert_ignore(spark, folder):
    old, new = _halves(spark, folder)
    return merge.insert_ignore(old, new, DAY_KEYS, "event_id")


@query(
    "j3_upsert",
    f"WITH {_HALVES} SELECT user_id, event_type, day, R(COALESCE(n.value, o.value)) AS value, COALESCE(o.event_id, n.event_id) AS event_id FROM old o FULL JOIN new n USING (user_id, event_type, day)",
)
def upsert(spark, folder):
    old, new = _halves(spark, folder)
    return merge.upsert(old, new, DAY_KEYS, ["value"])


@query(
    "j4_merge_largest",
    f"WITH {_HALVES} SELECT user_id, event_type, day, R(GREATEST(COALESCE(o.value, n.value), COALESCE(n.value, o.value))) AS value, COALESCE(o.event_id, n.event_id) AS event_id FROM old o FULL JOIN new n USING (user_id, event_type, day)",
)
def merge_largest(spark, folder):
    old, new = _halves(spark, folder)
    return merge.merge_largest(old, new, DAY_KEYS)


def _metric_batch(spark, folder):
    rows = T.table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.to_date("ts").cast("string").alias("date"),
        F.get_json_object("props", "$.k").alias("k"),
        F.concat(F.lit("acc-"), F.col("user_id").cast("string")).alias("account"),
        F.when(F.col("event_type") == "click", F.col("value")).alias("cost"),
        F.when(F.col("event_type") == "view", F.lit(1.0)).alias("shown"),
    )
    long = normalise_metrics(rows, "ads", {"cost": "spend", "shown": "impressions"}, dimensions=["k"], metadata_fields=["id"])
    account = F.get_json_object("data", "$.account")
    batch = long.withColumns({"channeled_account": account, "sequence": F.col("platform_id").cast("bigint")})
    return metrics.signature_of(batch)


_BATCH = """b AS (SELECT event_id, user_id, CAST(ts AS DATE) AS d, json_extract_string(props, '$.k') AS k,
    CASE event_type WHEN 'click' THEN 'spend' ELSE 'impressions' END AS name, CASE event_type WHEN 'click' THEN value ELSE 1 END AS value
    FROM events WHERE event_type IN ('click', 'view'))"""


@query(
    "j5_metric_configs",
    f"WITH {_BATCH}, c AS (SELECT DISTINCT name, user_id, k FROM b) SELECT name, user_id AS channeled_account_id, 'daily' AS period, COUNT(*) AS configs FROM c GROUP BY 1, 2",
)
def metric_configs(spark, folder):
    """Configs of a batch with the account resolved to its key."""
    batch = _metric_batch(spark, folder)
    accounts = T.entities(spark, folder)["channeled_accounts"]
    resolved = metrics.resolve_keys(batch, {"channeled_account": (accounts, "platform_id")})
    configs = metrics.config_rows(resolved)
    known = configs.withColumn(
        "channeled_account_id", F.coalesce("channeled_account_id", F.lit(None).cast("bigint"))
    )
    return known.groupBy("name", "channeled_account_id", "period").agg(F.count("*").alias("configs"))


@query(
    "j5_resolved_keys",
    "SELECT o_orderkey, c_custkey AS customer_id FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0",
)
def resolved_keys(spark, folder):
    """References no entity answers to stay NULL."""
    orders = T.table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"))
    customers = T.table(spark, folder, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("platform_id")
    )
    return metrics.resolve_keys(orders, {"customer": (customers, "platform_id")}).drop("customer")


@query(
    "c11_keys_by_channel",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN c_custkey ELSE c_custkey + 1000000 END AS channeled_account_id FROM events LEFT JOIN customer ON user_id = c_custkey""",
)
def keys_by_channel(spark, folder):
    """Two channels know the same platform ids, one of them twice; each reference finds its own."""
    customer = T.table(spark, folder, "customer")
    platform = F.concat(F.lit("acc-"), F.col("c_custkey").cast("string")).alias("platform_id")
    known = [customer.select((F.col("c_custkey") + extra).alias("id"), F.lit(channel).alias("channel"), platform) for channel, extra in (("a", 0), ("b", 1_000_000), ("a", 2_000_000))]
    accounts = known[0].unionByName(known[1]).unionByName(known[2])
    batch = T.table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_type") == "click", "a").otherwise("b").alias("channel"),
        F.concat(F.lit("acc-"), F.col("user_id").cast("string")).alias("channeled_account"),
    )
    return metrics.resolve_keys(batch, {"channeled_account": (accounts, "platform_id")}).select("event_id", "channeled_account_id")


@query("j14_creatives", "SELECT p_brand AS creative_id, arg_max(p_name, p_partkey) AS name, arg_max(p_type, p_partkey) AS data FROM part GROUP BY 1")
def creatives(spark, folder):
    rows = T.table(spark, folder, "part").select(F.col("p_brand").alias("platform_id"), F.col("p_name").alias("name"), F.col("p_type").alias("data"), F.col("p_partkey").alias("sequence"))
    return entities.load_creatives(rows).select("creative_id", "name", "data")


@query(
    "j14_ads_by_channel",
    """SELECT 'o' || o_orderkey AS platform_id, CASE WHEN o_orderstatus = 'F' THEN 'x' ELSE 'y' END AS channel,
    CASE WHEN o_orderstatus = 'F' THEN c_nationkey ELSE c_nationkey + 100 END AS channeled_account_id, CASE WHEN o_orderstatus = 'F' THEN c_custkey ELSE c_custkey + 1000000 END AS channeled_ad_group_id
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def ads_by_channel(spark, folder):
    """Ad groups of two channels share their platform ids; ads take the account of their own."""
    customer = T.table(spark, folder, "customer")

    def groups(channel, extra, nation):
        return customer.select(
            (F.col("c_custkey") + extra).alias("id"),
            F.lit(channel).alias("channel"),
            F.concat(F.lit("g"), F.col("c_custkey").cast("string")).alias("platform_id"),
            (F.col("c_nationkey").cast("bigint") + nation).alias("channeled_account_id"),
            F.lit(None).cast("bigint").alias("channeled_campaign_id"),
        )

    batch = T.table(spark, folder, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "x").otherwise("y").alias("channel"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("platform_id"),
        F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("ad_group_ref"),
        *[F.lit(None).cast("string").alias(c) for c in ("creative_ref", "name", "status", "data")],
        F.col("o_orderkey").alias("sequence"),
    )
    ads = entities.load_ads(batch, groups("x", 0, 0).unionByName(groups("y", 1_000_000, 100)))
    return ads.select("platform_id", "channel", "channeled_account_id", "channeled_ad_group_id")


@query(
    "j6_provenance_payloads",
    """SELECT 'u' || user_id AS platform_id, event_type AS channel, arg_max(value, event_id) AS last_value, COUNT(*) > 0 AS found, arg_max(json_extract_string(props, '$.k'), event_id) AS k FROM events GROUP BY 1, 2""",
)
def provenance_payloads(spark, folder):
    """Payloads of one platform row merge key by key, the last one winning."""
    from tidemark.ingest.payloads import merged_payloads

    rows = T.table(spark, folder, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("platform_id"),
        F.col("event_type").alias("channel"),
        F.to_json(F.struct("value", F.get_json_object("props", "$.k").alias("k"))).alias("data"),
        F.col("event_id").alias("sequence"),
    )
    merged = merged_payloads(rows, ["platform_id", "channel"])
    return merged.select(
        "platform_id",
        "channel",
        F.get_json_object("data", "$.value").cast("double").alias("last_value"),
        F.lit(True).alias("found"),
        F.get_json_object("data", "$.k").alias("k"),
    )


@query(
    "j6_array_unions",
    """WITH e AS (SELECT event_type, user_id AS u, MIN(event_id) AS came FROM events GROUP BY 1, 2),
    n AS (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY came) - 1) // 25 AS part FROM e)
    SELECT event_type AS channel, CAST(part AS INT) AS part, COUNT(*) AS size, string_agg(CAST(u AS VARCHAR), ',' ORDER BY came) AS users FROM n GROUP BY 1, 2""",
)
def array_unions_in_parts(spark, folder):
    """The users of each channel in the order in which they came, from payloads with arrays, at most 25 to a row."""
    from tidemark.ingest.payloads import array_unions

    rows = T.table(spark, folder, "events").select(
        F.col("event_type").alias("channel"),
        F.to_json(F.struct(F.array("user_id").alias("users"), F.col("value"))).alias("data"),
        F.col("event_id").alias("sequence"),
    )
    unions = array_unions(rows, ["channel"], at_most=25)
    return unions.select("channel", "part", "size", F.regexp_replace("elements", r"[\[\]]", "").alias("users"))


@query(
    "j7_dimension_sets",
    "SELECT DISTINCT md5('[{\"key\":\"k\",\"value\":\"' || json_extract_string(props, '$.k') || '\"}]') AS hash, json_extract_string(props, '$.k') AS k FROM events",
)
def dimension_sets(spark, folder):
    batch = T.table(spark, folder, "events").select(F.create_map(F.lit("K"), F.get_json_object("props", "$.k")).alias("dims"))
    return metrics.register_dimension_sets(batch).select("hash", F.col("dims")["k"].alias("k"))


@query(
    "j8_metric_load",
    f"""WITH {_BATCH}, f AS (SELECT name, user_id, k, d, value, row_number() OVER (PARTITION BY name, user_id, k, d ORDER BY event_id DESC) AS rn FROM b)
    SELECT name, d AS metric_date, COUNT(*) AS facts, R(SUM(value)) AS total FROM f WHERE rn = 1 GROUP BY 1, 2""",
)
def metric_load(spark, folder):
    """A batch loaded twice into empty tables gives the same facts as once."""
    batch = _metric_batch(spark, folder)
    facts = metrics.fact_rows(batch)
    stored = metrics.load_facts(facts, batch)
    configs = metrics.config_rows(batch).select(F.col("id").alias("metric_config_id"), "name")
    joined = stored.join(configs, "metric_config_id")
    return joined.groupBy("name", "metric_date").agg(F.count("*").alias("facts"), F.sum("value").alias("total"))


@query(
    "j8_load_pipeline",
    f"""WITH {_BATCH}, l AS (SELECT name, user_id, k, d, arg_max(value, event_id) + CASE WHEN d >= DATE '2024-01-10' THEN 1 ELSE 0 END AS value FROM b GROUP BY 1, 2, 3, 4)
    SELECT name, 'acc-' || user_id AS account, k, d AS metric_date, R(value) AS value, 1 AS provenance FROM l""",
)
def load_pipeline(spark, folder):
    """Two overlapping loads into stored tables, the second one repeated, and the tables read back."""
    root = f"{shared_folder(spark)}/metrics-{uuid.uuid4().hex}"
    # Staged, as each load and the names read it.
    batch = staged(_metric_batch(spark, folder), "metrics")
    columns = "id bigint, config_signature string, channel string, name string, period string"
    store = MetricStore(spark, root, columns)
    store.create()
    late = batch.where("metric_date >= DATE '2024-01-10'").withColumn("value", F.col("value") + 1)
    for load, part in (("first", batch.where("metric_date < DATE '2024-01-20'")), ("second", late), ("repeat", late)):
        store.load(part, load)
    names = batch.select(F.col("signature").alias("config_signature"), F.col("channeled_account").alias("account"), F.col("dims")["k"].alias("k")).distinct()
    configs = store.read("configs").join(names, "config_signature").select(F.col("id").alias("metric_config_id"), "name", "account", "k", F.col("config_signature").alias("signature"))
    facts = store.read("facts").join(configs, "metric_config_id")
    metric = surrogate_id(F.concat_ws("|", "signature", "dimensions_hash", F.col("metric_date").cast("string")))
    known = store.read("provenance").select("metric_id").distinct()
    joined = facts.withColumn("metric_id", metric).join(known.withColumn("provenance", F.lit(1)), "metric_id", "left")
    return joined.select("name", "account", "k", "metric_date", "value", "provenance")


_VERSIONED = "id bigint, config_signature string, channel string, name string, period string, channeled_account_id bigint, page_id bigint"


def _versioned(spark, folder):
    """An empty store, a batch with resolved accounts, and what of it comes late with larger values."""
    accounts = T.entities(spark, folder)["channeled_accounts"]
    # Staged, as several loads take parts of it.
    batch = staged(metrics.resolve_keys(_metric_batch(spark, folder), {"channeled_account": (accounts, "platform_id")}), "metrics")
    late = batch.where("metric_date >= DATE '2024-01-10'").withColumn("value", F.col("value") + 1)
    return VersionedStore(spark, f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}", _VERSIONED), batch, late


class _Broken(Exception):
    pass


_LOADED = """(SELECT COUNT(DISTINCT (name, user_id, k)) FROM {0}) AS configs, (SELECT COUNT(*) FROM {0}) AS provenance,
    (SELECT COUNT(DISTINCT user_id) FROM {0}) AS accounts"""


@query(
    "j8_atomic_load",
    f"""WITH {_BATCH}, early AS (SELECT * FROM b WHERE d < DATE '2024-01-20'),
    f AS (SELECT name, user_id, k, d, arg_max(value, event_id) AS value FROM early GROUP BY 1, 2, 3, 4),
    l AS (SELECT name, user_id, k, d, arg_max(value, event_id) + CASE WHEN d >= DATE '2024-01-10' THEN 1 ELSE 0 END AS value FROM b GROUP BY 1, 2, 3, 4)
    SELECT step, (SELECT COUNT(*) FROM f) AS facts, (SELECT R(SUM(value)) FROM f) AS total, {_LOADED.format("early")}
    FROM (VALUES ('batch'), ('configs'), ('facts'), ('provenance'), ('watermarks')) AS s(step)
    UNION ALL SELECT 'done', (SELECT COUNT(*) FROM l), (SELECT R(SUM(value)) FROM l), {_LOADED.format("b")}""",
)
def atomic_load(spark, folder):
    """A load that breaks after each of its steps leaves all tables as they were; the next one changes all at once."""
    store, batch, late = _versioned(spark, folder)
    store.load(batch.where("metric_date < DATE '2024-01-20'"), "first")

    def state(step):
        now = store.version()
        facts = now.read("facts").agg(F.count("*").alias("facts"), F.sum("value").alias("total"))
        marks = now.read("watermarks").agg(F.count_distinct("channeled_account_id").alias("accounts"))
        counts = [now.read(name).agg(F.count("*").alias(name)) for name in ("configs", "provenance")]
        # One row each.
        return facts.select(F.lit(step).alias("step"), "*", *[c.scalar().alias(c.columns[0]) for c in (*counts, marks)])

    seen = None
    for step in ("batch", "configs", "facts", "provenance", "watermarks"):

        def stop(done, at=step):
            if done == at:
                raise _Broken(at)

        try:
            store.load(late, "second", on_step=stop)
        except _Broken:
            seen = state(step) if seen is None else seen.union(state(step))
    store.load(late, "second")
    return seen.union(state("done"))


@query(
    "d15_watermarks",
    f"""WITH {_BATCH} SELECT 'ads' AS channel, user_id AS channeled_account_id, MAX(d) AS last_day FROM b GROUP BY 2""",
)
def watermarks(spark, folder):
    """Largest dates that loads keep by month: early, late and repeated loads, and a channel that is purged again."""
    store, batch, late = _versioned(spark, folder)
    early = batch.where("metric_date < DATE '2024-01-20'")
    other = metrics.signature_of(early.withColumns({"channel": F.lit("other"), "metric_date": F.date_add("metric_date", 60)}))
    for load, part in (("first", early), ("other", other), ("late", late), ("repeat", early)):
        store.load(part, load)
    return store.purge_channel("OTHER", "purge").last_loaded_day()


def _order_batch(spark, folder):
    """Line items as order rows: an order comes once per line."""
    lines = T.table(spark, folder, "lineitem")
    orders = T.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    item = F.struct(F.col("l_partkey").alias("product_id"), F.concat_ws("-", F.col("l_partkey").cast("string"), "l_returnflag").alias("variant_id"))
    sequence = F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")
    return joined.select(
        F.lit("shop").alias("channel"),
        F.col("l_orderkey").cast("string").alias("platform_id"),
        F.col("o_orderdate").alias("platform_created_at"),
        F.struct(
            F.col("o_custkey").cast("string").alias("id"),
            F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.com")).alias("email"),
        ).alias("customer"),
        F.array(F.col("o_orderpriority")).alias("discount_codes"),
        F.array(item).alias("line_items"),
        F.to_json(F.struct(F.array(item).alias("items"), F.col("o_orderpriority").alias("priority"))).alias("data"),
        sequence.alias("sequence"),
    )


@query(
    "j9_order_load",
    """WITH j AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT 'orders' AS table_name, COUNT(DISTINCT l_orderkey) AS n FROM j UNION ALL SELECT 'customers', COUNT(DISTINCT o_custkey) FROM j
    UNION ALL SELECT 'channeled_orders', COUNT(DISTINCT l_orderkey) FROM j UNION ALL SELECT 'channeled_customers', COUNT(DISTINCT o_custkey) FROM j
    UNION ALL SELECT 'channeled_discounts', COUNT(DISTINCT o_orderpriority) FROM j UNION ALL SELECT 'channeled_products', COUNT(DISTINCT l_partkey) FROM j
    UNION ALL SELECT 'channeled_product_variants', COUNT(DISTINCT l_partkey || l_returnflag) FROM j
    UNION ALL SELECT 'order_products', COUNT(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM j)
    UNION ALL SELECT 'order_variants', COUNT(*) FROM (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag FROM j)
    UNION ALL SELECT 'order_discounts', COUNT(DISTINCT l_orderkey) FROM j""",
)
def order_load(spark, folder):
    from tidemark.health.inventory import table_counts

    tables = commerce.load_orders(_order_batch(spark, folder))
    return table_counts(tables).withColumnsRenamed({"table": "table_name", "count": "n"})


@query(
    "j9_order_payloads",
    """WITH i AS (SELECT l_orderkey, COUNT(*) AS items FROM (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag FROM lineitem) GROUP BY 1)
    SELECT CAST(l_orderkey AS VARCHAR) AS platform_id, CAST(items AS INT) AS items, o_orderpriority AS priority FROM i JOIN orders ON l_orderkey = o_orderkey""",
)
def order_payloads(spark, folder):
    """Repeated orders unite their item arrays."""
    orders = commerce.load_orders(_order_batch(spark, folder))["channeled_orders"]
    items = F.json_array_length(F.get_json_object("data", "$.items"))
    return orders.select("platform_id", items.alias("items"), F.get_json_object("data", "$.priority").alias("priority"))


def _product_batch(spark, folder):
    parts = T.table(spark, folder, "part")
    variant = F.struct(
        F.concat_ws("-", F.col("p_partkey").cast("string"), F.col("p_size").cast("string")).alias("id"),
        F.concat(F.lit("sku"), F.col("p_partkey").cast("string")).alias("sku"),
        F.lit("{}").alias("data"),
    )
    category = F.struct(F.lower("p_type").alias("id"), F.to_json(F.struct(F.col("p_type").alias("title"))).alias("data"))
    return parts.select(
        F.lit("shop").alias("channel"),
        F.col("p_partkey").cast("string").alias("platform_id"),
        F.lit(None).cast("timestamp").alias("platform_created_at"),
        F.concat(F.lit("sku"), F.col("p_partkey").cast("string")).alias("sku"),
        F.col("p_brand").alias("vendor"),
        F.array(variant).alias("variants"),
        F.array(category).alias("categories"),
        F.to_json(F.struct(F.col("p_name").alias("title"))).alias("data"),
        F.col("p_partkey").alias("sequence"),
    )


@query(
    "j10_product_load",
    """SELECT p_brand AS vendor, lower(p_type) AS category, COUNT(*) AS products, R(MIN(p_partkey)) AS first_product FROM part GROUP BY 1, 2""",
)
def product_load(spark, folder):
    """Products joined back to their vendor and categories over the loaded ids."""
    tables = commerce.load_products(_product_batch(spark, folder))
    products = tables["channeled_products"].select(F.col("id").alias("pid"), "platform_id", "channeled_vendor_id")
    vendors = tables["channeled_vendors"].select(F.col("id").alias("vid"), F.col("name").alias("vendor"))
    categories = tables["channeled_product_categories"].select(F.col("id").alias("cid"), F.col("platform_id").alias("category"))
    joined = (
        tables["category_products"]
        .join(products, F.col("channeled_product_id") == F.col("pid"))
        .join(vendors, F.col("channeled_vendor_id") == F.col("vid"))
        .join(categories, F.col("channeled_product_category_id") == F.col("cid"))
    )
    return joined.groupBy("vendor", "category").agg(
        F.count("*").alias("products"), F.min(F.col("platform_id").cast("double")).alias("first_product")
    )


@query(
    "j11_customer_load",
    """SELECT 'c' || o_custkey || '@example.com' AS email, COUNT(DISTINCT o_orderpriority) AS addresses, arg_max(o_orderstatus, o_orderkey) AS lead FROM orders GROUP BY 1""",
)
def customer_load(spark, folder):
    """One row per order: a customer's addresses unite, lead data keeps the last."""
    orders = T.table(spark, folder, "orders")
    batch = orders.select(
        F.lit("shop").alias("channel"),
        F.col("o_custkey").cast("string").alias("platform_id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.col("o_orderdate").alias("platform_created_at"),
        F.to_json(F.struct(F.array(F.struct(F.col("o_orderpriority").alias("street"))).alias("addresses"))).alias("data"),
        F.to_json(F.struct(F.col("o_orderstatus").alias("status"))).alias("lead_data"),
        F.col("o_orderkey").alias("sequence"),
    )
    customers = commerce.load_customers(batch)["channeled_customers"]
    return customers.select(
        "email",
        F.json_array_length(F.get_json_object("data", "$.addresses")).cast("bigint").alias("addresses"),
        F.get_json_object("lead_data", "$.status").alias("lead"),
    )


@query(
    "j12_price_rules_and_discounts",
    """SELECT o_orderpriority AS code, CAST(COUNT(DISTINCT o_orderpriority) AS BIGINT) AS discounts, arg_min(o_orderstatus, o_orderkey) AS rule FROM orders GROUP BY 1""",
)
def price_rules(spark, folder):
    """The first row of a code or rule counts."""
    orders = T.table(spark, folder, "orders")
    rows = orders.select(
        F.lit("shop").alias("channel"),
        F.col("o_orderstatus").alias("platform_id"),
        F.col("o_orderpriority").alias("code"),
        F.col("o_orderstatus").alias("price_rule_ref"),
        F.col("o_orderdate").alias("platform_created_at"),
        F.lit("{}").alias("data"),
        F.col("o_orderkey").alias("sequence"),
    )
    rules = commerce.load_price_rules(rows)["channeled_price_rules"].select(F.col("id").alias("rid"), F.col("platform_id").alias("rule"))
    discounts = commerce.load_discounts(rows)["channeled_discounts"]
    joined = discounts.join(rules, F.col("channeled_price_rule_id") == F.col("rid"))
    return joined.groupBy("code").agg(F.count("*").alias("discounts"), F.min("rule").alias("rule"))


@query(
    "j13_category_load",
    "SELECT p_type AS category, COUNT(DISTINCT p_brand) AS brands FROM part GROUP BY 1",
)
def category_load(spark, folder):
    parts = T.table(spark, folder, "part")
    rows = parts.select(
        F.lit("shop").alias("channel"),
        F.col("p_type").alias("platform_id"),
        F.lit(False).alias("is_smart"),
        F.lit(None).cast("timestamp").alias("platform_created_at"),
        F.to_json(F.struct(F.col("p_type").alias("title"))).alias("data"),
        F.col("p_partkey").alias("sequence"),
    )
    collects = parts.select(F.lit("shop").alias("channel"), F.col("p_type").alias("category_ref"), F.col("p_brand").alias("product_ref"))
    tables = commerce.load_categories(rows, collects)
    categories = tables["channeled_product_categories"].select("id", F.get_json_object("data", "$.title").alias("category"))
    joined = tables["category_products"].join(categories, F.col("channeled_product_category_id") == F.col("id"))
    return joined.groupBy("category").agg(F.count("*").alias("brands"))


@query(
    "j14_ads_hierarchy_load",
    """SELECT n_name AS account, c_name AS campaign, COUNT(*) AS ads FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
)
def ads_hierarchy_load(spark, folder):
    """Orders as ads, under an ad group and a campaign per customer."""
    nations = T.table(spark, folder, "nation").select(
        F.lit("ads").alias("channel"),
        F.col("n_nationkey").cast("string").alias("platform_id"),
        F.col("n_name").alias("account"),
        F.col("n_name").alias("name"),
        F.lit("ads").alias("type"),
        F.lit(True).alias("enabled"),
        F.lit("{}").alias("data"),
        F.col("n_nationkey").cast("bigint").alias("sequence"),
    )
    accounts = entities.load_accounts(nations)["channeled_accounts"]
    customer = T.table(spark, folder, "customer")
    campaign_rows = customer.select(
        F.lit("ads").alias("channel"),
        F.col("c_custkey").cast("string").alias("platform_id"),
        F.col("c_name").alias("name"),
        F.lit(None).cast("timestamp").alias("start_date"),
        F.lit(None).cast("timestamp").alias("end_date"),
        F.col("c_nationkey").cast("string").alias("account_ref"),
        F.col("c_acctbal").alias("budget"),
        F.lit("ACTIVE").alias("status"),
        F.lit(None).cast("string").alias("objective"),
        F.lit(None).cast("string").alias("buying_type"),
        F.to_json(F.struct(F.col("c_name").alias("name"))).alias("data"),
        F.col("c_custkey").alias("sequence"),
    )
    campaigns = entities.load_campaigns(campaign_rows, accounts)["channeled_campaigns"]
    group_rows = customer.select(
        F.lit("ads").alias("channel"),
        F.concat(F.lit("g"), F.col("c_custkey").cast("string")).alias("platform_id"),
        F.col("c_nationkey").cast("string").alias("account_ref"),
        F.col("c_custkey").cast("string").alias("campaign_ref"),
        F.col("c_mktsegment").alias("name"),
        F.lit("ACTIVE").alias("status"),
        F.lit("{}").alias("data"),
        F.col("c_custkey").alias("sequence"),
    )
    groups = entities.load_ad_groups(group_rows, accounts, campaigns)
    ad_rows = T.table(spark, folder, "orders").select(
        F.lit("ads").alias("channel"),
        F.col("o_orderkey").cast("string").alias("platform_id"),
        F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("ad_group_ref"),
        F.lit(None).cast("string").alias("creative_ref"),
        F.col("o_orderpriority").alias("name"),
        F.col("o_orderstatus").alias("status"),
        F.lit("{}").alias("data"),
        F.col("o_orderkey").alias("sequence"),
    )
    ads = entities.load_ads(ad_rows, groups)
    named = ads.join(
        campaigns.select(F.col("id").alias("cid"), F.get_json_object("data", "$.name").alias("campaign")),
        F.col("channeled_campaign_id") == F.col("cid"),
    ).join(accounts.select(F.col("id").alias("aid"), F.col("name").alias("account")), F.col("channeled_account_id") == F.col("aid"))
    return named.groupBy("account", "campaign").agg(F.count("*").alias("ads"))


_CANONICAL = "trim(regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://(www\\.)?', ''), '[?#].*$', ''), '[^a-z0-9]+', '_', 'g'), '_')"


@query("j15_page_load", f"SELECT {_CANONICAL} AS canonical_id, arg_max(url, page_id) AS url, 'pg' || MAX(page_id) AS platform_id FROM pages GROUP BY 1")
def page_load(spark, folder):
    rows = T.table(spark, folder, "pages").select(
        "url",
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("hostname"),
        F.concat(F.lit("pg"), F.col("page_id").cast("string")).alias("platform_id"),
        F.lit("{}").alias("data"),
        F.col("page_id").alias("sequence"),
    )
    return entities.load_pages(rows).select("canonical_id", "url", "platform_id")


@query(
    "j15_post_load",
    "SELECT 'e' || event_id AS post_id, c_custkey AS channeled_account_id, page_id FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN pages ON CAST(json_extract_string(props, '$.k') AS BIGINT) = page_id",
)
def post_load(spark, folder):
    rows = T.table(spark, folder, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("post_id"),
        F.concat(F.lit("acc-"), F.col("user_id").cast("string")).alias("account_ref"),
        F.concat(F.lit("pg-"), F.get_json_object("props", "$.k")).alias("page_ref"),
        F.col("props").alias("data"),
        F.col("event_id").alias("sequence"),
    )
    known = T.entities(spark, folder)
    posts = entities.load_posts(rows, known["channeled_accounts"], known["pages"])
    return posts.select("post_id", "channeled_account_id", "page_id")


@query(
    "j16_event_load",
    "SELECT event_type AS name, COUNT(*) AS rows_loaded, COUNT(DISTINCT user_id) AS accounts FROM events WHERE event_type <> '' GROUP BY 1",
)
def event_load(spark, folder):
    rows = T.table(spark, folder, "events").select(
        F.lit("app").alias("channel"),
        F.col("event_id").cast("string").alias("platform_id"),
        F.col("event_type").alias("name"),
        F.concat(F.lit("acc-"), F.col("user_id").cast("string")).alias("account_ref"),
        F.col("props").alias("data"),
        F.col("event_id").alias("sequence"),
    )
    loaded = entities.load_events(rows, T.entities(spark, folder)["channeled_accounts"])
    names = loaded["events"].select(F.col("id").alias("eid"), F.col("name").alias("event"))
    joined = loaded["channeled_events"].join(names, F.col("event_id") == F.col("eid"))
    # Distinct accounts in two steps, each combined map-side.
    per_account = joined.groupBy("event", "channeled_account_id").agg(F.count("*").alias("n"))
    return per_account.groupBy(F.col("event").alias("name")).agg(
        F.sum("n").alias("rows_loaded"), F.count("channeled_account_id").alias("accounts")
    )


@query(
    "j17_merged_duplicates",
    f"""WITH {_SURVIVORS}, m AS (SELECT k.id, b.survivor_id FROM keyed k JOIN best b ON k.host = b.host),
    f AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS page_id, value FROM events)
    SELECT COALESCE(survivor_id, page_id) AS page_id, COUNT(*) AS facts, R(SUM(value)) AS total FROM f LEFT JOIN m ON m.id = page_id GROUP BY 1""",
)
def merged_duplicates(spark, folder):
    pages = T.table(spark, folder, "pages").select(
        F.col("page_id").alias("id"), "url", F.regexp_replace("url", r"^https?://([^/]+).*$", "$1").alias("host")
    )
    survivors = survivor_per_group(pages, "host")
    facts = T.organic_facts(spark, folder).select("page_id", "value")
    moved = merge.repoint(facts, "page_id", survivors)
    return moved.groupBy("page_id").agg(F.count("*").alias("facts"), F.sum("value").alias("total"))


@query(
    "j18_rekeyed_configs",
    """WITH m AS (SELECT event_id AS metric_config_id, user_id, event_type, CAST(ts AS DATE) AS d, value FROM events),
    k AS (SELECT *, MIN(metric_config_id) OVER (PARTITION BY user_id, event_type) AS target FROM m),
    w AS (SELECT *, row_number() OVER (PARTITION BY target, d ORDER BY metric_config_id DESC) AS rn FROM k)
    SELECT target AS metric_config_id, d AS metric_date, R(value) AS value FROM w WHERE rn = 1""",
)
def rekeyed_configs(spark, folder):
    """Every event its own config; configs of one user and type become one."""
    events = T.table(spark, folder, "events")
    configs = events.select(F.col("event_id").alias("id"), "user_id", "event_type", F.lit("old").alias("config_signature"))
    facts = events.select(
        F.col("event_id").alias("metric_config_id"), F.lit("").alias("dimensions_hash"), F.to_date("ts").alias("metric_date"), "value"
    )
    _, duplicates = merge.rekey_configs(configs, F.md5(F.concat_ws("|", F.col("user_id").cast("string"), "event_type")))
    return merge.rekey_metrics(facts, duplicates).drop("dimensions_hash")


@query(
    "j19_channel_purge",
    f"WITH {EVENTS} SELECT name, COUNT(*) AS facts FROM ev WHERE name <> 'clicks' GROUP BY 1",
)
def channel_purge(spark, folder):
    star = T.normal_event_star(spark, folder)
    configs = star.configs.withColumn("channel", F.col("name"))
    facts, kept = merge.purge_channel(star.metrics, configs, "CLICKS")
    joined = facts.join(kept.select(F.col("id").alias("cid"), "name"), F.col("metric_config_id") == F.col("cid"))
    return joined.groupBy("name").agg(F.count("*").alias("facts"))


@query(
    "c7_previous_day",
    """WITH v AS (SELECT user_id, CAST(ts AS DATE) AS d, SUM(value) AS value FROM events GROUP BY 1, 2)
    SELECT t.user_id, t.d AS day, R(t.value) AS value, R(y.value) AS before FROM v t LEFT JOIN v y ON y.user_id = t.user_id AND y.d = t.d - 1""",
)
def previous_day(spark, folder):
    """An exact day-before join, not the row before."""
    daily = T.table(spark, folder, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("value").alias("value"))
    before = daily.select("user_id", F.date_add("day", 1).alias("day"), F.col("value").alias("before"))
    return daily.join(before, ["user_id", "day"], "left")


@query(
    "m1_incremental_load",
    "SELECT user_id, event_type, CAST(ts AS DATE) AS day, R(arg_max(value, event_id)) AS value FROM events GROUP BY 1, 2, 3",
)
def incremental_load(spark, folder):
    """Files followed as a stream into a merged table, in the cluster's shared folder."""
    base = f"{shared_folder(spark)}/incremental-{uuid.uuid4().hex}"
    schema = T.table(spark, folder, "events").schema

    def prepare(batch):
        return batch.select("user_id", "event_type", F.to_date("ts").alias("day"), "value", "event_id")

    stream = follow_files(spark, folder, schema, prepare, DAY_KEYS, f"{base}/facts", f"{base}/progress", glob="events.parquet", sequence="event_id")
    stream.awaitTermination()
    return read_merged(spark, f"{base}/facts", DAY_KEYS)
