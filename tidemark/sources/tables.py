"""The star read from the sample tables.

Each view is a plain select over the parquet files, so filters and column
pruning reach the scan.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.keys import config_signature, dimensions_hash
from tidemark.model import Star

# Metric counted for each event type.
EVENT_METRICS = {
    "view": "impressions",
    "click": "clicks",
    "purchase": "results",
    "signup": "sessions",
    "error": "event_count",
}
ORGANIC_METRICS = {
    "view": "views",
    "click": "likes",
    "purchase": "shares",
    "signup": "follows",
    "error": "comments",
}
CONFIG_SCHEMA = {
    "channeled_account_id": "bigint",
    "channeled_campaign_id": "bigint",
    "channeled_ad_group_id": "bigint",
    "channeled_ad_id": "bigint",
    "page_id": "bigint",
    "query_id": "bigint",
    "post_id": "bigint",
    "country_id": "bigint",
    "device_id": "bigint",
}


# Schemas of the sample tables; naming them spares a footer read.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _choice(column: Column, mapping: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in mapping.items():
        out = F.when(column == key, F.lit(value)).otherwise(out)
    return out


def _nulls(*present: str) -> list[Column]:
    return [F.lit(None).cast(t).alias(n) for n, t in CONFIG_SCHEMA.items() if n not in present]


def event_facts(spark: SparkSession, folder: str) -> DataFrame:
    """One fact per event, and a ``spend`` fact per click; account = user."""
    events = table(spark, folder, "events")
    dims = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"))
    count = F.struct(_choice(F.col("event_type"), EVENT_METRICS).alias("name"), F.lit(1.0).alias("value"))
    spend = F.struct(F.lit("spend").alias("name"), F.col("value").alias("value"))
    facts = F.when(F.col("event_type") == "click", F.array(count, spend)).otherwise(F.array(count))
    exploded = events.select(
        F.to_date("ts").alias("metric_date"),
        F.col("user_id").alias("channeled_account_id"),
        dims.alias("dims"),
        F.get_json_object("props", "$.k").alias("dimension_set_id"),
        F.inline(facts),
    )
    return exploded.select(
        F.lit("events").alias("channel"),
        "name",
        F.lit("daily").alias("period"),
        "value",
        "metric_date",
        "channeled_account_id",
        "dims",
        "dimension_set_id",
        *_nulls("channeled_account_id"),
    )


def organic_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Post-level lifetime counters and page-level daily counters.

    ``signup`` events stand on the page alone; all others on a post of that page.
    """
    events = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    page_level = F.col("event_type") == "signup"
    return events.select(
        F.lit("facebook_organic").alias("channel"),
        _choice(F.col("event_type"), ORGANIC_METRICS).alias("name"),
        F.when(page_level, "daily").otherwise("lifetime").alias("period"),
        F.col("value"),
        F.to_date("ts").alias("metric_date"),
        F.col("user_id").alias("channeled_account_id"),
        k.alias("page_id"),
        F.when(~page_level, k).alias("post_id"),
        F.lit(None).cast("map<string,string>").alias("dims"),
        F.lit(None).cast("string").alias("dimension_set_id"),
        *_nulls("channeled_account_id", "page_id", "post_id"),
    )


def _line_facts(values: list[tuple[str, Column]]) -> Column:
    return F.inline(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in values]))


def ads_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as ad facts: part = ad, supplier = ad group, customer = campaign,
    nation = account; return flag and line status as gender and age."""
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(
        customers, F.col("o_custkey") == F.col("c_custkey"), "left"
    )
    exploded = joined.select(
        F.to_date("l_shipdate").alias("metric_date"),
        F.col("c_nationkey").cast("long").alias("channeled_account_id"),
        F.col("o_custkey").alias("channeled_campaign_id"),
        F.col("l_suppkey").alias("channeled_ad_group_id"),
        F.col("l_partkey").alias("channeled_ad_id"),
        F.create_map(F.lit("gender"), F.col("l_returnflag"), F.lit("age"), F.col("l_linestatus")).alias("dims"),
        F.concat("l_returnflag", "l_linestatus").alias("dimension_set_id"),
        _line_facts(
            [
                ("spend", F.col("l_extendedprice")),
                ("impressions", F.col("l_quantity") * 100),
                ("clicks", F.round(F.col("l_tax") * 100)),
                ("results", F.round(F.col("l_discount") * 100)),
            ]
        ),
    )
    keys = ("channeled_account_id", "channeled_campaign_id", "channeled_ad_group_id", "channeled_ad_id")
    return exploded.select(
        F.lit("ads").alias("channel"), F.lit("daily").alias("period"), exploded["*"], *_nulls(*keys)
    )


def search_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as search facts: part = page, supplier = query, nation unknown.

    ``searchappearance`` is the line status, the device the return flag.
    """
    lines = table(spark, folder, "lineitem")
    exploded = lines.select(
        F.to_date("l_shipdate").alias("metric_date"),
        F.col("l_partkey").alias("page_id"),
        F.col("l_suppkey").alias("query_id"),
        F.ascii("l_returnflag").cast("long").alias("device_id"),
        F.create_map(F.lit("searchappearance"), F.col("l_linestatus")).alias("dims"),
        F.col("l_linestatus").alias("dimension_set_id"),
        _line_facts(
            [
                ("position", F.round(F.col("l_discount") * 100) + 1),
                ("impressions", F.col("l_quantity")),
                ("clicks", F.round(F.col("l_tax") * 100)),
            ]
        ),
    )
    return exploded.select(
        F.lit("search").alias("channel"),
        F.lit("daily").alias("period"),
        exploded["*"],
        *_nulls("page_id", "query_id", "device_id"),
    )


def lifetime_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Running counts per user and event type, one row per day with events.

    The window runs over daily counts, so a user brings at most one row per day
    and type, however many events lie behind them.
    """
    from pyspark.sql import Window

    daily = (
        table(spark, folder, "events")
        .groupBy("user_id", "event_type", F.to_date("ts").alias("metric_date"))
        .agg(F.count("*").alias("n"))
    )
    running = F.sum("n").over(
        Window.partitionBy("user_id", "event_type").orderBy("metric_date").rowsBetween(Window.unboundedPreceding, 0)
    )
    return daily.select(
        F.lit("events").alias("channel"),
        _choice(F.col("event_type"), EVENT_METRICS).alias("name"),
        F.lit("lifetime").alias("period"),
        running.cast("double").alias("value"),
        "metric_date",
        F.col("user_id").alias("channeled_account_id"),
        F.lit(None).cast("map<string,string>").alias("dims"),
        F.lit(None).cast("string").alias("dimension_set_id"),
        *_nulls("channeled_account_id"),
    )


class Entities(Mapping):
    """Entity tables under the names the relations use, each built when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self._read = lambda name: table(spark, folder, name)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in _ENTITIES:
            raise KeyError(name)
        return _ENTITIES[name](self._read)

    def __iter__(self):
        return iter(_ENTITIES)

    def __len__(self) -> int:
        return len(_ENTITIES)


def _channeled_accounts(read) -> DataFrame:
    entity = F.struct(F.concat(F.lit("ent-"), F.col("c_nationkey").cast("string")).alias("platform_id"))
    return read("customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("acc-"), F.col("c_custkey").cast("string")).alias("platform_id"),
        F.lower("c_mktsegment").alias("type"),
        (F.col("c_acctbal") >= 0).alias("enabled"),
        F.to_json(entity).alias("data"),
    )


def _channeled_campaigns(read) -> DataFrame:
    return read("customer").select(
        F.col("c_custkey").alias("id"),
        F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("objective"))).alias("data"),
        F.when(F.col("c_acctbal") >= 0, "ACTIVE").otherwise("PAUSED").alias("status"),
    )


def _title() -> Column:
    return F.regexp_extract("html", r"<title>([^<]*)</title>", 1)


def _pages(read) -> DataFrame:
    return read("pages").select(
        F.col("page_id").alias("id"),
        "url",
        _title().alias("title"),
        F.concat(F.lit("pg-"), F.col("page_id").cast("string")).alias("platform_id"),
    )


def _posts(read) -> DataFrame:
    attributes = F.struct(
        _title().alias("caption"),
        F.lit("2024-01-01").alias("timestamp"),
        F.regexp_extract("url", r"^(https?):", 1).alias("media_type"),
        F.col("url").alias("permalink"),
    )
    return read("pages").select(
        F.col("page_id").alias("id"),
        F.concat_ws("_", F.lit("pg"), F.col("page_id").cast("string")).alias("post_id"),
        F.col("page_id").alias("page_id"),
        F.to_json(attributes).alias("data"),
    )


def _named(name: str, key: str, label: str, output: str = "name"):
    return lambda read: read(name).select(F.col(key).cast("long").alias("id"), F.col(label).alias(output))


def _devices(read) -> DataFrame:
    types = read("lineitem").select(F.col("l_returnflag").alias("type")).distinct()
    return types.select(F.ascii("type").cast("long").alias("id"), "type")


_ENTITIES = {
    "channeled_accounts": _channeled_accounts,
    "channeled_campaigns": _channeled_campaigns,
    "channeled_ad_groups": _named("supplier", "s_suppkey", "s_name"),
    "channeled_ads": _named("part", "p_partkey", "p_name"),
    "queries": _named("supplier", "s_suppkey", "s_name", "query"),
    "nations": _named("nation", "n_nationkey", "n_name"),
    "devices": _devices,
    "pages": _pages,
    "posts": _posts,
}


def entities(spark: SparkSession, folder: str) -> Entities:
    return Entities(spark, folder)


def _replaced(base: Mapping[str, DataFrame], **tables: DataFrame) -> ChainMap:
    return ChainMap(tables, base)


def event_star(spark: SparkSession, folder: str) -> Star:
    return Star(facts=event_facts(spark, folder), entities=entities(spark, folder))


def organic_star(spark: SparkSession, folder: str) -> Star:
    return Star(facts=organic_facts(spark, folder), entities=entities(spark, folder))


def lifetime_star(spark: SparkSession, folder: str) -> Star:
    return Star(facts=lifetime_facts(spark, folder), entities=entities(spark, folder))


def ads_star(spark: SparkSession, folder: str) -> Star:
    tables = entities(spark, folder)
    return Star(facts=ads_facts(spark, folder), entities=_replaced(tables, channeled_accounts=tables["nations"]))


def search_star(spark: SparkSession, folder: str) -> Star:
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("url"), F.col("p_brand").alias("title"), F.col("p_type").alias("platform_id")
    )
    statuses = table(spark, folder, "lineitem").select("l_linestatus").distinct()
    sets = statuses.select(
        F.col("l_linestatus").alias("dimension_set_id"), F.create_map(F.lit("searchappearance"), F.col("l_linestatus")).alias("dims")
    )
    return Star(
        facts=search_facts(spark, folder), dimension_sets=sets, entities=_replaced(entities(spark, folder), pages=parts)
    )


def normal_event_star(spark: SparkSession, folder: str) -> Star:
    """The event star as three normal tables, as a load would store them."""
    facts = event_facts(spark, folder)
    signature = config_signature(
        {
            "channel": F.col("channel"),
            "name": F.col("name"),
            "period": F.col("period"),
            "channeled_account": F.col("channeled_account_id"),
            "dimension_set": dimensions_hash(F.col("dims")),
        }
    )
    keyed = facts.withColumn("metric_config_id", F.xxhash64(signature))
    metrics = keyed.select("metric_config_id", "value", "metric_date", F.lit(None).cast("string").alias("metadata"))
    keys = ["metric_config_id", "channel", "name", "period", "dimension_set_id", *CONFIG_SCHEMA]
    configs = keyed.select(*keys).distinct().withColumnRenamed("metric_config_id", "id")
    sets = facts.select("dimension_set_id").distinct().select(
        "dimension_set_id", F.create_map(F.lit("k"), F.col("dimension_set_id")).alias("dims")
    )
    return Star(metrics=metrics, configs=configs, dimension_sets=sets, entities=entities(spark, folder))


JOBS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("channel", T.StringType()),
        T.StructField("entity", T.StringType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("worker_id", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a log of load jobs: the customer is the account, the priority
    gives channel and rank, status and price give the job status."""
    orders = table(spark, folder, "orders")
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    status = (
        F.when(F.col("o_orderstatus") == "P", 2)
        .when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 400000), 3)
        .when(F.col("o_orderstatus") == "F", 4)
        .when(rank <= 3, 1)
        .when(rank == 4, 5)
        .otherwise(6)
    )
    recent = F.col("o_totalprice") < 100000
    day = F.to_date("o_orderdate")
    payload = F.to_json(
        F.struct(
            F.when(F.col("o_totalprice") < 480000, F.concat(F.lit("acc-"), F.col("o_custkey").cast("string"))).alias("account_id"),
            F.concat(F.lit("ch"), rank.cast("string"), F.when(recent, "-recent").otherwise("-history")).alias("instance_name"),
            F.struct(
                F.when(recent, "recent").otherwise("history").alias("type"),
                day.cast("string").alias("startDate"),
                F.date_add(day, 2).cast("string").alias("endDate"),
            ).alias("params"),
        )
    )
    return orders.select(
        F.col("o_orderkey").alias("id"),
        status.cast("int").alias("status"),
        F.concat(F.lit("ch"), rank.cast("string")).alias("channel"),
        F.lit("metric").alias("entity"),
        (F.lit(6) - rank).cast("int").alias("priority"),
        F.when(status == 2, F.lit("w1")).alias("worker_id"),
        payload.alias("payload"),
        F.when(status == 4, F.lit("timed out")).alias("message"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.floor("o_totalprice").cast("decimal(18,6)"))).alias("updated_at"),
    )
