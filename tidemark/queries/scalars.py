"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates as D
from tidemark.functions import keys as K
from tidemark.functions import text as X
from tidemark.operators.normalise import normalise_entities, normalise_metrics
from tidemark.queries.registry import EVENTS, query
from tidemark.sources import tables as T


@query("i1_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_path(spark, folder):
    events = T.table(spark, folder, "events")
    return events.select(
        "event_id", X.json_path(F.col("props"), "k").cast("bigint").alias("k"), X.json_path(F.col("props"), "missing").alias("missing")
    )


@query(
    "i3_text_functions",
    "SELECT n_nationkey, COALESCE(lower(trim(n_name)), 'N/A') AS name, CAST(length(n_name) AS INT) AS size, CAST(n_regionkey AS VARCHAR) AS region FROM nation",
)
def text_functions(spark, folder):
    return T.table(spark, folder, "nation").select(
        "n_nationkey",
        F.coalesce(F.lower(F.trim("n_name")), F.lit("N/A")).alias("name"),
        F.length("n_name").alias("size"),
        F.col("n_regionkey").cast("string").alias("region"),
    )


_HOST = "regexp_replace(regexp_replace(url, '^https?://(www\\.)?', ''), '[/?#].*$', '')"


@query(
    "i6_domain",
    f"SELECT page_id, CASE WHEN regexp_full_match({_HOST}, '([A-Za-z0-9\\-]+\\.)+[A-Za-z]{{2,}}') THEN {_HOST} END AS domain FROM pages",
)
def domain(spark, folder):
    return T.table(spark, folder, "pages").select("page_id", X.domain_of(F.col("url")).alias("domain"))


@query(
    "i7_url_key",
    "SELECT page_id, regexp_replace(CASE WHEN regexp_extract(url, '^https?://[^/]+(/.*)?$', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/]+(/.*)?$', 1) END, '\\?.*$', '') AS key FROM pages",
)
def url_key(spark, folder):
    return T.table(spark, folder, "pages").select("page_id", X.url_key(F.col("url")).alias("key"))


@query(
    "i15_canonical_page_id",
    """SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(url), '^https?://(www\\.)?', ''), '[?#].*$', ''), '[^a-z0-9]+', '_', 'g'), '_') AS canonical_id FROM pages""",
)
def canonical_page_id(spark, folder):
    return T.table(spark, folder, "pages").select("page_id", X.canonical_page_id(F.col("url")).alias("canonical_id"))


@query(
    "i9_country_alpha3",
    """WITH c(alpha2, alpha3) AS (VALUES ('EN', NULL), ('FR', 'FRA'), ('DE', 'DEU'), ('ES', 'ESP'))
    SELECT doc_id, alpha3 FROM documents LEFT JOIN c ON upper(lang) = alpha2""",
)
def country_alpha3(spark, folder):
    return X.with_alpha3(T.table(spark, folder, "documents").select("doc_id", "lang"), "lang", "alpha3").drop("lang")


@query(
    "i10_row_keys",
    """WITH s AS (SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, md5('[{"key":"k","value":"' || json_extract_string(props, '$.k') || '"}]') AS h, event_type, user_id FROM events),
    c AS (SELECT *, md5('{"channel":"events","channeled_account":"' || user_id || '","dimension_set":"' || h || '","name":"' || event_type || '","period":"daily"}') AS sig FROM s)
    SELECT event_id, h AS dimensions_hash, sig AS signature, md5(sig || '|' || h || '|' || day) AS metric_key FROM c""",
)
def row_keys(spark, folder):
    events = T.table(spark, folder, "events")
    dims = K.dimensions_hash(F.create_map(F.lit("k"), F.get_json_object("props", "$.k")))
    keyed = events.select("event_id", "event_type", "user_id", F.to_date("ts").alias("day"), dims.alias("dimensions_hash"))
    parts = {
        "channel": F.lit("events"),
        "name": F.col("event_type"),
        "period": F.lit("daily"),
        "page": F.lit(None),
        "channeled_account": F.col("user_id"),
        "dimension_set": F.col("dimensions_hash"),
    }
    signed = keyed.withColumn("signature", K.config_signature(parts))
    key = K.metric_key(F.col("signature"), F.col("dimensions_hash"), F.col("day"))
    return signed.select("event_id", "dimensions_hash", "signature", key.alias("metric_key"))


@query(
    "i11_array_union",
    """WITH a AS (SELECT l_orderkey, l_linenumber, list_sort(list_distinct([l_partkey, l_suppkey, l_orderkey])) AS p FROM lineitem)
    SELECT l_orderkey, l_linenumber, CAST(len(p) AS INT) AS items, p[1] AS first_item FROM a""",
)
def array_union(spark, folder):
    def items(*names):
        return F.array(*[F.struct(F.col(n).alias("id")) for n in names])

    union = F.array_sort(X.union_distinct(items("l_partkey", "l_suppkey"), items("l_suppkey", "l_orderkey")))
    return T.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.size(union).alias("items"), F.get(union, F.lit(0))["id"].alias("first_item")
    )


@query(
    "i13_date_chunks",
    """WITH o AS (SELECT o_custkey, MIN(CAST(o_orderdate AS DATE)) AS a, MAX(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1),
    s AS (SELECT o_custkey, b, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS first_day FROM o)
    SELECT o_custkey, first_day, LEAST(first_day + 6, b) AS last_day FROM s""",
)
def date_chunks(spark, folder):
    spans = T.table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b")
    )
    chunks = spans.select("o_custkey", F.inline(D.chunk_starts(F.col("a"), F.col("b"), "1 week")))
    return chunks.select("o_custkey", F.col("start").alias("first_day"), F.col("end").alias("last_day"))


@query(
    "i14_history_quarters",
    """WITH o AS (SELECT o_custkey, MIN(CAST(o_orderdate AS DATE)) AS a, MAX(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1),
    s AS (SELECT o_custkey, a, b, CAST(unnest(generate_series(date_trunc('quarter', a), b, INTERVAL 3 MONTH)) AS DATE) AS q FROM o WHERE a < b)
    SELECT o_custkey, GREATEST(q, a) AS first_day, LEAST(CAST(q + INTERVAL 3 MONTH AS DATE) - 1, b) AS last_day, year(q) || '-' || quarter(q) AS label FROM s WHERE GREATEST(q, a) < b""",
)
def history_quarters(spark, folder):
    spans = T.table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b")
    )
    windows = spans.select("o_custkey", F.inline(D.quarter_windows(F.col("a"), F.col("b"))))
    return windows.select("o_custkey", F.col("start").alias("first_day"), F.col("end").alias("last_day"), "label")


@query(
    "i16_formatted_dates",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day FROM events",
)
def formatted_dates(spark, folder):
    return D.format_dates(T.table(spark, folder, "events").select("event_id", "ts", F.to_date("ts").alias("day")))


@query("i18_query_key", "SELECT doc_id, md5(substr(text, 1, 512)) AS query_hash FROM documents")
def query_key(spark, folder):
    """The key of a search text is its first 512 characters; the text itself stays whole."""
    return T.table(spark, folder, "documents").select("doc_id", F.md5(X.query_key(F.col("text"))).alias("query_hash"))


@query(
    "a3_wide_to_long",
    """SELECT l_orderkey || '-' || l_linenumber AS platform_id, CAST(l_shipdate AS DATE) AS metric_date, m.name, R(m.value) AS value, l_returnflag AS gender, COUNT(*) AS n
    FROM lineitem, LATERAL (VALUES ('spend', l_extendedprice), ('impressions', l_quantity), ('clicks', CASE WHEN l_tax > 0 THEN l_tax END)) AS m(name, value)
    WHERE m.value IS NOT NULL GROUP BY ALL""",
)
def wide_to_long(spark, folder):
    rows = T.table(spark, folder, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        F.to_date("l_shipdate").cast("string").alias("date"),
        F.col("l_extendedprice").alias("cost"),
        F.struct(F.col("l_quantity").alias("shown"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("taps")).alias("stats"),
        F.col("l_returnflag").alias("Gender"),
    )
    metrics = {"cost": "spend", "stats.shown": "impressions", "stats.taps": "clicks"}
    long = normalise_metrics(rows, "ads", metrics, dimensions=["Gender"])
    return long.groupBy("platform_id", "metric_date", "name", "value", F.col("dims")["gender"].alias("gender")).agg(F.count("*").alias("n"))


@query(
    "a3_nested_rows",
    """SELECT CAST(l_orderkey AS VARCHAR) AS platform_id, d AS metric_date, R(SUM(v)) AS value FROM (
      SELECT l_orderkey, CAST(l_shipdate AS DATE) AS d, l_quantity AS v FROM lineitem
      UNION ALL SELECT l_orderkey, CAST(l_shipdate AS DATE) + 1, l_tax FROM lineitem WHERE l_tax > 0) GROUP BY 1, 2""",
)
def nested_rows(spark, folder):
    day = F.to_date("l_shipdate")
    values = F.array(
        F.struct(day.cast("string").alias("day"), F.col("l_quantity").alias("shown")),
        F.struct(F.date_add(day, 1).cast("string").alias("day"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("shown")),
    )
    rows = T.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), values.alias("values"))
    long = normalise_metrics(rows, "ads", {"shown": "impressions"}, row_path="values", nested_date_field="day")
    return long.groupBy("platform_id", "metric_date").agg(F.sum("value").alias("value"))


@query(
    "a4_entity_rows",
    """SELECT 'shop' AS channel, CAST(o_orderkey AS VARCHAR) AS platform_id, o_orderdate AS platform_created_at, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS customer, 'crm' AS origin FROM orders""",
)
def entity_rows(spark, folder):
    rows = T.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
        F.to_json(F.struct(F.struct(F.col("o_custkey").alias("id")).alias("customer"))).alias("body"),
        "o_orderstatus",
    )
    mapping = {"status": "o_orderstatus", "customer": "body.customer.id"}
    out = normalise_entities(rows, "shop", mapping, context={"origin": "crm"})
    return out.select("channel", "platform_id", F.col("platform_created_at").cast("timestamp_ntz").alias("platform_created_at"), "status", "customer", "origin")


@query(
    "a5_coerced_values",
    "SELECT event_id, R(CASE event_type WHEN 'error' THEN 0 ELSE value END) AS value FROM events",
)
def coerced_values(spark, folder):
    value = F.col("value").cast("string")
    raw = (
        F.when(F.col("event_type") == "click", F.concat(F.lit('[{"value": "'), value, F.lit('"}]')))
        .when(F.col("event_type") == "view", F.concat(F.lit('[{"amount": '), value, F.lit("}]")))
        .when(F.col("event_type") == "signup", F.concat(F.lit('{"value": '), value, F.lit("}")))
        .when(F.col("event_type") == "error", F.lit("n/a"))
        .otherwise(value)
    )
    return T.table(spark, folder, "events").select("event_id", X.coerce_value(raw).alias("value"))
