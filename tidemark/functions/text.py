"""Text helpers: URLs, JSON paths, value coercion, array de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: search texts are keyed by at most this many characters.
QUERY_KEY_LENGTH = 512


def json_path(column: Column, path: str) -> Column:
    """``data.name`` style access into a JSON string column."""
    return F.get_json_object(column, "$." + path)


def _with_scheme(url: Column) -> Column:
    """The text as a full URL, so that one parser serves both forms."""
    return F.when(F.lower(url).startswith("http://") | F.lower(url).startswith("https://"), url).otherwise(F.concat(F.lit("http://"), url))


def _is_domain(host: Column) -> Column:
    """At least two labels of letters, digits and hyphens, the last of letters only."""
    labels = F.split(F.lower(host), r"\.")
    plain = F.forall(labels, lambda x: (x != "") & (F.translate(x, "abcdefghijklmnopqrstuvwxyz0123456789-", "") == ""))
    last = F.element_at(labels, -1)
    return (F.size(labels) > 1) & plain & (F.length(last) > 1) & (F.translate(last, "abcdefghijklmnopqrstuvwxyz", "") == "")


def domain_of(url: Column) -> Column:
    """Host without scheme, a leading ``www.`` of full URLs, and path; NULL when it is no domain."""
    host = F.try_parse_url(_with_scheme(url), F.lit("HOST"))
    full = F.lower(url).startswith("http")
    host = F.when(full & F.lower(host).startswith("www."), F.substring(host, 5, 2**31 - 1)).otherwise(host)
    return F.when(_is_domain(host), host)


def url_key(url: Column) -> Column:
    """Path of a full URL or of ``host.tld/path``, without the query; other texts lose their query only."""
    before_query = F.substring_index(url, "?", 1)
    full = url.startswith("http://") | url.startswith("https://")
    rest = F.when(full, F.substring_index(before_query, "://", -1)).otherwise(before_query)
    cut = F.instr(rest, "/")
    host = F.when(cut > 0, F.substring(rest, F.lit(1), cut - 1)).otherwise(rest)
    path = F.when(cut > 0, F.substring(rest, cut, F.length(rest))).otherwise(F.lit("/"))
    bare = _is_domain(host) & (F.size(F.split(host, r"\.")) == 2)
    return F.when((full & (host != "")) | bare, path).otherwise(before_query)


def canonical_page_id(url: Column) -> Column:
    """Host and path joined by underscores, lower-cased, without ``www.``."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(url), r"^https?://(?:www\.)?", ""), r"[?#].*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def query_key(text: Column) -> Column:
    return F.substring(text, 1, QUERY_KEY_LENGTH)


def coerce_value(raw: Column) -> Column:
    """Number in a platform value: plain, ``[{value}]``, ``[{amount}]`` or ``{value}``."""
    return F.coalesce(
        raw.try_cast("double"),
        F.get_json_object(raw, "$[0].value").try_cast("double"),
        F.get_json_object(raw, "$[0].amount").try_cast("double"),
        F.get_json_object(raw, "$.value").try_cast("double"),
        F.lit(0.0),
    )


def union_distinct(left: Column, right: Column) -> Column:
    """Two arrays of structs as one, without repeats; a missing array is empty."""
    return F.when(left.isNull(), F.array_distinct(right)).when(
        right.isNull(), F.array_distinct(left)
    ).otherwise(F.array_union(left, right))


def country_codes(spark: SparkSession) -> DataFrame:
    """ISO 3166 two-letter to three-letter codes, from the JVM's own tables.

    At most 26 x 26 rows whatever the data, so it may always be broadcast.
    """
    locale = spark._jvm.java.util.Locale
    rows = []
    for alpha2 in locale.getISOCountries():
        rows.append((alpha2, locale("", alpha2).getISO3Country()))
    return spark.createDataFrame(rows, "alpha2 string, alpha3 string")


def with_alpha3(df: DataFrame, column: str, output: str, codes: DataFrame | None = None) -> DataFrame:
    """Add the three-letter country code; unknown codes give NULL."""
    table = codes if codes is not None else F.broadcast(country_codes(df.sparkSession))
    lookup = table.select(F.col("alpha2").alias("__alpha2"), F.col("alpha3").alias(output))
    return df.join(lookup, F.upper(F.col(column)) == F.col("__alpha2"), "left").drop("__alpha2")
