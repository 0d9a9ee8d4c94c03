"""Platform rows turned into metric rows and entity rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import CONFIG_PARTS, config_signature, dimensions_hash
from tidemark.functions.text import coerce_value


def path_column(df: DataFrame, path: str) -> Column:
    """``a.b.c``: nested struct fields, or the rest as a JSON path of a text column."""
    head, dot, rest = path.partition(".")
    if head not in df.columns:
        return F.lit(None).cast("string")
    if not dot:
        return F.col(f"`{head}`")
    if dict(df.dtypes)[head] == "string":
        return F.get_json_object(F.col(f"`{head}`"), "$." + rest)
    if dict(df.dtypes)[head].startswith("map"):
        return F.try_element_at(F.col(f"`{head}`"), F.lit(rest))
    return F.col(path)


def _as_text(df: DataFrame, path: str) -> Column:
    """Any value as text that ``coerce_value`` reads: JSON for nested values."""
    column = path_column(df, path)
    head = path.partition(".")[0]
    kind = dict(df.select(column.alias("c")).dtypes)["c"] if head in df.columns else "string"
    return F.to_json(column) if kind.startswith(("array", "struct", "map")) else column.cast("string")


def normalise_metrics(
    rows: DataFrame,
    channel: str,
    metrics: Mapping[str, str],
    period: str = "daily",
    dimensions: Sequence[str] = (),
    date_field: str = "date",
    platform_id_field: str = "id",
    row_path: str | None = None,
    nested_date_field: str | None = None,
    context: Mapping[str, Any] | None = None,
    include_nulls: bool = False,
    metadata_fields: Sequence[str] = (),
) -> DataFrame:
    """Wide platform rows as one row per metric.

    ``metrics`` maps source fields (dot paths) to metric names. ``row_path`` names
    an array of nested rows the metrics are read from. Missing values are dropped
    unless ``include_nulls``, which turns them into 0.
    """
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    pairs = [
        F.struct(F.lit(d.lower()).alias("key"), path_column(rows, d).cast("string").alias("value")) for d in dimensions
    ]
    dims = (
        F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))
        if pairs
        else F.create_map().cast("map<string,string>")
    )
    optional = {
        name: path_column(rows, source).cast("string")
        for name, sources in {
            "country": ("country", "country_code"),
            "device": ("device",),
            "location": ("location",),
            "state": ("state",),
            "city": ("city",),
        }.items()
        for source in [next((s for s in sources if s in rows.columns), sources[0])]
    }
    keyed = rows.withColumns(
        {
            "__raw": raw,
            "__dims": dims,
            "__day": F.to_date(path_column(rows, date_field)),
            "__platform": F.coalesce(path_column(rows, platform_id_field).cast("string"), F.lit("unknown")),
            **{f"__o_{n}": c for n, c in optional.items()},
        }
    )
    source = keyed
    if row_path is not None:
        nested = keyed.withColumn("__row", F.explode(path_column(keyed, row_path)))
        kept = [c for c in nested.columns if c.startswith("__") and c != "__row"]
        source = nested.select(*kept, "__row.*")
        if nested_date_field:
            source = source.withColumn("__day", F.coalesce(F.to_date(path_column(source, nested_date_field)), "__day"))
    entries = F.array(
        *[F.struct(F.lit(name).alias("name"), _as_text(source, path).alias("raw")) for path, name in metrics.items()]
    )
    long = source.select(*[c for c in source.columns if c.startswith("__")], F.inline(entries))
    if not include_nulls:
        long = long.filter(F.col("raw").isNotNull())
    given = {k: F.lit(v).cast("string") for k, v in (context or {}).items()}
    parts = {
        **given,
        **{n: F.col(f"__o_{n}") for n in optional if n not in given},
        "channel": F.lit(channel),
        "name": F.col("name"),
        "period": F.lit(period),
        "dimension_set": dimensions_hash(F.col("__dims")),
    }
    metadata = (
        F.to_json(F.struct(*[F.get_json_object("__raw", "$." + f).alias(f) for f in metadata_fields]))
        if metadata_fields
        else F.lit("{}")
    )
    return long.select(
        F.lit(channel).alias("channel"),
        "name",
        coerce_value(F.col("raw")).alias("value"),
        F.lit(period).alias("period"),
        F.coalesce("__day", F.current_date()).alias("metric_date"),
        F.col("__platform").alias("platform_id"),
        F.col("__dims").alias("dims"),
        dimensions_hash(F.col("__dims")).alias("dimensions_hash"),
        config_signature({k: v for k, v in parts.items() if k in CONFIG_PARTS}).alias("signature"),
        metadata.alias("metadata"),
        F.col("__raw").alias("data"),
        *[c.alias(k) for k, c in given.items()],
        *[F.col(f"__o_{n}").alias(n) for n in optional if n not in given],
    )


def normalise_entities(
    rows: DataFrame,
    channel: str,
    mapping: Mapping[str, str | Column],
    platform_id_field: str = "id",
    date_field: str = "created_at",
    context: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Platform rows as entities: mapped fields, context, and the raw row as ``data``."""
    columns = {
        "channel": F.lit(channel),
        "platform_id": F.coalesce(path_column(rows, platform_id_field).cast("string"), F.lit("")),
        "platform_created_at": path_column(rows, date_field).try_cast("timestamp"),
    }
    for name, source in mapping.items():
        columns[name] = source if isinstance(source, Column) else path_column(rows, source)
    for name, value in (context or {}).items():
        columns[name] = F.lit(value)
    columns.setdefault("data", F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))
    return rows.select(*[c.alias(n) for n, c in columns.items()])
