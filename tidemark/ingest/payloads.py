"""Merging JSON payloads of one row, key by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.positions import in_parts
from tidemark.session import staged

# Row keys are dealt into so many buckets, to find those with very many payloads.
BUCKETS = 1 << 16
# Bytes of payloads up to which the rows of a bucket are merged as they are.
SMALL_BUCKET = 4 << 20


def json_pairs(data: Column) -> Column:
    """Map of a JSON object's keys to variants; text that is no object gives NULL."""
    return F.try_parse_json(data).try_cast("map<string,variant>")


def _object(entries: Column) -> Column:
    """JSON object text from ``{k, v}`` entries whose values are JSON text."""
    quoted = F.transform(entries, lambda e: F.concat(F.btrim(F.to_json(F.array(e["k"])), F.lit("[]")), F.lit(":"), e["v"]))
    return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))


def _elements_once(parts: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Each element of the arrays under a key once, with where it came first.

    Repeats collapse map-side before anything is put together.
    """
    elements = parts.select(
        *keys,
        sequence,
        "__key",
        F.posexplode(F.transform(F.try_variant_get("__value", "$", "array<variant>"), lambda x: F.to_json(x))).alias("pos", "e"),
    )
    return elements.groupBy(*keys, "__key", "e").agg(F.min(F.struct(sequence, "pos")).alias("at"))


def array_unions(
    rows: DataFrame, keys: Sequence[str], sequence: str = "sequence", data: str = "data", at_most: int = 10_000
) -> DataFrame:
    """The unions of ``merged_payloads`` in ordered parts, for keys with very many elements.

    One row per row key, JSON key and part: ``key``, ``part`` (from 0) and
    ``elements``, JSON text of at most ``at_most`` elements in the order in which
    they first came. Keys whose last value is no array have none. No row and no
    task holds all elements of a key.
    """
    parts = rows.select(*keys, sequence, F.explode_outer(json_pairs(F.col(data))).alias("__key", "__value"))
    once = _elements_once(parts.filter("__key IS NOT NULL"), keys, sequence)
    is_array = F.schema_of_variant("__value").startswith("ARRAY")
    last = parts.filter("__key IS NOT NULL").groupBy(*keys, "__key").agg(F.max_by(is_array, sequence).alias("__array"))
    # Written as a side of its own, so Spark may split a key with most of the elements.
    last = staged(last.filter("__array").select(*[F.col(c).alias(f"__of_{c}") for c in [*keys, "__key"]]), "arrays")
    same = F.lit(True)
    for c in [*keys, "__key"]:
        same = same & once[c].eqNullSafe(last[f"__of_{c}"])
    elements = staged(once.join(last, same, "left_semi"), "elements")
    numbered = in_parts(elements, [*keys, "__key"], ["at", "e"], at_most)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "e"))), lambda x: x["e"]), ",")
    text = F.concat(F.lit("["), joined, F.lit("]"))
    return numbered.groupBy(*keys, F.col("__key").alias("key"), "part").agg(F.count("*").alias("size"), text.alias("elements"))


def merged_payloads(
    rows: DataFrame, keys: Sequence[str], sequence: str = "sequence", data: str = "data", union_arrays: bool = False
) -> DataFrame:
    """One payload per row key: per JSON key, the value written last.

    With ``union_arrays`` a key whose last value is an array gets the union of
    its arrays instead. A union is one value; ``array_unions`` gives it in bounded
    parts. Rows are dealt by row key once and merged there; row keys in buckets with
    very many bytes are taken apart and combined map-side instead, so no task holds
    all the payloads of such a row key. ``rows`` are read twice, to find those
    buckets when this is called.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    crowded = _crowded(rows, bucket, data)
    if not crowded:
        return _merged_in_place(rows, keys, sequence, data, union_arrays)
    few = _merged_in_place(rows.filter(~bucket.isin(crowded)), keys, sequence, data, union_arrays)
    return few.unionByName(_merged_apart(rows.filter(bucket.isin(crowded)), keys, sequence, data, union_arrays))


def _crowded(rows: DataFrame, bucket: Column, data: str) -> list[int]:
    """Buckets with over ``SMALL_BUCKET`` bytes and four times the mean; at most a quarter of all."""
    size = F.coalesce(F.octet_length(data), F.lit(0)).cast("bigint") + 64
    sizes = rows.groupBy(bucket.alias("b")).agg(F.sum(size).alias("n"))
    large = F.collect_list(F.when(F.col("n") > SMALL_BUCKET, F.struct("b", "n")))
    total, found = sizes.agg(F.sum("n"), large).first()
    return [b for b, n in found if n > 4 * total / BUCKETS]


def _merged_in_place(rows: DataFrame, keys: Sequence[str], sequence: str, data: str, union_arrays: bool) -> DataFrame:
    """Payloads merged where all of their row key meet; each is parsed once and none is repeated per JSON key."""
    pairs = F.map_entries(json_pairs(F.col(data)))

    def entry(pair: Column) -> Column:
        fields = [pair["key"].alias("k"), F.col(sequence).alias("s"), F.to_json(pair["value"]).alias("v")]
        if union_arrays:
            elements = F.try_variant_get(pair["value"], "$", "array<variant>")
            fields.append(F.transform(elements, lambda x, i: F.struct(F.col(sequence).alias("s"), i.alias("i"), F.to_json(x).alias("e"))).alias("es"))
        return F.struct(*fields)

    # Dealt first, so that the rows of a key are sorted once, not before and after the shuffle.
    entries = rows.repartition(*keys).select(*keys, F.transform(pairs, entry).alias("entries"))
    gathered = entries.groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list("entries"))).alias("all"))

    def union(last: Column) -> Column:
        own = F.transform(F.filter("all", lambda x: (x["k"] == last["k"]) & x["es"].isNotNull()), lambda x: x["es"])
        once = F.array_distinct(F.transform(F.sort_array(F.flatten(own)), lambda x: x["e"]))
        text = F.concat(F.lit("["), F.array_join(once, ","), F.lit("]"))
        # Arrays without elements have no union. In an array, so that the text is made once.
        found = F.get(F.filter(F.array(text), lambda t: t != "[]"), F.lit(0))
        return F.when(last["v"].startswith("["), F.coalesce(found, last["v"])).otherwise(last["v"])

    # Sorted by JSON key and sequence: the last of a key is followed by another key or none.
    last = F.filter("all", lambda e, i: ~e["k"].eqNullSafe(F.get("all", i + 1)["k"]))
    value = (lambda e: union(e)) if union_arrays else (lambda e: e["v"])
    # Without any sequence there is no last value.
    texts = F.transform(last, lambda e: F.struct(e["k"].alias("k"), F.when(e["s"].isNotNull(), value(e)).alias("v")))
    return gathered.select(*keys, _object(texts).alias(data))


def _merged_apart(rows: DataFrame, keys: Sequence[str], sequence: str, data: str, union_arrays: bool) -> DataFrame:
    """Payloads taken apart first and combined map-side by JSON key."""
    parts = rows.select(*keys, sequence, F.explode_outer(json_pairs(F.col(data))).alias("__key", "__value"))
    text = parts.select(*keys, sequence, "__key", F.to_json("__value").alias("v"))
    latest = text.groupBy(*keys, "__key").agg(F.max_by("v", sequence).alias("v"))
    if union_arrays:
        once = _elements_once(parts, keys, sequence)
        unions = once.groupBy(*keys, "__key").agg(F.sort_array(F.collect_list(F.struct("at", "e"))).alias("es"))
        joined_text = F.concat(F.lit("["), F.array_join(F.transform("es", lambda x: x["e"]), ","), F.lit("]"))
        same = F.lit(True)
        renamed = unions.select(*[F.col(c).alias(f"__{c}") for c in [*keys, "__key"]], joined_text.alias("__union"))
        for c in [*keys, "__key"]:
            same = same & latest[c].eqNullSafe(renamed[f"__{c}"])
        latest = latest.join(renamed, same, "left").select(
            *keys, "__key", F.when(F.col("v").startswith("["), F.coalesce("__union", "v")).otherwise(F.col("v")).alias("v")
        )
    entries = F.sort_array(F.collect_list(F.when(F.col("__key").isNotNull(), F.struct(F.col("__key").alias("k"), "v"))))
    return latest.groupBy(*keys).agg(_object(entries).alias(data))
