"""Shop loads: orders, products, customers, price rules, categories.

Each load takes a batch of platform rows and gives the tables it fills. Ids are
hashes of natural keys, so rows refer to each other without waiting for a store
to number them, and a repeated load changes nothing. The tables of a load are
independent plans over the batch, so hand in a batch that is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import surrogate_id
from tidemark.functions.text import json_path
from tidemark.ingest.entities import CHANNELED_KEY, channeled_id, first_per_key, identities, payload_rows
from tidemark.ingest.payloads import merged_payloads
from tidemark.session import staged


def _placeholders(rows: DataFrame, platform: str, extra: list[str] | None = None) -> DataFrame:
    """Per-channel rows known by id only, until their own load fills them in."""
    known = rows.filter(F.col(platform).isNotNull()).select("channel", F.col(platform).alias("platform_id"), *(extra or []))
    return known.distinct().select(channeled_id("channel", "platform_id").alias("id"), *known.columns)


def load_orders(batch: DataFrame) -> dict[str, DataFrame]:
    """Orders with customers, discounts, placeholder products and bridges.

    ``batch``: channel, platform_id, platform_created_at, customer struct<id,email>,
    discount_codes array<string>, line_items array<struct<product_id,variant_id>>,
    data JSON text, sequence. An order that comes twice keeps its first customer
    and date; its payloads merge, arrays by union and the rest by the last value.
    The batch is staged first: each table is a plan of its own over it.
    """
    batch = staged(batch, "orders")
    order_id = channeled_id("channel", "platform_id")
    orders = identities(batch.select(F.col("platform_id").alias("order_id")), "order_id")
    head = first_per_key(
        batch.select(*CHANNELED_KEY, "platform_created_at", F.col("customer.id").cast("string").alias("customer_ref"), "sequence"),
        CHANNELED_KEY,
    ).drop("sequence")
    customer_key = F.when(F.col("customer_ref").isNotNull(), channeled_id("channel", "customer_ref"))
    channeled_orders = head.join(payload_rows(batch), list(CHANNELED_KEY)).select(
        order_id.alias("id"),
        *CHANNELED_KEY,
        surrogate_id(F.col("platform_id")).alias("order_id"),
        customer_key.alias("channeled_customer_id"),
        "platform_created_at",
        "data",
    )
    people = batch.select(
        "channel", F.col("customer.id").cast("string").alias("platform_id"), F.col("customer.email").alias("email"), "sequence"
    ).filter(F.col("platform_id").isNotNull() | F.col("email").isNotNull())
    customers = identities(people, "email")
    people = people.withColumn("platform_id", F.coalesce("platform_id", F.lit("")))
    channeled_customers = first_per_key(people, CHANNELED_KEY).select(
        channeled_id("channel", "platform_id").alias("id"),
        *CHANNELED_KEY,
        "email",
        F.when(F.coalesce("email", F.lit("")) != "", surrogate_id(F.col("email"))).alias("customer_id"),
    )
    codes = batch.select(order_id.alias("channeled_order_id"), "channel", F.explode("discount_codes").alias("code"))
    discounts = codes.select("channel", "code").distinct().select(channeled_id("channel", "code").alias("id"), "channel", "code")
    items = batch.select(order_id.alias("channeled_order_id"), "channel", F.inline("line_items")).select(
        "channeled_order_id",
        "channel",
        F.col("product_id").cast("string").alias("product_ref"),
        F.col("variant_id").cast("string").alias("variant_ref"),
    )
    items = items.filter(F.col("product_ref").isNotNull())
    variants = items.filter(F.col("variant_ref").isNotNull()).withColumn(
        "channeled_product_id", channeled_id("channel", "product_ref")
    )
    return {
        "orders": orders,
        "channeled_orders": channeled_orders,
        "customers": customers,
        "channeled_customers": channeled_customers,
        "channeled_discounts": discounts,
        "channeled_products": _placeholders(items, "product_ref"),
        "channeled_product_variants": first_variant(variants),
        "order_products": _bridge(items, "product_ref", "channeled_product_id"),
        "order_variants": _bridge(variants, "variant_ref", "channeled_product_variant_id"),
        "order_discounts": codes.select("channeled_order_id", channeled_id("channel", "code").alias("channeled_discount_id")).distinct(),
    }


def first_variant(variants: DataFrame) -> DataFrame:
    """One row per variant; a variant met under two products keeps the smaller id."""
    rows = variants.groupBy("channel", F.col("variant_ref").alias("platform_id")).agg(
        F.min("channeled_product_id").alias("channeled_product_id")
    )
    return rows.select(channeled_id("channel", "platform_id").alias("id"), *rows.columns)


def _bridge(items: DataFrame, reference: str, output: str) -> DataFrame:
    return items.select("channeled_order_id", channeled_id("channel", reference).alias(output)).distinct()


def load_products(batch: DataFrame) -> dict[str, DataFrame]:
    """Products with vendors, variants, categories and the category bridge.

    ``batch``: channel, platform_id, platform_created_at, sku, vendor,
    variants array<struct<id,sku,data>>, categories array<struct<id,data>>, data, sequence.
    """
    product = channeled_id("channel", "platform_id")
    vendors = identities(batch.select(F.col("vendor").alias("name")), "name")
    channeled_vendors = (
        batch.filter(F.coalesce("vendor", F.lit("")) != "")
        .select("channel", F.col("vendor").alias("name"))
        .distinct()
        .select(channeled_id("channel", "name").alias("id"), "channel", "name", surrogate_id(F.col("name")).alias("vendor_id"))
    )
    products = first_per_key(
        batch.select(F.col("platform_id").alias("product_id"), "sku", "sequence"), ["product_id"]
    ).select(surrogate_id(F.col("product_id")).alias("id"), "product_id", "sku")
    head = first_per_key(batch.select(*CHANNELED_KEY, "platform_created_at", "vendor", "sequence"), CHANNELED_KEY).drop("sequence")
    channeled_products = head.join(payload_rows(batch), list(CHANNELED_KEY)).select(
        product.alias("id"),
        *CHANNELED_KEY,
        surrogate_id(F.col("platform_id")).alias("product_id"),
        F.when(F.coalesce("vendor", F.lit("")) != "", channeled_id("channel", "vendor")).alias("channeled_vendor_id"),
        "platform_created_at",
        "data",
    )
    variants = batch.select(product.alias("channeled_product_id"), "channel", "sequence", F.inline("variants")).select(
        "channel", F.col("id").cast("string").alias("platform_id"), "sku", "channeled_product_id", "data", "sequence"
    )
    channeled_variants = first_per_key(variants.filter(F.col("platform_id").isNotNull()), CHANNELED_KEY).drop("sequence")
    categories = batch.select(product.alias("channeled_product_id"), "channel", "sequence", F.inline("categories")).select(
        "channel", F.col("id").cast("string").alias("platform_id"), "data", "channeled_product_id", "sequence"
    )
    categories = categories.filter(F.col("platform_id").isNotNull())
    category = channeled_id("channel", "platform_id")
    return {
        "vendors": vendors,
        "channeled_vendors": channeled_vendors,
        "products": products,
        "channeled_products": channeled_products,
        "product_variants": identities(variants.select(F.col("platform_id").alias("product_variant_id")), "product_variant_id"),
        "channeled_product_variants": channeled_variants.select(
            channeled_id("channel", "platform_id").alias("id"), *channeled_variants.columns
        ),
        "product_categories": identities(categories.select(F.col("platform_id").alias("product_category_id")), "product_category_id"),
        "channeled_product_categories": first_per_key(
            categories.drop("channeled_product_id"), CHANNELED_KEY
        ).select(category.alias("id"), *CHANNELED_KEY, "data"),
        "category_products": categories.select(category.alias("channeled_product_category_id"), "channeled_product_id").distinct(),
    }


def load_customers(batch: DataFrame) -> dict[str, DataFrame]:
    """Customers by email; addresses of repeated rows unite, lead data merges.

    ``batch``: channel, platform_id, email, platform_created_at, data, lead_data, sequence.
    Of a repeated row only the addresses are taken from ``data``. The batch is
    staged first.
    """
    known = staged(batch.filter(F.coalesce("email", F.lit("")) != ""), "customers")
    customers = identities(known, "email")
    head = first_per_key(known.select(*CHANNELED_KEY, "email", "platform_created_at", "data", "sequence"), CHANNELED_KEY)
    addresses = known.select(
        *CHANNELED_KEY,
        "sequence",
        F.when(
            json_path(F.col("data"), "addresses").isNotNull(),
            F.concat(F.lit('{"addresses":'), json_path(F.col("data"), "addresses"), F.lit("}")),
        ).alias("data"),
    )
    united = payload_rows(addresses).withColumnRenamed("data", "addresses")
    lead = merged_payloads(
        known.select(*CHANNELED_KEY, "sequence", F.col("lead_data").alias("data")), CHANNELED_KEY
    ).withColumnRenamed("data", "lead_data")
    both = staged(head.join(united, list(CHANNELED_KEY)).join(lead, list(CHANNELED_KEY)), "customer-parts")
    parts = both.select(*CHANNELED_KEY, F.lit(0).alias("sequence"), "data").unionByName(
        both.select(*CHANNELED_KEY, F.lit(1).alias("sequence"), F.col("addresses").alias("data"))
    )
    merged = merged_payloads(parts, CHANNELED_KEY)
    channeled = both.drop("data", "sequence", "addresses").join(merged, list(CHANNELED_KEY))
    return {
        "customers": customers,
        "channeled_customers": channeled.select(
            channeled_id("channel", "platform_id").alias("id"),
            *CHANNELED_KEY,
            surrogate_id(F.col("email")).alias("customer_id"),
            "email",
            "platform_created_at",
            "data",
            "lead_data",
        ),
    }


def load_price_rules(batch: DataFrame) -> dict[str, DataFrame]:
    """Price rules by platform id; the first row of a repeated one counts.

    ``batch``: channel, platform_id, platform_created_at, data, sequence.
    """
    head = first_per_key(batch.select(*CHANNELED_KEY, "platform_created_at", "data", "sequence"), CHANNELED_KEY)
    return {
        "price_rules": identities(batch.select(F.col("platform_id").alias("price_rule_id")), "price_rule_id"),
        "channeled_price_rules": head.select(
            channeled_id("channel", "platform_id").alias("id"),
            *CHANNELED_KEY,
            surrogate_id(F.col("platform_id")).alias("price_rule_id"),
            "platform_created_at",
            "data",
        ),
    }


def load_discounts(batch: DataFrame) -> dict[str, DataFrame]:
    """Discounts by code, under their price rule.

    ``batch``: channel, platform_id, code, price_rule_ref, platform_created_at, data, sequence.
    """
    keys = ["channel", "code"]
    head = first_per_key(
        batch.select("channel", "code", "platform_id", "price_rule_ref", "platform_created_at", "data", "sequence"), keys
    )
    return {
        "discounts": identities(batch, "code"),
        "channeled_discounts": head.select(
            channeled_id("channel", "code").alias("id"),
            "channel",
            "code",
            "platform_id",
            F.when(F.col("price_rule_ref").isNotNull(), channeled_id("channel", "price_rule_ref")).alias("channeled_price_rule_id"),
            "platform_created_at",
            "data",
        ),
    }


def load_categories(batch: DataFrame, collects: DataFrame | None = None) -> dict[str, DataFrame]:
    """Product categories and, from ``collects``, the products in them.

    ``batch``: channel, platform_id, is_smart, platform_created_at, data, sequence.
    ``collects``: channel, category_ref, product_ref.
    """
    head = first_per_key(batch.select(*CHANNELED_KEY, "platform_created_at", "is_smart", "sequence"), CHANNELED_KEY).drop("sequence")
    out = {
        "product_categories": identities(batch.select(F.col("platform_id").alias("product_category_id")), "product_category_id"),
        "channeled_product_categories": head.join(payload_rows(batch), list(CHANNELED_KEY)).select(
            channeled_id("channel", "platform_id").alias("id"), *CHANNELED_KEY, "is_smart", "platform_created_at", "data"
        ),
    }
    if collects is not None:
        out["category_products"] = collects.select(
            channeled_id("channel", "category_ref").alias("channeled_product_category_id"),
            channeled_id("channel", "product_ref").alias("channeled_product_id"),
        ).distinct()
    return out
