"""Stars in buckets: no shuffle between facts and configs, hot configs in pieces, equal answers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.plans.request import AggregateRequest, aggregate
from tidemark.sources import tables as T
from tidemark.sources.buckets import bucketed_star


def test_a_bucketed_star_answers_alike_without_a_shuffle_before_the_join(spark, folder, rows):
    star = T.normal_event_star(spark, folder)
    config = star.metrics.filter("metric_date >= '2024-01-01'").select(F.min("metric_config_id")).first()[0]
    day = F.expr("date_add(DATE '2024-01-01', CAST(id % 31 AS INT))")
    hot = spark.range(400).select(F.lit(config).alias("metric_config_id"), F.col("id").cast("double").alias("value"), day.alias("metric_date"), F.lit(None).cast("string").alias("metadata"))
    star = replace(star, metrics=star.metrics.unionByName(hot))
    stored = bucketed_star(star, "bucketed_star_test", buckets=4, at_most=100)
    assert stored.metrics.count() == star.metrics.count()
    largest = stored.metrics.groupBy("metric_config_id").count().agg({"count": "max"}).first()[0]
    whole = star.metrics.groupBy("metric_config_id").count().agg({"count": "max"}).first()[0]
    assert whole >= 400 and largest <= 130
    assert stored.configs.select("config_id").distinct().count() == star.configs.count() < stored.configs.count()
    for group in (["daily", "k"], ["monthly"], []):
        request = AggregateRequest({"clicks": "clicks", "ctr": "ctr"}, group, {}, "2024-01-01", "2024-01-31")
        expected = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows(aggregate(star, request))]
        assert [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows(aggregate(stored, request))] == expected
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in stored.frame()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for table in ("metrics", "configs"):
            spark.sql(f"DROP TABLE IF EXISTS bucketed_star_test_{table}")
