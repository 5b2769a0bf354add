"""Observations, dimensions and records as derived from the driver's tables.

Timestamps in the files have no zone and mean UTC; sessions run with ``spark.sql.session.timeZone=UTC``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_AS_OF, SHIPMENTS_AS_OF, ORDERS_AS_OF = "2024-01-31 00:00:00", "2001-11-05 00:00:00", "2001-08-02 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def second(c: Column) -> Column:
    """Catalog times have whole seconds."""
    return F.date_trunc("second", c.cast("timestamp"))


def text_time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def obs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric for each event type, each event an observation."""
    return table(spark, sf_dir, "events").select(F.concat(F.lit("app.events."), "event_type").alias("fq_name"), "value", second(F.col("ts")).alias("observed_at"), F.col("event_id").alias("seq"))


def obs_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric for each supplier: revenue shipped by day."""
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4)
    out = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_shipdate").agg(revenue.alias("value"))
    return out.select(F.concat(F.lit("shop.shipments.s"), F.col("l_suppkey").cast("string")).alias("fq_name"), "value", second(F.col("l_shipdate")).alias("observed_at"), F.lit(0).cast("long").alias("seq"))


def obs_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric for each order priority: order value by day."""
    out = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderdate").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return out.select(F.concat(F.lit("shop.orders."), F.lower("o_orderpriority")).alias("fq_name"), "value", second(F.col("o_orderdate")).alias("observed_at"), F.lit(0).cast("long").alias("seq"))


#: Sources whose metrics have a value a day.
DAILY = (obs_shipments, obs_orders)


def metric_dim(observations: DataFrame) -> DataFrame:
    """Declared semantics of each metric that occurs: unit, direction, aggregation."""
    name = F.col("fq_name")
    last = F.substring_index(name, ".", -1)
    number = F.expr("try_cast(regexp_extract(substring_index(fq_name, '.', -1), '([0-9]+)$', 1) AS BIGINT)")
    direction = (
        F.when(name.startswith("app.") & (last == "error"), "lower_is_better").when(name.startswith("app.") & (last == "view"), "neutral").when(name.startswith("app."), "higher_is_better")
        .when(number % 3 == 0, "higher_is_better").when(number % 3 == 1, "lower_is_better").otherwise("neutral")
    )
    unit = F.when(name.startswith("shop.") | (last == "purchase"), "USD").otherwise("")
    aggregation = F.when(name.startswith("shop."), "sum").otherwise("avg")
    return observations.select("fq_name").distinct().select("fq_name", unit.alias("unit"), direction.alias("direction"), aggregation.alias("aggregation"))


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeline marks: large signups are releases, large errors are commits with a hash."""
    rows = table(spark, sf_dir, "events").where("value >= 150 AND event_type IN ('signup', 'error')")
    release = F.col("event_type") == "signup"
    return rows.select(
        F.when(release, "release").otherwise("commit").alias("kind"),
        F.when(release, "").otherwise(F.md5(F.col("event_id").cast("string"))).alias("metric_fq"),
        F.when(release, F.concat(F.lit("release "), F.col("event_id").cast("string"))).alias("description"),
        second(F.col("ts")).alias("at"), F.col("event_id").alias("seq"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of a connector: stream, time and a JSON payload."""
    rows = table(spark, sf_dir, "events")
    payload = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("value")))
    return rows.select(F.col("event_type").alias("stream"), F.col("ts").cast("timestamp").alias("timestamp"), payload.alias("data_json"), F.col("event_id").alias("seq"))
