"""Catalog of streams and metrics, observations, connector state and health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.baselines import moment


def upsert_streams(old: DataFrame, runs: DataFrame) -> DataFrame:
    """Keeps first_seen_at, advances last_seen_at, takes the newest kind, adds up rows."""
    both = old.unionByName(runs)
    return both.groupBy("connector", "stream").agg(F.max_by("kind", "last_seen_at").alias("kind"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.sum("row_count_lifetime").alias("row_count_lifetime"))


def upsert_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    """New declarations replace old ones; the last value and its time stay where the new value is null."""
    o, n = old.alias("o"), new.alias("n")
    pick = lambda c: F.when(F.col("n.fq_name").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    keep = lambda c: F.when(F.col("n.last_value").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    both = o.join(n, F.col("o.fq_name") == F.col("n.fq_name"), "full_outer")
    return both.select(F.coalesce("n.fq_name", "o.fq_name").alias("fq_name"), pick("unit"), pick("direction"), pick("aggregation"), keep("last_value"), keep("last_value_at"))


def last_records(records: DataFrame, keys: tuple[str, ...] = ("run_id", "stream")) -> DataFrame:
    """The last record of each run and stream in order of arrival."""
    last = records.groupBy(*keys).agg(F.max(F.struct("seq", "timestamp", "data_json")).alias("m"))
    return last.select(*keys, "m.seq", "m.timestamp", "m.data_json")


def metric_values(last: DataFrame, connector: str, columns: list[str]) -> DataFrame:
    """Long observations of the declared metric columns. Only JSON numbers count, not text that looks like one."""
    fields = F.transform_values(F.from_json("data_json", "map<string,variant>"), lambda _, v: F.to_json(v))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("__f")[c].alias("raw")) for c in columns]))
    rows = last.withColumn("__f", fields).select("stream", "timestamp", pairs.alias("p"))
    value = F.when(F.col("p.raw").rlike(r"^-?\d"), F.col("p.raw").try_cast("double"))
    return rows.select(F.concat_ws(".", F.lit(connector), "stream", "p.column").alias("fq_name"), value.alias("value"), F.date_trunc("second", "timestamp").alias("observed_at")).where("value IS NOT NULL")


def declared(metrics: DataFrame, names: DataFrame) -> DataFrame:
    """``names(fq_name)`` with whether each is declared."""
    known = metrics.select("fq_name", F.lit(True).alias("known")).distinct()
    return names.join(known, "fq_name", "left").select("fq_name", F.coalesce("known", F.lit(False)).alias("declared"))


def effective_schema(static: DataFrame, announced: DataFrame) -> DataFrame:
    """The declared schema of each stream, else the last announced one."""
    last = announced.groupBy("stream").agg(F.max_by("schema", "seq").alias("announced"))
    return static.select("stream", F.col("schema").alias("declared")).join(last, "stream", "full_outer").select("stream", F.coalesce("declared", "announced").alias("schema"), F.when(F.col("declared").isNotNull(), "declared").otherwise("announced").alias("source"))


def save_state(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replaces whole entries by key."""
    return old.join(new.select("key"), "key", "left_anti").unionByName(new)


def delete_state(old: DataFrame, keys: DataFrame) -> DataFrame:
    return old.join(keys.select("key"), "key", "left_anti")


STALE_AFTER_S = 24 * 3600


def health(configured: DataFrame, state: DataFrame, manifest_counts: DataFrame | None, as_of: str) -> DataFrame:
    """Each configured stream with its last sync, landed rows (-1 unknown) and status: never, stale (over a day) or ok.

    ``configured(product, connector, stream)``, ``state(key, updated_at)`` with key ``product/connector``.
    """
    key = F.concat_ws("/", "product", "connector")
    out = configured.withColumn("key", key).join(state.select("key", F.col("updated_at").alias("last_sync")), "key", "left")
    if manifest_counts is None:
        out = out.withColumn("records", F.lit(-1).cast("long"))
    else:
        out = out.join(manifest_counts.select("key", "stream", F.col("rows").alias("records")), ["key", "stream"], "left").fillna(0, ["records"])
    age = F.unix_timestamp(moment(as_of)) - F.unix_timestamp("last_sync")
    status = F.when(F.col("last_sync").isNull(), "never").when(age > STALE_AFTER_S, "stale").otherwise("ok")
    return out.withColumn("status", status).orderBy("product", "connector", "stream")


def orphans(configured: DataFrame, state: DataFrame) -> DataFrame:
    """State that no configured connector owns."""
    return state.join(configured.select(F.concat_ws("/", "product", "connector").alias("key")).distinct(), "key", "left_anti")
