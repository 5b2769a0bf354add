"""Direction-aware sigma anomalies, as of one moment or for the whole past."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import scores as S
from gaugeworks.operators.baselines import DAYS, replay
from gaugeworks.operators.events import insert_or_ignore

DEFAULT_K, DEFAULT_MIN = 2.5, 14


def thresholds(metrics: DataFrame, overrides: DataFrame | None = None, k: float | None = None, min_samples: int | None = None) -> DataFrame:
    """Effective ``k`` and ``min_samples`` of each metric: override, then global, then default; values that aren't positive don't count."""
    k = k if k and k > 0 else DEFAULT_K
    least = min_samples if min_samples and min_samples > 0 else DEFAULT_MIN
    names = metrics.select("fq_name").distinct()
    if overrides is None:
        return names.select("fq_name", F.lit(float(k)).alias("k"), F.lit(int(least)).alias("min_samples"))
    out = names.join(overrides.select("fq_name", "anomaly_k", F.col("min_samples").alias("least")), "fq_name", "left")
    return out.select("fq_name", F.coalesce(F.when(F.col("anomaly_k") > 0, F.col("anomaly_k")), F.lit(float(k))).alias("k"), F.coalesce(F.when(F.col("least") > 0, F.col("least")), F.lit(int(least))).alias("min_samples"))


def flagged(checked: DataFrame, dim: DataFrame, limits: DataFrame) -> DataFrame:
    """Anomaly events from rows ``fq_name, value, observed_at, seq, window_days, mean, stddev, sample_count``."""
    joined = checked.join(limits, "fq_name").join(dim.select("fq_name", F.col("direction").alias("wanted")), "fq_name", "left")
    dev = (F.col("value") - F.col("mean")) / F.col("stddev")
    hits = joined.where((F.col("sample_count") >= F.col("min_samples")) & (F.col("stddev") != 0)).withColumn("dev", dev).where(F.abs("dev") >= F.col("k"))
    return hits.select(
        F.lit("anomaly").alias("kind"), F.col("fq_name").alias("metric_fq"), F.col("value").alias("observed_value"), F.col("mean").alias("baseline_mean"),
        F.col("dev").alias("stddev_from_mean"), S.surprise(F.col("wanted"), F.col("dev")).alias("direction"), "window_days", F.lit(None).cast("string").alias("description"), F.col("observed_at").alias("at"), "seq",
    )


def detect(latest: DataFrame, baselines: DataFrame, dim: DataFrame, limits: DataFrame) -> DataFrame:
    """Anomalies of one new observation for each metric against stored baselines."""
    return insert_or_ignore(flagged(latest.join(baselines, "fq_name"), dim, limits))


def replayed(obs: DataFrame, dim: DataFrame, limits: DataFrame, days: tuple[int, ...] = DAYS, start: str | None = None, end: str | None = None, short: bool = False) -> DataFrame:
    """What repeated runs would have stored over the whole past, or from ``start`` to ``end``; ``short`` as of ``replay``."""
    return insert_or_ignore(flagged(replay(obs, days, start, end, short), dim, limits))


def latest(obs: DataFrame, as_of: str | None = None) -> DataFrame:
    """The last observation of each metric, by time, then arrival."""
    rows = obs if as_of is None else obs.where(F.col("observed_at") <= F.to_timestamp(F.lit(as_of)))
    last = rows.groupBy("fq_name").agg(F.max(F.struct("observed_at", "seq", "value")).alias("m"))
    return last.select("fq_name", "m.value", "m.observed_at", "m.seq")
