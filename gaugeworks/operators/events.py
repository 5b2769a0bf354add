"""The timeline of anomalies, releases, commits and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import scores as S
from gaugeworks.operators.baselines import moment

KEY = ("kind", "metric_fq", "window_days", "at")
COLUMNS = ("event_id", "kind", "metric_fq", "observed_value", "baseline_mean", "stddev_from_mean", "direction", "window_days", "description", "at")


def with_id(events: DataFrame) -> DataFrame:
    """A stable id from the unique key."""
    return events.withColumn("event_id", F.xxhash64(*KEY))


def marks_as_events(marks: DataFrame) -> DataFrame:
    """Notes and commits as events: no values, window 0, direction none; a commit's hash is its key."""
    none = F.lit(None).cast("double")
    return marks.select("kind", "metric_fq", none.alias("observed_value"), none.alias("baseline_mean"), none.alias("stddev_from_mean"), F.lit("none").alias("direction"), F.lit(0).alias("window_days"), "description", "at", "seq")


def insert_or_ignore(events: DataFrame, arrival: str = "seq") -> DataFrame:
    """The first arrival of each key stays. A partial aggregate, so a key that comes very often shuffles little."""
    others = [c for c in events.columns if c not in (*KEY, arrival)]
    first = events.groupBy(*KEY).agg(F.min(F.struct(arrival, *others)).alias("f"))
    return with_id(first.select(*KEY, *[f"f.{c}" for c in others]))


def timeline(events: DataFrame) -> DataFrame:
    """Newest first, with a line of text by kind."""
    sign = F.when(F.col("stddev_from_mean") < 0, "-").otherwise("+")
    sigma = F.concat(sign, F.replace(F.format_number(F.abs("stddev_from_mean"), 2), F.lit(","), F.lit("")))
    anomaly = F.concat("metric_fq", F.lit(": "), S.four_digits(F.col("observed_value")), F.lit(" ("), sigma, F.lit("σ, "), F.col("window_days").cast("string"), F.lit("d baseline) -- "), "direction")
    detail = F.when(F.col("kind") == "anomaly", anomaly).otherwise(F.coalesce(F.expr("nullif(description, '')"), "metric_fq"))
    return events.withColumn("detail", detail).orderBy(F.col("at").desc(), "event_id")


def in_window(events: DataFrame, start: str, as_of: str) -> DataFrame:
    return events.where((F.col("at") >= moment(start)) & (F.col("at") <= moment(as_of)))


def about(metric: Column, events_metric: Column, kind: Column) -> Column:
    """An event concerns a metric if it is its anomaly or no anomaly at all."""
    return (events_metric == metric) | (kind != "anomaly")


CAUSE_HOURS = 48
#: Targets of a slot that marks meet in one part of it, about.
TARGETS_AT_ONCE = 64


def causal_candidates(events: DataFrame, at_once: int = TARGETS_AT_ONCE) -> DataFrame:
    """Marks up to 48 hours before an anomaly of a metric; each mark once for each metric, with the newest such anomaly.

    An interval join by 48-hour slots. A target's anomalies of a slot are one row: its hours, each with its newest anomaly
    and its times (3,600 at most), so a mark meets a target once, however many anomalies that has, and looks into the one
    hour in which its 48 end. A mark goes to its slot and the next. The targets of a slot are dealt into as many
    parts as their number asks for, and a mark goes to each of those, so that a busy slot isn't one task.
    """
    slot = CAUSE_HOURS * 3600
    at = F.unix_timestamp("at")
    anomalies = events.where("kind = 'anomaly'").select(F.col("metric_fq").alias("target"), at.alias("a_s"))
    hourly = anomalies.groupBy("target", F.floor(F.col("a_s") / slot).alias("slot"), F.floor(F.col("a_s") / 3600).alias("hour")).agg(F.max("a_s").alias("newest"), F.collect_set("a_s").alias("times"))
    targets = hourly.groupBy("target", "slot").agg(F.max("newest").alias("newest"), F.collect_list(F.struct("hour", "newest", "times")).alias("hours"))
    # a row for each slot: a century has 18,263
    parts = F.broadcast(targets.groupBy("slot").agg(F.ceil(F.count("*") / at_once).alias("parts")))
    targets = targets.join(parts, "slot").withColumn("part", F.pmod(F.xxhash64("target"), F.col("parts")))
    own = F.floor(at / slot)
    marks = events.where("kind <> 'anomaly'").select("event_id", "kind", "metric_fq", "description", F.col("at").alias("event_at"), at.alias("e_s"), F.explode(F.array(F.struct(own.alias("slot"), F.lit(False).alias("later")), F.struct((own + 1).alias("slot"), F.lit(True).alias("later")))).alias("s"))
    marks = marks.select("*", "s.slot", "s.later").drop("s").join(parts, "slot")
    marks = marks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    end = F.col("e_s") + slot
    earlier = F.array_max(F.transform(F.filter("hours", lambda h: h["hour"] < F.floor(end / 3600)), lambda h: h["newest"]))
    same = F.array_max(F.filter(F.flatten(F.transform(F.filter("hours", lambda h: h["hour"] == F.floor(end / 3600)), lambda h: h["times"])), lambda t: t <= end))
    newest = F.when(F.col("later"), F.greatest(earlier, same)).when(F.col("newest") >= F.col("e_s"), F.col("newest"))
    pairs = marks.join(targets.drop("parts"), ["slot", "part"]).withColumn("found", newest).where("found IS NOT NULL")
    last = pairs.groupBy("target", "event_id", "kind", "metric_fq", "description", "event_at").agg(F.timestamp_seconds(F.max("found")).alias("anomaly_at"))
    hours = (F.unix_timestamp("anomaly_at") - F.unix_timestamp("event_at")) / 3600.0
    out = last.withColumn("proximity_hours", hours)
    return out.withColumn("confidence", S.proximity_confidence(F.col("proximity_hours"))).withColumn("label", F.coalesce(F.expr("nullif(description, '')"), "kind"))
