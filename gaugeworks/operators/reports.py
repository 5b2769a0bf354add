"""Explain, compare, investigate and summarize, for all metrics in one job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import scores as S
from gaugeworks.operators import baselines as B
from gaugeworks.operators.anomalies import latest
from gaugeworks.operators.events import causal_candidates, in_window


def event_counts(dim: DataFrame, events: DataFrame, start: str, as_of: str) -> DataFrame:
    """Anomalies of each metric in the window (how many, the newest) and how many other events there are.

    Other events are the same for all metrics: one number, not a pairing with every metric.
    """
    rows = in_window(events, start, as_of)
    own = rows.where("kind = 'anomaly'").groupBy(F.col("metric_fq").alias("fq_name")).agg(F.count("*").alias("n_anomalies"), F.max(F.struct("at", -F.col("window_days"), F.col("direction").alias("label"))).alias("m"))
    shared = rows.where("kind <> 'anomaly'").agg(F.count("*").alias("n_correlated"))
    out = dim.select("fq_name").join(own, "fq_name", "left").crossJoin(F.broadcast(shared))  # one row
    return out.select("fq_name", F.coalesce("n_anomalies", F.lit(0)).cast("long").alias("n_anomalies"), F.col("m.at").alias("newest_at"), F.col("m.label").alias("newest_label"), "n_correlated")


def explain(obs: DataFrame, dim: DataFrame, baselines: DataFrame, events: DataFrame, as_of: str, since_s: int) -> DataFrame:
    """Each declared metric's current value, best baseline, window and prior period, events, confidence."""
    start = B.shifted(as_of, -since_s)
    now = latest(obs, as_of).select("fq_name", F.col("value").alias("current_value"), F.col("observed_at").alias("current_at"))
    stats = B.period_stats(obs, {"window": (start, B.shifted(as_of, 1)), "prior": (B.shifted(as_of, -2 * since_s), start)})
    base = B.best(baselines, B.need_days(since_s)).select("fq_name", "window_days", "mean", "stddev", "sample_count")
    out = dim.select("fq_name", "direction", "unit").join(now, "fq_name", "left").join(stats, "fq_name", "left").join(base, "fq_name", "left").join(event_counts(dim, events, start, as_of), "fq_name", "left")
    out = out.withColumns({"window_mean": F.coalesce("window_mean", F.lit(0.0)), "window_n": F.coalesce("window_n", F.lit(0)), "prior_mean": F.when(F.col("prior_n") > 0, F.col("prior_mean")), "prior_n": F.coalesce("prior_n", F.lit(0))})
    out = out.withColumn("dev", S.deviation(F.col("current_value"), F.col("mean"), F.col("stddev"))).withColumn("confidence", S.baseline_confidence(F.col("sample_count")))
    return out.withColumn("score", S.score(F.col("direction"), F.col("dev")))


def event_lists(metrics: list[str], events: DataFrame, start: str, as_of: str) -> DataFrame:
    """For each of the chosen metrics its events of the window as rows, newest first: its own anomalies, and all other events.

    A report is asked for by name, so the names are a short list; no metric is joined with events that aren't its own.
    """
    rows = in_window(events, start, as_of)
    own = F.when((F.col("kind") == "anomaly") & F.col("metric_fq").isin(metrics), F.array("metric_fq"))
    shared = F.when(F.col("kind") != "anomaly", F.lit(list(metrics)))
    rows = rows.withColumn("fq_name", F.explode(F.coalesce(own, shared)))
    return rows.orderBy("fq_name", F.col("at").desc(), "kind", "metric_fq", "window_days")


def summary(explained: DataFrame) -> DataFrame:
    """One sentence for each metric."""
    c = F.col
    day = F.date_format("newest_at", "yyyy-MM-dd")
    spike = F.when(c("n_anomalies") == 1, F.concat(F.lit(", with one "), "newest_label", F.lit(" spike on "), day)).when(
        c("n_anomalies") > 1, F.concat(F.lit(", with "), c("n_anomalies").cast("string"), F.lit(" anomalies including a "), "newest_label", F.lit(" spike on "), day)
    )
    near = F.when(c("n_correlated") > 0, F.concat(F.lit("; "), c("n_correlated").cast("string"), F.lit(" correlated event(s) in window")))
    trend = S.trend(c("direction"), c("dev"), c("window_mean"), c("window_n"), c("mean"))
    tag = S.tag(c("confidence"), c("window_days"), c("sample_count"))
    return explained.withColumn("summary", F.concat(S.short_name(c("fq_name")), F.lit(" is "), trend, F.coalesce(spike, F.lit("")), F.coalesce(near, F.lit("")), F.lit(" "), tag, F.lit(".")))


def narrative(explained: DataFrame, since_text: str) -> DataFrame:
    """A few lines for each metric: current value, baseline, change since the prior period."""
    c = F.col
    current = F.concat(F.lit("Current value: "), S.four_digits(c("current_value")), F.lit(" "), "unit", F.lit(" (as of "), F.date_format("current_at", "yyyy-MM-dd"), F.lit(").\n"))
    head = F.concat(F.lit("The "), c("window_days").cast("string"), F.lit("d baseline "))
    label = F.concat(F.lit(" "), "unit", F.lit(" ("), S.direction_text(c("direction")), F.lit(")"))
    spread = F.concat(head, F.lit("is "), S.four_digits(c("mean")), F.lit(" +/- "), S.four_digits(c("stddev")), label, F.lit("; current is "), S.one_place(c("dev")), F.lit(" sigma from the mean.\n"))
    flat = F.concat(head, F.lit("mean is "), S.four_digits(c("mean")), label, F.lit(".\n"))
    pct = B.pct_change(c("window_mean"), c("prior_mean"))
    prior = F.concat(F.lit(f"Compared to the prior {since_text} (mean "), S.four_digits(c("prior_mean")), F.lit(", "), c("prior_n").cast("string"), F.lit(" samples), this period is "), S.one_place(pct), F.lit("%.\n"))
    silent = c("current_value").isNull() & (c("window_n") == 0)
    body = F.concat(
        F.coalesce(F.when(c("current_value").isNotNull(), current), F.lit("")), F.coalesce(F.when(c("mean").isNotNull(), F.when(c("dev").isNotNull(), spread).otherwise(flat)), F.lit("")),
        F.coalesce(F.when(c("prior_mean").isNotNull() & (c("window_n") > 0), prior), F.lit("")),
    )
    return explained.withColumn("narrative", F.concat("fq_name", F.lit(f" -- last {since_text}\n\n"), F.when(silent, F.lit("No observations recorded in this window.\n")).otherwise(body)))


def improved(prefix: str = ""):
    c = lambda n: F.col(f"{prefix}{n}")
    by_dev = ((c("dev") > 0) & (c("direction") == S.HIGHER)) | ((c("dev") < 0) & (c("direction") == S.LOWER))
    by_mean = ((c("window_mean") > c("prior_mean")) & (c("direction") == S.HIGHER)) | ((c("window_mean") < c("prior_mean")) & (c("direction") == S.LOWER))
    return F.coalesce(F.when(c("dev").isNotNull(), by_dev).when(c("prior_mean").isNotNull() & (c("window_n") > 0), by_mean), F.lit(False))


def compare_pairs(pairs: DataFrame, explained: DataFrame) -> DataFrame:
    """Both explanations of each pair ``(a, b)``, a verdict, whether they diverged, and the mean confidence."""
    side = lambda p: explained.select(*[F.col(n).alias(f"{p}_{n}") for n in ("fq_name", "direction", "dev", "window_mean", "window_n", "prior_mean", "confidence")])
    both = pairs.join(side("a"), F.col("a") == F.col("a_fq_name")).join(side("b"), F.col("b") == F.col("b_fq_name"))
    up_a, up_b = improved("a_"), improved("b_")
    a, b = S.short_name(F.col("a")), S.short_name(F.col("b"))
    verdict = (
        F.when(up_a & up_b, "both improved").when(~up_a & ~up_b, "both regressed")
        .when(up_a, F.concat(F.lit("diverged: "), a, F.lit(" improved, "), b, F.lit(" regressed"))).otherwise(F.concat(F.lit("diverged: "), a, F.lit(" regressed, "), b, F.lit(" improved")))
    )
    return both.select("a", "b", verdict.alias("verdict"), (up_a != up_b).alias("diverged"), ((F.col("a_confidence") + F.col("b_confidence")) / 2).alias("confidence"))


def compare_periods(obs: DataFrame, dim: DataFrame, baselines: DataFrame, as_of: str, since_s: int, prior_s: int) -> DataFrame:
    """Recent against prior period of each metric, with change in percent, verdict and best baseline."""
    start = B.shifted(as_of, -since_s)
    stats = B.period_stats(obs, {"recent": (start, B.shifted(as_of, 1)), "prior": (B.shifted(start, -prior_s), start)})
    out = dim.select("fq_name", "direction", "unit").join(stats, "fq_name", "left").fillna({"recent_mean": 0.0, "prior_mean": 0.0, "recent_n": 0, "prior_n": 0})
    pct = F.when(F.col("prior_n") > 0, B.pct_change(F.col("recent_mean"), F.col("prior_mean"))).otherwise(F.lit(0.0))
    up = ((F.col("pct_change") > 0) & (F.col("direction") == S.HIGHER)) | ((F.col("pct_change") < 0) & (F.col("direction") == S.LOWER))
    verdict = F.when(F.col("prior_n") == 0, "no prior data to compare").when(F.col("prior_mean") == 0, "stable (prior mean zero)").when(up, "improved").when(F.col("pct_change") == 0, "stable").otherwise("regressed")
    base = B.best(baselines, B.need_days(since_s)).select("fq_name", "window_days", F.col("mean").alias("baseline_mean"))
    return out.withColumn("pct_change", pct).withColumn("verdict", verdict).join(base, "fq_name", "left")


def shared_events(events: DataFrame, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Events other than anomalies that lie in both windows, newest first."""
    marks = events.where("kind <> 'anomaly'")
    return in_window(marks, *b).join(in_window(marks, *a).select("event_id"), "event_id", "left_semi").orderBy(F.col("at").desc(), "event_id")


STRONG = 0.6


#: Series of a connector that are compared with others at once, about; blocks have up to WIDEST times as many.
CORRELATED_AT_ONCE, WIDEST = 256, 16
#: Tasks that pairs of blocks are dealt to; names that a task gives out at once; pairs of metrics that one row becomes (Spark holds them all).
PAIR_TASKS, NAMES_AT_ONCE, PAIRS_OF_A_ROW = 128, 1 << 15, 1 << 12


def _correlated(least_r: float | None, at_once: int):
    """Sums over shared days of all pairs of two blocks of series, as matrix products of ``at_once`` rows; weak pairs stay inside.

    Both directions of a pair are given: rows of the metrics of one series and some of their siblings, a metric itself among them.
    """

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, low, high = (k.as_py() for k in key)
        table = pa.Table.from_batches(batches)
        block, metrics, days = table["block"].to_numpy(), table["metrics"].combine_chunks().cast(pa.list_(pa.string())), table["days"].combine_chunks()
        names, size = metrics.flatten(), np.diff(metrics.offsets.to_numpy())
        begin = np.cumsum(size) - size
        at = days.flatten().field("day").to_numpy(zero_copy_only=False).astype(np.int64)
        place, column = np.unique(at, return_inverse=True)
        row = np.repeat(np.arange(len(days)), np.diff(days.offsets.to_numpy()))
        has, value = np.zeros((len(days), len(place))), np.zeros((len(days), len(place)))
        has[row, column] = 1
        value[row, column] = days.flatten().field("value").to_numpy(zero_copy_only=False)
        first, second = np.flatnonzero(block == low), np.flatnonzero(block == high)
        has_b, value_b = has[second].T, value[second].T
        square_b = value_b**2
        for start in range(0, len(first), at_once):
            a = first[start : start + at_once]
            has_a, value_a = has[a], value[a]
            n, xy = has_a @ has_b, value_a @ value_b
            sx, sy = value_a @ has_b, has_a @ value_b
            xx, yy = (value_a**2) @ has_b, has_a @ square_b
            with np.errstate(divide="ignore", invalid="ignore"):
                bottom = np.sqrt(np.maximum(xx - sx * sx / n, 0)) * np.sqrt(np.maximum(yy - sy * sy / n, 0))
                r = np.where(bottom > 0, (xy - sx * sy / n) / bottom, 0.0)
            wanted = n >= 2
            if least_r is not None:
                wanted &= np.abs(r) >= least_r
            if low == high:  # a series is paired with itself, once, for the metrics that share it
                wanted &= a[:, None] <= second
            for these, those, is_, of, shared in ((a, second, wanted, r, n), (second, a, (wanted & (a[:, None] != second)).T, r.T, n.T)):
                i, j = np.nonzero(is_)
                many = size[those[j]]
                cuts = np.flatnonzero(np.diff(np.cumsum(many) // NAMES_AT_ONCE)) + 1
                for x, y, of_y in zip(np.split(i, cuts), np.split(j, cuts), np.split(many, cuts), strict=True):
                    before = np.cumsum(of_y) - of_y
                    sibling = names.take(pa.array(np.repeat(begin[those[y]] - before, of_y) + np.arange(of_y.sum())))
                    each = [sibling, pa.array(np.repeat(of[x, y], of_y)), pa.array(np.repeat(shared[x, y].astype(np.int64), of_y))]
                    mine = np.flatnonzero(np.diff(x, prepend=-1))
                    owner, begins = these[x[mine]], before[mine]
                    step = np.maximum(PAIRS_OF_A_ROW // np.maximum(size[owner], 1), 1)
                    rows = -(-np.diff(np.append(begins, len(sibling))) // step)
                    turn = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
                    begins = np.repeat(begins, rows) + turn * np.repeat(step, rows)
                    siblings = pa.ListArray.from_arrays(pa.array(np.append(begins, len(sibling)).astype(np.int32)), pa.StructArray.from_arrays(each, ["sibling", "r", "n"]))
                    yield pa.RecordBatch.from_arrays([metrics.take(pa.array(np.repeat(owner, rows))), siblings], ["metrics", "siblings"])

    return run


def sibling_correlations(obs: DataFrame, as_of: str, since_s: int, least_r: float | None = STRONG, at_once: int = CORRELATED_AT_ONCE, places: int | None = None) -> DataFrame:
    """Pearson r of daily means for metrics of the same connector, from sums over shared days; 0 when a side doesn't vary.

    A series, with the metrics that share it, is one row: pairs of series are computed, rounded and sent once, and become pairs of
    metrics last of all. A connector's series are dealt into 16 blocks, or more, so that a block has sixteen times ``at_once`` of them at
    most, about; each pair of blocks is a group of its own, so no key holds a whole connector. A metric's name is sent once for each
    block, so up to 65,536 series what is shuffled grows with the metrics alone. A pair below ``least_r`` never leaves its task; the
    rows returned are as many as the strong pairs. With ``places``, r and confidence are rounded as DuckDB does (``round`` goes by way of a
    decimal, which takes longer than all else that a row takes).
    """
    days = B.daily_means(obs, B.shifted(as_of, -since_s), B.shifted(as_of, 1)).where("value IS NOT NULL")
    day = F.struct(F.unix_date("day").alias("day"), F.col("value").cast("double").alias("value"))
    metrics = days.groupBy(F.col("fq_name").alias("metric")).agg(F.array_sort(F.collect_list(day)).alias("days")).withColumn("connector", S.connector(F.col("metric"))).withColumn("like", F.xxhash64("connector", "days"))
    # metrics of one series are at_once to a row at most, about
    equal = metrics.groupBy(F.col("like").alias("as")).agg(F.ceil(F.count("*") / at_once).alias("pieces"))
    piece = F.pmod(F.xxhash64("metric"), F.col("pieces"))
    series = metrics.join(equal, F.col("like") == F.col("as")).groupBy("connector", "days", "like", piece.alias("piece")).agg(F.collect_list("metric").alias("metrics"))
    blocks = F.greatest(F.least(F.ceil(F.sum(F.size("metrics")) / at_once), F.lit(WIDEST)), F.ceil(F.count("*") / (at_once * WIDEST)))
    sizes = series.groupBy(F.col("connector").alias("of")).agg(blocks.alias("blocks"))
    dealt = series.join(sizes, F.col("connector").eqNullSafe(F.col("of"))).withColumn("block", F.pmod(F.xxhash64("like", "piece"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = dealt.select("connector", "metrics", "block", "days", other.alias("other"))
    dealt = dealt.select("connector", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "metrics", "block", "days")
    keys = ("connector", "low", "high")
    found = dealt.repartition(PAIR_TASKS, *keys).groupBy(*keys).applyInArrow(_correlated(least_r, at_once), "metrics array<string>, siblings array<struct<sibling string, r double, n long>>")
    pairs = found.select("metrics", F.inline("siblings")).withColumn("confidence", S.correlation_confidence(F.col("r"), F.col("n")))
    if places is not None:
        pairs = pairs.withColumns({c: F.signum(c) * F.floor(F.abs(c) * 10.0**places + 0.5) / 10.0**places for c in ("r", "confidence")})
    return pairs.select(F.explode("metrics").alias("metric"), "sibling", "r", "n", "confidence").where("metric <> sibling")


def investigate(explained: DataFrame, events: DataFrame, obs: DataFrame, as_of: str, since_s: int) -> DataFrame:
    """Explanation with causes and siblings counted and the best of each."""
    causes = causal_candidates(in_window(events, B.shifted(as_of, -since_s), as_of)).groupBy(F.col("target").alias("fq_name")).agg(F.count("*").alias("n_causes"), F.min("proximity_hours").alias("nearest_hours"))
    siblings = sibling_correlations(obs, as_of, since_s).groupBy(F.col("metric").alias("fq_name")).agg(F.count("*").alias("n_siblings"), F.max(F.abs("r")).alias("strongest_r"))
    out = explained.join(causes, "fq_name", "left").join(siblings, "fq_name", "left")
    return out.fillna(0, ["n_causes", "n_siblings"])


def summarize(explained: DataFrame, top: int) -> DataFrame:
    """The ``top`` metrics by score (all for 0 or less), ties by name."""
    ranked = explained.withColumn("connector", S.connector(F.col("fq_name"))).orderBy(F.col("score").desc(), "fq_name")
    return ranked.limit(top) if top > 0 else ranked


def totals(dim: DataFrame) -> DataFrame:
    return dim.agg(F.count("*").alias("total_metrics"), F.count_distinct(S.connector(F.col("fq_name"))).alias("total_connectors"))
