"""Baselines, anomalies, events and reports on small pinned inputs."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import scores as S
from gaugeworks.operators import anomalies as A
from gaugeworks.operators import baselines as B
from gaugeworks.operators import events as V
from gaugeworks.operators import reports as R

AS_OF = "2024-03-01 00:00:00"
BASE = datetime(2024, 3, 1)
OBS = "fq_name string, value double, observed_at timestamp, seq long"


def obs(spark, values, name="a.b.c", hours=1):
    n = len(values)
    return spark.createDataFrame([(name, float(v), BASE - timedelta(hours=hours * (n - i)), i) for i, v in enumerate(values)], OBS)


@pytest.mark.parametrize(("values", "mean", "sd", "low", "high"), [(range(1, 11), 5.5, math.sqrt(8.25), 1, 10), ([2, 4, 4, 4, 5, 5, 7, 9], 5, 2, 2, 9), ([42], 42, 0, 42, 42)])
def test_window_stats(spark, values, mean, sd, low, high):
    rows = B.compute(obs(spark, list(values)), AS_OF).collect()
    assert [r.window_days for r in sorted(rows, key=lambda r: r.window_days)] == [7, 30, 90]
    for r in rows:
        assert (r.mean, r.min, r.max, r.sample_count) == (mean, low, high, len(list(values)))
        assert r.stddev == pytest.approx(sd)


def test_no_data_gives_no_row(spark):
    assert B.compute(obs(spark, []), AS_OF).count() == 0
    assert B.compute(obs(spark, [1, 2], hours=24 * 200), AS_OF).count() == 0


def test_cap_keeps_the_oldest(spark):
    rows = B.compute(obs(spark, range(100)), AS_OF, cap=10).collect()
    assert {(r.sample_count, r.min, r.max) for r in rows} == {(10, 0.0, 9.0)}


def test_a_stale_baseline_stays(spark):
    rows = obs(spark, [1, 2, 3])
    old = B.compute(rows, AS_OF)
    new = B.recompute(rows, old, "2024-03-20 00:00:00")
    seven = new.where("window_days = 7").first()
    assert seven.last_computed_at == datetime(2024, 3, 1) and new.count() == 3


def test_replay_ends_where_the_baseline_is(spark):
    rows = obs(spark, [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9], hours=30)
    last = B.replay(rows).where(F.col("seq") == 14).select("window_days", "mean", "stddev", "sample_count").collect()
    at = BASE - timedelta(hours=30)
    now = B.compute(rows, str(at)).select("window_days", "mean", "stddev", "sample_count").collect()
    for a, b in zip(sorted(last), sorted(now), strict=True):
        assert a == pytest.approx(b)


def test_replay_looks_over_block_borders(spark):
    rows = obs(spark, range(50), hours=24 * 7)
    got = {r.seq: r.sample_count for r in B.replay(rows, (90,)).collect()}
    assert got == {i: min(i, 12) + 1 for i in range(50)}


def baselines(spark, days=7, mean=100.0, sd=10.0, n=20):
    return spark.createDataFrame([("a.b.c", days, mean, sd, n)], "fq_name string, window_days int, mean double, stddev double, sample_count long")


def dim(spark, direction="higher_is_better", names=("a.b.c",)):
    return spark.createDataFrame([(n, "", direction) for n in names], "fq_name string, unit string, direction string")


@pytest.mark.parametrize(("value", "sd", "n", "direction", "want"), [(70, 10, 20, "higher_is_better", [(-3.0, "surprise-bad")]), (130, 10, 20, "higher_is_better", [(3.0, "surprise-good")]), (130, 10, 20, "lower_is_better", [(3.0, "surprise-bad")]), (130, 10, 20, "neutral", [(3.0, "neutral")]), (70, 10, 13, "higher_is_better", []), (70, 0, 20, "higher_is_better", []), (120, 10, 20, "neutral", []), (125, 10, 20, "neutral", [(2.5, "neutral")])])
def test_anomaly(spark, value, sd, n, direction, want):
    names = dim(spark, direction)
    out = A.detect(obs(spark, [value]), baselines(spark, sd=float(sd), n=n), names, A.thresholds(names))
    assert [(r.stddev_from_mean, r.direction) for r in out.collect()] == want


def test_anomalies_are_inserted_once(spark):
    names = dim(spark)
    twice = obs(spark, [70]).union(obs(spark, [70]).withColumn("seq", F.lit(9).cast("long")))
    assert A.detect(twice, baselines(spark), names, A.thresholds(names)).count() == 1


def test_thresholds(spark):
    over = spark.createDataFrame([("x", 3.5, None), ("y", -1.0, 5), ("z", None, 0)], "fq_name string, anomaly_k double, min_samples int")
    got = {r.fq_name: (r.k, r.min_samples) for r in A.thresholds(dim(spark, names=("x", "y", "z", "w")), over, k=2.0).collect()}
    assert got == {"x": (3.5, 14), "y": (2.0, 5), "z": (2.0, 14), "w": (2.0, 14)}


def test_best_baseline(spark):
    rows = baselines(spark, 7).union(baselines(spark, 30)).union(baselines(spark, 90))
    pick = lambda d: B.best(rows, d).first().window_days
    assert [pick(d) for d in (1, 7, 8, 30, 31, 90, 400)] == [7, 7, 30, 30, 90, 90, 90]


def events(spark, rows):
    return V.with_id(spark.createDataFrame([(k, m, 0 if k != "anomaly" else 7, d, datetime.fromisoformat(t)) for k, m, d, t in rows], "kind string, metric_fq string, window_days int, description string, at timestamp"))


def test_causes_within_48_hours_once_with_the_newest_anomaly(spark):
    rows = events(spark, [("anomaly", "m", None, "2024-02-10 00:00:00"), ("anomaly", "m", None, "2024-02-11 00:00:00"), ("release", "", "a", "2024-02-09 12:00:00"), ("release", "", "late", "2024-02-11 00:00:01"), ("release", "", "early", "2024-02-07 23:59:59"), ("release", "", "edge", "2024-02-08 00:00:00")])
    got = {r.label: (r.anomaly_at.day, r.proximity_hours) for r in V.causal_candidates(rows).collect()}
    assert got == {"a": (11, 36.0), "edge": (10, 48.0)}


def test_first_event_of_a_key_stays(spark):
    rows = spark.createDataFrame([("release", "", "b", datetime(2024, 1, 1), 2), ("release", "", "a", datetime(2024, 1, 1), 1), ("release", "", "c", datetime(2024, 1, 2), 3)], "kind string, metric_fq string, description string, at timestamp, seq long")
    once = V.insert_or_ignore(V.marks_as_events(rows))
    assert sorted(r.description for r in once.collect()) == ["a", "c"]


@pytest.mark.parametrize(("a", "b", "want"), [((1, 2, 3, 4), (2, 4, 6, 8), 1.0), ((1, 2, 3, 4), (4, 3, 2, 1), -1.0), ((1, 2, 3, 4), (5, 5, 5, 5), 0.0)])
def test_pearson(spark, a, b, want):
    rows = obs(spark, a, "c.s.x", 24).union(obs(spark, b, "c.s.y", 24))
    got = {(r.metric, r.sibling): (r.r, r.n) for r in R.sibling_correlations(rows, AS_OF, 30 * 86400, None).collect()}
    assert got[("c.s.x", "c.s.y")] == (pytest.approx(want), 4)


def test_ranking_puts_bad_news_first(spark):
    rows = spark.createDataFrame([("c.s.uptime", "higher_is_better", 4.0), ("c.s.errors", "lower_is_better", 2.0), ("c.s.revenue", "higher_is_better", -3.1), ("c.s.none", "neutral", None)], "fq_name string, direction string, dev double")
    got = [r.fq_name for r in R.summarize(rows.withColumn("score", S.score(F.col("direction"), F.col("dev"))), 0).collect()]
    assert got == ["c.s.revenue", "c.s.errors", "c.s.none", "c.s.uptime"]
    assert R.summarize(rows.withColumn("score", F.lit(0.0)), 2).count() == 2


def test_confidence(spark):
    row = spark.range(1).select(
        S.baseline_confidence(F.lit(45)).alias("a"), S.baseline_confidence(F.lit(None).cast("long")).alias("b"), S.anomaly_confidence(F.lit(-1.5)).alias("c"), S.proximity_confidence(F.lit(12.0)).alias("d"),
        S.proximity_confidence(F.lit(-1.0)).alias("e"), S.correlation_confidence(F.lit(-0.8), F.lit(15)).alias("f"), S.correlation_confidence(F.lit(0.9), F.lit(4)).alias("g"), S.level(F.lit(0.4)).alias("h"), S.level(F.lit(0.75)).alias("i"),
    ).first()
    assert tuple(row) == (0.5, 0.0, 0.5, 0.75, 1.0, pytest.approx(0.4), 0.0, "medium", "high")


@pytest.mark.parametrize("x", [724.0, 4.2, 0.0, -4.25, 12345.0, 12355.0, 9999.6, 0.00012345, 1e-7, 224.25, 188.95, 999.95, 1234567.0, 0.1])
def test_number_text_is_as_in_c(spark, x):
    assert spark.range(1).select(S.four_digits(F.lit(x))).first()[0] == "%.4g" % x
    assert spark.range(1).select(S.one_place(F.lit(x))).first()[0] == "%+.1f" % x


def test_sparkline(spark):
    glyphs = lambda values, width=40: B.sparkline(obs(spark, values), AS_OF, 30, width).first().sparkline
    assert glyphs([5, 5, 5, 5]) == "▁▁▁▁"
    assert glyphs([0, 7]) == "▁█"
    assert glyphs(range(1, 20, 2), 5) == "▁▃▅▆█"


def test_verdicts(spark):
    rows = obs(spark, [10] * 5 + [20] * 5, hours=24 * 5)
    out = R.compare_periods(rows, dim(spark), B.compute(rows, AS_OF), AS_OF, 25 * 86400, 30 * 86400).first()
    assert (out.verdict, out.pct_change) == ("improved", 100.0)
    none = R.compare_periods(rows, dim(spark, names=("q.q.q",)), B.compute(rows, AS_OF), AS_OF, 86400, 86400).first()
    assert none.verdict == "no prior data to compare"


def test_explain_without_observations(spark):
    rows = obs(spark, [1, 2, 3])
    none = events(spark, [("release", "", "a", "2024-02-29 00:00:00")]).selectExpr("*", "cast(null as double) observed_value", "cast(null as double) baseline_mean", "cast(null as double) stddev_from_mean", "'none' direction")
    out = R.narrative(R.summary(R.explain(rows, dim(spark, names=("a.b.c", "q.q.q")), B.compute(rows, AS_OF), none, AS_OF, 7 * 86400)), "7d")
    got = {r.fq_name: r for r in out.collect()}
    assert got["q.q.q"].summary == "q is near baseline; 1 correlated event(s) in window (low confidence: no baseline)."
    assert "No observations" in got["q.q.q"].narrative and got["a.b.c"].current_value == 3.0
