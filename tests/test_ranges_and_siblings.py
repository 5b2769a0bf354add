"""Union of time ranges by blocks, and correlations by blocks of metrics, against plain loops."""

import datetime
import math
import random
import statistics
from collections.abc import Iterator

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import baselines, landing, reports
from gaugeworks.operators.events import causal_candidates

T0 = datetime.datetime(2024, 1, 1)


def at(s):
    return None if s is None else T0 + datetime.timedelta(seconds=s)


def union(ranges):
    out = []
    for a, b in sorted(r for r in ranges if None not in r and r[0] <= r[1]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return {(at(a), at(b)) for a, b in out}


@pytest.mark.parametrize("seed", range(3))
def test_ranges_over_many_blocks(spark, seed):
    rng = random.Random(seed)
    rows = []
    for s in ("a", "b", None):
        for _ in range(120):
            a = rng.randrange(40_000)
            rows.append((s, a, a + rng.choice([0, 1, 50, 900, 9000 if rng.random() < 0.05 else 3])))
        rows += [(s, 0, 0), (s, 100, None), (s, None, 5), (s, 300, 200), (s, 39_000, 39_000), (s, 39_000, 39_000)]
    table = spark.createDataFrame([(s, at(a), at(b)) for s, a, b in rows], "stream string, start_time timestamp, end_time timestamp")
    got = {}
    for r in landing.merged_ranges(table, block_s=600).collect():
        got.setdefault(r.stream, set()).add((r.start_time, r.end_time))
    assert got == {s: union([(a, b) for x, a, b in rows if x == s]) for s in ("a", "b", None)}


def test_edges_of_ranges(spark):
    """One range's end is the next one's start (one range); a second between them stays a gap; one inside another; one that reaches over several blocks."""
    rows = [(0, 10), (10, 20), (22, 30), (100, 9000), (200, 300), (8000, 9000), (9001, 9002)]
    table = spark.createDataFrame([("s", at(a), at(b)) for a, b in rows], "stream string, start_time timestamp, end_time timestamp")
    got = {(r.start_time, r.end_time) for r in landing.merged_ranges(table, block_s=60).collect()}
    assert got == {(at(0), at(20)), (at(22), at(30)), (at(100), at(9000)), (at(9001), at(9002))}
    records = spark.createDataFrame([("s", at(t), t) for t in (0, 10, 20, 21, 22, 30, 31, 5000, 9000, 9001)], "stream string, timestamp timestamp, t int")
    assert sorted(r.t for r in landing.prune_covered(records, table).collect()) == [21, 31]


def test_a_stream_s_ranges_are_not_one_task(spark):
    """20,000 ranges of one stream: the window over them is dealt by block."""
    many = spark.range(20_000).select(F.lit("s").alias("stream"), F.timestamp_seconds(F.col("id") * 1000).alias("start_time"), F.timestamp_seconds(F.col("id") * 1000 + 5).alias("end_time"))
    plan = landing.merged_ranges(many)._jdf.queryExecution().optimizedPlan().toString()
    over = [line for line in plan.split("\n") if "Window [" in line and "start_time" in line.split("windowspecdefinition")[1]]
    assert over and all("block" in line.split("windowspecdefinition")[1] for line in over)
    assert landing.merged_ranges(many).count() == 20_000


def test_siblings_in_blocks(spark):
    rng = random.Random(2)
    rows = []
    for c, m in (("x", 23), ("y", 1), ("z", 4)):
        base = [rng.random() for _ in range(20)]
        for k in range(m):
            for d in range(20):
                if rng.random() < 0.8:
                    value = None if rng.random() < 0.05 else 3.0 if k == 2 else (1 if k % 2 else -1) * base[d] + rng.random() * (k % 5) / 4
                    rows.append((f"{c}.s.m{k}", value, T0 + datetime.timedelta(days=d, hours=3)))
    obs = spark.createDataFrame(rows, "fq_name string, value double, observed_at timestamp")
    got = {(r.metric, r.sibling): (r.r, r.n) for r in reports.sibling_correlations(obs, "2024-01-21 00:00:00", 30 * 86400, None, at_once=4).collect()}
    by = {}
    for name, v, t in rows:
        if v is not None:
            by.setdefault(name, {})[t] = v
    want = {}
    for a in by:
        for b in by:
            days = sorted(by[a].keys() & by[b].keys())
            if a != b and a[0] == b[0] and len(days) >= 2:
                x, y = [by[a][d] for d in days], [by[b][d] for d in days]
                mx, my = sum(x) / len(x), sum(y) / len(y)
                bottom = (sum((v - mx) ** 2 for v in x) * sum((v - my) ** 2 for v in y)) ** 0.5
                want[a, b] = (sum((u - mx) * (v - my) for u, v in zip(x, y, strict=True)) / bottom if bottom > 1e-9 else 0.0), len(days)
    assert set(got) == set(want)
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], abs=1e-6) for k in want)
    strong = reports.sibling_correlations(obs, "2024-01-21 00:00:00", 30 * 86400, 0.6, at_once=4)
    assert {(r.metric, r.sibling) for r in strong.collect()} == {k for k, (r, _) in want.items() if abs(r) >= 0.6}
    assert reports.sibling_correlations(obs.where("false"), "2024-01-21 00:00:00", 86400).count() == 0


def test_causes_of_busy_slots_and_of_one_busy_target(spark):
    """Anomalies and marks on a slot's first and last second, 48 hours apart to the second, many of one target, many targets."""
    rng = random.Random(7)
    base = 1_728_000 * 900  # a slot begins here
    hour = 3600
    anomalies = [("t0", base + rng.randrange(96 * hour)) for _ in range(400)] + [(f"t{k}", base + rng.randrange(96 * hour)) for k in range(1, 12) for _ in range(3)]
    anomalies += [("edge", base), ("edge", base + 48 * hour - 1), ("edge", base + 96 * hour), ("edge2", base + 48 * hour)]
    marks = [(f"m{k}", base + rng.randrange(-48 * hour, 96 * hour)) for k in range(40)] + [("first", base), ("last", base + 48 * hour - 1), ("late", base + 96 * hour + 1), ("before", base - 48 * hour), ("just", base - 48 * hour - 1)]
    rows = [(f"a{i}", "anomaly", t, None, s) for i, (t, s) in enumerate(anomalies)] + [(m, "release", "", m, s) for m, s in marks]
    events = spark.createDataFrame(rows, "event_id string, kind string, metric_fq string, description string, s long").withColumn("at", F.timestamp_seconds("s")).withColumn("window_days", F.lit(7))
    want = {}
    for m, e in marks:
        for t, a in anomalies:
            if 0 <= a - e <= 48 * hour:
                want[m, t] = max(want.get((m, t), 0), a)
    for at_once in (1, 4, 64):
        got = {(r.event_id, r.target): r.s for r in causal_candidates(events, at_once).select("event_id", "target", F.unix_timestamp("anomaly_at").alias("s")).collect()}
        assert got == want


def test_daily_metrics_replay_as_dense_ones_do(spark):
    """One second a day, not always the same; gaps, nulls, and a metric that once has two seconds on a day."""
    rng = random.Random(5)
    rows = []
    for m in range(4):
        day = 19_700
        for k in range(140):
            day += rng.choice([1, 1, 1, 2, 7, 23, 30])
            rows.append((f"m{m}", day * 86400 + (0 if m == 0 else rng.choice([0, 5, 40_000])), k, None if rng.random() < 0.1 else rng.choice([1.0, 1e5]) + rng.random()))
    rows.append(("m3", rows[-1][1] + 60, 999, 4.0))
    obs = spark.createDataFrame(rows, "fq_name string, s long, seq long, value double").select("fq_name", F.timestamp_seconds("s").alias("observed_at"), "seq", "value")
    got = {(r.fq_name, r.seq, r.window_days): r for r in baselines.replay(obs).collect()}
    assert len(got) == 3 * len(rows)
    for name, t, seq, _ in rows:
        for d in baselines.DAYS:
            vs = [v for n, s, _, v in rows if n == name and t - d * 86400 <= s <= t and v is not None]
            r = got[name, seq, d]
            assert r.sample_count == len(vs)
            if vs:
                mean = sum(vs) / len(vs)
                assert r.mean == pytest.approx(mean, rel=1e-9) and r.stddev == pytest.approx((sum((v - mean) ** 2 for v in vs) / len(vs)) ** 0.5, rel=1e-6, abs=1e-6)


def _sent(spark, action) -> int:
    """Rows that all stages of an action shuffle."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in map(found().apply, range(found().size()))}
    found = lambda: store.stageList(None, False, False, gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    before = stages()
    action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(n for k, n in stages().items() if k not in before)


def test_siblings_sent_once_for_each_of_sixteen_blocks(spark):
    """400 metrics, 4 at once: 16 blocks, not 100. Equal series, even if all are, are dealt into pieces, and no pair is lost."""
    days = spark.createDataFrame([(m, d, float(m % 40 * d * d % 11)) for m in range(400) for d in range(6)], "m long, d long, value double")
    obs = days.select(F.concat(F.lit("x.m"), "m").alias("fq_name"), "value", F.timestamp_seconds(F.col("d") * 86400 + 1704067200).alias("observed_at")).localCheckpoint()
    out = reports.sibling_correlations(obs, "2024-01-21 00:00:00", 30 * 86400, None, at_once=4)
    got = []
    assert _sent(spark, lambda: got.extend(out.collect())) < 25 * 400
    assert len(got) == len({(r.metric, r.sibling) for r in got}) == 400 * 399
    same = reports.sibling_correlations(obs.withColumn("value", F.dayofmonth("observed_at").cast("double")), "2024-01-21 00:00:00", 30 * 86400, 0.6, at_once=4)
    assert same.groupBy("metric").count().where("count = 399").count() == 400


def test_equal_series_leave_their_task_once(spark, monkeypatch):
    """300 metrics of three series, two of them alike: names that come out of the tasks are few, and no row becomes many pairs at once. None is lost."""
    plain, total, most = reports._correlated, spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counting(least_r, at_once):
        inner = plain(least_r, at_once)

        def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in inner(key, batches):
                lists = [c for c in batch.columns if pa.types.is_list(c.type)]
                total.add(sum(len(c.flatten()) for c in lists) if lists else batch.num_rows)
                most.add(sum(a * b > 4096 for a, b in zip(*(c.value_lengths().to_pylist() for c in lists), strict=True)) if lists else 0)
                yield batch

        return run

    monkeypatch.setattr(reports, "_correlated", counting)
    series = F.when(F.col("m") % 3 == 0, F.col("d") % 4).when(F.col("m") % 3 == 1, F.col("d") % 4 * -2.5).otherwise(F.col("d") * F.col("d") % 7)
    days = spark.range(300).select(F.col("id").alias("m")).crossJoin(spark.range(8).select(F.col("id").alias("d")))
    obs = days.select(F.concat(F.lit("x.m"), "m").alias("fq_name"), series.cast("double").alias("value"), F.timestamp_seconds(F.col("d") * 86400 + 1704067200).alias("observed_at"))
    got = {(r.metric, r.sibling): (r.r, r.n, r.confidence) for r in reports.sibling_correlations(obs, "2024-01-21 00:00:00", 30 * 86400, None, places=5).collect()}
    assert len(got) == 300 * 299 and total.value < 300 * 299 / 10 and most.value == 0
    value = [[d % 4 for d in range(8)], [d % 4 * -2.5 for d in range(8)], [d * d % 7 for d in range(8)]]
    want = {(a, b): math.floor(abs(r) * 1e5 + 0.5) / 1e5 * (1 if r > 0 else -1) for a in range(3) for b in range(3) for r in [statistics.correlation(value[a], value[b])]}
    assert all(r == want[int(a[3:]) % 3, int(b[3:]) % 3] and n == 8 and c == pytest.approx(abs(r) * 8 / 30, abs=1e-5) for (a, b), (r, n, c) in got.items())


def test_short_windows_say_what_parts_say_and_send_each_row_once(spark):
    """Daily metrics, some with several seconds or rows of one second on a day, nulls, equal values; from a start on as well."""
    rng = random.Random(8)
    rows = [(f"m{m}", (19_700 + d) * 86400 + s, k, None if rng.random() < 0.1 else 2.5 if m == 1 else rng.choice([1.0, 1e5]) + rng.random()) for m in range(3) for d in range(120) if rng.random() < 0.6 for k, s in enumerate((0, 0, 40_000)[: rng.choice([1, 1, 3])])]
    obs = spark.createDataFrame(rows, "fq_name string, s long, seq long, value double").select("fq_name", F.timestamp_seconds("s").alias("observed_at"), "seq", "value").localCheckpoint()
    for start in (None, "2024-02-10 12:00:00"):
        read = lambda short: {(r.fq_name, r.observed_at, r.seq, r.window_days): r for r in baselines.replay(obs, start=start, short=short).collect()}  # noqa: B023, E731
        parts, plain = read(False), read(True)
        assert parts.keys() == plain.keys() and plain
        for k, r in plain.items():
            assert (r.value, r.sample_count) == (parts[k].value, parts[k].sample_count)
            assert r.mean == pytest.approx(parts[k].mean, rel=1e-12) and r.stddev == pytest.approx(parts[k].stddev, rel=1e-6, abs=1e-9)
    assert _sent(spark, baselines.replay(obs, short=True).collect) == len(rows)


def test_shipments_are_replayed_by_short_windows(spark):
    """Two shuffles of the observations, by day and by metric; parts of seconds and days took more than ten."""
    from gaugeworks.plans.metric_queries import QUERIES
    from gaugeworks.sources import tables

    n = tables.obs_shipments(spark, "/root/testdata/sf0.001").count()
    assert _sent(spark, QUERIES["anomaly_replay_shipments"](spark, "/root/testdata/sf0.001").collect) < 4 * n
