"""Repeating runs, logs as streams, exact dedup of late events, sinks and write mode."""

import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import baselines, landing, write_mode
from gaugeworks.sources import protocol
from gaugeworks.streaming import jobs


def files(spark, rows, schema, n=3):
    folder = landing.new_folder(spark, "in")
    for k in range(n):
        spark.createDataFrame(rows[k::n], schema).coalesce(1).write.mode("append").parquet(folder)
    return jobs.records_stream(spark, folder, spark.read.parquet(folder).schema)


def test_a_passing_error_is_tried_again_and_a_permanent_one_ends_the_run(spark):
    seen, fails = [], [OSError("away"), OSError("away")]

    def batch(df, batch_id):
        if fails:
            raise fails.pop()
        seen.append((batch_id, df.count()))

    stream = lambda: files(spark, [(i,) for i in range(9)], "i long")
    done = lambda q: q.lastProgress and q.lastProgress["batchId"] >= 2
    jobs.run_repeatedly(stream(), batch, landing.new_folder(spark, "marks"), "50 milliseconds", done)
    assert seen == [(0, 3), (1, 3), (2, 3)]
    calls = []

    def wrong(df, batch_id):
        calls.append(batch_id)
        raise ValueError("no such stream")

    with pytest.raises(ValueError, match="no such stream"):
        jobs.run_repeatedly(stream(), wrong, landing.new_folder(spark, "marks"), "50 milliseconds", done)
    assert calls == [0]
    fails[:] = [OSError("away")] * 9
    with pytest.raises(Exception, match="away"):
        jobs.run_repeatedly(stream(), batch, landing.new_folder(spark, "marks"), "50 milliseconds", done)
    assert len(fails) == 6


def test_events_however_late_are_seen_once(spark):
    rows = [("2024-01-31 10:00:00", "a"), ("2024-01-31 10:00:00", "a"), ("2020-01-01 00:00:00", "a"), ("2024-01-31 10:00:00", None), ("2024-01-31 10:00:00", None), ("2020-01-01 00:00:00", "a"), (None, "a"), (None, "a"), ("2024-01-31 11:00:00", "a")]
    stream = files(spark, rows, "t string, k string").select(F.to_timestamp("t").alias("at"), "k")
    out = jobs.seen_once(spark, stream, ["at", "k"], landing.new_folder(spark, "seen"), landing.new_folder(spark, "marks"))
    assert sorted((str(r.at), str(r.k)) for r in out.collect()) == sorted({(str(t), str(k)) for t, k in rows})


def test_written_keeps_full_batches_before_an_error(spark):
    rng = random.Random(4)
    rows, want = [], []
    for run in ("clean", "failed"):
        pending, seq = {}, 0
        for _ in range(400):
            seq += rng.randint(1, 3)
            if rng.random() < 0.01:
                rows.append((run, seq, "STATE", None))
                want += [x for xs in pending.values() for x in xs]
                pending = {}
            else:
                stream = rng.choice("abc")
                rows.append((run, seq, "RECORD", stream))
                pending.setdefault(stream, []).append((run, seq))
                if len(pending[stream]) == 7:
                    want += pending.pop(stream)
        if run == "failed":
            rows.append((run, seq + 1, "ERROR", None))
            rows.append((run, seq + 2, "RECORD", "a"))
        else:
            want += [x for xs in pending.values() for x in xs]
    table = spark.createDataFrame(rows, "run_id string, seq long, type string, stream string").withColumn("problem", F.lit(None).cast("string"))
    assert sorted((r.run_id, r.seq) for r in protocol.written(table, batch=7).collect()) == sorted(want)


def test_sinks_and_write_mode(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00", '{"v":1}'), ("b", None, None)], "stream string, t string, data_json string").select("stream", F.to_timestamp("t").alias("timestamp"), "data_json")
    for kind in ("parquet", "jsonl"):
        assert {r.stream: r.rows for r in landing.write_to(rows, kind, root=landing.new_folder(spark, kind), run_id="r").collect()} == {"a": 1, "b": 1}
    with pytest.raises(ValueError, match="twice"):
        landing.register_sink("parquet", print)
    with pytest.raises(KeyError, match="no sink"):
        landing.write_to(rows, "nowhere")
    name = write_mode.working_table(spark, "t")
    write_mode.create_table_as(spark, name, "SELECT 1 AS a WHERE false")
    assert write_mode.insert_into(spark, name, "SELECT 2 AS a").collect()[0].a == 2
    with pytest.raises(Exception, match="(?i)exist"):
        write_mode.create_table_as(spark, name, "SELECT 1 AS a")
    with pytest.raises(Exception, match="(?i)column|arity"):
        write_mode.insert_into(spark, name, "SELECT 1, 2")
    assert spark.table(name).count() == 1


def test_replay_is_brute_force(spark):
    """Windows that end on the second, bounds included, over gaps, repeated seconds, nulls and equal values."""
    rng = random.Random(6)
    rows = []
    for m in range(3):
        t = 1_700_000_000 + rng.randrange(86400)
        for k in range(150):
            t += rng.choice([0, 1, 3600, 86400, 86400 * 7, 86400 * 2 + 5, 40000])
            rows.append((f"m{m}", t, k, None if rng.random() < 0.05 else 5.0 if m == 2 else rng.choice([1e6, 1.5, -3.0]) + rng.random()))
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
                assert name != "m2" or r.stddev == 0
            else:
                assert r.mean is None and r.stddev is None
    start, end = "2024-02-01 00:00:00", "2024-06-01 12:00:00"
    part = {(r.fq_name, r.seq, r.window_days): (r.sample_count, r.mean, r.stddev) for r in baselines.replay(obs, start=start, end=end).collect()}
    inside = {k for k, r in got.items() if start <= str(r.observed_at) <= end}
    assert inside and set(part) == inside and all(part[k][0] == got[k].sample_count and part[k][1:] == pytest.approx((got[k].mean, got[k].stddev), rel=1e-9, abs=1e-9) for k in inside if got[k].mean is not None)
