"""State that streams keep: folded deltas, runs of a log, exact dedup, marks in the state store, baselines kept up to date."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import anomalies, baselines, landing
from gaugeworks.sources import protocol
from gaugeworks.streaming import jobs
from gaugeworks.streaming.folded import Folded, newest


def test_folded_deltas_are_what_a_plain_map_says(spark):
    rng = random.Random(3)
    root = landing.new_folder(spark, "folded")
    store = Folded(spark, root, "k string, v long, batch long, part long", "part", newest("k"), fan=3)
    plain = {}
    for b in range(14):
        new = {rng.choice(["a", "b", "c", "d", "e", None]): rng.randrange(99) for _ in range(2)}
        plain |= {k: (v, b) for k, v in new.items()}
        rows = [(k, v, b, 0 if k in ("a", "b") else 1) for k, v in new.items()]
        for _ in range(2 if b in (4, 8) else 1):  # a batch that comes again
            store.append(b, spark.createDataFrame(rows, "k string, v long, batch long, part long"))
        if b in (0, 4, 8, 13):
            assert {r.k: (r.v, r.batch) for r in store.read(b + 1).collect()} == plain
            assert {r.k for r in store.read(b + 1, [0]).collect()} == {k for k in plain if k in ("a", "b")}
    assert store.runs(0) == [] and store.read(0).count() == 0
    assert store.runs(14) == [(2, 8), (1, 11), (0, 12), (0, 13)]
    # before the latest batches all is as it was
    assert store.runs(9) == [(2, 8)] and all(r.batch < 9 for r in store.read(9).collect())


def _lines(rng, n):
    """A run's lines and what the orchestrator's rules write of them."""
    lines, want, held, states = [], [], {}, None
    dead = False
    for i in range(n):
        u = rng.random()
        if u < 0.02:
            lines.append('{"type":"STATE","state":{"at":%d}}' % i)
            if not dead:
                want += [x for xs in held.values() for x in xs]
                held, states = {}, i
        elif u < 0.024:
            lines.append('{"type":"ERROR","error":"x"}')
            dead, held = True, {}
        elif u < 0.06:
            lines.append(rng.choice(["{broken", "", '{"type":"LOG","message":"m"}', '{"type":"RECORD","stream":"a","timestamp":null,"data":{}}', '{"type":"RECORD","stream":"other","timestamp":1,"data":{}}']))
        else:
            s = rng.choice("abc")
            lines.append('{"type":"RECORD","stream":"%s","timestamp":%d,"data":{"i":%d}}' % (s, 1_700_000_000 + i, i))
            if not dead:
                held.setdefault(s, []).append(i)
                if len(held[s]) == 7:
                    want += held.pop(s)
    return lines, sorted(want + ([] if dead else [x for xs in held.values() for x in xs])), states


def test_runs_cut_anywhere_land_what_the_rules_write(spark):
    rng = random.Random(11)
    folder, want, states = landing.new_folder(spark, "log"), {}, {}
    pieces = []
    for run in ("x", "y", "z", "w"):
        lines, want[run], states[run] = _lines(rng, 260 if run != "w" else 40)
        cuts = sorted(rng.sample(range(len(lines)), 4))
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(lines)], strict=True)):
            pieces.append((k, run, [ln.replace('"i":', f'"run":"{run}","i":') for ln in lines[a:b]]))
    t = 1_600_000_000
    for k, run, lines in sorted(pieces, key=lambda p: p[0]):
        os.makedirs(f"{folder}/part={k}/run_id={run}", exist_ok=True)
        path = f"{folder}/part={k}/run_id={run}/log.txt"
        with open(path, "w") as f:
            f.write("\n".join(lines))
        t += 1
        os.utime(path, (t, t))
    root, st, held, marks = (landing.new_folder(spark, n) for n in ("landed", "states", "held", "marks"))
    runs = jobs.LogRuns(spark, root, st, held, "log", ["a", "b", "c"], flush=7, parts=4)
    seen = []

    def batch(df, batch_id):
        runs.batch(df, batch_id)
        if batch_id == 2 and not seen:
            seen.append(1)
            runs.batch(df, batch_id)  # once more, as after a failure

    query = jobs.run_available(jobs.log_stream(spark, f"{folder}/*/*", 3), batch, marks)
    for _ in range(2):
        runs.close(jobs.batches_of(query))
    got = {}
    for r in landing.read_landed(spark, root).select(F.get_json_object("data_json", "$.run").alias("run"), F.get_json_object("data_json", "$.i").cast("int").alias("i")).collect():
        got.setdefault(r.run, []).append(r.i)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert {r.run_id: r.state for r in runs.states().collect()} == {k: '{"at":%d}' % v for k, v in states.items() if v is not None}


def test_nothing_counts_after_an_error(spark):
    rows = [("r", 1, "RECORD", "a"), ("r", 2, "ERROR", None), ("r", 3, "STATE", None), ("r", 4, "RECORD", "a"), ("q", 1, "RECORD", "a")]
    table = spark.createDataFrame(rows, "run_id string, seq long, type string, stream string").withColumn("problem", F.lit(None).cast("string"))
    assert [(r.run_id, r.fate) for r in protocol.fates(table).orderBy("run_id").collect()] == [("q", "held"), ("r", "lost")]
    assert [r.run_id for r in protocol.written(table).collect()] == ["q"]


def _stream(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return jobs.records_stream(spark, folder, schema)


def test_a_key_on_two_days_and_in_two_batches_comes_once_and_is_looked_up_only(spark):
    folder, root, marks = (landing.new_folder(spark, n) for n in ("in", "seen", "marks"))
    schema = "at timestamp, k string, v long"
    day = lambda d: __import__("datetime").datetime(2024, 1, d)
    first = [(day(1), f"k{i}", i) for i in range(3000)] + [(day(1), None, 1), (day(2), None, 2)]
    out = jobs.seen_once(spark, _stream(spark, folder, first, schema), ["k"], root, marks)
    assert out.count() == 3001
    late = [(day(20), "k7", 9), (day(3), "k7", 10), (day(20), "new", 1), (day(1), None, 3)]
    stream = _stream(spark, folder, late, schema)  # the job starts again from its checkpoint
    query = stream.dropDuplicates(["k"]).writeStream.format("parquet").option("path", root).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(schema).parquet(root)
    assert rows.count() == 3002 and rows.where("k = 'k7'").collect()[0].v == 7
    state = [p["stateOperators"][0] for p in query.recentProgress if p["numInputRows"]][-1]
    assert state["numRowsTotal"] == 3002 and state["customMetrics"]["rocksdbGetCount"] <= 8  # its own keys, not what was seen


def test_marks_live_in_the_state_store_and_a_batch_writes_what_it_changes(spark):
    folder, marks = landing.new_folder(spark, "in"), landing.new_folder(spark, "marks")
    schema = "stream string, timestamp timestamp"
    at = lambda s: __import__("datetime").datetime.fromtimestamp(1_700_000_000 + s)
    jobs.high_water(spark, _stream(spark, folder, [(f"s{i}", at(i)) for i in range(4000)] + [("s1", at(5))], schema), marks)
    size = lambda: sum(os.path.getsize(p) for p in glob.glob(f"{marks}/state/**/*.changelog", recursive=True))
    before = size()
    out = jobs.high_water(spark, _stream(spark, folder, [("s1", at(1)), ("s2", at(9)), ("fresh", at(0))], schema), marks)
    got = {r.stream: (r.cursor, r.records) for r in out.collect()}
    assert len(got) == 4001 and got["s1"] == (at(5), 3) and got["s2"] == (at(9), 2) and got["s3"] == (at(3), 1)
    assert 0 < size() - before < before / 10
    assert {r.stream: r.records for r in jobs.saved_marks(spark, marks, 0).collect()}["s2"] == 1


def test_live_baselines_are_a_replay_and_read_no_raw_past(spark):
    rng = random.Random(9)
    rows = []
    for m in range(3):
        t = 1_700_000_000 + m * 1000
        for k in range(120):
            t += rng.choice([0, 1, 3600, 86400, 86400 * 7, 40000])
            rows.append((f"m{m}", rng.gauss(5, 1) + (40 if k % 37 == 30 else 0), t, k))
    obs = spark.createDataFrame(rows, "fq_name string, value double, t long, seq long").select("fq_name", "value", F.timestamp_seconds("t").alias("observed_at"), "seq")
    dim = obs.select("fq_name").distinct().withColumn("direction", F.lit("higher_is_better"))
    limits = anomalies.thresholds(dim)
    live = jobs.LiveBaselines(spark, landing.new_folder(spark, "live"), dim, limits)
    times = sorted({r[2] for r in rows})
    cuts = [times[0], times[len(times) // 5], times[len(times) // 2], times[-3], times[-1] + 1]
    for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        piece = obs.where((F.unix_timestamp("observed_at") >= lo) & (F.unix_timestamp("observed_at") < hi))
        for _ in range(2 if b == 1 else 1):
            live.batch(piece, b)
    key = lambda r: (r.metric_fq, str(r["at"]), r.window_days)
    want = {key(r): r for r in anomalies.replayed(obs, dim, limits).collect()}
    got = {key(r): r for r in live.anomalies().collect()}
    assert want and set(got) == set(want)
    assert all(got[k].stddev_from_mean == pytest.approx(want[k].stddev_from_mean, rel=1e-6) and got[k].direction == want[k].direction for k in want)
    last = {}
    for r in baselines.replay(obs).collect():
        if (r.fq_name, r.window_days) not in last or last[r.fq_name, r.window_days].observed_at <= r.observed_at:
            last[r.fq_name, r.window_days] = r
    now = {(r.fq_name, r.window_days): r for r in live.baselines(4).collect()}
    assert set(now) == set(last) and all(now[k].sample_count == last[k].sample_count and now[k].mean == pytest.approx(last[k].mean) for k in last)


def test_a_batch_s_observations_are_read_thrice(spark, tmp_path):
    """For the parts of seconds, those of days, and the check: all else reads parts. They were read nine times and more."""
    n = 50_000
    rows = spark.range(n).select(F.lit("x.m").alias("fq_name"), F.rand(1).alias("value"), F.timestamp_seconds(F.col("id") % 40 + 1704067200).alias("observed_at"), F.col("id").alias("seq"))
    rows.write.parquet(f"{tmp_path}/in")
    obs = spark.read.parquet(f"{tmp_path}/in")
    dim = spark.createDataFrame([("x.m", "neutral")], "fq_name string, direction string")
    live = jobs.LiveBaselines(spark, f"{tmp_path}/live", dim, anomalies.thresholds(dim))
    sc = spark.sparkContext

    def read() -> int:
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(s.inputRecords() for s in map(stages.apply, range(stages.size())))

    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = read()
    live.batch(obs, 0)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert n <= read() - before < 5 * n  # once more to store them
    assert live.baselines(1).where("sample_count = 50000").count() == 3
