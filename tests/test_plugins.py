"""Connectors and sinks as plug-ins: what reaches them, what tasks do, and what is seen after a failure."""

import datetime
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from gaugeworks.operators import landing, sinks
from gaugeworks.sources import connector as C
from gaugeworks.streaming import jobs

# what a test defines goes to the workers by value, as it would from a notebook
cloudpickle.register_pickle_by_value(sys.modules[__name__])
T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


class Numbers(C.Connector):
    """Ten records a stream; each tells what it was asked for."""

    needs = ("n",)

    def discover(self, options):
        return ["a", "b"]

    def pieces(self, options, wanted):
        return [s for s in self.discover(options) if wanted.streams is None or s in wanted.streams]

    def read(self, options, piece, wanted):
        at = [T0 + datetime.timedelta(hours=k) for k in range(int(options["n"]))]
        kept = [t for t in at if wanted.after is None or t > wanted.after or (wanted.after_included and t == wanted.after)]
        asked = f"{sorted(wanted.streams or [])} {wanted.after} {wanted.until}"
        yield pa.RecordBatch.from_arrays([pa.array([piece] * len(kept), pa.string()), pa.array(kept, pa.timestamp("us", tz="UTC")), pa.array([asked] * len(kept))], ["stream", "timestamp", "data_json"])


if "numbers" not in C.connectors():
    C.register_connector("numbers", Numbers())


def test_filters_reach_the_connector_and_options_are_checked_first(spark):
    rows = C.extract(spark, "numbers", n="10")
    assert rows.count() == 20 and rows.rdd.getNumPartitions() == 2
    cut = F.lit("2024-01-01 07:00:00").cast("timestamp")
    got = C.extract(spark, "numbers", n="10").where((F.col("stream") == "b") & (F.col("timestamp") > cut)).collect()
    assert [r.stream for r in got] == ["b", "b"] and got[0].data_json.startswith("['b'] 2024-01-01 07:00:00")
    assert C.extract(spark, "numbers", n="10").where(F.col("stream").isin("a", "x")).count() == 10
    with pytest.raises(ValueError, match="missing options: n"):
        C.extract(spark, "numbers")
    with pytest.raises(KeyError, match="no connector"):
        C.extract(spark, "nowhere")
    with pytest.raises(ValueError, match="twice"):
        C.register_connector("numbers", Numbers())
    assert C.discover("numbers", n="1") == ["a", "b"]


def records(spark, n, at=0):
    return spark.range(n).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("stream"), F.timestamp_seconds(F.lit(1_700_000_000 + at) + F.col("id")).alias("timestamp"), F.to_json(F.struct("id")).alias("data_json"))


def test_folder_as_batch_and_as_stream(spark):
    folder = landing.new_folder(spark, "landed")
    landing.land(records(spark, 300), folder, "r1")
    landing.land(records(spark, 100, 5000), folder, "r2")
    rows = C.extract(spark, "parquet_folder", path=folder)
    assert rows.count() == 400 and C.discover("parquet_folder", path=folder) == ["a", "b"]
    late = rows.where((F.col("stream") == "a") & (F.col("timestamp") > F.timestamp_seconds(F.lit(1_700_004_000))))
    assert late.count() == 34
    wanted = C.Wanted()
    wanted.stream(["a"])
    wanted.newer(datetime.datetime.fromtimestamp(1_700_004_000, datetime.UTC), False)
    chosen = C.ParquetFolder().pieces({"path": folder}, wanted)
    assert chosen and all("/stream=a/" in p and "run_id=r2" in p for p, _ in chosen)  # the rest is not even opened by a task
    out, marks = landing.new_folder(spark, "out"), landing.new_folder(spark, "marks")
    assert jobs.append_all(spark, C.extract_stream(spark, "parquet_folder", path=folder), out, marks).count() == 400
    landing.land(records(spark, 30, 9000), folder, "r3")
    assert jobs.append_all(spark, C.extract_stream(spark, "parquet_folder", path=folder), out, marks).count() == 430  # only what is new
    assert C.extract(spark, "parquet_folder", path=landing.new_folder(spark, "none")).count() == 0


SCHEMA = "stream string, timestamp timestamp, data_json string"


def test_a_failing_task_leaves_nothing_to_be_seen(spark):
    path = landing.new_folder(spark, "sink")
    good = records(spark, 1000).repartition(4)
    sinks.write_run(good, "run_folder", path=path, run="first")
    broken = good.withColumn("data_json", F.when(F.col("data_json") == '{"id":777}', F.raise_error(F.lit("torn"))).otherwise(F.col("data_json")))
    with pytest.raises(Exception, match="torn"):
        sinks.write_run(broken, "run_folder", path=path, run="second")
    rows = sinks.read_committed(spark, path, SCHEMA)
    assert rows.count() == 1000 and {r.run for r in rows.select("run").distinct().collect()} == {"first"}
    sinks.write_run(records(spark, 10), "run_folder", path=path, run="second")
    assert {(r.run, r.rows) for r in sinks.committed_runs(spark, path).collect()} == {("first", 1000), ("second", 10)}
    sinks.write_run(records(spark, 20), "run_folder", path=path, run="second")  # again: it replaces itself
    assert sinks.read_committed(spark, path, SCHEMA).groupBy("run").count().where("run = 'second'").collect()[0]["count"] == 20
    with pytest.raises(ValueError, match="missing options"):
        sinks.write_run(good, "run_folder", path=path)
    with pytest.raises(KeyError, match="no sink"):
        sinks.write_run(good, "nowhere")


class Told(sinks.Writer):
    def __init__(self, path, task):
        self.log, self.path, self.task, self.n = [], path, task, 0

    def write(self, stream, batch):
        self.log.append(f"write {stream}")
        self.n += batch.num_rows
        return batch.num_rows // 2

    def flush(self):
        self.log.append("flush")

    def close(self):
        return {"log": [*self.log, "close"], "n": self.n}


class Telling(sinks.Sink):
    needs = ("path",)

    def open(self, options, task):
        return Told(options["path"], task)

    def commit(self, options, closed):
        import json

        with open(options["path"], "w") as f:
            json.dump(closed, f)


if "telling" not in sinks._sinks:
    sinks.register_lifecycle_sink("telling", Telling())


def test_the_life_of_a_sink(spark, tmp_path):
    import json

    sinks.write_run(records(spark, 40).coalesce(1), "telling", path=str(tmp_path / "told"))
    (told,) = json.loads((tmp_path / "told").read_text())
    assert told["log"] == ["write a", "write b", "flush", "close"] and told["n"] == 40 and told["rows"] == 20
