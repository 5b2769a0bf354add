"""The same jobs as streams: micro-batches into landed files, runs of a log, high-water marks, event dedup, online anomalies.

A batch may come again after a failure, so every ``foreachBatch`` writes what it would write again: landed files
in a folder named by query and batch, and deltas named by batch. State by key lives in Spark's state store.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.operators import baselines as B
from gaugeworks.operators.anomalies import flagged
from gaugeworks.operators.events import insert_or_ignore
from gaugeworks.operators.landing import land, prune_covered, read_landed
from gaugeworks.sources import protocol
from gaugeworks.streaming.folded import Folded, newest


def records_stream(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def run_available(stream: DataFrame, batch, checkpoint: str, every: str | None = None):
    """Runs ``batch(df, id)`` over all that is there; with ``every`` it goes on at that interval and the query is returned running."""
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    if every:
        return writer.trigger(processingTime=every).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


#: Errors that another attempt can't mend.
PERMANENT = (ValueError, TypeError, KeyError, AnalysisException)


def run_repeatedly(stream: DataFrame, batch, checkpoint: str, every: str, until: Callable | None = None, attempts: int = 3, permanent: tuple = PERMANENT):
    """Runs ``batch`` at that interval, the first time at once, until ``until(query)`` says so or someone stops the query.

    A batch that fails for good reason of its own (``permanent``) ends the job with that error. Any other error is
    tried again from the checkpoint, with the same batch, until it has come ``attempts`` times running.
    """
    errors: list[Exception] = []

    def watched(df: DataFrame, batch_id: int) -> None:
        try:
            batch(df, batch_id)
            errors.clear()
        except Exception as error:
            errors.append(error)
            raise

    while True:
        query = run_available(stream, watched, checkpoint, every)
        try:
            while not query.awaitTermination(1):
                if until and until(query):
                    query.stop()
            return query
        except StreamingQueryException as failed:
            if not errors or len(errors) >= attempts:
                raise
            if isinstance(errors[-1], permanent):
                raise errors[-1] from failed


def log_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """A folder of protocol logs as a stream of lines, each with its place: file, block of the file, and (in a batch) row."""
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(folder)
    return lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


_LINE = "run_id string, problem string, type string, stream string, seq struct<batch:long,path:string,block:long,row:long>, timestamp timestamp, data_json string, state string"


class LogRuns:
    """Runs of a protocol log in micro-batches, with the orchestrator's rules: a record is landed once a STATE, a full batch of its stream or the run's clean end lets it go, and an ERROR discards what is still held.

    A run's lines come in order: by micro-batch, then path, then place. A run is what its path names as ``run_id=…``;
    without that the whole log is one. What is held (fewer than ``flush`` valid records of a stream and run) is kept by
    run in folded deltas: a batch reads and writes only the parts of its own runs. Invalid lines are skipped.
    """

    def __init__(self, spark: SparkSession, root: str, state_root: str, held_root: str, query: str, streams: list[str], flush: int = 500, parts: int = 64):
        self.spark, self.root, self.state_root, self.query, self.streams, self.flush, self.parts = spark, root, state_root, query, streams, flush, parts
        self.held = Folded(spark, held_root, f"{_LINE}, batch long, part long", "part", newest("run_id"))

    def _part(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("part", F.pmod(F.xxhash64("run_id"), F.lit(self.parts)))

    def batch(self, df: DataFrame, batch_id: int) -> None:
        run = F.regexp_extract("path", "/run_id=([^/]+)/", 1)
        place = F.struct(F.lit(batch_id).cast("long").alias("batch"), "path", "block", F.monotonically_increasing_id().alias("row"))
        lines = protocol.messages(df.select(run.alias("run_id"), place.alias("seq"), "line"))
        good = protocol.judged_records(lines, self.streams).where("reason IS NULL")
        control = lines.where("problem IS NULL AND type IN ('STATE', 'ERROR')")
        nothing = F.lit(None).cast("string")
        new = good.select("run_id", nothing.alias("problem"), F.lit("RECORD").alias("type"), "stream", "seq", "timestamp", "data_json", nothing.alias("state"))
        new = new.union(control.select("run_id", "problem", "type", nothing.alias("stream"), "seq", F.lit(None).cast("timestamp"), nothing, F.to_json("state")))
        # each batch's lines are read once
        scratch = f"{self.state_root}/lines/batch={batch_id}"
        new.write.mode("overwrite").parquet(scratch)
        new = self.spark.read.schema(_LINE).parquet(scratch)
        touched = new.select("run_id").distinct()
        chosen = [r["part"] for r in self._part(touched).select("part").distinct().collect()]
        before = self.held.read(batch_id, chosen).join(touched, "run_id", "left_semi").drop("batch", "part")
        rows = before.unionByName(new)
        judged = protocol.fates(rows, batch=self.flush)
        judged.write.mode("overwrite").parquet(f"{self.state_root}/judged/batch={batch_id}")
        judged = self.spark.read.schema(judged.schema).parquet(f"{self.state_root}/judged/batch={batch_id}")
        land(judged.where("fate = 'written'").select("stream", "timestamp", "data_json"), self.root, f"{self.query}-{batch_id}")
        errors = protocol.of_type(rows, "ERROR").groupBy("run_id").agg(F.min("seq").alias("at"))
        kept = touched.join(errors, "run_id", "left").select("run_id", nothing.alias("problem"), F.when(F.col("at").isNotNull(), "ERROR").otherwise("OPEN").alias("type"), nothing.alias("stream"), F.col("at").alias("seq"), F.lit(None).cast("timestamp").alias("timestamp"), nothing.alias("data_json"), nothing.alias("state"))
        kept = kept.unionByName(judged.where("fate = 'held'").drop("fate"))
        self.held.append(batch_id, self._part(kept.withColumn("batch", F.lit(batch_id).cast("long"))))
        states = protocol.of_type(new, "STATE").join(errors, "run_id", "left").where("at IS NULL OR seq < at")
        states.groupBy("run_id").agg(F.max(F.struct("seq", "state")).alias("m")).select("run_id", "m.seq", "m.state").write.mode("overwrite").parquet(f"{self.state_root}/states/batch={batch_id}")

    def close(self, batches: int, runs: DataFrame | None = None) -> None:
        """The clean end of ``runs(run_id)`` (of all without it) after so many batches: what they hold is landed. Doing it again changes nothing."""
        held = protocol.of_type(self.held.read(batches), "RECORD")
        held = held if runs is None else held.join(runs, "run_id", "left_semi")
        land(held.select("stream", "timestamp", "data_json"), self.root, f"{self.query}-end")

    def states(self) -> DataFrame:
        """Each run's last saved state."""
        rows = self.spark.read.schema("run_id string, seq struct<batch:long,path:string,block:long,row:long>, state string").parquet(f"{self.state_root}/states")
        return rows.groupBy("run_id").agg(F.max(F.struct("seq", "state")).alias("m")).select("run_id", "m.seq", "m.state")


def batches_of(query) -> int:
    """How many batches a finished query has done since its first start."""
    last = query.lastProgress
    return last["batchId"] + 1 if last else 0


def landing_batch(root: str, query: str, manifest: DataFrame | None = None, kind: str = "parquet"):
    """Prunes what earlier runs cover, then lands a batch under its own run id."""

    def batch(df: DataFrame, batch_id: int) -> None:
        rows = df if manifest is None else prune_covered(df, manifest)
        land(rows, root, f"{query}-{batch_id}", kind)

    return batch


def landed_by_stream(spark: SparkSession, stream: DataFrame, root: str, checkpoint: str, manifest: DataFrame | None = None) -> DataFrame:
    """Lands a stream and returns what was landed."""
    run_available(stream, landing_batch(root, "land", manifest), checkpoint)
    return read_landed(spark, root)


def disk_state(spark: SparkSession) -> None:
    """State on the executors' disks, with a log of what each batch changed in the checkpoint, so its size isn't bound by memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def high_water(spark: SparkSession, stream: DataFrame, checkpoint: str) -> DataFrame:
    """Each stream's newest time and number of records, kept by key in the state store: a batch writes the keys that it changes. What is returned is read from the state itself."""
    disk_state(spark)
    marks = stream.groupBy("stream").agg(F.max("timestamp").alias("cursor"), F.count("*").alias("records"))
    marks.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return saved_marks(spark, checkpoint)


def saved_marks(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """``stream, cursor, records`` as of the last batch or an earlier one that is still kept."""
    reader = spark.read.format("statestore")
    state = (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)
    cursor, records = state.schema["value"].dataType.names
    return state.select("key.stream", F.col(f"value.{cursor}").alias("cursor"), F.col(f"value.{records}").alias("records"))


def deduplicated(stream: DataFrame, keys: list[str], time_col: str = "at", late: str = "48 hours") -> DataFrame:
    """The first event of each key, with bounded state: it is let go once the watermark has passed, and later events are dropped. ``seen_once`` drops none."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


def seen_once(spark: SparkSession, stream: DataFrame, keys: list[str], root: str, checkpoint: str) -> DataFrame:
    """Each key's first event and no other, however late one comes; nulls are equal to each other.

    Keys alone decide, as in a unique index. They live in the state store by hash; a batch looks up its own keys, and
    what it reads doesn't grow with what was seen. The store grows with the distinct keys, on disk.
    """
    disk_state(spark)
    return append_all(spark, stream.dropDuplicates(keys), root, checkpoint)


def append_all(spark: SparkSession, stream: DataFrame, root: str, checkpoint: str) -> DataFrame:
    """A stream's output as files, and read back."""
    query = stream.writeStream.format("parquet").option("path", root).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(root)


def online_anomalies(spark: SparkSession, stream: DataFrame, baselines: DataFrame, dim: DataFrame, limits: DataFrame, root: str, checkpoint: str) -> DataFrame:
    """Each new observation against a snapshot of the baselines."""
    snapshot = baselines.select("fq_name", "window_days", "mean", "stddev", "sample_count")
    return append_all(spark, flagged(stream.join(snapshot, "fq_name"), dim, limits), root, checkpoint)


def _at_once(*actions: Callable[[], None]) -> None:
    """Spark actions that don't need one another, side by side; an error of any is raised once all have ended."""
    with ThreadPoolExecutor(len(actions)) as pool:
        for done in [pool.submit(a) for a in actions]:
            done.result()


class LiveBaselines:
    """Observations in micro-batches, each against baselines that are up to date with it, itself included.

    What is kept of the past are mergeable parts (count, mean, squared deviations, extremes) of each metric's days, and of
    its seconds; a batch folds its own into them. A window is put together as in ``baselines.windows``, from the parts
    of whole days and the seconds of the few days that windows begin on, of those metrics only that the batch has. No
    batch reads an observation of an earlier one.

    Batches come in order of time, and a second's observations of a metric in one batch; what comes later than that counts
    from then on, and changes nothing that was said before, as when baselines are computed at each run.
    """

    def __init__(self, spark: SparkSession, root: str, dim: DataFrame, limits: DataFrame, days: tuple[int, ...] = B.DAYS):
        self.spark, self.root, self.dim, self.limits, self.windows = spark, root, dim, limits, days
        part = "n long, mean double, m2 double, lo double, hi double"
        fold = lambda keys: lambda rows: B.folded_parts(rows, keys)
        self.seconds = Folded(spark, f"{root}/seconds", f"fq_name string, sod long, {part}, day long", "day", fold(["fq_name", "day", "sod"]))
        self.days = Folded(spark, f"{root}/days", f"fq_name string, {part}, day long", "day", fold(["fq_name", "day"]))
        kept = "fq_name string, window_days int, mean double, stddev double, min double, max double, sample_count long, last_computed_at timestamp, batch long, part long"
        self.current = Folded(spark, f"{root}/current", kept, "part", newest("fq_name", "window_days"))

    def batch(self, df: DataFrame, batch_id: int) -> None:
        scratch = f"{self.root}/new/batch={batch_id}"
        df.select("fq_name", "value", "observed_at", "seq").write.mode("overwrite").parquet(scratch)
        obs = self.spark.read.schema("fq_name string, value double, observed_at timestamp, seq long").parquet(scratch)
        # the batch's parts are made once, and read back
        _at_once(lambda: self.seconds.append(batch_id, B.second_parts(obs)), lambda: self.days.append(batch_id, B.day_parts(obs)))
        second, total = self.seconds.of(batch_id), self.days.of(batch_id)
        asked = [r["day"] for r in total.select("day").distinct().collect()]
        names = total.select("fq_name").distinct()
        mine = lambda rows: rows.join(names, "fq_name", "left_semi")
        begins = sorted({d - back for d in asked for back in (0, *self.windows)})
        whole = sorted({d - back for d in asked for back in range(max(self.windows) + 1)})
        old_seconds = mine(self.seconds.read(batch_id, begins)).withColumn("__old", F.lit(True))
        keys = ["fq_name", "day", "sod"]
        both = B.folded_parts(old_seconds.drop("__old").unionByName(second), keys)
        both = both.join(second.select(*keys, F.lit(True).alias("asks")), keys, "left").fillna({"asks": False})
        all_days = B.folded_parts(mine(self.days.read(batch_id, whole)).unionByName(total), ["fq_name", "day"])
        full = B.windows(both, all_days, self.windows)
        full.write.mode("overwrite").parquet(f"{self.root}/windows/batch={batch_id}")
        full = self.spark.read.schema(full.schema).parquet(f"{self.root}/windows/batch={batch_id}")
        judged = B.with_windows(obs.withColumn("at_s", B.epoch(F.col("observed_at"))), full)
        found = insert_or_ignore(flagged(judged, self.dim, self.limits))
        last = full.groupBy("fq_name").agg(F.max_by("w", "at_s").alias("w"), F.max("at_s").alias("at_s"))
        last = last.select("fq_name", F.explode("w").alias("w"), F.timestamp_seconds("at_s").alias("last_computed_at"))
        row = last.select("fq_name", *[f"w.{c}" for c in ("window_days", "mean", "stddev", "min", "max", "sample_count")], "last_computed_at", F.lit(batch_id).cast("long").alias("batch"), F.pmod(F.xxhash64("fq_name"), F.lit(16)).alias("part"))
        _at_once(lambda: self.current.append(batch_id, row), lambda: found.write.mode("overwrite").parquet(f"{self.root}/anomalies/batch={batch_id}"))

    def anomalies(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/anomalies").drop("batch")

    def baselines(self, batches: int) -> DataFrame:
        """Each metric's windows as of its last observation."""
        return self.current.read(batches).where("sample_count > 0").drop("batch", "part")
