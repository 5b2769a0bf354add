"""Landing records: envelope, typed columns, coverage pruning, files and their manifest."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="gaugeworks-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


LANDED = T.StructType([T.StructField("stream", T.StringType()), T.StructField("timestamp", T.LongType()), T.StructField("data_json", T.StringType())])


def envelope(records: DataFrame) -> DataFrame:
    """``stream, timestamp`` in microseconds, ``data_json`` ({} for none), as landed."""
    return records.select("stream", F.unix_micros("timestamp").alias("timestamp"), F.coalesce("data_json", F.lit("{}")).alias("data_json"))


#: Logical types and what they are on disk.
TYPES = {"string": "string", "int": "bigint", "float": "double", "bool": "boolean", "timestamp": "bigint", "json": "string"}


def _typed(raw: Column, kind: str) -> Column:
    """A JSON scalar, given as its text, in a declared type; null where it doesn't fit."""
    number = raw.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")
    if kind in ("string", "json"):
        return F.when(raw.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"])
    if kind == "int":
        return F.when(number, F.coalesce(raw.try_cast("bigint"), raw.try_cast("double").cast("bigint")))
    if kind == "float":
        return F.when(number, raw.try_cast("double"))
    if kind == "bool":
        return F.when(raw.isin("true", "false"), raw == "true")
    from gaugeworks.functions.times import normalised

    text = F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]
    return F.when(number, raw.try_cast("bigint")).when(raw.startswith('"'), F.unix_micros(F.try_to_timestamp(normalised(text))))


def typed_columns(landed: DataFrame, columns: dict[str, str], strict: bool = True) -> DataFrame:
    """Declared, nullable columns between ``timestamp`` and ``data_json``.

    A missing or null field is null. A field of another type fails the write with ``strict``; else it is null and
    its name is listed in ``_rejected``. Whole numbers widen to floats, floats truncate to whole numbers, text
    isn't read as a number or truth value; timestamps are microseconds, RFC 3339 text or a date.
    """
    fields = F.transform_values(F.from_json("data_json", "map<string,variant>"), lambda _, v: F.to_json(v))
    with_ = landed.withColumn("__f", fields)
    out, wrong = [], []
    for name, kind in columns.items():
        text = F.col("__f")[name]
        text = F.when(text == "null", None).otherwise(text)
        value = _typed(text, kind)
        bad = text.isNotNull() & value.isNull()
        if strict:
            value = F.when(bad, F.raise_error(F.concat(F.lit(f"field {name} is not {kind}: "), text)).cast(TYPES[kind])).otherwise(value)
        wrong.append(F.when(bad, name))
        out.append(value.alias(name))
    if not strict:
        out.append(F.array_compact(F.array(*wrong)).alias("_rejected"))
    return with_.select("stream", "timestamp", *out, "data_json")


#: Ranges are merged by blocks of so many seconds of their starts.
BLOCK_S = 3600


def merged_ranges(manifest: DataFrame, scope: tuple[str, ...] = ("stream",), block_s: int = BLOCK_S) -> DataFrame:
    """Overlapping or touching [start, end] ranges of each stream made one; gaps stay gaps. Ranges without a bound cover nothing, nor do those that end before they start.

    Starts are cut into blocks of time. What reaches into a block from earlier ones is one number, as is how many merged
    ranges begin in it; both are carried over a stream's blocks, so a task orders the ranges of one block and never
    all of a stream.
    """
    rows = manifest.where("start_time IS NOT NULL AND end_time IS NOT NULL AND start_time <= end_time").groupBy(*scope, "start_time").agg(F.max("end_time").alias("end_time"))
    rows = rows.withColumn("block", F.floor(F.unix_timestamp("start_time") / block_s))
    earlier = Window.partitionBy(*scope).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy(*scope, "block").agg(F.max("end_time").alias("last")).withColumn("carried", F.max("last").over(earlier)).drop("last")
    inside = Window.partitionBy(*scope, "block").orderBy("start_time")
    before = F.greatest("carried", F.max("end_time").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    with_carry = _same_scope(rows, reach, (*scope, "block"))
    marked = with_carry.withColumn("before", before).withColumn("fresh", (F.col("before").isNull() | (F.col("start_time") > F.col("before"))).cast("int")).withColumn("local", F.sum("fresh").over(inside))
    begun = marked.groupBy(*scope, "block").agg(F.sum("fresh").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    island = _same_scope(marked, begun, (*scope, "block")).withColumn("island", F.col("offset") + F.col("local"))
    return island.groupBy(*scope, "island").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time")).drop("island")


def _same_scope(rows: DataFrame, facts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Joins one row of facts to each row with the same keys, nulls included."""
    named = facts.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in facts.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(named, condition).drop(*[f"__{k}" for k in keys])


#: Merged ranges up to this many rows are broadcast; beyond it the join is by stream and day.
BROADCAST_RANGES = 100_000


def prune_covered(records: DataFrame, manifest: DataFrame, resume: bool = True, per_connector: bool = False) -> DataFrame:
    """Drops records whose time lies within a range that an earlier run landed for their stream, bounds included.

    Without ``resume`` nothing is dropped. A record without time is never covered. With ``per_connector`` only
    the same connector's ranges count. Merged ranges are counted first: few are broadcast, many are dealt by
    day, so that neither side has to fit into one task.
    """
    if not resume:
        return records
    scope = ("stream", "connector") if per_connector else ("stream",)
    ranges = merged_ranges(manifest, scope)
    same = [records[c] == F.col(f"r.{c}") for c in scope]
    inside = (records["timestamp"] >= F.col("r.start_time")) & (records["timestamp"] <= F.col("r.end_time"))
    condition = inside
    for s in same:
        condition = condition & s
    if ranges.count() <= BROADCAST_RANGES:
        return records.join(F.broadcast(ranges).alias("r"), condition, "left_anti")
    days = ranges.withColumn("day", F.explode(F.sequence(F.to_date("start_time"), F.to_date("end_time")))).alias("r")
    return records.withColumn("__day", F.to_date("timestamp")).alias("l").join(days, condition & (F.col("l.__day") == F.col("r.day")), "left_anti").drop("__day")


def land(records: DataFrame, root: str, run_id: str, kind: str = "parquet", connector: str = "") -> DataFrame:
    """Writes one run as ``root/run_id=…/stream=…`` and returns its manifest rows. A run that is written again replaces itself."""
    spark = records.sparkSession
    path = f"{root}/run_id={run_id}"
    getattr(envelope(records).write.mode("overwrite").partitionBy("stream"), kind)(path)
    return manifest_rows(read_landed(spark, root, run_id, kind), kind, connector)


def land_flat(records: DataFrame, root: str, kind: str = "parquet") -> DataFrame:
    """One folder for each stream, replaced by each run that has the stream; other streams stay."""
    getattr(envelope(records).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream"), kind)(root)
    return read_flat(records.sparkSession, root, kind)


_sinks: dict = {"parquet": land}


def register_sink(name: str, sink) -> None:
    """A sink of one's own: a function of records and options that writes them and returns what it has written."""
    if not callable(sink):
        raise TypeError(f"sink {name!r} can't be called")
    if name in _sinks:
        raise ValueError(f"sink {name!r} is registered twice")
    _sinks[name] = sink


def write_to(records: DataFrame, name: str, **options) -> DataFrame:
    """Hands records to the sink of that name, in a batch job or from ``foreachBatch``."""
    if name not in _sinks:
        raise KeyError(f"no sink {name!r}; known: {sorted(_sinks)}")
    return _sinks[name](records, **options)


def read_landed(spark: SparkSession, root: str, run_id: str | None = None, kind: str = "parquet") -> DataFrame:
    """Landed rows with ``run_id``, and the file's name and size; declared types, so nothing is inferred."""
    schema = T.StructType([*LANDED.fields[1:], LANDED.fields[0], T.StructField("run_id", T.StringType())])
    rows = getattr(spark.read.schema(schema).option("basePath", root), kind)(root if run_id is None else f"{root}/run_id={run_id}")
    return rows.select("run_id", "stream", "timestamp", "data_json", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("file_size"))


def read_flat(spark: SparkSession, root: str, kind: str = "parquet") -> DataFrame:
    return getattr(spark.read.schema(T.StructType([*LANDED.fields[1:], LANDED.fields[0]])), kind)(root).select("stream", "timestamp", "data_json")


def manifest_rows(landed: DataFrame, kind: str = "parquet", connector: str = "") -> DataFrame:
    """A row for each non-empty data file: rows, bytes, first and last time."""
    rows = landed.groupBy("run_id", "stream", "path").agg(F.count("*").alias("rows"), F.max("file_size").alias("size_bytes"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    return rows.select("stream", F.lit(connector).alias("connector"), "path", F.lit(kind).alias("format"), "rows", "size_bytes", F.timestamp_micros("lo").alias("start_time"), F.timestamp_micros("hi").alias("end_time"), "run_id")


def manifest_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace those of the same path."""
    return old.join(new.select("path"), "path", "left_anti").unionByName(new, allowMissingColumns=True)


def manifest_touch(header: DataFrame, now: str) -> DataFrame:
    """The header's time moves on even when a run landed nothing."""
    return header.withColumn("updated_at", F.greatest("updated_at", F.to_timestamp(F.lit(now))))


def manifest_for(manifest: DataFrame, stream: str) -> DataFrame:
    return manifest.where(F.col("stream") == stream)


def rows_by_stream(manifest: DataFrame, connector: str) -> DataFrame:
    """Rows of each stream of a connector; where no row names a connector, of all."""
    tagged = manifest.agg(F.coalesce(F.bool_or(F.coalesce("connector", F.lit("")) != ""), F.lit(False)).alias("tagged"))
    rows = manifest.crossJoin(F.broadcast(tagged)).where(~F.col("tagged") | (F.col("connector") == connector))  # one row
    return rows.groupBy("stream").agg(F.sum("rows").alias("rows"))


def semantics_sidecar(catalog: DataFrame) -> DataFrame:
    """One JSON text: each stream with its kind and declared columns."""
    column = F.struct("name", "type", "unit", "direction", "aggregation")
    streams = catalog.groupBy("stream", "kind").agg(F.array_sort(F.collect_list(column)).alias("columns"))
    entry = F.map_from_entries(F.array_sort(F.collect_list(F.struct("stream", F.struct("kind", "columns")))))
    return streams.agg(F.to_json(entry).alias("semantics"))


def run_counters(extracted: DataFrame, persisted: DataFrame) -> DataFrame:
    """Extracted, persisted and pruned records of each stream."""
    a = extracted.groupBy("stream").agg(F.count("*").alias("extracted"))
    b = persisted.groupBy("stream").agg(F.count("*").alias("persisted"))
    out = a.join(b, "stream", "left").withColumn("persisted", F.coalesce("persisted", F.lit(0)).cast("long"))
    return out.withColumn("pruned", F.col("extracted") - F.col("persisted"))


register_sink("jsonl", lambda records, root, run_id, connector="": land(records, root, run_id, "json", connector))
register_sink("flat", land_flat)
