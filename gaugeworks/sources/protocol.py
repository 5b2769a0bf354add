"""The line protocol of external sources: one JSON message a line, read into typed relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.functions.times import normalised

MESSAGES = ("RECORD", "STATE", "SCHEMA", "LOG", "ERROR", "SKIPPED")
MAX_LINE = 1 << 20
#: Salts of the first step of a long run's ranking from its end.
SALTS = 32
_SHAPE = "type string, stream string, timestamp variant, data variant, state variant, level string, message string, schema variant, error string"
_FIELDS = [f.split()[0] for f in _SHAPE.split(", ")]


def messages(log: DataFrame) -> DataFrame:
    """``log(seq, line)`` (and any run keys) as messages. Blank lines are skipped; ``problem`` says what is wrong with a line."""
    others = [c for c in log.columns if c not in ("line",)]
    line = F.col("line")
    parsed = F.when(F.try_parse_json("line").isNotNull() & line.rlike(r"^\s*\{"), F.from_json("line", _SHAPE))

    def judged(m: Column) -> Column:
        problem = F.when(F.octet_length(line) > MAX_LINE, "line too long").when(m.isNull(), "not a JSON object").when(m["type"].isNull(), "no type").when(~m["type"].isin(*MESSAGES), "unknown type")
        return F.struct(problem.alias("problem"), *[m[c].alias(c) for c in _FIELDS])

    # a generator's output is never put back into later expressions, so each line is read once
    return log.where(F.trim("line") != "").select(*others, F.inline(F.transform(F.array(parsed), judged)))


def of_type(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.col("problem").isNull() & (F.col("type") == kind))


def judged_records(rows: DataFrame, streams: list[str]) -> DataFrame:
    """RECORD messages with time, payload and the reason for skipping one, if any.

    A time is RFC 3339 text or a number of epoch seconds.
    """
    others = [c for c in rows.columns if c not in ("problem", *_FIELDS)]

    def judged(m: Column) -> Column:
        raw = m["timestamp"]
        text = F.try_variant_get(raw, "$", "string")
        number = F.try_variant_get(raw, "$", "double")
        at = F.when(F.schema_of_variant(raw) == "STRING", F.try_to_timestamp(normalised(F.when(text.contains("T"), text)))).otherwise(F.timestamp_micros(F.round(number * 1_000_000).cast("bigint")))
        missing = raw.isNull() | F.is_variant_null(raw)

        def with_time(x: Column) -> Column:
            reason = (
                F.when(m["stream"].isNull() | ~m["stream"].isin(streams), "stream not configured").when(missing, "timestamp missing").when(x["at"].isNull(), "timestamp unreadable")
                .when(m["data"].isNull() | F.is_variant_null(m["data"]), "data missing")
            )
            return F.struct(m["stream"].alias("stream"), x["at"].alias("timestamp"), F.to_json(m["data"]).alias("data_json"), reason.alias("reason"))

        return F.transform(F.array(F.struct(F.when(~missing, at).alias("at"))), with_time)[0]

    message = F.array(F.struct("stream", "timestamp", "data"))
    return of_type(rows, "RECORD").select(*others, F.inline(F.transform(message, judged)))


def rejects(judged: DataFrame) -> DataFrame:
    return judged.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def committed(rows: DataFrame, run: str = "run_id") -> DataFrame:
    """Messages with whether the run's last STATE came after them: the cursor has moved past those.

    One mark for each run, joined back, so a long run isn't gathered in one task.
    """
    marks = of_type(rows, "STATE").groupBy(run).agg(F.max("seq").alias("__mark"))
    return rows.join(marks, run, "left").withColumn("committed", F.coalesce(F.col("seq") < F.col("__mark"), F.lit(False))).drop("__mark")


def fates(rows: DataFrame, run: str = "run_id", batch: int = 500) -> DataFrame:
    """RECORDs with their ``fate``: ``written``, ``held`` in memory at the end of the log, or ``lost`` to an ERROR.

    A STATE writes all before it, and full batches of a stream go at once. The first ERROR of a run discards what is
    still held, and nothing after it counts, neither RECORD nor STATE. ``seq`` orders a run's lines, by any type.
    """
    control = rows.where("problem IS NULL AND type IN ('STATE', 'ERROR')")
    errors = control.where("type = 'ERROR'").groupBy(run).agg(F.min("seq").alias("__error"))
    alive = lambda part: part.join(errors, run, "left").where("__error IS NULL OR seq < __error")
    states = alive(control.where("type = 'STATE'")).groupBy(run).agg(F.max("seq").alias("__state"))
    records = alive(of_type(rows, "RECORD")).join(states, run, "left").withColumn("__loose", F.coalesce(F.col("seq") > F.col("__state"), F.lit(True)))
    # of the records after the last flush the full batches are in, so the last count % batch are not: they are found
    # from the end, first within salts, so that no task ranks a whole run
    loose = records.where("__loose")
    keys = [run, "stream"]
    short = loose.groupBy(*keys).agg((F.count("*") % batch).alias("__short"))
    ends = loose.select(*keys, "seq", F.pmod(F.xxhash64("seq"), F.lit(SALTS)).alias("__salt"))
    for group in ([*keys, "__salt"], keys):
        ends = ends.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("seq")))).where(F.col("__rn") < batch)
    cuts = ends.join(short, keys).where(F.col("__rn") <= F.col("__short")).groupBy(*keys).agg(F.min("seq").alias("__cut"))
    open_ = F.col("__loose") & F.coalesce(F.col("seq") >= F.col("__cut"), F.lit(False))
    fate = F.when(~open_, "written").when(F.col("__error").isNotNull(), "lost").otherwise("held")
    return records.join(cuts, keys, "left").withColumn("fate", fate).drop("__error", "__state", "__loose", "__cut")


def written(rows: DataFrame, run: str = "run_id", batch: int = 500) -> DataFrame:
    """RECORDs of whole runs that reach the sink; a clean end writes what is held."""
    return fates(rows, run, batch).where("fate <> 'lost'").drop("fate")


def last_state(rows: DataFrame, run: str = "run_id") -> DataFrame:
    return of_type(rows, "STATE").groupBy(run).agg(F.max_by(F.to_json("state"), "seq").alias("state"))
