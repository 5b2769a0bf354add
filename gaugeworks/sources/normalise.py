"""Landed payloads of the supported sources as records: stream, timestamp, data_json.

Fetching isn't part of this engine: each normaliser reads payload text (``payload``, one response a row) and
explodes it. Rows without a usable time or of a wrong shape are dropped here and counted by ``dropped``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeworks.functions.times import normalised

HIT_TAGS = {"stories": "story", "comments": "comment"}


def synthetic(spark: SparkSession, streams: list[str], n: int) -> DataFrame:
    """``n`` records of each stream, a minute apart from 1700000000 s on."""
    rows = spark.range(n).crossJoin(spark.createDataFrame([(s,) for s in streams], "stream string"))  # a fixed list of names
    payload = F.to_json(F.struct("stream", F.col("id").alias("index"), F.concat_ws("-", "stream", F.col("id").cast("string")).alias("id")))
    return rows.select("stream", F.timestamp_seconds(1_700_000_000 + 60 * F.col("id")).alias("timestamp"), payload.alias("data_json"))


def _items(payloads: DataFrame, field: str) -> DataFrame:
    """Each element of a list field, as variant and as text."""
    listed = F.from_json(F.get_json_object("payload", f"$.{field}"), "array<variant>")
    others = [c for c in payloads.columns if c != "payload"]
    return payloads.select(*others, F.explode(listed).alias("v"))


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("v", f"$.{path}", kind)


def news_hits(payloads: DataFrame, stream: str) -> DataFrame:
    """``hits[]`` with a numeric ``created_at_i``; the payload is the whole hit. ``stream`` is stories or comments."""
    if stream not in HIT_TAGS:
        raise ValueError(f"no stream {stream!r}; known: {sorted(HIT_TAGS)}")
    rows = _items(payloads, "hits").withColumn("at", _get("created_at_i", "bigint"))
    return rows.where("at IS NOT NULL").select(F.lit(stream).alias("stream"), F.timestamp_seconds("at").alias("timestamp"), F.to_json("v").alias("data_json"), _get("objectID", "string").alias("id"), "at")


def page_window(hits: DataFrame, since: int, upper: int, per_page: int = 50, max_pages: int = 5) -> DataFrame:
    """What a bounded newest-first walk over (since, upper) reads, with each hit's page.

    ``hits`` has ``at`` (epoch seconds) and ``id``. A walk steps strictly below the oldest hit of a page, so
    hits that tie with it on the next page are left out, as the walk would. The limit is the feature here.
    """
    rows = hits.where((F.col("at") > since) & (F.col("at") < upper)).orderBy(F.col("at").desc(), "id").limit(per_page * max_pages + per_page)
    numbered = rows.withColumn("rn", F.row_number().over(Window.orderBy(F.col("at").desc(), "id")))
    page = F.ceil(F.col("rn") / per_page)
    return numbered.where(F.col("rn") <= per_page * max_pages).withColumn("page", page.cast("int")).drop("rn")


def daily_stats(payloads: DataFrame, stream: str, start: str, end: str) -> DataFrame:
    """``results[]`` of daily statistics within [start, end] (dates); a bad date is dropped."""
    date = F.when(_get("date", "string").rlike(r"^\d{4}-\d{2}-\d{2}$"), _get("date", "string").try_cast("date"))
    rows = _items(payloads, "results").withColumn("day", date)
    rows = rows.where(F.col("day").isNotNull() & F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    data = F.to_json(F.struct(_get("date", "string").alias("date"), _get("visitors", "bigint").alias("visitors"), _get("pageviews", "bigint").alias("pageviews"), _get("bounce_rate", "double").alias("bounce_rate"), _get("visit_duration", "double").alias("visit_duration")))
    return rows.select(F.lit(stream).alias("stream"), F.col("day").cast("timestamp").alias("timestamp"), data.alias("data_json"))


def traffic(payloads: DataFrame, stream: str) -> DataFrame:
    """``views[]`` or ``clones[]`` (the stream's name) with day, count and uniques."""
    rows = _items(payloads, stream).withColumn("at", F.try_to_timestamp(normalised(_get("timestamp", "string"))))
    data = F.to_json(F.struct(F.date_format("at", "yyyy-MM-dd").alias("date"), _get("count", "bigint").alias("count"), _get("uniques", "bigint").alias("uniques")))
    return rows.where("at IS NOT NULL").select(F.lit(stream).alias("stream"), F.col("at").alias("timestamp"), data.alias("data_json"))


def search_rows(payloads: DataFrame, stream: str, dims: list[str], end: str) -> DataFrame:
    """``rows[]`` with ``keys[]`` named by the configured dimensions; another number of keys drops the row.

    The time is the ``date`` dimension, or the window's end.
    """
    keys = F.try_variant_get("v", "$.keys", "array<string>")
    rows = _items(payloads, "rows").withColumn("keys", keys).where(F.size("keys") == len(dims))
    named = [F.col("keys")[i].alias(d) for i, d in enumerate(dims)]
    day = F.col("keys")[dims.index("date")] if "date" in dims else F.lit(end)
    metrics = [_get(m, "double").alias(m) for m in ("clicks", "impressions", "ctr", "position")]
    return rows.withColumn("at", day.try_cast("date").cast("timestamp")).where("at IS NOT NULL").select(F.lit(stream).alias("stream"), F.col("at").alias("timestamp"), F.to_json(F.struct(*named, *metrics)).alias("data_json"))


def visit_events(payloads: DataFrame, stream: str) -> DataFrame:
    """``data[]`` with RFC 3339 ``createdAt``; the payload is the whole event."""
    rows = _items(payloads, "data").withColumn("at", F.try_to_timestamp(normalised(_get("createdAt", "string"))))
    return rows.where("at IS NOT NULL").select(F.lit(stream).alias("stream"), F.col("at").alias("timestamp"), F.to_json("v").alias("data_json"))


def product_events(payloads: DataFrame, stream: str) -> DataFrame:
    """``results[]`` as timestamp, event and distinct_id, in order of time."""
    rows = _items(payloads, "results").withColumn("at", F.try_to_timestamp(normalised(_get("timestamp", "string")))).where("at IS NOT NULL")
    data = F.to_json(F.struct(_get("timestamp", "string").alias("timestamp"), _get("event", "string").alias("event"), _get("distinct_id", "string").alias("distinct_id")))
    return rows.select(F.lit(stream).alias("stream"), F.col("at").alias("timestamp"), data.alias("data_json")).orderBy("timestamp", "data_json")


def commits(log: DataFrame, last_hash: str | None = None) -> DataFrame:
    """``log(seq, line)``: hash, address, ISO date and subject between the first three tabs, newest first, up to a known hash (all without it)."""
    part = F.split("line", "\t", 4)
    rows = log.withColumn("p", part).where(F.size("p") == 4)
    rows = rows.select("seq", F.get("p", 0).alias("hash"), F.get("p", 1).alias("author"), F.try_to_timestamp(normalised(F.get("p", 2))).alias("at"), F.get("p", 3).alias("subject")).where("at IS NOT NULL")
    if last_hash is None:
        return rows
    stop = rows.where(F.col("hash") == last_hash).agg(F.min("seq").alias("stop"))
    return rows.crossJoin(F.broadcast(stop)).where("stop IS NULL OR seq < stop").drop("stop")  # one row


def after_cursor(records: DataFrame, cursors: DataFrame, default: str) -> DataFrame:
    """Records strictly newer than their stream's mark (the default without one)."""
    marks = cursors.select("stream", F.col("cursor").alias("__cursor"))
    joined = records.join(marks, "stream", "left")
    return joined.where(F.col("timestamp") > F.coalesce("__cursor", F.to_timestamp(F.lit(default)))).drop("__cursor")


def advanced(records: DataFrame, cursors: DataFrame) -> DataFrame:
    """New high-water marks, never below the old ones."""
    new = records.groupBy("stream").agg(F.max("timestamp").alias("seen"))
    return cursors.join(new, "stream", "full_outer").select("stream", F.greatest("cursor", "seen").alias("cursor"))


def selected(records: DataFrame, streams: list[str]) -> DataFrame:
    return records.where(F.col("stream").isin(streams))


#: Declarations of the supported sources: (connector, stream, kind, column, type, unit, direction, aggregation). Fixed values.
DECLARED = (
    ("web", "daily", "metric", "date", "timestamp", "", "neutral", "none"),
    ("web", "daily", "metric", "visitors", "int", "visitors", "higher_is_better", "sum"),
    ("web", "daily", "metric", "pageviews", "int", "views", "higher_is_better", "sum"),
    ("web", "daily", "metric", "bounce_rate", "float", "percent", "lower_is_better", "avg"),
    ("web", "daily", "metric", "visit_duration", "float", "seconds", "higher_is_better", "avg"),
    ("code", "views", "metric", "count", "int", "views", "higher_is_better", "sum"),
    ("code", "views", "metric", "uniques", "int", "visitors", "higher_is_better", "sum"),
    ("code", "clones", "metric", "count", "int", "clones", "higher_is_better", "sum"),
    ("code", "clones", "metric", "uniques", "int", "users", "higher_is_better", "sum"),
    ("search", "rows", "metric", "clicks", "float", "clicks", "higher_is_better", "sum"),
    ("search", "rows", "metric", "impressions", "float", "impressions", "higher_is_better", "sum"),
    ("search", "rows", "metric", "ctr", "float", "ratio", "higher_is_better", "avg"),
    ("search", "rows", "metric", "position", "float", "rank", "lower_is_better", "avg"),
    ("visits", "events", "event", "eventName", "string", "", "neutral", "none"),
    ("product", "events", "event", "event", "string", "", "neutral", "none"),
    ("git", "commits", "event", "hash", "string", "", "neutral", "none"),
    ("news", "stories", "event", "points", "int", "points", "higher_is_better", "last"),
    ("news", "comments", "event", "comment_text", "string", "", "neutral", "none"),
)


def semantic_catalog(spark: SparkSession, stream: str | None = None) -> DataFrame:
    """Declared columns, of one ``connector.stream`` with ``stream``."""
    rows = spark.createDataFrame(list(DECLARED), "connector string, stream string, kind string, name string, type string, unit string, direction string, aggregation string")
    return rows if stream is None else rows.where(F.concat_ws(".", "connector", "stream") == stream)


_readers: dict = {}


def register_reader(name: str, reader) -> None:
    """A source of one's own: a function from a session to a DataFrame of records."""
    if name in _readers:
        raise ValueError(f"source {name!r} is registered twice")
    _readers[name] = reader


def read_source(spark: SparkSession, name: str, **options) -> DataFrame:
    if name not in _readers:
        raise KeyError(f"no source {name!r}; known: {sorted(_readers)}")
    return _readers[name](spark, **options)


for _name, _reader in (("synthetic", synthetic), ("parquet", lambda spark, path: spark.read.parquet(path)), ("jsonl", lambda spark, path, schema: spark.read.schema(schema).json(path)), ("csv", lambda spark, path, schema=None, header=True: spark.read.csv(path, header=header, schema=schema, inferSchema=schema is None))):
    register_reader(_name, _reader)
