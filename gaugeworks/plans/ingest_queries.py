"""Queries over landing, enrichment, sources, catalog and streams, each with its SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions.hosts import url_host
from gaugeworks.functions.times import normalised
from gaugeworks.operators import anomalies as A
from gaugeworks.operators import baselines as B
from gaugeworks.operators import catalog as C
from gaugeworks.operators import enrichment, landing, sinks, write_mode
from gaugeworks.operators import events as V
from gaugeworks.operators.ledger import Ledger
from gaugeworks.plans import metric_queries as M
from gaugeworks.sources import connector
from gaugeworks.sources import normalise as N
from gaugeworks.sources import protocol as P
from gaugeworks.sources import tables as T
from gaugeworks.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}
STAMP = M.STAMP


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _fields(landed: DataFrame, *keep: str) -> DataFrame:
    """Landed rows with their payload's numbers, which print alike everywhere."""
    return landed.select(*keep, F.get_json_object("data_json", "$.k").cast("long").alias("k"), F.get_json_object("data_json", "$.value").cast("double").alias("value"))


_LANDED_SQL = "SELECT event_type AS stream, epoch_us(ts) AS timestamp, json_extract_string(props, '$.k')::BIGINT AS k, value FROM events"


@query("envelope", _LANDED_SQL)
def envelope(spark, sf):
    return _fields(landing.envelope(T.records(spark, sf)), "stream", "timestamp")


@query("typed_columns", _LANDED_SQL)
def typed_columns(spark, sf):
    return landing.typed_columns(landing.envelope(T.records(spark, sf)), {"k": "int", "value": "float"}).select("stream", "timestamp", "k", "value")


_HOST = "lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)', 1))"


@query("url_host", f"SELECT page_id, nullif({_HOST}, '') AS host FROM pages")
def url_host_(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", url_host(F.col("url")).alias("host"))


def _raw_ts(spark, sf) -> DataFrame:
    """Event times in eight formats."""
    at = T.second(F.col("ts"))
    kind = F.col("event_id") % 8
    text = lambda c, f: F.date_format(c, f)
    raw = (
        F.when(kind == 0, text(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(kind == 1, text(at, "yyyy-MM-dd'T'HH:mm:ss")).when(kind == 2, text(at, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 3, text(at + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).when(kind == 4, text(at, "yyyy-MM-dd")).when(kind == 5, F.unix_timestamp(at).cast("string"))
        .when(kind == 6, (F.unix_timestamp(at) * 1000).cast("string")).otherwise(F.concat(F.unix_timestamp(at).cast("string"), F.lit(".5")))
    )
    return T.table(spark, sf, "events").select("event_id", raw.alias("raw"))


@query("ts_normalize", "SELECT event_id, CASE event_id % 8 WHEN 4 THEN strftime(ts, '%Y-%m-%dT00:00:00Z') WHEN 7 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.5Z') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS ts FROM events")
def ts_normalize(spark, sf):
    return _raw_ts(spark, sf).select("event_id", normalised(F.col("raw")).alias("ts"))


@query("enrich_chain", f"SELECT page_id, nullif({_HOST}, '') AS host, strftime(make_timestamp((1704067200 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS seen FROM pages")
def enrich_chain(spark, sf):
    pages = T.table(spark, sf, "pages").select("page_id", "url", (F.lit(1_704_067_200) + F.col("page_id")).cast("string").alias("timestamp"))
    return enrichment.chain(pages, [("url_host", {}), ("ts_normalize", {"out_field": "seen"})]).select("page_id", "host", "seen")


# sources: payloads rendered from the tables, then read by the normalisers


def _payloads(rows: DataFrame, field: str, item, per_page: int = 50) -> DataFrame:
    return rows.groupBy(F.floor(F.col("event_id") / per_page).alias("page")).agg(F.to_json(F.struct(F.collect_list(item).alias(field))).alias("payload")).select("payload")


def _events(spark, sf) -> DataFrame:
    return T.table(spark, sf, "events").withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp")))


def _iso(c):
    return F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _news(spark, sf) -> DataFrame:
    item = F.struct(F.col("event_id").cast("string").alias("objectID"), F.when(F.col("event_id") % 10 != 0, F.col("at")).alias("created_at_i"), F.col("event_type").alias("title"))
    return N.news_hits(_payloads(_events(spark, sf), "hits", item), "stories")


@query("normalise_news", f"SELECT 'stories' AS stream, event_id::VARCHAR AS id, strftime(date_trunc('second', ts), {STAMP}) AS at_time, event_type AS title FROM events WHERE event_id % 10 <> 0")
def normalise_news(spark, sf):
    return _news(spark, sf).select("stream", "id", T.text_time(F.col("timestamp")).alias("at_time"), F.get_json_object("data_json", "$.title").alias("title"))


@query("page_window", """WITH h AS (SELECT event_id::VARCHAR AS id, epoch(date_trunc('second', ts))::BIGINT AS s FROM events WHERE event_id % 10 <> 0)
SELECT id, s AS at_s, ceil(row_number() OVER (ORDER BY s DESC, id) / 50.0)::INT AS page FROM h WHERE s > 1704500000 AND s < 1706000000 ORDER BY s DESC, id LIMIT 250""")
def page_window(spark, sf):
    return N.page_window(_news(spark, sf), 1_704_500_000, 1_706_000_000).select("id", F.col("at").alias("at_s"), "page")


@query("normalise_daily", """SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS visitors, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS pageviews FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21' GROUP BY ALL""")
def normalise_daily(spark, sf):
    days = _events(spark, sf).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("visitors"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("pageviews"))
    payload = days.groupBy().agg(F.to_json(F.struct(F.collect_list(F.struct("date", "visitors", "pageviews", F.lit(0.5).alias("bounce_rate"), F.lit(1.5).alias("visit_duration"))).alias("results"))).alias("payload"))  # a row a day
    out = N.daily_stats(payload, "daily", "2024-01-05", "2024-01-20")
    return out.select(F.get_json_object("data_json", "$.date").alias("date"), F.get_json_object("data_json", "$.visitors").cast("long").alias("visitors"), F.get_json_object("data_json", "$.pageviews").cast("long").alias("pageviews"))


@query("normalise_traffic", """SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n, count(DISTINCT user_id) AS uniques FROM events WHERE event_type = 'view' GROUP BY ALL HAVING max(date_trunc('day', ts)) > TIMESTAMP '2024-01-09'""")
def normalise_traffic(spark, sf):
    days = _events(spark, sf).where("event_type = 'view'").groupBy(F.date_format("ts", "yyyy-MM-dd'T'00:00:00'Z'").alias("timestamp")).agg(F.count("*").alias("count"), F.count_distinct("user_id").alias("uniques"))
    payload = days.groupBy().agg(F.to_json(F.struct(F.collect_list(F.struct("timestamp", "count", "uniques")).alias("views"))).alias("payload"))  # a row a day
    rows = N.traffic(payload, "views")
    cursors = rows.select("stream").distinct().withColumn("cursor", F.to_timestamp(F.lit("2024-01-09 00:00:00")))
    rows = N.after_cursor(rows, cursors, "1970-01-01 00:00:00")
    pick = lambda c: F.get_json_object("data_json", f"$.{c}")
    return rows.select(pick("date").alias("date"), pick("count").cast("long").alias("n"), pick("uniques").cast("long").alias("uniques"))


@query("normalise_search", "SELECT event_id::VARCHAR AS query, strftime(ts, '%Y-%m-%d') AS date, value AS clicks FROM events WHERE event_id % 7 <> 0")
def normalise_search(spark, sf):
    keys = F.when(F.col("event_id") % 7 != 0, F.array(F.date_format("ts", "yyyy-MM-dd"), F.col("event_id").cast("string"))).otherwise(F.array(F.col("event_id").cast("string")))
    item = F.struct(keys.alias("keys"), F.col("value").alias("clicks"), F.lit(1.0).alias("impressions"), F.lit(0.5).alias("ctr"), F.lit(3.0).alias("position"))
    out = N.search_rows(_payloads(_events(spark, sf), "rows", item), "rows", ["date", "query"], "2024-01-31")
    pick = lambda c: F.get_json_object("data_json", f"$.{c}")
    return out.select(pick("query").alias("query"), pick("date").alias("date"), pick("clicks").cast("double").alias("clicks"))


@query("normalise_visits", f"SELECT event_id::VARCHAR AS id, strftime(date_trunc('second', ts), {STAMP}) AS at_time FROM events WHERE event_id % 9 <> 0")
def normalise_visits(spark, sf):
    item = F.struct(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 9 != 0, _iso(F.col("at"))).otherwise(F.lit("soon")).alias("createdAt"), F.col("event_type").alias("eventName"))
    return N.visit_events(_payloads(_events(spark, sf), "data", item), "events").select(F.get_json_object("data_json", "$.id").alias("id"), T.text_time(F.col("timestamp")).alias("at_time"))


@query("normalise_product", f"SELECT user_id::VARCHAR AS distinct_id, event_type AS event, strftime(date_trunc('second', ts), {STAMP}) AS at_time FROM events")
def normalise_product(spark, sf):
    item = F.struct(F.col("event_type").alias("event"), F.col("user_id").cast("string").alias("distinct_id"), _iso(F.col("at")).alias("timestamp"))
    pick = lambda c: F.get_json_object("data_json", f"$.{c}")
    return N.product_events(_payloads(_events(spark, sf), "results", item), "events").select(pick("distinct_id").alias("distinct_id"), pick("event").alias("event"), T.text_time(F.col("timestamp")).alias("at_time"))


@query("normalise_commits", f"SELECT md5(event_id::VARCHAR) AS hash, strftime(date_trunc('second', ts), {STAMP}) AS at_time, event_type || chr(9) || 'x' AS subject FROM events WHERE event_id > 300 AND event_id % 11 <> 0")
def normalise_commits(spark, sf):
    rows = _events(spark, sf)
    line = F.concat_ws("\t", F.md5(F.col("event_id").cast("string")), F.concat(F.col("user_id").cast("string"), F.lit("@example.org")), F.when(F.col("event_id") % 11 != 0, _iso(F.col("at"))).otherwise(F.lit("?")), "event_type", F.lit("x"))
    log = rows.select((-F.col("event_id")).alias("seq"), line.alias("line"))
    import hashlib

    return N.commits(log, hashlib.md5(b"300").hexdigest()).select("hash", T.text_time(F.col("at")).alias("at_time"), "subject")


def _cursors(spark, sf) -> DataFrame:
    return T.records(spark, sf).where("seq < 4000").groupBy("stream").agg(F.max("timestamp").alias("cursor"))


_CURSOR_SQL = "cu AS (SELECT event_type AS stream, max(ts) AS cursor FROM events WHERE event_id < 4000 GROUP BY ALL)"


@query("cursor_filter", f"WITH {_CURSOR_SQL} SELECT event_id AS seq, event_type AS stream FROM events JOIN cu ON stream = event_type WHERE ts > cursor")
def cursor_filter(spark, sf):
    return N.after_cursor(T.records(spark, sf), _cursors(spark, sf), "1970-01-01 00:00:00").select("seq", "stream")


@query("high_water", "SELECT event_type AS stream, epoch_us(max(ts)) AS cursor_us FROM events GROUP BY ALL")
def high_water(spark, sf):
    return N.advanced(T.records(spark, sf), _cursors(spark, sf)).select("stream", F.unix_micros("cursor").alias("cursor_us"))


@query("stream_selection", "SELECT event_type AS stream, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL")
def stream_selection(spark, sf):
    return N.selected(T.records(spark, sf), ["click", "view", "absent"]).groupBy("stream").agg(F.count("*").alias("n"))


# the line protocol


def _log(spark, sf) -> DataFrame:
    """Events as protocol lines, a STATE after every hundredth, and some lines that are wrong."""
    rows = _events(spark, sf).withColumn("seq", F.col("event_id") * 2)
    k = F.get_json_object("props", "$.k").cast("long")
    stamp = F.when(F.col("event_id") % 83 == 0, F.lit(None)).when(F.col("event_id") % 79 == 0, F.lit("soon")).otherwise(_iso(F.col("at")))
    body = F.struct(F.lit("RECORD").alias("type"), F.when(F.col("event_id") % 89 == 0, "absent").otherwise(F.col("event_type")).alias("stream"), stamp.alias("timestamp"), F.when(F.col("event_id") % 73 != 0, F.struct(k.alias("k"))).alias("data"))
    line = F.when(F.col("event_id") % 97 == 0, "{not json").otherwise(F.to_json(body))
    records = rows.select(F.lit("r1").alias("run_id"), "seq", line.alias("line"))
    states = rows.where("event_id % 100 = 99").select(F.lit("r1").alias("run_id"), (F.col("seq") + 1).alias("seq"), F.to_json(F.struct(F.lit("STATE").alias("type"), F.struct(F.col("event_id").alias("cursor")).alias("state"))).alias("line"))
    return records.union(states)


_STREAMS = ["click", "error", "purchase", "signup", "view"]
_BAD = "CASE WHEN event_id % 89 = 0 THEN 'stream not configured' WHEN event_id % 83 = 0 THEN 'timestamp missing' WHEN event_id % 79 = 0 THEN 'timestamp unreadable' WHEN event_id % 73 = 0 THEN 'data missing' END"


@query("msglog_demux", "SELECT 'RECORD' AS type, NULL::VARCHAR AS problem, count(*) AS n FROM events WHERE event_id % 97 <> 0 UNION ALL SELECT NULL, 'not a JSON object', count(*) FROM events WHERE event_id % 97 = 0 UNION ALL SELECT 'STATE', NULL, count(*) FROM events WHERE event_id % 100 = 99")
def msglog_demux(spark, sf):
    return P.messages(_log(spark, sf)).groupBy("type", "problem").agg(F.count("*").alias("n"))


@query("msglog_rejects", f"SELECT {_BAD} AS reason, count(*) AS n FROM events WHERE event_id % 97 <> 0 AND {_BAD} IS NOT NULL GROUP BY ALL")
def msglog_rejects(spark, sf):
    return P.rejects(P.judged_records(P.messages(_log(spark, sf)), _STREAMS))


@query("msglog_records", f"SELECT event_id * 2 AS seq, event_type AS stream, strftime(date_trunc('second', ts), {STAMP}) AS at_time, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_id % 97 <> 0 AND {_BAD} IS NULL")
def msglog_records(spark, sf):
    good = P.judged_records(P.messages(_log(spark, sf)), _STREAMS).where("reason IS NULL")
    return good.select("seq", "stream", T.text_time(F.col("timestamp")).alias("at_time"), F.get_json_object("data_json", "$.k").cast("long").alias("k"))


@query("msglog_committed", "SELECT event_id * 2 AS seq, event_id * 2 < (SELECT max(event_id) * 2 + 1 FROM events WHERE event_id % 100 = 99) AS committed FROM events WHERE event_id % 97 <> 0")
def msglog_committed(spark, sf):
    return P.committed(P.messages(_log(spark, sf))).where("problem IS NULL AND type = 'RECORD'").select("seq", "committed")


# landing


def _seed(spark, sf) -> DataFrame:
    """A manifest of what an earlier run landed: all before 2024-01-10, by stream."""
    rows = T.records(spark, sf).where("timestamp < TIMESTAMP '2024-01-10 00:00:00'").groupBy("stream").agg(F.count("*").alias("rows"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"))
    return rows.withColumn("connector", F.lit("app")).withColumn("path", F.concat_ws("/", F.lit("seed"), "stream")).withColumn("format", F.lit("parquet"))


_SEED_SQL = "sd AS (SELECT event_type AS stream, count(*) AS n, min(ts) AS lo, max(ts) AS hi FROM events WHERE ts < TIMESTAMP '2024-01-10' GROUP BY ALL)"


@query("coverage_prune", f"WITH {_SEED_SQL} SELECT event_id AS seq, event_type AS stream FROM events e WHERE NOT EXISTS (SELECT 1 FROM sd WHERE sd.stream = e.event_type AND e.ts BETWEEN lo AND hi)")
def coverage_prune(spark, sf):
    return landing.prune_covered(T.records(spark, sf), _seed(spark, sf)).select("seq", "stream")


@query("run_counters", f"WITH {_SEED_SQL}, x AS (SELECT event_type AS stream, count(*) AS extracted, count(*) FILTER (ts > hi) AS persisted FROM events JOIN sd ON sd.stream = event_type GROUP BY ALL) SELECT stream, extracted, persisted, extracted - persisted AS pruned FROM x")
def run_counters(spark, sf):
    rows = T.records(spark, sf)
    return landing.run_counters(rows, landing.prune_covered(rows, _seed(spark, sf)))


def _landed(spark, sf, kind: str) -> tuple[DataFrame, DataFrame]:
    root = landing.new_folder(spark, "landed")
    manifest = landing.land(T.records(spark, sf), root, "r1", kind, "app")
    return landing.read_landed(spark, root, "r1", kind), manifest


@query("land_parquet_roundtrip", _LANDED_SQL)
def land_parquet_roundtrip(spark, sf):
    return _fields(_landed(spark, sf, "parquet")[0], "stream", "timestamp")


@query("land_jsonl_roundtrip", _LANDED_SQL)
def land_jsonl_roundtrip(spark, sf):
    return _fields(_landed(spark, sf, "json")[0], "stream", "timestamp")


@query("land_flat", "SELECT event_type AS stream, count(*) AS n, sum(value >= 10)::BIGINT AS large FROM events WHERE event_type <> 'click' OR event_id % 2 = 0 GROUP BY ALL")
def land_flat(spark, sf):
    root = landing.new_folder(spark, "flat")
    rows = T.records(spark, sf)
    landing.land_flat(rows, root)
    out = landing.land_flat(rows.where("stream = 'click' AND seq % 2 = 0"), root)
    return _fields(out, "stream").groupBy("stream").agg(F.count("*").alias("n"), F.sum((F.col("value") >= 10).cast("long")).alias("large"))


@query("manifest_build", "SELECT event_type AS stream, 'app' AS connector, 'parquet' AS format, count(*) AS n, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us FROM events GROUP BY ALL")
def manifest_build(spark, sf):
    rows = _landed(spark, sf, "parquet")[1]
    return rows.groupBy("stream", "connector", "format").agg(F.sum("rows").alias("n"), F.unix_micros(F.min("start_time")).alias("start_us"), F.unix_micros(F.max("end_time")).alias("end_us"))


@query("manifest_rows", f"WITH {_SEED_SQL} SELECT stream, n FROM sd")
def manifest_rows(spark, sf):
    seed = _seed(spark, sf)
    other = seed.withColumn("connector", F.lit("shop"))
    return landing.rows_by_stream(seed.unionByName(other), "app").withColumnRenamed("rows", "n")


@query("manifest_upsert", f"WITH {_SEED_SQL} SELECT stream, CASE WHEN stream = 'view' THEN 0 ELSE n END AS n FROM sd")
def manifest_upsert(spark, sf):
    seed = _seed(spark, sf)
    new = seed.where("stream = 'view'").withColumn("rows", F.lit(0).cast("long"))
    return landing.manifest_upsert(seed, new).select("stream", F.col("rows").alias("n"))


# catalog


def _run_rows(spark, sf, where: str, at: str) -> DataFrame:
    rows = T.records(spark, sf).where(where).groupBy("stream").agg(F.count("*").alias("row_count_lifetime"))
    when = F.to_timestamp(F.lit(at))
    return rows.select(F.lit("app").alias("connector"), "stream", F.lit("event").alias("kind"), when.alias("first_seen_at"), when.alias("last_seen_at"), "row_count_lifetime")


@query("stream_upsert", "SELECT 'app' AS connector, event_type AS stream, CASE WHEN max(event_id) >= 700 THEN 'metric' ELSE 'event' END AS kind, CASE WHEN min(event_id) < 700 THEN '2024-01-15 00:00:00' ELSE '2024-01-31 00:00:00' END AS first_seen_at, CASE WHEN max(event_id) >= 700 THEN '2024-01-31 00:00:00' ELSE '2024-01-15 00:00:00' END AS last_seen_at, count(*) AS n FROM events GROUP BY ALL")
def stream_upsert(spark, sf):
    old = _run_rows(spark, sf, "seq < 700", "2024-01-15 00:00:00")
    new = _run_rows(spark, sf, "seq >= 700", "2024-01-31 00:00:00").withColumn("kind", F.lit("metric"))
    out = C.upsert_streams(old, new).orderBy("connector", "stream")
    return out.select("connector", "stream", "kind", T.text_time(F.col("first_seen_at")).alias("first_seen_at"), T.text_time(F.col("last_seen_at")).alias("last_seen_at"), F.col("row_count_lifetime").alias("n"))


@query("metric_upsert", f"WITH {M.OE}, la AS (SELECT fq_name, value, tm FROM oe QUALIFY row_number() OVER (PARTITION BY fq_name ORDER BY tm DESC, seq DESC) = 1) SELECT fq_name, 'new' AS unit, value AS last_value, strftime(tm, {STAMP}) AS last_at FROM la")
def metric_upsert(spark, sf):
    obs = T.obs_events(spark, sf)
    old = T.metric_dim(obs).join(A.latest(obs).select("fq_name", F.col("value").alias("last_value"), F.col("observed_at").alias("last_value_at")), "fq_name")
    new = T.metric_dim(obs).withColumn("unit", F.lit("new")).withColumn("last_value", F.lit(None).cast("double")).withColumn("last_value_at", F.lit(None).cast("timestamp"))
    return C.upsert_metrics(old, new).select("fq_name", "unit", "last_value", T.text_time(F.col("last_value_at")).alias("last_at"))


@query("last_observed", "SELECT event_type AS stream, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def last_observed(spark, sf):
    last = C.last_records(T.records(spark, sf), ("stream",))
    return last.select("stream", "seq", F.get_json_object("data_json", "$.value").cast("double").alias("value"))


@query("metric_values", "WITH x AS (SELECT event_type, arg_max(value, event_id) AS value, arg_max(json_extract_string(props, '$.k')::DOUBLE, event_id) AS k FROM events GROUP BY ALL) SELECT 'app.' || event_type || '.value' AS fq_name, value FROM x UNION ALL SELECT 'app.' || event_type || '.k', k FROM x")
def metric_values(spark, sf):
    return C.metric_values(C.last_records(T.records(spark, sf), ("stream",)), "app", ["value", "k", "absent"]).select("fq_name", "value")


@query("metric_declared", f"WITH {M.OE} SELECT 'app.events.' || event_type AS fq_name, true AS declared FROM events GROUP BY ALL UNION ALL SELECT DISTINCT 'app.unknown.' || event_type, false FROM events")
def metric_declared(spark, sf):
    obs = T.obs_events(spark, sf)
    names = obs.select("fq_name").union(obs.select(F.replace("fq_name", F.lit(".events."), F.lit(".unknown.")))).distinct()
    return C.declared(T.metric_dim(obs), names)


def _configured(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nations as connectors with a stream for each event type; customers' orders as what they landed."""
    nation = T.table(spark, sf, "nation")
    streams = T.table(spark, sf, "events").select(F.col("event_type").alias("stream")).distinct()
    configured = nation.where("n_nationkey < 20").crossJoin(F.broadcast(streams)).select(F.concat(F.lit("p"), F.col("n_regionkey").cast("string")).alias("product"), F.col("n_name").alias("connector"), "stream")  # a fixed 25 by 5
    key = F.concat_ws("/", F.concat(F.lit("p"), F.col("n_regionkey").cast("string")), "n_name")
    synced = F.to_timestamp(F.lit("2024-01-30 00:00:00")) + F.make_interval(hours=F.col("n_nationkey").cast("int"))
    state = nation.where("n_nationkey % 4 <> 0").select(key.alias("key"), synced.alias("updated_at"))
    counts = T.table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(key.alias("key")).agg(F.count("*").alias("rows")).withColumn("stream", F.lit("click"))
    return configured, state, counts


@query("health_report", """WITH c AS (SELECT 'p' || n_regionkey AS product, n_name AS connector, stream, n_nationkey FROM nation, (SELECT DISTINCT event_type AS stream FROM events) WHERE n_nationkey < 20), k AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL)
SELECT product, connector, stream, CASE WHEN stream = 'click' THEN coalesce(n, 0) ELSE 0 END AS records, CASE WHEN n_nationkey % 4 = 0 THEN 'never' WHEN n_nationkey < 12 THEN 'stale' ELSE 'ok' END AS status FROM c LEFT JOIN k ON c_nationkey = n_nationkey""")
def health_report(spark, sf):
    return C.health(*_configured(spark, sf), "2024-01-31 12:00:00").select("product", "connector", "stream", "records", "status")


@query("orphan_state", "SELECT 'p' || n_regionkey || '/' || n_name AS key FROM nation WHERE n_nationkey % 4 <> 0 AND n_nationkey >= 20")
def orphan_state(spark, sf):
    configured, state, _ = _configured(spark, sf)
    return C.orphans(configured, state).select("key")


# streams, each the same as a batch job


def _files(df: DataFrame, name: str, n: int = 4) -> tuple[str, object]:
    """Rows as ``n`` files that a stream reads one by one."""
    folder = landing.new_folder(df.sparkSession, name)
    df.repartition(n).write.parquet(folder)
    return folder, df.schema


def _stream(df: DataFrame, name: str) -> DataFrame:
    return jobs.records_stream(df.sparkSession, *_files(df, name))


@query("stream_land", _LANDED_SQL)
def stream_land(spark, sf):
    out = jobs.landed_by_stream(spark, _stream(T.records(spark, sf), "in"), landing.new_folder(spark, "landed"), landing.new_folder(spark, "marks"))
    return _fields(out, "stream", "timestamp")


@query("stream_land_pruned", f"WITH {_SEED_SQL} SELECT event_type AS stream, epoch_us(ts) AS timestamp FROM events e JOIN sd ON sd.stream = e.event_type WHERE ts NOT BETWEEN lo AND hi")
def stream_land_pruned(spark, sf):
    out = jobs.landed_by_stream(spark, _stream(T.records(spark, sf), "in"), landing.new_folder(spark, "landed"), landing.new_folder(spark, "marks"), _seed(spark, sf))
    return out.select("stream", "timestamp")


@query("stream_high_water", "SELECT event_type AS stream, epoch_us(max(ts)) AS cursor_us, count(*) AS records FROM events GROUP BY ALL")
def stream_high_water(spark, sf):
    out = jobs.high_water(spark, _stream(T.records(spark, sf), "in"), landing.new_folder(spark, "marks"))
    return out.select("stream", F.unix_micros("cursor").alias("cursor_us"), "records")


_DEDUP_SQL = f"WITH {M.MARKS} SELECT DISTINCT kind, metric_fq, strftime(tm, {STAMP}) AS at_time FROM mk"


def _marks_twice(spark, sf) -> DataFrame:
    marks = V.marks_as_events(T.marks(spark, sf)).drop("seq")
    return _stream(marks.union(marks), "in")


@query("stream_event_dedup", _DEDUP_SQL)
def stream_event_dedup(spark, sf):
    out = jobs.seen_once(spark, _marks_twice(spark, sf), list(V.KEY), landing.new_folder(spark, "seen"), landing.new_folder(spark, "marks"))
    return out.select("kind", "metric_fq", T.text_time(F.col("at")).alias("at_time"))


@query("stream_event_dedup_keys", "SELECT user_id, true AS seen FROM events GROUP BY ALL")
def stream_event_dedup_keys(spark, sf):
    """One event for each user, whose events come on many days and in every batch: the key doesn't hold the time."""
    rows = T.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    out = jobs.seen_once(spark, _stream(rows, "in"), ["user_id"], landing.new_folder(spark, "seen"), landing.new_folder(spark, "marks"))
    return out.select("user_id", F.col("at").isNotNull().alias("seen"))


@query("stream_event_dedup_watermark", _DEDUP_SQL)
def stream_event_dedup_watermark(spark, sf):
    out = jobs.deduplicated(_marks_twice(spark, sf), list(V.KEY), late="60 days")
    out = jobs.append_all(spark, out, landing.new_folder(spark, "out"), landing.new_folder(spark, "marks"))
    return out.select("kind", "metric_fq", T.text_time(F.col("at")).alias("at_time"))


@query("stream_anomalies", f"""WITH {M.OE}, {M.dim('oe')}, {M.baselines_sql('oe', T.EVENTS_AS_OF, cap=B.SAMPLE_CAP)}
SELECT oe.fq_name AS metric_fq, strftime(tm, {STAMP}) AS at_time, window_days, value AS observed_value, {M.LABEL.format(d='direction', v='(value - mean)')} AS direction FROM oe JOIN bl USING (fq_name) JOIN dim USING (fq_name) WHERE sample_count >= 14 AND stddev <> 0 AND abs((value - mean) / stddev) >= 2.5""")
def stream_anomalies(spark, sf):
    obs = T.obs_events(spark, sf)
    names = T.metric_dim(obs)
    out = jobs.online_anomalies(spark, _stream(obs, "in"), B.compute(obs, T.EVENTS_AS_OF), names, A.thresholds(names), landing.new_folder(spark, "out"), landing.new_folder(spark, "marks"))
    return out.select("metric_fq", T.text_time(F.col("at")).alias("at_time"), "window_days", "observed_value", "direction")


def _live(spark, sf) -> tuple[jobs.LiveBaselines, int]:
    """Events' observations in four batches, in order of time."""
    obs, folder, dim = T.obs_events(spark, sf), landing.new_folder(spark, "in"), landing.new_folder(spark, "dim")
    T.metric_dim(obs).write.parquet(dim)
    names = spark.read.parquet(dim)
    lo, hi = obs.agg(F.unix_timestamp(F.min("observed_at")), F.unix_timestamp(F.max("observed_at"))).first()
    at = F.unix_timestamp("observed_at")
    for k in range(4):
        piece = obs.where((at >= lo + (hi + 1 - lo) * k // 4) & (at < lo + (hi + 1 - lo) * (k + 1) // 4))
        piece.repartition(4).write.mode("append").parquet(folder)
    live = jobs.LiveBaselines(spark, landing.new_folder(spark, "live"), names, A.thresholds(names))
    query = jobs.run_available(jobs.records_stream(spark, folder, obs.schema, files=4), live.batch, landing.new_folder(spark, "marks"))
    return live, jobs.batches_of(query)


@query("stream_anomalies_live", M.SQL["anomaly_replay"])
def stream_anomalies_live(spark, sf):
    """Each observation against baselines refreshed with it: what a replay of the whole past finds."""
    return M._anomaly_rows(_live(spark, sf)[0].anomalies())


@query("stream_baselines_live", f"WITH {M.OE}, rp AS ({M.replay_sql('oe')}) SELECT DISTINCT fq_name, window_days, round(mean + 1.3e-7, 6) AS mean, n AS sample_count, strftime(tm, {STAMP}) AS computed_at FROM rp JOIN (SELECT fq_name, max(tm) AS tm FROM oe GROUP BY ALL) USING (fq_name, tm)")
def stream_baselines_live(spark, sf):
    live, batches = _live(spark, sf)
    return live.baselines(batches).select("fq_name", "window_days", M.rounded("mean").alias("mean"), "sample_count", T.text_time(F.col("last_computed_at")).alias("computed_at"))


@query("stream_repeat", _LANDED_SQL)
def stream_repeat(spark, sf):
    """Lands four files at an interval; the second batch fails once and is tried again."""
    root, failed = landing.new_folder(spark, "landed"), []
    land = jobs.landing_batch(root, "again")

    def batch(df, batch_id):
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise OSError("the store is away for a moment")
        land(df, batch_id)

    jobs.run_repeatedly(_stream(T.records(spark, sf), "in"), batch, landing.new_folder(spark, "marks"), "100 milliseconds", lambda q: q.lastProgress and q.lastProgress["batchId"] >= 3)
    return _fields(landing.read_landed(spark, root), "stream", "timestamp")


def _log_landed(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The protocol log as text files, read as a stream: what was landed, and the last state."""
    folder = landing.new_folder(spark, "log")
    _log(spark, sf).repartitionByRange(4, "seq").sortWithinPartitions("seq").select("line").write.text(folder)
    return _runs_landed(spark, folder, files=4)


def _runs_landed(spark, folder: str, files: int) -> tuple[DataFrame, DataFrame]:
    root, states, held = (landing.new_folder(spark, n) for n in ("landed", "states", "held"))
    runs = jobs.LogRuns(spark, root, states, held, "log", _STREAMS)
    query = jobs.run_available(jobs.log_stream(spark, folder, files), runs.batch, landing.new_folder(spark, "marks"))
    runs.close(jobs.batches_of(query))
    return landing.read_landed(spark, root), runs.states()


@query("stream_msglog", f"SELECT event_type AS stream, epoch_us(date_trunc('second', ts)) AS timestamp, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_id % 97 <> 0 AND {_BAD} IS NULL")
def stream_msglog(spark, sf):
    return _fields(_log_landed(spark, sf)[0], "stream", "timestamp").drop("value")


@query("stream_msglog_state", "SELECT max(event_id) AS cursor FROM events WHERE event_id % 100 = 99")
def stream_msglog_state(spark, sf):
    return _log_landed(spark, sf)[1].select(F.get_json_object("state", "$.cursor").cast("long").alias("cursor"))


_RUN = "event_id % 3"
_RUNS_SQL = f"""WITH g AS (SELECT event_id, {_RUN} AS run, event_type AS stream, epoch_us(date_trunc('second', ts)) AS timestamp, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_id % 97 <> 0 AND {_BAD} IS NULL),
e AS (SELECT {_RUN} AS run, min(event_id) AS err FROM events WHERE {_RUN} > 0 AND event_id % 1777 = 1700 GROUP BY ALL),
a AS (SELECT g.*, err FROM g LEFT JOIN e USING (run) WHERE err IS NULL OR event_id <= err),
s AS (SELECT {_RUN} AS run, max(event_id) AS st FROM events LEFT JOIN e ON e.run = {_RUN} WHERE event_id % 700 = 699 AND (err IS NULL OR event_id < err) GROUP BY ALL),
r AS (SELECT a.*, st, row_number() OVER (PARTITION BY run, stream, coalesce(event_id > st, true) ORDER BY event_id) AS k_th, count(*) OVER (PARTITION BY run, stream, coalesce(event_id > st, true)) AS c FROM a LEFT JOIN s USING (run)),
f AS (SELECT * FROM r WHERE err IS NULL OR coalesce(event_id <= st, false) OR k_th <= c // 500 * 500)"""


def _run_files(spark, sf) -> str:
    """Three runs' logs, each in four files that come one after the other; STATEs are rare, and two runs break off with an ERROR, more than once."""
    rows = _events(spark, sf)
    records = _log(spark, sf).where("seq % 2 = 0").select((F.col("seq") * 2).alias("seq"), "line")
    note = lambda where, at, body: rows.where(where).select((F.col("event_id") * 4 + at).alias("seq"), F.to_json(body).alias("line"))
    errors = note(f"{_RUN} > 0 AND event_id % 1777 = 1700", 1, F.struct(F.lit("ERROR").alias("type"), F.lit("gone").alias("error")))
    states = note("event_id % 700 = 699", 2, F.struct(F.lit("STATE").alias("type"), F.struct(F.col("event_id").alias("cursor")).alias("state")))
    log = records.union(errors).union(states).withColumn("run_id", F.concat(F.lit("r"), (F.floor(F.col("seq") / 4) % 3).cast("string")))
    folder, last = landing.new_folder(spark, "log"), rows.agg(F.max("event_id")).first()[0] * 4 + 3
    for part in range(4):
        lines = log.where((F.col("seq") > last * part // 4 - (part == 0)) & (F.col("seq") <= last * (part + 1) // 4))
        lines.repartition("run_id").sortWithinPartitions("run_id", "seq").select("run_id", "line").write.partitionBy("run_id").text(f"{folder}/part={part}")
    return folder


@query("stream_runs", f"{_RUNS_SQL} SELECT stream, timestamp, k FROM f")
def stream_runs(spark, sf):
    """Runs that end cleanly land all their records; of those that end with an ERROR what a STATE or a full batch let go."""
    return _fields(_runs_landed(spark, f"{_run_files(spark, sf)}/*/*", 2)[0], "stream", "timestamp").drop("value")


@query("stream_runs_state", f"{_RUNS_SQL} SELECT 'r' || run AS run_id, st AS cursor FROM s")
def stream_runs_state(spark, sf):
    """The last state that each run saved before its end."""
    return _runs_landed(spark, f"{_run_files(spark, sf)}/*/*", 2)[1].select("run_id", F.get_json_object("state", "$.cursor").cast("long").alias("cursor"))


# write mode, plug-ins, and what is declared


@query("write_table", _LANDED_SQL)
def write_table(spark, sf):
    landed, name = _landed(spark, sf, "parquet")[0], write_mode.working_table(spark, "landed")
    write_mode.create_table_as(spark, name, "SELECT stream, timestamp, data_json FROM {landed} WHERE stream <> 'click'", landed=landed)
    return _fields(write_mode.insert_into(spark, name, "SELECT stream, timestamp, data_json FROM {landed} WHERE stream = 'click'", landed=landed), "stream", "timestamp")


@query("write_copy", "SELECT event_type AS stream, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM events GROUP BY ALL")
def write_copy(spark, sf):
    folder = landing.new_folder(spark, "copy")
    write_mode.copy_to(spark, folder, "csv", "SELECT stream, count(*) AS n, min(timestamp) AS first_us, max(timestamp) AS last_us FROM {landed} GROUP BY stream", landed=_landed(spark, sf, "parquet")[0])
    return N.read_source(spark, "csv", path=folder, schema="stream string, n long, first_us long, last_us long", header=False)


def _csv_sink(records: DataFrame, folder: str) -> DataFrame:
    """A sink as a user might add it."""
    records.write.mode("overwrite").option("header", True).csv(folder)
    return N.read_source(records.sparkSession, "csv", path=folder)


landing.register_sink("csv_for_queries", _csv_sink)
_EVENTS_CSV_SQL = "SELECT event_id, event_type, value FROM events"


@query("csv_scan", _EVENTS_CSV_SQL)
def csv_scan(spark, sf):
    folder = landing.new_folder(spark, "csv")
    T.table(spark, sf, "events").select("event_id", "event_type", "value").write.option("header", True).csv(folder)
    out = N.read_source(spark, "csv", path=folder)
    return out.select(F.col("event_id").cast("long").alias("event_id"), "event_type", "value")


@query("sink_plugin", _EVENTS_CSV_SQL)
def sink_plugin(spark, sf):
    rows = T.table(spark, sf, "events").select("event_id", "event_type", "value")
    return landing.write_to(rows, "csv_for_queries", folder=landing.new_folder(spark, "csv")).select(F.col("event_id").cast("long").alias("event_id"), "event_type", "value")


def _order_records(spark, sf: str) -> DataFrame:
    """A source as a user might add it: orders as records."""
    return T.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("stream"), F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.to_json(F.struct("o_orderkey")).alias("data_json"))


N.register_reader("orders_for_queries", _order_records)


@query("reader_plugin", "SELECT o_orderpriority AS stream, epoch_us(o_orderdate::TIMESTAMP) AS timestamp, o_orderkey AS k FROM orders")
def reader_plugin(spark, sf):
    rows = landing.envelope(N.read_source(spark, "orders_for_queries", sf=sf))
    return rows.select("stream", "timestamp", F.get_json_object("data_json", "$.o_orderkey").cast("long").alias("k"))


@query("connector_extract", f"{_LANDED_SQL} WHERE event_type IN ('click', 'view') AND ts > TIMESTAMP '2024-01-10 00:00:00'")
def connector_extract(spark, sf):
    """Landed events through a connector: streams and cursor go down to it, and tasks read its pieces."""
    root = landing.new_folder(spark, "landed")
    landing.land(T.records(spark, sf), root, "r1")
    rows = connector.extract(spark, "parquet_folder", path=root).where(F.col("stream").isin("click", "view") & (F.col("timestamp") > F.lit("2024-01-10 00:00:00").cast("timestamp")))
    return _fields(landing.envelope(rows), "stream", "timestamp")


@query("connector_stream", _LANDED_SQL)
def connector_stream(spark, sf):
    """Two runs through the same connector as a stream, the second after a restart."""
    root, out, marks = (landing.new_folder(spark, n) for n in ("landed", "out", "marks"))
    for run, half in (("r1", "seq % 2 = 0"), ("r2", "seq % 2 = 1")):
        landing.land(T.records(spark, sf).where(half), root, run)
        rows = jobs.append_all(spark, connector.extract_stream(spark, "parquet_folder", path=root), out, marks)
    return _fields(landing.envelope(rows), "stream", "timestamp")


@query("sink_lifecycle", _LANDED_SQL)
def sink_lifecycle(spark, sf):
    """Two runs through a sink that commits; a third breaks off, and nothing of it is seen."""
    path, rows = landing.new_folder(spark, "sink"), landing.envelope(T.records(spark, sf)).withColumn("seq", F.get_json_object("data_json", "$.k").cast("long"))
    for run, half in (("r1", "seq % 2 = 0"), ("r2", "seq % 2 = 1")):
        sinks.write_run(rows.where(half).drop("seq"), "run_folder", path=path, run=run)
    try:
        sinks.write_run(rows.drop("seq").withColumn("data_json", F.when(F.col("stream") == "view", F.raise_error(F.lit("torn"))).otherwise(F.col("data_json"))), "run_folder", path=path, run="r3")
    except Exception as error:
        if "torn" not in str(error):
            raise
    return _fields(sinks.read_committed(spark, path, "stream string, timestamp long, data_json string"), "stream", "timestamp")


@query("synthetic_source", "SELECT stream, i AS index, 1700000000 + 60 * i AS at_s, stream || '-' || i AS id FROM (SELECT DISTINCT event_type AS stream FROM events), (SELECT unnest(range((SELECT count(*) FROM events))) AS i)")
def synthetic_source(spark, sf):
    """As many records of each event type as there are events."""
    events = T.table(spark, sf, "events")
    streams = [r.event_type for r in events.select("event_type").distinct().orderBy("event_type").collect()]
    pick = lambda c: F.get_json_object("data_json", f"$.{c}")
    return N.read_source(spark, "synthetic", streams=streams, n=events.count()).select("stream", pick("index").cast("long").alias("index"), F.unix_timestamp("timestamp").alias("at_s"), pick("id").alias("id"))


@query("semantic_catalog", """SELECT 'clicks' AS name, 'clicks' AS unit, 'higher_is_better' AS direction, 'sum' AS aggregation, round(sum(value), 3) AS total, count(*) AS n FROM events WHERE event_id % 7 <> 0
UNION ALL SELECT 'ctr', 'ratio', 'higher_is_better', 'avg', round(count(*) * 0.5, 3), count(*) FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT 'impressions', 'impressions', 'higher_is_better', 'sum', round(count(*) * 1.0, 3)::DOUBLE, count(*) FROM events WHERE event_id % 7 <> 0
UNION ALL SELECT 'position', 'rank', 'lower_is_better', 'avg', round(count(*) * 3.0, 3)::DOUBLE, count(*) FROM events WHERE event_id % 7 <> 0""")
def semantic_catalog(spark, sf):
    """What is declared of one stream, with the totals of its columns in the records of that stream."""
    declared = N.semantic_catalog(spark, "search.rows")
    keys = F.when(F.col("event_id") % 7 != 0, F.array(F.date_format("ts", "yyyy-MM-dd"), F.col("event_id").cast("string"))).otherwise(F.array(F.col("event_id").cast("string")))
    item = F.struct(keys.alias("keys"), F.col("value").alias("clicks"), F.lit(1.0).alias("impressions"), F.lit(0.5).alias("ctr"), F.lit(3.0).alias("position"))
    rows = N.search_rows(_payloads(_events(spark, sf), "rows", item), "rows", ["date", "query"], "2024-01-31")
    values = rows.select(F.explode(F.from_json("data_json", "map<string,string>")).alias("name", "v"))
    sums = values.groupBy("name").agg(F.round(F.sum(F.col("v").try_cast("double")), 3).alias("total"), F.count("*").alias("n"))
    return declared.join(sums, "name").select("name", "unit", "direction", "aggregation", "total", "n")


@query("semantics_sidecar", f"WITH {M.OE}, {M.dim('oe')} SELECT substr(fq_name, 5) AS stream, 'event' AS kind, 'value' AS name, 'float' AS type, unit, direction, aggregation FROM dim")
def semantics_sidecar(spark, sf):
    dim = T.metric_dim(T.obs_events(spark, sf))
    catalog = dim.select(F.expr("substring(fq_name, 5)").alias("stream"), F.lit("event").alias("kind"), F.lit("value").alias("name"), F.lit("float").alias("type"), "unit", "direction", "aggregation")
    kind = "map<string,struct<kind:string,columns:array<struct<name:string,type:string,unit:string,direction:string,aggregation:string>>>>"
    entries = landing.semantics_sidecar(catalog).select(F.explode(F.from_json("semantics", kind)).alias("stream", "s"))
    return entries.select("stream", "s.kind", F.explode("s.columns").alias("c")).select("stream", "kind", "c.*")


@query("land_no_resume", "SELECT event_id AS seq, event_type AS stream FROM events")
def land_no_resume(spark, sf):
    return landing.prune_covered(T.records(spark, sf), _seed(spark, sf), resume=False).select("seq", "stream")


@query("manifest_lookup", "SELECT event_type AS stream, count(*) AS n, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us FROM events WHERE event_type = 'click' GROUP BY ALL")
def manifest_lookup(spark, sf):
    rows = landing.manifest_for(_landed(spark, sf, "parquet")[1], "click")
    return rows.groupBy("stream").agg(F.sum("rows").alias("n"), F.unix_micros(F.min("start_time")).alias("start_us"), F.unix_micros(F.max("end_time")).alias("end_us"))


@query("manifest_touch", f"SELECT event_type AS stream, strftime(greatest(max(date_trunc('second', ts)), TIMESTAMP '2024-01-20 00:00:00'), {STAMP}) AS updated_at FROM events GROUP BY ALL")
def manifest_touch(spark, sf):
    """A header for each stream; a run on the 20th that lands nothing moves those on that are older."""
    headers = T.records(spark, sf).groupBy("stream").agg(F.max(T.second(F.col("timestamp"))).alias("updated_at"))
    return landing.manifest_touch(headers, "2024-01-20 00:00:00").select("stream", T.text_time(F.col("updated_at")).alias("updated_at"))


@query("effective_schema", "SELECT event_type AS stream, CASE WHEN event_type IN ('click', 'view') THEN 'declared' ELSE 'k' || arg_max(json_extract_string(props, '$.k'), event_id) END AS schema, CASE WHEN event_type IN ('click', 'view') THEN 'declared' ELSE 'announced' END AS source FROM events GROUP BY event_type")
def effective_schema(spark, sf):
    """Each event announces a schema of its stream; two streams have a declared one."""
    events = T.table(spark, sf, "events")
    announced = events.select(F.col("event_type").alias("stream"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("schema"), F.col("event_id").alias("seq"))
    static = events.where("event_type IN ('click', 'view')").select(F.col("event_type").alias("stream"), F.lit("declared").alias("schema")).distinct()
    return C.effective_schema(static, announced)


@query("state_store", "SELECT 'c' || c_custkey AS key, CASE WHEN n IS NULL THEN 'none' ELSE 'orders ' || n END AS state FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) ON o_custkey = c_custkey WHERE c_custkey % 5 <> 0")
def state_store(spark, sf):
    """A state for each customer, saved anew for those with orders; every fifth is deleted."""
    key = lambda c: F.concat(F.lit("c"), F.col(c).cast("string")).alias("key")
    old = T.table(spark, sf, "customer").select(key("c_custkey"), F.lit("none").alias("state"))
    new = T.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select(key("o_custkey"), F.concat(F.lit("orders "), F.col("n").cast("string")).alias("state"))
    gone = T.table(spark, sf, "customer").where("c_custkey % 5 = 0").select(key("c_custkey"))
    return C.delete_state(C.save_state(old, new), gone)


# tables that several writers change


_LEDGER_MANIFEST_SQL = """
WITH r AS (SELECT event_id % 4 AS run, event_type AS stream, count(*) AS n, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us FROM events GROUP BY ALL)
SELECT run, stream, n, start_us, end_us FROM r WHERE run <> 0
UNION ALL SELECT run, stream, n + 1000, start_us, end_us FROM r WHERE run = 0 AND stream <> 'click'
"""


@query("manifest_ledger", _LEDGER_MANIFEST_SQL)
def manifest_ledger(spark, sf):
    """Four runs land a quarter of the records each and commit their manifest rows at once; the first then corrects its own."""
    root = landing.new_folder(spark, "manifest")
    book = Ledger(spark, f"{root}/ledger", "run bigint, stream string, n bigint, start_us bigint, end_us bigint", ("run", "stream"), fan=4)

    def run(k: int) -> None:
        landed = landing.land(T.records(spark, sf).where(F.col("seq") % 4 == k), f"{root}/data", f"r{k}")
        of_stream = landed.groupBy("stream").agg(F.sum("rows").alias("n"), F.min("start_time").alias("lo"), F.max("end_time").alias("hi"))
        book.put(of_stream.select(F.lit(k).alias("run"), "stream", "n", F.unix_micros("lo").alias("start_us"), F.unix_micros("hi").alias("end_us")), name=f"r{k}")

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(run, range(4)))
    book.merge()
    first = book.read().where("run = 0")
    book.put(first.withColumn("n", F.col("n") + 1000))
    book.remove(first.where("stream = 'click'"))
    return book.read()


_LEDGER_STATE_SQL = "SELECT c_nationkey AS nation, count(*) AS customers, max(c_custkey) AS last_key FROM customer GROUP BY ALL"


@query("state_ledger", _LEDGER_STATE_SQL)
def state_ledger(spark, sf):
    """Two writers add their half of the customers to each nation's state at once; either reads what the other has added."""
    book = Ledger(spark, landing.new_folder(spark, "state"), "nation bigint, customers bigint, last_key bigint", ("nation",))

    def half(k: int) -> str:
        mine = T.table(spark, sf, "customer").where(F.col("c_custkey") % 2 == k).groupBy(F.col("c_nationkey").cast("long").alias("nation"))
        mine = mine.agg(F.count("*").alias("customers"), F.max("c_custkey").alias("last_key"))
        return book.update(lambda now: now.unionByName(mine).groupBy("nation").agg(F.sum("customers").alias("customers"), F.max("last_key").alias("last_key")))

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(half, range(2)))
    return book.read()
