"""Sources, enrichment, landing, protocol, catalog and streams on small inputs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions.hosts import url_host
from gaugeworks.functions.times import normalised
from gaugeworks.operators import catalog as C
from gaugeworks.operators import enrichment, landing
from gaugeworks.sources import normalise as N
from gaugeworks.sources import protocol as P
from gaugeworks.streaming import jobs

TEN = "2024-03-15T10:30:00Z"
NINE = "2024-03-15T09:30:00Z"


@pytest.mark.parametrize(("raw", "want"), [
    ("2024-03-15T10:30:00Z", TEN), ("2024-03-15T10:30:00", TEN), ("2024-03-15 10:30:00", TEN), ("2024-03-15T12:30:00+02:00", TEN),
    ("2024-03-15T10:30:00.123Z", "2024-03-15T10:30:00.123Z"), ("2024-03-15T10:30:00.123456789Z", "2024-03-15T10:30:00.123456789Z"), ("2024-03-15T12:30:00.456+02:00", "2024-03-15T10:30:00.456Z"),
    ("2024-03-15", "2024-03-15T00:00:00Z"), ("1710495000", NINE), ("1710495000000", NINE), ("1710495000.0", NINE), ("1710495000.123", "2024-03-15T09:30:00.123Z"),
    ("not-a-date", None), ("true", None), ("2024", "1970-01-01T00:33:44Z"), ("2024-3-5", None), ("2024-13-40", None), ("", None), (None, None),
])
def test_timestamps(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "r string").select(normalised(F.col("r"))).first()[0] == want


@pytest.mark.parametrize(("url", "want"), [
    ("https://example.com/path?q=1", "example.com"), ("http://sub.domain.org/a/b", "sub.domain.org"), ("https://EXAMPLE.COM/b", "example.com"), ("not-a-url", None), (None, None), ("", None),
    ("http://h:8080/", "h"), ("http://u:p@h/", "h"), ("http://[::1]:80/x", "::1"), ("http://a_b.com", "a_b.com"), ("http://münchen.de/", "münchen.de"), ("//host/path", "host"), ("http://h:x/", None), ("http://a b/", None), ("http://h/%zz", None),
])
def test_hosts(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(url_host(F.col("u"))).first()[0] == want


def test_chain_and_registry(spark):
    df = spark.createDataFrame([("https://a.org/x", "1710495000")], "url string, timestamp string")
    assert tuple(enrichment.chain(df, [("url_host", {}), ("ts_normalize", {"out_field": "t"})]).first())[2:] == ("a.org", NINE)
    with pytest.raises(ValueError, match="twice"):
        enrichment.register("url_host", lambda d: d)
    with pytest.raises(KeyError):
        enrichment.get("absent")
    with pytest.raises(TypeError):
        enrichment.register("x", None)


def at(s):
    return datetime.fromtimestamp(s)


def test_coverage_table(spark):
    ranges = [("pages", 100, 200), ("pages", 300, 400), ("events", 500, 600), ("no-time", None, None)]
    manifest = spark.createDataFrame([(s, at(a) if a else None, at(b) if b else None) for s, a, b in ranges], "stream string, start_time timestamp, end_time timestamp")
    cases = {("pages", 99): False, ("pages", 100): True, ("pages", 150): True, ("pages", 200): True, ("pages", 250): False, ("pages", 350): True, ("events", 150): False, ("pages", None): False, ("no-time", 1): False, ("other", 150): False}
    rows = spark.createDataFrame([(s, at(t) if t else None) for s, t in cases], "stream string, timestamp timestamp")
    for limit in (landing.BROADCAST_RANGES, 0):
        landing.BROADCAST_RANGES = limit
        kept = {(r.stream, int(r.timestamp.timestamp()) if r.timestamp else None) for r in landing.prune_covered(rows, manifest).collect()}
        assert kept == {k for k, covered in cases.items() if not covered}
    landing.BROADCAST_RANGES = 100_000
    assert landing.prune_covered(rows, manifest, resume=False).count() == len(cases)


RECORDS = "stream string, timestamp timestamp, data_json string"


def records(spark):
    return spark.createDataFrame([("a", at(1_700_000_000), '{"n":1,"x":2.5,"ok":true,"s":"t"}'), ("a", at(1_700_000_060), '{"n":2.9,"x":3,"s":null}'), ("b", at(1_700_000_120), None)], RECORDS)


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_landing_and_a_second_run_writes_nothing(spark, tmp_path, kind):
    root = str(tmp_path)
    manifest = landing.land(records(spark), root, "r1", kind, "app")
    assert sorted((r.stream, r.rows, r.start_time) for r in manifest.collect()) == [("a", 2, at(1_700_000_000)), ("b", 1, at(1_700_000_120))] or manifest.groupBy("stream").agg(F.sum("rows")).count() == 2
    assert landing.prune_covered(records(spark), manifest).count() == 0
    assert landing.read_landed(spark, root, "r1", kind).where("stream = 'b'").first().data_json == "{}"


def test_typed_columns(spark):
    columns = {"n": "int", "x": "float", "ok": "bool", "s": "string", "gone": "int"}
    got = landing.typed_columns(landing.envelope(records(spark)), columns).orderBy("timestamp").collect()
    assert [tuple(r)[2:7] for r in got] == [(1, 2.5, True, "t", None), (2, 3.0, None, None, None), (None, None, None, None, None)]
    bad = landing.typed_columns(landing.envelope(records(spark)), {"s": "int"}, strict=False).where("timestamp = 1700000000000000").first()
    assert bad["_rejected"] == ["s"] and bad["s"] is None
    with pytest.raises(Exception, match="field s is not int"):
        landing.typed_columns(landing.envelope(records(spark)), {"s": "int"}).collect()


def test_flat_landing_replaces_a_stream(spark, tmp_path):
    root = str(tmp_path)
    landing.land_flat(records(spark), root)
    out = landing.land_flat(records(spark).where("stream = 'a'").limit(1), root)
    assert {r.stream: r["count"] for r in out.groupBy("stream").count().collect()} == {"a": 1, "b": 1}


def test_manifest_rows_fall_back_to_all(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "", 2), ("b", "", 4)], "stream string, connector string, rows long")
    assert [tuple(r) for r in landing.rows_by_stream(rows, "x").collect()] == [("a", 1)]
    assert sorted(map(tuple, landing.rows_by_stream(rows.where("connector = ''"), "x").collect())) == [("a", 2), ("b", 4)]


def test_synthetic_and_catalog(spark):
    rows = N.read_source(spark, "synthetic", streams=["p", "q"], n=3).orderBy("stream", "timestamp").collect()
    assert len(rows) == 6 and rows[1].timestamp == at(1_700_000_060) and '"id":"p-1"' in rows[1].data_json
    assert N.semantic_catalog(spark, "web.daily").count() == 5
    assert '"visitors"' in landing.semantics_sidecar(N.semantic_catalog(spark)).first()[0]


def test_cursor_is_strict(spark):
    rows = records(spark)
    cursors = spark.createDataFrame([("a", at(1_700_000_000))], "stream string, cursor timestamp")
    assert sorted(r.stream for r in N.after_cursor(rows, cursors, "1970-01-01 00:00:00").collect()) == ["a", "b"]
    assert {r.stream: r.cursor for r in N.advanced(rows, cursors).collect()} == {"a": at(1_700_000_060), "b": at(1_700_000_120)}


def test_commits_until_known(spark):
    log = spark.createDataFrame([(0, "h3\ta\t2024-03-15T10:30:00Z\tone\ttwo"), (1, "bad"), (2, "h2\ta\t?\tx"), (3, "h1\ta\t2024-03-14T00:00:00+00:00\tx"), (4, "h0\ta\t2024-03-13T00:00:00Z\tx")], "seq long, line string")
    assert [r.hash for r in N.commits(log, "h1").orderBy("seq").collect()] == ["h3"]
    assert N.commits(log, "absent").count() == 3 and N.commits(log).first().subject == "one\ttwo"


def test_search_rows_need_all_keys(spark):
    page = spark.createDataFrame([('{"rows":[{"keys":["2024-01-02","q"],"clicks":2},{"keys":["2024-01-02"],"clicks":1},{"keys":["?","q"]}]}',)], "payload string")
    assert [r.timestamp for r in N.search_rows(page, "rows", ["date", "query"], "2024-01-31").collect()] == [datetime(2024, 1, 2)]
    assert N.search_rows(page, "rows", ["query"], "2024-01-31").first().timestamp == datetime(2024, 1, 31)


LINES = [
    '{"type":"RECORD","stream":"s","timestamp":"2024-03-15T10:30:00Z","data":{"a":1},"more":1}', "", '{"type":"STATE","state":{"c":1}}', '{"type":"RECORD","stream":"s","timestamp":1710495000.5,"data":{}}',
    '{"type":"RECORD","stream":"z","timestamp":1,"data":{}}', '{"type":"RECORD","stream":"s","data":{}}', '{"type":"RECORD","stream":"s","timestamp":null,"data":{}}', '{"type":"RECORD","stream":"s","timestamp":"x","data":{}}',
    '{"type":"RECORD","stream":"s","timestamp":1}', "{nope", '{"x":1}', '{"type":"ERROR","error":"end"}', '{"type":"RECORD","stream":"s","timestamp":1,"data":{}}',
]


def test_protocol(spark):
    log = spark.createDataFrame([("r", i, x) for i, x in enumerate(LINES)], "run_id string, seq long, line string")
    rows = P.messages(log)
    assert rows.where("problem IS NOT NULL").count() == 2
    judged = P.judged_records(rows, ["s"])
    assert {r.reason: r.n for r in P.rejects(judged).collect()} == {"stream not configured": 1, "timestamp missing": 2, "timestamp unreadable": 1, "data missing": 1}
    assert [r.timestamp for r in judged.where("reason IS NULL").orderBy("seq").collect()][:2] == [datetime(2024, 3, 15, 10, 30), datetime(2024, 3, 15, 9, 30, 0, 500000)]
    assert [r.seq for r in P.committed(rows).where("committed").collect()] == [0]
    assert [r.seq for r in P.written(rows).orderBy("seq").collect()] == [0]
    assert [r.seq for r in P.written(rows, batch=2).orderBy("seq").collect()][:3] == [0, 3, 5]
    assert P.last_state(rows).first().state == '{"c":1}'


def test_catalog_upserts(spark):
    schema = "connector string, stream string, kind string, first_seen_at timestamp, last_seen_at timestamp, row_count_lifetime long"
    one = spark.createDataFrame([("c", "s", "event", at(1), at(1), 5)], schema)
    two = spark.createDataFrame([("c", "s", "metric", at(9), at(9), 7)], schema)
    assert tuple(C.upsert_streams(one, two).first()) == ("c", "s", "metric", at(1), at(9), 12)
    schema = "fq_name string, unit string, direction string, aggregation string, last_value double, last_value_at timestamp"
    old = spark.createDataFrame([("m", "a", "neutral", "none", 1.0, at(1)), ("k", "a", "neutral", "none", 2.0, at(1))], schema)
    new = spark.createDataFrame([("m", "b", "neutral", "sum", None, None), ("n", "b", "neutral", "sum", 3.0, at(2))], schema)
    assert sorted(map(tuple, C.upsert_metrics(old, new).collect())) == [("k", "a", "neutral", "none", 2.0, at(1)), ("m", "b", "neutral", "sum", 1.0, at(1)), ("n", "b", "neutral", "sum", 3.0, at(2))]


def test_only_json_numbers_are_values(spark):
    last = spark.createDataFrame([("s", at(1), '{"a":1,"b":"2","c":null,"d":2.5}')], "stream string, timestamp timestamp, data_json string")
    assert sorted((r.fq_name, r.value) for r in C.metric_values(last, "x", ["a", "b", "c", "d"]).collect()) == [("x.s.a", 1.0), ("x.s.d", 2.5)]


def test_health(spark):
    configured = spark.createDataFrame([("p", "a", "s"), ("p", "b", "s"), ("p", "c", "s")], "product string, connector string, stream string")
    state = spark.createDataFrame([("p/a", datetime(2024, 2, 29)), ("p/b", datetime(2024, 2, 28, 23, 59)), ("p/z", datetime(2024, 2, 28))], "key string, updated_at timestamp")
    got = C.health(configured, state, None, "2024-03-01 00:00:00").collect()
    assert [(r.connector, r.status, r.records) for r in got] == [("a", "ok", -1), ("b", "stale", -1), ("c", "never", -1)]
    assert [r.key for r in C.orphans(configured, state).collect()] == ["p/z"]


def test_state_and_schema(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, data string")
    saved = C.save_state(old, spark.createDataFrame([("a", "9")], "key string, data string"))
    assert sorted(map(tuple, saved.collect())) == [("a", "9"), ("b", "2")]
    assert C.delete_state(saved, old.where("key = 'a'")).count() == 1
    static = spark.createDataFrame([("s", "x")], "stream string, schema string")
    told = spark.createDataFrame([("s", "y", 1), ("t", "y", 1), ("t", "z", 2)], "stream string, schema string, seq long")
    assert sorted(map(tuple, C.effective_schema(static, told).collect())) == [("s", "x", "declared"), ("t", "z", "announced")]


def test_a_repeated_batch_lands_once(spark, tmp_path):
    batch = jobs.landing_batch(str(tmp_path), "q")
    batch(records(spark), 0)
    batch(records(spark), 0)
    assert landing.read_landed(spark, str(tmp_path)).count() == 3


def test_registry_is_whole(spark):
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 80
    assert entry.entry(spark).columns
