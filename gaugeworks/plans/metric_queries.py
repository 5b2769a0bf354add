"""Queries over baselines, anomalies, events and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.functions import scores as S
from gaugeworks.operators import anomalies as A
from gaugeworks.operators import baselines as B
from gaugeworks.operators import events as V
from gaugeworks.operators import reports as R
from gaugeworks.sources import tables as T

DAY = B.DAY
QUERIES: dict = {}
SQL: dict[str, str] = {}

# observations and dimensions
OE = "oe AS MATERIALIZED (SELECT 'app.events.' || event_type AS fq_name, value, date_trunc('second', ts) AS tm, event_id AS seq FROM events)"
OS = "os AS MATERIALIZED (SELECT 'shop.shipments.s' || l_suppkey AS fq_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS value, date_trunc('second', l_shipdate) AS tm, 0::BIGINT AS seq FROM lineitem GROUP BY l_suppkey, l_shipdate)"
OO = "oo AS MATERIALIZED (SELECT 'shop.orders.' || lower(o_orderpriority) AS fq_name, round(sum(o_totalprice), 2) AS value, date_trunc('second', o_orderdate) AS tm, 0::BIGINT AS seq FROM orders GROUP BY o_orderpriority, o_orderdate)"
MARKS = "mk AS MATERIALIZED (SELECT CASE event_type WHEN 'signup' THEN 'release' ELSE 'commit' END AS kind, CASE event_type WHEN 'signup' THEN '' ELSE md5(event_id::VARCHAR) END AS metric_fq, CASE event_type WHEN 'signup' THEN 'release ' || event_id END AS description, date_trunc('second', ts) AS tm, event_id AS seq FROM events WHERE value >= 150 AND event_type IN ('signup', 'error'))"
STAMP = "'%Y-%m-%d %H:%M:%S'"


def dim(obs: str) -> str:
    last = "regexp_extract(fq_name, '[^.]*$')"
    number = "TRY_CAST(regexp_extract(fq_name, '([0-9]+)$', 1) AS BIGINT)"
    return f"""dim AS MATERIALIZED (SELECT DISTINCT fq_name, CASE WHEN fq_name LIKE 'shop.%' OR {last} = 'purchase' THEN 'USD' ELSE '' END AS unit,
  CASE WHEN fq_name = 'app.events.error' THEN 'lower_is_better' WHEN fq_name = 'app.events.view' THEN 'neutral' WHEN fq_name LIKE 'app.%' THEN 'higher_is_better'
  WHEN {number} % 3 = 0 THEN 'higher_is_better' WHEN {number} % 3 = 1 THEN 'lower_is_better' ELSE 'neutral' END AS direction,
  CASE WHEN fq_name LIKE 'shop.%' THEN 'sum' ELSE 'avg' END AS aggregation FROM {obs})"""


def replay_sql(obs: str) -> str:
    parts = []
    for d in B.DAYS:
        w = f"OVER (PARTITION BY fq_name ORDER BY tm RANGE BETWEEN INTERVAL {d} DAYS PRECEDING AND CURRENT ROW)"
        parts.append(f"SELECT fq_name, tm, seq, value, {d} AS window_days, avg(value) {w} AS mean, stddev_pop(value) {w} AS sd, count(value) {w} AS n FROM {obs}")
    return " UNION ALL ".join(parts)


LABEL = "CASE WHEN {d} NOT IN ('higher_is_better', 'lower_is_better') THEN 'neutral' WHEN ({d} = 'higher_is_better' AND {v} > 0) OR ({d} = 'lower_is_better' AND {v} < 0) THEN 'surprise-good' ELSE 'surprise-bad' END"


def anomalies_sql(obs: str) -> str:
    return f"""rp AS ({replay_sql(obs)}),
fl AS (SELECT rp.*, (value - mean) / sd AS dev, direction AS wanted FROM rp JOIN dim USING (fq_name) WHERE n >= 14 AND sd <> 0 AND abs((value - mean) / sd) >= 2.5),
an AS MATERIALIZED (SELECT fq_name AS metric_fq, value AS observed_value, mean AS baseline_mean, dev, {LABEL.format(d='wanted', v='dev')} AS direction, window_days, tm FROM (SELECT *, row_number() OVER (PARTITION BY fq_name, window_days, tm ORDER BY seq) AS rn FROM fl) WHERE rn = 1)"""


def baselines_sql(obs: str, as_of: str, name: str = "bl", cap: int | None = None) -> str:
    parts = []
    for d in B.DAYS:
        rows = f"SELECT * FROM {obs} WHERE tm >= TIMESTAMP '{as_of}' - INTERVAL {d} DAYS AND tm <= TIMESTAMP '{as_of}'"
        if cap:
            rows += f" QUALIFY row_number() OVER (PARTITION BY fq_name ORDER BY tm, seq) <= {cap}"
        parts.append(f"SELECT fq_name, {d} AS window_days, avg(value) AS mean, stddev_pop(value) AS stddev, min(value) AS min, max(value) AS max, count(*) AS sample_count FROM ({rows}) GROUP BY fq_name")
    return f"{name} AS MATERIALIZED ({' UNION ALL '.join(parts)})"


def best_sql(need: int, source: str = "bl", name: str = "bb") -> str:
    return f"{name} AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY fq_name ORDER BY CASE WHEN window_days >= {need} THEN window_days ELSE 1000000 - window_days END) = 1)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(x) -> Column:
    """Six places; a small shift keeps means of short decimals off the ties, where two engines may differ."""
    return F.round((F.col(x) if isinstance(x, str) else x) + 1.3e-7, 6)


def r6(*names: str) -> dict[str, Column]:
    return {n: rounded(n) for n in names}


def _replayed(spark, sf, source, start: str | None = None, end: str | None = None) -> DataFrame:
    obs = source(spark, sf)
    names = T.metric_dim(obs)
    return A.replayed(obs, names, A.thresholds(names), start=start, end=end, short=source in T.DAILY)


def _timeline(spark, sf) -> DataFrame:
    marks = V.insert_or_ignore(V.marks_as_events(T.marks(spark, sf)))
    return _replayed(spark, sf, T.obs_events).select(*V.COLUMNS).unionByName(marks.select(*V.COLUMNS))


_EVENTS_SQL = f"{OE}, {MARKS}, {dim('oe')}, {anomalies_sql('oe')}, md AS (SELECT * FROM mk QUALIFY row_number() OVER (PARTITION BY kind, metric_fq, tm ORDER BY seq) = 1), ev AS MATERIALIZED (SELECT 'anomaly' AS kind, metric_fq, observed_value, baseline_mean, dev, direction, window_days, NULL::VARCHAR AS description, tm FROM an UNION ALL SELECT kind, metric_fq, NULL, NULL, NULL, 'none', 0, description, tm FROM md)"


def _anomaly_rows(df: DataFrame) -> DataFrame:
    return df.select("metric_fq", T.text_time(F.col("at")).alias("at_time"), rounded("observed_value").alias("observed_value"), rounded("baseline_mean").alias("baseline_mean"), rounded("stddev_from_mean").alias("stddev_from_mean"), "direction", "window_days")


_ANOMALY_SELECT = f"SELECT metric_fq, strftime(tm, {STAMP}) AS at_time, round(observed_value + 1.3e-7, 6) AS observed_value, round(baseline_mean + 1.3e-7, 6) AS baseline_mean, round(dev + 1.3e-7, 6) AS stddev_from_mean, direction, window_days FROM an"


@query("anomaly_replay", f"WITH {OE}, {dim('oe')}, {anomalies_sql('oe')} {_ANOMALY_SELECT}")
def anomaly_replay(spark, sf):
    return _anomaly_rows(_replayed(spark, sf, T.obs_events))


@query("anomaly_replay_shipments", f"WITH {OS}, {dim('os')}, {anomalies_sql('os')} {_ANOMALY_SELECT}")
def anomaly_replay_shipments(spark, sf):
    return _anomaly_rows(_replayed(spark, sf, T.obs_shipments))


_BASE = ("mean", "stddev", "min", "max")


def _base_rows(df: DataFrame) -> DataFrame:
    return df.select("fq_name", "window_days", *[rounded(c).alias(c) for c in _BASE], "sample_count")


_BASE_SELECT = "SELECT fq_name, window_days, round(mean + 1.3e-7, 6) AS mean, round(stddev + 1.3e-7, 6) AS stddev, round(min + 1.3e-7, 6) AS min, round(max + 1.3e-7, 6) AS max, sample_count FROM bl"


@query("baselines_asof", f"WITH {OS}, {baselines_sql('os', T.SHIPMENTS_AS_OF)} {_BASE_SELECT}")
def baselines_asof(spark, sf):
    return _base_rows(B.compute(T.obs_shipments(spark, sf), T.SHIPMENTS_AS_OF))


@query("baselines_orders", f"WITH {OO}, {baselines_sql('oo', T.ORDERS_AS_OF)} {_BASE_SELECT}")
def baselines_orders(spark, sf):
    return _base_rows(B.compute(T.obs_orders(spark, sf), T.ORDERS_AS_OF))


@query("baselines_capped", f"WITH {OE}, {baselines_sql('oe', T.EVENTS_AS_OF, cap=1000)} {_BASE_SELECT}")
def baselines_capped(spark, sf):
    return _base_rows(B.compute(T.obs_events(spark, sf), T.EVENTS_AS_OF, cap=1000))


_EARLIER, _RECENT = B.shifted(T.SHIPMENTS_AS_OF, -30 * DAY), B.shifted(T.SHIPMENTS_AS_OF, -2 * DAY)


@query("baselines_recent_only", f"""WITH {OS}, {baselines_sql('os', _EARLIER, 'old')}, live AS (SELECT os.* FROM os WHERE fq_name IN (SELECT fq_name FROM os WHERE tm >= TIMESTAMP '{_RECENT}')), {baselines_sql('live', T.SHIPMENTS_AS_OF, 'new')},
bl AS (SELECT *, '{T.SHIPMENTS_AS_OF}' AS computed_at FROM new UNION ALL SELECT *, '{_EARLIER}' FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.fq_name = old.fq_name AND new.window_days = old.window_days)) {_BASE_SELECT.replace(' FROM', ', computed_at FROM')}""")  # fmt: skip
def baselines_recent_only(spark, sf):
    obs = T.obs_shipments(spark, sf)
    out = B.recompute(obs, B.compute(obs, _EARLIER), T.SHIPMENTS_AS_OF, _RECENT)
    return out.select("fq_name", "window_days", *[rounded(c).alias(c) for c in _BASE], "sample_count", T.text_time(F.col("last_computed_at")).alias("computed_at"))


@query("anomalies_asof", f"""WITH {OE}, {dim('oe')}, {baselines_sql('oe', T.EVENTS_AS_OF, cap=B.SAMPLE_CAP)}, la AS (SELECT * FROM oe QUALIFY row_number() OVER (PARTITION BY fq_name ORDER BY tm DESC, seq DESC) = 1),
x AS (SELECT fq_name, value, mean, (value - mean) / stddev AS dev, direction AS wanted, window_days, tm FROM la JOIN bl USING (fq_name) JOIN dim USING (fq_name) WHERE sample_count >= 14 AND stddev <> 0),
an AS (SELECT fq_name AS metric_fq, value AS observed_value, mean AS baseline_mean, dev, {LABEL.format(d='wanted', v='dev')} AS direction, window_days, tm FROM x WHERE abs(dev) >= 0.1) {_ANOMALY_SELECT}""")  # fmt: skip
def anomalies_asof(spark, sf):
    obs = T.obs_events(spark, sf)
    names = T.metric_dim(obs)
    return _anomaly_rows(A.detect(A.latest(obs), B.compute(obs, T.EVENTS_AS_OF), names, A.thresholds(names, k=0.1)))


@query("anomaly_thresholds", """SELECT 'shop.shipments.s' || l_suppkey AS fq_name, CASE WHEN s_suppkey % 5 = 0 AND s_acctbal > 0 THEN round(s_acctbal / 1000 + 1.3e-7, 6) ELSE 2.0 END::DOUBLE AS k, CASE WHEN s_suppkey % 5 = 0 AND s_nationkey > 0 THEN s_nationkey ELSE 14 END::INT AS min_samples
FROM (SELECT DISTINCT l_suppkey FROM lineitem) LEFT JOIN supplier ON s_suppkey = l_suppkey""")  # fmt: skip
def anomaly_thresholds(spark, sf):
    overrides = T.table(spark, sf, "supplier").where("s_suppkey % 5 = 0").select(F.concat(F.lit("shop.shipments.s"), F.col("s_suppkey").cast("string")).alias("fq_name"), rounded(F.col("s_acctbal") / 1000).alias("anomaly_k"), F.col("s_nationkey").cast("int").alias("min_samples"))
    return A.thresholds(T.metric_dim(T.obs_shipments(spark, sf)), overrides, k=2.0, min_samples=-1)


@query("best_baseline", f"WITH {OS}, {baselines_sql('os', T.SHIPMENTS_AS_OF)}, {best_sql(10)} SELECT fq_name, window_days, round(mean + 1.3e-7, 6) AS mean, sample_count FROM bb")
def best_baseline(spark, sf):
    return B.best(B.compute(T.obs_shipments(spark, sf), T.SHIPMENTS_AS_OF), 10).select("fq_name", "window_days", rounded("mean").alias("mean"), "sample_count")


def periods_sql(obs: str, periods: dict[str, tuple[str, str]], name: str = "ps") -> str:
    parts = []
    for p, (a, b) in periods.items():
        inside = f"tm >= TIMESTAMP '{a}' AND tm < TIMESTAMP '{b}'"
        parts.append(f"coalesce(avg(value) FILTER ({inside}), 0.0) AS {p}_mean, count(*) FILTER ({inside}) AS {p}_n")
    return f"{name} AS MATERIALIZED (SELECT fq_name, {', '.join(parts)} FROM {obs} GROUP BY fq_name)"


def _explain_periods(as_of: str, since: int) -> dict:
    start = B.shifted(as_of, -since)
    return {"window": (start, B.shifted(as_of, 1)), "prior": (B.shifted(as_of, -2 * since), start)}


_P30 = _explain_periods(T.SHIPMENTS_AS_OF, 30 * DAY)


@query("period_means", f"WITH {OS}, {periods_sql('os', _P30)} SELECT fq_name, round(window_mean + 1.3e-7, 6) AS window_mean, window_n, round(prior_mean + 1.3e-7, 6) AS prior_mean, prior_n FROM ps")
def period_means(spark, sf):
    return B.period_stats(T.obs_shipments(spark, sf), _P30).withColumns(r6("window_mean", "prior_mean"))


@query("prior_change", f"WITH {OS}, {periods_sql('os', _P30)} SELECT fq_name, round(CASE WHEN prior_mean <> 0 THEN (window_mean - prior_mean) / abs(prior_mean) * 100 ELSE 0.0 END + 1.3e-7, 6) AS pct_change FROM ps")
def prior_change(spark, sf):
    return B.period_stats(T.obs_shipments(spark, sf), _P30).select("fq_name", rounded(B.pct_change(F.col("window_mean"), F.col("prior_mean"))).alias("pct_change"))


_WEEK = 7 * DAY


def _explained_sql(obs: str, as_of: str, since: int, events: bool) -> str:
    start = B.shifted(as_of, -since)
    own = f"(SELECT metric_fq AS fq_name, count(*) AS n_anomalies, arg_max(direction, (tm, -window_days)) AS newest_label, max(tm) AS newest_at FROM an WHERE tm >= TIMESTAMP '{start}' AND tm <= TIMESTAMP '{as_of}' GROUP BY metric_fq)"
    shared = f"(SELECT count(*) AS n_correlated FROM ev WHERE kind <> 'anomaly' AND tm >= TIMESTAMP '{start}' AND tm <= TIMESTAMP '{as_of}')" if events else "(SELECT 0::BIGINT AS n_correlated)"
    return f"""{baselines_sql(obs, as_of, cap=B.SAMPLE_CAP)}, {best_sql(B.need_days(since))}, {periods_sql(obs, _explain_periods(as_of, since))},
la AS (SELECT fq_name, value AS current_value, tm AS current_at FROM {obs} WHERE tm <= TIMESTAMP '{as_of}' QUALIFY row_number() OVER (PARTITION BY fq_name ORDER BY tm DESC, seq DESC) = 1),
ex AS MATERIALIZED (SELECT dim.fq_name, direction, unit, current_value, current_at, coalesce(window_mean, 0.0) AS window_mean, coalesce(window_n, 0) AS window_n, CASE WHEN prior_n > 0 THEN prior_mean END AS prior_mean, coalesce(prior_n, 0) AS prior_n,
  window_days, mean, stddev, sample_count, coalesce(n_anomalies, 0) AS n_anomalies, newest_at, newest_label, n_correlated, CASE WHEN stddev > 0 THEN (current_value - mean) / stddev END AS dev, coalesce(least(1.0, sample_count / 90.0), 0.0)::DOUBLE AS confidence
  FROM dim LEFT JOIN la USING (fq_name) LEFT JOIN ps USING (fq_name) LEFT JOIN bb USING (fq_name) LEFT JOIN {own} o USING (fq_name), {shared} s),
sc AS MATERIALIZED (SELECT *, coalesce(CASE direction WHEN 'higher_is_better' THEN -dev WHEN 'lower_is_better' THEN dev ELSE abs(dev) END, 0.0) AS score FROM ex)"""


_EXPLAIN_EVENTS = f"WITH {_EVENTS_SQL}, {_explained_sql('oe', T.EVENTS_AS_OF, _WEEK, True)}"
_EXPLAIN_SHIPMENTS = f"WITH {OS}, {dim('os')}, {anomalies_sql('os')}, {_explained_sql('os', T.SHIPMENTS_AS_OF, 30 * DAY, False)}"


def _explained_events(spark, sf) -> DataFrame:
    obs = T.obs_events(spark, sf)
    return R.explain(obs, T.metric_dim(obs), B.compute(obs, T.EVENTS_AS_OF), _timeline(spark, sf), T.EVENTS_AS_OF, _WEEK)


def _explained_shipments(spark, sf) -> DataFrame:
    obs = T.obs_shipments(spark, sf)
    events = _replayed(spark, sf, T.obs_shipments, B.shifted(T.SHIPMENTS_AS_OF, -30 * DAY), T.SHIPMENTS_AS_OF)
    return R.explain(obs, T.metric_dim(obs), B.compute(obs, T.SHIPMENTS_AS_OF), events, T.SHIPMENTS_AS_OF, 30 * DAY)


_EX_SELECT = f"SELECT fq_name, direction, unit, round(current_value + 1.3e-7, 6) AS current_value, strftime(current_at, {STAMP}) AS current_at, round(window_mean + 1.3e-7, 6) AS window_mean, window_n, round(prior_mean + 1.3e-7, 6) AS prior_mean, prior_n, window_days, round(mean + 1.3e-7, 6) AS mean, round(stddev + 1.3e-7, 6) AS stddev, sample_count, n_anomalies, n_correlated, round(dev + 1.3e-7, 6) AS dev, round(confidence + 1.3e-7, 6) AS confidence, round(score + 1.3e-7, 6) AS score FROM sc"


def _explain_rows(df: DataFrame) -> DataFrame:
    df = df.withColumns(r6("current_value", "window_mean", "prior_mean", "mean", "stddev", "dev", "confidence", "score")).withColumn("current_at", T.text_time(F.col("current_at")))
    return df.select("fq_name", "direction", "unit", "current_value", "current_at", "window_mean", "window_n", "prior_mean", "prior_n", "window_days", "mean", "stddev", "sample_count", "n_anomalies", "n_correlated", "dev", "confidence", "score")


@query("explain_all", f"{_EXPLAIN_EVENTS} {_EX_SELECT}")
def explain_all(spark, sf):
    return _explain_rows(_explained_events(spark, sf))


@query("explain_shipments", f"{_EXPLAIN_SHIPMENTS} {_EX_SELECT}")
def explain_shipments(spark, sf):
    return _explain_rows(_explained_shipments(spark, sf))


_CHOSEN = ("app.events.error", "app.events.purchase")
_LIST_COLUMNS = f"kind, metric_fq, strftime(tm, {STAMP}) AS at_time, window_days, direction, description"


@query("explain_events", f"WITH {_EVENTS_SQL}, w AS (SELECT * FROM ev WHERE tm >= TIMESTAMP '{B.shifted(T.EVENTS_AS_OF, -_WEEK)}' AND tm <= TIMESTAMP '{T.EVENTS_AS_OF}') " + " UNION ALL ".join(f"SELECT '{m}' AS fq_name, {_LIST_COLUMNS} FROM w WHERE kind <> 'anomaly' OR metric_fq = '{m}'" for m in _CHOSEN))
def explain_events(spark, sf):
    """What two reports list below their figures: the metric's anomalies and all other events of the week."""
    out = R.event_lists(list(_CHOSEN), _timeline(spark, sf), B.shifted(T.EVENTS_AS_OF, -_WEEK), T.EVENTS_AS_OF)
    return out.select("fq_name", "kind", "metric_fq", T.text_time(F.col("at")).alias("at_time"), "window_days", "direction", "description")


_TREND = """CASE WHEN round(dev, 9) > 1 THEN CASE direction WHEN 'higher_is_better' THEN 'above baseline (positive)' WHEN 'lower_is_better' THEN 'above baseline (watch)' ELSE 'above baseline' END
  WHEN round(dev, 9) < -1 THEN CASE direction WHEN 'lower_is_better' THEN 'below baseline (positive)' WHEN 'higher_is_better' THEN 'below baseline (watch)' ELSE 'below baseline' END
  WHEN dev IS NULL AND window_n > 0 AND window_mean > mean THEN 'above baseline' WHEN dev IS NULL AND window_n > 0 AND window_mean < mean THEN 'below baseline' ELSE 'near baseline' END"""
_SUMMARY = f"""regexp_extract(fq_name, '[^.]*$') || ' is ' || {_TREND} || CASE WHEN n_anomalies = 1 THEN ', with one ' || newest_label || ' spike on ' || strftime(newest_at, '%Y-%m-%d') WHEN n_anomalies > 1 THEN ', with ' || n_anomalies || ' anomalies including a ' || newest_label || ' spike on ' || strftime(newest_at, '%Y-%m-%d') ELSE '' END
  || CASE WHEN n_correlated > 0 THEN '; ' || n_correlated || ' correlated event(s) in window' ELSE '' END || ' (' || CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END || ' confidence: ' || coalesce(window_days || 'd baseline, n=' || sample_count, 'no baseline') || ').'"""


@query("summary_phrase", f"{_EXPLAIN_EVENTS} SELECT fq_name, {_SUMMARY} AS summary FROM sc")
def summary_phrase(spark, sf):
    return R.summary(_explained_events(spark, sf)).select("fq_name", "summary")


@query("summary_shipments", f"{_EXPLAIN_SHIPMENTS} SELECT fq_name, {_SUMMARY} AS summary FROM sc")
def summary_shipments(spark, sf):
    return R.summary(_explained_shipments(spark, sf)).select("fq_name", "summary")


_DIR_TEXT = "CASE direction WHEN 'higher_is_better' THEN 'higher is better' WHEN 'lower_is_better' THEN 'lower is better' ELSE 'neutral' END"


@query("narrative", f"""{_EXPLAIN_SHIPMENTS} SELECT fq_name, fq_name || ' -- last 30d' || chr(10) || chr(10) || CASE WHEN current_value IS NULL AND window_n = 0 THEN 'No observations recorded in this window.' || chr(10) ELSE
  coalesce('Current value: ' || printf('%.4g', current_value) || ' ' || unit || ' (as of ' || strftime(current_at, '%Y-%m-%d') || ').' || chr(10), '')
  || CASE WHEN mean IS NULL THEN '' WHEN dev IS NOT NULL THEN 'The ' || window_days || 'd baseline is ' || printf('%.4g', mean) || ' +/- ' || printf('%.4g', stddev) || ' ' || unit || ' (' || {_DIR_TEXT} || '); current is ' || printf('%+.1f', dev) || ' sigma from the mean.' || chr(10)
    ELSE 'The ' || window_days || 'd baseline mean is ' || printf('%.4g', mean) || ' ' || unit || ' (' || {_DIR_TEXT} || ').' || chr(10) END
  || CASE WHEN prior_mean IS NOT NULL AND window_n > 0 THEN 'Compared to the prior 30d (mean ' || printf('%.4g', prior_mean) || ', ' || prior_n || ' samples), this period is ' || printf('%+.1f', CASE WHEN prior_mean <> 0 THEN (window_mean - prior_mean) / abs(prior_mean) * 100 ELSE 0.0 END) || '%.' || chr(10) ELSE '' END END AS narrative FROM sc""")  # fmt: skip
def narrative(spark, sf):
    return R.narrative(_explained_shipments(spark, sf), "30d").select("fq_name", "narrative")


_PP = {"recent": (B.shifted(T.SHIPMENTS_AS_OF, -30 * DAY), B.shifted(T.SHIPMENTS_AS_OF, 1)), "prior": (B.shifted(T.SHIPMENTS_AS_OF, -90 * DAY), B.shifted(T.SHIPMENTS_AS_OF, -30 * DAY))}


@query("compare_periods", f"""WITH {OS}, {dim('os')}, {baselines_sql('os', T.SHIPMENTS_AS_OF)}, {best_sql(30)}, {periods_sql('os', _PP)},
x AS (SELECT dim.fq_name, direction, coalesce(recent_mean, 0.0) AS recent_mean, coalesce(recent_n, 0) AS recent_n, coalesce(prior_mean, 0.0) AS prior_mean, coalesce(prior_n, 0) AS prior_n, CASE WHEN prior_n > 0 AND prior_mean <> 0 THEN (recent_mean - prior_mean) / abs(prior_mean) * 100 ELSE 0.0 END AS pct, window_days, mean FROM dim LEFT JOIN ps USING (fq_name) LEFT JOIN bb USING (fq_name))
SELECT fq_name, round(recent_mean + 1.3e-7, 6) AS recent_mean, recent_n, round(prior_mean + 1.3e-7, 6) AS prior_mean, prior_n, round(pct + 1.3e-7, 6) AS pct_change, CASE WHEN prior_n = 0 THEN 'no prior data to compare' WHEN prior_mean = 0 THEN 'stable (prior mean zero)' WHEN (pct > 0 AND direction = 'higher_is_better') OR (pct < 0 AND direction = 'lower_is_better') THEN 'improved' WHEN pct = 0 THEN 'stable' ELSE 'regressed' END AS verdict, window_days, round(mean + 1.3e-7, 6) AS baseline_mean FROM x""")  # fmt: skip
def compare_periods(spark, sf):
    obs = T.obs_shipments(spark, sf)
    out = R.compare_periods(obs, T.metric_dim(obs), B.compute(obs, T.SHIPMENTS_AS_OF), T.SHIPMENTS_AS_OF, 30 * DAY, 60 * DAY)
    return out.withColumns(r6("recent_mean", "prior_mean", "pct_change", "baseline_mean")).select("fq_name", "recent_mean", "recent_n", "prior_mean", "prior_n", "pct_change", "verdict", "window_days", "baseline_mean")


_UP = "coalesce(CASE WHEN {p}.dev IS NOT NULL THEN ({p}.dev > 0 AND {p}.direction = 'higher_is_better') OR ({p}.dev < 0 AND {p}.direction = 'lower_is_better') WHEN {p}.prior_mean IS NOT NULL AND {p}.window_n > 0 THEN ({p}.window_mean > {p}.prior_mean AND {p}.direction = 'higher_is_better') OR ({p}.window_mean < {p}.prior_mean AND {p}.direction = 'lower_is_better') END, false)"


@query("compare_pairs", f"""{_EXPLAIN_SHIPMENTS}, pr AS (SELECT 'shop.shipments.s' || s_suppkey AS a, 'shop.shipments.s' || (s_suppkey + 1) AS b FROM supplier),
v AS (SELECT pr.a, pr.b, {_UP.format(p='x')} AS ua, {_UP.format(p='y')} AS ub, (x.confidence + y.confidence) / 2 AS confidence, regexp_extract(pr.a, '[^.]*$') AS sa, regexp_extract(pr.b, '[^.]*$') AS sb FROM pr JOIN sc x ON x.fq_name = pr.a JOIN sc y ON y.fq_name = pr.b)
SELECT a, b, CASE WHEN ua AND ub THEN 'both improved' WHEN NOT ua AND NOT ub THEN 'both regressed' WHEN ua THEN 'diverged: ' || sa || ' improved, ' || sb || ' regressed' ELSE 'diverged: ' || sa || ' regressed, ' || sb || ' improved' END AS verdict, ua <> ub AS diverged, round(confidence + 1.3e-7, 6) AS confidence FROM v""")  # fmt: skip
def compare_pairs(spark, sf):
    name = lambda k: F.concat(F.lit("shop.shipments.s"), k.cast("string"))
    pairs = T.table(spark, sf, "supplier").select(name(F.col("s_suppkey")).alias("a"), name(F.col("s_suppkey") + 1).alias("b"))
    return R.compare_pairs(pairs, _explained_shipments(spark, sf)).withColumns(r6("confidence"))


_MARK_COLUMNS = f"kind, metric_fq, description, strftime(tm, {STAMP}) AS at_time"


def _mark_rows(df: DataFrame) -> DataFrame:
    return df.select("kind", "metric_fq", "description", T.text_time(F.col("at")).alias("at_time"))


@query("shared_events", f"WITH {MARKS}, md AS (SELECT * FROM mk QUALIFY row_number() OVER (PARTITION BY kind, metric_fq, tm ORDER BY seq) = 1) SELECT {_MARK_COLUMNS} FROM md WHERE tm >= TIMESTAMP '2024-01-10' AND tm <= TIMESTAMP '2024-01-20'")
def shared_events(spark, sf):
    marks = V.insert_or_ignore(V.marks_as_events(T.marks(spark, sf)))
    return _mark_rows(R.shared_events(marks, ("2024-01-05 00:00:00", "2024-01-20 00:00:00"), ("2024-01-10 00:00:00", "2024-01-31 00:00:00")))


@query("event_dedup", f"WITH {MARKS} SELECT {_MARK_COLUMNS} FROM (SELECT * FROM mk QUALIFY row_number() OVER (PARTITION BY kind, metric_fq, tm ORDER BY seq) = 1)")
def event_dedup(spark, sf):
    marks = V.marks_as_events(T.marks(spark, sf))
    return _mark_rows(V.insert_or_ignore(marks.union(marks.withColumn("seq", F.col("seq") + 10_000_000_000))))


@query("commit_events", f"WITH {MARKS} SELECT {_MARK_COLUMNS} FROM (SELECT * FROM mk WHERE kind = 'commit' QUALIFY row_number() OVER (PARTITION BY kind, metric_fq, tm ORDER BY seq) = 1)")
def commit_events(spark, sf):
    return _mark_rows(V.insert_or_ignore(V.marks_as_events(T.marks(spark, sf).where("kind = 'commit'"))))


@query("timeline", f"""WITH {_EVENTS_SQL} SELECT kind, strftime(tm, {STAMP}) AS at_time, CASE WHEN kind = 'anomaly' THEN metric_fq || ': ' || printf('%.4g', observed_value) || ' (' || printf('%+.2f', dev) || 'σ, ' || window_days || 'd baseline) -- ' || direction ELSE coalesce(nullif(description, ''), metric_fq) END AS detail FROM ev""")
def timeline(spark, sf):
    return V.timeline(_timeline(spark, sf)).select("kind", T.text_time(F.col("at")).alias("at_time"), "detail")


@query("event_filters", f"WITH {_EVENTS_SQL} SELECT kind, metric_fq, window_days, strftime(tm, {STAMP}) AS at_time FROM ev WHERE tm >= TIMESTAMP '2024-01-20' AND tm <= TIMESTAMP '{T.EVENTS_AS_OF}' AND (metric_fq = 'app.events.purchase' OR kind <> 'anomaly')")
def event_filters(spark, sf):
    rows = V.in_window(_timeline(spark, sf), "2024-01-20 00:00:00", T.EVENTS_AS_OF)
    rows = rows.where(V.about(F.lit("app.events.purchase"), F.col("metric_fq"), F.col("kind")))
    return rows.select("kind", "metric_fq", "window_days", T.text_time(F.col("at")).alias("at_time"))


_START14 = B.shifted(T.EVENTS_AS_OF, -14 * DAY)
_CAUSES = f"""iw AS (SELECT * FROM ev WHERE tm >= TIMESTAMP '{_START14}' AND tm <= TIMESTAMP '{T.EVENTS_AS_OF}'),
ca AS MATERIALIZED (SELECT a.metric_fq AS target, o.kind, o.metric_fq, o.description, o.tm AS event_at, max(a.tm) AS anomaly_at FROM (SELECT DISTINCT metric_fq, tm FROM iw WHERE kind = 'anomaly') a JOIN (SELECT * FROM iw WHERE kind <> 'anomaly') o ON a.tm >= o.tm AND a.tm - o.tm <= INTERVAL 48 HOURS GROUP BY ALL)"""


@query("causal_candidates", f"WITH {_EVENTS_SQL}, {_CAUSES} SELECT target, kind, coalesce(nullif(description, ''), kind) AS label, strftime(event_at, {STAMP}) AS event_at, strftime(anomaly_at, {STAMP}) AS anomaly_at, round(epoch(anomaly_at - event_at) / 3600.0 + 1.3e-7, 6) AS proximity_hours, round(CASE WHEN anomaly_at <= event_at THEN 1.0 ELSE greatest(0.0, 1 - epoch(anomaly_at - event_at) / 3600.0 / 48.0) END + 1.3e-7, 6) AS confidence FROM ca")
def causal_candidates(spark, sf):
    out = V.causal_candidates(V.in_window(_timeline(spark, sf), _START14, T.EVENTS_AS_OF)).withColumns(r6("proximity_hours", "confidence"))
    return out.select("target", "kind", "label", T.text_time(F.col("event_at")).alias("event_at"), T.text_time(F.col("anomaly_at")).alias("anomaly_at"), "proximity_hours", "confidence")


@query("confidence", f"WITH {OE}, {dim('oe')}, {anomalies_sql('oe')} SELECT metric_fq, window_days, strftime(tm, {STAMP}) AS at_time, round(least(1.0, abs(dev) / 3.0) + 1.3e-7, 6) AS confidence, CASE WHEN abs(dev) / 3.0 >= 0.75 THEN 'high' WHEN abs(dev) / 3.0 >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM an")
def confidence(spark, sf):
    score = S.anomaly_confidence(F.col("stddev_from_mean"))
    return _replayed(spark, sf, T.obs_events).select("metric_fq", "window_days", T.text_time(F.col("at")).alias("at_time"), rounded(score).alias("confidence"), S.level(score).alias("level"))


_SINCE = B.shifted(T.SHIPMENTS_AS_OF, -30 * DAY)


@query("daily_means", f"WITH {OE} SELECT fq_name, strftime(tm, '%Y-%m-%d') AS day, round(avg(value) + 1.3e-7, 6) AS value FROM oe GROUP BY ALL")
def daily_means(spark, sf):
    return B.daily_means(T.obs_events(spark, sf)).select("fq_name", F.col("day").cast("string").alias("day"), rounded("value").alias("value"))


_SIBLINGS = f"""dm AS (SELECT fq_name, tm::DATE AS day, avg(value) AS v FROM os WHERE tm >= TIMESTAMP '{_SINCE}' AND tm < TIMESTAMP '{B.shifted(T.SHIPMENTS_AS_OF, 1)}' GROUP BY ALL),
su AS (SELECT x.fq_name AS metric, y.fq_name AS sibling, count(*) AS n, sum(x.v) AS sx, sum(y.v) AS sy, sum(x.v * x.v) AS xx, sum(y.v * y.v) AS yy, sum(x.v * y.v) AS xy FROM dm x JOIN dm y ON x.day = y.day AND x.fq_name <> y.fq_name GROUP BY ALL HAVING count(*) >= 2),
de AS (SELECT *, sqrt(greatest(xx - sx * sx / n, 0.0)) * sqrt(greatest(yy - sy * sy / n, 0.0)) AS den FROM su),
si AS MATERIALIZED (SELECT metric, sibling, n, CASE WHEN den = 0 THEN 0.0 ELSE (xy - sx * sy / n) / den END AS r FROM de)"""


@query("sibling_corr", f"WITH {OS}, {_SIBLINGS} SELECT metric, sibling, round(r, 5) AS r, n, round(CASE WHEN n < 5 THEN 0.0 ELSE abs(r) * least(1.0, n / 30.0) END, 5) AS confidence FROM si WHERE abs(r) >= 0.6")
def sibling_corr(spark, sf):
    return R.sibling_correlations(T.obs_shipments(spark, sf), T.SHIPMENTS_AS_OF, 30 * DAY, places=5)


@query("investigate", f"{_EXPLAIN_EVENTS}, {_CAUSES.replace(_START14, B.shifted(T.EVENTS_AS_OF, -_WEEK))}, cc AS (SELECT target AS fq_name, count(*) AS n_causes, round(min(epoch(anomaly_at - event_at) / 3600.0) + 1.3e-7, 6) AS nearest_hours FROM ca GROUP BY target) SELECT fq_name, round(dev + 1.3e-7, 6) AS dev, coalesce(n_causes, 0) AS n_causes, nearest_hours FROM sc LEFT JOIN cc USING (fq_name)")
def investigate(spark, sf):
    out = R.investigate(_explained_events(spark, sf), _timeline(spark, sf), T.obs_events(spark, sf), T.EVENTS_AS_OF, _WEEK)
    return out.select("fq_name", rounded("dev").alias("dev"), "n_causes", rounded("nearest_hours").alias("nearest_hours"))


@query("summarize_topk", f"{_EXPLAIN_SHIPMENTS} SELECT fq_name, 'shop' AS connector, round(score + 1.3e-7, 6) AS score, round(confidence + 1.3e-7, 6) AS confidence FROM sc ORDER BY score DESC, fq_name LIMIT 5")
def summarize_topk(spark, sf):
    return R.summarize(_explained_shipments(spark, sf), 5).select("fq_name", "connector", rounded("score").alias("score"), rounded("confidence").alias("confidence"))


@query("catalog_totals", f"WITH {OE}, {OS}, {OO}, u AS (SELECT fq_name FROM oe UNION SELECT fq_name FROM os UNION SELECT fq_name FROM oo) SELECT count(*) AS total_metrics, count(DISTINCT split_part(fq_name, '.', 1)) AS total_connectors FROM u")
def catalog_totals(spark, sf):
    return R.totals(T.metric_dim(T.obs_events(spark, sf).union(T.obs_shipments(spark, sf)).union(T.obs_orders(spark, sf))))


@query("metric_catalog", f"WITH {OE}, {OS}, u AS (SELECT fq_name FROM oe UNION ALL SELECT fq_name FROM os), {dim('u')} SELECT fq_name, unit, direction, aggregation FROM dim")
def metric_catalog(spark, sf):
    return T.metric_dim(T.obs_events(spark, sf).union(T.obs_shipments(spark, sf))).orderBy("fq_name")


@query("sparkline", f"""WITH {OE}, n AS (SELECT fq_name, value, row_number() OVER (PARTITION BY fq_name ORDER BY tm, seq) - 1 AS j, count(*) OVER (PARTITION BY fq_name) AS len FROM oe WHERE tm >= TIMESTAMP '{B.shifted(T.EVENTS_AS_OF, -30 * DAY)}' AND tm <= TIMESTAMP '{T.EVENTS_AS_OF}'),
b AS (SELECT fq_name, CASE WHEN len <= 40 THEN j ELSE ((j + 1) * 40 - 1) // len END AS bucket, avg(value) AS v FROM n GROUP BY ALL), m AS (SELECT *, min(v) OVER (PARTITION BY fq_name) AS lo, max(v) OVER (PARTITION BY fq_name) AS hi FROM b)
SELECT fq_name, string_agg(substr('{B.GLYPHS}', CASE WHEN hi > lo THEN least(greatest(floor((v - lo) / (hi - lo) * 7 + 0.5), 0), 7)::INT ELSE 0 END + 1, 1), '' ORDER BY bucket) AS sparkline FROM m GROUP BY fq_name""")  # fmt: skip
def sparkline(spark, sf):
    return B.sparkline(T.obs_events(spark, sf), T.EVENTS_AS_OF)
