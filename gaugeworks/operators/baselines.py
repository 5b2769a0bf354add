"""Rolling baselines of all metrics at once, as of one moment or replayed for every observation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS = (7, 30, 90)
DAY = 86_400
#: A baseline uses the oldest so many samples of its window.
SAMPLE_CAP = 10_000
#: Salts of the first step of a capped metric's top-k.
SALTS = 32


def moment(text: str) -> Column:
    return F.to_timestamp(F.lit(text))


def epoch(c: Column) -> Column:
    return F.unix_timestamp(c)


def _within(days: int, as_of: str) -> Column:
    at = epoch(F.col("observed_at"))
    return (at >= epoch(moment(as_of)) - days * DAY) & (at <= epoch(moment(as_of)))


_FIELDS = ("mean", "stddev", "min", "max", "sample_count")


def compute(obs: DataFrame, as_of: str, days: tuple[int, ...] = DAYS, cap: int | None = SAMPLE_CAP) -> DataFrame:
    """Mean, population deviation, extremes and count of each metric and window; no row for an empty window.

    One scan makes all windows as conditional aggregates. Only metrics over the cap are read again: each
    salt keeps its own oldest ``cap`` rows, so that no task sorts a whole hot metric.
    """
    pick = lambda d: F.when(_within(d, as_of), F.col("value"))
    parts = [x for d in days for x in (F.avg(pick(d)).alias(f"mean_{d}"), F.stddev_pop(pick(d)).alias(f"stddev_{d}"), F.min(pick(d)).alias(f"min_{d}"), F.max(pick(d)).alias(f"max_{d}"), F.count(pick(d)).alias(f"sample_count_{d}"))]
    wide = obs.where(_within(max(days), as_of)).groupBy("fq_name").agg(*parts)
    windows = F.array(*[F.struct(F.lit(d).alias("window_days"), *[F.col(f"{f}_{d}").alias(f) for f in _FIELDS]) for d in days])
    long = wide.select("fq_name", F.explode(windows).alias("w")).select("fq_name", "w.*").where("sample_count > 0")
    if cap is not None:
        over = long.where(F.col("sample_count") > cap).select("fq_name", "window_days")
        rows = obs.join(over, "fq_name").where((epoch(F.col("observed_at")) >= epoch(moment(as_of)) - F.col("window_days") * DAY) & (epoch(F.col("observed_at")) <= epoch(moment(as_of))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("observed_at", "seq"), F.lit(SALTS)))
        for keys in (["fq_name", "window_days", "salt"], ["fq_name", "window_days"]):
            order = Window.partitionBy(*keys).orderBy("observed_at", "seq")
            rows = rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= cap)
        capped = rows.groupBy("fq_name", "window_days").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("stddev"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("sample_count"))
        long = long.where(F.col("sample_count") <= cap).unionByName(capped)
    return long.withColumn("last_computed_at", moment(as_of))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same metric and window; a window that came out empty keeps its old row."""
    return old.join(new.select("fq_name", "window_days"), ["fq_name", "window_days"], "left_anti").unionByName(new)


def recompute(obs: DataFrame, old: DataFrame, as_of: str, since: str | None = None, days: tuple[int, ...] = DAYS) -> DataFrame:
    """Recompute metrics that were observed since a moment (all of them without one); the rest stays as it was."""
    live = obs if since is None else obs.join(obs.where(F.col("observed_at") >= moment(since)).select("fq_name").distinct(), "fq_name", "left_semi")
    return upsert(old, compute(live, as_of, days))


_PART = ("n", "mean", "m2", "lo", "hi")


#: Of two disjoint parts ``a`` and ``b`` taken together count, mean, sum of squared deviations and extremes; only sums, so nothing cancels.
_BOTH = """named_struct('n', a.n + b.n, 'mean', a.mean + (b.mean - a.mean) * b.n / (a.n + b.n), 'm2', a.m2 + b.m2 + (b.mean - a.mean) * (b.mean - a.mean) * a.n * b.n / (a.n + b.n), 'lo', least(a.lo, b.lo), 'hi', greatest(a.hi, b.hi))"""
_MERGED = f"CASE WHEN coalesce(b.n, 0) = 0 THEN a WHEN a.n = 0 THEN b ELSE {_BOTH} END"
_NOTHING = "named_struct('n', 0L, 'mean', CAST(NULL AS DOUBLE), 'm2', CAST(NULL AS DOUBLE), 'lo', CAST(NULL AS DOUBLE), 'hi', CAST(NULL AS DOUBLE))"


def merged(parts: str, finish: str = "") -> Column:
    """An array of parts taken together; ``finish`` is a lambda over the result. As text, which the driver hands over in one call."""
    return F.expr(f"aggregate({parts}, {_NOTHING}, (a, b) -> {_MERGED}{finish and ', ' + finish})")


def _running(rows: DataFrame, name: str, w) -> DataFrame:
    """``rows`` with the part that each one's growing frame makes up, as column ``name``.

    Sums are taken around the frame's first mean, which lies among its own values, so that nothing outside the frame
    costs precision.
    """
    rows = rows.withColumn("centre", F.first("mean", ignorenulls=True).over(w)).withColumn("off", F.col("mean") - F.col("centre"))
    n, s1, s2 = (F.sum(x).over(w) for x in (F.col("n"), F.col("n") * F.col("off"), F.col("m2") + F.col("n") * F.col("off") * F.col("off")))
    part = F.struct(n.alias("n"), (F.col("centre") + s1 / n).alias("mean"), F.greatest(s2 - s1 * s1 / n, F.lit(0.0)).alias("m2"), F.min("lo").over(w).alias("lo"), F.max("hi").over(w).alias("hi"))
    return rows.withColumn(name, part).drop("centre", "off")


def replay(obs: DataFrame, days: tuple[int, ...] = DAYS, start: str | None = None, end: str | None = None, short: bool = False) -> DataFrame:
    """Every observation with the trailing baseline it had, itself and its second's peers included.

    A window of d days is put together from three disjoint parts: its own day up to the second, the whole days
    before, and the end of the day d days ago. Observations are first summed up by metric and second; the parts
    of a day come from running sums over it, forwards and backwards, and whole days from at most d rows. The work
    is linear in the observations, and a task holds seconds of one metric's day (86,400 at most) however dense it is.
    Null values count for nothing; a window without values has null mean and deviation. Of a part of the past
    (``start`` to ``end``, bounds included) only that and the longest window before it is read.

    ``short`` gives the same rows by plain range windows. It is for sources whose metrics have few observations a window, as with
    one value a day: each is then sent once, and no parts are made. The work is linear in the rows of all windows.
    """
    at = epoch(F.col("observed_at"))
    if start is not None:
        obs = obs.where(at >= epoch(moment(start)) - max(days) * DAY)
    if end is not None:
        obs = obs.where(at <= epoch(moment(end)))
    if short:
        return _short_windows(obs.withColumn("at_s", at), days, start)
    full = windows(second_parts(obs).withColumn("asks", F.lit(True)), day_parts(obs), days)
    rows = obs.withColumn("at_s", at)
    rows = rows if start is None else rows.where(F.col("at_s") >= epoch(moment(start)))
    return with_windows(rows, full)


def _short_windows(rows: DataFrame, days: tuple[int, ...], start: str | None) -> DataFrame:
    """Rows as of ``with_windows``, each window read over for each row."""
    ordered = Window.partitionBy("fq_name").orderBy("at_s")

    def stats(d: int) -> Column:
        w, value = ordered.rangeBetween(-d * DAY, Window.currentRow), F.col("value")
        return F.struct(F.lit(d).alias("window_days"), F.avg(value).over(w).alias("mean"), F.stddev_pop(value).over(w).alias("stddev"), F.count(value).over(w).alias("sample_count"))

    out = rows.select("fq_name", "observed_at", "seq", "value", "at_s", F.array(*map(stats, days)).alias("w"))
    out = out if start is None else out.where(F.col("at_s") >= epoch(moment(start)))
    return _by_window(out)


def _part_of(value: str = "value") -> list[Column]:
    n = F.count(value)
    return [n.alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * n).alias("m2"), F.min(value).alias("lo"), F.max(value).alias("hi")]


def second_parts(obs: DataFrame) -> DataFrame:
    """``fq_name, day, sod`` (second of the day) and the part that the metric's observations of that second make up."""
    at = epoch(F.col("observed_at"))
    second = obs.groupBy("fq_name", at.alias("at_s")).agg(*_part_of())
    day = F.floor(F.col("at_s") / DAY)
    return second.select("fq_name", day.alias("day"), (F.col("at_s") - day * DAY).alias("sod"), *_PART)


def day_parts(obs: DataFrame) -> DataFrame:
    return obs.groupBy("fq_name", F.floor(epoch(F.col("observed_at")) / DAY).alias("day")).agg(*_part_of())


def folded_parts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of the same keys taken together. Few parts share a key: one for each batch that had it."""
    both = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*_PART))).alias("parts")).select(*keys, merged("parts").alias("p"))
    return both.select(*keys, *[f"p.{c}" for c in _PART])


def windows(second: DataFrame, total: DataFrame, days: tuple[int, ...] = DAYS) -> DataFrame:
    """``fq_name, at_s`` and the trailing windows ``w`` of each second that ``asks`` for them.

    ``second`` has the parts of seconds on the days that are asked for and on those that their windows begin on;
    ``total`` the parts of whole days from the longest window's first on.
    """
    # a second stands in its day's forward and backward sums, and asks for the end of the days that its windows begin on
    place = lambda back, forward, asks: F.struct(F.lit(back).alias("back"), F.lit(forward).alias("forward"), F.lit(asks).alias("asks"), F.col("asks").alias("new"))
    stands = F.array(place(0, True, False), place(0, False, False))
    asking = F.array(*[place(d, False, True) for d in days])
    dealt = second.select("*", F.explode(F.when(F.col("asks"), F.concat(stands, asking)).otherwise(stands)).alias("q"))
    order = F.when(F.col("q.forward"), F.col("sod")).otherwise(-F.col("sod"))
    dealt = dealt.select("fq_name", (F.col("day") - F.col("q.back")).alias("day"), "sod", "q.*", order.alias("order"), *[F.when(~F.col("q.asks"), F.col(c)).alias(c) for c in _PART])
    edges = _running(dealt, "p", Window.partitionBy("fq_name", "day", "forward").orderBy("order").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    edges = edges.where("new AND (forward OR asks)").withColumn("day", F.col("day") + F.col("back"))
    picked = [F.max(F.when(F.col("back") == d, F.col("p")[c])).alias(f"{c}_{d}") for d in (0, *days) for c in _PART]
    edges = edges.groupBy("fq_name", "day", "sod").agg(*picked)
    # whole days: each window adds to the next shorter one those days that only it has
    by_day = Window.partitionBy("fq_name").orderBy("day")
    steps = list(zip((1, *sorted(days)), sorted(days), strict=False))
    whole = total.select("fq_name", "day", F.struct(*_PART).alias("p"))
    whole = whole.select("fq_name", "day", *[F.collect_list("p").over(by_day.rangeBetween(1 - d, -shorter)).alias(f"days_{d}") for shorter, d in steps])
    full = edges.join(whole.select("fq_name", "day", *[merged(f"days_{d}").alias(f"between_{d}") for d in days]), ["fq_name", "day"])

    def stats(d: int) -> Column:
        part = lambda x: f"named_struct({', '.join(f"'{c}', {c}_{x}" for c in _PART)})"
        row = f"x -> named_struct('window_days', {d}, 'mean', x.mean, 'stddev', CASE WHEN x.lo = x.hi THEN 0D ELSE sqrt(x.m2 / x.n) END, 'sample_count', x.n, 'min', x.lo, 'max', x.hi)"
        return merged(f"array({', '.join([*(f'between_{x}' for x in days if x <= d), part(0), part(d)])})", row)

    return full.select("fq_name", (F.col("day") * DAY + F.col("sod")).alias("at_s"), F.array(*map(stats, days)).alias("w"))


def with_windows(rows: DataFrame, full: DataFrame) -> DataFrame:
    """Observations with ``at_s``, each with a row for every window of its second."""
    return _by_window(rows.join(full, ["fq_name", "at_s"]))


def _by_window(rows: DataFrame) -> DataFrame:
    out = rows.select("fq_name", "observed_at", "seq", "value", F.explode("w").alias("w"))
    return out.select("fq_name", "observed_at", "seq", "value", *[f"w.{c}" for c in ("window_days", "mean", "stddev", "sample_count")])


def best(baselines: DataFrame, need_days: int) -> DataFrame:
    """For each metric the smallest window that covers ``need_days``, else the largest."""
    rank = F.when(F.col("window_days") >= need_days, F.col("window_days")).otherwise(1_000_000 - F.col("window_days"))
    others = [c for c in baselines.columns if c != "fq_name"]
    return baselines.groupBy("fq_name").agg(F.min(F.struct(rank.alias("rank"), *others)).alias("b")).select("fq_name", *[f"b.{c}" for c in others])


def need_days(since_s: int) -> int:
    return -(-since_s // DAY)


def period_stats(obs: DataFrame, periods: dict[str, tuple[str, str]]) -> DataFrame:
    """Mean (0 when empty) and count of each half-open period, in one pass; columns ``<period>_mean`` and ``<period>_n``."""
    parts = []
    for name, (start, end) in periods.items():
        inside = F.when((F.col("observed_at") >= moment(start)) & (F.col("observed_at") < moment(end)), F.col("value"))
        parts += [F.coalesce(F.avg(inside), F.lit(0.0)).alias(f"{name}_mean"), F.count(inside).alias(f"{name}_n")]
    return obs.groupBy("fq_name").agg(*parts)


def shifted(as_of: str, seconds: int) -> str:
    """``as_of`` moved by so many seconds, as text."""
    from datetime import datetime, timedelta

    return str(datetime.fromisoformat(as_of) + timedelta(seconds=seconds))


def pct_change(new: Column, old: Column) -> Column:
    """In percent of the old value's size; 0 when that is 0."""
    return F.when(old != 0, (new - old) / F.abs(old) * 100).otherwise(F.lit(0.0))


def daily_means(obs: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Mean by metric and UTC day over [start, end); a bound that is None is open."""
    inside = obs if start is None else obs.where(F.col("observed_at") >= moment(start))
    inside = inside if end is None else inside.where(F.col("observed_at") < moment(end))
    return inside.groupBy("fq_name", F.to_date("observed_at").alias("day")).agg(F.avg("value").alias("value"))


GLYPHS = "▁▂▃▄▅▆▇█"


def sparkline(obs: DataFrame, as_of: str, days: int = 30, width: int = 40) -> DataFrame:
    """Each metric's values over the last days as at most ``width`` block glyphs; longer series are averaged in equal buckets.

    A value's place comes from counts by day and a rank within the day, so a long series isn't ordered in one task.
    """
    width = width if width > 0 else 20
    rows = obs.where(_within(days, as_of)).withColumn("day", F.to_date("observed_at"))
    counts = rows.groupBy("fq_name", "day").agg(F.count("*").alias("c"))
    ordered = Window.partitionBy("fq_name").orderBy("day")
    whole = Window.partitionBy("fq_name")
    before = counts.select("fq_name", "day", (F.sum("c").over(ordered) - F.col("c")).alias("before"), F.sum("c").over(whole).alias("len"))
    placed = rows.withColumn("rn", F.row_number().over(Window.partitionBy("fq_name", "day").orderBy("observed_at", "seq"))).join(before, ["fq_name", "day"])
    j = F.col("before") + F.col("rn") - 1
    bucket = F.when(F.col("len") <= width, j).otherwise(F.floor(((j + 1) * width - 1) / F.col("len")))
    values = placed.groupBy("fq_name", bucket.alias("bucket")).agg(F.avg("value").alias("v"))
    spans = values.groupBy("fq_name").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.array_sort(F.collect_list(F.struct("bucket", "v"))).alias("points"))
    place = lambda p: F.when(F.col("hi") > F.col("lo"), F.floor((p["v"] - F.col("lo")) / (F.col("hi") - F.col("lo")) * (len(GLYPHS) - 1) + 0.5)).otherwise(F.lit(0)).cast("int")
    glyph = lambda p: F.element_at(F.array(*map(F.lit, GLYPHS)), F.greatest(F.least(place(p), F.lit(len(GLYPHS) - 1)), F.lit(0)) + 1)
    return spans.select("fq_name", F.array_join(F.transform("points", glyph), "").alias("sparkline"))
