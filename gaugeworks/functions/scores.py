"""Scalar pieces of the reports: deviations, labels, confidence, number text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGHER, LOWER = "higher_is_better", "lower_is_better"
#: Fixed values.
FULL_SAMPLES, FULL_SIGMA, HORIZON_HOURS, FULL_PAIRS, LEAST_PAIRS = 90, 3, 48, 30, 5
HIGH, MEDIUM = 0.75, 0.40


def deviation(value: Column, mean: Column, stddev: Column) -> Column:
    """Sigmas from the mean; null without a spread."""
    return F.when(stddev > 0, (value - mean) / stddev)


def surprise(direction: Column, dev: Column) -> Column:
    good = ((direction == HIGHER) & (dev > 0)) | ((direction == LOWER) & (dev < 0))
    return F.when(F.coalesce(direction, F.lit("")).isin(HIGHER, LOWER), F.when(good, "surprise-good").otherwise("surprise-bad")).otherwise("neutral")


def score(direction: Column, dev: Column) -> Column:
    """Rank of a deviation: bad ones count up, good ones down, neutral ones by size; 0 without one."""
    return F.coalesce(F.when(direction == HIGHER, -dev).when(direction == LOWER, dev).otherwise(F.abs(dev)), F.lit(0.0))


def baseline_confidence(n: Column) -> Column:
    return F.coalesce(F.when(n > 0, F.least(F.lit(1.0), n / F.lit(float(FULL_SAMPLES)))), F.lit(0.0))


def anomaly_confidence(z: Column) -> Column:
    return F.least(F.lit(1.0), F.abs(z) / F.lit(float(FULL_SIGMA)))


def proximity_confidence(hours: Column) -> Column:
    return F.when(hours <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - hours / F.lit(float(HORIZON_HOURS))))


def correlation_confidence(r: Column, n: Column) -> Column:
    return F.when(n < LEAST_PAIRS, F.lit(0.0)).otherwise(F.abs(r) * F.least(F.lit(1.0), n / F.lit(float(FULL_PAIRS))))


def level(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "high").when(confidence >= MEDIUM, "medium").otherwise("low")


def tag(confidence: Column, window_days: Column, n: Column) -> Column:
    detail = F.when(window_days.isNull(), "no baseline").otherwise(F.concat(window_days.cast("string"), F.lit("d baseline, n="), n.cast("string")))
    return F.concat(F.lit("("), level(confidence), F.lit(" confidence: "), detail, F.lit(")"))


def trend(direction: Column, dev: Column, window_mean: Column, window_n: Column, mean: Column) -> Column:
    """How the current value, or without one the window's mean, lies to the baseline."""
    dev = F.round(dev, 9)  # a pair of values lies exactly one sigma off
    watch = F.when(dev > 1, F.when(direction == HIGHER, "above baseline (positive)").when(direction == LOWER, "above baseline (watch)").otherwise("above baseline")).when(
        dev < -1, F.when(direction == LOWER, "below baseline (positive)").when(direction == HIGHER, "below baseline (watch)").otherwise("below baseline")
    )
    plain = F.when((window_n > 0) & (window_mean > mean), "above baseline").when((window_n > 0) & (window_mean < mean), "below baseline")
    return F.coalesce(F.when(dev.isNotNull(), watch).otherwise(plain), F.lit("near baseline"))


def connector(fq: Column) -> Column:
    return F.substring_index(fq, ".", 1)


def short_name(fq: Column) -> Column:
    return F.substring_index(fq, ".", -1)


def direction_text(direction: Column) -> Column:
    return F.when(direction == HIGHER, "higher is better").when(direction == LOWER, "lower is better").otherwise("neutral")


def _four_digits(x: Column) -> Column:
    size = F.abs(x)
    power = F.floor(F.log10(size)).cast("int")
    plain = lambda c: F.replace(c, F.lit(","), F.lit(""))
    trimmed = lambda t: F.when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)
    fixed = plain(F.call_function("format_number", size, F.greatest(3 - power, F.lit(0))))
    # whole numbers this large are exact decimals, so ties are seen
    exact = size.cast("decimal(38,18)")
    large = F.coalesce(*[F.when(power == k, F.bround(exact, 3 - k).cast("double")) for k in range(4, 16)], size)
    raised = F.when(large >= F.pow(F.lit(10.0), power + 1), power + 1).when(fixed == "10000", F.lit(4)).otherwise(power)
    mantissa = F.format_number(F.when(power >= 4, large).otherwise(size) / F.pow(F.lit(10.0), raised), 3)
    scientific = F.concat(trimmed(mantissa), F.lit("e"), F.when(raised < 0, "-").otherwise("+"), F.lpad(F.abs(raised).cast("string"), 2, "0"))
    text = F.when((raised < -4) | (raised >= 4), scientific).otherwise(trimmed(fixed))
    return F.when(x == 0, "0").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), text))


def four_digits(x: Column) -> Column:
    """Four significant digits (half to even) without trailing zeros; an exponent below 1e-4 and from 1e4."""
    return F.transform(F.array(x.cast("double")), _four_digits)[0]


def one_place(x: Column, signed: bool = True) -> Column:
    sign = F.when(x < 0, "-").otherwise("+" if signed else "")
    return F.concat(sign, F.replace(F.format_number(F.abs(x), 1), F.lit(","), F.lit("")))
