"""Timestamp normalisation: strings, integer and float epochs to RFC 3339 in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Epochs beyond this are milliseconds.
MILLIS_FROM = 10_000_000_000
#: date, optional time, optional fraction, optional zone
STAMP = r"^(\d{4}-\d{2}-\d{2})(?:([T ])(\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?(Z|[+-]\d{2}:\d{2})?)?$"
NUMBER = r"^[+-]?\d+$"
DECIMAL = r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"


def _rfc(at: Column, fraction: Column) -> Column:
    """Whole seconds and the digits of a fraction as text; trailing zeros go."""
    digits = F.regexp_replace(fraction, "0+$", "")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(digits != "", F.concat(F.lit("."), digits)).otherwise(""), F.lit("Z"))


def _from_micros(micros: Column) -> Column:
    return _rfc(F.timestamp_seconds(F.floor(micros / 1_000_000)), F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0"))


def _stamp(p: Column) -> Column:
    """Date, T or space, clock, fraction and zone as text in UTC; a zone needs the T of RFC 3339."""
    zone = F.when(F.get(p, F.lit(4)).isin("", "Z"), "+00:00").otherwise(F.get(p, F.lit(4)))
    clock = F.when(F.get(p, F.lit(2)) == "", "00:00:00").otherwise(F.get(p, F.lit(2)))
    at = F.try_to_timestamp(F.concat(F.get(p, F.lit(0)), F.lit("T"), clock, zone), F.lit("yyyy-MM-dd'T'HH:mm:ssxxx"))
    fits = ~((F.get(p, F.lit(1)) == " ") & (F.get(p, F.lit(4)) != ""))
    return F.when(fits, F.transform(F.array(F.struct(at.alias("at"))), lambda x: F.when(x["at"].isNotNull(), _rfc(x["at"], F.get(p, F.lit(3)))))[0])


def normalised(raw: Column) -> Column:
    """RFC 3339 text of a timestamp given as text; null where it can't be read.

    Layouts: RFC 3339, the same without zone (UTC), a space for the T, a date alone. Up to nine digits of a
    fraction are carried as text, as Spark's timestamps have six. Whole numbers are epochs in seconds, or in
    milliseconds beyond 1e10; of decimal numbers the fraction counts in microseconds, but not for milliseconds.
    """
    # one match, its groups apart by tabs; an array's element isn't worked out again wherever it is named
    groups = F.split(F.regexp_replace(raw, STAMP, "$1\t$2\t$3\t$4\t$5"), "\t", -1)
    read = F.when(raw.rlike(STAMP), F.transform(F.array(groups), _stamp)[0])
    whole = raw.try_cast("bigint")
    epoch = F.when(whole > MILLIS_FROM, _from_micros(whole * 1000)).otherwise(_from_micros(whole * 1_000_000))
    number = raw.try_cast("double")
    seconds = number.cast("bigint")
    micros = F.when(seconds > MILLIS_FROM, seconds * 1000).otherwise(seconds * 1_000_000 + F.round(F.greatest(number - seconds, F.lit(0.0)) * 1_000_000).cast("bigint"))
    return F.coalesce(read, F.when(raw.rlike(NUMBER), epoch), F.when(raw.rlike(DECIMAL) & ~raw.rlike(NUMBER), _from_micros(micros)))


def ts_normalize(df: DataFrame, ts_field: str = "timestamp", out_field: str | None = None) -> DataFrame:
    """Adds or replaces a field; what can't be read passes through unchanged."""
    return df.withColumn(out_field or ts_field, F.coalesce(normalised(F.col(ts_field).cast("string")), F.col(ts_field).cast("string")))
