"""Host names of URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: scheme, userinfo, host (or an address in brackets), port
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([^/?#]*))?(?:[/?#].*)?$"
BAD_HOST = r"[\x00-\x20\x7F<>\"\\^`{|}]"
BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"


def url_host(url: Column) -> Column:
    """Lower-cased host without port, userinfo and brackets; null where there is none or the URL can't be read."""
    host, port = F.regexp_extract(url, AUTHORITY, 1), F.regexp_extract(url, AUTHORITY, 2)
    bare = F.lower(F.regexp_replace(host, r"^\[|\]$", ""))
    good = url.rlike(AUTHORITY) & (bare != "") & ~host.rlike(BAD_HOST) & port.rlike("^[0-9]*$") & ~url.rlike(BAD_ESCAPE) & ~url.rlike(r"[\x00-\x1F\x7F]")
    return F.when(good, bare)


def add_host(df: DataFrame, url_field: str = "url", host_field: str = "host") -> DataFrame:
    return df.withColumn(host_field, url_host(F.col(url_field)))
