"""A registry of batch transforms and the ordered chain that a run applies before it writes."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from gaugeworks.functions.hosts import add_host
from gaugeworks.functions.times import ts_normalize

Transform = Callable[..., DataFrame]
_known: dict[str, Transform] = {}


def register(name: str, transform: Transform) -> None:
    """A name can be taken once; user code in pandas or Arrow goes in as a transform that calls ``mapInPandas`` or ``mapInArrow``."""
    if not callable(transform):
        raise TypeError(f"transform {name!r} can't be called")
    if name in _known:
        raise ValueError(f"transform {name!r} is registered twice")
    _known[name] = transform


def get(name: str) -> Transform:
    if name not in _known:
        raise KeyError(f"no transform {name!r}; known: {sorted(_known)}")
    return _known[name]


def chain(df: DataFrame, steps: Iterable[tuple[str, dict]]) -> DataFrame:
    """Applies the named transforms in order; an error ends the run."""
    for name, options in steps:
        df = df.transform(get(name), **options)
    return df


register("url_host", add_host)
register("ts_normalize", ts_normalize)
