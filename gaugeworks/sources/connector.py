"""Sources as plug-ins: a connector says what it has and how its work is divided; Spark does the reading.

A connector is registered once and then read by name, as a batch or as a stream. Its pieces are planned on the driver and
read by tasks. What a query asks of ``stream`` and ``timestamp`` reaches the connector before anything is read, which
is how a cursor keeps old records from being fetched.
"""

from __future__ import annotations

import json
import pickle
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D

RECORDS = "stream string, timestamp timestamp, data_json string"
_ARROW = pa.schema([("stream", pa.string()), ("timestamp", pa.timestamp("us", tz="UTC")), ("data_json", pa.string())])


@dataclass
class Wanted:
    """What a query asks for: some streams (all for None), and times after and up to a moment, if any. A connector may return more."""

    streams: frozenset[str] | None = None
    after: datetime | None = None
    after_included: bool = False
    until: datetime | None = None
    seen: list[str] = field(default_factory=list)

    def stream(self, names: Iterable[str]) -> None:
        self.streams = frozenset(names) if self.streams is None else self.streams & frozenset(names)

    def newer(self, at: datetime, included: bool) -> None:
        if self.after is None or at > self.after or (at == self.after and not included):
            self.after, self.after_included = at, included

    def older(self, at: datetime) -> None:
        self.until = at if self.until is None else min(self.until, at)


class Connector(ABC):
    """A source of records. All methods but ``read`` run on the driver; it is pickled to go to the tasks."""

    #: Options without which it can't work.
    needs: tuple[str, ...] = ()

    def validate(self, options: dict[str, str]) -> None:
        """Raises ValueError for options that can't work, before anything is read."""
        missing = [n for n in self.needs if not options.get(n)]
        if missing:
            raise ValueError(f"missing options: {', '.join(missing)}")

    @abstractmethod
    def discover(self, options: dict[str, str]) -> list[str]:
        """The names of the streams."""

    @abstractmethod
    def pieces(self, options: dict[str, str], wanted: Wanted) -> list:
        """Work for tasks, each piece small enough for one: anything that can be pickled."""

    @abstractmethod
    def read(self, options: dict[str, str], piece, wanted: Wanted) -> Iterator[pa.RecordBatch]:
        """A piece's records with the columns of ``RECORDS``, in batches."""

    def position(self, options: dict[str, str]) -> dict:
        """How far the source has come, as JSON values; streams need it."""
        raise NotImplementedError("this connector can't be streamed")

    def between(self, options: dict[str, str], start: dict | None, end: dict) -> list:
        """Pieces of what came after ``start`` (all for None) and up to ``end``."""
        raise NotImplementedError("this connector can't be streamed")


_connectors: dict[str, Connector] = {}


def register_connector(name: str, connector: Connector) -> None:
    if not isinstance(connector, Connector):
        raise TypeError(f"{name!r} is no connector")
    if name in _connectors:
        raise ValueError(f"connector {name!r} is registered twice")
    _connectors[name] = connector


def connectors() -> list[str]:
    return sorted(_connectors)


@dataclass
class _Piece(D.InputPartition):
    work: bytes

    def __init__(self, work):
        self.work = pickle.dumps(work)
        self.value = None


def _utc(value) -> datetime:
    return value if value.tzinfo else value.replace(tzinfo=UTC)


class _Batches(D.DataSourceReader):
    def __init__(self, connector: Connector, options: dict[str, str]):
        self.connector, self.options, self.wanted = connector, options, Wanted()

    def pushFilters(self, filters):
        """Takes what it understands as a hint; Spark still applies every filter, so a connector may return more."""
        for f in filters:
            column = getattr(f, "attribute", ())
            if column == ("stream",) and isinstance(f, D.EqualTo):
                self.wanted.stream([f.value])
            elif column == ("stream",) and isinstance(f, D.In):
                self.wanted.stream(f.value)
            elif column == ("timestamp",) and isinstance(f, D.GreaterThan | D.GreaterThanOrEqual):
                self.wanted.newer(_utc(f.value), isinstance(f, D.GreaterThanOrEqual))
            elif column == ("timestamp",) and isinstance(f, D.LessThan | D.LessThanOrEqual):
                self.wanted.older(_utc(f.value))
            yield f

    def partitions(self):
        return [_Piece(p) for p in self.connector.pieces(self.options, self.wanted)] or [_Piece(None)]

    def read(self, partition):
        piece = pickle.loads(partition.work)
        if piece is not None:
            for batch in self.connector.read(self.options, piece, self.wanted):
                yield batch.select(_ARROW.names).cast(_ARROW)


class _Stream(D.DataSourceStreamReader):
    def __init__(self, connector: Connector, options: dict[str, str]):
        self.connector, self.options = connector, options

    def initialOffset(self):
        return {"at": None}

    def latestOffset(self, *_):
        return {"at": json.dumps(self.connector.position(self.options), sort_keys=True)}

    def partitions(self, start, end):
        if end["at"] is None:
            return []
        before = json.loads(start["at"]) if start["at"] else None
        return [_Piece(p) for p in self.connector.between(self.options, before, json.loads(end["at"]))]

    def read(self, partition):
        for batch in self.connector.read(self.options, pickle.loads(partition.work), Wanted()):
            yield batch.select(_ARROW.names).cast(_ARROW)

    def commit(self, end):
        """Nothing is let go: a batch may come again."""


def _source(name: str, connector: Connector) -> type[D.DataSource]:
    class Source(D.DataSource):
        @classmethod
        def name(cls):
            return f"gaugeworks_{name}"

        def schema(self):
            return RECORDS

        def reader(self, schema):
            return _Batches(connector, dict(self.options))

        def streamReader(self, schema):
            return _Stream(connector, dict(self.options))

    return Source


def _ready(spark: SparkSession, name: str, options: dict[str, str]) -> str:
    if name not in _connectors:
        raise KeyError(f"no connector {name!r}; known: {connectors()}")
    _connectors[name].validate(options)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(_source(name, _connectors[name]))
    return f"gaugeworks_{name}"


def discover(name: str, **options: str) -> list[str]:
    _connectors[name].validate(options)
    return _connectors[name].discover(options)


def extract(spark: SparkSession, name: str, **options: str) -> DataFrame:
    """A connector's records as a DataFrame; filters on ``stream`` and ``timestamp`` go down to it."""
    return spark.read.format(_ready(spark, name, options)).options(**options).load()


def extract_stream(spark: SparkSession, name: str, **options: str) -> DataFrame:
    """The same as a stream: each batch has what came since the one before."""
    return spark.readStream.format(_ready(spark, name, options)).options(**options).load()


class ParquetFolder(Connector):
    """Landed Parquet files (``stream=…`` folders or a ``stream`` column) in any store that Arrow reaches, a row group a piece.

    Row groups whose statistics lie outside the asked times, and folders of other streams, aren't read. As a stream, files are
    taken in order of time of change and name, each once.
    """

    needs = ("path",)

    def _files(self, options) -> list[tuple[int, str]]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(options["path"] if "://" in options["path"] or options["path"].startswith("file:") else f"file://{options['path']}")
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return sorted((x.mtime_ns or 0, x.path) for x in found if x.is_file and x.path.endswith(".parquet"))

    @staticmethod
    def _open(options, path):
        from pyarrow import fs
        from pyarrow import parquet as pq

        store, _ = fs.FileSystem.from_uri(options["path"] if "://" in options["path"] or options["path"].startswith("file:") else f"file://{options['path']}")
        return pq.ParquetFile(store.open_input_file(path))

    @staticmethod
    def _stream_of(path: str) -> str | None:
        part = [p for p in path.split("/") if p.startswith("stream=")]
        return part[-1][len("stream=") :] if part else None

    def discover(self, options):
        return sorted({s for _, p in self._files(options) if (s := self._stream_of(p))})

    def pieces(self, options, wanted):
        out = []
        for _, path in self._files(options):
            stream = self._stream_of(path)
            if wanted.streams is not None and stream is not None and stream not in wanted.streams:
                continue
            meta = self._open(options, path).metadata
            for g in range(meta.num_row_groups):
                if self._may_hold(meta.row_group(g), wanted):
                    out.append((path, g))
        return out

    @staticmethod
    def _may_hold(group, wanted) -> bool:
        for c in range(group.num_columns):
            column = group.column(c)
            stats = column.statistics
            if column.path_in_schema == "timestamp" and stats is not None and stats.has_min_max and isinstance(stats.max, int):
                moment = lambda us: datetime.fromtimestamp(us / 1e6, UTC)
                if (wanted.after is not None and moment(stats.max + 1) < wanted.after) or (wanted.until is not None and moment(stats.min - 1) > wanted.until):
                    return False
        return True

    def read(self, options, piece, wanted):
        path, group = piece
        stream = self._stream_of(path)
        names = ["timestamp", "data_json"] + ([] if stream is not None else ["stream"])
        for batch in self._open(options, path).iter_batches(row_groups=[group], columns=names):
            at = batch.column("timestamp")
            at = at.cast(pa.timestamp("us", tz="UTC")) if pa.types.is_integer(at.type) else at
            name = batch.column("stream") if stream is None else pa.array([stream] * batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([name, at, batch.column("data_json")], _ARROW.names)

    def position(self, options):
        files = self._files(options)
        return {"last": list(files[-1])} if files else {"last": [0, ""]}

    def between(self, options, start, end):
        low, high = tuple(start["last"]) if start else (-1, ""), tuple(end["last"])
        return [(path, g) for key in self._files(options) if low < key <= high for path in [key[1]] for g in range(self._open(options, path).metadata.num_row_groups)]


register_connector("parquet_folder", ParquetFolder())
