"""Sinks as plug-ins with a life of their own: opened, written to in batches, flushed and closed by tasks, committed once.

Tasks write where no reader looks. When all of them have closed, one commit on the driver makes a run visible as a whole;
if one of them fails for good, the run is aborted and nothing of it is ever seen. An attempt that Spark gives up (a lost
executor, a slow twin) isn't in the commit, so its files don't count either.
"""

from __future__ import annotations

import json
import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F


class Writer(ABC):
    """One task's end of a sink."""

    @abstractmethod
    def write(self, stream: str, batch: pa.RecordBatch) -> int:
        """Takes records of one stream and says how many it keeps."""

    def flush(self) -> None:
        """What was taken so far has to survive from here on."""

    @abstractmethod
    def close(self) -> dict:
        """Ends the writing; what it returns (JSON values) goes to ``commit``."""

    def cancel(self) -> None:
        """The task failed: lets go of what it holds."""


class Sink(ABC):
    """A sink; pickled to go to the tasks. ``commit`` and ``abort`` run on the driver."""

    needs: tuple[str, ...] = ()

    def validate(self, options: dict[str, str]) -> None:
        missing = [n for n in self.needs if not options.get(n)]
        if missing:
            raise ValueError(f"missing options: {', '.join(missing)}")

    @abstractmethod
    def open(self, options: dict[str, str], task: str) -> Writer: ...

    @abstractmethod
    def commit(self, options: dict[str, str], closed: list[dict]) -> None: ...

    def abort(self, options: dict[str, str], closed: list[dict]) -> None:
        """Removes what the tasks that did close have written."""


@dataclass
class _Closed(D.WriterCommitMessage):
    said: str


class _Adapter(D.DataSourceArrowWriter):
    def __init__(self, sink: Sink, options: dict[str, str]):
        self.sink, self.options = sink, options

    def write(self, iterator: Iterator[pa.RecordBatch]):
        writer = self.sink.open(self.options, uuid.uuid4().hex)
        try:
            rows = 0
            for batch in iterator:
                streams = batch.column(batch.schema.get_field_index("stream"))
                for stream in streams.unique().to_pylist():
                    mine = pa.compute.is_null(streams) if stream is None else pa.compute.equal(streams, stream)
                    rows += writer.write(stream, batch.filter(mine))
            writer.flush()
            return _Closed(json.dumps({"rows": rows} | writer.close()))
        except BaseException:
            writer.cancel()
            raise

    def commit(self, messages):
        self.sink.commit(self.options, [json.loads(m.said) for m in messages if m is not None])

    def abort(self, messages):
        self.sink.abort(self.options, [json.loads(m.said) for m in messages if m is not None])


def _source(name: str, sink: Sink) -> type[D.DataSource]:
    class Target(D.DataSource):
        @classmethod
        def name(cls):
            return f"gaugeworks_sink_{name}"

        def writer(self, schema, overwrite):
            return _Adapter(sink, dict(self.options))

    return Target


_sinks: dict[str, Sink] = {}


def register_lifecycle_sink(name: str, sink: Sink) -> None:
    if not isinstance(sink, Sink):
        raise TypeError(f"{name!r} is no sink")
    if name in _sinks:
        raise ValueError(f"sink {name!r} is registered twice")
    _sinks[name] = sink


def write_run(records: DataFrame, name: str, **options: str) -> None:
    """Writes ``records(stream, …)`` as one run of a sink: all of it becomes visible, or nothing."""
    if name not in _sinks:
        raise KeyError(f"no sink {name!r}; known: {sorted(_sinks)}")
    _sinks[name].validate(options)
    records.sparkSession.dataSource.register(_source(name, _sinks[name]))
    records.write.format(f"gaugeworks_sink_{name}").options(**options).mode("append").save()


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Files(Writer):
    """A Parquet file for each stream, written row group by row group."""

    ROWS = 100_000

    def __init__(self, path: str, run: str, task: str):
        self.store, root = _store(path)
        self.folder, self.task = f"{root}/files/run={run}", task
        self.held: dict[str | None, list[pa.RecordBatch]] = {}
        self.files: dict[str | None, tuple[str, object]] = {}

    def write(self, stream, batch):
        self.held.setdefault(stream, []).append(batch)
        if sum(b.num_rows for b in self.held[stream]) >= self.ROWS:
            self._drain(stream)
        return batch.num_rows

    def _drain(self, stream):
        from pyarrow import parquet as pq

        table = pa.Table.from_batches(self.held.pop(stream))
        if stream not in self.files:
            path = f"{self.folder}/{self.task}-{len(self.files)}.parquet"
            self.store.create_dir(self.folder, recursive=True)
            self.files[stream] = path, pq.ParquetWriter(self.store.open_output_stream(path), table.schema)
        self.files[stream][1].write_table(table)

    def flush(self):
        for stream in list(self.held):
            self._drain(stream)

    def close(self):
        for _, file in self.files.values():
            file.close()
            file.file_handle and file.file_handle.close()
        return {"files": [path for path, _ in self.files.values()]}

    def cancel(self):
        for path, file in self.files.values():
            file.close()
            self.store.delete_file(path)


class RunFolder(Sink):
    """Parquet files below ``path`` that count from the moment the run's list of them exists; a run that is written again replaces its list."""

    needs = ("path", "run")

    def open(self, options, task):
        return _Files(options["path"], options["run"], task)

    def commit(self, options, closed):
        store, root = _store(options["path"])
        store.create_dir(f"{root}/runs", recursive=True)
        draft = f"{root}/runs/.{options['run']}-{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as f:
            f.write(json.dumps({"run": options["run"], "rows": sum(c["rows"] for c in closed), "files": [p for c in closed for p in c["files"]]}).encode())
        store.move(draft, f"{root}/runs/{options['run']}.json")

    def abort(self, options, closed):
        store, _ = _store(options["path"])
        for path in (p for c in closed for p in c["files"]):
            store.delete_file(path)


register_lifecycle_sink("run_folder", RunFolder())


def committed_runs(spark: SparkSession, path: str) -> DataFrame:
    """``run, rows, files`` of what was committed."""
    return spark.read.schema("run string, rows long, files array<string>").json(f"{path}/runs/*.json")


def read_committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all committed runs, with ``run``. The list of files goes to the driver, as it does for any read of files."""
    files = [r["p"] for r in committed_runs(spark, path).select(F.explode("files").alias("p")).distinct().collect()]
    scheme = path.split("://")[0] + "://" if "://" in path else "file:" if path.startswith("file:") else ""
    rows = spark.read.schema(schema).parquet(*[f"{scheme}{p}" if scheme else p for p in files]) if files else spark.createDataFrame([], schema)
    run = F.regexp_extract(F.col("_metadata.file_path"), "/run=([^/]+)/", 1) if files else F.lit(None).cast("string")
    return rows.select("*", run.alias("run"))
