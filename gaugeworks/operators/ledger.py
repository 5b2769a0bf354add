"""A keyed table that several writers change at once, without a lock and without overwriting a file.

A commit is a folder of entries, which nobody reads until a note says that it is done. A note is one row in one file
in a folder of its own, so it is there or it isn't, on a file system as on an object store: no rename has to fail and
nothing is created "if absent". Of a key's entries the one with the highest (version, author) counts, and a version is
one more than the highest that its writer saw; so commits can be read, merged and read twice in any order.
"""

from __future__ import annotations

import math
import random
import time
import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: So many commits of about one size are merged into one.
FAN = 8
#: A writer that has announced a change and then says nothing for so long is taken for dead.
PATIENCE_S = 3600
_NOTE = "commit string, step string, version long, at double, rows long, replaces array<string>"


class Conflict(RuntimeError):
    """A change that met others at every try, or took too long to be sure of itself."""


@dataclass(frozen=True)
class _State:
    """What the notes say: commits that count (with versions and rows), and announced changes still open."""

    live: dict
    open: dict

    @property
    def version(self) -> int:
        return max((v for v, _ in self.live.values()), default=0)


class Ledger:
    """Entries of ``schema`` by ``keys`` under ``root``, which all writers share.

    ``put`` and ``remove`` are for keys that the caller alone writes (a run's files, a connector's own state): they
    never wait, and of two at once the later version, then the greater commit name, counts for a key that both have.
    ``update`` reads before it writes and succeeds only if nobody else changed the table meanwhile; it tries again
    otherwise. Null keys are keys; columns can't be maps. Of rows that repeat a key within a commit the greatest counts.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: tuple[str, ...], fan: int = FAN):
        self.spark, self.root, self.keys, self.fan = spark, root.rstrip("/"), keys, fan
        self.fields = T.StructType.fromDDL(schema)
        self.columns = self.fields.names
        stamps = [T.StructField("__version", T.LongType()), T.StructField("__author", T.StringType()), T.StructField("__gone", T.BooleanType())]
        self._stored = T.StructType([*self.fields.fields, *stamps])

    # notes

    def _note(self, commit: str, step: str, version: int, rows: int = 0, replaces: tuple[str, ...] = ()) -> None:
        row = self.spark.createDataFrame([(commit, step, version, time.time(), rows, list(replaces))], _NOTE)
        row.coalesce(1).write.parquet(f"{self.root}/notes/note={uuid.uuid4().hex}")

    def _notes(self) -> DataFrame:
        try:
            return self.spark.read.schema(_NOTE).parquet(f"{self.root}/notes")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _NOTE)

    def _state(self) -> _State:
        """Only what is live or open comes to the driver: some FAN commits of each size, and the writers at work."""
        notes = self._notes()
        replaced = notes.select(F.explode("replaces").alias("commit")).distinct()
        ended = notes.where("step IN ('done', 'withdrawn')").select("commit").distinct()
        live = notes.where("step = 'done'").join(replaced, "commit", "left_anti")
        begun = notes.where(F.col("step") == "open").where(F.col("at") > time.time() - PATIENCE_S).join(ended, "commit", "left_anti")
        rows = live.unionByName(begun).collect()
        return _State({r.commit: (r.version, r.rows) for r in rows if r.step == "done"}, {r.commit: r.at for r in rows if r.step == "open"})

    # entries

    def _path(self, commit: str) -> str:
        return f"{self.root}/entries/commit={commit}"

    def _write(self, rows: DataFrame, commit: str) -> int:
        rows.select(*self._stored.names).write.mode("overwrite").parquet(self._path(commit))
        return self._read([commit]).count()

    def _read(self, commits) -> DataFrame:
        paths = [self._path(c) for c in sorted(commits)]
        return self.spark.read.schema(self._stored).parquet(*paths) if paths else self.spark.createDataFrame([], self._stored)

    def _newest(self, rows: DataFrame) -> DataFrame:
        """One entry a key, summed up before it is shuffled; a key that was removed keeps the entry that says so."""
        rest = [c for c in self._stored.names if c not in self.keys and not c.startswith("__")]
        best = F.max(F.struct("__version", "__author", "__gone", *rest)).alias("__best")
        return rows.groupBy(*self.keys).agg(best).select(*self.keys, "__best.*").select(*self._stored.names)

    def _stamped(self, rows: DataFrame, version: int, commit: str, gone: bool) -> DataFrame:
        held = {c.lower() for c in rows.columns}
        columns = [F.col(f.name).cast(f.dataType) if f.name.lower() in held else F.lit(None).cast(f.dataType) for f in self.fields]
        named = [c.alias(f.name) for c, f in zip(columns, self.fields, strict=True)]
        return rows.select(*named, F.lit(version).cast("long").alias("__version"), F.lit(commit).alias("__author"), F.lit(gone).alias("__gone"))

    def _current(self, state: _State) -> DataFrame:
        return self._newest(self._read(state.live)).where("NOT __gone").select(*self.columns)

    # what users call

    def read(self) -> DataFrame:
        """The table as the commits that are done by now leave it."""
        return self._current(self._state())

    def put(self, rows: DataFrame, name: str | None = None) -> str:
        """Adds or replaces whole entries. A ``name`` that is committed already changes nothing, so a retried run can use its own."""
        return self._commit(rows, name, gone=False)

    def remove(self, rows: DataFrame, name: str | None = None) -> str:
        """Removes the keys of ``rows``; what else they hold doesn't matter."""
        return self._commit(rows.select(*self.keys), name, gone=True)

    def _commit(self, rows: DataFrame, name: str | None, gone: bool) -> str:
        commit = name or uuid.uuid4().hex
        if name and self._notes().where((F.col("commit") == name) & (F.col("step") == "done")).limit(1).count():
            return name
        version = self._state().version + 1
        self._note(commit, "done", version, self._write(self._stamped(rows, version, commit, gone), commit))
        return commit

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 20) -> str:
        """Puts what ``change`` makes of the current table, if that is still current then.

        The change is announced before it is checked, so of two writers at least one sees the other: the smaller
        name goes on once the other has given way. A writer that took over half of PATIENCE_S doesn't commit.
        """
        for attempt in range(tries):
            before = self._state()
            if not before.open:
                commit = uuid.uuid4().hex
                rows = self._write(self._stamped(change(self._current(before)), before.version + 1, commit, False), commit)
                begun = time.time()
                self._note(commit, "open", before.version + 1)
                if self._may_commit(commit, before, begun):
                    self._note(commit, "done", before.version + 1, rows)
                    return commit
                self._note(commit, "withdrawn", before.version + 1)
            time.sleep(random.uniform(0.1, 0.4 * min(attempt + 1, 8)))
        raise Conflict(f"{self.root} changed at each of {tries} tries")

    def _may_commit(self, commit: str, before: _State, begun: float) -> bool:
        while True:
            now = self._state()
            if time.time() - begun > PATIENCE_S / 2:
                self._note(commit, "withdrawn", before.version + 1)
                raise Conflict(f"{commit} took longer than half of {PATIENCE_S} s")
            others = now.open.keys() - {commit}
            if now.version > before.version or any(c < commit for c in others):
                return False
            if not others:
                return True
            time.sleep(0.1)

    def merge(self) -> list[str]:
        """Merges commits of about one size where there are FAN of them; returns the new ones.

        Entries keep their stamps, so readers get the same rows from the old commits, the new one or both, and two
        that merge at once only repeat work. An entry is written again a logarithmic number of times.
        """
        tiers = defaultdict(list)
        state = self._state()
        for commit, (_, rows) in state.live.items():
            tiers[int(math.log(max(rows, 1), self.fan) + 1e-9)].append(commit)
        made = []
        for commits in tiers.values():
            if len(commits) >= self.fan:
                commit = uuid.uuid4().hex
                rows = self._write(self._newest(self._read(commits)), commit)
                self._note(commit, "done", max(state.live[c][0] for c in commits), rows, tuple(commits))
                made.append(commit)
        return made

    def superseded(self) -> DataFrame:
        """Folders that no new reader opens: merged or withdrawn commits. Remove them once no reader is older than that."""
        notes = self._notes()
        gone = notes.select(F.explode("replaces").alias("commit")).union(notes.where("step = 'withdrawn'").select("commit"))
        return gone.distinct().select(F.concat(F.lit(f"{self.root}/entries/commit="), "commit").alias("path"))
