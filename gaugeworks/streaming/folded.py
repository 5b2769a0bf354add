"""What streams keep between batches as folded deltas: small files for each batch, merged in powers of FAN.

A batch writes only its own rows. After FAN batches their deltas become one run, after FAN * FAN batches FAN runs become
one, and so on, so a row is written again a logarithmic number of times, and few runs are ever read. Which runs are live
follows from the number of batches alone: nothing is listed, and a batch that comes again writes the same runs again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FAN = 8


def newest(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """Of rows that say something of the same key those of the latest batch: a key may have many, or one that ends it."""

    def fold(rows: DataFrame) -> DataFrame:
        last = rows.groupBy(*keys).agg(F.max("batch").alias("__last"))
        same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
        condition = F.col("l.batch") == F.col("r.__last")
        for s in same:
            condition = condition & s
        return rows.alias("l").join(last.alias("r"), condition, "left_semi")

    return fold


class Folded:
    """Rows with a ``batch`` number, by batch; ``fold`` makes of several batches' rows what they come to together.

    ``part``, a column, is what readers choose by: only the files of the parts asked for are opened.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, part: str, fold: Callable[[DataFrame], DataFrame], fan: int = FAN):
        self.spark, self.root, self.part, self.fold, self.fan = spark, root.rstrip("/"), part, fold, fan
        self.schema = schema

    def runs(self, batches: int) -> list[tuple[int, int]]:
        """``(level, last batch)`` of the runs that make up the first so many batches, the longest first."""
        level, at, out = 0, 0, []
        while self.fan ** (level + 1) <= batches:
            level += 1
        while level >= 0:
            while at + self.fan**level <= batches:
                at += self.fan**level
                out.append((level, at - 1))
            level -= 1
        return out

    def _path(self, run: tuple[int, int]) -> str:
        return f"{self.root}/level={run[0]}/last={run[1]}"

    def _open(self, runs: list[tuple[int, int]]) -> DataFrame:
        if not runs:
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(self.schema)])
        rows = self.spark.read.schema(self.schema).option("basePath", self.root).parquet(*map(self._path, runs))
        return rows.select(*StructType.fromDDL(self.schema).names)

    def _save(self, rows: DataFrame, run: tuple[int, int]) -> None:
        rows.hint("rebalance", self.part).write.mode("overwrite").partitionBy(self.part).parquet(self._path(run))

    def append(self, batch: int, rows: DataFrame) -> None:
        """A batch's rows, and the merges that are due after it."""
        self._save(rows, (0, batch))
        level = 0
        while (batch + 1) % self.fan ** (level + 1) == 0:
            step = self.fan**level
            merged = [(level, batch - k * step) for k in reversed(range(self.fan))]
            level += 1
            self._save(self.fold(self._open(merged)), (level, batch))

    def of(self, batch: int) -> DataFrame:
        """What a batch has appended."""
        return self._open([(0, batch)])

    def read(self, batches: int, parts: list | None = None) -> DataFrame:
        """All that the first so many batches come to, or only what is in ``parts`` (a bounded list of values)."""
        rows = self._open(self.runs(batches))
        return self.fold(rows if parts is None else rows.where(F.col(self.part).isin(parts)))
