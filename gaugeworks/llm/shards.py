"""Sharded storage with size-tiered compaction.

Arrivals land as small immutable shards. Runs of similar size are merged, tier by tier, until files reach the
target size. The list of live shards is a manifest of its own version; a commit makes the next version with a
rename that fails where it already exists, so readers see the old or the new state and never a mixture.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass
from math import ceil, log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.common import shared_folder

#: A merge takes all shards of a tier once there are FAN; tiers are powers of FAN above the smallest size.
FAN = 4
TARGET_BYTES = 128 << 20
SMALLEST = 1 << 20
#: Arrivals that the query makes of its table; versions and age of data that a vacuum spares.
ARRIVALS, KEEP_VERSIONS, YOUNG_S = 4, 10, 24 * 3600.0


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


class ShardStore:
    """A folder of shards and manifests, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan: int = FAN, smallest: int = SMALLEST):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.fan, self.smallest = target_bytes, fan, smallest
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        where = self._hadoop.Path(self.root)
        self._fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = self._hadoop.FileContext.getFileContext(self._fs.makeQualified(where).toUri(), spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self._hadoop.Path(text)

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def load(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """A version's number and live shards; 0 and none before the first commit."""
        at = version if version is not None else max(self.versions(), default=0)
        if not at:
            return 0, []
        stream = self._fs.open(self._path(f"{self.root}/manifest/v{at:09d}.json"))
        try:
            raw = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return at, [Shard(**x) for x in json.loads(raw)["shards"]]

    def commit(self, seen: int, add: list[Shard], drop: list[Shard] = ()) -> int:
        """Version ``seen`` + 1, or an error if another writer made it first; then nothing has changed and the caller may try again."""
        live = [s for s in self.load(seen)[1] if s not in set(drop)] + add
        made = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        out.write(bytearray(json.dumps({"shards": [asdict(s) for s in live]}).encode()))
        out.close()
        options = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._context.rename(made, self._path(f"{self.root}/manifest/v{seen + 1:09d}.json"), options)
        return seen + 1

    def _write(self, df: DataFrame, **options) -> list[Shard]:
        """New files in a folder of their own; they count once a manifest names them."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.options(**options).parquet(folder)
        files = [s for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet")]
        return sorted((Shard(s.getPath().toString(), s.getLen()) for s in files), key=lambda s: s.path)

    def append(self, df: DataFrame, rows_per_shard: int = 0) -> int:
        """Lands a batch as it is partitioned, without a shuffle: each file is a shard."""
        options = {"maxRecordsPerFile": rows_per_shard} if rows_per_shard else {}
        return self.commit(max(self.versions(), default=0), self._write(df, **options))

    def tier(self, shard: Shard) -> int:
        return max(0, int(log(max(shard.bytes, 1) / self.smallest, self.fan)) + 1) if shard.bytes >= self.smallest else 0

    def due(self, shards: list[Shard]) -> list[Shard]:
        """The lowest tier with FAN shards or more that are still under half the target."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if 2 * s.bytes < self.target:
                tiers.setdefault(self.tier(s), []).append(s)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan), [])

    def compact(self) -> int:
        """Merges until no tier is due. Each merge reads its shards, writes target-sized files, and commits the swap.

        A merge that would not lessen the number of files ends the work.
        """
        seen, live = self.load()
        while merge := self.due(live):
            files = max(1, ceil(sum(s.bytes for s in merge) / self.target))
            if files >= len(merge):
                break
            rows = self.spark.read.schema(self.spark.read.parquet(merge[0].path).schema).parquet(*[s.path for s in merge])
            seen = self.commit(seen, self._write(rows.coalesce(files)), merge)
            seen, live = self.load(seen)
        return seen

    def read(self, version: int | None = None) -> DataFrame:
        paths = [s.path for s in self.load(version)[1]]
        if not paths:
            raise ValueError(f"no shards in {self.root}")
        return self.spark.read.schema(self.spark.read.parquet(paths[0]).schema).parquet(*paths)

    def vacuum(self, versions: int = KEEP_VERSIONS, young_s: float = YOUNG_S) -> int:
        """Deletes manifests but the newest ``versions``, then data that none of these names. Returns how many data files.

        Data younger than ``young_s`` stays, as a writer may be about to commit it.
        """
        known = self.versions()
        for old in known[: max(len(known) - max(versions, 1), 0)]:
            self._fs.delete(self._path(f"{self.root}/manifest/v{old:09d}.json"), False)
        live = {s.path for v in self.versions() for s in self.load(v)[1]}
        gone = 0
        for folder in self._fs.listStatus(self._path(f"{self.root}/data")):
            files = list(self._fs.listStatus(folder.getPath()))
            newest = max([folder.getModificationTime(), *(f.getModificationTime() for f in files)])
            if time.time() - newest / 1000 >= young_s and not any(f.getPath().toString() in live for f in files):
                gone += len(files)
                self._fs.delete(folder.getPath(), True)
        return gone


def arrivals(docs: DataFrame, n: int) -> list[DataFrame]:
    """``docs`` in ``n`` parts by a hash of the whole row, so that a part is the same however often it is made."""
    kinds = [f.name for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map", "variant"))]
    place = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in kinds]), F.lit(n))
    return [docs.where(place == k) for k in range(n)]


def sharded(docs: DataFrame, target_bytes: int = TARGET_BYTES, rows_per_shard: int = 2000, n_arrivals: int = ARRIVALS) -> tuple[DataFrame, ShardStore]:
    """Appends ``docs`` in several arrivals of small shards, compacts, and reads the committed version back; rows and columns are unchanged.

    Any rows do: nulls, repeats and empty texts are stored as they are. An empty table is stored as empty shards.
    Earlier versions stay readable until ``vacuum``.
    """
    store = ShardStore(docs.sparkSession, f"{shared_folder(docs.sparkSession)}/shards-{uuid.uuid4().hex}", target_bytes)
    for arrival in arrivals(docs, n_arrivals):
        store.append(arrival, rows_per_shard)
    store.compact()
    return store.read(), store


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """Every document as it is read back: digest of its text, the shard that holds it, and the manifest's version."""
    out, store = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    version, shards = store.load()
    sizes = spark.createDataFrame([(s.path.rsplit("/", 1)[1], i, s.bytes) for i, s in enumerate(shards)], "name string, shard int, shard_bytes long")
    rows = out.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.col("_metadata.file_name").alias("name"))
    return rows.join(F.broadcast(sizes), "name").select("doc_id", "n_bytes", "text_sha256", "shard", "shard_bytes", F.lit(version).alias("version"))
