"""What several operators share: stored intermediates, safe column names, connected components."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of white space; every other byte belongs to a word.
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local session takes a temporary folder; a cluster raises, as executors
    would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="gaugeworks-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that outlives executors.

    Unlike ``checkpoint()`` this runs the plan once, and Parquet keeps it small.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: At most so many ids are broadcast (8 bytes each, about 100 MB once hashed); more are shuffled.
BROADCAST_IDS = 1 << 21


def small(ids: DataFrame) -> DataFrame:
    """Stored ``ids``, marked for broadcast if a count shows that there are at most BROADCAST_IDS."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def bucketed(df: DataFrame, name: str, key: str, deal: bool = True) -> DataFrame:
    """Store ``df`` bucketed and sorted by ``key`` in the shared folder; joins on ``key`` then don't shuffle it again.

    Without ``deal`` rows are written where they are, which is for few and large ones: a task may write a file a row.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    base = f"gaugeworks_{zlib.crc32(folder.encode()):08x}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {base} LOCATION '{folder}/{base}'")
    table, n = f"{base}.{name}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(n, key) if deal else df).write.bucketBy(n, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or with underscores in front until no column of ``df`` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def _digest(edges: DataFrame) -> tuple:
    """A count and an order-free checksum, to see whether a round changed anything."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` as ``(a, b)``: node and smallest node it reaches.

    Alternates large-star and small-star rounds until the edges stand still. A round only takes minima
    by node (partial aggregates), stores them and joins them back on the node, so a hub with very many
    neighbours is never collected, and adaptive execution can split its join. The smallest node of a component is not
    listed; null and self edges are ignored; no edges give no rows.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _digest(edges)
    while before[0]:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m")).where("a <> b").distinct()
        edges = stored(small, "edges")
        after = _digest(edges)
        if after == before:
            break
        before = after
    return edges
