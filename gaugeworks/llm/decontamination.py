"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import free_name, stored
from gaugeworks.llm.hashing import pair, word_hashes

WINDOW = 13
#: Bytes of benchmark text that one set of tables may hold; a larger benchmark is searched shard by shard. Tables
#: take about six bytes for each byte of text.
SHARD_BYTES = 16 << 20
#: Items are cut into pieces of so many bytes, which share the words of all but one place of a window.
PIECE_BYTES = 64 << 10
_WORD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def split_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words: runs of digits, a-z and bytes beyond ASCII."""
    return text.translate(_WORD).split() if text else []


def _offsets(words: list[bytes]) -> np.ndarray:
    """Where each word starts in the words joined by spaces, and where one more would."""
    return np.cumsum([0, *(len(w) + 1 for w in words)], dtype=np.int64)


def _blocks(hashes: np.ndarray, size: int) -> np.ndarray:
    return pair(hashes[:-1], hashes[1:]) if size == 2 else hashes


class Tables:
    """Shift and suffix tables of all patterns of ``size`` words, as flat arrays.

    A block is two neighbouring words (one, for one-word patterns). ``shift``, indexed by a block's hash, says how
    far the window may move on when its last block is known; of blocks that share an entry the nearest counts.
    Where it is 0, ``keys`` (hashes of a pattern's last and first block, sorted) selects the patterns to compare, and
    their bytes are compared with the document's.
    """

    def __init__(self, size: int, texts: list[tuple[str, list[bytes]]]):
        self.size, self.block = size, min(2, size)
        self.names = sorted({item for item, _ in texts})
        number = {item: k for k, item in enumerate(self.names)}
        self.text = b"".join(b" ".join(words) + b" " for _, words in texts)
        self.offsets = np.concatenate([[0], np.cumsum(np.fromiter((len(w) + 1 for _, words in texts for w in words), np.int64))]).astype(np.uint32)
        counts = np.array([len(words) for _, words in texts])
        first = np.cumsum(counts) - counts
        starts = np.concatenate([np.arange(f, f + n - size + 1, dtype=np.int32) for f, n in zip(first, counts, strict=True)])
        blocks = _blocks(np.concatenate(list(word_hashes([self.text]))), self.block)
        self.mask = np.uint64((1 << min(24, max(10, int(len(blocks) * 4).bit_length()))) - 1)
        self.shift = np.full(int(self.mask) + 1, min(size - self.block + 1, 255), np.uint8)
        for stop in range(self.block, size + 1):  # nearer blocks come later and overwrite
            self.shift[blocks[starts + (stop - self.block)] & self.mask] = min(size - stop, 255)
        keys = pair(blocks[starts + (size - self.block)], blocks[starts])
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts = keys[order], starts[order]
        self.items = np.repeat(np.array([number[item] for item, _ in texts], np.int32), counts - size + 1)[order]

    def search(self, words: list[bytes], hashes: np.ndarray) -> Iterator[tuple[int, str]]:
        """Start and item of each occurrence."""
        at, n, size = self.size, len(words), self.size
        if n < size:
            return
        blocks = _blocks(hashes, self.block)
        steps, back, found = self.shift[blocks & self.mask].tobytes(), self.block, []
        while at <= n:
            if step := steps[at - back]:
                at += step
            else:
                found.append(at - size)
                at += 1
        if not found:
            return
        found = np.array(found)
        keys = pair(blocks[found + (size - back)], blocks[found])
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        some = np.flatnonzero(low < high)
        if not len(some):
            return
        body, offsets = b" ".join(words), _offsets(words)
        for k in some.tolist():
            start = int(found[k])
            own = body[offsets[start] : offsets[start + size] - 1]
            for j in range(low[k], high[k]):
                w = int(self.starts[j])
                if self.text[self.offsets[w] : int(self.offsets[w + size]) - 1] == own:
                    yield start, self.names[self.items[j]]


def build(rows: list[tuple[str, bytes]], window: int) -> list[Tables]:
    by_size: dict[int, list] = defaultdict(list)
    for item, text in rows:
        if words := split_words(text):
            by_size[min(window, len(words))].append((item, words))
    return [Tables(size, texts) for size, texts in sorted(by_size.items())]


def _pieces(window: int, most: int):
    """Items as words joined by spaces; long ones in pieces, so that each window lies in exactly one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, bodies = [], []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = split_words(text)
                offsets, last, at = _offsets(words), max(len(words) - window, 0), 0
                while words and at <= last:
                    stop = max(int(np.searchsorted(offsets, offsets[at] + most)), at + 1)
                    names.append(item)
                    bodies.append(b" ".join(words[at : stop + window - 1]))
                    at = stop
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], ["item", "body"])

    return run


def shards_of(benchmark: DataFrame, item_col: str, text_col: str, window: int, shard_bytes: int) -> list[DataFrame]:
    """The benchmark's pieces dealt into shards, each measured to hold at most ``shard_bytes``, or one piece."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("binary").alias("body")).where("body IS NOT NULL")
    pieces = stored(items.mapInArrow(_pieces(window, min(PIECE_BYTES, max(shard_bytes // 4, 1))), "item string, body binary").distinct(), "pieces")
    n = 1
    while True:
        place = F.pmod(F.xxhash64("item", "body"), F.lit(n))
        sizes = pieces.groupBy(place.alias("k")).agg(F.sum(F.octet_length("body")).alias("bytes"), F.count("*").alias("rows"))
        worst = sizes.where((F.col("bytes") > shard_bytes) & (F.col("rows") > 1)).agg(F.max("bytes")).first()[0]
        if worst is None:
            return [pieces if n == 1 else pieces.where(place == k) for k in range(n)]
        n = max(n + 1, n * min(-(-worst // shard_bytes), 16))


_NEW = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])


def _scan(tables, at: int, keep: list[int], held: bool):
    """Adds the number of words, the hit words' places and the items; with ``held`` it adds to what an earlier shard found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hits, found = [], [], []
            texts = [split_words(t) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            before = batch.columns[-2:] if held else ()
            before = [c.to_pylist() for c in before] or [[()] * len(texts)] * 2
            for words, hashes, old, names in zip(texts, word_hashes([b" ".join(w) for w in texts]), *before, strict=True):
                places, items = set(old), set(names)
                for table in tables.value:
                    for start, item in table.search(words, hashes):
                        places.update(range(start, start + table.size))
                        items.add(item)
                n.append(len(words))
                hits.append(sorted(places))
                found.append(sorted(items))
            new = [pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *new], [f"c{i}" for i in range(len(keep) + 3)])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep_text: bool = True, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, list[str]]:
    """``docs`` with three more columns: number of words, places of hit words, items found; and their names.

    The benchmark's tables go to each task as a broadcast of at most ``shard_bytes`` of text; a larger benchmark
    is cut into shards, within items too, and the documents pass one shard after the other. Documents aren't shuffled.
    Null or wordless text has no words and no hits; null or wordless items have no windows. Item ids are
    compared as strings, a null id as the empty string; items that repeat count once.
    """
    spark = docs.sparkSession
    parts = shards_of(benchmark, item_col, item_text_col, window, shard_bytes)
    shards = len(parts)
    names = [free_name(docs, n) for n in ("n_words", "hits", "items")]
    out = docs
    for k, part in enumerate(parts):
        tables = spark.sparkContext.broadcast(build([(r.item, bytes(r.body)) for r in part.collect()], window))
        at = out.columns.index(text_col)
        columns = [i for i, c in enumerate(docs.columns) if keep_text or k < shards - 1 or c != text_col]
        fields = [T.StructField(docs.schema[i].name, docs.schema[i].dataType, True) for i in columns]
        new = [T.StructField(name, f.dataType, True) for name, f in zip(names, _NEW.fields, strict=True)]
        out = out.mapInArrow(_scan(tables, at, columns, k > 0), T.StructType(fields + new))
        if shards > 1 and k < shards - 1:
            out = stored(out, "shard")
    return out, names


def contamination_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """A row for each document: words, hit words, items, digest of the items, and the verdict (a twentieth of the words hit)."""
    full, (n, hits, items) = contamination(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), benchmark, "t", keep_text=False, **options)
    n_hit = F.size(hits).cast("long")
    return full.select(F.col("id").alias(id_col), F.col(n).alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col(n))).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents; columns unchanged."""
    full, (n, hits, _) = contamination(docs, benchmark, text_col, **options)
    return full.where(~((F.size(hits) > 0) & (20 * F.size(hits) >= F.col(n)))).select(*docs.columns)


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = rf"""
WITH a AS (SELECT 0 AS kind, row_number() OVER () AS rid, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark),
w AS MATERIALIZED (SELECT kind, rid, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM a),
p AS MATERIALIZED (SELECT DISTINCT id AS item, least(len(w), {WINDOW}) AS m, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS s FROM (SELECT id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM w WHERE kind = 1 AND len(w) > 0)),
z AS (SELECT DISTINCT m FROM p),
x AS MATERIALIZED (SELECT rid, m, i, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, z WHERE kind = 0 AND len(w) >= m)),
o AS MATERIALIZED (SELECT rid, m, i, item FROM x JOIN p USING (m, s)),
h AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest(range(i, i + m)) AS pos FROM o) GROUP BY rid),
k AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item::VARCHAR AS item FROM o) GROUP BY rid)
SELECT id AS doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(k.n, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM w LEFT JOIN h USING (rid) LEFT JOIN k USING (rid) WHERE kind = 0
"""
