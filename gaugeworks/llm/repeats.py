"""Removal of repeated passages by a depth-limited radix sort of suffixes.

A suffix counts only through its first ``window`` bytes, so two suffixes are equal exactly where a passage of
that length repeats. Passes go from the most significant digit down and drop what is alone in its group:

1. The first digit of a suffix is the least hash among the ``gram``-byte strings of its window. Equal windows
   have equal digits, and neighbouring suffixes mostly share theirs, so a run of them is one row, about one for
   each 80 bytes, instead of a row for each suffix.
2. The second digit is the text that the whole run covers. Runs that are equal there are repeats outright.
3. What is left, runs that share the first digit and differ in the second, is cut into blocks of 32 neighbouring
   suffixes, each with the bytes that all its suffixes share as digit, then into blocks of 8, then into single
   suffixes: at each pass only groups with several members go on, so few suffixes are ever spelled out;
   and blocks that are equal as a whole are repeats outright.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import small, stored

WINDOW, GRAM = 200, 40
#: Texts are hashed in parts of so many bytes; parts overlap by a window.
PART = 1 << 20
#: Neighbouring suffixes in a block of the third pass, and of the fourth.
BLOCK, SMALL = 32, 8
_PLACE = np.uint64((1 << 21) - 1)
_BYTE = np.random.default_rng(7411).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(31)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the concatenation of two strings of known lengths, from their hashes."""
    h = a * _A
    h += b
    h ^= h >> _S
    h *= _B
    h ^= h >> np.uint64(29)
    return h


class Hashes:
    """Hashes of all substrings of a few lengths of one part, by doubling."""

    def __init__(self, data: np.ndarray, longest: int):
        self.by: dict[int, np.ndarray] = {1: _BYTE[data]}
        size = 1
        while 2 * size <= min(longest, len(data)):
            h = self.by[size]
            self.by[2 * size] = _join(h[:-size], h[size:])
            size *= 2

    def of(self, size: int, start: np.ndarray | None = None) -> np.ndarray:
        """Of the strings of ``size`` bytes at ``start``, or at all places: two overlapping powers of two cover them."""
        half = 1 << ((size - 1).bit_length() - 1) if size > 1 else 1
        half = size if size == 1 << (size.bit_length() - 1) else half
        h = self.by[half]
        if half == size:
            return h if start is None else h[start]
        if start is None:
            return _join(h[: len(h) - (size - half)], h[size - half :])
        return _join(h[start], h[start + size - half])


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(h)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def _parts(n: int, window: int) -> Iterator[tuple[int, int]]:
    """Parts whose windows together are all windows, each once."""
    for at in range(0, max(n - window + 1, 0), PART):
        yield at, min(n, at + PART + window - 1)


def runs_of(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """First digit, second digit, first window, number of windows and lead of the digit's string of each run of one part."""
    hashes = Hashes(data, window)
    grams = hashes.of(gram)
    keyed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    place = (_least(keyed, window - gram + 1) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.concatenate([first, [len(place)]]))
    anchor = place[first]
    # a run covers window..2*window bytes: three overlapping strings of half a power of two
    size = 1 << (window.bit_length() - 1)
    h = hashes.by[size]
    last = first + count - 1 + window - size
    middle = (first + last) // 2
    assert int((last - first).max(initial=0)) <= 2 * size
    shape = ((anchor - first).astype(np.uint64) << np.uint64(20)) | count.astype(np.uint64)
    return grams[anchor], _join(_join(h[first], h[middle]), _join(h[last], shape)), first, count, anchor - first


def _unpacked(column: pa.Array) -> list[bytes]:
    return [zlib.decompress(x) if x is not None else b"" for x in column.to_pylist()]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts are shuffled compressed."""
    for batch in batches:
        packed = [None if x is None else zlib.compress(x, 1) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["key", "id", "z"])


def _emit_runs(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.frombuffer(text or b"", np.uint8)
                for at, end in _parts(len(data), window):
                    digit, whole, first, count, lead = runs_of(data[at:end], window, gram)
                    for c, x in zip(columns, (np.full(len(digit), key), digit.view(np.int64), whole.view(np.int64), first + at, count, lead), strict=True):
                        c.append(x)
            flat = [np.concatenate(c) if c else np.empty(0, np.int64) for c in columns]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in flat[:4]] + [pa.array(x.astype(np.int32)) for x in flat[4:]], ["key", "digit", "whole", "first", "n", "lead"])

    return run


_BLOCKS = "key long, digit long, core long, place int, at long, lo int, hi int, before binary, after binary, c long"


def _emit_blocks(window: int):
    """The blocks of runs: the digit's place in the block, a hash of the bytes that all its windows share, and those that only some have."""
    shared = window - BLOCK + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, text, spans in zip(batch.column(0).to_pylist(), _unpacked(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                for span in spans:
                    start, n = span["first"], span["n"]
                    place, last = start + span["lead"], span["lead"] - n + 1
                    part = np.frombuffer(text[start : start + n - 1 + window], np.uint8)
                    hashes = Hashes(part, window)
                    for block in range(last // BLOCK, span["lead"] // BLOCK + 1):
                        near = block * BLOCK
                        lo, hi = max(last - near, 0), min(span["lead"] - near, BLOCK - 1)
                        at = place - near
                        core = hashes.of(shared, np.array([at - start]))
                        out.append((key, span["digit"], int(core.view(np.int64)[0]), near, at, lo, hi, text[at - hi : at], text[at + shared : at + shared + BLOCK - 1 - lo], span["c"]))
            kinds = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
            names = [x.split()[0] for x in _BLOCKS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * len(kinds), kinds, strict=True)], names)

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint maximal runs of the union."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, count, digest, kept = [], [], [], [], []
        for text, spans in zip(_unpacked(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            runs = merged([(s["a"], s["b"]) for s in spans or ()])
            rest = b"".join(text[x:y] for x, y in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(text)], strict=True))
            n.append(len(text))
            gone.append(len(text) - len(rest))
            count.append(len(runs))
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        new = [pa.array(x, pa.int64()) for x in (n, gone, count)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *new, pa.array(digest), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Remove every byte that a ``window``-byte string covers which starts anywhere else too, in any document.

    Returns ``id_col, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes that stay). All places of a
    repeated string go, the first included. Null text is empty; a text shorter than the window stays whole.
    Rows are told apart by id and text; rows that repeat both count as so many places, so long ones go
    wholly. A null id is kept. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = _keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")))
    packed = base.select("key", "id", "t").mapInArrow(_pack, f"key long, id {kind}, z binary")
    long = base.where(F.octet_length("t") >= window).select("key", "t")
    runs = stored(long.mapInArrow(_emit_runs(window, gram), "key long, digit long, whole long, first long, n int, lead int"), "runs")
    span = lambda first, n: F.struct(first.cast("long").alias("a"), (first + n - 1 + window).cast("long").alias("b"))
    # stored apart, so that adaptive execution can split the join on a digit that very many runs have
    several = stored(runs.groupBy("digit").agg(F.count("*").alias("c")).where("c > 1").select("digit"), "several")
    held = stored(runs.join(several, "digit"), "held")
    classes = stored(held.groupBy("digit", "whole").agg(F.count("*").alias("c"), F.min(F.struct("key", "first", "n", "lead")).alias("m")), "classes")
    mixed = stored(classes.groupBy("digit").agg(F.count("*").alias("k")).where("k > 1").select("digit"), "mixed")
    sure = held.join(classes.where("c > 1").select("digit", "whole"), ["digit", "whole"], "left_semi").select("key", span(F.col("first"), F.col("n")).alias("s"))
    spelled = classes.join(mixed, "digit").select("m.key", F.struct("m.first", "m.n", "m.lead", "digit", "c").alias("s")).groupBy("key").agg(F.collect_list("s").alias("spans"))
    blocks = packed.join(spelled, "key").dropDuplicates(["key"]).select("key", "z", "spans").mapInArrow(_emit_blocks(window), _BLOCKS)
    blocks = _several(stored(blocks, "blocks"), "digit", "core", "place")
    near = (F.col("j") * SMALL).cast("int")
    fine = blocks.withColumn("j", F.explode(F.sequence(F.floor(F.col("lo") / SMALL), F.floor(F.col("hi") / SMALL))))
    side = lambda back, ahead: F.xxhash64("core", "place", near, F.expr(f"substring(before, length(before) - {back} + 1, {back})"), F.expr(f"substring(after, 1, {ahead})"))
    fine = fine.withColumn("core2", side(f"(int(j) * {SMALL})", f"({BLOCK - SMALL} - int(j) * {SMALL})"))
    fine = _several(fine, "digit", "core2")
    lo, hi = F.greatest(F.col("lo"), near), F.least(F.col("hi"), near + SMALL - 1)
    fine = fine.select("key", "digit", "core2", "core", "place", "at", "before", "after", "c", lo.alias("lo"), hi.alias("hi"))
    whole = F.xxhash64("lo", "hi", F.expr("substring(before, length(before) - hi + 1, hi)"), F.expr(f"substring(after, 1, {BLOCK - 1} - lo)"))
    fine = fine.withColumn("whole", whole)
    kinds = stored(fine.groupBy("digit", "core2", "whole").agg(F.sum("c").alias("c"), F.min(F.struct("key", "at", "core", "place", "before", "after", "lo", "hi")).alias("m")), "kinds")
    equal = fine.where("c = 1").join(kinds.where("c > 1").select("digit", "core2", "whole"), ["digit", "core2", "whole"], "left_semi")
    equal = equal.select("key", span(F.col("at") - F.col("hi"), F.col("hi") - F.col("lo") + 1).alias("s"))
    unlike = kinds.groupBy("digit", "core2").agg(F.count("*").alias("k")).where("k > 1").select("digit", "core2")
    each = kinds.join(unlike, ["digit", "core2"]).select("digit", "c", "m.*").withColumn("i", F.explode(F.sequence("lo", "hi")))
    window_ = F.xxhash64("core", "place", "i", F.expr("substring(before, length(before) - i + 1, i)"), F.expr(f"substring(after, 1, {BLOCK - 1} - i)"))
    each = _several(each.select("key", "digit", "c", (F.col("at") - F.col("i")).alias("first"), window_.alias("w")), "digit", "w")
    rest = equal.union(each.where("c = 1").select("key", span(F.col("first"), F.lit(1)).alias("s")))
    cover = sure.union(rest).groupBy("key").agg(F.collect_set("s").alias("spans"))  # rows that repeat share their spans
    out = packed.join(cover, "key", "left").select("id", "z", "spans")
    return out.mapInArrow(_remove, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumnRenamed("id", id_col)


def _keyed(base: DataFrame, narrow=lambda h: h) -> DataFrame:
    """``base(id, t)`` with a ``key`` that is equal only for equal id and text.

    A key is a 64-bit hash. Where rows that differ (by 128 bits) share one, as will happen to a few of very many, those
    get another, until none do. ``narrow`` makes clashes likelier, for tests.
    """
    base = base.withColumn("key", narrow(F.xxhash64("id", "t"))).withColumn("other", F.xxhash64(F.lit(1), "id", "t"))
    while True:
        clash = stored(base.groupBy("key").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi").select("key", F.lit(True).alias("clash")), "clash")
        if clash.isEmpty():
            return base.drop("other")
        base = base.join(small(clash), "key", "left").withColumn("key", F.when(F.col("clash"), F.xxhash64("key", "other")).otherwise(F.col("key"))).drop("clash")


def _several(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose key stands for several places; one pass of the sort."""
    held = rows.groupBy(*keys).agg(F.sum("c").alias("__c"), F.count("*").alias("__n")).where("__c > 1 AND __n > 1").select(*keys)
    return stored(rows.join(held, list(keys)), "pass")


def op7_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT rid, i, md5(substr(h, 2 * i + 1, {2 * WINDOW})) AS s FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - {WINDOW - 1})) AS i FROM d WHERE length(h) >= {2 * WINDOW})),
r AS MATERIALIZED (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY s) AS c FROM w) WHERE c > 1),
b AS MATERIALIZED (SELECT rid, i, sum(CASE WHEN i - p <= {WINDOW} THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM r)),
s AS MATERIALIZED (SELECT rid, run, min(i) AS a, max(i) + {WINDOW} AS b FROM b GROUP BY rid, run),
g AS (SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS x, a AS y FROM s UNION ALL SELECT rid, max(b), 1000000000 FROM s GROUP BY rid),
k AS (SELECT rid, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS h FROM g JOIN d USING (rid) GROUP BY rid),
n AS (SELECT rid, sum(b - a) AS gone, count(*) AS n FROM s GROUP BY rid)
SELECT doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n.n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)
"""
