"""Packing token sequences: length patterns by non-negative least squares, the rest by best fit.

The plan is made from the histogram of piece lengths alone, whose size is bounded by the capacity and not by
the input; each piece then finds its place from its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import stored

CAPACITY = 2048
#: Lengths are fitted in classes of so many tokens, in patterns of at most so many documents; the plan with fewest sequences is taken.
CLASS, DEPTHS = 32, (2, 3)
#: A worker's cache of word ids starts anew at so many words.
CACHE_WORDS = 1_000_000
#: A special token of this vocabulary: the tokenizer cuts a text there before anything else.
MARK = "<|endoftext|>"
END = np.zeros(1, "<u4").tobytes()
#: Control characters that Python takes for white space and the tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f]")


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), {}


def _ids(tokenizer, texts: list[str]) -> list[bytes]:
    return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _between_marks(tokenizer, words: list[str]) -> list[bytes]:
    """Ids of each word from one call, cut at the mark's own id."""
    ids = np.array(tokenizer.encode_batch_fast([MARK.join(words)], add_special_tokens=False)[0].ids, "<u4")
    raw, cuts = ids.tobytes(), np.flatnonzero(ids == tokenizer.token_to_id(MARK)) * 4
    return [raw[a:b] for a, b in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)], strict=True)]


def tokens(texts: list[str], path: str) -> Iterator[bytes]:
    """Little-endian 32-bit ids of each text.

    This tokenizer drops white space and never joins across it, so a text's ids are those of its words, which
    repeat: each worker keeps the ids of the words it has seen.
    """
    tokenizer, known = _tokenizer(path)
    for at in range(0, len(texts), 256):
        split = [None if _ODD.search(t) else t.split() for t in texts[at : at + 256]]
        if len(known) > CACHE_WORDS:
            known.clear()
        new = set().union(*(w for w in split if w)).difference(known)
        known.update((w, _ids(tokenizer, [w])[0]) for w in [w for w in new if MARK in w])
        if new := [w for w in new if MARK not in w]:
            known.update(zip(new, _between_marks(tokenizer, new), strict=True))
        for text, words in zip(texts[at : at + 256], split, strict=True):
            yield _ids(tokenizer, [text])[0] if words is None else b"".join(map(known.__getitem__, words))


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), tokens([t or "" for t in batch.column(1).to_pylist()], path), strict=True):
                ids += END
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            names = ["doc", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], names)

    return run


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Least squares ``a x = b`` with ``x >= 0`` by an active set (Lawson and Hanson)."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    gradient = a.T @ (b - a @ x)
    while rounds and (~active).any() and gradient[~active].max() > 1e-8 * max(1.0, np.abs(b).max()):
        rounds -= 1
        active[np.where(active, -np.inf, gradient).argmax()] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (s <= 1e-12)
            if not low.any():
                break
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x += step * (s - x)
            active &= x > 1e-12
            x[~active] = 0
        x = s
        gradient = a.T @ (b - a @ x)
    return x


def length_patterns(classes: int, depth: int) -> list[tuple[int, ...]]:
    """Multisets of at most ``depth`` classes that fill a sequence but for one class or less."""
    out = []

    def grow(pattern: tuple[int, ...], left: int) -> None:
        if pattern and left <= 1:
            out.append(pattern)
        if len(pattern) < depth:
            for k in range(pattern[-1] if pattern else 1, left + 1):
                grow((*pattern, k), left - k)

    grow((), classes)
    return out


Group = tuple[tuple[tuple[int, int], ...], int]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, width: int = CLASS, depths: tuple[int, ...] = DEPTHS) -> list[Group]:
    """Groups of equal sequences: ((length, copies in a sequence), ...) and the number of sequences."""
    return min((_plan(histogram, capacity, width, depth) for depth in depths), key=lambda groups: sum(n for _, n in groups))


def _plan(histogram: dict[int, int], capacity: int, width: int, depth: int) -> list[Group]:
    left = defaultdict(int, {k: v for k, v in histogram.items() if v})
    groups: list[Group] = []
    if n := left.pop(capacity, 0):
        groups.append((((capacity, 1),), n))
    classes = capacity // width
    of = lambda length: -(-length // width)
    need = np.zeros(classes)
    for length, n in left.items():
        need[of(length) - 1] += n
    open_: dict[int, list[Group]] = defaultdict(list)  # by free room
    if need.any():
        patterns = length_patterns(classes, depth)
        matrix = np.zeros((classes, len(patterns)))
        for j, p in enumerate(patterns):
            for k in p:
                matrix[k - 1, j] += 1
        scale = need.max()
        times = np.floor(nnls(matrix, need / scale) * scale + 1e-6).astype(np.int64)
        members = {k: sorted(x for x in left if of(x) == k) for k in range(1, classes + 1)}
        every = sorted(left)
        for j in np.argsort(-times, kind="stable"):
            want = int(times[j])
            while want:
                taken: list[int] = []
                for k in patterns[j][::-1]:
                    # the longest piece of its class; the last slot takes what fits best
                    pool = members[k] if len(taken) < len(patterns[j]) - 1 else every
                    pick = _longest(pool, left, taken, capacity - sum(taken))
                    if pick is None:
                        break
                    taken.append(pick)
                if len(taken) < len(patterns[j]):
                    break
                use = min(want, *(left[x] // taken.count(x) for x in taken))
                for x in set(taken):
                    left[x] -= use * taken.count(x)
                open_[capacity - sum(taken)].append((tuple((x, taken.count(x)) for x in sorted(set(taken), reverse=True)), use))
                want -= use
    rooms = sorted(r for r in open_ if r)
    for length in sorted((x for x in left if left[x] > 0), reverse=True):
        n = left[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                if n >= each:
                    _open(open_, rooms, capacity - each * length, (((length, each),), n // each))
                if n % each:
                    _open(open_, rooms, capacity - n % each * length, (((length, n % each),), 1))
                break
            room = rooms[at]
            made, count = open_[room].pop()
            if not open_[room]:
                rooms.pop(at)
            each = min(room // length, n)
            use = min(count, n // each)
            if use < count:
                _open(open_, rooms, room, (made, count - use))
            _open(open_, rooms, room - each * length, ((*made, (length, each)), use))
            n -= use * each
    return groups + [g for room in sorted(open_) for g in open_[room]]


def _longest(pool: list[int], left: dict[int, int], taken: list[int], room: int) -> int | None:
    """The longest length of a sorted ``pool`` that fits and isn't used up; what is used up leaves the pool."""
    at = bisect_right(pool, room) - 1
    while at >= 0:
        x = pool[at]
        if left[x] > taken.count(x):
            return x
        if not left[x]:
            pool.pop(at)
        at -= 1
    return None


def _open(open_: dict, rooms: list[int], room: int, group: Group) -> None:
    if room and room not in rooms:
        insort(rooms, room)
    open_[room].append(group)


def _tables(groups: list[Group]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: the rank at which each use of it starts, its first sequence, copies a sequence, and first offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    seen: dict[int, int] = defaultdict(int)
    base = 0
    for made, count in groups:
        offset = 0
        for length, each in made:
            rows[length].append((seen[length], base, each, offset))
            seen[length] += each * count
            offset += each * length
        base += count
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in rows.items()}


def _place(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, base, each, start = tables.value[int(x)]
                k = np.searchsorted(first, rank[at], "right") - 1
                beyond = rank[at] - first[k]
                sequence[at] = base[k] + beyond // each[k]
                offset[at] = start[k] + beyond % each[k] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of tokenized documents and their places in sequences of at most ``capacity`` tokens.

    Returns ``id_col, piece, start, length, ids_crc32, sequence_id, offset``. A document is its ids and a final 0;
    only longer ones are cut. Null text is empty: one piece of one token. A null id is kept; rows that repeat
    are packed as often as they come. An empty table gives no rows.

    The plan's tables are broadcast; they depend on the lengths that occur, not on the number of documents.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("t"))
    pieces = stored(base.mapInArrow(_cut(tokenizer or public_path(), capacity), "doc long, piece int, start long, length long, ids_crc32 long"), "pieces")
    lengths = stored(pieces.groupBy("length").agg(F.count("*").alias("n")), "lengths")
    groups = plan({r.length: r.n for r in lengths.collect()}, capacity)
    # n pieces of one length are ranked in about sqrt(n) parts, and these among each other, so neither list is long
    parts = F.broadcast(lengths.select("length", F.ceil(F.sqrt("n")).alias("parts")))  # a row for each length up to the capacity
    pieces = pieces.join(parts, "length").withColumn("part", F.pmod(F.xxhash64("doc", "piece", "ids_crc32"), F.col("parts"))).drop("parts")
    counts = stored(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "counts")
    tables = spark.sparkContext.broadcast(_tables(groups))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    order = Window.partitionBy("length", "part").orderBy("doc", "piece", "ids_crc32")
    ranked = pieces.withColumn("rn", F.row_number().over(order)).join(before, ["length", "part"])
    ranked = ranked.select("doc", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rn") - 1).cast("long").alias("rank"))
    out = ranked.mapInArrow(_place(tables), "doc long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("doc", id_col)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
