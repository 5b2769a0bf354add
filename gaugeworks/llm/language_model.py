"""Stupid-backoff scores of documents against n-gram counts of the whole corpus.

Documents are dealt into chunks of some megabytes. Orders are counted one after another: each chunk asks for its
distinct n-grams, in rows by range of their hashes, and the ranges, grouped, answer with counts in the order asked. Only
n-grams whose two shorter parts other documents have are asked for. At last each chunk's documents sum up.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import bucketed, stored
from gaugeworks.llm.hashing import pair, word_hashes

#: Longest n-gram, and the factor of each step back to a shorter one.
ORDER, BACKOFF = 3, 0.4
#: Bytes of text in a chunk, and n-grams asked for in a range, about; they bound what a task holds.
CHUNK_BYTES, RANGE_GRAMS = 8 << 20, 1 << 22
#: There are so many ranges at least (a power of two), so that small inputs are shared out, too.
LEAST_BITS = 5
#: Bytes of the difference of neighbouring hashes that are sent as they are; what is above is small and compressed.
PLAIN = 5


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each word."""
    h = words[: max(len(words) - n + 1, 0)]
    for k in range(1, n):
        h = pair(h, words[k : len(words) - n + 1 + k])
    return h


_CHUNK = "chunk long, docs binary, sizes binary, z binary, n_words long"


def _chunks(limit: int):
    """Documents of about ``limit`` bytes as one row: a name, document ids, text lengths, the compressed texts, and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if ids:
                doc, size, body = np.array(ids, np.int64).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), b"".join(texts)
                name, words = int.from_bytes(os.urandom(8), "little", signed=True), sum(len(t.split()) for t in texts)
                columns = [pa.array([name], pa.int64()), *(pa.array([x], pa.binary()) for x in (doc, size, pa.Codec("zstd", 3).compress(body, asbytes=True))), pa.array([words], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "docs", "sizes", "z", "n_words"])

        for batch in batches:
            valid = batch.column(0).is_valid().to_pylist()
            for known, doc, text in zip(valid, batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or b""
                if held + len(text) > limit:
                    yield from flush()
                    ids, texts, held = [], [], 0
                ids += [doc, 1] if known else [0, 0]
                texts.append(text)
                held += len(text) + 1
        yield from flush()

    return run


def _open(docs: bytes, sizes: bytes, z: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, words of each, and all words' hashes of a chunk."""
    ends = np.cumsum(np.frombuffer(sizes, np.int64))
    body = pa.Codec("zstd").decompress(z, int(ends[-1]), asbytes=True)
    words = list(word_hashes([body[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]))
    ids = [x if known else None for x, known in np.frombuffer(docs, np.int64).reshape(-1, 2).tolist()]
    return ids, np.array([len(w) for w in words], np.int64), np.concatenate(words)


def _inside(count: np.ndarray, n: int) -> np.ndarray:
    """Where an n-gram starts that lies within one document."""
    at = np.arange(max(int(count.sum()) - n + 1, 0))
    left = np.repeat(np.cumsum(count), count)[: len(at)] - at
    return left >= n


def _hashes_out(h: np.ndarray) -> bytes:
    """Ascending hashes as their differences: low bytes by place, then the compressed high bytes."""
    planes = np.ascontiguousarray(np.diff(h, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return planes[:PLAIN].tobytes() + zlib.compress(planes[PLAIN:].tobytes(), 1)


def _hashes_in(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(raw[: PLAIN * n] + zlib.decompress(raw[PLAIN * n :]), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _counts_out(c: np.ndarray) -> bytes:
    """Counts as a byte each, and those that don't fit behind them, compressed."""
    return zlib.compress(np.minimum(c, 255).astype(np.uint8).tobytes() + c[c >= 255].astype("<i8").tobytes(), 1)


def _counts_in(raw: bytes, n: int) -> np.ndarray:
    body = zlib.decompress(raw)
    c = np.frombuffer(body, np.uint8, n).astype(np.int64)
    c[c == 255] = np.frombuffer(body, "<i8", offset=n)
    return c


def _runs(changed: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs between changes in a sorted array; ``changed`` tells for each but the first."""
    first = np.flatnonzero(np.concatenate([np.ones(min(length, 1), bool), changed]))
    return first, np.diff(first, append=length)


def _sorted(h: np.ndarray) -> np.ndarray:
    """A stable argsort of evenly spread hashes: places are packed below their high bits, as numpy sorts plain values much faster."""
    low = np.uint64(max(len(h) - 1, 1).bit_length())
    by = np.sort(h >> low << low | np.arange(len(h), dtype=np.uint64)) & ((np.uint64(1) << low) - np.uint64(1))
    out = h[by]
    return by.astype(np.int64) if np.all(out[1:] >= out[:-1]) else np.argsort(h, kind="stable")


class _Order:
    """A chunk's n-grams of one order that can be in other documents, sorted by hash and then by document."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, n: int, shorter: np.ndarray | None):
        at = np.flatnonzero(_inside(sizes, n))
        if shorter is not None:  # an n-gram that another document has is made of two parts that it has, too
            at = at[(shorter[at] > 0) & (shorter[at + 1] > 0)]
        h = _grams(words, n)[at]
        by = _sorted(h)
        self.h, self.at, self.length = h[by], at[by], len(words)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)[self.at]
        self.first, self.times = _runs(self.h[1:] != self.h[:-1], len(self.h))

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes, and for each twice the times that the chunk has it, plus 1 if several of its documents do."""
        return self.h[self.first], 2 * self.times + (self.doc[self.first] != self.doc[self.first + self.times - 1])

    def others(self, counts: np.ndarray) -> np.ndarray:
        """For each word how often all other documents have the n-gram that starts there; ``counts``: of all documents, 0 if only one has it."""
        _, own = _runs((self.h[1:] != self.h[:-1]) | (self.doc[1:] != self.doc[:-1]), len(self.h))
        out = np.zeros(self.length, np.int64)
        out[self.at] = np.maximum(np.repeat(counts, self.times) - np.repeat(own, own), 0)
        return out


def _others(words: np.ndarray, sizes: np.ndarray, order: int, found: pa.Table) -> list[np.ndarray]:
    """What ``_Order.others`` says for each order up to ``order``, from the answers to a chunk."""
    out: list[np.ndarray] = []
    found = found.sort_by([("n", "ascending"), ("range", "ascending")])
    for n in range(1, order + 1):
        grams = _Order(words, sizes, n, out[-1] if out else None)
        answers = found.filter(pc.equal(found["n"], n))
        counts = [_counts_in(c, k) for c, k in zip(answers["c"].to_pylist(), answers["many"].to_pylist(), strict=True)]
        out.append(grams.others(np.concatenate([np.empty(0, np.int64), *counts])))
    return out


_ASKED = "range long, chunk long, many long, h binary, v binary"
_ANSWER = "chunk long, n long, range long, many long, c binary"


def _ask(n: int, bits: int):
    """A chunk's n-grams of order ``n``: a row for each range of their hashes, by the first ``bits``."""

    def run(fixed: pa.Table, found: pa.Table) -> pa.Table:
        rows = []
        for row in fixed.to_pylist():
            _, sizes, words = _open(row["docs"], row["sizes"], row["z"])
            shorter = _others(words, sizes, n - 1, found)[-1] if n > 1 else None
            h, v = _Order(words, sizes, n, shorter).asked()
            cuts = [0, *np.searchsorted(h, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist(), len(h)]
            rows += [(k, row["chunk"], b - a, _hashes_out(h[a:b]), _counts_out(v[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["range", "chunk", "many", "h", "v"])

    return run


def _ask_first(bits: int):
    """As ``_ask`` for words, which need no answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from _ask(1, bits)(pa.Table.from_batches([batch.slice(k, 1)]), None).to_batches()

    return run


def _answer(n: int):
    """For a range's n-grams, as each chunk asked, how often all documents have them; 0 if only one has."""

    def run(asked: pa.Table) -> pa.Table:
        many = asked["many"].to_numpy()
        h = np.concatenate([_hashes_in(*x) for x in zip(asked["h"].to_pylist(), many.tolist(), strict=True)])
        v = np.concatenate([_counts_in(*x) for x in zip(asked["v"].to_pylist(), many.tolist(), strict=True)])
        by = np.argsort(h)
        h = h[by]
        first, times = _runs(h[1:] != h[:-1], len(h))
        del h
        v = v[by]
        count, docs = np.add.reduceat(v >> 1, first), np.add.reduceat(1 + (v & 1), first)
        del v
        out = np.empty(len(by), np.int64)
        out[by] = np.repeat(np.where(docs > 1, count, 0), times)
        parts = [_counts_out(c) for c in np.split(out, np.cumsum(many)[:-1])]
        return pa.table({"chunk": asked["chunk"], "n": pa.array(np.full(len(many), n)), "range": asked["range"], "many": asked["many"], "c": pa.array(parts, pa.binary())})

    return run


def _score(order: int, total: int, backoff: float):
    """Scores of a chunk's documents, from the chunk and the answers to it."""
    logs = np.log(backoff)

    def run(fixed: pa.Table, found: pa.Table) -> pa.Table:
        parts = []
        for row in fixed.to_pylist():
            ids, sizes, words = _open(row["docs"], row["sizes"], row["z"])
            doc, length = np.repeat(np.arange(len(ids)), sizes), int(sizes.sum())
            others = dict(enumerate(_others(words, sizes, order, found), 1))
            rest = total - sizes[doc]
            # a word that no other document has takes the mass of one unseen word
            score = np.log(np.maximum(others[1], 1) / (np.maximum(rest, 0) + 1.0))
            level = (others[1] > 0).astype(np.int64)
            place = np.arange(length) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            for n in range(2, order + 1):
                # n-grams are noted at their first word; the scored word is n - 1 further on
                with_, context = np.zeros(length, np.int64), np.zeros(length, np.int64)
                with_[n - 1 :] = others[n][: max(length - n + 1, 0)]
                context[n - 1 :] = others[n - 1][: max(length - n + 1, 0)]
                hit = with_ > 0
                score = np.where(hit, np.log(np.maximum(with_, 1)) - np.log(np.maximum(context, 1)), score + np.where(place >= n - 1, logs, 0.0))
                level[hit] = n
            hits = np.bincount(doc, level == order, len(ids)).astype(np.int64)
            parts.append(pa.table({"id": pa.array(ids, pa.int64()), "n_words": pa.array(sizes), "n_known": pa.array(hits), "log_score": pa.array(np.bincount(doc, score, len(ids)).astype(np.float64))}))
        return pa.concat_tables(parts) if parts else pa.table({"id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64())})

    return run


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """Score each document against all the others' n-grams.

    Returns ``id_col, n_words, n_known, log_score, mean_score``: words (runs of bytes other than ASCII white
    space), words found with their longest context, the sum of log scores, and that sum for each word (null
    without words). The score of a word after its context is count(context word) / count(context), or
    ``backoff`` times the score with a context shorter by one; a document's own counts are left out, so a text
    isn't its own evidence; a word that no other document has counts as seen once. At the start of a document
    contexts are as long as there are words. Null text has no words. A null id is kept, and rows that repeat are
    documents of their own. An empty table gives no rows.

    What is sent grows in proportion to the text: some six bytes for each distinct n-gram of a chunk that may be in
    several documents, once one way, and about one back. Rows are chunks times ranges, both in proportion to the
    text: their number grows with its square, n-grams of a row shrink (some 400 at 50 GB of text). A very frequent
    n-gram is asked for once by each chunk. Chunks are stored bucketed by name, so that texts aren't sent at all.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    chunks = bucketed(base.mapInArrow(_chunks(CHUNK_BYTES), _CHUNK), "chunks", "chunk", deal=False)
    total = int(chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0])
    bits = max((total // RANGE_GRAMS).bit_length(), LEAST_BITS)
    packed = chunks.select("chunk", "docs", "sizes", "z")
    answers: list[DataFrame] = []
    for n in range(1, order + 1):
        if answers:
            asked = packed.groupBy("chunk").cogroup(reduce(DataFrame.union, answers).groupBy("chunk")).applyInArrow(_ask(n, bits), _ASKED)
        else:
            asked = packed.mapInArrow(_ask_first(bits), _ASKED)
        answers.append(stored(asked.groupBy("range").applyInArrow(_answer(n), _ANSWER), "answers"))
    found = reduce(DataFrame.union, answers)
    scored = packed.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_score(order, int(total), backoff), "id long, n_words long, n_known long, log_score double")
    return scored.select(F.col("id").alias(id_col), "n_words", "n_known", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_score"))


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    out = backoff_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("log_score", F.round("log_score", 3)).withColumn("mean_score", F.round("mean_score", 5))


def _counts_sql(name: str, keys: str, need: str) -> str:
    given = f" WHERE {need} IS NOT NULL"
    return f"{name} AS MATERIALIZED (SELECT {keys}, count(*) AS c FROM t{given} GROUP BY ALL), {name}d AS MATERIALIZED (SELECT rid, {keys}, count(*) AS c FROM t{given} GROUP BY ALL)"


SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS MATERIALIZED (SELECT rid, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] END AS p, CASE WHEN i > 2 THEN w[i - 2] END AS q FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
{_counts_sql('u', 'a', 'a')}, {_counts_sql('b', 'p, a', 'p')}, {_counts_sql('r', 'q, p, a', 'q')},
n AS (SELECT count(*) AS n FROM t),
s AS (SELECT t.rid, u.c - ud.c AS c1, coalesce(b.c - bd.c, 0) AS c2, coalesce(up.c - upd.c, 0) AS cp, coalesce(r.c - rd.c, 0) AS c3, coalesce(bq.c - bqd.c, 0) AS cq, t.p IS NOT NULL AS two, t.q IS NOT NULL AS three, n.n - len(d.w) AS rest
  FROM t JOIN d USING (rid) JOIN u ON u.a = t.a JOIN ud ON ud.rid = t.rid AND ud.a = t.a LEFT JOIN b ON b.p = t.p AND b.a = t.a LEFT JOIN bd ON bd.rid = t.rid AND bd.p = t.p AND bd.a = t.a
  LEFT JOIN u up ON up.a = t.p LEFT JOIN ud upd ON upd.rid = t.rid AND upd.a = t.p LEFT JOIN r ON r.q = t.q AND r.p = t.p AND r.a = t.a LEFT JOIN rd ON rd.rid = t.rid AND rd.q = t.q AND rd.p = t.p AND rd.a = t.a
  LEFT JOIN b bq ON bq.p = t.q AND bq.a = t.p LEFT JOIN bd bqd ON bqd.rid = t.rid AND bqd.p = t.q AND bqd.a = t.p, n),
y AS (SELECT rid, c3, CASE WHEN c3 > 0 THEN ln(c3) - ln(greatest(cq, 1)) ELSE CASE WHEN three THEN ln({BACKOFF}) ELSE 0 END
  + CASE WHEN c2 > 0 THEN ln(c2) - ln(greatest(cp, 1)) ELSE CASE WHEN two THEN ln({BACKOFF}) ELSE 0 END + ln(greatest(c1, 1) / (rest + 1.0)) END END AS v FROM s),
x AS (SELECT rid, count(*) AS n, count(*) FILTER (c3 > 0) AS k, sum(v) AS s FROM y GROUP BY rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(k, 0)::BIGINT AS n_known, round(coalesce(s, 0.0)::DOUBLE, 3) AS log_score, round((s / n)::DOUBLE, 5) AS mean_score FROM d LEFT JOIN x USING (rid)
"""
