"""Near-duplicate documents by one-permutation MinHash, confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import bucketed, components, free_name, small, stored
from gaugeworks.llm.hashing import mix, pair, word_hashes

#: Fixed: with r rows a band, two sets of similarity 0.8 miss all BANDS bands with (1 - 0.8**ROWS)**BANDS = 2e-9.
ROWS, BANDS = 5, 51
_PROBES = 64
#: Members of one component whose sizes differ by less than this factor share an anchor.
CLASS = 1.1


def _probe_table(bins: int) -> np.ndarray:
    """For each bin the bins that it looks in, one after the other, while it is empty."""
    at = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(_PROBES) + np.arange(_PROBES, dtype=np.uint64)[None, :]
    return (mix(at + np.uint64(77)) % np.uint64(bins)).astype(np.int64)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; of fewer words, the whole sequence is one shingle."""
    if not len(words):
        return words
    size = min(size, len(words))
    h = mix(words[: len(words) - size + 1] + np.uint64(1))
    for k in range(1, size):
        h = pair(h, words[k : len(words) - size + 1 + k])
    return np.unique(h)


def _bin_edges(bins: int) -> np.ndarray:
    return np.array([min((i << 64) // bins, (1 << 64) - 1) for i in range(bins + 1)], np.uint64)


def signature(shingles: np.ndarray, edges: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """One permutation: the least hash of each bin; an empty bin borrows from the first full one on its own probe path."""
    first = np.searchsorted(shingles, edges)
    full = first[:-1] < first[1:]
    out = shingles[np.minimum(first[:-1], len(shingles) - 1)]
    empty = np.flatnonzero(~full)
    for t in range(probes.shape[1]):
        if not len(empty):
            break
        source = probes[empty, t]
        hit = full[source]
        out[empty[hit]] = shingles[first[source[hit]]]
        empty = empty[~hit]
    if len(empty):  # few full bins: the next full one to the right
        where = np.flatnonzero(full)
        out[empty] = shingles[first[where[np.searchsorted(where, empty) % len(where)]]]
    return out


def _words(texts: list) -> Iterator[np.ndarray]:
    return word_hashes([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts])


def _sketch(size: int, rows: int, bands: int):
    bins = rows * bands
    probes, edges = _probe_table(bins), _bin_edges(bins)
    salt = mix(np.arange(bands, dtype=np.uint64) + np.uint64(11))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, prints, keys = [], [], []
            for words in _words(batch.column(1).to_pylist()):
                s = shingle_set(words, size)
                n.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if len(s):
                    sig = signature(s, edges, probes).reshape(bands, rows)
                    h = salt
                    for k in range(rows):
                        h = pair(h, sig[:, k])
                    keys.append(h.view(np.int64))
                else:
                    keys.append(np.empty(0, np.int64))
            offsets = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "n", "print", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(w, size).view(np.int64) for w in _words(batch.column(1).to_pylist())]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "s"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """Link documents whose ``shingle``-word sets have a Jaccard similarity of at least ``percent`` / 100.

    Returns ``id_col, n_shingles, component_id, kept``: the size of the set, the smallest id reachable
    through links, and whether the document is the one that stays.

    Steps: (1) each set gets a one-permutation MinHash with optimal densification; sets that are equal
    (128-bit digest) fold into their smallest id, so copies cost one row each from here. (2) Documents
    that share a band are in a bucket. Its smallest id is the centre of a star: only centre and member
    are compared, on full sets. (3) Members of a bucket that are still in different components may yet be
    linked. They are held against a pivot, the set of shingles that most of the bucket's largest component
    have. Two members can only be similar if they share a shingle that the pivot lacks, one of their rarest
    there, or if each shares enough with the pivot. First each is compared with one member for each such
    shingle and with the largest component's nearest to the pivot, one for each class of sizes; components
    that this links are one from there on. Then members of those that are still apart are compared if
    they meet one of the two conditions. No other two can be that similar, so no pair that shares a band
    is lost; a pair is only made between components without a link found so far.

    Null or wordless text: set size 0, linked with nothing. A null id is returned with a null component
    and kept. Rows that repeat an id are one node. An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    sketch = stored(base.mapInArrow(_sketch(shingle, rows, bands), "id long, n long, print binary, bands array<long>"), "sketch")
    live = sketch.where("n > 0 AND id IS NOT NULL")
    classes = stored(live.groupBy("print").agg(F.min("id").alias("rep")), "classes")
    member = sketch.select("id", "n", "print").join(classes, "print", "left")
    member = stored(member.select("id", "n", F.when(F.col("n") > 0, F.coalesce("rep", "id")).otherwise(F.col("id")).alias("rep")), "member")
    # ids that stand for no class; few enough to be broadcast, they keep the bands of all others from a shuffle
    copies = stored(member.where("id <> rep").select("id").distinct().join(classes.select(F.col("rep").alias("id")), "id", "left_anti"), "copies")
    banded = live.join(small(copies), "id", "left_anti").select("id", "n", F.explode("bands").alias("key"))
    # stored, so that the join with a band that very many documents share can be split
    crowded = stored(banded.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"), "crowded")
    buckets = stored(banded.join(crowded, "key").distinct(), "buckets")
    wanted = stored(buckets.select("id").distinct(), "wanted")
    sets = bucketed(base.join(small(wanted), "id", "left_semi").mapInArrow(_sets(shingle), "id long, s array<long>"), "sets", "id")

    def linked(pairs: DataFrame) -> DataFrame:
        """Pairs ``a, b`` whose sets are similar. ``a`` may be hot: both sides of its join are dealt anew, so that it can be split."""
        pairs = stored(pairs.where("a <> b").distinct(), "pairs")
        heads = pairs.select(F.col("a").alias("id")).distinct().join(sets, "id").select(F.col("id").alias("a"), F.col("s").alias("sa"))
        both = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(stored(heads, "heads"), "a")
        shared = F.size(F.array_intersect("sa", "sb"))
        return both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b")

    def labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
        """``c``: the component of each row's ``id``."""
        return rows.join(components(links).select(F.col("a").alias("id"), F.col("b").alias("c")), "id", "left").withColumn("c", F.coalesce("c", "id"))

    centre = stored(buckets.groupBy("key").agg(F.min(F.struct("id", "n")).alias("m")).select("key", F.col("m.id").alias("a"), F.col("m.n").alias("an")), "centre")
    sized = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    links = stored(linked(buckets.join(centre, "key").where(sized("n", "an")).select("a", F.col("id").alias("b"))), "links")

    # what is grouped by a component, bucket or pivot is stored before it is joined, so that a hot one can be split
    named = stored(labelled(wanted, links), "named")
    size = stored(named.groupBy("c").agg(F.count("*").alias("size")), "size")
    named = stored(named.join(size, "c"), "named")
    held = stored(buckets.select("key", "id").join(named, "id"), "held")
    pivot = held.groupBy("key").agg(F.max(F.struct("size", (-F.col("c")).alias("minus"))).alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
    pivot = stored(pivot.select("key", (-F.col("m.minus")).alias("p")), "pivot")
    attached = stored(held.join(pivot, "key").select("p", "id", F.col("c").alias("was")).distinct(), "attached")
    bodies = named.join(stored(attached.select(F.col("p").alias("c")).distinct(), "centres"), "c", "left_semi")
    common = bodies.join(sets, "id").select("c", "size", F.explode("s").alias("s")).groupBy("c", "size", "s").agg(F.count("*").alias("k")).where("2 * k > size")
    pivots = stored(common.groupBy(F.col("c").alias("p")).agg(F.collect_list("s").alias("ps")), "pivots")
    # a component that drifts may have no shingle in common: its pivot is empty, and all its shingles are extra
    around = attached.join(sets, "id").join(pivots, "p", "left").withColumn("ps", F.coalesce("ps", F.array().cast("array<long>")))
    around = stored(around.select("p", "id", "was", F.size("s").alias("n"), F.size(F.array_intersect("s", "ps")).alias("o"), F.array_except("s", "ps").alias("extra")), "around")
    enough = lambda overlap, n, m: (100 + percent) * overlap >= percent * (n + m)
    # of a member's shingles beyond the pivot, a partner shares at least what the pivot leaves it short of; so
    # one of the rarest few is shared, and only those are looked up. What two share beyond the pivot are the first
    # that they share in that order and some of what comes later in both ("later").
    short = F.greatest(F.ceil(F.col("n") * percent / 100) - F.col("o"), F.lit(1))
    beyond = stored(around.select("p", "id", "was", "n", "o", F.size("extra").alias("k"), F.xxhash64("extra").alias("row"), F.explode("extra").alias("s")), "extras")
    often = stored(beyond.groupBy("p", "s").agg(F.count("*").alias("often")).where("often > 1"), "often")
    beyond = beyond.join(often, ["p", "s"], "left").withColumn("often", F.coalesce("often", F.lit(1)))
    # rows that repeat an id have a set each, or the same one again
    place = F.dense_rank().over(Window.partitionBy("p", "id", "n", "o", "row").orderBy("often", "s"))
    beyond = beyond.withColumn("rank", place).withColumn("later", F.col("k") - F.col("rank"))
    beyond = stored(beyond.where((F.col("rank") <= F.col("k") - short + 1) & (F.col("often") > 1)).select("p", "s", "id", "was", "n", "o", "later"), "beyond")

    # before any two members are paired, components that have a cheap link become one: each row is held against one
    # member only, the smallest id that shares its shingle or the pivot's own member of about its size nearest to the pivot
    head = beyond.groupBy("p", "s").agg(F.min(F.struct("id", "was", "n", "o", "later")).alias("m"))
    head = stored(head.select("p", "s", *[F.col(f"m.{c}").alias(f"{c}_h") for c in ("id", "was", "n", "o", "later")]), "heads_by_extra")
    by_head = beyond.join(head, ["p", "s"]).where((F.col("was") != F.col("was_h")) & sized("n", "n_h"))
    by_head = by_head.where(enough(F.least("o", "o_h") + 1 + F.least("later", "later_h"), F.col("n"), F.col("n_h")))
    anchor = around.where("was = p").groupBy("p", F.floor(F.log("n") / math.log(CLASS)).alias("class"))
    anchor = anchor.agg(F.max(F.struct("o", (-F.col("id")).alias("minus"), "n")).alias("m"))
    anchor = stored(anchor.select("p", (-F.col("m.minus")).alias("id_h"), F.col("m.n").alias("n_h"), F.col("m.o").alias("o_h")), "anchors")
    by_anchor = around.where("was <> p").select("p", "id", "n", "o").join(anchor, "p").where(sized("n", "n_h"))
    by_anchor = by_anchor.where(enough(F.least("o", "o_h") + F.least(F.col("n") - F.col("o"), F.col("n_h") - F.col("o_h")), F.col("n"), F.col("n_h")))
    tried = stored(by_head.select(F.col("id_h").alias("a"), F.col("id").alias("b")).union(by_anchor.select(F.col("id_h").alias("a"), F.col("id").alias("b"))).distinct(), "tried")
    grown = components(links.union(stored(linked(tried), "near")))
    now = wanted.join(grown.select(F.col("a").alias("id"), F.col("b").alias("c")), "id", "left").withColumn("c", F.coalesce("c", "id"))
    now = stored(now, "now")
    of_pivot = now.select(F.col("id").alias("p"), F.col("c").alias("cp"))

    # what is left are members of components without such a link; f isn't in the pivot's
    other = (F.col("c") != F.col("cf")) & ((F.col("c") == F.col("cp")) | (F.col("f") < F.col("id"))) & sized("nf", "n")
    as_f = [F.col("id").alias("f"), F.col("n").alias("nf"), F.col("o").alias("of"), F.col("c").alias("cf")]
    beyond = stored(beyond.drop("was").join(now, "id").join(of_pivot, "p"), "beyond")
    mine = beyond.where("c <> cp").select("p", "s", *as_f, F.col("later").alias("later_f"))
    most = F.least("of", "o") + 1 + F.least("later_f", "later")
    by_extra = mine.join(beyond, ["p", "s"]).where(other & enough(most, F.col("nf"), F.col("n"))).select("f", "id")
    # both share at least the overlap that their sizes ask for with the pivot
    x = stored(around.select("p", "id", "n", "o").join(now, "id").join(of_pivot, "p"), "x")
    room = F.floor(F.lit(100 + percent) * F.col("of") / percent - F.col("nf")).cast("int")
    fits = x.where("c <> cp").select("p", *as_f).withColumn("lo", F.ceil(F.col("nf") * percent / 100).cast("int"))
    fits = fits.withColumn("hi", F.least(room, F.ceil(F.col("nf") * 100 / percent).cast("int"))).where("lo <= hi")
    by_pivot = fits.select("p", "f", "nf", "of", "cf", F.explode(F.sequence("lo", "hi")).alias("n")).join(x.withColumn("n", F.col("n").cast("int")), ["p", "n"])
    by_pivot = by_pivot.where(other & enough(F.least("of", "o"), F.col("nf"), F.col("n"))).select("f", "id")
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    pairs = by_extra.union(by_pivot).select(*ordered("f", "id")).distinct().join(tried.select(*ordered("a", "b")), ["a", "b"], "left_anti")
    comp = components(grown.union(stored(linked(pairs), "links")))
    roots = comp.select(F.col("a").alias("rep"), F.col("b").alias("root"))
    out = member.join(roots, "rep", "left").withColumn("component_id", F.coalesce("root", "rep"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate component: the one with the smallest id; rows without id stay."""
    name = free_name(docs, "gone")
    gone = near_duplicates(docs, id_col, text_col, **options).where(~F.col("kept")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(small(stored(gone, "gone")), F.col(id_col).cast("long") == F.col(name), "left_anti")
