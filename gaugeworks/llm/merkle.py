"""A manifest of hashes over a table, and a proof of membership for each row.

Rows are leaves of one tree for each group; the trees' roots are leaves of a tree of trees. Every node carries the
interval of leaf ranks that it covers. Trees grow by blocks of FAN ** STEP neighbouring nodes, which one row holds with
all levels between; ancestors are attached from the root down by containment joins, bucketed by the blocks' width at
their level. A node's siblings are the nodes that make up its parent's interval less its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeworks.llm.common import free_name, small, stored

FAN, STEP = 3, 3
WIDTH = FAN**STEP


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after another; digests count as hex text."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the size in bytes, a colon and the value, so that neighbours can't be confused."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along its path."""
    return F.aggregate(path, leaf, lambda now, x: digest(x["l"], now, x["r"]))


def proof(path: Column) -> Column:
    """One digest of all siblings, from the leaf's level up and from left to right."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), ""))


def _ranked(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with its place in the whole order as ``rank``, from 0.

    Rows are sorted by ranges and stored with their places within a range; only the ranges' sizes, one number for each
    partition, are added up on the driver.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    sorted_ = stored(sorted_, "ranked").withColumn("part", F.shiftright("at", 33))
    starts, total = [], 0
    for row in sorted(sorted_.groupBy("part").agg(F.count("*").alias("n")).collect()):
        starts.append((row["part"], total))
        total += row["n"]
    start = spark.createDataFrame(starts, "part long, start long")
    place = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_.join(F.broadcast(start), "part").withColumn("rank", place).drop("part", "at", "start")


def _once(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _parents(nodes: Column) -> Column:
    """The level above: each FAN neighbours' interval and digest."""

    def of(run: Column) -> Column:
        inside = F.array_join(F.transform(run, lambda x: x["d"]), "")
        return F.struct(run[0]["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"), digest(inside).alias("d"))

    runs = F.sequence(F.lit(0), ((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: _once(F.slice(nodes, i * FAN + 1, F.lit(FAN)), of))


def _grow(leaves: DataFrame, keep: list[str]) -> list[DataFrame]:
    """Blocks by round, each stored: ``tree, n, lo, hi, last, levels, top`` and, of the first round, ``kept``.

    ``leaves(tree, n, lo, hi, d, *keep)`` are a tree's nodes, n in number, with intervals of one rank. The levels of a
    block begin with its own nodes. A tree ends with the round in which it has one block (``last``): that block climbs
    to one node, and every other one STEP levels, however few nodes it has.
    """
    rounds: list[DataFrame] = []
    most = leaves.agg(F.max("n")).first()[0] or 1
    nodes, width = leaves, 1
    while True:
        left = F.ceil(F.col("n") / width)
        steps = reduce(lambda a, b: a + b, [(left > FAN**k).cast("int") for k in range(STEP)])
        row = F.struct(F.struct("lo", "hi", "d").alias("x"), F.struct(*(keep if not rounds else [])).alias("kept")) if keep and not rounds else F.struct(F.struct("lo", "hi", "d").alias("x"))
        block = nodes.groupBy("tree", (F.floor(F.col("lo") / (width * WIDTH))).alias("bucket")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(row)).alias("rows"))
        own = F.array(F.transform("rows", lambda x: x["x"]))
        climb = F.filter(F.lit(list(range(1, STEP + 1))), lambda k: k <= F.col("steps"))
        levels = F.aggregate(climb, own, lambda now, _: F.concat(now, F.array(_parents(F.element_at(now, -1)))))
        block = block.withColumn("steps", steps).withColumn("levels", levels).withColumn("last", left <= WIDTH)
        kept = [F.transform("rows", lambda x: x["kept"]).alias("kept")] if keep and not rounds else []
        ends = [F.col("levels")[0][0]["lo"].alias("lo"), F.element_at(F.col("levels")[0], -1)["hi"].alias("hi"), F.element_at("levels", -1)[0]["d"].alias("top")]
        rounds.append(stored(block.select("tree", "n", "last", "levels", *ends, *kept), "blocks"))
        width *= WIDTH
        if width >= most:
            return rounds
        nodes = rounds[-1].where("NOT last").select("tree", "n", "lo", "hi", F.col("top").alias("d"))


def _siblings(lo: Column, hi: Column, levels: Column) -> Column:
    """For each level of a block what stands left and right of [lo, hi)'s ancestor there within its parent."""

    def joined(level: Column, inside) -> Column:
        return F.array_join(F.transform(F.filter(level, inside), lambda y: y["d"]), "")

    def of(above: Column, i: Column) -> Column:
        holder = F.filter(above, lambda p: (p["lo"] <= lo) & (hi <= p["hi"]))[0]
        left = lambda p: joined(levels[i], lambda y: (y["lo"] >= p["lo"]) & (y["hi"] <= lo))
        right = lambda p: joined(levels[i], lambda y: (y["lo"] >= hi) & (y["hi"] <= p["hi"]))
        return _once(holder, lambda p: F.struct(left(p).alias("l"), right(p).alias("r")))

    return F.transform(F.slice(levels, F.lit(2), F.lit(STEP)), of)


def _attach(rounds: list[DataFrame], tops: DataFrame, keep: list[str]) -> DataFrame:
    """Leaves with the path of siblings up through ``tops(tree, subroot, path)``, by one containment join for each round."""
    found = None
    for t in reversed(range(len(rounds))):
        width, blocks = WIDTH ** (t + 1), rounds[t]
        columns = ["levels", "path", "tree", "subroot", *(["kept"] if keep and t == 0 else [])]
        opened = blocks.where("last").join(tops, "tree").select(*columns)
        if found is not None:
            above, below = found.alias("p"), blocks.where("NOT last").alias("c")
            bucket = lambda side: F.floor(F.col(f"{side}.lo") / width)
            inside = (F.col("c.tree") == F.col("p.tree")) & (bucket("c") == bucket("p")) & (F.col("p.lo") <= F.col("c.lo")) & (F.col("c.hi") <= F.col("p.hi"))
            opened = opened.union(below.join(above, inside).select("c.levels", "p.path", "c.tree", "p.subroot", *(["c.kept"] if keep and t == 0 else [])))
        each = opened.select("*", F.posexplode(F.col("levels")[0]).alias("at", "x"))
        payload = [F.col("kept")[F.col("at")][k].alias(k) for k in keep] if t == 0 else []
        path = F.concat(_siblings(F.col("x.lo"), F.col("x.hi"), F.col("levels")), F.col("path"))
        found = each.select("tree", "subroot", "x.lo", "x.hi", "x.d", path.alias("path"), *payload)
        found = stored(found, "paths") if t else found
    return found


def proofs(leaves: DataFrame, group_col: str, id_col: str, leaf_col: str) -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` and ``path``, an array of ``l`` and ``r``: siblings on either side, from the leaf up.

    Leaves of a group ascend by id (null first), then digest; groups ascend bytewise (null first). Rows that repeat are
    leaves of their own. An empty table gives no rows. Other columns are kept, whatever they are called.

    No task holds more than a block: a group's leaves are ranked by ranges, and a group with any share of all rows meets in
    blocks of WIDTH. Paths are attached to blocks, so each is sent once for WIDTH leaves.
    """
    names = [c for c in leaves.columns if c not in (group_col, id_col, leaf_col)]
    plain = leaves.select(F.col(group_col).alias("g"), F.col(id_col).alias("i"), F.col(leaf_col).alias("d"), F.struct(*[F.col(f"`{c}`") for c in names] or [F.lit(0)]).alias("more"))
    placed = _ranked(stored(plain.withColumn("tie", F.monotonically_increasing_id()), "leaves"), "g", "i", "d", "tie")
    groups = stored(placed.groupBy("g").agg(F.min("rank").alias("tree"), F.count("*").alias("n")), "groups")
    of = small(groups.withColumnRenamed("g", "of"))
    rank = F.col("rank") - F.col("tree")
    nodes = placed.join(of, F.col("g").eqNullSafe(F.col("of"))).select("tree", "n", rank.alias("lo"), (rank + 1).alias("hi"), "d", "g", "i", "more")
    trees = _grow(nodes, ["g", "i", "more"])
    roots = reduce(DataFrame.union, [r.where("last").select("tree", F.col("top").alias("d")) for r in trees])
    n_groups = groups.count()
    forest = _ranked(roots, "tree").select(F.lit(0).cast("long").alias("tree"), F.lit(n_groups).cast("long").alias("n"), F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "d", F.col("tree").alias("of"))
    crown = _grow(forest, ["of"])
    first = crown[-1].where("last").select("top").first()
    root = first["top"] if first else ""
    none = F.array().cast("array<struct<l:string,r:string>>")
    ground = leaves.sparkSession.range(1).select(F.lit(0).cast("long").alias("tree"), F.lit(root).alias("subroot"), none.alias("path"))
    tops = stored(_attach(crown, ground, ["of"]).select(F.col("of").alias("tree"), F.col("d").alias("subroot"), "path"), "tops")
    out = _attach(trees, tops, ["g", "i", "more"])
    return out.select(F.col("g").alias(group_col), F.col("i").alias(id_col), F.col("d").alias(leaf_col), *[F.col("more")[c].alias(c) for c in names], "subroot", F.lit(root).alias("root"), "path")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(docs: DataFrame, fields: tuple[str, ...] = FIELDS, **instead: Column) -> Column:
    """A row's digest over ``fields``, some of them replaced."""
    return digest(*[field(instead.get(c, docs[c])) for c in fields])


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every document's proof, checked with a text that lost its line ends for about every other id.

    A null id is no tampered one. Null fields and empty ones differ.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(chosen, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    leaves = docs.select("doc_id", "source", leaf_of(docs).alias("leaf"), leaf_of(docs, text=text).alias("found"))
    out = proofs(leaves, "source", "doc_id", "leaf").withColumn("folded_root", folded(F.col("found"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = " || ".join(_FIELD.format(c) for c in FIELDS[:-1])
SQL = f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS tab),
c AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS k FROM documents, crc),
a AS (SELECT *, CASE WHEN k % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS found FROM c),
l AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS rid FROM (SELECT doc_id, source, sha256({_LEAF} || {_FIELD.format("text")}) AS leaf, sha256({_LEAF} || {_FIELD.format("found")}) AS found FROM a)),
x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY rid) - 1 AS r, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM l),
t AS (SELECT 0 AS k, s, r AS i, leaf AS d, n FROM x UNION ALL SELECT k + 1, s, i // 3, sha256(string_agg(d, '' ORDER BY i)), first((n + 2) // 3) FROM t WHERE n > 1 GROUP BY k, s, i // 3),
g AS (SELECT s, max(k) AS top, first(d ORDER BY k DESC) AS subroot FROM t GROUP BY s),
u AS (SELECT 0 AS k, s AS i, subroot AS d, count(*) OVER () AS n FROM g UNION ALL SELECT k + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), first((n + 2) // 3) FROM u WHERE n > 1 GROUP BY k, i // 3),
w AS (SELECT first(d) AS root, max(k) AS top FROM u WHERE n = 1),
p AS (SELECT x.rid, t.k, coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i < x.r // (3 ** t.k)::BIGINT), '') AS a, coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i > x.r // (3 ** t.k)::BIGINT), '') AS b
    FROM x JOIN g USING (s) JOIN t ON t.s = x.s AND t.k < g.top AND t.i // 3 = x.r // (3 ** (t.k + 1))::BIGINT GROUP BY x.rid, t.k
  UNION ALL SELECT x.rid, u.k + g.top, coalesce(string_agg(u.d, '' ORDER BY u.i) FILTER (u.i < x.s // (3 ** u.k)::BIGINT), ''), coalesce(string_agg(u.d, '' ORDER BY u.i) FILTER (u.i > x.s // (3 ** u.k)::BIGINT), '')
    FROM x JOIN g USING (s), w JOIN u ON u.k < w.top WHERE u.i // 3 = x.s // (3 ** (u.k + 1))::BIGINT GROUP BY x.rid, u.k, g.top),
q AS MATERIALIZED (SELECT * FROM p),
f AS (SELECT rid, 0 AS k, found AS d FROM x UNION ALL SELECT f.rid, f.k + 1, sha256(q.a || f.d || q.b) FROM f JOIN q ON q.rid = f.rid AND q.k = f.k),
e AS (SELECT rid, first(d ORDER BY k DESC) AS folded_root FROM f GROUP BY rid),
o AS (SELECT rid, string_agg(a || b, '' ORDER BY k) AS path FROM q GROUP BY rid)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(path, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM x JOIN g USING (s) JOIN e USING (rid) LEFT JOIN o USING (rid), w
"""
