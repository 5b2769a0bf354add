"""Hash manifest against a model built list by list."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, path string, Levels int, tree int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text=None):
    return h(*map(field, (row[0], row[1], row[2], row[3], row[4] if text is None else text)))


def tree(leaves):
    """The root, and each leaf's path of (left, right)."""
    paths, level, of = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, at in enumerate(of):
            run = level[at // 3 * 3 : at // 3 * 3 + 3]
            paths[k].append(("".join(run[: at % 3]), "".join(run[at % 3 + 1 :])))
        level, of = [h(*level[i : i + 3]) for i in range(0, len(level), 3)], [at // 3 for at in of]
    return level[0], paths


def model(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        members = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[s] = members, *tree([leaf(r) for r in members])
    root, tops = tree([built[s][1] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        members, subroot, paths = built[s]
        for r, path in zip(members, paths, strict=True):
            chosen = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf(r, r[4].replace("\n", "") if chosen and r[4] is not None else None)
            for a, b in path + top:
                now = h(a, now, b)
            out.append((r[0], leaf(r), subroot, root, h(*(a + b for a, b in path + top)), now, now == root))
    return out


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return merkle.op11_merkle_manifest(spark, str(tmp_path))


def rows_of(sizes):
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i * 7 % 1009, s, "en", 3, f"text {i}\nü\n", "p", 1, 2))
            i += 1
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 3}, {"a": 4, None: 28, "": 2}, {f"s{i}": 1 for i in range(30)}, {"hot": 760, "é": 27, "Z": 82, "z": 9, None: 1}])
def test_proofs_are_the_model_s(spark, tmp_path, sizes):
    rows = rows_of(sizes)
    got = run(spark, tmp_path, rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(model(rows), key=str)


def test_awkward_rows(spark, tmp_path):
    """Nulls in any column, an empty and a long text, rows that repeat, equal ids with other texts, a null id; names that clash."""
    rows = rows_of({"a": 5}) + [(None, None, None, None, None, None, None, None), (2000, "a", None, None, "", "", 0, 0), (2001, "a", "", 0, "x\n" * 200_000, "", 0, 0)]
    rows += [(3000, "a", "en", 1, "same\n", "", 0, 0)] * 3 + [(3000, "a", "en", 1, "other", "", 0, 0), (3001, "b", "en", 1, None, "", 0, 0), (None, "a", "en", 1, "q\n", "", 0, 0)]
    got = run(spark, tmp_path, rows).collect()
    assert sorted(map(tuple, got), key=str) == sorted(model(rows), key=str)
    assert not all(r.verified for r in got) and any(r.verified for r in got)


def test_empty_table(spark, tmp_path):
    got = run(spark, tmp_path, [])
    assert got.count() == 0 and got.columns[:4] == ["doc_id", "leaf", "subroot", "root"]


def test_other_columns_stay_and_a_changed_row_fails(spark):
    base = spark.range(100).select(F.col("id"), (F.col("id") % 3).cast("string").alias("G"), F.lit("x").alias("path2"), F.lit(1).alias("d"))
    leaves = base.withColumn("leaf", merkle.leaf_of(base, ("id", "G", "d")))
    out = merkle.proofs(leaves, "G", "id", "leaf")
    assert set(out.columns) == {"id", "G", "leaf", "path2", "d", "subroot", "root", "path"}
    good = out.withColumn("same", merkle.folded(F.col("leaf"), F.col("path")) == F.col("root"))
    assert good.where("same").count() == 100
    bad = out.withColumn("same", merkle.folded(F.sha2(F.concat("leaf", F.lit("!")).cast("binary"), 256), F.col("path")) == F.col("root"))
    assert bad.where("same").count() == 0
