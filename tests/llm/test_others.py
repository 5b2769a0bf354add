"""HTML, shards, preferences and the pipeline."""

import pytest
from tests.llm.data import documents, frame

import corpus_pipeline
from gaugeworks.llm import common, html_text, preferences, shards


@pytest.mark.parametrize(("page", "text"), [
    ("<p>one<p>two", "one\n\ntwo"), ("a<br>b<br><br>c", "a\nb\n\nc"), ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
    ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"), ("<table><tbody><tr><th>h</th><td>1<br>2</td></tr></tbody></table>", "h  1\n   2"),
    ("<pre>a\n  b</pre>", "a\n  b"), ("x<span hidden>n</span><div style='display: none'>n</div><script>n</script><style>n</style><!-- n -->y", "xy"), ("&amp;&lt;&eacute;&#65;", "&<éA"),
    ("<b>a <i>b</b> c</i>", "a b c"), ("</p></div>a</b>", "a"), ("<div>a<div>b</div></div>c", "a\nb\nc"), ("<title>t</title><body>b", "b"), ("<details><summary>s</summary>no</details>e", "s\ne"),
    ("<p>a  \n b</p>", "a b"), ("", ""), (None, ""), ("a < b", "a < b"), ("<p", ""), ("<a href='>'>x</a>", "x"), ("<div>" * 3000 + "deep", "deep"),
])
def test_visible_text(spark, page, text):
    got = html_text.visible_text(spark.createDataFrame([(1, page), (None, page)], "page_id long, html string")).collect()
    assert [r.text for r in got] == [text] * 2 and got[0].n_chars == len(text)


def test_no_visible_word_is_lost(spark):
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    shown = {r.page_id: r.text for r in html_text.visible_text(pages).collect()}
    for r in pages.collect():
        body = re.sub(r"(?s)<(script|style|title)\b.*?</\1>|<!--.*?-->", " ", r.html)
        import html

        words = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        assert [w for w in shown[r.page_id].split() if w != "-"] == [w for w in words if w != "-"]


def test_shards_keep_all_rows(spark):
    docs = frame(spark).repartition(8)
    out, store = shards.sharded(docs, rows_per_shard=2)
    version, live = store.load()
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    assert len(live) < store.fan and version > 1
    first = store.load(1)[1]
    assert len(first) > len(live) and not set(first) & set(live)
    assert shards.sharded(docs.limit(0))[0].count() == 0


def test_a_lost_race_changes_nothing(spark):
    store = shards.ShardStore(spark, common.shared_folder(spark) + "/race")
    store.append(frame(spark))
    seen, live = store.load()
    store.append(frame(spark))
    with pytest.raises(Exception, match="(?i)exist"):
        store.commit(seen, [shards.Shard("x", 1)])
    assert store.load()[0] == seen + 1 and store.read().count() == 2 * frame(spark).count() and store.read(seen).count() == frame(spark).count()


def test_shard_query_columns(spark, tmp_path):
    import hashlib

    rows = documents()
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = shards.op6_sharding(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), str(r.n_bytes), r.text_sha256) for r in got) == sorted((str(i), str(None if t is None else len(t.encode())), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)
    assert len({r.version for r in got}) == 1 and got[0].version >= shards.ARRIVALS
    sizes = {r.shard: r.shard_bytes for r in got}
    assert min(sizes) >= 0 and all(b > 0 for b in sizes.values())


def test_vacuum_spares_promised_versions_and_young_data(spark):
    docs = frame(spark)
    out, store = shards.sharded(docs, rows_per_shard=20)
    assert all(store.read(v).count() <= docs.count() for v in store.versions()) and store.read(1).count() < docs.count()
    store._write(docs)  # not committed yet
    assert store.vacuum() == 0
    last = store.versions()[-1]
    assert store.vacuum(versions=2, young_s=0) > 0
    assert store.versions() == [last - 1, last] and store.read().count() == docs.count() and store.read(last - 1).count() == docs.count()
    with pytest.raises(Exception):  # noqa: B017
        store.read(1)


def test_tiers(spark):
    store = shards.ShardStore(spark, common.shared_folder(spark) + "/tiers", target_bytes=1000, smallest=10)
    small, large = [shards.Shard(str(i), 5) for i in range(4)], [shards.Shard("b", 400)]
    assert store.due(small[:3] + large) == [] and store.due(small + large) == small
    assert store.due([shards.Shard(str(i), 600) for i in range(9)]) == []
    assert [store.tier(shards.Shard("", b)) for b in (0, 9, 10, 39, 40, 160)] == [0, 0, 1, 1, 2, 3]


TURNS = "conv_id long, turn long, role string, text string"


def test_preferences(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "why"), (1, 3, "assistant", "so"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (2, 2, "user", "bye"), (3, 0, "user", "alone"), (4, 0, "system", None), (4, 1, None, "x<|y"), (4, 2, "assistant", "z"), (5, 0, "user", "hi"), (5, 1, "assistant", "yes"), (5, 2, "user", "why"), (5, 3, "assistant", "so")]
    got = {r.id: r for r in preferences.formatted(preferences.preference_pairs(spark.createDataFrame(rows, TURNS))).collect()}
    assert sorted(got) == [1, 2, 4, 5]
    one = got[1]
    assert (one.other_id, one.n_prompt_turns, one.chosen_text, one.rejected_text) == (None, 3, "<|assistant|>\nso\n<|end|>\n", "<|assistant|>\nyes\n<|end|>\n")
    assert one.prompt == "<|user|>\nhi\n<|end|>\n<|assistant|>\nyes\n<|end|>\n<|user|>\nwhy\n<|end|>\n"
    a, b = map(int, one.chosen_mask.split(":"))
    assert one.chosen_text[a:b] == "so\n<|end|>\n"
    two = got[2]
    assert (two.other_id, two.n_prompt_turns) == (1, 1) and two.rejected_text.startswith("<|assistant|>\nyes") and len(two.rejected_mask.split(",")) == 2
    assert got[4].rejected_text == "<|assistant|>\n\n<|end|>\n" and "x< |y" in got[4].prompt
    assert (got[5].chosen_text, got[5].rejected_text, got[5].chosen_mask, got[5].n_prompt_turns) == ("", "", "", 4)
    assert preferences.preference_pairs(spark.createDataFrame([], TURNS)).count() == 0


def test_preferences_with_null_ids_and_clashing_names(spark):
    rows = [(None, 1, "user", "q"), (None, 2, "assistant", "a"), (1, None, "user", "q"), (1, 2, "assistant", "b"), (2, 1, None, None), (2, 2, "assistant", None)]
    pairs = preferences.preference_pairs(spark.createDataFrame(rows, TURNS))
    got = {r.id: r for r in preferences.formatted(pairs.selectExpr("*", "1 AS parts", "2 AS _parts")).collect()}
    assert set(got) == {None, 1, 2} and got[None].parts == 1 and got[None]._parts == 2
    assert "a" in got[None].chosen_text and got[None].n_prompt_turns == 1


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 99), (7, 7), (200, 200)]
    got = {r.a: r.b for r in common.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 100: 99, 101: 99}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_is_its_stages_one_by_one(spark, tmp_path):
    rows = [(i, *r[1:]) for i, r in enumerate(documents(6))]
    secret = "token = q9X2mK7pL4vR8tW1yB6nZ3 "
    rows += [(500, rows[8][1] * 3 + secret, "q", 0)]
    docs = spark.createDataFrame([(i, t, "en", "s", n) for i, t, _, n in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[9][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        ids.append({r.doc_id for r in now.collect()})
    assert ids[0] > ids[1] > ids[2] == ids[3] and 9 not in ids[2]
    assert secret not in "".join(r.text for r in now.collect())
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == ids[3]
    assert sorted(r.ids_crc32 for r in got.collect()) == sorted(r.ids_crc32 for r in corpus_pipeline.best_fit_packing(spark, now, str(tmp_path)).collect())


def test_each_operator_has_a_query():
    from gaugeworks.llm.queries import ORACLE_SQL, QUERIES

    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
