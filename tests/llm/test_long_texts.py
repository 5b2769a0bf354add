"""Texts of over two megabytes, beyond the buffers that hashing works in, beside short ones: each operator against a plain count."""

import random
import zlib

import numpy as np
import pytest
from tests.llm.data import frame
from tests.llm.test_documents import measures, scores, split

from gaugeworks.llm import decontamination, hashing, language_model, near_dedup, packing, preferences, quality, urls


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 9))) for _ in range(20_000)]
    long = [rng.choice(words) for _ in range(360_000)]
    near = list(long)
    for k in range(0, len(near), 60):  # five in sixty of its shingles change at most
        near[k] = rng.choice(words)
    other = [rng.choice(words) for _ in range(30_000)]
    line = lambda w: "\n".join(" ".join(w[k : k + 50]) for k in range(0, len(w), 50))
    out = [(1, line(long)), (2, line(near)), (3, line(other)), (4, " ".join(long[100_000:100_040])), (5, "x" * 1_500_000 + " end"), (6, None), (7, "")]
    assert len(out[0][1].encode()) > 2 * hashing.CHUNK
    return [(i, t, "q", 0) for i, t in out]


def test_hashes_of_a_long_text_are_those_of_its_words(rows):
    for t in (rows[0][1], rows[4][1] + " " + rows[3][1], "y" * (hashing.CHUNK + 5), " " * (hashing.CHUNK + 5) + "z"):
        (got,) = hashing.word_hashes([t.encode()])
        singly = {w: h[0] for w, h in zip(set(split(t)), hashing.word_hashes([w.encode() for w in set(split(t))]), strict=True)}
        assert got.tolist() == [singly[w] for w in split(t)]


def test_quality(spark, rows):
    got = {r.doc_id: r for r in quality.quality_report(frame(spark, rows)).collect()}
    for i, t, *_ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(t)


def test_near_duplicates(spark, rows):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    for i, t, *_ in rows:
        w = split(t)
        assert got[i].n_shingles == len({tuple(w[k : k + 2]) for k in range(max(len(w) - 1, min(len(w), 1)))})
    assert {i: r.component_id for i, r in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}


def test_packing(spark, rows):
    pieces = {}
    for r in packing.packed(frame(spark, rows)).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t, *_ in rows:
        ids = np.frombuffer(next(packing.tokens([t or ""], packing.public_path())) + packing.END, "<u4")
        mine = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(-(-len(ids) // 2048)))
        assert [(r.start, r.length, r.ids_crc32) for r in mine] == [(a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for a in range(0, len(ids), 2048)]


def test_contamination(spark, rows):
    w = split(rows[0][1])
    at = (0, 150_000, len(w) - 13)  # the first words, some in the middle, the last
    bench = spark.createDataFrame([(k, " ".join(w[a : a + 13])) for k, a in enumerate(at)] + [(9, "x" * 1_500_000)], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.contamination_report(frame(spark, rows), bench).collect()}
    ascii_words = sum(1 for x in decontamination.split_words(rows[0][1].encode()))
    assert got[1].n_words == ascii_words and got[1].n_items == 3 and got[1].n_hit >= 39 and not got[1].contaminated
    assert (got[5].n_words, got[5].n_hit, got[5].n_items, got[5].contaminated) == (2, 1, 1, True)
    assert got[3].n_hit == got[6].n_hit == got[7].n_words == 0


def test_scores(spark, rows):
    some = [r for r in rows if r[0] != 1]
    got = {r.doc_id: r for r in language_model.backoff_scores(frame(spark, some)).collect()}
    for (i, *_), (n, known, s) in zip(some, scores(some, 3), strict=True):
        assert (got[i].n_words, got[i].n_known) == (n, known)
        assert got[i].log_score == pytest.approx(s, rel=1e-9, abs=1e-9)


def test_preferences(spark, rows):
    turns = [(c, 0, "user", rows[0][1]) for c in (1, 2)] + [(1, 1, "assistant", rows[1][1]), (2, 1, "assistant", rows[2][1])]
    pairs = preferences.preference_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    two = next(r for r in preferences.formatted(pairs).collect() if r.id == 2)
    assert two.n_prompt_turns == 1 and rows[0][1] in two.prompt and rows[2][1] in two.chosen_text and rows[1][1] in two.rejected_text


def test_urls(spark, rows):
    long = "z" * 2_000_000
    pages = spark.createDataFrame([(1, f"http://a.example.org/es/{long}"), (2, f"{long}://b.com/fr/?{long}"), (3, long)], "page_id long, url string")
    got = {r.page_id: r for r in urls.judged(pages).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", f"/es/{long}", "example.org/es/", "block")
    assert (got[2].host, got[2].path, got[2].rule, got[2].verdict) == ("b.com", "/fr/", "com/fr/", "allow")
    assert (got[3].host, got[3].path, got[3].rule) == ("", "", None)
