import random

import numpy as np
import pytest
from tests.llm.data import documents, frame
from tests.llm.test_documents import scores

from gaugeworks.llm import language_model


def test_what_is_sent_is_small(spark):
    random.seed(8)
    words = [f"w{int(random.paretovariate(0.3)) % 90_000}" for _ in range(400_000)]
    texts = [" ".join(words[a : a + 400]) for a in (random.randrange(len(words) - 400) for _ in range(1500))]
    rows = [(i, t, "", len(t)) for i, t in enumerate(texts)]
    docs = frame(spark, rows).repartition(3)
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    found = lambda: store.stageList(None, False, False, gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    sent = lambda: {s.stageId(): s.shuffleWriteBytes() for s in map(found().apply, range(found().size()))}
    before = sent()
    known = sum(r.n_known for r in language_model.backoff_scores(docs).collect())
    assert known > 100_000
    assert sum(n for k, n in sent().items() if k not in before) < 4 * sum(map(len, texts))  # the texts' own deal included


@pytest.mark.parametrize("parts", [1, 7])
def test_many_ranges_and_chunks(spark, monkeypatch, parts):
    monkeypatch.setattr(language_model, "RANGE_GRAMS", 16)
    monkeypatch.setattr(language_model, "CHUNK_BYTES", 20_000)
    texts = [r[1] for r in documents(5)] + ["of the " * 400, "the of " * 300, "of the end", None, ""]
    rows = [(i, t, "", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in language_model.backoff_scores(frame(spark, rows).repartition(parts)).collect()}
    assert len(got) == len(rows)
    for i, (n, known, s) in enumerate(scores(rows, 3)):
        assert (got[i].n_words, got[i].n_known) == (n, known) and got[i].log_score == pytest.approx(s, rel=1e-9, abs=1e-9)


def test_texts_without_words(spark):
    got = language_model.backoff_scores(frame(spark, [(1, None, "", 0), (2, " \n", "", 2)])).collect()
    assert sorted((r.doc_id, r.n_words, r.n_known, r.log_score, r.mean_score) for r in got) == [(1, 0, 0, 0.0, None), (2, 0, 0, 0.0, None)]


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_sent_hashes_and_counts_come_back(n):
    rng = np.random.default_rng(n)
    h = np.sort(np.concatenate([rng.integers(0, 1 << 64, n, np.uint64, endpoint=False) if n else np.empty(0, np.uint64), np.array([0, (1 << 64) - 1] * (n > 1), np.uint64)]))
    c = np.where(rng.random(len(h)) < 0.9, rng.integers(0, 3, len(h)), rng.integers(200, 1 << 50, len(h)))
    assert np.array_equal(language_model._hashes_in(language_model._hashes_out(h), len(h)), h)
    assert np.array_equal(language_model._counts_in(language_model._counts_out(c), len(c)), c)


def test_hashes_that_differ_in_low_bits_only():
    for h in ([5, 3, 5, 4, 3], [9, 8], [7], [], [(1 << 64) - 1, 0, (1 << 64) - 2, 0]):
        h = np.array(h, np.uint64)
        assert np.array_equal(language_model._sorted(h), np.argsort(h, kind="stable"))
