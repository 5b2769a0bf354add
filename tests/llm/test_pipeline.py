"""The pipeline's near-duplicate stage against brute force on five-word sets."""

import random

import corpus_pipeline
from tests.llm.data import documents, frame
from tests.llm.test_documents import lower, split


def kept_ids(rows, size=5, percent=80):
    sets = {}
    for i, t, *_ in rows:
        w = split(lower(t))
        k = min(size, len(w))
        sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[x] for b in sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i for i in ids if find(i) == i} | {None}


def test_near_duplicate_stage_uses_five_words(spark):
    rng = random.Random(2)
    rows = documents(2)
    for n in range(6):  # near on two words; on five only if one word differs
        text = [f"v{n}_{k}" for k in range(100)]
        rows.append((2000 + 3 * n, " ".join(text), "q", 0))
        for changes in (1, 5):
            t = list(text)
            for k in rng.sample(range(6, 94, 6), changes):
                t[k] = "other"
            rows.append((2000 + 3 * n + (1 if changes == 1 else 2), " ".join(t), "q", 0))
    want = kept_ids(rows)
    assert want != kept_ids(rows, 2)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), "").collect()} == want
