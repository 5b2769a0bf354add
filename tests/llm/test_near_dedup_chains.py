"""Near duplicates where the largest component of a bucket has no shingle in common."""

import random

import pytest
from tests.llm.data import frame
from tests.llm.test_documents import classes

from gaugeworks.llm import near_dedup


@pytest.mark.parametrize("seed", [1, 2])
def test_border_copies_of_a_drifting_chain(spark, seed):
    """Each version is near its neighbours only; each copy is near one version only, which is seldom its buckets' centre."""
    rng = random.Random(seed)
    fresh = iter(range(10**6))
    text = [f"w{next(fresh)}" for _ in range(100)]
    order = rng.sample(range(100), 100)
    versions = []
    for i in range(200):
        for k in (2 * i, 2 * i + 1):
            text[order[k % 100]] = f"w{next(fresh)}"
        versions.append(list(text))
    copies = []
    for i in range(0, 200, 4):
        t = list(versions[i])
        for k in rng.sample(range(5, 95, 3), 5):
            t[k] = f"c{next(fresh)}"
        copies.append(t)
    texts = [" ".join(t) for t in versions + copies]
    rng.shuffle(texts)
    rows = [(k, t, "", 0) for k, t in enumerate(texts)]
    want = classes(rows)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()} == want
