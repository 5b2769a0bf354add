"""How many pairs are compared where two families of near copies are linked by a few members only."""

import random

from tests.llm.data import frame
from tests.llm.test_documents import classes

from gaugeworks.llm import near_dedup


def test_linked_families_are_not_paired_member_by_member(spark, monkeypatch):
    """The families' texts differ in a passage of six words. A member has two words of its own; the last of each family has one, and only those two are alike across the families. With the highest ids they are hardly ever a bucket's centre."""
    rng, n = random.Random(5), 120
    first = [f"w{i}" for i in range(100)]
    second = first[:40] + [f"v{i}" for i in range(6)] + first[46:]
    texts = []
    for base, own in [(first, 2), (second, 2)] * (n - 1) + [(first, 1), (second, 1)]:
        t = list(base)
        for k in rng.sample([*range(2, 38, 3), *range(50, 98, 3)], own):
            t[k] = f"c{len(texts)}x{k}"
        texts.append(" ".join(t))
    rows = [(k, t, "", 0) for k, t in enumerate(texts)]
    counts = []

    def counted(df, name, plain=near_dedup.stored):
        out = plain(df, name)
        if name == "pairs":
            counts.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "stored", counted)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == classes(rows)
    assert sum(counts[1:]) < 10 * n, counts
