"""The verdict of the quality rules doesn't hang on a first guess, and needs no label."""

import os

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import quality
from gaugeworks.llm.common import stored

DATA = "/root/testdata/sf0.01"
STARTS = [
    (0.8, 0.05, 0.4, 0.5, 0.8), (0.8, 0.1, 0.4, 0.5, 0.8), (0.9, 0.02, 0.3, 0.6, 0.6), (0.7, 0.1, 0.6, 0.3, 0.8), (0.6, 0.05, 0.2, 0.5, 0.7), (0.8, 0.02, 0.2, 0.7, 0.9), (0.5, 0.1, 0.3, 0.3, 0.6), (0.9, 0.05, 0.5, 0.4, 0.5), (0.7, 0.2, 0.3, 0.5, 0.8),
    (0.5, 0.4, 0.1, 0.8, 0.2),  # the classes the other way round
]


@pytest.mark.skipif(not os.path.exists(DATA), reason="the tables aren't here")
def test_every_start_gives_the_same_verdicts_and_they_agree_with_labels_that_were_not_used(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    measured = stored(quality.measures(docs, "text", "m").select("doc_id", "m"), "measured")
    n = len(quality.RULES)
    patterns = stored(quality.patterns(measured, "m"), "votes")
    def verdicts(starts):
        model, prior = quality.fit(patterns, n, starts=starts)
        judged = measured.select("doc_id", quality.verdict("m", model, prior).alias("q")).select("doc_id", "q.kept", "q.base_failed", *[f"q.vote_{r[0]}" for r in quality.RULES])
        return sorted(map(tuple, judged.collect()))

    rows = verdicts(quality.STARTS)
    guesses = [dict(zip((*quality.ACCURACIES, "prior"), start, strict=True)) for start in STARTS]
    alike = [verdicts([g]) == rows for g in guesses]
    assert sum(alike) >= 8
    # those that end in a worse optimum lose to any that doesn't
    assert verdicts([*(g for g, same in zip(guesses, alike, strict=True) if not same), guesses[0]]) == rows
    kept = {r[0]: r[1] for r in rows}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.quality is not None}
    passed = [r for r in rows if not r[2]]
    good, bad = [r for r in passed if labels.get(r[0]) == 1], [r for r in passed if labels.get(r[0]) == 0]
    assert sum(kept[r[0]] for r in good) >= 0.99 * len(good) and sum(kept[r[0]] for r in bad) <= 0.05 * len(bad)
    # a rule that is often wrong doesn't reject: bad votes on length alone are outvoted
    assert any(kept[r[0]] and r[3] == -1 for r in passed)
