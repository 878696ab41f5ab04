"""The risk that quality rules promise, by simulation, and strata at the edges."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import quality_rules

RULES = len(quality_rules.RULES)


def plain(seen, n, level, rate):
    """The same search with every bound computed anew."""
    total = int(n.sum())
    passes = lambda cutoffs, at: quality_rules.upper_bound(int(n[(seen > cutoffs).any(axis=1)].sum()), total, at) <= rate
    out = np.full(RULES, quality_rules.STEPS)
    while out[0] and passes(out - 1, level / 2):
        out = out - 1
    start, every = out, level / 2 / (quality_rules.STEPS + 1) ** RULES
    for rule in range(RULES):
        for step in range(out[rule]):
            trial = out.copy()
            trial[rule] = step
            if passes(trial, every):
                out = trial
                break
    return out


def table(levels):
    seen, n = np.unique(levels, axis=0, return_counts=True)
    return seen, n


def test_search_equals_a_plain_version():
    rng = np.random.default_rng(1)
    for size in (0, 5, 300, 900, 3_000, 20_000):
        levels = np.minimum(rng.geometric(rng.uniform(0.3, 0.9, RULES), (size, RULES)) - 1, 9)
        seen, n = table(levels)
        if size:
            assert quality_rules.chosen(seen, n, 0.01, 0.01).tolist() == plain(seen, n, 0.01, 0.01).tolist()


@pytest.mark.parametrize("good", [400, 2_000, 20_000])
def test_the_verdict_keeps_its_risk(good):
    # independent rules, each with its own tail: the judgement that counts is the one of all rules together
    rng = np.random.default_rng(good)
    chance = np.array([0.35, 0.45, 0.5, 0.6, 0.4])
    above = (1 - chance)[None, :] ** np.arange(1, 10)[:, None]
    broken = 0
    for _ in range(60):
        cutoffs = quality_rules.chosen(*table(np.minimum(rng.geometric(chance, (good, RULES)) - 1, 9)), 0.05, 0.01)
        risk = 1 - np.prod([1 - (above[c, r] if c < 9 else 0) for r, c in enumerate(cutoffs)])
        broken += risk > 0.01
    assert broken <= 6  # 5 % of 60, and chance


def test_strata_of_their_own(spark):
    clean, noisy = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}!" if i < 20 else f"w{i}" for i in range(60))
    rows = [(i, clean, lang) for i, lang in enumerate(itertools.islice(itertools.cycle(("en", "", None)), 6_000))] + [(9_000 + i, noisy, lang) for i, lang in enumerate(("en", "", None, "rare"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("__stratum", F.lit(1)).withColumn("cutoffs", F.lit(2))
    labels = spark.createDataFrame([(i, 1) for i in range(6_000)] + [(9_003, 1)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality_rules.verdicts(docs, labels).where("doc_id >= 9000").collect()}
    assert kept == {9_000: False, 9_001: False, 9_002: False, 9_003: True}
    stay = quality_rules.keep_good(docs, labels)
    assert stay.columns == docs.columns and stay.count() == 6_001
    assert quality_rules.keep_good(docs.limit(0), labels.limit(0)).count() == 0
    assert quality_rules.verdicts(docs, labels.limit(0)).where("kept").count() == len(rows)


def test_many_labels_are_shuffled_as_counts(spark, docs, labels, monkeypatch):
    want = sorted(map(str, quality_rules.verdicts(docs, labels).collect()))
    monkeypatch.setattr(quality_rules, "fits", lambda table: False)
    assert sorted(map(str, quality_rules.verdicts(docs, labels).collect())) == want
