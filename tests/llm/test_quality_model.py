"""The classifier on held-out labels, against a plain version of its score, and on edge cases."""

import zlib

import numpy as np

from strandline.llm import quality_model


def test_held_out_labels(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_model.quality(docs, labels).join(labels.where("quality is not null"), "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert len(good) > 40 and len(bad) > 5
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93


def test_edges(spark, docs, labels):
    got = quality_model.quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert len(by[1]) == 1 and by[3] == by[4] == by[5] and by[0] == by[None]


def test_executors_score_as_the_features_say(spark, docs):
    rng = np.random.default_rng(2)
    folded, bias = rng.normal(size=quality_model.BUCKETS).astype(np.float32), 0.25
    for r in quality_model.scored(docs, (folded, bias)).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        found, weight = quality_model.document_features(r.text or "")
        assert abs(r.score - 1 / (1 + np.exp(-(bias + (folded[found] * weight).sum())))) < 1e-6


def test_bigrams_are_of_neighbours():
    one = lambda t: set(quality_model.document_features(t)[0].tolist())
    assert one("a b c") != one("b a c")
    assert one("p p") & one("q q")
