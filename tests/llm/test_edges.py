"""Columns with names that operators use inside, empty tables through every stage, and texts far longer than a batch."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import decontaminate, language_model, near_dup, packing, page_text, quality_model, quality_rules, repeats, secrets, sharding

CLASHING = ["key", "rep", "component", "component_id", "group", "member", "shard", "slot", "size", "law", "spans", "score", "held_out", "kept", "piece", "start", "length", "offset", "__row", "__stratum", "__s", "__text", "__m", "__g", "__one", "text_crc32", "quality", "toxic", "item_id", "__key", "__part", "h", "n", "i", "w"]


def run(name, docs, labels, benchmark):
    return {
        "secrets": lambda: secrets.scan(docs), "near": lambda: near_dup.classes(docs), "packing": lambda: packing.packed(docs), "quality": lambda: quality_model.quality(docs, labels),
        "leaks": lambda: decontaminate.contamination(docs, benchmark), "model": lambda: language_model.scored(docs), "rules": lambda: quality_rules.verdicts(docs, labels),
        "sharding": lambda: sharding.sharded(docs), "repeats": lambda: repeats.deduplicated(docs), "pages": lambda: page_text.extracted(docs.withColumnsRenamed({"doc_id": "page_id", "text": "html"}).withColumn("url", F.lit("u"))),
    }[name]()


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("name", ["secrets", "near", "packing", "quality", "leaks", "model", "rules", "sharding", "repeats", "pages"])
def test_names_used_inside_do_no_harm(spark, docs, labels, benchmark, name):
    plain = docs.select("doc_id", "text", "lang", "source").coalesce(1)
    odd = plain.withColumns({c: F.lit(7) for c in CLASHING})
    a, b = run(name, plain, labels, benchmark), run(name, odd, labels, benchmark)
    assert a.columns == b.columns
    if name == "packing":
        # which sequence a piece goes to may differ, its ids may not
        a, b = (x.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")) for x in (a, b))
    if name == "sharding":
        a, b = (x.select("doc_id", "size", "text_crc32") for x in (a, b))
    assert rows(a) == rows(b)


def test_stages_keep_clashing_columns_and_empty_tables(spark, docs, sample):
    real = spark.read.parquet(f"{sample}/documents.parquet")
    odd = real.limit(0).withColumns({c: F.lit(7) for c in CLASHING if c not in real.columns})
    some = real.withColumns({c: F.lit(7) for c in CLASHING if c not in real.columns})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        odd = stage(spark, odd, sample)
        assert odd.count() == 0, name
        out = stage(spark, some, sample)
        assert out.columns == some.columns and out.where("__stratum = 7 and rep = 7").count() == out.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, sample).count() == 0


def test_a_very_long_text_is_whole(spark, labels, benchmark):
    text = " ".join(f"u{i}" for i in range(300_000)) + " password=abcdefghijkl9"
    docs = spark.createDataFrame([(1, text, "en", "s"), (2, text, "en", "s"), (3, "short one", "en", "s")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in near_dup.classes(docs, size=4).collect()}
    assert got[2].component_id == 1 and got[1].n_shingles == 300_001 - 3
    assert {r.doc_id: r.n_removed for r in repeats.deduplicated(docs).collect()} == {1: 0, 2: 300_001, 3: 0}
    assert {r.doc_id: r.n_tokens for r in language_model.scored(docs).collect()} == {1: 300_002, 2: 300_002, 3: 3}
    assert {r.doc_id: r.n_assign for r in secrets.scan(docs).collect()} == {1: 1, 2: 1, 3: 0}
