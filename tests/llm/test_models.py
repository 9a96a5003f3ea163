"""Learned operators on held-out rows, and on awkward tables; the pipeline's stages."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assethealth.llm import langid, quality_rules, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_chain_learns_a_later_category_from_an_earlier_one(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        words = [rng.choice(["the", "cat", "dog", "runs", "home"]) for _ in range(30)]
        rude, threat = rng.random() < 0.4, False
        if rude:
            words[rng.randrange(30)] = rng.choice(["idiot", "moron"])
            threat = rng.random() < 0.5
            if threat:
                words[rng.randrange(30)] = "crushing"
        rows.append((i, " ".join(words), int(rude), int(threat)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, rude int, threat int")
    chain = toxicity.fit_chain(docs.where("doc_id < 450"), docs.select("doc_id", "rude", "threat"), ["rude", "threat"])
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1
    got = toxicity.score_chain(docs.where("doc_id >= 450"), chain).join(docs, "doc_id").collect()
    assert sum(r.is_rude == bool(r.rude) for r in got) >= 147 and sum(r.is_threat == bool(r.threat) for r in got) >= 140
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000), (None, "you idiot")], "doc_id long, text string")
    assert toxicity.score_chain(odd, chain).count() == 4
    assert toxicity.without(odd.withColumn("p_rude", F.lit(1)), chain, "rude").columns == ["doc_id", "text", "p_rude"]
    nothing = toxicity.fit_chain(docs, docs.select("doc_id", "rude").limit(0), ["rude"])
    assert not any(r.is_rude for r in toxicity.score_chain(docs, nothing).collect())


def test_toxicity_on_the_tables(spark):
    got = queries.op5_toxicity(spark, SF).join(queries.table(spark, SF, "labels").withColumnRenamed("toxic", "marked"), "doc_id")
    wrong = got.agg(F.count_if(F.col("toxic") & (F.col("marked") == 0)).alias("clean"), F.count_if(~F.col("toxic") & (F.col("marked") == 1)).alias("missed"), F.sum("marked").alias("marked")).first()
    assert wrong.clean <= 2 and wrong.missed < 0.05 * wrong.marked


def test_languages(spark):
    got = queries.op6_language_id(spark, SF).join(queries.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    right = got.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")).alias("share"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert right.share > 0.97 and right.low >= 0 and right.high <= 1
    texts = [(1, "die und der ist nicht", "de"), (2, "the and of is not", "en"), (3, None, "de"), (4, "123 !!", "en"), (5, "the cat", None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = langid.fit_centroids(docs)
    out = {r.doc_id: r for r in langid.predict_language(docs.withColumn("score", F.lit(2)), model).collect()}
    assert [out[i].lang_pred for i in range(1, 6)] == ["de", "en", "und", "und", "en"]
    empty = langid.fit_centroids(docs.limit(0))
    assert {r.lang_pred for r in langid.predict_language(docs, empty).collect()} == {"und"}


def test_quality(spark):
    got = queries.op10_quality(spark, SF).join(queries.table(spark, SF, "labels"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("share"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert right.share > 0.95 and right.low >= 0 and right.high <= 1
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "x" * 100_000), (None, "a")], "doc_id long, text string")
    one = quality_rules.fit_rules(odd, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), "quality")
    assert all(0 <= r.score <= 1 for r in quality_rules.score_quality(odd, one).collect())
    assert quality_rules.score_quality(odd.limit(0), one).count() == 0


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_take_empty_and_keep_columns(spark, at):
    docs = queries.table(spark, SF, "documents")
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, docs.where("doc_id < 60").withColumn("position", F.lit(1)) if at < 4 else docs.where("doc_id < 60"), SF)
    assert set(docs.columns) <= set(out.columns)
    places = ["doc_id", "take"] if name.startswith("mixing") else ["doc_id"]  # the last stage has a row a take
    assert 20 < out.select("doc_id").distinct().count() <= 60 and out.count() == out.select(*places).distinct().count(), name
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_rows_of_toxic_stage_are_those_of_the_operator(spark):
    docs = queries.table(spark, SF, "documents")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, SF).collect()}
    assert kept == {r.doc_id for r in queries.op5_toxicity(spark, SF).where("NOT toxic").collect()}
    marked = {r.doc_id for r in queries.table(spark, SF, "labels").where("toxic = 1").collect()}
    assert len(marked & kept) < 0.05 * len(marked)
