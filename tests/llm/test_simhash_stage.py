"""The pipeline's near-duplicate stage goes by SimHash, and exactly where SimHash is blind."""

import random

import corpus_pipeline
from assethealth.llm import simhash


def test_simhash_joins_texts_and_the_exact_search_what_it_leaves(spark, monkeypatch):
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(3000)]
    short = [f"v{r.randrange(10**6)}" for _ in range(60)]
    texts = {0: words, 1: [*words, "end"], 2: short, 3: [*short[:-3], "at", "the", "end"], 4: [f"u{r.randrange(10**6)}" for _ in range(50)], 5: [], 6: []}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(2)
    found, pairs = [], simhash.simhash_pairs

    def seen(rows):
        out = pairs(rows)
        found.append(out.count())
        return out

    monkeypatch.setattr(simhash, "simhash_pairs", seen)
    left = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert {x.doc_id for x in left} == {0, 2, 4, 5}
    assert found == [1]
