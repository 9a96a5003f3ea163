"""Cases that earlier forms of the operators got wrong: lots, repeated rows, ids that are null or shared."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from assethealth.llm import decontaminate, langid, lexical, mixing, secret_scan, shared, simhash


def words(n, seed, letters="abcdefghijklmnopqrstuvwxyz"):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(n)]


def test_lots_of_a_benchmark_find_what_one_index_finds(spark):
    items = [(i, " ".join(words(12, i)) + ". " + " ".join(words(8, 100 + i)) + ".") for i in range(6)] + [(9, " ".join(words(94, 77)))]
    texts = []
    for i, text in items[:6]:
        question, answer = text.split(". ")
        for gap in (0, 60, 90):
            texts.append((len(texts), " ".join(words(40, 500 + i)) + " " + question + " " + " ".join(words(min(gap, 96 - 20), 900 + gap)) + " " + answer + " end"))
    texts += [(100, " ".join(words(300, 3))), (101, items[6][1])]
    docs, benchmark = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {n: {r.doc_id: (r["items"], round(r.overlap, 9)) for r in decontaminate.find_contamination(docs, benchmark, n).collect()} for n in (60, 200, 2_000_000)}
    assert found[60] == found[200] == found[2_000_000]
    assert all(found[60][k][0] == [k // 3] for k in range(18)) and found[60][100][0] == [] and found[60][101][0] == [9]
    alone = spark.createDataFrame(items[:1], "item_id long, text string")  # other items' lengths do not matter
    assert {r.doc_id for r in decontaminate.find_contamination(docs, alone).where("size(items) > 0").collect()} == {0, 1, 2}


def test_languages_of_repeated_rows_are_learnt(spark):
    rows = [(i, " ".join(words(20, i)), "en") for i in range(200)]
    rows += [(7, " ".join(words(20, 50 + k, "äöüßéèçñ")), lang) for k, lang in enumerate(("de", "fr", "es")) for _ in range(5000)]
    model = langid.fit_centroids(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.langs) == {"de", "en", "es", "fr"}


def test_secrets_of_a_text_without_an_id_are_its_own(spark):
    inner = "user: admin_login key Zx9Kq2Wv8Lp4Rt6Yb1Nc77QwErT5 at https://db.internal:5432/x"
    docs = spark.createDataFrame([(None, "1\n" + inner), (1, inner), (None, inner), (11, "\n" + inner)], "doc_id long, text string")
    spans = {}
    for r in secret_scan.scan_secrets(docs).collect():
        spans.setdefault(r.doc_id, []).append(sorted(s["start"] for s in r.linked))
    own = spans[1][0]
    assert own and sorted(spans[None]) == sorted([own, [x + 2 for x in own]]) and spans[11] == [[x + 1 for x in own]]


def test_near_copies_are_told_apart_by_id_and_text(spark):
    a, other = " ".join(words(60, 1)), " ".join(words(60, 2))
    rows = [(3, a), (5, a + " more"), (5, other), (None, other), (None, a + " extra"), (None, "quite alone here")]
    left = simhash.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(3, a), (5, other), (None, "quite alone here")], key=str)


def test_a_labelled_sample_is_bounded_in_rows(spark):
    docs = [(1, f"text {i}") for i in range(3000)] + [(1, "same")] * 2000 + [(2, "two"), (None, "none")]
    labels = [(1, 1), (2, 0), (2, 0), (None, 1)]
    rows = shared.labelled_sample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), 10)
    assert rows.count() == 10 and set(rows.columns) == {"doc_id", "text", "toxic", "h"}
    few = shared.labelled_sample(spark.createDataFrame(docs[-3:], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), 10)
    assert {(r.doc_id, r.text, r.toxic) for r in few.collect()} == {(1, "same", 1), (2, "two", 0)}


def test_rows_without_an_id_are_mixed_in_many_buckets(spark):
    r = random.Random(1)
    docs = [(None if i % 2 else 4, " ".join(["w"] * r.randint(0, 9)) + f" {i % 3000}", "s") for i in range(4000)] + [(i, "a b c", "t") for i in range(500)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    rows = shared.written(mixing.sized(frame).drop("row").withColumn("r", F.xxhash64(F.monotonically_increasing_id())), "sizes")
    sizes = [x["count"] for x in mixing.bucketed(rows, 50).groupBy("source", "bucket").count().collect()]
    assert max(sizes) < 600 and sum(sizes) == len(docs)
    mixed = mixing.mix(frame, bucket_rows=50).collect()
    assert Counter((x.doc_id, x.size) for x in mixed) == Counter((d[0], len(d[1].split())) for d in docs)
    # words laid end to end by MD5 of the id, then size: each source meets its target to the word
    taken, target = defaultdict(int), {}
    for x in mixed:
        taken[x.source] += x.taken
        target[x.source] = x.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sum(x["taken"] for x in mixing.schedule(frame, bucket_rows=50).collect()) == sum(taken.values())


def test_a_long_text_passes_every_operator_that_reads_words(spark):
    long = " ".join(words(3000, 8) * 200)  # 600,000 words
    docs = spark.createDataFrame([(1, long, "en", "s"), (2, "short text of few words", "en", "s"), (3, None, None, None)], "doc_id long, text string, lang string, source string")
    items = spark.createDataFrame([(1, " ".join(words(3000, 8)[100:130]) + ".")], "item_id long, text string")
    assert {r.doc_id: len(r["items"]) for r in decontaminate.find_contamination(docs, items).collect()} == {1: 1, 2: 0, 3: 0}
    assert simhash.near_dup_groups(docs).count() == 3 and simhash.without_near_copies(docs).count() == 3
    assert mixing.mix(docs).where("doc_id = 1").first()["size"] == 600_000
    assert [r.doc_id for r in lexical.top_documents(docs, items).collect()] == [1]
    assert {r.doc_id: r.lang_pred for r in langid.predict_language(docs, langid.fit_centroids(docs)).collect()} == {1: "en", 2: "en", 3: "und"}
