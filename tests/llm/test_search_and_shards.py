"""Divergence of sources, ranked search and shards against plain versions, also on awkward rows."""

import random
import re
import zlib
from collections import Counter, defaultdict
from math import floor, log

import pytest
from pyspark.sql import functions as F

from assethealth.llm import divergence, lexical, queries, sharding

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, value long, item string, row string, shard int, bits long"


def rows(n, seed, words):
    """Awkward documents: null and empty columns, repeated rows, one hot group, one very long text, longer characters."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 40)))
        out.append((i, r.choice([text, text.upper(), text + " été-naïve 12a", ""]) if i % 9 else None, r.choice(["en", "fr", None, ""]), r.choice(["a", "b", "ü", None, "b"]), i, "x", "r", 7, 3))
    out += out[:5] + [(None, out[3][1], None, "a", 1, "x", "r", 7, 3)] * 3
    out += [(1000 + i, "one two three two", "en", "hot", 1, "x", "r", 7, 3) for i in range(n // 2)]
    return [*out, (5000, "alpha beta gamma " * 70_000, "fr", "a", 1, "x", "r", 7, 3), (5001, "!!! ...", "xx", "lonely", 1, "x", "r", 7, 3)]


WORDS = "one two three four Five six seven eight nine ten alpha beta gamma Delta the The a".split()


# -- divergence ----------------------------------------------------------------


def plain_divergence(docs, least=10, most=10):
    count, total, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        count[lang, source].update(terms)
        total[lang].update(terms)
        seen[lang].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= least]

        def rates(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        own, every = rates(count[lang, source]), rates(total[lang])
        pairs = []
        for other in {s for x, s in groups if x == lang and s != source}:
            theirs = rates(count[lang, other])
            pairs.append((-sum(f(own[t], theirs[t]) for t in kept), other.encode(), other))
        terms = sorted((-f(own[t], every[t]), t.encode(), t) for t in kept if count[lang, source][t] and own[t] > every[t])[:most]
        for part, found in (("pair", sorted(pairs)), ("term", terms)):
            out |= {(lang, source, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)}
    return out


def test_divergence_is_that_of_all_terms(spark):
    docs = rows(400, 1, WORDS + [f"w{i}x" for i in range(60)] + ["çok", "żó"])
    made = divergence.source_divergence(spark.createDataFrame(docs, DOCS)).collect()
    found = {(r.lang, r.source, r.part, r["item"], r["value"], r["rank"]) for r in made}
    assert len(made) == len(found) and found == plain_divergence(docs)
    assert any(r.part == "pair" and r.lang == "fr" for r in made)


def test_divergence_of_many_levels_and_blocks(spark):
    r = random.Random(5)
    words = [a + b + c for a in "abcdefgh" for b in "klmnopqr" for c in "uvwxyz"]
    docs = [(i, " ".join(words[min(int(r.paretovariate(0.6)), len(words)) - 1] for _ in range(120)), "en", f"s{i % 7}") for i in range(700)]
    made = divergence.source_divergence(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"))
    assert {tuple(x) for x in made.select("lang", "source", "part", "item", "value", "rank").collect()} == plain_divergence(docs)


def test_divergence_passes_counts_on_when_many_are_held(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    docs = rows(60, 2, WORDS)
    made = divergence.term_counts(spark.createDataFrame(docs, DOCS))
    assert made.groupBy("lang", "source", "term").count().where("count > 1").count() == 0
    assert made.agg(F.sum("occurrences")).first()[0] == sum(len(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", d[1] or "")) for d in docs)


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(spark.createDataFrame([], DOCS)).count() == 0
    few = spark.createDataFrame([(1, "a b", "en", "s"), (2, None, "en", "t"), (3, "", "en", None)], "doc_id long, text string, lang string, source string")
    made = {tuple(x) for x in divergence.source_divergence(few).collect()}
    assert made == plain_divergence([tuple(x) for x in few.collect()]) and len(made) == 6


def test_rates_are_exact_for_any_corpus(spark):
    big = spark.createDataFrame([(9_000_000_000_000, 20_000_000_000_001, 77_777_777)], "c long, n long, v long")
    assert big.select(divergence.rate(F.col("c"), F.col("n"), F.col("v"))).first()[0] == 1 + 10**9 * 9_000_000_000_002 // (20_000_000_000_001 + 2 * 77_777_777)


# -- ranked search -------------------------------------------------------------


def plain_search(docs, items, most=50):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    texts = [(d[0], Counter(cut(d[1]))) for d in docs]
    n, length = sum(bool(c) for _, c in texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in texts:
            m = 50 + 50 * sum(c.values()) * n // max(length, 1)
            score = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(cut(text)) if c[t])
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item_id, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:most])]
    return sorted(out, key=str)


ITEMS = [(1, "One two, THREE! alpha"), (2, "été naïve 12a seven"), (2, "nine ten the"), (None, "gamma beta"), (4, None), (5, "?!"), (6, "unheard of"), (7, "a the one two")]


@pytest.mark.parametrize(("seeds", "lot_terms", "bucket"), [(16_384, 200_000, 2048), (40, 5, 7), (1, 200_000, 64)])
def test_search_finds_what_a_full_scan_finds(spark, monkeypatch, seeds, lot_terms, bucket):
    docs = rows(300, 3, WORDS)
    monkeypatch.setattr(lexical, "BUCKET", bucket)
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    frame = spark.createDataFrame(docs, DOCS).repartition(5)
    made = lexical.top_documents(frame, benchmark, most=20, seeds=seeds, lot_terms=lot_terms)
    assert sorted(map(tuple, made.collect()), key=str) == plain_search(docs, ITEMS, 20)


def test_search_of_nothing(spark):
    empty, items = spark.createDataFrame([], DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.top_documents(empty, items).count() == 0
    assert lexical.top_documents(spark.createDataFrame(rows(9, 1, WORDS), DOCS), items.where("false")).count() == 0


# -- shards --------------------------------------------------------------------


def check_shards(made, docs, shards, tolerance):
    """Whole rows, gapless slots, bytes as near as one row and the tolerance allow."""
    assert Counter((r.doc_id, zlib.crc32((r.text or "").encode())) for r in made) == Counter((d[0], zlib.crc32((d[1] or "").encode())) for d in docs)
    size = lambda t: len((t or "").encode()) + 16
    assert all(r.size == size(r.text) for r in made)
    by = defaultdict(list)
    for r in made:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values()) and set(by) <= set(range(shards))
    fair, largest = sum(r.size for r in made) / shards, max(r.size for r in made)
    assert all(abs(sum(r.size for r in by[k]) - fair) <= largest + 2 * tolerance * fair + 1 for k in range(shards))
    return by


def test_shards_of_awkward_rows(spark):
    docs = rows(600, 4, WORDS)[:-2]
    made = sharding.shard_documents(spark.createDataFrame(docs, DOCS).repartition(5), 12).collect()
    by = check_shards(made, docs, 12, sharding.TOLERANCE)
    assert {c for c in made[0].asDict()} == {"doc_id", "text", "lang", "source", "value", "item", "row", "bits", "size", "shard", "slot"}
    hot = {k for k, x in by.items() if any(r.text == "one two three two" for r in x)}
    assert len(hot) > 1 and hot == set(range(min(hot), max(hot) + 1))


def test_a_group_stays_together_where_the_tolerance_allows(spark):
    docs = [(i, f"text {i % 500} " + "x" * (i % 500), None, None, 1, "x", "r", 7, 3) for i in range(5000)]
    made = sharding.shard_documents(spark.createDataFrame(docs, DOCS), 8, tolerance=0.02).collect()
    check_shards(made, docs, 8, 0.02)
    assert max(Counter(t for t, _ in {(r.text, r.shard) for r in made}).values()) == 1


def test_equal_rows_fill_many_shards(spark):
    docs = [(None, "same", None, None, 1, "x", "r", 7, 3)] * 4000
    by = check_shards(sharding.shard_documents(spark.createDataFrame(docs, DOCS).repartition(6), 40).collect(), docs, 40, 0.0)
    assert {len(x) for x in by.values()} <= {99, 100, 101}


def test_one_text_larger_than_a_shard_and_few_rows(spark):
    docs = [(i, "z" * (10 if i else 2_000_000), None, None, 1, "x", "r", 7, 3) for i in range(9)]
    made = sharding.shard_documents(spark.createDataFrame(docs, DOCS), 40).collect()
    assert len(made) == 9 and all(0 <= r.shard < 40 for r in made)
    assert sharding.shard_documents(spark.createDataFrame([], DOCS), 40).count() == 0


def test_boundaries_of_keys_that_lie_close(spark):
    """Keys in clumps that take many rounds: boundaries are those of a full sort."""
    r = random.Random(3)
    keys = sorted((r.choice([1 << 5, 1 << 40, (1 << 61) + r.randrange(50)]) + int(r.paretovariate(0.5)) % 9999, r.randrange(1 << 60), r.randint(0, 50)) for _ in range(3000))
    cuts = sharding.boundaries(spark.createDataFrame(keys, "h1 long, h2 long, size long"), 16, 0.0)
    total, most = sum(k[2] for k in keys), max(k[2] for k in keys)
    assert len(cuts) == 15
    for i, cut in enumerate(cuts):
        assert abs(sum(k[2] for k in keys if (k[0], k[1]) < cut) - total * (i + 1) / 16) <= most / 2


def test_shards_are_written_one_folder_each(spark, tmp_path):
    docs = rows(100, 9, WORDS)[:-2]
    made = sharding.write_shards(spark.createDataFrame(docs, DOCS), str(tmp_path / "out"), 5)
    assert made.count() == len(docs) and {p.name for p in (tmp_path / "out").glob("shard=*")} == {f"shard={i}" for i in range(5)}


def test_query_of_shards_keeps_its_law(spark):
    made = queries.op13_sharding(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert Counter((r.doc_id, r.text_crc32, r.size) for r in made) == Counter((d.doc_id, zlib.crc32((d.text or "").encode()), len((d.text or "").encode()) + 16) for d in docs)
    total, largest = sum(r.size for r in made), max(r.size for r in made)
    for k in range(40):
        own = [r for r in made if r.shard == k]
        assert sorted(r.slot for r in own) == list(range(len(own))) and abs(sum(r.size for r in own) - total / 40) <= largest + 0.01 * total / 40
    assert {r.law for r in made} == {"bytes"} and {r.grown_shard for r in made} == {None}
