"""Operators against brute force on awkward rows, and with columns that have the operators' own names."""

import datetime
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from assethealth.llm import decontaminate, exact_dedup, langid, mixing, pseudonyms, quality_rules, queries, secret_scan, simhash, spans, toxicity

SF = "/root/testdata/sf0.01"


# -- pseudonyms ----------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def plain_pair(left, right, sizes, kind):
    for i in range(1, pseudonyms.ROUNDS + 1):
        size = sizes[0] if i % 2 else sizes[1]
        left, right = right, (left + int(sha("k", kind, i, right)[:15], 16) % size) % size
    return left, right


def plain_text(value, kind):
    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for i in range(1, pseudonyms.ROUNDS + 1):
        stream, out = sha("k", kind, i, right), ""
        for at, c in enumerate(left):
            by = int(stream[at % 31 * 2 : at % 31 * 2 + 4], 16)
            for first, n in (("0", 10), ("a", 26), ("A", 26)):
                if ord(first) <= ord(c) < ord(first) + n:
                    c = chr((ord(c) - ord(first) + by) % n + ord(first))
                    break
            out += c
        left, right = right, out
    return left + right


def into(template, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in template)


START = datetime.date(1700, 1, 1)
LATE = [d for d in (START + datetime.timedelta(i) for i in range(pseudonyms.CYCLE_DAYS)) if d.day > 12]


def plain_pseudonym(value):
    if "@" in value:
        name, host = value.split("@")
        return f"{plain_text(name, 'email')}@{host}"
    if value.count(".") == 3:
        o = list(map(int, value.split(".")))
        a, b = plain_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), "ip")
        return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
    for pattern in ("%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y"):
        try:
            n = (datetime.datetime.strptime(value, pattern).date() - START).days
        except ValueError:
            continue
        a, b = plain_pair(n // 773, n % 773, (189, 773), "date")
        d = START + datetime.timedelta(a * 773 + b)
        return d.strftime(pattern)
    if value.count("/") == 2:
        n = LATE.index(datetime.datetime.strptime(value, "%m/%d/%Y").date())
        a, b = plain_pair(n // 9833, n % 9833, (9, 9833), "late date")
        return LATE[a * 9833 + b].strftime("%m/%d/%Y")
    digits = re.sub(r"\D", "", value)
    if len(digits) >= 13:
        body = plain_text(digits[:-1], "card")
        odd = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(body[::-1]))
        return into(value, body + str(-odd % 10))
    code = re.match(r"(\+\d{1,3}(?=[ .-]))?", value)[0]
    rest = value[len(code) :]
    return code + into(rest, plain_text(re.sub(r"\D", "", rest), "phone"))


def test_pseudonyms_are_those_of_a_plain_feistel_network(spark):
    values = ["a@b.cd", "Jo.Doe99+x@mail.example.com", "10.1.2.3", "255.0.0.255", "2024-02-29", "29/02/2024", "12/25/2024", "01.12.1999", "4111111111111111", "4111-1111-1111-1111", "+1 (017) 555-7713", "017-555-7713", "+49 30 123 4567"]
    docs = spark.createDataFrame([(i, f"see {v} there") for i, v in enumerate(values)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pseudonyms.pseudonymise(docs, "k").collect()}
    assert got == {i: f"see {plain_pseudonym(v)} there" for i, v in enumerate(values)}


@pytest.mark.parametrize("pattern", ["dd/MM/yyyy", "MM/dd/yyyy", "yyyy-MM-dd"])
def test_all_dates_map_one_to_one(spark, pattern):
    days = spark.range(pseudonyms.CYCLE_DAYS).select(F.date_format(F.date_add(F.lit("1700-01-01").cast("date"), F.col("id").cast("int")), pattern).alias("d"))
    if pattern == "MM/dd/yyyy":  # all slash dates together
        days = days.union(spark.range(pseudonyms.CYCLE_DAYS).select(F.date_format(F.date_add(F.lit("1700-01-01").cast("date"), F.col("id").cast("int")), "dd/MM/yyyy")))
    days = days.distinct().persist()
    out = days.select("d", pseudonyms.date_pseudonym(F.col("d"), "k").alias("p")).persist()
    assert out.count() == out.select("p").distinct().count() and out.select("p").subtract(days).count() == 0


def test_long_and_odd_values_do_no_harm(spark):
    texts = ["a@b" + ".b" * 1_000_000, "a@b" + ".b" * 500_000 + "..", "x" * 200_000 + "@host.de", "010.1.1.1 and 300.1.1.1", "1." * 300_000, "a@", "@b.c", "+1" * 200_000, "a@b.c, d@e."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(docs, "k").collect()}
    assert [got[i].n_email for i in (0, 1, 2, 8)] == [1, 1, 1, 1] and got[3].text == texts[3] and all(len(got[i].text) == len(t) for i, t in enumerate(texts))
    assert got[0].text[1:] == texts[0][1:] and got[0].text[0] == plain_text("a", "email")


# -- secrets -------------------------------------------------------------------


def test_running_sums(spark):
    rows = [(list(range(n)),) for n in (0, 1, 2, 3, 8, 33)] + [([5] * 100,)]
    got = spark.createDataFrame(rows, "x array<int>").select("x", spans.running_sums(F.col("x")).alias("s")).collect()
    assert all(list(np.cumsum(r.x)) == r.s for r in got)


def plain_links(parts, scope=400):
    role = lambda rank: "i" if rank in (1, 3) else "e" if rank == 5 else "s"
    out = []
    for start, rank, end in parts:
        near = {role(k) for at, k, _ in parts if abs(at - start) <= scope} - {"e"}
        need = {"i": {"s"}, "s": {"i"}, "e": {"i", "s"}}[role(rank)]
        if rank > 2 and need <= near:
            out.append((start, rank, end))
    return sorted(out)


def test_links_are_those_of_brute_force(spark):
    rng = random.Random(4)
    docs = [sorted({(rng.randrange(3000), rng.randrange(6), 5000) for _ in range(rng.choice([2, 10, 40]))}) for _ in range(60)]
    rows = [(f"d{i}", *p) for i, d in enumerate(docs) for p in d]
    got = secret_scan.linked_spans(spark.createDataFrame(rows, "doc string, start int, rank int, end int"))
    found = {}
    for r in got.collect():
        found.setdefault(r.doc, []).append((r.start, r.rank, r.end))
    assert {k: sorted(v) for k, v in found.items()} == {f"d{i}": plain_links(d) for i, d in enumerate(docs) if plain_links(d)}


def test_many_and_late_secrets(spark):
    late = "a" * 100 + "B" + "c" * 30 + "7"
    texts = [f"user: alice99 {late}", f"user: alice99 {'z' * 90}", "token=abcdefgh12345 " * 40_000]
    began = time.time()
    got = {r.doc_id: r for r in secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert time.time() - began < 60  # quadratic work would take hours
    assert [secret_scan.KINDS[s.rank] for s in got[0].linked] == ["identifier", "secret"] and not got[1].linked
    assert [(s.start, s.end) for s in got[2].base] == [(i * 20, i * 20 + 19) for i in range(40_000)]


# -- decontamination -----------------------------------------------------------


def test_awkward_benchmark_rows(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [("cloze", f"____\n{line(20)}."), (None, f"{line(9)}? {line(9)}."), ("twice", f"{line(10)}? {line(8)}."), ("twice", f"{line(12)}? {line(9)}."), ("marks", "... !!! ___"), ("x", None), ("y", ""), ("one", "zyzzyva")]
    docs = [f"{line(40)} {t} {line(30)}" for _, t in items[:4]] + [items[3][1] * 2, "zyzzyva", None, "... !!! ___", f"{items[0][1]} {items[2][1]} {items[3][1]}"]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumns({"found": F.lit(1), "body": F.lit("b"), "items": F.lit(2)})
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    for lot in (2_000_000, 25):
        got = {r.doc_id: list(r["items"]) for r in decontaminate.find_contamination(frame, benchmark, lot).collect()}
        assert got == {0: ["cloze"], 1: [None], 2: ["twice"], 3: ["twice"], 4: ["twice"], 5: ["one"], 6: [], 7: [], 8: ["cloze", "twice"]}
        assert {r.doc_id for r in decontaminate.without_contaminated(frame, benchmark, lot).collect()} == {6, 7}


def test_search_finds_all_that_brute_force_verifies(spark):
    """Every document against every item by ``held`` alone, without an index."""
    docs = queries.table(spark, SF, "documents").limit(400).select("doc_id", "text").collect()
    benchmark = queries.table(spark, SF, "benchmark")
    items = [(r.item_id, *decontaminate.question_and_answer(r.text)) for r in benchmark.collect() if decontaminate.words_of(r.text)]
    want = {}
    for d in docs:
        words = decontaminate.words_of(d.text)
        have = set(words)
        want[d.doc_id] = sorted(i for i, q, a in items if len(have & {*q, *a}) >= 0.7 * len({*q, *a}) and decontaminate.held(q, a, words))
    got = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), benchmark)
    assert {r.doc_id: list(r["items"]) for r in got.collect()} == want


# -- mixing --------------------------------------------------------------------


def test_schedule_is_that_of_a_plain_walk(spark):
    rng = random.Random(6)
    rows = [(rng.randrange(40) if i % 9 else None, rng.choice(["u v w", "a", "x y z q r", "b c", None, "b c"]), rng.choice(["a", "b", "b", "b", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, bucket_rows=7).collect()
    assert [r.position for r in mixed if r.position is not None] == sorted(r.position for r in mixed if r.position is not None)
    target = {r.source: r.target for r in mixed}
    want = []
    for s in target:
        own = sorted(((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), i is not None, i or 0, len((t or "").split()), i, t) for i, t, x in rows if x == s), key=lambda r: r[:4])
        total, goal, ramp = sum(r[3] for r in own), round(target[s]), mixing.RAMPS[sorted(target, key=lambda x: (x is None, x or "")).index(s) % 3]
        met = 0
        for turn in range(3):
            for *_, size, i, t in own:
                words = max(0, min(size, goal - met))
                need = (met + words / 2) / target[s] * (1 + ramp) / 2
                if words:
                    want.append((i, size, s, turn + 1, words, round(need if ramp == 1 else ((1 + 2 * (ramp - 1) * need) ** 0.5 - 1) / (ramp - 1), 9)))
                met += size
        assert total * 3 >= goal
    got = [(r.doc_id, r.size, r.source, r["take"], r.taken, round(r.position, 9)) for r in mixing.schedule(docs, bucket_rows=7).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and [r[5] for r in got] == sorted(r[5] for r in got)


# -- columns that have the operators' own names ---------------------------------

OWN = [
    "_id", "_size", "_sha", "_keep", "_length", "_prefix", "_found", "id", "node", "n", "prefix", "parity", "row", "body", "found", "h", "bucket", "length", "sha256", "keep_id", "token", "one", "label", "base", "weak", "doc", "new", "hashes",
    "own", "share", "lang_pred", "fp", "take", "inner", "at", "word_length", "n_chars",
]


@pytest.mark.parametrize("name", ["op1", "op2", "op5", "op6", "op7", "op8", "op9", "op10", "near", "exact", "schedule", "curriculum", "toxic", "clean"])
def test_columns_with_own_names_are_kept_or_ignored(spark, name):
    texts = ["one two three four five six", "one two three four five six", None, "", "user: alice99 Ab3dEf6hIj9lMn2pQr5tUv8xYz1", "call +1 (017) 555-7713"]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    extra = docs.withColumns({c: F.lit(f"mine {c}") for c in OWN})
    chain = toxicity.Chain(["h"], ["idiot$"], [np.ones(1)], [-5.0], [0.5])
    model = quality_rules.RuleModel([(("n_chars", True, 2.0),)], [1.0], 0.0)
    benchmark = spark.createDataFrame([(1, "quite another text than any of these")], "item_id long, text string")
    centroids = langid.Centroids(np.ones(langid.DIMENSIONS, np.float32), ["en"], np.ones((1, langid.DIMENSIONS), np.float32), np.zeros(1))
    run = {
        "op1": simhash.near_dup_groups, "op2": exact_dedup.exact_dedup, "op5": lambda d: toxicity.score_chain(d, chain), "op6": lambda d: langid.predict_language(d, centroids), "op7": secret_scan.scan_secrets, "op8": mixing.mix,
        "op9": lambda d: pseudonyms.pseudonymise(d, "k"), "op10": lambda d: quality_rules.score_quality(d, model), "near": simhash.without_near_copies, "exact": exact_dedup.deduplicated, "schedule": mixing.schedule,
        "curriculum": mixing.curriculum, "toxic": lambda d: toxicity.without(d, chain, "h"), "clean": lambda d: decontaminate.without_contaminated(d, benchmark),
    }[name]
    plain, out = run(docs), run(extra)
    added = [c for c in plain.columns if c not in docs.columns]
    assert sorted(map(str, plain.collect())) == sorted(map(str, out.select(*plain.columns).collect()))
    if name in ("op9", "near", "exact", "schedule", "curriculum", "toxic", "clean"):  # whole rows come through
        for r in out.collect():
            assert all(r[c] == f"mine {c}" for c in OWN if c not in added)


# -- learned operators ----------------------------------------------------------


def test_scores_are_those_of_plain_rules(spark):
    rng = random.Random(2)
    rules = [tuple((rng.choice(["n_chars", "symbols", "distinct_share"]), rng.random() < 0.5, rng.random() * 4) for _ in range(rng.randint(1, 3))) for _ in range(15)]
    model = quality_rules.RuleModel(rules, [rng.uniform(-2, 2) for _ in rules], 0.3)
    texts = ["", "a", "a b c a b c", "$$$ # text", "Ünï cödé words " * 50, "x\ny\nx\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.score_quality(docs, model).collect():
        t = texts[r.doc_id]
        words = re.split(r"[\x20\x09-\x0D]+", t)
        stats = {"n_chars": np.log1p(len(t)), "symbols": sum(c in "#$%&*|" for c in t) / max(1, len(t)), "distinct_share": len(set(words)) / len(words)}
        total = 0.3 + sum(w for rule, w in zip(rules, model.weights, strict=True) if all((stats[n] > at) == above for n, above, at in rule))
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)))


def test_chain_scores_are_those_of_plain_sums(spark):
    chain = toxicity.Chain(["a", "b"], ["bad$", "wor", "good$"], [np.array([3.0, 1.0, -2.0]), np.array([0.5, 2.0, 0.0, 4.0])], [-1.0, -2.0], [0.5, 0.5])
    texts = ["bad words", "good", "", None, "Bad BAD world 7", "worse worry bad good"]
    for r in toxicity.score_chain(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chain).collect():
        words = re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower())
        x = [(sum(w == "bad" for w in words) / max(1, len(words))) ** 0.5, (sum(w.startswith("wor") for w in words) / max(1, len(words))) ** 0.5, (sum(w == "good" for w in words) / max(1, len(words))) ** 0.5]
        a = 1 / (1 + np.exp(-(3 * x[0] + x[1] - 2 * x[2] - 1)))
        b = 1 / (1 + np.exp(-(0.5 * x[0] + 2 * x[1] + 4 * a - 2)))
        assert (r.p_a, r.p_b) == (pytest.approx(a), pytest.approx(b)) and (r.is_a, r.is_b) == (a >= 0.5, b >= 0.5)


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = queries.table(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    docs = queries.table(spark, sf, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    chain = toxicity.fit_chain(docs, labels.where(~held), ["low_quality", "toxic"])
    got = toxicity.score_chain(docs.where(held), chain).join(labels, "doc_id").groupBy("is_toxic", "toxic").count().collect()
    n = {(r.is_toxic, r.toxic): r["count"] for r in got}
    right, missed, wrong = n.get((True, 1), 0), n.get((False, 1), 0), n.get((True, 0), 0)
    assert right >= 0.95 * (right + missed) and right >= 0.95 * (right + wrong) and right > 50


def test_languages_by_plain_cosines_and_without_ids(spark):
    rows = [(i if i % 3 else None, f"{'the and of house ' if i % 2 else 'die und der haus '}{i % 7 * 'x '}{i}", "en" if i % 2 else "de") for i in range(300)] + [(None, "the and of house", "en")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_centroids(docs, sample=20)
    assert set(model.langs) == {"de", "en"} and len(model.langs) <= 6
    assert set(langid.fit_centroids(docs, sample=20, most_languages=1).langs) == {"en"}
    for r in langid.predict_language(docs.limit(50), model).collect():
        assert r.lang_pred in ("de", "en")
    texts = [r[1] for r in rows[:50]]
    want = []
    for t in texts:
        x = np.log1p(langid.ngram_counts(t)) * model.idf
        want.append(model.langs[int(np.argmax(model.vectors @ (x / np.linalg.norm(x))))])
    numbered = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.lang_pred for r in langid.predict_language(numbered, model).orderBy("doc_id").collect()] == want
