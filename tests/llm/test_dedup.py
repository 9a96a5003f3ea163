"""Exact and near deduplication against brute force, and on awkward tables."""

import hashlib
import random

import pytest
import xxhash

from assethealth.llm import exact_dedup, simhash
from assethealth.llm.components import connected_components

DOCS = "doc_id long, text string, label string, links string"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


def plain_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    items = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in items]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(keys, linked):
    """Least id reachable, by trying every pair."""
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in keys:
        for b in keys:
            if a < b and linked(keys[a], keys[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_masks_cover_every_pair_of_bits():
    masks = simhash.covering_masks()
    for i in range(64):
        for j in range(64):
            assert any(not (m >> i & 1) and not (m >> j & 1) for m in masks)


@pytest.mark.parametrize("bucket", [32, 2])
def test_links_join_what_brute_force_joins(spark, bucket):
    rng = random.Random(3)
    values = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        values |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(8)}
    values = sorted(simhash._signed(v) for v in values)
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), bucket)
    got = {r.node: r.label for r in connected_components(edges).collect()}
    want = plain_groups({v: v for v in values}, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 2)
    assert {v: got.get(v, v) for v in values} == want


def test_near_duplicates(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    texts = [None, "", " \t\n", "one", "ONE", "two words", "ünï çödé"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(3, 400))]
        texts += [" ".join(base), " ".join(base).upper()]
        base[rng.randrange(len(base))] = word()
        texts.append("  ".join(base))
    texts.append("w " * 30_000)
    docs = frame(spark, [*texts, texts[9]], [*range(len(texts)), None])
    got = simhash.near_dup_groups(docs).collect()
    assert len(got) == len(texts) + 1
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    want = plain_groups(fps, lambda a, b: bin(a ^ b).count("1") <= 2)
    for r in got:
        if r.doc_id is not None:
            assert (int(r.fingerprint, 16), r.component_id) == (fps[r.doc_id], want[r.doc_id])
    assert {r.component_id for r in got if r.doc_id is None} == {want[9]}


def test_chains_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.label for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_similar_documents_leave_one(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    texts, keep = [], set()
    for _ in range(20):
        base = [word() for _ in range(300)]
        keep.add(len(texts))
        texts.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for at in rng.sample(range(300), 3):
                copy[at] = word()
            texts.append(" ".join(copy))  # 15 of 296 shingles changed at most
        far = [w if rng.random() < 0.8 else word() for w in base]
        keep.add(len(texts))
        texts.append(" ".join(far))  # similarity well below 0.5
    out = simhash.without_near_copies(frame(spark, [*texts, "no id"], [*range(len(texts)), None])).collect()
    assert {r.doc_id for r in out} == keep | {None}
    assert set(out[0].asDict()) == {"doc_id", "text", "label", "links"}


def test_exact_copies(spark):
    texts = ["a", "b", "a", None, "", "x" * 5000 + "1", "x" * 5000 + "2", "x" * 5000 + "1", "ab", "ba", "a"]
    docs = frame(spark, texts, [*range(10), None])
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert len(got) == 11
    groups = {}
    for i, t in enumerate(texts[:10]):
        groups.setdefault(t or "", []).append(i)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(ids), len(ids) + (t == "a"), i == max(ids))
    assert not got[None].kept and got[None].keep_id == 2
    left = exact_dedup.deduplicated(docs.union(docs))
    assert sorted(r.doc_id for r in left.collect()) == sorted(max(ids) for ids in groups.values())
    assert left.columns == docs.columns


def test_empty_tables(spark):
    none = frame(spark, [])
    for f in (simhash.near_dup_groups, simhash.without_near_copies, exact_dedup.exact_dedup, exact_dedup.deduplicated):
        assert f(none).count() == 0


def test_xxhash_of_the_engine_is_the_same(spark):
    assert spark.sql("SELECT xxhash64('a b c') AS h").first().h == simhash._signed(xxhash.xxh64_intdigest(b"a b c", 42))
    assert hashlib.sha256(b"").hexdigest() == spark.sql("SELECT sha2('', 256) AS h").first().h


def plain_similar(texts, similarity=0.8):
    """Least index reachable over all pairs of exact shingle sets."""
    sets = {}
    for i, t in enumerate(texts):
        words = t.lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    return plain_groups(sets, lambda a, b: len(a & b) + 1e-9 >= similarity * len(a | b))


def kept(spark, texts, **options):
    return {r.doc_id: r.keep_id for r in simhash.similar_groups(frame(spark, texts), **options).collect()}


def test_thousands_around_one_base(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 9)))
    base = [word() for _ in range(300)]
    texts = []
    for _ in range(2000):
        copy = list(base)
        for at in rng.sample(range(300), 6):
            copy[at] = word()
        texts.append(" ".join(copy))  # 0.8 or more like the base, but hardly any other copy
    texts.insert(1000, " ".join(base))
    assert set(kept(spark, texts).values()) == {0}


def test_groups_without_a_middle(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 9)))
    texts, now = [], [word() for _ in range(120)]
    for _ in range(150):  # each is like the next ones only
        now = [*now[3:], *(word() for _ in range(3))]
        texts.append(" ".join(now))
    base = [word() for _ in range(120)]
    for _ in range(150):  # links here and there
        copy = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            copy[at] = word()
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    for bucket in (32, 2):
        assert kept(spark, texts, max_bucket=bucket) == plain_similar(texts)


def test_passages_added_cut_and_replaced(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    texts = []
    for k in range(40):
        base = [word() for _ in range(rng.choice([40, 120, 300]))]
        n = len(base)
        cut, new = int(n * rng.uniform(0.05, 0.22)), [word() for _ in range(n)]
        swap = int(n * rng.uniform(0.02, 0.12))
        texts += [" ".join(x) for x in (base, base + new[:cut], base[: n - cut], base[: n // 3] + new[:swap] + base[n // 3 + swap :])][:: 1 if k % 2 else -1]
    assert kept(spark, texts) == plain_similar(texts)
