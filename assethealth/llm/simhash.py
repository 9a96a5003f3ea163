"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint's 64 bits are dealt to the seven nonzero vectors of three bits
(bit i to vector i mod 7 + 1). Mask v, one of those seven vectors, keeps the
bits whose vector has an odd product with v. Two differing bits leave at least
one of the seven masks untouched, so every pair within two bits agrees on some
masked value: no pair is missed (Pagh's covering codes, radius 2).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assethealth.llm.components import connected_components
from assethealth.llm.shared import map_texts, text_or_empty, written

RADIUS = 2
#: A bucket with more distinct fingerprints than this is linked through hubs.
MAX_BUCKET = 32


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def covering_masks() -> list[int]:
    """The seven masks, as signed 64-bit integers."""
    return [_signed(sum(1 << i for i in range(64) if bin((i % 7 + 1) & v).count("1") % 2)) for v in range(1, 8)]


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """All runs of ``size`` words, repeats included; fewer words give the whole sequence, none give nothing."""
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(size)), strict=False)]


def fingerprint(items: list[bytes], seed: int = 42, weights: np.ndarray | None = None) -> int:
    """Bit i is set if items of over half the weight have it set in XXH64; no items give zero."""
    return majority(np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in items), np.uint64, len(items)), weights)


def majority(h: np.ndarray, weights: np.ndarray | None = None) -> int:
    """The SimHash of 64-bit hashes: bit i is set if hashes of over half the weight have it set; none give zero."""
    if not len(h):
        return 0
    one = np.zeros(64)
    for at in range(0, len(h), 65536):
        bits = np.unpackbits(h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        one += bits.sum(0) if weights is None else weights[at : at + 65536] @ bits
    total = len(h) if weights is None else weights.sum()
    return int(np.packbits(one * 2 > total, bitorder="little").view("<u8")[0])


def shingle_fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (long) of each whole text; a null or blank text has fingerprint zero."""

    def make() -> Callable[[list[str]], dict]:
        return lambda texts: {"fp": [_signed(fingerprint(shingles(t.encode().lower().split(), size), seed)) for t in texts]}

    return map_texts(docs.select("doc_id", "text"), make, {"fp": "long"})


def links(fps: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """All links ``a < b`` of distinct ``fp`` at two or fewer differing bits, or links that join the same groups.

    Buckets of up to ``max_bucket`` fingerprints are compared pair by pair.
    In the rest, which only large groups of near copies fill, each fingerprint
    goes to the 65 values within one bit of it. Two fingerprints differ in at
    most two bits just when they share such a value, and a value has at most
    65 neighbours: linking each to the least of them joins exactly the same
    groups, at 65 rows a fingerprint however large the bucket.
    """
    masks = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(covering_masks())])
    keyed = fps.select("fp", F.explode(masks).alias("m")).select("fp", "m.mask", "m.key")
    sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(keyed.join(sizes, ["mask", "key"]), "buckets")
    small = shared.where(F.col("n") <= max_bucket).select("mask", "key", "fp")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    pairs = small.withColumnRenamed("fp", "a").join(small.withColumnRenamed("fp", "b"), ["mask", "key"]).where((F.col("a") < F.col("b")) & apart)
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])
    hubs = shared.where(F.col("n") > max_bucket).select("fp").distinct().select("fp", F.explode(near).alias("hub"))
    hubs = hubs.groupBy("hub").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    stars = hubs.select("a", F.explode("all").alias("b")).where("a <> b")
    return pairs.select("a", "b").union(stars)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_dup_groups(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """Group documents whose shingle fingerprints are linked, directly or through others.

    Returns one row a document: ``doc_id, fingerprint`` (16 hex digits),
    ``component_id`` (least doc_id of the group) and ``links`` (number of other
    fingerprints in its group). Copies share a fingerprint and are never
    expanded into pairs. Null, empty and blank texts all have fingerprint zero
    and are grouped like any other. A null doc_id stays in its group but never
    names it; repeated rows are returned repeatedly; other columns are ignored.
    An empty table gives an empty result.
    """
    rows = written(shingle_fingerprints(docs, size, seed), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = connected_components(links(fps.select("fp")).distinct())
    linked = fps.join(labels, F.col("fp") == F.col("node")).select("fp", "label", "first")
    groups = linked.groupBy("label").agg(F.min("first").alias("least"), (F.count("*") - 1).alias("others"))
    named = linked.join(groups, "label").select(F.col("fp").alias("own"), "least", "others")
    named = written(fps.join(named, F.col("fp") == F.col("own"), "left").select("fp", F.coalesce("least", "first").alias("component_id"), F.coalesce("others", F.lit(0)).alias("links")), "named")
    return rows.join(named, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id", "links")


# -- the filtering stage: copies of at least 0.8 similarity ------------------

#: Shingles whose counts order the rest, at most, and documents they are counted in, about.
COMMON, COUNTED = 500_000, 20_000
#: Texts of a block, and shingles of a block, about.
BLOCK, BLOCK_SHINGLES = 64, 65_536
#: Bits of a set's parity map, and of a wide one at most.
PARITY, WIDEST = 1024, 65_536


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """The distinct shingles' hashes, in their order."""
    s = shingles(words, size)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, s), np.uint64, len(s)).view(np.int64))


def parity_map(hashes: np.ndarray, bits: int = PARITY) -> np.ndarray:
    """Bit i says whether an odd number of hashes fall on i: two maps differ in no more bits than their sets do in hashes."""
    odd = np.bincount(hashes & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def wide_map(hashes: np.ndarray) -> np.ndarray | None:
    """The parity map of a large set, of more bits than it has hashes, up to ``WIDEST``; None where ``PARITY`` bits are as many.

    Small maps of large sets that share nothing are alike by chance and tell
    them apart no more. Halves of a map put together by XOR are the map of half
    the bits, so maps of different lengths can be compared.
    """
    bits = min(WIDEST, 1 << len(hashes).bit_length())
    return parity_map(hashes, bits) if bits > PARITY else None


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """``node`` and ``hashes``, the distinct shingle hashes of each text."""

    def make() -> Callable[[list[str]], dict]:
        def one(words: list[bytes]) -> tuple[bytes, np.ndarray]:
            return xxhash.xxh3_128_digest(b" ".join(words)), shingle_hashes(words, size)

        def columns(texts: list[str]) -> dict:
            rows = [one(t.encode().lower().split()) for t in texts]
            return {"node": [r[0] for r in rows], "hashes": [r[1] for r in rows]}

        return columns

    return map_texts(docs.select("text"), make, {"node": "binary", "hashes": "array<long>"})


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about ``COUNTED`` documents have, sorted, and their counts.

    They only set the order in ``prefixes``; any order gives the same pairs.
    """
    every = max(1, round(docs.count() / COUNTED))
    some = shingle_sets(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0), size)
    counts = written(some.select(F.explode("hashes").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") >= total / COMMON).toPandas().sort_values("token")
    return rows["token"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def prefixes(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """``doc_id, node`` (128-bit hash of the words), ``n`` distinct shingles, ``fp``, their SimHash, ``prefix``, the rarest of them, and the set's ``parity_map`` and ``wide_map``.

    Two sets of ``similarity`` or more have that share of either in common. So
    with all shingles in one order, each set's first n - ceil(similarity * n)
    + 1 meet: no pair is missed. Rare ones come first, to meet seldom otherwise.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, size))

    def make() -> Callable[[list[str]], dict]:
        common, counts = shared.value

        def prefix(h: np.ndarray) -> np.ndarray:
            n = len(h) - ceil(similarity * len(h) - 1e-9) + 1 if len(h) else 0
            if len(common):
                at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                h = h[np.argsort(np.where(common[at] == h, counts[at], 0), kind="stable")]
            return h[:n].copy()  # a view would hold the whole set

        def one(words: list[bytes]) -> tuple:
            h = shingle_hashes(words, size)
            return xxhash.xxh3_128_digest(b" ".join(words)), len(h), _signed(majority(h)), prefix(h), parity_map(h), wide_map(h)

        def columns(texts: list[str]) -> dict:
            rows = [one(t.encode().lower().split()) for t in texts]
            return {k: [r[i] for r in rows] for i, k in enumerate(("node", "n", "fp", "prefix", "parity", "wide"))}

        return columns

    return map_texts(docs.select("doc_id", "text"), make, {"node": "binary", "n": "long", "fp": "long", "prefix": "array<long>", "parity": "array<long>", "wide": "array<long>"})


def possible(drawn: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The pairs of ``drawn(a, b, common)`` that can have ``similarity``.

    ``common`` shingles of both prefixes are in small buckets; no more than
    the lesser number of either's in ``large`` ones come to those. All others
    that two sets share come after the prefix that ends first, so they are at
    most the longer rest. Parity maps bound the shared shingles too: sets
    differ in at least as many hashes as their maps do in bits.
    """
    names = ("n", "long", "large", "parity")
    one, two = (known.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in names]) for x in "ab")
    both = drawn.join(one, "a").join(two, "b")
    total = F.col("n_a") + F.col("n_b")
    least = F.lit(similarity / (1 + similarity)) * total - F.lit(1e-6)
    by_prefix = F.col("common") + F.least("large_a", "large_b") + F.greatest(F.col("n_a") - F.col("long_a"), F.col("n_b") - F.col("long_b"))
    alike = F.least("n_a", "n_b") + F.lit(1e-9) >= similarity * F.greatest("n_a", "n_b")
    return both.where(alike & (by_prefix >= least) & ((total - _apart(F.col("parity_a"), F.col("parity_b"))) / 2 >= least)).select("a", "b")


def _apart(a: Column, b: Column) -> Column:
    """Bits in which two maps of one length differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def possible_by_wide(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(a, b)`` of ``possible`` that can have ``similarity`` by their wide maps too, where both have one.

    Sizes of such pairs are less than twice apart, so a map is halved once at most.
    """
    one, two = (known.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"wide_{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b")

    def halved(x: str, other: str) -> Column:
        half = F.floor(F.size(x) / 2).cast("int")
        parts = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda v, w: v.bitwiseXOR(w))
        return F.when(F.size(x) > F.size(other), parts).otherwise(F.col(x))

    total = F.col("n_a") + F.col("n_b")
    able = (total - _apart(halved("wide_a", "wide_b"), halved("wide_b", "wide_a"))) / 2 >= F.lit(similarity / (1 + similarity)) * total - F.lit(1e-6)
    return both.where(F.col("wide_a").isNull() | F.col("wide_b").isNull() | able).select("a", "b")


def sets_of(wanted: DataFrame, firsts: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """``id, hashes`` of the ``wanted(id)``, made again from their texts."""
    named = written(firsts.join(wanted, "id", "left_semi").select("node", "id", "first"), "ends")
    texts = docs.select("doc_id", "text").join(named.select(F.col("first").alias("own")).distinct(), F.col("doc_id").eqNullSafe(F.col("own")), "left_semi")
    return written(shingle_sets(texts, size).join(named.select("node", "id"), "node").select("id", "hashes").dropDuplicates(["id"]), "sets")


def verified(candidates: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``candidates(a, b)`` whose sets have ``similarity`` or more."""
    first = candidates.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("set_a")), "a")
    both = first.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("set_b")), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where((common + F.lit(1e-9)) >= similarity * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")


def _sides(batch: pa.RecordBatch, row: int, field: str) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """Labels and the arrays of ``field`` of the two lists in a row of block pairs."""
    out = []
    for name in ("one", "two"):
        v = batch.column(name)[row].values
        out.append((v.field("label").to_numpy(zero_copy_only=False), [x.values.to_numpy(zero_copy_only=False) for x in v.field(field)]))
    return out


def possible_blocks(pairs: DataFrame, similarity: float) -> DataFrame:
    """Rows ``block_a, block_b`` of ``pairs`` with a pair of texts, of different labels, that can have ``similarity`` by their sizes and parity maps.

    Maps are compared at the length of the shortest.
    """

    def folded(x: np.ndarray, length: int) -> np.ndarray:
        while len(x) > length:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        return x

    def able(batch: pa.RecordBatch, row: int) -> bool:
        (la, ma), (lb, mb) = _sides(batch, row, "parity")
        na, nb = (batch.column(x)[row].values.field("n").to_numpy(zero_copy_only=False) for x in ("one", "two"))
        total = na[:, None] + nb[None, :]
        alike = (la[:, None] != lb[None, :]) & (np.minimum(na[:, None], nb[None, :]) + 1e-9 >= similarity * np.maximum(na[:, None], nb[None, :]))
        if not alike.any():
            return False
        length = min(map(len, [*ma, *mb]))
        ga, gb = (np.unpackbits(np.array([folded(x, length) for x in m], "<i8").view(np.uint8), axis=1).astype(np.float32) for m in (ma, mb))
        apart = ga.sum(1)[:, None] + gb.sum(1)[None, :] - 2 * (ga @ gb.T)
        return bool((alike & ((total - apart) / 2 >= similarity / (1 + similarity) * total - 1e-6)).any())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["block_a", "block_b"]).filter(pa.array([able(batch, i) for i in range(batch.num_rows)], pa.bool_()))

    return pairs.select("block_a", "block_b", "one", "two").mapInArrow(run, "block_a long, block_b long")


def block_links(pairs: DataFrame, similarity: float) -> DataFrame:
    """Distinct ``a, b``: labels with a link between them, from rows of two lists ``one`` and ``two`` of ``label, hashes``."""

    def found(batch: pa.RecordBatch, row: int) -> set[tuple[int, int]]:
        (la, sa), (lb, sb) = _sides(batch, row, "hashes")
        na, nb = (np.array([len(x) for x in s]) for s in (sa, sb))
        # shingles of one side alone cannot be common
        known = np.intersect1d(np.concatenate(sa), np.concatenate(sb))
        common = np.zeros((len(sa), len(sb)), np.float32)
        ma, mb = ([np.searchsorted(known, x[np.isin(x, known, assume_unique=True)]) for x in s] for s in (sa, sb))
        for at in range(0, len(known), 16384):
            grids = []
            for m in (ma, mb):
                grid = np.zeros((len(m), min(16384, len(known) - at)), np.float32)
                for k, x in enumerate(m):
                    grid[k, x[(x >= at) & (x < at + 16384)] - at] = 1
                grids.append(grid)
            common += grids[0] @ grids[1].T
        close = (la[:, None] != lb[None, :]) & (common + 1e-9 >= similarity * (na[:, None] + nb[None, :] - common))
        return {(int(la[x]), int(lb[y])) for x, y in zip(*np.nonzero(close), strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = sorted(set().union(*(found(batch, i) for i in range(batch.num_rows))))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return pairs.select("one", "two").mapInArrow(run, "a long, b long").distinct()


def links_between(big: DataFrame, labels: DataFrame, known: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame | None:
    """All links ``a, b`` between different ``labels`` of texts that share a bucket of ``big(token, id, n, m)``; none if each has one label.

    Every such pair of texts is compared, in blocks of texts of like size and
    by the same bucket, of one label where a label fills blocks: two blocks
    meet once, if they share a token and are not of one and the same label.
    Parity maps go first, then wide ones; sets only to pairs of blocks that these leave open.
    """
    rows = big.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    rows = written(rows, "labelled")
    open_ = written(rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token"), "open")
    if open_.isEmpty():
        return None
    rows = written(rows.join(open_, "token"), "open-buckets")
    homes = rows.groupBy("id").agg(F.max(F.struct("m", "token"))["token"].alias("home"), F.any_value("label").alias("label"), F.any_value("n").alias("n"))
    homes = written(homes.withColumn("fold", F.floor(F.log2("n")).cast("int")), "homes")
    many = written(homes.groupBy("home", "label").agg(F.count("*").alias("c")).where(F.col("c") >= BLOCK).select(F.col("home").alias("_home"), F.col("label").alias("_label")), "many")
    homes = homes.join(many, (F.col("home") == F.col("_home")) & (F.col("label") == F.col("_label")), "left").drop("_home")
    homes = written(homes.withColumn("part", F.coalesce("_label", F.lit(-1).cast("long"))).drop("_label"), "parts")
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.lit(BLOCK_SHINGLES) / F.pow(F.lit(2), F.col("fold"))))
    sizes = written(homes.groupBy("home", "part", "fold").agg(F.count("*").alias("c")), "parts-sizes")
    homes = homes.join(sizes, ["home", "part", "fold"]).withColumn("slot", F.pmod(F.xxhash64("id"), F.ceil(F.col("c") / room)))
    homes = written(homes.select("id", "label", "fold", F.xxhash64("home", "part", "fold", "slot").alias("block")), "placed")
    meet = rows.select("token", "id").join(homes, "id").groupBy("token", "block", "fold").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    meet = written(meet, "meet")
    one, two = (meet.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("block", "fold", "lo", "hi")]) for x in "ab")
    mixed = ~((F.col("lo_a") == F.col("hi_a")) & (F.col("lo_b") == F.col("hi_b")) & (F.col("lo_a") == F.col("lo_b")))
    pairs = one.join(two, "token").where((F.col("block_a") <= F.col("block_b")) & (F.abs(F.col("fold_a") - F.col("fold_b")) <= 1) & mixed)
    pairs = written(pairs.select("block_a", "block_b").distinct(), "block-pairs")

    def met(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
        pairs = pairs.join(blocks.select(F.col("block").alias("block_a"), F.col("members").alias("one")), "block_a")
        return pairs.join(blocks.select(F.col("block").alias("block_b"), F.col("members").alias("two")), "block_b")

    wanted = homes
    for name, of in (("", F.col("parity")), ("wide-", F.coalesce("wide", "parity"))):
        maps = wanted.join(known.select("id", "n", of.alias("parity")), "id").groupBy("block").agg(F.collect_list(F.struct("label", "n", "parity")).alias("members"))
        pairs = written(possible_blocks(met(pairs, written(maps, f"{name}maps")), similarity), f"{name}open-pairs")
        if pairs.isEmpty():
            return None
        wanted = written(homes.join(pairs.select(F.explode(F.array("block_a", "block_b")).alias("block")).distinct(), "block", "left_semi"), f"{name}open-blocks")
    blocks = wanted.join(sets(wanted.select("id")), "id").groupBy("block").agg(F.collect_list(F.struct("label", "hashes")).alias("members"))
    return block_links(met(pairs, written(blocks, "blocks")), similarity)


def simhash_pairs(texts: DataFrame) -> DataFrame:
    """``a < b``: pairs of ``texts(id, fp)`` whose fingerprints are equal or linked (``links``), one row a text and a link.

    Texts of one fingerprint are paired with the first of them, and those
    firsts with each other along the links.
    """
    firsts = written(texts.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("times")), "fingerprints")
    same = texts.join(firsts.where("times > 1"), "fp").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    ends = [firsts.select(F.col("fp").alias(x), F.col("first").alias(f"id_{x}")) for x in "ab"]
    near = links(firsts.select("fp")).distinct().join(ends[0], "a").join(ends[1], "b")
    return same.union(near.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")))


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """``node, doc_id, keep_id``: documents grouped by links of ``similarity`` (Jaccard, distinct ``size``-word shingles) or more.

    SimHash comes first: texts whose shingle sets have linked fingerprints
    (``simhash_pairs``) and ``similarity`` on the exact sets are one group.
    Pairs of 0.8 can differ in more bits than fingerprints are linked at, so
    what SimHash leaves apart is searched exactly. Candidates there share a
    shingle of their ``prefixes``, which no pair of ``similarity`` fails to do,
    and can have it (``possible``, ``possible_by_wide``); each is verified on the exact shingle sets,
    unless SimHash has joined both already.
    Buckets of up to ``max_bucket`` texts are compared pair by pair. In larger
    ones all texts are first compared with the one that shares most of its
    prefix, the likely original; then every pair that is not yet joined is
    compared too, block by block (``links_between``), so the groups are those
    of all pairs. ``keep_id`` is the least doc_id of the group. Null and blank
    texts have one shingle set, the empty one, and form one group; a null
    doc_id never names a group.
    """
    rows = written(prefixes(docs, size, similarity).withColumn("id", F.monotonically_increasing_id()), "prefixes")
    firsts = written(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("id").alias("id"), F.count("*").alias("times")), "firsts")
    again = firsts.where("times > 1").select("node", F.col("id").alias("kept"))
    again = written(rows.select("node", "id").join(again, "node").where("id <> kept").select("id"), "again")
    texts = rows.join(again, "id", "left_anti").select("id", "n", "fp", F.size("prefix").alias("long"), "prefix", "parity", "wide")
    alike = written(simhash_pairs(texts.where("n > 0").select("id", "fp")), "alike")
    sets = sets_of(alike.select(F.explode(F.array("a", "b")).alias("id")).distinct(), firsts, docs, size)
    joined = written(verified(alike, sets, similarity), "joined")
    labelled = written(connected_components(joined), "simhash-groups")
    keyed = texts.select("id", "n", F.explode("prefix").alias("token"))
    sizes = written(keyed.groupBy("token").agg(F.count("*").alias("m")).where("m > 1"), "tokens")
    shared = written(keyed.join(sizes, "token"), "buckets")
    members = shared.where(F.col("m") <= max_bucket).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("all")).groupBy("all").agg(F.count("*").alias("common"))
    fits = lambda x: (x["id"] > F.col("one.id")) & (F.least(x["n"], F.col("one.n")) + F.lit(1e-9) >= similarity * F.greatest(x["n"], F.col("one.n")))
    pairs = members.select("all", "common", F.explode("all").alias("one")).select(F.col("one.id").alias("a"), F.explode(F.filter("all", fits)).alias("two"), "common").select("a", F.col("two.id").alias("b"), "common")
    big = written(shared.where(F.col("m") > max_bucket), "large")
    central = written(big.groupBy("id").agg(F.count("*").alias("large")).join(texts.select("id", "long"), "id").select("id", "large", (F.col("large") / F.col("long")).alias("share")), "central")
    heads = written(big.join(central, "id").groupBy("token").agg(F.max(F.struct("share", "id"))["id"].alias("a")), "heads")
    stars = big.join(heads, "token").where("a <> id").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"), F.lit(0).cast("long").alias("common"))
    drawn = written(pairs.union(stars.distinct()).groupBy("a", "b").agg(F.sum("common").alias("common")), "drawn")
    known = texts.join(central.select("id", "large"), "id", "left").select("id", "n", "long", F.coalesce("large", F.lit(0)).alias("large"), "parity", "wide")
    one, two = (labelled.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}")) for x in "ab")
    apart = drawn.join(one, "a", "left").join(two, "b", "left").where(F.coalesce(F.col("label_a") != F.col("label_b"), F.lit(True))).select("a", "b", "common")
    candidates = written(possible_by_wide(written(possible(apart, known, similarity), "possible"), known, similarity), "candidates")
    sets = sets_of(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct(), firsts, docs, size)
    close = written(verified(candidates, sets, similarity).union(joined), "close")
    labels = connected_components(close)
    more = links_between(big, labels, known, lambda wanted: sets_of(wanted, firsts, docs, size), similarity)
    if more is not None:
        labels = connected_components(close.union(more))
    linked = firsts.select("id", "first").join(labels, F.col("id") == F.col("node")).select("id", "label", "first")
    groups = written(linked.groupBy("label").agg(F.min("first").alias("least")), "groups")
    named = written(linked.join(groups, "label").select(F.col("id").alias("own"), "least"), "named")
    kept = written(firsts.join(named, F.col("id") == F.col("own"), "left").select("node", F.coalesce("least", "first").alias("keep_id")), "kept")
    return rows.select("node", "doc_id").join(kept, "node")


def without_near_copies(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, one document of each group of ``similar_groups``: the least doc_id's.

    A document is a doc_id and a text, so rows that share a doc_id, or have
    none, are judged each by its own text; those without come last. Of texts
    with one doc_id in a group that with the least MD5 stays. Rows equal in
    both stay together: exact deduplication comes first. An empty table gives
    none.
    """
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("doc_id"), F.md5(text_or_empty()).alias("md5"))
    groups = similar_groups(docs.select(own.alias("doc_id"), "text"), size, similarity)
    stays = written(groups.where(F.col("doc_id") == F.col("keep_id")).select(F.col("doc_id").alias("own")).distinct(), "stays")
    rows = docs.select(own.alias("own"), F.struct("*").alias("row"))
    return rows.join(stays, "own", "left_semi").select("row.*")
