"""The queries opN_<name> and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assethealth.llm import decontaminate, divergence, exact_dedup, langid, lexical, mixing, pseudonyms, quality_rules, secret_scan, sharding, simhash, toxicity, warc
from assethealth.llm.shared import fresh_dir, text_or_empty

#: Toxicity categories of the chain in its order; ``labels`` has one, which follows low quality.
CATEGORIES = ("low_quality", "toxic")
#: Setting that names the key of pseudonyms. Spark shows it in plans and event logs, so keep those as safe as the key.
PSEUDONYM_KEY = "assethealth.pseudonyms.key"
SHARDS = 40
#: SQL that lower-cases A-Z of a text, null as empty.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(of: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) mod ``of`` is ``remainder``; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of == remainder, F.lit(False))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dup_groups(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = {"text_sha256": F.sha2(text_or_empty(), 256)}
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), digest).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path, min_bytes=0)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "segments", "intact")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.col("items").alias("item_ids"), F.round("overlap", 6).alias("overlap"))


def toxicity_chain(spark: SparkSession, sf_dir: str) -> toxicity.Chain:
    """The chain fitted on all labelled documents of a folder."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.fit_chain(table(spark, sf_dir, "documents"), labels, CATEGORIES)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_chain(table(spark, sf_dir, "documents"), toxicity_chain(spark, sf_dir))
    return scored.select("doc_id", F.col("is_toxic").alias("toxic"), F.col("p_toxic").alias("score"), F.col("p_low_quality").alias("low_quality_score"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", _held_out(4, 2))
    model = langid.fit_centroids(docs.where(~F.col("held_out")))
    return langid.predict_language(docs, model).select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == secret_scan.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.concat("base", "linked"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"), secret_scan.listed(every).alias("spans"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.round("position", 9).alias("position"))


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, spark.conf.get(PSEUDONYM_KEY, "example-key"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~_held_out(5, 0)).select("doc_id", "quality")
    model = quality_rules.fit_rules(docs, labels, "quality")
    scored = quality_rules.score_quality(docs, model)
    return scored.select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [F.col("doc_id"), F.crc32(text_or_empty()).alias("text_crc32")]
    sharded = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS, columns)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_exact_dedup, op3_warc, op4_decontaminate, op5_toxicity, op6_language_id, op7_secret_scan, op8_mixing, op9_pseudonyms, op10_quality,
        op11_divergence, op12_lexical_search, op13_sharding,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op8_mixing": r"""
        WITH sized AS (
          SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                 CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size
          FROM documents),
        sources AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                 (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS k
          FROM sized GROUP BY source),
        weighed AS (
          SELECT *, 3.0 * source_size AS cap, CAST([5, 2, 1][k + 1] AS DOUBLE) AS weight, CAST([0.5, 1, 3][k + 1] AS DOUBLE) AS ramp FROM sources),
        levels AS (
          SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                    / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM weighed),
        targets AS (
          SELECT source, source_size, ramp,
                 least(cap, weight * coalesce((SELECT arg_min(level, cap / weight) FROM levels WHERE level * weight <= cap), 1e300)) AS target
          FROM levels),
        placed AS (
          SELECT doc_id, size, source_size, target, ramp,
                 CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
          FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
        took AS (
          SELECT *, CAST(greatest(0, least(size, round(target) - begins)) + greatest(0, least(size, round(target) - begins - source_size))
                         + greatest(0, least(size, round(target) - begins - 2 * source_size)) AS BIGINT) AS taken
          FROM placed),
        shares AS (SELECT *, (begins + least(size, taken) / 2) / nullif(target, 0) * (1 + ramp) / 2 AS need FROM took)
        SELECT doc_id, size, source_size, round(target, 6) AS target, taken,
               CASE WHEN taken > 0 THEN round(CASE WHEN ramp = 1 THEN need ELSE (sqrt(1 + 2 * (ramp - 1) * need) - 1) / (ramp - 1) END, 9) END AS position
        FROM shares
    """,
    "op11_divergence": rf"""
        WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, {LOWERED} AS text FROM documents),
        rows AS (SELECT *, row_number() OVER () AS d FROM docs),
        words AS (SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM rows),
        kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
        languages AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(total) AS HUGEINT) AS n FROM kept GROUP BY lang),
        sources AS (SELECT DISTINCT lang, source FROM docs),
        counts AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
        cells AS (
          SELECT s.lang, s.source, k.term, k.total, CAST(coalesce(c.c, 0) AS HUGEINT) AS c
          FROM sources s JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
        sums AS (SELECT lang, source, CAST(sum(c) AS HUGEINT) AS n FROM cells GROUP BY lang, source),
        rates AS (
          SELECT c.*, 1 + (1000000000 * (c.c + 2)) // (s.n + 2 * l.v) AS p, 1 + (1000000000 * (c.total + 2)) // (l.n + 2 * l.v) AS q
          FROM cells c JOIN sums s USING (lang, source) JOIN languages l USING (lang)),
        apart AS (
          SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
          FROM rates a JOIN rates b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pairs AS (
          SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN apart p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
        terms AS (
          SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM rates WHERE c > 0 AND p > q),
        ranked AS (
          SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
          FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
    "op12_lexical_search": rf"""
        WITH words AS (
          SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        asked AS (
          SELECT DISTINCT item_id, term
          FROM (SELECT item_id, unnest(regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
        sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
        corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
        held AS (SELECT doc_id, term, count(*) AS tf FROM words SEMI JOIN asked USING (term) GROUP BY doc_id, term),
        weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, corpus GROUP BY term, docs),
        impacts AS (
          SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)) AS impact
          FROM held JOIN sizes USING (doc_id), corpus),
        scores AS (
          SELECT item_id, doc_id, CAST(sum(w * impact) AS BIGINT) AS score
          FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_id, doc_id),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
    """,
}
