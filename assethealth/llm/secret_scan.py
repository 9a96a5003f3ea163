"""Secret scan with multipart credential linking, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assethealth.llm.shared import text_or_empty, written
from assethealth.llm.spans import matches

# fixed values: the base patterns
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run of 16 or more; shorter runs hold no other match
HEX = r"[0-9a-f]{32,}"  # likewise
# weak parts: each alone is common in clean text
IDENTIFIER = r"(?i)(?<![A-Za-z0-9])(?:access_?key(?:_?id)?|client_?id|account(?:_?id)?|user_?name|user|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,}"
SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}"  # with a small letter, a capital and a digit
ENDPOINT = r"(?i)https?://[a-z0-9.-]+(?::[0-9]{2,5})?|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}:[0-9]{2,5}(?![0-9])"
#: Kinds in the order in which spans at one start are listed.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
#: Code points between the starts of parts that belong together, at most.
SCOPE = 400

ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
IDENTIFIER_WORDS = ("access", "client", "account", "user", "login")


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end")))


def _none() -> Column:
    return F.array().cast("array<struct<start:int,rank:int,end:int>>")


def _if(found: Column, kind: str, near: Column) -> Column:
    """The spans, looked for only in texts that pass a cheaper test."""
    return F.when(near, _spans(found, kind)).otherwise(_none())


def base_spans(text: Column) -> Column:
    """Spans of the three base kinds, sorted by start, then kind."""
    low = F.lower(text)
    some = lambda words: F.greatest(*[low.contains(w) for w in words])
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= 8)
    return F.array_sort(F.concat(_if(assign, "assign", some(ASSIGN_WORDS)), _if(matches(text, ACCESS), "access", text.contains("AKIA")), _if(matches(text, HEX), "hex", text.rlike(HEX))))


def weak_spans(text: Column) -> Column:
    """Spans of the three weak kinds."""
    low = F.lower(text)
    secret = F.filter(matches(text, SECRET), lambda m: m["value"].rlike("[a-z]") & m["value"].rlike("[A-Z]") & m["value"].rlike("[0-9]"))
    named = F.greatest(*[low.contains(w) for w in IDENTIFIER_WORDS])
    return F.concat(_if(matches(text, IDENTIFIER), "identifier", named), _if(secret, "secret", text.rlike(SECRET)), _if(matches(text, ENDPOINT), "endpoint", low.contains("http") | text.rlike(r"[0-9]:[0-9]{2}")))


def linked_spans(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts of ``parts(doc, start, rank, end)`` that stand near complementary ones.

    An identifier (access keys count) needs a secret (assignments and hex
    strings count) whose start is within ``scope``, a secret needs an
    identifier, and an endpoint needs both. The interval join goes by blocks
    of ``scope`` code points: a part meets the parts of its own and the two
    next blocks, so no group is larger than what one stretch of text holds.
    """
    role = F.when(F.col("rank").isin(1, 3), "i").when(F.col("rank") == 5, "e").otherwise("s")
    rows = parts.withColumns({"role": role, "block": F.floor(F.col("start") / scope)})
    roles = rows.where("role <> 'e'").select("doc", F.col("role").alias("other"), F.col("start").alias("at"), F.explode(F.array(F.col("block") - 1, "block", F.col("block") + 1)).alias("block"))
    met = rows.where("rank > 2").join(roles.distinct(), ["doc", "block"]).where(F.abs(F.col("start") - F.col("at")) <= scope)
    met = met.select("doc", "start", "rank", "end", F.col("role").alias("own"), "other")
    found = met.groupBy("doc", "start", "rank", "end", "own").agg(F.bool_or(F.col("other") == "i").alias("i"), F.bool_or(F.col("other") == "s").alias("s"))
    return found.where("(own = 'i' AND s) OR (own = 's' AND i) OR (own = 'e' AND i AND s)").select("doc", "start", "rank", "end")


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, base, linked``: span arrays (start, rank in KINDS, end) of each whole text.

    ``base`` has the assignments of 8 characters or more, access identifiers
    of 16 or more and hex strings of 32 or more; ``linked`` the weak parts that
    complementary parts stand near (see ``linked_spans``). A null text is
    empty. Parts meet under a hash of doc_id and text, so rows that repeat, or
    share or lack a doc_id, keep their own spans. Extra columns are ignored.
    """
    text = text_or_empty()
    own = F.col("doc_id").cast("string")
    known = F.coalesce(F.concat(F.length(own).cast("string"), F.lit(":"), own), F.lit("none"))
    found = docs.select("doc_id", F.sha2(F.concat(known, F.lit("\n"), text), 256).alias("doc"), base_spans(text).alias("base"), weak_spans(text).alias("weak"))
    found = written(found, "spans")
    both = found.where(F.size("weak") > 0).select("doc", F.explode(F.concat("base", "weak")).alias("s")).select("doc", "s.start", "s.rank", "s.end").distinct()
    linked = linked_spans(written(both, "parts"), scope).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("linked"))
    linked = written(linked, "linked")
    return found.join(linked, "doc", "left").select("doc_id", "base", F.coalesce("linked", _none()).alias("linked"))

