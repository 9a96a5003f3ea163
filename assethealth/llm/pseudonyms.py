"""Format-preserving Feistel pseudonyms for personal data, in DataFrame operations alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assethealth.llm.shared import text_or_empty

ROUNDS = 8
# Every part starts where no part of the same kind can run on to the left, and
# repeats possessively, so a text is gone through once. Nothing without a bound
# repeats but single characters: a repeated group would take a stack frame a turn.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*+"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])"
PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9A-Za-z])"
KINDS = ("email", "ip", "date", "card", "phone")
PATTERN = "|".join(f"(?:{p})" for p in (EMAIL, IPV4, DATE, CARD, PHONE))

#: A Gregorian cycle of 400 years from here has exactly 189 * 773 days.
CYCLE_START, CYCLE_DAYS, CYCLE_A, CYCLE_B = "1700-01-01", 146097, 189, 773
#: Of these, 9 * 9833 are after the twelfth of their month.
LATE_A, LATE_B = 9, 9833


def _number(key: str, kind: str, step: Column, value: Column) -> Column:
    """A keyed pseudo-random number below 2^60 for one Feistel round."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel_pair(left: Column, right: Column, sizes: tuple[int, int], key: str, kind: str) -> Column:
    """A keyed permutation of pairs below ``sizes``: struct ``l``, ``r``."""
    a, b = sizes

    def step(acc: Column, i: Column) -> Column:
        size = F.when(i % 2 == 1, F.lit(a)).otherwise(F.lit(b)).cast("long")
        return F.struct(acc["r"].alias("l"), F.pmod(acc["l"] + F.pmod(_number(key, kind, i, acc["r"]), size), size).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def feistel_text(value: Column, key: str, kind: str) -> Column:
    """A keyed permutation of strings that keeps each character's class.

    Digits become digits, small and capital letters likewise, other characters
    stay. The halves are shifted in turn, each by a stream keyed by the other.
    """
    half = F.floor(F.length(value) / 2).cast("int")

    def shifted(part: Column, other: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other), 256)

        def one(c: Column, at: Column, stream: Column) -> Column:
            by = F.conv(F.substr(stream, at % 31 * 2 + 1, F.lit(4)), 16, 10).cast("int")
            turn = lambda first, n: F.char((F.pmod(F.ascii(c) - first + by, F.lit(n)) + first).cast("int"))
            return F.when(c.rlike("^[0-9]$"), turn(48, 10)).when(c.rlike("^[a-z]$"), turn(97, 26)).when(c.rlike("^[A-Z]$"), turn(65, 26)).otherwise(c)

        # the stream is bound to a variable, so that it is made once and not for each character
        chars = F.filter(F.split(part, ""), lambda c: c != "")
        return F.transform(F.array(stream), lambda s: F.array_join(F.transform(chars, lambda c, at: one(c, at, s)), ""))[0]

    def step(acc: Column, i: Column) -> Column:
        return F.struct(acc["r"].alias("l"), shifted(acc["l"], acc["r"], i).alias("r"))

    start = F.struct(F.substr(value, F.lit(1), half).alias("l"), F.substr(value, half + 1, F.length(value)).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""
    each = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    values = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda acc, v: acc + v)


def _into(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced by ``digits``, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    each = F.filter(F.split(template, ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(acc["out"], F.when(digit, F.substr(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + digit.cast("int")).alias("at"))

    return F.aggregate(each, start, step, lambda acc: acc["out"])


def card_pseudonym(value: Column, key: str) -> Column:
    """All digits but the last are permuted; the last is the check digit anew."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    body = feistel_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    return _into(value, F.concat(body, F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")))


def ip_pseudonym(value: Column, key: str) -> Column:
    octet = lambda i: F.element_at(F.split(value, r"\."), i).cast("long")
    pair = feistel_pair(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), (65536, 65536), key, "ip")
    return F.transform(F.array(pair), lambda p: F.concat_ws(".", *[x.cast("string") for s in ("l", "r") for x in (F.shiftright(p[s], 8), F.pmod(p[s], F.lit(256)))]))[0]


def _day(value: Column) -> Column:
    """The date that a match is, or null: ISO, day first, or month first where only that is a date."""
    return F.coalesce(F.try_to_date(value, "yyyy-MM-dd"), F.try_to_date(value, "dd/MM/yyyy"), F.try_to_date(value, "MM/dd/yyyy"), F.try_to_date(value, "dd.MM.yyyy"))


def _start() -> Column:
    return F.lit(CYCLE_START).cast("date")


def late_number(day: Column) -> Column:
    """Place of a day after the twelfth of its month among all such days, from 0."""
    months = (F.year(day) - 1700) * 12 + F.month(day) - 1
    return F.datediff(day, _start()) - 12 * (months + 1)


def late_day(number: Column) -> Column:
    """The day of that place: the months before it are about its place over the mean number of such days, give or take one."""
    guess = F.floor(number * F.lit(4800 / (LATE_A * LATE_B))).cast("int")
    days = F.transform(F.sequence(guess - 2, guess + 2), lambda m: F.date_add(_start(), (number + 12 * (m + 1)).cast("int")))
    return F.filter(days, lambda d: (F.dayofmonth(d) > 12) & (late_number(d) == number))[0]


def date_pseudonym(value: Column, key: str) -> Column:
    """Days of the 400 years from 1700 are permuted, so one day stays one day in all its spellings but month first.

    Those that can only be month first have days after the twelfth, and are
    permuted among themselves: another day would be read day first.
    """
    day = _day(value)
    number = F.datediff(day, _start())
    any_day = feistel_pair(F.floor(number / CYCLE_B), F.pmod(number, F.lit(CYCLE_B)), (CYCLE_A, CYCLE_B), key, "date")
    late = feistel_pair(F.floor(late_number(day) / LATE_B), F.pmod(late_number(day), F.lit(LATE_B)), (LATE_A, LATE_B), key, "late date")

    def written(p: Column) -> Column:
        d = F.date_add(_start(), (p["l"] * CYCLE_B + p["r"]).cast("int"))
        return F.when(value.contains("-"), F.date_format(d, "yyyy-MM-dd")).when(value.contains("."), F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy"))

    month_first = value.contains("/") & F.try_to_date(value, "dd/MM/yyyy").isNull()
    by_month = F.transform(F.array(late), lambda p: F.date_format(late_day(p["l"] * LATE_B + p["r"]), "MM/dd/yyyy"))[0]
    return F.when(month_first, by_month).otherwise(F.transform(F.array(any_day), written)[0])


def phone_pseudonym(value: Column, key: str) -> Column:
    """A leading country code stays; all other digits are permuted."""
    code = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .-])", 0)
    rest = F.substr(value, F.length(code) + 1, F.length(value))
    return F.concat(code, _into(rest, feistel_text(F.regexp_replace(rest, "[^0-9]", ""), key, "phone")))


def email_pseudonym(value: Column, key: str) -> Column:
    """The name before the @ is permuted; the host stays."""
    return F.concat(feistel_text(F.substring_index(value, "@", 1), key, "email"), F.lit("@"), F.substring_index(value, "@", -1))


def kind_of(value: Column) -> Column:
    """The kind of a match, or null if it is not valid: octets to 255 without leading zeros, days that exist from 1700 to 2099, Luhn sums."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    octets = F.forall(F.split(value, r"\."), lambda o: (o.cast("int") <= 255) & ((o == "0") | ~o.startswith("0")))
    day = _day(value)
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(f"^{IPV4}$"), F.when(octets, "ip"))
        .when(value.rlike(f"^(?:{DATE})$"), F.when(day.between(F.lit("1700-01-01").cast("date"), F.lit("2099-12-31").cast("date")), "date"))
        .when(value.rlike(f"^(?:{CARD})$"), F.when(luhn_sum(digits) % 10 == 0, "card"))
        .when(value.rlike(f"^(?:{PHONE})$"), "phone")
    )


def pseudonym(kind: Column, value: Column, key: str) -> Column:
    """The pseudonym of a valid value; others stay as they are."""
    makers = {"email": email_pseudonym, "ip": ip_pseudonym, "date": date_pseudonym, "card": card_pseudonym, "phone": phone_pseudonym}
    cases = reduce(lambda acc, k: acc.when(kind == k, makers[k](value, key)), KINDS[1:], F.when(kind == KINDS[0], makers[KINDS[0]](value, key)))
    return cases.otherwise(value)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``text`` pseudonymised, and how many values of each kind were: ``n_<kind>``.

    E-mail addresses, IPv4 addresses, dates, payment card numbers (Luhn) and
    telephone numbers are replaced by keyed permutations of the same format:
    equal values stay equal across documents, different ones stay different,
    and the result is as valid as the original. What only looks like such a
    value (a wrong check digit, octet or day) is left alone. A null text stays
    null; other columns are kept, whatever their names, but for ``n_<kind>`` of
    the same name. An empty table gives none; repeated rows stay so.
    """
    text = text_or_empty()
    blank = F.array().cast("array<string>")
    found = F.when(text.rlike("[0-9]|@"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(blank)
    marked = F.transform(found, lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))
    rows = docs.select(F.struct("*").alias("row"), text.alias("body"), marked.alias("found"))
    hit = F.exists("found", lambda m: m["kind"].isNotNull())
    new = F.transform("found", lambda m: F.when(m["kind"].isNull(), m["value"]).otherwise(pseudonym(m["kind"], m["value"], key)))
    joined = F.array_join(F.zip_with(F.split(F.col("body"), PATTERN, -1), new, lambda gap, v: F.concat(gap, F.coalesce(v, F.lit("")))), "")
    of_kind = lambda k: F.size(F.filter("found", lambda m: m["kind"] == k)).cast("long")
    counts = {f"n_{k}": of_kind(k) for k in KINDS}
    kept = {c: F.col("row").getField(c) for c in docs.columns if c not in counts}
    kept["text"] = F.when(hit, joined).otherwise(kept["text"])
    return rows.select(*[v.alias(c) for c, v in (kept | counts).items()])
