"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame operations only.

Each value that passes its format's own test (check digit, calendar, ranges) is
permuted within the format by a keyed Feistel network: a card stays a valid card of
the same length and separators, a date stays a date. The permutation depends on
the key and the kind only, so equal values stay linked across documents however they
are punctuated, and different ones stay different.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from penstock.llm.common import table

ROUNDS = 8
#: Setting that holds the key; the fallback is for tests.
KEY_SETTING, TEST_KEY = "spark.penstock.pseudonym.secret.key", "not a secret"

# What personal values look like.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}"
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
def _iban_pattern() -> str:
    """Compact or in groups of four, of the length of its country; a country that is not listed may have any."""
    listed = []
    for length, countries in IBAN_LENGTHS.items():
        groups, rest = divmod(length - 4, 4)
        tail = rf"(?: ?[A-Z0-9]{{{rest}}})" if rest else ""
        listed.append(rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{tail}")
    known = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
    other = rf"(?!{known})[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
    return "|".join([*listed, other])


IBAN = _iban_pattern()
IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
ISO_DATE, SLASH_DATE, DOT_DATE = r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}\.\d{2}\.\d{4}"
CARD = r"\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4} \d{6} \d{5}|\d{13,19}"
SSN = r"\d{3}-\d{2}-\d{4}"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
PATTERNS = (
    rf"(?<![A-Za-z0-9._%+-]){EMAIL}(?![A-Za-z0-9])",
    rf"(?<![A-Za-z0-9])(?:{IBAN})(?![A-Za-z0-9])",
    rf"(?<![A-Za-z0-9]|\d\.){IPV4}(?![A-Za-z0-9]|\.\d)",
    rf"(?<![A-Za-z0-9]|\d[-/.])(?:{ISO_DATE}|{SLASH_DATE}|{DOT_DATE})(?![A-Za-z0-9]|[-/.]\d)",
    rf"(?<![A-Za-z0-9])(?:{CARD})(?![A-Za-z0-9])",
    rf"(?<![A-Za-z0-9-]){SSN}(?![A-Za-z0-9]|-\d)",
    rf"(?<![A-Za-z0-9+])(?:{PHONE})(?![A-Za-z0-9])",
)
ANY = "|".join(PATTERNS)

#: One Gregorian cycle: 400 years of days, as a product for the two halves.
CYCLE, DAYS_A, DAYS_B, DAY_ZERO = 146_097, 189, 773, "1800-01-01"
#: The days of a cycle from the 13th of a month on, likewise, and its months.
LATE, LATE_A, LATE_B, MONTHS = 88_497, 9, 9_833, 4_800


def _drawn(key: str, kind: str, turn: Column, other: Column) -> Column:
    """512 keyed bits, as hex, from one half in one round."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), other), 512)


def _feistel(left: Column, right: Column, moved: Callable[[Column, Column, Column], Column]) -> Column:
    """struct(l, r) after all rounds; moved(half, other, round) must be invertible in `half`."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        F.struct(left.alias("l"), right.alias("r")),
        lambda acc, turn: F.when(turn % 2 == 1, F.struct(acc["l"].alias("l"), moved(acc["r"], acc["l"], turn).alias("r")))
        .otherwise(F.struct(moved(acc["l"], acc["r"], turn).alias("l"), acc["r"].alias("r"))),
    )


def permuted_text(text: Column, key: str, kind: str) -> Column:
    """Digits become digits and letters letters of the same case; the rest stays."""

    def moved(half: Column, other: Column, turn: Column) -> Column:
        stream = _drawn(key, kind, turn, other)

        def one(c: Column, i: Column) -> Column:
            step = F.conv(F.substr(stream, (i * 3) % 126 + 1, F.lit(3)), 16, 10).cast("int")
            code = F.ascii(c)
            turned = lambda first, size: F.char((code - first + step) % size + first)
            return (
                F.when(c.between("0", "9"), turned(48, 10)).when(c.between("a", "z"), turned(97, 26)).when(c.between("A", "Z"), turned(65, 26)).otherwise(c)
            )

        return F.array_join(F.transform(F.split(half, ""), one), "")

    cut = F.floor(F.length(text) / 2).cast("int")
    state = _feistel(F.substr(text, F.lit(1), cut), F.substr(text, cut + 1), moved)
    return _with(state, lambda s: F.concat(s["l"], s["r"]))


def permuted_pair(left: Column, right: Column, key: str, kind: str, a: Column | int, b: Column | int) -> Column:
    """struct(l, r): a permutation of the pairs of a number below `a` and one below `b`."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (a, b))

    def moved(half: Column, other: Column, turn: Column) -> Column:
        step = F.conv(F.substr(_drawn(key, kind, turn, other.cast("string")), F.lit(1), F.lit(15)), 16, 10).cast("long")
        size = F.when(turn % 2 == 1, b).otherwise(a)
        return (half + step % size) % size

    return _feistel(left.cast("long"), right.cast("long"), moved)


def permuted_number(number: Column, key: str, kind: str, a: int, b: int) -> Column:
    """A permutation of 0 .. a*b-1."""
    whole = number.cast("long")
    return _with(permuted_pair(F.floor(whole / F.lit(b)), whole % b, key, kind, a, b), lambda s: s["l"] * b + s["r"])


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _laid_out(text: Column, digits: Column, skipped: int | Column = 0) -> Column:
    """`text` with its digits replaced in turn by `digits`, the first `skipped` digits left alone."""
    skipped = F.lit(skipped) if isinstance(skipped, int) else skipped

    def one(c: Column, i: Column) -> Column:
        nth = F.length(_digits(F.substr(text, F.lit(1), i + 1))) - skipped
        return F.when(c.between("0", "9") & (nth > 0), F.substr(digits, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column, doubled_last: bool) -> Column:
    """Luhn sum; `doubled_last` when the check digit is still missing."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    odd = 0 if doubled_last else 1

    def add(acc: Column, x: Column) -> Column:
        twice = x["d"] * 2
        return acc + F.when(x["i"] % 2 == odd, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(x["d"])

    return F.aggregate(values, F.lit(0), add)


def _mod97(text: Column) -> Column:
    def add(acc: Column, c: Column) -> Column:
        value = F.when(c.between("A", "Z"), F.ascii(c) - 55).otherwise(c.cast("int"))
        return (acc * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), permuted_text(F.substr(digits, F.lit(2), F.length(digits) - 2), key, "card"))
    new = _with(body, lambda b: F.concat(b, ((10 - _luhn(b, True) % 10) % 10).cast("string")))
    return F.when(_luhn(digits, False) % 10 == 0, _laid_out(m, new))


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, account = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
    new = permuted_text(account, key, "iban")
    check = lambda a: F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0")
    compact = _with(new, lambda a: F.concat(country, check(a), a))
    spaced = F.array_join(
        F.transform(
            F.split(m, ""),
            lambda c, i: F.when(c == " ", c).otherwise(F.substr(compact, F.length(F.replace(F.substr(m, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1))),
        ),
        "",
    )
    valid = (_mod97(F.concat(account, F.substr(plain, F.lit(1), F.lit(4)))) == 1) & F.length(plain).between(15, 34)
    return F.when(valid, spaced)


def _ipv4(m: Column, key: str) -> Column:
    """Each octet keeps its number of digits; there are 10, 90 or 156 octets of one, two or three."""
    octets = F.split(m, r"\.")
    part = lambda k: F.element_at(octets, k)
    count = lambda k: F.element_at(F.array(F.lit(10), F.lit(90), F.lit(156)), F.length(part(k))).cast("long")
    first = lambda k: F.element_at(F.array(F.lit(0), F.lit(10), F.lit(100)), F.length(part(k))).cast("long")
    half = lambda i, j: (part(i).cast("long") - first(i)) * count(j) + part(j).cast("long") - first(j)
    new = permuted_pair(half(1, 2), half(3, 4), key, "ipv4", count(1) * count(2), count(3) * count(4))

    def shown(s: Column) -> Column:
        pairs = ((s["l"], 1, 2), (s["r"], 3, 4))
        return F.concat_ws(".", *[x.cast("long").cast("string") for v, i, j in pairs for x in (F.floor(v / count(j)) + first(i), v % count(j) + first(j))])

    plain = F.forall(octets, lambda x: (x.cast("long") <= 255) & (x == x.cast("long").cast("string")))
    return F.when(plain, _with(new, shown))


def _late_day(day: Column, key: str) -> Column:
    """A permutation, within its cycle, of the days from the 13th of a month on: those that read one way only with slashes."""
    zero = F.lit(DAY_ZERO).cast("date")
    since = F.datediff(day, zero)
    cycle, within = F.floor(since / CYCLE), F.pmod(since, F.lit(CYCLE))

    def months(n: Column) -> Column:  # of the cycle, before the nth day
        at = F.date_add(zero, n.cast("int"))
        return (F.year(at) - 1800) * 12 + F.month(at) - 1

    def before(month: Column) -> Column:  # late days before that month of the cycle
        return F.datediff(F.add_months(zero, month.cast("int")), zero) - 12 * month

    def placed(n: Column) -> Column:
        # months have 16 to 19 late days, so the right one is next to the one an even spread gives
        guess = F.floor(n * MONTHS / LATE)
        near = F.filter(F.sequence(F.greatest(guess - 2, F.lit(0)), guess + 2), lambda x: (before(x) <= n) & (n < before(x + 1)))
        return _with(F.get(near, F.lit(0)), lambda month: n + 12 * (month + 1))

    rank = within - 12 * (months(within) + 1)
    new = permuted_number(rank, key, "late-date", LATE_A, LATE_B)
    return F.date_add(zero, (_with(new, placed) + cycle * CYCLE).cast("int"))


def _date(m: Column, key: str) -> Column:
    """Dates with slashes are of the month first where that is possible; the others, of the 13th or later, stay among themselves."""
    iso, dotted = m.rlike("^" + ISO_DATE), m.contains(".")
    formats = {
        "iso": F.when(iso, F.try_to_timestamp(m, F.lit("yyyy-MM-dd"))),
        "dots": F.when(dotted, F.try_to_timestamp(m, F.lit("dd.MM.yyyy"))),
        "us": F.when(~iso & ~dotted, F.try_to_timestamp(m, F.lit("MM/dd/yyyy"))),
    }
    late = F.when(~iso & ~dotted & formats["us"].isNull(), F.try_to_timestamp(m, F.lit("dd/MM/yyyy"))).cast("date")
    day = F.coalesce(*formats.values()).cast("date")
    zero = F.lit(DAY_ZERO).cast("date")
    since = F.datediff(day, zero)
    cycle = F.floor(since / CYCLE)
    new = permuted_number(F.pmod(since, F.lit(CYCLE)), key, "date", DAYS_A, DAYS_B) + cycle * CYCLE
    early = _with(
        F.date_add(zero, new.cast("int")),
        lambda d: F.when(formats["iso"].isNotNull(), F.date_format(d, "yyyy-MM-dd")).when(formats["dots"].isNotNull(), F.date_format(d, "dd.MM.yyyy"))
        .when(formats["us"].isNotNull(), F.date_format(d, "MM/dd/yyyy")),
    )
    return F.when(late.isNotNull(), F.date_format(_late_day(late, key), "dd/MM/yyyy")).otherwise(early)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.element_at(F.split(m, "-"), k).cast("long") for k in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    number = ((area - 1 - (area > 666).cast("long")) * 99 + group - 1) * 9999 + serial - 1
    new = permuted_number(number, key, "ssn", 898, 99 * 9999)
    pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")

    def shown(n: Column) -> Column:
        area = F.floor(n / (99 * 9999)) + 1
        return F.concat_ws("-", pad(area + (area > 665).cast("long"), 3), pad(F.floor(n / 9999) % 99 + 1, 2), pad(n % 9999 + 1, 4))

    return F.when(valid, _with(new, shown))


def _phone(m: Column, key: str) -> Column:
    digits = _digits(m)
    code = F.when(m.startswith("+"), F.length(F.regexp_extract(m, r"^\+(\d{1,3})", 1))).otherwise(0)
    # an unbroken number gives away no country code: its first digit stands for one
    code = F.when(m.rlike(r"^\+\d+$"), F.lit(1)).otherwise(code)
    local = F.substr(digits, code + 1)
    return F.when(F.length(digits).between(7, 15) & (F.length(local) > 3), _laid_out(m, permuted_text(local, key, "phone"), code))


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(permuted_text(F.substr(m, F.lit(1), at - 1), key, "email"), F.substr(m, at))


KINDS: dict[str, tuple[str, Callable[[Column, str], Column]]] = {
    "email": (EMAIL, _email),
    "ipv4": (IPV4, _ipv4),
    "date": (f"{ISO_DATE}|{SLASH_DATE}|{DOT_DATE}", _date),
    "card": (CARD, _card),
    "ssn": (SSN, _ssn),
    "phone": (PHONE, _phone),
    "iban": (IBAN, _iban),
}


def _found(text: Column, key: str) -> Column:
    """array<struct<kind, old, new>> of all candidates in order; new is null where the test fails."""

    def one(m: Column) -> Column:
        kind = F.lit(None).cast("string")
        for name in reversed(KINDS):
            kind = F.when(m.rlike(f"^(?:{KINDS[name][0]})$"), F.lit(name)).otherwise(kind)

        def judged(k: Column) -> Column:
            new = F.lit(None).cast("string")
            for name in reversed(KINDS):
                new = F.when(k == name, KINDS[name][1](m, key)).otherwise(new)
            return F.struct(k.alias("kind"), m.alias("old"), new.alias("new"))

        return _with(kind, judged)

    return F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), one)


def pseudonymised(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """`docs` with personal values in `text` replaced; all other columns as they are.

    Cards must pass the Luhn test, IBANs modulo 97; dates must exist, octets be at
    most 255, social security numbers be assignable, phone numbers have 7 to 15
    digits. What fails stays. E-mail addresses keep their domain. The first digit
    of a card and the country code of a phone number or IBAN stay.

    `found` names an additional column with the replaced values,
    array<struct<kind, old, new>>. Null and empty texts stay as they are and have
    found nothing; each row is handled by itself, so repeated rows give repeated results.
    """
    # names of the given table can't clash with these
    work, pieces = "__pseudonyms", "__pieces"
    looked = docs.withColumn(work, F.when(F.col(text).rlike("[0-9@]"), _found(F.col(text), key)))
    looked = looked.withColumn(pieces, F.when(F.size(work) > 0, F.split(text, ANY, -1)))
    joined = F.array_join(
        F.zip_with(pieces, work, lambda p, m: F.concat(p, F.coalesce(m["new"], m["old"], F.lit("")))), ""
    )
    out = looked.withColumn(text, F.coalesce(joined, F.col(text)))
    if found:
        kept = F.filter(work, lambda m: m["new"].isNotNull())
        out = out.withColumn(found, F.coalesce(kept, F.array().cast("array<struct<kind:string,old:string,new:string>>")))
    keep = [c for c in docs.columns if c != found] + ([found] if found else [])
    return out.select(*[F.col(f"`{c}`") for c in keep])


def pseudonym_key(spark: SparkSession) -> str:
    """The key of the session; without one, the public test key, with a warning, for pseudonyms under it can be undone by anyone."""
    key = spark.conf.get(KEY_SETTING, None)
    if key is None:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms are made with the public test key and protect nothing", stacklevel=2)
    return key or TEST_KEY


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_replaced, kinds (sorted, comma-joined) for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pseudonymised(docs, pseudonym_key(spark), found="found")
    kinds = F.array_join(F.array_sort(F.array_distinct(F.col("found.kind"))), ",")
    return done.select("doc_id", "text", F.size("found").cast("long").alias("n_replaced"), kinds.alias("kinds"))
