"""Personal data: format-preserving Feistel pseudonyms, in SQL functions only.

What looks like a card, telephone, social security or network number, a date, an address or a credential is validated and
replaced by another value of the same format. Numbers and dates are pairs (x, y) of two ranges; rounds add a keyed
hash of one half to the other, so the mapping is a permutation of the format: equal values stay equal and different ones
different in all documents, and with the key the rounds can be undone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.naming import fresh

ROUNDS = 8
# The notations that are recognised.
# Repeated groups are bounded, for the engine goes one level deeper with every repetition: a host name has 127 labels at most.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,}"
SECRET = r"\bAKIA[0-9A-Z]{16}\b|(?i:\b(?:password|passwd|secret|token|api_key)\s?[=:]\s?\"?)[A-Za-z0-9_+/-]{8,}"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d.]*\d)"
DATE = r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = (
    r"(?<![\d.])(?<!\d-)(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})"
    r"(?!-?\d)"
)
_CODE = r"(?>[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9]\d\d)"
#: A country code, and one digit in brackets behind it, as in +44 (0)20.
_ABROAD = rf"\+(?!1){_CODE}(?:[ ]?\(\d\))?"
PHONE = (
    r"\+1(?:[ ./()-]{0,2}+\d){10}(?!\d)"
    r"|(?:(?<!\d)1[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    r"|(?<!\d)(?:1[ .-]\d{3}|[2-9]\d{2})[ .-]\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\w.])1?\d{10}(?!\w|\.\d)"
    # Abroad: 5 to 14 digits; behind the fifth, what looks like another kind is not taken in.
    rf"|(?<!\w){_ABROAD}(?:[ ./()-]{{0,2}}+\d){{5}}(?:(?:[ ./()-]{{1,2}}+(?!{IP}|{DATE}|{SSN}|{CARD}))?\d){{0,9}}(?!\d)"
)
#: What the first four digits of a card say of its issuer.
ISSUER = r"^(?:4|5[0-8]|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)|3(?:0[0-5]|[4-9])|6[0-7])"
#: In the order in which they are tried at a place in the text.
KINDS = {"email": EMAIL, "secret": SECRET, "ip": IP, "date": DATE, "ssn": SSN, "card": CARD, "phone": PHONE}
ANY = "|".join(KINDS.values())
#: Dates from 1900-03-01 on, 17 * 4297 days, to 2100-02-28 are personal dates; others stay.
FIRST_DAY, DATE_X, DATE_Y = -25508, 17, 4297


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _long(column: Column) -> Column:
    return column.cast("bigint")


def _hash(key: str, kind: str, round_: Column, half: Column) -> Column:
    """48 bits of a keyed hash."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), half.cast("string"))
    return _long(F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10))


def permute(x: Column, y: Column, size_x: Column, size_y: Column, key: str, kind: str) -> Column:
    """Struct ``x, y``: the keyed permutation of the pairs below ``size_x`` and ``size_y``."""

    def step(state: Column, r: Column) -> Column:
        a, b = state["x"], state["y"]
        new_a = F.when(r % 2 == 0, (a + _hash(key, kind, r, b)) % size_x).otherwise(a)
        new_b = F.when(r % 2 == 1, (b + _hash(key, kind, r, a)) % size_y).otherwise(b)
        return F.struct(new_a.alias("x"), new_b.alias("y"))

    begin = F.struct(_long(x).alias("x"), _long(y).alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, step)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _into(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced, in order, by those of ``digits`` (as many)."""

    def place(i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        nth = F.length(_digits(F.substring(text, F.lit(1), i)))
        return F.when(c.between("0", "9"), F.substring(digits, nth, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), place), "")


def _luhn_sum(digits: Column, doubled_first: Column) -> Column:
    """Luhn's sum; ``doubled_first`` says whether the leftmost digit counts twice."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (i + F.when(doubled_first, 1).otherwise(0)) % 2 == 0
        return total + F.when(twice, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _power(n: Column) -> Column:
    return _long(F.rpad(F.lit("1"), n + 1, "0"))


def _padded(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _split_digits(digits: Column, left: Column, key: str, kind: str) -> Column:
    """All digits permuted among numbers of as many digits; ``left`` of them are one half."""
    right = F.length(digits) - left
    pair = permute(
        F.substring(digits, F.lit(1), left), F.substring(digits, left + 1, right), _power(left), _power(right), key, kind
    )
    return _let(pair, lambda p: F.concat(_padded(p["x"], left), _padded(p["y"], right)))


def _card(text: Column, key: str) -> Column:
    """Cards whose first digits are an issuer's and that Luhn's check finds valid. The first four digits stay, so that the
    issuer does; the last is the new check digit, and all between are permuted."""

    def changed(digits: Column) -> Column:
        size = F.length(digits)
        valid = digits.rlike(ISSUER) & (_luhn_sum(digits, size % 2 == 0) % 10 == 0)
        middle = _split_digits(F.substring(digits, F.lit(5), size - 5), F.floor((size - 5) / 2).cast("int"), key, "card")
        check = lambda b: ((10 - _luhn_sum(b, size % 2 == 0) % 10) % 10).cast("string")
        body = F.concat(F.substring(digits, F.lit(1), F.lit(4)), middle)
        new = _let(_let(body, lambda b: F.concat(b, check(b))), lambda d: _into(text, d))
        return F.when(valid, new)

    return _let(_digits(text), changed)


def _phone(text: Column, key: str) -> Column:
    """The ten digits of a number of country code 1, which itself stays, as does whether the first of them is 0 or 1; of
    other countries all digits behind the code."""
    all_digits = _digits(text)
    ten = F.substring(all_digits, F.length(all_digits) - 9, F.lit(10))
    area, rest = _long(F.substring(ten, F.lit(1), F.lit(3))), F.substring(ten, F.lit(4), F.lit(7))
    low = area < 200
    first, areas = F.when(low, 0).otherwise(200), F.when(low, 200).otherwise(800)
    pair = permute(area - first, _long(rest), areas, F.lit(10_000_000), key, "phone")
    country = F.substring(all_digits, F.lit(1), F.length(all_digits) - 10)
    home = _let(pair, lambda p: F.concat(country, _padded(p["x"] + first, 3), _padded(p["y"], 7)))

    def abroad(code: Column) -> Column:
        national = F.substring(all_digits, F.length(code) + 1, F.length(all_digits))
        return F.concat(code, _split_digits(national, F.floor(F.length(national) / 2).cast("int"), key, "phone abroad"))

    code = _digits(F.regexp_extract(text, f"^{_ABROAD}", 0))
    new = F.when(text.rlike(r"^\+(?!1)"), _let(code, abroad)).otherwise(home)
    return _let(new, lambda d: _into(text, d))


def _ip(text: Column, key: str) -> Column:
    parts = F.transform(F.split(text, r"\."), lambda p: p.cast("int"))
    pair = permute(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], F.lit(65536), F.lit(65536), key, "ip")

    def dotted(p: Column) -> Column:
        octets = [F.floor(p["x"] / 256), p["x"] % 256, F.floor(p["y"] / 256), p["y"] % 256]
        return F.concat_ws(".", *[o.cast("string") for o in octets])

    return F.when(F.array_max(parts) <= 255, _let(pair, dotted))


def _ssn(text: Column, key: str) -> Column:
    """Valid numbers: area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = (_long(p) for p in (F.substring(text, 1, 3), F.substring(text, 5, 2), F.substring(text, 8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    x = area - F.when(area > 666, 2).otherwise(1)
    pair = permute(x, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")

    def dashed(p: Column) -> Column:
        new_area = p["x"] + F.when(p["x"] >= 665, 2).otherwise(1)
        return F.concat_ws(
            "-", _padded(new_area, 3), _padded(F.floor(p["y"] / 9999) + 1, 2), _padded(p["y"] % 9999 + 1, 4)
        )

    return F.when(valid, _let(pair, dashed))


def _date(text: Column, key: str) -> Column:
    """Days that exist, year-month-day, month/day/year and day.month.year, in the range of personal dates."""
    out = F.lit(None).cast("string")
    for sign, pattern in (("-", "yyyy-MM-dd"), ("/", "MM/dd/yyyy"), (".", "dd.MM.yyyy")):
        day = F.unix_date(F.try_to_timestamp(text, F.lit(pattern)).cast("date")) - FIRST_DAY
        pair = permute(F.floor(day / DATE_Y), day % DATE_Y, F.lit(DATE_X), F.lit(DATE_Y), key, "date")
        new = _let(pair, lambda p: F.date_from_unix_date((p["x"] * DATE_Y + p["y"] + FIRST_DAY).cast("int")))
        valid = F.contains(text, F.lit(sign)) & day.between(0, DATE_X * DATE_Y - 1)
        out = F.coalesce(out, F.when(valid, F.date_format(new, pattern)))
    return out


def _shifted(half: Column, other: Column, r: Column, key: str, kind: str) -> Column:
    """Letters and digits of one half moved on within their class by a keyed hash of the other."""
    stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), other), 256)
    return _let(stream, lambda s: _moved(half, s))


def _moved(half: Column, stream: Column) -> Column:
    def move(c: Column, i: Column) -> Column:
        k = F.conv(F.substring(stream, 1 + 2 * (i % 32), F.lit(2)), 16, 10).cast("int")
        within = lambda low, size: F.char(F.lit(low) + (F.ascii(c) - low + k) % size)
        return (
            F.when(c.between("a", "z"), within(97, 26))
            .when(c.between("A", "Z"), within(65, 26))
            .when(c.between("0", "9"), within(48, 10))
            .otherwise(c)
        )

    letters = F.filter(F.split(half, ""), lambda c: c != "")
    return F.array_join(F.transform(letters, move), "")


def permute_text(text: Column, key: str, kind: str) -> Column:
    """Keyed permutation of a text that keeps every character's class and all other characters."""
    left = F.floor(F.length(text) / 2).cast("int")

    def step(state: Column, r: Column) -> Column:
        a, b = state["x"], state["y"]
        new_a = F.when(r % 2 == 0, _shifted(a, b, r, key, kind)).otherwise(a)
        new_b = F.when(r % 2 == 1, _shifted(b, a, r, key, kind)).otherwise(b)
        return F.struct(new_a.alias("x"), new_b.alias("y"))

    begin = F.struct(
        F.substring(text, F.lit(1), left).alias("x"), F.substring(text, left + 1, F.length(text)).alias("y")
    )
    pair = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, step)
    return _let(pair, lambda p: F.concat(p["x"], p["y"]))


def _email(text: Column, key: str) -> Column:
    local = F.substring_index(text, "@", 1)
    return F.concat(permute_text(local, key, "email"), F.lit("@"), F.substring_index(text, "@", -1))


def _secret(text: Column, key: str) -> Column:
    value = F.regexp_extract(text, r"(?:^AKIA|[=:]\s?\"?)([A-Za-z0-9_+/-]+)$", 1)
    head = lambda v: F.substring(text, F.lit(1), F.length(text) - F.length(v))
    return _let(value, lambda v: F.concat(head(v), permute_text(v, key, "secret")))


_MAKERS = {"email": _email, "secret": _secret, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def _kind(found: Column) -> Column:
    """Which notation a match has: the first that covers it whole, as in the search."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(list(KINDS.items())):
        kind = F.when(found.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return kind


def pseudonym(found: Column, key: str) -> Column:
    """Struct ``kind, value``: the pseudonym of a match; kind null and value unchanged if it does not validate."""

    def made(kind: Column) -> Column:
        value = F.lit(None).cast("string")
        for name, make in _MAKERS.items():
            value = F.when(kind == name, make(found, key)).otherwise(value)
        both = lambda v: F.struct(
            F.when(v.isNotNull(), kind).alias("kind"), F.coalesce(v, found).alias("value")
        )
        return _let(value, both)

    return _let(_kind(found), made)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with its text replaced by one with pseudonyms, ``n_private`` and one count ``n_<kind>`` per kind.

    Columns of ``docs`` that have these names are replaced. Null texts stay null, with zero counts; empty texts stay empty.
    Every match of the whole text is treated. Rows are independent: equal texts get equal results under one key.
    """
    source, name = F.col(text), fresh(docs, "_found")
    held = F.coalesce(source, F.lit(""))
    matches = F.when(held.rlike("[0-9@]|AKIA|(?i:passw|secret|token|api_key)"), F.regexp_extract_all(held, F.lit(ANY), F.lit(0)))
    found = F.transform(F.coalesce(matches, F.array().cast("array<string>")), lambda m: pseudonym(m, key))
    # What lies between the matches, and the matches' pseudonyms, in turn.
    joined = F.array_join(
        F.zip_with(
            F.split(held, ANY, -1),
            F.transform(F.col(name), lambda f: f["value"]),
            lambda gap, value: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(value, F.lit(""))),
        ),
        "",
    )

    def count(kind: str) -> Column:
        return F.size(F.filter(name, lambda f: f["kind"] == kind)).cast("bigint")

    private = F.size(F.filter(name, lambda f: f["kind"].isNotNull())).cast("bigint")
    return (
        docs.withColumn(name, found)
        .withColumns(
            {
                text: F.when(F.size(name) > 0, joined).otherwise(source),
                "n_private": private,
                **{f"n_{kind}": count(kind) for kind in KINDS},
            }
        )
        .drop(name)
    )
