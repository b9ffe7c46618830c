"""PII: format-preserving pseudonyms from a keyed Feistel network, in DataFrame functions.

Mail addresses, phone numbers, IPv4 addresses, card numbers (Luhn), social security numbers, dates and long
hexadecimal secrets are found, validated, and permuted within their format under a key, so that an equal value
has an equal pseudonym in every document and the pseudonym is again valid. The permutation is a bijection: the
key's owner can undo it, and different values stay different.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import text_or_empty

ROUNDS = 6
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What each kind looks like. At a place, the first that fits counts.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,128}(?![A-Za-z0-9])",
    "date": r"(?<![\d./\-])(?:(?:19\d\d|20\d\d|2100)-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([./])(?:0[1-9]|1[0-2])\1(?:19\d\d|20\d\d|2100))(?![\d/\-]|\.\d)",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .\-]?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|(?<!\d)\(\d{3}\)[ \-]?\d{3}[ .\-]\d{4}(?!\d)",
    "ssn": r"(?<![\d\-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d\-])",
    "card": r"(?<![\d\-.])\d(?:[ \-]?\d){12,18}(?!\d|[\-.]\d)",
}
#: What every value holds: a digit, the sign of a mail address, or a long row of letters that may be a number. A look for
#: these costs a small part of a search for the patterns.
HINT = "[0-9@]|[A-Fa-f]{32}"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: All kinds but cards, which are sought between the others' values; and digit groups, in a row, of 13 or more digits.
OTHERS = "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "card")
RUN = r"(?<![\d\-.])(?=\d(?:[ \-]?\d){12})\d++(?!\.\d)(?:[ \-]\d++(?!\.\d))*+"
#: Dates from FIRST_DAY on, DATE_A * DATE_B of them (to 2100-01-01).
FIRST_DAY, DATE_A, DATE_B = "1900-01-01", 150, 487
_HEX = "0123456789abcdef"


def _with(value: Column, f) -> Column:
    """f of a value that is computed once for all its uses."""
    return F.get(F.transform(F.array(value), f), 0)


def _shift(c: Column, by: Column, alphabet: str) -> Column:
    code = F.ascii(c)
    if alphabet == "hex":
        at = F.instr(F.lit(_HEX), c) - 1
        return F.substring(F.lit(_HEX), (at + by) % 16 + 1, F.lit(1))
    turned = F.lit(None).cast("string")
    for first, last in (("0", "9"), ("a", "f"), ("A", "F")) if alphabet == "cased hex" else (("0", "9"), ("a", "z"), ("A", "Z")):
        size = ord(last) - ord(first) + 1
        turned = F.coalesce(turned, F.when(c.between(first, last), F.char((code - ord(first) + by) % size + ord(first))))
    return F.coalesce(turned, c)


def _mask(text: Column, other: Column, salt: Column, alphabet: str) -> Column:
    """Each character moved within its class by a byte of the keyed hash of the other half."""
    stream = F.sha2(F.concat_ws("|", salt, other), 512)

    def move(keys: Column) -> Column:
        chars = F.filter(F.split(text, ""), lambda c: c != "")
        byte = lambda i: F.conv(F.substring(keys, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.array_join(F.transform(chars, lambda c, i: _shift(c, byte(i), alphabet)), "")

    return _with(stream, move)


def feistel(text: Column, key: str, kind: str, alphabet: str = "alnum") -> Column:
    """A keyed permutation of strings that keeps each character's class (digit, lower, upper case; hex digit;
    or digit, lower, upper case of hex digits).

    Halves of the string are moved in turn, each by a hash of the key, the round and the other half.
    """
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.length(text)).alias("r"))

    def one(s: Column, k: Column) -> Column:
        salt = F.concat_ws("|", F.lit(key), F.lit(kind), k.cast("string"))
        odd = k % 2 == 1
        return F.struct(
            F.when(odd, _mask(s["l"], s["r"], salt, alphabet)).otherwise(s["l"]).alias("l"),
            F.when(odd, s["r"]).otherwise(_mask(s["r"], s["l"], salt, alphabet)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one, lambda s: F.concat(s["l"], s["r"]))


def _number(key: str, salt: str, k: Column, value: Column, size: int) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(salt), k.cast("string"), value.cast("string")), 256), 1, 12), 16, 10).cast("long") % size


def permute_day(day: Column, key: str) -> Column:
    """A keyed permutation of the days from FIRST_DAY on, by their number."""
    start = F.struct(F.floor(day / DATE_B).cast("long").alias("a"), (day % DATE_B).cast("long").alias("b"))

    def one(s: Column, k: Column) -> Column:
        odd = k % 2 == 1
        return F.struct(
            F.when(odd, (s["a"] + _number(key, "date", k, s["b"], DATE_A)) % DATE_A).otherwise(s["a"]).alias("a"),
            F.when(odd, s["b"]).otherwise((s["b"] + _number(key, "date", k, s["a"], DATE_B)) % DATE_B).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, one, lambda s: (s["a"] * DATE_B + s["b"]).cast("int"))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last of which counts once."""
    values = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(values, F.lit(0), lambda acc, v: acc + F.when(v > 9, v - 9).otherwise(v))


def _refill(shape: Column, digits: Column) -> Column:
    """The digits put in order where `shape` has digits."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(chars, start, lambda s, c: F.when(
        c.between("0", "9"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))), lambda s: s["out"])


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _iso(s: Column) -> Column:
    """A date of either form as yyyy-mm-dd."""
    return F.when(F.substring(s, 5, 1) == "-", s).otherwise(
        F.concat_ws("-", F.substring(s, 7, 4), F.substring(s, 4, 2), F.substring(s, 1, 2)))


def _date(s: Column, key: str) -> Column:
    day = F.datediff(_iso(s).try_cast("date"), F.lit(FIRST_DAY).cast("date"))
    iso = F.date_add(F.lit(FIRST_DAY).cast("date"), permute_day(day, key)).cast("string")
    return _with(iso, lambda d: F.when(F.substring(s, 5, 1) == "-", d).otherwise(
        F.concat_ws("", F.substring(d, 9, 2), F.substring(s, 3, 1), F.substring(d, 6, 2), F.substring(s, 3, 1), F.substring(d, 1, 4))))


def _ip(s: Column, key: str) -> Column:
    packed = F.lower(F.array_join(F.transform(F.split(s, "[.]"), lambda o: F.lpad(F.hex(o.cast("int")), 2, "0")), ""))
    return _with(feistel(packed, key, "ip", "hex"), lambda h: F.concat_ws(
        ".", *[F.conv(F.substring(h, 2 * k + 1, 2), 16, 10) for k in range(4)]))


def _card(s: Column, key: str) -> Column:
    d = _digits(s)
    body = feistel(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    full = _with(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    return _with(full, lambda f: _refill(s, f))


def _cards(run: Column, key: str) -> Column:
    """Struct (text, n) of a run of digit groups: its card numbers replaced, from the left, the longest first.

    A card number is any row of whole groups with 13 to 19 digits and a right Luhn sum: an expiry date, a room
    or another number beside it doesn't hide it.
    """
    groups, gaps = F.regexp_extract_all(run, F.lit(r"(\d+)"), 1), F.split(run, r"\d+", -1)

    def step(groups: Column, gaps: Column, s: Column, i: Column) -> Column:
        digits = lambda j: F.array_join(F.slice(groups, i + 1, j - i + 1), "")
        valid = lambda d: F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0)
        ends = F.filter(F.sequence(F.least(i + 18, F.size(groups) - 1), i, F.lit(-1)), lambda j: _with(digits(j), valid))
        span = lambda j: F.array_join(F.transform(F.sequence(i, j), lambda k: F.concat(F.when(k > i, F.get(gaps, k)).otherwise(""), F.get(groups, k))), "")
        taken = lambda j: F.struct(
            F.concat(s["text"], F.get(gaps, i), F.when(j.isNotNull(), _card(span(j), key)).otherwise(F.get(groups, i))).alias("text"),
            (s["n"] + j.isNotNull().cast("int")).alias("n"), (F.coalesce(j, i) + 1).alias("at"))
        return F.when(i < s["at"], s).otherwise(_with(F.get(ends, 0), taken))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(0).alias("at"))
    return _with(F.struct(groups.alias("groups"), gaps.alias("gaps")), lambda x: F.aggregate(
        F.sequence(F.lit(0), F.size(x["groups"]) - 1), start, lambda s, i: step(x["groups"], x["gaps"], s, i), lambda s: F.struct(s["text"].alias("text"), s["n"].alias("n"))))


def _all_cards(text: Column, key: str) -> Column:
    """Struct (text, n) of a text with its card numbers replaced."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(RUN), 0), lambda r: _cards(r, key))
    found = _with(F.struct(runs.alias("runs"), F.split(text, RUN, -1).alias("gaps")), lambda x: F.struct(
        F.concat(F.get(x["gaps"], 0), F.array_join(F.transform(x["runs"], lambda r, i: F.concat(r["text"], F.get(x["gaps"], i + 1))), "")).alias("text"),
        F.aggregate(x["runs"], F.lit(0), lambda n, r: n + r["n"]).alias("n")))
    return F.when(text.rlike(RUN), found).otherwise(F.struct(text.alias("text"), F.lit(0).alias("n")))


def _phone(s: Column, key: str) -> Column:
    d = _digits(s)
    head = F.length(d) - 10
    return _with(F.concat(F.substring(d, F.lit(1), head), feistel(F.substring(d, head + 1, F.lit(10)), key, "phone")), lambda f: _refill(s, f))


def _ssn(s: Column, key: str) -> Column:
    # area 001-665 and 667-899, group 01-99, serial 0001-9999: the places of all such numbers, permuted as two halves
    area = F.substring(s, 1, 3).cast("long")
    a = F.when(area > 666, area - 2).otherwise(area - 1)
    b = (F.substring(s, 5, 2).cast("long") - 1) * 9999 + F.substring(s, 8, 4).cast("long") - 1
    size_a, size_b = 898, 99 * 9999

    def one(x: Column, k: Column) -> Column:
        odd = k % 2 == 1
        return F.struct(
            F.when(odd, (x["a"] + _number(key, "ssn", k, x["b"], size_a)) % size_a).otherwise(x["a"]).alias("a"),
            F.when(odd, x["b"]).otherwise((x["b"] + _number(key, "ssn", k, x["a"], size_b)) % size_b).alias("b"),
        )

    def show(x: Column) -> Column:
        n = F.when(x["a"] >= 665, x["a"] + 2).otherwise(x["a"] + 1)
        return F.concat_ws("-", F.lpad(n.cast("string"), 3, "0"), F.lpad((F.floor(x["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((x["b"] % 9999 + 1).cast("string"), 4, "0"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(a.alias("a"), b.alias("b")), one, show)


def _email(s: Column, key: str) -> Column:
    at = F.instr(s, "@")
    first = F.substring_index(F.substring(s, at + 1, F.length(s)), ".", 1)  # the domain's first label
    own = F.concat(F.substring(s, F.lit(1), at), first)
    return _with(own, lambda o: F.concat(feistel(o, key, "email"), F.substring(s, F.length(o) + 1, F.length(s))))


def _full(pattern: str) -> str:
    return f"^(?:{pattern})$"


def pseudonym(s: Column, key: str) -> Column:
    """The pseudonym of a found value other than a card number; null if it isn't valid."""
    is_ = lambda kind: s.rlike(_full(PATTERNS[kind]))
    return (
        F.when(s.contains("@"), _email(s, key))
        .when(is_("hex"), F.when(s.rlike("[A-F]"), feistel(s, key, "hex", "cased hex")).otherwise(feistel(s, key, "hex", "hex")))
        .when(is_("date"), F.when(_iso(s).try_cast("date").isNotNull() & (_iso(s) <= "2100-01-01"), _date(s, key)))
        .when(is_("ip"), _ip(s, key))
        .when(is_("phone"), _phone(s, key))
        .when(is_("ssn"), _ssn(s, key))
    )


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The rows with PII in `text` replaced by pseudonyms, and n_pii (long): how many were replaced.

    Values that fail validation (a card number's Luhn sum, a day that no month has) stay as they are, as do all
    other characters; a card number may be any whole groups of a row of digits. Null texts stay null with n_pii 0, empty texts empty. Rows are independent; an empty table
    gives an empty result. A column named n_pii in the input is replaced.
    """
    t = text_or_empty(text)
    own = docs.drop("n_pii") if text != "n_pii" else docs
    found = own.withColumn("__spans", F.when(t.rlike(HINT) & t.rlike(f"{OTHERS}|(?:{RUN})"), F.regexp_extract_all(t, F.lit(OTHERS), 0)))
    found = found.withColumn("__new", F.transform("__spans", lambda s: pseudonym(s, key)))
    found = found.withColumn("__gaps", F.when(F.col("__spans").isNotNull(), F.transform(F.split(t, OTHERS, -1), lambda g: _all_cards(g, key))))
    gaps, spans, new = F.col("__gaps"), F.col("__spans"), F.col("__new")
    rebuilt = F.concat(F.get(gaps, 0)["text"], F.array_join(
        F.transform(spans, lambda s, i: F.concat(F.coalesce(F.get(new, i), s), F.get(gaps, i + 1)["text"])), ""))
    return found.withColumns({
        text: F.when(spans.isNull(), F.col(text)).otherwise(rebuilt),
        "n_pii": F.when(spans.isNull(), F.lit(0)).otherwise(
            F.size(F.filter(new, lambda x: x.isNotNull())) + F.aggregate(gaps, F.lit(0), lambda n, g: n + g["n"])).cast("long"),
    }).drop("__spans", "__new", "__gaps")
