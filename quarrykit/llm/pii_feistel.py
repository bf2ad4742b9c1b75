"""Format-preserving pseudonyms for personal data, in built-in functions only.

Numbers and dates that pass their own validation are permuted within their
format by a keyed Feistel network, so a value becomes another valid value of
the same shape, equal values stay equal across documents, and the holder of the
key can undo it:

=======  ==========================================  =================================
kind     found and validated                         permuted over
=======  ==========================================  =================================
card     13-19 digits, Luhn                          all but the check digit, set anew
phone    +country (area) number; 3-3-4 groups        the digits after the country code
ssn      3-2-4 digits, area not 000, 666 or 9xx      the last six digits
ip       four octets up to 255                       32 bits
date     y-m-d, d.m.y, m/d/y; a day of 1800-2199     the 146,097 days of 400 years
=======  ==========================================  =================================

E-mail names keep their marks; their letters and digits are permuted likewise, as
numbers to the base 36, so different names stay different (in lower case).  Names
with other letters, and quoted ``token = "hex"`` secrets, get hex digits of a keyed
hash, as long as they were; of those, short ones may become equal.  Candidates
that fail validation (a number without a valid check digit, 2024-13-45) stay.

A network over (a, b) adds to a, modulo its range, a keyed hash of b, then to b
one of a, eight rounds; both ranges are exact, so no value needs a second walk.

The key is the caller's secret: an argument without a default.

Cases: a null text stays null, an empty one empty; rows are independent, so
repeats, ties and null ids change nothing; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.quality_rules import let

ROUNDS = 8
DAYS_A, DAYS_B = 189, 773  # 146,097 days: 400 Gregorian years
FIRST_DAY = "1800-01-01"

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"
TOKEN = r"(?<=[Tt][Oo][Kk][Ee][Nn] = \")[0-9A-Fa-f]{16,64}(?=\")"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)"
PHONE = r"\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d+(-])(?:\(\d{3}\) |\d{3}[.-])\d{3}[.-]\d{4}(?![\d-])|\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\d)"
DATE = r"(?<![\d.-])\d{4}-\d{2}-\d{2}(?![\d]|-\d)|(?<![\d.])\d{2}\.\d{2}\.\d{4}(?!\d|\.\d)|(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d)"
ANY = "|".join((EMAIL, TOKEN, IP, PHONE, DATE, SSN, CARD))
KINDS = ("card", "phone", "ssn", "ip", "date", "email", "token")


def _hash(key: str, tag: Column, r: Column, x: Column) -> Column:
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tag, r.cast("string"), x.cast("string")), 256), 1, 12), 16, 10).cast("long")


def feistel(a: Column, b: Column, range_a: Column, range_b: Column, tag: Column, key: str) -> Column:
    """struct(a, b), permuted within 0..range_a-1 and 0..range_b-1."""

    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(F.when(even, (s["a"] + _hash(key, tag, r, s["b"])) % range_a).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise((s["b"] + _hash(key, tag, r, s["a"])) % range_b).alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)


def _ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def permute_digits(digits: Column, tag: str, key: str) -> Column:
    """Another string of as many (2 to 18) digits."""

    def run(d: Column) -> Column:
        n = F.length(d)
        left = (n / 2).cast("int")
        right = n - left
        out = feistel(F.substring(d, F.lit(1), left), F.substring(d, left + 1, right), _ten_to(left), _ten_to(right), F.concat(F.lit(tag), n.cast("string")), key)
        return let(out, lambda s: F.concat(F.lpad(s["a"].cast("string"), left, F.lit("0")), F.lpad(s["b"].cast("string"), right, F.lit("0"))))

    return let(digits, run)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refill(shape: Column, digits: Column, like: str = "[0-9]") -> Column:
    """shape with its digits (characters like) replaced, in order, by digits."""

    def fill(d: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            fits = c.rlike(f"^{like}$")
            return F.struct(F.concat(s["out"], F.when(fits, F.substring(d, s["at"], F.lit(1))).otherwise(c)).alias("out"), F.when(fits, s["at"] + 1).otherwise(s["at"]).alias("at"))

        return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s["out"])

    return let(digits, fill)


def _luhn_sum(payload: Column) -> Column:
    """Luhn sum of the digits that stand before a check digit."""
    each = F.transform(F.split(F.reverse(payload), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c >= "5", 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _check_digit(payload: Column) -> Column:
    return F.pmod(F.lit(10) - _luhn_sum(payload) % 10, F.lit(10)).cast("string")


def _card(m: Column, key: str) -> Column:
    """Null unless the number is valid."""

    def valid(d: Column) -> Column:
        payload = F.substring(d, F.lit(1), F.length(d) - 1)
        new = lambda p: refill(m, F.concat(p, _check_digit(p)))
        return F.when(_check_digit(payload) == F.right(d, F.lit(1)), let(permute_digits(payload, "card", key), new))

    return let(digits_of(m), valid)


def _phone(m: Column, key: str) -> Column:
    """Null unless the number has the 7 to 15 digits of a telephone number."""
    country = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])", 0)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    new = F.concat(country, let(rest, lambda r: refill(r, permute_digits(digits_of(r), "phone", key))))
    return F.when(F.length(digits_of(m)).between(7, 15), new)


def _ssn(m: Column, key: str) -> Column:
    ok = ~F.substring(m, 1, 3).isin("000", "666") & (F.substring(m, 1, 1) != "9")
    return F.when(ok, F.concat(F.substring(m, 1, 3), let(F.substring(m, 4, 8), lambda r: refill(r, permute_digits(digits_of(r), "ssn", key)))))


def _ip(m: Column, key: str) -> Column:
    def valid(o: Column) -> Column:
        part = lambda i: F.element_at(o, i).cast("long")
        out = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65536), F.lit(65536), F.lit("ip"), key)
        text = let(out, lambda s: F.concat_ws(".", F.shiftright(s["a"], 8).cast("string"), (s["a"] % 256).cast("string"), F.shiftright(s["b"], 8).cast("string"), (s["b"] % 256).cast("string")))
        return F.when(F.forall(o, lambda x: x.cast("int") <= 255), text)

    return let(F.split(m, r"\."), valid)


def _date(m: Column, key: str) -> Column:
    def in_format(fmt: str) -> Column:
        day = F.datediff(F.to_date(F.try_to_timestamp(m, F.lit(fmt))), F.lit(FIRST_DAY).cast("date"))

        def move(n: Column) -> Column:
            out = feistel(F.floor(n / DAYS_B), n % DAYS_B, F.lit(DAYS_A), F.lit(DAYS_B), F.lit("date"), key)
            days = let(out, lambda s: (s["a"] * DAYS_B + s["b"]).cast("int"))
            return F.when((n >= 0) & (n < DAYS_A * DAYS_B), F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), days), fmt))

        return let(day, move)

    return F.when(m.contains("-"), in_format("yyyy-MM-dd")).when(m.contains("."), in_format("dd.MM.yyyy")).otherwise(in_format("MM/dd/yyyy"))


def _letters(text: Column, key: str, tag: str) -> Column:
    """As many hex digits of a keyed hash, however long the text."""

    def run(t: Column) -> Column:
        block = lambda i: F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), t, i.cast("string")), 256)
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(t) / 64).cast("int")), block)
        return F.substring(F.array_join(blocks, ""), F.lit(1), F.length(t))

    return let(F.lower(text), run)


def permute_name(name: Column, key: str) -> Column:
    """Another string of as many of a-z and 0-9 (lower case); different ones stay different.

    Pieces of up to 22 characters are pairs of numbers to the base 36, permuted; a
    piece's place is part of its key.
    """
    powers = F.array(*[F.lit(36**i) for i in range(12)])

    def piece(p: Column, at: Column) -> Column:
        n = F.length(p)
        left = (n / 2).cast("int")
        number = lambda t: F.coalesce(F.conv(F.nullif(t, F.lit("")), 36, 10), F.lit("0")).cast("long")
        out = feistel(number(F.substring(p, F.lit(1), left)), number(F.substring(p, left + 1, n - left)), F.get(powers, left), F.get(powers, n - left), F.concat(F.lit("name"), n.cast("string"), F.lit("."), at.cast("string")), key)
        half = lambda x, size: F.lpad(F.lower(F.conv(x.cast("string"), 10, 36)), size, F.lit("0"))
        return let(out, lambda s: F.concat(F.when(left > 0, half(s["a"], left)).otherwise(""), half(s["b"], n - left)))

    def run(t: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / 22).cast("int")), lambda i: F.substring(t, i * 22 + 1, F.lit(22)))
        return F.when(t == "", t).otherwise(F.array_join(F.transform(pieces, piece), ""))

    return let(F.lower(name), run)


def _email(m: Column, key: str) -> Column:
    """The name's letters and digits permuted, its marks in place; hashed where it has letters beyond a-z."""
    domain = F.substring_index(m, "@", -1)

    def run(n: Column) -> Column:
        plain = lambda x: refill(n, permute_name(x, key), "[a-z0-9]")
        return F.when(n.rlike("^[a-z0-9._%+-]+$"), let(F.regexp_replace(n, "[^a-z0-9]", ""), plain)).otherwise(_letters(n, key, "email"))

    return F.concat(let(F.lower(F.substring_index(m, "@", 1)), run), F.lit("@"), domain)


def pseudonym(m: Column, key: str) -> Column:
    """struct(kind, text): null kind and the text itself where validation fails."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    of = lambda kind, value: let(value, lambda v: F.struct(F.when(v.isNotNull(), F.lit(kind)).alias("kind"), F.coalesce(v, m).alias("text")))
    return (
        F.when(m.contains("@"), of("email", _email(m, key)))
        .when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), of("ip", _ip(m, key)))
        .when(whole(r"\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4}"), of("date", _date(m, key)))
        .when(whole(r"\d{3}-\d{2}-\d{4}"), of("ssn", _ssn(m, key)))
        .when(whole(r"\d(?:[ -]?\d){12,18}"), of("card", _card(m, key)))
        .when(whole(r"[0-9A-Fa-f]{16,64}"), of("token", _letters(m, key, "token")))
        .otherwise(of("phone", _phone(m, key)))
    )


def masked(text: Column, key: str) -> Column:
    """struct(text, kinds found) of a text."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    parts = F.split(text, ANY, -1)
    none = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))

    def put(new: Column) -> Column:
        body = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(new, i)["text"], F.lit("")))), "")
        return F.struct(body.alias("text"), F.filter(F.transform(new, lambda x: x["kind"]), lambda k: k.isNotNull()).alias("kinds"))

    # Most texts have no digit and no @: they are passed on after one scan.
    return F.when(text.rlike("[0-9@]"), let(F.transform(found, lambda m: pseudonym(m, key)), put)).otherwise(none)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with its text column masked; all other columns as they are."""
    return docs.withColumn(text_col, masked(F.col(text_col).cast("string"), key)["text"])


def report(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, masked text and the number of values replaced, by kind."""
    out = docs.select(F.col(id_col).alias("doc_id"), masked(F.col(text_col).cast("string"), key).alias("m")).select("doc_id", "m.*")
    count = lambda k: F.coalesce(F.size(F.filter("kinds", lambda x: x == k)), F.lit(0)).cast("long")
    return out.select("doc_id", "text", *[count(k).alias(f"n_{k}") for k in KINDS])
