"""Format-preserving pseudonyms of personal data, in DataFrame operations only.

One pattern finds candidates; each is validated by its own rule.  Numbers, dates,
account and phone numbers are permuted within their format by a keyed Feistel
network, so equal values get equal pseudonyms in every document, however they are
spaced, and nothing but the key is kept.  A permutation E is used as
"undo E, step to the next value, apply E", which has no fixed point: no value
stands for itself.  Names in mail addresses and secrets have no number format; a
keyed digest of the same shape replaces them.

The key is the caller's.  It is part of the query plan, so the cluster's event
logs are as secret as the key.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm.tables import read_table

#: The session setting that holds the key of the registered query and of the pipeline.
KEY_SETTING = "spark.corpusq.pii.key"
STEPS = 5
FIRST_DAY = "1900-01-01"
_DAY_HALVES = (17, 4297)  # 73049 days, up to 2099-12-31

# Country calling codes of one and two digits; all others have three.
_COUNTRY = r"^(?:[17]|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
# The months in natural order.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_YEAR, _MONTH, _DAY = r"(?:19|20)[0-9]{2}", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12][0-9]|3[01])"
_SHORT_DAY, _SHORT_MONTH = r"(?:0?[1-9]|[12][0-9]|3[01])", r"(?:0?[1-9]|1[0-2])"
_NAMED = "(?:" + "|".join(m if len(m) == 3 else f"{m[:3]}(?:{m[3:]})?" for m in MONTHS) + ")"
_YEAR_FIRST = rf"{_YEAR}(?:-{_MONTH}-|/{_MONTH}/){_DAY}(?![0-9\-/])"
_YEAR_LAST = rf"{_SHORT_DAY}(?:\.{_SHORT_MONTH}\.|/{_SHORT_DAY}/){_YEAR}(?![0-9])"
_DAY_NAMED = rf"{_SHORT_DAY} {_NAMED} {_YEAR}(?![0-9])"
_NAMED_DAY = rf"{_NAMED} {_SHORT_DAY}, {_YEAR}(?![0-9])"
#: Candidates by kind, in order of precedence; fixed patterns.  Repeated groups are bounded: the
#: matcher takes stack for each repetition.  A domain has up to 126 labels of up to 63 characters.
KINDS = {
    "email": r"[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]{1,63}+\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9\-])",
    "secret": r"(?=[A-Za-z])(?i:token|password|passwd|secret|api_?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_\-]{8,}+",
    "cloud_key": r"A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![0-9A-Za-z])",
    "ip": rf"(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "date": f"{_YEAR_FIRST}|{_YEAR_LAST}|{_DAY_NAMED}|{_NAMED_DAY}",
    "ssn": r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9\-])",
    "card": r"(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9A-Za-z])",
    "phone": r"\+[1-9][0-9]{0,2}[ .\-]?(?:\(0\)[ .\-]?)?\(?[0-9]{2,5}\)?(?:[ .\-]?[0-9]{2,5}){1,4}(?![0-9])",
}
#: One pattern for all: what a kind may not follow is tested once for each start, and digits first.
PATTERN = (
    r"(?<![A-Za-z0-9._%+\-])(?:" + "|".join([*(KINDS[k] for k in ("email", "secret", "cloud_key", "iban")), _NAMED_DAY])
    + r")|(?=[0-9])(?<![0-9A-Za-z.\-])(?:" + "|".join([KINDS["ip"], _YEAR_FIRST, _YEAR_LAST, _DAY_NAMED, KINDS["ssn"], KINDS["card"]])
    + r")|" + KINDS["phone"].replace(r"\+", r"\+(?<![0-9A-Za-z+]\+)", 1)
)
#: Put around candidates; a text that holds it takes the slower way.
MARK = "\x02"
#: Parts of a secret: what names it, and its value.
_SECRET = r"(?s)^(.*?[=:]\s{0,3}[\"']?)([A-Za-z0-9+/_\-]{8,})$"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, also where it stands in inner lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _characters(m: Column, pattern: str = "[^0-9]") -> Column:
    return F.regexp_replace(m, pattern, "")


def _moved(c: Column, by: Column) -> Column:
    """A digit or capital moved on in its alphabet, round to the start."""
    code = F.ascii(c)
    digit, capital = (c >= "0") & (c <= "9"), (c >= "A") & (c <= "Z")
    return F.when(digit, F.char(F.pmod(code - 48 + by, F.lit(10)) + 48)).when(capital, F.char(F.pmod(code - 65 + by, F.lit(26)) + 65)).otherwise(c)


class Cipher:
    """Keyed permutations without fixed points, and digests, as columns."""

    def __init__(self, key: str):
        if not key:
            raise ValueError("pseudonyms need a key")
        self._key = F.lit(hashlib.sha256(key.encode()).hexdigest())

    def digest(self, *parts: Column | str) -> Column:
        """64 hexadecimal digits of a keyed digest."""
        return F.sha2(F.concat_ws("|", self._key, *[p if isinstance(p, Column) else F.lit(p) for p in parts], self._key), 256)

    def _number(self, x: Column, a: Column, b: Column, tweak: str, undo: bool) -> Column:
        def random(i: Column, side: str, other: Column) -> Column:
            return F.conv(F.substring(self.digest(tweak, i.cast("string"), side, other.cast("string")), 1, 15), 16, 10).cast("long")

        def step(s: Column, i: Column) -> Column:
            if undo:
                return _bound(F.pmod(s["r"] - random(i, "r", s["l"]) % b, b), lambda r: F.struct(
                    F.pmod(s["l"] - random(i, "l", r) % a, a).alias("l"), r.alias("r")))
            return _bound((s["l"] + random(i, "l", s["r"]) % a) % a, lambda left: F.struct(
                left.alias("l"), ((s["r"] + random(i, "r", left) % b) % b).alias("r")))

        order = range(STEPS)[::-1] if undo else range(STEPS)
        start = F.struct(F.call_function("div", x, b).alias("l"), (x % b).alias("r"))
        return F.aggregate(F.array(*[F.lit(i) for i in order]), start, step, lambda s: s["l"] * b + s["r"])

    def number(self, x: Column, a: int, b: int, tweak: str) -> Column:
        """The numbers 0 to a * b - 1 permuted."""
        size, a, b = a * b, F.lit(a).cast("long"), F.lit(b).cast("long")
        back = _bound(x, lambda v: self._number(v, a, b, tweak, True))
        return _bound((back + 1) % F.lit(size).cast("long"), lambda v: self._number(v, a, b, tweak, False))

    def string(self, s: Column, tweak: Column) -> Column:
        """Up to 32 digits and capitals, permuted among strings of the same shape: digits stay digits, capitals capitals."""
        def mask(part: Column, i: Column, side: str, other: Column, sign: int) -> Column:
            return _bound(self.digest(tweak, i.cast("string"), side, other), lambda h: F.array_join(F.transform(F.split(part, ""), lambda c, n: _moved(
                c, sign * F.conv(F.substr(h, n * 4 + 1, F.lit(4)), 16, 10).cast("int"))), ""))

        def apply(s: Column, i: Column) -> Column:
            return _bound(mask(s["l"], i, "l", s["r"], 1), lambda left: F.struct(left.alias("l"), mask(s["r"], i, "r", left, 1).alias("r")))

        def undo(s: Column, i: Column) -> Column:
            return _bound(mask(s["r"], i, "r", s["l"], -1), lambda right: F.struct(mask(s["l"], i, "l", right, -1).alias("l"), right.alias("r")))

        low = F.call_function("div", F.length(s), F.lit(2)).cast("int")
        high = F.length(s) - low
        start = F.struct(F.substr(s, F.lit(1), high).alias("l"), F.substr(s, high + 1, low).alias("r"))
        back = F.aggregate(F.array(*[F.lit(i) for i in range(STEPS)][::-1]), start, undo)
        following = _bound(back, lambda t: F.struct(
            F.concat(_moved(F.substr(t["l"], F.lit(1), F.lit(1)), F.lit(1)), F.substr(t["l"], F.lit(2), F.length(t["l"]))).alias("l"), t["r"].alias("r")))
        return F.aggregate(F.array(*[F.lit(i) for i in range(STEPS)]), following, apply, lambda t: F.concat(t["l"], t["r"]))

    def hexadecimal(self, m: Column, tweak: str, n: Column | int) -> Column:
        """n hexadecimal digits of keyed digests: 64 of m's, then those of m's digest and a round number."""
        n = F.lit(n) if isinstance(n, int) else n

        def extended(h: Column) -> Column:
            more = F.transform(F.sequence(F.lit(1), F.call_function("div", n - 1, F.lit(64)).cast("int")), lambda i: self.digest(tweak, i.cast("string"), h))
            return F.when(n <= 64, F.substr(h, F.lit(1), n)).otherwise(F.substr(F.concat(h, F.array_join(more, "")), F.lit(1), n))

        return _bound(self.digest(tweak, "0", m), extended)


def _refilled(m: Column, d: Column) -> Column:
    """m with its digits and capitals replaced, in order, by the characters of d."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def put(state: Column, c: Column) -> Column:
        taken = ((c >= "0") & (c <= "9")) | ((c >= "A") & (c <= "Z"))
        return F.struct(
            F.concat(state["s"], F.when(taken, F.substr(d, state["i"], F.lit(1))).otherwise(c)).alias("s"),
            (state["i"] + F.when(taken, 1).otherwise(0)).alias("i"))

    return F.aggregate(F.split(m, ""), start, put, lambda s: s["s"])


def luhn_digit(body: Column) -> Column:
    """The check digit that makes body valid by Luhn's rule, as a string."""
    n = F.length(body)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(body, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add, lambda t: ((10 - t % 10) % 10).cast("string"))


def _mod97(s: Column) -> Column:
    """The remainder by 97 of digits and letters, A for 10 to Z for 35."""
    def add(r: Column, c: Column) -> Column:
        letter = c >= "A"
        return F.when(letter, (r * 100 + F.ascii(c) - 55) % 97).otherwise((r * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.split(s, ""), F.lit(0), add)


def _sized(tweak: str, s: Column, *more: Column) -> Column:
    return F.concat_ws("/", F.lit(tweak), F.length(s).cast("string"), *more)


def _card(m: Column, cipher: Cipher) -> Column:
    """All digits but the check digit are permuted; it is worked out anew."""
    def valid(d: Column) -> Column:
        return luhn_digit(F.substr(d, F.lit(1), F.length(d) - 1)) == F.substr(d, F.length(d), F.lit(1))

    def swapped(d: Column) -> Column:
        new = _bound(F.substr(d, F.lit(1), F.length(d) - 1), lambda body: cipher.string(body, _sized("card", body)))
        return _bound(_bound(new, lambda n: F.concat(n, luhn_digit(n))), lambda n: _refilled(m, n))

    return _bound(_characters(m), lambda d: F.when(valid(d), swapped(d)).otherwise(m))


def _iban(m: Column, cipher: Cipher) -> Column:
    """The country stays; digits and letters of the account are permuted, and the check digits worked out anew."""
    def swapped(s: Column) -> Column:
        country = F.substr(s, F.lit(1), F.lit(2))
        new = _bound(F.substr(s, F.lit(5), F.length(s)), lambda body: cipher.string(body, _sized("iban", body, country)))
        whole = _bound(new, lambda n: F.concat(country, F.lpad((98 - _mod97(F.concat(n, country, F.lit("00")))).cast("string"), 2, "0"), n))
        return _bound(whole, lambda n: _refilled(m, n))

    def valid(s: Column) -> Column:
        return F.length(s).between(15, 34) & (_mod97(F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4)))) == 1)

    return _bound(_characters(m, " "), lambda s: F.when(valid(s), swapped(s)).otherwise(m))


def _ip(m: Column, cipher: Cipher) -> Column:
    n = F.aggregate(F.split(m, r"\."), F.lit(0).cast("long"), lambda t, o: t * 256 + o.cast("long"))
    return _bound(cipher.number(n, 65536, 65536, "ip"), lambda y: F.concat_ws(
        ".", *[F.call_function("shiftright", y, F.lit(s)).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]))


def _date(m: Column, cipher: Cipher) -> Column:
    """The day is permuted and written as it was: year first, year last, or with the month's English name.

    With slashes and the year last, the month stands first unless the first number is above 12.
    """
    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(m, pattern, group)

    def padded(x: Column, like: Column) -> Column:
        return F.lpad(x, F.greatest(F.length(x), F.length(like)), F.lit("0"))

    def place(name: Column) -> Column:
        return F.array_position(F.array(*[F.lit(n[:3]) for n in MONTHS]), F.substring(name, 1, 3)).cast("string")

    def named(new: Column, name: Column) -> Column:
        full = F.element_at(F.array(*[F.lit(n) for n in MONTHS]), F.month(new))
        return F.when(F.length(name) == 3, F.substring(full, 1, 3)).otherwise(full)

    def text(x: Column) -> Column:
        return x.cast("string")

    first, last = r"^([0-9]{4})([-/])([0-9]{2})[-/]([0-9]{2})$", r"^([0-9]{1,2})([./])([0-9]{1,2})[./]([0-9]{4})$"
    day_named, named_day = r"^([0-9]{1,2}) ([A-Za-z]+) ([0-9]{4})$", r"^([A-Za-z]+) ([0-9]{1,2}), ([0-9]{4})$"
    month_first = (part(last, 2) == "/") & (part(last, 1).try_cast("int") <= 12)
    parts = (
        F.when(m.rlike(first), F.concat_ws("-", part(first, 1), part(first, 3), part(first, 4)))
        .when(m.rlike(last) & month_first, F.concat_ws("-", part(last, 4), part(last, 1), part(last, 3)))
        .when(m.rlike(last), F.concat_ws("-", part(last, 4), part(last, 3), part(last, 1)))
        .when(m.rlike(day_named), F.concat_ws("-", part(day_named, 3), place(part(day_named, 2)), part(day_named, 1)))
        .otherwise(F.concat_ws("-", part(named_day, 3), place(part(named_day, 1)), part(named_day, 2))))
    start = F.lit(FIRST_DAY).cast("date")

    def written(new: Column) -> Column:
        year, month, day = text(F.year(new)), text(F.month(new)), text(F.dayofmonth(new))
        return (
            F.when(m.rlike(first), F.concat(year, part(first, 2), F.lpad(month, 2, "0"), part(first, 2), F.lpad(day, 2, "0")))
            .when(m.rlike(last) & month_first, F.concat_ws("/", padded(month, part(last, 1)), padded(day, part(last, 3)), year))
            .when(m.rlike(last), F.concat(padded(day, part(last, 1)), part(last, 2), padded(month, part(last, 3)), part(last, 2), year))
            .when(m.rlike(day_named), F.concat_ws(" ", padded(day, part(day_named, 1)), named(new, part(day_named, 2)), year))
            .otherwise(F.concat(named(new, part(named_day, 1)), F.lit(" "), padded(day, part(named_day, 2)), F.lit(", "), year)))

    def swapped(day: Column) -> Column:
        return _bound(F.date_add(start, cipher.number(F.datediff(day, start).cast("long"), *_DAY_HALVES, "date").cast("int")), written)

    return _bound(parts.try_cast("date"), lambda day: F.when(day.isNull(), m).otherwise(swapped(day)))


def _ssn(m: Column, cipher: Cipher) -> Column:
    """Area 001-899 without 666, group 01-99, serial 0001-9999: 898 * 99 * 9999 numbers."""
    area, group, serial = (F.substr(m, F.lit(i), F.lit(n)).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    rank = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1

    def written(y: Column) -> Column:
        high = F.call_function("div", y, F.lit(9999).cast("long"))
        a = F.call_function("div", high, F.lit(99).cast("long")) + 1
        parts = ((a + F.when(a >= 666, 1).otherwise(0), 3), (high % 99 + 1, 2), (y % 9999 + 1, 4))
        return F.concat_ws("-", *[F.lpad(p.cast("string"), n, "0") for p, n in parts])

    return _bound(cipher.number(rank, 898 * 99, 9999, "ssn"), written)


def _phone(m: Column, cipher: Cipher) -> Column:
    """The country code stays; the other digits are permuted if there are 6 to 14 of them.

    A trunk zero in brackets is no part of the number and goes.
    """
    plain = F.regexp_replace(m, r"\(0\)[ .\-]?", "")

    def swapped(d: Column) -> Column:
        known = F.regexp_extract(d, _COUNTRY, 0)
        code = F.when(known == "", F.substring(d, 1, 3)).otherwise(known)
        return _bound(code, lambda c: _bound(F.substr(d, F.length(c) + 1, F.length(d)), lambda rest: F.when(
            F.length(rest).between(6, 14), _bound(F.concat(c, cipher.string(rest, _sized("phone", rest, c))), lambda n: _refilled(plain, n))).otherwise(m)))

    return _bound(_characters(plain), swapped)


def _email(m: Column, cipher: Cipher) -> Column:
    return F.concat(F.lit("user-"), cipher.hexadecimal(F.lower(m), "email", 12), F.lit("@example.invalid"))


def _secret(m: Column, cipher: Cipher) -> Column:
    value = F.regexp_extract(m, _SECRET, 2)
    return F.concat(F.regexp_extract(m, _SECRET, 1), cipher.hexadecimal(value, "secret", F.length(value)))


def _cloud_key(m: Column, cipher: Cipher) -> Column:
    return F.concat(F.substr(m, F.lit(1), F.lit(4)), F.upper(cipher.hexadecimal(m, "cloud", 16)))


PSEUDONYMS = {
    "email": _email, "secret": _secret, "cloud_key": _cloud_key, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "iban": _iban, "card": _card,
}


def kind_of(m: Column) -> Column:
    """The kind of a candidate that PATTERN found: the first whose own pattern takes all of it."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS.items()):
        kind = F.when(m.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return kind


def pseudonym(m: Column, kind: Column, cipher: Cipher) -> Column:
    """What stands for a candidate; the candidate itself if its kind's rule finds it invalid."""
    out = m
    for name, rule in PSEUDONYMS.items():
        out = F.when(kind == name, rule(m, cipher)).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """docs with personal data in a text column replaced under a key, and pii: an array of (kind, value).

    Kinds: mail addresses, secrets, cloud keys, IPv4 addresses, dates of 1900 to
    2099 (`_date` has the forms), social security numbers, phone numbers with a
    country code, IBANs (mod 97, also in groups of four) and payment cards (Luhn;
    13 to 19 digits, or in groups 4-4-4-4 and 4-6-5).  Candidates that fail their
    rule stay.  Pseudonyms are valid in the same format and never equal their
    value; a value of one kind has one pseudonym, however it is spaced or written.

    Nulls and edge cases: a missing key is refused; null text stays null and empty
    text empty, both with an empty pii; a name of more than 126 labels is no mail
    domain beyond them; repeated rows get equal results; other columns stay,
    except that an existing column pii is replaced; an empty table gives an empty
    result.
    """
    cipher = Cipher(key)
    text = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))
    between, found = F.split(text, PATTERN, -1), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    slow = F.flatten(F.zip_with(between, found, lambda b, m: F.array(b, F.coalesce(m, F.lit("")))))
    fast = F.split(F.regexp_replace(text, PATTERN, f"{MARK}$0{MARK}"), MARK, -1)
    swapped = F.transform("_parts", lambda x, i: F.when(i % 2 == 1, F.struct(x.alias("m"), kind_of(x).alias("kind"))))
    swapped = F.transform(swapped, lambda x: F.when(x.isNotNull(), F.struct(x["kind"].alias("kind"), x["m"].alias("m"), pseudonym(x["m"], x["kind"], cipher).alias("p"))))
    joined = F.array_join(F.zip_with("_parts", "_swapped", lambda x, y: F.coalesce(y["p"], x)), "")
    changed = F.transform(F.filter("_swapped", lambda x: x["m"] != x["p"]), lambda x: F.struct(x["kind"].alias("kind"), x["p"].alias("value")))
    keep = [c for c in docs.columns if c.lower() not in ("pii", column.lower())]
    return (
        docs.withColumn("_parts", F.when(F.instr(text, MARK) > 0, slow).otherwise(fast))
        .withColumn("_swapped", F.when(F.size("_parts") > 1, swapped))
        .select(*[F.col(f"`{c}`") for c in keep],
                F.when(F.col("_swapped").isNotNull(), joined).otherwise(F.col(f"`{column}`")).alias(column),
                F.coalesce(changed, F.array().cast("array<struct<kind:string,value:string>>")).alias("pii"))
    )


_session_keys: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The key in KEY_SETTING; where it is unset, a random one of this application that nobody knows."""
    app = spark.sparkContext.applicationId
    return spark.conf.get(KEY_SETTING, None) or _session_keys.setdefault(app, secrets.token_hex(32))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Pseudonymised text of all documents, and how many values of each kind were replaced."""
    out = pseudonymised(read_table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
    kinds = [F.size(F.expr(f"filter(pii, x -> x.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), *kinds)
