"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Numbers and dates that validate are permuted within their own format by a keyed Feistel
network, so equal values get equal pseudonyms in all documents and different values
different ones.  Where only some values of a format are real, the network is applied
until it lands on a real one again (cycle walking), which keeps it a permutation of those:

- payment card numbers (13 to 19 digits that begin with 2 to 6 and have a right Luhn sum, whole
  or in groups 4-4-4-4 or 4-6-5): all digits but the last are permuted, the last makes
  the sum right again; separators stay
- telephone numbers of ten digits in groups 3-3-4, with or without a country code, and numbers
  of 8 to 15 digits after a plus sign: the last ten digits (all but two of a shorter one); ten digits
  whose groups of three begin with 2 to 9 are permuted among themselves
- social security numbers ``ddd-dd-dddd`` (no group of zeros): the nine digits
- IPv4 addresses (octets up to 255): the 32 bits
- dates ``yyyy-mm-dd``, ``dd/mm/yyyy`` or else ``mm/dd/yyyy``, ``dd.mm.yyyy`` that exist, within
  2**16 days from 1900-01-01: the day number; what reads as mm/dd/yyyy alone does so again

Two kinds have no numeric format and get a keyed digest of equal shape instead: the local
part and domain of e-mail addresses, and hexadecimal secrets of 32 digits or more.

Numbers that do not validate stay as they are.  Null text stays null, empty text empty;
long texts are rewritten whole (the pattern has no nested repetition).  Repeated rows give
equal results; an empty table gives an empty table; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, without

ROUNDS = 8
#: Steps of a cycle walk at most.  A third of all values fit or more, so one in 10**17 would need another.
WALK = 100
#: The first day and the number of days that date pseudonyms range over.
DAY_ZERO, DAYS = "1900-01-01", 1 << 16

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,8}"
SECRET = r"(?<![A-Za-z0-9])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,128}(?![A-Za-z0-9])"
#: Ten digits in groups; between blanks only where both groups of three may begin a real number.
PHONE = (
    r"(?<![0-9+.-])(?:\+?[0-9]{1,3}[ .-])?(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}(?! [0-9]))(?![0-9-])"
    r"|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
)
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IP = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9])(?!\.[0-9])"
DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9/.])[0-9]{2}(?:/[0-9]{2}/|\.[0-9]{2}\.)[0-9]{4}(?![0-9])"
CARD = (
    r"(?<![0-9])[2-6][0-9]{12,18}(?![0-9])|(?<![0-9])[2-6][0-9]{3}(?: [0-9]{4} [0-9]{4} |-[0-9]{4}-[0-9]{4}-)[0-9]{4}(?![0-9])"
    r"|(?<![0-9])[2-6][0-9]{3}(?: [0-9]{6} |-[0-9]{6}-)[0-9]{5}(?![0-9])"
)
#: In order of precedence where two begin at one place.
KINDS = {"email": EMAIL, "secret": SECRET, "ip": IP, "phone": PHONE, "ssn": SSN, "date": DATE, "card": CARD}
#: Cheap looks ahead spare most places of a text the alternatives.
PATTERN = f"{EMAIL}|(?=[0-9A-Fa-f]{{32}})(?:{SECRET})|(?=[0-9(+])(?:{'|'.join(KINDS[k] for k in ('ip', 'phone', 'ssn', 'date', 'card'))})"
#: A character of this class is in every match (a secret of letters alone is none).
NEEDED = "[0-9@]"


def walked(start: Column, step: Callable[[Column], Column], fits: Callable[[Column], Column]) -> Column:
    """The first of ``step(start)``, ``step(step(start))``, ... that fits."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), step(start), lambda now, _: F.when(fits(now), now).otherwise(step(now)))


def _round(value: Column, turn: Column, tweak: Column, key: str) -> Column:
    """A keyed number of 60 bits."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def feistel(high: Column, low: Column, high_size: Column, low_size: Column, tweak: Column, key: str, rounds: int = ROUNDS) -> Column:
    """A struct (a, b): the keyed permutation of (high, low) among high_size x low_size values.

    Every turn adds a keyed function of one half to the other, modulo its size.
    """
    start = F.struct(high.cast("bigint").alias("a"), low.cast("bigint").alias("b"))

    def turn(now: Column, i: Column) -> Column:
        even = F.struct(F.pmod(now["a"] + _round(now["b"], i, tweak, key), high_size.cast("bigint")).alias("a"), now["b"].alias("b"))
        odd = F.struct(now["a"].alias("a"), F.pmod(now["b"] + _round(now["a"], i, tweak, key), low_size.cast("bigint")).alias("b"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * rounds - 1)), start, turn)


def permute_digits(digits: Column, kind: str, key: str) -> Column:
    """A string of 2 to 18 digits as another of the same length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    high, low = digits.substr(F.lit(1), half), digits.substr(half + 1, n - half)
    ten = lambda k: F.pow(F.lit(10.0), k).cast("bigint")
    out = feistel(high.cast("bigint"), low.cast("bigint"), ten(half), ten(n - half), F.concat(F.lit(kind), n.cast("string")), key)
    return let(out, lambda o: F.concat(F.lpad(o["a"].cast("string"), half, "0"), F.lpad(o["b"].cast("string"), n - half, "0")))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits, the last one counted once."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refill(layout: Column, new: Column) -> Column:
    """``layout`` with its digits replaced, in order, by those of ``new``."""
    return let(new, lambda digits: _refilled(layout, digits))


def _refilled(layout: Column, digits: Column) -> Column:

    def put(done: Column, i: Column) -> Column:
        c = layout.substr(i, F.lit(1))
        figure = c.rlike("[0-9]")
        return F.struct(
            F.concat(done["text"], F.when(figure, digits.substr(done["used"] + 1, F.lit(1))).otherwise(c)).alias("text"), (done["used"] + figure.cast("int")).alias("used")
        )

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))
    return F.aggregate(F.sequence(F.lit(1), F.length(layout)), start, put)["text"]


def _card(value: Column, key: str) -> Column:
    def checked(body: Column) -> Column:
        return F.concat(body, F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string"))

    def card(digits: Column) -> Column:
        body = walked(digits.substr(F.lit(1), F.length(digits) - 1), lambda b: permute_digits(b, "card", key), lambda b: b.rlike("^[2-6]"))
        return F.when(luhn_sum(digits) % 10 == 0, refill(value, let(body, checked))).otherwise(value)

    return let(only_digits(value), card)


def _phone(value: Column, key: str) -> Column:
    def phone(digits: Column) -> Column:
        n = F.length(digits)
        kept = F.when(n > 10, n - 10).when(value.startswith("+"), 2).otherwise(0)
        return F.concat(digits.substr(F.lit(1), kept), let(digits.substr(kept + 1, n - kept), alike))

    def alike(tail: Column) -> Column:
        # what may be a number between blanks stays so, and what may not doesn't become one
        dialled = lambda d: d.rlike("^[2-9]..[2-9]......$")
        return walked(tail, lambda d: permute_digits(d, "phone", key), lambda d: dialled(d) == dialled(tail))

    digits = only_digits(value)
    return F.when(F.length(digits).between(8, 15), refill(value, let(digits, phone))).otherwise(value)


def _ssn(value: Column, key: str) -> Column:
    step = lambda digits: permute_digits(digits, "ssn", key)
    real = lambda digits: ~digits.rlike("^000|^...00|0000$")
    return let(only_digits(value), lambda digits: F.when(real(digits), refill(value, walked(digits, step, real))).otherwise(value))


def _ip(value: Column, key: str) -> Column:
    octet = F.transform(F.split(value, r"\."), lambda o: o.cast("int"))
    real = F.forall(octet, lambda o: o <= 255)
    out = feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], F.lit(1 << 16), F.lit(1 << 16), F.lit("ip"), key)
    spelt = lambda o: F.concat_ws(".", *[(F.floor(o[h] / 256) if part == 0 else o[h] % 256).cast("string") for h in "ab" for part in (0, 1)])
    return F.when(real, let(out, spelt)).otherwise(value)


def _date(value: Column, key: str) -> Column:
    zero = F.lit(DAY_ZERO).cast("date")

    def moved(day: Column) -> Column:
        return let(feistel(F.floor(day / 256), day % 256, F.lit(DAYS // 256), F.lit(256), F.lit("date"), key), lambda o: (o["a"] * 256 + o["b"]).cast("int"))

    def by(layout: str, fits: Callable[[Column], Column] | None = None) -> tuple[Column, Column]:
        day = F.datediff(F.try_to_date(value, layout), zero)
        real = (day >= 0) & (day < DAYS)
        new = moved(day) if fits is None else walked(day, moved, fits)
        return real if fits is None else real & fits(day), F.date_format(F.date_add(zero, new), layout)

    late = lambda day: F.dayofmonth(F.date_add(zero, day)) > 12  # noqa: E731 - no month: such a date has one reading
    out = value
    for shape, layout, fits in (("^../../", "MM/dd/yyyy", late), ("^../../", "dd/MM/yyyy", None), (r"^..\..", "dd.MM.yyyy", None), ("^....-", "yyyy-MM-dd", None)):
        real, spelt = by(layout, fits)
        out = F.when(value.rlike(shape) & real, spelt).otherwise(out)
    return out


def _digest(value: Column, kind: str, key: str, n: int) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), value), 256), 1, n)


def _email(value: Column, key: str) -> Column:
    return F.concat(F.lit("u"), _digest(F.lower(value), "email", key, 12), F.lit("@mail.invalid"))


def _secret(value: Column, key: str) -> Column:
    long = F.concat(_digest(value, "secret", key, 64), _digest(value, "secret2", key, 64))
    out = long.substr(F.lit(1), F.length(value))
    return F.when(value == F.upper(value), F.upper(out)).otherwise(out)


REWRITE = {"email": _email, "secret": _secret, "ip": _ip, "phone": _phone, "ssn": _ssn, "date": _date, "card": _card}


def pseudonym(value: Column, key: str) -> Column:
    """A struct (old, kind, text) for a match of ``PATTERN``; text is old where it does not validate."""
    out, kind = value, F.lit(None).cast("string")
    for name in reversed(KINDS):
        this = value.rlike(f"^(?:{KINDS[name]})$")
        out, kind = F.when(this, REWRITE[name](value, key)).otherwise(out), F.when(this, F.lit(name)).otherwise(kind)
    return F.struct(value.alias("old"), kind.alias("kind"), out.alias("text"))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten, and pii_found: numbers of rewritten values by kind.

    The column pii_found replaces one of that name.
    """
    columns = [c for c in docs.columns if c.lower() != "pii_found"]
    docs = without(docs, "pii_found")
    body = F.col(f"`{text}`")
    hits = F.when(body.rlike(NEEDED), F.regexp_extract_all(body, F.lit(PATTERN), F.lit(0)))
    # one expression, so that the steps below read it as a column and nothing is matched twice
    made = docs.withColumn("__pii", F.transform(hits, lambda v: pseudonym(v, key)))
    some = F.coalesce(F.size("__pii"), F.lit(0)) > 0
    parts = F.zip_with(F.split(body, PATTERN, -1), "__pii", lambda p, v: F.concat(p, F.coalesce(v["text"], F.lit(""))))
    count = lambda k: F.size(F.filter("__pii", lambda v: (v["kind"] == k) & (v["old"] != v["text"])))
    kinds = F.filter(F.transform(F.array(*map(F.lit, sorted(KINDS))), lambda k: F.struct(k.alias("key"), count(k).alias("value"))), lambda e: e["value"] > 0)
    found = F.when(some, F.map_from_entries(kinds)).otherwise(F.create_map().cast("map<string,int>"))
    return made.select(*[F.when(some, F.array_join(parts, "")).otherwise(body).alias(c) if c == text else F.col(f"`{c}`") for c in columns], found.alias("pii_found"))
