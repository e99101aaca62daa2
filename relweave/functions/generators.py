"""Column generators: a registry of name -> Column builder over a :class:`Cell`.

Every builder is a pure expression of deterministic draws, so a generated table is
one narrow projection over ``spark.range``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from relweave.functions import words
from relweave.functions.draws import LETTERS_PER_DRAW, Cell, letters
from relweave.functions.texts import array_sql

Builder = Callable[[Cell], Column]
REGISTRY: dict[str, Builder] = {}

# Window of the temporal generators: whole seconds in [2020-01-01, 2025-12-31) UTC.
TIME_START = 1577836800
TIME_SPAN = 1767139200 - 1577836800
DAY = 86400


def generator(*names: str) -> Callable[[Builder], Builder]:
    def add(builder: Builder) -> Builder:
        for name in names:
            REGISTRY[name] = builder
        return builder

    return add


def pick(cell: Cell, values: Sequence, part: Column | int = 0) -> Column:
    """A uniform choice from a short driver-side list."""
    return F.element_at(F.expr(array_sql(values)), (cell.below(len(values), part) + 1).cast("int"))


def truncate(value: Column, max_length: int | None) -> Column:
    return value if max_length is None else F.substring(value, 1, max_length)


def _bounds(cell: Cell, default_hi: float) -> tuple[float, float]:
    lo, hi = cell.params.get("min", 0), cell.params.get("max", default_hi)
    return (hi, lo) if lo > hi else (lo, hi)


def uniform_hundredths(cell: Cell, lo: float, hi: float, scale: int = 2, part: int = 0) -> Column:
    """A double on the grid of 10^-scale in [lo, hi]; drawn as an integer, so no rounding."""
    unit = 10**scale
    return cell.between(round(lo * unit), round(hi * unit), part) / F.lit(float(unit))


# --- numeric, boolean, temporal, uuid ---------------------------------------
@generator("random_int")
def random_int(cell: Cell) -> Column:
    lo, hi = _bounds(cell, 10000)
    return cell.between(int(lo), int(hi))


@generator("random_float")
def random_float(cell: Cell) -> Column:
    return uniform_hundredths(cell, *_bounds(cell, 10000))


@generator("random_decimal")
def random_decimal(cell: Cell) -> Column:
    precision = cell.params.get("precision", 10)
    scale = cell.params.get("scale", 2)
    return decimal_up_to(cell, max(10 ** (precision - scale) - 1, 1), precision, scale)


def decimal_up_to(cell: Cell, top: int, precision: int, scale: int) -> Column:
    """A decimal(precision, scale) in [0, top], drawn in units of 10^-scale."""
    whole = min(top * 10**scale, 10**precision - 1)
    if whole < 2**59:
        units = cell.below(whole + 1).cast("decimal(20,0)")
    else:  # two draws side by side cover 38 digits
        big = F.lit(10**17).cast("decimal(20,0)")
        high = cell.below(max((whole + 1) // 10**17, 1), 1).cast("decimal(20,0)")
        units = (high * big).cast("decimal(38,0)") + cell.below(10**17).cast("decimal(20,0)")
        units = units.cast("decimal(38,0)")
    if scale:
        step = F.lit(Decimal(1).scaleb(-scale)).cast(f"decimal({scale + 1},{scale})")
        units = units * step
    return units.cast(f"decimal({precision},{scale})")


@generator("random_bool")
def random_bool(cell: Cell) -> Column:
    return cell.unit() < F.lit(float(cell.params.get("true_ratio", 0.5)))


@generator("random_datetime", "datetime")
def random_datetime(cell: Cell) -> Column:
    return F.timestamp_seconds(F.lit(TIME_START).cast("bigint") + cell.below(TIME_SPAN))


@generator("random_date")
def random_date(cell: Cell) -> Column:
    days = F.call_function("div", cell.below(TIME_SPAN), F.lit(DAY).cast("bigint"))
    return F.date_add(F.lit("2020-01-01").cast("date"), days.cast("int"))


@generator("random_time")
def random_time(cell: Cell) -> Column:
    second = cell.below(TIME_SPAN) % F.lit(DAY).cast("bigint")
    parts = [
        F.call_function("div", second, F.lit(3600).cast("bigint")),
        F.call_function("div", second, F.lit(60).cast("bigint")) % 60,
        second % 60,
    ]
    return F.concat_ws(":", *[F.lpad(p.cast("string"), 2, "0") for p in parts])


@generator("date_of_birth")
def date_of_birth(cell: Cell) -> Column:
    """A birthday that makes the person 18 to 80 years old at the end of 2025."""
    return F.date_add(F.lit("1945-01-01").cast("date"), cell.below(22_645).cast("int"))


@generator("uuid4")
def uuid4(cell: Cell) -> Column:
    """The 122 free bits from the digest, with the version and variant bits set."""
    digits = cell.hex()
    variant = F.translate(
        F.substring(digits, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab"
    )
    return F.concat(
        F.substring(digits, 1, 8), F.lit("-"), F.substring(digits, 9, 4), F.lit("-4"),
        F.substring(digits, 14, 3), F.lit("-"), variant, F.substring(digits, 18, 3),
        F.lit("-"), F.substring(digits, 21, 12),
    )


# --- strings and containers -------------------------------------------------
def random_letters(cell: Cell, length: int, first_part: int = 0) -> Column:
    chunks = []
    for start in range(0, length, LETTERS_PER_DRAW):
        count = min(LETTERS_PER_DRAW, length - start)
        chunks.append(letters(cell.hex(first_part + start // LETTERS_PER_DRAW), count))
    return F.concat(*chunks)


@generator("random_string")
def random_string(cell: Cell) -> Column:
    return random_letters(cell, min(cell.params.get("max_length") or 20, 100))


@generator("random_text")
def random_text(cell: Cell) -> Column:
    """5 to 20 words of 3 to 10 letters; one digest per word gives its length and letters."""

    def word(digits: Column) -> Column:
        size = F.conv(F.substring(digits, 16, 1), 16, 10).cast("int") % 8 + 3
        return F.substring(letters(digits), F.lit(1), size)

    places = F.sequence(F.lit(1), cell.between(5, 20).cast("int"))
    # two steps, so that a word's digest is computed once
    return F.array_join(F.transform(F.transform(places, cell.hex), word), " ")


@generator("random_choice")
def random_choice(cell: Cell) -> Column:
    values = cell.params.get("enum_values", ["a", "b", "c"])
    return pick(cell, values) if values else F.lit(None).cast("string")


@generator("random_bytes")
def random_bytes(cell: Cell) -> Column:
    return F.unhex(cell.hex())


@generator("random_json")
def random_json(cell: Cell) -> Column:
    return F.to_json(
        F.struct(random_letters(cell, 10).alias("key"), cell.between(0, 100, 1).alias("value"))
    )


@generator("random_list")
def random_list(cell: Cell) -> Column:
    size = cell.between(1, 5).cast("int")
    return F.transform(F.sequence(F.lit(1), size), lambda k: cell.between(0, 100, k).cast("int"))


# --- codes ------------------------------------------------------------------
@generator("age")
def age(cell: Cell) -> Column:
    return cell.between(18, 90)


@generator("cvv")
def cvv(cell: Cell) -> Column:
    return cell.between(100, 999).cast("string")


@generator("ssn")
def ssn(cell: Cell) -> Column:
    return F.concat_ws(
        "-", cell.between(100, 999), cell.between(10, 99, 1), cell.between(1000, 9999, 2)
    )


@generator("national_id")
def national_id(cell: Cell) -> Column:
    return F.concat(F.lit("ID-"), cell.between(100000, 999999).cast("string"))


@generator("version")
def version(cell: Cell) -> Column:
    return F.concat_ws(".", cell.below(10), cell.below(100, 1), cell.below(100, 2))


@generator("sku")
def sku(cell: Cell) -> Column:
    return F.concat(F.lit("SKU-"), cell.between(10000, 99999).cast("string"))


@generator("reference_code")
def reference_code(cell: Cell) -> Column:
    return F.concat(F.lit("REF-"), F.upper(F.substring(cell.hex(), 1, 8)))


@generator("token")
def token(cell: Cell) -> Column:
    return cell.hex()


@generator("hash")
def hash_digest(cell: Cell) -> Column:
    return F.sha2(cell.hex(), 256)


@generator("credit_card_expiry")
def credit_card_expiry(cell: Cell) -> Column:
    return F.concat_ws(
        "/", F.lpad(cell.between(1, 12).cast("string"), 2, "0"), cell.between(25, 30, 1)
    )


@generator("filename")
def filename(cell: Cell) -> Column:
    return F.concat(F.lit("file_"), cell.between(1, 9999).cast("string"), F.lit(".txt"))


@generator("credit_card")
def credit_card(cell: Cell) -> Column:
    """15 drawn digits starting with 4, and the Luhn check digit."""
    body = F.concat(F.lit("4"), F.lpad(cell.below(10**14).cast("string"), 14, "0"))
    digits = F.filter(F.split(body, ""), lambda d: d != "")

    def weigh(digit: Column, place: Column) -> Column:
        value = digit.cast("int")
        doubled = value * 2 - F.when(value > 4, 9).otherwise(0)
        return F.when(place % 2 == 0, doubled).otherwise(value)

    total = F.aggregate(F.transform(digits, weigh), F.lit(0), lambda a, d: a + d)
    return F.concat(body, F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string"))


for _name, _values in {
    "status": words.STATUS,
    "category": words.CATEGORY,
    "role": words.ROLE,
    "priority": words.PRIORITY,
    "locale": words.LOCALE,
    "timezone": words.TIMEZONE,
    "mime_type": words.MIME_TYPE,
    "gender": words.GENDERS,
    "currency_code": words.CURRENCIES,
    "user_agent": words.USER_AGENTS,
    "word": words.WORDS,
    "first_name": words.FIRST_NAMES,
    "last_name": words.LAST_NAMES,
    "country_code": [code for code, _ in words.COUNTRIES],
    "country": [name for _, name in words.COUNTRIES],
    "city": [city for city, _, _ in words.PLACES],
    "state": [state for _, state, _ in words.PLACES],
    "zip_code": [zip_code for _, _, zip_code in words.PLACES],
}.items():
    REGISTRY[_name] = lambda cell, values=tuple(_values): pick(cell, values)


# --- people and places ------------------------------------------------------
def _first(cell: Cell) -> Column:
    return pick(cell, words.FIRST_NAMES)


def _last(cell: Cell) -> Column:
    return pick(cell, words.LAST_NAMES, 1)


@generator("full_name")
def full_name(cell: Cell) -> Column:
    return F.concat_ws(" ", _first(cell), _last(cell))


@generator("username")
def username(cell: Cell) -> Column:
    return F.concat(
        F.lower(_first(cell)), F.lit("_"), F.lower(_last(cell)), cell.below(10000, 2).cast("string")
    )


@generator("email")
def email(cell: Cell) -> Column:
    return F.concat(username(cell), F.lit("@"), pick(cell, words.MAIL_DOMAINS, 3))


@generator("password")
def password(cell: Cell) -> Column:
    return F.substring(F.base64(F.unhex(cell.hex())), 1, 16)


@generator("phone")
def phone(cell: Cell) -> Column:
    return F.concat(
        F.lit("+1-"),
        F.concat_ws(
            "-",
            cell.between(200, 999),
            cell.between(200, 999, 1),
            F.lpad(cell.below(10000, 2).cast("string"), 4, "0"),
        ),
    )


@generator("street_address")
def street_address(cell: Cell) -> Column:
    return F.concat_ws(
        " ", F.initcap(pick(cell, words.WORDS, 1)), pick(cell, words.STREET_TYPES, 2)
    )


@generator("address")
def address(cell: Cell) -> Column:
    return F.concat_ws(" ", cell.between(1, 1999), street_address(cell))


@generator("latitude")
def latitude(cell: Cell) -> Column:
    return uniform_hundredths(cell, -90, 90, 6)


@generator("longitude")
def longitude(cell: Cell) -> Column:
    return uniform_hundredths(cell, -180, 180, 6)


# --- web, text, money -------------------------------------------------------
@generator("slug")
def slug(cell: Cell) -> Column:
    return F.concat_ws("-", *[pick(cell, words.WORDS, k) for k in range(3)])


@generator("url")
def url(cell: Cell) -> Column:
    return F.concat(
        F.lit("https://"), pick(cell, words.WORDS, 3), F.lit(".example.com/"), slug(cell)
    )


@generator("avatar_url", "image_url")
def image_url(cell: Cell) -> Column:
    return F.concat(
        F.lit("https://img.example.com/"), F.substring(cell.hex(), 1, 12), F.lit(".png")
    )


@generator("ip_address")
def ip_address(cell: Cell) -> Column:
    """Four octets from one draw; the first is 1 to 223."""
    bits = cell.draw()
    octets = [F.lit(1).cast("bigint") + bits % F.lit(223).cast("bigint")] + [
        F.call_function("div", bits, F.lit(1000 ** k).cast("bigint")) % 256 for k in (1, 2, 3)
    ]
    return F.concat_ws(".", *octets)


@generator("mac_address")
def mac_address(cell: Cell) -> Column:
    """Twelve digest digits, marked as a locally administered unicast address."""
    digits = cell.hex()
    return F.concat_ws(
        ":", F.lit("02"), *[F.substring(digits, 1 + 2 * k, 2) for k in range(5)]
    )


@generator("hex_color")
def hex_color(cell: Cell) -> Column:
    return F.concat(F.lit("#"), F.substring(cell.hex(), 1, 6))


@generator("title")
def title(cell: Cell) -> Column:
    return F.initcap(F.concat_ws(" ", *[pick(cell, words.WORDS, k) for k in range(4)]))


@generator("text")
def text(cell: Cell) -> Column:
    """A sentence of 6 to 15 words."""
    count = cell.between(6, 15).cast("int")
    body = F.array_join(
        F.transform(F.sequence(F.lit(1), count), lambda k: pick(cell, words.WORDS, k)), " "
    )
    return F.concat(F.upper(F.substring(body, 1, 1)), F.substring(body, F.lit(2), F.length(body)), F.lit("."))


@generator("price")
def price(cell: Cell) -> Column:
    """500.00 to 1500.00, or the range in the parameters."""
    lo, hi = cell.params.get("min", 500), cell.params.get("max", 1500)
    scale = cell.params.get("scale", 2)
    precision = max(cell.params.get("precision", 10), scale + 1)
    step = F.lit(Decimal(1).scaleb(-scale)).cast(f"decimal({scale + 1},{scale})")
    top = min(int(hi * 10**scale), 10**precision - 1)
    units = cell.between(min(int(lo * 10**scale), top), top).cast("decimal(20,0)")
    return (units * step).cast(f"decimal({precision},{scale})")


def build(name: str | None, cell: Cell) -> Column:
    """The column of a generator; no mapping gives nulls, an unknown name a random string.

    String results are cut to ``max_length``.
    """
    if name is None:
        return F.lit(None).cast("string")
    value = REGISTRY.get(name, random_string)(cell)
    max_length = cell.params.get("max_length")
    if max_length is not None and name in STRING_GENERATORS:
        value = truncate(value, max_length)
    return value


_NOT_STRINGS = {
    "random_json",
    "random_int", "random_float", "random_decimal", "random_bool", "random_datetime",
    "datetime", "random_date", "date_of_birth", "random_bytes", "random_list", "age",
    "latitude", "longitude", "price",
}
STRING_GENERATORS = frozenset(REGISTRY) - _NOT_STRINGS
