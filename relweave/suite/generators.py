"""Generators over the row keys of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.functions import words
from relweave.functions.draws import Cell, column_seed, draw, unit
from relweave.functions.generators import DAY, TIME_SPAN, TIME_START, build
from relweave.suite.base import (
    SEED, between_sql, draw_sql, hex_sql, letters_sql, pick_sql, query, unit_sql,
)

ROW = "o_orderkey"


def _cell(name: str, **params) -> Cell:
    return Cell(SEED, "orders", name, F.col(ROW), params)


def _d(name: str, part: int | str = 0) -> str:
    return draw_sql("orders", name, ROW, part)


def _b(name: str, lo: int, hi: int, part: int | str = 0) -> str:
    return between_sql("orders", name, ROW, lo, hi, part)


def _h(name: str, part: int = 0) -> str:
    return hex_sql("orders", name, ROW, part)


def _p(values, name: str, part: int | str = 0) -> str:
    return pick_sql(values, "orders", name, ROW, part)


AS_TEXT = {
    "random_decimal", "random_datetime", "datetime", "random_date", "date_of_birth", "price",
}


def family(name: str, columns: dict[str, tuple]) -> None:
    """Register one projection; each entry is column -> (generator, parameters, SQL).

    Decimals and times are compared as text.
    """
    sql = f"SELECT {ROW}, " + ", ".join(
        f"({text})::VARCHAR AS {c}" if g in AS_TEXT else f"{text} AS {c}"
        for c, (g, _, text) in columns.items()
    ) + " FROM orders"

    @query(name, sql)
    def run(t):
        out = []
        for c, (g, params, _) in columns.items():
            value = build(g, _cell(c, **params))
            out.append((value.cast("string") if g in AS_TEXT else value).alias(c))
        return t.orders.select(ROW, *out)


@query(
    "gen_draw",
    f"SELECT {ROW}, {_d('d')} AS d, {_d('d', 3)} AS d3, {unit_sql('orders', 'u', ROW)} AS u FROM orders",
)
def gen_draw(t):
    row = F.col(ROW)
    return t.orders.select(
        ROW, draw(SEED, "orders", "d", row).alias("d"), draw(SEED, "orders", "d", row, 3).alias("d3"),
        unit(SEED, "orders", "u", row).alias("u"),
    )


@query(
    "gen_column_seed",
    "SELECT event_id, (('0x' || substr(sha256('42:' || event_type || ':' || event_id::VARCHAR), 1, 16))::UBIGINT "
    "% 2147483648)::BIGINT AS column_seed FROM events",
)
def gen_column_seed(t):
    return t.events.select(
        "event_id", column_seed(SEED, F.col("event_type"), F.col("event_id")).alias("column_seed")
    )


_when = f"make_timestamp(({TIME_START} + {{d}} % {TIME_SPAN}) * 1000000)"
_uuid = (
    "substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-' || "
    "translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"
)
family(
    "gen_vectorized",
    {
        "i": ("random_int", {}, _b("i", 0, 10000)),
        "swapped": ("random_int", {"min": 9, "max": -3}, _b("swapped", -3, 9)),
        "f": ("random_float", {}, f"{_b('f', 0, 1000000)} / 100.0::DOUBLE"),
        "dec": ("random_decimal", {}, f"({_b('dec', 0, 9999999900)}::DECIMAL(20,0) * 0.01::DECIMAL(3,2))::DECIMAL(10,2)"),
        "dec0": ("random_decimal", {"precision": 5, "scale": 0}, f"{_b('dec0', 0, 99999)}::DECIMAL(5,0)"),
        "b": ("random_bool", {"true_ratio": 0.25}, f"{unit_sql('orders', 'b', ROW)} < 0.25::DOUBLE"),
        "ts": ("random_datetime", {}, _when.format(d=_d("ts"))),
        "day": ("random_date", {}, f"DATE '2020-01-01' + (({_d('day')} % {TIME_SPAN}) // {DAY})::INT"),
        "uid": ("uuid4", {}, _uuid.format(h=_h("uid"))),
        "cut": ("uuid4", {"max_length": 6}, f"substr({_uuid.format(h=_h('cut'))}, 1, 6)"),
    },
)

_tod = f"(({_d('tod')} % {TIME_SPAN}) % {DAY})"
family(
    "gen_strings",
    {
        "s20": ("random_string", {}, f"{letters_sql(_d('s20'))} || {letters_sql(_d('s20', 1))}"),
        "s7": ("random_string", {"max_length": 7}, letters_sql(_d("s7"), 7)),
        "tod": ("random_time", {}, f"lpad(({_tod} // 3600)::VARCHAR, 2, '0') || ':' || lpad(({_tod} // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad(({_tod} % 60)::VARCHAR, 2, '0')"),
        "choice": ("random_choice", {"enum_values": ["x", "y", "z"]}, _p(["x", "y", "z"], "choice")),
        "none": ("random_choice", {"enum_values": []}, "NULL::VARCHAR"),
        "js": ("random_json", {}, f"'{{\"key\":\"' || {letters_sql(_d('js'))} || '\",\"value\":' || {_b('js', 0, 100, 1)}::VARCHAR || '}}'"),
        "unknown": ("no_such_generator", {"max_length": 4}, letters_sql(_d("unknown"), 4)),
        "nothing": (None, {}, "NULL::VARCHAR"),
    },
)


@query(
    "gen_containers",
    f"SELECT {ROW}, lower({_h('raw')}) AS raw_hex, "
    f"array_to_string(list_transform(range(1, 1 + {_b('lst', 1, 5)}), lambda k: {_b('lst', 0, 100, 'k')}), ',') AS lst FROM orders",
)
def gen_containers(t):
    return t.orders.select(
        ROW, F.lower(F.hex(build("random_bytes", _cell("raw")))).alias("raw_hex"),
        F.array_join(build("random_list", _cell("lst")).cast("array<string>"), ",").alias("lst"),
    )


@query(
    "gen_random_text",
    f"SELECT {ROW}, array_to_string(list_transform(range(1, 1 + {_b('txt', 5, 20)}), lambda k: "
    f"substr({letters_sql(_d('txt', 'k'))}, 1, 3 + ('0x' || substr({hex_sql('orders', 'txt', ROW, 'k')}, 16, 1))::INT % 8)), ' ') AS txt FROM orders",
)
def gen_random_text(t):
    return t.orders.select(ROW, build("random_text", _cell("txt")).alias("txt"))


family(
    "gen_codes",
    {
        "age": ("age", {}, _b("age", 18, 90)),
        "cvv": ("cvv", {}, f"{_b('cvv', 100, 999)}::VARCHAR"),
        "ssn": ("ssn", {}, f"{_b('ssn', 100, 999)} || '-' || {_b('ssn', 10, 99, 1)} || '-' || {_b('ssn', 1000, 9999, 2)}"),
        "nid": ("national_id", {}, f"'ID-' || {_b('nid', 100000, 999999)}"),
        "ver": ("version", {}, f"{_b('ver', 0, 9)} || '.' || {_b('ver', 0, 99, 1)} || '.' || {_b('ver', 0, 99, 2)}"),
        "sku": ("sku", {}, f"'SKU-' || {_b('sku', 10000, 99999)}"),
        "ref": ("reference_code", {}, f"'REF-' || upper(substr({_h('ref')}, 1, 8))"),
        "tok": ("token", {}, _h("tok")),
        "hsh": ("hash", {}, f"sha256({_h('hsh')})"),
        "exp": ("credit_card_expiry", {}, f"lpad({_b('exp', 1, 12)}::VARCHAR, 2, '0') || '/' || {_b('exp', 25, 30, 1)}"),
        "fn": ("filename", {}, f"'file_' || {_b('fn', 1, 9999)} || '.txt'"),
    },
)

family(
    "gen_fixed_lists",
    {
        "status": ("status", {}, _p(words.STATUS, "status")),
        "category": ("category", {}, _p(words.CATEGORY, "category")),
        "role": ("role", {}, _p(words.ROLE, "role")),
        "priority": ("priority", {}, _p(words.PRIORITY, "priority")),
        "locale": ("locale", {}, _p(words.LOCALE, "locale")),
        "timezone": ("timezone", {}, _p(words.TIMEZONE, "timezone")),
        "mime": ("mime_type", {}, _p(words.MIME_TYPE, "mime")),
    },
)

_user = f"lower({{f}}) || '_' || lower({{l}}) || {{n}}"


def _username(c: str) -> str:
    return _user.format(f=_p(words.FIRST_NAMES, c), l=_p(words.LAST_NAMES, c, 1), n=_b(c, 0, 9999, 2))


family(
    "gen_people",
    {
        "first": ("first_name", {}, _p(words.FIRST_NAMES, "first")),
        "last": ("last_name", {}, _p(words.LAST_NAMES, "last")),
        "full_name": ("full_name", {}, f"{_p(words.FIRST_NAMES, 'full_name')} || ' ' || {_p(words.LAST_NAMES, 'full_name', 1)}"),
        "gender": ("gender", {}, _p(words.GENDERS, "gender")),
        "username": ("username", {}, _username("username")),
        "email": ("email", {}, f"{_username('email')} || '@' || {_p(words.MAIL_DOMAINS, 'email', 3)}"),
        "password": ("password", {}, f"substr(base64(unhex({_h('password')})), 1, 16)"),
        "phone": ("phone", {}, f"'+1-' || {_b('phone', 200, 999)} || '-' || {_b('phone', 200, 999, 1)} || '-' || lpad({_b('phone', 0, 9999, 2)}::VARCHAR, 4, '0')"),
    },
)


def _street(c: str) -> str:
    word = _p(words.WORDS, c, 1)
    return f"upper(substr({word}, 1, 1)) || substr({word}, 2) || ' ' || {_p(words.STREET_TYPES, c, 2)}"


family(
    "gen_places",
    {
        "city": ("city", {}, _p([p[0] for p in words.PLACES], "city")),
        "state": ("state", {}, _p([p[1] for p in words.PLACES], "state")),
        "zip": ("zip_code", {}, _p([p[2] for p in words.PLACES], "zip")),
        "country": ("country", {}, _p([c[1] for c in words.COUNTRIES], "country")),
        "country_code": ("country_code", {}, _p([c[0] for c in words.COUNTRIES], "country_code")),
        "street": ("street_address", {}, _street("street")),
        "address": ("address", {}, f"{_b('address', 1, 1999)} || ' ' || {_street('address')}"),
        "lat": ("latitude", {}, f"{_b('lat', -90000000, 90000000)} / 1000000.0::DOUBLE"),
        "lon": ("longitude", {}, f"{_b('lon', -180000000, 180000000)} / 1000000.0::DOUBLE"),
    },
)


def _slug(c: str) -> str:
    return " || '-' || ".join(_p(words.WORDS, c, k) for k in range(3))


_mac = " || ':' || ".join(f"substr({_h('mac')}, {1 + 2 * k}, 2)" for k in range(5))
_title = " || ' ' || ".join(
    f"upper(substr({_p(words.WORDS, 'title', k)}, 1, 1)) || substr({_p(words.WORDS, 'title', k)}, 2)" for k in range(4)
)
family(
    "gen_web",
    {
        "slug": ("slug", {}, _slug("slug")),
        "url": ("url", {}, f"'https://' || {_p(words.WORDS, 'url', 3)} || '.example.com/' || {_slug('url')}"),
        "avatar": ("avatar_url", {}, f"'https://img.example.com/' || substr({_h('avatar')}, 1, 12) || '.png'"),
        "image": ("image_url", {}, f"'https://img.example.com/' || substr({_h('image')}, 1, 12) || '.png'"),
        "ip": ("ip_address", {}, f"(1 + {_d('ip')} % 223) || '.' || ({_d('ip')} // 1000 % 256) || '.' || ({_d('ip')} // 1000000 % 256) || '.' || ({_d('ip')} // 1000000000 % 256)"),
        "mac": ("mac_address", {}, f"'02:' || {_mac}"),
        "agent": ("user_agent", {}, _p(words.USER_AGENTS, "agent")),
        "color": ("hex_color", {}, f"'#' || substr({_h('color')}, 1, 6)"),
        "word": ("word", {}, _p(words.WORDS, "word")),
        "title": ("title", {}, _title),
    },
)

_words = f"array_to_string(list_transform(range(1, 1 + {_b('sentence', 6, 15)}), lambda k: {_p(words.WORDS, 'sentence', 'k')}), ' ')"
family(
    "gen_sentence",
    {"sentence": ("text", {}, f"upper(substr({_words}, 1, 1)) || substr({_words}, 2) || '.'")},
)

_card = f"('4' || lpad(({_d('card')} % {10**14})::VARCHAR, 14, '0'))"
_luhn = " + ".join(
    f"(CASE WHEN {k} % 2 = 0 THEN 2 * x{k} - CASE WHEN x{k} > 4 THEN 9 ELSE 0 END ELSE x{k} END)".replace(
        f"x{k}", f"substr({_card}, {k + 1}, 1)::INT"
    )
    for k in range(15)
)
family(
    "gen_money_dates",
    {
        "ts": ("datetime", {}, _when.format(d=_d("ts"))),
        "birth": ("date_of_birth", {}, f"DATE '1945-01-01' + ({_d('birth')} % 22645)::INT"),
        "price": ("price", {}, f"({_b('price', 50000, 150000)}::DECIMAL(20,0) * 0.01::DECIMAL(3,2))::DECIMAL(10,2)"),
        "currency": ("currency_code", {}, _p(words.CURRENCIES, "currency")),
        "card": ("credit_card", {}, f"{_card} || ((10 - ({_luhn}) % 10) % 10)::VARCHAR"),
    },
)
