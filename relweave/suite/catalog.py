"""Catalog work: classification, PII, redaction, fingerprints, inference.

The catalogs are derived from the test tables: every order describes one column, so
the catalog grows with the data.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from relweave.functions.rules import NAME_RULES, PII_PATTERNS, TYPE_FALLBACKS
from relweave.operators import catalog as C
from relweave.operators import constraints as K
from relweave.operators import privacy as P
from relweave.operators.discovery import composite_foreign_keys, inclusion_dependencies, unique_column_sets
from relweave.suite.base import ALL_COLUMNS, OTHER_COLUMNS, STAR, all_tables, query, star_tables

NAMES = (
    "email", "email_address", "firstName", "emailAddress", "last_name", "userName", "name", "created_at", "createdAt",
    "price", "unit_price", "city", "country", "zip_code", "postal-code", "ssn", "user_ssn", "dob", "phone_number",
    "headphone_count", "home_phone", "order_total", "status", "is_active", "isActive", "has_children", "qty", "rating",
    "percentage", "sort_order", "sortOrder", "IP_address", "tax_id", "Credit_Card", "salary", "card_cvv", "cvv",
    "date_of_birth", "passport", "foo", "bar_baz", "XY", "uuid", "version", "lang", "timestamp", "file_name", "county",
)
TYPES = tuple(TYPE_FALLBACKS)
CHECKS = (
    "age >= 18", "price >= 0 AND price <= 1000", "x BETWEEN -5 AND 10.5", "status IN ('b', 'a','c')", "q > 3", "q < 9",
    "r > 0 AND r < 100", "length(name) = 3", "level in ('low')", "v >= 1 and v >= 2 and v <= 7.25",
)


def _array(values) -> str:
    return "array(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in values) + ")"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _catalog(t):
    """One column per order: database by customer, table by customer and status."""
    return t.orders.selectExpr(
        "concat('db', o_custkey % 97) AS db",
        "concat('tab_', o_custkey, '_', o_orderstatus) AS table",
        "int(o_orderkey) AS ordinal",
        f"concat(get({_array(NAMES)}, int(o_orderkey % {len(NAMES)})), if(o_orderkey % 5 = 4, concat('_', o_orderkey), '')) AS column",
        f"get({_array(TYPES)}, int(o_orderkey % {len(TYPES)})) AS data_type",
        "o_orderkey % 2 = 0 AS nullable", "o_orderkey % 7 = 0 AS is_pk", "false AS is_unique",
        "o_orderkey % 14 = 0 AS autoincrement", "string(null) AS default",
        "if(o_orderkey % 3 = 0, int(o_orderkey % 50), null) AS max_length",
        "if(o_orderkey % 4 = 0, 12, null) AS precision", "if(o_orderkey % 4 = 0, 3, null) AS scale",
        "if(o_orderkey % 6 = 0, array('b', o_orderpriority), null) AS enum_values",
        f"if(o_orderkey % 2 = 1, get({_array(CHECKS)}, int(o_orderkey div 2 % {len(CHECKS)})), null) AS check_expr",
        "o_orderpriority AS comment",
    )


CATALOG = (
    "(SELECT 'db' || (o_custkey % 97) AS db, 'tab_' || o_custkey || '_' || o_orderstatus AS tab, o_orderkey::INT AS ordinal, "
    f"({_list(NAMES)})[(o_orderkey % {len(NAMES)})::INT + 1] || CASE WHEN o_orderkey % 5 = 4 THEN '_' || o_orderkey ELSE '' END AS col, "
    f"({_list(TYPES)})[(o_orderkey % {len(TYPES)})::INT + 1] AS data_type, o_orderkey % 2 = 0 AS nullable, o_orderkey % 7 = 0 AS is_pk, "
    "false AS is_unique, o_orderkey % 14 = 0 AS autoincrement, "
    "CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 50)::INT END AS max_length, CASE WHEN o_orderkey % 4 = 0 THEN 12 END AS prec, "
    "CASE WHEN o_orderkey % 4 = 0 THEN 3 END AS scal, CASE WHEN o_orderkey % 6 = 0 THEN ['b', o_orderpriority] END AS enums, "
    f"CASE WHEN o_orderkey % 2 = 1 THEN ({_list(CHECKS)})[(o_orderkey // 2 % {len(CHECKS)})::INT + 1] END AS check_expr, "
    "o_orderpriority AS comment FROM orders)"
)


def _rule_case(name: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_full_match({name}, '{r[0]}') THEN {k}" for k, r in enumerate(NAME_RULES)) + " END"


_split = "lower(replace(regexp_replace(col, '([a-z])([A-Z])', '\\1_\\2', 'g'), '-', '_'))"
_ruled = (
    f"(SELECT *, coalesce(r1, r2) AS rule FROM (SELECT *, CASE WHEN r1 IS NULL THEN {_rule_case(_split)} END AS r2 "
    f"FROM (SELECT *, {_rule_case('lower(col)')} AS r1 FROM {CATALOG})))"
)


def _nth(position: int) -> str:
    return f"({_list([str(r[position]) for r in NAME_RULES])})[rule + 1]"


_fallback = "CASE data_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_FALLBACKS.items()) + " END"
_confidence = f"([{', '.join(str(r[3]) for r in NAME_RULES)}]::DOUBLE[])[rule + 1]"
_mapped = (
    f"SELECT db, tab AS \"table\", ordinal, col AS \"column\", coalesce({_nth(1)}, {_fallback}) AS generator, coalesce({_nth(2)}, 'builtin') AS provider, "
    f"round(CASE WHEN r1 IS NOT NULL THEN {_confidence} WHEN r2 IS NOT NULL THEN {_confidence} * 0.9::DOUBLE ELSE 0.5::DOUBLE END, 6) AS confidence FROM {_ruled}"
)


@query("cat_map_columns", _mapped)
def cat_map(t):
    mapped = C.map_columns(_catalog(t))
    return mapped.select(
        "db", "table", "ordinal", "column", "generator", "provider", F.round("confidence", 6).alias("confidence")
    )


def _param(key: str, own: str) -> str:
    cases = " ".join(f"WHEN {k} THEN '{r[4][key]}'" for k, r in enumerate(NAME_RULES) if key in r[4])
    rule = f"CASE rule {cases} END" if cases else "NULL"
    return f"coalesce({own}, {rule}, '') AS p_{key}"


@query(
    "cat_map_params",
    "SELECT ordinal, " + ", ".join(
        [_param("min", "NULL"), _param("max", "NULL"), _param("max_length", "max_length::VARCHAR"),
         _param("precision", "prec::VARCHAR"), _param("scale", "scal::VARCHAR"),
         _param("enum_values", "'[\"b\",\"' || enums[2] || '\"]'")]
    ) + f" FROM {_ruled}",
)
def cat_params(t):
    mapped = C.map_columns(_catalog(t))
    keys = ("min", "max", "max_length", "precision", "scale", "enum_values")
    return mapped.select(
        "ordinal", *[F.coalesce(F.try_element_at("params", F.lit(k)), F.lit("")).alias(f"p_{k}") for k in keys]
    )


@query(
    "spec_from_mapping",
    f"SELECT db, \"table\", \"column\", provider || '.' || generator AS provider FROM ({_mapped})",
)
def cat_spec(t):
    return C.mapping_to_spec(C.map_columns(_catalog(t))).drop("params")


_pii = " OR ".join(f"regexp_matches(col, '(?i){p}')" for p in PII_PATTERNS)


@query("cat_pii", f"SELECT ordinal, col AS \"column\", ({_pii}) AS is_pii FROM {CATALOG}")
def cat_pii(t):
    return C.flag_pii_columns(_catalog(t)).select("ordinal", "column", "is_pii")


SALT = b"test-salt-16byte"


def hash_sql(value: str, prefix: str, salt: bytes = SALT, digits: int = 12) -> str:
    key = salt.ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in key).hex() for pad in (0x36, 0x5C))
    first = f"sha256(unhex('{inner}') || ({value})::BLOB)"
    return f"'{prefix}' || substr(sha256(unhex('{outer}') || unhex({first})), 1, {digits})"


@query(
    "cat_redact",
    f"SELECT db, ordinal, {hash_sql('tab', 'tbl_')} AS \"table\", {hash_sql('col', 'col_')} AS \"column\", NULL::VARCHAR AS check_expr, NULL::VARCHAR AS comment, data_type FROM {CATALOG}",
)
def cat_redact(t):
    return P.redact_catalog(_catalog(t), SALT).select(
        "db", "ordinal", "table", "column", "check_expr", "comment", "data_type"
    )


@query(
    "cat_redact_pii_only",
    f"SELECT ordinal, CASE WHEN {_pii} THEN {hash_sql('col', 'col_')} ELSE col END AS \"column\" FROM {CATALOG}",
)
def cat_redact_pii(t):
    return P.redact_catalog(C.flag_pii_columns(_catalog(t)), SALT, only_pii=True).select("ordinal", "column")


@query(
    "cat_redact_references",
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN {hash_sql('o_orderpriority', 'fk_')} ELSE {hash_sql('o_orderpriority', 'idx_')} END AS name, "
    f"{hash_sql(chr(39) + 'orders' + chr(39), 'tbl_')} AS \"table\", {hash_sql('o_orderstatus', 'col_')} AS first_column, "
    f"CASE WHEN o_orderkey % 2 = 0 THEN {hash_sql('o_custkey::VARCHAR', 'tbl_')} END AS ref_table FROM orders",
)
def cat_references(t):
    refs = t.orders.selectExpr(
        "o_orderkey", "if(o_orderkey % 2 = 0, 'fk', 'index') AS kind", "o_orderpriority AS name", "'orders' AS table",
        "array(o_orderstatus) AS columns", "if(o_orderkey % 2 = 0, string(o_custkey), NULL) AS ref_table",
        "array(o_orderstatus) AS ref_columns",
    )
    return P.redact_references(refs, SALT).select(
        "o_orderkey", "name", "table", F.col("columns")[0].alias("first_column"), "ref_table"
    )


@query(
    "cat_redact_enums",
    f"SELECT o_orderkey, {hash_sql('o_orderstatus', 'enum_')} AS name, {hash_sql('o_orderpriority', 'val_')} || ',' || {hash_sql(chr(39) + 'x' + chr(39), 'val_')} AS vals FROM orders",
)
def cat_enums(t):
    enums = t.orders.selectExpr("o_orderkey", "o_orderstatus AS name", "array(o_orderpriority, 'x') AS values")
    return P.redact_enums(enums, SALT).select("o_orderkey", "name", F.array_join("values", ",").alias("vals"))


@query(
    "cat_de_redact",
    "SELECT ordinal, CASE WHEN ordinal % 10 = 0 THEN 'tbl_unknown' ELSE tab END AS \"table\", "
    f"CASE WHEN ordinal % 10 = 0 THEN {hash_sql('col', 'col_')} ELSE col END AS \"column\", ordinal % 10 <> 0 AS mapped FROM {CATALOG}",
)
def cat_de_redact(t):
    catalog = _catalog(t)
    redacted = P.redact_catalog(catalog, SALT).select(
        "ordinal", F.expr("if(ordinal % 10 = 0, 'tbl_unknown', table)").alias("table"), "column"
    )
    return P.de_redact(redacted, P.redaction_map(catalog, SALT))


@query(
    "cat_pseudonymize",
    f"SELECT c_custkey, {hash_sql('c_name', 'val_', digits=64)} AS c_name, {hash_sql('c_nationkey::VARCHAR', 'val_', digits=64)} AS c_nationkey, c_acctbal FROM customer",
)
def cat_pseudonymize(t):
    return P.pseudonymize(
        t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), ["c_name", "c_nationkey"], SALT
    )


_n = "coalesce({}::VARCHAR, '\\N')".format
_line = " || chr(31) || ".join(
    [_n(c) for c in ("tab", "col", "data_type", "nullable", "is_pk", "is_unique", "autoincrement")] + ["'\\N'"]
    + [_n(c) for c in ("max_length", "prec", "scal")]
    + ["coalesce(array_to_string(list_sort(enums), chr(30)), '\\N')", _n("check_expr")]
)
_sums = " || ':' || ".join(f"sum(('0x' || substr(h, {1 + 16 * k}, 15))::BIGINT::HUGEINT)::VARCHAR" for k in range(4))


@query(
    "cat_fingerprint",
    f"SELECT db, substr(sha256(count(*)::VARCHAR || ':' || {_sums}), 1, 16) AS fingerprint FROM (SELECT db, sha256({_line}) AS h FROM {CATALOG}) GROUP BY db",
)
def cat_fingerprint(t):
    return C.schema_fingerprint(_catalog(t))


_cut = "'db' || (o_custkey % 97)"
_reference = " || chr(31) || ".join([
    "CASE WHEN o_orderkey % 2 = 0 THEN 'fk' ELSE 'index' END", "'tab_' || o_custkey || '_' || o_orderstatus",
    "array_to_string(list_sort(['c' || (o_orderkey % 9), 'b' || (o_orderkey % 7)]), chr(30))", _n("CASE WHEN o_orderkey % 2 = 0 THEN 'tab_' || o_orderpriority END"),
    "CASE WHEN o_orderkey % 2 = 0 THEN array_to_string(list_sort(['z' || (o_orderkey % 5), 'id']), chr(30)) ELSE '\\N' END",
    "CASE WHEN o_orderkey % 4 = 0 THEN 'CASCADE' ELSE '\\N' END", "'\\N'", "(o_orderkey % 8 = 0)::VARCHAR", "'\\N'",
    "CASE WHEN o_orderkey % 2 = 1 THEN (o_orderkey % 3 = 0)::VARCHAR ELSE '\\N' END",
])


@query(
    "cat_fingerprint_references",
    f"SELECT db, substr(sha256(count(*)::VARCHAR || ':' || {_sums}), 1, 16) AS fingerprint FROM "
    f"(SELECT db, sha256({_line}) AS h FROM {CATALOG} UNION ALL SELECT {_cut}, sha256({_reference}) FROM orders WHERE o_orderkey % 3 < 2) GROUP BY db",
)
def cat_fingerprint_references(t):
    """Columns, foreign keys and indexes together."""
    references = t.orders.where("o_orderkey % 3 < 2").selectExpr(
        "concat('db', o_custkey % 97) AS db", "if(o_orderkey % 2 = 0, 'fk', 'index') AS kind", "concat('tab_', o_custkey, '_', o_orderstatus) AS table",
        "array(concat('c', o_orderkey % 9), concat('b', o_orderkey % 7)) AS columns", "if(o_orderkey % 2 = 0, concat('tab_', o_orderpriority), NULL) AS ref_table",
        "if(o_orderkey % 2 = 0, array(concat('z', o_orderkey % 5), 'id'), NULL) AS ref_columns", "if(o_orderkey % 4 = 0, 'CASCADE', NULL) AS on_delete",
        "string(NULL) AS on_update", "o_orderkey % 8 = 0 AS deferrable", "string(NULL) AS initially", "if(o_orderkey % 2 = 1, o_orderkey % 3 = 0, NULL) AS unique",
    )
    return C.schema_fingerprint(_catalog(t), references)


@query(
    "cat_check_values",
    "SELECT ordinal, coalesce(array_to_string(list_sort(regexp_extract_all(regexp_extract(check_expr, '(?i)\\bIN\\s*\\(([^)]*)\\)', 1), '''([^'']*)''', 1)), '|'), '') AS allowed "
    f"FROM {CATALOG}",
)
def cat_check_values(t):
    return C.check_values(_catalog(t)).select(
        "ordinal", F.coalesce(F.array_join("allowed", "|"), F.lit("")).alias("allowed")
    )


_expected = {
    "age >= 18": (18, None, False, False, ""),
    "price >= 0 AND price <= 1000": (0, 1000, False, False, ""),
    "x BETWEEN -5 AND 10.5": (-5, 10.5, False, False, ""),
    "status IN ('b', 'a','c')": (None, None, False, False, "b|a|c"),
    "q > 3": (3, None, True, False, ""),
    "q < 9": (None, 9, False, True, ""),
    "r > 0 AND r < 100": (0, 100, True, True, ""),
    "length(name) = 3": (None, None, False, False, ""),
    "level in ('low')": (None, None, False, False, "low"),
    "v >= 1 and v >= 2 and v <= 7.25": (2, 7.25, False, False, ""),
}


def _case(position: int) -> str:
    def lit(v) -> str:
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"'{float(v)}'"

    cases = " ".join(
        "WHEN '" + k.replace("'", "''") + f"' THEN {lit(v[position])}" for k, v in _expected.items()
    )
    return f"CASE check_expr {cases} END"


@query(
    "con_check_domains",
    f"SELECT ordinal, {_case(0)} AS lo, {_case(1)} AS hi, coalesce({_case(2)}, false) AS lo_open, coalesce({_case(3)}, false) AS hi_open, coalesce({_case(4)}, '') AS allowed FROM {CATALOG}",
)
def con_domains(t):
    return K.check_domains(_catalog(t)).select(
        "ordinal", F.col("min_value").cast("string").alias("lo"), F.col("max_value").cast("string").alias("hi"),
        F.col("min_open").alias("lo_open"), F.col("max_open").alias("hi_open"),
        F.coalesce(F.array_join("allowed_values", "|"), F.lit("")).alias("allowed"),
    )


# --- inference ----------------------------------------------------------------------
def _profile_sql() -> str:
    parts = []
    for table in STAR.tables:
        for k, c in enumerate(table.columns):
            kind = {"varchar": "text"}.get(c.data_type, c.data_type)
            allowed = (
                f"CASE WHEN count(DISTINCT {c.name}) <= 20 THEN coalesce(array_to_string(list_sort(list_distinct(list({c.name}))), '|'), '') ELSE '' END"
                if kind == "text" else "''"
            )
            parts.append(
                f"SELECT '{table.name}' AS \"table\", {k} AS ordinal, '{c.name}' AS \"column\", '{kind}' AS data_type, count(*) AS rows, "
                f"count(*) - count({c.name}) AS nulls, count(DISTINCT {c.name}) AS distinct_values, count(*) > count({c.name}) AS nullable, "
                f"count(DISTINCT {c.name}) = count({c.name}) AS is_unique, count(DISTINCT {c.name}) = count(*) AS pk_candidate, {allowed} AS allowed FROM {table.name}"
            )
    return " UNION ALL ".join(parts)


@query("cat_infer", _profile_sql())
def cat_infer(t):
    tables = star_tables(t)
    profile = C.infer_catalog(tables)
    # the timestamp columns of the files carry no zone
    return profile.withColumn("data_type", F.expr("if(data_type = 'datetime', 'timestamp', data_type)"))


def inclusions_sql(columns: dict[str, dict[str, str]], sources: dict[str, str] | None = None) -> str:
    """WITH list: ``col`` has one row to a column, ``ind`` every inclusion (a, b) of column numbers; ``sources`` are tables made here."""
    sources = sources or {}
    listed = [(t, c, k) for t, own in columns.items() for c, k in own.items()]
    numbers = ", ".join(f"({n}, '{t}', '{c}')" for n, (t, c, _) in enumerate(listed))

    def text(c: str, kind: str) -> str:
        return f"({c} + 0.0::DOUBLE)::VARCHAR" if kind == "float" else f"{c}::VARCHAR"

    cells = " UNION ALL ".join(f"SELECT {n} AS a, '{k}' AS k, {text(c, k)} AS v FROM {sources.get(t, t)}" for n, (t, c, k) in enumerate(listed))
    return f"""names(a, tab, col) AS (VALUES {numbers}),
cell AS MATERIALIZED (SELECT a, k, v, count(*) AS n FROM ({cells}) WHERE v IS NOT NULL GROUP BY ALL),
col AS MATERIALIZED (SELECT a, tab, col, sum(n)::BIGINT AS rows, count(*) AS vals, max(n) = 1 AS uniq FROM cell JOIN names USING (a) GROUP BY ALL),
ind AS MATERIALIZED (
  SELECT x.a, y.a AS b FROM cell x JOIN cell y ON x.k = y.k AND x.v = y.v AND x.a <> y.a GROUP BY x.a, y.a
  HAVING count(*) = (SELECT vals FROM col WHERE col.a = x.a)
)"""


_FOUND = "ind JOIN col c ON c.a = ind.a JOIN col p ON p.a = ind.b"


@query(
    "cat_infer_fks",
    f"WITH {inclusions_sql(ALL_COLUMNS)} SELECT c.tab AS child, c.col AS \"column\", p.tab AS parent, p.col AS ref_column, c.rows AS child_rows, "
    f"c.vals / p.vals AS coverage FROM {_FOUND} WHERE p.uniq",
)
def cat_fks(t):
    """All pairs of columns of all test tables, whatever their names."""
    return C.fk_candidates(all_tables(t))


_NOTES = {
    "notes": "(SELECT doc_id * 10 AS note_id, CASE WHEN doc_id % 3 > 0 THEN doc_id END AS about, lang AS tongue, toxic FROM documents JOIN labels USING (doc_id))",
    "words": "(SELECT DISTINCT lang AS code FROM documents WHERE lang IS NOT NULL)",
}
_NOTES_COLUMNS = {
    "documents": OTHER_COLUMNS["documents"], "labels": OTHER_COLUMNS["labels"],
    "notes": {"note_id": "exact", "about": "exact", "tongue": "text", "toxic": "exact"}, "words": {"code": "text"},
}


@query(
    "cat_inclusions",
    f"WITH {inclusions_sql(_NOTES_COLUMNS, _NOTES)} SELECT c.tab AS child, c.col AS \"column\", p.tab AS parent, p.col AS ref_column, c.rows AS child_rows, "
    f"c.vals AS child_values, c.vals / p.vals AS coverage, p.uniq AS parent_unique FROM {_FOUND}",
)
def cat_inclusions(t):
    """Keys between columns of different names and types, with NULLs, and of repeated values."""
    documents, labels = t.documents, t.labels
    notes = documents.join(labels, "doc_id").selectExpr(
        "cast(doc_id * 10 AS decimal(20, 2)) AS note_id", "if(doc_id % 3 > 0, int(doc_id), NULL) AS about", "lang AS tongue", "toxic",
    )
    words = documents.where("lang IS NOT NULL").selectExpr("lang AS code").distinct()
    return inclusion_dependencies({"documents": documents, "labels": labels, "notes": notes, "words": words})


def _unique_sets_sql(columns: dict[str, dict[str, str]], width: int) -> str:
    parts = []
    for t, own in columns.items():
        for w in range(1, width + 1):
            for some in combinations(own, w):
                values = ", ".join(f"{c} + 0.0::DOUBLE" if own[c] == "float" else c for c in some)
                empty = " OR ".join(f"{c} IS NULL" for c in some)
                parts.append(
                    f"SELECT '{t}' AS \"table\", {list(some)} AS cols, {w} AS width, (SELECT count(*) FROM {t}) AS rows, "
                    f"(SELECT count(*) FROM (SELECT DISTINCT {values} FROM {t})) AS vals, EXISTS (SELECT 1 FROM {t} WHERE {empty}) AS nullable"
                )
    return (
        f"WITH s AS MATERIALIZED (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE rows = vals AND rows > 0) "
        "SELECT \"table\", array_to_string(cols, ',') AS columns, width, rows, nullable, NOT nullable AS pk_candidate FROM s "
        "WHERE NOT EXISTS (SELECT 1 FROM s AS f WHERE f.\"table\" = s.\"table\" AND f.width < s.width AND list_has_all(s.cols, f.cols))"
    )


_KEY_TABLES = {name: own for name, own in ALL_COLUMNS.items() if name != "embeddings"}


@query("cat_infer_keys", _unique_sets_sql(_KEY_TABLES, 2))
def cat_infer_keys(t):
    """Minimal unique column sets of up to two columns in all test tables: (conv_id, turn) is one, (l_orderkey, l_linenumber) is none."""
    found = unique_column_sets({name: df for name, df in all_tables(t).items() if name in _KEY_TABLES}, max_width=2)
    return found.withColumn("columns", F.array_join("columns", ","))


_REPLIES = "(SELECT conv_id AS thread, turn AS place, turn - 1 AS answers, length(text) % 7 AS mark FROM conversations WHERE turn > 0)"


@query(
    "cat_infer_composite_fks",
    f"""WITH r AS (SELECT * FROM {_REPLIES}), k AS (SELECT DISTINCT conv_id, turn FROM conversations),
pairs(x, y) AS (VALUES {', '.join(f"('{a}', '{b}')" for a in ('thread', 'place', 'answers', 'mark') for b in ('thread', 'place', 'answers', 'mark') if a != b)}),
cells AS (SELECT x, y, u.a, u.b FROM r, pairs, LATERAL (SELECT CASE x WHEN 'thread' THEN thread WHEN 'place' THEN place WHEN 'answers' THEN answers ELSE mark END AS a,
  CASE y WHEN 'thread' THEN thread WHEN 'place' THEN place WHEN 'answers' THEN answers ELSE mark END AS b) AS u)
SELECT 'replies' AS child, x || ',' || y AS columns, 'conversations' AS parent, 'conv_id,turn' AS ref_columns, count(*) AS child_rows
FROM cells LEFT JOIN k ON cells.a = k.conv_id AND cells.b = k.turn GROUP BY x, y HAVING count(*) FILTER (k.conv_id IS NULL) = 0""",
)
def cat_composite_fks(t):
    """Foreign keys of two columns, differently named, of the composite keys that the data have."""
    replies = t.conversations.where("turn > 0").selectExpr("conv_id AS thread", "turn AS place", "turn - 1 AS answers", "length(text) % 7 AS mark")
    keys = unique_column_sets({"conversations": t.conversations.select("conv_id", "turn")}, max_width=2)
    found = composite_foreign_keys({"conversations": t.conversations.select("conv_id", "turn"), "replies": replies}, keys)
    return found.withColumn("columns", F.array_join("columns", ",")).withColumn("ref_columns", F.array_join("ref_columns", ","))
