"""The registered queries of this subpackage and their SQL, one ``opN_<name>`` per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.llm import (
    alignment, chat, chunk_dedup, decontaminate, hard_negatives, language, language_model, licenses, mixing, near_dedup, quality, toxicity, url_templates,
)
from relweave.llm.store import stored
from relweave.suite.base import unit_sql
from relweave.llm.words import ALNUM, LOWER, SPACED, UPPER

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_sql(text: str, pattern: str, *, lower: bool = True) -> str:
    text = f"coalesce({text}, '')"
    if lower:
        text = f"translate({text}, '{UPPER}', '{LOWER}')"
    return f"regexp_extract_all({text}, '{pattern}')"


# --- 6: benchmark decontamination ---------------------------------------------
OP6_SQL = f"""
WITH d AS (SELECT doc_id, {words_sql('text', ALNUM)} AS ws FROM documents),
b AS (SELECT item_id, {words_sql('text', ALNUM)} AS ws FROM benchmark WHERE item_id IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS t(i) WHERE len(ws) > 0
),
widths AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM d, widths, unnest(range(1, len(ws) - n + 2)) AS t(i)
),
hits AS (SELECT doc_id, item_id, n, i FROM dw JOIN iw USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) AS t(k) GROUP BY 1),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY 1
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


@query("op6_decontamination", OP6_SQL)
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    marked = decontaminate.mark_contamination(docs, table(spark, folder, "benchmark"))
    mark = F.col("contamination")
    ids = F.array_sort(F.transform(mark["items"], lambda x: x.cast("string")))
    hit = decontaminate.n_hit(mark)
    return marked.select(
        "doc_id", mark["n_words"].alias("n_words"), hit.alias("n_hit"), F.size(mark["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


# --- 7: near duplicates ---------------------------------------------------------
OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words_sql('text', SPACED)} AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh
  FROM d, unnest(range(1, greatest(len(ws) - 5, 0) + 2)) AS t(i) WHERE len(ws) > 0
),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
),
link AS MATERIALIZED (
  SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
),
edge AS MATERIALIZED (SELECT a AS u, b AS v FROM link UNION SELECT b, a FROM link),
reach(u, v) AS (SELECT u, v FROM edge UNION SELECT reach.u, edge.v FROM reach JOIN edge ON reach.v = edge.u),
least_of AS (SELECT u AS doc_id, min(v) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""


@query("op7_near_dedup", OP7_SQL)
def op7_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


# --- 4: substring dedup -----------------------------------------------------------
@query("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = chunk_dedup.remove_repeats(docs, spans="spans")
    removed = F.aggregate("spans", F.lit(0), lambda n, s: n + s["stop"] - s["start"])
    return out.select(
        "doc_id", F.greatest(F.coalesce(F.size("spans"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce(removed, F.lit(0)).cast("bigint").alias("removed_bytes"), F.col("spans").isNotNull().alias("repeats"),
        F.array_sort(F.array_distinct(F.flatten(F.col("spans.sources")))).alias("first_doc_ids"), "text",
    )


# --- 9: language ID ---------------------------------------------------------------
@query("op9_language_id")
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.learn_from_documents(docs)
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (language.held_out(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"),
    )


# --- 1: license scans -------------------------------------------------------------
_TEMPLATES_SQL = ", ".join(
    f"({k}, '{t.label}', {t.phrase}, {t.base}, {list(t.words)})" for k, t in enumerate(licenses.TEMPLATES)
)
OP1_SQL = f"""
WITH t(k, label, phrase, base, ws) AS (VALUES {_TEMPLATES_SQL}),
tok AS (SELECT DISTINCT k, phrase, w FROM t, unnest(ws) AS u(w)),
size_of AS (SELECT k, count(*) AS n FROM tok GROUP BY 1),
d AS (SELECT doc_id, {words_sql('text', ALNUM)} AS ws FROM documents),
dw AS (SELECT doc_id, i, ws[i + 1] AS w FROM d, unnest(range(0, len(ws))) AS u(i)),
places AS (
  SELECT doc_id, k, label, base, i AS first, i + len(t.ws) - 1 AS last
  FROM d, t, unnest(range(0, len(d.ws))) AS u(i) WHERE phrase AND d.ws[i + 1:i + len(t.ws)] = t.ws
),
blocks AS (
  SELECT doc_id, k, block, count(DISTINCT w) AS n
  FROM (SELECT doc_id, w, unnest(CASE WHEN i >= 100 THEN [i // 100, i // 100 - 1] ELSE [0] END) AS block FROM dw) JOIN tok USING (w)
  WHERE NOT phrase GROUP BY 1, 2, 3
),
met AS (
  SELECT doc_id, label, n::DOUBLE / m AS share FROM (SELECT blocks.*, size_of.n AS m, label FROM blocks JOIN size_of USING (k) JOIN t USING (k))
  WHERE n >= ceil({licenses.THRESHOLD}::DOUBLE * m)
  UNION ALL SELECT doc_id, label, 1.0 FROM places
),
m AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM met GROUP BY 1),
b AS (
  SELECT doc_id, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places WHERE base GROUP BY 1
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""


@query("op1_license_scan", OP1_SQL)
def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = licenses.scan_licenses(docs).select("doc_id", "licenses.*")
    numbers = F.array(*[F.lit(k) for k in licenses.base_numbers()])
    base = F.filter("places", lambda p: F.array_contains(numbers, p["template"]))
    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min("base.first").alias("first_word"),
        F.array_max("base.first").alias("last_word"), licenses.labels(F.col("base.template")).alias("base_labels"),
        licenses.labels(F.col("blocks.template")).alias("labels"), "score",
    )


# --- 10: mixing sources -------------------------------------------------------------
_U = unit_sql("mix", "rank", "coalesce(doc_id::VARCHAR, '')")
OP10_SQL = f"""
WITH d AS (SELECT doc_id, source, len({words_sql('text', SPACED, lower=False)})::BIGINT AS size FROM documents),
s AS (
  SELECT source, source_size, 3 * source_size AS cap, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1)
),
run AS (
  SELECT *, sum(cap) OVER w - cap AS capped, sum(weight) OVER w - weight AS gone, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight
  FROM s WINDOW w AS (ORDER BY cap::DOUBLE / weight, source ROWS UNBOUNDED PRECEDING)
),
levels AS (SELECT *, (total - capped)::DOUBLE / (all_weight - gone)::DOUBLE AS level FROM run),
lev AS (SELECT level FROM levels WHERE cap >= weight * level ORDER BY cap::DOUBLE / weight, source LIMIT 1),
aim AS (SELECT source, source_size, least(weight::DOUBLE * level, cap::DOUBLE) AS target FROM s, lev),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM aim
),
q AS (SELECT *, target - whole * source_size AS missing FROM p),
r AS (SELECT *, CASE WHEN source_size > 0 THEN missing / source_size ELSE 0 END AS share FROM q),
k AS (
  SELECT doc_id, size, d.source, source_size, target, whole, missing, share,
    ({_U} * (1.0::DOUBLE - share)) / ((1.0::DOUBLE - {_U}) * (share * sqrt(1.0::DOUBLE + size))) AS ratio
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
),
f AS (SELECT *, ratio / (1.0::DOUBLE + ratio) AS key FROM k),
c AS (
  SELECT *, sum(size) FILTER (size > 0 AND share > 0) OVER (PARTITION BY source ORDER BY CASE WHEN size > 0 AND share > 0 THEN key END NULLS LAST ROWS UNBOUNDED PRECEDING) AS upto FROM f
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN size > 0 AND share > 0
  AND (upto <= missing OR (upto - size <= missing AND upto - missing < missing - (upto - size))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""


@query("op10_mixing", OP10_SQL)
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    out = mixing.with_copies(docs).select("doc_id", "mix.*")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


# --- 2: chat formatting -------------------------------------------------------------
def _escape_sql(text: str) -> str:
    for first, rests in chat.first_characters(chat.INSTRUCT).items():
        pattern = f"([{first}])(\\\\*)({'|'.join(r.replace(']', '[]]') for r in rests)})"
        text = f"regexp_replace({text}, '{pattern}', '\\1\\\\\\2\\3', 'g')"
    return text


def _around_sql(text: str) -> str:
    marks = chat.INSTRUCT.marks
    known = "".join(f" WHEN '{r}' THEN '{a}' || {text} || '{b}'" for r, (a, b) in marks.items())
    o = chat.INSTRUCT.other
    return f"CASE role{known} ELSE '{o[0]}' || {_escape_sql('role')} || '{o[1]}' || {text} || '{o[2]}' END"


def _allowed_sql() -> str:
    cases = " ".join(f"WHEN '{s}' THEN role IN ({', '.join(repr(r) for r in rs)})" for s, rs in chat.INSTRUCT.follows.items())
    return f"CASE before {cases} ELSE false END"


OP2_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
m AS (SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM c),
e AS (SELECT *, {_around_sql(_escape_sql('text'))} AS piece, {_allowed_sql()} AS allowed FROM m)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(piece))::BIGINT AS formatted_chars,
       bool_and(allowed) AND last(role ORDER BY turn NULLS FIRST, role, text) = 'assistant' AS valid,
       CASE WHEN bool_and(allowed) THEN last(role ORDER BY turn NULLS FIRST, role, text) END AS end_state
FROM e GROUP BY conv_id
"""
PROBE = "</s>[INST] ok [/INST]"


@query("op2_chat_format", OP2_SQL)
def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT -7L AS conv_id, k AS turn, r AS role, '{PROBE}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(k, r)")
    made = chat.format_chats(rows.unionByName(probe))
    turns = F.transform(chat.read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"], chat.INSTRUCT)), "")
    made = made.withColumn("turns", turns).withColumn("loss", loss)
    return made.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "valid", "end_state",
    )


# --- 3: URL filters -----------------------------------------------------------------
def _rule_sql(of: str) -> str:
    ordered = sorted(url_templates.RULES, key=lambda r: -len(r.text))
    cases = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, of)}'" for r in ordered
    )
    return f"CASE {cases} END"


SQL_DEPTH = 6  # levels the SQL knows; the operator has as many as the paths


def _op3_sql() -> str:
    u = url_templates
    levels = [f"g{d}" for d in range(1, SQL_DEPTH + 1)]
    steps, tree = [], "t0"
    for d in range(1, SQL_DEPTH + 1):
        keys = ", ".join(["host", *levels[: d - 1]])
        own = f"g{d}"
        others = ", ".join(c for c in ["host", "shape", "n", "labelled", "blocked", *levels] if c != own)
        steps.append(f"""
w{d} AS (
  SELECT {keys} FROM (SELECT {keys}, {own}, sum(n) AS n FROM {tree} WHERE {own} != '' GROUP BY ALL) GROUP BY {keys}
  HAVING count(*) > {u.MOST_CHILDREN} AND sum(n) < {u.LEAST_REPEAT} * count(*)
),
x{d} AS (SELECT {others}, CASE WHEN {own} != '' AND concat_ws(chr(31), {keys}) IN (SELECT concat_ws(chr(31), {keys}) FROM w{d}) THEN '*' ELSE {own} END AS {own} FROM {tree}),
k{d} AS (SELECT {keys}, {own}, sum(labelled) AS l, sum(blocked) AS b FROM x{d} WHERE {own} != '' GROUP BY ALL),
p{d} AS (SELECT *, sum(l) OVER (PARTITION BY {keys}) AS pl, sum(b) OVER (PARTITION BY {keys}) AS pb FROM k{d}),
m{d} AS (
  SELECT {keys}, {own} FROM p{d} WHERE l > 0 AND pl > l
  AND (b * (pl - l) - (pb - b) * l)::DOUBLE * (b * (pl - l) - (pb - b) * l)::DOUBLE
    <= {u.DEVIATIONS ** 2}::DOUBLE * ((pb + 1.0::DOUBLE) / (pl + 2.0::DOUBLE)) * (1.0::DOUBLE - (pb + 1.0::DOUBLE) / (pl + 2.0::DOUBLE)) * l * (pl - l) * pl
),
t{d} AS (SELECT {others}, CASE WHEN {own} != '' AND concat_ws(chr(31), {keys}, {own}) IN (SELECT concat_ws(chr(31), {keys}, {own}) FROM m{d}) THEN '*' ELSE {own} END AS {own} FROM x{d})""")
        tree = f"t{d}"
    template = ", ".join(["host", *levels])
    return f"""
WITH a AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{u.SPLIT}', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '{u.SPLIT}', 2), '') AS path FROM pages
),
r AS (
  SELECT *, {_rule_sql('text')} AS rule, {_rule_sql('verdict')} AS ruled,
         [regexp_replace(x, '[0-9]+', '#', 'g') FOR x IN string_split(path, '/') IF x != ''] AS parts FROM a
),
q AS (SELECT *, array_to_string(parts, '/') AS shape, {', '.join(f"coalesce(parts[{d + 1}], '') AS {g}" for d, g in enumerate(levels))} FROM r),
t0 AS (
  SELECT host, shape, {', '.join(levels)}, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS blocked FROM q GROUP BY ALL
),{','.join(steps)},
every AS (SELECT sum(labelled) AS el, sum(blocked) AS eb FROM t0),
per AS (SELECT {template}, sum(labelled) AS l, sum(blocked) AS b FROM {tree} GROUP BY ALL),
bad AS (SELECT {template} FROM per, every WHERE l >= {u.LEAST_LABELS} AND (b + 2.0::DOUBLE * ((eb - b + 1.0::DOUBLE) / (el - l + 2.0::DOUBLE))) / (l + 2.0::DOUBLE) >= {u.PURITY}::DOUBLE),
bad_shapes AS (SELECT host, shape FROM {tree} SEMI JOIN bad USING ({template}))
SELECT page_id, q.host, path, rule, coalesce(ruled, CASE WHEN z.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN bad_shapes z ON q.host = z.host AND q.shape = z.shape
"""


OP3_SQL = _op3_sql()


@query("op3_url_filter", OP3_SQL)
def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_templates.filter_urls(table(spark, folder, "pages").select("page_id", "url")).select("page_id", "url_filter.*")


# --- 5: quality rules ---------------------------------------------------------------
def _op5_sql() -> str:
    q = quality
    count = lambda text, pattern: f"len(regexp_extract_all({text}, '{pattern}'))"
    closed = q.CLOSED.replace("'", "''")
    fails = f"""(({count('x', SPACED)} < {q.SHORT_LINE} AND NOT regexp_matches(x, '{closed}'))
      OR {count('x', q.BAR)} >= {q.BARS} OR ({count('x', q.BAR)} > 0 AND 3 * {count('x', q.BAR)} >= {count('x', SPACED)})
      OR regexp_matches(lower(x), '{'|'.join(q.FURNITURE)}')
      OR 100 * {count('x', q.SYMBOLS)} > {q.SYMBOL_SHARE} * (length(x) - {count('x', q.SPACE)}))"""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{SPACED}') AS ws, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{SPACED}')] AS ls FROM d),
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS win FROM w, unnest(range(1, len(ws) - 3)) AS t(i)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM v) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, unnest(range(0, 5)) AS t(k) GROUP BY 1),
ln AS (SELECT doc_id, x FROM w, unnest(ls) AS t(x)),
good AS (SELECT doc_id, sum({count('x', SPACED)}) AS n FROM ln WHERE NOT {fails} GROUP BY 1),
r AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(text) - {count('text', q.SPACE)} AS word_chars, {count('text', q.SYMBOLS)} AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(good.n, 0) AS n_good
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN good USING (doc_id)
),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND 100 * (n_words - n_good) <= {q.MOST_LOST} * n_words AS kept
FROM f
"""


OP5_SQL = _op5_sql()


@query("op5_quality_rules", OP5_SQL)
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judge(docs).select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names])


# --- 8: language-model scores ---------------------------------------------------------
@query("op8_lm_score")
def op8_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = language_model.score_texts(docs, language.held_out(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


# --- 11: toxicity -----------------------------------------------------------------------
@query("op11_toxicity")
def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held = language.held_out(F.col("doc_id"), 5) == 0
    labels = table(spark, folder, "labels").select("doc_id", "toxic").where(~held)
    scored = toxicity.score_texts(docs, toxicity.learn(docs.where(~held), labels))
    score, worst = F.col("toxicity.score"), F.array_max(F.transform("toxicity.sentences", lambda s: s["score"]))
    return scored.select(
        "doc_id", held.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"),
        F.size("toxicity.sentences").cast("bigint").alias("n_offending"), worst.alias("worst_sentence"),
    )


# --- 12: cross-tokenizer alignment --------------------------------------------------------
@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    sizes = ("n_a", "n_b", "n_groups", "n_links")
    made = alignment.align(docs, fields=(*sizes, "groups", "pairs", "times")).select("doc_id", "alignment.*")
    digest = F.when(F.col("n_groups") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    made = stored(made.select(F.monotonically_increasing_id().alias("row"), "doc_id", *sizes, digest.alias("groups_sha256"), "pairs", "times"), "aligned")
    pairs, times = F.col("pairs"), F.col("times")
    counted = alignment.with_link_counts(made, alignment.link_counts(made, pairs), "row", pairs, times)
    zero = F.lit(0).cast("bigint")
    return made.drop("pairs", "times").join(counted, "row", "left").select(
        "doc_id", *sizes, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )


# --- 13: hard negatives -------------------------------------------------------------------
OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256::DOUBLE * x::DOUBLE)::BIGINT::HUGEINT) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id != b.vec_id
),
pos AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM pos JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""


@query("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)
