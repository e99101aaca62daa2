"""URL filters by path-template trees, in Spark's own expressions: no Python runs on the executors.

A URL's path segments are the levels of a tree below its host, as many as the longest path has; digits in a
segment are replaced by ``#``.  Level by level:

1. Variable segments: where a node has more than ``most_children`` children with fewer than
   ``least_repeat`` pages each on average, its children become one wildcard ``*``.
2. Similar branches: a labelled child whose rate of blocked labels does not differ from that of its labelled
   siblings together (two-proportion test at ``deviations``) joins the wildcard; children that differ, and those
   without labels, keep their name.

What is left of a path is a template.  Its labelled purity is smoothed towards the labels of all other
templates together: (blocked + 2 h) / (labelled + 2), where h is (other blocked + 1) / (other labelled + 2).
A template of ``least_labels`` labels or more whose purity reaches ``purity`` is rejected; one without labels never is.

Pages are first added up per host and path shape, so the tree is built on that table; a
host with a third of all pages has few shapes unless its segments vary, and then every
level's counts are combined before they are shuffled.  Only shapes of rejected templates
are joined back to pages, by a plain join that Spark can split.

Defined cases: a null URL, or one without ``://``, has an empty host and path; repeated
pages count each; without labels nothing is rejected; an empty table gives an empty
result; other columns pass through whatever their names, and a column named like the result is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.llm.store import stored, unused
from relweave.llm.words import lower_ascii

MOST_CHILDREN, LEAST_REPEAT = 16, 4
DEVIATIONS = 2.0
PURITY, LEAST_LABELS = 0.8, 3
SPLIT = r"://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The longest rule that fits, as its number in ``rules``; null if none does."""
    out = None
    for k, rule in sorted(enumerate(rules), key=lambda x: -len(x[1].text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(k)) if out is None else out.when(fits, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def pick(number: Column, values: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), number)


def shape(path: Column) -> Column:
    """Path segments with digits replaced, joined."""
    parts = F.filter(F.split(path, "/", -1), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.regexp_replace(x, "[0-9]+", "#")), "/")


def shapes(pages: DataFrame, host: Column, path: Column, blocked: Column) -> DataFrame:
    """(host, shape) with numbers of pages, labelled and blocked pages, and the segments: the tree's levels."""
    known = pages.select(host.alias("host"), shape(path).alias("shape"), blocked.alias("blocked"))
    counted = known.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("blocked").alias("labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).cast("bigint").alias("blocked")
    )
    return counted.withColumn("segs", F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", "/", -1)))


def _children(tree: DataFrame, level: int) -> DataFrame:
    """Rows that reach the level, with the node above (``parent``) and their segment there (``own``)."""
    parent = F.array_join(F.slice("segs", 1, level - 1), "/") if level > 1 else F.lit("")
    return tree.where(F.size("segs") >= level).select("*", parent.alias("parent"), F.get("segs", F.lit(level - 1)).alias("own"))


def _as_wildcard(tree: DataFrame, marks: DataFrame, keys: list[str], level: int) -> DataFrame:
    """The tree with ``*`` at the level where the node is among ``marks``."""
    deep = _children(tree, level).join(marks.select(*keys, F.lit(True).alias("mark")), keys, "left")
    star = F.transform("segs", lambda x, i: F.when(i == level - 1, "*").otherwise(x))
    deep = deep.withColumn("segs", F.when(F.col("mark"), star).otherwise(F.col("segs"))).select(*tree.columns)
    return tree.where(F.size("segs") < level).unionByName(deep)


def generalised(tree: DataFrame, level: int, most_children: int, least_repeat: int) -> DataFrame:
    """Step 1 at one level."""
    children = _children(tree, level).groupBy("host", "parent", "own").agg(F.sum("n").alias("n"))
    wide = children.groupBy("host", "parent").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("p"))
    return _as_wildcard(tree, wide.where((F.col("c") > most_children) & (F.col("p") < least_repeat * F.col("c"))), ["host", "parent"], level)


def merged(tree: DataFrame, level: int, deviations: float) -> DataFrame:
    """Step 2 at one level."""
    children = _children(tree, level).groupBy("host", "parent", "own").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    both = children.join(children.groupBy("host", "parent").agg(F.sum("l").alias("pl"), F.sum("b").alias("pb")), ["host", "parent"])
    rest = F.col("pl") - F.col("l")
    # (b / l - rest_b / rest)^2 against deviations^2 * p (1 - p) (1 / l + 1 / rest), times (l * rest)^2
    gap = (F.col("b") * rest - (F.col("pb") - F.col("b")) * F.col("l")).cast("double")
    share = (F.col("pb") + 1.0) / (F.col("pl") + 2.0)
    spread = deviations * deviations * share * (1.0 - share) * F.col("l") * rest * F.col("pl")
    alike = (F.col("l") > 0) & (rest > 0) & (gap * gap <= spread)
    return _as_wildcard(tree, both.where(alike), ["host", "parent", "own"], level)


def rejected_shapes(tree: DataFrame, *, most_children: int = MOST_CHILDREN, least_repeat: int = LEAST_REPEAT,
                    deviations: float = DEVIATIONS, purity: float = PURITY, least_labels: int = LEAST_LABELS) -> DataFrame:
    """(host, shape) of all rejected templates."""
    tree = stored(tree, "shapes")
    depth, labelled, blocked = tree.agg(F.max(F.size("segs")), F.sum("labelled"), F.sum("blocked")).first()
    for level in range(1, (depth or 0) + 1):
        tree = stored(merged(generalised(tree, level, most_children, least_repeat), level, deviations), "shapes")
    tree = tree.withColumn("template", F.array_join("segs", "/"))
    per_template = tree.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    other = (F.lit(blocked or 0) - F.col("b") + 1.0) / (F.lit(labelled or 0) - F.col("l") + 2.0)
    bad = per_template.where((F.col("l") >= least_labels) & ((F.col("b") + 2.0 * other) / (F.col("l") + 2.0) >= purity))
    return tree.join(bad, ["host", "template"], "left_semi").select("host", "shape")


def filter_urls(pages: DataFrame, *, url: str = "url", rules: Sequence[Rule] = RULES, result: str = "url_filter", **options: float) -> DataFrame:
    """``pages`` with ``url_filter``: host, path, rule, verdict.

    The rules' own verdicts are the labels the templates are judged by.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    number = longest_rule(host, path, rules)
    blocked = pick(number, [r.verdict for r in rules]) == "block"
    bad = stored(rejected_shapes(shapes(pages, host, path, blocked.cast("int")), **options), "rejected")
    own, bad_host, bad_shape = unused(pages, "own", "bad_host", "bad_shape")
    bad = bad.select(F.col("host").alias(bad_host), F.col("shape").alias(bad_shape))
    known = pages.withColumn(own, F.struct(host.alias("host"), path.alias("path"), number.alias("rule"), shape(path).alias("shape")))
    page = F.col(own)
    both = known.join(bad, (page["host"] == F.col(bad_host)) & (page["shape"] == F.col(bad_shape)), "left")
    verdict = F.when(F.col(bad_host).isNotNull(), "block").otherwise("allow")
    made = F.struct(
        page["host"].alias("host"), page["path"].alias("path"), pick(page["rule"], [r.text for r in rules]).alias("rule"),
        F.coalesce(pick(page["rule"], [r.verdict for r in rules]), verdict).alias("verdict"),
    )
    return both.withColumn(result, made).drop(own, bad_host, bad_shape)
