"""Mixing sources to target weights by Pareto order sampling.

Targets: sources in code point order (null last) take the weights in turn and share the
words of all documents.  A target stops at ``most_copies`` times its source's words; the
excess is shared again by weight until no target is above.

A source whose target is r times its words takes floor(r) whole copies of each document.
The rest is a sample without replacement.  Document i has inclusion odds
f / (1 - f) * pull_i, where f is the missing share and pull_i a weight of the document;
its rank key is (U / (1 - U)) / odds with a U drawn from seed and id, and documents are
taken in key order until their words reach the missing words: a fixed-size sample with
unequal probabilities.  The last document goes in if that comes nearer to the target.

No source is ranked as a whole.  The words per source and per slice of the key range are
added up first (``SLICES`` rows a source), which shows the slice the boundary falls in;
that slice is cut once more, and only documents in the last small slice are sorted.

Defined cases: a null or wordless text has size 0 and is taken 0 times; documents
of size 0 take part in no sample; an empty source has target 0; null is a source of its
own; rows of equal key (repeated rows, and rows without id of one size) are numbered in parts
and taken one by one, as many as come nearest to the target; an empty table gives an empty result; other columns pass
through whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relweave.functions.draws import unit
from relweave.llm.store import small, stored, unused
from relweave.llm.words import SPACED

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SLICES = 1024
TIES = 50_000  # rows of one key that are numbered in one part
SEED = 42


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_copies: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size); one row per source is all that is ordered."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = stored(per_source.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), place)), "sources")
    cap = most_copies * F.col("source_size")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    # sources above their cap leave the sharing; each round lets at least one go
    level, gone = 0.0, -1
    while True:
        free = F.col("weight") * F.lit(level) < cap if gone >= 0 else F.lit(True)
        state = weighed.agg(
            F.sum(F.when(free, 0).otherwise(cap)).alias("fixed"), F.sum(F.when(free, F.col("weight")).otherwise(0)).alias("open"),
            F.sum(F.when(free, 0).otherwise(1)).alias("gone"),
        ).first()
        if not state["open"] or state["gone"] == gone:
            break
        gone, level = state["gone"], (total - state["fixed"]) / state["open"]
    target = F.least(F.col("weight") * F.lit(float(level)), cap.cast("double"))
    return weighed.select("source", "source_size", target.alias("target"))


def key(id_: Column, pull: Column, share: Column, seed: int) -> Column:
    """Random odds divided by inclusion odds, folded into [0, 1)."""
    u = unit(seed, "mix", "rank", F.coalesce(id_.cast("string"), F.lit("")))
    ratio = (u * (1.0 - share)) / ((1.0 - u) * (share * pull))
    return ratio / (1.0 + ratio)


def edge(rows: DataFrame, bin_: str) -> DataFrame:
    """Per source, the bin in which the running sum of words passes ``missing``, the sum before it and its rows."""
    per_bin = rows.groupBy("source", "missing", bin_).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), F.first("done").alias("done"))
    upto = F.col("done") + F.sum("words").over(W.partitionBy("source").orderBy(bin_))
    run = per_bin.withColumn("upto", upto).withColumn("done", F.col("upto") - F.col("words"))
    return run.where((F.col("done") <= F.col("missing")) & (F.col("upto") > F.col("missing"))).select("source", bin_, "done", "upto", "rows", "missing")


def cut_keys(ranked: DataFrame) -> DataFrame:
    """Per source the key at which its sample ends, how many rows have it, and how many of them go in."""
    found = ranked.withColumn("done", F.lit(0).cast("bigint"))
    for bin_ in ("coarse", "fine"):
        at = small(stored(edge(found, bin_).select(F.col("source").alias("s"), F.col(bin_).alias("b"), F.col("done").alias("d")), "edges"), 64)
        found = found.drop("done").join(at, F.col("source").eqNullSafe(F.col("s")) & (F.col(bin_) == F.col("b"))).withColumnRenamed("d", "done").drop("s", "b")
    last = edge(found, "key")
    # rows of one key have one size; those whole inside, and one more if that comes nearer
    size = (F.col("upto") - F.col("done")) / F.col("rows")
    inside = F.floor((F.col("missing") - F.col("done")) / size)
    left = F.col("missing") - F.col("done") - inside * size
    take = inside + F.when(size - left < left, 1).otherwise(0)
    return last.select(F.col("source").alias("cut_source"), F.col("key").alias("cut_key"), take.alias("cut_take"), F.col("rows").alias("cut_rows"))


def plan(aims: DataFrame) -> DataFrame:
    """Whole copies, missing words and missing share of each source."""
    size = F.col("source_size")
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("bigint")
    planned = aims.withColumn("whole", whole).withColumn("missing", F.col("target") - F.col("whole") * size)
    return planned.withColumn("share", F.when(size > 0, F.col("missing") / size).otherwise(0.0)).withColumnRenamed("source", "t_source")


def with_copies(
    docs: DataFrame, *, id_: str = "doc_id", text: str = "text", source: str = "source", pull: Callable[[Column], Column] | None = None,
    weights: Sequence[int] = WEIGHTS, most_copies: int = MOST_COPIES, seed: int = SEED, slices: int = SLICES, mix: str = "mix",
) -> DataFrame:
    """``docs`` with ``mix``: a struct of ``size``, ``source_size``, ``target`` and ``copies``.

    ``pull`` makes a weight of a document's size, by default the square root of 1 + size.
    """
    pull = pull or (lambda size: F.sqrt(1.0 + size))
    sized = stored(docs.select(F.col(id_).alias("id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size")), "sizes")
    aims = stored(plan(targets(sized, weights, most_copies)), "targets")
    drawn = sized.join(small(aims, 64), F.col("source").eqNullSafe(F.col("t_source"))).where("size > 0 AND share > 0")
    own = F.when(F.col("share") > 0, key(F.col("id"), pull(F.col("size")), F.col("share"), seed))
    ranked = drawn.select("source", "size", "missing", own.alias("key"))
    ranked = ranked.withColumn("coarse", F.floor(F.col("key") * slices)).withColumn("fine", F.floor((F.col("key") * slices - F.col("coarse")) * slices))
    joined = aims.join(cut_keys(ranked), F.col("t_source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source")
    own_, aim_, tie_ = unused(docs, "own", "aim", "tie")
    aims = stored(joined.select(F.struct(*joined.columns).alias(aim_)), "targets")
    own, aim = F.col(own_), F.col(aim_)
    named = docs.withColumn(own_, F.struct(F.col(id_).alias("id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size")))
    placed = named.join(small(aims, 128), own["source"].eqNullSafe(aim["t_source"]))
    sampled = (own["size"] > 0) & (aim["share"] > 0)
    rank = F.when(sampled, key(own["id"], pull(own["size"]), aim["share"], seed))
    at_cut = F.coalesce(sampled & (rank == aim["cut_key"]), F.lit(False))
    inside = F.coalesce(rank < aim["cut_key"], sampled & aim["cut_key"].isNull(), F.lit(False))

    def with_mix(rows: DataFrame, extra: Column) -> DataFrame:
        made = F.struct(
            own["size"].alias("size"), aim["source_size"].alias("source_size"), aim["target"].alias("target"),
            (aim["whole"] + extra.cast("int")).alias("copies"),
        )
        return rows.withColumn(mix, made).drop(own_, aim_, tie_)

    if aims.where(aim["cut_rows"] > 1).isEmpty():
        return with_mix(placed, inside | (at_cut & (aim["cut_take"] > 0)))
    # several rows share the key of a cut: they alone are numbered, in parts that no group outgrows
    ties = stored(placed.where(at_cut).withColumn(tie_, F.monotonically_increasing_id()), "ties")
    part = F.pmod(F.xxhash64(F.col(tie_)), F.ceil(aim["cut_rows"] / TIES).cast("bigint"))
    cut = ties.select(F.col(tie_).alias("tie"), aim["t_source"].alias("s"), part.alias("part"))
    before = cut.groupBy("s", "part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select(
        F.col("s").alias("s2"), F.col("part").alias("part2"),
        F.coalesce(F.sum("n").over(W.partitionBy("s").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    place = F.row_number().over(W.partitionBy("s", "part").orderBy("tie"))
    ranked = cut.withColumn("place", place).join(before, F.col("s").eqNullSafe(F.col("s2")) & (F.col("part") == F.col("part2")))
    ranked = ranked.select(F.col("tie").alias(tie_), (F.col("before") + F.col("place")).alias("place"))
    place_, = unused(ties, "place")
    tied = ties.join(ranked.withColumnRenamed("place", place_), tie_)
    return with_mix(placed.where(~at_cut), inside).unionByName(with_mix(tied, F.col(place_) <= aim["cut_take"]).drop(place_))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken."""
    mix, copy = unused(docs, "mix", "copy")
    taken = with_copies(docs, mix=mix, **options)
    return taken.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(mix)["copies"].cast("int")))).select(*docs.columns)
