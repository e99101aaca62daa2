"""Near-duplicate documents by b-bit MinHash, links confirmed on full shingle sets.

1. Each text becomes its set of hashed 5-word shingles.  Documents with equal sets are
   one class, found by a digest, so copies never meet in pairs.
2. Per class, ``ROWS * BANDS`` minima give one key per band (whole minima) and a packed
   signature that keeps 4 low bits of every minimum.
3. Members are ranked by a digest of their id; the first of a band bucket leads it.  Each member is paired
   with the first of its leaders only, so a group of near copies gathers around one of them with one pair a
   member, whatever its size.  A pair is dropped if the similarity estimated from
   the signatures' equal fields, corrected for chance collisions, is far below the
   threshold; the rest are compared on their full sets.  Links are joined to components.
4. Buckets that still hold several components pair each member outside their largest
   component with one hub, the most linked member of such a component: again one pair a member.
5. What is still apart in buckets of up to ``PART`` members: each member outside the largest component meets the members
   of the other components, at most ``PART`` pairs a member.  For them a longer signature is made, one bit
   of each of 2048 minima, and only pairs whose estimate allows a link leave that join, each from the first
   bucket it shares, to be compared on their full sets.
6. Larger buckets are cut into parts of ``BLOCK`` members, and every two parts meet in a task of their own with their full
   sets: a product of two 0/1 matrices counts what all their pairs share.  A task returns the components it joined,
   one row to a component, not its links.  So every pair that shares a bucket is joined already, or compared.

A pair at the threshold misses all buckets with probability (1 - 0.75^ROWS)^BANDS, 5e-6,
and is estimated too low with probability 1e-4.

Defined cases: a text of one to four words is one shingle; null and wordless texts have
no shingle and no link; a row without id is linked with nothing and kept; repeated rows
get equal results; tables may be empty; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from relweave.llm.components import connected_components
from relweave.llm.store import short_batches, small, stored
from relweave.llm.words import SPACED, mix, numbered, run_starts, runs, word_slices

WIDTH = 5
ROWS, BANDS = 4, 32
THRESHOLD = 75  # per cent
PART = 64  # members of a bucket up to which its pairs are estimated one by one
BLOCK = 512  # members of a larger bucket in one part
SHINGLES = 4096  # columns of the matrices at a time


@dataclass(frozen=True)
class Signature:
    """``bits`` low bits of ``count`` minima; estimates may fall ``slack`` below the threshold (3.7 deviations)."""

    count: int
    bits: int
    slack: float


COARSE, SHARP = Signature(ROWS * BANDS, 4, 0.15), Signature(2048, 1, 0.055)
_FACTORS = (numbered(SHARP.count, seed=3) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (numbered(SHARP.count, seed=5) >> np.uint64(32)).astype(np.uint32)
ARROW_SKETCH = pa.struct([
    ("n", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("signature", pa.list_(pa.int64())),
])


def shingle_sets(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted distinct shingle hashes of consecutive rows, and each row's first index."""
    for words in word_slices(texts, SPACED):
        hashes, counts = words.hashes(), np.diff(words.rows)
        starts = run_starts(words.rows, WIDTH)
        owner = np.searchsorted(words.rows, starts, side="right") - 1
        values = [runs(hashes, WIDTH)[starts]] if len(starts) else []
        owners = [owner]
        for width in range(1, WIDTH):
            short = np.flatnonzero(counts == width)
            if len(short):
                values.append(runs(hashes, width)[words.rows[short]])
                owners.append(short)
        value = np.concatenate(values) if values else np.zeros(0, dtype=np.uint64)
        owner = np.concatenate(owners)
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[new], owner[new]
        yield value, np.searchsorted(owner, np.arange(len(counts) + 1))


def minima(values: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """``count`` minima for each non-empty set; ``starts`` are the sets' first indexes."""
    low = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((count, len(starts)), dtype=np.uint32)
    room = np.empty_like(low)
    for k in range(count):
        np.multiply(low, _FACTORS[k], out=room)
        np.add(room, _SHIFTS[k], out=room)
        np.bitwise_xor(room, room >> np.uint32(15), out=room)
        np.minimum.reduceat(room, starts, out=out[k])
    return mix(out.T.astype(np.uint64))


def packed(least: np.ndarray, kind: Signature) -> np.ndarray:
    """The low bits of each minimum, 64 bits to a word."""
    fields = (least & np.uint64((1 << kind.bits) - 1)).reshape(len(least), -1, 64 // kind.bits)
    places = np.arange(64 // kind.bits, dtype=np.uint64) * np.uint64(kind.bits)
    return np.bitwise_or.reduce(fields << places, axis=2)


def as_lists(rows: np.ndarray) -> pa.Array:
    ends = pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(rows.reshape(-1).view(np.int64)))


def sketches(values: np.ndarray, rows: np.ndarray) -> pa.Array:
    sizes = np.diff(rows)
    full = np.flatnonzero(sizes > 0)
    n = len(sizes)
    bands, signature = np.zeros((n, BANDS), dtype=np.uint64), np.zeros((n, COARSE.count * COARSE.bits // 64), dtype=np.uint64)
    digests: list[bytes | None] = [None] * n
    if len(full):
        starts = rows[full]
        least = minima(values, starts, COARSE.count)
        key = np.zeros((len(full), BANDS), dtype=np.uint64)
        for r in range(ROWS):
            key = mix(key + least[:, r::ROWS] + numbered(BANDS, seed=11))
        bands[full], signature[full] = key, packed(least, COARSE)
        both = np.stack([np.add.reduceat(mix(values ^ s), starts) for s in numbered(2, seed=13)], axis=1)
        for i, row in enumerate(full.tolist()):
            digests[row] = both[i].tobytes()
    return pa.StructArray.from_arrays(
        [pa.array(sizes.astype(np.int64)), pa.array(digests, type=pa.binary()), as_lists(bands), as_lists(signature)],
        fields=list(ARROW_SKETCH),
    )


@F.arrow_udf(T.ArrayType(T.LongType()))
def sharp_signature(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        parts = []
        for values, rows in shingle_sets(texts):
            out = np.zeros((len(rows) - 1, SHARP.count * SHARP.bits // 64), dtype=np.uint64)
            full = np.flatnonzero(np.diff(rows) > 0)
            if len(full):
                out[full] = packed(minima(values, rows[full], SHARP.count), SHARP)
            parts.append(as_lists(out))
        yield pa.concat_arrays(parts) if parts else pa.array([], type=pa.list_(pa.int64()))


@F.arrow_udf(from_arrow_type(ARROW_SKETCH))
def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        parts = [sketches(values, rows) for values, rows in shingle_sets(texts)]
        yield pa.concat_arrays(parts) if parts else pa.array([], type=ARROW_SKETCH)


@F.arrow_udf(T.ArrayType(T.LongType()))
def shingle_set(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        parts = [
            pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(values.view(np.int64)))
            for values, rows in shingle_sets(texts)
        ]
        yield pa.concat_arrays(parts) if parts else pa.array([], type=pa.list_(pa.int64()))


def similarity(a: Sequence[Column], b: Sequence[Column], kind: Signature) -> Column:
    """Jaccard similarity estimated from the words of two packed signatures."""
    ones = sum(1 << (k * kind.bits) for k in range(64 // kind.bits))
    ones = ones - (1 << 64) if ones >= 1 << 63 else ones

    def differing(x: Column) -> Column:
        folded = x
        for k in range(1, kind.bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(folded.bitwiseAND(F.lit(ones).cast("bigint")) if kind.bits > 1 else folded)

    words = [differing(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)]
    equal = 1.0 - sum(words[1:], words[0]) / F.lit(float(kind.count))
    chance = 1.0 / (1 << kind.bits)
    return (equal - chance) / (1.0 - chance)


def _few(table: DataFrame) -> DataFrame:
    """A stored table of one or two ids, marked for broadcast if it is small; ids that are texts are measured."""
    text = any(isinstance(f.dataType, T.StringType) for f in table.schema)
    return small(table, None if text else 16)


def texts_of(ids: DataFrame, docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, __text) of the given ids; few ids, counted first, are broadcast, more are joined by a shuffle."""
    ids = _few(stored(ids, "ids"))
    return docs.select(F.col(id_).alias("id"), F.col(text).alias("__text")).join(ids, "id", "left_semi")


def confirmed(pairs: DataFrame, docs: DataFrame, id_: str, text: str, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets overlap enough.  Only members of pairs send their sets."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = stored(texts_of(ends, docs, id_, text).select("id", shingle_set("__text").alias("set")).dropDuplicates(["id"]), "sets")
    one = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    two = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("bigint")
    union = F.size("set_a") + F.size("set_b") - shared
    return both.where(100 * shared >= threshold * union).select("a", "b")


def near_duplicates(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``, ``kept``."""
    short_batches(docs.sparkSession)
    made = docs.select(F.col(id_).alias("id"), sketch(F.col(text)).alias("s"))
    made = stored(made.select("id", "s.*"), "sketches")
    known = made.where(F.col("id").isNotNull() & (F.col("n") > 0))
    # one class per distinct set; the smallest id stands for it
    classes = stored(
        known.groupBy("digest", "n").agg(F.min("id").alias("id"), F.first("bands").alias("bands"), F.first("signature").alias("signature")),
        "classes",
    )
    members = classes.select("id", F.posexplode("bands").alias("band", "bucket"))
    rank = F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("leader"))
    leaders = members.groupBy("bucket").agg(F.min(rank).alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = stored(members.join(leaders, "bucket").select("bucket", "band", "id", "lead"), "buckets")
    first = shared.groupBy("id").agg(F.min("lead").alias("lead")).select("id", F.col("lead.leader").alias("other")).where("id != other")
    links = stored(confirmed(stored(judged(first, classes, threshold), "pairs"), docs, id_, text, threshold), "links")
    groups = stored(connected_components(links), "groups")

    def sharp(ids: DataFrame) -> DataFrame:
        return texts_of(ids, docs, id_, text).select("id", sharp_signature("__text").alias("signature")).dropDuplicates(["id"])

    def joined(groups: DataFrame, more: DataFrame) -> DataFrame:
        known = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        return stored(connected_components(known.unionByName(more)), "groups")

    for pairs_of in (hub_pairs, lambda *known: outside_pairs(*known, sharp)):
        pairs = stored(pairs_of(shared, groups, links, classes, threshold), "pairs")
        if not pairs.isEmpty():
            more = stored(confirmed(pairs, docs, id_, text, threshold), "links")
            links, groups = links.unionByName(more), joined(groups, more)
    large = mixed_buckets(shared, groups).where(F.col("size") > PART)
    if not large.isEmpty():
        groups = joined(groups, stored(block_links(large, docs, id_, text, threshold), "links"))
    named = classes.select("digest", "n", F.col("id").alias("node")).join(groups, "node", "left")
    named = named.select("digest", "n", F.coalesce("component", "node").alias("component_id"))
    out = made.select("id", "n", "digest").join(named, ["digest", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(id_), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def alike(x: Column, y: Column, threshold: int) -> Column:
    """Whether sizes and signatures (n, signature of two structs) allow the threshold."""
    words = range(COARSE.count * COARSE.bits // 64)
    estimate = similarity([x["signature"][k] for k in words], [y["signature"][k] for k in words], COARSE)
    return sizes_allow(x["n"], y["n"], threshold) & (estimate >= threshold / 100 - COARSE.slack)


def sizes_allow(n: Column, m: Column, threshold: int) -> Column:
    return 100 * F.least(n, m) >= threshold * F.greatest(n, m)


def profiles(classes: DataFrame, node: str, profile: str) -> DataFrame:
    return classes.select(F.col("id").alias(node), F.struct("n", "signature").alias(profile))


def ordered(x: str, y: str) -> tuple[Column, Column]:
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def judged(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Distinct pairs (id, other) whose estimate allows a link, as (a, b)."""
    both = pairs.select(*ordered("id", "other")).distinct().join(profiles(classes, "a", "pa"), "a").join(profiles(classes, "b", "pb"), "b")
    return both.where(alike(F.col("pa"), F.col("pb"), threshold)).select("a", "b")


def mixed_buckets(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with the largest component there and the bucket's size."""
    placed = shared.select("bucket", "band", F.col("id").alias("node")).join(_few(groups), "node", "left")
    placed = placed.select("bucket", "band", "node", F.coalesce("component", "node").alias("component"))
    counts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m"))
    mixed = counts.groupBy("bucket").agg(F.max(F.struct("m", "component")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("m").alias("size"))
    mixed = mixed.where("parts > 1").select("bucket", F.col("top.component").alias("top"), "size")
    return stored(placed.join(mixed, "bucket"), "mixed")


def hub_pairs(shared: DataFrame, groups: DataFrame, links: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Members outside a bucket's largest component, each with one hub: the most linked member of such a component there."""
    members = mixed_buckets(shared, groups)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    inner = members.where("component = top").join(degree, "node", "left")
    hubs = inner.groupBy("bucket").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("d"), "node")).alias("hub"))
    pairs = members.where("component != top").join(hubs, "bucket").groupBy("node").agg(F.max("hub").alias("hub"))
    return judged(pairs.select(F.col("node").alias("id"), F.col("hub.node").alias("other")), classes, threshold)


def outside_pairs(
    shared: DataFrame, groups: DataFrame, links: DataFrame, classes: DataFrame, threshold: int, sharp: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """In small buckets, members outside the largest component with members of the others, where the estimate allows a link."""
    members = mixed_buckets(shared, groups).where(F.col("size") <= PART)
    low, halves = F.lit(0xFFFFFFFF).cast("bigint"), range(BANDS // 2)
    keys = [F.get("bands", F.lit(2 * k)).bitwiseAND(low).bitwiseOR(F.shiftleft(F.get("bands", F.lit(2 * k + 1)), 32)) for k in halves]
    known = sharp(members.select(F.col("node").alias("id")).distinct()).join(classes.select("id", "n", F.array(*keys).alias("keys")), "id")
    members = stored(members.join(known.withColumnRenamed("id", "node"), "node"), "mixed")
    # one plain column for each word of a signature keeps the join's code short
    words = range(SHARP.count * SHARP.bits // 64)

    def side(mark: str) -> list[Column]:
        own = [F.coalesce(F.get("signature", F.lit(k)), F.lit(0)).alias(f"{mark}{k}") for k in words]
        own += [F.coalesce(F.get("keys", F.lit(k)), F.lit(0)).alias(f"{mark}key{k}") for k in halves]
        own += [F.col(c).alias(f"{mark}{c}") for c in ("node", "component", "n")]
        return ["bucket", *([F.coalesce("band", F.lit(0)).alias("band")] if mark == "x" else []), *own]

    # a bucket before this one that the pair shares too has emitted it already
    news = F.lit(True)
    for k in halves:
        differ = F.col(f"xkey{k}").bitwiseXOR(F.col(f"ykey{k}"))
        news = news & ((F.col("band") <= 2 * k) | (differ.bitwiseAND(low) != 0)) & ((F.col("band") <= 2 * k + 1) | (F.shiftrightunsigned(differ, 32) != 0))
    estimate = similarity([F.col(f"x{k}") for k in words], [F.col(f"y{k}") for k in words], SHARP)
    met = members.where("component != top").select(*side("x")).join(members.select(*side("y")), "bucket").where(
        (F.col("xcomponent") != F.col("ycomponent")) & sizes_allow(F.col("xn"), F.col("yn"), threshold)
        & (estimate >= threshold / 100 - SHARP.slack) & news
    )
    return met.select(*ordered("xnode", "ynode")).distinct()


def joined_components(sets: pa.ListArray, first: np.ndarray, second: np.ndarray, components: np.ndarray, threshold: int) -> np.ndarray:
    """Numbers of the components after the links between members ``first`` and ``second`` have joined them."""
    edges = sets.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(edges)
    _, column, often = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = often[column] > 1  # the others no two members share
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    places = [np.full(len(sets), -1), np.full(len(sets), -1)]
    places[0][first], places[1][second] = np.arange(len(first)), np.arange(len(second))
    both = np.zeros((len(first), len(second)), dtype=np.float32)
    for low in range(0, int(column.max()) + 1 if len(column) else 0, SHINGLES):
        now = (column >= low) & (column < low + SHINGLES)
        sides = []
        for place, count in zip(places, (len(first), len(second)), strict=True):
            own = now & (place[row] >= 0)
            side = np.zeros((count, SHINGLES), dtype=np.float32)
            side[place[row[own]], column[own] - low] = 1
            sides.append(side)
        both += sides[0] @ sides[1].T  # counts below 2^24, exact
    union = sizes[first][:, None] + sizes[second][None, :] - both
    a, b = np.nonzero(100 * both.astype(np.float64) >= threshold * union)
    root = np.arange(components.max() + 1)
    u, v = components[first[a]], components[second[b]]
    while (root[u] != root[v]).any():
        x, y = root[u], root[v]
        np.minimum.at(root, x, y)
        np.minimum.at(root, y, x)
        while (root[root] != root).any():
            root = root[root]
    return root


def block_links(large: DataFrame, docs: DataFrame, id_: str, text: str, threshold: int) -> DataFrame:
    """(a, b): components of large buckets that a pair of members links, found block by block on full sets."""
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = large.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    placed = placed.select("bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", F.col("node").alias("id"), "component")
    sets = texts_of(large.select(F.col("node").alias("id")).distinct(), docs, id_, text).select("id", shingle_set("__text").alias("set")).dropDuplicates(["id"])
    kind = large.schema["component"].dataType

    def block(table: pa.Table) -> pa.Table:
        names = table.column("component").combine_chunks()
        known, number = np.unique(names.to_numpy(zero_copy_only=False), return_inverse=True)
        part = table.column("part").to_numpy()
        first, second = np.flatnonzero(part == part.min()), np.flatnonzero(part == part.max())
        root = joined_components(table.column("set").combine_chunks(), first, second, number, threshold) if len(known) > 1 else np.zeros(1, dtype=np.int64)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": pa.array(known[root[moved]], type=names.type), "b": pa.array(known[moved], type=names.type)})

    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    return placed.join(sets, "id").groupBy("bucket", "low", "high").applyInArrow(block, schema)
