"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes: every step shifts left by one and adds a fixed value of
the byte, so a hash of ``WINDOW_BITS`` bits sees that many last bytes only.  A space
whose hash has zeros under the mask ends a chunk; where none of the bytes the hash sees is
a space, so does any character whose hash has zeros under a longer mask.  Cuts depend on
the bytes around them alone, so an insertion moves the cuts near it and no others.

Neighbouring chunks that together just reach ``least_run`` bytes are a run, known by a
128-bit digest of its whole text; from each chunk one run goes forward and one back, so
that runs reach both ends of a repeated passage.  The first occurrence of a run in
(document, position) order stays; later ones are removed.  Chunks repeated one by one,
each from another place, are left alone.

Only digests are shuffled, twice: once to find each repeated digest's first place (with
map-side combine, so a common passage is no hot group), once to mark the later places by a
plain join.  Texts move only for documents that lose something.

Defined cases: null and empty texts have no chunks and are kept as they are; a document
without id takes no part; repeated rows of one id count as one document, whose repeats
inside itself are removed alike in each row; text without any cut, such as one character
over and over, is a chunk per ``LONGEST`` bytes, shortened to whole characters; other
columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from relweave.llm.store import short_batches, small, stored, unused
from relweave.llm.words import CLASSES, SPACED, numbered, slices

WINDOW_BITS = 16
MASK_BITS = 2  # a cut about every fourth word
DENSE_BITS = 5  # a cut about every 32nd character where there are no spaces
SHORTEST, LONGEST = 16, 512
LEAST_RUN = 110  # about 20 words
_GEAR = (numbered(256, seed=29) >> np.uint64(48)).astype(np.uint16)
_MASK = np.uint16(((1 << MASK_BITS) - 1) << (WINDOW_BITS - MASK_BITS))
_DENSE_MASK = np.uint16(((1 << DENSE_BITS) - 1) << (WINDOW_BITS - DENSE_BITS))
_SPACE = ~CLASSES[SPACED]
ARROW_CHUNKS = pa.list_(pa.struct([("pos", pa.int32()), ("size", pa.int32()), ("digest", pa.binary()), ("again", pa.bool_())]))


def gear_hash(flat: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte; 16 bits wide, so it sees the last 16 bytes."""
    h = _GEAR[flat]
    reach = 1
    while reach < WINDOW_BITS:  # doubling: the hash over 2r bytes from two hashes over r
        later = h.copy()
        later[reach:] += h[:-reach] << np.uint16(reach)
        h, reach = later, reach * 2
    return h


def may_end(own: np.ndarray) -> np.ndarray:
    """Where the bytes up to there let a chunk end."""
    h, space = gear_hash(own), _SPACE[own]
    near, reach = space.copy(), 1  # a space among the bytes the hash sees
    while reach < WINDOW_BITS:
        later = near.copy()
        later[reach:] |= near[:-reach]
        near, reach = later, reach * 2
    whole = np.ones(len(own), dtype=bool)  # the next byte begins a character
    whole[:-1] = (own[1:] & 0xC0) != 0x80
    return np.flatnonzero((space & ((h & _MASK) == 0)) | (~near & whole & ((h & _DENSE_MASK) == 0))) + 1


def cuts(own: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, stop) of a text's chunks."""
    length, start = len(own), 0
    ends = may_end(own) if length else own
    for end in [*ends.tolist(), length]:
        if end - start < SHORTEST and end < length:
            continue
        while end - start > LONGEST:
            stop = start + LONGEST
            while stop > start + LONGEST - 4 and own[stop] & 0xC0 == 0x80:
                stop -= 1
            yield start, stop
            start = stop
        if end > start:
            yield start, end
            start = end


def runs(own: np.ndarray, least_run: int) -> list[tuple[int, int]]:
    """(start, stop), in order, of the shortest runs of at least ``least_run`` bytes that begin or end with each chunk."""
    edges = np.array([0, *(stop for _, stop in cuts(own))])
    after = np.searchsorted(edges, edges[:-1] + least_run)  # first edge that far behind
    ahead = np.flatnonzero(after < len(edges))
    before = np.searchsorted(edges, edges[1:] - least_run, side="right") - 1  # last edge that far in front
    back = np.flatnonzero(before >= 0)
    ends = [np.concatenate([ahead, before[back]]), np.concatenate([after[ahead], back + 1])]
    place = np.unique(ends[0] * len(edges) + ends[1])
    return list(zip(edges[place // len(edges)].tolist(), edges[place % len(edges)].tolist(), strict=True))


def named(parts: Callable[[np.ndarray], Iterable[tuple[int, int]]]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def name_parts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            place, size, digest, again, rows = [], [], [], [], [0]
            for flat, offsets in slices(texts):
                for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own, seen = flat[first:last], set()
                    data = own.tobytes()
                    for start, stop in parts(own):
                        name = blake2b(data[start:stop], digest_size=16).digest()
                        place.append(start)
                        size.append(stop - start)
                        digest.append(name)
                        again.append(name in seen)
                        seen.add(name)
                    rows.append(len(place))
            fields = [pa.array(place, pa.int32()), pa.array(size, pa.int32()), pa.array(digest, pa.binary()), pa.array(again, pa.bool_())]
            yield pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(ARROW_CHUNKS.value_type)))

    return name_parts


@F.arrow_udf(from_arrow_type(ARROW_CHUNKS))
def chunks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Position and size (in bytes) and digest of each chunk of each text, and whether the text had it before."""
    yield from named(cuts)(batches)


def chunk_runs(text: Column, least_run: int) -> Column:
    """The same of each run of chunks."""

    @F.arrow_udf(from_arrow_type(ARROW_CHUNKS))
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from named(lambda own: runs(own, least_run))(batches)

    return found(text)


def repeats(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", least_run: int = LEAST_RUN) -> DataFrame:
    """One row per document that repeats something: id, ``spans`` (start, stop in bytes; document of the first occurrence)."""
    short_batches(docs.sparkSession)
    listed = docs.where(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), F.inline(chunk_runs(F.col(text), least_run)))
    first = listed.groupBy("digest").agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max(F.col("again").cast("int")).alias("twice")
    ).where("first_id < last_id OR twice = 1").select("digest", "first_id")
    later = listed.join(first, "digest").where("again OR id > first_id")
    return joined(later.select("id", "pos", (F.col("pos") + F.col("size")).alias("stop"), "first_id"))


def joined(found: DataFrame) -> DataFrame:
    """(id, ``spans``): runs that meet or overlap as one span each, with the documents they come from.

    A span begins where no earlier run of the document reaches.
    """
    order = W.partitionBy("id").orderBy("pos", "stop")
    reach = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("pos") > reach), 1).otherwise(0)
    numbered_ = found.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = numbered_.groupBy("id", "span").agg(
        F.min("pos").alias("start"), F.max("stop").alias("stop"), F.array_sort(F.collect_set("first_id")).alias("sources")
    )
    return spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "sources"))).alias("spans"))


def without(text: Column, spans: Column) -> Column:
    """The text without the spans, which are in bytes and never split a character."""
    data = text.cast("binary")
    gaps = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda i: F.struct(
            F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["stop"]).alias("start"),
            F.when(i == F.size(spans), F.octet_length(data)).otherwise(F.get(spans, i)["start"]).alias("stop"),
        ),
    )
    parts = F.transform(gaps, lambda g: data.substr(g["start"] + 1, g["stop"] - g["start"]))
    return F.array_join(F.transform(parts, lambda p: F.decode(p, "UTF-8")), "")


def remove_repeats(docs: DataFrame, *, id_: str = "doc_id", text: str = "text", least_run: int = LEAST_RUN, spans: str | None = None) -> DataFrame:
    """All documents, repeated passages cut out of ``text``; ``spans`` names a column that tells what was cut."""
    own, cut_spans = unused(docs, "id", "spans")
    found = repeats(docs, id_=id_, text=text, least_run=least_run).select(F.col("id").alias(own), F.col("spans").alias(cut_spans))
    both = docs.join(small(stored(found, "spans")), F.col(id_) == F.col(own), "left")
    cut = F.when(F.col(cut_spans).isNull(), F.col(text)).otherwise(without(F.col(text), F.col(cut_spans)))
    out = both.withColumn(text, cut).drop(own)
    return out.drop(cut_spans) if spans is None else out.drop(spans).withColumnRenamed(cut_spans, spans)
