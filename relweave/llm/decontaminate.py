"""Benchmark decontamination: a broadcast hash set of normalised test word windows.

Benchmark texts are cut into windows of ``width`` words (a shorter text is one
window).  Each document is scanned once: every run of words whose hash is in the set is
compared with the window's own words, then its words count as hit.

The set is broadcast in blocks of at most ``block_bytes`` of window text, measured
before.  A benchmark beyond that bound takes several blocks, each scanned in turn; the
documents are never shuffled.

Defined cases: a null or wordless text has no words and no hits; a null or wordless
item, and an item without id, has no windows; repeated items count once; repeated
documents are marked alike; other columns pass through, and an input column named like
the mark is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from relweave.llm.store import short_batches
from relweave.llm.words import ALNUM, lower_ascii, run_starts, runs, word_array, word_slices

WIDTH = 10
BLOCK_BYTES = 8 << 20


def windows(benchmark: DataFrame, *, item: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per distinct window: its words joined by a space, their number, the items it is in."""
    found = benchmark.where(F.col(item).isNotNull()).select(
        F.col(item).cast("bigint").alias("item"), word_array(lower_ascii(F.col(text)), ALNUM).alias("words")
    ).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - width, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("words", i + 1, width), " "))
    return (
        found.select("item", F.explode(cut).alias("window"), F.least(F.size("words"), F.lit(width)).alias("width"))
        .groupBy("window", "width").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )


def blocks_of(found: DataFrame, block_bytes: int) -> Iterator[list[tuple[bytes, int, list[int]]]]:
    """The windows on the driver, in blocks of about ``block_bytes`` at most."""
    size = F.octet_length("window") + 8 * F.size("items") + 64
    total = found.agg(F.sum(size)).first()[0] or 0
    count = max(1, -(-int(total * 1.25) // block_bytes)) if total > block_bytes else 1
    for k in range(count):
        block = found.where(F.pmod(F.xxhash64("window"), F.lit(count)) == k) if count > 1 else found
        yield [(r.window.encode(), r.width, list(r["items"])) for r in block.collect()]


class WindowSet:
    """Windows by hash, for membership tests over whole arrays."""

    def __init__(self, rows: list[tuple[bytes, int, list[int]]]) -> None:
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.found: dict[tuple[int, bytes], list[int]] = {(w, text): items for text, w, items in rows}
        for width in sorted({w for _, w, _ in rows}):
            texts = pa.array([text.decode() for text, w, _ in rows if w == width])
            hashes = np.concatenate([runs_of_rows(s, width) for s in word_slices(texts, ALNUM)])
            some = np.zeros(1 << 20, dtype=bool)
            some[hashes & np.uint64((1 << 20) - 1)] = True
            self.by_width[width] = np.sort(hashes), some

    def hits(self, words) -> Iterator[tuple[int, int, list[int]]]:
        """(first word, width, items) of every occurrence, compared word by word."""
        hashes = words.hashes()
        for width, (known, some) in self.by_width.items():
            starts = run_starts(words.rows, width)
            seen = runs(hashes, width)[starts]
            maybe = np.flatnonzero(some[seen & np.uint64((1 << 20) - 1)])
            maybe = maybe[np.isin(seen[maybe], known)]
            for i in starts[maybe].tolist():
                items = self.found.get((width, b" ".join(words.text(j) for j in range(i, i + width))))
                if items is not None:
                    yield i, width, items


def runs_of_rows(words, width: int) -> np.ndarray:
    return runs(words.hashes(), width)[run_starts(words.rows, width)]


def scanner(rows: list[tuple[bytes, int, list[int]]], spark) -> Column:
    held = spark.sparkContext.broadcast(rows)

    @F.arrow_udf(from_arrow_type(ARROW_MARK))
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = WindowSet(held.value)
        for texts in batches:
            yield pa.array([m for s in word_slices(texts, ALNUM) for m in marks(s, known)], type=ARROW_MARK)

    return scan


ARROW_MARK = pa.struct([
    ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
    ("items", pa.list_(pa.int64())),
])


def marks(words, known: WindowSet) -> list[dict]:
    counts = np.diff(words.rows)
    out = [{"n_words": int(n), "hits": [], "items": []} for n in counts]
    found: dict[int, tuple[list, set]] = {}
    hits = list(known.hits(words))
    owner = np.searchsorted(words.rows, np.array([i for i, _, _ in hits], dtype=np.int64), side="right") - 1
    for row, (i, width, items) in zip(owner.tolist(), hits, strict=True):
        spans, ids = found.setdefault(row, ([], set()))
        spans.append((i - int(words.rows[row]), width))
        ids.update(items)
    for row, (spans, ids) in found.items():
        out[row]["items"] = sorted(ids)
        out[row]["hits"] = merged(spans)
    return out


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    """Disjoint, ascending [start, stop) ranges of words."""
    joined: list[dict] = []
    for start, width in sorted(spans):
        if joined and start <= joined[-1]["stop"]:
            joined[-1]["stop"] = max(joined[-1]["stop"], start + width)
        else:
            joined.append({"start": start, "stop": start + width})
    return joined


def mark_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text",
    width: int = WIDTH, mark: str = "contamination", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``mark``: number of words, hit word ranges, ids of the items found."""
    spark = docs.sparkSession
    short_batches(spark)
    found = windows(benchmark, item=item, text=item_text, width=width)
    parts: list[Column] = [scanner(rows, spark)(F.col(text)) for rows in blocks_of(found, block_bytes)]
    names = [f"__mark{k}" for k in range(len(parts))]
    marked = docs.withColumns(dict(zip(names, parts, strict=True)))
    if len(names) == 1:
        return marked.drop(mark).withColumnRenamed(names[0], mark) if mark in docs.columns else marked.withColumnRenamed(names[0], mark)
    hits = F.flatten(F.array(*[F.col(n)["hits"] for n in names]))
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(n)["items"] for n in names]))))
    whole = F.struct(F.col(names[0])["n_words"].alias("n_words"), union_of_ranges(hits).alias("hits"), items.alias("items"))
    return marked.withColumn(mark, whole).drop(*names)


def union_of_ranges(ranges: Column) -> Column:
    """Disjoint ranges from ranges that may overlap, by Spark's own functions."""
    kind = "array<struct<start:int,stop:int>>"

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        return F.when(F.size(done) == 0, F.array(x)).when(
            x["start"] <= last["stop"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))
        ).otherwise(F.concat(done, F.array(x))).cast(kind)

    return F.aggregate(F.array_sort(ranges), F.array().cast(kind), add)


def n_hit(mark: Column) -> Column:
    return F.aggregate(mark["hits"], F.lit(0).cast("bigint"), lambda n, x: n + (x["stop"] - x["start"]))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, text: str = "text") -> DataFrame:
    """Documents without any benchmark window."""
    marked = mark_contamination(docs, benchmark, text=text, width=width, mark="__contamination")
    return marked.where(F.size(F.col("__contamination")["hits"]) == 0).select(*docs.columns)


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, text: str = "text") -> DataFrame:
    """All documents; a hit one keeps only its other words, normalised and joined by a space."""
    marked = mark_contamination(docs, benchmark, text=text, width=width, mark="__contamination")
    words = word_array(lower_ascii(F.col(text)), ALNUM)
    hits = F.col("__contamination")["hits"]
    kept = F.filter(words, lambda w, i: ~F.exists(hits, lambda h: (h["start"] <= i) & (i < h["stop"])))
    new = F.when(F.size(hits) == 0, F.col(text)).otherwise(F.array_join(kept, " "))
    return marked.withColumn(text, new).select(*docs.columns)
