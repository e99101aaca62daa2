"""Hard negatives for contrastive training: exact integer scores by Strassen products of tiles.

Vectors are whole numbers (int64).  Some rows are anchors; a row's score for an anchor is their inner
product.  An anchor's positives are its best rows of the same label, and a positive's hard
negatives are the best rows of other labels whose score lies in a window below the
positive's: ``low * positive <= 100 * negative <= high * positive``.

1. Anchors are dealt by a digest of their id into blocks of at most about ``block_bytes``, whose number
   follows their count.  One block at a time is sent to all tasks; its size is measured first and
   it is dealt anew if it is larger.  All rows are scanned against each block.
2. A task cuts its rows into tiles and multiplies anchor tiles by candidate tiles with Strassen's seven
   products, recursively, on int64 tiles padded with zeros to even sizes.  Additions and products of
   integers are exact; sums inside the recursion may pass 2^63 and wrap, which leaves the product right,
   as it holds modulo 2^64 and is itself below 2^63 (checked when rows are prepared).
3. First scan: each task keeps the best positives of each anchor as a heap, merges every new tile's into it, and
   returns one heap per anchor; Spark merges the heaps of all tasks.  Second scan, with the
   positives found: the same with one heap per window.  A heap has a fixed number of places, so memory
   and shuffles follow the number of anchors of a block, not that of candidates.

Ranks: higher scores first, ties by smaller id.

Defined cases: rows without id, label or vector, or with a null, NaN or infinite component, take no
part; several rows of one id are one row, the least by (label, vector); shorter
vectors are filled with zeros; an anchor with fewer positives or negatives has those it has, and none gives
no row; an empty table gives an empty one; other columns are not read.  Vectors whose scores could
pass 2^63 stop the job with an error instead of giving wrong numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relweave.llm.store import stored
from relweave.session import scratch_path

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # per cent of the positive's score
BLOCK_BYTES = 16 << 20  # of anchors sent to every task at once
ANCHOR_TILE, CANDIDATE_TILE = 256, 1024
LEAF = 32  # tiles whose inner size is below this are multiplied plainly
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices, exact modulo 2^64; odd sizes are filled up with a row or column of zeros."""
    n, k = a.shape
    m = b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ np.asfortranarray(b)  # without a library for integers, columns that lie together are read fastest
    if n % 2 or k % 2 or m % 2:
        a = np.pad(a, ((0, n % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, m % 2)))
        return strassen(a, b, leaf)[:n, :m]
    i, j, l = n // 2, k // 2, m // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    out = np.empty((n, m), dtype=np.int64)
    c11, c12, c21, c22 = out[:i, :l], out[:i, l:], out[i:, :l], out[i:, l:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    c11[:], c22[:] = p, p
    p = strassen(a21 + a22, b11, leaf)
    c21[:] = p
    c22 -= p
    p = strassen(a11, b12 - b22, leaf)
    c12[:] = p
    c22 += p
    p = strassen(a22, b21 - b11, leaf)
    c11 += p
    c21 += p
    p = strassen(a11 + a12, b22, leaf)
    c11 -= p
    c12 += p
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    return out


def tile_best(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``places`` best allowed (score, id) of each row; columns are in order of id.  Empty places have score ``NONE``."""
    left = np.where(allowed, scores, NONE)
    rows = np.arange(len(left))
    best, who = np.full((len(left), places), NONE), np.zeros((len(left), places), dtype=np.int64)
    for k in range(min(places, left.shape[1])):
        at = left.argmax(axis=1)  # of equal scores the first, which has the smallest id
        best[:, k], who[:, k] = left[rows, at], ids[at]
        left[rows, at] = NONE
    return best, who


def merged(best: np.ndarray, who: np.ndarray, more: np.ndarray, whom: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two heaps of each row as one of the same size."""
    score, ids = np.concatenate([best, more], axis=1), np.concatenate([who, whom], axis=1)
    order = np.lexsort((ids, -score - 1))[:, : best.shape[1]]  # -score - 1 is the reverse order and never overflows
    return np.take_along_axis(score, order, axis=1), np.take_along_axis(ids, order, axis=1)


def _matrix(batch: pa.RecordBatch, column: int, dims: int) -> np.ndarray:
    lists = batch.column(column)
    ends = lists.offsets.to_numpy().astype(np.int64)
    sizes, values = np.diff(ends), lists.flatten().to_numpy()
    out = np.zeros((len(lists), dims), dtype=np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(values)) - np.repeat(ends[:-1] - ends[0], sizes)] = values
    return out


def _heaps(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, windows: np.ndarray | None, places: int, low: int, high: int):
    """For mapInArrow over (vec_id, label, vector): (anchor, window, score, id), the heaps of one task."""
    kinds = 1 if windows is None else windows.shape[1]
    dims = vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.full((len(ids), places), NONE) for _ in range(kinds)]
        who = [np.zeros((len(ids), places), dtype=np.int64) for _ in range(kinds)]
        for batch in batches:
            own, label = (batch.column(i).to_numpy() for i in (0, 1))
            order = np.argsort(own, kind="stable")
            own, label = own[order], label[order]
            rows = _matrix(batch, 2, dims)[order]
            for c in range(0, len(own), CANDIDATE_TILE):
                tile = np.ascontiguousarray(rows[c: c + CANDIDATE_TILE].T)
                cid, clabel = own[c: c + CANDIDATE_TILE], label[c: c + CANDIDATE_TILE]
                for a in range(0, len(ids), ANCHOR_TILE):
                    part = slice(a, a + ANCHOR_TILE)
                    scores = strassen(vectors[part], tile)
                    same = labels[part, None] == clabel
                    if windows is None:
                        found = [tile_best(scores, same & (ids[part, None] != cid), cid, places)]
                    else:
                        found = []
                        for k in range(kinds):
                            floor, ceiling = windows[part, k, 0, None], windows[part, k, 1, None]
                            found.append(tile_best(scores, ~same & (scores >= floor) & (scores <= ceiling), cid, places))
                    for k, (more, whom) in enumerate(found):
                        best[k][part], who[k][part] = merged(best[k][part], who[k][part], more, whom)
        for k in range(kinds):
            row, place = np.nonzero(best[k] != NONE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row]), pa.array(np.full(len(row), k, dtype=np.int32)), pa.array(best[k][row, place]), pa.array(who[k][row, place])],
                ["anchor_id", "window", "score", "id"],
            )

    return run


def whole_vectors(rows: DataFrame, *, id_: str, label: str, vector: str, scale: float) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part; components become ``floor(scale * x)``, one row to an id."""
    x = F.col(vector)
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    clean = rows.where(F.col(id_).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & ~odd).select(
        F.col(id_).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"),
        F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double"))).alias("vector"),
    )
    if rows.where(F.col(id_).isNotNull()).groupBy(id_).count().where("count > 1").isEmpty():
        return clean
    return clean.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector")


def _first(rows: DataFrame, keys: list[str], places: int) -> DataFrame:
    """Heaps of all tasks merged: the ``places`` best of each key with their rank; tasks drop what cannot be among them first."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= places)


def _block(table, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
    parts = [_matrix(b, 2, dims) for b in table.to_batches()]
    return ids, labels, np.concatenate(parts) if parts else np.zeros((0, dims), dtype=np.int64)


def hard_negatives(
    rows: DataFrame, anchor: Column, *, id_: str = "vec_id", label: str = "label", vector: str = "embedding", scale: float = 256.0,
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``anchor`` is a condition on column ``vec_id``."""
    spark = rows.sparkSession
    known = stored(whole_vectors(rows, id_=id_, label=label, vector=vector, scale=scale), "vectors")
    norm = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    anchors = known.where(anchor)
    dims, longest = known.agg(F.max(F.size("vector")), F.max(norm)).first()
    if longest is not None and longest >= 2.0**62:
        raise ValueError(f"scores up to {longest:g} do not fit 64 bits")
    dims = max(dims or 0, 1)
    count = anchors.count()
    blocks = max(1, math.ceil(count * 8 * (dims + 2) / (0.8 * block_bytes)))
    out = scratch_path(spark, "negatives")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], schema).write.parquet(out)
    while count:
        number = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
        most = anchors.groupBy(number.alias("b")).count().agg(F.max("count")).first()[0]
        if blocks == 1 or most * 8 * (dims + 2) <= block_bytes:
            break
        blocks *= 2
    for b in range(blocks if count else 0):
        ids, labels, vectors = _block(anchors.where(number == b).select("vec_id", "label", "vector").toArrow(), dims)
        if len(ids):
            _mine(spark, known, ids, labels, vectors, positives, negatives, low, high).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def _mine(spark: SparkSession, known: DataFrame, ids, labels, vectors, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result for one block of anchors."""
    kind = "anchor_id bigint, window int, score bigint, id bigint"
    heaps = known.mapInArrow(_heaps(ids, labels, vectors, None, positives, low, high), kind)
    found = stored(_first(heaps, ["anchor_id"], positives).select("anchor_id", (F.col("rank") - 1).alias("window"), "score", "id"), "positives")
    table = found.toArrow()  # at most ``positives`` rows for each anchor of the block
    at, k, score = (table.column(c).to_numpy() for c in ("anchor_id", "window", "score"))
    order = np.argsort(ids)
    windows = np.zeros((len(ids), positives, 2), dtype=np.int64)
    windows[:, :, 0], windows[:, :, 1] = 1, 0  # nothing fits an empty window
    place = order[np.searchsorted(ids[order], at)]
    # low * positive <= 100 * negative <= high * positive, as whole bounds of the negative
    windows[place, k, 0] = [-((-low * int(s)) // 100) for s in score]
    windows[place, k, 1] = [high * int(s) // 100 for s in score]
    heaps = known.mapInArrow(_heaps(ids, labels, vectors, windows, negatives, low, high), kind)
    best = _first(heaps, ["anchor_id", "window"], negatives).select("anchor_id", "window", "rank", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
    named = found.select("anchor_id", "window", F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    return named.join(best, ["anchor_id", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
