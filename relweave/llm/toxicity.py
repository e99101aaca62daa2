"""Toxic sentences by multiple-instance learning: a document is a bag of sentences joined by noisy-or.

Only documents are labelled.  A sentence ``s`` is toxic with probability
``p(s) = 1 / (1 + exp(-z))``, where ``z`` is a bias plus the weights of its known
features: lower-cased words, their first 3 to 5 bytes, and every 5 bytes inside them.  The
document is toxic unless every sentence is clean and a small leak, one more instance
of every document, stays silent: ``P = 1 - (1 - leak) * prod(1 - p(s))``.

Learning
1. A sample of about ``sample`` labelled documents of each class at most, chosen by a digest of
   the id, each weighted by the share of its class that was taken.
2. Features found in ``LEAST_DOCS`` sampled documents or more, and in class 1 ``LEAST_GAIN`` deviations
   more or less often than chance, are the model's, ``features`` of them at most, those that depend
   most on the label; counts are summed in tasks first and by Spark after that.
3. ``STEPS`` steps of gradient descent on the noisy-or log likelihood.  Each is one Spark job over the
   stored sample: tasks return sums of fixed size, one row for each of at most ``PARTS`` partitions.  A
   document of class 1 gives each sentence a share of its label in proportion to that
   sentence's part in it, so weight gathers on the sentences that explain the label.

Scoring is one pass over whole texts with the model sent to every task; its size is bound by
``features``.  The result holds the document's score and the offending sentences: byte spans
of those with p(s) >= ``bar``, with their own scores.

Sentences end after . ! ? or their wide forms, and at line ends; a text without any is one
sentence of any length.

Defined cases: null, empty and wordless texts have the leak's score and no sentence; rows
without id are scored, not learned from; repeated rows get equal scores and count each; with no labelled
row, or one class only, there are no features and the score is the labels' rate; an empty table
gives an empty one; other columns pass through, and the result is one struct column whose name must be
free (ValueError otherwise).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from relweave.llm.store import short_batches, stored
from relweave.llm.words import ALNUM, Words, mix, numbered, word_slices

SAMPLE = 10_000  # labelled documents of each class
FEATURES = 1 << 15
LEAST_DOCS, LEAST_GAIN = 3, 5.0  # documents that hold a feature; deviations of its count in class 1 from chance
STEPS, RATE, SHRINK = 40, 0.4, 1e-5
PARTS = 16
BAR = 0.5
_STARTS, _INNER = (3, 4, 5), 5  # bytes
_SALTS = numbered(8, seed=17)
ARROW_RESULT = pa.struct([
    ("score", pa.float64()), ("n_sentences", pa.int64()),
    ("sentences", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))),
])


@dataclass(frozen=True)
class Model:
    """Sorted feature hashes with their weights; ``bias`` of a sentence, ``leak`` (a logit) of a document."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    leak: float


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features of all words, and the word each belongs to."""
    sums = words.prefix_sums()
    size = words.ends - words.starts
    every = np.arange(len(size))
    value, owner = [words.spans(sums, words.starts, words.ends) ^ _SALTS[0]], [every]
    for k, n in enumerate(_STARTS, start=1):
        has = np.flatnonzero(size >= n)
        value.append(words.spans(sums, words.starts[has], words.starts[has] + n) ^ _SALTS[k])
        owner.append(has)
    more = np.maximum(size - _INNER, 0)  # places after the first, which the starts hold
    inner = np.repeat(every, more)
    place = words.starts[inner] + 1 + np.arange(len(inner)) - np.repeat(np.cumsum(more) - more, more)
    value.append(words.spans(sums, place, place + _INNER) ^ _SALTS[-1])
    owner.append(inner)
    return mix(np.concatenate(value)), np.concatenate(owner)


def sentence_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The sentence of each word, numbered over all rows from 0 without gaps, and each sentence's row."""
    flat = words.flat
    stops = np.isin(flat, np.frombuffer(b".!?\n", dtype=np.uint8))
    for mark in ("。", "！", "？"):
        a, b, c = mark.encode()
        if len(flat) > 2:
            stops[2:] |= (flat[:-2] == a) & (flat[1:-1] == b) & (flat[2:] == c)
    passed = np.cumsum(stops)[words.starts] if len(words.starts) else np.zeros(0, dtype=np.int64)
    row = words.row_of()
    new = np.ones(len(row), dtype=bool)
    new[1:] = (passed[1:] != passed[:-1]) | (row[1:] != row[:-1])
    return np.cumsum(new) - 1, row[new]


def spread(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each logit, and the log of one over its complement."""
    return 0.5 * (1 + np.tanh(0.5 * z)), np.logaddexp(0.0, z)


class _Known:
    """Looks up feature hashes; a bit table turns most unknown ones away first."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.low = keys, np.uint64((1 << 21) - 1)
        self.table = np.zeros(1 << 21, dtype=bool)
        self.table[keys & self.low] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that are known, and their feature numbers."""
        some = np.flatnonzero(self.table[hashes & self.low])
        if not len(some) or not len(self.keys):
            return some[:0], some[:0]
        at = np.minimum(np.searchsorted(self.keys, hashes[some]), len(self.keys) - 1)
        same = self.keys[at] == hashes[some]
        return some[same], at[same]


def _sampled(docs: DataFrame, labels: DataFrame, text: str, label: str, id_: str, sample: int) -> DataFrame:
    """(text, y, weight): at most about ``sample`` documents of each class.  Only their ids and labels are sent to tasks."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(id_).isNotNull()).select(
        F.col(id_).alias("id"), F.col(label).cast("int").alias("y"), F.xxhash64(F.col(id_)).alias("h"),
    )
    count = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {y: min(1.0, sample / n) for y, n in count.items()}
    keep = F.lit(False)
    for y, s in share.items():
        limit = (1 << 63) - 1 if s >= 1 else int((2 * s - 1) * (1 << 63))
        keep = keep | ((F.col("y") == y) & (F.col("h") <= F.lit(limit).cast("bigint")))
    weight = F.when(F.col("y") == 1, 1 / share.get(1, 1.0)).otherwise(1 / share.get(0, 1.0))
    chosen = rows.where(keep).select("id", "y", weight.cast("double").alias("weight"))
    texts = docs.select(F.col(id_).alias("id"), F.col(text).alias("text"))
    return texts.join(F.broadcast(chosen), "id").select("text", "y", "weight")


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, documents, documents of class 1), summed over a slice of texts."""
    for batch in batches:
        y, done = batch.column(1).to_numpy(zero_copy_only=False), 0
        for words in word_slices(batch.column(0), ALNUM):
            hashes, owner = features(words)
            n = len(words.rows) - 1
            row = words.row_of()[owner]
            order = np.lexsort((row, hashes))
            hashes, row = hashes[order], row[order]
            new = np.ones(len(hashes), dtype=bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
            hashes, ones = hashes[new], y[done: done + n][row[new]].astype(np.int64)
            done += n
            first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, dtype=np.int64)
            counts = np.diff(np.r_[first, len(hashes)])
            pos = np.add.reduceat(ones, first) if len(first) else first
            yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(counts), pa.array(pos)], ["feature", "n", "pos"])


def _bags(keys: np.ndarray):
    """For mapInArrow: (y, weight, sentences, features, ends): known features of each sentence that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(keys)
        for batch in batches:
            done = 0
            for words in word_slices(batch.column(0), ALNUM):
                n = len(words.rows) - 1
                sentence, row_of = sentence_of(words)
                hashes, owner = features(words)
                place, feature = known.find(hashes)
                at = sentence[owner[place]]
                order = np.argsort(at, kind="stable")
                at, feature = at[order], feature[order]
                used, first = np.unique(at, return_index=True)
                stop = np.r_[first[1:], len(at)] if len(used) else first
                rows = row_of[used]
                per_row = np.searchsorted(rows, np.arange(n + 1))
                edge = np.r_[first, len(at)][per_row] if len(used) else np.zeros(n + 1, dtype=np.int64)
                ends = stop - edge[rows] if len(used) else stop
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).slice(done, n), batch.column(2).slice(done, n), pa.array(np.bincount(row_of, minlength=n)),
                    pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(feature.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(per_row.astype(np.int32)), pa.array(ends.astype(np.int32))),
                ], ["y", "weight", "sentences", "features", "ends"])
                done += n

    return run


def bag_gradient(y, weight, sentences, feature, feature_rows, ends, end_rows, w, bias, leak) -> np.ndarray:
    """Gradient of the weighted log likelihood for each weight, bias and leak; then curvatures of the same; then the loss."""
    k = len(w)
    size = np.diff(end_rows)
    row = np.repeat(np.arange(len(y)), size)
    stop = ends + feature_rows[row]
    first = np.r_[0, stop[:-1]] if len(stop) else stop
    z = np.add.reduceat(w[feature], first) + bias if len(stop) else np.zeros(0)
    p, q = spread(z)
    p0, q0 = spread(np.array([bias]))
    pl, ql = spread(np.array([leak]))
    plain = sentences - size
    silent = np.bincount(row, weights=q, minlength=len(y)) + plain * q0 + ql
    heard = np.maximum(-np.expm1(-silent), 1e-12)
    blame = weight * np.where(y == 1, 1 - 1 / heard, 1.0)  # times p(s): the slope of the loss in z(s)
    bend = weight * np.where(y == 1, 1 / heard, 1.0)
    out = np.zeros(2 * (k + 2) + 1)
    own, turn = blame[row] * p, bend[row] * p
    length = stop - first
    out[:k] = np.bincount(feature, weights=np.repeat(own, length), minlength=k)
    out[k + 2: 2 * k + 2] = np.bincount(feature, weights=np.repeat(turn, length), minlength=k)
    out[k], out[k + 1] = own.sum() + (blame * plain * p0).sum(), (blame * pl).sum()
    out[2 * k + 2], out[2 * k + 3] = turn.sum() + (bend * plain * p0).sum(), (bend * pl).sum()
    out[-1] = (weight * np.where(y == 1, -np.log(heard), silent)).sum()
    return out


def _gradients(w: np.ndarray, bias: float, leak: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * (len(w) + 2) + 1)
        for b in batches:
            y, weight, sentences = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            f, e = b.column(3), b.column(4)
            rows, edges = f.offsets.to_numpy().astype(np.int64), e.offsets.to_numpy().astype(np.int64)
            total += bag_gradient(y, weight, sentences, f.flatten().to_numpy(), rows - rows[0], e.flatten().to_numpy().astype(np.int64), edges - edges[0], w, bias, leak)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], type=pa.binary())], ["sums"])

    return run


def learn(
    docs: DataFrame, labels: DataFrame, *, text: str = "text", label: str = "toxic", id_: str = "doc_id", sample: int = SAMPLE,
    features: int = FEATURES, steps: int = STEPS,
) -> Model:
    """Fit the model to ``docs`` (id, text) and ``labels`` (id, label); a label is 0 or 1, other values take no part."""
    short_batches(docs.sparkSession)
    rows = stored(_sampled(docs, labels, text, label, id_, sample), "toxic-sample")
    count = {r["y"]: (r["n"], r["w"]) for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()}
    (neg, neg_w), (pos, pos_w) = count.get(0, (0, 0.0)), count.get(1, (0, 0.0))
    rate = (pos_w + 0.5) / (neg_w + pos_w + 1)
    leak = float(np.log(rate / (1 - rate)))
    if not neg or not pos:
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), -30.0, leak)
    counts = rows.mapInArrow(_feature_counts, "feature bigint, n bigint, pos bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    share = pos / (neg + pos)
    gain = F.abs(F.col("pos") - share * F.col("n")) / F.sqrt(F.col("n") * (share * (1 - share)) + 1.0)
    best = counts.where((F.col("n") >= LEAST_DOCS) & (gain >= LEAST_GAIN)).orderBy(gain.desc(), "feature").limit(features).select("feature")
    keys = np.sort(best.toArrow().column(0).to_numpy().view(np.uint64))
    bags = rows.mapInArrow(_bags(keys), "y int, weight double, sentences bigint, features array<int>, ends array<int>")
    bags = stored(bags.coalesce(PARTS), "toxic-bags").coalesce(PARTS)
    w, first, second = np.zeros(len(keys) + 2), np.zeros(len(keys) + 2), np.zeros(len(keys) + 2)
    w[-2], w[-1] = -4.0, leak - 2.0
    total = neg_w + pos_w
    for step in range(1, steps + 1):
        sums = bags.mapInArrow(_gradients(w[:-2], float(w[-2]), float(w[-1])), "sums binary").collect()
        g = sum(np.frombuffer(r["sums"]) for r in sums)[: len(w)] / total
        g[:-2] += SHRINK * w[:-2]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w = w - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return Model(keys, w[:-2], float(w[-2]), float(w[-1]))


def _score(words: Words, known: _Known, model: Model, bar: float) -> pa.Array:
    n = len(words.rows) - 1
    sentence, row_of = sentence_of(words)
    hashes, owner = features(words)
    place, feature = known.find(hashes)
    z = np.bincount(sentence[owner[place]], weights=model.weights[feature], minlength=len(row_of)) + model.bias
    p, q = spread(z)
    silent = np.bincount(row_of, weights=q, minlength=n) + np.logaddexp(0.0, model.leak)
    score = np.clip(-np.expm1(-silent), 0.0, 1.0)
    bad = np.flatnonzero(p >= bar)
    first = np.searchsorted(sentence, bad)
    last = np.searchsorted(sentence, bad, side="right") - 1
    base = words.offsets[row_of[bad]]
    spans = pa.StructArray.from_arrays(
        [pa.array(words.starts[first] - base), pa.array(words.ends[last] - base), pa.array(p[bad])], fields=list(ARROW_RESULT.field("sentences").type.value_type),
    )
    edges = np.searchsorted(row_of[bad], np.arange(n + 1)).astype(np.int32)
    return pa.StructArray.from_arrays(
        [pa.array(score), pa.array(np.bincount(row_of, minlength=n)), pa.ListArray.from_arrays(pa.array(edges), spans)], fields=list(ARROW_RESULT),
    )


def score_texts(docs: DataFrame, model: Model, *, text: str = "text", result: str = "toxicity", bar: float = BAR) -> DataFrame:
    """Adds a struct: ``score``, ``n_sentences`` and the offending ``sentences`` (start and stop in UTF-8 bytes, score)."""
    if result in docs.columns:
        raise ValueError(f"column {result} exists")
    short_batches(docs.sparkSession)

    @F.arrow_udf(from_arrow_type(ARROW_RESULT))
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _Known(model.keys)
        for texts in batches:
            parts = [_score(words, known, model, bar) for words in word_slices(texts, ALNUM)]
            yield pa.concat_arrays(parts) if parts else pa.array([], type=ARROW_RESULT)

    return docs.withColumn(result, scored(F.col(text)))


def offending_sentences(scored: DataFrame, *, text: str = "text", result: str = "toxicity") -> DataFrame:
    """One row for each offending sentence: all columns of the document, ``sentence`` and ``sentence_score``."""
    spans = scored.withColumn("sentence_at", F.explode(F.col(f"{result}.sentences")))
    whole = F.encode(F.col(text), "UTF-8")
    part = F.substring(whole, (F.col("sentence_at.start") + 1).cast("int"), (F.col("sentence_at.stop") - F.col("sentence_at.start")).cast("int"))
    return spans.withColumn("sentence", F.decode(part, "UTF-8")).withColumn("sentence_score", F.col("sentence_at.score")).drop("sentence_at")
