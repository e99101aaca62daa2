"""Text scores from an online logistic mix of hashed-context bit predictors, next to a unigram base.

Bits: a byte is coded by the Huffman tree of the training bytes, so a common byte takes few
binary decisions.  Predictors: for each of three contexts (the byte before; a hash of the
three bytes before; a hash of the word so far and its place) and each tree node, the log
odds of the decision in training.  Counts are gathered per context and byte, which gives
every node's counts by addition.  Mixing: the log odds are combined by weights, one set
for each gate (whether the long context was seen often), and squashed to a probability.
Refining: each text starts with weights learned on all training texts; after every
block of a text, short ones first, they move along that block's prediction error, so they
follow the text.

Last stage: a word with the white space behind it is spelled by these bits, or taken whole from the
words met before in its text, or from the training vocabulary; its probability is the sum of the three.
Spelling weighs as much as unseen words are to be expected (the share of training words
seen once), the text's own words the more the longer it is.  A word taken whole is its frequency in lower case without
the mark behind it (one of ``MARKS``), times the frequencies of its capitals after the byte before, of its mark and of its white space.
The score is the log10 probability of the UTF-8 text by this mix.

The vocabulary grows with the corpus, for the base and for the mix: the ``HEAD`` most frequent
tokens are broadcast, every other token is joined by a shuffle, so no hot token of the training texts is
shuffled.  The context tables that spell unseen words have a fixed size (``SLOTS``) and are broadcast.
The start weights are learned by a pass of their own over every training text.

Defined cases: a null text is empty: one end token, no bits, score 0; without training
documents every token is unseen and every bit has probability 1/2; repeated rows score
alike; a null id counts as the empty text for the split; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from relweave.llm.store import stored
from relweave.llm.words import CLASSES, SPACED, Words, find, mix, numbered, slices

SLOTS = (256, 1 << 14, 1 << 15)  # contexts of each predictor
FIRST = np.concatenate([[0], np.cumsum(SLOTS)]).astype(np.int64)
BLOCK, RATE = 1024, 1.5
SHORTEST, LONGEST = 32, 1024  # bytes of a text between two moves of its weights
START = np.array([[0.5, 0.3, 0.4], [0.15, 0.6, 0.4]], dtype=np.float32)  # weights of each gate
GRAIN = 0.1  # step of the stored log odds
OFTEN = 32  # sightings from which a long context opens the second gate
HEAD = 200_000
LEAST_SPELLED = 1e-3  # least weight of the spelling of a word
OWN, OWN_AFTER = 0.3, 50  # weight of a long text's own words, and the words after which it is half that
MARKS = ".,;:!?"
MORE = 256 * 3 + 256  # words by the byte before and their shape, words by their mark
END = np.uint64(0x45E1D0F7EE7)  # stands for the end token
COUNT_SLICE, SCORE_SLICE = 1 << 18, 1 << 17
_SPACE = ~CLASSES[SPACED]
_MARK = np.isin(np.arange(256), list(MARKS.encode()))
_WORD_VALUES = numbered(256, seed=31)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
ARROW_SCORE = pa.struct([
    ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("head_sum", pa.float64()), ("score", pa.float64()),
    ("tail", pa.list_(pa.struct([("token", pa.int64()), ("base", pa.bool_()), ("else", pa.float32()), ("shape", pa.float32())]))),
])


def keep_freed_memory() -> None:
    """Have the allocator keep the arrays of one slice for the next, up to about 60 MB a worker.

    It takes the size of the largest block freed so far as a measure; this one is never touched.
    Otherwise each array's pages go back and are faulted in again, half the time of a slice.
    """
    np.empty(31 << 20, dtype=np.uint8)


# --- words ------------------------------------------------------------------------
def parts(words: Words, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: shape, the byte before the white space before it, and its mark (0 for none).

    Shapes: 0 for a word without capitals, 1 for one with a single capital in front, 2 for any other.
    """
    capital = (text >= 65) & (text <= 90)
    count = np.concatenate([[0], np.cumsum(capital)])
    many = count[words.ends] - count[words.starts]
    shape = np.where(many == 0, 0, np.where((many == 1) & capital[words.starts], 1, 2))
    last = text[words.ends - 1]
    before = np.full(len(last), 32, dtype=np.uint8)
    before[1:] = last[:-1]
    before[words.rows[:-1][np.diff(words.rows) > 0]] = 32
    mark = np.where(_MARK[last] & (words.ends - words.starts > 1), last, 0).astype(np.int64)
    return shape, before, mark


def hashes(words: Words, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word as a token of the base, and without its mark."""
    sums, marked = words.prefix_sums(), mark > 0
    core = mix(words.spans(sums, words.starts, words.ends - marked))
    token = core.copy()
    token[marked] = mix(words.spans(sums, words.starts[marked], words.ends[marked]))
    return token, core


def met_before(row: np.ndarray, word: np.ndarray) -> np.ndarray:
    """How often each word, given by its number, stands earlier in its row."""
    place, bits = np.arange(len(row)), len(row).bit_length()
    both = (row * (word.max(initial=0) + 1) + word) << bits | place  # numbers sort faster than their places
    both.sort()
    order = both & ((1 << bits) - 1)
    both >>= bits
    new = np.ones(len(row), dtype=bool)
    new[1:] = both[1:] != both[:-1]
    out = np.empty(len(row), dtype=np.int64)
    out[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return out


# --- contexts ---------------------------------------------------------------------
def contexts(flat: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each byte the number of its context in each predictor; texts begin after spaces."""
    n = len(flat)
    sizes = np.diff(offsets)
    heads, sizes = offsets[:-1][sizes > 0], sizes[sizes > 0]
    framed = np.full(n + 3, 32, dtype=np.uint8)
    framed[3:] = flat
    wide = framed.astype(np.uint32)
    long = wide[2:-1] | wide[1:-2] << np.uint32(8) | wide[:-3] << np.uint32(16)
    for k in range(3):  # what stands before a text is another one
        at = heads[sizes > k] + k
        bytes_ = [wide[at + 3 - i] if i <= k else np.uint32(32) for i in (1, 2, 3)]
        long[at] = bytes_[0] | bytes_[1] << np.uint32(8) | bytes_[2] << np.uint32(16)

    def slot(h: np.ndarray, k: int) -> np.ndarray:  # sizes are powers of two
        h *= np.uint64(0x9E3779B97F4A7C15)
        h >>= np.uint64(65 - SLOTS[k].bit_length())
        h += np.uint64(FIRST[k])
        return h.view(np.int64)

    # the word so far: values of its bytes by place, summed since the last space
    begin = np.zeros(n, dtype=bool)
    begin[1:] = _SPACE.take(framed[3:-1])
    begin[heads] = True
    start = np.flatnonzero(begin)
    length = np.diff(np.append(start, n))
    place = np.arange(n, dtype=np.uint64)
    place -= np.repeat(start.astype(np.uint64), length)
    sums = np.zeros(n + 1, dtype=np.uint64)
    value = place << np.uint64(1)
    value |= np.uint64(1)
    value *= _WORD_VALUES.take(flat)
    np.cumsum(value, out=sums[1:])
    place += sums[:-1]
    place -= np.repeat(sums[start], length)
    return [(long & np.uint32(255)).astype(np.int64), slot(long.astype(np.uint64), 1), slot(place, 2)]


def count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(context * 256 + byte, sightings) of a partition's training texts; words by shape and mark follow the last context."""
    keep_freed_memory()
    total = np.zeros(int(FIRST[-1]) * 256 + MORE, dtype=np.int32)
    for batch in batches:
        for flat, offsets in slices(batch.column(0), COUNT_SLICE):
            if not len(flat):
                continue
            first, *others = contexts(flat, offsets)
            total[: 1 << 16] += np.bincount(first * 256 + flat, minlength=1 << 16)
            for own in others:
                key = own.astype(np.int32)
                key <<= 8
                key |= flat
                key.sort()  # near places one after the other
                at = np.flatnonzero(key[1:] != key[:-1])
                total[key[np.append(at, len(key) - 1)]] += np.diff(at, prepend=-1, append=len(key) - 1)
            shape, before, mark = parts(find(flat, offsets, CLASSES[SPACED]), flat)
            total[-MORE:] += np.bincount(before.astype(np.int64) * 3 + shape, minlength=MORE) + np.bincount(mark + 768, minlength=MORE)
    key = np.flatnonzero(total)
    for first in range(0, len(key), 1 << 18):
        some = key[first: first + (1 << 18)]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some].astype(np.int64))], names=["key", "n"])


# --- the model --------------------------------------------------------------------
def huffman(weights: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Depth of each byte's leaf and its path of (node, bit); ties go to the lower number."""
    heap = [(int(w) + 1, b, [b]) for b, w in enumerate(weights)]
    heapq.heapify(heap)
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    for node in range(255):
        (w0, k0, left), (w1, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        for bit, leaves in ((0, left), (1, right)):
            for b in leaves:
                paths[b].append((node, bit))
        heapq.heappush(heap, (w0 + w1, k0, left + right))
    paths = [p[::-1] for p in paths]
    return np.array([len(p) for p in paths]), paths


def build(keys: np.ndarray, counts: np.ndarray) -> dict:
    """Node log odds for each context, gates, and the code, as plain arrays for broadcast."""
    seen = np.zeros(int(FIRST[-1]) * 256 + MORE, dtype=np.float32)
    seen[keys] = counts
    shape, mark = seen[-MORE:-256].reshape(256, 3).astype(np.float64) + 1, seen[-256:] + np.append(1, _MARK[1:])
    seen = seen[:-MORE].reshape(-1, 256)
    often = seen[: SLOTS[0]].astype(np.float64).sum(axis=0)
    depth, paths = huffman(often)
    space = np.where(_SPACE, seen[: SLOTS[0]] + 1.0, 0)  # after each byte
    ones, all_ = np.zeros((256, 255), dtype=np.float32), np.zeros((256, 255), dtype=np.float32)
    for b, path in enumerate(paths):
        for node, bit in path:
            all_[b, node], ones[b, node] = 1, bit
    n1, n = seen @ ones, seen @ all_
    odds = np.log((n1 + 0.4) / (n - n1 + 0.4))
    odds = np.clip(np.rint(odds / GRAIN), -127, 127).astype(np.int8)  # a small table stays in a core's cache
    first = np.concatenate([[0], np.cumsum(depth)])
    return {
        "shape": np.log(shape / shape.sum(axis=1, keepdims=True)) + np.array([0, 0, -np.inf]),  # others are always spelled
        "mark": np.log(np.maximum(mark, 1) / mark.sum()), "space": np.log(np.where(_SPACE, space / space.sum(axis=1, keepdims=True), 1)),
        "spell": 1.0, "taken": 0.0, "start": START, "odds": odds.reshape(-1), "gate": (seen.sum(axis=1) >= OFTEN).astype(np.int64), "depth": depth, "first": first[:-1],
        "node": np.array([node for p in paths for node, _ in p]),
        "sign": np.array([(2 * bit - 1) * GRAIN for p in paths for _, bit in p], dtype=np.float32),
    }


def blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges after which weights move: short ones first, then ``LONGEST`` bytes each."""
    first, most = 0, int(sizes.max(initial=0))
    while first < most:
        last = first + min(max(first, SHORTEST), LONGEST)
        yield first, last
        first = last


def byte_logs(model: dict, flat: np.ndarray, offsets: np.ndarray, *, wanted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of all bytes before each place of a slice (unless only the weights are ``wanted``), and each text's last weights."""
    texts = len(offsets) - 1
    weights = np.repeat(model["start"].T.reshape(-1, 1, 2), texts, axis=1).reshape(-1, 2 * texts).astype(np.float32)
    if not len(flat):
        return np.zeros(1), weights
    own = contexts(flat, offsets)
    # bytes in the order they are met: block by block, in it text by text, in it gate by gate, so that
    # neighbours share their weights
    sizes, texts_of, sizes_of, runs, bounds = np.diff(offsets), [], [], [0], [0]
    for first, last in blocks(sizes):
        live = np.flatnonzero(sizes > first)
        texts_of.append(live)
        sizes_of.append(np.minimum(sizes[live], last) - first)
        runs.append(runs[-1] + 2 * len(live))
        bounds.append(bounds[-1] + int(sizes_of[-1].sum()))
    texts_of, sizes_of = np.concatenate(texts_of), np.concatenate(sizes_of)
    by_text = np.argsort(texts_of, kind="stable")
    run_of = np.repeat(by_text * 2, sizes_of[by_text])
    run_of += model["gate"].take(own[1])
    order = np.argsort(run_of.astype(np.uint16) if runs[-1] <= 1 << 16 else run_of, kind="stable")  # 16 bits are sorted by radix
    size_of = np.bincount(run_of, minlength=runs[-1])
    slot_of = (texts_of[:, None] * 2 + np.arange(2)).reshape(-1)
    met = flat[order]
    depth = model["depth"].take(met)
    ends = np.zeros(len(order) + 1, dtype=np.int64)
    np.cumsum(depth, out=ends[1:])
    byte = np.repeat(np.arange(len(met)), depth)  # of each bit; taking by it is cheaper than repeating each array
    code = (model["first"].take(met) - ends[:-1]).take(byte)
    code += np.arange(ends[-1])
    node, sign = model["node"].take(code), model["sign"].take(code)
    odds = []
    for c in own:
        at = (c.take(order) * 255).take(byte)
        at += node
        odds.append(model["odds"].take(at).astype(np.float32))
        odds[-1] *= sign
    # of each run that has bytes: weights, first bit, bits, and rate
    filled = np.flatnonzero(size_of)
    slots, starts = slot_of.take(filled), np.cumsum(size_of)
    starts = ends.take((starts - size_of).take(filled))
    lengths = np.diff(starts, append=ends[-1])
    rates = (RATE / np.maximum(BLOCK, lengths)).astype(np.float32)
    runs = np.searchsorted(filled, runs)
    logs = np.empty(len(order)) if wanted else np.zeros(0)
    for k, (first, last) in enumerate(zip(bounds[:-1], bounds[1:])):
        bits, those = slice(ends[first], ends[last]), slice(runs[k], runs[k + 1])
        slot, length, run = slots[those], lengths[those], starts[those] - bits.start
        xs = [x[bits] for x in odds]
        z = np.repeat(weights[0][slot], length)
        z *= xs[0]
        for w, x in zip(weights[1:], xs[1:]):
            part = np.repeat(w[slot], length)
            part *= x
            z += part
        np.clip(z, -15, 15, out=z)
        away = np.exp(np.negative(z, out=z), out=z)
        sure = away + 1
        if wanted:
            logs[order[first:last]] = -np.log(np.multiply.reduceat(sure.astype(np.float64), ends[first:last] - bits.start))
        away /= sure  # how far the probability of what came stays below 1
        for w, x in zip(weights, xs):
            x *= away
            w[slot] += rates[those] * np.add.reduceat(x, run)
    return np.concatenate([[0], np.cumsum(logs)]), weights


def log_probabilities(model: dict, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Natural log probability of the bits of each text of a slice."""
    return np.diff(byte_logs(model, flat, offsets)[0][offsets])


def start_weights(texts: DataFrame, model: dict) -> np.ndarray:
    """Mean of the weights at which the texts end, each by its size; those of the model without texts."""
    held = texts.sparkSession.sparkContext.broadcast(model)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        for batch in batches:
            for flat, offsets in slices(batch.column(0), SCORE_SLICE):
                size = np.diff(offsets).astype(np.float64)
                weights = byte_logs(held.value, flat, offsets, wanted=False)[1].reshape(len(SLOTS), -1, 2)
                sums = np.einsum("ktg,t->gk", weights, size).reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array([*range(len(sums)), -1]), pa.array([*sums, size.sum()])], names=["k", "w"])

    sums = {r["k"]: r["w"] for r in texts.mapInArrow(last, "k bigint, w double").groupBy("k").agg(F.sum("w").alias("w")).collect()}
    if not sums.get(-1):
        return model["start"]
    found = np.array([sums[k] for k in range(START.size)]) / sums[-1]
    return np.round(found.reshape(START.shape), 3).astype(np.float32)  # the same whatever the order of the sums


# --- tokens -----------------------------------------------------------------------
def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_freed_memory()
    for batch in batches:
        for flat, offsets in slices(batch.column(0), COUNT_SLICE):
            words = find(_LOWER.take(flat), offsets, CLASSES[SPACED])
            mark = parts(words, flat)[2]
            token, core = hashes(words, mark)
            # as a word without its mark, and as a token of the base: the same without a mark
            key, at = np.unique(np.concatenate([core, token[mark > 0], [END]]), return_inverse=True)
            word = np.bincount(at[: len(core)], minlength=len(key))
            n = np.bincount(at[: len(core)][mark == 0], minlength=len(key)) + np.bincount(at[len(core): -1], minlength=len(key))
            n += (key == END) * (len(offsets) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n), pa.array(word)], names=["token", "n", "word"])


def by_first_bits(known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.uint64, int]:
    """Sorted hashes and one more, where those of each leading bits begin, the bits left out, and the most hashes alike in them."""
    left = np.uint64(64 - max(1, len(known).bit_length()))
    of = np.bincount((known >> left).view(np.int64), minlength=1 << (64 - int(left)))
    return np.append(known, np.uint64(0)), np.cumsum(of) - of, left, int(of.max())


def places(index: tuple[np.ndarray, np.ndarray, np.uint64, int], token: np.ndarray) -> np.ndarray:
    """Place of each token among the sorted known ones, -1 for others (counts end with a zero for them)."""
    known, begin, left, most = index
    at, last = begin.take((token >> left).view(np.int64)), len(known) - 1
    for _ in range(most):  # hashes are spread evenly: few are alike in their first bits
        at += (known.take(at) < token) & (at < last)
    return np.where((known.take(at) == token) & (at < last), at, -1)


def scorer(model: dict, head: tuple[np.ndarray, dict], spark) -> Column:
    held = spark.sparkContext.broadcast((model, head))

    @F.arrow_udf(from_arrow_type(ARROW_SCORE))
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keep_freed_memory()
        model, (known, counts) = held.value
        end, index = counts["n"][:-1][known == END].sum(), by_first_bits(known)  # every text ends with the end token
        for texts in batches:
            out = []
            for flat, offsets in slices(texts, SCORE_SLICE):
                sums, n = byte_logs(model, flat, offsets)[0], len(offsets) - 1
                words = find(_LOWER.take(flat), offsets, CLASSES[SPACED])
                row, (shape, before, mark) = words.row_of(), parts(words, flat)
                token, word = hashes(words, mark)
                distinct, which = np.unique(word, return_inverse=True)
                closed = words.ends < offsets[row + 1]  # by white space, not by the end of the text
                spelled = sums[words.ends + closed] - sums[words.starts]
                space = model["space"][flat[words.ends - 1], flat[np.minimum(words.ends, len(flat) - 1)]] if len(row) else np.zeros(0)
                shape = model["shape"][before, shape] + model["mark"][mark] + space * closed
                # the word spelled or taken from the text so far, and the weight left for the vocabulary
                earlier = np.arange(len(row)) - words.rows[row]
                own_words = OWN * earlier / (earlier + OWN_AFTER)
                whole = 1 - model["spell"]
                again = np.log(np.maximum(whole * own_words * met_before(row, which) / np.maximum(earlier, 1), 1e-300))
                other = np.logaddexp(spelled + np.log(model["spell"]), again + shape)
                shape += np.log1p(-own_words)
                j = places(index, distinct)[which]
                i = j.copy()
                i[mark > 0] = places(index, token[mark > 0])
                often = counts["word"][j]
                mixed = other.copy()
                taken = often > 0
                mixed[taken] = np.logaddexp(other[taken], model["taken"] + np.log(often[taken]) + shape[taken])
                logs = np.diff(sums[offsets]) + np.bincount(row, mixed - spelled, n)
                base = counts["n"][i]
                head = np.bincount(row, np.log10(base + 1.0), n) + np.log10(end + 1.0)
                # words outside the head: as tokens of the base, as words of the mix, or both at once
                both = (i < 0) & (token == word)
                alone, as_word = np.flatnonzero((i < 0) & ~both), np.flatnonzero(j < 0)
                at = np.concatenate([alone, as_word])
                key = np.concatenate([token[alone], word[as_word]])
                is_base = np.concatenate([np.ones(len(alone), dtype=bool), both[as_word]])
                is_word = np.arange(len(at)) >= len(alone)
                order = np.argsort(row[at], kind="stable")
                at, key, is_base, is_word = at[order], key[order], is_base[order], is_word[order]
                tails = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(row[at], np.arange(n + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(is_base), pa.array(other[at].astype(np.float32), mask=~is_word), pa.array(shape[at].astype(np.float32))],
                        fields=list(ARROW_SCORE.field("tail").type.value_type),
                    ),
                )
                out.append(pa.StructArray.from_arrays(
                    [pa.array(np.diff(words.rows) + 1), pa.array(np.bincount(row, base > 0, n).astype(np.int64) + int(end > 0)), pa.array(head),
                     pa.array(logs / np.log(10)), tails], fields=list(ARROW_SCORE)
                ))
            yield pa.concat_arrays(out) if out else pa.array([], type=ARROW_SCORE)

    return score


def score_texts(docs: DataFrame, training: Column, *, id_: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """One row per document: id, ``training``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    spark = docs.sparkSession
    known = docs.select(F.col(id_).alias("id"), F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    learned = known.where("training").select("text")
    # a task yields a key once, so there is nothing to add up before the exchange
    seen = learned.mapInArrow(count_contexts, "key int, n bigint").repartition("key").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    model = build(seen["key"].to_numpy(), seen["n"].to_numpy())
    tokens = stored(learned.mapInArrow(count_tokens, "token bigint, n bigint, word bigint").groupBy("token").agg(
        F.sum("n").alias("n"), F.sum("word").alias("word")
    ), "tokens")
    end = F.col("token") == F.lit(int(END))
    n, v, words, once = tokens.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0), F.coalesce(F.sum("word"), F.lit(0)), F.count_if(F.col("word") == 1),
    ).first()
    if words:
        model["spell"] = min(max(once / words, LEAST_SPELLED), 0.5)
        model["taken"] = float(np.log1p(-model["spell"]) - np.log(words))
        model["start"] = start_weights(learned, model)
    level = F.floor(F.log2(F.greatest("n", "word")) * 16)
    levels = sorted(((r["level"], r["m"]) for r in tokens.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("m")).collect()), reverse=True)
    kept, least = 0, 1 << 20
    for at, m in levels:
        kept += m
        if kept > head:
            break
        least = at
    in_head = (level >= least) | end
    top = tokens.where(in_head).toArrow()
    keys = top["token"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    common = keys[order], {c: np.append(top[c].to_numpy()[order], 0).astype(np.float64) for c in ("n", "word")}
    made = known.select("id", "training", F.monotonically_increasing_id().alias("row"), scorer(model, common, spark)(F.col("text")).alias("s"))
    rows = stored(made.select("row", "id", "training", "s.*"), "scores")  # numbered once, here
    tail = rows.select("row", F.inline("tail").alias("token", "base", "else", "shape")).join(tokens.where(~in_head), "token")
    ahead = F.lit(model["taken"]) + F.ln("word") + F.col("shape") - F.col("else")
    gain = F.greatest(ahead, F.lit(0.0)) + F.log1p(F.exp(-F.abs(ahead)))  # of taking the word whole
    is_base = F.col("base") & (F.col("n") > 0)
    found = tail.groupBy("row").agg(
        F.count_if(is_base).alias("tail_known"), F.sum(F.when(is_base, F.log10(F.col("n") + 1.0))).alias("tail_sum"),
        F.sum(F.when(F.col("word") > 0, gain / F.lit(float(np.log(10))))).alias("gain"),
    )
    both = rows.drop("tail").join(found, "row", "left")
    base = F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    return both.select(
        F.col("id").alias(id_), "training", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"),
    )
