"""Language ID by word-first backoff.

Learning counts, per language, words and character n-grams of lengths ``LENGTHS`` in a
bounded sample of labelled documents.  A known word scores its smoothed log frequency in
each language.  An unseen word falls back to its n-grams, the longest first: positions
covered by a known longer n-gram are not asked again at a shorter length.  A key a language
never showed scores the same floor in every language, so a small sample is no advantage.
The mean of a text's words counts as all of them up to ``SHARPNESS`` words, and beyond that
as the square root of ``SHARPNESS`` times their number, as words of a text are not independent.

All languages with a labelled document that has words are learned.  From each come about
``sample`` documents (all, if there are no more), chosen evenly by a hash of id and text,
and its ``most_words`` most frequent words and ``most_grams`` n-grams of each length (those
above the least count that leaves so many); every language's counts of a chosen key are
kept.  The model lists for each key only the languages that have it, so it grows in
proportion to the number of languages, and is broadcast.  Scoring reads whole texts.

Defined cases: a null text or one without a letter is ``und`` with score 0, also when
nothing could be learned; null labels are not learned from; a text of letters without any
known word or n-gram takes the languages' shares; ties go to the least language name;
repeated rows score alike; label and id columns are not read when predicting.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from relweave.llm.store import short_batches, small, stored
from relweave.llm.words import ALNUM, Words, mix, numbered, word_slices

UNKNOWN = "und"
LENGTHS = (5, 4, 3, 2, 1)  # characters of an n-gram, longest first
SAMPLE, MOST_WORDS, MOST_GRAMS = 20_000, 50_000, 20_000  # of each language
SHARPNESS = 4.0  # words from which on further ones count less
ARROW_GUESS = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def characters(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each character of the chosen words, each word framed by a space; first index of each word."""
    lengths = words.ends[chosen] - words.starts[chosen]
    room = lengths + 2
    firsts = np.concatenate([[0], np.cumsum(room)])
    raw = np.full(int(firsts[-1]), 32, dtype=np.uint8)
    place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    raw[np.repeat(firsts[:-1] + 1, lengths) + place] = words.flat[np.repeat(words.starts[chosen], lengths) + place]
    heads = np.flatnonzero((raw & 0xC0) != 0x80)  # UTF-8 continuation bytes belong to the character before
    value = numbered(256, seed=17)[raw[heads]]
    stops = np.append(heads[1:], len(raw))
    for k in range(1, 4):
        more = np.flatnonzero(stops - heads > k)
        value[more] = mix(value[more] + numbered(256, seed=17 + k)[raw[heads[more] + k]])
    return value, np.searchsorted(heads, firsts)


def grams(value: np.ndarray, firsts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, first character) of the n-grams inside words."""
    left = np.repeat(firsts[1:], np.diff(firsts)) - np.arange(len(value))
    at = np.flatnonzero(left >= length)
    key = np.zeros(len(at), dtype=np.uint64)
    for k, factor in enumerate(numbered(length, seed=23)):
        key += value[at + k] * (factor | np.uint64(1))
    return mix(key + np.uint64(length)), at


def counter(langs: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of words (length 0) and n-grams per language in batches of (lang, text)."""
    code = {name: i for i, name in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array([code.get(x, -1) for x in batch.column(0).to_pylist()], dtype=np.int64)
            at = 0
            for words in word_slices(pc.utf8_lower(batch.column(1)), ALNUM):
                own = lang[at: at + len(words.rows) - 1]
                at += len(own)
                hashes, of_word = words.hashes(), np.repeat(own, np.diff(words.rows))
                for i in np.unique(own[own >= 0]).tolist():
                    chosen = np.flatnonzero(of_word == i)
                    value, firsts = characters(words, chosen)
                    for length in (0, *LENGTHS):
                        keys = grams(value, firsts, length)[0] if length else hashes[chosen]
                        key, n = np.unique(keys.view(np.int64), return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(key), length, np.int32)), pa.array(key), pa.array(np.full(len(key), i, np.int32)), pa.array(n.astype(np.int64))],
                            names=["length", "key", "lang", "n"],
                        )

    return count


@dataclass
class Model:
    langs: list[str]
    shares: np.ndarray
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # length -> sorted keys, first entry of each, language and gain of entries

    def look_up(self, length: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and their rows."""
        known = self.tables[length][0]
        if not len(known):
            return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return known[at] == keys, at

    def gains(self, length: int, at: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
        """Weighted sums of what the keys at ``at`` score above the floor, by row and language."""
        _, first, lang, gain = self.tables[length]
        many = first[at + 1] - first[at]
        entry = np.repeat(first[at] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        cell = np.repeat(row, many) * len(self.langs) + lang[entry]
        return np.bincount(cell, gain[entry] * np.repeat(weight, many), rows * len(self.langs)).reshape(rows, -1)

    def text_scores(self, words: Words) -> np.ndarray:
        """Sum over each text's words of their log frequency above the floor, in each language."""
        rows, row = len(words.rows) - 1, words.row_of()
        known, at = self.look_up(0, words.hashes())
        out = self.gains(0, at[known], row[known], np.ones(int(known.sum())), rows)
        unseen = np.flatnonzero(~known)
        if len(unseen):
            out += self.backed_off(*characters(words, unseen), row[unseen], rows)
        return out

    def backed_off(self, value: np.ndarray, firsts: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """The same of unseen words: the mean over a word's n-grams, of each position the longest known one."""
        open_ = np.ones(len(value), dtype=bool)
        word = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        found, used = {}, np.zeros(len(firsts) - 1)
        for length in LENGTHS:
            keys, start = grams(value, firsts, length)
            asked = open_[start]
            keys, start = keys[asked], start[asked]
            known, at = self.look_up(length, keys)
            start, at = start[known], at[known]
            for k in range(length):
                open_[start + k] = False
            found[length] = at, word[start]
            used += np.bincount(word[start], minlength=len(used))
        return sum(self.gains(length, at, row[owner], 1 / used[owner], rows) for length, (at, owner) in found.items())

    def guesses(self, words: Words) -> list[tuple[str, float]]:
        counts = np.maximum(np.diff(words.rows), 1)[:, None]
        mean = self.text_scores(words) / counts
        weight = np.where(counts <= SHARPNESS, counts, np.sqrt(SHARPNESS * counts))
        odds = mean * weight + np.log(self.shares) / counts
        odds -= odds.max(axis=1, keepdims=True)
        share = np.exp(odds)
        share /= share.sum(axis=1, keepdims=True)
        best = np.argmax(share, axis=1)
        return [(self.langs[b], float(share[i, b])) for i, b in enumerate(best.tolist())]


def learn(labelled: DataFrame, *, text: str, lang: str, id_: str, sample: int = SAMPLE,
          most_words: int = MOST_WORDS, most_grams: int = MOST_GRAMS) -> Model:
    """Fit on about ``sample`` labelled documents of each language, chosen evenly by a hash of id and text."""
    spark = labelled.sparkSession
    short_batches(spark)
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(id_).alias("id")
    )
    per_lang = stored(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    rows = {r["lang"]: r["n"] for r in per_lang.collect()}
    names = sorted(rows)
    part = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n"))
    drawn = F.shiftrightunsigned(F.xxhash64("id", "text"), 1) / F.lit(2.0**63) < part
    chosen = known.join(small(per_lang.withColumnRenamed("lang", "__lang")), F.col("lang") == F.col("__lang")).where(drawn).select("lang", "text")
    each = chosen.mapInArrow(counter(names), "length int, key bigint, lang int, n bigint")
    per_key = stored(each.groupBy("length", "key", "lang").agg(F.sum("n").alias("n")), "frequencies")
    totals = {(r["length"], r["lang"]): r["n"] for r in per_key.groupBy("length", "lang").agg(F.sum("n").alias("n")).collect()}
    levels: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in per_key.groupBy("length", "lang", "n").agg(F.count(F.lit(1)).alias("keys")).collect():  # as many rows as different counts
        levels.setdefault((r["length"], r["lang"]), []).append((r["n"], r["keys"]))
    least = [(length, i, least_count(found, most_grams if length else most_words)) for (length, i), found in levels.items()]
    limits = F.broadcast(spark.createDataFrame(least, "length int, lang int, least bigint"))  # a row per length and language
    often = per_key.join(limits, ["length", "lang"]).where("n >= least").select("length", "key").distinct()
    kept = stored(per_key.join(often, ["length", "key"], "left_semi").select("length", "key", "lang", "n"), "frequencies")
    learned = [i for i in range(len(names)) if (0, i) in totals]  # a language without a word has no score
    tables = {length: as_table(kept.where(F.col("length") == length).toArrow(), learned, [totals.get((length, i), 0) for i in learned]) for length in (0, *LENGTHS)}
    # words of all labelled documents, from those of the sample
    sizes = np.array([totals[(0, i)] * max(1.0, rows[names[i]] / sample) for i in learned], dtype=np.float64) + 1
    return Model([names[i] for i in learned], sizes / sizes.sum(), tables)


def least_count(levels: list[tuple[int, int]], most: int) -> int:
    """The least count from which on at most ``most`` keys are left."""
    kept, least = 0, 1 << 62
    for count, keys in sorted(levels, reverse=True):
        kept += keys
        if kept > most:
            break
        least = count
    return least


def as_table(rows: pa.Table, learned: list[int], totals: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    key, lang, n = rows["key"].to_numpy().astype(np.int64).view(np.uint64), rows["lang"].to_numpy(), rows["n"].to_numpy().astype(np.float64)
    order = np.lexsort((lang, key))
    keys, first = np.unique(key[order], return_index=True)
    lang = np.searchsorted(np.array(learned, dtype=np.int64), lang[order]).astype(np.int32)
    room = np.array(totals, dtype=np.float64) + 0.5 * (len(keys) + 1)
    # the floor, the same for all: what the language with the largest sample gives a key it never showed
    gain = np.log(n[order] + 0.5) - np.log(room)[lang] - (np.log(0.5) - np.log(room.max(initial=1.0)))
    return keys, np.append(first, len(key)).astype(np.int64), lang, gain.astype(np.float32)


def guesser(model: Model, spark) -> Column:
    held = spark.sparkContext.broadcast(vars(model))

    @F.arrow_udf(from_arrow_type(ARROW_GUESS))
    def guess(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(**held.value)
        for texts in batches:
            lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()
            found: list[tuple[str, float]] = []
            if model.langs:
                for words in word_slices(pc.utf8_lower(texts), ALNUM):
                    found += model.guesses(words)
            else:
                found = [(UNKNOWN, 0.0)] * len(texts)
            made = [g if ok else (UNKNOWN, 0.0) for g, ok in zip(found, lettered, strict=True)]
            yield pa.array([{"lang": a, "score": b} for a, b in made], type=ARROW_GUESS)

    return guess


def identify(docs: DataFrame, model: Model, *, text: str = "text", guess: str = "guess") -> DataFrame:
    """``docs`` with ``guess``: a struct of ``lang`` and ``score`` (0 to 1)."""
    short_batches(docs.sparkSession)
    return docs.withColumn(guess, guesser(model, docs.sparkSession)(F.col(text)))


def held_out(id_: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % modulus


def learn_from_documents(docs: DataFrame) -> Model:
    """The model of the registered query: labelled documents outside the held-out fifth."""
    training = docs.where(held_out(F.col("doc_id"), 5) != 0)
    return learn(training, text="text", lang="lang", id_="doc_id")
