"""License scans as an exact set-similarity join of text blocks with license templates.

A document's words are cut into overlapping blocks: block b begins at word ``stride * b``
and holds ``2 * stride`` words, so every run of up to ``stride + 1`` words lies whole in
the block its first word belongs to.  The stride is ``STRIDE`` words, or those of the longest template if that has more.  A block meets a template when it holds at least
``threshold`` of the template's distinct tokens (1.0 for phrases).

Tokens are ordered globally, the rarest in all documents first; only tokens of templates
matter, so the table of frequencies has as many rows as the templates have tokens.
A template of n tokens that needs k of them can only be met by a block that holds one of
its n - k + 1 rarest tokens (prefix filter) and at least k template tokens at all (length
filter), and where the tokens that follow the first shared one, on either side, can still
reach k (positional filter).  What passes is counted in full, so the join is exact.
Phrases are then checked word by word.

Templates are parameters and go to every task; documents are not shuffled.

Defined cases: a null or empty text has no words and score 0; repeated rows score alike;
an empty table gives an empty frequency table and result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from relweave.llm.words import ALNUM, Words, word_slices

STRIDE = 100
THRESHOLD = 0.8


@dataclass(frozen=True)
class Template:
    """Words in order.  ``phrase``: only places where they stand consecutively count."""

    label: str
    words: tuple[str, ...]
    phrase: bool = False
    base: bool = False


def template(label: str, text: str, **kind: bool) -> Template:
    return Template(label, tuple(text.split()), **kind)


# Names and opening sentences of public licenses, normalised to words.
TEMPLATES = (
    template("mit", "mit license", phrase=True, base=True),
    template("apache", "apache license", phrase=True, base=True),
    template("gpl", "general public license", phrase=True, base=True),
    template("bsd", "bsd license", phrase=True),
    template("isc", "isc license", phrase=True),
    template("mpl", "mozilla public license", phrase=True),
    template("epl", "eclipse public license", phrase=True),
    template("lgpl", "lesser general public license", phrase=True),
    template("agpl", "affero general public license", phrase=True),
    template("cc", "creative commons attribution", phrase=True),
    template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    template("mpl", "this source code form is subject to the terms of the mozilla public license"),
    template("cc", "this work is licensed under a creative commons attribution license"),
    template("unlicense", "this is free and unencumbered software released into the public domain"),
)

ARROW_SCAN = pa.struct([
    ("n_words", pa.int64()), ("score", pa.float64()),
    ("blocks", pa.list_(pa.struct([("template", pa.int32()), ("first", pa.int64()), ("shared", pa.int32())]))),
    ("places", pa.list_(pa.struct([("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]))),
])


class Vocabulary:
    """Template tokens by the hash of their word."""

    def __init__(self, tokens: Sequence[str]) -> None:
        parts = [w.hashes() for w in word_slices(pa.array(list(tokens), pa.string()), ALNUM)]
        hashes = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        self.order = np.argsort(hashes)
        self.sorted, self.words = hashes[self.order], [t.encode() for t in tokens]

    def ids(self, words: Words) -> np.ndarray:
        """Index of each word among the tokens, or -1."""
        out = np.full(len(words.starts), -1, dtype=np.int64)
        if len(out) and len(self.sorted):
            hashes = words.hashes()
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            same = np.flatnonzero(self.sorted[at] == hashes)
            out[same] = self.order[at[same]]
        return out


def frequencies(docs: DataFrame, tokens: Sequence[str], text: str) -> dict[str, int]:
    """How often each template token stands in all documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(tokens)
        for batch in batches:
            total = np.zeros(len(tokens), dtype=np.int64)
            for words in word_slices(batch.column(0), ALNUM):
                ids = known.ids(words)
                total += np.bincount(ids[ids >= 0], minlength=len(tokens))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tokens), dtype=np.int32)), pa.array(total)], names=["token", "n"])

    rows = docs.select(text).mapInArrow(count, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = dict.fromkeys(tokens, 0)
    return counts | {tokens[r["token"]]: r["n"] for r in rows}


class TemplateIndex:
    """Templates as sorted token ranks, rarest first, with the prefixes of all of them by token."""

    def __init__(self, templates: Sequence[Template], counts: dict[str, int], threshold: float) -> None:
        self.tokens = sorted(counts, key=lambda t: (counts[t], t))
        rank = {t: i for i, t in enumerate(self.tokens)}
        self.stride = max([STRIDE, *(len(t.words) for t in templates)])
        self.ranks = [np.array(sorted({rank[w] for w in t.words}), dtype=np.int64) for t in templates]
        self.need = [len(r) if t.phrase else ceil(threshold * len(r)) for t, r in zip(templates, self.ranks, strict=True)]
        self.phrases = {k: np.array([rank[w] for w in t.words]) for k, t in enumerate(templates) if t.phrase}
        found = sorted((int(r[p]), k, p) for k, r in enumerate(self.ranks) for p in range(len(r) - self.need[k] + 1))
        self.token, self.of, self.place = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
        self.member = np.zeros((len(templates), len(self.tokens)), dtype=bool)
        for k, r in enumerate(self.ranks):
            self.member[k, r] = True
        self.sizes, self.needs = np.array([len(r) for r in self.ranks]), np.array(self.need)

    def meet(self, block: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block, template, shared tokens) of all that meet; ``block``, ``token``: distinct pairs in order."""
        first = np.searchsorted(block, block, side="left")
        length = np.searchsorted(block, block, side="right") - first
        at = np.arange(len(block)) - first
        low, high = np.searchsorted(self.token, token, "left"), np.searchsorted(self.token, token, "right")
        times = high - low
        left = np.repeat(np.arange(len(block)), times)
        entry = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
        # of the shared prefix tokens of a block and a template only the first counts
        pair = block[left] * len(self.sizes) + self.of[entry]
        order = np.lexsort((token[left], pair))
        keep = order[np.concatenate([[True], pair[order][1:] != pair[order][:-1]])] if len(order) else order
        left, entry = left[keep], entry[keep]
        of = self.of[entry]
        need = self.needs[of]
        reach = 1 + np.minimum(self.sizes[of] - self.place[entry] - 1, length[left] - at[left] - 1)
        ok = (length[left] >= need) & (reach >= need)
        left, of = left[ok], of[ok]
        times = length[left]
        pairs = np.repeat(np.arange(len(left)), times)
        tokens = token[np.arange(len(pairs)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[left], times)]
        shared = np.bincount(pairs, self.member[of[pairs], tokens], len(left)).astype(np.int64)
        met = shared >= self.needs[of]
        return block[left[met]], of[met], shared[met]


def scanner(index: TemplateIndex) -> Callable[[Column], Column]:
    @F.arrow_udf(from_arrow_type(ARROW_SCAN))
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Vocabulary(index.tokens)
        for texts in batches:
            yield pa.array([row for words in word_slices(texts, ALNUM) for row in scanned(words, known.ids(words), index)], type=ARROW_SCAN)

    return scan


def scanned(words: Words, ids: np.ndarray, index: TemplateIndex) -> list[dict]:
    counts, stride = np.diff(words.rows), index.stride
    out = [{"n_words": int(n), "score": 0.0, "blocks": [], "places": []} for n in counts]
    blocks_of = np.maximum(-(-counts // stride), 1)
    first_block = np.concatenate([[0], np.cumsum(blocks_of)])
    at = np.flatnonzero(ids >= 0)
    row = np.searchsorted(words.rows, at, side="right") - 1
    inside = at - words.rows[row]
    own = first_block[row] + inside // stride
    before = np.flatnonzero(inside >= stride)  # a block also holds the words of the next stride
    pairs = np.unique(np.stack([np.concatenate([own, own[before] - 1]), np.concatenate([ids[at], ids[at[before]]])]), axis=1)
    block, of, shared = index.meet(pairs[0], pairs[1])
    for b, k, n in zip(block.tolist(), of.tolist(), shared.tolist(), strict=True):
        r = int(np.searchsorted(first_block, b, side="right")) - 1
        start = (b - int(first_block[r])) * stride
        if k in index.phrases:
            phrase = index.phrases[k]
            low, high = int(words.rows[r]) + start, int(min(words.rows[r] + start + stride, words.rows[r + 1] - len(phrase) + 1))
            starts = np.arange(low, max(low, high))
            for j, token in enumerate(phrase):
                starts = starts[ids[starts + j] == token]
            out[r]["places"] += [{"template": k, "first": i, "last": i + len(phrase) - 1} for i in (starts - int(words.rows[r])).tolist()]
            if not len(starts):
                continue
        out[r]["blocks"].append({"template": k, "first": start, "shared": n})
        out[r]["score"] = max(out[r]["score"], n / len(index.ranks[k]))
    return out


def scan_licenses(docs: DataFrame, *, templates: Sequence[Template] = TEMPLATES, text: str = "text", threshold: float = THRESHOLD, found: str = "licenses") -> DataFrame:
    """``docs`` with ``found``: number of words, best share of a template met, met blocks, phrase places.

    Template numbers are positions in ``templates``, which may have any length.
    """
    tokens = sorted({w for t in templates for w in t.words})
    index = TemplateIndex(templates, frequencies(docs, tokens, text), threshold)
    return docs.withColumn(found, scanner(index)(F.col(text)))


def labels(numbers: Column, templates: Sequence[Template] = TEMPLATES) -> Column:
    """Distinct labels of template numbers, sorted and comma-joined."""
    names = F.array(*[F.lit(t.label) for t in templates])
    return F.array_join(F.array_sort(F.array_distinct(F.transform(numbers, lambda k: F.get(names, k)))), ",")


def base_numbers(templates: Sequence[Template] = TEMPLATES) -> list[int]:
    return [k for k, t in enumerate(templates) if t.base]
