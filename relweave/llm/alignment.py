"""Alignment of two tokenizers' tokens by the bytes they cover.

Tokenizer A is a byte-level BPE of the ``tokenizers`` library, B a BPE with byte fallback of
``sentencepiece``.  Both read a space and the text (B puts the space there itself), without
special tokens: strings of such tokens inside a text are plain text.

1. Coarse cuts.  A's character offsets and B's spans (those of its proto, which this version of the
   library returns as ``proto``; its older name ``immutable_proto`` raises there) say where tokens
   meet, if they meet between characters.
2. Refinement.  Where two tokens of A share a character, or two tokens of B are bytes of the fallback, the
   cut lies inside a character or is not told; there the tokens' decoded bytes are counted from the last coarse cut.
3. Token bytes joined must equal the space and the text; a text for which A's or B's do not has no tokens.
4. Byte places where tokens of both end cut the tokens into groups.  Between two neighbouring ends of either
   side lies one link: a token of A and a token of B that overlap.

Both tokenizers cut before a single space between other characters: A by its pattern, and no piece of B's
vocabulary has a space after another character (both are looked up in the files; a pair of files
for which this does not hold is run on whole texts).  So a text is cut there, and a task aligns each distinct
piece once and puts the texts' alignments together from their pieces.

``link_counts`` counts for each pair of ids the documents that hold it linked.  ``with_link_counts`` looks the
counts up again for every document: pairs found in at least a 2^19th of all (document, pair) rows, of which
there are at most 2^19 by that rule, are sent to every task; the others, none of which is frequent, are joined by a shuffle.

Defined cases: null and empty texts, and texts that are no valid UTF-8, have no tokens, links or groups; rows
without id and repeated rows are documents of their own; tables may be empty; other columns pass through and
may have any name but that of the one struct column added (ValueError otherwise).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from relweave.llm.store import short_batches, stored

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICE_CHARS = 1 << 18
MOST_PIECES = 600_000  # remembered in a task
FREQUENT = 19  # bits: at most 2^FREQUENT pairs are sent to every task
FIELDS = {
    "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "a_ids": pa.list_(pa.int32()), "a_ends": pa.list_(pa.int64()),
    "b_ids": pa.list_(pa.int32()), "b_ends": pa.list_(pa.int64()), "groups": pa.string(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int32()),
}


@dataclass(frozen=True)
class Files:
    """The tokenizers' files as bytes, so that only the driver must reach them."""

    a: bytes
    b: bytes


def read_files(folder: str = TOKENIZERS, a: str = BYTE_BPE, b: str = PIECE_BPE) -> Files:
    with open(f"{folder}/{a}", "rb") as one, open(f"{folder}/{b}", "rb") as two:
        return Files(one.read(), two.read())


def byte_level_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def between(coarse: np.ndarray, known: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where each token ends: the coarse cut where it is known, else the last known cut plus the decoded bytes since."""
    total = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(known, np.arange(len(known)), -1))
    at = np.maximum(last, 0)
    return np.where(last >= 0, coarse[at] + total - total[at], total)


class Pair:
    """Both tokenizers, loaded once in a task."""

    def __init__(self, files: Files) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(files.a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        letters = byte_level_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        added = {t["id"] for t in json.loads(files.a).get("added_tokens", [])}
        for token, i in vocabulary.items():
            self.a_bytes[i] = token.encode() if i in added else bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_is_byte = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.b_bytes = [bytes([int(p[3:5], 16)]) if one else p.replace("▁", " ").encode() for p, one in zip(pieces, self.b_is_byte, strict=True)]
        self.a_size, self.b_size = (np.array(list(map(len, t)), dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        # whether no token of either reaches over a space between two words: by A's own cuts, by B's vocabulary
        cuts = json.loads(files.a).get("pre_tokenizer") or {}
        a_cuts = cuts.get("type") == "ByteLevel" and cuts.get("use_regex", True) and not cuts.get("add_prefix_space") and not json.loads(files.a).get("normalizer")
        self.apart = a_cuts and not any(re.search("[^▁]▁", p) for p in pieces)
        # A id, then B id, each followed by the mark inside a group or the one at its end
        self.a_names = np.array([f"{i}{mark}" for i in range(len(self.a_bytes)) for mark in ",|"], dtype=object)
        self.b_names = np.array([f"{i}{mark}" for i in range(len(self.b_bytes)) for mark in ",;"], dtype=object)

    def encode(self, text: str, whole: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and ends of A's and B's tokens of a space and the text (``whole``); None if their bytes differ from it."""
        if not text:
            return None
        made = self.a.encode(" " + text, add_special_tokens=False)
        ids = made.ids
        if b"".join(map(self.a_bytes.__getitem__, ids)) != whole:
            return None
        spans = self.b.encode(text, return_type="proto", num_threads=1).pieces
        b_ids = list(map(attrgetter("id"), spans))
        if b"".join(map(self.b_bytes.__getitem__, b_ids)) != whole:
            return None
        a, b = np.array(ids, dtype=np.int32), np.array(b_ids, dtype=np.int32)
        flat = np.frombuffer(whole, dtype=np.uint8)
        place = np.append(np.flatnonzero(flat & 0xC0 != 0x80), len(flat))  # of each character
        start, stop = np.fromiter(chain.from_iterable(made.offsets), dtype=np.int64, count=2 * len(a)).reshape(-1, 2).T
        meet = np.append(start[1:], len(place) - 1)
        a_ends = between(place[meet], stop == meet, self.a_size[a])
        begins = np.fromiter(map(attrgetter("begin"), spans), dtype=np.int64, count=len(b)) + 1
        begins[0] = 0
        byte = self.b_is_byte[b]
        meet = np.append(begins[1:], len(flat))
        b_ends = between(meet, (meet > begins) & ~(byte & np.append(byte[1:], False)), self.b_size[b])
        return a, a_ends, b, b_ends


def pieces_of(text: str, apart: bool) -> list[str]:
    """The text cut where tokens of both always end: before a single space between other characters.

    A space before each piece, joined, is the space and the text.
    """
    if not apart:
        return [text]
    if _WIDE.search(" " + text):
        return [p[1:] for p in _SINGLE.split(" " + text)]
    return text.split(" ")


_WIDE = re.compile(r" (?:\s|$)")
_SINGLE = re.compile(r"(?<=[^ ])(?= \S)")


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes of all elements of some ranges, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Memo:
    """Alignments of the pieces met so far; forgotten when they are ``MOST_PIECES``.  Single tokens are kept where ``fields`` has them."""

    def __init__(self, pair: Pair, fields: Sequence[str] = tuple(FIELDS)) -> None:
        self.pair = pair
        self.kept = [k for k in ("a_ids", "a_ends", "b_ids", "b_ends") if k in fields] + ["links"]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.whole = np.zeros(0, dtype=bool)  # tokens give back the piece
        self.size = np.zeros(0, dtype=np.int64)  # bytes with the space before it
        self.counts = {k: np.zeros(0, dtype=np.int32) for k in ("a", "b", "common")}
        self.flat = {k: np.zeros(0, dtype=np.int64) for k in self.kept}
        self.edges = {k: np.zeros(1, dtype=np.int64) for k in self.kept}

    def number_of(self, pieces: list[str]) -> np.ndarray:
        fresh = [p for p in dict.fromkeys(pieces) if p not in self.number]
        if len(self.number) + len(fresh) > MOST_PIECES and self.number:
            self.forget()
            fresh = list(dict.fromkeys(pieces))
        # side by side in one text, as they stand in texts; those at an end of their text alone
        alone = [p for p in fresh if not p or p[0].isspace() or p[-1] == " "]
        if alone:
            some = set(alone)
            fresh = [p for p in fresh if p not in some]
        if fresh:
            self._learn(fresh)
        for p in alone:
            self._learn([p])
        return np.fromiter(map(self.number.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def _learn(self, fresh: list[str]) -> None:
        text = " ".join(fresh)
        made = self.pair.encode(text, b" " + text.encode())
        if made is None and len(fresh) > 1:
            self._learn(fresh[: len(fresh) // 2])
            self._learn(fresh[len(fresh) // 2:])
            return
        size = np.array([len(p.encode()) + 1 for p in fresh], dtype=np.int64)
        none = np.zeros(0, dtype=np.int64)
        a, a_ends, b, b_ends = made if made is not None else (none, none, none, none)
        stops = np.cumsum(size)
        starts = stops - size
        everywhere = np.sort(np.concatenate([a_ends, b_ends]))
        twice = np.zeros(len(everywhere), dtype=bool)
        twice[1:] = everywhere[1:] == everywhere[:-1]
        common = everywhere[twice]
        if made is not None and not np.array_equal(common[np.minimum(np.searchsorted(common, stops), len(common) - 1)], stops):
            raise RuntimeError("a token reaches over a space between two words")
        ends = everywhere[~twice]
        links = (a[np.searchsorted(a_ends, ends)].astype(np.int64) << 32) | b[np.searchsorted(b_ends, ends)]
        rows = {k: np.append(0, np.searchsorted(x, stops, side="right")) for k, x in (("a", a_ends), ("b", b_ends), ("common", common), ("links", ends))}
        # ids in the order of groups, A's before B's, with the mark that follows each
        upto_a, upto_b = np.searchsorted(a_ends, common, side="right"), np.searchsorted(b_ends, common, side="right")
        a_group, b_group = np.searchsorted(common, a_ends), np.searchsorted(common, b_ends)
        names = np.empty(len(a) + len(b), dtype=object)
        if len(a):
            names[np.arange(len(a)) + np.append(0, upto_b)[a_group]] = self.pair.a_names[2 * a.astype(np.int64) + (a_ends == common[a_group])]
            names[np.arange(len(b)) + upto_a[b_group]] = self.pair.b_names[2 * b.astype(np.int64) + (b_ends == common[b_group])]
        words, edges = names.tolist(), (rows["a"] + rows["b"]).tolist()
        self.groups += ["".join(words[i:j])[:-1] for i, j in zip(edges, edges[1:])]
        for p in fresh:
            self.number[p] = len(self.number)
        self.whole = np.append(self.whole, np.full(len(fresh), made is not None))
        self.size = np.append(self.size, size)
        for k in self.counts:
            self.counts[k] = np.append(self.counts[k], np.diff(rows[k]).astype(np.int32))
        found = {"a_ids": (a, "a"), "a_ends": (a_ends, "a"), "b_ids": (b, "b"), "b_ends": (b_ends, "b"), "links": (links, "links")}
        for k in self.kept:
            values, kind = found[k]
            if k.endswith("ends"):
                values = values - np.repeat(starts, np.diff(rows[kind]))
            self.edges[k] = np.append(self.edges[k], self.edges[k][-1] + rows[kind][1:])
            self.flat[k] = np.append(self.flat[k], values)


def _align(memo: Memo, texts: Sequence[str | None], fields: Sequence[str]) -> pa.StructArray:
    """The alignment of some texts at once, put together from that of their pieces."""
    n = len(texts)
    split = [pieces_of(t, memo.pair.apart) if t else [] for t in texts]
    counts = np.fromiter(map(len, split), dtype=np.int64, count=n)
    number = memo.number_of([p for pieces in split for p in pieces])
    row = np.repeat(np.arange(n), counts)
    bad = np.bincount(row[~memo.whole[number]], minlength=n) > 0
    if bad.any():
        keep = ~bad[row]
        number, row = number[keep], row[keep]
    edges = np.searchsorted(row, np.arange(n + 1))

    def total(per_piece: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(per_piece[number], dtype=np.int64))[edges])

    def lists(values: np.ndarray, sizes: np.ndarray, kind) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.astype(kind)))

    size = {k: np.diff(e) for k, e in memo.edges.items()}
    out: dict[str, pa.Array] = {
        "n_a": pa.array(total(memo.counts["a"])), "n_b": pa.array(total(memo.counts["b"])), "n_groups": pa.array(total(memo.counts["common"])),
        "n_links": pa.array(total(size["links"])),
    }
    if "groups" in fields:
        words, ends = list(map(memo.groups.__getitem__, number.tolist())), edges.tolist()
        out["groups"] = pa.array([";".join(words[i:j]) for i, j in zip(ends, ends[1:])], type=pa.string())
    if "pairs" in fields or "times" in fields:
        some, often = np.unique(row * len(memo.size) + number, return_counts=True)
        piece, owner = some % max(len(memo.size), 1), some // max(len(memo.size), 1)
        many = size["links"][piece]
        link = memo.flat["links"][_spread(memo.edges["links"][piece], many)]
        owner, often = np.repeat(owner, many), np.repeat(often, many)
        order = np.lexsort((link, owner))
        link, owner, often = link[order], owner[order], often[order]
        new = np.ones(len(link), dtype=bool)
        new[1:] = (link[1:] != link[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        each = np.bincount(owner[first], minlength=n)
        out |= {"pairs": lists(link[first], each, np.int64), "times": lists(np.add.reduceat(often, first) if len(first) else first, each, np.int32)}
    if set(fields) & {"a_ids", "a_ends", "b_ids", "b_ends"}:
        before = np.cumsum(memo.size[number]) - memo.size[number]
        before -= np.repeat(before[np.minimum(edges[:-1], max(len(before) - 1, 0))], np.diff(edges)) if len(before) else 0
        for k in memo.kept[:-1]:
            many = size[k][number]
            values = memo.flat[k][_spread(memo.edges[k][number], many)]
            if k.endswith("ends"):
                values = values + np.repeat(before, many)
            out[k] = lists(values, total(size[k]), np.int64 if k.endswith("ends") else np.int32)
    return pa.StructArray.from_arrays([out[f] for f in fields], fields=[pa.field(f, FIELDS[f]) for f in fields])


def _texts(column: pa.Array) -> list[str | None]:
    out: list[str | None] = []
    for raw in column.cast(pa.binary()).to_pylist():
        try:
            out.append(None if raw is None else raw.decode())
        except UnicodeDecodeError:
            out.append(None)
    return out


def align(docs: DataFrame, files: Files | None = None, *, text: str = "text", result: str = "alignment", fields: Sequence[str] = tuple(FIELDS)) -> DataFrame:
    """Adds a struct of the ``fields`` asked for.

    ``a_ids``, ``b_ids`` tokens; ``a_ends``, ``b_ends`` the byte places in space and text where they end; ``groups`` the
    groups' ids as text, ``a1,a2|b1;a3|b2,b3``; ``pairs`` the distinct linked ids (A's times 2^32 plus B's) and
    ``times``, how often each is linked; and counts.
    """
    if result in docs.columns:
        raise ValueError(f"column {result} exists")
    unknown = set(fields) - set(FIELDS)
    if unknown:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    short_batches(docs.sparkSession)
    files, names = files or read_files(), tuple(fields)
    kind = pa.struct([(f, FIELDS[f]) for f in names])

    @F.arrow_udf(from_arrow_type(kind))
    def aligned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = None
        for column in batches:
            memo = memo or Memo(Pair(files), names)
            texts, parts, first = _texts(column), [], 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size + len(texts[last] or "") <= SLICE_CHARS):
                    size += len(texts[last] or "")
                    last += 1
                parts.append(_align(memo, texts[first:last], names))
                first = last
            yield pa.concat_arrays(parts) if parts else pa.array([], type=kind)

    return docs.withColumn(result, aligned(F.col(text)))


def link_counts(aligned: DataFrame, pairs: Column) -> DataFrame:
    """(pair, n, best): documents that hold the pair linked; whether that is the most of all pairs of its A id."""
    counts = aligned.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts, "pairs")
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    # one row to an id of A's vocabulary at most
    return counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def with_link_counts(aligned: DataFrame, counts: DataFrame, row: str, pairs: Column, times: Column) -> DataFrame:
    """(row, n_best, count_sum) of each row that has links; ``row`` tells rows apart."""
    counts = stored(counts, "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") * (1 << FREQUENT) >= total
    links = aligned.select(F.col(row).alias("row"), F.explode(F.arrays_zip(pairs.alias("pair"), times.alias("times"))).alias("l")).select("row", "l.pair", "l.times")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    first = links.join(F.broadcast(counts.where(frequent)), "pair", "left")
    out = first.where("n IS NOT NULL").groupBy("row").agg(*sums)
    if not counts.where(~frequent).isEmpty():
        rest = first.where("n IS NULL").select("row", "pair", "times").join(counts.where(~frequent), "pair").groupBy("row").agg(*sums)
        out = out.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select(F.col("row").alias(row), "n_best", "count_sum")
