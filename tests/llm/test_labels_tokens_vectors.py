"""Toxicity, token alignment and hard negatives: hard rows, empty tables, brute force and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relweave.llm import alignment, hard_negatives, toxicity
from relweave.llm.suite import QUERIES

SMALL = "/root/testdata/sf0.001"
FILES = alignment.read_files()
HARD_TEXTS = [
    None, "", " ", "a", "é", "a😀b", "日本語 text", "a▁b", "\x00\x01 ​", "<|endoftext|> </s><s> <unk>", "  two  spaces\n\n\ttab", "𐍈𐍈𐍈", "naïve façade 한국어",
    "x" * 5000, "ź́ \U0010ffff", "\r\n\r\n",
]


def brute_alignment(pair: alignment.Pair, text: str | None):
    """Tokens and groups from decoded bytes alone."""
    whole = b" " + (text or "").encode()
    a = pair.a.encode(" " + (text or ""), add_special_tokens=False).ids
    b = pair.b.encode(text or "")
    if not text or b"".join(pair.a_bytes[i] for i in a) != whole or b"".join(pair.b_bytes[i] for i in b) != whole:
        return [], [], [], []
    cover = []
    for ids, table in ((a, pair.a_bytes), (b, pair.b_bytes)):
        place, spans = 0, []
        for i in ids:
            spans.append((place, place + len(table[i]), i))
            place += len(table[i])
        cover.append(spans)
    links = [(x[2], y[2]) for x in cover[0] for y in cover[1] if x[0] < y[1] and y[0] < x[1]] if len(whole) < 3000 else None
    common = sorted({e for _, e, _ in cover[0]} & {e for _, e, _ in cover[1]})
    groups, last = [], 0
    for end in common:
        groups.append([[i for s, e, i in spans if last < e <= end] for spans in cover])
        last = end
    return a, b, groups, links


def as_text(groups) -> str:
    return ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)


def test_alignment_against_brute_force(spark):
    pair, pick = alignment.Pair(FILES), random.Random(4)
    letters = "ab é😀日本\n  ▁ñß<0x0A>한‍\t\u00a0'1"
    texts = HARD_TEXTS + ["".join(pick.choice(letters) for _ in range(pick.randrange(60))) for _ in range(80)]
    texts += [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 1500").limit(40).collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "alignment_id int, text string").repartition(3)
    rows = {r["alignment_id"]: r["alignment"] for r in alignment.align(docs, FILES).collect()}
    for i, text in enumerate(texts):
        a, b, groups, links = brute_alignment(pair, text)
        r = rows[i]
        assert (r["a_ids"], r["b_ids"], r["groups"], r["n_groups"]) == (list(a), list(b), as_text(groups), len(groups)), repr(text)
        if links is not None:
            assert Counter({(p >> 32, p & 0xFFFFFFFF): t for p, t in zip(r["pairs"], r["times"], strict=True)}) == Counter(links), repr(text)
            assert r["n_links"] == len(links)
        if a:
            assert r["a_ends"][-1] == r["b_ends"][-1] == len(text.encode()) + 1


def test_cuts_come_from_spans_and_are_refined_only_inside_characters():
    coarse, known = np.array([3, 5, 5, 9]), np.array([True, False, False, True])
    assert alignment.between(coarse, known, np.array([3, 1, 1, 4])).tolist() == [3, 4, 5, 9]
    assert alignment.between(coarse, np.zeros(4, dtype=bool), np.array([3, 1, 1, 4])).tolist() == [3, 4, 5, 9]


def test_pieces_equal_whole_texts(monkeypatch):
    pair, pick = alignment.Pair(FILES), random.Random(6)
    assert pair.apart
    alphabet = [" ", " ", " ", "\n", "\t", "a", "the", "'s", "é", "1", "22", "\u00a0", "。", "\x1c", "\u2028", "-", "<0x20>", "▁", "😀"]
    texts = ["".join(pick.choice(alphabet[: pick.choice((9, 19))]) for _ in range(pick.randrange(1, 25))) for _ in range(3000)]
    made = alignment._align(alignment.Memo(pair), texts, tuple(alignment.FIELDS)).to_pylist()
    monkeypatch.setattr(alignment, "MOST_PIECES", 40)  # forgets again and again
    assert alignment._align(alignment.Memo(pair), texts, tuple(alignment.FIELDS)).to_pylist() == made
    monkeypatch.setattr(pair, "apart", False)
    assert alignment._align(alignment.Memo(pair), texts, tuple(alignment.FIELDS)).to_pylist() == made


def test_invalid_utf8_has_no_tokens():
    raw = pa.array([b"ok", b"\xff\xfe", None], type=pa.binary())
    assert alignment._texts(raw) == ["ok", None, None]


@pytest.mark.parametrize("bits", [alignment.FREQUENT, 6])
def test_alignment_query_against_brute_force(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(alignment, "FREQUENT", bits)  # 6: most pairs go through the shuffle
    pair = alignment.Pair(FILES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 1200").limit(60).select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs] + [(i + 10**6 if i else None, t) for i, t in enumerate(HARD_TEXTS) if len(t or "") < 100] + [(7, "same"), (7, "same")]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    made = [brute_alignment(pair, t) for _, t in rows]
    counts = Counter(p for _, _, _, links in made for p in set(links))
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    want = Counter()
    for (i, _), (a, b, groups, links) in zip(rows, made, strict=True):
        digest = hashlib.sha256(as_text(groups).encode()).hexdigest() if a else ""
        want[(i, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), digest)] += 1
    got = QUERIES["op12_token_alignment"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == want


def test_alignment_refuses_a_taken_name(spark):
    with pytest.raises(ValueError):
        alignment.align(spark.createDataFrame([("a", 1)], "text string, alignment int"), FILES)


# --- toxicity ---------------------------------------------------------------------------
def test_toxicity_held_out(spark):
    rows = QUERIES["op11_toxicity"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    hit = Counter((r["toxic"], r["predicted"]) for r in rows)
    assert hit[1, 1] >= 0.8 * (hit[1, 0] + hit[1, 1]) and hit[0, 1] <= 0.01 * (hit[0, 0] + hit[0, 1])
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def bags(seed: int, count: int):
    pick = random.Random(seed)
    plain = [f"plain{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows = []
    for i in range(count):
        sentences = [" ".join(pick.choice(plain) for _ in range(pick.randrange(4, 9))) for _ in range(pick.randrange(1, 30))]
        if i % 3 == 0:
            sentences[pick.randrange(len(sentences))] += " vilefoe " + pick.choice(plain)
        rows.append((i, ". ".join(sentences), int(i % 3 == 0)))
    return rows


def test_offending_sentences_are_found(spark):
    rows = bags(1, 600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.learn(docs, labels)
    fresh = bags(2, 90)
    new = spark.createDataFrame([(r[0], "É " + r[1], "x") for r in fresh], "doc_id bigint, text string, __score string")
    scored = toxicity.score_texts(new, model)
    got = {r["doc_id"]: r["toxicity"] for r in scored.collect()}
    assert all((got[i]["score"] >= 0.5) == bool(y) for i, _, y in fresh)
    assert all(got[i]["n_sentences"] == t.count(". ") + 1 for i, t, _ in fresh)
    found = toxicity.offending_sentences(scored).collect()
    assert {r["doc_id"] for r in found} == {i for i, _, y in fresh if y} and all("vilefoe" in r["sentence"] and ". " not in r["sentence"] for r in found)


def test_noisy_or_against_one_document_at_a_time(spark):
    rows = bags(3, 60)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    model = toxicity.learn(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int"), steps=5)
    for r in toxicity.score_texts(docs, model, bar=0.0).collect():
        clean = 1 - 1 / (1 + math.exp(-model.leak))
        for s in r["toxicity"]["sentences"]:
            clean *= 1 - s["score"]
        assert abs(r["toxicity"]["score"] - (1 - clean)) < 1e-9
        assert len(r["toxicity"]["sentences"]) == r["toxicity"]["n_sentences"]


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    y, weight, sentences = np.array([1, 0, 1]), np.array([1.0, 2.0, 1.5]), np.array([3, 2, 4])
    feature, feature_rows = np.array([0, 1, 1, 2, 0, 3]), np.array([0, 3, 4, 6])
    ends, end_rows = np.array([1, 3, 1, 2]), np.array([0, 2, 3, 4])
    at = rng.normal(size=6)

    def loss(v):
        return toxicity.bag_gradient(y, weight, sentences, feature, feature_rows, ends, end_rows, v[:4], v[4], v[5])

    g = loss(at)[:6]
    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-6
        assert abs((loss(at + step)[-1] - loss(at - step)[-1]) / 2e-6 - g[k]) < 1e-5


def test_toxicity_of_hard_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "..."), (3, "one word" * 9000), (3, "one word" * 9000), (4, "a")], "doc_id bigint, text string")
    for labels in ([], [(1, 1)], [(3, 1), (4, 0), (2, 0), (3, 1)]):
        model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
        got = toxicity.score_texts(docs, model).select("toxicity.*").collect()
        assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if not r["n_sentences"]}) == 1
    assert toxicity.score_texts(docs.limit(0), model).count() == 0


def test_toxic_sample_is_bounded_and_weighted(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    rows = toxicity._sampled(docs, labels, "text", "toxic", "doc_id", 500).collect()
    n = Counter(r["y"] for r in rows)
    assert n[1] == 400 and 400 < n[0] < 600 and abs(sum(r["weight"] for r in rows) - 4000) < 600


# --- hard negatives -----------------------------------------------------------------------
@pytest.mark.parametrize("n,k,m", [(64, 64, 64), (33, 65, 129), (1, 1, 1), (5, 3, 9), (0, 4, 3), (70, 40, 50)])
def test_strassen_equals_the_plain_product(n, k, m):
    rng = np.random.default_rng(n + k + m)
    a, b = rng.integers(-1000, 1000, (n, k)), rng.integers(-1000, 1000, (k, m))
    for leaf in (1, 4, 32):
        assert (hard_negatives.strassen(a, b, leaf) == a @ b).all()


def test_strassen_stays_exact_when_sums_inside_wrap():
    a = np.array([[2**40, 2**40 - 7], [3, -(2**40)]])
    b = np.array([[2**22, -(2**21)], [-(2**22), 2**20 + 1]])
    want = a.astype(object) @ b.astype(object)
    assert (hard_negatives.strassen(a, b, 1) == want.astype(np.int64)).all() and (np.abs(want) < 2**63).all()


def brute_negatives(rows, anchor):
    clean = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        key = (label, [math.floor(256 * v) for v in x])
        clean[i] = min(clean.get(i, key), key)
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    out = []
    for i in (i for i in clean if anchor(i)):
        label, x = clean[i]
        ranked = sorted(((-dot(x, v), j, other) for j, (other, v) in clean.items() if j != i))
        for s, j, _ in [r for r in ranked if r[2] == label][:5]:
            fits = [(n, k) for n, k, other in ranked if other != label and 50 * -s <= 100 * -n <= 95 * -s]
            out += [(i, j, rank, k, -s, -n) for rank, (n, k) in enumerate(fits[:3], 1)]
    return Counter(out)


@pytest.mark.parametrize("block", [hard_negatives.BLOCK_BYTES, 300])
def test_hard_negatives_against_brute_force(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.integers(-3, 4, 6) / 16], int(rng.integers(0, 3))) for i in range(120)]  # small numbers make ties
    rows += [(3, [9.0], 1), (3, [9.0], 1), (200, None, 1), (201, [None, 1.0], 1), (202, [float("nan")], 0), (203, [float("inf")], 0), (None, [1.0], 0)]
    rows += [(204, [1.0], None), (205, [], 2), (210, [0.5, 0.5], 1), (220, [0.1] * 6, 77), (0, rows[0][1], rows[0][2])]
    made = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, rank string").repartition(4)
    got = hard_negatives.hard_negatives(made, F.col("vec_id") % 10 == 0, block_bytes=block)
    as_floats = [(i, x and [None if v is None else float(np.float32(v)) for v in x], label) for i, x, label in rows]
    assert Counter(map(tuple, got.collect())) == brute_negatives(as_floats, lambda i: i % 10 == 0)


def test_hard_negatives_of_empty_tables_and_too_large_numbers(spark):
    schema = "vec_id bigint, embedding array<double>, label int"
    assert hard_negatives.hard_negatives(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], schema), F.col("vec_id") % 50 == 0).count() == 0
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(spark.createDataFrame([(50, [1e9], 1)], schema), F.col("vec_id") % 50 == 0)
