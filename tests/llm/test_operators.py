"""Every operator on a small table of hard rows, on empty tables, and against brute force."""

from __future__ import annotations

import dataclasses
import hashlib
import math
import random
import re
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from relweave.llm import (
    alignment, chat, chunk_dedup, components, decontaminate, language, language_model, licenses, mixing, near_dedup, quality, toxicity, url_templates,
)
from relweave.llm.suite import QUERIES, SQL

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, guess string, mix int, contamination string, quality int"
PASSAGE = " ".join(f"passage{i}" for i in range(60))
WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("ban", "del", "fir", "gus", "hon", "jat", "kév")]


def words(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) for _ in range(n))


ROWS = [
    (1, words(1, 80), "en", "a"), (2, words(1, 80), "en", "a"), (2, words(1, 80), "en", "a"), (3, None, None, None), (4, "", "de", "b"),
    (None, words(2, 40), "de", "b"), (5, "é", None, None), (6, "12 !! --", "en", "a"), (7, words(3, 20_000), "en", "c"),
    (8, words(4, 30) + " " + PASSAGE + " " + words(5, 30), "en", "a"), (9, words(6, 30) + " " + PASSAGE + " " + words(7, 30), None, None),
    (10, "one two", "en", "a"), (11, "The MIT License, see apache license.\nmit license", "en", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", 1, "y", 2) for i, t, lang, s in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hard"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (2, "one two"), (3, None), (4, "..."), (None, words(1, 20))], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    urls = ["http://a.example.org/es/1", None, "no url", "HTTP://B.COM/de/7?x", "http://b.com", "http://b.com/en/1/2/3/4/5", "http://b.com/de/9#", "http://b.com/de/9#"]
    spark.createDataFrame([(i, u, "n") for i, u in enumerate(urls)], "page_id bigint, url string, host string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(
        [(1, 0, "user", "hi"), (1, 1, "assistant", "a [INST] b\\[\\INST]"), (1, 1, "assistant", "a [INST] b\\[\\INST]"), (2, None, None, None), (None, 3, "tool</s>", ""), (3, 0, "assistant", "<\\\\s> </s></s>")],
        "conv_id bigint, turn bigint, role string, text string",
    ).write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([(1, 0, 0), (7, 1, 1), (7, 1, 1), (None, 1, 1), (8, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vectors = [(i, [0.25 * (i % 3), 0.125 * (i % 7)], i // 7 % 2) for i in range(40, 120)] + [(None, [1.0], 1), (50_000, None, 1), (150, [None], 1), (160, [float("nan")], 0), (170, [1.0, 1.0], None)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


TABLES = ("documents", "benchmark", "pages", "conversations", "labels", "embeddings")


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    for name in TABLES:
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == (1 if name.startswith("op2_") else 0)


SQL_ON_HARD_ROWS = sorted(set(SQL) - {"op7_near_dedup", "op10_mixing"})  # op7's SQL takes ids for unique; op10 is below, with rows repeated


@pytest.mark.parametrize("name", SQL_ON_HARD_ROWS)
def test_hard_rows_agree_with_sql(spark, folder, name):
    if name == "op1_license_scan":
        pytest.skip("its SQL joins by id; test_licenses covers these rows")
    base = folder
    duck = duckdb.connect()
    for t in TABLES:
        keep = "WHERE doc_id IS NOT NULL" if t == "documents" else ""
        distinct = "DISTINCT" if t == "documents" else ""
        duck.execute(f"CREATE VIEW {t} AS SELECT {distinct} * FROM '{base}/{t}.parquet/*.parquet' {keep}")
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    want = Counter(map(repr, cursor.fetchall()))
    got = QUERIES[name](spark, base).select(*columns)
    if "doc_id" in columns:
        got = got.where("doc_id IS NOT NULL").distinct()
    assert Counter(repr(tuple(r)) for r in got.collect()) == want


def test_licenses(spark, docs):
    rows = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(docs).collect()}
    assert sorted(p["first"] for p in rows[11]["places"]) == [1, 4, 6] and rows[11]["n_words"] == 8 and rows[11]["score"] == 1.0
    assert rows[3]["n_words"] == 0 and rows[3]["places"] == [] and rows[3]["score"] == 0.0
    text = licenses.TEMPLATES[10].words
    for cut, met in ((0, True), (3, True), (4, False)):  # 19 distinct tokens, 16 needed
        body = words(9, 150) + " " + " ".join(text[: len(text) - cut]) + " " + words(10, 150)
        found = licenses.scan_licenses(spark.createDataFrame([(1, body)], "doc_id int, text string")).first()["licenses"]
        need = len(set(text[: len(text) - cut])) >= 0.8 * len(set(text))
        assert (10 in {b["template"] for b in found["blocks"]}) == need and need == met


def test_decontamination_in_blocks_equals_one_block(spark, folder):
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    one = decontaminate.mark_contamination(docs, bench).select("doc_id", "contamination").collect()
    many = decontaminate.mark_contamination(docs, bench, block_bytes=900).select("doc_id", "contamination").collect()
    assert Counter(map(repr, one)) == Counter(map(repr, many)) and any(r["contamination"]["items"] for r in one)
    cut = {r["doc_id"]: r["text"] for r in decontaminate.cut_contaminated(docs, bench).collect()}
    assert "passage3" not in cut[8] and len(cut[8].split()) == 60


def brute_components(texts: dict[int, str]) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k: k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates_against_brute_force(spark):
    pick, texts = random.Random(5), {}
    for group in range(12):
        base = words(100 + group, 150).split()
        for _ in range(10):  # edits around the threshold, so chains and outsiders appear
            copy = list(base)
            for _ in range(pick.choice((0, 1, 3, 4, 5, 6, 8))):
                copy[pick.randrange(150)] = f"new{pick.randrange(10**6)}"
            texts[len(texts)] = " ".join(copy)
    made = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in made} == brute_components(texts)


@pytest.mark.parametrize("count", [300, 1200])
def test_pairs_of_a_large_group_follow_its_members(spark, monkeypatch, count):
    sent, real = [], near_dedup.confirmed
    monkeypatch.setattr(near_dedup, "confirmed", lambda pairs, *rest: sent.append(pairs.count()) or real(pairs, *rest))
    pick, base = random.Random(6), words(200, 150).split()
    rows = []
    for i in range(count):
        copy = list(base)
        for _ in range(pick.choice((0, 1, 2))):
            copy[pick.randrange(150)] = f"new{pick.randrange(10**6)}"
        rows.append((i, " ".join(copy) + f" tail{i}"))
    made = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["component_id"] for r in made} == {0} and sum(sent) < 3 * count


@pytest.mark.parametrize("part,block,shingles", [(2, 512, 4096), (2, 3, 50), (0, 2, 7)])
def test_blocks_of_a_bucket_lose_no_pair(spark, monkeypatch, part, block, shingles):
    for name, value in (("PART", part), ("BLOCK", block), ("SHINGLES", shingles)):
        monkeypatch.setattr(near_dedup, name, value)
    monkeypatch.setattr(near_dedup, "hub_pairs", lambda shared, groups, links, classes, threshold: links.limit(0))  # leaves more apart
    test_near_duplicates_against_brute_force(spark)


def test_members_around_the_threshold(spark):
    pick, passage = random.Random(8), [f"common{k}" for k in range(60)]
    texts = {i: " ".join(passage + [f"own{pick.randrange(10**7)}" for _ in range(pick.choice((4, 8, 11, 14)))]) for i in range(260)}
    made = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in made} == brute_components(texts)


def test_near_duplicates_of_hard_rows(docs):
    rows = near_dedup.near_duplicates(docs).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS) and by_id[2]["component_id"] == 1 and not by_id[2]["kept"]
    assert by_id[3]["n_shingles"] == 0 and by_id[3]["kept"] and by_id[10]["n_shingles"] == 1
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]


@pytest.mark.parametrize("local", [components.LOCAL_LINKS, 0])
def test_components_of_long_chains(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL_LINKS", local)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**dict.fromkeys(range(201), 0), 1000: 1000, 1001: 1000}
    texts = spark.createDataFrame([("b", "é"), ("é", "a"), ("x", "y"), (None, "q")], "a string, b string")
    assert {tuple(r) for r in components.connected_components(texts).collect()} == {("a", "a"), ("b", "a"), ("é", "a"), ("x", "x"), ("y", "x")}


def brute_chunks(data: bytes) -> list[tuple[int, int]]:
    gear, out, start, h = [int(x) for x in chunk_dedup._GEAR], [], 0, 0
    for end in range(1, len(data) + 1):
        h = ((h << 1) + gear[data[end - 1]]) & 0xFFFF
        cut = h & int(chunk_dedup._MASK) == 0 and data[end - 1] in b" \t\n\v\f\r"
        if end == len(data) or (cut and end - start >= chunk_dedup.SHORTEST):
            while end - start > chunk_dedup.LONGEST:
                stop = start + chunk_dedup.LONGEST
                while stop > start + chunk_dedup.LONGEST - 4 and data[stop] & 0xC0 == 0x80:
                    stop -= 1
                out.append((start, stop))
                start = stop
            if end > start:
                out.append((start, end))
                start = end
    return out


@pytest.mark.parametrize("text", [words(1, 300), "é" * 900, "a" * 1500, "", "x y", words(2, 40) + " " * 700])
def test_chunks_against_brute_force(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chunk_dedup.chunks("t").alias("c")).first()
    assert [(c["pos"], c["pos"] + c["size"]) for c in row["c"]] == brute_chunks(text.encode())


@pytest.mark.parametrize("letters", ["".join(map(chr, range(0x4E00, 0x4E00 + 900))), "abcdefghijklmnopqrstuvwxyz0123456789+/"])
def test_spaceless_passage_behind_any_prefix(spark, letters):
    pick = random.Random(17)
    text = lambda n: "".join(pick.choice(letters) for _ in range(n))
    passage = text(2000)
    rows = [(i, text(before) + passage + text(300)) for i, before in enumerate((0, 1, 7, 100, 611))]
    made = {r["doc_id"]: r["text"] for r in chunk_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert made[0] == rows[0][1]
    for (i, whole), before in zip(rows[1:], (1, 7, 100, 611), strict=True):
        assert made[i].startswith(whole[:before]) and made[i].endswith(whole[-300:])
        assert len(made[i]) <= len(whole) - 1600 and passage[200:1800] not in made[i]


def test_chunks_from_different_documents_are_no_passage(spark):
    pool = words(21, 3000)
    data = pool.encode()
    parts = [data[a:b].decode() for a, b in chunk_dedup.cuts(np.frombuffer(data, dtype=np.uint8))]
    parts = list(dict.fromkeys(parts))[:60]
    rows = [(i, p + f"{i} nowhere else " * 3) for i, p in enumerate(parts)]
    rows.append((1000, "".join(parts)))  # each chunk was seen, no two of them together
    rows.append((1001, "x " + "".join(parts[10:40])))  # a passage of 1000
    made = {r["doc_id"]: r["text"] for r in chunk_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert made[1000] == rows[-2][1]
    assert len(made[1001]) < 100 and made[1001].startswith("x ")


def test_runs_cover_a_passage_to_its_last_chunk():
    own = np.frombuffer(words(22, 400).encode(), dtype=np.uint8)
    edges = [0, *(stop for _, stop in chunk_dedup.cuts(own))]
    got = set(chunk_dedup.runs(own, 110))
    assert all(b - a >= 110 for a, b in got)
    for i, j in ((0, 9), (5, 30), (17, 24)):
        inside = [(a, b) for a, b in got if a >= edges[i] and b <= edges[j]]
        assert min(a for a, _ in inside) == edges[i] and max(b for _, b in inside) == edges[j]


def test_repeated_passages_go_and_the_rest_stays(docs):
    rows = {r["doc_id"]: r for r in chunk_dedup.remove_repeats(docs, spans="quality").collect()}
    kept = {i: t for i, t, *_ in ROWS}
    assert rows[8]["text"] == kept[8] and PASSAGE not in rows[9]["text"] and rows[9]["quality"][0]["sources"] == [8]
    assert rows[9]["text"].startswith(words(6, 30)[:100]) and rows[9]["text"].endswith(words(7, 30)[-100:])
    assert rows[2]["text"] == "" and rows[3]["text"] is None and rows[5]["text"] == "é" and rows[1]["text"] == kept[1]


def test_quality_removes_lines_and_keeps_clean_text(spark):
    good = "This is a plain sentence of several words here.\nAnother clean sentence follows with other content now."
    bad = good + "\nHome | About | Contact | Terms\nPlease read our privacy policy page now.\nMenu"
    rows = spark.createDataFrame([(1, good), (2, bad), (3, "a | b | c | d\n" * 9 + good)], "doc_id int, text string")
    made = {r["doc_id"]: r["quality"] for r in quality.judge(rows).collect()}
    assert made[1]["kept"] and made[1]["text"] == good and made[2]["kept"] and made[2]["text"] == good and not made[3]["kept"]


def test_chats_read_back_exactly(spark):
    marks, pick = chat.INSTRUCT.all_marks(), random.Random(3)
    rows = []
    for conv in range(60):
        for turn in range(4):
            text = "".join(pick.choice([*marks, "\\", "[", "<", "/", "]", "word ", "\n", "[\\INST]", "é"]) for _ in range(12))
            rows.append((conv, turn, pick.choice(["user", "assistant", "system", "tool", text]), text))
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    for r in made.withColumn("turns", chat.read_back(F.col("formatted"))).collect():
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(a, b) for c, _, a, b in rows if c == r["conv_id"]]
    order = chat.format_chats(spark.createDataFrame([(1, 0, "user", ""), (1, 1, "assistant", ""), (2, 0, "user", ""), (2, 1, "user", "")], "conv_id int, turn int, role string, text string"))
    assert {r["conv_id"]: r["valid"] for r in order.collect()} == {1: True, 2: False}


def test_url_templates_reject_pure_branches(spark):
    urls = [f"http://h.net/{b}/{i}" for b in ("good", "bad", "new") for i in range(12)] + [f"http://v.net/{w}" for w in (words(i, 2).replace(" ", "") + str(i) * 0 + chr(97 + i) for i in range(20))]
    rules = (url_templates.Rule("allow", "h.net", "/good/"), url_templates.Rule("block", "h.net", "/bad/1"))
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {u: v for u, v in url_templates.filter_urls(rows, rules=rules).select("url", "url_filter.verdict").collect()}
    assert got["http://h.net/bad/1"] == "block" and got["http://h.net/good/3"] == "allow" and got["http://h.net/new/3"] == "allow"
    assert all(v == "allow" for u, v in got.items() if "v.net" in u)


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn_from_documents(docs)
    rows = language.identify(docs, model).where(language.held_out(F.col("doc_id"), 5) == 0).select("lang", "guess.lang", "guess.score").toDF("a", "b", "s").collect()
    assert sum(r["a"] == r["b"] for r in rows) >= 0.98 * len(rows) and all(0 <= r["s"] <= 1 for r in rows)


def test_every_language_is_learned_from_its_own_sample(spark):
    own = lambda lang, seed: " ".join(w[:2] + chr(0x1000 + lang) + w[2:] for w in words(seed, 30).split())
    rows = [(1000 * lang + i, own(lang, i), f"l{lang:02}") for lang in range(70) for i in range(400 if lang < 1 else 2)]
    rows.append((99_999, "!!", "none"))
    labelled = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    model = language.learn(labelled, text="text", lang="lang", id_="doc_id", sample=40)
    assert model.langs == [f"l{lang:02}" for lang in range(70)]
    new = spark.createDataFrame([(lang, own(lang, 999)) for lang in range(70)], "doc_id bigint, text string").repartition(2)
    got = {r["doc_id"]: r["guess"] for r in language.identify(new, model).collect()}
    assert all(g["lang"] == f"l{lang:02}" and g["score"] > 0.5 for lang, g in got.items())


def test_language_evidence_grows_with_text(spark):
    pick = random.Random(31)
    half = len(WORDS) // 2
    text = lambda lang, n: " ".join(pick.choices(WORDS, [2 - lang] * half + [1 + lang] * half, k=n))
    rows = [(i, text(i % 2, 400), "ab"[i % 2]) for i in range(60)]
    model = language.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), text="text", lang="lang", id_="doc_id")
    new = spark.createDataFrame([(lang, text(lang, 900)) for lang in (0, 1)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["guess"] for r in language.identify(new, model).collect()}
    assert all(got[i]["lang"] == "ab"[i] and got[i]["score"] > 0.99 for i in (0, 1))


def test_language_of_hard_rows(docs):
    rows = {r["doc_id"]: r["guess"] for r in language.identify(docs, language.learn_from_documents(docs)).collect()}
    assert all(rows[i]["lang"] == "und" and rows[i]["score"] == 0 for i in (3, 4, 6)) and rows[5]["lang"] in ("en", "de") and rows[1]["lang"] == "en"


def test_base_scores_against_brute_force(spark, folder):
    rows = QUERIES["op8_lm_score"](spark, folder).collect()
    tokens = lambda t: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    seen = Counter(w for i, t, *_ in ROWS if not out(i) for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    want = Counter()
    for i, t, *_ in ROWS:
        base = sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens(t))
        want[(i, out(i), len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), n, round(base, 6))] += 1
    assert Counter((*r[:5], round(r["base_score"], 6)) for r in rows) == want
    assert all(r["score"] <= 0 for r in rows) and {r["score"] for r in rows if r["doc_id"] in (3, 4)} == {0.0}


def test_model_probabilities_sum_to_one_and_adapt():
    import numpy as np

    model = language_model.build(np.array([97 * 256 + 98, 32 * 256 + 97]), np.array([50, 20]))
    offsets = np.arange(257, dtype=np.int64)
    every = language_model.log_probabilities(model, np.arange(256, dtype=np.uint8), offsets)
    assert abs(np.exp(every).sum() - 1) < 1e-3
    flat = np.frombuffer(b"ab" * 5000, dtype=np.uint8)
    first = language_model.log_probabilities(model, flat[:600], np.array([0, 600]))[0] / 600
    assert language_model.log_probabilities(model, flat, np.array([0, len(flat)]))[0] / len(flat) >= first


def test_bit_mix_against_a_slow_version():
    """Every bit of three texts, one after the other, with weights that move after each block."""
    lm, pick = language_model, random.Random(4)
    texts = [words(s, n).encode() for s, n in ((1, 3), (2, 90), (3, 400))]
    flat, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    keys = np.array(sorted({int(own[i]) * 256 + int(flat[i]) for own in lm.contexts(flat, offsets) for i in range(0, len(flat), 2)}))
    model = lm.build(keys, np.array([pick.randrange(1, 60) for _ in keys]))
    got, own = np.diff(lm.byte_logs(model, flat, offsets)[0]), lm.contexts(flat, offsets)
    for t in range(len(texts)):
        weights = model["start"].astype(float)
        for first, last in lm.blocks(np.diff(offsets)[t: t + 1]):
            pull, bits = np.zeros((2, 3)), [0, 0]
            for i in range(offsets[t] + first, min(offsets[t] + last, offsets[t + 1])):
                b, gate, log = int(flat[i]), int(model["gate"][own[1][i]]), 0.0
                for c in range(int(model["first"][b]), int(model["first"][b] + model["depth"][b])):
                    x = np.array([model["odds"][o[i] * 255 + model["node"][c]] * float(model["sign"][c]) for o in own])
                    p = 1 / (1 + math.exp(-max(-15.0, min(15.0, float(weights[gate] @ x)))))
                    log += math.log(p)
                    pull[gate] += (1 - p) * x
                    bits[gate] += 1
                assert abs(got[i] - log) < 1e-3
            for gate in (0, 1):
                weights[gate] += lm.RATE / max(lm.BLOCK, bits[gate]) * pull[gate]


def test_contexts_and_their_counts_against_a_slow_version():
    """Each byte's contexts by the bytes before it in its own text, and their sightings; empty texts count nothing."""
    import pyarrow as pa

    from relweave.llm.words import numbered

    lm, texts = language_model, [b"", b"a", b"ab", b"a b\tcd  abc abc", b"", "\u00e9t\u00e9 x".encode(), b"zz" * 40, b""]
    flat, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    slot = lambda h, size: ((h * 0x9E3779B97F4A7C15) % (1 << 64)) >> (65 - size.bit_length())
    value, want = numbered(256, seed=31).tolist(), []
    for text in texts:
        start = 0
        for i, byte in enumerate(text):
            b1, b2, b3 = (text[i - k] if i >= k else 32 for k in (1, 2, 3))
            start = i if i and b1 in b" \t\n\v\f\r" else start
            word = (sum(value[c] * (2 * k + 1) for k, c in enumerate(text[start: i])) + i - start) % (1 << 64)
            want.append((b1, 256 + slot(b1 | b2 << 8 | b3 << 16, lm.SLOTS[1]), 256 + lm.SLOTS[1] + slot(word, lm.SLOTS[2]), byte))
    assert list(zip(*(c.tolist() for c in lm.contexts(flat, offsets)), flat.tolist(), strict=True)) == want
    batches = [pa.RecordBatch.from_arrays([pa.array([t.decode() for t in some], pa.string())], names=["text"]) for some in (texts, [b""], [])]
    got = {k: n for b in lm.count_contexts(iter(batches)) for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    seen = Counter(c * 256 + w[3] for w in want for c in w[:3])
    assert {k: n for k, n in got.items() if k < int(lm.FIRST[-1]) * 256} == seen


def test_slices_are_counted_in_memory_taken_once():
    """Arrays of a slice are not given back and faulted in again for the next, which took half the time."""
    code = """
import resource
import pyarrow as pa
from relweave.llm.language_model import count_tokens
text = "some words to be counted, of which few are new " * 60
batches = [pa.RecordBatch.from_arrays([pa.array([text] * 1000)], names=["text"])] * 4
for _ in count_tokens(iter(batches[:2])):
    pass
before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
for _ in count_tokens(iter(batches)):
    pass
print(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
"""
    faults = int(subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True).stdout)
    assert faults < 6000  # of 11 MB


def test_parts_of_words_and_earlier_ones():
    from relweave.llm.words import CLASSES, SPACED, find

    texts = ["The cat. The CAT, the", "", "a ! The.", "The"]
    flat = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    lower = np.frombuffer("".join(texts).lower().encode(), dtype=np.uint8)
    found = find(lower, offsets, CLASSES[SPACED])
    shape, before, mark = language_model.parts(found, flat)
    token, core = language_model.hashes(found, mark)
    assert (token == found.hashes()).all()
    assert shape.tolist() == [1, 0, 1, 2, 0, 0, 0, 1, 1]
    assert bytes(before.astype(np.uint8)) == b" e.e,  a!"[:5] + b" a! "
    assert [chr(m) if m else "" for m in mark] == ["", ".", "", ",", "", "", "", ".", ""]
    assert core[0] == core[2] == core[4] == core[7] == core[8] and core[1] == core[3]
    assert language_model.met_before(found.row_of(), np.unique(core, return_inverse=True)[1]).tolist() == [0, 0, 1, 1, 2, 0, 0, 0, 0]


def test_bits_of_bytes_are_told_apart_once(monkeypatch):
    """Bytes have different numbers of bits; repeating for each bit, the dearest step of a slice, is done once, not once an array."""
    lm, flat = language_model, np.frombuffer(words(5, 300).encode(), dtype=np.uint8)
    offsets = np.array([0, 100, len(flat)])
    keys = np.unique(np.concatenate([own * 256 + flat for own in lm.contexts(flat, offsets)]))
    model, repeated, repeat = lm.build(keys, np.arange(len(keys)) % 40 + 1), [], np.repeat
    monkeypatch.setattr(np, "repeat", lambda a, n, axis=None: (repeated.append(np.size(n)), repeat(a, n, axis))[1])
    logs, weights = lm.byte_logs(model, flat, offsets)
    assert repeated.count(len(flat)) == 1
    alone = [lm.byte_logs(model, flat[a:b], np.array([0, b - a])) for a, b in ((0, 100), (100, len(flat)))]
    assert np.allclose(np.diff(logs), np.concatenate([np.diff(x) for x, _ in alone]), atol=1e-6)
    assert np.allclose(weights.reshape(3, 2, 2), np.stack([w.reshape(3, 2) for _, w in alone], axis=1), atol=1e-6)


def test_places_of_tokens_by_their_first_bits():
    """As a binary search finds them, for none, one, crowded and spread hashes."""
    from relweave.llm.words import numbered

    spread = numbered(3000, seed=9)
    for known in (spread[:0], spread[:1], spread[:2000], np.arange(40, dtype=np.uint64), np.append(spread[:50], np.array([0, 1, 2**64 - 1], dtype=np.uint64))):
        known = np.unique(known)
        token = np.concatenate([spread, known, np.array([0, 5, 2**63, 2**64 - 1], dtype=np.uint64)])
        where = {int(k): i for i, k in enumerate(known)}
        assert language_model.places(language_model.by_first_bits(known), token).tolist() == [where.get(int(t), -1) for t in token]


def test_earlier_words_of_many_rows():
    pick = np.random.default_rng(7)
    row, word = np.sort(pick.integers(0, 900, 5000)), pick.integers(0, 30, 5000)
    seen, want = Counter(), []
    for pair in zip(row.tolist(), word.tolist(), strict=True):
        want.append(seen[pair])
        seen[pair] += 1
    assert language_model.met_before(row, word).tolist() == want
    assert language_model.met_before(row[:0], word[:0]).tolist() == []


def test_scores_learn_words_and_refine(spark):
    """On held-out texts the mix beats its bits alone; unseen words cost more than known ones; no training rows: one bit a decision."""
    pick = random.Random(3)
    vocabulary = ["".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randrange(2, 9))) for _ in range(400)]
    draw = lambda n: " ".join(vocabulary[int(400 * pick.random() ** 3)] for _ in range(n))
    rows = [(i, draw(200)) for i in range(200)] + [(1000, "kknown"), (1001, None), (1002, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    scored = {r["doc_id"]: r for r in language_model.score_texts(docs, F.col("doc_id") < 150).collect()}
    size = sum(len(t) for i, t in rows if 150 <= i < 200)
    bits = lambda c: -sum(scored[i][c] for i in range(150, 200)) / math.log10(2) / size
    assert bits("score") < 1.05 * bits("base_score")
    assert scored[1001]["score"] == scored[1002]["score"] == 0
    few = {r["doc_id"]: r["score"] for r in language_model.score_texts(docs, F.col("doc_id") < 150, head=5).collect()}
    assert all(abs(few[i] - r["score"]) < 1e-3 * max(1, -r["score"]) for i, r in scored.items())  # the shuffled tail scores like the head
    untaught = language_model.score_texts(docs.where("doc_id = 1000"), F.lit(False)).first()
    none = np.zeros(0, dtype=np.int64)
    depth = language_model.build(none, none)["depth"]
    assert abs(untaught["score"] + sum(int(depth[b]) for b in b"kknown") * math.log10(2)) < 1e-4 and untaught["n_known"] == 0


def test_start_weights_come_from_every_training_text(spark):
    """The mean of the weights at which each text ends, by size; no text is left out."""
    lm, pick = language_model, random.Random(6)
    texts = [words(i, pick.randrange(1, 200)) for i in range(60)] + ["qx " * 900, None, ""]
    flat, offsets = np.frombuffer("".join(t or "" for t in texts).encode(), dtype=np.uint8), np.cumsum([0, *(len((t or "").encode()) for t in texts)])
    keys = np.unique(np.concatenate([own * 256 + flat for own in lm.contexts(flat, offsets)]))
    model = lm.build(keys, np.arange(len(keys)) % 40 + 1)
    sums = np.zeros((2, 3))
    for i, size in enumerate(np.diff(offsets)):
        ends = lm.byte_logs(model, flat[offsets[i]: offsets[i + 1]], np.array([0, size]))[1]
        sums += ends.reshape(3, 2).T * size
    every = lambda rows: lm.start_weights(spark.createDataFrame([(t,) for t in rows], "text string").repartition(3), model)
    assert np.abs(every(texts) - sums / len(flat)).max() <= 0.0011
    assert (every(texts) != every([t for t in texts if t != "qx " * 900])).any()
    assert (every([None, ""]) == lm.START).all()


def test_mixing_meets_targets(spark):
    pick = random.Random(8)
    rows = [(i, words(i, pick.randrange(1, 60)), pick.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(1500)]
    made = mixing.with_copies(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).select("doc_id", "source", "mix.*").collect()
    total, taken, target, size = sum(r["size"] for r in made), Counter(), {}, {}
    for r in made:
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
        assert 0 <= r["copies"] <= 3
    assert abs(sum(target.values()) - total) < 1e-6 * total
    assert all(abs(taken[s] - target[s]) <= 30 and target[s] <= 3 * size[s] for s in target)
    again = mixing.with_copies(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)).select("doc_id", "mix.copies").collect()
    assert sorted(again) == sorted((r["doc_id"], r["copies"]) for r in made)


def mix_sql(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = duck.execute(SQL["op10_mixing"])
    columns = [d[0] for d in cursor.description]
    got = [tuple(r) for r in QUERIES["op10_mixing"](spark, str(tmp_path)).select(*columns).collect()]
    close = lambda rows: Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert close(got) == close(cursor.fetchall())
    return got


@pytest.mark.parametrize("parts", [50_000, 7])
@pytest.mark.parametrize("id_,often", [(77, 500), (None, 1000)])
def test_mixing_takes_repeated_rows_one_by_one(spark, tmp_path, monkeypatch, parts, id_, often):
    monkeypatch.setattr(mixing, "TIES", parts)
    rows = [(id_, "a b c", "b")] * often + [(1000 + i, "a b c", "b") for i in range(200)] + [(5000 + i, words(i, 5), "a") for i in range(900)]
    got = mix_sql(spark, tmp_path, rows)
    taken, target, largest = Counter(), {}, 0
    for (i, *_), (doc, size, source_size, aim, took) in zip(rows, got, strict=True):
        taken[source_size] += took
        target[source_size], largest = aim, max(largest, size)
    assert all(abs(taken[s] - target[s]) <= largest for s in target)


def test_mixing_of_hard_rows(spark, tmp_path):
    mix_sql(spark, tmp_path, [(i, t, s) for i, t, _, s in ROWS] + [(None, None, None), (1, "x", "z")])


@pytest.mark.parametrize("name", ["licenses", "quality", "mixing", "urls", "repeats", "language", "contamination", "toxicity", "alignment"])
def test_columns_of_any_name_pass_through(spark, name):
    own = ["__id", "__spans", "__lines", "__good", "__repeated", "__size", "__source", "__aim", "__own", "__tie", "__host", "__rule", "__bad_host", "__shape", "__cut", "__mix", "id", "n"]
    text = words(1, 60)
    rows = [(i, text + f" {i}", "a", "en", f"http://h.com/de/{i}", *[f"{c}{i}" for c in own]) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, url string, " + ", ".join(f"`{c}` string" for c in own))
    bench = spark.createDataFrame([(1, words(3, 20))], "item_id int, text string")
    made = {
        "licenses": lambda: licenses.scan_licenses(docs), "quality": lambda: quality.judge(docs), "mixing": lambda: mixing.with_copies(docs),
        "urls": lambda: url_templates.filter_urls(docs), "repeats": lambda: chunk_dedup.remove_repeats(docs),
        "language": lambda: language.identify(docs, language.learn_from_documents(docs)), "contamination": lambda: decontaminate.mark_contamination(docs, bench),
        "toxicity": lambda: toxicity.score_texts(docs, toxicity.learn(docs, docs.select("doc_id", F.lit(1).alias("toxic")))), "alignment": lambda: alignment.align(docs, fields=("n_a",)),
    }[name]()
    got = {r["doc_id"]: r for r in made.collect()}
    assert len(got) == 4 and all(got[i][c] == f"{c}{i}" for i in got for c in own)
    assert set(own) <= set(made.columns) and not [c for c in made.columns if c.startswith("__") and c not in own]


def test_repeats_of_text_ids(spark):
    rows = [("b", words(6, 30) + " " + PASSAGE), ("a", PASSAGE + " " + words(7, 30))]
    made = {r["doc_id"]: r for r in chunk_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id string, text string"), spans="cut").collect()}
    assert made["a"]["cut"] is None and made["b"]["cut"][0]["sources"] == ["a"] and "passage30" not in made["b"]["text"]


def test_spans_against_brute_force(spark):
    pick = random.Random(12)
    for trial in range(4):
        passages = [words(500 + k, 40) for k in range(3)]
        rows = []
        for i in range(12):
            parts = [pick.choice(passages) if pick.random() < 0.5 else words(1000 + 100 * trial + 10 * i + k, 25) for k in range(4)]
            rows.append((i, " ".join(parts)))
        first = {}
        for i, t in rows:  # the least document of each run, and whether it stood there before
            for a, b in chunk_dedup.runs(np.frombuffer(t.encode(), dtype=np.uint8), chunk_dedup.LEAST_RUN):
                first.setdefault(t.encode()[a:b], (i, a))
        want = {}
        for i, t in rows:
            spans = []
            for a, b in sorted(chunk_dedup.runs(np.frombuffer(t.encode(), dtype=np.uint8), chunk_dedup.LEAST_RUN)):
                if first[t.encode()[a:b]] < (i, a):
                    if spans and spans[-1][1] >= a:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
            if spans:
                want[i] = spans
        made = chunk_dedup.repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
        assert {r["id"]: [[s["start"], s["stop"]] for s in r["spans"]] for r in made} == want


def test_long_templates_are_found_whole(spark):
    long = licenses.template("long", words(77, 160).replace("é", "e"))
    body = words(9, 130) + " " + " ".join(long.words) + " " + words(10, 130)
    rows = spark.createDataFrame([(1, body), (2, words(11, 400))], "doc_id int, text string")
    made = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(rows, templates=[*licenses.TEMPLATES, long], threshold=1.0).collect()}
    assert [b["template"] for b in made[1]["blocks"]] and made[1]["score"] == 1.0


def test_two_labels_do_not_block_a_host(spark):
    urls = [f"http://x.com/de/{i}" for i in range(2)] + [f"http://x.com/en/{i}" for i in range(50)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = url_templates.filter_urls(rows).select("url", "url_filter.verdict").collect()
    assert all((r["verdict"] == "block") == ("/de/" in r["url"]) for r in got)


def test_deep_templates_are_rejected_by_their_own_labels(spark):
    deep = "/a/b/c/d/e/"
    urls = [f"http://y.net{deep}{k}/{i}" for k in ("good", "bad") for i in range(30)] + [f"http://y.net{deep}other/{i}" for i in range(5)]
    rules = (url_templates.Rule("allow", "y.net", deep + "good/"), url_templates.Rule("block", "y.net", deep + "bad/1"))
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r["url"]: r["verdict"] for r in url_templates.filter_urls(rows, rules=rules).select("url", "url_filter.verdict").collect()}
    assert all((v == "block") == ("/bad/" in u) for u, v in got.items())


def test_loss_follows_the_machine(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "assistant", "early"), (2, 1, "user", "q"), (2, 2, "assistant", "late"), (3, 0, "tool", "t")]
    chats = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    strict = dataclasses.replace(chat.INSTRUCT, train_out_of_order=False)
    for template, second in ((chat.INSTRUCT, ["early", "late"]), (strict, ["late"])):
        got = {r["conv_id"]: r for r in chat.format_chats(chats, template).collect()}
        assert [s["text"] for s in got[2]["segments"] if s["loss"]] == second and not got[2]["valid"] and got[2]["end_state"] is None
        assert got[1]["valid"] and got[1]["end_state"] == "assistant" and not got[3]["valid"]


def test_failed_lines_name_their_rules(spark):
    text = "This is a fine line of words.\nHome | About | Contact | Terms\nMenu\nPlease accept our cookie policy to go on.\nWir sind im Impressum zu finden heute."
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    got = {r["line_number"]: r["failed_rules"] for r in quality.failed_lines(docs).collect()}
    assert got == {1: ["navigation"], 2: ["punctuation"], 3: ["boilerplate"]} or got == {1: ["navigation", "symbols"], 2: ["punctuation"], 3: ["boilerplate"]}
    own = quality.LineRules(furniture=("impressum",))
    assert 4 in {r["line_number"] for r in quality.failed_lines(docs, rules=own).collect()} and quality.judge(docs, rules=own).first()["quality"]["n_failed_lines"] == 3


def test_pipeline_keeps_the_least_row_of_an_id(spark):
    rows = [(1, words(1, 40), "en", "a", i) for i in (3, 1, 2)] + [(1, words(2, 40), "en", "b", 9), (None, "x", "en", "a", 0), (2, words(5, 40), "en", "a", 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [sorted(map(repr, corpus_pipeline.drop_near_duplicates(spark, docs.repartition(k), "").collect())) for k in (1, 2, 5)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 3


def test_pipeline_mix_takes_effect(spark):
    rows = [(i, words(i, 10 + i % 40), "en", "a" if i < 300 else "b" if i < 360 else "c", 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    copies = {r["doc_id"]: r["copies"] for r in mixing.with_copies(docs).select("doc_id", "mix.copies").collect()}
    made = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert 0 in copies.values() and max(copies.values()) > 1
    assert Counter(r["doc_id"] for r in made) == Counter({i: n for i, n in copies.items() if n})
    assert all(r["taken"] == copies[r["doc_id"]] * r["size"] for r in made)


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        ids = {r["doc_id"] for r in docs.collect()}
        assert {"language_id": 7 in ids and 3 not in ids, "near_dedup": 1 in ids and 2 not in ids, "substring_dedup": {8, 9} <= ids,
                "decontamination": 8 not in ids and 7 in ids, "mixing": 7 in ids}[name], name
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_sha_of_the_probe_conversation(spark, folder):
    row = QUERIES["op2_chat_format"](spark, folder).where("conv_id = -7").first()
    text = "</s>[INST] ok [/INST]"
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and row["loss_chars"] == len(text)
