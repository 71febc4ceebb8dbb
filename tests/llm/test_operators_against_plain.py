"""Every operator of the corpus part against a plain version, on texts with odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import corpus
import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmart.llm import bloom_lm, chunk_dedup, components, decontaminate, jaccard, language, licenses, mixing, queries, suffix_dedup, suffixes, token_files, vector_topk
from leafmart.llm.license_rules import SEPARATOR, rules

BLANK = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def raw(text):
    return (text or "").encode()


def lower(text):
    return bytes(raw(text)).lower()


def by_id(df, key="doc_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


def test_language_on_held_out_texts(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate(corpus.texts(5, 200)) if len(t.split()) > 6]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language.learn_dictionaries(docs.where(~held))
    found = language.identify(docs.where(held), model).collect()
    assert set(model) == {"en", "fr", "de"} and len(found) > 30
    assert np.mean([r["lang"] == r["language"]["lang"] for r in found]) > 0.95
    assert all(0 <= r["language"]["score"] <= 1 for r in found)
    assert not any(r["language"]["rejected"] for r in found if len(r["text"]) > 200)


def plain_passages(text, items, window):
    words, hit, found = ALNUM.findall(lower(text)), set(), set()
    for name, item in items:
        w = ALNUM.findall(lower(item))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i : i + window]
            for p in range(len(words) - len(part) + 1):
                if words[p : p + len(part)] == part:
                    hit.update(range(p, p + len(part)))
                    found.add(name)
    return len(words), hit, sorted(found)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 150])
def test_passages(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    rng = random.Random(3)
    docs, rows = corpus.documents(spark, 2, 25)
    some = [r[1] for r in rows if r[1] and 30 < len(r[1].split()) < 500]
    items = [(str(i), " ".join(rng.choice(some).split()[5 : 5 + k])) for i, k in enumerate([3, 9, 10, 11, 25, 1])] + [("null", "the of"), ("7", None), ("8", ""), ("9", "the the the")]
    bench = spark.createDataFrame([(None if n == "null" else int(n), t) for n, t in items], "item_id long, text string")
    got = by_id(decontaminate.cut_passages(decontaminate.find_passages(docs, bench, window=10).withColumn("cut", F.col("text")), "cut"))
    for doc_id, text, *_ in rows[: len(rows) - 2]:
        n, hit, found = plain_passages(text, items, 10)
        r = got[doc_id][0]
        c = r["contamination"]
        assert (c["n_words"], c["n_hit"], c["items"]) == (n, len(hit), found)
        assert {w for s in c["spans"] for w in range(s["first"], s["last"] + 1)} == hit
        assert r["cut"] == text if not hit else len(r["cut"]) < len(text)


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(4)
    text = np.concatenate([np.append(rng.integers(1, 6, n), 0) for n in rng.integers(1, 60, 50)])
    index = decontaminate.FMIndex(text, 5)
    for n in (1, 2, 4):
        patterns = rng.integers(1, 6, (30, n))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(5)
    for n in (1, 2, 50, 3000):
        data = rng.integers(97, 99, n).astype(np.uint8)
        order, rank = suffixes.refine(suffixes.byte_keys(data), step=8)
        whole = data.tobytes()
        assert order.tolist() == sorted(range(n), key=lambda i: whole[i:])
        assert (rank[order] == np.arange(n)).all()
        shared = suffixes.common_prefixes(data, order, 12, lanes=7)
        for i in range(1, n):
            a, b = whole[order[i - 1] :][:12], whole[order[i] :][:12]
            assert shared[i] == next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def plain_repeats(all_texts, length):
    count = Counter(t[i : i + length] for t in all_texts for i in range(len(t) - length + 1))
    for t in all_texts:
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        yield len(t), int(gone.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~gone])


@pytest.mark.parametrize("seed", [0, 3])
def test_repeated_strings(spark, monkeypatch, seed):
    monkeypatch.setattr(suffix_dedup, "SHARD_BLOCKS", 3)  # so that shards are merged
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab cdé") for _ in range(200)) for _ in range(5)]

    def piece():
        i = rng.randrange(150)
        return rng.choice(base)[i : i + rng.randrange(5, 90)]

    docs = [None, "", "a" * 100, "a" * 40, base[0], base[0]] + ["".join(piece() for _ in range(rng.randrange(1, 6))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    got = by_id(suffix_dedup.remove_repeats(df, length=24, gram=8))
    for i, want in enumerate(plain_repeats([raw(t) for t in docs], 24)):
        r = got[i][0]["repeats"]
        assert (r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) == want


def shingles(text):
    w = BLANK.findall(lower(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_components(rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, s) in enumerate(sets):
        if doc is not None and s:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(s), least.get(root(i)) if s else doc) for i, (doc, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("seed", [1, 7])
def test_jaccard_components(spark, seed):
    docs, rows = corpus.documents(spark, seed, 70)
    rng = random.Random(seed)
    chain, text = [], corpus.prose(rng, "en", 60)
    for i in range(12):
        chain.append((10_000 - i, text, *[None] * 7))
        text = edited_at(text, 3 * i)
    docs = docs.unionByName(spark.createDataFrame(chain, corpus.SCHEMA))
    got = jaccard.near_duplicates(docs.select("doc_id", "text")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == plain_components(rows + chain)


def edited_at(text, at):
    words = text.split(" ")
    words[at] += "y"
    return " ".join(words)


def test_hollow_sets_are_joined_by_elements(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "segments", lambda start: 1)  # one segment is too few for any set
    jaccard.used_segments.cache_clear()
    docs, rows = corpus.documents(spark, 9, 30)
    rows = [r for r in rows if r[1] is None or len(r[1]) < 20_000]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, corpus.SCHEMA).select("doc_id", "text")).collect()
    jaccard.used_segments.cache_clear()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == plain_components(rows)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(40)] + [(7, 7), (300, 299), (299, 300)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, **dict.fromkeys(range(200, 240), 100), 299: 299, 300: 299}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_licences(spark):
    docs, rows = corpus.documents(spark, 1, 20)
    more = ["SPDX-License-Identifier: Apache-2.0", "licensed under the Apache License, Version 2.0 here", "the MIT License", "MIT\nall rights\nreserved, cc  by", "ccby", "CC BY cc_by ccé by"] * 2
    docs = docs.unionByName(spark.createDataFrame([(5000 + i, t, *[None] * 7) for i, t in enumerate(more)], corpus.SCHEMA))
    every = rows[: len(rows) - 2] + [(5000 + i, t) for i, t in enumerate(more)]
    got = by_id(licenses.scan_licenses(docs))
    ordered = rules()
    assert len(ordered) > 200
    for doc_id, text, *_ in every:
        r = got[doc_id][0]["licenses"]
        words = ALNUM.findall(lower(text))
        base = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == [x.encode() for x in phrase.split()])
        assert r["n_words"] == len(words) and sorted((b["word"], b["label"]) for b in r["base"]) == base
        found = [(m.start(), m.end(), rule.priority, k, rule.label) for k, rule in enumerate(ordered) if rule.keyword in (text or "").lower() for m in re.finditer(rule.pattern, text, re.ASCII)]
        kept = []
        for d in sorted(found, key=lambda d: (d[0], -d[1], -d[2], d[3])):
            if not any(e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] for e in kept):
                kept.append(d)
        assert [tuple(d) for d in r["detections"]] == kept
        assert 0 <= r["score"] <= 1
    assert SEPARATOR and got[5000][0]["licenses"]["detections"][0]["label"] == "spdx-apache-2.0"


def test_broken_keywords_reach_their_rules(spark):
    texts = ["GNU General\nPublic License, version 3", "Permission is hereby\n# granted, free of charge", "in the public\n * domain", "see LICENCE.txt", "THE BEER-WARE LICENSE", "nothing here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(licenses.scan_licenses(docs, fold=True))
    for i, text in enumerate(texts):
        plain = {rule.label for rule in rules() if re.search(rule.pattern, text, re.ASCII)}
        assert {d["label"] for d in got[i][0]["licenses"]["detections"]} <= plain
        assert bool(got[i][0]["licenses"]["detections"]) == bool(plain) == (text != "nothing here")
    assert "gpl-3.0" in {d["label"] for d in got[0][0]["licenses"]["detections"]}


def test_license_query_finds_broken_keywords(spark, tmp_path):
    spark.createDataFrame([(1, "GNU General\nPublic License, version 3")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert "gpl-3.0" in queries.op3_license_scan(spark, str(tmp_path)).first()["labels"].split(",")


def test_mix_meets_every_budget(spark):
    docs, rows = corpus.documents(spark, 4, 40)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    total = sum(len(BLANK.findall(raw(r[1]))) for r in rows)
    by_source = defaultdict(list)
    for r in got:
        assert r["mix_size"] == len(BLANK.findall(raw(r["text"]))) and 0 <= r["mix_taken"] <= 3 * r["mix_size"]
        by_source[r["source"]].append(r)
    for source, some in by_source.items():
        size, target = some[0]["mix_source_size"], some[0]["mix_target"]
        assert size == sum(r["mix_size"] for r in some) and target <= 3 * size + 1e-9
        assert sum(r["mix_taken"] for r in some) == math.floor(target), source
    assert abs(sum(s[0]["mix_target"] for s in by_source.values()) - total) < 1e-6 * total
    again = mixing.mix_sources(docs.repartition(2)).collect()
    assert sorted((str(r["doc_id"]), r["mix_taken"]) for r in got) == sorted((str(r["doc_id"]), r["mix_taken"]) for r in again)


def test_water_filling_of_targets(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 10), ("d", 500), (None, 1), ("e", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes, 3).collect()}
    weight, limit = {"a": 1, "b": 2, "c": 3, "d": 1, "e": 2, None: 3}, {"a": 3000, "b": 30, "c": 30, "d": 1500, "e": 0, None: 3}
    full = set()
    while True:
        rate = (1521 - sum(limit[s] for s in full)) / sum(weight[s] for s in weight if s not in full)
        more = {s for s in weight if limit[s] <= rate * weight[s]} - full
        if not more:
            break
        full |= more
    assert got == pytest.approx({s: limit[s] if s in full else rate * weight[s] for s in weight})


@pytest.mark.parametrize("frequent", [bloom_lm.FREQUENT, 8])
def test_base_scores_are_exact(spark, monkeypatch, frequent):
    monkeypatch.setattr(bloom_lm, "FREQUENT", frequent)
    docs, rows = corpus.documents(spark, 6, 40)
    learn = F.col("doc_id").isNotNull() & (F.col("doc_id") % 3 != 0)
    got = by_id(bloom_lm.score_texts(docs.withColumn("learn", learn), "learn"))
    tokens = [(r[0], BLANK.findall(lower(r[1])) + [None]) for r in rows]
    count = Counter(t for doc, some in tokens if doc is not None and doc % 3 for t in some)
    total, distinct = sum(count.values()), len(count)
    for doc, some in tokens:
        if doc is None:
            continue
        for r in got[doc]:
            lm = r["lm"]
            assert (lm["n_tokens"], lm["n_known"], lm["train_tokens"]) == (len(some), sum(count[t] > 0 for t in some), total)
            assert lm["base_score"] == pytest.approx(sum(math.log10((count[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in some))
            assert lm["score"] <= 0


@pytest.mark.parametrize("frequent", [bloom_lm.FREQUENT, 8])
def test_scores_count_every_pair(spark, monkeypatch, frequent):
    monkeypatch.setattr(bloom_lm, "FREQUENT", frequent)
    monkeypatch.setattr(bloom_lm, "SAMPLE_DOCS", 5)
    docs, rows = corpus.documents(spark, 6, 40)
    learn = F.col("doc_id").isNotNull() & (F.col("doc_id") % 3 != 0)
    got = by_id(bloom_lm.score_texts(docs.withColumn("learn", learn), "learn"))
    tokens = [(r[0], BLANK.findall(lower(r[1])) + [None]) for r in rows]
    taught = [some for doc, some in tokens if doc is not None and doc % 3]
    count, pairs = Counter(t for some in taught for t in some), Counter(p for some in taught for p in zip(some, some[1:]))
    every = sum(count.values()) + 0.5 * (len(count) + 1)

    def middle(n):
        return n if n < 2 else 1.5 * 2 ** math.floor(math.log2(n))

    extra = []
    for doc, some in tokens:
        if doc is None:
            continue
        alone = [(middle(count[t]) + 0.5) / every for t in some]
        score = math.log10(min(1, alone[0]))
        for (a, b), one in zip(zip(some, some[1:]), alone[1:]):
            before = middle(count[a])
            score += math.log10(min(1, (min(middle(pairs[a, b]), before) + bloom_lm.SMOOTHING * one) / (before + bloom_lm.SMOOTHING)))
        for r in got[doc]:
            extra.append(r["lm"]["score"] - score)
    assert min(extra) > -1e-6 and sum(x < 1e-6 for x in extra) > 0.8 * len(extra)  # a false hit of the filter only raises a score


def test_filter_keeps_levels_of_counts():
    rng = np.random.default_rng(8)
    hashes, counts = rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(1, 500, 300)
    bits = bloom_lm.Filter(np.frombuffer(bloom_lm.build_block(hashes, counts).tobytes(), np.uint8), 1)
    found = bits.counts(hashes)
    assert (found >= np.where(counts == 1, 1, 1.5 * 2.0 ** np.floor(np.log2(counts)))).all()  # never missed
    assert np.mean(bits.counts(rng.integers(0, 2**63, 5000, dtype=np.uint64)) > 0) < 0.03


def test_filter_has_room_for_every_count():
    rng = np.random.default_rng(9)
    hashes, counts = rng.integers(0, 2**63, 40_000, dtype=np.uint64), rng.integers(1, 4, 40_000)
    bits = bloom_lm.Filter(np.frombuffer(bloom_lm.build_block(hashes, counts).tobytes(), np.uint8), 1)
    assert (bits.counts(hashes) >= counts.clip(max=3)).all()
    assert np.mean(bits.counts(rng.integers(0, 2**63, 5000, dtype=np.uint64)) > 0) < 0.03
    assert bloom_lm.blocks_for(10**12) * bloom_lm.BLOCK_LEVELS * 4 >= 10**12


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    docs, rows = corpus.documents(spark, 2, 30)
    definition = queries.tokenizer_definition()
    coder = Tokenizer.from_str(definition)
    got = token_files.round_trip(docs.select("doc_id", "text"), definition).orderBy("start").collect()
    assert len(got) == len(rows)
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    start, texts = 0, {r[0]: r[1] for r in rows if r[0] is not None}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        if r["doc_id"] is not None:
            assert ids == coder.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [1]
        start += len(ids)


def test_pieces_of_odd_texts_equal_those_of_whole_texts():
    from tokenizers import Tokenizer

    definition = queries.tokenizer_definition()
    coder, plain, rng = token_files.WordCoder(definition, "<u2"), Tokenizer.from_str(definition), random.Random(2)
    pool = [*"abcXYZé ñ'sß İ中文   12 .,!?\n\t\x1c\x85", "ΑΣ ", "don't ", "é", "<|x|> ", "😀", "ﬁ"]
    for _ in range(500):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(60)))
        assert np.frombuffer(coder.encode([text.encode()], b"\1\0")[0], "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids + [1]


def test_packed_values():
    rng = random.Random(1)
    for n in range(30):
        values = np.array([rng.choice([0, 255, 256, 70_000, 2**31]) for _ in range(n)], np.uint32)
        assert (token_files.unpack(*token_files.pack(values), n) == values).all()


def test_chunks_do_not_shift(spark):
    rng = random.Random(5)
    passage = corpus.prose(rng, "en", 120)
    docs = [corpus.prose(rng, "en", 80) + passage + corpus.prose(rng, "fr", 50), "x" + passage + "y", corpus.prose(rng, "de", 200), None, "", "short", passage, passage]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(docs)], "doc_id long, text string, _spans string")
    got = by_id(chunk_dedup.deduplicate(df))
    r = {i: got[i][0]["repeats"] for i in range(len(docs))}
    assert r[0]["n_removed"] == 0 and r[0]["n_repeated"] > 0.8 * len(passage)  # the first stays
    assert r[1]["n_removed"] > 0.8 * len(passage) and r[2]["n_repeated"] == 0
    assert (r[3]["n_bytes"], r[4]["n_bytes"], r[5]["n_removed"]) == (0, 0, 0)
    assert r[7]["n_removed"] == r[7]["n_bytes"] and got[0][0]["_spans"] == "z"
    for i, t in enumerate(docs):
        kept, at = b"", 0
        for s in r[i]["spans"]:
            kept += raw(t)[at : s["start"]]
            at = s["end"]
        assert bytes(r[i]["kept"]) == kept + raw(t)[at:] and r[i]["n_bytes"] - r[i]["n_removed"] == len(r[i]["kept"])


def test_removed_chunks_occur_before(spark):
    docs, rows = corpus.documents(spark, 3, 30)
    got = chunk_dedup.deduplicate(docs).where("doc_id is not null").collect()
    whole = sorted((r["doc_id"], raw(r["text"])) for r in got)
    for r in got:
        for s in r["repeats"]["spans"]:
            part = raw(r["text"])[s["start"] : s["start"] + 60]
            assert any(part in t for doc, t in whole if doc < r["doc_id"]) or raw(r["text"]).count(part) > 1 or part in raw(r["text"])[: s["start"] + 59]


def test_short_copies_are_removed_whole(spark):
    docs = spark.createDataFrame([(1, "a short text"), (2, "a short text"), (3, "a short text"), (4, "another"), (5, ""), (6, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["repeats"] for r in chunk_dedup.deduplicate(docs).collect()}
    assert [(got[i]["n_repeated"], got[i]["n_removed"], bytes(got[i]["kept"])) for i in range(1, 7)] == [(12, 0, b"a short text"), (12, 12, b""), (12, 12, b""), (0, 0, b"another"), (0, 0, b""), (0, 0, b"")]


def test_gear_hash_sees_the_last_bytes():
    data = np.frombuffer(corpus.prose(random.Random(1)).encode(), np.uint8)
    h = chunk_dedup.gear_hashes(data, np.zeros(len(data), bool))
    for i in (0, 5, 40, 300):
        assert int(h[i]) == sum(int(chunk_dedup.GEAR[data[i - j]]) << j for j in range(32) if i >= j) % 2**32


def test_top_k_with_ties_and_bad_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.3]) for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (350, [0.1, None, 0.1, 0.1, 0.1, 0.1]), (400, [float("nan")] * 6), (450, [float("inf")] * 6), (None, [0.1] * 6), (301, []), (500, [0.2, 0.1]), (501, [0.1, 0.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors = vector_topk.scaled(df, "vec_id", "embedding")
    got = defaultdict(list)
    for r in vector_topk.top_k(vectors, vectors.where("id % 50 = 0"), 5).collect():
        got[r["query_id"]].append((r["rank"], r["id"], r["score"]))
    good = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    for q in [i for i in good if i % 50 == 0]:
        scores = sorted(((-sum(a * b for a, b in zip(good[q], v, strict=True)), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert set(got) == {i for i in good if i % 50 == 0}
    assert vector_topk.top_k(vectors.where("false"), vectors.where("false")).count() == 0


def test_search_reads_few_exact_vectors():
    rng = np.random.default_rng(3)
    vectors = np.floor(256 * rng.normal(0, 0.3, (4000, 32))).astype(np.int64)
    search = vector_topk.Search(np.arange(10), vectors[:10], 5, float(vectors.min()), (vectors.max() - vectors.min() + 1) / vector_topk.CELLS)
    search.scan(np.arange(4000), vectors)
    assert search.exact_reads < 0.1 * 10 * 4000
