"""Hard negatives, toxicity and spelling variants against plain versions and odd rows."""

import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import corpus
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmart.llm import hard_negatives, jaccard, queries, spelling, suffix_dedup, toxicity

# --- hard negatives --------------------------------------------------------------------------------------------------


def plain_negatives(rows, k=5, m=10, low=30, high=90):
    """rows: (id, label, vector of integers), one an id; anchors have an id divisible by 100."""
    out = []
    for a, label, v in rows:
        if a % 100:
            continue
        near = sorted((-int(np.dot(v, w)), i, lab == label) for i, lab, w in rows if i != a and len(w) == len(v))
        for minus, p, _ in [x for x in near if x[2]][:k]:
            fit = [(i, -s) for s, i, same in near if not same and low * -minus <= 100 * -s <= high * -minus][:m]
            out += [(a, p, rank, i, -minus, s) for rank, (i, s) in enumerate(fit, 1)]
    return sorted(out)


def vectors(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = [(i * 10, int(rng.integers(0, 3)), [int(x) for x in np.floor((centres[rng.integers(0, 6)] + rng.normal(size=8) * 0.4) * 50)]) for i in range(n)]
    rows += [(4001, 1, rows[0][2]), (4002, 0, rows[0][2]), (4003, 1, rows[0][2]), (5000, 1, [0] * 8), (5100, 1, [1, 2]), (5101, 1, [3, 4]), (5102, 2, [1, 1])]
    return spark.createDataFrame(rows, "id long, label long, vec array<long>").repartition(3), rows


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:  # many shards, blocks, clusters over several blocks, short steps
        monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 5 * 64)
        monkeypatch.setattr(hard_negatives, "LEAST_SHARD_BYTES", 64 * 64)
        monkeypatch.setattr(hard_negatives, "STEP", 4)
    frame, rows = vectors(spark, 150 if small else 400)
    got = sorted(tuple(r) for r in hard_negatives.mine(frame, F.col("id") % 100 == 0).collect())
    assert got == plain_negatives(rows) and len(got) > 200


def test_hard_negatives_of_odd_rows(spark):
    table = spark.createDataFrame(
        [(0, [1.0, 0.5], 1), (0, [1.0, 0.25], 1), (1, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.5], 2), (None, [1.0, 1.0], 1), (3, None, 2), (4, [1.0, 1.0], None), (5, [None, 1.0], 2),
         (6, [float("nan"), 1.0], 2), (7, [float("inf"), 1.0], 2), (8, [], 2), (100, [1.0, 1.0], 9)],
        "vec_id long, embedding array<float>, label int",
    ).withColumn("id", F.lit("clash"))
    rows = hard_negatives.labelled_vectors(table, "vec_id", "label", "embedding")
    assert {r["id"] for r in rows.collect()} == {0, 1, 2, 100}
    got = [tuple(r) for r in hard_negatives.mine(rows, F.col("id") % 100 == 0).collect()]
    # of the repeated id 0 the smaller vector counts: 256 * 256 + 64 * 128 with its one positive, 256 * 128 + 64 * 128 and 256 * 256 + 64 * 256 with others
    assert got == [(0, 1, 1, 2, 73728, 40960)]
    assert hard_negatives.mine(rows.where("false"), F.col("id") % 100 == 0).count() == 0
    assert hard_negatives.mine(rows, F.col("id") < 0).count() == 0


def test_walk_stops_early():
    """Candidates in tight bundles: the certificate ends the walk long before the end of the list."""
    rng = np.random.default_rng(1)
    centre = np.zeros(8)
    centre[0] = 1
    members = np.floor((centre + rng.normal(size=(20, 8)) * 0.02) * 1000).astype(np.int64)
    found = hard_negatives.Candidates(np.arange(5000) + 100, np.ones(5000, np.int64), np.floor((np.roll(np.eye(8), 1, axis=0)[rng.integers(0, 8, 5000)] + rng.normal(size=(5000, 8)) * 0.02) * 1000).astype(np.int64))
    wanted = hard_negatives.Wanted(np.arange(20), np.full(20, hard_negatives.NONE), np.full(20, hard_negatives.LAST), True)
    best, reads = hard_negatives.walk(members, np.arange(20), np.ones(20, np.int64), found, centre, wanted, 5)
    scores = members @ found.vectors.T
    expected = [sorted(zip(-s, found.ids, strict=True))[:5] for s in scores]
    assert [[(-a, b) for a, b in zip(x, y, strict=True)] for x, y in zip(best.scores, best.ids, strict=True)] == expected
    assert reads < 0.3 * scores.size


# --- toxicity --------------------------------------------------------------------------------------------------------


def judged(spark, n=400, seed=2):
    rng = random.Random(seed)
    bad = ["moron", "clown", "scum", "worthless"]
    rows = []
    for i in range(n):
        text = corpus.prose(rng, ["en", "fr", "de"][i % 3], rng.choice([5, 40, 200]))
        toxic = i % 4 == 0
        if toxic:
            words = text.split(" ")
            for _ in range(1 + len(words) // 40):
                words.insert(rng.randrange(len(words)), rng.choice(bad).upper() + rng.choice(["", ",", "!"]))
            text = " ".join(words)
        rows.append((i, text, int(toxic)))
    return rows


def test_toxicity_on_held_out_texts(spark):
    rows = judged(spark)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5], "doc_id long, label int")
    model = toxicity.learn_weights(docs, labels)
    assert 0 < len(model.at) < 5000  # sparse
    held = {r["doc_id"]: r["toxicity"]["score"] for r in toxicity.score_texts(docs, model).collect() if r["doc_id"] % 5 == 0}
    right = [(held[i] >= 0.3) == bool(y) for i, _, y in rows if i in held]
    assert np.mean(right) > 0.95 and all(0 <= s <= 1 for s in held.values())
    again = toxicity.learn_weights(docs.repartition(7), labels.repartition(3))
    assert np.array_equal(again.at, model.at) and np.allclose(again.weight, model.weight) and again.intercept == pytest.approx(model.intercept)


def plain_coordinates(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(text.encode()).lower())
    return {(b"%d" % gap, *pair) for gap, pair in [(0, (w,)) for w in words] + [(g, p) for g in (1, 2) for p in zip(words, words[g:], strict=False)]}


def test_features_are_words_pairs_and_skips():
    import pyarrow as pa

    texts = ["a b c", "A-B  c", "", None, "b a c", "a b", "x y x y x y"]
    got = toxicity.per_document(pa.array(texts))
    for i, a in enumerate(texts):
        assert len(got[i]) // 4 == len(plain_coordinates(a or ""))
        for j, b in enumerate(texts):
            shared = set(np.frombuffer(got[i], "<u4")) & set(np.frombuffer(got[j], "<u4"))
            assert len(shared) == len(plain_coordinates(a or "") & plain_coordinates(b or ""))


def test_ftrl_against_plain_arithmetic():
    rng = random.Random(4)
    model, z, n = toxicity.Ftrl(), defaultdict(float), defaultdict(float)
    bias = 1 << toxicity.BITS

    def weight(i):
        small = 0 if i == bias else toxicity.L1
        if abs(z[i]) <= small:
            return 0.0
        return -(z[i] - (small if z[i] > 0 else -small)) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(300):
        label = rng.randrange(2)
        at = sorted({rng.randrange(5) + 10 * label * (rng.random() < 0.8) for _ in range(4)})
        w = {i: weight(i) for i in [*at, bias]}
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i in w:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * w[i]
            n[i] += g * g
        model.learn(np.array(at), label)
    every = np.array(sorted(z))
    assert np.allclose(model.weights(every), [weight(i) for i in every]) and np.count_nonzero(model.weights(every)) > 5


def test_toxicity_of_odd_rows(spark):
    docs, rows = corpus.documents(spark, 3, 12)
    docs = docs.withColumn("toxicity", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(0, 1), (None, 1), (3, None), (4, 7), (10**6, 1)], "doc_id long, label int")
    out = toxicity.score_texts(docs, toxicity.learn_weights(docs, labels))
    assert out.columns == docs.columns and out.count() == len(rows)
    for doc_id, text in [(0, None)]:
        same = [r["toxicity"] for r in out.where(f"doc_id = {doc_id}").collect()]
        assert len(same) == 3 and len(set(same)) == 1
    none = {r["toxicity"] for r in out.where("text is null or text = ''").collect()}
    assert len(none) == 1 and 0 <= none.pop()["score"] <= 1
    blank = toxicity.learn_weights(docs, labels.where("false"))
    assert {r["toxicity"]["score"] for r in toxicity.score_texts(docs, blank).collect()} == {0.5}
    empty = corpus.nothing(spark)
    assert toxicity.score_texts(empty, toxicity.learn_weights(empty, labels)).count() == 0
    few = toxicity.learn_weights(docs, labels, sample_rows=2)
    assert len(few.at) <= 1 << toxicity.BITS


# --- spelling --------------------------------------------------------------------------------------------------------


def plain_vocabulary(rows):
    counts = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(vocab, factor=10):
    near = {w: [x for x in vocab if one_edit(w, x)] for w in vocab}
    form = {}
    for w, n in vocab.items():
        best = min(near[w], key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= factor * n else None
    out = {}
    for w, n in vocab.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), vocab[form[w]] if form[w] else None)
    return out


def spelled(rng):
    base = ["worthless", "pathetic", "être-été", "Éléphant", "straße", "grüßen", "recherche", "aaaaaaaa", "naïveté", "ÀÉÎÕÜßÿ", "disgusting", "possible"]
    words = []
    for w in base:
        words += [w] * rng.choice([3, 40, 500])
        for _ in range(6):
            i, c = rng.randrange(len(w)), rng.choice("abcéüxÿ")
            words += [rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])] * rng.choice([1, 2, 5, 30])
    rng.shuffle(words)
    return words


@pytest.mark.parametrize("slice_bytes", [spelling.SLICE_BYTES, 128])
def test_spelling_variants(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(spelling, "SLICE_BYTES", slice_bytes)  # several slices a length, several passes
    monkeypatch.setattr(spelling, "PASS_BYTES", 4 * slice_bytes)
    rng = random.Random(8)
    words = spelled(rng)
    docs, rows = corpus.documents(spark, 6, 25)
    extra = [(10_000 + i, " ".join(words[i * 50 : i * 50 + 50])) for i in range(-(-len(words) // 50))]
    rows = [(r[0], r[1]) for r in rows] + extra
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    vocab = spelling.vocabulary(table)
    expected = plain_vocabulary(rows)
    assert {r["word"]: r["n"] for r in vocab.collect()} == expected
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(vocab).collect()}
    assert got == plain_variants(expected)
    assert sum(v[0] is not None for v in got.values()) > 10


def test_forms_are_followed_to_the_last(spark):
    chain = [("aaaaaaa", 2), ("aaaaaab", 20), ("aaaaabb", 200), ("aaaabbb", 2000), ("aaabbbb", 20_000), ("aabbbbb", 200_000), ("zzzzzzz", 5)]
    got = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert got == {w: "aabbbbb" for w, _ in chain[:6]} | {"zzzzzzz": "zzzzzzz"}


def test_ties_and_empty_vocabulary(spark):
    rows = [("xaaaaaa", 10), ("baaaaaa", 10), ("aaaaaaa", 1), ("aaaaaa", 9)]
    got = {r["word"]: tuple(r)[1:] for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got["aaaaaaa"] == ("baaaaaa", "baaaaaa", 1, 3, 10) and got["aaaaaa"] == (None, "aaaaaa", 9, 3, None)
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    assert spelling.vocabulary(corpus.nothing(spark)).count() == 0


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_toxicity", "op13_spelling_variants"])
def test_new_queries_on_the_given_tables(spark, name):
    out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert len(rows) > 20
    if name == "op12_toxicity":
        assert len(rows) == 200 and {r["predicted"] for r in rows} <= {0, 1}
    if name == "op13_spelling_variants":
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
        assert {r["word"]: r["n"] for r in rows} == plain_vocabulary([tuple(r) for r in docs])


# --- language --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text,letters", [("½ ²", False), ("① ٣ 12", False), ("", False), ("_", False), ("½ a", True), ("日", True), ("ª", True)])
def test_what_counts_as_a_letter(text, letters):
    from leafmart.llm import language

    model = language.Classifier({"en": b"the of and to in is", "de": b"der die das und ist"})
    lang, score, rejected = model.predict(text)
    assert (lang != "und") == letters and (letters or (score, rejected) == (0.0, True))


def test_smallest_encoding_is_chosen():
    """The choice against plain compression of the same blocks, one dictionary after another."""
    import zstandard

    from leafmart.llm import language

    rng = random.Random(6)
    held = {lang: language.normal(" ".join(corpus.prose(rng, lang, 300) for _ in range(20))) for lang in ("de", "en", "fr")}
    model = language.Classifier(held)
    for i in range(60):
        text = corpus.prose(rng, ["en", "fr", "de"][i % 3], rng.choice([3, 20, 150, 2500]))
        data, sizes = language.normal(text), {}
        for lang, raw in held.items():
            shared = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            coder = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(coder.compress(data[a : a + language.BLOCK_BYTES])) for a in range(0, len(data), language.BLOCK_BYTES))
        best, second = sorted(sizes.items(), key=lambda x: (x[1], x[0]))[:2]
        lang, score, rejected = model.predict(text)
        assert lang == best[0] and rejected == ((second[1] - best[1]) / second[1] < language.MARGIN) and 0.5 <= score <= 1


def test_sets_of_large_batches_take_little_memory():
    """The arrays of a step follow SET_BYTES, not the batch."""
    rng = random.Random(3)
    column = pa.array([" ".join(rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(400)) for _ in range(1500)])
    tracemalloc.start()
    jaccard.features(column, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20


def test_refinement_ends_at_the_length(monkeypatch):
    """Strings of a length are told apart without sorting blocks further than that, whatever they have in common."""
    depths, refine = [], suffix_dedup.refine

    def noted(keys, depth=None, step=1):
        depths.append(depth)
        return refine(keys, depth, step)

    monkeypatch.setattr(suffix_dedup, "refine", noted)
    rng = random.Random(8)
    for length in (1, 3, 7, 8, 9, 12, 16, 31, 40):
        blocks = [bytes(rng.choices(b"abc", [8, 8, 1], k=rng.randrange(length, 5 * length))) for _ in range(6)] + [b"a" * 4 * length]
        blocks.append(blocks[0])
        count = Counter(b[i : i + length] for b in blocks for i in range(len(b) - length + 1))
        want = [[i for i in range(len(b) - length + 1) if count[b[i : i + length]] > 1] for b in blocks]
        assert [f.tolist() for f in suffix_dedup.repeated_starts(blocks, length)] == want
        assert depths[-1] is not None and depths[-1] <= length
