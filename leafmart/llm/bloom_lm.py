"""Text scores by a log-frequency Bloom filter of n-gram counts (operator 7)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmart.llm.common import LOWER, NONSPACE, SpanHash, bounded_batches, mix, shards, staged, unused, words

#: Documents of the sample of training rows that names frequent words and pairs of them, and how many of each. What is on a
#: list is counted inside tasks and broadcast with its count; all others meet their counts by a shuffle. A list is a shortcut
#: for counting only: words and pairs have the same counts without it, but for false hits of the filter.
SAMPLE_DOCS, FREQUENT, FREQUENT_PAIRS = 4_000, 1 << 16, 1 << 18
#: The least block of the filter in bits, and the levels it holds. The number of blocks follows the training tokens, and a block
#: with more levels has more bits, so nothing is dropped; a task holds one block at a time.
BLOCK_BITS, BLOCK_LEVELS = 1 << 16, (1 << 16) // 12
PROBES = 3
#: Pseudo-count of the unigram distribution behind each history.
SMOOTHING = 200.0
END = np.uint64(0x1F83D9ABFB41BD6B)
PAIR = np.uint64(0x9E3779B97F4A7C15)


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, hashes, document of each) for runs of documents: words, then an end for each document."""
    for shard in shards(column):
        data = LOWER[shard.data]
        starts, ends = words(data, NONSPACE)
        n = shard.last - shard.first
        doc = np.concatenate((shard.doc_of(starts), np.arange(n)))
        order = np.argsort(doc, kind="stable")  # the end comes after the words
        yield shard.first, shard.last, np.concatenate((SpanHash.of_bytes(data).of(starts, ends), np.full(n, END)))[order], doc[order]


def summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(hashes)), bool), hashes[1:] != hashes[:-1])))
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def member(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in an ascending table, and whether it is there."""
    if len(table) == 0:
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    slot = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    return slot, table[slot] == hashes


def level(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2(count)): a count is kept by as many entries."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def value(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for, 0 without any."""
    return np.where(levels == 0, 0.0, np.where(levels == 1, 1.0, 1.5 * np.exp2(levels - 1.0)))


def pairs(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token with the one before it, and whether both are of one document."""
    before = np.concatenate((hashes[:1], hashes[:-1]))
    same = np.concatenate((np.zeros(min(1, len(doc)), bool), doc[1:] == doc[:-1]))
    return mix(before * PAIR + hashes + np.uint64(1)), same


def positions(hashes: np.ndarray, j: int | np.ndarray, size: int) -> list[np.ndarray]:
    """Bits inside a block of `size` bits that stand for level j; up to 2**21 bits are told apart."""
    y = mix(hashes * np.uint64(0xD1342543DE82EF95) + np.asarray(j).astype(np.uint64))
    return [(y >> np.uint64(21 * i) & np.uint64(size - 1)).astype(np.int64) for i in range(PROBES)]


def block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(hashes) >> np.uint64(33) & np.uint64(blocks - 1)).astype(np.int64)


def build_block(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits of all n-grams of a block: a power of two, BLOCK_BITS at least, with the share of bits a level that BLOCK_LEVELS asks."""
    levels = level(counts)
    size = BLOCK_BITS
    while size * BLOCK_LEVELS < int(levels.sum()) * BLOCK_BITS:
        size *= 2
    bits = np.zeros(size, bool)
    for j in range(1, int(levels.max(initial=0)) + 1):
        for p in positions(hashes[levels >= j], j, size):
            bits[p] = True
    return np.packbits(bits, bitorder="little")


class Filter:
    def __init__(self, data: np.ndarray, blocks: int):
        self.data, self.blocks = data, blocks

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Counts as far as levels tell: probes go on from level 1 until one is missing."""
        size = len(self.data) * 8 // self.blocks
        base = block_of(hashes, self.blocks) * size
        found = np.zeros(len(hashes), np.int64)
        live = np.arange(len(hashes))
        j = 1
        while len(live) and j < 63:
            there = np.ones(len(live), bool)
            for p in positions(hashes[live], j, size):
                at = base[live] + p
                there &= (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            live = live[there]
            found[live] = j
            j += 1
        return value(found)


def frequent_grams(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of words and of pairs of these words that are most frequent in a sample of SAMPLE_DOCS rows; the end
    is a word."""
    total = docs.count()
    some = (docs if total <= SAMPLE_DOCS else docs.sample(SAMPLE_DOCS / total, seed=11)).select("text")

    def top(grams: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int) -> np.ndarray:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for batch in batches:
                for _, _, hashes, doc in tokens(batch.column(0)):
                    found = grams(hashes, doc)
                    h, c = summed(np.concatenate((h, found)), np.concatenate((c, np.ones(len(found), np.int64))))
            first = np.argsort(-c, kind="stable")[: 2 * most]
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(c[first])], ["h", "n"])

        found = some.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(most)
        return found.toArrow()["h"].to_numpy().astype(np.int64).view(np.uint64)

    frequent = np.unique(np.concatenate((top(lambda hashes, doc: hashes, FREQUENT - 1), [END])))

    def inner(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
        common = member(frequent, hashes)[1]
        pair, inside = pairs(hashes, doc)
        inside[1:] &= common[1:] & common[:-1]
        return pair[inside]

    return frequent, np.sort(top(inner, FREQUENT_PAIRS))


class Model:
    """Counts of all training tokens, of listed words and of listed pairs; `seen` has the other words of each document."""

    def __init__(self, seen: DataFrame, words: tuple[np.ndarray, np.ndarray], listed: tuple[np.ndarray, np.ndarray], total: int, distinct: int):
        self.seen, self.words, self.listed, self.total, self.distinct = seen, words, listed, total, distinct


def train(docs: DataFrame, train_col: str) -> Model:
    """Counts over all rows of `docs` (doc_id, text, a boolean `train_col`); only rows where it is true are learned from.

    A task sums up the counts of listed words and pairs. Other words go to the shuffle as (word, document, times), where a
    window over the word finds its count; this table is kept in `seen` for the scores.
    """
    spark = docs.sparkSession
    frequent, listed = frequent_grams(docs.where(F.col(train_col)))
    lists = spark.sparkContext.broadcast((frequent, listed))

    def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "pair", "doc_id", "mark", "times"]
        known = lists.value
        for batch in batches:
            ids, marks, learn = batch.column(0), batch.column(1), batch.column(3).to_numpy(zero_copy_only=False)
            totals = [np.zeros(len(table), np.int64) for table in known]
            for first, _, hashes, doc in tokens(batch.column(2)):
                taught = learn[first + doc]
                slot, common = member(known[0], hashes)
                totals[0] += np.bincount(slot[common & taught], minlength=len(known[0]))
                pair, inside = pairs(hashes, doc)
                place, there = member(known[1], pair)
                totals[1] += np.bincount(place[there & inside & taught], minlength=len(known[1]))
                h, d = hashes[~common], doc[~common]
                order = np.lexsort((h, d))
                h, d = h[order], d[order]
                new = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (d[1:] != d[:-1]))))
                times = np.diff(np.append(new, len(h)))
                at = first + d[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[new].view(np.int64)), pa.array(np.zeros(len(new), bool)), ids.take(pa.array(at)), marks.take(pa.array(at)), pa.array(np.where(learn[at], times, -times))], names
                )
            for is_pair, (table, total) in enumerate(zip(known, totals, strict=True)):
                used = np.flatnonzero(total)
                none = pa.nulls(len(used))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(table[used].view(np.int64)), pa.array(np.full(len(used), bool(is_pair))), none.cast(pa.int64()), none.cast(pa.int32()), pa.array(total[used])], names
                )

    rows = docs.select("doc_id", "mark", "text", F.col(train_col).alias("learn")).mapInArrow(word_rows, "h long, pair boolean, doc_id long, mark int, times long")
    same = Window.partitionBy("h", "pair")
    lead = F.row_number().over(same.orderBy("doc_id")) == 1
    counted = rows.withColumn("c", F.sum(F.greatest("times", F.lit(0))).over(same)).withColumn("lead", lead)
    seen = staged(counted.where((F.col("mark").isNotNull() | F.col("lead")) & (F.col("c") > 0)))
    learned = seen.where(F.col("lead") & ~F.col("pair"))
    total, distinct = learned.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    def counts(table: np.ndarray, rows: DataFrame) -> np.ndarray:
        out = np.zeros(len(table), np.int64)
        got = rows.select("h", "c").toArrow()
        out[np.searchsorted(table, got["h"].to_numpy().view(np.uint64))] = got["c"].to_numpy()
        return out

    # the lists bound what is fetched: only listed words and pairs have rows without a document
    both = seen.where(F.col("lead") & F.col("mark").isNull())
    return Model(seen, (frequent, counts(frequent, both.where(~F.col("pair")))), (listed, counts(listed, both.where(F.col("pair")))), int(total), int(distinct))


def chances(pair: np.ndarray, history: np.ndarray, alone: np.ndarray, every: float) -> np.ndarray:
    """Logarithms of the probabilities of tokens, by the levels of the pair, of the word before (0: none) and of the word."""
    chance = (value(alone) + 0.5) / every
    before = value(history)
    return np.log10(np.minimum((np.minimum(pair, before) + SMOOTHING * chance) / (before + SMOOTHING), 1.0))


GRAMS = "block int, h long, doc_id long, mark int, times int, near double, known int, logs double"
NAMES = [field.split()[0] for field in GRAMS.split(", ")]


def blocks_for(total: int) -> int:
    """A power of two that grows with the training tokens, without a ceiling."""
    return 1 << max(0, math.ceil(math.log2(max(1, total / 4 / BLOCK_LEVELS))))


def score_texts(docs: DataFrame, train_col: str) -> DataFrame:
    """`docs` (doc_id long, text, a boolean `train_col`) with a column `lm` of (n_tokens, n_known, train_tokens, base_score, score).

    base_score is the exact unigram score with half a count added to each of the distinct training tokens and one unknown;
    score is the base-10 logarithm of the probability by the levels of counts: the count of each pair of neighbours by repeated
    probes of the filter, smoothed by the word's own count. Null and empty texts are one end; rows that agree in doc_id and
    text are scored alike; without training rows all tokens are unknown; an empty table stays empty; `lm` is replaced.

    Tokens are told apart by 64-bit hashes. Documents meet the counts of their words first; then all pairs that are not on the
    list go to the blocks of the filter, those of training rows to fill them and all to probe. No pair is left out: a pair
    with a word that training rows lack has no count.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop("lm")
    mark, same_doc, same_text, part = unused(docs, "_mark", "_doc", "_hash", "_lm")
    marked = docs.withColumn(mark, F.hash("text"))
    plain = marked.select("doc_id", F.col(mark).alias("mark"), "text", F.coalesce(F.col(train_col), F.lit(False)).alias("learn"))
    model = train(plain, "learn")
    every = model.total + 0.5 * (model.distinct + 1)
    blocks = blocks_for(model.total)
    shared = spark.sparkContext.broadcast((model.words, model.listed))

    def gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document with its sums so far (times is 0, h its tokens), and one a pair of it whose count is to be found."""
        (frequent, counts), (listed, pair_counts) = shared.value
        pair_values = value(level(pair_counts))
        for batch in batches:
            ids, marks, learn, rare = batch.column(0), batch.column(1), batch.column(3).to_numpy(zero_copy_only=False), batch.column(4)
            for first, last, hashes, doc in tokens(batch.column(2)):
                n = last - first
                slot, common = member(frequent, hashes)
                count = np.where(common, counts[slot], 0)
                fields = rare.slice(first, n).flatten().flatten()
                h, at = np.unique(fields[0].to_numpy(zero_copy_only=False).view(np.uint64), return_index=True)
                slot, there = member(h, hashes[~common])
                if len(h):
                    count[~common] = np.where(there, fields[1].to_numpy(zero_copy_only=False)[at][slot], 0)
                alone = level(count)
                pair, inside = pairs(hashes, doc)
                history = np.where(inside, np.concatenate((alone[:1], alone[:-1])), 0)
                slot, there = member(listed, pair)
                found = np.where(there & inside, pair_values[slot], 0.0) if len(listed) else np.zeros(len(pair))
                asked = inside & ~there & (history > 0) & (alone > 0)
                score = np.where(asked, 0.0, chances(found, history, alone, every))
                row = pa.array(np.arange(first, last))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block_of(np.arange(n, dtype=np.uint64) + hashes[:1], blocks).astype(np.int32)), pa.array(np.bincount(doc, minlength=n).astype(np.int64)), ids.take(row), marks.take(row),
                        pa.array(np.zeros(n, np.int32)), pa.array(np.bincount(doc, score, minlength=n)), pa.array(np.bincount(doc, count > 0, minlength=n).astype(np.int32)),
                        pa.array(np.bincount(doc, np.log10(count + 0.5), minlength=n)),
                    ], NAMES,
                )
                pair, d, near = pair[asked], doc[asked], history[asked] * 64 + alone[asked]
                order = np.lexsort((pair, d))
                pair, d, near = pair[order], d[order], near[order]
                new = np.flatnonzero(np.concatenate((np.ones(min(1, len(d)), bool), (pair[1:] != pair[:-1]) | (d[1:] != d[:-1]))))
                times = np.diff(np.append(new, len(d)))
                pair, row = pair[new], first + d[new]
                none = pa.nulls(len(new))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block_of(pair, blocks).astype(np.int32)), pa.array(pair.view(np.int64)), ids.take(pa.array(row)), marks.take(pa.array(row)),
                        pa.array(np.where(learn[row], times, -times).astype(np.int32)), pa.array(near[new].astype(np.float64)), none.cast(pa.int32()), none.cast(pa.float64()),
                    ], NAMES,
                )

    def probe_block(rows: pa.Table) -> pa.Table:
        """The filter of a block from the pairs of training rows, and the scores of all of its pairs."""
        h, times, score = rows["h"].to_numpy().view(np.uint64), rows["times"].to_numpy().astype(np.int64), rows["near"].to_numpy().copy()
        asked = times != 0
        bits = Filter(build_block(*summed(h[times > 0], times[times > 0])), 1)
        single, back = np.unique(h[asked], return_inverse=True)
        near = score[asked].astype(np.int64)
        score[asked] = np.abs(times[asked]) * chances(bits.counts(single)[back], near >> 6, near & 63, every)
        doc = pa.array(np.ones(len(h), np.int32), mask=asked)
        n = pa.array(h.view(np.int64), mask=asked)
        return pa.table({"doc_id": rows["doc_id"], "mark": rows["mark"], "row": doc, "n": n, "known": rows["known"], "logs": rows["logs"], "score": pa.array(score)})

    rare = model.seen.where(F.col("mark").isNotNull()).groupBy(F.col("doc_id").alias("_d"), F.col("mark").alias("_m")).agg(F.collect_set(F.struct("h", "c")).alias("words"))
    met = plain.join(rare, F.expr("doc_id <=> _d and mark = _m"), "left").select("doc_id", "mark", "text", "learn", "words")
    grams = met.mapInArrow(gram_rows, GRAMS)
    probed = grams.groupBy("block").applyInArrow(probe_block, "doc_id long, mark int, row int, n long, known int, logs double, score double")
    sums = probed.groupBy(F.col("doc_id").alias(same_doc), F.col("mark").alias(same_text)).agg(
        F.struct(
            F.max("n").alias("n_tokens"), F.max("known").cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
            (F.max("logs") - F.max("n") * F.lit(math.log10(every))).alias("base_score"), (F.sum("score") / F.count("row")).alias("score"),
        ).alias(part)
    )
    scored = marked.join(sums, F.col("doc_id").eqNullSafe(F.col(same_doc)) & (F.col(mark) == F.col(same_text)), "left")
    return scored.withColumn("lm", F.col(part)).drop(mark, part, same_doc, same_text)
