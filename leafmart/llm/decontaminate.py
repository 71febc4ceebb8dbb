"""Benchmark passages in training text by FM-indexes of shards (operator 2)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmart.llm.common import ALNUM, LOWER, SpanHash, bounded_batches, shards, unused, words
from leafmart.llm.suffixes import refine

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: Text of benchmark items that one pass searches for; more items are searched block by block.
BLOCK_BYTES = 8 << 20
#: Every so many places of the text keep their suffix position.
SAMPLE = 8


class WaveletRanks:
    """Occurrences of a symbol before a place, for many places at once: a level of zero counts for each bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.zeros, self.totals = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = symbols >> level & 1
            zeros = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit == 0, out=zeros[1:])
            self.zeros.append(zeros)
            self.totals.append(int(zeros[-1]))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        start = np.zeros_like(place)
        for level, zeros, total in zip(range(self.bits - 1, -1, -1), self.zeros, self.totals, strict=True):
            one = (symbol >> level & 1).astype(bool)
            place = np.where(one, total + place - zeros[place], zeros[place])
            start = np.where(one, total + start - zeros[start], zeros[start])
        return place - start


class FMIndex:
    """Full-text index of runs of symbols from 1 on; every run ends with a 0, which no pattern holds."""

    def __init__(self, text: np.ndarray, top: int):
        ends = np.flatnonzero(text == 0)
        keys = text + len(ends)
        keys[ends] = np.arange(len(ends))  # each end sorts by its place, so that suffixes are told apart inside their run
        order, _ = refine(keys)
        self.before = text[order - 1]
        counts = np.bincount(text, minlength=top + 2)
        self.lower = np.concatenate(([0], np.cumsum(counts)))
        self.ranks = WaveletRanks(self.before, max(1, int(top).bit_length()))
        self.sampled = (order % SAMPLE == 0) | (self.before == 0)
        self.slot = np.cumsum(self.sampled) - 1
        self.places = order[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all patterns of one length (a row each), the last symbol first."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.before), np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, j]
            low[live] = self.lower[symbol] + self.ranks.rank(symbol, low[live])
            high[live] = self.lower[symbol] + self.ranks.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if len(live) == 0:
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of suffix rows: back to the next sampled one, then forward as many symbols."""
        row, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.sampled[row[live]]
            hit = live[done]
            out[hit] = self.places[self.slot[row[hit]]] + steps[hit]
            live = live[~done]
            symbol = self.before[row[live]]
            row[live] = self.lower[symbol] + self.ranks.rank(symbol, row[live])
            steps[live] += 1
        return out


@dataclass
class Patterns:
    """Distinct windows of a block of items, by length, as numbers of the block's words."""

    hashes: np.ndarray  # of words, ascending; the number of a word is its place plus one
    by_length: list[tuple[np.ndarray, list[bytes], list[list[str]]]]  # rows of numbers, the words joined, names of items
    shortest: int

    @classmethod
    def of(cls, items: list[tuple[str, str | None]], window: int) -> Patterns:
        found: dict[tuple[bytes, ...], set[str]] = {}
        for name, text in items:
            item = WORD.findall((text or "").encode("utf-8", "replace").translate(bytes(LOWER)))
            for i in range(max(1, len(item) - window + 1) if item else 0):
                found.setdefault(tuple(item[i : i + window]), set()).add(name)
        known = sorted({w for key in found for w in key})
        hashes = hash_words(known)
        order = np.argsort(hashes)
        number = {known[j]: i + 1 for i, j in enumerate(order)}
        by_length = []
        for n in sorted({len(key) for key in found}):
            keys = sorted(key for key in found if len(key) == n)
            by_length.append((np.array([[number[w] for w in key] for key in keys], np.int64), [b" ".join(key) for key in keys], [sorted(found[key]) for key in keys]))
        return cls(hashes[order], by_length, min(map(len, found), default=0))


def hash_words(known: list[bytes]) -> np.ndarray:
    if not known:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(known), np.uint8)
    return SpanHash.of_bytes(data).of(*words(data, ALNUM))


def candidate_runs(numbers: np.ndarray, doc: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of neighbouring known words of one document, `shortest` words at least: no pattern occurs elsewhere."""
    known = numbers > 0
    joined = known[1:] & known[:-1] & (doc[1:] == doc[:-1])
    starts = np.flatnonzero(known & np.concatenate(([True], ~joined)))
    ends = np.flatnonzero(known & np.concatenate((~joined, [True]))) + 1
    long = ends - starts >= shortest
    return starts[long], ends[long]


def occurrences(patterns: Patterns, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, list[str]]]:
    """(first word, words, names of items) of every occurrence in a shard of words."""
    if len(starts) == 0 or len(patterns.hashes) == 0:
        return []
    hashes = SpanHash.of_bytes(data).of(starts, ends)
    slot = np.minimum(np.searchsorted(patterns.hashes, hashes), len(patterns.hashes) - 1)
    numbers = np.where(patterns.hashes[slot] == hashes, slot + 1, 0)
    first, last = candidate_runs(numbers, doc, patterns.shortest)
    if len(first) == 0:
        return []
    sizes = last - first
    offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
    text, word = np.zeros(offsets[-1], np.int64), np.full(offsets[-1], -1, np.int64)
    inside = np.ones(offsets[-1], bool)
    inside[offsets[1:] - 1] = False
    word[inside] = np.repeat(first - offsets[:-1], sizes) + np.flatnonzero(inside)
    text[inside] = numbers[word[inside]]
    index = FMIndex(text, len(patterns.hashes))
    out = []
    for rows, joined, names in patterns.by_length:
        low, high = index.search(rows)
        count = high - low
        which = np.repeat(np.arange(len(rows)), count)
        places = index.locate(np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(len(which)))
        n = rows.shape[1]
        for p, w in zip(word[places].tolist(), which.tolist(), strict=True):
            if b" ".join(data[starts[i] : ends[i]].tobytes() for i in range(p, p + n)) == joined[w]:  # hashes may collide
                out.append((p, n, names[w]))
    return out


SCHEMA = "struct<n_words: long, spans: array<struct<first: long, last: long, begin: long, end: long>>, items: array<string>>"


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """`docs` with a column `contamination` of (n_words, n_hit, spans, items).

    Words are runs of digits, letters a-z and bytes above ASCII after lower-casing A-Z. Windows are `window` neighbouring
    words of an item (item_id, text), or all words of a shorter one; spans are merged ranges of document words (first to last,
    counted from 0) inside occurrences, with their bytes (begin to end) in the UTF-8 text; items are the names of items with
    an occurrence, sorted as strings, a null id as "null". Null or empty texts have no words; items without words match
    nothing; repeated rows are found each; empty tables give no spans. A column named `contamination` is replaced.

    A shard is a bounded run of documents. Words unknown to the benchmark part it, which no pattern crosses; the runs that are
    long enough are indexed. Items come in blocks of bounded text, and spans of blocks are merged in the row.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))

    def finder(block: int):
        mine = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = [("null" if r[0] is None else r[0], r[1]) for r in mine.select(F.col("item_id").cast("string"), "text").collect()]
        shared = spark.sparkContext.broadcast(Patterns.of(items, window))

        @F.arrow_udf(SCHEMA)
        def find(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                counts: list[int] = []
                spans: list[list[dict]] = [[] for _ in range(len(column))]
                items: list[list[str]] = [[] for _ in range(len(column))]
                for shard in shards(column):
                    data = LOWER[shard.data]
                    starts, ends = words(data, ALNUM)
                    doc = shard.doc_of(starts)
                    counts += np.bincount(doc, minlength=shard.last - shard.first).tolist()
                    first_word = np.searchsorted(doc, np.arange(shard.last - shard.first))
                    names: dict[int, set[str]] = {}
                    covered = np.zeros(len(starts) + 1, np.int64)
                    for p, n, found in occurrences(shared.value, data, starts, ends, doc):
                        covered[p] += 1
                        covered[p + n] -= 1
                        names.setdefault(int(doc[p]), set()).update(found)
                    hit = np.cumsum(covered[:-1]) > 0
                    if not names:
                        continue
                    edge = hit[1:] & hit[:-1] & (doc[1:] == doc[:-1])
                    for a, b in zip(np.flatnonzero(hit & np.concatenate(([True], ~edge))).tolist(), np.flatnonzero(hit & np.concatenate((~edge, [True]))).tolist(), strict=True):
                        d = int(doc[a])
                        spans[shard.first + d].append(
                            {"first": a - int(first_word[d]), "last": b - int(first_word[d]), "begin": int(starts[a] - shard.starts[d]), "end": int(ends[b] - shard.starts[d])}
                        )
                    for d, found in names.items():
                        items[shard.first + d] = sorted(found)
                parts = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "last", "begin", "end")]))), pa.array(items, pa.list_(pa.string()))]
                yield pa.StructArray.from_arrays(parts, ["n_words", "spans", "items"])

        return find(F.col(text_col))

    docs = docs.drop("contamination")
    (more,) = unused(docs, "_more")
    found = docs.withColumn("contamination", finder(0))
    for b in range(1, blocks):
        found = found.withColumn(more, finder(b)).withColumn(
            "contamination",
            F.struct(
                F.col("contamination.n_words").alias("n_words"),
                merged(F.concat("contamination.spans", f"{more}.spans")).alias("spans"),
                F.array_sort(F.array_union("contamination.items", f"{more}.items")).alias("items"),
            ),
        ).drop(more)
    hit = F.aggregate("contamination.spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.withColumn("contamination", F.col("contamination").withField("n_hit", hit))


def merged(spans: F.Column) -> F.Column:
    """Overlapping or touching spans as one, in the order of their first words."""

    def add(done: F.Column, s: F.Column) -> F.Column:
        top = F.element_at(done, -1)
        joined = F.struct(top["first"].alias("first"), F.greatest(top["last"], s["last"]).alias("last"), top["begin"].alias("begin"), F.greatest(top["end"], s["end"]).alias("end"))
        return F.when(F.size(done) == 0, F.array(s)).when(s["first"] <= top["last"] + 1, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), F.expr("cast(array() as array<struct<first: long, last: long, begin: long, end: long>>)"), add)


def cut_passages(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The text without the bytes of its spans; the text itself where nothing was found."""

    @F.arrow_udf("string")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(text.to_pylist(), spans.to_pylist(), strict=True):
            if t and found:
                raw, at, kept = t.encode(), 0, []
                for s in found:
                    kept.append(raw[at : s["begin"]])
                    at = s["end"]
                t = b"".join([*kept, raw[at:]]).decode("utf-8", "replace")
            out.append(t)
        return pa.array(out, pa.string())

    return found.withColumn(text_col, cut(F.col(text_col), F.col("contamination.spans")))
