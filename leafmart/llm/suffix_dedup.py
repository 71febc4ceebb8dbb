"""Removal of long repeated byte strings by suffix arrays of shards (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmart.llm.common import SpanHash, bounded_batches, shards, staged, unused
from leafmart.llm.suffixes import byte_keys, refine

LENGTH = 400
#: An anchor of a string is its substring of so many bytes with the least hash.
GRAM = 64
#: Blocks of one suffix array; an anchor with more different blocks spreads over several, which are merged afterwards.
SHARD_BLOCKS, SHARD_BYTES = 2_000, 2 << 20
#: No byte of UTF-8.
BREAK = 0xFF


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i : i + width] for every i where it is whole."""
    block, size = values, 1
    while 2 * size <= width:
        block = np.minimum(block[:-size], block[size:])
        size *= 2
    return np.minimum(block[: len(values) - width + 1], block[width - size : len(values) - size + 1])


def anchor_blocks(column: pa.Array, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, first, last, anchor, hash, hash) of the blocks of a column.

    All strings of `length` bytes that start from `first` to `last` in a document have the same anchor: the place of the least
    hash among their substrings of `gram` bytes, the leftmost of equal ones. Equal strings have equal anchors at equal places.
    The other hashes tell the bytes of the whole block from `first` to `last` + length.
    """
    for shard in shards(column):
        n = len(shard.data)
        if not (shard.ends - shard.starts >= length).any():
            continue
        one, two = SpanHash.of_bytes(shard.data), SpanHash.of_bytes(shard.data, 1)
        at = np.arange(n - gram + 1)
        hashes = one.of(at, at + gram)
        bits = np.uint64(int(n).bit_length())
        least = window_least((hashes >> bits << bits) | at.astype(np.uint64), length - gram + 1)
        anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        delta = np.zeros(n + 1, np.int32)
        long = shard.ends - shard.starts >= length
        delta[shard.starts[long]] += 1
        delta[shard.ends[long] - length + 1] -= 1
        start = np.flatnonzero(np.cumsum(delta[:-1]) > 0)
        a, doc = anchor[start], shard.doc_of(start)
        new = np.ones(len(start), bool)
        new[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        first, last = start[head], start[np.append(head[1:], len(start)) - 1]
        base = shard.starts[doc[head]]
        yield shard.first + doc[head], first - base, last - base, hashes[a[head]].view(np.int64), one.of(first, last + length).view(np.int64), two.of(first, last + length).view(np.int64)


def repeated_starts(blocks: list[bytes], length: int) -> list[np.ndarray]:
    """For each block, the starts of its strings of `length` bytes that also start elsewhere in the blocks.

    One suffix array over all blocks, sorted by the first `length` bytes: refinement doubles up to the last depth that is not
    above the length, and one more step by the rest of the length ends there exactly. A string is repeated when it agrees with
    a neighbour.
    """
    sizes = np.array([len(b) + 1 for b in blocks])
    data = np.frombuffer(b"".join(b + bytes([BREAK]) for b in blocks), np.uint8)
    step = 8 if length >= 8 else 1
    depth = step
    while 2 * depth <= length:
        depth *= 2
    _, rank = refine(byte_keys(data) if step == 8 else data.astype(np.uint64), depth, step)
    tail = length - depth
    start = np.arange(max(0, len(data) - length + 1))
    key = rank[start] * len(data) + rank[start + tail]
    order = np.argsort(key, kind="stable")
    shared = np.zeros(len(start), bool)
    shared[1:] = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(data), bool)
    twice[order[shared]] = True
    twice[order[np.flatnonzero(shared) - 1]] = True
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    found = [np.flatnonzero(twice[offsets[i] : offsets[i + 1]]) for i in range(len(blocks))]
    return [f[f <= len(b) - length] for f, b in zip(found, blocks, strict=True)]


def ranges(starts: np.ndarray) -> list[dict]:
    """Runs of neighbouring numbers."""
    if len(starts) == 0:
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return [{"x": int(starts[a]), "y": int(starts[b])} for a, b in zip(np.concatenate(([0], cut + 1)), np.append(cut, len(starts) - 1), strict=True)]


RANGES = pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())]))
BLOCK = "anchor long, one long, two long"


class Repeats:
    """Repeated strings of `docs` (doc_id long, text)."""

    def __init__(self, docs: DataFrame, length: int, gram: int):
        self.docs, self.length, self.gram = docs.withColumn("mark", F.xxhash64("text")), length, gram

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for doc, *values in anchor_blocks(batch.column(2), length, gram):
                    at = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, values)], ["doc_id", "mark", "first", "last", "anchor", "one", "two"])

        blocks = staged(self.docs.select("doc_id", "mark", "text").mapInArrow(rows, f"doc_id long, mark long, first long, last long, {BLOCK}"))
        # an anchor that occurs once is in no repeated string
        several = ((F.min("one") != F.max("one")) | (F.min("two") != F.max("two"))).alias("several")
        anchors = blocks.groupBy("anchor").agg(F.count("*").alias("total"), several).where("total > 1").drop("total")
        self.live = staged(blocks.join(anchors, "anchor"))
        # equal blocks are one, with how often they occur
        self.kinds = staged(self.live.groupBy("anchor", "one", "two").agg(F.first("several").alias("several"), F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "first", "last")).alias("rep")))

    def open_blocks(self) -> DataFrame:
        """anchor, one, two, shard, shards, bytes of the different blocks around an anchor, cut out of their documents."""
        kinds = self.kinds.where("several")
        counts = kinds.groupBy("anchor").agg(F.ceil(F.count("*") / SHARD_BLOCKS).alias("shards"))
        placed = kinds.join(counts, "anchor").withColumn("shard", F.pmod("one", "shards"))
        wanted = placed.groupBy("rep.doc_id", "rep.mark").agg(F.collect_list(F.struct("anchor", "one", "two", "n", "shard", "shards", "rep.first", "rep.last")).alias("blocks"))
        wanted = wanted.withColumnsRenamed({"doc_id": "_doc", "mark": "_mark"})
        texts = self.docs.join(wanted, F.expr("doc_id <=> _doc and mark = _mark")).dropDuplicates(["doc_id", "mark"])
        pieces = texts.select(F.encode("text", "utf-8").alias("raw"), F.explode("blocks").alias("b"))
        return staged(pieces.select("b.anchor", "b.one", "b.two", "b.n", "b.shard", "b.shards", F.expr(f"substring(raw, cast(b.first as int) + 1, cast(b.last - b.first as int) + {self.length})").alias("bytes")))

    def resolve(self) -> DataFrame:
        """(anchor, one, two, found) of blocks that occur once: the ranges of starts whose strings are in other blocks."""
        length = self.length
        blocks = self.open_blocks()

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows: list[dict] = []
            size, last = 0, None

            def solve() -> pa.RecordBatch:
                found = repeated_starts([r["bytes"] for r in rows], length)
                kept = [(r, f) for r, f in zip(rows, found, strict=True) if r["n"] == 1 and len(f)]
                return pa.RecordBatch.from_arrays(
                    [pa.array([r[x] for r, _ in kept], pa.int64()) for x in ("anchor", "one", "two")] + [pa.array([ranges(f) for _, f in kept], RANGES)], ["anchor", "one", "two", "found"]
                )

            for batch in batches:
                for r in batch.to_pylist():
                    group = (r["anchor"], r["shard"])
                    if size > SHARD_BYTES and group != last:
                        yield solve()
                        rows, size = [], 0
                    rows.append(r)
                    size += len(r["bytes"])
                    last = group
            if rows:
                yield solve()

        shape = f"{BLOCK}, found array<struct<x: long, y: long>>"
        own = blocks.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard").mapInArrow(search, shape)
        return staged(own.unionByName(self.merge(blocks.where("shards > 1"), shape)))

    def merge(self, blocks: DataFrame, shape: str) -> DataFrame:
        """Strings of an anchor that lie in several shards. Each shard gives its strings by hash; a range of hashes is merged in
        one place, where a shard's sorted strings are looked up in those of the others by binary search."""
        length = self.length

        def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    data = np.frombuffer(r["bytes"], np.uint8)
                    at = np.arange(len(data) - length + 1)
                    h, g = SpanHash.of_bytes(data).of(at, at + length), SpanHash.of_bytes(data, 1).of(at, at + length)
                    same = [pa.array(np.full(len(at), r[x])) for x in ("anchor", "shard", "one", "two", "n")]
                    part = (h >> np.uint64(33)).astype(np.int64) % r["shards"]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(part), pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(at)], ["anchor", "shard", "one", "two", "n", "part", "h", "g", "at"])

        def look_up(rows: pa.Table) -> pa.Table:
            h, g, shard, n = (rows[x].to_numpy() for x in ("h", "g", "shard", "n"))
            key = np.rec.fromarrays([h, g], names="h,g").astype([("h", "<i8"), ("g", "<i8")])
            keys = np.unique(key)
            place = np.searchsorted(keys, key)
            least, most = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), -1)
            np.minimum.at(least, place, shard)
            np.maximum.at(most, place, shard)
            found = (least[place] != most[place]) & (n == 1)
            return rows.filter(pa.array(found)).select(["anchor", "one", "two", "at"])

        every = blocks.select("anchor", "shard", "shards", "one", "two", "n", "bytes").mapInArrow(strings, "anchor long, shard long, one long, two long, n long, part long, h long, g long, at long")
        met = every.groupBy("anchor", "part").applyInArrow(look_up, f"{BLOCK}, at long")
        return met.groupBy("anchor", "one", "two").agg(F.array_sort(F.collect_set("at")).alias("starts")).select("anchor", "one", "two", F.transform("starts", lambda s: F.struct(s.alias("x"), s.alias("y"))).alias("found"))

    def spans(self) -> DataFrame:
        """(doc_id, mark, spans) of the bytes to remove; spans may overlap."""
        block = ["anchor", "one", "two"]
        whole = self.live.join(self.kinds.where("n > 1").select(*block), block).select("doc_id", "mark", F.col("first").alias("x"), F.col("last").alias("y"))
        part = self.live.join(self.resolve(), block).select("doc_id", "mark", "first", F.explode("found").alias("f")).select("doc_id", "mark", (F.col("first") + F.col("f.x")).alias("x"), (F.col("first") + F.col("f.y")).alias("y"))
        each = whole.unionByName(part)
        return staged(each.groupBy("doc_id", "mark").agg(F.collect_set(F.struct(F.col("x").alias("begin"), (F.col("y") + self.length).alias("end"))).alias("spans")))


RESULT = "struct<n_bytes: long, n_removed: long, spans: array<struct<begin: long, end: long>>, kept: binary>"


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """`docs` (doc_id long, text, ...) with a column `repeats` of (n_bytes, n_removed, spans, kept).

    Every byte of a UTF-8 text that lies in a string of `length` bytes which also starts elsewhere, in the same or another
    document, is removed; spans are the maximal removed runs, kept the other bytes in their order. Null is an empty text;
    shorter texts lose nothing; repeated rows are documents of their own and remove each other; overlapping repetitions count;
    an empty table stays empty; a column named `repeats` is replaced.

    A string can only be repeated where its anchor is: anchors that occur once are left out, blocks that are equal byte for
    byte are repeated as a whole, and suffix arrays decide on the blocks around an anchor that differ. Blocks meet by their
    anchor; an anchor with many different blocks is dealt over shards of bounded size, and what lies in two shards is found by
    binary search in sorted strings. Blocks and strings between shards are told apart by 128-bit hashes.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("repeats")
    work = Repeats(docs.select("doc_id", "text"), length, gram)
    same_doc, same_text, pieces, mark = unused(docs, "_doc", "_hash", "_spans", "_mark")
    found = work.spans().withColumnsRenamed({"doc_id": same_doc, "mark": same_text, "spans": pieces})

    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for raw, pieces in zip(text.cast(pa.binary()).to_pylist(), spans.to_pylist(), strict=True):
            raw, gone = raw or b"", []
            for a, b in sorted((s["begin"], s["end"]) for s in pieces or []):
                if gone and a <= gone[-1][1]:
                    gone[-1][1] = max(gone[-1][1], b)
                else:
                    gone.append([a, b])
            at, kept = 0, []
            for a, b in gone:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            rows.append({"n_bytes": len(raw), "n_removed": sum(b - a for a, b in gone), "spans": [{"begin": a, "end": b} for a, b in gone], "kept": b"".join(kept)})
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        return pa.array(rows, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.binary())]))

    marked = docs.withColumn(mark, F.xxhash64("text"))
    joined = marked.join(found, F.col("doc_id").eqNullSafe(F.col(same_doc)) & (F.col(mark) == F.col(same_text)), "left")
    return joined.withColumn("repeats", F.arrow_udf(cut, RESULT)("text", pieces)).drop(mark, same_doc, same_text, pieces)
