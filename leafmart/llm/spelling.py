"""Spelling variants by edits probed against Bloom filters of the vocabulary (operator 13)."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmart.llm.common import LOWER, SHARD_BYTES, SpanHash, bounded_batches, mix, shards, staged, words

#: Code points of a word as bytes of Latin-1: A-Z, a-z and U+00C0 to U+00FF.
LATIN = np.zeros(256, bool)
LATIN[65:91] = LATIN[97:123] = LATIN[192:256] = True

#: Bits of filter for each word, bits set for a word, and bytes of one filter slice and of all slices broadcast at once.
BITS_PER_WORD, BITS_SET = 24, 5
SLICE_BYTES, PASS_BYTES = 4 << 20, 16 << 20
#: Edits held at once in a task.
EDITS = 1 << 19

_VALUE = np.random.default_rng(20240613).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWER = np.array([pow(_BASE, i, 1 << 64) for i in range(256)], np.uint64)
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c


def powers(n: int) -> np.ndarray:
    """Powers of the hash base; words beyond 256 code points are rare and make their own."""
    return _POWER if n <= len(_POWER) else np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, _BASE, np.uint64))), dtype=np.uint64)


# --- words of the corpus ---------------------------------------------------------------------------------------------


def corrupted(starts: np.ndarray, lengths: np.ndarray, data: np.ndarray, docs: np.ndarray, ids: list) -> np.ndarray:
    """For each run the place of the code point to delete, -1 if none: by the crc32 of `<doc_id>:<run>` in UTF-8. Null ids read `null`."""
    prefix = np.array([zlib.crc32(f"{'null' if i is None else i}:".encode()) for i in ids], np.uint32)
    crc = ~prefix[docs]
    order = np.argsort(-lengths, kind="stable")
    size = -lengths[order]
    for at in range(int(lengths.max()) if len(lengths) else 0):
        live = order[: np.searchsorted(size, -at, side="left")]
        code = data[starts[live] + at]
        wide = code >= 128
        lead = np.where(wide, 0xC0 | (code >> 6), code).astype(np.uint32)
        state = crc[live]
        state = _CRC[(state ^ lead) & 255] ^ (state >> 8)
        second = np.flatnonzero(wide)
        tail = (0x80 | (code[second] & 63)).astype(np.uint32)
        state[second] = _CRC[(state[second] ^ tail) & 255] ^ (state[second] >> 8)
        crc[live] = state
    h = (~crc).astype(np.int64)
    return np.where(h % 31 == 0, h % np.maximum(lengths, 1), -1)


def latin_bytes(texts: list[str | None]) -> list[bytes]:
    """One byte a code point; code points beyond U+00FF become a blank, which is no letter."""
    return [(t or "").encode("latin-1", "replace").replace(b"?", b" ") for t in texts]


def run_counts(texts: list[str | None], ids: list, least: int) -> tuple[list[str], np.ndarray]:
    """Distinct words of a few texts after the deletions, and their occurrences; words under `least` code points are left out."""
    column = pa.array(latin_bytes(texts), pa.binary())
    out_words: list[str] = []
    out_counts: list[np.ndarray] = []
    for shard in shards(column):
        data = LOWER[shard.data]
        starts, ends = words(data, LATIN)
        long = ends - starts >= least
        starts, ends = starts[long], ends[long]
        if len(starts) == 0:
            continue
        docs = shard.doc_of(starts)
        marks = SpanHash.of_bytes(data).of(starts, ends)
        # once for each run of a document
        order = np.lexsort((marks, docs))
        new = np.ones(len(order), bool)
        new[1:] = (marks[order][1:] != marks[order][:-1]) | (docs[order][1:] != docs[order][:-1])
        first = order[new]
        times = np.diff(np.append(np.flatnonzero(new), len(order)))
        starts, lengths = starts[first], (ends - starts)[first]
        gone = corrupted(starts, lengths, data, docs[first] + shard.first, ids)
        kept = lengths - (gone >= 0) >= least
        starts, lengths, gone, times, marks = starts[kept], lengths[kept], gone[kept], times[kept], marks[first][kept]
        whole = np.flatnonzero(gone < 0)
        _, one, group = np.unique(marks[whole], return_index=True, return_inverse=True)
        raw = data.tobytes()
        out_words += [raw[starts[whole[i]] : starts[whole[i]] + lengths[whole[i]]].decode("latin-1") for i in one]
        out_counts.append(np.bincount(group, weights=times[whole], minlength=len(one)).astype(np.int64))
        cut = np.flatnonzero(gone >= 0)
        out_words += [(raw[starts[i] : starts[i] + gone[i]] + raw[starts[i] + gone[i] + 1 : starts[i] + lengths[i]]).decode("latin-1") for i in cut]
        out_counts.append(times[cut])
    return out_words, np.concatenate(out_counts) if out_counts else np.zeros(0, np.int64)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, least_n: int = 2) -> DataFrame:
    """(word, n): all runs `[A-Za-z\\u00C0-\\u00FF]+` of whole texts in lower-cased A-Z, with one code point deleted where the crc32 of
    id and run asks for it, that have at least `least` code points and occur `least_n` times. Null texts have no words."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts = run_counts(batch.column(1).to_pylist(), batch.column(0).to_pylist(), least)
            for at in range(0, len(names), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(names[at : at + (1 << 18)], pa.string()), pa.array(counts[at : at + (1 << 18)], pa.int64())], ["word", "n"])

    counted = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


# --- filters ---------------------------------------------------------------------------------------------------------


def letters(column: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of words of one length, and their code points as a matrix."""
    sizes = np.fromiter((len(w) for w in column), np.int64, len(column))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, np.frombuffer("".join(column[i] for i in rows).encode("latin-1"), np.uint8).reshape(len(rows), size)


def hashes(codes: np.ndarray) -> np.ndarray:
    return (_VALUE[codes] * powers(codes.shape[1])[: codes.shape[1]]).sum(axis=1, dtype=np.uint64)


def place(raw: np.ndarray, slices: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slice, block of 64 bits in it and the bits to set there, of hashes."""
    spread = mix(raw)
    low = spread & np.uint64(0xFFFFFFFF)
    high = spread >> np.uint64(32)
    where = (high * np.uint64(slices * blocks)) >> np.uint64(32)
    bits = np.zeros(len(raw), np.uint64)
    for i in range(BITS_SET):
        bits |= np.uint64(1) << ((low >> np.uint64(6 * i)) & np.uint64(63))
    return where // np.uint64(blocks), where % np.uint64(blocks), bits


def shape(count: int) -> tuple[int, int]:
    """Slices of a length's filter and blocks of 64 bits in each, for `count` words."""
    blocks = max(16, -(-count * BITS_PER_WORD // 64))
    slices = -(-blocks * 8 // SLICE_BYTES)
    return slices, -(-blocks // slices)


class Filters:
    """Some slices of the filters, as one pass broadcasts them: (length, slice) to blocks."""

    def __init__(self, shapes: dict[int, tuple[int, int]], slices: dict[tuple[int, int], np.ndarray]):
        self.shapes, self.slices = shapes, slices
        self.lengths = {length for length, _ in slices}
        self.tables = {}

    def table(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """All slices of a length in one array, absent ones as zeros that let nothing pass."""
        if length not in self.tables:
            count, blocks = self.shapes[length]
            row = np.full(count, -1, np.int64)
            held = sorted(s for of, s in self.slices if of == length)
            row[held] = np.arange(len(held))
            self.tables[length] = row, np.concatenate([self.slices[length, s] for s in held])
        return self.tables[length]

    def may_hold(self, length: int, raw: np.ndarray) -> np.ndarray:
        """Whether the filter of a length knows a hash: False is certain for slices of this pass; others are left to their own pass."""
        count, blocks = self.shapes[length]
        row, table = self.table(length)
        part, block, bits = place(raw, count, blocks)
        held = row[part.astype(np.int64)]
        at = np.where(held < 0, 0, held) * blocks + block.astype(np.int64)
        return ((table[at] & bits) == bits) & (held >= 0)


def edits(codes: np.ndarray, alphabet: np.ndarray, filters: Filters) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, code point) of the edits of words of one length that pass a filter; code point -1 deletes.

    Deletions reach the words that are one shorter; a replacement takes a greater code point only. So each pair of near words is
    generated once: an insertion is the deletion of the longer word, a replacement belongs to the smaller of the two.
    """
    count, size = codes.shape
    power = powers(size + 1)
    own = _VALUE[codes] * power[:size]
    total = own.sum(axis=1, dtype=np.uint64)
    if size - 1 in filters.lengths:
        before = np.zeros(count, np.uint64)
        for i in range(size):
            after = total - before - own[:, i]
            distinct = np.ones(count, bool) if i == 0 else codes[:, i] != codes[:, i - 1]
            rows = np.flatnonzero(distinct)
            rows = rows[filters.may_hold(size - 1, (before + after * _INVERSE)[rows])]
            yield rows, np.full(len(rows), i), np.full(len(rows), -1)
            before = before + own[:, i]
    if size in filters.lengths:
        step = max(1, EDITS // len(alphabet))
        for i in range(size):
            for a in range(0, count, step):
                rank = np.searchsorted(alphabet, codes[a : a + step, i])
                times = len(alphabet) - 1 - rank
                rows = np.repeat(np.arange(a, a + len(rank)), times)
                greater = alphabet[np.arange(len(rows)) - np.repeat(np.cumsum(times) - times - rank - 1, times)]
                hit = np.flatnonzero(filters.may_hold(size, (total - own[:, i])[rows] + (_VALUE * power[i])[greater]))
                yield rows[hit], np.full(len(hit), i), greater[hit].astype(np.int64)


def filter_slices(vocab: DataFrame, shapes: dict[int, tuple[int, int]]) -> DataFrame:
    """(size, slice, block, bits): the filters as rows, made in the tasks and joined by bit_or."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes in letters(batch.column(0).to_pylist()):
                size = codes.shape[1]
                part, block, bits = place(hashes(codes), *shapes[size])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), size), pa.int32()), pa.array(part.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(bits.view(np.int64))], ["size", "slice", "block", "bits"])

    return vocab.select("word").mapInArrow(marks, "size int, slice int, block int, bits long").groupBy("size", "slice", "block").agg(F.bit_or("bits").alias("bits"))


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every pair of words that differ by one inserted, deleted or replaced code point, once; the vocabulary must be stored.

    Filters are sharded by length, and a long one by hash into slices. A pass broadcasts slices of at most PASS_BYTES (one at
    least), generates the edits of the words of their length and of the next, and stores those that pass; the vocabulary join
    afterwards keeps what is a word. Slices number with the vocabulary, a pass's broadcast does not grow.
    """
    spark = vocab.sparkSession
    per_length = {r["size"]: r["count"] for r in vocab.groupBy(F.length("word").alias("size")).count().collect()}  # a row a word length
    shapes = {size: shape(count) for size, count in per_length.items()}
    used = vocab.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).where("letter <> ''").distinct().collect()  # 90 rows at most
    alphabet = np.array(sorted(ord(r["letter"]) for r in used), np.uint8)
    slices = staged(filter_slices(vocab, shapes).repartitionByRange("size", "slice"))
    passes: list[list[tuple[int, int]]] = []
    filled = PASS_BYTES
    for size in sorted(shapes):
        for part in range(shapes[size][0]):
            need = shapes[size][1] * 8
            if filled + need > PASS_BYTES:
                passes.append([])
                filled = 0
            passes[-1].append((size, part))
            filled += need
    found = None
    for held in passes:
        wanted = F.struct("size", "slice") >= F.struct(*[F.lit(x).cast("int") for x in held[0]])
        wanted &= F.struct("size", "slice") <= F.struct(*[F.lit(x).cast("int") for x in held[-1]])
        rows = slices.where(wanted).toArrow()
        size, part, block, bits = (rows[c].to_numpy() for c in ("size", "slice", "block", "bits"))
        tables = {key: np.zeros(shapes[key[0]][1], np.uint64) for key in held}
        for key, table in tables.items():
            own = (size == key[0]) & (part == key[1])
            table[block[own]] = bits[own].view(np.uint64)
        shared = spark.sparkContext.broadcast((shapes, tables))

        def probe(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            filters = Filters(*shared.value)
            for batch in batches:
                names, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
                for rows, codes in letters(names):
                    for r, at, code in edits(codes, alphabet, filters):
                        if len(r) == 0:
                            continue
                        own = [names[rows[i]] for i in r]
                        other = [w[:i] + (chr(c) if c >= 0 else "") + w[i + 1 :] for w, i, c in zip(own, at.tolist(), code.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(counts[rows[r]]), pa.array(other, pa.string())], ["word", "n", "other"])

        lengths = sorted({s for s, _ in held} | {s + 1 for s, _ in held})
        positives = staged(vocab.where(F.length("word").isin(lengths)).select("word", "n").mapInArrow(probe, "word string, n long, other string"))
        shared.destroy()
        found = positives if found is None else found.unionByName(positives)
    if found is None:
        return spark.createDataFrame([], "word string, n long, other string, other_n long")
    return found.join(vocab.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other").select("word", "n", "other", "other_n")


def variants(vocab: DataFrame, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n), one row a word.

    Words are near if they differ by exactly one inserted, deleted or replaced code point. The form of a word is its near word of
    largest n (ties: smallest in code-point order) if that n is `factor` times the word's own or more, else null; the root follows
    the forms to the last. n grows by the factor with every step, so doubling the steps ends after a number of rounds that is the
    logarithm of the logarithm of the largest n. Words must be letters up to U+00FF; an empty vocabulary gives no rows.
    """
    vocab = staged(vocab.select("word", "n"))
    pairs = near_pairs(vocab)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    grown = -F.col("best.less") >= factor * F.col("n")
    out = staged(vocab.join(near, "word", "left").select("word", F.when(grown, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(grown, -F.col("best.less")).alias("form_n")))
    steps = out.where("form is not null").select("word", F.col("form").alias("root"))
    largest = vocab.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(1 + math.log(largest, factor))) if largest > 1 and factor > 1 else 0):
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = staged(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return out.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
