"""Repeated passages by content-defined chunks of a gear rolling hash (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmart.llm.common import SpanHash, bounded_batches, shards, staged, unused

#: The rolling hash sees so many bytes; a cut is its strict minimum among so many places on either side.
WINDOW, REACH = 32, 24
#: Runs of repeated chunks shorter than this stay, unless they are the whole text: a short common phrase is no passage.
MIN_RUN = 120

GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j for j < 32, by doubling; bytes outside of documents add nothing."""
    h = np.where(outside, np.uint32(0), GEAR[data])
    width = 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def least_before(h: np.ndarray, reach: int) -> np.ndarray:
    """Minimum of the `reach` values before each place."""
    top = np.uint32(0xFFFFFFFF)
    out, block, width, done = np.full(len(h), top), h, 1, 0
    while reach:
        if reach & 1:
            out[done + 1 :] = np.minimum(out[done + 1 :], block[: len(h) - done - 1])
            done += width
        reach >>= 1
        wider = block.copy()
        wider[width:] = np.minimum(block[width:], block[:-width])
        block, width = wider, width * 2
    return out


def chunk_ends(data: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """Places after which a chunk ends. A cut depends on the bytes around it alone, so insertions shift no other cut."""
    h = gear_hashes(data, outside)
    h[outside] = 0xFFFFFFFF
    least = np.minimum(least_before(h, REACH), least_before(h[::-1], REACH)[::-1])
    return np.flatnonzero((h < least) & ~outside) + 1


def chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each document: its number, starts and ends of its chunks, and two hashes of each."""
    for shard in shards(column, gap=WINDOW + REACH):
        outside = np.ones(len(shard.data), bool)
        for s, e in zip(shard.starts, shard.ends, strict=True):
            outside[s:e] = False
        full = shard.ends > shard.starts
        ends = np.unique(np.concatenate((chunk_ends(shard.data, outside), shard.ends[full])))
        doc = shard.doc_of(ends - 1)
        starts = np.concatenate(([0], ends[:-1]))
        first = np.concatenate(([True], doc[1:] != doc[:-1]))[: len(ends)]
        starts = np.where(first, shard.starts[doc], starts[: len(ends)])
        one, two = (SpanHash.of_bytes(shard.data, t).of(starts, ends).view(np.int64) for t in (0, 1))
        cut = np.searchsorted(doc, np.arange(shard.last - shard.first + 1))
        for d in range(shard.last - shard.first):
            a, b = cut[d], cut[d + 1]
            yield shard.first + d, starts[a:b] - shard.starts[d], ends[a:b] - shard.starts[d], one[a:b], two[a:b]


CHUNKS = "array<struct<start: long, end: long, one: long, two: long>>"
SPANS = "array<struct<start: long, end: long, first: boolean>>"
RESULT = "struct<n_bytes: long, n_repeated: long, n_removed: long, spans: array<struct<start: long, end: long>>, kept: binary>"


def chunk_lists(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        counts, parts = [], [[], [], [], []]
        for _, *values in chunks(column):
            counts.append(len(values[0]))
            for out, x in zip(parts, values, strict=True):
                out.append(x)
        flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in parts]
        offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), pa.int32())
        yield pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(flat, ["start", "end", "one", "two"]))


def runs(spans: list[tuple[int, int]], least: int, size: int) -> list[tuple[int, int]]:
    """Touching spans joined; short runs left out, but for one of all `size` bytes of the text."""
    out: list[list[int]] = []
    for a, b in spans:
        if out and out[-1][1] == a:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b - a >= min(least, size)]


def deduplicate(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """`docs` (doc_id, text, ...) with a column `repeats` of (n_bytes, n_repeated, n_removed, spans, kept).

    Texts are cut into chunks (49 bytes on average, 25 at least but for the ends of a text); a chunk is repeated when its
    128-bit digest occurs anywhere else. The first occurrence by doc_id, then by place, stays; spans are runs of at least `min_run` bytes, or of the whole text, of later ones,
    n_removed counts their bytes, kept is the rest as UTF-8 bytes (a cut may part a character). n_repeated counts the bytes of
    runs of repeated chunks, first ones included. Null or empty texts have no chunks; rows that agree in doc_id and text are
    one document and get the same answer; an empty table stays empty; a column named `repeats` is replaced.

    Chunks are counted by digest with a partial count in each task, so a chunk of a third of all documents is a row a task;
    only repeated chunks meet their documents again.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("repeats")
    mark, same_doc, same_text, found = unused(docs, "_mark", "_doc", "_hash", "_spans")
    keyed = docs.withColumn(mark, F.xxhash64("text"))
    chunk_list = F.arrow_udf(chunk_lists, CHUNKS)
    one = keyed.select("doc_id", F.col(mark).alias("_text"), "text").select("doc_id", "_text", F.explode(chunk_list("text")).alias("c")).select("doc_id", "_text", "c.*")
    counted = one.groupBy("one", "two").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "_text", "start")).alias("lead"))
    repeated = staged(counted.where(F.col("n") > 1).select("one", "two", "lead"))
    meet = one.join(repeated, ["one", "two"])
    leads = F.struct("doc_id", "_text", "start") == F.col("lead")
    spans = staged(meet.groupBy("doc_id", "_text").agg(F.array_sort(F.collect_set(F.struct("start", "end", leads.alias("first")))).alias("_spans")))

    @F.arrow_udf(RESULT)
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for raw, found in zip(text.cast(pa.binary()).to_pylist(), spans.to_pylist(), strict=True):
            raw, found = raw or b"", found or []
            gone = runs([(s["start"], s["end"]) for s in found if not s["first"]], min_run, len(raw))
            at, kept = 0, []
            for a, b in gone:
                kept.append(raw[at:a])
                at = b
            kept.append(raw[at:])
            rows.append(
                {
                    "n_bytes": len(raw), "n_repeated": sum(b - a for a, b in runs([(s["start"], s["end"]) for s in found], min_run, len(raw))), "n_removed": sum(b - a for a, b in gone),
                    "spans": [{"start": a, "end": b} for a, b in gone], "kept": b"".join(kept),
                }
            )
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.array(rows, pa.struct([("n_bytes", pa.int64()), ("n_repeated", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.binary())]))

    met = spans.select(F.col("doc_id").alias(same_doc), F.col("_text").alias(same_text), F.col("_spans").alias(found))
    joined = keyed.join(met, F.col("doc_id").eqNullSafe(F.col(same_doc)) & (F.col(mark) == F.col(same_text)), "left")
    return joined.withColumn("repeats", cut("text", found)).drop(mark, same_doc, same_text, found)
