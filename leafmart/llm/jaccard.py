"""Exact join of texts on the Jaccard similarity of their word shingles by universe partitions (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmart.llm.common import LOWER, NONSPACE, SMALL_BATCH_BYTES, SpanHash, bounded_batches, mix, shards, staged, words
from leafmart.llm.components import components

SHINGLE = 5
#: Texts are linked from 80 of 100 on; two sets so alike differ in at most a quarter of the smaller one's size.
PERCENT, PART = 80, 4
#: Size bands start at 4, 16, 64, ...; below DELETIONS a segment is also indexed with each one element left out.
BAND, DELETIONS = 4, 64
#: Random orders in which sets under a key meet a neighbour.
ORDERS = 8
#: Size of the bit table of the elements of hollow sets, as a power of two.
HOLLOW_BITS = 22
#: Bytes of text whose sets are made in one numpy step; a step holds some 80 bytes for each.
SET_BYTES = 1 << 19
#: Distinct sets that a task remembers, so that copies are sent on once.
REMEMBERED = 4_000_000

_MULTIPLIER = np.uint64(0x2545F4914F6CDD1D)


def differences(n: np.ndarray | int) -> np.ndarray | int:
    """Most elements in which a set of n differs from a linked set of its size or above."""
    return n // PART


def band_start(n: np.ndarray) -> np.ndarray:
    """Lower end of the band of each size."""
    return BAND ** np.floor(np.log(np.maximum(n, BAND) + 0.5) / np.log(BAND)).astype(np.int64)


def segments(start: int) -> int:
    """Segments of the universe for the band that begins at `start`.

    The cost of a band is its index rows: with deletions, segments of several elements count twice and few suffice; without,
    one row a segment, about six for four differences at the band's upper end.
    """
    return {4: 6, 16: 12}.get(start, start * 3 // 2 + 40)


@cache
def used_segments(start: int) -> np.ndarray:
    """For each size from 0 to the band's end: so many first segments are indexed. It never falls with the size, so the larger
    of two sets has all segments that the smaller one counts on."""
    n, m = np.arange(BAND * start + 1, dtype=np.float64), segments(start)
    if start < DELETIONS:
        return np.full(len(n), m)
    least = n // PART + 1
    wanted = (least + 4 * np.sqrt(least) + 4) / (1 - np.exp(-np.maximum(n, 1) / m))
    wanted[: start * PERCENT // 100] = 0
    return np.minimum(m, np.ceil(np.maximum.accumulate(wanted))).astype(np.int64)


def shingle_sets(column: pa.Array, seed: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, shingles, document of each) for runs of documents; shingles are distinct 64-bit hashes, by document."""
    for shard in shards(column, SET_BYTES):
        data = LOWER[shard.data]
        starts, ends = words(data, NONSPACE)
        doc = shard.doc_of(starts)
        word = SpanHash.of_bytes(data).of(starts, ends) + np.uint64(seed) * _MULTIPLIER
        n = max(0, len(word) - SHINGLE + 1)
        whole = doc[:n] == doc[SHINGLE - 1 :] if n else np.zeros(0, bool)
        h = np.zeros(n, np.uint64)
        for i in range(SHINGLE):
            h = mix(h * _MULTIPLIER + word[i : i + n])
        h, of = h[whole], doc[:n][whole]
        count = np.bincount(doc, minlength=shard.last - shard.first)
        short = np.flatnonzero((count > 0) & (count < SHINGLE))
        if len(short):
            left = np.searchsorted(doc, short)
            extra = np.zeros(len(short), np.uint64)
            for i in range(SHINGLE - 1):
                more = i < count[short]
                extra[more] = mix(extra[more] * _MULTIPLIER + word[left[more] + i])
            h, of = np.concatenate((h, mix(extra + count[short].astype(np.uint64)))), np.concatenate((of, short))
        h, of = by_document(h, of)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
        yield shard.first, shard.last, h[new], of[new]


def by_document(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by document, then hash; one sort where the leading bits of the hashes tell them apart."""
    bits = np.uint64(max(1, int(of.max(initial=0)).bit_length()))
    lead = of.astype(np.uint64) << (np.uint64(64) - bits) | h >> bits
    order = np.argsort(lead)
    lead, x, y = lead[order], h[order], of[order]
    if ((lead[1:] == lead[:-1]) & (x[1:] != x[:-1])).any():
        order = np.lexsort((h, of))
        x, y = h[order], of[order]
    return x, y


def sums(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sum modulo 2**64 by document; `of` ascends."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    edge = np.searchsorted(of, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]


def placed(h: np.ndarray, of: np.ndarray, size: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Elements that fall into segments in use, their documents and segments, and which documents are in small bands."""
    m, used, small = np.ones(len(start), np.int64), np.zeros(len(start), np.int64), np.zeros(len(start), bool)
    for b in np.unique(start[start > 0]).tolist():
        mine = start == b
        m[mine], small[mine] = segments(b), b < DELETIONS
        used[mine] = used_segments(b)[np.minimum(size[mine], BAND * b)]
    segment = (mix(h + start[of].astype(np.uint64)) >> np.uint64(16)).astype(np.int64) % m[of]
    keep = (segment < used[of]) & (start[of] > 0)
    return h[keep], of[keep], segment[keep], small


def segment_keys(h: np.ndarray, of: np.ndarray, size: np.ndarray, start: np.ndarray, cross: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, tag) of the segments of sets under the bands that begin at `start` (0: none).

    A key names a band, a segment and its elements; for small bands there are also the keys of each segment less one element,
    none of them empty. tag = segment * 8 + weight * 2 + cross: a segment of weight w gives a key in common with every set that
    differs from it in less than w elements.
    """
    h, of, segment, small = placed(h, of, size, start)
    order = np.lexsort((segment, of))
    h, of, segment = mix(h[order] + np.uint64(77)), of[order], segment[order]
    new = np.ones(len(h), bool)
    new[1:] = (of[1:] != of[:-1]) | (segment[1:] != segment[:-1])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    total = np.add.reduceat(h, first) if len(first) else np.zeros(0, np.uint64)
    many = np.diff(np.append(first, len(h))) > 1
    salt = mix(start[of].astype(np.uint64) * np.uint64(1_000_003) + segment.astype(np.uint64))
    weight = 1 + (many & small[of[first]]) if len(first) else np.zeros(0, np.int64)
    tag = segment[first] * 8 + weight * 2 + cross
    less = (many & small[of[first]])[group] if len(first) else np.zeros(0, bool)
    keys = np.concatenate((mix(total + salt[first]), mix(total[group[less]] - h[less] + salt[less])))
    return np.concatenate((of[first], of[less])), keys, np.concatenate((tag, tag[group[less]]))


def bands(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each set's band, and of the next one where a larger linked set can be there; 0: none. Sets of less than four
    elements are linked with equal ones only."""
    own = np.where(size >= BAND, band_start(size), 0)
    above = own * BAND
    return own, np.where((own > 0) & (size * 100 >= above * PERCENT), above, 0)


def index_rows(h: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.bincount(of, minlength=n)
    own, above = bands(size)
    parts = [segment_keys(h, of, size, own, 0), segment_keys(h, of, size, above, 1)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def weights(h: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the weights of a set's segments in its own band and in the next one (-1: not there)."""
    size = np.bincount(of, minlength=n)
    out = []
    for start in bands(size):
        _, doc, segment, small = placed(h, of, size, start)
        once, times = np.unique(doc << 32 | segment, return_counts=True)
        weight = 1 + ((times > 1) & small[once >> 32])
        out.append(np.where(start > 0, np.bincount(once >> 32, weight.astype(float), minlength=n).astype(np.int64), -1))
    return out[0], out[1]


FEATURES = "struct<n: long, node: long, check: long, own: long, above: long, parts: binary, steps: array<long>>"
#: Parts of the universe whose element counts are kept with a node.
PARTS = 256


def part_counts(h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Elements of each set in each part of the universe, up to 255."""
    part = (mix(h + np.uint64(5)) >> np.uint64(56)).astype(np.int64)
    return np.minimum(np.bincount(of * PARTS + part, minlength=n * PARTS), 255).astype(np.uint8).reshape(n, PARTS)


def unary(counts: np.ndarray) -> np.ndarray:
    """Counts up to two as so many bits, 32 parts in a number: different bits are a lower bound of different elements."""
    bits = ((1 << np.minimum(counts, 2)) - 1).astype(np.uint8)
    return (bits[:, 0::4] | bits[:, 1::4] << 2 | bits[:, 2::4] << 4 | bits[:, 3::4] << 6).reshape(-1).view(np.int64)


def steps_apart(one: str, two: str) -> F.Column:
    return sum((F.bit_count(F.get(one, F.lit(i)).bitwiseXOR(F.get(two, F.lit(i)))) for i in range(PARTS // 32)), F.lit(0))


def may_be_linked(n_u: pa.Array, n_v: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    """False where the counts of the parts alone differ by more than two linked sets do."""
    a, b = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int16) for x in (one, two))
    total = n_u.to_numpy(zero_copy_only=False) + n_v.to_numpy(zero_copy_only=False)
    apart = np.abs(a - b).sum(axis=1, dtype=np.int64)
    return pa.array((100 + PERCENT) * apart <= (100 - PERCENT) * total)



def features(column: pa.Array, seed: int) -> pa.Array:
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    counts: list[bytes] = []
    steps: list[np.ndarray] = []
    for first, last, h, of in shingle_sets(column, seed):
        n = last - first
        size = np.bincount(of, minlength=n)
        two = [mix(sums(mix(h + np.uint64(s)), of, n) + size.astype(np.uint64)).view(np.int64) for s in (1, 2)]
        for values, x in zip(out, (size, *two, *weights(h, of, n)), strict=True):
            values.append(x)
        held = part_counts(h, of, n)
        counts += [row.tobytes() for row in held]
        steps.append(unary(held))
    flat = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out]
    rows = pa.array(np.arange(len(counts) + 1, dtype=np.int32) * (PARTS // 32))
    bits = pa.ListArray.from_arrays(rows, pa.array(np.concatenate(steps) if steps else np.zeros(0, np.int64)))
    return pa.StructArray.from_arrays([*flat, pa.array(counts, pa.binary()), bits], ["n", "node", "check", "own", "above", "parts", "steps"])


def key_rows(column: pa.Array, seed: int, seen: set[int]) -> pa.RecordBatch:
    """(key, node, tag) of the sets of a column that the task has not yet sent."""
    out: list[list[np.ndarray]] = [[], [], []]
    for first, last, h, of in shingle_sets(column, seed):
        n = last - first
        size = np.bincount(of, minlength=n)
        node = mix(sums(mix(h + np.uint64(1)), of, n) + size.astype(np.uint64)).view(np.int64)
        fresh = np.zeros(n, bool)
        for i, x in enumerate(node.tolist()):
            if x not in seen:
                seen.add(x)
                fresh[i] = True
        mine = fresh[of]
        doc, key, tag = index_rows(h[mine], of[mine], n)
        for values, x in zip(out, (key.view(np.int64), node[doc], tag), strict=True):
            values.append(x)
        if len(seen) > REMEMBERED:
            seen.clear()
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
    return pa.RecordBatch.from_arrays([pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.int64()), pa.array(flat[2].astype(np.int32))], ["key", "node", "tag"])


def alike(one: pa.Array, two: pa.Array) -> pa.Array:
    """Whether the sets of two columns of texts are linked, from their shingles."""

    def sets(column: pa.Array) -> list[np.ndarray]:
        found = []
        for first, last, h, of in shingle_sets(column):
            edge = np.searchsorted(of, np.arange(last - first + 1))
            found += [h[edge[i] : edge[i + 1]] for i in range(last - first)]
        return found

    out = []
    for a, b in zip(sets(one), sets(two), strict=True):
        common = len(np.intersect1d(a, b, assume_unique=True))
        out.append(common > 0 and 100 * common >= PERCENT * (len(a) + len(b) - common))
    return pa.array(out, pa.bool_())


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where("other <> node").select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()


def nearest_hubs(links: DataFrame) -> DataFrame:
    """(node, comp): of a node and those it is linked with, the one with most links. Nodes with one hub are connected; a cheap
    beginning of components, in one pass."""
    both = staged(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    degree = both.groupBy("u").agg(F.count("*").alias("d"))
    near = both.join(degree.withColumnRenamed("u", "v"), "v").select("u", "v", "d").unionByName(degree.select("u", F.col("u").alias("v"), "d"))
    return near.groupBy("u").agg(F.max(F.struct("d", "v"))["v"].alias("comp")).withColumnRenamed("u", "node")


class Join:
    """The steps of one join over `docs` (doc_id long, text)."""

    def __init__(self, docs: DataFrame, seed: int):
        self.docs, self.seed = docs.withColumn("mark", F.xxhash64("text")), seed
        found = F.arrow_udf(lambda column: features(column, seed), FEATURES)
        self.sets = staged(self.docs.select("doc_id", "mark", found("text").alias("f")).select("doc_id", "mark", "f.*"))
        one = [F.first(x).alias(x) for x in ("n", "own", "above", "parts", "steps")]
        grouped = self.sets.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("rep"), F.min("doc_id").alias("least"), (F.min("check") != F.max("check")).alias("mixed"), *one)
        self.nodes = staged(grouped)

    def mixed(self) -> bool:
        """Whether two different sets share a node number."""
        return self.nodes.where("mixed").limit(1).count() > 0

    def index(self) -> DataFrame:
        """(key, node, tag, df) of the keys that several sets share, df being how often a key comes."""
        seed = self.seed

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                yield key_rows(batch.column(0), seed, seen)

        keys = self.docs.select("text").mapInArrow(rows, "key long, node long, tag int")
        same = Window.partitionBy("key")
        shared = keys.withColumn("df", F.count("*").over(same)).withColumn("several", F.min("node").over(same) != F.max("node").over(same))
        return staged(shared.where("several").drop("several"))

    def lead_pairs(self, index: DataFrame) -> DataFrame:
        """Each set with those that share most under its keys: an original among its edited copies."""
        central = index.groupBy("node").agg(F.sum("df").alias("central"))
        lead = F.max(F.struct("central", "node")).over(Window.partitionBy("key"))["node"]
        return distinct_pairs(index.join(central, "node").select("node", lead.alias("other")))

    def neighbour_pairs(self, index: DataFrame, comps: DataFrame) -> DataFrame:
        """Each set with its neighbours of another component under its keys, in one of ORDERS random orders."""
        known = index.select("key", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        order = Window.partitionBy("key").orderBy(F.xxhash64("node", F.pmod("key", F.lit(ORDERS))), "node")
        near = known.select("node", "comp", F.lag("node").over(order).alias("other"), F.lag("comp").over(order).alias("other_comp"))
        return distinct_pairs(near.where("comp <> other_comp"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Links (u, v) among pairs (u, v) of nodes: sizes first, then counts by part, then the shingles of both texts."""
        sized = pairs
        for x in ("u", "v"):
            sized = sized.join(self.nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "rep", "parts")]), x)
        fits = F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * PERCENT
        near = F.arrow_udf(may_be_linked, "boolean")("n_u", "n_v", "parts_u", "parts_v")
        sized = staged(sized.where(fits).where(near).select("u", "v", "rep_u", "rep_v"))
        texts = self.docs.where(F.col("text").isNotNull()).select("doc_id", "mark", "text")
        for x in ("u", "v"):
            mine = texts.withColumnsRenamed({"doc_id": f"id_{x}", "mark": f"mark_{x}", "text": f"text_{x}"})
            sized = sized.join(mine, F.expr(f"rep_{x}.doc_id <=> id_{x} and rep_{x}.mark = mark_{x}"))
        return staged(sized.where(F.arrow_udf(alike, "boolean")("text_u", "text_v")).select("u", "v").distinct())

    def open_pairs(self, index: DataFrame, comps: DataFrame) -> DataFrame:
        """Pairs of different components that can still be linked.

        A key whose sets are all in one component has nothing left to find. A set whose other segments weigh more than the
        most differences is done: one of them would be shared with any linked set. Where they do not, the cheapest open
        segments make up for the rest, and all sets under their keys are candidates.
        """
        known = index.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        apart = known.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key")
        sizes = self.nodes.select("node", "n", "own", "above", "steps")
        rest = staged(known.join(apart, "key").join(sizes, "node").select("key", "node", "tag", "comp", "df", "n", "own", "above", "steps"))
        open_segments = rest.groupBy("node", "tag", "n", "own", "above").agg(F.sum("df").alias("cost")).withColumn("weight", F.shiftright("tag", 1).bitwiseAND(3)).withColumn("cross", F.col("tag").bitwiseAND(1))
        unit = Window.partitionBy("node", "cross")
        cheap = unit.orderBy("cost", "tag").rowsBetween(Window.unboundedPreceding, -1)
        left = F.when(F.col("cross") == 0, F.col("own")).otherwise(F.col("above")) - F.sum("weight").over(unit)
        missing = F.floor(F.col("n") / PART) + 1 - left
        chosen = open_segments.withColumn("missing", missing).withColumn("before", F.coalesce(F.sum("weight").over(cheap), F.lit(0))).where("before < missing").select("node", "tag")
        probe = rest.join(chosen, ["node", "tag"]).select("key", *[F.col(c).alias(f"{c}_u") for c in ("node", "comp", "n", "steps")])
        other = rest.select("key", *[F.col(c).alias(f"{c}_v") for c in ("node", "comp", "n", "steps")])
        # the smaller set of a pair vouches for it, the smaller number where they are equal
        larger = (F.col("n_v") > F.col("n_u")) | ((F.col("n_v") == F.col("n_u")) & (F.col("node_v") > F.col("node_u")))
        fits = (F.col("n_u") * 100 >= F.col("n_v") * PERCENT) & (steps_apart("steps_u", "steps_v") * (100 + PERCENT) <= (F.col("n_u") + F.col("n_v")) * (100 - PERCENT))
        pairs = probe.join(other, (probe["key"] == other["key"]) & (F.col("comp_u") != F.col("comp_v")) & larger & fits)
        return pairs.select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v")).distinct()

    def hollow_links(self) -> DataFrame | None:
        """Links of sets whose segments weigh too little to be sure (their elements fall into very few segments): all their
        elements are joined with those of sets of fitting size. None if there are no such sets."""
        short = F.floor(F.col("n") / PART) + 1
        hollow = staged(self.nodes.where((F.col("n") >= BAND) & ((F.col("own") < short) | ((F.col("above") >= 0) & (F.col("above") < short)))).select("node", "n"))
        low, high = hollow.agg(F.min("n"), F.max("n")).first()
        if low is None:
            return None
        seed, least, most = self.seed, low * PERCENT // 100, high * 100 // PERCENT + 1
        spark = self.docs.sparkSession

        def elements(batches: Iterator[pa.RecordBatch], bits=None) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, last, h, of in shingle_sets(batch.column(0), seed):
                    n = last - first
                    size = np.bincount(of, minlength=n)
                    node = mix(sums(mix(h + np.uint64(1)), of, n) + size.astype(np.uint64)).view(np.int64)
                    fits = ((size >= least) & (size <= most))[of]
                    if bits is not None:
                        fits &= bits.value[(h >> np.uint64(64 - HOLLOW_BITS)).astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(h[fits].view(np.int64)), pa.array(node[of[fits]]), pa.array(size[of[fits]])], ["h", "node", "n"])

        # a table of bits, of one size at any input, lets through little but the elements of hollow sets
        reps = self.nodes.join(hollow.select("node"), "node").select("rep.*").withColumnsRenamed({"doc_id": "_doc", "mark": "_mark"})
        theirs = self.docs.join(reps, F.expr("doc_id <=> _doc and mark = _mark")).select("text").mapInArrow(elements, "h long, node long, n long")
        table = np.zeros(1 << HOLLOW_BITS, bool)
        table[theirs.select(F.shiftrightunsigned("h", 64 - HOLLOW_BITS).alias("bit")).distinct().toArrow()["bit"].to_numpy()] = True
        bits = spark.sparkContext.broadcast(table)
        every = self.docs.select("text").mapInArrow(lambda batches: elements(batches, bits), "h long, node long, n long").distinct()
        mine = every.join(hollow.select("node"), "node", "left_semi").withColumnsRenamed({"node": "u", "n": "n_u"})
        met = mine.join(every.withColumnsRenamed({"node": "v", "n": "n_v"}), "h").where("u <> v").groupBy("u", "v", "n_u", "n_v").agg(F.count("*").alias("common"))
        return staged(met.where(F.col("common") * 100 >= (F.col("n_u") + F.col("n_v") - F.col("common")) * PERCENT).select("u", "v"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of `docs` (doc_id long, text).

    Words lie between white space, A-Z lower-cased; a set holds the distinct runs of five words, or all words of a shorter text
    as one. Sets are linked when 100 * common >= 80 * united. component_id is the smallest doc_id that links reach, n_links the
    number of links found from the row's set to other sets (links inside a component that were not needed are not searched).
    Null texts and texts without words have an empty set and stay alone with their own doc_id; rows with equal texts share a
    component; a null doc_id counts only where there is no other; an empty table gives no rows.

    Equal sets are one node. The universe of shingles is cut into segments by size band; sets that differ little share a
    segment, or one less an element. A few likely pairs of each set are verified first; most keys then lie inside one
    component, and what other pairs are still possible is bounded by `open_pairs`. Shingles and nodes are 64-bit hashes; different sets under
    one node number are detected, and the join runs with another seed.
    """
    return grouped_rows(docs).select("doc_id", "n_shingles", "component_id", "n_links")


def grouped_rows(docs: DataFrame) -> DataFrame:
    """The rows of `near_duplicates` with `mark`, the xxhash64 of the text, and `group`, a number of the component that does not
    rest on ids; null for texts without words."""
    bounded_batches(docs.sparkSession, SMALL_BATCH_BYTES)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for seed in range(4):
        join = Join(docs, seed)
        if not join.mixed():
            break
    else:
        raise ValueError("different sets share node numbers under four seeds")
    index = join.index()
    links = join.verified(join.lead_pairs(index))
    links = links.unionByName(join.verified(join.neighbour_pairs(index, nearest_hubs(links))))
    comps = components(links)
    more = join.verified(join.open_pairs(index, comps))
    links = links.unionByName(more)
    hollow = join.hollow_links()
    if hollow is not None:
        links = links.unionByName(hollow)
    links = staged(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    comps = components(links)
    degree = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    placed = join.nodes.select("node", "least").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(degree, "node", "left")
    smallest = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "comp").select("node", F.col("comp").alias("group"), "component_id", "n_links")
    full = join.sets.select("doc_id", "mark", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(named, "node", "left")
    return full.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "mark", "group",
    )
