"""Hard negatives by shared candidate lists of anchor clusters (operator 11)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmart.llm.common import bounded_batches, staged
from leafmart.llm.vector_topk import matrix, scaled

#: Anchors that place the centroids, and centroids at most; every anchor is then assigned.
SAMPLE_ROWS, SAMPLE_BYTES, MAX_CLUSTERS, ROUNDS = 4096, 8 << 20, 256, 8
#: Vectors of anchors, and of candidates, that meet in one group.
BLOCK_BYTES, SHARD_BYTES, LEAST_SHARD_BYTES, SHARDS = 8 << 20, 32 << 20, 2 << 20, 64
#: Places of a list read between two looks at the certificates, and exact scores held at once.
STEP, CELLS = 256, 1 << 20

NONE = np.iinfo(np.int64).min
LAST = np.iinfo(np.int64).max


def labelled_vectors(table: DataFrame, id_col: str, label_col: str, vec_col: str, label: Column | None = None) -> DataFrame:
    """(id, label, vec) of the rows that take part: with id, label and a vector of finite components; components as floor(256 * x)."""
    known = table.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) if label is None else label).alias("label"), F.col(vec_col).alias("vec"))
    vectors = scaled(known.select(F.struct("id", "label").alias("row"), "vec").where("row.id is not null"), "row", "vec")
    return vectors.select("id.id", "id.label", "vec").where(F.size("vec") > 0)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def centroids(vectors: np.ndarray, n: int) -> np.ndarray:
    """Directions of at most `n` clusters: seeds far from each other, then a few rounds of spherical means."""
    x = unit(vectors.astype(np.float64))
    places = [0]
    nearest = x @ x[0]
    while len(places) < min(n, len(x)):
        places.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[places[-1]])
    means = x[places]
    for _ in range(ROUNDS):
        own = np.argmax(x @ means.T, axis=1)
        sums = np.zeros_like(means)
        np.add.at(sums, own, x)
        means = np.where(np.bincount(own, minlength=len(means))[:, None] > 0, unit(sums), means)
    return means


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where that is exact."""
    if len(a) and len(b) and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Best:
    """The k largest (score, smaller id first) of each of many rows."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((rows, k), NONE), np.full((rows, k), LAST)

    def last(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(rows) == 0:
            return
        touched = np.unique(rows)
        all_rows = np.concatenate((np.repeat(touched, self.k), rows))
        all_scores = np.concatenate((self.scores[touched].ravel(), scores))
        all_ids = np.concatenate((self.ids[touched].ravel(), ids))
        order = np.lexsort((all_ids, -all_scores, all_rows))  # -NONE wraps to NONE: absent entries would come first
        absent = all_scores[order] == NONE
        order = np.concatenate((order[~absent], order[absent]))
        order = order[np.argsort(all_rows[order], kind="stable")]
        first = np.searchsorted(all_rows[order], touched)
        take = order[first[:, None] + np.arange(self.k)]
        self.scores[touched], self.ids[touched] = all_scores[take], all_ids[take]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, j = np.nonzero(self.scores != NONE)
        return r, self.ids[r, j], self.scores[r, j]


@dataclass
class Candidates:
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    def __post_init__(self):
        self.norms = np.linalg.norm(self.vectors.astype(np.float64), axis=1)

    def ordered(self, centre: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list that all members share: candidates by an upper bound of the score with a member of length one.

        The angle between a candidate and a member is at least the candidate's angle to the centre less the widest angle of a member.
        """
        with np.errstate(invalid="ignore", divide="ignore"):
            near = np.nan_to_num(self.vectors.astype(np.float64) @ centre / self.norms, nan=1.0)
            inner = np.nan_to_num(members @ centre / np.linalg.norm(members, axis=1), nan=1.0)
        spread = np.arccos(np.clip(inner, -1, 1)).max() if np.any(centre) else np.pi
        bound = self.norms * np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - spread))
        order = np.argsort(-bound, kind="stable")
        return order, bound[order]


@dataclass
class Wanted:
    """What a row of `Best` looks for: rows of one anchor, of the anchor's label or of others, with scores inside limits times 100."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same_label: bool


def walk(members: np.ndarray, ids: np.ndarray, labels: np.ndarray, found: Candidates, centre: np.ndarray, wanted: Wanted, k: int) -> tuple[Best, int]:
    """Best rows of each wish of the members of a cluster, and how many exact scores were computed.

    Every member reads the shared list from its start. A wish is certified, and leaves, when the bound at the next place is
    below its k-th score or below its lower limit.
    """
    order, bound = found.ordered(centre, members.astype(np.float64))
    norms = np.linalg.norm(members.astype(np.float64), axis=1)
    slack = norms * (found.norms.max() if len(found.norms) else 0) * 1e-9 + 1e-6
    best, reads = Best(len(wanted.anchor), k), 0
    live = np.arange(len(wanted.anchor))
    at = 0
    while at < len(order) and len(live):
        most = norms[wanted.anchor[live]] * bound[at] + slack[wanted.anchor[live]]
        live = live[(most >= best.last()[live]) & (100 * most >= wanted.low[live])]
        step = order[at : at + STEP]
        at += STEP
        for a in range(0, len(live), max(1, CELLS // STEP)):
            part = live[a : a + max(1, CELLS // STEP)]
            rows, where = np.unique(wanted.anchor[part], return_inverse=True)
            scores = exact_scores(members[rows], found.vectors[step])
            reads += scores.size
            fits = labels[rows][:, None] == found.labels[step][None, :]
            fits = (fits if wanted.same_label else ~fits) & (ids[rows][:, None] != found.ids[step][None, :])
            mine, hundred = scores[where], 100 * scores[where]
            ok = fits[where] & (mine >= best.last()[part][:, None]) & (hundred >= wanted.low[part][:, None]) & (hundred <= wanted.high[part][:, None])
            r, j = np.nonzero(ok)
            best.add(part[r], mine[r, j], found.ids[step][j])
    return best, reads


ANCHOR_FIELDS = "anchor_id long, positive_id long, positive_score long, id long, score long"


def search(anchors: pa.Table, rows: pa.Table, means: np.ndarray, k: int, limits: tuple[int, int] | None) -> pa.Table:
    """A block of anchors against a shard of rows: their best same-label rows, or with `limits` those of other labels for each positive."""
    empty = pa.schema([(n, pa.int64()) for n in ("anchor_id", "positive_id", "positive_score", "id", "score")]).empty_table()
    if anchors.num_rows == 0 or rows.num_rows == 0:
        return empty
    found = Candidates(*(rows[c].to_numpy() for c in ("id", "label")), matrix(rows["vec"]))
    ids, labels, vectors, cluster = anchors["id"].to_numpy(), anchors["label"].to_numpy(), matrix(anchors["vec"]), anchors["cluster"].to_numpy()
    positives = anchors["positives"].to_pylist() if limits else []
    out = [[] for _ in range(5)]
    for c in np.unique(cluster):
        own = np.flatnonzero(cluster == c)
        if limits:
            pairs = [(i, p["id"], p["score"]) for i, a in enumerate(own) for p in positives[a] if p["score"] >= 0]
            if not pairs:
                continue
            anchor, positive, score = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
            wanted = Wanted(anchor, limits[0] * score, limits[1] * score, False)
        else:
            anchor = np.arange(len(own))
            positive = score = np.full(len(own), 0)
            wanted = Wanted(anchor, np.full(len(own), NONE), np.full(len(own), LAST), True)
        best, _ = walk(vectors[own], ids[own], labels[own], found, means[c], wanted, k)
        r, got, points = best.rows()
        for column, values in zip(out, (ids[own][anchor[r]], positive[r], score[r], got, points), strict=True):
            column.append(values)
    return pa.table({n: np.concatenate(x).astype(np.int64) for n, x in zip(empty.schema.names, out, strict=True)}) if out[0] else empty


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of a table (id long, label, vec array<long>).

    For each anchor (a row for which `is_anchor` holds) its first `positives` rows of the same label and, for each of these, the
    first `negatives` rows of other labels with low * positive_score <= 100 * score <= high * positive_score. Higher scores come
    first, ties by smaller id. A repeated id is one row, that of the smallest (label, vector); no row is its own partner. Only
    vectors of one length meet. A negative positive score has no negatives, since its limits exclude each other. Empty tables
    and anchors without positives give no rows. Sums of 100 products must fit a long (components below 2**25 for some thousand dimensions).

    Anchors form clusters around centroids (found on a bounded sample, SAMPLE_ROWS). A block of whole clusters meets a shard of
    the rows in one group; there each cluster sorts the rows once by an upper bound of their angle and length, and all its
    members walk that list until their results are certain. A cluster beyond BLOCK_BYTES is dealt over several blocks. Groups
    return at most the wanted number of rows for each anchor, merged by ranked windows.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    rows = staged(rows.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row")).select("id", F.col("row.label").cast("long").alias("label"), "row.vec", F.size("row.vec").alias("n")))
    shapes = [tuple(r) for r in rows.groupBy("n").agg(F.count("*"), F.count_if(is_anchor)).orderBy("n").collect()]  # a row a vector length
    results = [_of_length(rows.where(F.col("n") == n).drop("n"), is_anchor, n, total, some, positives, negatives, low, high) for n, total, some in shapes if some]
    if not results:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = results[0]
    for other in results[1:]:
        out = out.unionByName(other)
    return out


def _of_length(rows: DataFrame, is_anchor: Column, n: int, total: int, some: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = rows.sparkSession
    anchors = rows.where(is_anchor)
    sample = anchors.orderBy(F.xxhash64("id")).limit(max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * n)))).select("vec").toArrow()
    means = centroids(matrix(sample["vec"]), min(MAX_CLUSTERS, max(1, round(some**0.5)), max(1, SAMPLE_BYTES // (8 * n))))
    shared = spark.sparkContext.broadcast(means)

    def assign(batches):
        for batch in batches:
            nearest = np.argmax(matrix(batch["vec"]).astype(np.float64) @ shared.value.T, axis=1) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int32())], [*batch.schema.names, "cluster"])

    anchors = staged(anchors.mapInArrow(assign, "id long, label long, vec array<long>, cluster int"))
    limit = max(1, BLOCK_BYTES // (8 * n))
    firsts, parts, block, filled = {}, {}, 0, 0
    for cluster, members in sorted(tuple(r) for r in anchors.groupBy("cluster").count().collect()):  # at most MAX_CLUSTERS rows
        if filled and filled + members > limit:
            block, filled = block + 1, 0
        firsts[cluster], parts[cluster] = block, -(-members // limit)
        block, filled = block + parts[cluster] - 1, filled + members
        if parts[cluster] > 1:
            block, filled = block + 1, 0
    blocks = block + 1
    of = lambda known: F.create_map(*[F.lit(x) for item in known.items() for x in item])[F.col("cluster")]
    anchors = anchors.withColumn("block", of(firsts) + F.pmod(F.xxhash64(F.lit("part"), "id"), of(parts)).cast("int"))
    shard_bytes = min(SHARD_BYTES, max(LEAST_SHARD_BYTES, total * n * 8 // SHARDS))
    shards = -(-total * n * 8 // shard_bytes)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(left: DataFrame, k: int, limits: tuple[int, int] | None) -> DataFrame:
        left = left.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        return left.groupBy("block", "shard").cogroup(dealt.groupBy("block", "shard")).applyInArrow(lambda a, r: search(a, r, shared.value, k, limits), ANCHOR_FIELDS)

    close = meet(anchors, positives, None)
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    close = close.withColumn("rank", rank("anchor_id")).where(F.col("rank") <= positives)
    close = close.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("id", "score"))).alias("positives"))  # at most `positives` each
    with_positives = staged(anchors.join(close, anchors["id"] == close["anchor_id"]).drop("anchor_id"))
    far = meet(with_positives, negatives, (low, high))
    far = far.withColumn("rank", rank("anchor_id", "positive_id")).where(F.col("rank") <= negatives)
    return far.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
