"""Toxicity by logistic regression over hashed word n-grams and skip-grams, learned with FTRL-proximal (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmart.llm.common import ALNUM, LOWER, SpanHash, bounded_batches, mix, shards, staged, unused, words

#: Features are hashed into 2**BITS coordinates.
BITS = 22
#: Labelled documents of each class that teach, at most; all others of the class count in the intercept only.
SAMPLE_ROWS = 8192
EPOCHS = 2
#: Learning rate, its damping, and the weights of the L1 and L2 terms.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1.0, 1.0

_PAIR, _SKIP = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(document of the column, coordinate) of every word, pair of neighbours and pair around one word, a shard of texts at a time,
    with the range of documents of the shard. Words are runs of letters, digits and all signs beyond ASCII; A-Z are lower-cased."""
    for shard in shards(column):
        data = LOWER[shard.data]
        starts, ends = words(data, ALNUM)
        docs = shard.doc_of(starts)
        marks = SpanHash.of_bytes(data).of(starts, ends)
        ids, owners = [mix(marks)], [docs]
        for gap, factor in ((1, _PAIR), (2, _SKIP)):
            together = docs[gap:] == docs[:-gap] if len(docs) > gap else np.zeros(0, bool)
            ids.append(mix(marks[:-gap][together] * factor + marks[gap:][together]) if len(together) else np.zeros(0, np.uint64))
            owners.append(docs[gap:][together] if len(together) else np.zeros(0, np.int64))
        yield np.concatenate(owners) + shard.first, (np.concatenate(ids) >> np.uint64(64 - BITS)).astype(np.int64), shard.first, shard.last


def per_document(column: pa.Array) -> list[bytes]:
    """Distinct coordinates of each text as little-endian 32-bit numbers."""
    out: list[bytes] = []
    for owner, at, first, last in features(column):
        key = np.unique((owner << BITS) | at)
        owner, at = key >> BITS, (key & ((1 << BITS) - 1)).astype("<u4")
        cuts = np.searchsorted(owner, np.arange(first, last + 1))
        out += [at[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


class Ftrl:
    """Per-coordinate learning rates; a weight is zero until its gradients add up to more than L1. The last place is the intercept."""

    def __init__(self):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - np.where(at == 1 << BITS, 0.0, L1), 0.0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at.astype(np.int64), 1 << BITS)
        w = self.weights(at)
        gradient = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + gradient**2


@dataclass
class Weights:
    """The non-zero weights, at most 2**BITS, and the intercept."""

    at: np.ndarray
    weight: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.at] = self.weight
        return out


def learn_weights(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS) -> Weights:
    """Weights from texts (doc_id, text) and labels (doc_id, label).

    Labels other than 0 and 1, null ids and labels without a document teach nothing; several labels of an id count as the largest. The
    sample is bounded: at most `sample_rows` documents of each class, those with the smallest hash of their id (of repeated ids
    the smallest hash of the text); the intercept is corrected to the classes' shares among all labelled ids. Features are made in the
    map tasks; one task reads them in a hashed order, epoch by epoch, a batch at a time, for which memory does not grow with
    the texts. Without both classes all weights are 0, and the score is their share (one half without any label).
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    valid = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    known = staged(valid.join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(totals) < 2:
        odds = 0.0 if not totals else (35.0 if 1 in totals else -35.0)
        return Weights(np.zeros(0, np.int64), np.zeros(0, np.float32), odds)
    order = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    drawn = F.broadcast(known.withColumn("turn", order).where(F.col("turn") <= sample_rows).drop("turn"))  # 2 * sample_rows rows at most
    texts = docs.select("doc_id", "text").join(drawn, "doc_id")
    order = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")))
    texts = texts.withColumn("turn", order).where(F.col("turn") <= sample_rows).drop("turn")

    @F.arrow_udf("binary")
    def made(column: pa.Array) -> pa.Array:
        return pa.array(per_document(column), pa.binary())

    rows = staged(texts.repartition(F.xxhash64("doc_id", "text")).select("doc_id", "label", made("text").alias("at")))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl()
        for batch in batches:
            for label, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                model.learn(np.frombuffer(at, "<u4"), label)
        every = np.arange((1 << BITS) + 1)
        weights = model.weights(every)
        kept = np.flatnonzero((weights != 0) | (every == 1 << BITS))
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(weights[kept])], ["at", "weight"])

    turns = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).repartition(1).sortWithinPartitions("epoch", F.xxhash64("epoch", "doc_id", "at"))
    found = turns.select("label", "at").mapInArrow(train, "at long, weight double").toArrow()
    at, weight = found["at"].to_numpy(), found["weight"].to_numpy()
    inside = at < 1 << BITS
    prior = np.log(totals[1] / totals[0]) - np.log(counts.get(1, 1) / counts.get(0, 1))
    return Weights(at[inside], weight[inside].astype(np.float32), float(weight[~inside].sum() + prior))


def score_texts(docs: DataFrame, model: Weights, text_col: str = "text") -> DataFrame:
    """`docs` with a column `toxicity` of (score double from 0 to 1, n_active: distinct coordinates with a weight), of whole texts.

    Null and empty texts have the score of the intercept. Repeated rows get equal answers, an empty table stays empty, a
    column named `toxicity` is replaced. The broadcast holds at most 2**BITS weights.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score: double, n_active: long>")
    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, intercept = shared.value.table(), shared.value.intercept
        for column in columns:
            sums, active = np.full(len(column), intercept), np.zeros(len(column), np.int64)
            for owner, at, _, _ in features(column):
                hit = table[at] != 0
                key = np.unique((owner[hit] << BITS) | at[hit])
                owner, at = key >> BITS, key & ((1 << BITS) - 1)
                np.add.at(sums, owner, table[at])
                np.add.at(active, owner, 1)
            score = 1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.StructArray.from_arrays([pa.array(score), pa.array(active)], ["score", "n_active"])

    (name,) = unused(docs.drop("toxicity"), "_text")
    return docs.withColumn(name, F.col(text_col)).withColumn("toxicity", judge(F.col(name))).drop(name)
