"""Mixing sources to target weights with hash-random keys and distributed prefix sums (operator 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmart.llm.common import staged, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Leading hex digits of a key that name its range; 4096 ranges a source.
RANGE_DIGITS = 3


def word_count(text: F.Column) -> F.Column:
    """Number of words between white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, repeats: int) -> DataFrame:
    """source, source_size, target of a table of one row a source.

    Sources in the order of code points, null last, weigh 1, 2, 3, 1, ... and share the sum of all sizes; no target is above
    `repeats` times its source. The excess is shared again by weight until none is above: filling in the order of limit by
    weight, the level after j full sources is what is left by the weights that are left.
    """
    one = Window.partitionBy(F.lit(0))
    order = one.orderBy(F.col("source").isNull(), F.col("source"))
    weighed = sizes.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("limit", F.col("source_size").cast("double") * repeats)
    before = one.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    filled = weighed.withColumn("left", F.sum("source_size").over(one).cast("double") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))).withColumn(
        "weights", F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    level = filled.withColumn("level", F.col("left") / F.col("weights")).withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    # the first source that is not full fixes the level of all that follow
    final = level.withColumn("final", F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(one)["level"])
    return final.select("source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, repeats: int = 3, seed: str = "mix-1") -> DataFrame:
    """All columns of `docs` (doc_id, text, source, ...) with mix_size, mix_source_size, mix_target and mix_taken.

    mix_taken is the number of words that the mix takes of a document, repeats counted: whole epochs of its source first, then
    documents in the order of a random key until the budget floor(target) is used up; the document at the cut gives what is
    left. Sums of mix_taken therefore equal floor(target) for each source. Null text or text without words has size 0 and
    gives 0; null sources are one source; an empty table gives no rows. Repeated rows are documents of their own: rows that
    agree in doc_id and size share a key and a tie is cut in any order. Columns named mix_* are replaced.

    Keys are md5 of seed and id, so ranges of keys are even and one source of any size spreads over 16**RANGE_DIGITS ranges.
    Prefix sums are sums by range first, then running sums inside a range; only the first is a table of sources and ranges.
    """
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_taken")
    key, part, within, of, span, ahead = unused(docs, "_key", "_range", "_inside", "_of", "_span", "_before")
    keyed = (
        docs.withColumn("mix_size", word_count(F.col("text")))
        .withColumn(key, F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")))
        .withColumn(part, F.substring(key, 1, RANGE_DIGITS))
    )
    ranges = staged(keyed.groupBy("source", F.col(part).alias("part")).agg(F.sum("mix_size").alias("range_size")))
    goal = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), repeats)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("ahead", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
    starts = offsets.alias("o").join(goal.alias("g"), F.expr("o.source <=> g.source")).select(
        F.col("o.source").alias(of), F.col("o.part").alias(span), F.col("ahead").alias(ahead), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target")
    )
    inside = Window.partitionBy("source", part).orderBy(key, "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    summed = keyed.withColumn(within, F.coalesce(F.sum("mix_size").over(inside), F.lit(0)))
    placed = summed.join(starts, F.col("source").eqNullSafe(F.col(of)) & (F.col(part) == F.col(span)), "left")
    budget = F.floor("mix_target")
    epochs = F.when(F.col("mix_source_size") > 0, F.floor(budget / F.col("mix_source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("mix_source_size") - F.col(ahead) - F.col(within)
    taken = epochs * F.col("mix_size") + F.greatest(F.lit(0), F.least(F.col("mix_size"), rest))
    return placed.withColumn("mix_taken", taken.cast("long")).drop(key, part, within, of, span, ahead)


def materialised(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix as rows of documents: a document comes as often as it is taken, rounded to whole documents.

    Documents without words are kept once: they cost no budget.
    """
    copies = F.when(F.col("mix_size") == 0, F.lit(1)).otherwise(F.round(F.col("mix_taken") / F.col("mix_size")).cast("int"))
    return mixed.select(*columns, F.explode(F.array_repeat(F.lit(1), copies)).alias("mix_copy")).drop("mix_copy")
