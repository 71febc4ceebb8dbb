"""Language by compression with per-language dictionaries (operator 1)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmart.llm.common import SMALL_BATCH_BYTES, bounded_batches

#: Labelled rows a language that make its dictionary, characters taken of each, and bytes of the dictionary.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 64, 4_000, 64 << 10
#: All dictionaries together; more languages than fit are an error, not a silent cut.
MODEL_BYTES = 32 << 20
#: A text is encoded in blocks, so that its own repetitions do not outweigh the dictionary.
BLOCK_BYTES = 4 << 10
LEVEL = 6
#: Least saving of the best over the second best dictionary, as a share of the second size.
MARGIN = 0.005

NO_LETTERS = re.compile(r"[\W\d_]+")


def learn_dictionaries(labelled: DataFrame) -> dict[str, bytes]:
    """Raw-content dictionaries of a table (doc_id, text, lang).

    A bounded sample: SAMPLE_ROWS documents a language with the smallest hash of their id, and of each the first SAMPLE_CHARS
    characters. Null languages and texts teach
    nothing; repeated rows count as often as they are drawn. Keys are drawn from narrow columns, then texts are fetched by id.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id")
    drawn = known.select("lang", "doc_id").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SAMPLE_ROWS)
    ids = sorted({r["doc_id"] for r in drawn.select("doc_id").collect() if r["doc_id"] is not None})
    texts: dict[str, list[str]] = {}
    if ids:
        rows = known.where(F.col("doc_id").isin(ids)).select("lang", "doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
        ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "text")))
        for r in ranked.where(F.col("_n") <= SAMPLE_ROWS).orderBy("lang", "_n").collect():
            texts.setdefault(r["lang"], []).append(r["text"])
    if len(texts) * DICTIONARY_BYTES > MODEL_BYTES:
        raise ValueError(f"{len(texts)} languages need more than {MODEL_BYTES} bytes of dictionaries")
    # the end of a dictionary is the cheapest to refer to: the first drawn come last
    return {lang: b"\n".join(normal(t) for t in reversed(found))[-DICTIONARY_BYTES:] for lang, found in sorted(texts.items())}


def has_letter(text: str) -> bool:
    """Whether a character is a letter of any script; numbers such as one half or a superscript two are none."""
    return any(map(str.isalpha, text))


def normal(text: str) -> bytes:
    """All letters in lower case, one space for all between them: signs and digits say nothing of a language."""
    return NO_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.coders = []
        for raw in dictionaries.values():
            shared = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=False, write_content_size=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, certainty from 0 to 1, and whether the margin is too narrow."""
        if text is None or not self.langs or not has_letter(text):
            return "und", 0.0, True
        data = normal(text)
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.coders]
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best, second = sizes[order[0]], sizes[order[1]] if len(order) > 1 else len(data) + 1
        margin = max(0.0, (second - best) / max(second, 1))
        return self.langs[order[0]], min(1.0, 0.5 + 5 * margin) if margin else 0.5, margin < MARGIN


SCHEMA = "struct<lang: string, score: double, rejected: boolean>"


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """`docs` with a column `language` of (lang, score, rejected); whole texts are encoded.

    Null texts and texts without a letter are `und` and rejected, as is every text without learned languages. Ties of sizes go
    to the language that is first by name and are rejected. Repeated rows get equal answers; an empty table stays empty; a
    column named `language` is replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark, SMALL_BATCH_BYTES)
    shared = spark.sparkContext.broadcast(dictionaries)

    @F.arrow_udf(SCHEMA)
    def classify(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Classifier(shared.value)
        for column in columns:
            rows = [model.predict(t) for t in column.to_pylist()]
            parts = [list(x) for x in zip(*rows, strict=True)] if rows else [[], [], []]
            yield pa.StructArray.from_arrays([pa.array(parts[0], pa.string()), pa.array(parts[1], pa.float64()), pa.array(parts[2], pa.bool_())], ["lang", "score", "rejected"])

    return docs.withColumn("language", classify(F.col(text_col)))
