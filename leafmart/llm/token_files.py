"""Token ids in byte-aligned files of frequency ranks with separate control bytes (operator 8)."""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmart.llm.common import NONSPACE, Shard, SpanHash, bounded_batches, shards, staged, utf8, words, work_folder

#: Words whose ids a worker remembers; the older half goes when it is full.
REMEMBERED = 300_000
#: Bytes of text whose words are told apart at once.
WORD_BYTES = 4 << 20
FILES = "doc_id long, part int, at long, n_tokens long, control binary, data binary"

_coders: dict[int, WordCoder] = {}


#: Letters with signs behind them, which are pieces of their own. No apostrophe: it may begin a piece with letters.
SIGNS = b"!#$%&*,.:;?"


def lower_letters(word: str) -> str | None:
    """The composed word in lower case where it is letters alone before and after; None else. A last sigma is lower-cased by
    its place, so it is left to the tokenizer."""
    if word.isascii():
        return word.lower() if word.isalpha() else None
    low = unicodedata.normalize("NFC", word).lower()
    return low if word.isalpha() and low.isalpha() and "\u03a3" not in word else None


def lower_bytes(word: bytes) -> bytes | None:
    """`lower_letters` of a word in UTF-8."""
    if word.isascii():
        return word.lower() if word.isalpha() else None
    low = lower_letters(word.decode("utf-8", "replace"))
    return low.encode() if low else None


class WordCoder:
    """Ids of texts by a tokenizer whose pieces never span white space, from remembered words.

    The tokenizer removes white space, so the ids of a text are those of its pieces between ASCII white space, one after
    another.
    """

    def __init__(self, definition: str, kind: str):
        from tokenizers import Tokenizer

        self.coder, self.kind = Tokenizer.from_str(definition), kind
        vocabulary = self.coder.get_vocab(with_added_tokens=True)
        self.word_end = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.word_end[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.letters = letters_coder(definition)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes], end: bytes) -> list[bytes]:
        """Ids of each text, then the end id."""
        return self.encode_column(pa.array(texts, pa.binary()), end)

    def encode_column(self, column: pa.Array, end: bytes) -> list[bytes]:
        return list(chain.from_iterable(self.encode_shard(shard, end) for shard in shards(column, WORD_BYTES)))

    def encode_shard(self, shard: Shard, end: bytes) -> list[bytes]:
        """Words of some documents are told apart by a hash, looked up once each, and their ids put in the place of each word.
        A second hash finds out where two words share the first; then they are told apart by their bytes."""
        first, last = words(shard.data, NONSPACE)
        raw = shard.data.tobytes()
        _, head, of = np.unique(SpanHash.of_bytes(shard.data).of(first, last), return_index=True, return_inverse=True)
        check = SpanHash.of_bytes(shard.data, 1).of(first, last)
        if (check[head][of] != check).any():
            known: dict[bytes, int] = {}
            of = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.int64)
            head = np.unique(of, return_index=True)[1]
        ids = self.ids_of([raw[a:b] for a, b in zip(first[head].tolist(), last[head].tolist(), strict=True)])
        size = np.dtype(self.kind).itemsize
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // size
        count = sizes[of]
        at = np.concatenate(([0], np.cumsum(count)))
        every = np.frombuffer(b"".join(ids), self.kind)[np.arange(at[-1]) + np.repeat((np.cumsum(sizes) - sizes)[of] - at[:-1], count)].tobytes()
        edges = (at[np.searchsorted(first, np.append(shard.starts, len(shard.data)))] * size).tolist()
        return [every[a:b] + end for a, b in zip(edges, edges[1:], strict=False)]

    def ids_of(self, names: list[bytes]) -> list[bytes]:
        """Ids of distinct words. Words of letters are remembered in lower case, whatever their case was, and without the signs
        behind them, which are pieces of their own; unseen ones are encoded."""
        young = self.young
        keys, tails = [], []
        for w in names:
            key, tail = w, b""
            if self.letters:
                if w.isalpha():
                    key = w.lower()
                else:
                    core = w.rstrip(SIGNS)
                    if core and (low := lower_bytes(core)):
                        key, tail = low, w[len(core) :]
            keys.append(key)
            tails.append(tail)
        fresh = self.recall(set(keys).union(t for t in set(tails) if t))
        for a in range(0, len(fresh), 1000):
            some = fresh[a : a + 1000]
            young.update(zip(some, self.encode_words(some), strict=True))
        out = [young[k] + young[t] if t else young[k] for k, t in zip(keys, tails, strict=True)]
        if len(young) > REMEMBERED:
            self.old, self.young = young, {}
        return out

    def recall(self, some: Iterable[bytes]) -> list[bytes]:
        """Words that are not remembered; those of the older half are young again."""
        unseen = []
        for w in some:
            if w in self.young:
                continue
            if w in self.old:
                self.young[w] = self.old[w]
            else:
                unseen.append(w)
        return unseen

    def encode_words(self, some: list[bytes]) -> list[bytes]:
        """Words of letters alone are one piece each; many of them go through the merges in one text, parted at the ends of
        pieces. All others go through the whole tokenizer one by one."""
        out = dict.fromkeys(range(len(some)), b"")
        plain, lower = [], []
        if self.letters:
            for i, w in enumerate(some):
                if low := lower_bytes(w):
                    plain.append(i)
                    lower.append(low)
        ids = np.zeros(0, np.int64)
        if plain:
            text = BYTE_LETTERS[np.frombuffer(b" ".join(lower), np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.word_end[ids]) + 1
        if len(ends) != len(plain) or (len(ends) and ends[-1] != len(ids)):
            plain, ends = [], ends[:0]
        raw, size, at = ids.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize, 0
        for i, e in zip(plain, ends.tolist(), strict=True):
            out[i] = raw[at * size : e * size]
            at = e
        rest = sorted(out.keys() - set(plain))
        for i, e in zip(rest, self.coder.encode_batch_fast([some[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, self.kind).tobytes()
        return [out[i] for i in range(len(some))]


#: Letters that byte-level pieces are written in: printable bytes stand for themselves, the others are moved up. Not the blank.
BYTE_LETTERS = np.arange(256, dtype="<u2")
for _k, _b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)):
    BYTE_LETTERS[_b] = _b if _b == 32 else 256 + _k


def letters_coder(definition: str):
    """The tokenizer's merges for words of letters that are lower-cased and written in byte letters already; None where the
    steps before the merges are others than: compose, white space, lower case; letters as one piece; bytes."""
    from tokenizers import Tokenizer

    parts = json.loads(definition)
    steps = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
    cuts = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or r"|[\p{L}]+|" not in cuts[0]["pattern"].get("Regex", ""):
        return None
    return Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))


def word_coder(definition: str, kind: str) -> WordCoder:
    """One per worker process, kept between tasks."""
    key = zlib.crc32((kind + definition).encode())
    if key not in _coders:
        _coders.clear()
        _coders[key] = WordCoder(definition, kind)
    return _coders[key]


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes (two bits a value: its length less one) and the values' own bytes, little-endian."""
    lengths = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    kept = np.arange(4, dtype=np.uint8)[None, :] < lengths[:, None]
    return control.tobytes(), ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[kept].tobytes()


#: Lengths of the four values of each control byte.
LENGTHS = ((np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3) + 1
#: Which of the sixteen bytes of four values are stored, for each control byte.
STORED = (np.arange(4)[None, None, :] < LENGTHS[:, :, None]).reshape(256, 16)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Values by table lookup of the control bytes."""
    codes = np.frombuffer(control, np.uint8)
    values = np.zeros((len(codes), 16), np.uint8)
    stored = STORED[codes]
    if n % 4:  # the last group is not full
        stored[-1, 4 * (n % 4) :] = False
    values[stored] = np.frombuffer(data, np.uint8)
    return values.reshape(-1).view("<u4")[:n]


def id_type(definition: str, end_id: int) -> str:
    """Two bytes an id on the way to the files where all ids of the tokenizer fit, else four."""
    from tokenizers import Tokenizer

    return "<u2" if max(end_id + 1, Tokenizer.from_str(definition).get_vocab_size()) <= 1 << 16 else "<u4"


def encode_documents(docs: DataFrame, definition: str, end_id: int, kind: str = "<u4") -> DataFrame:
    """(doc_id, ids binary): ids of each whole text as numbers of `kind`, the end id last. Null is an empty text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(definition)
    end = np.array([end_id], kind).tobytes()

    @F.arrow_udf("binary")
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = word_coder(shared.value, kind)
        for column in columns:
            yield pa.array(coder.encode_column(column, end), pa.binary())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), encode("text").alias("ids"))


def frequency_ranks(encoded: DataFrame, kind: str) -> np.ndarray:
    """Ids in the order of falling counts, ties to the smaller id; a row a distinct id, so no more than the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            found = np.bincount(data[offsets[0] : offsets[-1]].view(kind).astype(np.int64), minlength=len(total))
            found[: len(total)] += total
            total = found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    counts = encoded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "id").toArrow()["id"].to_numpy().astype(np.uint32)


def write_tokens(docs: DataFrame, path: str, definition: str, end_id: int = 1) -> None:
    """Writes `docs` (doc_id, text) as token files under `path` in ascending doc_id order, null ids first.

    `path`/ranks holds one row with the ids by rank; `path`/parts holds a row a document: part and start inside the part, the
    control bytes and the data bytes of its ranks. Null texts give the end id alone; repeated rows are written as often as
    they come; an empty table gives files without rows.
    """
    spark = docs.sparkSession
    kind = id_type(definition, end_id)
    encoded = staged(encode_documents(docs, definition, end_id, kind))
    ids = frequency_ranks(encoded, kind)
    table = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    table[ids] = np.arange(len(ids), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(table)
    spark.createDataFrame([(bytearray(ids.astype("<u4").tobytes()),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, at = shared.value, 0
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for raw in batch.column(2).to_pylist():
                ranks = rank[np.frombuffer(raw, kind)]
                for out, x in zip(rows, (at, len(ranks), *pack(ranks)), strict=True):
                    out.append(x)
                at += len(ranks)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())],
                ["doc_id", "part", "at", "n_tokens", "control", "data"],
            )

    ordered = encoded.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("doc_id", F.spark_partition_id().alias("part"), "ids")
    ordered.mapInArrow(write, FILES).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (32-bit little-endian) as written, start being the ids of all documents before."""
    bounded_batches(spark)
    ids = np.frombuffer(bytes(spark.read.schema("ids binary").parquet(f"{path}/ranks").first()["ids"]), "<u4")
    shared = spark.sparkContext.broadcast(ids)
    parts = spark.read.schema(FILES).parquet(f"{path}/parts")
    totals = parts.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    offsets = totals.select("part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("offset"))

    @F.arrow_udf("binary")
    def decode(counts: pa.Array, control: pa.Array, data: pa.Array) -> pa.Array:
        return pa.array([shared.value[unpack(c, d, n)].astype("<u4").tobytes() for n, c, d in zip(counts.to_pylist(), control.to_pylist(), data.to_pylist(), strict=True)], pa.binary())

    placed = parts.join(offsets, "part")
    return placed.select("doc_id", (F.col("at") + F.col("offset")).alias("start"), "n_tokens", decode("n_tokens", "control", "data").alias("ids"))


def round_trip(docs: DataFrame, definition: str, end_id: int = 1) -> DataFrame:
    """Written to a new folder of the shared checkpoint folder, then read back."""
    path = work_folder(docs.sparkSession)
    write_tokens(docs, path, definition, end_id)
    return read_tokens(docs.sparkSession, path)
