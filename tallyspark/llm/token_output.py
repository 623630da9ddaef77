"""Token ids as a binary table: one zstd frame for each document, a shared dictionary and an offset index.

A file row is a block: consecutive documents in key order, each document's ids (little-endian, 16 bits
where the vocabulary fits, else 32) as a frame of its own, the frames' offsets, and the hash of the
dictionary that the frames need. A reader of one document finds its block by the key range that the
block covers (Parquet keeps each row group's range), and decompresses that frame alone.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._pieces import encoder
from ._shared import shared_folder, spans, string_bytes, tidy, whole_text

#: The dictionary is trained on a stretch of so many bytes of ids, at a drawn place, of at most so many documents.
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 1 << 14
DICTIONARY_BYTES, LEVEL = 1 << 16, 3
#: Pieces that a worker remembers while it writes.
WRITE_PIECES = 600_000
#: A block closes at so many bytes of frames or so many documents.
BLOCK_BYTES, BLOCK_DOCS = 1 << 20, 4096

BLOCK_SCHEMA = "shard int, block int, dictionary string, width int, first_id long, last_id long, start_in_shard long, tokens long, ids array<long>, offsets array<int>, frames binary"


@dataclass(frozen=True)
class TokenFiles:
    """Where the blocks and the dictionary are."""

    folder: str

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(BLOCK_SCHEMA).parquet(f"{self.folder}/blocks")

    def dictionary(self, spark: SparkSession) -> bytes:
        """At most DICTIONARY_BYTES."""
        row = spark.read.schema("hash string, content binary").parquet(f"{self.folder}/dictionary").first()
        return bytes(row.content)


def _hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()[:16]


def _zstd(dictionary: bytes):
    """None for an empty dictionary: frames then need none."""
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def _press(dictionary: bytes) -> zstandard.ZstdCompressor:
    """A compressor whose dictionary is digested once, not for each document."""
    shared = _zstd(dictionary)
    if shared:
        shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_dict_id=False, write_content_size=True)


def train_dictionary(docs: DataFrame, path: str, key: str, text: str, end_id: int, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """From the ``sample_docs`` documents whose key hashes lowest, a stretch of at most ``sample_bytes`` of each at a place that its hash says; empty if they are too few to train on."""
    order = F.xxhash64(F.col(key).cast("string"), F.lit("dictionary"))
    named = docs.where(F.col(key).isNotNull())
    last = named.select(order.alias("draw")).orderBy("draw").limit(sample_docs).agg(F.max("draw")).first()[0]
    some = named.select(order.alias("draw"), whole_text(text).alias("text")).where(F.col("draw") <= F.lit(last).cast("long"))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        kind = _kind(code.library.get_vocab_size())
        stretch = max(sample_bytes // kind.itemsize, 1)
        for batch in batches:
            draws = batch.column(0).to_pylist()
            data, bounds = string_bytes(batch.column(1))
            for a, b in spans(bounds):
                found, ends = code.encode(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                out = []
                for draw, s, e in zip(draws[a:b], ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    at = s + stretch * ((draw or 0) % -(-(e - s + 1) // stretch))
                    out.append(np.append(found[at:e], end_id)[:stretch].astype(kind).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["ids"])

    samples = [bytes(r.ids) for r in some.mapInArrow(tidy(ids, keep=True), "ids binary").limit(sample_docs).collect()]  # at most sample_docs * sample_bytes
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _kind(vocabulary: int) -> type:
    return np.dtype("<u2") if vocabulary <= 1 << 16 else np.dtype("<u4")


def write_tokens(docs: DataFrame, path: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = 0) -> TokenFiles:
    """Writes the ids of every whole text, each with ``end_id`` behind it, in ascending key order.

    A shard is a range of keys; shards in number order, blocks within them, and documents within blocks
    ascend. Null keys come first, equal keys next to each other by the text's hash, then the text; null and empty
    texts hold the end id alone. Repeated rows are written as often as they come. Added tokens' texts inside a text
    get their ids, as is the library's default. Long texts are encoded in windows. Other columns play no part,
    whatever their names. An empty table makes no blocks.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    dictionary = train_dictionary(docs, path, key, text, end_id)
    stamp = _hash(dictionary)
    spark.createDataFrame([(stamp, bytearray(dictionary))], "hash string, content binary").coalesce(1).write.parquet(f"{folder}/dictionary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, shard = encoder(path, WRITE_PIECES), TaskContext.get().partitionId()
        kind = _kind(code.library.get_vocab_size())
        press = _press(dictionary)
        number = start = tokens = held = 0
        keys, frames = [], []

        def close() -> pa.RecordBatch:
            nonlocal number, start, tokens, held, keys, frames
            named = [k for k in keys if k is not None]
            row = {"shard": shard, "block": number, "dictionary": stamp, "width": kind.itemsize, "first_id": min(named, default=None), "last_id": max(named, default=None), "start_in_shard": start, "tokens": tokens, "ids": keys, "offsets": np.append(0, np.cumsum([len(f) for f in frames])).tolist(), "frames": b"".join(frames)}
            number, start, tokens, held, keys, frames = number + 1, start + tokens, 0, 0, [], []
            return pa.RecordBatch.from_pylist([row], schema=_BLOCK_ARROW)

        for batch in batches:
            data, bounds = string_bytes(batch.column(1))
            named = batch.column(0).to_pylist()
            for a, b in spans(bounds):
                found, ends = code.encode(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
                found = found.astype(kind)
                tail = np.array([end_id], kind)
                for k, s, e in zip(named[a:b], ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    frame = press.compress(np.concatenate([found[s:e], tail]).tobytes())
                    keys.append(k)
                    frames.append(frame)
                    tokens, held = tokens + e - s + 1, held + len(frame)
                    if held >= BLOCK_BYTES or len(keys) >= BLOCK_DOCS:
                        yield close()
        if keys:
            yield close()

    # the hash spreads rows of one key, null above all, over ranges
    rows = docs.select(F.col(key).cast("long").alias("key"), whole_text(text).alias("text")).withColumn("mark", F.xxhash64("text"))
    ordered = rows.repartitionByRange("key", "mark").sortWithinPartitions("key", "mark", "text").select("key", "text")
    ordered.mapInArrow(tidy(blocks, keep=True), BLOCK_SCHEMA).write.parquet(f"{folder}/blocks")
    return TokenFiles(folder)


_BLOCK_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("dictionary", pa.string()), ("width", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("start_in_shard", pa.int64()), ("tokens", pa.int64()), ("ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("frames", pa.binary())])


def _frames(batch: pa.RecordBatch, dictionary: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(row, documents before it in the block, key, ids) of the blocks of a batch."""
    open_ = zstandard.ZstdDecompressor(dict_data=_zstd(dictionary))
    for row in range(batch.num_rows):
        one = {c: batch.column(c)[row].as_py() for c in ("dictionary", "width", "ids", "offsets", "frames")}
        if one["dictionary"] != _hash(dictionary):
            raise ValueError(f"block needs dictionary {one['dictionary']}")
        kind, frames = np.dtype(f"<u{one['width']}"), memoryview(one["frames"])
        for i, k in enumerate(one["ids"]):
            yield row, i, k, np.frombuffer(open_.decompress(frames[one["offsets"][i] : one["offsets"][i + 1]]), kind)


def read_documents(spark: SparkSession, files: TokenFiles, keys: Iterable[int] | None = None) -> DataFrame:
    """(key, ids) of all documents, or of the given ones: then only blocks whose range can hold them are read, and only their frames are opened."""
    dictionary, blocks = files.dictionary(spark), files.blocks(spark)
    wanted = None if keys is None else frozenset(keys)
    if wanted is not None:
        blocks = blocks.where(F.exists(F.array(*[F.lit(k).cast("long") for k in sorted(wanted)]), lambda k: k.between(F.col("first_id"), F.col("last_id")))) if wanted else blocks.limit(0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor(dict_data=_zstd(dictionary))
        for batch in batches:
            for row in range(batch.num_rows):
                ids, offsets, width = (batch.column(c)[row].as_py() for c in ("ids", "offsets", "width"))
                frames = memoryview(batch.column("frames")[row].as_py())
                some = [i for i, k in enumerate(ids) if wanted is None or k in wanted]
                found = [np.frombuffer(open_.decompress(frames[offsets[i] : offsets[i + 1]]), np.dtype(f"<u{width}")).astype(np.int64) for i in some]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in some], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["key", "ids"])

    return blocks.mapInArrow(tidy(rows, keep=True), "key long, ids array<long>")


def summaries(spark: SparkSession, files: TokenFiles, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, read from the files: start counts the ids of all documents before it."""
    dictionary, blocks = files.dictionary(spark), files.blocks(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards, starts = batch.column("shard").to_pylist(), batch.column("start_in_shard").to_pylist()
            out: list[tuple] = []
            for row, i, k, ids in _frames(batch, dictionary):
                at = starts[row] if i == 0 else at + before  # noqa: F821
                before = len(ids)
                out.append((shards[row], k, at, before, zlib.crc32(ids.astype("<u4").tobytes())))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.int64()] * 4), strict=True)], names=["shard", key, "at", "n_tokens", "ids_crc32"])

    each = blocks.select("shard", "start_in_shard", "dictionary", "width", "ids", "offsets", "frames").mapInArrow(tidy(rows, keep=True), f"shard int, `{key}` long, at long, n_tokens long, ids_crc32 long")
    # a row for each shard, that is for each write task
    shards = blocks.groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    before = shards.select("shard", F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return each.join(F.broadcast(before), "shard").select(key, (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
