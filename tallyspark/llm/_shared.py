"""Shared folder, intermediate tables and Arrow helpers of the operators."""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled by one numpy pass, longer texts in windows; temporaries are about 60 times this.
CHUNK_BYTES = 1 << 19


_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local session without it, as in a test, gets a new local folder, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="tallyspark-"))
    return _own_folder[0]


def fresh(columns: Iterable[str], stem: str) -> str:
    """A column name that none of ``columns`` has, in any case."""
    taken = {c.lower() for c in columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def saved(frame: DataFrame, name: str, scratch: list[str] | None = None, batch: int | None = None) -> DataFrame:
    """``frame`` as a table in the shared folder: computed once, with no lineage to rerun when an executor is lost.

    Its path goes to ``scratch``, for ``dropped``. ``batch`` is the rows of Arrow batches while it is written; the
    session's own setting is back behind it.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.getAll.get(rows)
    try:
        if batch:
            spark.conf.set(rows, str(batch))
        frame.write.parquet(path)
    finally:
        if batch and before is None:
            spark.conf.unset(rows)
        elif batch:
            spark.conf.set(rows, before)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(frame.schema).parquet(path)


def dropped(spark: SparkSession, scratch: list[str]) -> None:
    """Deletes tables that nothing reads any more."""
    for path in scratch:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    scratch.clear()


#: Batches that a task hands on until freed memory goes back to the system.
GIVE_BACK = 16
#: What a worker keeps from task to task, such as tokenizers.
kept: list[dict] = []


def tidy(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``rows`` as a task that leaves its worker small: freed memory goes back to the system, and unless ``keep``, what other operators have kept goes too.

    Workers live on between stages, so what one stage has used would otherwise count against all later ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            clear_kept()
        try:
            for i, batch in enumerate(rows(batches), 1):
                yield batch
                if i % GIVE_BACK == 0:
                    give_back()
        finally:
            give_back()

    return run


def clear_kept() -> None:
    for one in kept:
        one.clear()


def give_back() -> None:
    """Hands freed memory back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def whole_text(column: str = "text"):
    """The text, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id's decimal text; null ids count as the text 'null'."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary"))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array, without copying; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    found = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), found


def spans(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes, or one longer row."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(end, rows)
        at = min(end, rows)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Ones over the first 0 to 8 bytes of a little-endian word.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer spans are hashed and compared one by one.
LONG_SPAN = 256


def byte_windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a little-endian word, without copying them for each; zeros behind the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))


def span_word(windows: np.ndarray, starts: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th word of spans that have ``left`` bytes from it on."""
    return windows[starts + 8 * k] & FIRST_BYTES[np.minimum(left, 8)]


class SpanHash:
    """64-bit hashes of many byte spans of one buffer.

    Each word of eight bytes goes through a bijective mix of the state, which the length begins, so spans of one
    length up to eight bytes never share a hash and longer ones only by chance; long spans go through BLAKE2.
    """

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = (ends - starts).astype(np.int64)
        out = mixed(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
        if not len(size):
            return out
        windows = byte_windows(data)
        live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
        k = 0
        while len(live):
            out[live] = mixed(out[live] ^ span_word(windows, starts[live], size[live] - 8 * k, k))
            k += 1
            live = live[size[live] > 8 * k]
        for i in np.flatnonzero(size > LONG_SPAN).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
        return out


def gathered(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of flat[start : start + count]."""
    total = int(counts.sum())
    if not total:
        return flat[:0]
    shift = starts - (np.cumsum(counts) - counts)
    return flat[np.repeat(shift, counts) + np.arange(total)]
