"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, the warehouse on a cluster,
    which is shared too, and a temporary folder in local mode, where all tasks run on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        set_by_hand = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = set_by_hand.get() if set_by_hand.isDefined() else None
    if not at:
        local = spark.sparkContext.master.startswith("local")
        at = "file://" + tempfile.mkdtemp(prefix="strandkv-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/strandkv-stages"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


#: Folders of staged tables, and those still to be removed at exit.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_LEFT: set[str] = set()


def _clear(spark: SparkSession) -> None:
    while _LEFT:
        remove(spark, _LEFT.pop())


def stage(df: DataFrame, name: str, drop: tuple[DataFrame, ...] = (), **options: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts lineage, survives lost executors.

    drop: staged tables that nothing after this one reads; they are removed once this one is written, and the shuffle
    files of finished jobs with them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    if not _LEFT:
        atexit.register(_clear, spark)
    _LEFT.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    if drop:
        discard(*drop)
    return out


def behind(df: DataFrame, staged: DataFrame) -> DataFrame:
    """``df``, which reads ``staged`` alone, so that dropping it drops that."""
    _FOLDERS[df] = _FOLDERS[staged]
    return df


def discard(*staged: DataFrame) -> None:
    """Remove staged tables, and the shuffle files of finished jobs."""
    for df in staged:
        path = _FOLDERS.pop(df, None)
        if path:
            _LEFT.discard(path)
            remove(df.sparkSession, path)
    release(staged[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let the driver's collector find the plans that are done: Spark then deletes their shuffle files on all executors.
    The last job's plan is held a moment longer, by events on their way to listeners, hence the second call."""
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.5)
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` documents, so that long texts fit in a Python worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


#: Bytes of texts that are split at a time.
PORTION = 8 << 20
#: ASCII punctuation, without the apostrophe.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
_IS_MARK, _IS_ALNUM = (np.array([f(chr(c)) for c in range(256)]) for f in (MARKS.__contains__, lambda c: c.isascii() and c.isalnum()))


def gathered(batches: Iterator[pa.RecordBatch], column: int = 1, least: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Batches joined until their texts hold ``least`` bytes: chunks that they share are then looked up once."""
    own: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        own.append(b)
        size += b.column(column).nbytes
        if size >= least:
            yield pa.concat_batches(own)
            own, size = [], 0
    if own:
        yield pa.concat_batches(own)


def portions(column: pa.Array, most: int = PORTION) -> Iterator[tuple[bytes, np.ndarray]]:
    """UTF-8 bytes of some texts in a row, and where each starts and ends; null counts as empty. One text at least."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield column.buffers()[2][int(offsets[a]) : int(offsets[b])].to_pybytes() if offsets[b] > offsets[a] else b"", offsets[a : b + 1] - offsets[a]
        a = b


def marks_after_letters(x: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 are punctuation after a letter or digit of ASCII or after a letter from U+00C0 to U+024F."""
    letter, out = _IS_ALNUM[x], np.zeros(len(x), bool)
    at = np.flatnonzero((x >= 0xC3) & (x <= 0xC9))  # all of them letters, but for two signs
    letter[at[(x[at] != 0xC3) | ((x[at + 1] != 0x97) & (x[at + 1] != 0xB7))] + 1] = True
    np.logical_and(_IS_MARK[x[1:]], letter[:-1], out=out[1:])
    return out


def slices(x: np.ndarray, starts: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The bytes from each start to the next, texts' starts included, and how many come before each text."""
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.flatnonzero(starts)
    found = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(x)).astype(np.int32)), pa.py_buffer(x)])
    return found.dictionary_encode(), np.searchsorted(at, offsets)


_MIX = tuple(np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 30, 27, 31))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    a, b, c, d, e = _MIX
    with np.errstate(over="ignore"):
        x = (x ^ (x >> c)) * a
        x = (x ^ (x >> d)) * b
        return x ^ (x >> e)


def five_bytes(h: np.ndarray) -> bytes:
    """The low five bytes of each hash."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def from_five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def look_up(rows: DataFrame, table: DataFrame, key: str, total: int, share: int = 1000) -> DataFrame:
    """``rows``, ``total`` of them, joined to ``table`` on the key, inner; table: key, unique, n, how many of the rows
    have it, and other columns.

    Keys that more than one in ``share`` rows have are fewer than ``share``, however many rows there are: those are
    broadcast, so that no task gets all rows of one key; the others are joined by a shuffle."""
    is_hot = F.col("n") * share > total
    hot, cold = table.where(is_hot).drop("n"), table.where(~is_hot).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def shuffle_parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(cols or ("doc_id", "text")))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))
