r"""Token ids as binary blocks: frequency-ranked ids, one to four bytes each, lengths in separate control bytes.

Every text is encoded once and every id of the corpus counted; ids are ranked by falling count, so the 256 most frequent take one byte.
Each id's byte length is two bits in a control stream, four ids to a control byte, and the data bytes follow in a
stream of their own; a document starts at a control byte. Decoding looks each control byte up in a 256-entry table.

Documents go to ranges of ascending doc_id (bounds from quantiles of the ids alone), are sorted there, and are written
as blocks through Spark's own writer, which commits whole tasks: files can lie in any store that Spark reaches, and a
lost executor's task runs again. A dataset folder holds ``blocks`` (shard, block, start_in_shard, n_docs, n_ids,
payload) and ``ranks`` (rank, id).

Cases: null text counts as empty and has the end id alone; null ids come first; repeated rows are written once each,
next to each other; an empty table gives an empty dataset; extra columns are ignored.
"""

from __future__ import annotations

import atexit
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gathered, remove, shared_dir, shuffle_parts, small_batches, stage
from .tokens import ChunkEncoder, vocabulary

MAGIC = b"TIDX1\0\0\0"
_SIZES = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)  # lengths by control byte


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of uint32 ranks."""
    if not len(ranks):
        return b"", b""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    code = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    code[: len(ranks)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    keep = np.arange(4, dtype=np.uint8) < size[:, None]
    return control.astype(np.uint8).tobytes(), ranks.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ranks of documents in a row; counts has each document's number of ids, and each starts at a control byte."""
    size = _SIZES[control].reshape(-1)
    slots = -(-counts // 4) * 4
    ends = np.cumsum(slots)
    place = np.arange(len(size))
    doc = np.repeat(np.arange(len(counts)), slots)
    size = size[place - (ends - slots)[doc] < counts[doc]].astype(np.int64)
    first = np.cumsum(size) - size
    data = np.concatenate([data, np.zeros(3, np.uint8)])
    out = data[first].astype(np.uint32)
    for k in (1, 2, 3):
        at = np.flatnonzero(size > k)
        out[at] |= data[first[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block(rows: list[tuple[int | None, int, bytes, bytes]]) -> bytes:
    """A block of (doc_id, number of ids, control, data)."""
    n = len(rows)
    head = np.array([r[0] or 0 for r in rows], "<i8").tobytes() + np.array([r[0] is None for r in rows], np.uint8).tobytes()
    head += np.array([r[1] for r in rows], "<u4").tobytes() + np.array([[len(r[2]), len(r[3])] for r in rows], "<u4").tobytes()
    return MAGIC + np.array([n], "<u8").tobytes() + head + b"".join(r[2] for r in rows) + b"".join(r[3] for r in rows)


def read_block(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, number of ids of each, and all ranks."""
    if payload[:8] != MAGIC:
        raise ValueError("not a block of token ids")
    n, at = int(np.frombuffer(payload, "<u8", 1, 8)[0]), 16
    ids = np.frombuffer(payload, "<i8", n, at)
    none = np.frombuffer(payload, np.uint8, n, at + 8 * n)
    counts = np.frombuffer(payload, "<u4", n, at + 9 * n).astype(np.int64)
    lens = np.frombuffer(payload, "<u4", 2 * n, at + 13 * n).reshape(-1, 2).sum(axis=0, dtype=np.int64)
    at += 21 * n
    ranks = unpack(np.frombuffer(payload, np.uint8, lens[0], at), np.frombuffer(payload, np.uint8, lens[1], at + lens[0]), counts)
    return [None if x else int(i) for i, x in zip(ids, none)], counts, ranks


def encoded(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """doc_id, ids: little-endian ids of each text, two bytes each if the vocabulary allows, else four."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ChunkEncoder.shared(path)
        end = np.array([] if end_id is None else [end_id], enc.dtype).tobytes()
        for b in gathered(batches):
            ids = [x.tobytes() + end for x in enc.encode(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])
        enc.rest()

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids binary")


def id_counts(ids: DataFrame, dtype: np.dtype, size: int) -> np.ndarray:
    """Occurrences of every id over all documents; one row for each task and id met is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), dtype), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    rows = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:  # at most one row for each id of the vocabulary
        out[r["id"]] = r["n"]
    return out


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, block_ids: int = 1 << 18) -> None:
    """Encode every text and write the dataset in ascending id order."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or shuffle_parts(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dtype, size = ChunkEncoder.shared(path).dtype, vocabulary(path) + (end_id or 0) + 1
    # encoding costs most, so its result is kept while ids are counted and then coded
    tokens = stage(encoded(docs, path, end_id), "token-ids", compression="zstd")
    counts = id_counts(tokens, dtype, size)
    order = np.argsort(-counts, kind="stable")
    rank_of = np.empty(len(order), np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    used = int((counts > 0).sum())
    spark.createDataFrame(pa.table({"rank": pa.array(np.arange(used)), "id": pa.array(order[:used])})).coalesce(1).write.parquet(f"{folder}/ranks")
    cuts = docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)] or [0.5], 10 * parts).alias("q")).first()["q"] or []
    cuts = np.unique(np.array(cuts[: parts - 1], np.int64))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.frombuffer(x, dtype) for x in b.column(1).to_pylist()]
            packed = [pack(rank_of[x]) for x in got]
            part = np.searchsorted(cuts, b.column(0).fill_null(-(2**63)).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column(0), pa.array([len(x) for x in got], pa.int64()), pa.array([p[0] for p in packed], pa.binary()), pa.array([p[1] for p in packed], pa.binary())], ["p", "doc_id", "n", "control", "data"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, number, start, rows, n = TaskContext.get().partitionId(), 0, 0, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()), pa.array([len(rows)], pa.int64()), pa.array([n], pa.int64()), pa.array([block(rows)], pa.binary())], ["shard", "block", "start_in_shard", "n_docs", "n_ids", "payload"])

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(1, 5))):
                rows.append(row)
                n += row[1]
                if n >= block_ids:
                    yield out()
                    number, start, rows, n = number + 1, start + n, [], 0
        if rows:
            yield out()

    coded = tokens.mapInArrow(code, "p int, doc_id long, n long, control binary, data binary")
    placed = coded.repartitionById(len(cuts) + 1, F.col("p")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "data")
    placed.mapInArrow(blocks, "shard int, block int, start_in_shard long, n_docs long, n_ids long, payload binary").write.parquet(f"{folder}/blocks", compression="none")


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids)."""
    table = spark.read.parquet(f"{folder}/ranks").orderBy("rank").toPandas()["id"].to_numpy(np.uint32)  # one row for each id of the vocabulary
    files = spark.read.parquet(f"{folder}/blocks")
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()  # one row a shard
    first, at = {}, 0
    for r in totals:
        first[r["shard"]] = at
        at += r["n"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, start, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                docs, counts, ranks = read_block(payload)
                ids = table[ranks]
                ends = np.cumsum(counts)
                each = [ids[e - n : e] for e, n in zip(ends, counts)]
                cols = [pa.array(docs, pa.int64()), pa.array(first[shard] + start + ends - counts), pa.array(counts), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return files.select("shard", "start_in_shard", "payload").mapInArrow(decode, kind)


def round_trip(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    folder = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    atexit.register(remove, docs.sparkSession, folder)
    write_tokens(docs, folder, path, end_id)
    return read_tokens(docs.sparkSession, folder)
