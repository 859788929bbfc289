"""Best-fit packing of tokenised documents into fixed-length sequences, by linear grouping.

All decisions are made on the histogram of piece lengths, which has at most ``capacity`` entries however many documents
there are. Large lengths are sorted, cut into groups of equal cardinality and rounded up to each group's largest; a
linear program over configurations of these few sizes (columns from a knapsack) tells how many sequences take which
configuration; actual lengths are then put in for the rounded ones, and the space that is left in each sequence, with
new sequences where none has room, goes to the small pieces by best fit, longest first. The plan is a table of runs
"the pieces of length L with ranks a..b go to sequences s.., k to each, from offset o"; each piece finds its place from
its length and its rank among equal lengths. Ranks are counted in salted buckets, so that no length meets in one task.

Cases: null text counts as empty and is the end id alone; null ids and repeated rows are pieces of their own; an empty
table gives an empty result; a document longer than the capacity is cut, no other; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import gathered, shuffle_parts, small_batches, stage
from .tokens import ChunkEncoder


def _best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most worth that fits, and how often each size is taken. Round by round one item more is
    allowed, so a round is a few vector operations over all capacities."""
    value, choices = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        best, choice = value, np.full(capacity + 1, -1, np.int16)
        now = np.zeros(capacity + 1)
        for k, (s, y) in enumerate(zip(sizes.tolist(), worth.tolist())):
            if y <= 0:
                continue
            got = best[: capacity + 1 - s] + y
            better = got > now[s:] + 1e-12
            now[s:][better] = got[better]
            choice[s:][better] = k
        if not (now > value + 1e-12).any():
            break
        keep = value > now
        choice[keep] = -1
        value = np.maximum(now, value)
        choices.append(choice)
    takes, c = np.zeros(len(sizes), np.int64), capacity
    for choice in reversed(choices):
        if choice[c] >= 0:
            takes[choice[c]] += 1
            c -= int(sizes[choice[c]])
    return float(value[capacity]), takes


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(how often each size is taken, number of sequences), together exactly the demand: the linear program's whole
    part, and first-fit for the few items that its fractions leave."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x = inverse @ demand
        prices = inverse.T @ np.ones(k)
        value, takes = _best_configuration(sizes, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-6:
            break
        way = inverse @ takes
        up = way > 1e-9
        if not up.any():
            break
        ratio = np.where(up, np.maximum(x, 0) / np.where(up, way, 1), np.inf)
        basis[:, int(ratio.argmin())] = takes
    x = np.maximum(np.linalg.solve(basis, demand), 0)
    out, left = [], demand.astype(np.int64).copy()
    for j in range(k):
        takes = np.rint(basis[:, j]).astype(np.int64)
        n = int(x[j] + 1e-6)
        n = min([n, *(int(left[i] // takes[i]) for i in np.flatnonzero(takes))])
        if n > 0:
            out.append((takes, n))
            left -= n * takes
    open_: list[list] = []  # [free, takes], of the few items left
    for j in np.argsort(-sizes, kind="stable"):
        for _ in range(int(left[j])):
            best = min((b for b in open_ if b[0] >= sizes[j]), key=lambda b: b[0], default=None)
            if best is None:
                best = [capacity, np.zeros(k, np.int64)]
                open_.append(best)
            best[0] -= int(sizes[j])
            best[1][j] += 1
    return out + [(b[1], 1) for b in open_]


def plan(counts: np.ndarray, capacity: int, groups: int = 40, small: int | None = None) -> tuple[np.ndarray, int]:
    """From counts[length], rows (length, first rank, pieces, first sequence, pieces a sequence, offset) and the number
    of sequences."""
    small = capacity // 8 if small is None else small
    runs: list[tuple[int, int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # free space -> (first sequence, sequences)
    levels: list[int] = []
    sequences = 0

    def leave(space: int, first: int, n: int) -> None:
        if n > 0:
            if space not in free:
                free[space] = []
                insort(levels, space)
            free[space].append((first, n))

    lengths = [length for length in range(capacity, small, -1) if counts[length]]
    if lengths and lengths[0] == capacity:
        runs.append((capacity, 0, int(counts[capacity]), 0, 1, 0))
        sequences = int(counts[capacity])
        lengths = lengths[1:]
    if lengths:
        lens = np.array(lengths)
        ends = np.cumsum(counts[lens])  # ranks from the longest down
        total = int(ends[-1])
        step = -(-total // groups)
        starts = np.arange(0, total, step)
        sizes = lens[np.searchsorted(ends, starts, "right")]  # each group's largest
        demand = np.diff(np.append(starts, total))
        at = starts.copy()
        for takes, n in configurations(sizes, demand, capacity):
            slots = []
            for j in np.flatnonzero(takes):
                for _ in range(int(takes[j])):
                    slots.append(int(at[j]))
                    at[j] += n
            edges = {0, n}
            for s in slots:
                lo, hi = np.searchsorted(ends, [s, s + n - 1], "right")
                edges.update(int(e) - s for e in ends[lo:hi])
            cuts = sorted(e for e in edges if 0 <= e <= n)
            for a, b in zip(cuts, cuts[1:]):
                used = 0
                for s in slots:
                    k = int(np.searchsorted(ends, s + a, "right"))
                    length = int(lens[k])
                    runs.append((length, s + a - int(ends[k] - counts[length]), b - a, sequences + a, 1, used))
                    used += length
                leave(capacity - used, sequences + a, b - a)
            sequences += n
    for length in range(min(small, capacity), 0, -1):
        left, rank = int(counts[length]), 0
        while left:
            at_level = bisect_left(levels, length)
            if at_level == len(levels):
                n = -(-left // (capacity // length))
                leave(capacity, sequences, n)
                sequences += n
                continue
            space = levels[at_level]
            first, n = free[space].pop()
            if not free[space]:
                del free[space]
                levels.pop(at_level)
            each = space // length
            whole = min(n, left // each)
            if whole:
                runs.append((length, rank, whole * each, first, each, capacity - space))
                leave(space - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < n:
                if left and left < each:
                    runs.append((length, rank, left, first + whole, left, capacity - space))
                    leave(space - left * length, first + whole, 1)
                    rank, left, whole = rank + left, 0, whole + 1
                leave(space, first + whole, n - whole)
    return np.array(sorted(runs), np.int64).reshape(-1, 6), sequences


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ChunkEncoder.shared(path)
        end = np.array([end_id], enc.dtype)
        for b in gathered(batches):
            rows: list[tuple] = []
            for doc, x in zip(b.column(0).to_pylist(), enc.encode(b.column(1))):
                x = np.concatenate([x, end]).astype("<u4")
                for n, s in enumerate(range(0, len(x), capacity)):
                    part = x[s : s + capacity]
                    rows.append((doc, n, s, len(part), zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None))
            cols = list(zip(*rows)) or [()] * 6
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(cols[k], pa.int64()) for k in (2, 3, 4))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(cols[5], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)
        enc.rest()

    small_batches(docs.sparkSession)
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, kind)


def place(found: DataFrame, capacity: int, groups: int = 40, small: int | None = None) -> DataFrame:
    """``found`` (with doc_id, piece, length; read several times, so best a table) with sequence_id and offset."""
    parts = shuffle_parts(found.sparkSession)
    counts = np.zeros(capacity + 1, np.int64)
    for r in found.groupBy("length").count().collect():  # at most one row a length
        counts[r["length"]] = r["count"]
    runs, _ = plan(counts, capacity, groups, small)
    # buckets of a length: enough that none holds more than a small share of the rows
    most = max(500, int(counts.sum()) // (8 * parts))
    per = F.lit([int(-(-c // most)) or 1 for c in counts])
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.get(per, F.col("length").cast("int"))).alias("_b")
    rows = found.withColumn("_b", bucket)
    sums = rows.groupBy("length", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_b")) - F.col("_n")
    sums = sums.select(F.col("length").alias("_l"), F.col("_b").alias("_lb"), before.alias("_before"))
    # fewer rows than lengths plus 8 a shuffle partition
    rows = rows.join(F.broadcast(sums), (F.col("length") == F.col("_l")) & (F.col("_b") == F.col("_lb")))
    at = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece")) - 1
    rows = rows.withColumn("_rank", F.col("_before") + at).drop("_b", "_l", "_lb", "_before")
    key = (runs[:, 0] << 48) + runs[:, 1]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            r = runs[np.searchsorted(key, (length << 48) + rank, "right") - 1]
            k = rank - r[:, 1]
            sequence, offset = r[:, 3] + k // r[:, 4], r[:, 5] + k % r[:, 4] * length
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kept = found.columns
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"
    return rows.mapInArrow(find, kind)


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return place(stage(pieces(docs, path, capacity, end_id, id_col, text_col, with_ids), "pieces"), capacity)
