r"""Removal of repeated byte strings across documents, by suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id. Strings are
judged on the input and never cross documents.

Sorting every suffix of the corpus would send each many times, so only those that can matter are sorted, exactly:

1. Every string of ``length`` bytes holds an anchor, the k-byte gram of least hash in it, and equal strings hold the
   same anchor at the same place. Each document's anchors are sent as packed hashes, by hash range; those of a second
   document in the same range are found again there.
2. Anchors that two or more documents hold go back to their documents, which send the bytes round each: all strings
   of ``length`` bytes whose anchor it is. Equal surroundings in one task are sent once, for the document of least id.
3. A range's surroundings are one text, whose suffixes are sorted deep-shallow: multikey quicksort by eight-byte
   characters to a shallow depth, then a blind trie for each group that shares a longer prefix: members are compared
   once with a leaf, leave its path by a branch, and go on in a trie of their own, blind to the bytes above. Neighbours that agree on ``length`` bytes are equal strings; those of
   documents above the least id among them are marked.
4. Marks go back to their documents, where the covered bytes are removed.

What is equal in full needs no sorting and is pre-aggregated: of equal texts, found by digest, only the document of least
id is searched, the others lose all; of equal surroundings in one task only those of the least document are sorted.

Cases: null text counts as empty; a null id counts as larger than any other; rows that repeat an id are one document
for this purpose and don't remove each other's bytes; texts shorter than ``length`` stay; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import five_bytes, from_five, look_up, mixed, shuffle_parts, small_batches, stage

U = np.uint64
_A, _B = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9)
GRAM = 24
NULL_ID = 2**63 - 1


def eights(data: np.ndarray) -> np.ndarray:
    """At each position the eight bytes from there as a big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(len(data) + 8, U)
    for k in range(8):
        part = padded[k : k + (len(data) + 8 - k + 7) // 8 * 8]
        part = part[: len(part) // 8 * 8].view(">u8")
        out[k::8][: len(part)] = part[: len(out[k::8])]
    return out[: len(data)]


def _sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each w neighbours, by doubling."""
    f, size = np.minimum if least else np.maximum, 1
    while 2 * size <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors and their hashes, in documents that end at ``ends`` one after the other."""
    n, w = len(data), length - GRAM + 1
    if n < length:
        return np.empty(0, np.int64), np.empty(0, U)
    e = eights(data)
    with np.errstate(over="ignore"):
        h = mixed(e[: n - GRAM + 1] * _A)
        for k in range(8, GRAM, 8):
            h = mixed(h ^ (e[k : n - GRAM + 1 + k] * _B + U(k)))
    low = _sliding(h, w, True)  # of each string of ``length`` bytes
    # strings that cross documents have no say
    start = np.arange(len(low))
    doc_end = ends[np.searchsorted(ends, start, "right")]
    inside = start + length <= doc_end
    say = np.where(inside, low, U(0))
    top = _sliding(np.concatenate([np.zeros(w - 1, U), say, np.zeros(w - 1, U)]), w, False)[: len(h)]
    at = np.flatnonzero((top == h) & (h > 0))
    return at, h[at]


def deep_shallow(text: np.ndarray, suffixes: np.ndarray, depth: int, shallow: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """``suffixes`` (positions with at least ``depth`` bytes after them) in the order of their first ``depth`` bytes,
    and for each whether it differs in those from the one before."""
    e = eights(text)
    # multikey quicksort: eight bytes are one character; each character only parts groups that are equal so far
    order = np.argsort(e[suffixes], kind="stable")
    at = suffixes[order]
    key = e[at]
    new = np.append(True, key[1:] != key[:-1]) if len(at) else np.empty(0, bool)
    for d in range(8, shallow, 8):
        group = np.cumsum(new)
        sizes = np.bincount(group)
        tied = np.flatnonzero(sizes[group] > 1)
        if not len(tied):
            break
        key = e[at[tied] + d]
        order = np.lexsort((key, group[tied]))
        at[tied] = at[tied[order]]
        key = key[order]
        g = group[tied]
        new[tied[1:]] |= (key[1:] != key[:-1]) & (g[1:] == g[:-1])
    return blind_tries(e, at, new, depth, shallow)


def blind_tries(e: np.ndarray, at: np.ndarray, new: np.ndarray, depth: int, known: int) -> tuple[np.ndarray, np.ndarray]:
    """Orders the groups of ``at`` that agree on ``known`` bytes, all groups at once; ``new`` starts a group.

    Each group is a trie whose first leaf is its first member. A round compares every member with that leaf, once, from
    the known depth on: where it first differs, and by which eight bytes, is the branch at which it leaves the leaf's
    path. Members that leave by the same branch go on as a trie of their own, blind to the bytes above it; members that
    agree with the leaf in full stay beside it.
    """
    deep = np.full(len(at), known)  # bytes on which a member is known to agree with its group
    done = np.zeros(len(at), bool)
    while True:
        group = np.cumsum(new) - 1
        open_ = np.flatnonzero((np.bincount(group)[group] > 1) & ~done) if len(at) else at
        if not len(open_):
            return at, new
        first = np.flatnonzero(np.append(True, group[open_][1:] != group[open_][:-1]))
        leaf = np.repeat(at[open_[first]], np.diff(np.append(first, len(open_))))
        own, pos = at[open_], deep[open_]
        branch, side, word = np.full(len(own), depth), np.zeros(len(own), np.int8), np.zeros(len(own), U)
        left = np.arange(len(own))
        while len(left):
            left = left[pos[left] < depth]
            cut = np.maximum(pos[left] + 8 - depth, 0).astype(U) * U(8)  # bytes beyond the depth have no say
            a, b = e[own[left] + pos[left]] >> cut, e[leaf[left] + pos[left]] >> cut
            other = a != b
            leave = left[other]
            branch[leave], word[leave], side[leave] = pos[leave], a[other], np.where(a[other] < b[other], -1, 1)
            left = left[~other]
            pos[left] += 8
        # on the smaller side who leaves first comes first, on the larger side last
        turn = branch * -side.astype(np.int64)
        order = np.lexsort((word, turn, side, group[open_]))
        at[open_] = own[order]
        branch, side, word = branch[order], side[order], word[order]
        new[open_[1:]] |= (group[open_][1:] == group[open_][:-1]) & ((side[1:] != side[:-1]) | (branch[1:] != branch[:-1]) | (word[1:] != word[:-1]))
        deep[open_] = branch + 8
        done[open_] = side == 0


def repeated(contexts: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Surroundings of anchors, and their documents: runs (number of the surroundings, first and last + 1 start within
    them) of the strings of ``length`` bytes that a smaller document in the list holds too."""
    sizes = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    counts = sizes - length + 1
    owner = np.repeat(np.arange(len(contexts)), counts)
    starts = begin[owner] + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    # the suffix array of the starts; the owner of each is found by its place
    at, new = deep_shallow(text, starts, length)
    own = np.searchsorted(begin, at, "right") - 1
    least = np.minimum.reduceat(docs[own], np.flatnonzero(new))[np.cumsum(new) - 1]
    hit = docs[own] > least
    own, at = own[hit], at[hit]
    order = np.lexsort((at, own))
    own, at = own[order], at[order]
    new = np.append(True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)) if len(own) else np.empty(0, bool)
    last = np.append(np.flatnonzero(new)[1:], len(own)) - 1 if len(own) else np.empty(0, np.int64)
    return own[new], at[new] - begin[own[new]], at[last] + 1 - begin[own[new]]


def _merged(runs: np.ndarray) -> np.ndarray:
    """Runs that touch become one."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(runs[:, 1])
    new = np.append(True, runs[1:, 0] > reach[:-1])
    return np.stack([runs[new, 0], reach[np.append(np.flatnonzero(new)[1:], len(runs)) - 1]], 1)


def _cover(runs: np.ndarray, length: int, n: int) -> np.ndarray:
    """Bytes of n that strings of ``length`` with starts in the runs cover."""
    gone = np.zeros(n, bool)
    for a, b in _merged(runs).tolist():
        gone[a : b - 1 + length] = True
    return gone


def _digest(raw: bytes, gone: np.ndarray | None) -> tuple[int, int, str]:
    """n_removed, n_spans, kept_sha256."""
    if gone is None or not gone.any():
        return 0, 0, hashlib.sha256(raw).hexdigest()
    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()


def _short(h: np.ndarray) -> np.ndarray:
    """40 of the bits below those that pick the range; equal ones by chance cost time only."""
    return (h << U(16)) >> U(24)


def _by_text(d: np.ndarray, k: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Runs of marked starts, those that touch made one, as a row for each document and text."""
    order = np.lexsort((a, k, d))
    d, k, a, b = d[order], k[order], a[order], b[order]
    group = np.cumsum(np.append(True, (d[1:] != d[:-1]) | (k[1:] != k[:-1]))) if len(d) else np.empty(0, np.int64)
    low, reach = (group << 33) + a, np.maximum.accumulate((group << 33) + b)
    new = np.append(True, low[1:] > reach[:-1]) if len(d) else np.empty(0, bool)
    at = np.flatnonzero(new)
    ends = reach[np.append(at[1:], len(d)) - 1] - (group[at] << 33) if len(d) else at
    runs = np.stack([a[at], ends], 1).astype("<u4")
    cuts = np.append(np.flatnonzero(np.append(True, group[at][1:] != group[at][:-1])), len(at)) if len(d) else np.zeros(1, np.int64)
    heads = at[cuts[:-1]]
    return pa.array(d[heads], pa.int64()), pa.array(k[heads], pa.int64()), pa.array([runs[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary())


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", hot: int = 20_000, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that remain).

    Strings round anchors that more than ``hot`` documents hold are dealt by their own content, one by one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ranges = max(64, 2 * shuffle_parts(spark))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # d stands for the document, k tells texts apart where rows repeat an id
    rows = rows.withColumns({"d": F.coalesce("doc_id", F.lit(NULL_ID)), "k": F.xxhash64("text")})
    wide = rows.where(F.octet_length("text") >= length)

    # whole copies: of equal texts only the document of least id takes part, the others lose all strings
    same = wide.select("d", "k", F.octet_length("text").alias("n"), F.unhex(F.sha2("text", 256)).alias("sha"))
    same = stage(same, "digests")
    least = same.groupBy("sha").agg(F.min("d").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    lost = look_up(same.withColumnRenamed("n", "bytes"), least, "sha", same.count()).where(F.col("d") > F.col("least"))
    lost = stage(lost.select("d", "k", F.col("bytes").alias("n")), "whole-copies")
    # an id all of whose rows are copies of smaller ones has nothing more to find
    done = same.groupBy("d").agg(F.count(F.lit(1)).alias("rows")).join(lost.groupBy("d").agg(F.count(F.lit(1)).alias("lost")), "d").where("rows = lost").select("d")

    # 1. anchors by range of hash: of each its short hash and its document, packed by task
    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            h, d = np.concatenate(hashes), np.concatenate(owner)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
            h, d = h[new], d[new]
            r = (h >> U(48)).astype(np.int64) % ranges
            order = np.argsort(r, kind="stable")
            d, r = d[order], r[order]
            short = np.frombuffer(five_bytes(_short(h[order])), np.uint8).reshape(-1, 5)
            base = int(d.min())
            d = (d - base).astype("<u4") if int(d.max()) - base < 1 << 32 else d
            cuts = np.searchsorted(r, np.arange(ranges + 1))
            have = np.flatnonzero(np.diff(cuts)).tolist()
            return pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array([short[cuts[k] : cuts[k + 1]].tobytes() for k in have], pa.binary()), pa.array([d[cuts[k] : cuts[k + 1]].tobytes() for k in have], pa.binary()), pa.array([base] * len(have), pa.int64())], ["r", "h", "d", "base"])

        for b in batches:
            raw = [t.encode() for t in b.column(1).to_pylist()]
            ends = np.cumsum([len(x) for x in raw])
            at, h = anchors(np.frombuffer(b"".join(raw), np.uint8), ends, length)
            hashes.append(h)
            owner.append(b.column(0).to_numpy()[np.searchsorted(ends, at, "right")])
            held += len(h)
            if held > 2_000_000:
                yield out()
                hashes, owner, held = [], [], 0
        if held:
            yield out()

    def shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ds, rs = [], [], []
        for b in batches:
            for r, x, y, base in zip(*(c.to_pylist() for c in b.columns)):
                hs.append(from_five(x))
                ds.append(np.frombuffer(y, "<u4").astype(np.int64) + base if len(y) == 4 * len(hs[-1]) else np.frombuffer(y, np.int64))
                rs.append(np.full(len(hs[-1]), r))
        if not hs:
            return
        h, d, r = np.concatenate(hs), np.concatenate(ds), np.concatenate(rs)
        order = np.lexsort((d, h, r))
        h, d, r = h[order], d[order], r[order]
        first = np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))
        group = np.cumsum(first) - 1
        last = np.append(np.flatnonzero(first)[1:], len(d)) - 1
        hit = (d[first] < d[last])[group]
        h, d, many = h[hit], d[hit], (np.bincount(group) > hot)[group[hit]]
        order = np.argsort(d, kind="stable")
        h, d, many = h[order], d[order], many[order]
        ids, at = np.unique(d, return_index=True)
        cuts = np.append(at, len(d))
        for k in range(0, len(ids), 5000):
            some = [slice(cuts[i], cuts[i + 1]) for i in range(k, min(k + 5000, len(ids)))]
            yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 5000]), pa.array([five_bytes(h[x]) for x in some], pa.binary()), pa.array([five_bytes(h[x][many[x]]) for x in some], pa.binary())], ["d", "h", "many"])

    packed = wide.select("d", "text").mapInArrow(send_anchors, "r int, h binary, d binary, base long")
    found = packed.repartitionById(ranges, F.col("r")).mapInArrow(shared_anchors, "d long, h binary, many binary")
    found = stage(found.join(done, "d", "left_anti").groupBy("d").agg(F.collect_list("h").alias("h"), F.collect_list("many").alias("many")), "shared-anchors", (same,))

    # 2. surroundings of shared anchors; equal ones in a task are sent for the least document, the others marked here
    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[] for _ in range(5)]  # d, k, at, r, h
        texts: list[bytes] = []

        def out() -> pa.RecordBatch:
            d, k, at, r, h = (np.concatenate(c) for c in columns)
            head: dict[bytes, int] = {}
            first = np.empty(len(d), np.int64)
            for i in np.argsort(d, kind="stable").tolist():
                first[i] = head.setdefault(texts[i], i)
            more = d > d[first]
            ends = at + np.fromiter(map(len, texts), np.int64, len(texts)) - length + 1
            md, mk, runs = _by_text(d[more], k[more], at[more], ends[more])
            n = len(md)
            sent = np.flatnonzero(~more)
            put = lambda x, y, kind: pa.concat_arrays([pa.array(x[sent], kind), pa.array(y, kind)])
            # at -1: text holds runs of marks, which may go to any range
            arrays = [put(r, (np.arange(n) + int(r[0])) % ranges, pa.int32()), put(h, np.zeros(n, np.int64), pa.int64()), pa.concat_arrays([pa.array(d[sent]), md]), pa.concat_arrays([pa.array(k[sent]), mk]), put(at, np.full(n, -1), pa.int64())]
            return pa.RecordBatch.from_arrays([*arrays, pa.concat_arrays([pa.array([texts[i] for i in sent.tolist()], pa.binary()), runs])], ["r", "h", "d", "k", "at", "text"])

        for b in batches:
            raw = [t.encode() for t in b.column(2).to_pylist()]
            ends = np.cumsum([len(x) for x in raw])
            whole = b"".join(raw)
            at, h = anchors(np.frombuffer(whole, np.uint8), ends, length)
            doc = np.searchsorted(ends, at, "right")
            lists, many = ([from_five(b"".join(x)) for x in b.column(c).to_pylist()] for c in (3, 4))
            short = _short(h)
            mine = short | (doc.astype(U) << U(40))  # five bytes of hash, then the place of the document in the batch
            keep, over = (np.isin(mine, np.concatenate([x | (U(i) << U(40)) for i, x in enumerate(own)])) for own in (lists, many))
            over = over[keep]
            at, h, doc = at[keep], h[keep], doc[keep]
            begin = ends[doc] - np.array([len(x) for x in raw])[doc]
            lo, hi = np.maximum(at - (length - GRAM), begin), np.minimum(at + length, ends[doc])
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            some = np.flatnonzero(~over)
            texts += [whole[x:y] for x, y in zip(lo[some].tolist(), hi[some].tolist())]
            rows_ = [ids[doc[some]], keys[doc[some]], (lo - begin)[some], ((h >> U(48)).astype(np.int64) % ranges)[some], h.view(np.int64)[some]]
            for i in np.flatnonzero(over).tolist():  # strings one by one
                starts = range(int(lo[i]), int(hi[i]) - length + 1)
                own = [int.from_bytes(hashlib.blake2b(whole[v : v + length], digest_size=8).digest(), "little", signed=True) for v in starts]
                texts += [whole[v : v + length] for v in starts]
                n = len(own)
                single = [np.full(n, ids[doc[i]]), np.full(n, keys[doc[i]]), np.array(starts) - begin[i], np.array(own) % ranges, np.array(own, np.int64)]
                rows_ = [np.concatenate(x) for x in zip(rows_, single)] if n else rows_
            for c, x in zip(columns, rows_):
                c.append(x)
            if len(texts) > 100_000:
                yield out()
                columns, texts = [[] for _ in range(5)], []
        if texts:
            yield out()

    near = wide.join(found, "d").select("d", "k", "text", "h", "many").mapInArrow(surroundings, "r int, h long, d long, k long, at long, text binary")

    # 3. suffix sorting, range by range; rows come sorted by anchor and are taken some anchors at a time
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        size = 0

        def run(table: pa.Table) -> pa.RecordBatch:
            d, k, at = (table[c].to_numpy() for c in ("d", "k", "at"))
            text = table["text"].to_pylist()
            known = np.flatnonzero(at < 0)
            blobs = [np.frombuffer(text[i], "<u4").reshape(-1, 2).astype(np.int64) for i in known.tolist()]
            times = [len(x) for x in blobs]
            pairs = np.concatenate(blobs) if blobs else np.empty((0, 2), np.int64)
            found_ = [(np.repeat(d[known], times), np.repeat(k[known], times), pairs[:, 0], pairs[:, 1])]
            # equal surroundings are sorted once: those of the least document stand for all
            head: dict[bytes, int] = {}
            first = np.arange(len(d))
            for i in np.argsort(d, kind="stable").tolist():
                if at[i] >= 0:
                    first[i] = head.setdefault(text[i], i)
            more = np.flatnonzero(d > d[first])
            ends = at + np.fromiter(map(len, text), np.int64, len(text)) - length + 1
            found_.append((d[more], k[more], at[more], ends[more]))
            if head:
                heads = np.array(list(head.values()))
                slot, a, b_ = repeated([text[i] for i in heads.tolist()], d[heads], length)
                own = heads[slot]
                found_.append((d[own], k[own], a + at[own], b_ + at[own]))
                # the same document again: the runs of the first, at the other place
                again = np.flatnonzero((at >= 0) & (d == d[first]) & (first != np.arange(len(d))))
                place = np.empty(len(d), np.int64)
                place[heads] = np.arange(len(heads))
                lo = np.searchsorted(slot, place[first[again]])
                n = np.searchsorted(slot, place[first[again]], "right") - lo
                source, rep = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum())), np.repeat(again, n)
                found_.append((d[rep], k[rep], a[source] + at[rep], b_[source] + at[rep]))
            return pa.RecordBatch.from_arrays(list(_by_text(*(np.concatenate(x) for x in zip(*found_)))), ["d", "k", "runs"])

        for b in batches:
            rest.append(b)
            size += b.nbytes
            if size > 6_000_000:
                table = pa.Table.from_batches(rest)
                h = table["h"].to_numpy()
                last = int(np.searchsorted(h, h[-1]))
                if last:
                    yield run(table.slice(0, last))
                    rest = table.slice(last).combine_chunks().to_batches()
                    size = sum(x.nbytes for x in rest)
        if size:
            yield run(pa.Table.from_batches(rest))

    placed = near.repartitionById(ranges, F.col("r")).sortWithinPartitions("h").select("h", "d", "k", "at", "text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [np.array([0, n - length + 1], "<u4").tobytes() for n in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(runs, pa.binary())], ["d", "k", "runs"])

    kind = "d long, k long, runs binary"
    marks = placed.mapInArrow(mark, kind).union(lost.mapInArrow(whole, kind)).groupBy("d", "k").agg(F.collect_list("runs").alias("runs"))
    marks = stage(marks, "marks", (found, lost))

    # 4. the result
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = t.encode()
                gone = _cover(np.frombuffer(b"".join(runs), "<u4").reshape(-1, 2).astype(np.int64), length, len(raw)) if runs else None
                kept = (raw if gone is None else np.frombuffer(raw, np.uint8)[~gone].tobytes()) if with_text else None
                out.append((len(raw), *_digest(raw, gone), kept))
            cols = list(zip(*out)) or [()] * 5
            arrays = [b.column(0), *(pa.array(cols[i], pa.int64()) for i in range(3)), pa.array(cols[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(cols[4], pa.binary())] * with_text, names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return rows.join(marks, ["d", "k"], "left").select("doc_id", "text", "runs").mapInArrow(finish, kind)
