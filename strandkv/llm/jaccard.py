r"""Joining documents by the Jaccard similarity of their word n-grams, exactly, with a token-group matrix.

Words are `[^\x20\x09-\x0D]+` after A-Z are lower-cased; a document's set holds its distinct n-word shingles as 64-bit
hashes (with fewer words, the whole sequence as one; without words, nothing, and then it links with no document).

1. Equal sets are one class, told by 128 bits. All that follows is about classes, so copies cost nothing.
2. Two classes at or over the threshold can differ in a bounded number H of shingles. Shingles are dealt by hash into
   more than H parts, so one part at least is equal in both: each class has a hash of each of its parts, for its own
   size and for the sizes of larger classes that it may link with. Parts without shingles are passed over; the number
   of parts exceeds H by E, and a class with more than E empty parts has those too, so no link is lost. What is sent is
   packed by range of hash, five bytes a part and two or four for the class.
3. Classes with an equal part are compared by sketches, the parities of their shingles' counts in as many cells as a set
   has shingles or more: sketches differ in no more cells than sets do in shingles, so no link is lost, while classes
   that have a phrase in common and little else stay apart. A part that more than ``most_alike`` classes have connects
   all of them unseen. What is left connects classes into neighbourhoods; every link lies inside one. Only sets in
   neighbourhoods of two or more are built again and sent, once each.
4. In a neighbourhood, sets that share their least tokens form groups; the token-group matrix holds the tokens of each
   group's union. For each set the matrix gives its overlap with every union, which bounds its overlap with each member,
   and only groups that reach the needed overlap are opened and compared in full. Members that are known to be
   connected are passed over, so a group of near copies takes about one comparison a member.
5. A neighbourhood with more shingles than a task should hold is partitioned into blocks by least token. Each block is
   joined within; then the matrix of the blocks' unions, dealt by range of token, bounds the overlap of each set with
   each other block, and a set is sent only to the blocks that reach the needed overlap and that it isn't connected with.

Cases: null text counts as empty; null ids and repeated rows are documents like any other, and a component's id is the
smallest doc_id in it that isn't null; an empty table gives an empty result; extra columns are ignored. Shingles are told
apart by hashes of 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import behind, five_bytes, from_five, look_up, mixed, release, shuffle_parts, small_batches, stage

U = np.uint64
_A, _C = U(0x9E3779B97F4A7C15), U(0x94D049BB133111EB)


class Shingles:
    """Sorted distinct shingle hashes of texts; remembers words' hashes, up to a bound."""

    def __init__(self, n: int, keep: int = 400_000):
        self.n, self.keep, self.known = n, keep, {}

    def of(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, U)
        known = self.known
        if len(known) > self.keep:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), U, len(words))
        n = min(self.n, len(words))
        with np.errstate(over="ignore"):
            out = np.full(len(words) - n + 1, U(n))
            for k in range(n):
                out = mixed(out * _A + h[k : len(words) - n + 1 + k])
        out.sort()
        return out[np.append(True, out[1:] != out[:-1])]


class Threshold:
    """100 * intersection >= percent * union, and what follows from it."""

    def __init__(self, percent: int):
        self.p = percent
        self.t = percent / 100
        # sizes by bands; wider ones have more parts, narrower ones give a set more bands
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(max(self.edges[-1] + 1, math.ceil(self.edges[-1] * 1.3)))
        self.bounds = np.array(self.edges)

    def linked(self, both: int, a: int, b: int) -> bool:
        return 100 * both >= self.p * (a + b - both)

    def parts(self, band: int) -> tuple[int, int]:
        """For a band of the larger set: number of parts, and how many may be empty."""
        big = self.edges[band + 1] - 1
        # sets of sizes a and b differ in a + b - 2 * overlap shingles, most where both are largest
        h = (100 - self.p) * 2 * big // (100 + self.p)
        if h == 0:
            return 0, 0
        m = h + 1
        e = 3 + math.ceil(3 * m * math.exp(-0.9 * max(1, self.edges[band]) / m))
        return m + e, e

    def bands(self, n: int) -> list[int]:
        """Bands of the larger set for which a set of size n emits parts."""
        own = int(np.searchsorted(self.bounds, n, "right")) - 1
        over = int(np.searchsorted(self.bounds, 100 * n // max(self.p, 1), "right"))
        return list(range(own, max(over, own + 1)))


def part_hashes(s: np.ndarray, t: Threshold) -> np.ndarray:
    """Of a non-empty set: hashes of its parts."""
    out = []
    with np.errstate(over="ignore"):
        weights = mixed(s * _A + U(1))
        for band in t.bands(len(s)):
            m, spare = t.parts(band)
            if not m:  # only equal sets link
                continue
            part = ((weights >> U(32)) * U(m)) >> U(32)
            order = np.argsort(part, kind="stable")
            first = np.flatnonzero(np.diff(part[order], prepend=U(m)))
            sums = np.add.reduceat(weights[order], first)
            names = part[order][first]
            out.append(mixed(sums ^ mixed(names * _A + U(band + 7))))
            if m - len(names) > spare:
                none = np.setdiff1d(np.arange(m, dtype=U), names)
                out.append(mixed(mixed(none * _A + U(band + 7)) ^ _C))
    return np.concatenate(out) if out else np.empty(0, U)


def sketch_of(s: np.ndarray) -> bytes:
    """Parities of the numbers of shingles in cells, a power of two of them, from 64 to 32768."""
    cells = 1 << min(15, max(6, (len(s) - 1).bit_length()))
    at = mixed(s * _A + U(3)) & U(cells - 1)
    odd = np.bincount(at.astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def halved(sketch: np.ndarray) -> np.ndarray:
    """The sketch of half as many cells."""
    half = sketch.shape[-1] // 2
    return sketch[..., :half] ^ sketch[..., half:]


def alike(sizes: np.ndarray, sketches: list[bytes], t: Threshold) -> np.ndarray:
    """Labels (the first member's place) of the sets' components under what sizes and sketches leave open; any two sets
    that link have one label. sizes rise."""
    label = np.arange(len(sizes))
    cells = np.array([len(x) for x in sketches])
    tables, first = {}, {}
    for c in np.unique(cells).tolist():  # sketches grow with sets, so those of one length follow each other
        at = np.flatnonzero(cells == c)
        tables[c], first[c] = np.frombuffer(b"".join(sketches[i] for i in at), U).reshape(len(at), -1), int(at[0])
    low = np.searchsorted(100 * sizes, t.p * sizes)  # the first that is large enough to link
    for q in range(1, len(sizes)):
        c = int(cells[q])
        mine = tables[c][q - first[c]]
        while c in tables and low[q] < first[c] + len(tables[c]):
            a, b = max(int(low[q]), first[c]), min(q, first[c] + len(tables[c]))
            if a < b:
                apart = np.bitwise_count(tables[c][a - first[c] : b - first[c]] ^ mine).sum(1, dtype=np.int64)
                hits = np.unique(label[a:b][apart * (100 + t.p) <= (sizes[a:b] + sizes[q]) * (100 - t.p)])
                if len(hits) and (len(hits) > 1 or hits[0] != label[q]):
                    hits = np.append(hits, label[q])
                    label[np.isin(label, hits)] = hits.min()
            if c == 8:
                break
            c, mine = c // 2, halved(mine)
            while c > 8 and c not in tables:
                c, mine = c // 2, halved(mine)
    return label


class Components:
    """Union-find over 0..n-1; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def link_sets(sets: list[np.ndarray], t: Threshold, known: list[int] | None = None, apart: np.ndarray | None = None, group: int = 16) -> Components:
    """Components of the sets under the threshold, by the token-group matrix. known: labels of sets already connected;
    apart: of two blocks, the number of each set's block, whose own links are known, so only links across are sought."""
    n = len(sets)
    comp = Components(n)
    if known is not None:
        first: dict[int, int] = {}
        for i, k in enumerate(known):
            comp.join(i, first.setdefault(k, i))
    sizes = np.array([len(s) for s in sets])
    # similar sets are near each other: they share their least tokens more often than not
    near = np.lexsort((sizes, [s[min(1, len(s) - 1)] for s in sets], [s[0] for s in sets]))
    group_of = np.empty(n, np.int64)
    group_of[near] = np.arange(n) // group
    members = [near[k : k + group] for k in range(0, n, group)]
    order = np.argsort(sizes, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [at[e - s : e] for e, s in zip(ends, sizes)]
    # the matrix, by token: groups whose union holds it
    cell = np.unique(at * len(members) + np.repeat(group_of, sizes))
    row, col = cell // len(members), cell % len(members)
    starts = np.searchsorted(row, np.arange(len(tokens) + 1))
    low = np.array([sizes[m].min() for m in members])
    high = np.array([sizes[m].max() for m in members])
    mark = np.zeros(len(tokens), bool)
    for q in order.tolist():  # each pair is met at its later set, the larger
        mine, a = own[q], int(sizes[q])
        counts = starts[mine + 1] - starts[mine]
        where = np.repeat(starts[mine] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
        bound = np.bincount(col[where], minlength=len(members))
        need = np.maximum(-(-t.p * a // 100), 1)  # a partner's overlap with q is at least t times q's size
        open_ = np.flatnonzero((bound >= need) & (100 * high >= t.p * a) & (low <= a))
        if not len(open_):
            continue
        mark[mine] = True
        for g in open_[np.argsort(-bound[open_], kind="stable")].tolist():
            for y in members[g].tolist():
                b = int(sizes[y])
                if rank[y] >= rank[q] or b * 100 < t.p * a or (apart is not None and apart[y] == apart[q]) or comp.root(y) == comp.root(q):
                    continue
                if t.linked(int(np.count_nonzero(mark[own[y]])), a, b):
                    comp.join(y, q)
        mark[mine] = False
    return comp


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a portion of edges (u, v): each node but the least with the least node that these edges reach."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not got:
        return
    u, v = (np.concatenate(x) for x in zip(*got))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    other = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[root[other]])], ["u", "v"])


def connected(edges: DataFrame, name: str, drop: tuple[DataFrame, ...] = (), portion: int = 1_000_000) -> DataFrame:
    """a, b (any 64-bit numbers) -> node, root (smallest number reachable), for every number in an edge.

    Each round turns portions of the edges into forests, a task each; until all are one level deep, a round of joins
    then brings each node's neighbours to the smallest of them. A node that very many edges meet is looked up by broadcast, so
    its edges stay spread. Every step is written to the shared folder. A task takes some 100 bytes an edge of its portion.
    """
    both = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    both = stage(both, name, drop)
    while True:
        portions = max(1, math.ceil(both.count() / portion))
        both = stage(both.repartition(portions, "u", "v").mapInArrow(_forest, "u long, v long"), name, (both,))
        if portions == 1:  # a forest of all edges is one level deep
            break
        # done when each node has one edge to a smaller one, which has none
        ends = both.select(F.col("u").alias("x"), F.lit(1).alias("down")).union(both.select("v", F.lit(0)))
        ends = ends.groupBy("x").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
        if not ends.where((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("least") == 0))).limit(1).count():
            break
        # large star: larger neighbours go to the smallest neighbour (or the node itself)
        out = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = out.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = look_up(out, low, "u", 2 * both.count()).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, name)
        # small star: smaller neighbours and the node go to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = look_up(large, low, "u", large.count()).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        both = stage(small.where(F.col("u") != F.col("v")).distinct(), name, (both, large))
    return behind(both.select(F.col("u").alias("node"), F.col("v").alias("root")).union(both.select(F.col("v"), F.col("v")).distinct()), both)


def _text_sets(docs: DataFrame, n: int, t: Threshold, ranges: int, most_alike: int, chunk: int = 2_000_000) -> DataFrame:
    """One table of four kinds of rows, told by ``what``:
    "doc": doc_id, n, node; "node": node, its class (c1, c2), n, least token (node2), least doc_id and sketch (h); "edge": node and node2,
    which share a part that more than most_alike nodes of this task have; "part": packed hashes (h) of a range (r) and their nodes
    as offsets (at) from ``node``, of a hash that more nodes have most_alike + 1 of them.

    A node is a class as one task knows it: a number that no other task gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sh = Shingles(n)
        first = node = TaskContext.get().partitionId() << 36
        hashes: list[np.ndarray] = []
        seen: dict[bytes, int] = {}
        about: list[list] = []  # of each node since first: c1, c2, n, low, least, sketch
        held = 0

        def rows(what: str, count: int, **cols) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([what] * count, pa.string())] + [cols[f.name] if f.name in cols else pa.nulls(count, f.type) for f in kind], ["what", *kind.names])

        def flush() -> Iterator[pa.RecordBatch]:
            *numbers, sketches = zip(*about)
            c1, c2, sizes, low, least = (pa.array(x, pa.int64()) for x in numbers)
            yield rows("node", len(about), node=pa.array(np.arange(first, node)), c1=c1, c2=c2, n=sizes, node2=low, doc_id=least, h=pa.array(sketches, pa.binary()))
            h = np.concatenate(hashes)
            c = np.repeat(np.arange(node - first, dtype=np.uint32), [len(x) for x in hashes])
            order = np.argsort(h, kind="stable")
            h, c = h[order], c[order]
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            k = np.diff(np.append(start, len(h)))
            place = np.arange(len(h)) - np.repeat(start, k)
            many = np.flatnonzero(np.repeat(k > most_alike, k) & (place > 0))
            pair = np.unique(np.stack([c[many - place[many]], c[many]], 1).astype(np.int64), axis=0)
            yield rows("edge", len(pair), node=pa.array(pair[:, 0] + first), node2=pa.array(pair[:, 1] + first))
            sent = place <= most_alike
            h, c = h[sent], c[sent]
            r = ((h >> U(48)) * U(ranges) >> U(16)).astype(np.int64)  # rises with h
            cuts = np.searchsorted(r, np.arange(ranges + 1))
            have = np.flatnonzero(np.diff(cuts)).tolist()
            small = c.astype("<u2") if node - first <= 1 << 16 else c.astype("<u4")
            yield rows("part", len(have), node=pa.array([first] * len(have), pa.int64()), r=pa.array(have, pa.int32()), h=pa.array([five_bytes(h[cuts[k] : cuts[k + 1]]) for k in have], pa.binary()), at=pa.array([small[cuts[k] : cuts[k + 1]].tobytes() for k in have], pa.binary()))

        for b in batches:
            ids, sizes, nodes = b.column(0).to_pylist(), [], []
            for doc, text in zip(ids, b.column(1).to_pylist()):
                s = sh.of(text)
                sizes.append(len(s))
                if not len(s):
                    nodes.append(None)
                    continue
                c = class_of(s)
                k = seen.get(c)
                if k is None:
                    k = seen[c] = node
                    node += 1
                    hashes.append(part_hashes(s, t))
                    held += len(hashes[-1])
                    about.append([*np.frombuffer(c, "<i8").tolist(), len(s), int(s[0]) >> 1, doc, sketch_of(s)])
                elif doc is not None:
                    a = about[k - first]
                    a[4] = doc if a[4] is None else min(a[4], doc)
                nodes.append(k)
            yield rows("doc", len(ids), doc_id=b.column(0), n=pa.array(sizes, pa.int64()), node=pa.array(nodes, pa.int64()))
            if held > chunk:
                yield from flush()
                first, hashes, about, held = node, [], [], 0
                seen.clear()
        if about:
            yield from flush()

    kind = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("node2", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("r", pa.int32()), ("h", pa.binary()), ("at", pa.binary())])
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "what string, doc_id long, n long, node long, node2 long, c1 long, c2 long, r int, h binary, at binary")


def _equal_parts(most_alike: int):
    """Of packed parts of whole ranges: the nodes that have a part in common; of a part of more than most_alike nodes a star of
    pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, cs = [], []
        for b in batches:
            for r, x, y, first in zip(*(c.to_pylist() for c in b.columns)):
                h = from_five(x)
                hs.append(h ^ (U(r) << U(44)))  # the range is above the five bytes
                cs.append(np.frombuffer(y, "<u2" if len(y) == 2 * len(h) else "<u4").astype(np.int64) + first)
        if not hs:
            return
        h, c = np.concatenate(hs), np.concatenate(cs)
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        k = np.diff(np.append(start, len(h)))
        for n in np.unique(k[(k > 1) & (k <= most_alike)]).tolist():
            at = start[k == n]
            for i in range(0, len(at), max(1, 1_000_000 // n)):
                found = np.unique(c[at[i : i + max(1, 1_000_000 // n), None] + np.arange(n)], axis=0)
                yield rows(pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * n, pa.int32()), pa.array(found.ravel())))
        many = np.repeat(k > most_alike, k)
        if many.any():
            pair = np.unique(np.stack([np.repeat(c[start], k)[many], c[many]], 1), axis=0)
            yield rows(None, pair[pair[:, 0] != pair[:, 1]])

    def rows(nodes: pa.Array | None, pair: np.ndarray | None = None) -> pa.RecordBatch:
        count = len(pair) if nodes is None else len(nodes)
        ends = [pa.nulls(count, pa.int64())] * 2 if pair is None else [pa.array(pair[:, 0]), pa.array(pair[:, 1])]
        return pa.RecordBatch.from_arrays([*ends, pa.nulls(count, pa.list_(pa.int64())) if nodes is None else nodes], ["a", "b", "nodes"])

    return run


def _open_links(parts: DataFrame, sketches: DataFrame, t: Threshold) -> DataFrame:
    """Pairs that connect the nodes which have a part in common as far as their sketches let them link, for each of
    ``parts`` (nodes). sketches: node, n, sketch."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = b.column(0).offsets.to_numpy()
            node, n, cells = b.column(0).flatten().flatten()
            node, n, cells = node.to_numpy(), n.to_numpy(), cells.to_pylist()
            out = []
            for x, y in zip((ends - ends[0]).tolist(), (ends[1:] - ends[0]).tolist()):
                order = x + np.argsort(n[x:y], kind="stable")
                label = alike(n[order], [cells[i] for i in order], t)
                tied = label != np.arange(y - x)
                out.append(np.stack([node[order][label[tied]], node[order][tied]], 1))
            pair = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    # parts of one number would only be compared together
    each = parts.distinct().select(F.xxhash64("nodes").alias("part"), F.explode("nodes").alias("node"))
    with_sketch = each.join(sketches, "node").groupBy("part").agg(F.collect_list(F.struct("node", "n", "sketch")).alias("held"))
    return with_sketch.select("held").mapInArrow(compare, "a long, b long")


def class_of(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def _bloom(values: np.ndarray, bits: int) -> np.ndarray:
    """Four positions of each value."""
    v = values.view(U)
    return np.stack([mixed(v * _A + U(k)) & U(bits - 1) for k in range(4)])


def _in_filter(filled: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values a filter of ``_heads_filter`` lets through; it is read as packed bits, an eighth of a flag each."""
    p = _bloom(values, len(filled) * 8)
    return ((filled[p >> U(3)] << (p & U(7)).astype(np.uint8)) & 128).all(0)


def _heads_filter(heads: DataFrame, total: int) -> np.ndarray:
    """A Bloom filter of the heads' doc_ids, at most 16 MB; fuller, it lets more documents through."""
    bits = 1 << min(27, max(10, math.ceil(math.log2(16 * total + 1))))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(bits // 8, np.uint8)
        for b in batches:
            v = b.column(0).drop_null().to_numpy().astype(np.int64)
            for p in _bloom(v, bits):
                np.bitwise_or.at(on, p >> U(3), (U(128) >> (p & U(7))).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([on.tobytes()], pa.binary())], ["bits"])

    filled = np.zeros(bits // 8, np.uint8)
    for r in heads.select("doc_id").coalesce(4).mapInArrow(fill, "bits binary").collect():
        filled |= np.frombuffer(r["bits"], np.uint8)
    return filled


def _linked(t: Threshold):
    def run(batches: pa.Table) -> pa.Table:
        classes = batches["cls"].to_numpy()
        order = np.argsort(classes, kind="stable")
        classes = classes[order]
        payload = batches["set"].to_pylist()
        found = [np.frombuffer(payload[i], U) for i in order]
        known = batches["known"].to_numpy()[order].tolist() if "known" in batches.column_names else None
        apart = batches["visitor"].to_numpy()[order] if known is not None else None
        comp = link_sets(found, t, known, apart)
        root = classes[[comp.root(i) for i in range(len(found))]]
        return pa.table({"a": pa.array(root), "b": pa.array(classes)})

    return run


def _across_blocks(sets: DataFrame, links: DataFrame, t: Threshold, most_shingles: int, block_shingles: int) -> DataFrame:
    """Links between sets of different blocks. sets: root, block, cls, set; links: those found inside the blocks.

    The token-group matrix of the blocks is dealt by range of token: a range holds, of every set of a neighbourhood, the
    tokens in it, and so the tokens of each block's union. It counts, for each set, its tokens in each other block's."""
    now = connected(links, "linked")
    known = sets.select("root", "block", "cls", (F.length("set") / 8).cast("long").alias("n")).join(now.select(F.col("node").alias("cls"), F.col("root").alias("known")), "cls", "left").withColumn("known", F.coalesce("known", "cls"))
    known = stage(known, "labels")
    ranges = known.groupBy("root").agg(F.ceil(F.sum("n") / most_shingles).cast("int").alias("ranges"))
    # a root is a neighbourhood beyond most_shingles, a block has block_shingles of them: few rows beside the sets
    about = known.groupBy("root", "block").agg(F.min("n").alias("small"), F.max("n").alias("big"), F.min("known").alias("one"), F.max("known").alias("other"), F.sum("n").alias("held"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for root, block, cls, raw, k in zip(*(c.to_pylist() for c in b.columns)):
                s = np.frombuffer(raw, U)
                r = ((s >> U(32)) * U(k) >> U(32)).astype(np.int64)  # sorted, as s is
                cuts = np.searchsorted(r, np.arange(k + 1))
                out += [(root, i, block, cls, s[cuts[i] : cuts[i + 1]].tobytes()) for i in range(k) if cuts[i] < cuts[i + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["root", "r", "block", "cls", "set"])

    def count(batches: pa.Table) -> pa.Table:
        blocks, own = np.unique(batches["block"].to_numpy(), return_inverse=True)
        found = [np.frombuffer(x, U) for x in batches["set"].to_pylist()]
        sizes = np.array([len(x) for x in found])
        tokens, at = np.unique(np.concatenate(found), return_inverse=True)
        cell = np.unique(at * len(blocks) + np.repeat(own, sizes))
        col, starts = cell % len(blocks), np.searchsorted(cell // len(blocks), np.arange(len(tokens) + 1))
        cls, out = batches["cls"].to_numpy(), []
        for i, (end, n) in enumerate(zip(np.cumsum(sizes).tolist(), sizes.tolist())):
            mine = at[end - n : end]
            counts = starts[mine + 1] - starts[mine]
            where = np.repeat(starts[mine] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
            both = np.bincount(col[where], minlength=len(blocks))
            both[own[i]] = 0
            some = np.flatnonzero(100 * both >= t.p * n)
            out.append((np.full(len(some), cls[i]), blocks[some], np.full(len(some), n), both[some]))
        a, b, n, c = (np.concatenate(x) for x in zip(*out))
        return pa.table({"root": pa.array(np.full(len(a), batches["root"][0].as_py())), "cls": pa.array(a), "block": pa.array(b.astype(np.int32)), "own": pa.array(n.astype(np.int64)), "both": pa.array(c.astype(np.int64))})

    dealt = sets.join(F.broadcast(ranges), "root").select("root", "block", "cls", "set", "ranges").mapInArrow(deal, "root long, r int, block int, cls long, set binary")
    counts = dealt.groupBy("root", "r").applyInArrow(count, "root long, cls long, block int, own long, both long")
    # a set that reaches the needed share of its tokens does so in one range at least; in ranges where it doesn't, its
    # tokens in the block are fewer than that share, which bounds the whole overlap
    bounds = counts.groupBy("root", "cls", "block").agg(F.sum("both").alias("both"), F.sum("own").alias("own"))
    open_ = bounds.join(known.select("cls", "n", "known"), "cls").where(100 * F.col("both") + t.p * (F.col("n") - F.col("own")) >= t.p * F.col("n"))
    open_ = open_.join(about, ["root", "block"]).where((100 * F.col("big") >= t.p * F.col("n")) & (100 * F.col("n") >= t.p * F.col("small")) & ~((F.col("one") == F.col("other")) & (F.col("one") == F.col("known"))))
    open_ = stage(open_.select("root", "block", "cls", "n", "known"), "open")
    # visitors of a block in portions, each with the block's own sets
    portions = open_.groupBy("root", "block").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("portions"))
    visitors = open_.join(portions, ["root", "block"]).select("root", "block", "cls", "known", F.pmod(F.xxhash64("cls"), F.col("portions")).cast("int").alias("portion"), F.lit(1).alias("visitor"))
    members = known.join(portions, ["root", "block"]).select("root", "block", "cls", "known", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), F.lit(0).alias("visitor"))
    sent = visitors.unionByName(members).join(sets.select("cls", "set"), "cls")
    return stage(sent.groupBy("root", "block", "portion").applyInArrow(_linked(t), "a long, b long"), "links-across", (open_,))


def components(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", most_shingles: int = 2_000_000, block_shingles: int = 500_000, most_alike: int = 4096) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id of all that links reach)."""
    spark, t = docs.sparkSession, Threshold(percent)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranges = max(64, 2 * shuffle_parts(spark))
    made = stage(_text_sets(docs, n, t, ranges, most_alike), "shingles")
    kind = lambda what, *cols: made.where(F.col("what") == what).select(*cols)
    packed = kind("part", "r", "h", "at", "node").repartitionById(ranges, F.col("r")).mapInArrow(_equal_parts(most_alike), "a long, b long, nodes array<long>")
    shared_parts = stage(packed, "equal-parts")
    release(spark)
    sketches = kind("node", "node", "n", F.col("h").alias("sketch"))
    opened = stage(_open_links(shared_parts.where("nodes is not null").select("nodes"), sketches, t), "open-links")
    edges = opened.union(shared_parts.where("nodes is null").select("a", "b"))
    rows = stage(kind("doc", "doc_id", "n", "node"), "rows")
    nodes = stage(kind("node", "node", "c1", "c2", "n", F.col("node2").alias("low"), "doc_id"), "nodes")
    # one class: the least of its nodes stands for it
    classes = stage(nodes.groupBy("c1", "c2").agg(F.min("node").alias("cls"), F.min("n").alias("n"), F.min("low").alias("low"), F.min("doc_id").alias("doc_id")), "classes")
    equal = nodes.join(classes.select("c1", "c2", "cls"), ["c1", "c2"]).where(F.col("node") != F.col("cls"))
    equal = stage(equal.select(F.col("cls").alias("a"), F.col("node").alias("b")), "equal")
    near = connected(edges.union(kind("edge", F.col("node").alias("a"), F.col("node2").alias("b"))).union(equal), "near", (opened, shared_parts, made))

    # neighbourhoods of two classes or more; their sets are built again, for the document of least id of each
    heads = stage(near.join(classes, F.col("node") == F.col("cls")).select("cls", "root", F.col("n").alias("size"), "low", "doc_id", "c1", "c2"), "heads")
    weight = stage(heads.groupBy("root").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n")).where("n > 1"), "weights")
    heads = stage(look_up(heads, weight, "root", heads.count()), "heads", (heads, near))
    # large ones in blocks by least token; a token that fills several blocks is dealt out by hash
    by_low = heads.where(F.col("total") > most_shingles).groupBy("root", "low").agg(F.sum("size").alias("sum"))
    before = F.sum("sum").over(Window.partitionBy("root").orderBy("low")) - F.col("sum")
    cuts = by_low.select("root", "low", F.floor(before / block_shingles).alias("lo"), F.ceil(F.col("sum") / block_shingles).alias("k"))
    block = F.when(F.col("lo").isNull(), -1).otherwise(F.col("lo") + F.pmod(F.xxhash64("cls"), F.col("k"))).cast("int").alias("block")
    heads = stage(heads.join(cuts, ["root", "low"], "left").select("c1", "c2", "doc_id", "cls", "root", block), "heads", (heads,))
    filled = _heads_filter(heads, heads.count())
    shared = spark.sparkContext.broadcast(filled)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingles(n)
        for b in batches:
            ids = b.column(0)
            v = ids.fill_null(0).to_numpy().astype(np.int64)
            maybe = _in_filter(shared.value, v) | ids.is_null().to_numpy(zero_copy_only=False)  # a class of null ids alone is found too
            at = np.flatnonzero(maybe)
            got = [sh.of(b.column(1)[int(k)].as_py()) for k in at]
            keep = [k for k, s in enumerate(got) if len(s)]
            c = np.frombuffer(b"".join(class_of(got[k]) for k in keep), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(c[:, 0]), pa.array(c[:, 1]), ids.take(pa.array(at[keep])), pa.array([got[k].tobytes() for k in keep], pa.binary())], ["c1", "c2", "d", "set"])

    built = docs.mapInArrow(sets, "c1 long, c2 long, d long, set binary")
    # one row a class, told where the join has brought its rows together
    both = built.join(heads, ["c1", "c2"]).where(F.col("d").eqNullSafe(F.col("doc_id"))).select("c1", "c2", "cls", "root", "block", "set").dropDuplicates(["c1", "c2"])
    both = stage(both.drop("c1", "c2"), "sets", (heads, weight))
    links = stage(both.groupBy("root", "block").applyInArrow(_linked(t), "a long, b long"), "links")
    release(spark)
    inside = both.where("block >= 0")
    if inside.limit(1).count():
        links = links.union(_across_blocks(inside, links, t, most_shingles, block_shingles))
    links = stage(links.union(equal), "all-links", (both,))
    now = connected(links, "components", (links, equal))

    # the least id of each component, by way of its nodes, so that rows of one component never meet in a task
    found = stage(nodes.join(now, "node", "left").select("node", "root", "doc_id"), "component-nodes", (nodes, classes, now))
    linked = found.where(F.col("root").isNotNull())
    least = stage(linked.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    answer = look_up(linked.select("node", "root"), least, "root", linked.count()).select("node", "component_id")
    answer = stage(answer.union(found.where(F.col("root").isNull()).select("node", "doc_id")), "answers", (found, least))
    # a node's rows are of one task of the first pass; empty sets have no node
    some = rows.where(F.col("node").isNotNull()).join(answer, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.union(rows.where(F.col("node").isNull()).select("doc_id", "n", F.col("doc_id")))
