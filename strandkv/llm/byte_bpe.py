r"""Byte-level BPE over a table of ranks, and its inverse.

Texts are split by the pattern in Python; the distinct words of the corpus and their counts are then a table, and Spark
higher-order functions encode each word once: an array of its bytes is folded, each step joining the neighbours whose
concatenation has the lowest rank and looking up the pairs beside them, until no two have one. Ranks are a literal: an
array of small maps, picked by a hash, as a map's own look-up is linear. Decoding joins the binary pieces of ids: by
``decode_ids`` in Spark, and in ``encode_documents``, which has the ids in Python, by the same table there.

Words go back to the documents through a dictionary sent to every executor. Its size is checked, about 20 bytes a word:
it takes the words met at least m times, where m is the least number that leaves at most ``most_words``. The other words,
if any, are joined to the documents that hold them by a shuffle, so no word is lost and nothing grows without bound.

Bytes stand as characters U+0000 to U+00FF in Spark strings (ISO-8859-1).

Cases: null text counts as empty and has no ids; null ids, repeated rows and extra columns pass; an empty table gives
an empty result; a very long word is folded in the parts that no merge can join, a run of letters that merges can join
throughout in one, in time that grows with the square of its length.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MARKS, gathered, marks_after_letters, portions, release, shuffle_parts, slices, small_batches, stage

BUCKETS = 1 << 15
#: The pattern under which letters, and punctuation that follows them, are a word each.
_KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = "\u0250"  # below: letters are the same to Python and to the pattern


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_map(ranks: dict[bytes, int]) -> Column:
    """array<map<string,int>>; a constant, which the optimizer folds to a literal."""
    import xxhash

    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        s = piece.decode("latin-1")
        h = xxhash.xxh64_intdigest(s.encode(), 42)  # as Spark's xxhash64
        buckets[(h - (1 << 64) if h >> 63 else h) % BUCKETS][s] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def _rank(ranks: Column, piece: Column) -> Column:
    return F.element_at(F.get(ranks, F.pmod(F.xxhash64(piece), F.lit(BUCKETS)).cast("int")), piece)


def _let(value: Column, body) -> Column:
    """let x = value in body(x)"""
    return F.get(F.transform(F.array(value), body), 0)


NONE = 2**31 - 1  # the rank of what is no piece


def fold(ranks: Column, word: Column) -> Column:
    """The pieces of ``word`` (bytes as ISO-8859-1 characters) after all ranked merges.

    The state is the array of pieces and the array of ranks that neighbours would have together; a step joins the two of
    lowest rank and looks up only the pairs beside them anew."""

    def rank(*parts: Column) -> Column:
        return F.coalesce(_rank(ranks, F.concat(*parts)), F.lit(NONE))

    def merge(state: Column, _: Column) -> Column:
        def at(i: Column) -> Column:
            i, parts, pairs = i.cast("int"), state["parts"], state["pairs"]

            a, b, none = F.get(parts, i - 1), F.get(parts, i), F.array().cast("array<int>")
            left = F.when(i > 1, F.array(rank(F.get(parts, i - 2), a, b))).otherwise(none)
            right = F.when(i < F.size(pairs), F.array(rank(a, b, F.get(parts, i + 1)))).otherwise(none)
            return F.struct(
                F.concat(F.slice(parts, F.lit(1), i - 1), F.array(F.concat(a, b)), F.slice(parts, i + 2, F.size(parts))).alias("parts"),
                F.concat(F.slice(pairs, F.lit(1), F.greatest(i - 2, F.lit(0))), left, right, F.slice(pairs, i + 2, F.size(pairs))).alias("pairs"),
            )

        low = F.array_min(state["pairs"])
        return F.when(F.coalesce(low, F.lit(NONE)) == NONE, state).otherwise(_let(F.array_position(state["pairs"], low), at))

    n = F.length(word)
    parts = F.when(n < 2, F.array(word)).otherwise(F.slice(F.split(word, ""), F.lit(1), n))
    pairs = lambda p: F.when(F.size(p) < 2, F.array().cast("array<int>")).otherwise(F.transform(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), lambda x, i: rank(x, F.get(p, i + 1))))
    first = _let(parts, lambda p: F.struct(p.alias("parts"), pairs(p).alias("pairs")))
    folded = F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), first, merge, lambda s: s["parts"])
    # a word that is a piece itself is one id, as the merges may not lead there
    return F.when(_rank(ranks, word).isNotNull(), F.array(word)).otherwise(folded)


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``words`` (word binary) with ids array<int>."""
    # one literal: each place that names it would be a copy, which every task has to read
    word = F.decode("word", "ISO-8859-1")
    return words.withColumn("ids", _let(rank_map(ranks), lambda m: F.transform(fold(m, word), lambda p: _rank(m, p))))


def decode_ids(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes that ids stand for, joined."""
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.decode("latin-1")
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""), "ISO-8859-1")


def merged(piece: bytes, ranks: dict[bytes, int]) -> int:
    """How many pieces the merges leave of a short string."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > 1:
        low, k = min((ranks.get(a + b, NONE), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
        if low == NONE:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return len(parts)


class Joints:
    """side: which two bytes stand side by side in some piece, 256 x 256; no merge ever crosses any other two.
    odd: pieces to which merges don't lead, so that they are one id only as a word of their own."""

    def __init__(self, ranks: dict[bytes, int]):
        self.side = np.zeros((256, 256), bool)
        for piece in ranks:
            b = np.frombuffer(piece, np.uint8)
            self.side[b[:-1], b[1:]] = True
        self.odd = frozenset(x for x in ranks if len(x) > 2 and merged(x, ranks) > 1)


_IS_SPACE = np.isin(np.arange(256), [*range(9, 14), 32])


def white_space(x: np.ndarray, ascii_: bool) -> np.ndarray:
    """Which bytes of UTF-8 are of white space."""
    out = _IS_SPACE[x]
    if ascii_:
        return out
    end = len(x) - 1
    at = np.flatnonzero((x == 0xC2) | ((x >= 0xE1) & (x <= 0xE3)))
    a, b, c = x[at], x[np.minimum(at + 1, end)], x[np.minimum(at + 2, end)]
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    punctuation = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    three = punctuation | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    for k, own in enumerate((two | three, two | three, three)):
        out[at[own] + k] = True
    return out


class Splitter:
    """Words of texts by the pattern. White space runs with what follows are cut out first: a word never reaches from
    other characters into white space, so their words are found once each. By the known pattern, none reaches from a
    letter or digit into punctuation either. A long word is given in parts, cut where no merge can cross, so that its
    merges are few at a time."""

    def __init__(self, pattern: str, joint: Joints, long: int = 32):
        import regex

        self.word, self.joint, self.long = regex.compile(pattern), joint, long
        self.plain = pattern == _KNOWN

    def units(self, raw: bytes, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The units of texts in a row, and how many come before each text."""
        x = np.frombuffer(raw, np.uint8)
        space = white_space(x, raw.isascii())
        starts = space.copy()
        starts[1:] &= ~space[:-1]
        if self.plain:
            starts |= marks_after_letters(x)
        return slices(x, starts, offsets)

    def words_of(self, unit: bytes) -> list[bytes]:
        if self.plain and len(unit) <= self.long and (unit[1:] if unit[0] == 32 else unit).isalpha():  # of ASCII
            return [unit]
        return self.words(unit.decode())

    def words(self, unit: str) -> list[bytes]:
        if self.plain and len(unit) <= self.long:  # letters after one space or none, then punctuation: most units
            core = unit.rstrip(MARKS)
            if core[1:].isalpha() and (core[0] == " " or core[0].isalpha()) and (core.isascii() or max(core) < _PLAIN):
                return [core.encode()] if len(core) == len(unit) else [core.encode(), unit[len(core) :].encode()]
        out = [w.encode("utf-8", "surrogatepass") for w in self.word.findall(unit)]
        return out if len(unit) <= self.long else [x for w in out for x in (self.parts(w) if len(w) > self.long else (w,))]

    def parts(self, word: bytes) -> list[bytes]:
        b = np.frombuffer(word, np.uint8)
        cuts = [0, *(np.flatnonzero(~self.joint.side[b[:-1], b[1:]]) + 1).tolist(), len(word)]
        out = [word[x:y] for x, y in zip(cuts, cuts[1:])]
        return out if self.joint.odd.isdisjoint(out) else [word]


def distinct_words(docs: DataFrame, pattern: str, joint: Joints, most: int = 400_000) -> DataFrame:
    """word binary, n long, of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, words = Splitter(pattern, joint), {}
        for b in gathered(batches, 0):
            for raw, offsets in portions(b.column(0)):
                found, _ = split.units(raw, offsets)
                counts = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary)).tolist()
                for u, n in zip(found.dictionary.to_numpy(zero_copy_only=False).tolist(), counts):
                    for w in split.words_of(u):
                        words[w] = words.get(w, 0) + n
                if len(words) > most:
                    yield batch(words)
                    words.clear()
        if words:
            yield batch(words)

    def batch(words: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

    found = docs.select("text").mapInArrow(count, "word binary, n long")
    # counted before; dealt by number, so that what follows runs in as many tasks
    return found.repartition(2 * shuffle_parts(docs.sparkSession), "word").groupBy("word").agg(F.sum("n").alias("n"))


def _packed(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[pa.RecordBatch]:
    """Words (word, ids) as blobs: hashes, numbers of ids, ids."""
    import xxhash

    for b in batches:
        h = np.array([xxhash.xxh64_intdigest(w) for w in b.column(0).to_pylist()], np.uint64)
        ends = b.column(1).offsets.to_numpy()
        ids = b.column(1).flatten().to_numpy().astype(dtype)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (h, np.diff(ends).astype("<u4"), ids)], ["h", "n", "ids"])


def _gathered(packed: DataFrame, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, numbers of ids and ids of all blobs. A partition is fetched at a time and added to what grows in place,
    so neither the driver's JVM nor its Python holds them twice."""
    parts = bytearray(), bytearray(), bytearray()
    for row in packed.toLocalIterator():
        for part, blob in zip(parts, row):
            part += blob
    return tuple(np.frombuffer(x, kind) for x, kind in zip(parts, ("<u8", "<u4", dtype)))


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] numbers, then those of the next."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class Dictionary:
    """Ids of words, about 20 bytes a word: sorted hashes, ends, ids. A word's ids are checked by decoding them."""

    def __init__(self, h: np.ndarray, n: np.ndarray, ids: np.ndarray, portion: int = 200_000):
        order = np.argsort(h, kind="stable")
        start = (np.cumsum(n, dtype=np.int64) - n)[order]
        self.hashes, n = h[order], n[order]
        self.ends, self.ids = np.cumsum(n, dtype=np.int64), np.empty_like(ids)
        for k in range(0, len(n), portion):  # some words at a time, as places take more than ids
            own = n[k : k + portion].astype(np.int64)
            end = int(self.ends[k + len(own) - 1])
            self.ids[end - int(own.sum()) : end] = ids[_ranges(start[k : k + portion], own)]

    def find(self, words: list[bytes], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word start, and how many; none for an unknown word."""
        import xxhash

        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        at = np.searchsorted(self.hashes, h)
        start, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        open_ = np.arange(len(words))
        while True:  # words of one hash follow each other
            open_ = open_[at[open_] < len(self.hashes)]
            open_ = open_[self.hashes[at[open_]] == h[open_]]
            if not len(open_):
                return start, n
            k = at[open_]
            a = np.where(k > 0, self.ends[k - 1], 0)
            back = pieces.split(self.ids[_ranges(a, self.ends[k] - a)], self.ends[k] - a)
            same = np.fromiter((x == words[i] for x, i in zip(back, open_.tolist())), bool, len(open_))
            start[open_[same]], n[open_[same]] = a[same], (self.ends[k] - a)[same]
            open_ = open_[~same]
            at[open_] += 1


class Pieces:
    """The bytes of all ids, one after the other."""

    def __init__(self, ranks: dict[bytes, int]):
        sizes = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for piece, rank in ranks.items():
            sizes[rank] = len(piece)
        self.ends, self.bytes = np.append(0, np.cumsum(sizes)).astype(np.int32), b"".join(sorted(ranks, key=ranks.get))

    def split(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of runs of ids."""
        table = pa.BinaryArray.from_buffers(pa.binary(), len(self.ends) - 1, [None, pa.py_buffer(self.ends), pa.py_buffer(self.bytes)])
        raw, ends = joined(table, ids)
        ends = ends[np.append(0, np.cumsum(counts))].tolist()
        return [raw[x:y] for x, y in zip(ends, ends[1:])]


def joined(table: pa.BinaryArray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The values at these places, joined, and where each starts and ends."""
    if not len(at):
        return b"", np.zeros(1, np.int32)
    got = table.take(pa.array(at))
    ends = np.frombuffer(got.buffers()[1], np.int32)[: len(at) + 1]
    return (got.buffers()[2].to_pybytes() if ends[-1] else b""), ends


class Units:
    """Ids of the units met, up to a bound: a number for each, and its ids."""

    def __init__(self, split: Splitter, book: Dictionary, pieces: Pieces, keep: int = 400_000):
        self.split, self.book, self.pieces, self.keep = split, book, pieces, keep
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = pa.array([], pa.binary())  # by number, 4 bytes an id

    def learn(self, new: list[bytes], rare: dict[bytes, list[int]]) -> None:
        words = list(map(self.split.words_of, new))
        flat = [w for x in words for w in x]
        number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        distinct = list(number)
        start, n = self.book.find(distinct, self.pieces)
        table = self.book.ids
        other = np.flatnonzero(n == 0).tolist()
        if other:  # the rare ones stand after the dictionary
            more = [rare[distinct[i]] for i in other]
            n[other] = [len(x) for x in more]
            start[other] = len(table) + np.cumsum(n[other]) - n[other]
        at = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        where = _ranges(start[at], n[at])
        ids = table[np.minimum(where, max(len(table) - 1, 0))].astype(np.uint32) if len(table) else np.zeros(len(where), np.uint32)
        if other:
            beyond = where >= len(table)
            ids[beyond] = np.concatenate([np.array(x, np.uint32) for x in more])[where[beyond] - len(table)]
        per = np.fromiter(map(len, words), np.int64, len(words))
        ends = 4 * np.append(0, np.cumsum(n[at]))[np.append(0, np.cumsum(per))]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        own = pa.BinaryArray.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
        self.ids = pa.concat_arrays([self.ids, own])

    def encode(self, texts: pa.Array, rare: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many of each text."""
        ids, counts = [b""], [np.zeros(0, np.int64)]
        for raw, offsets in portions(texts):
            found, first = self.split.units(raw, offsets)
            distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
            new = [u for u in distinct if u not in self.known]
            if new:
                self.learn(new, rare)
            own = self.ids.take(pa.array(np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))))
            part, ends = joined(own, found.indices.to_numpy())
            ids.append(part)
            counts.append(np.diff(ends[first] // 4).astype(np.int64))
            if len(self.known) > self.keep or self.ids.nbytes > 80 * self.keep:
                self.clear()
        return np.frombuffer(b"".join(ids), "<u4"), np.concatenate(counts)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", most_words: int = 5_000_000, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids array<int>, decoded binary)."""
    spark = docs.sparkSession
    small_batches(spark)
    ranks = read_ranks(ranks_path)
    joint = Joints(ranks)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words = stage(encode_words(distinct_words(docs, pattern, joint), ranks), "encoded-words")
    # how many words have each count, counts above a million together
    levels = words.groupBy(F.least("n", F.lit(1_000_000)).alias("n")).count().orderBy(F.desc("n")).collect()
    total, least = 0, 1_000_001
    for r in levels:
        total += r["count"]
        if total > most_words:
            break
        least = r["n"]
    is_frequent = F.least("n", F.lit(1_000_000)) >= least
    whole = total <= most_words
    dtype = np.dtype("<u2" if max(ranks.values(), default=0) < 1 << 16 else "<u4")
    # at most most_words words of about 20 bytes
    packed = words.where(is_frequent).select("word", "ids").mapInArrow(lambda batches: _packed(batches, dtype), "h binary, n binary, ids binary")
    book = Dictionary(*_gathered(packed, dtype))
    release(spark)
    shared = spark.sparkContext.broadcast((joint, book, Pieces(ranks)))
    del book

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint_, book_, pieces = shared.value
        units = Units(Splitter(pattern, joint_), book_, pieces)
        for b in gathered(batches):
            rare = {} if whole else {x["word"]: x["ids"] for r in b.column(2).to_pylist() for x in r or ()}
            ids, counts = units.encode(b.column(1), rare)
            ends = np.append(0, np.cumsum(counts))
            back = pieces.split(ids, counts)
            hashes = [hashlib.sha256(ids[x:y]).hexdigest() for x, y in zip(ends.tolist(), ends[1:].tolist())]
            arrays = [b.column(0), pa.array(counts), pa.array(hashes, pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string())]
            if with_ids:
                arrays += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(back, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    if whole:
        return docs.mapInArrow(assemble, kind)

    def rare_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint_, book_, pieces = shared.value
        split = Splitter(pattern, joint_)
        for b in batches:
            row = 0
            for raw, offsets in portions(b.column(2)):
                units, first = split.units(raw, offsets)
                words = list(map(split.words_of, units.dictionary.to_numpy(zero_copy_only=False).tolist()))
                distinct = list({w for x in words for w in x})
                _, n = book_.find(distinct, pieces)
                unknown = {w for w, k in zip(distinct, n.tolist()) if not k}
                own, index = [unknown.intersection(x) for x in words], units.indices.to_numpy()
                rare = [(row + i, w) for i, (x, y) in enumerate(zip(first.tolist(), first[1:].tolist())) for w in set().union(*map(own.__getitem__, np.unique(index[x:y]).tolist()))]
                at = pa.array([i for i, _ in rare], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([w for _, w in rare], pa.binary())], ["k1", "k2", "word"])
                row += len(first) - 1

    # a text's hashes, 96 bits together, are the key: equal texts share their rare words, and nothing hangs on doc_id
    # being unique
    keyed = docs.withColumns({"k1": F.xxhash64("text"), "k2": F.hash("text")})
    pairs = keyed.select("k1", "k2", "text").mapInArrow(rare_of, "k1 long, k2 int, word binary").distinct()
    rare = pairs.join(words.where(~is_frequent).select("word", "ids"), "word").groupBy("k1", "k2").agg(F.collect_list(F.struct("word", "ids")).alias("rare"))
    return keyed.join(rare, ["k1", "k2"], "left").select("doc_id", "text", "rare").mapInArrow(assemble, kind)
