r"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its words (A-Z and all other letters lower-cased) and, for words of five letters or more, their
first four to seven letters; each is hashed to one of 2^bits columns. Columns are kept whose presence tells the training
rows' classes apart (a chi-square of at least ``telling``), and so are columns that tell them apart only in pairs: of the
``frequent`` columns in most training rows, those whose presence together has a chi-square of at least ``telling_pair``
and more than twice that of either alone. A text's value in a kept column is log2(1 + count), at most MOST_VALUE. The
machine has a bias, a weight for each column and a vector of ``factors`` for each column, whose products stand for pairs
of terms that mean something else together than apart. It is trained in numpy, by Adam on the logistic loss.

Training takes the whole texts of the labelled rows that the caller passes, at most ``most_rows`` of them, picked by a
hash of the id (a bound of the training sample only). Scoring reads every whole text and uses nothing but the text.

Cases: null text counts as empty and gets the bias alone; null ids, repeated rows and extra columns don't matter; rows
without a label aren't trained on; with no labelled rows of both classes every score is the share of toxic rows, or 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

_WORD = re.compile(r"[^\W\d_]+")
_SEED = 0x9E3779B97F4A7C15
MOST_VALUE = 3.0


def _hash(s: str, bits: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), _SEED) >> (64 - bits)


class Terms:
    """Columns of a text's terms, those in ``only`` if it is given; remembers the words met, up to a bound."""

    def __init__(self, bits: int, only: np.ndarray | None = None, keep: int = 300_000):
        self.bits, self.only, self.keep, self.known = bits, only, keep, {}

    def of_word(self, w: str) -> list[int]:
        got = self.known.get(w)
        if got is None:
            names = ["w " + w, *(f"p {w[:k]}" for k in range(4, 8) if len(w) >= max(5, k))]
            got = [h for h in (_hash(x, self.bits) for x in names) if self.only is None or self.only[h]]
            if len(w) <= 40:
                if len(self.known) >= self.keep:
                    self.known.clear()
                self.known[w] = got
        return got

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct columns, rising, and their counts."""
        words = Counter(_WORD.findall((text or "").lower()))
        cols: list[int] = []
        times: list[int] = []
        for w, n in words.items():
            if c := self.of_word(w):
                cols += c
                times += [n] * len(c)
        at, inverse = np.unique(np.array(cols, np.int64), return_inverse=True)
        return at, np.bincount(inverse, np.array(times, float), len(at))


@dataclass
class Model:
    bits: int
    kept: np.ndarray  # by column
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def values(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kept columns and their values."""
        k = self.kept[at]
        return at[k], np.minimum(np.log2(1 + n[k]), MOST_VALUE)

    def margin(self, at: np.ndarray, n: np.ndarray) -> float:
        at, x = self.values(at, n)
        v = self.factors[at]
        s = x @ v
        return float(self.bias + x @ self.weights[at] + 0.5 * (s @ s - (x * x) @ (v * v).sum(1)))

    def score(self, at: np.ndarray, n: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.margin(at, n)))))


def chi_square(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int) -> np.ndarray:
    """Of each column's presence against the label."""
    y = np.array([r[2] for r in rows], float)
    both, one = np.zeros(size), np.zeros(size)
    for at, _, label in rows:
        both[at] += label
        one[at] += 1
    n, pos = len(rows), y.sum()
    expected = one * pos / n
    spread = expected * (1 - pos / n) * (1 - one / n)
    return (both - expected) ** 2 / np.maximum(spread, 1e-9)


def telling_pairs(rows: list[tuple[np.ndarray, np.ndarray, int]], own: np.ndarray, frequent: int, least: float) -> np.ndarray:
    """Columns that have a telling pair among the ``frequent`` ones; own: each column's chi-square."""
    seen = np.zeros(len(own))
    for at, _, _ in rows:
        seen[at] += 1
    cols = np.sort(np.argsort(-seen, kind="stable")[:frequent])
    cols = cols[seen[cols] > 0]
    place = np.full(len(own), -1)
    place[cols] = np.arange(len(cols))
    x = np.zeros((len(rows), len(cols)), np.float32)
    for k, (at, _, _) in enumerate(rows):
        at = place[at]
        x[k, at[at >= 0]] = 1
    y = np.array([r[2] for r in rows], np.float32)
    together = (x.T @ x).astype(float)
    toxic = (x[y > 0].T @ x[y > 0]).astype(float)
    n, pos = len(rows), float(y.sum())
    expected = together * pos / n
    score = (toxic - expected) ** 2 / np.maximum(expected * (1 - pos / n) * (1 - together / n), 1e-9)
    alone = own[cols]
    np.fill_diagonal(score, 0)
    hit = (score >= least) & (score > 2 * np.maximum(alone[:, None], alone[None, :]))
    return cols[hit.any(1)]


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, factors: int = 8, epochs: int = 30, rate: float = 0.05, shrink: float = 1e-3, telling: float = 16.0, frequent: int = 1024, telling_pair: float = 40.0, seed: int = 5) -> Model:
    """rows: (columns, counts, label 0 or 1)."""
    size, rng = 1 << bits, np.random.default_rng(seed)
    y = np.array([r[2] for r in rows], float)
    share = float(y.mean()) if len(y) else 0.0
    kept = np.zeros(size, bool)
    if 0 < share < 1:
        own = chi_square(rows, size)
        kept = own >= telling
        kept[telling_pairs(rows, own, frequent, telling_pair)] = True
    model = Model(bits, kept, math.log((share + 1e-9) / (1 - share + 1e-9)), np.zeros(size, np.float32), np.zeros((size, factors), np.float32))
    if not kept.any():
        return model
    # kept columns are numbered anew, so that steps are small
    cols = np.flatnonzero(kept)
    new = np.zeros(size, np.int64)
    new[cols] = np.arange(len(cols))
    data = []
    for at, n, _ in rows:
        at, x = model.values(at, n)
        data.append((new[at], x.astype(np.float32)))
    w, v, b = np.zeros(len(cols), np.float32), rng.normal(0, 0.05, (len(cols), factors)).astype(np.float32), model.bias
    mw, sw, mv, sv, mb, sb, step = np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v), 0.0, 0.0, 0
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for k in range(0, len(order), 128):
            part = order[k : k + 128]
            idx = np.concatenate([data[i][0] for i in part])
            x = np.concatenate([data[i][1] for i in part])
            ends = np.cumsum([len(data[i][0]) for i in part])
            row = np.repeat(np.arange(len(part)), np.diff(ends, prepend=0))
            vi = v[idx]
            s = np.zeros((len(part), v.shape[1]), np.float32)
            xv = vi * x[:, None]
            for f in range(v.shape[1]):
                s[:, f] = np.bincount(row, xv[:, f], len(part))
            z = b + np.bincount(row, x * w[idx], len(part)) + 0.5 * ((s * s).sum(1) - np.bincount(row, (xv * xv).sum(1), len(part)))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weight[part] / len(part)
            at, inverse = np.unique(idx, return_inverse=True)
            gx = g[row] * x
            gw = np.bincount(inverse, gx, len(at)) + shrink * w[at]
            each = gx[:, None] * (s[row] - xv)
            gv = np.stack([np.bincount(inverse, each[:, f], len(at)) for f in range(v.shape[1])], 1) + 0.1 * shrink * v[at]
            step += 1
            r1, r2 = 1 - 0.9**step, 1 - 0.999**step
            mw[at] = 0.9 * mw[at] + 0.1 * gw
            sw[at] = 0.999 * sw[at] + 0.001 * gw * gw
            w[at] -= rate * (mw[at] / r1) / (np.sqrt(sw[at] / r2) + 1e-8)
            mv[at] = 0.9 * mv[at] + 0.1 * gv
            sv[at] = 0.999 * sv[at] + 0.001 * gv * gv
            v[at] -= rate * 0.2 * (mv[at] / r1) / (np.sqrt(sv[at] / r2) + 1e-8)
            gb = float(g.sum())
            mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
            b -= rate * (mb / r1) / (math.sqrt(sb / r2) + 1e-8)
    model.bias, model.weights[cols] = b, w
    model.factors[cols] = v
    return model


def training_rows(docs: DataFrame, labels: DataFrame, use: Column, bits: int, most_rows: int, label_col: str = "toxic") -> list[tuple[np.ndarray, np.ndarray, int]]:
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull()).select("doc_id", F.col(label_col).cast("int").alias("_y")).where(use).dropDuplicates(["doc_id"])
    n = known.count()
    if n > most_rows:
        known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    # bounded: most_rows ids; of rows that repeat an id the greatest text is taken
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("_y").alias("_y"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Terms(bits)
        for b in batches:
            got = [own.of(t) for t in b.column(1).to_pylist()]
            at = pa.array([a.astype(np.int32) for a, _ in got], pa.list_(pa.int32()))
            times = pa.array([n.astype(np.int32) for _, n in got], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), at, times, b.column(2)], ["doc_id", "at", "n", "y"])

    out = texts.select("doc_id", "text", "_y").mapInArrow(terms, "doc_id long, at array<int>, n array<int>, y int").toArrow()
    rows = sorted(zip(out["doc_id"].to_pylist(), out["at"].combine_chunks().to_numpy(zero_copy_only=False), out["n"].combine_chunks().to_numpy(zero_copy_only=False), out["y"].to_pylist()), key=lambda r: r[0])
    return [(at.astype(np.int64), n.astype(float), y) for _, at, n, y in rows]


def toxicity(docs: DataFrame, labels: DataFrame, use: Column | None = None, bits: int = 18, most_rows: int = 6000, **how) -> DataFrame:
    """doc_id, score, predicted for every row of ``docs``; ``use`` tells which rows of ``labels`` are trained on."""
    model = train(training_rows(docs, labels, F.lit(True) if use is None else use, bits, most_rows), bits, **how)
    shared = docs.sparkSession.sparkContext.broadcast((model.bits, model.kept, model.bias, model.weights, model.factors))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        own = Terms(m.bits, m.kept)
        for b in batches:
            s = [m.score(*own.of(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double, predicted int")
