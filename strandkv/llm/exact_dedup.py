r"""Exact duplicates by content sort.

Splitters sampled from the texts range-partition the rows by content: by the first characters of the text, then its
digest, then the id. An external sort inside each range places equal texts next to each other, and each row is compared
in full with its neighbour. A splitter holds HEAD characters, a digest and an id, however long the texts and however many
of them begin alike. A splitter cuts a group only where samples before and after it hold the same text, so a large group
of copies is spread over many ranges; the groups of those few texts are summed up once more.

DataFrame functions only; one shuffle of the texts.

Cases: null text counts as empty; null ids lose to any other; repeated rows (same id and text) are members of the group
like any other and one of them stays; an empty table gives an empty result. Other columns of the input, whatever their
names, are ignored by ``exact_groups`` and kept by ``exact_kept``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, stage

HEAD = 100
Key = tuple[bytes, str, int]  # first characters, digest, id


def _splitters(keys: list[Key], parts: int) -> list[Key]:
    """From sorted samples: at most parts-1 rising ones; the id is the least possible but inside a run of equal texts."""
    step, out = max(1, math.ceil(len(keys) / parts)), []
    for i in range(step, len(keys), step):
        head, sha, d = keys[i]
        s = (head, sha, d if keys[i - 1][:2] == (head, sha) else -(2**63))
        if not out or s > out[-1]:
            out.append(s)
    return out


def _range_of(key: Column, splitters: Column, n: int) -> Column:
    """Number of splitters at or below the key, by binary search in a literal array."""

    def halve(lo_hi: Column, _: Column) -> Column:
        lo, hi = lo_hi["lo"], lo_hi["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        open_ = lo < hi
        below = F.get(splitters, mid) <= key
        return F.struct(F.when(open_ & below, mid + 1).otherwise(lo).alias("lo"), F.when(open_ & ~below, mid).otherwise(hi).alias("hi"))

    first = F.struct(F.lit(0).cast("int").alias("lo"), F.lit(n).cast("int").alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, math.ceil(math.log2(n + 1)) + 1))), first, halve, lambda x: x["lo"])


def _sorted(docs: DataFrame, id_col: str, text_col: str, keep: str, carry: list[str], parts: int, per_part: int, samples: int) -> tuple[DataFrame, DataFrame]:
    """The rows sorted, and of the groups that may reach over a range's edge (at most one for each splitter) _hk, the
    digest, _hbest, the id that stays, and _hn, the number of rows. The rows' columns: _id, _d (the id, or what stands for null), _sha, _split (whether the group may reach over a range's edge), _p (the
    range), _new (1 for the first row of a text in its range, the one that stays there), _run and the struct _c."""
    least = -(2**63) + 1 if keep == "largest" else 2**63 - 1  # stands for a null id, which loses
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.struct(F.lit(0).alias("_"), *carry).alias("_c"))
    rows = rows.withColumns({"_d": F.coalesce(F.col("_id"), F.lit(least)), "_sha": F.sha2("_text", 256)})
    key = [F.substring("_text", 1, HEAD), F.col("_sha"), F.col("_d")]

    n = docs.count()  # from the files' footers
    wanted = parts * samples
    # the sample is bounded: about ``samples`` keys of HEAD characters a partition
    got = (rows.sample(min(1.0, wanted / max(n, 1)), 7) if n > wanted else rows).select(key[0].alias("h"), "_sha", "_d").collect()
    keys = sorted((r["h"].encode(), r["_sha"], r["_d"]) for r in got)
    cut = _splitters(keys, parts * per_part)
    split = sorted({sha for _, sha, d in cut if d > -(2**63)})
    if cut:
        literal = F.array(*[F.struct(F.lit(h.decode()).alias("h"), F.lit(sha).alias("s"), F.lit(d).cast("long").alias("d")) for h, sha, d in cut])
        rows = rows.withColumn("_p", _range_of(F.struct(key[0].alias("h"), key[1].alias("s"), key[2].alias("d")), literal, len(cut)))
    else:
        rows = rows.withColumn("_p", F.lit(0))
    order = Window.partitionBy("_p").orderBy("_text", F.col("_d").desc() if keep == "largest" else F.col("_d").asc())
    best = (F.max if keep == "largest" else F.min)("_d")
    is_split = F.col("_sha").isin(split) if split else F.lit(False)
    sums = rows.select("_sha", "_d").where(is_split).groupBy(F.col("_sha").alias("_hk")).agg(best.alias("_hbest"), F.count(F.lit(1)).alias("_hn"))
    runs = (
        rows.repartitionById(parts, F.col("_p"))
        .withColumn("_new", F.when(F.lag("_text").over(order) == F.col("_text"), 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_split", is_split)
        .drop("_text")
    )
    return runs, sums


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", parts: int | None = None, per_part: int = 4, samples: int = 40) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    keep: "largest" or "smallest" identifier of a group stays. parts: shuffle partitions; each takes ``per_part``
    ranges, found from about ``samples`` sampled texts a partition.
    """
    runs, _ = _sorted(docs, id_col, text_col, keep, [], parts or shuffle_parts(docs.sparkSession), per_part, samples)
    runs = stage(runs.drop("_c"), "exact-runs")
    # pre-aggregated by range: what a run holds, and over the ranges' edges the groups that were cut; at most one row for
    # each splitter is broadcast
    best = F.max if keep == "largest" else F.min
    group = Window.partitionBy("_p", "_run")
    each = runs.withColumns({"_best": best("_d").over(group), "_n": F.count(F.lit(1)).over(group)})
    sums = runs.where("_split").groupBy("_sha").agg(best("_d").alias("_hbest"), F.count(F.lit(1)).alias("_hn"))
    each = each.join(F.broadcast(sums.withColumnRenamed("_sha", "_hk")), F.col("_split") & (F.col("_sha") == F.col("_hk")), "left")
    found = F.coalesce("_hbest", "_best")
    return each.select(
        F.col("_id").alias(id_col),
        F.when(found.between(-(2**63) + 2, 2**63 - 2), found).alias("keep_id"),
        F.coalesce("_hn", "_n").alias("group_size"),
        ((F.col("_new") == 1) & (F.col("_d") == found)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def exact_kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", parts: int | None = None, per_part: int = 4, samples: int = 40) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    runs, sums = _sorted(docs, id_col, text_col, keep, docs.columns, parts or shuffle_parts(docs.sparkSession), per_part, samples)
    first = runs.where("_new = 1").join(F.broadcast(sums), F.col("_split") & (F.col("_sha") == F.col("_hk")), "left")
    return first.where(F.coalesce("_hbest", "_d") == F.col("_d")).select(*(F.col("_c")[c].alias(c) for c in docs.columns))
