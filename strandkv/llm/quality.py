r"""Quality rules with cross-document line frequency.

Every line is normalised (runs of white space become one space, trimmed, A-Z lower-cased) and hashed; per host the
distinct documents (copies of one text count once) that hold each line are counted. Lines in more documents than the
limits allow are removed, and a document of which too little is left is rejected, as are documents that fail the base
rules. DataFrame functions only: texts are never shuffled, only line hashes are, pre-aggregated.

Cases: null text counts as empty; a null host is a host of its own; repeated rows each get a result and count once as
documents; empty texts have zero counts and fail the base rules; an empty table gives an empty result; a very long text
is one row like any other. Other columns pass through ``quality``; an input column that has the name of a result (n_words,
word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_lines, n_left_words, clean_text, kept) is
replaced by it, and names that begin with ``_q_`` are its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stage

SYMBOLS = "#*$%&|<>"


def _bare(c: Column) -> Column:
    return F.translate(c, SPACES, "")


def _words(c: Column) -> Column:
    return F.array_remove(F.split(F.translate(c, SPACES, " " * len(SPACES)), " "), "")


def _normal(line: Column) -> Column:
    low = F.translate(line, SPACES + "ABCDEFGHIJKLMNOPQRSTUVWXYZ", " " * len(SPACES) + "abcdefghijklmnopqrstuvwxyz")
    return F.array_join(F.array_remove(F.split(low, " "), ""), " ")


def base_counts(df: DataFrame, text: Column) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    lines = F.filter(F.split(F.col("_q_text"), "\n"), lambda x: _bare(x) != "")
    df = df.withColumn("_q_text", text).withColumn("_q_w", _words(F.col("_q_text")))
    df = df.withColumn("_q_lines", lines).withColumn("n_words", F.size("_q_w").cast("long"))
    df = df.withColumn("word_chars", F.length(_bare(F.col("_q_text"))).cast("long"))
    df = df.withColumn("n_symbols", (F.length("_q_text") - F.length(F.translate("_q_text", SYMBOLS, ""))).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"))
    # 64-bit hashes of 3-word windows; within one document two windows collide with a chance below 1e-9
    grams = F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), lambda i: F.xxhash64(F.get("_q_w", i), F.get("_q_w", i + 1), F.get("_q_w", i + 2))))
    df = df.withColumn("_q_g", F.coalesce(grams, F.array().cast("array<bigint>")))
    placed = F.when(F.size(F.array_distinct("_q_g")) < F.size("_q_g"), F.sort_array(F.transform("_q_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("_q_s", placed)
    again = F.filter("_q_s", lambda x, k: (x["h"] == F.get("_q_s", k - 1)["h"]) | (x["h"] == F.get("_q_s", k + 1)["h"]))
    df = df.withColumn("_q_at", F.transform(again, lambda x: x["i"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_q_at", lambda i: F.array(i, i + 1, i + 2)))))
    df = df.withColumn("n_repeat_words", F.when(F.col("_q_at").isNull(), 0).otherwise(covered).cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return df.drop("_q_w", "_q_g", "_q_s", "_q_at")


def frequent_lines(docs: DataFrame, host: Column, text: Column, least_docs: int, percent: int) -> DataFrame:
    """host -> hashes of lines that more than max(least_docs, percent of the host's) distinct documents hold, and its rows.

    A host has fewer than 100 / percent times its mean number of lines a document, so an array per host is small.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: _bare(x) != "")
    rows = docs.select(host.alias("_q_host"), F.xxhash64(text).alias("_q_d"), F.array_distinct(F.transform(lines, lambda x: F.xxhash64(_normal(x)))).alias("_q_h"))
    # null marks the document itself, so that one pass counts documents and lines
    each = rows.select("_q_host", "_q_d", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), "_q_h")).alias("_q_h")).distinct()
    counts = stage(each.groupBy("_q_host", "_q_h").agg(F.count(F.lit(1)).alias("_q_n")).where((F.col("_q_n") > least_docs) | F.col("_q_h").isNull()), "line-counts")
    size = counts.where(F.col("_q_h").isNull()).select("_q_host", F.col("_q_n").alias("_q_docs"))
    over = counts.where(F.col("_q_h").isNotNull()).join(size, "_q_host").where(100 * F.col("_q_n") > percent * F.col("_q_docs"))
    rows = docs.groupBy(host.alias("_q_host")).agg(F.count(F.lit(1)).alias("_q_rows"))
    found = over.groupBy("_q_host").agg(F.sort_array(F.collect_list("_q_h")).alias("_q_over"))
    return stage(found.join(rows, "_q_host"), "frequent-lines", (counts,))


def quality(docs: DataFrame, text_col: str = "text", host_col: str = "source", least_docs: int = 20, percent: int = 10, least_left_percent: int = 20) -> DataFrame:
    """``docs`` with the base counts, n_removed_lines, n_left_words, clean_text and kept.

    A line goes if more than max(least_docs, percent of the host's distinct documents) hold it. kept is false where
    base rules fail or fewer than least_left_percent of the words are left.
    """
    host, text = F.coalesce(F.col(host_col), F.lit("\x00none")), F.coalesce(F.col(text_col), F.lit(""))
    over = frequent_lines(docs, host, text, least_docs, percent)
    df = docs.withColumn("_q_host", host)
    # hosts of more than one in a thousand rows are fewer than a thousand: those are broadcast, so that no task gets all
    # texts of one; a table of the others that is small is broadcast too, else joined by sort
    is_hot, small = 1000 * F.col("_q_rows") > docs.count(), ["_q_host", "_q_over"]
    hot, cold = over.where(is_hot).select(small), over.where(~is_hot).select(small)
    rest = df.join(F.broadcast(hot.select("_q_host")), "_q_host", "left_anti").join(cold, "_q_host", "left")
    # texts are counted after the joins, so each is counted once, however many ways lead to its host's lines
    df = base_counts(df.join(F.broadcast(hot), "_q_host").unionByName(rest), text)
    gone = lambda x: F.coalesce(F.array_contains("_q_over", F.xxhash64(_normal(x))), F.lit(False))
    df = df.withColumn("_q_gone", F.when(F.col("_q_over").isNull(), F.array().cast("array<string>")).otherwise(F.filter("_q_lines", gone)))
    df = df.withColumn("n_removed_lines", F.size("_q_gone").cast("long"))
    df = df.withColumn("n_left_words", F.col("n_words") - F.aggregate("_q_gone", F.lit(0), lambda a, x: a + F.size(_words(x))))
    left = F.array_join(F.filter(F.split("_q_text", "\n"), lambda x: ~gone(x)), "\n")
    df = df.withColumn("clean_text", F.when(F.col("n_removed_lines") == 0, F.col("_q_text")).otherwise(left))
    df = df.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_left_words") >= least_left_percent * F.col("n_words")))
    return df.drop("_q_host", "_q_over", "_q_gone", "_q_lines", "_q_text")

