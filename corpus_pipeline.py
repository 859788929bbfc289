"""A corpus pipeline: quality rules, exact deduplication, near-duplicate removal, masking of personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows and reads them again as
the next one's documents. All stages but the last return the columns of ``documents``.

Cases: null text counts as empty, which the quality rules reject; null ids pass; rows are told apart by doc_id and text
together, so rows that repeat an id are kept or dropped by their own text, and of rows that repeat in full one stays;
texts of any length are taken whole; an empty table gives an empty result; columns beside those of ``documents`` are
left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkv.llm.common import stage
from strandkv.llm.exact_dedup import exact_kept
from strandkv.llm.jaccard import components
from strandkv.llm.packing import pack
from strandkv.llm.pii import personal_data
from strandkv.llm.quality import quality
from strandkv.llm.queries import WORD_TOKENIZER

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text) -> DataFrame:
    """The columns of documents, with another text."""
    return docs.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; of the others, lines that too many documents of their host hold go."""
    got = quality(docs.select(*COLUMNS))
    # the number keeps the filter above the projections; pushed into them, it would copy their expressions
    got = got.withColumn("_row", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("_row") >= 0))
    return _with_text(got, F.col("clean_text"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_kept(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles at similarity 0.8 connect, the one with the least doc_id stays."""
    docs = docs.select(*COLUMNS).withColumn("_own", F.xxhash64("doc_id", "text"))  # tells rows apart where ids repeat or are null
    got = components(docs, 5, 80, id_col="_own").toDF("_own", "_n", "_component")
    rows = got.join(docs.select("_own", "doc_id").distinct(), "_own")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_own")).alias("_best")
    stay = rows.groupBy("_component").agg(best).select("_best._own")
    # a row that is repeated in full stays once
    return docs.join(stay, "_own", "left_semi").dropDuplicates(["_own"]).select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by the name of its kind."""
    return personal_data(docs.select(*COLUMNS), masked=True, carry=COLUMNS[2:4]).transform(lambda d: _with_text(d, F.col("masked_text")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, WORD_TOKENIZER, 4096, 1)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mask_personal_data", mask_personal_data), ("best_fit_packing", best_fit_packing)]

#: The tagger and the tokenizer can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
