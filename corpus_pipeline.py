"""From raw documents to packed training sequences: quality, near-duplicates, repeats, benchmark leaks, packing.

Every stage takes what the stage before it kept and decides about all of it. Stages return the columns of documents,
but the last, which returns the packed pieces. Null or empty texts pass through every stage as empty documents (the
quality stage judges them like any other). Rows that repeat a doc_id are documents of their own in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import decontaminate, neardup, packing, quality, repeats
from chronoloom.llm.common import materialize, read, tune


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field, learned as in op5, doesn't reject."""
    tune(spark)
    field = quality.learned(docs, read(spark, sf_dir, "labels"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("p_doc"), "text")
    return quality.score(rows, field).where(F.col("predicted") == 1).select("p_doc.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group whose sets of five-word shingles are 0.8 alike: the one with the smallest doc_id, of equal
    ones the first. A null doc_id counts as larger than all others."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("p_doc"), F.monotonically_increasing_id().alias("p_row"))
    rows = materialize(rows)  # numbers hold only as written: another split of the input would give others
    rows = rows.withColumns({"p_id": F.col("p_doc.doc_id"), "text": F.col("p_doc.text")})
    groups = materialize(neardup.near_duplicates(rows.select(F.col("p_row").alias("doc_id"), "text"), width=5))
    members = groups.select(F.col("doc_id").alias("p_row"), "component_id").join(rows.select("p_row", "p_id"), "p_row")
    first = F.min(F.struct(F.col("p_id").isNull().alias("none"), "p_id", "p_row")).alias("first")
    kept = members.groupBy("component_id").agg(first).select(F.col("first.p_row").alias("p_row"))
    gone = materialize(groups.select(F.col("doc_id").alias("p_row")).join(kept, "p_row", "left_anti"))
    return rows.join(gone, "p_row", "left_anti").select("p_doc.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a document with a smaller doc_id has in a passage of 50 bytes; n_chars follows.

    Where a cut falls inside a character, its broken bytes become the replacement character."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("p_doc"), "doc_id", "text")
    text = F.make_valid_utf8(F.col("r_kept").cast("string"))
    cut = repeats.remove_repeats(rows).withColumn("p_doc", F.col("p_doc").withField("text", text))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("p_doc", F.col("p_doc").withField("n_chars", F.length(text).cast("long")))
    return cut.select("p_doc.*")


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("p_doc"), "text")
    return decontaminate.find_leaks(rows, read(spark, sf_dir, "benchmark"), keep=("p_doc",)).where(F.size("d_spans") == 0).select("p_doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", without_near_duplicates),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_leaks),
    ("best-fit packing", packed),
]
#: SQL can't express the stages' models and packing; the tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
