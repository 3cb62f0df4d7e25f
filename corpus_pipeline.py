"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloc.llm.line_dedup import drop_repeated_lines
from lumenloc.llm.ngram_join import jaccard_components
from lumenloc.llm.packing import pack_documents
from lumenloc.llm.quality import THRESHOLD, add_statistics, fit, scored, with_statistics
from lumenloc.llm.secret_scan import scan_secrets
from lumenloc.llm.shared import documents, fresh, removed, staged


def _texts(out: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs with the new text and its length."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": F.col(text)}
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on their labels, rejects go. Each text's statistics are made twice, for the
    fit and for the score: kept between them with the texts, they would take more room than the input in all stages."""
    (features,) = fresh(docs, "features")
    fitted = fit(with_statistics(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return add_statistics(docs, features).where(scored(F.col(features), fitted) >= THRESHOLD).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of three lines go, and with them documents of which nothing is left."""
    n_lines, n_removed = fresh(docs, "n_lines", "n_removed")
    out = drop_repeated_lines(docs, n_lines=n_lines, n_removed=n_removed)
    return _texts(out.where((F.col(n_removed) < F.col(n_lines)) | (F.col(n_lines) == 0)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group, at five words and 0.8, one document stays: that with the smallest id, of those with one id that
    whose text has the smallest hash, and one row of repeated ones. Null ids come last; documents without words stay."""
    (key,) = fresh(docs, "document")
    # ids may be null or repeated: a document is its id and its text
    text = F.coalesce("text", F.lit(""))
    docs_by = docs.withColumn(key, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("one"), F.xxhash64(F.lit(1), text).alias("two")))
    found = staged(jaccard_components(docs_by.select(F.col(key).alias("doc_id"), "text"), n=5, num=80, den=100), "pipeline-components").where("n_shingles > 0")
    kept = docs_by.join(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), key, "left_anti")
    repeated = found.groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("n")).where("n > 1").select(key)
    if not repeated.isEmpty():
        kept = kept.join(repeated, key, "left_anti").unionByName(kept.join(repeated, key, "left_semi").dropDuplicates([key]))
    return kept.select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in a text become a mark; every document stays."""
    base, spans, redacted = fresh(docs, "base_spans", "spans", "redacted_text")
    return _texts(scan_secrets(docs, base_spans=base, spans=spans, redacted_text=redacted), docs, redacted)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of 2048 tokens; documents of a source or with equal texts never share one."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("packing", packing),
]
#: The classifier and the packing can't be expressed in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            removed(before)
    return docs
