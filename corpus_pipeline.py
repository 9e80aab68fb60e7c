"""The corpus pipeline: quality rules, line dedup, near-dedup, secret scans, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on all rows its predecessor kept; between stages the rows
are written as Parquet and read again. All but the last return the columns of documents: doc_id, text, lang, source, n_chars (and
any others that came in).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import line_dedup, near_dedup, packing, quality_rules, secret_scan
from lodeseek.llm.common import column, free_prefix, materialize, table


def _with_text(rows: DataFrame, columns: list[str], text) -> DataFrame:
    """rows with a new text, and n_chars, where there is one, as its length."""
    new = {"text": text}
    if "n_chars" in columns:
        new["n_chars"] = F.length(text).cast(rows.schema["n_chars"].dataType)
    return rows.select(*[new[c].alias(c) if c in new else column(c).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts; a document of which no line with a word is left goes."""
    out = free_prefix("__lines", docs.columns)
    found = line_dedup.dedup(docs, out=out).where(F.col(f"{out}.n_deleted") < F.greatest(F.col(f"{out}.n_lines"), F.lit(1)))
    return _with_text(found, docs.columns, F.col(f"{out}.text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, once: the one of least id, or one without an id where none has any.

    Rows are told apart by a key of their own: rows that share an id, or have none, are documents like others. Texts without a
    word are alike with none but rows of their id.
    """
    own = free_prefix("__near_", docs.columns)
    key, node, worded, kept = (own + name for name in ("key", "node", "worded", "kept"))
    rows = materialize(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    found = near_dedup.near_duplicates(rows, key).select(F.col("doc_id").alias(node), "component_id", (F.col("n_shingles") > 0).alias(worded))
    both = rows.select(key, "doc_id").join(found, F.col(key) == F.col(node))
    empty = ~F.col(worded)
    group = [F.when(F.col(worded), F.col("component_id")), F.when(empty, F.col("doc_id")), F.when(empty & F.col("doc_id").isNull(), F.col(key))]
    first = both.groupBy(*[g.alias(f"{own}g{i}") for i, g in enumerate(group)]).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)).alias("first"))
    ids = first.select(F.col(f"first.{key}").alias(kept))
    return rows.join(ids, F.col(key) == F.col(kept), "left_semi").select(*[column(c) for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become marks; all documents stay."""
    net = secret_scan.learn(docs)
    out = free_prefix("__secrets", docs.columns)
    return _with_text(secret_scan.scan(docs, net, out=out), docs.columns, F.col(f"{out}.redacted"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts with their places in sequences."""
    return packing.pack(docs, with_text=True)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near_duplicates), ("secret scans", secrets), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs


#: Sketches, trained networks and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None
