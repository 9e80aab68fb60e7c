"""The queries of the corpus operators, each over its whole table, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clustering, hard_negatives, language_id, license_scan, line_dedup, near_dedup, oracle, packing, quality_rules, secret_scan, token_counts, url_filter, vector_search
from .common import table


#: The vocabulary of op2 and op12; a deployment points this at its own copy.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, size=3, percent=85)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest(docs, vocabulary_path()).select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fields = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return license_scan.scan(docs).select("doc_id", *[f"license.{f}" for f in fields])


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_search.search(vectors, vectors.where("vec_id % 100 = 0"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = secret_scan.learn(docs)
    found = secret_scan.scan(docs, net)

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(f"secrets.{spans}", lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("secrets.base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    run = lambda r: F.concat_ws(":", r["begin"], r["lines"], r["source"]["doc"], r["source"]["i"])
    runs = F.array_join(F.transform(F.coalesce("lines.runs", F.array()), run), ",").alias("runs")
    return line_dedup.dedup(docs).select("doc_id", "lines.n_lines", "lines.n_deleted", "lines.text", runs)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out("doc_id"))
    model = language_id.train(docs.where("not held_out and doc_id is not null"))
    return language_id.identify(docs, model).select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), "language.score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.judge(docs.select("doc_id", "text", "lang"), keep=["doc_id"]).select("doc_id", *[F.col(f"quality.{f}") for f in fields])


#: Fixed value: texts of more tokens are over the limit.
TOKEN_LIMIT = 512


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(vectors, vectors.where("vec_id % 100 = 0"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, token_counts.vocabulary(vocabulary_path()), out="n_tokens")
    return counted.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_bpe": op2_bpe,
    "op3_license_scan": op3_license_scan,
    "op4_packing": op4_packing,
    "op5_url_filter": op5_url_filter,
    "op6_vector_search": op6_vector_search,
    "op7_secret_scan": op7_secret_scan,
    "op8_line_dedup": op8_line_dedup,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_counts": op12_token_counts,
    "op13_clustering": op13_clustering,
}
ORACLE: dict[str, str] = {
    "op5_url_filter": oracle.URL_FILTER,
    "op8_line_dedup": oracle.LINE_DEDUP,
    "op10_quality_rules": oracle.QUALITY_RULES,
    "op11_hard_negatives": oracle.HARD_NEGATIVES,
    "op13_clustering": oracle.CLUSTERING,
}
