"""Queries of the operators for training data, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.llm.leakage import leaks
from clauselake.llm.mixing import Mixer
from clauselake.llm.neardup import near_duplicates
from clauselake.llm.scans import repair_scans, texts_of
from clauselake.llm.splitting import finest_cuts, oversized, split_oversized
from clauselake.llm.toxicity import CATEGORIES, fit_models, with_scores
from clauselake.session import table


def _p2(spark: SparkSession, d: str):
    return near_duplicates(table(spark, d, "clauses"), "clause_id", "clause_text", k=3, threshold=0.5, min_words=40)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d).pairs().select(F.col("id_a").alias("clause_id_a"), F.col("id_b").alias("clause_id_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d).groups().withColumnRenamed("id", "clause_id")


DOCUMENT_LIMIT, CLAUSE_LIMIT, OVERLAP = 12_000, 2_400, 200


def _p3(spark: SparkSession, d: str) -> DataFrame:
    docs = split_oversized(table(spark, d, "documents"), "document_id", "file_text", DOCUMENT_LIMIT, OVERLAP)
    clauses = split_oversized(table(spark, d, "clauses"), "clause_id", "clause_text", CLAUSE_LIMIT, OVERLAP)
    return docs.select(F.lit("documents").alias("tab_name"), "*").unionAll(clauses.select(F.lit("clauses").alias("tab_name"), "*"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    docs = finest_cuts(table(spark, d, "documents"), "document_id", "file_text", DOCUMENT_LIMIT)
    clauses = finest_cuts(table(spark, d, "clauses"), "clause_id", "clause_text", CLAUSE_LIMIT)
    return docs.select(F.lit("documents").alias("tab_name"), "*").unionAll(clauses.select(F.lit("clauses").alias("tab_name"), "*"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _p3(spark, d).select("tab_name", "row_key", F.inline("pieces"))


def p3_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """For every text over the limit: do its pieces give the text again, keep the limit and the overlap, and stand in order?"""
    parts = []
    for tab, k, text, limit in (("documents", "document_id", "file_text", DOCUMENT_LIMIT), ("clauses", "clause_id", "clause_text", CLAUSE_LIMIT)):
        cut = split_oversized(table(spark, d, tab), k, text, limit, OVERLAP)
        whole = oversized(table(spark, d, tab), k, text, limit)
        new = F.transform("pieces", lambda p: F.substring(p["piece_text"], p["overlap"] + 1, F.length(p["piece_text"])))
        parts.append(cut.join(whole, "row_key").select(
            F.lit(tab).alias("tab_name"), "row_key", (F.array_join(new, "") == F.col("text")).alias("rejoined"),
            F.forall("pieces", lambda p: F.length(p["piece_text"]) <= limit).alias("within_limit"),  # noqa: B023
            F.forall("pieces", lambda p: (p["overlap"] <= OVERLAP) & (F.substring(F.col("text"), p["start_at"] + 1, F.length(p["piece_text"])) == p["piece_text"])).alias("overlap_repeats"),
            F.forall(F.transform("pieces", lambda p, i: p["piece_no"] == i + 1), lambda ok: ok).alias("ordered")))
    return parts[0].unionAll(parts[1])


def _p5(spark: SparkSession, d: str) -> DataFrame:
    docs = texts_of(table(spark, d, "documents"), "documents", "document_id", "file_text")
    return repair_scans(docs.unionAll(texts_of(table(spark, d, "document_uploads"), "document_uploads", "upload_id", "file_text")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _p5(spark, d).select("tab_name", "row_key", F.inline("issues"))


def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text as continuous paragraphs; clean texts as they are."""
    return _p5(spark, d).select("tab_name", "row_key", "text")


def _p6(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text", min_run=20).withColumnRenamed("id", "doc_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _p6(spark, d).where("run_words >= 20").select("doc_id", "item_id")  # shorter items, held whole, are in p6_items


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """For each leaked item: documents, the longest run and the largest share of its shingles in one document."""
    return _p6(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("run_words").alias("longest_run"), F.max("containment").alias("max_containment"))


def _p7(spark: SparkSession, d: str) -> Mixer:
    return Mixer(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d).shortages().select("mix_name", "source")


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d).selection().withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d).shares()


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """For every target: are the repeats within their limit, and the chosen tokens those that the flow planned?"""
    return _p7(spark, d).limits()


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document with a score for each category."""
    docs = table(spark, d, "documents")
    models = fit_models(docs, "doc_id", "text", table(spark, d, "content_labels"), "doc_id", "verdict")
    return with_scores(docs, "text", ["doc_id", "source"], models)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    s = p8_scores(spark, d)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in CATEGORIES])).alias("p")
    return s.select("doc_id", pairs).where("p.score >= 0.5").select("doc_id", "p.category").distinct()


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the share of them in each category, for each source."""
    s = p8_scores(spark, d)
    rates = [F.avg((F.col(c) >= 0.5).cast("double")).alias(f"{c}_rate") for c in CATEGORIES]
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), *rates)


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_groups, p3_found, p3_pieces, p3_rejoined, p5_found, p5_texts, p6_found, p6_items, p7_found, p7_selection, p7_shares, p7_limits, p8_found, p8_scores, p8_rates)
}
