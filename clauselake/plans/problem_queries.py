"""Queries of the general problems: missing references (p1) and hierarchies (p4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.operators.hierarchy import ancestor_pairs, cycle_pairs, hierarchy
from clauselake.operators.references import orphan_report, reference_states, referring_rows
from clauselake.session import table


def _deleted(column: str):
    return F.lower(F.btrim(F.col(column), F.lit(" \t"))) == "deleted"


def _p1_states(spark: SparkSession, d: str) -> DataFrame:
    docs, clauses = table(spark, d, "documents"), table(spark, d, "clauses")
    jobs = [
        ("clauses", "clause_id", "document_id", docs, "document_id", "status"),
        ("clause_units", "clause_unit_id", "clause_id", clauses, "clause_id", "review_status"),
        ("canonical_obligation_sources", "id", "clause_id", clauses, "clause_id", "review_status"),
    ]
    parts = []
    for tab, row_key, ref, target, target_key, status in jobs:
        refs = referring_rows(table(spark, d, tab), tab, row_key, [ref])
        parts.append(reference_states(refs, ["ref_0"], target, [target_key], ref_created="created_at", target_created="created_at", target_deleted=_deleted(status)))
    return reduce(DataFrame.unionAll, parts)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    s = _p1_states(spark, d).where(F.col("ref_state").isin("missing", "deleted", "late"))
    return s.select("tab_name", "row_key", "ref_state", F.date_format("created_at", "yyyy-MM").alias("ref_month"))


def p1_states(spark: SparkSession, d: str) -> DataFrame:
    """Every referring key with its state, ok and none included."""
    return _p1_states(spark, d).select("tab_name", "row_key", "ref_state")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_p1_states(spark, d))


def _p1_pairs(spark: SparkSession, d: str, match: str) -> DataFrame:
    refs = referring_rows(table(spark, d, "canonical_obligation_sources"), "canonical_obligation_sources", "id", ["document_id", "clause_id"])
    s = reference_states(
        refs, ["ref_0", "ref_1"], table(spark, d, "clauses"), ["document_id", "clause_id"],
        ref_created="created_at", target_created="created_at", target_deleted=_deleted("review_status"), match=match,
    )
    return s.select("row_key", "ref_state")


def p1_composite(spark: SparkSession, d: str) -> DataFrame:
    """Composite references (document_id, clause_id) of obligation sources to clauses, partial match: what is not null must agree with one row."""
    return _p1_pairs(spark, d, "partial")


def p1_full(spark: SparkSession, d: str) -> DataFrame:
    """The same with full match: a partly null reference is invalid."""
    return _p1_pairs(spark, d, "full")


def _p4_tree(spark: SparkSession, d: str, paths: bool = True) -> DataFrame:
    return hierarchy(table(spark, d, "clause_units"), "clause_unit_id", "parent_unit_id", paths=paths)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4_tree(spark, d, paths=False).select(F.col("node_id").alias("clause_unit_id"), F.col("root_id").alias("root_unit_id"), F.col("depth").alias("unit_depth"), "node_state")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path from the root for every unit of a tree; units on or below a cycle are in p4_cycle_paths."""
    t = _p4_tree(spark, d).where("node_state = 'tree'")
    return t.select(F.col("node_id").alias("clause_unit_id"), F.array_join("path", " > ").alias("unit_path"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """(ancestor, descendant, distance) for every unit of a tree and every unit below it; units below a cycle are in p4_cycle_descendants."""
    return ancestor_pairs(_p4_tree(spark, d).where("node_state = 'tree'"))


def p4_cycle_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path from the cycle's unit for every unit below a cycle; a unit on a cycle is its own path."""
    t = _p4_tree(spark, d).where("node_state <> 'tree'")
    return t.select(F.col("node_id").alias("clause_unit_id"), F.array_join("path", " > ").alias("unit_path"), "node_state")


def p4_cycle_descendants(spark: SparkSession, d: str) -> DataFrame:
    """(ancestor, descendant, distance) for every unit below a cycle: the units between, and every unit of the cycle at its least distance."""
    return cycle_pairs(_p4_tree(spark, d), table(spark, d, "clause_units"), "clause_unit_id", "parent_unit_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_states, p1_report, p1_composite, p1_full, p4_found, p4_paths, p4_descendants, p4_cycle_paths, p4_cycle_descendants)}
