from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from clauselake.operators.references import orphan_report, reference_states, referring_rows

T0, T1, T2 = D(2025, 1, 1), D(2025, 2, 1), D(2025, 3, 1)


def states(spark, refs, target, match="simple", cols=1):
    names = [f"r{i}" for i in range(cols)]
    keys = [f"k{i}" for i in range(cols)]
    r = spark.createDataFrame(refs, "id string, " + ", ".join(f"{n} string" for n in names) + ", at timestamp")
    t = spark.createDataFrame(target, ", ".join(f"{k} string" for k in keys) + ", st string, at timestamp")
    s = reference_states(r, names, t, keys, ref_created="at", target_created="at", target_deleted=F.lower("st") == "deleted", match=match)
    return {x.id: x.ref_state for x in s.collect()}


def test_states_and_precedence(spark):
    target = [("D1", "active", T0), ("d2", "active", T0), ("d2", "Deleted", T1), ("d3", "active", T2), ("d4", "deleted", T0), ("d4", "active", T1), ("d5", "DELETED", T2), (None, "deleted", T0)]
    refs = [("a", " d1\t", T1), ("b", "D2", T1), ("c", "d3", T1), ("d", "d4", T1), ("e", "zz", T1), ("f", None, T1), ("g", " \t", T1), ("h", "d5", T0), ("i", "d1", None)]
    assert states(spark, refs, target) == {"a": "ok", "b": "deleted", "c": "late", "d": "ok", "e": "missing", "f": "none", "g": "none", "h": "deleted", "i": "ok"}


def test_tie_of_latest_counts_as_deleted(spark):
    assert states(spark, [("a", "d", T1)], [("d", "active", T0), ("d", "deleted", T0)]) == {"a": "deleted"}


@pytest.mark.parametrize("match,want", [
    ("simple", {"full": "ok", "half": "none", "other": "none", "bad": "missing", "null": "none"}),
    ("full", {"full": "ok", "half": "invalid", "other": "invalid", "bad": "missing", "null": "none"}),
    ("partial", {"full": "ok", "half": "ok", "other": "missing", "bad": "missing", "null": "none"}),
])
def test_composite_match_semantics(spark, match, want):
    refs = [("full", "x", "1", T1), ("half", None, "1", T1), ("other", "q", None, T1), ("bad", "x", "9", T1), ("null", None, " ", T1)]
    assert states(spark, refs, [("x", "1", "active", T0), ("x", "2", "active", T0)], match, 2) == want


def test_partial_match_with_deleted_targets(spark):
    """A deleted target can be neither the match nor the reason that a reference is not late."""
    target = [("a", "1", "active", T0), ("a", "1", "deleted", T0), ("a", "2", "active", T2), ("b", "1", "deleted", T0), ("b", "2", "Deleted", T2), ("c", "1", "deleted", T2), ("c", "2", "active", T0)]
    refs = [("late", "a", None, T1), ("gone", "b", None, T1), ("ok", "c", None, T1), ("exact", "a", "1", T1), ("one", None, "1", T1), ("two", None, "2", T1), ("no", None, "3", T1)]
    assert states(spark, refs, target, "partial", 2) == {"late": "late", "gone": "deleted", "ok": "ok", "exact": "deleted", "one": "deleted", "two": "ok", "no": "missing"}


def test_empty_tables_and_extra_columns(spark):
    assert states(spark, [], [("d", "active", T0)]) == {}
    assert states(spark, [("a", "d", T1)], []) == {"a": "missing"}
    r = spark.createDataFrame([("a", "d", T1, "x")], "id string, r string, at timestamp, ref_state string")
    t = spark.createDataFrame([("d", "active", T0, "x")], "k string, st string, at timestamp, r string")
    s = reference_states(r, ["r"], t, ["k"], ref_created="at", target_created="at", target_deleted=F.col("st") == "deleted")
    assert [x.ref_state for x in s.collect()] == ["ok"]


def test_referring_rows_fold_by_key_and_report(spark):
    df = spark.createDataFrame([("K1", "d", T1), (" k1", "d", T0), ("k2", None, T1), (" ", "d", T0), (None, "d", T0)], "id string, ref string, created_at timestamp")
    rows = {x.row_key: (x.ref_0, x.created_at) for x in referring_rows(df, "t", "id", ["ref"]).collect()}
    assert rows == {" k1": ("d", T0), "k2": (None, T1)}
    st = spark.createDataFrame([("t", "missing", T0), ("t", "missing", T0), ("t", "ok", T1)], "tab_name string, ref_state string, created_at timestamp")
    assert {tuple(x) for x in orphan_report(st).collect()} == {("t", "2025-01", "missing", 2), ("t", "2025-02", "ok", 1)}


def test_hot_reference_keeps_all_rows(spark):
    refs = spark.range(3000).select(F.concat(F.lit("r"), "id").alias("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("x"), "id")).alias("r"), F.lit(T1).alias("at"))
    t = spark.createDataFrame([("hot", "active", T0)], "k string, st string, at timestamp")
    s = reference_states(refs, ["r"], t, ["k"], ref_created="at", target_created="at", target_deleted=F.lit(False))
    assert {x.ref_state: x["count"] for x in s.groupBy("ref_state").count().collect()} == {"ok": 1000, "missing": 2000}
