from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from clauselake.operators import dml, graph, relational, rules, segment


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_dml(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (4, "d")], "k int, v string")
    assert rows(dml.upsert(old, new, ["k"])) == {(1, "a"), (2, "B"), (3, None), (4, "d")}
    assert rows(dml.upsert(dml.upsert(old, new, ["k"]), new, ["k"])) == rows(dml.upsert(old, new, ["k"]))
    assert rows(dml.insert_missing(old, new, ["k"])) == {(1, "a"), (2, "b"), (3, None), (4, "d")}
    assert rows(dml.update(old, new, ["k"], ["v"])) == {(1, "a"), (2, "B"), (3, None)}
    assert rows(dml.update(old, new, ["k"], [])) == rows(old)
    assert rows(dml.backfill(old, spark.createDataFrame([(3, "c"), (1, "z")], "k int, v string"), ["k"], ["v"])) == {(1, "a"), (2, "b"), (3, "c")}
    assert rows(dml.delete(old, new, ["k"])) == {(1, "a"), (3, None)}
    assert rows(dml.clear(old, F.col("k") == 1, ["v"])) == {(1, None), (2, "b"), (3, None)}
    assert rows(dml.changes(old, new, ["k"])) == {(1, "resolve"), (2, "keep"), (3, "resolve"), (4, "insert")}
    assert rows(dml.replace_groups(old, spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), "k")) == {(1, "x"), (1, "y"), (2, "b"), (3, None)}
    s = StructType([StructField("v", IntegerType()), StructField("w", StringType()), StructField("k", StringType())])
    assert rows(dml.conform(old, s)) == {(None, None, "1"), (None, None, "2"), (None, None, "3")}


def test_overwrite_groups(spark, tmp_path):
    p = str(tmp_path / "t")
    dml.overwrite_groups(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), p, "k")
    dml.overwrite_groups(spark.createDataFrame([(2, "c")], "k int, v string"), p, "k")
    assert {(r.k, r.v) for r in spark.read.parquet(p).collect()} == {(1, "a"), (2, "c")}


def test_windows_and_ids(spark):
    df = spark.createDataFrame([("x", 1, "a"), ("x", 2, "b"), ("y", 1, "c")], "g string, n int, v string")
    assert rows(relational.latest(df, ["g"], [F.desc("n")])) == {("x", 2, "b"), ("y", 1, "c")}
    assert rows(relational.first_n(df, ["g"], [F.asc("n")], 1)) == {("x", 1, "a"), ("y", 1, "c")}
    ids = relational.next_ids(df.select("v"), spark.createDataFrame([("P-007",), ("P-x",)], "id string"), "id", "P-", [F.asc("v")])
    assert rows(ids.select("v", "id")) == {("a", "P-008"), ("b", "P-009"), ("c", "P-010")}
    u = spark.createDataFrame([("c", 1, False, "pay"), ("c", 2, True, "x"), ("c", 3, True, "y"), ("c", 4, False, None), ("c", 5, True, "z")], "c string, i int, item boolean, s string")
    got = relational.inherited(u, "c", "i", F.col("item"), F.col("s"), "stem")
    assert [r.stem for r in got.orderBy("i").collect()] == [None, "pay", "pay", None, "pay"]


def test_joins(spark):
    spans = spark.createDataFrame([("d", 0, 10, 1), ("d", 5, 20, 2), ("e", 0, 5, 1)], "k string, s int, e int, n int")
    pts = spark.createDataFrame([("d", 7), ("d", 10), ("d", 20), ("e", 4), ("f", 1)], "k string, p int")
    assert rows(relational.containing_interval(pts, spans, "k", "p", "s", "e", "n")) == {("d", 7, 1), ("d", 10, 2), ("d", 20, None), ("e", 4, 1), ("f", 1, None)}
    assert rows(relational.elementary_segments(spans, "k", "s", "e")) == {("d", 0, 5, 1), ("d", 5, 10, 2), ("d", 10, 20, 1), ("e", 0, 5, 1)}
    n = relational.nested(spark.createDataFrame([("d",), ("z",)], "k string"), spans, "k", "kids", "n", ["s"])
    assert {r.k: [tuple(x) for x in r.kids] for r in n.collect()} == {"d": [(1, 0), (2, 5)], "z": []}


def test_graph(spark):
    e = spark.createDataFrame([("1", "2"), ("2", "3"), ("3", "1"), ("3", None), ("1", "2")], "source_id string, target_id string")
    s = spark.createDataFrame([("1",), (None,), ("9",)], "start_id string")
    assert rows(graph.reachable(s, e, 3)) == {("1", "1", 0), ("1", "2", 1), ("1", "3", 2), ("9", "9", 0)}
    up = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "gone")], "i string, p string")
    assert rows(graph.chain_up(up, "i", "p")) == {("b", "a", 1), ("c", "b", 1), ("c", "a", 2)}


def test_rule_tree(spark):
    n = spark.createDataFrame(
        [("t", "r", None, "AND", None), ("t", "o", "r", "OR", None), ("t", "l1", "r", None, True), ("t", "l2", "o", None, None), ("t", "l3", "o", None, True), ("u", "r", None, "AND", None), ("u", "x", "r", None, None)],
        "tree_id string, node_id string, parent_id string, op string, truth boolean")
    got = {(r.tree_id, r.node_id): r.truth for r in rules.evaluate(n).collect()}
    deep = [("d", f"n{i:03d}", f"n{i - 1:03d}" if i else None, "OR" if i < 60 else None, True if i == 60 else None, i % 2 == 1) for i in range(61)]
    rows_ = deep + [("y", "a", "b", "AND", None, False), ("y", "b", "a", "AND", None, False), ("z", "r", None, "AND", None, True), ("z", "s", "r", None, None, None)]
    far = {(r.tree_id, r.node_id): r.verdict for r in rules.evaluate(spark.createDataFrame(rows_, "tree_id string, node_id string, parent_id string, op string, truth boolean, negated boolean")).collect()}
    assert far[("d", "n060")] == "true" and far[("d", "n059")] == "false" and far[("d", "n000")] == "true" and far[("y", "a")] == far[("y", "b")] == "open" and far[("z", "r")] == "unknown"
    assert got[("t", "r")] is True and got[("t", "o")] is True and got[("u", "r")] is None
    c = lambda op, v, w: spark.range(1).select(rules.compare(F.lit(op), F.lit(v).cast("string"), F.lit(w)).alias("c")).first().c
    assert c("at_least", "10", "9") is True and c("in", "b", "a, b") is True and c("contains", "Alpha", "PH") is True and c("equals", None, "x") is None and c("exists", None, "x") is False


def test_sections(spark):
    text = "Preamble of the agreement.\n1. PAYMENT TERMS\nThe Vendor shall pay the fee within thirty days.\n(a) late fees apply to all of it\nPage 3 of 9\n2. CONFIDENTIALITY\nNo party shall disclose the terms to anybody else. 3. TERM. This runs for two years from now on."
    df = spark.createDataFrame([("d", text), ("n", None), ("e", "")], "id string, t string")
    got = segment.sections(df, "id", "t").orderBy("seq").collect()
    assert [(r.clause_no, r.scheme) for r in got] == [("1. PAYMENT TERMS", "numeric"), ("2. CONFIDENTIALITY", "numeric"), ("3. TERM", "numeric")]
    assert "late fees" in got[0].clause_text and "Page" not in got[0].clause_text
    assert all(text[r.char_start :].startswith(r.clause_text[:20]) for r in got)
    fixed = segment.sections(spark.createDataFrame([("x", "PAYMENTS4. Due in thirty days after the invoice date.\n5. LAW\nThe law of the state governs this.")], "id string, t string"), "id", "t", "numeric")
    assert [r.clause_no for r in fixed.orderBy("seq").collect()] == ["4. PAYMENTS", "5. LAW"]
