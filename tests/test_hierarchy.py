import random
from datetime import datetime as D

from pyspark.sql import functions as F

from clauselake.operators.hierarchy import ancestor_pairs, cycle_pairs, hierarchy

T = [D(2025, 1, i + 1) for i in range(4)]


def run(spark, rows):
    """The result by levels alone, after checking that one task at the end (all levels, or the last of them) gives the same rows and paths."""
    df = spark.createDataFrame(rows, "id string, parent string, created_at timestamp")
    trees = [sorted(hierarchy(df, "id", "parent", finish=n).collect()) for n in (0, 30, 10_000)]
    assert trees[0] == trees[1] == trees[2]
    assert sorted(hierarchy(df, "id", "parent", paths=False).collect()) == [tuple(r)[:4] for r in trees[0]]
    return {x.node_id: (x.root_id, x.depth, x.node_state) for x in trees[0]}


def brute(parent):
    out = {}
    for x in parent:
        path, seen = [x], {x}
        while (p := parent[path[-1]]) in parent and p not in seen:
            path.append(p)
            seen.add(p)
        if p not in parent:
            out[x] = (path[-1], len(path) - 1, "tree")
        else:
            at = path.index(p)
            low = min(path[at:])
            out[x] = (low, 0, "cycle") if at == 0 else (low, at, "below_cycle")
    return out


def test_small_cases(spark):
    rows = [("a", None, T[0]), ("b", "A ", T[0]), ("c", "b", T[0]), ("d", "gone", T[0]), ("e", " \t", T[0]), ("s", "s", T[0]), ("x", "y", T[0]), ("y", "x", T[0]), ("z", "y", T[0]), ("w", "z", T[0])]
    assert run(spark, rows) == {
        "a": ("a", 0, "tree"), "b": ("a", 1, "tree"), "c": ("a", 2, "tree"), "d": ("d", 0, "tree"), "e": ("e", 0, "tree"), "s": ("s", 0, "cycle"),
        "x": ("x", 0, "cycle"), "y": ("x", 0, "cycle"), "z": ("x", 1, "below_cycle"), "w": ("x", 2, "below_cycle")}


def test_latest_row_gives_the_parent(spark):
    assert run(spark, [("a", None, T[0]), ("b", "a", T[1]), ("b", None, T[0]), ("c", "a", T[0]), ("c", None, T[1]), ("c", None, T[1]), (" ", "a", T[0]), (None, "a", T[0])]) == {
        "a": ("a", 0, "tree"), "b": ("a", 1, "tree"), "c": ("c", 0, "tree")}


def test_random_forest_with_cycles(spark):
    rnd = random.Random(4)
    parent = {f"n{i:03d}": (f"n{rnd.randrange(300):03d}" if rnd.random() < 0.9 else None) for i in range(300)}
    assert run(spark, [(k, p, T[0]) for k, p in parent.items()]) == brute(parent)


def test_only_cycles_and_empty(spark):
    assert run(spark, [("b", "c", T[0]), ("c", "a", T[0]), ("a", "b", T[0])]) == {k: ("a", 0, "cycle") for k in "abc"}
    assert run(spark, []) == {}


def test_long_chain_star_and_pairs(spark):
    rows = [("r", None, T[0])] + [(f"s{i}", "r", T[0]) for i in range(50)] + [(f"c{i:02d}", f"c{i - 1:02d}" if i else "r", T[0]) for i in range(12)]
    df = spark.createDataFrame(rows, "id string, parent string, created_at timestamp").withColumn("k", F.lit("clash")).withColumn("path", F.lit(1))
    tree = hierarchy(df, "id", "parent")
    deep = tree.where("node_id = 'c11'").first()
    assert deep.depth == 12 and deep.path == ["r"] + [f"c{i:02d}" for i in range(12)]
    pairs = ancestor_pairs(tree)
    assert pairs.where("ancestor_id = 'r'").count() == 62 and pairs.count() == 50 + sum(range(1, 13))
    assert {(x.descendant_id, x.distance) for x in pairs.where("ancestor_id = 'c09'").collect()} == {("c10", 1), ("c11", 2)}


def test_pairs_below_cycles(spark):
    rnd = random.Random(9)
    parent = {f"n{i:03d}": f"n{rnd.randrange(max(1, i - 30), i + 9):03d}" if i > 5 else None for i in range(200)}
    parent |= {"s": "s", "Sb": "s ", "c0": "c4"} | {f"c{i}": f"c{i - 1}" for i in range(1, 5)} | {"z": "c2", "y": "z", "x": "c0"}
    norm = lambda p: p.strip().lower() if p else p
    up = {norm(k): norm(p) for k, p in parent.items()}
    up = {k: p if p in up else None for k, p in up.items()}
    cycle = {k for k in up if (lambda seen: k in seen)(_above(up, k))}
    want = {(a, k, n) for k in up if k not in cycle and cycle & set(_above(up, k)) for a, n in _above(up, k).items()}
    df = spark.createDataFrame([(k, p, T[0]) for k, p in parent.items()], "id string, parent string, created_at timestamp")
    got = cycle_pairs(hierarchy(df, "id", "parent"), df, "id", "parent").collect()
    assert sorted((norm(r.ancestor_id), norm(r.descendant_id), r.distance) for r in got) == sorted(want) and len(want) > 50
    assert {("c2", "z", 1), ("c1", "z", 2), ("c3", "z", 5), ("c3", "y", 6), ("c1", "x", 5), ("s", "sb", 1)} <= want
    assert cycle_pairs(hierarchy(df.limit(0), "id", "parent"), df.limit(0), "id", "parent").count() == 0


def _above(up, k):
    """Every node above k at its least distance."""
    seen, n = {}, 1
    while (k := up[k]) and k not in seen:
        seen[k] = n
        n += 1
    return seen
