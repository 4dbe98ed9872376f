import random

from clauselake.llm.neardup import near_duplicates
from clauselake.llm.words import words

VOCAB = [f"w{i}" for i in range(400)]


def sets(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, t, least):
    s = {i: sets(x, k) for i, x in rows if x and len(words(x)) >= least}
    out = set()
    ids = sorted(s)
    for a in range(len(ids)):
        for b in range(a + 1, len(ids)):
            x, y = s[ids[a]], s[ids[b]]
            if x and y and len(x & y) >= t * len(x | y):
                out.add((ids[a], ids[b]))
    return out


def edited(rnd, text, n):
    w = text.split()
    for _ in range(n):
        i = rnd.randrange(len(w))
        w[i : i + 1] = rnd.choice([[], [rnd.choice(VOCAB)], [w[i], rnd.choice(VOCAB)]])
    return " ".join(w)


def corpus(seed, n_base=40, copies=6):
    rnd = random.Random(seed)
    phrase = "in accordance with the terms of this agreement and subject to applicable law"
    rows = []
    for b in range(n_base):
        base = " ".join(rnd.choice(VOCAB) for _ in range(rnd.randrange(40, 90))) + " " + phrase
        rows += [(f"c{b:02d}_{i}", edited(rnd, base, i * 2)) for i in range(copies)]
    return rows


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, "clause_id string, clause_text string")
    return {tuple(r) for r in near_duplicates(df, "clause_id", "clause_text", **kw).pairs().collect()}


def agree(got, want):
    """Nothing that is no pair, and at most one pair in 300 missed (sketches are random at the very threshold)."""
    return not got - want and len(want - got) <= max(1, len(want) // 300)


def test_against_all_pairs(spark):
    rows = corpus(1)
    assert agree(found(spark, rows, k=3, threshold=0.5, min_words=40), brute(rows, 3, 0.5, 40))
    assert agree(found(spark, rows), brute(rows, 5, 0.8, 1))


def test_large_cluster_in_many_blocks(spark):
    rnd = random.Random(2)
    base = " ".join(rnd.choice(VOCAB) for _ in range(80))
    rows = [(f"h{i:03d}", edited(rnd, base, 2)) for i in range(120)] + corpus(3, 5, 3)
    want = brute(rows, 3, 0.5, 40)
    assert agree(found(spark, rows, k=3, threshold=0.5, min_words=40, block=16), want) and len(want) > 7000


def test_blocks_find_what_whole_lists_find(spark):
    rnd = random.Random(7)
    base = " ".join(rnd.choice(VOCAB) for _ in range(90))
    rows = [(f"h{i:03d}", edited(rnd, base, 7)) for i in range(160)]
    want = brute(rows, 3, 0.5, 40)
    hot = found(spark, rows, k=3, threshold=0.5, min_words=40, block=24)
    assert len(want) > 3000 and hot == found(spark, rows, k=3, threshold=0.5, min_words=40, block=10_000) and agree(hot, want)


def test_copies_groups_and_links(spark):
    base = "the quick brown fox jumps over the lazy dog and then it runs away from here"
    rows = [("b", base), ("a", base), ("a", base), ("c", base.upper() + "!"), ("z", "something else entirely with many other words in it today")]
    df = spark.createDataFrame(rows, "clause_id string, clause_text string")
    nd = near_duplicates(df, "clause_id", "clause_text", k=3, threshold=0.5)
    assert {tuple(r) for r in nd.pairs().collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    assert {r.id: (r.group_id, r.n_links) for r in nd.groups().collect()} == {"a": ("a", 1), "b": ("a", 1), "c": ("a", 1), "z": ("z", 0)}


def test_short_and_null_texts_have_groups_but_no_pairs(spark):
    long = " ".join(VOCAB[:50])
    rows = [("b", "Too short."), ("a", "Too short."), ("c", "too short"), ("m", None), ("n", None), ("x", long), ("y", long + " w"), (" ", "Too short.")]
    nd = near_duplicates(spark.createDataFrame(rows, "clause_id string, clause_text string"), "clause_id", "clause_text", k=3, threshold=0.5, min_words=40)
    assert {tuple(r) for r in nd.pairs().collect()} == {("x", "y")}
    assert {r.id: (r.group_id, r.n_links) for r in nd.groups().collect()} == {
        "a": ("a", 0), "b": ("a", 0), "c": ("c", 0), "m": ("m", 0), "n": ("n", 0), "x": ("x", 1), "y": ("x", 1)}


def test_edge_cases(spark):
    assert found(spark, []) == set()
    long = " ".join(f"x{i}" for i in range(20_000))
    rows = [("n", None), ("e", ""), ("s", "too short"), ("s2", "too short"), (None, "a b c d e f"), ("l1", long), ("l2", long + " end"), ("one", "a b c"), ("two", "a b c.")]
    assert found(spark, rows, k=3, threshold=0.5) == {("l1", "l2"), ("one", "two")}
    df = spark.createDataFrame([("p", "a b c d e", 1, "q"), ("q", "a b c d e f", 2, "r")], "clause_id string, clause_text string, d int, id string")
    assert {tuple(r) for r in near_duplicates(df, "clause_id", "clause_text", k=3, threshold=0.5).pairs().collect()} == {("p", "q")}


def test_recall_near_the_threshold_in_a_cluster_of_hot_lists(spark):
    """Many edited wordings of one text, about all pairs at J from 0.5 to 0.65, lists cut in blocks."""
    rnd = random.Random(11)
    base = " ".join(rnd.choice(VOCAB) for _ in range(100))
    rows = [(f"h{i:03d}", edited(rnd, base, 6)) for i in range(300)]
    want = brute(rows, 3, 0.5, 40)
    got = found(spark, rows, k=3, threshold=0.5, min_words=40, block=64)
    assert len(want) > 10_000 and not got - want and len(want & got) >= 0.99 * len(want)


def test_one_text_inside_another(spark):
    """Sizes one to two: the sketch of the longer text keeps half of the common values."""
    rnd = random.Random(12)
    rows = []
    for i in range(150):
        w = [f"u{i}x{rnd.randrange(10**6)}" for _ in range(110)]
        rows += [(f"a{i:03d}", " ".join(w)), (f"b{i:03d}", " ".join(w[:60]))]
    want = brute(rows, 3, 0.5, 40)
    got = found(spark, rows, k=3, threshold=0.5, min_words=40)
    assert len(want) == 150 and not got - want and len(got) >= 148
