import random

from clauselake.llm.leakage import leaks, longest_run
from clauselake.llm.words import hashed, words

VOCAB = [f"w{i}" for i in range(60)]


def brute(docs, items, least):
    out = {}
    for d, t in docs:
        a = words(t)
        for i, u in items:
            b = words(u)
            n = min(least, len(b))
            if n < 5:
                continue
            best = 0
            for x in range(len(b)):
                y = best + 1
                while x + y <= len(b) and any(a[z : z + y] == b[x : x + y] for z in range(len(a) - y + 1)):
                    best, y = y, y + 1
            if best >= n:
                out[(d, i)] = max(best, out.get((d, i), 0))
    return out


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return {(r.id, r.item_id): r.run_words for r in leaks(d, "doc_id", "text", i, "item_id", "text", **kw).collect()}


def test_against_brute_force(spark):
    rnd = random.Random(7)
    text = lambda n: " ".join(rnd.choice(VOCAB) for _ in range(n))
    items = [(i, text(rnd.randrange(8, 60))) for i in range(12)]
    docs = []
    for d in range(40):
        parts = [text(rnd.randrange(0, 80))]
        if d % 2:
            w = items[rnd.randrange(12)][1].split()
            n = rnd.randrange(10, 30)
            at = rnd.randrange(max(1, len(w) - n))
            parts += [", ".join(w[at : at + n]).upper(), text(rnd.randrange(0, 40))]
        docs.append((d, " ".join(parts)))
    assert run(spark, docs, items, min_run=20) == brute(docs, items, 20)
    assert run(spark, docs, items, min_run=12) == brute(docs, items, 12)


def test_exactly_at_the_bound(spark):
    item = " ".join(f"a{i}" for i in range(50))
    w = item.split()
    docs = [(1, "x " + " ".join(w[10:30]) + " y"), (2, "x " + " ".join(w[10:29]) + " y"), (3, " ".join(w[30:50])), (4, " ".join(w[:20]))]
    assert run(spark, docs, [(9, item)]) == {(1, 9): 20, (3, 9): 20, (4, 9): 20}


def test_edge_cases(spark):
    assert run(spark, [], [(1, "a b c d e f")]) == {} and run(spark, [(1, "a b c d e f")], []) == {}
    assert run(spark, [(1, None), (2, ""), (3, "one two three four five"), (3, "One, two; three four five!")], [(1, None), (2, ""), (3, "one two"), (4, "one two three four five")]) == {(3, 4): 5}
    d = spark.createDataFrame([(1, "one two three four five", 8, "q")], "doc_id long, text string, item_id int, h string")
    assert leaks(d, "doc_id", "text", spark.createDataFrame([(4, "one two three four five", 1)], "item_id long, text string, id int"), "item_id", "text").count() == 1


def test_repetitive_text():
    h = lambda s: hashed([s])[0]
    assert longest_run(h("a " * 50), h("a " * 30), 20) == 30
    assert longest_run(h("a b " * 5 + "c"), h("b a b a b c"), 4) == 6


def test_size_partitions_of_short_and_long_items(spark):
    """Items shorter than min_run are searched whole in a partition of their own length; a run of fewer than min_run words of a long item is no case."""
    w = [f"w{i}" for i in range(300)]
    long, six, nine = " ".join(w[:40]), " ".join(w[100:106]), " ".join(w[200:209])
    docs = [(1, "a b " + " ".join(w[10:30]) + " c"), (2, "x " + six + " y"), (3, nine), (4, " ".join(w[10:29])), (5, " ".join(w[100:105])), (6, long + " z " + six)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(7, long), (8, six), (9, nine)], "item_id long, text string")
    got = {(r.id, r.item_id): (r.run_words, round(r.passage_containment, 3)) for r in leaks(d, "doc_id", "text", i, "item_id", "text", min_run=20).collect()}
    assert got == {(1, 7): (20, round(1 / 21, 3)), (2, 8): (6, 1.0), (3, 9): (9, 1.0), (6, 7): (40, 1.0), (6, 8): (6, 1.0)}
