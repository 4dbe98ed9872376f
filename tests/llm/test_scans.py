import itertools
import random

from clauselake.llm.layout import is_scanned, kind_of, layout
from clauselake.llm.lexicon import candidates, reading_cost, trie, within
from clauselake.llm.scans import core, repair_scans, texts_of, word_table


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, last = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(last[j] + 1, d[-1] + 1, last[j - 1] + (x != y)))
    return d[-1]


def test_automaton_finds_all_words_within_the_distance():
    rnd = random.Random(1)
    vocab = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 7))) for _ in range(400)})
    root = trie(vocab)
    for w in ["".join(rnd.choice("abcde") for _ in range(rnd.randrange(0, 8))) for _ in range(80)]:
        for k in (0, 1, 2):
            assert sorted(within(root, w, k)) == [v for v in vocab if distance(w, v) <= k]


def test_readings():
    root = trie(["amend", "tend", "mend", "first", "confirm", "shall", "inspection"])
    for read, meant in (("arnend", "amend"), ("5hall", "shall"), ("ﬁrst", "first"), ("c0nf!rm", "confirm"), ("mspection", "inspection")):
        assert candidates(root, read)[0][0] == meant
    assert reading_cost("arnend", "amend") == 0.25 and reading_cost("x", "y") == 1.0


def test_words_of_chunks():
    assert [core(c) for c in ('"Joint', "27.7(c)", "B6-937.", "2nd", "$1,950", "13b,", "w@ives", "5hall", "re-use.", "I", "company's", "annua|,")] == [
        "joint", "", "", "", "", "", "w@ives", "5hall", "re-use", "", "company", "annua|"]


CLEAN = ("The Carrier shall first amend the annual privilege and deliver the long-term permit to the licensor within thirty days of the inspection. "
         "Nothing in this paragraph shall limit the remedies which the licensor may pursue against the carrier under the permit. ") * 3
SCAN = """LEASE - NOTICES 12
The Carrier 5hall first arnend the annual priv-
ilege and deliver the long-
Acme Freight Ltd.
- 1 -
\f
term permit to the licen­
sor within thirty days of the inspection.

Nothing in this paragraph shall limit the
remedies which the licensor may pursue
Acme Freight Ltd.
- 2 -
\f
against the carrier under the permit."""


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id string, file_text string")
    return {r.row_key: ([(i.line_no, i.issue) for i in r.issues], r.text) for r in repair_scans(texts_of(df, "t", "id", "file_text"), **kw).collect()}


WANT = [(2, "hyphen"), (2, "misread"), (4, "header"), (5, "page_number"), (7, "hyphen"), (12, "header"), (13, "page_number")]


def test_repair(spark):
    got = run(spark, [("c", CLEAN), ("s", SCAN), ("n", None), ("e", ""), ("S ", SCAN)])
    assert set(got) == {"c", "S "} and got["c"] == ([], CLEAN)
    issues, text = got["S "]
    assert issues == WANT
    assert text == ("LEASE - NOTICES 12\n\nThe Carrier shall first amend the annual privilege and deliver the long-term permit to the licensor within thirty days of the inspection.\n\n"
                    "Nothing in this paragraph shall limit the remedies which the licensor may pursue against the carrier under the permit.")


def test_same_result_without_the_broadcast(spark):
    rows = [("c", CLEAN), ("s", SCAN)]
    assert run(spark, rows, max_words=0) == run(spark, rows)


def test_commoner_meaning_without_the_broadcast(spark):
    clean = ("The beard ordered it and the board agreed. " * 2 + "The board met again. ") * 3
    rows = [("c", clean), ("s", "NOTICE\nThe bcard met again and\nagreed with it.")]
    for kw in ({}, {"max_words": 0}):
        assert "The board met again" in run(spark, rows, **kw)["s"][1], kw


def test_a_confusion_of_two_letters_is_one_edit(spark):
    root = trie(["commitment", "summary", "am"])
    assert [candidates(root, w)[0] for w in ("cornrnitrnent", "surnrnary", "arn")] == [("commitment", 0.75), ("summary", 0.5), ("am", 0.25)]
    rows = [("c", "the summary of it " * 3), ("s", "NOTICE\nthe surnrnary of it\nthe summaxy of it")]
    rows.append(("o", "NOTICE\nthe surnrnary of it\nno summaxy stands"))  # x for r is not listed: it needs the neighbours' support
    got = run(spark, rows)
    assert got["s"] == ([(2, "misread"), (3, "misread")], "NOTICE\n\nthe summary of it the summary of it")
    assert got["o"] == ([(2, "misread")], "NOTICE\n\nthe summary of it no summaxy stands")


def test_all_meanings_of_the_lowest_cost_are_kept(spark):
    vocab = ["cbcdef", "cbcdof", "cbedcf", "cbodcf", "ebcdcf", "obcdcf"]
    assert [v for v, _ in candidates(trie(vocab), "cbcdcf")] == vocab
    rows = [("c", " ".join(vocab * 3)), ("s", "NOTICE\nobcdcf and cbcdcf and\nobcdcf again")]
    assert run(spark, rows)["s"][1] == "NOTICE\n\nobcdcf and obcdcf and obcdcf again"


def test_edge_cases(spark):
    assert run(spark, []) == {}
    assert run(spark, [("s", SCAN)])["s"][0] and all(i != "misread" for _, i in run(spark, [("s", SCAN)])["s"][0])  # nothing clean to compare with
    assert not is_scanned("x" * 200) and not is_scanned("a\nb") and is_scanned("a\nb\nc")
    for t in ("", "\n\n", "\f", "1\n2\n3", "-\n-\n-", "A" * 40 + "\n" + "b" * 40 + "\nc"):
        lay = layout(t)
        assert len(lay.lines) == len(lay.kinds)
    long = "\n".join(itertools.repeat("the carrier shall deliver the permit to", 5000))
    assert run(spark, [("c", CLEAN), ("l", long)])["l"][0] == []


def test_a_long_line_does_not_stop_the_repair(spark):
    """One line of 200 characters amid wrapped ones: the text is repaired and adds nothing to the clean words."""
    wide = "Schedule A " + "of the permit " * 14
    assert kind_of(SCAN + "\n" + wide) == "scanned" and kind_of(CLEAN) == "clean" and kind_of("short\nlines") == "unsure" and kind_of(CLEAN + "\n" + SCAN) == "unsure"
    issues, text = run(spark, [("c", CLEAN), ("s", SCAN + "\n" + wide)])["s"]
    assert issues == WANT and "shall first amend the annual privilege" in text
    assert "5hall" not in {r.word for r in word_table(texts_of(spark.createDataFrame([("c", CLEAN), ("s", SCAN + "\n" + wide)], "id string, file_text string"), "t", "id", "file_text")).where("n_clean > 0").collect()}


PLAIN_CLEAN = ("The tenant keeps the warehouse clean. The tenant signs the agreement today. The insurance covers the warehouse and the minimum of goods. "
               "Ms Warrham signs the agreement for the tenant and the insurance covers the minimum. ") * 4


def test_plain_edits_need_support_of_their_neighbours(spark):
    scan = "NOTES 1\nThe tenant keeps the warahouse clean. The tenant\nsigns the agreemant today. The insuranxe covers\nthe rninirnum of goods. Ms Warrhem signs the\nagreement. A blue warahouse stands."
    alone = "NOTES 2\nSome blue warahouse stands\nbehind nine green agreemants\nof old."
    for most in (1_000_000, 0):
        got = run(spark, [("c", PLAIN_CLEAN), ("s", scan), ("a", alone)], max_words=most)
        assert got["s"][1] == ("NOTES 1\n\nThe tenant keeps the warehouse clean. The tenant signs the agreement today. The insurance covers the minimum of goods. "
                               "Ms Warrhem signs the agreement. A blue warehouse stands.")
        assert got["a"] == ([], "NOTES 2\n\nSome blue warahouse stands behind nine green agreemants of old.")


def test_neighbours_decide_between_meanings_of_one_cost(spark):
    """'lcg' is 'leg' or 'log' by one listed confusion each."""
    clean = "He broke his leg in the yard and cut the log with a saw for the fire. They wrote the log with a pen and broke his leg again at the yard in the evening hours. " * 3
    assert kind_of(clean) == "clean"
    scan = "NOTES 1\nThe man broke his lcg\nin the end\nof all."
    other = "NOTES 2\nThe man cut the lcg\nwith a saw\nof all."
    for most in (1_000_000, 0):
        got = run(spark, [("c", clean), ("s", scan), ("o", other)], max_words=most)
        assert "his leg in" in got["s"][1] and "the log with" in got["o"][1]


def test_precision_and_recall_of_listed_and_plain_edits(spark):
    """Held-out count: words of a made-up language, half of the scans misread by listed confusions, half by one other edit inside the word; names stay."""
    rnd = random.Random(21)
    vocab = ["".join(rnd.choice("bdfghklmnprstvz") + rnd.choice("aeiou") for _ in range(rnd.randrange(3, 6))) for _ in range(300)]
    sentences = [[rnd.choice(vocab) for _ in range(8)] for _ in range(60)]
    clean = [(f"c{i}", " ".join(" ".join(s) + "." for s in sentences * 3)) for i in range(2)]
    rows, truth = list(clean), {}
    swaps = {"m": "rn", "o": "0", "s": "5", "d": "cl", "h": "li", "e": "c"}
    for n, s in enumerate(sentences):
        lines, w = [f"NOTES {n}"], list(s)
        k = rnd.randrange(1, 7)
        old, new = w[k], w[k]
        if n % 2:
            if any(c in swaps for c in old):
                c = rnd.choice([c for c in old if c in swaps])
                new = old.replace(c, swaps[c], 1)
        elif len(old) >= 6:
            i = rnd.randrange(1, len(old) - 1)
            new = old[:i] + rnd.choice("qxwj") + old[i + 1 :]
        w[k] = new
        name = f"Zq{n}".replace("0", "k").replace("1", "w") + "varn"
        rows.append((f"s{n}", "\n".join(lines + [" ".join(w[:4]), " ".join(w[4:]), f"and {name.translate(str.maketrans('23456789', 'abdefghi'))} again"])))
        if new != old:
            truth[f"s{n}"] = (n % 2, 2 if k < 4 else 3)
    got = run(spark, rows)
    for kind in (0, 1):
        want = {(k, line) for k, (x, line) in truth.items() if x == kind}
        have = {(k, n) for k, v in got.items() if k.startswith("s") and int(k[1:]) % 2 == kind for n, issue in v[0] if issue == "misread"}
        assert len(want) > 15 and len(want & have) >= 0.9 * len(want) and len(have - want) <= 0.05 * len(want), (kind, len(want), len(want & have), have - want)
