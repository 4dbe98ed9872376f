import random
import re

import pytest

from clauselake.llm.splitting import split_oversized

WS = re.compile(r"[\s\x1c-\x1f]")


def finest(text, limit):
    paragraphs = re.split(r"\f|(?:^|\n)(?:[ \t\r]*(?:\n|$))+", text)
    if all(len(p.strip()) <= limit for p in paragraphs):
        return "paragraph"
    if all(len(s.strip()) <= limit for p in paragraphs for s in re.split(r"(?<=[.!?])\s+", p)):
        return "sentence"
    return "word" if all(len(w) <= limit for w in text.split()) else "char"


def run(spark, rows, limit, overlap=20):
    df = spark.createDataFrame(rows, "id string, text string")
    return {r.row_key: r for r in split_oversized(df, "id", "text", limit, overlap).collect()}


def check(text, r, limit, overlap):
    assert "".join(p.piece_text[p.overlap :] for p in r.pieces) == text
    for before, p in zip([None, *r.pieces], r.pieces):
        assert len(p.piece_text) <= limit and p.overlap <= overlap and text[p.start_at : p.start_at + len(p.piece_text)] == p.piece_text
        assert before is None or before.piece_text.endswith(p.piece_text[: p.overlap])


def test_random_texts(spark):
    rnd = random.Random(5)
    unit = lambda: rnd.choice(["x" * rnd.randrange(1, 12), "Ünï", "日本", "a.b", "no"]) + rnd.choice(["", "", ".", "!", "?"])
    sep = lambda: rnd.choice([" "] * 8 + ["  ", "\n", "\r\n", "\n\n", "\n \t\r\n", "\f", " ", "\t"])
    texts = {f"t{i}": "".join(unit() + sep() for _ in range(rnd.randrange(20, 200))) for i in range(150)}
    texts["wide"] = "y" * 500
    texts["blank"] = " " * 500
    got = run(spark, list(texts.items()), 100)
    assert set(got) == {k for k, t in texts.items() if len(t) > 100}
    for k, r in got.items():
        check(texts[k], r, 100, 20)
        assert r.finest_cut == finest(texts[k], 100), k


def test_cuts_at_the_strongest_boundary(spark):
    text = "First one. Second sentence here.\n\nAnother paragraph follows and is rather long indeed, so it goes on"
    r = run(spark, [("a", text)], 60, 0)["a"]
    assert [p.cut for p in r.pieces] == ["paragraph", "word", "end"] and r.pieces[0].piece_text == "First one. Second sentence here.\n"
    assert r.finest_cut == "word" or r.finest_cut == finest(text, 60)


def test_overlap_gives_way_before_a_unit_that_fits_is_cut(spark):
    words = lambda n: ("abcd " * 40)[: n - 1] + "e"
    texts = {"p": "\n\n".join([words(90), words(95), words(30)]), "s": " ".join([words(88) + ".", words(97) + ".", words(60) + "."]), "w": " ".join(["x" * 95, "y" * 99, "z"])}
    got = run(spark, list(texts.items()), 100, 20)
    for k, cut in (("p", "paragraph"), ("s", "sentence"), ("w", "word")):
        check(texts[k], got[k], 100, 20)
        assert got[k].finest_cut == cut and [p.cut for p in got[k].pieces] == [cut] * (len(got[k].pieces) - 1) + ["end"], k


def test_edge_cases(spark):
    assert run(spark, [], 10, 2) == {}
    rows = [("n", None), ("e", ""), ("s", "x" * 10), (None, "x" * 11), (" ", "x" * 11), ("k", "x" * 11), ("K ", "x" * 11)]
    got = run(spark, rows, 10, 2)
    assert set(got) == {"K "} and [len(p.piece_text) for p in got["K "].pieces] == [8, 5]
    with pytest.raises(ValueError):
        run(spark, rows, 10, 10)
    big = "word " * 60_000
    r = run(spark, [("b", big)], 12_000, 200)["b"]
    check(big, r, 12_000, 200)
    df = spark.createDataFrame([("a", "x" * 11, 1, "p")], "id string, text string, pieces int, row_key string")
    assert split_oversized(df, "id", "text", 10, 2).count() == 1


def test_units_of_just_the_limit_between_white_space(spark):
    """White space around a unit does not count, however long."""
    a, b = "x" * 100, ("y" * 49 + ". ") * 2
    rows = [("par", f"{a}\n \n{a}\r\n\r\n{' ' * 200}{a}"), ("sen", f"{'s' * 99}.{' ' * 150}{'t' * 99}! {b}"), ("wor", f"{'s' * 100}{' ' * 150}{'t' * 100} u"), ("chr", f"{'s' * 101} t"), ("bla", " " * 300)]
    assert {k: r.finest_cut for k, r in run(spark, rows, 100).items()} == {"par": "paragraph", "sen": "sentence", "wor": "word", "chr": "char", "bla": "paragraph"}
