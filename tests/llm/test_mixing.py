import pytest
from pyspark.sql import Row

from clauselake.llm.mixing import Mixer, plan_mix
from clauselake.llm.tokens import encoder

TARGET = "mix_name string, budget_ratio double, source string, target_share double, max_repeats int"


def target(source, share, repeats, ratio=1.0):
    return Row(source=source, target_share=share, max_repeats=repeats, budget_ratio=ratio)


def test_plan_meets_quotas_without_repeating_first():
    flows, res = plan_mix({("a",): 600, ("b",): 300, ("a", "b"): 100}, [target("a", 0.5, 3), target("b", 0.5, 3)], 1000)
    got = {s: sum(n for _, x, n in flows if x == s) for s in "ab"}
    assert got == {"a": 500.0, "b": 500.0}
    once = sum(min(n, {("a",): 600, ("b",): 300, ("a", "b"): 100}[p]) for p, _, n in flows)
    assert once == pytest.approx(900.0)  # b's 300, the shared 100, a's 500; only 100 tokens are repeats
    assert all(short == 0 for _, _, short, _ in res)


def test_shortage():
    _, res = plan_mix({("a",): 100}, [target("a", 0.5, 2), target("gone", 0.1, 4)], 1000)
    assert {(s, q, short) for s, q, short, _ in res} == {("a", 500.0, 300.0), ("gone", 100.0, 100.0)}


def mixer(spark, docs, targets, schema="doc_id long, text string, source string", **kw):
    return Mixer(spark.createDataFrame(docs, schema), "doc_id", "text", "source", spark.createDataFrame(targets, TARGET), **kw)


def test_selection_follows_targets_and_caps(spark):
    docs = [(i, "alpha beta gamma delta " * (1 + i % 5), "big") for i in range(300)] + [(1000 + i, "one two three four " * 3, "small") for i in range(20)] + [(2000, None, "big"), (2001, "", "small"), (2002, "x y", None)]
    m = mixer(spark, docs, [("m", 0.5, "big", 0.7, 1), ("m", 0.5, "small", 0.2, 4), ("m", 0.5, "none", 0.1, 2), ("n", 5.0, "small", 1.0, 3)])
    short = {(r.mix_name, r.source) for r in m.shortages().collect()}
    assert short == {("m", "none"), ("n", "small")} | ({("m", "small")} if 4 * m.patterns[("small",)] < 0.1 * m.total else set())
    sel = m.selection().collect()
    assert max(r.repeats for r in sel if r.mix_name == "m" and r.source == "big") == 1
    assert {r.repeats for r in sel if r.mix_name == "n"} == {3} and len([r for r in sel if r.mix_name == "n"]) == 20
    got = {r.source: r for r in m.shares().where("mix_name = 'm'").collect()}
    assert got["big"].actual_tokens == pytest.approx(got["big"].target_tokens, abs=30) and got["none"].actual_tokens == 0
    assert sum(r.actual_share for r in got.values()) == pytest.approx(1.0)
    again = mixer(spark, docs, [("m", 0.5, "big", 0.7, 1), ("m", 0.5, "small", 0.2, 4), ("m", 0.5, "none", 0.1, 2), ("n", 5.0, "small", 1.0, 3)])
    assert {tuple(r) for r in again.selection().collect()} == {tuple(r) for r in sel}


def test_overlapping_sources(spark):
    docs = [(i, "a b c d e f", ["x", "y"] if i % 2 else ["x"]) for i in range(200)]
    m = mixer(spark, docs, [("m", 1.0, "x", 0.5, 2), ("m", 1.0, "y", 0.5, 2)], "doc_id long, text string, source array<string>")
    sel = m.selection().collect()
    assert m.shortages().count() == 0 and {r.source for r in sel} == {"x", "y"}
    for r in sel:
        assert r.source == "x" or r.id % 2 == 1
    assert sum(r.repeats * r.n_tokens for r in sel if r.source == "y") == pytest.approx(0.5 * m.total, abs=12)


def test_empty_tables_and_tokens(spark):
    assert mixer(spark, [], [("m", 1.0, "a", 0.5, 2)]).selection().count() == 0
    assert mixer(spark, [(1, "a b", "s")], []).selection().count() == 0
    m = mixer(spark, [(1, "hello world, it's fine", "s")], [("m", 1.0, "s", 1.0, 1)])
    assert m.total == len(encoder().encode_ordinary("hello world, it's fine"))
