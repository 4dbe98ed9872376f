from pyspark.sql import functions as F

from clauselake.functions import library as L
from clauselake.functions import providers


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first().c


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", "Alpha one", "draft"), (2, "b", None, "x"), (3, None, "beta", "regulation"), (4, "a", "one", None)], "i int, k string, t string, s string")
    ids = lambda c: sorted(r.i for r in df.where(c).collect())
    assert ids(L.composite()) == [1, 2, 3, 4] and ids(L.composite({"k": "a"})) == [1, 4] and ids(L.composite({"k": None}, {"s": []})) == [1, 2, 3, 4]
    assert ids(L.composite({"k": "a"}, {"s": ["draft"]}, (["t", "k"], "ONE"), ("t", "alpha OR beta"))) == [1]
    assert ids(L.composite({"k": "a"}, bypass=F.col("s") == "regulation")) == [1, 3, 4]
    assert ids(L.candidate(F.col("t"), ["one"], ["alpha"])) == [4] and ids(L.acceptable_file(F.concat("t", F.lit(".PDF")))) == [1, 3, 4]


def test_types_and_headings(spark):
    n = lambda x: one(spark, L.normalized_type(F.lit(x).cast("string"), ["Insurance", "Audit rights"], {"cover": "Insurance"}, "Other"))
    assert [n(x) for x in ("INSURANCE", "Cover.", "vendor audit rights and more", "audit", None, "")] == ["Insurance", "Insurance", "Audit rights", "Other", "Other", "Other"]
    h = lambda x: tuple(one(spark, L.heading(F.lit(x))))
    assert h("4.2 Payment. The fee is due.") == ("4.2", "Payment", "The fee is due.") and h("Section 3. Audit rights\nThe books") == ("Section 3", "Audit rights", "The books")
    assert h("NOTICES\nBy mail.") == (None, "NOTICES", "By mail.")
    assert one(spark, L.typed_heading(F.lit("x" * 81 + " audit"), [("audit", "A")])) is None
    assert one(spark, L.typed_content(F.lit("pay the pay"), [("two", "pay", 2), ("one", "pay", 1)])) == "two"
    assert one(spark, L.single_hit(F.lit("a b"), [("x", "a"), ("y", "b")], 10)) is None and one(spark, L.single_hit(F.lit("a c"), [("x", "a"), ("y", "b")], 10)) == "x"
    assert one(spark, L.subclauses(F.lit("Intro words that are long enough here (a) the first item of the list is long (b) the second item of the list is long"))) == [
        "Intro words that are long enough here", "(a) the first item of the list is long", "(b) the second item of the list is long"]
    assert one(spark, L.display_number(F.lit(" 4.2(a)"), F.lit("cl_01"))) == "4.2" and one(spark, L.display_number(F.lit(None).cast("string"), F.lit("cl_007"))) == "7"


def test_parties_dates_law(spark):
    t = F.lit('This is between Acme Freight, Inc. (the "Vendor") and Beta Data LLC (hereinafter the "Client"), dated March 5th, 2024, governed by the laws of the State of Ohio.')
    assert [tuple(x) for x in one(spark, L.defined_terms(t))] == [("Vendor", "Acme Freight, Inc."), ("Client", "Beta Data LLC")]
    assert one(spark, L.legal_names(t)) == ["Acme Freight, Inc.", "Beta Data LLC"]
    assert one(spark, L.governing_law(t, ["Ohio", "Maine"])) == "Ohio" and one(spark, L.governing_law(t, ["Maine"])) is None
    assert str(one(spark, L.labelled_date(t, ["signed", "dated"]))) == "2024-03-05"
    assert one(spark, L.without_alias(F.lit('Acme Ltd., a Delaware company (the "Vendor")'))) == "Acme Ltd."
    assert one(spark, L.cleaned(F.lit("a  re-\r\ncord\n 3 \nPage 1 of 2\n\n\n\nends [page 2 of 9] here"))) == "a record\n\nends here"


def test_values(spark):
    assert one(spark, L.unite(F.array(F.lit("Acme"), F.lit(" ")), F.array(F.lit("ACME"), F.lit("Beta")))) == ["Acme", "Beta"]
    assert [one(spark, L.as_values(F.lit(x).cast("string"))) for x in ('["a", "b c"]', "a; b ,c", "[broken", None, "")] == [["a", "b c"], ["a", "b", "c"], [], [], []]
    assert one(spark, L.joined_summary(F.lit("pay"), F.lit(" "))) == "pay" and one(spark, L.joined_summary(F.lit(None).cast("string"), F.lit(""))) is None
    f = one(spark, L.flags([("a", F.lit(True)), ("b", F.lit(None).cast("boolean")), ("c", F.lit(True))]))
    assert (f.flags, f.needs_review, f.reason) == (["a", "c"], True, "a; c")
    assert [one(spark, L.band(F.lit(x).cast("double"), [(8, "hi"), (3, "mid")], "lo")) for x in (9, 3, 1, None)] == ["hi", "mid", "lo", None]
    assert one(spark, L.badge(F.array(F.lit("x")), F.lit(False), {"x": "X!"}, "many")) == "X!" and one(spark, L.badge(F.array(F.lit("x"), F.lit("y")), F.lit(False), {}, "many")) == "many"
    assert one(spark, L.slug(F.lit("Data & Privacy "))) == "data-privacy" and one(spark, L.label_of(F.lit("v.cloud_hosting"))) == "Cloud Hosting"


def test_providers(spark):
    def busy(p):
        raise providers.Busy("later")

    def bad(p):
        if p == "x":
            raise ValueError("no")
        return p.upper()

    df = spark.createDataFrame([("a",), ("x",), (None,)], "p string")
    got = [tuple(r.a) for r in df.select(providers.answered(F.col("p"), [busy, bad]).alias("a")).collect()]
    assert got == [("A", 1, None), (None, 1, "ValueError: no"), (None, None, None)]
    assert tuple(df.limit(1).select(providers.answered(F.col("p"), [busy]).alias("a")).first().a) == (None, None, "later")
