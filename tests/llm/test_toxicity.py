import random

from clauselake.llm.toxicity import CATEGORIES, fit_models, plain_word, score, train, with_scores

BAD = {"abusive": ["you are a filthy {n} and a liar", "shut up you stupid {n} or else"], "hateful": ["all {n} people are vermin here", "those {n} folk should vanish"], "sexual": ["he sent nude photos of the {n}", "they had sex near the {n}"]}
NOUN = ["door", "clerk", "bus", "lamp", "desk", "tower", "river"]


def doc(rnd, *kinds):
    plain = [f"The {rnd.choice(NOUN)} moved the {rnd.choice(NOUN)} to the {rnd.choice(NOUN)} on day {rnd.randrange(30)}" for _ in range(rnd.randrange(3, 9))]
    plain += [rnd.choice(["Vermin control visits the river twice", "Nude colour samples hang near the lamp", "Hateful remarks are prohibited at the desk"])]
    plain += [rnd.choice(BAD[k]).format(n=rnd.choice(NOUN)) for k in kinds]
    rnd.shuffle(plain)
    return ". ".join(plain) + "."


def corpus(n, seed):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        k = rnd.choice([(), (), (), ("abusive",), ("hateful",), ("sexual",)])
        out.append((doc(rnd, *k), list(k)))
    return out


def test_disguises_are_undone():
    assert plain_word("p.i.g,") == ["pig"] and plain_word("v3rm1n") == ["vermin"] and plain_word("$ubhum@n") == ["subhuman"] and plain_word("tiiiiiits") == ["tits"]
    assert plain_word("m***n,")[0] == "qmask" and plain_word("$1,950") == ["1", "950"] and plain_word("2nd") == ["2nd"]


def test_held_out_accuracy_with_wrong_labels():
    rnd = random.Random(3)
    data = corpus(500, 1)
    labels = [[rnd.choice(["none", "abusive"])] if rnd.random() < 0.05 else (k or ["none"]) for _, k in data]
    models = train([t for t, _ in data], labels)
    test = corpus(300, 2)
    p = score([t for t, _ in test], models) >= 0.5
    for i, c in enumerate(CATEGORIES):
        truth = [c in k for _, k in test]
        hits = sum(a and b for a, b in zip(truth, p[:, i]))
        assert hits / max(1, sum(truth)) > 0.9 and hits / max(1, p[:, i].sum()) > 0.9, c
    assert (score(["A quiet day at the desk.\rYou are a filthy door and a liar."], models)[:, 0] >= 0.5).all()
    assert (score(["Shut up you s t u p i d lamp or else", "YOU ARE A F.I.L.T.H.Y DESK AND A LIAR!!!"], models)[:, 0] >= 0.5).all()


def test_frames_and_edge_cases(spark):
    data = corpus(200, 4)
    docs = spark.createDataFrame([(i, t, 1) for i, (t, _) in enumerate(data)] + [(900, None, 1), (901, "", 1), (902, "word " * 50_000, 1)], "doc_id long, text string, id int")
    rated = [(i, v, f"r{j}") for i, (_, k) in enumerate(data) for j, v in enumerate((k or ["none"]) * (1 + i % 2))]
    labels = spark.createDataFrame([*rated, (900, "abusive", "r"), (None, "sexual", "r"), (3, None, "r"), (5000, "odd", None)], "doc_id long, verdict string, rater string")
    m = fit_models(docs, "doc_id", "text", labels, "doc_id", "verdict")
    got = {r.doc_id: r for r in with_scores(docs, "text", ["doc_id"], m).collect()}
    assert len(got) == 203 and all(got[i].abusive == got[i].hateful == got[i].sexual == 0 for i in (900, 901))
    right = sum((got[i][c] >= 0.5) == (c in k) for i, (_, k) in enumerate(data) for c in CATEGORIES)
    assert right / 600 > 0.95
    none = fit_models(docs, "doc_id", "text", labels.limit(0), "doc_id", "verdict")
    assert with_scores(docs.limit(5), "text", ["doc_id"], none).where("abusive + hateful + sexual > 0").count() == 0
    assert with_scores(docs.limit(0), "text", ["doc_id"], m).count() == 0
