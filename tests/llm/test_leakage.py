import random

from codeloom.llm import leakage as X

DOCS = "doc_id bigint, text string, item_id bigint, passage string"
ITEMS = "item_id bigint, passage string, doc_id bigint"


def brute(docs, items, n=12):
    out = set()
    for d, t, *_ in docs:
        w = X.words(t)
        have = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, p, *_ in items:
            v = X.words(p)
            if d is not None and i is not None and any(tuple(v[k : k + n]) in have for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def data():
    rnd = random.Random(9)
    vocab = ["Ağ", "the", "İç", "run", "x_y", "a1", "straße", "of", "öz"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([5, 12, 30]))), 99) for i in range(25)] + [(50, None, 1), (51, "", 1), (None, "the of run " * 9, 1), (52, "a a a a a a a a a a a a a", 1)]
    docs = []
    for d in range(60):
        t = " ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 20, 200])))
        if d % 3 == 0:
            p = items[d % 25][1].upper().replace(" ", ",\n ")
            t = t[:40] + " | " + p + " | " + t[40:]
        docs.append((d, t, 7, "clash"))
    return [*docs, (100, None, 7, ""), (101, "", 7, ""), (None, items[3][1], 7, ""), (102, "a " * 5000, 7, "")], items


def test_equals_brute_force_either_way(spark):
    docs, items = data()
    d, i = spark.createDataFrame([*docs, docs[0]], DOCS), spark.createDataFrame([*items, items[1]], ITEMS)
    want = brute(docs, items)
    assert {tuple(r) for r in X.found(d, i).collect()} == want
    a = sorted(map(tuple, X.leaks(d, i).collect()))
    b = sorted(map(tuple, X.leaks(d, i, max_broadcast=0).collect()))
    assert a == b
    assert X.leaks(d.limit(0), i).count() == X.leaks(d, i.limit(0)).count() == 0


def test_cleaned_texts_hold_nothing_any_more(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, "Before. " + passage.title() + "! After that there is a lot of other text that stays where it is, as it should, whatever stood before it." * 2, 0, ""), (2, passage, 0, ""), (3, "nothing", 0, "")]
    got = {r.doc_id: r for r in X.cleaned(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(5, passage, 0)], ITEMS)).collect()}
    assert set(got) == {1, 2}
    assert got[1].action == "cut"
    assert got[1].clean_text.startswith("Before. ! After")
    assert (got[2].action, got[2].clean_text) == ("drop", None)
