import random

import numpy as np

from codeloom.llm import shared_spans as Z

SCHEMA = "doc_id bigint, text string, h bigint, key binary, at int"


def brute(docs, span):
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - span + 1):
            where.setdefault(t[i : i + span], set()).add(d)
    cover = {}
    for d, t in docs:
        for i in range(len(t or "") - span + 1):
            if len(where[t[i : i + span]]) > 1:
                cover.setdefault(d, set()).update(range(i, i + span))
    return {d: len(c) for d, c in cover.items()}


def corpus(seed, span):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abcdeğ😀 \n") for _ in range(n))
    hot = word(span + 7)
    pool = [word(n) for n in (span - 1, span, span + 1, span + 30, 3 * span)]
    docs = []
    for d in range(60):
        t = word(rnd.choice([0, 10, span, 4 * span]))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            t += rnd.choice(pool) + word(rnd.randrange(30))
        if d % 3 == 0:
            t = word(5) + hot + t
        docs.append((d, t))
    periodic = "ab" * (span // 2)
    docs += [(70, "x" + periodic * 3 + pool[1][:20]), (71, periodic + "y"), (72, "-" * (4 * span)), (73, "q" + "-" * span), (74, "-" * (span - 1)), (75, ""), (76, None)]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 1, None, 2) for d, t in docs], SCHEMA)


def test_equals_brute_force(spark):
    for seed, span, size in ((1, 40, 20), (2, 30, 10), (3, 400, 200)):
        docs = corpus(seed, span)
        want = brute(docs, span)
        assert {r.doc_id for r in Z.SharedSpans(frame(spark, docs), span, size).documents().collect()} == set(want)
        s = Z.SharedSpans(frame(spark, docs), span, size, segment=1 << 20 if seed != 2 else 64)  # texts beyond a segment are cut
        rep = {r.doc_id: r for r in s.report().collect()}
        assert {d: r.shared_chars for d, r in rep.items()} == {d: want.get(d, 0) for d, _ in docs}
        assert rep[72].cluster_id == rep[73].cluster_id and (rep[76].n_chars, rep[76].n_spans, rep[76].cluster_id) == (0, 0, None)
        assert sum(r.char_end - r.char_start for r in s.spans().collect()) == sum(want.values())


def test_removals_leave_every_shared_window_once(spark):
    span = 40
    docs = corpus(4, span)
    out = {}
    for r in Z.SharedSpans(frame(spark, docs), span, 20).removals().collect():
        out.setdefault(r.doc_id, set()).update(range(r.char_start, r.char_end))
    where = {}
    for d, t in docs:
        for i in range(len(t or "") - span + 1):
            where.setdefault(t[i : i + span], {}).setdefault(d, []).append(i)
    for w, by in where.items():
        for d, places in by.items():
            for i in places:
                gone = out.get(d, set()) >= set(range(i, i + span))
                assert gone or len(by) == 1 or d == min(by)
    assert not out.get(min(out), set()) or min(out) > 0


def test_no_documents_and_repeated_rows(spark):
    assert Z.found(frame(spark, []), 40 + 200).count() == 0
    t = "abcdefgh" * 80
    # one document twice under the same id shares nothing with itself
    assert Z.found(frame(spark, [(1, t), (1, t), (None, t)])).count() == 0
    assert {r.doc_id for r in Z.found(frame(spark, [(1, t), (2, "x" + t[5:])])).collect()} == {1, 2}


def test_paragraphs_depend_on_characters_alone():
    rnd = random.Random(3)
    copy = "".join(rnd.choice("abcdefg hij") for _ in range(900))
    a = Z.Texts(["zz" + copy, "other " * 30], 400, 200, 2)
    b = Z.Texts(["q" * 500, copy + "end"], 400, 200, 2)
    assert a.hashes(np.array([2]), 40) == b.hashes(np.array([500]), 40)
    (pa, fa, la), (pb, fb, lb) = a.picks(), b.picks()
    # windows that lie within the copy pick the same paragraphs
    inner = lambda p, f, z, at: {(int(q) - at, k) for q, x, y in zip(p, f, z) for k in range(int(q) - int(y), int(q) - int(x) + 1) if at <= int(q) - k <= at + 500}
    assert inner(pa, fa, la, 2) == inner(pb, fb, lb, 500) and sum(len(range(int(x), int(y) + 1)) for x, y in zip(fa, la)) == 503
    shared = sorted({q - 2 for q in pa.tolist()} & {q - 500 for q in pb.tolist()})
    assert (a.band_keys(np.array(shared) + 2) == b.band_keys(np.array(shared) + 500)).all()


def test_bands_reach_the_recall_they_are_tuned_for():
    assert Z.tune(1.0) == 1 and Z.tune(0.95, 0.99, 2) == 2 and Z.tune(0.8, 0.99, 2) == 5
    rnd = random.Random(9)
    hit = 0
    for n in range(400):
        t = [rnd.choice("abcdefghijklmnop ") for _ in range(200)]
        u = list(t)
        u[rnd.choice([0, 199])] = "#"  # one or no shingle of some 47 differs
        x = Z.Texts(["".join(t), "".join(u)], 200, 199, 2)
        k = x.band_keys(np.array([0, 200]))
        hit += bool((k[0] == k[1]).any())
    assert hit / 400 >= Z.RECALL


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) as h")
    b = Z.bloom(keys, "h", 5000)
    k = np.array([r.h for r in keys.collect()], np.int64).view(np.uint64)
    assert b.has(k).all()
    assert b.has(k + np.uint64(12345)).mean() < 0.1
