import base64
import random

import numpy as np
import pytest

from codeloom.llm import mixing as M

DOCS = "doc_id bigint, text string, source string, tokens bigint, repeats int, rate double"
TARGETS = "source string, target_share double, max_repeats int, tokens bigint"


def test_counter_equals_the_tokenizer():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(M.TOKENIZER, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=M._PATTERN, mergeable_ranks=ranks, special_tokens={})
    n = M.TokenCounter(M.TOKENIZER)
    rnd = random.Random(1)
    bits = ["word", "it's", " ", "  ", "\n", "\t", "12", "İğ", "!?", "_x", "\n ", " \n", "ß", "😀"]
    for _ in range(3000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randrange(14)))
        assert n(t) == len(enc.encode_ordinary(t)), repr(t)


def corpus(spark, n=900):
    rnd = random.Random(2)
    words = {"a": ["alpha", "beta", "gamma"], "b": ["delta", "eps", "zeta"], "c": ["eta", "theta", "iota"]}
    rows = []
    for i in range(n):
        s = rnd.choice("aaaabbc")
        label = None if i % 10 == 0 else rnd.choice([s, s.upper(), f" {s} "])
        rows.append((i, " ".join(rnd.choice(words[s]) for _ in range(rnd.randrange(5, 60))) + f" {i}", label, 1, 1, 0.5))
    rows += [(5000 + i, "the same text under many ids " * 3, "c", 1, 1, 0.5) for i in range(50)]
    rows += [(9000, None, "a", 1, 1, 0.5), (9001, "", "a", 1, 1, 0.5), (None, "x", "a", 1, 1, 0.5), (9002, "other", "no target", 1, 1, 0.5), (1, rows[1][1], rows[1][2], 1, 1, 0.5)]
    return spark.createDataFrame(rows, DOCS), {r[0]: r for r in rows}


def test_shares_are_reached_and_caps_kept(spark):
    docs, rows = corpus(spark)
    targets = spark.createDataFrame([("A", 0.2, 2, 0), ("b", 0.3, 1, 0), ("c", 0.4, 3, 0), ("empty", 0.1, 2, 0), (None, 0.1, 1, 0)], TARGETS)
    got = M.mix(docs, targets)[0].collect()
    caps = {"a": 2, "b": 1, "c": 3}
    assert all(1 <= r.repeats <= caps[r.source] for r in got)
    assert len({r.doc_id for r in got}) == len(got)
    assert len({rows[r.doc_id][1] for r in got}) == len(got)  # copies of a text are one text
    share = {r.source: r.reached_share for r in M.shares(docs, targets).collect()}
    assert share["empty"] == 0
    for s, want in (("a", 0.2), ("b", 0.3), ("c", 0.4)):
        assert share[s] == pytest.approx(want / 0.9, abs=0.03)


def test_posteriors_on_held_out_rows(spark):
    docs, _ = corpus(spark)
    train, held = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 and doc_id < 5000 and source is not null").collect()
    m = M.fit(train, ["a", "b", "c"])
    hit = [m.labels[m.posterior(r.text).argmax()] == r.source.strip().lower() for r in held]
    assert sum(hit) / len(hit) > 0.95


def test_empty_tables(spark):
    docs, _ = corpus(spark, 20)
    targets = spark.createDataFrame([("a", 1.0, 2, 0)], TARGETS)
    assert M.mix(docs.limit(0), targets)[0].count() == 0
    assert M.mix(docs, targets.limit(0))[0].count() == 0
    assert [tuple(r)[:2] for r in M.shares(docs.limit(0), targets).collect()] == [("a", 1.0)]


def test_words_are_worked_out_together(monkeypatch):
    plain = M.TokenCounter(M.TOKENIZER).encode
    rnd = random.Random(3)
    bits = ["word", "it's", "'s", " ", "  ", "\n", "\t", "12", "a.b", "_x", "\r\n", "\x1c", "　", "\xa0", "Σ", "İ", "²", " "]
    texts = ["", " ", "\n\n", *("".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 30))) for _ in range(1000))]
    model = M.Classifier(["a", "b"], np.random.default_rng(1).integers(0, 9, (2, M.FEATURES)), np.full(2, 9.0))
    words, calls = M.TokenCounter(M.TOKENIZER), []
    words.encode = lambda t: calls.append(t) or plain(t)
    p, tokens = model.posteriors(texts, [None] * len(texts), words)
    assert list(tokens) == [len(plain(t)) for t in texts]
    assert len(calls) < len(texts) / 2  # new words of many texts go to the tokenizer at once
    for t, row in zip(texts, p):
        has = list({M.zlib.crc32(w.encode()) % M.FEATURES for x in t.split() for w in M._WORDS.findall(x.lower())})
        s = model.prior + model.off + model.on[has].sum(axis=0)
        assert row == pytest.approx(np.exp(s - s.max()) / np.exp(s - s.max()).sum(), abs=1e-9)
    # a vocabulary that begins anew, and short stretches, change nothing
    monkeypatch.setattr(M, "_CACHE", 20)
    monkeypatch.setattr(M, "_CHARS", 100)
    again, counted = model.posteriors(texts, [None] * len(texts), M.TokenCounter(M.TOKENIZER))
    assert (counted == tokens).all() and np.allclose(again, p, atol=1e-12)


def test_a_scan_adds_up_all_texts_whatever_the_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    p, tokens = rng.dirichlet([1, 1, 1], 500).astype(np.float32), rng.integers(0, 90, 500)
    own = rng.integers(0, 3, 500)
    rows = [(i, "abc"[own[i]], int(tokens[i]), [float(x) for x in p[i]]) for i in range(500)]
    members = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint, p array<float>").repartition(4)
    t = M.pd.DataFrame({"source": list("abc"), "share": [0.2, 0.3, 0.5], "cap": [2.0, 1.0, 0.5]})
    level, top = np.array([0.5, 0.9, 1.4]), np.array([2.0, 1.0, 0.5])[own]
    raw = p @ level
    free = (raw > 0) & (raw < top)
    for block, blocks in ((M._BLOCK, M._BLOCKS), (20, 30), (1, 1)):
        monkeypatch.setattr(M, "_BLOCK", block)
        monkeypatch.setattr(M, "_BLOCKS", blocks)
        rates = M.Rates(members, t, M.Scratch(spark, "test"))
        totals, gram = rates.scan(level)
        assert totals == pytest.approx((tokens * np.clip(raw, 0, top)) @ p, rel=1e-5)
        assert gram == pytest.approx((p[free] * tokens[free, None]).T @ p[free], rel=1e-5)
        assert rates.scan(None)[0] == pytest.approx((tokens * top) @ p, rel=1e-5)
    # few texts are one task: a task costs more than the sums
    monkeypatch.undo()
    assert M.Rates(members, t, M.Scratch(spark, "test")).blocks.rdd.getNumPartitions() == 1
