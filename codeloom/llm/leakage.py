"""Evaluation passages inside training text.

The items' word n-grams are few: they are counted, and if the count is within the
bound they go to every task as sorted arrays. Documents are then scanned once, without a
shuffle. Beyond the bound the same n-grams meet in a join on their hashes instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 12
#: at most this many item words are broadcast (about 40 MB)
MAX_BROADCAST_WORDS = 2_000_000
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
HITS = "item_id bigint, char_start int, char_end int, n_words int"


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return [] if text is None else [w.lower() for w in _WORD.findall(text)]


def _roll(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of n ids."""
    h = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for j in range(n):
        h = (h + ids[j : j + len(h)].astype(np.uint64)) * _BASE
        h ^= h >> np.uint64(29)
    return h


class _Grams:
    """The items' n-grams: vocabulary, sorted hashes, and where each hash occurs."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n, self.vocab, seqs, owner, hashes, start = n, {}, [], [], [], []
        at = 0
        for item, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)], np.int64)
            h = _roll(ids, n)
            hashes.append(h)
            owner.append(np.full(len(h), item, np.int64))
            start.append(at + np.arange(len(h)))
            seqs.append(ids)
            at += len(ids)
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        self.ids = cat(seqs, np.int64)
        h, order = cat(hashes, np.uint64), None
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.start = h[order], cat(owner, np.int64)[order], cat(start, np.int64)[order]

    def hits(self, text: str | None) -> dict[int, list[int]]:
        """item -> first words of the windows of the text that stand in the item."""
        found = _WORD.findall(text) if text else ()
        if len(found) < self.n:
            return {}
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) or (get(w.lower(), 0)) for w in found), np.int64, len(found))
        if np.count_nonzero(ids) < self.n:
            return {}
        gap = np.flatnonzero(np.concatenate(([0], ids, [0])) == 0)
        out: dict[int, list[int]] = {}
        for a, b in zip(gap[:-1], gap[1:] - 1):  # runs of known words
            if b - a < self.n:
                continue
            run = ids[a:b]
            h = _roll(run, self.n)
            lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            for i in np.flatnonzero(hi > lo):
                for k in range(lo[i], hi[i]):
                    s = self.start[k]
                    if np.array_equal(self.ids[s : s + self.n], run[i : i + self.n]):  # the hash alone decides nothing
                        out.setdefault(int(self.item[k]), []).append(int(a + i))
        return out


def _merge(starts: list[int], spans: list[tuple[int, int]], n: int) -> list[tuple[int, int, int]]:
    """Overlapping windows as (char_start, char_end, words)."""
    out: list[list[int]] = []
    for s in sorted(set(starts)):
        if out and s <= out[-1][1]:
            out[-1][1] = s + n
        else:
            out.append([s, s + n])
    return [(spans[a][0], spans[b - 1][1], b - a) for a, b in out]


def leaks(documents: DataFrame, items: DataFrame, n: int = WORDS, max_broadcast: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """doc_id, item_id, char_start, char_end, n_words: the spans of documents that stand in an item's passage.

    A span is a maximal run of overlapping windows of ``n`` words; offsets are in characters, end exclusive.
    Null and empty texts and passages, and those under n words, have none; a null doc_id or item_id is left out. Rows repeated with one id are
    reported once.
    """
    its = items.select("item_id", "passage").where("item_id is not null and passage is not null").dropDuplicates()
    size = its.agg(F.coalesce(F.sum(F.size(F.split("passage", r"\s+")) + F.floor(F.char_length("passage") / 2)), F.lit(0))).first()[0]
    docs = documents.select("doc_id", "text").where("doc_id is not null")
    if size > 2 * max_broadcast:
        return _joined(docs, its, n).dropDuplicates()
    grams = documents.sparkSession.sparkContext.broadcast(_Grams([tuple(r) for r in its.collect()], n))  # within the bound just checked

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = grams.value
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                if hit := g.hits(text):
                    spans = [m.span() for m in _WORD.finditer(text)]
                    rows += [(doc, item, *s) for item, starts in hit.items() for s in _merge(starts, spans, n)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "char_start", "char_end", "n_words"])

    return docs.mapInPandas(scan, "doc_id bigint, " + HITS).dropDuplicates()


def _windows(df: DataFrame, key: str, text: str, n: int, wanted=None) -> DataFrame:
    """key, gram, words, at, char_start, char_end of the windows of n words; with ``wanted``, a broadcast Bloom filter of grams, of those that pass it."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text]):
                found = [(m.group().lower(), *m.span()) for m in _WORD.finditer(t or "")]
                grams = [" ".join(w for w, _, _ in found[i : i + n]) for i in range(len(found) - n + 1)]
                hashes = np.array([xxhash.xxh3_64_intdigest(g) for g in grams], np.uint64)
                keep = range(len(grams)) if wanted is None else np.flatnonzero(wanted.value.has(hashes)) if len(grams) else ()
                rows += [(k, int(hashes[i].astype(np.int64)), grams[i], int(i), found[i][1], found[i + n - 1][2]) for i in keep]
            yield pd.DataFrame(rows, columns=["k", "gram", "words", "at", "a", "b"])

    return df.select(key, text).mapInPandas(cut, "k bigint, gram bigint, words string, at int, a int, b int")


def _joined(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """The same spans by a join on n-grams, for item sets over the bound: a Bloom filter of bounded size keeps most windows out of the shuffle, hot grams are salted, and the words themselves decide."""
    from pyspark.sql import Window

    from codeloom.llm.shared_spans import bloom
    from codeloom.operators.skew import heavy_keys, salted_join

    grams = _windows(items, "item_id", "passage", n).select("gram", F.col("words").alias("item_words"), F.col("k").alias("item_id")).distinct()
    known = grams.select("gram").distinct()
    wanted = docs.sparkSession.sparkContext.broadcast(bloom(known, "gram", known.count()))
    wins = _windows(docs, "doc_id", "text", n, wanted).withColumnRenamed("k", "doc_id")
    hits = salted_join(wins, grams, "gram", heavy_keys(wins, "gram")).where("words = item_words").select("doc_id", "item_id", "at", "a", "b").distinct()
    w = Window.partitionBy("doc_id", "item_id").orderBy("at")
    hits = hits.withColumn("new", (F.col("at") > F.coalesce(F.lag("at").over(w), F.lit(-n - 1)) + n).cast("int")).withColumn("run", F.sum("new").over(w))
    g = hits.groupBy("doc_id", "item_id", "run").agg(F.min("a").alias("char_start"), F.max("b").alias("char_end"), (F.max("at") - F.min("at") + n).cast("int").alias("n_words"))
    return g.drop("run")


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items).select("doc_id", "item_id").distinct()


def cleaned(documents: DataFrame, items: DataFrame, drop_share: float = 0.5) -> DataFrame:
    """doc_id, action, n_items, leaked_chars, text_chars, clean_text for every leaking document.

    ``action`` is drop (null clean_text) if the leaked spans hold at least ``drop_share`` of the characters, else cut: the spans are taken out.
    """
    spans = leaks(documents, items)
    per = spans.groupBy("doc_id").agg(F.countDistinct("item_id").cast("int").alias("n_items"), F.array_sort(F.collect_set(F.struct("char_start", "char_end"))).alias("spans"))
    d = documents.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"]).join(per, "doc_id")
    # sorted spans may overlap: each adds what lies behind the furthest end so far
    fold = F.expr("""aggregate(spans, named_struct('at', 0, 'n', 0, 'kept', ''), (s, x) -> named_struct('at', greatest(s.at, x.char_end),
        'n', s.n + greatest(0, x.char_end - greatest(s.at, x.char_start)), 'kept', concat(s.kept, substring(text, s.at + 1, greatest(0, x.char_start - s.at)))))""")
    d = d.withColumn("f", fold).withColumn("text_chars", F.char_length("text"))
    drop = F.col("f.n") >= drop_share * F.col("text_chars")
    return d.select("doc_id", F.when(drop, "drop").otherwise("cut").alias("action"), "n_items", F.col("f.n").alias("leaked_chars"), "text_chars", F.when(~drop, F.expr("concat(f.kept, substring(text, f.at + 1))")).alias("clean_text"))
