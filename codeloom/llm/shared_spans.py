"""Long spans that stand character by character in more than one document.

1. ``paragraphs``. Every window of SPAN characters picks the least of its stretches of PARAGRAPH characters, by a hash of their
   characters. Picked stretches are the paragraphs: what a window picks depends on its characters alone, so copies of
   a span have the same paragraphs wherever they stand and whatever surrounds them, and every span of SPAN characters holds one.
2. Banding. A paragraph's MinHash signature over its shingles is cut into bands; ``tune`` sets their number for a wanted recall
   at a similarity. Paragraphs that share a band with another document's collide. Copies have equal bands, so none is missed.
3. Verification. A window is named by the paragraph it picks and its offset from it. Around each colliding paragraph the windows are taken in
   blocks of BLOCK offsets. Blocks are grouped by their core (their windows' intersection): in one document only, it proves that no window is
   shared; with equal whole texts (the windows' union) all around, that all are. Other blocks, which lie at the ends of spans, are verified
   window by window. Equality is that of 128-bit digests of all characters, that is edit distance 0 and Jaccard similarity 1. Copies meet in a
   group of equal digests, never pair by pair.
4. Removals. Documents that share a window are linked to the least of them; connected components of these links are clusters, of which every
   shared window is kept once.

Which bands collide, and which blocks are open, is told to the scans by Bloom filters, whose size has a fixed bound; false positives
cost time only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.components import connected_components
from codeloom.operators.skew import heavy_keys, salted_join
from codeloom.session import Scratch

SPAN = 400
PARAGRAPH = 200
SHINGLE, STEP = 16, 4
#: windows that are judged together
BLOCK = 64
#: paragraphs of this similarity collide with this probability at least
SIMILARITY, RECALL, ROWS = 0.95, 0.99, 2
#: Bloom filters have 16 bits an entry and at most 2**MAX_LOG_BITS bits (32 MB)
MAX_LOG_BITS = 28
#: longer texts are read in segments of so many characters
SEGMENT = 1 << 20
_PAGE = 1 << 12
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_CHARS = 1 << 21
_PLACES = np.uint64((1 << 22) - 1)


def tune(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands of ``rows`` MinHashes each by which paragraphs of this Jaccard similarity collide with probability ``recall``."""
    hit = similarity**rows
    return 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _slide(x: np.ndarray, w: int, best, worst) -> np.ndarray:
    """best of x over each window of w, by blocks."""
    n = len(x)
    pad = np.concatenate([x, np.full(-n % w + w, worst, x.dtype)]).reshape(-1, w)
    left = best.accumulate(pad, axis=1).ravel()
    right = best.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(right[: n - w + 1], left[w - 1 : n]) if n >= w else x[:0]


class Texts:
    """Several texts end to end: their paragraphs, with bands, and digests of their stretches."""

    def __init__(self, texts: list[str], span: int, size: int, bands: int):
        self.span, self.size, self.bands = span, size, bands
        self.block = min(BLOCK, max(1, (span - size) // 3))
        self.length = np.array([len(t) for t in texts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64)
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.bytes = memoryview(self.codes).cast("B")
        n = len(self.codes)
        self.back = _powers(_INVERSE, n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.codes.astype(np.uint64) + np.uint64(11)) * _powers(_BASE, n))])
        room = np.repeat(self.first + self.length, self.length) - np.arange(n)  # characters up to the end of the text
        self.fits, self.fits_span = room >= size, room >= span

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        # a difference of prefix sums, shifted back to the start: equal characters hash alike wherever they stand
        return _mix((self.sums[at + size] - self.sums[at]) * self.back[at])

    def picks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """pick, first, last: each picked paragraph with the first and the last window (their starts) of those in a row that pick it."""
        n, w = len(self.codes), self.span - self.size + 1
        if n < self.span:
            return (np.zeros(0, np.int64),) * 3
        # the place in the lower bits orders equal stretches from left to right, which depends on characters alone too
        key = np.full(n, _TOP, np.uint64)
        at = np.flatnonzero(self.fits)
        key[at] = (self.hashes(at, self.size) & ~_PLACES) | at.astype(np.uint64)
        starts = np.flatnonzero(self.fits_span)
        if not len(starts):
            return (np.zeros(0, np.int64),) * 3
        pick = (_slide(key, w, np.minimum, _TOP)[starts] & _PLACES).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], pick[1:] != pick[:-1]]))
        return pick[new], starts[new], starts[np.append(new[1:], len(pick)) - 1]

    def band_keys(self, pick: np.ndarray) -> np.ndarray:
        """A key per paragraph and band; shingles begin at every STEP-th character of the paragraph."""
        shingle = min(SHINGLE, max(1, self.size // 2))
        at = pick[:, None] + np.arange(0, self.size - shingle + 1, STEP)
        h = self.hashes(at.ravel(), shingle).reshape(at.shape)
        out = np.empty((len(pick), self.bands), np.uint64)
        for band in range(self.bands):
            key = np.full(len(pick), np.uint64(band + 1))
            for row in range(ROWS):
                key = _mix(key ^ _mix(h ^ _mix(np.uint64([band * ROWS + row + 1]))).min(axis=1) if len(pick) else key)
            out[:, band] = key
        return out

    def digest(self, at: int, size: int) -> bytes:
        return xxhash.xxh3_128_digest(self.bytes[4 * at : 4 * (at + size)])


def _batches(batches: Iterator[pd.DataFrame], cls) -> Iterator[tuple[np.ndarray, np.ndarray, Texts]]:
    """ids, places of the texts in their documents, texts."""
    for b in batches:
        ids, at, texts, size = [], [], [], 0
        for i, a, t in zip(b["doc_id"], b["seg_at"], b["text"]):
            if size and size + len(t) > _CHARS:
                yield np.array(ids, np.int64), np.array(at, np.int64), cls(texts)
                ids, at, texts, size = [], [], [], 0
            ids.append(i)
            at.append(a)
            texts.append(t)
            size += len(t)
        if ids:
            yield np.array(ids, np.int64), np.array(at, np.int64), cls(texts)


class Bloom:
    """Two bits a key, in words of 32."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, np.uint64(len(words) * 32)

    @staticmethod
    def slots(keys: np.ndarray, bits: np.uint64) -> list[np.ndarray]:
        k = _mix(keys)
        return [(k & np.uint64(0xFFFFFFFF)) % bits, (k >> np.uint64(32)) % bits]

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for s in self.slots(keys, self.bits):
            out &= (self.words[(s >> np.uint64(5)).astype(np.int64)] >> (s & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
        return out


def bloom(keys: DataFrame, column: str, count: int, max_log: int = MAX_LOG_BITS) -> Bloom:
    """A filter of the column's longs. It is made on the executors, page by page; the driver gets its bits, 2**max_log at most."""
    log = min(max_log, max(17, int(16 * count).bit_length()))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = np.concatenate(Bloom.slots(b[column].to_numpy(np.int64).view(np.uint64), np.uint64(1 << log)))
            yield pd.DataFrame({"word": (s >> np.uint64(5)).astype(np.int64), "bit": (np.uint64(1) << (s & np.uint64(31))).astype(np.int64)})

    def page(b: pd.DataFrame) -> pd.DataFrame:
        w = np.zeros(_PAGE, np.uint32)
        w[b["word"].to_numpy(np.int64) % _PAGE] = b["bit"].to_numpy(np.int64).astype(np.uint32)
        return pd.DataFrame({"page": [int(b["word"].iloc[0]) // _PAGE], "words": [w.tobytes()]})

    rows = keys.select(column).mapInPandas(words, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bit"))
    out = np.zeros(1 << (log - 5), np.uint32)
    # a page has _PAGE words at most
    for r in rows.groupBy(F.floor(F.col("word") / _PAGE)).applyInPandas(page, "page bigint, words binary").toLocalIterator():
        out[r.page * _PAGE : (r.page + 1) * _PAGE] = np.frombuffer(bytes(r.words), np.uint32)
    return Bloom(out)


def _in_two(rows: DataFrame, key: str) -> DataFrame:
    """key, least, most: the keys that two documents have. A hot key combines before the shuffle."""
    return rows.groupBy(key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most")


def _place(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A key of a place in a document, to be looked up in a filter."""
    return _mix(_mix(doc.astype(np.uint64)) ^ at.astype(np.uint64))


class SharedSpans:
    """One run over a corpus: doc_id, text. Null ids and texts and texts under ``span`` characters share nothing."""

    def __init__(self, documents: DataFrame, span: int = SPAN, paragraph: int = PARAGRAPH, similarity: float = SIMILARITY, segment: int = SEGMENT):
        if not 0 < paragraph < span:
            raise ValueError("a paragraph must be shorter than the span")
        self.all = documents.select("doc_id", "text").where("doc_id is not null")
        n = F.char_length("text")
        cut = F.transform(F.sequence(F.lit(0), n - span, F.lit(segment)), lambda a: F.struct(a.alias("seg_at"), F.substring(F.col("text"), a + 1, F.lit(segment + span - 1)).alias("text")))
        whole = F.array(F.struct(F.lit(0).alias("seg_at"), F.col("text").alias("text")))
        # windows of a segment begin in it; its halo is their rest
        self.docs = self.all.where(n >= span).select("doc_id", F.explode(F.when(n > segment + span - 1, cut).otherwise(whole)).alias("s")).select("doc_id", "s.*")
        self.spark, self.span, self.size, self.bands = documents.sparkSession, span, paragraph, tune(similarity)
        self.kept = Scratch(self.spark, "spans")
        self._verified: DataFrame | None = None

    def _texts(self):
        span, size, bands = self.span, self.size, self.bands
        return lambda texts: Texts(texts, span, size, bands)

    def buckets(self) -> DataFrame:
        """bucket, doc_id of every band of every paragraph."""
        cls = self._texts()

        def scan(batches):
            for ids, _, t in _batches(batches, cls):
                pick, first, _ = t.picks()
                doc = np.repeat(ids[np.searchsorted(t.first, first, "right") - 1], t.bands)
                yield pd.DataFrame({"bucket": t.band_keys(pick).ravel().view(np.int64), "doc_id": doc}).drop_duplicates()

        return self.docs.mapInPandas(scan, "bucket bigint, doc_id bigint")

    def blocks(self, buckets: Bloom) -> DataFrame:
        """doc_id, at, n, whole, core: the blocks around the colliding paragraphs, as n windows from ``at`` on, with digests of the windows' union and intersection."""
        cls, sc, span = self._texts(), self.spark.sparkContext, self.span
        wanted = sc.broadcast(buckets)

        def scan(batches):
            for ids, seg_at, t in _batches(batches, cls):
                pick, first, last = t.picks()
                hit = wanted.value.has(t.band_keys(pick).ravel()).reshape(len(pick), t.bands).any(axis=1)
                doc, at, n, whole, core = [], [], [], [], []
                for q, a, b in zip(pick[hit].tolist(), first[hit].tolist(), last[hit].tolist()):
                    d = int(np.searchsorted(t.first, q, "right") - 1)
                    lo, hi = int(t.first[d]), int(t.first[d] + t.length[d]) - span
                    # offsets from k blocks on before the paragraph; at the ends of a text a block has fewer
                    for k in range((q - b) // t.block, (q - a) // t.block + 1):
                        x, y = max(lo, q - (k + 1) * t.block + 1), min(hi, q - k * t.block)
                        doc.append(d)
                        at.append(x)
                        n.append(y - x + 1)
                        whole.append(t.digest(x, y - x + span))
                        # of a block that is cut short the core would be too long: the one all such blocks have in common is taken
                        z = q - k * t.block
                        core.append(t.digest(z, span - t.block + 1))
                doc, at = np.array(doc, np.int64), np.array(at, np.int64)
                yield pd.DataFrame({"doc_id": ids[doc], "at": at - t.first[doc] + seg_at[doc], "n": np.array(n, np.int32), "whole": whole, "core": core})

        return self.docs.mapInPandas(scan, "doc_id bigint, at bigint, n int, whole binary, core binary")

    def windows(self, blocks: DataFrame) -> DataFrame:
        """doc_id, at, n (1), key of the single windows of some blocks (doc_id, at, n)."""
        cls, sc, span = self._texts(), self.spark.sparkContext, self.span
        count = blocks.count()
        docs = blocks.select("doc_id").distinct()
        some_docs = bloom(docs.select(F.col("doc_id").alias("k")), "k", docs.count())

        def places(batches):
            for b in batches:
                yield pd.DataFrame({"k": _place(b["doc_id"].to_numpy(np.int64), b["at"].to_numpy(np.int64) * 128 + b["n"].to_numpy(np.int64)).view(np.int64)})

        wanted = sc.broadcast((some_docs, bloom(blocks.select("doc_id", "at", "n").mapInPandas(places, "k bigint"), "k", count)))

        def scan(batches):
            some_docs, some_blocks = wanted.value

            def keep(batches):
                for b in batches:
                    yield b[some_docs.has(b["doc_id"].to_numpy(np.int64).view(np.uint64))]

            for ids, seg_at, t in _batches(keep(batches), cls):
                pick, first, last = t.picks()
                k0, k1 = (pick - last) // t.block, (pick - first) // t.block
                each = np.repeat(np.arange(len(pick)), k1 - k0 + 1)
                k = np.arange(len(each)) - np.repeat(np.cumsum(k1 - k0 + 1) - (k1 - k0 + 1), k1 - k0 + 1) + k0[each]
                d = np.searchsorted(t.first, pick[each], "right") - 1
                x = np.maximum(t.first[d], pick[each] - (k + 1) * t.block + 1)
                y = np.minimum(t.first[d] + t.length[d] - span, pick[each] - k * t.block)
                hit = some_blocks.has(_place(ids[d], (x - t.first[d] + seg_at[d]) * 128 + y - x + 1))
                d, x, n = d[hit], x[hit], (y - x + 1)[hit]
                at = np.repeat(x, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                d = np.repeat(d, n)
                at, i = np.unique(at, return_index=True)
                d = d[i]
                yield pd.DataFrame({"doc_id": ids[d], "at": at - t.first[d] + seg_at[d], "n": np.ones(len(at), np.int32), "key": [t.digest(z, span) for z in at.tolist()]})

        return self.docs.mapInPandas(scan, "doc_id bigint, at bigint, n int, key binary")

    def _judged(self) -> DataFrame:
        """The blocks whose core two documents have, with the least of these and whether all blocks of that core are equal."""
        two = self.kept.put(_in_two(self.buckets(), "bucket").select("bucket"), "buckets")
        b = self.kept.put(self.blocks(bloom(two, "bucket", two.count())), "blocks")
        self.kept.drop("buckets")
        whole = F.xxhash64("whole")
        cores = b.groupBy("core").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), (F.min(whole) == F.max(whole)).alias("equal"))
        out = self.kept.put(salted_join(b.drop("whole"), cores.where("least <> most").drop("most"), "core", heavy_keys(b, "core")), "judged")
        self.kept.drop("blocks")
        return out

    def documents(self) -> DataFrame:
        """doc_id of every document that shares a span."""
        b = self._judged()
        sure = self.kept.put(b.where("equal").select("doc_id").distinct(), "sure")
        # cores of documents that no block has settled, and all blocks that have those cores
        mixed = b.where("not equal")
        cores = mixed.join(sure, "doc_id", "left_anti").select("core").distinct()
        open_ = self.kept.put(salted_join(mixed, cores, "core", heavy_keys(mixed, "core")).select("doc_id", "at", "n").distinct(), "open")
        w = self.kept.put(self.windows(open_), "windows")
        more = salted_join(w.select("key", "doc_id"), _in_two(w, "key").select("key"), "key", heavy_keys(w, "key")).select("doc_id")
        return sure.union(more).distinct()

    def verified(self) -> DataFrame:
        """doc_id, at, n, least: runs of n windows from ``at`` on that stand in other documents too, and the least document that has them."""
        if self._verified is None:
            b = self._judged()
            w = self.kept.put(self.windows(self.kept.put(b.where("not equal").select("doc_id", "at", "n").distinct(), "open")), "windows")
            w = salted_join(w, _in_two(w, "key").select("key", "least"), "key", heavy_keys(w, "key"))
            self._verified = self.kept.put(b.where("equal").select("doc_id", "at", "n", "least").union(w.select("doc_id", "at", "n", "least")), "verified")
            self.kept.drop("judged", "open", "windows")
        return self._verified

    def spans(self) -> DataFrame:
        """doc_id, char_start, char_end, least_doc_id: maximal stretches of shared windows, end exclusive, and the least document that has a part of it (perhaps itself)."""
        return _stretches(self.verified(), self.span, self.size)

    def clusters(self) -> DataFrame:
        """doc_id, cluster_id: the least doc_id among the documents linked, directly or through others, by shared spans."""
        # a star around the least document of each run links its copies
        links = self.verified().where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct()
        return connected_components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster_id"))

    def report(self) -> DataFrame:
        """doc_id, n_chars, n_spans, shared_chars, cluster_id of every document; one that shares nothing has zeros and no cluster, a null text 0 characters."""
        per = self.spans().groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_spans"), F.sum(F.col("char_end") - F.col("char_start")).alias("shared_chars"))
        size = self.all.groupBy("doc_id").agg(F.max(F.coalesce(F.char_length("text"), F.lit(0))).alias("n_chars"))
        return size.join(per, "doc_id", "left").join(self.clusters(), "doc_id", "left").fillna(0, ["n_spans", "shared_chars"]).select("doc_id", "n_chars", "n_spans", "shared_chars", "cluster_id")

    def removals(self) -> DataFrame:
        """doc_id, char_start, char_end, cluster_id: what to take out so that every shared window of a cluster stays in one document, the least that has it."""
        extra = _stretches(self.verified().where("doc_id <> least"), self.span, self.size).drop("least_doc_id")
        return extra.join(self.clusters(), "doc_id")


def _merge(df: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches (a, b, least) of a group that touch or overlap, as one."""
    w = Window.partitionBy(*keys).orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.withColumn("new", F.when(F.col("a") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return d.groupBy(*keys, "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("least").alias("least")).drop("run")


def _stretches(runs: DataFrame, span: int, part: int) -> DataFrame:
    # first within parts of a document, so that a very long one is many groups
    r = runs.select("doc_id", F.col("at").alias("a"), (F.col("at") + F.col("n") - 1 + span).alias("b"), "least", F.floor(F.col("at") / (64 * part)).alias("part"))
    m = _merge(_merge(r, ["doc_id", "part"]).drop("part"), ["doc_id"])
    return m.select("doc_id", F.col("a").alias("char_start"), F.col("b").alias("char_end"), F.col("least").alias("least_doc_id"))


def found(documents: DataFrame, span: int = SPAN) -> DataFrame:
    return SharedSpans(documents, span).documents()
