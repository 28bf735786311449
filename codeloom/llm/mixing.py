"""Mixing sources to target shares of the total size in tokens.

A naive Bayes classifier, trained on labelled rows and calibrated on others, gives every text a posterior over the sources; a text's own label is one more,
strong, piece of evidence. Rates between 0 and a cap are fitted by projected least squares, so that the expected token totals of the
sources match their targets: each step is a scan that adds up the totals and the Gram matrix of the texts that are free to move. Rates become whole
repeats by systematic rounding.
"""

from __future__ import annotations

import base64
import itertools
import math
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: the classifier is fitted on the counts of about this many labelled rows at most, picked by the hash of their id
FIT_ROWS = 50_000
FEATURES = 1 << 14
STEPS = 30
TOLERANCE = 1e-4
#: how often a label is right; and the temperatures that calibration tries
LABEL_TRUST = 0.999
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
#: rounding is done again with corrected targets, at most so often, until no share is off by more than CLOSE of itself
CORRECTIONS, CLOSE = 3, 0.005
#: memberships in a block of texts, blocks that a task of the fit reads about, and blocks that it adds up at a time
_BLOCK, _BLOCKS, _AT_ONCE = 512, 4096, 64
_SIZES = 1023
_SLICES = 64
# fixed value: the published pre-tokenisation pattern of the vocabulary
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# white space as the vocabulary's pattern has it; a gap is all of it between two words, but for the single blank
_SPACE = r"[^\S\x1c-\x1f]"
_GAPS = re.compile(rf"({_SPACE}(?:(?<! )|(?={_SPACE})){_SPACE}*)")
_WORDS = re.compile(r"\w+")
#: words and characters that a vocabulary holds before it begins anew; and texts and characters that are read at a time
_CACHE, _CACHE_CHARS = 400_000, 1 << 25
_TEXTS, _CHARS = 64, 1 << 18


class _Gaps(dict):
    """What stands for the white space before a word: its tokens, and a line feed unless its last blank is the word's."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.chars = encode, 0

    def __missing__(self, gap: str) -> str:
        self.chars += len(gap)
        n, last = len(self.encode(gap[:-1])), gap[-1]
        self[gap] = mark = f" \v{n} " if last == " " else f" \v{n + len(self.encode(last))} \n"
        return mark


class Words:
    """Numbers the words that stand between white space; the tokens and features of each are worked out once, and added up for many texts at once.

    A word's tokens are those behind a blank. A line feed before a word tells that it begins a text or follows other white space;
    a vertical tab and a number stand for so many tokens of white space. Without a tokenizer only features are known.
    """

    def __init__(self, path: str | None = None):
        self.encode = None
        if path:
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.encode = tiktoken.Encoding("counter", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.begins = np.zeros(max(ranks.values()) + 1, bool)
            self.begins[[n for piece, n in ranks.items() if piece[:1] in (b" ", b"\n")]] = True
        self.seen = np.zeros(_TEXTS * FEATURES, bool)
        self._begin()

    def _begin(self) -> None:
        self.numbers, self.gaps, self.chars = defaultdict(itertools.count().__next__), _Gaps(self.encode), 0
        self.tokens, self.features, self.ends = array("q"), array("q"), array("q", [0])

    def _cut(self, text: str) -> list[str]:
        if not self.encode:
            return text.split()
        parts = _GAPS.split(text)
        if len(parts) > 1:
            if not parts[-1]:
                parts[-2:] = [f" \v{len(self.encode(parts[-2]))}"]
            parts[1:-1:2] = map(self.gaps.__getitem__, parts[1:-1:2])
            text = "".join(parts)
        return ("\n" + text).split(" ")

    def _learn(self) -> None:
        """Tokens and features of the words that were numbered since the last time."""
        new = list(itertools.islice(reversed(self.numbers), len(self.numbers) - len(self.ends) + 1))[::-1]
        if self.encode and new:
            known = {i: int(w[1:] or 0) if w else 1 for i, w in enumerate(new) if w in ("", "\n") or w[0] == "\v"}
            # no token reaches across a blank or line feed before a word, so one encoding counts them all
            got = np.array(self.encode("".join([" x" if i in known else w if w[0] == "\n" else " " + w for i, w in enumerate(new)])))
            n = np.diff(np.flatnonzero(self.begins[got]), append=len(got)) - [w[:1] == "\n" for w in new]
            n[list(known)] = list(known.values())
            self.tokens.frombytes(n.astype(np.int64).tobytes())
        for word in new:
            low = word.lower()
            if low.isalnum():
                self.features.append(zlib.crc32(low.encode()) % FEATURES)
            else:
                self.features.extend([zlib.crc32(w.encode()) % FEATURES for w in _WORDS.findall(low)] if low[:1] != "\v" else ())
            self.ends.append(len(self.features))
        self.chars += sum(map(len, new))

    def read(self, texts: list[str]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """For stretches of the texts: which they are, the tokens of each, and the features that each has, as text within the stretch and feature, in order and each once."""
        at = 0
        while at < len(texts):
            if len(self.numbers) > _CACHE or self.chars + self.gaps.chars > _CACHE_CHARS:
                self._begin()
            begin, chars, number = at, 0, self.numbers.__getitem__
            stretch = []
            while at < len(texts) and at < begin + _TEXTS and chars < _CHARS:
                words = self._cut(texts[at])
                stretch.append(np.fromiter(map(number, words), np.int64, len(words)))
                chars += len(texts[at])
                at += 1
            self._learn()
            many, words = np.array([len(x) for x in stretch]), np.concatenate(stretch)
            tokens = np.zeros(len(many), np.int64)
            if self.encode:
                sums = np.append(0, np.cumsum(np.frombuffer(self.tokens, np.int64)[words]))
                tokens = np.diff(sums[np.append(0, np.cumsum(many))])
            first, end = np.frombuffer(self.ends, np.int64)[words], np.frombuffer(self.ends, np.int64)[words + 1]
            n = end - first
            if n.any():
                place = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                self.seen[np.repeat(np.repeat(np.arange(len(many)) * FEATURES, many), n) + np.frombuffer(self.features, np.int64)[place]] = True
            found = np.flatnonzero(self.seen)
            self.seen[found] = False
            yield slice(begin, at), tokens, found // FEATURES, found % FEATURES


class TokenCounter(Words):
    """Counts tokens of a tiktoken vocabulary, word by word."""

    _loaded: dict[str, TokenCounter] = {}

    @classmethod
    def get(cls, path: str) -> TokenCounter:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __call__(self, text: str | None) -> int:
        return sum(int(tokens.sum()) for _, tokens, _, _ in self.read([text])) if text else 0


def source_name(c: Column) -> Column:
    """A source as it is compared: trimmed, lower case, with underscores; blank is none."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_"), F.lit(""))


class Classifier:
    """Bernoulli-style naive Bayes on hashed words: which words a text has, not how often. Text evidence is divided by a fitted temperature."""

    def __init__(self, labels: list[str], counts: np.ndarray, rows: np.ndarray, temperature: float = 1.0):
        self.labels, self.temperature = labels, temperature
        # smoothed towards the rate over all labels, so that labels of few rows are not at a disadvantage
        p = np.clip((counts + 2 * counts.sum(axis=0) / rows.sum()) / (rows[:, None] + 2), 1e-6, 1 - 1e-6)
        self.on, self.off = (np.log(p) - np.log1p(-p)).T.copy(), np.log1p(-p).sum(axis=1)
        self.prior = np.log(rows / rows.sum())

    def evidence(self, texts: list[str], words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods, texts x labels, and the tokens of each text."""
        out, tokens = np.tile(self.off, (len(texts), 1)), np.zeros(len(texts), np.int64)
        for at, n, text, feature in words.read(texts):
            tokens[at] = n
            begins = np.flatnonzero(np.diff(text, prepend=-1))
            if len(begins):
                out[at.start + text[begins]] += np.add.reduceat(self.on[feature], begins, axis=0)
        return out, tokens

    def posterior(self, text: str, label: str | None = None) -> np.ndarray:
        return self.posteriors([text], [label], Words())[0][0]

    def posteriors(self, texts: list[str], given: list[str | None], words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors, texts x labels, and the tokens of each text; a given label counts if it is one of the model's."""
        n = len(self.labels)
        evidence, tokens = self.evidence(texts, words)
        s = self.prior + evidence / self.temperature
        if n > 1:
            at = {x: i for i, x in enumerate(self.labels)}
            own = np.array([at.get(x, -1) for x in given], int)
            s[own >= 0] += np.where(np.arange(n) == own[own >= 0, None], math.log(LABEL_TRUST), math.log((1 - LABEL_TRUST) / (n - 1)))
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True), tokens


def fit(documents: DataFrame, labels: list[str], fit_rows: int = FIT_ROWS) -> Classifier:
    """Word counts per label, added up on the executors: labels x FEATURES numbers reach the driver. A fifth of the rows is kept back, for the temperature of least log loss."""
    d = documents.where("doc_id is not null and text is not null").select("doc_id", source_name(F.col("source")).alias("source"), "text").where(F.col("source").isin(labels))
    # one row in m by the hash of its id, which needs no shuffle of the texts
    m = max(1, math.ceil(d.count() / fit_rows))
    d = d.where(F.pmod(F.xxhash64("doc_id"), F.lit(m)) == 0)
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros((len(labels), FEATURES + 1), np.int64), Words()
        for b in batches:
            own = np.array([labels.index(x) for x in b.column("source").to_pylist()], int)
            np.add.at(total[:, FEATURES], own, 1)
            for at, _, text, feature in words.read(b.column("text").to_pylist()):
                np.add.at(total, (own[at][text], feature), 1)
        label, at = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"label": label, "feature": at, "n": total[label, at]})

    got = d.where(~held).select("source", "text").mapInArrow(count, "label bigint, feature bigint, n bigint").groupBy("label", "feature").agg(F.sum("n").alias("n")).toPandas()
    have = sorted(set(got["label"]))
    known = [labels[i] for i in have]
    if not known:
        return Classifier(labels, np.zeros((len(labels), FEATURES)), np.ones(len(labels)))
    counts = np.zeros((len(known), FEATURES + 1))
    counts[np.searchsorted(have, got["label"]), got["feature"].to_numpy(np.int64)] = got["n"]
    model = Classifier(known, counts[:, :FEATURES], counts[:, FEATURES])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def loss(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words, sums = shared.value, Words(), np.zeros(len(TEMPERATURES))
        for b in batches:
            b = b.filter(pc.is_in(b.column("source"), pa.array(m.labels)))
            if not len(b):
                continue
            e, own = m.evidence(b.column("text").to_pylist(), words)[0], np.array([m.labels.index(x) for x in b.column("source").to_pylist()])
            for i, temperature in enumerate(TEMPERATURES):
                x = m.prior + e / temperature
                top = x.max(axis=1)
                sums[i] += (np.log(np.exp(x - top[:, None]).sum(axis=1)) + top - x[np.arange(len(x)), own]).sum()
        yield pa.RecordBatch.from_pydict({"t": np.array(TEMPERATURES), "loss": sums})

    sums = d.where(held).select("source", "text").mapInArrow(loss, "t double, loss double").groupBy("t").agg(F.sum("loss").alias("loss")).toPandas()
    if len(sums):
        model.temperature = float(sums.sort_values(["loss", "t"])["t"].iloc[0])
    return model


def sized(documents: DataFrame, model: Classifier | None = None, labels: list[str] | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens, text_hash, p of every text, in one scan; p are the posteriors over ``labels``. Null texts and ids are left out, empty ones have 0 tokens."""
    shared = documents.sparkSession.sparkContext.broadcast((model, labels or []))  # labels x FEATURES numbers
    name = _shipped(documents, tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        words = TokenCounter.get(SparkFiles.get(name))
        m, labels = shared.value
        at = [labels.index(x) for x in m.labels] if m else []
        for b in batches:
            texts, p = b.column("text").to_pylist(), np.zeros((len(b), len(labels)), np.float32)
            if m and len(b):
                p[:, at], tokens = m.posteriors(texts, b.column("source").to_pylist(), words)
            else:
                tokens = [words(t) for t in texts]
            hashes = pa.array([xxhash.xxh3_128_digest(t.encode()) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(tokens, pa.int64()), hashes, _lists(p)], ["doc_id", "source", "tokens", "text_hash", "p"])

    rows = documents.where("doc_id is not null and text is not null").select("doc_id", source_name(F.col("source")).alias("source"), "text")
    return rows.mapInArrow(count, "doc_id bigint, source string, tokens bigint, text_hash binary, p array<float>")


def _shipped(documents: DataFrame, tokenizer: str) -> str:
    """The vocabulary file's name, after it has been sent to the executors, once a session."""
    sc = documents.sparkSession.sparkContext
    sent = sc.__dict__.setdefault("_codeloom_files", set())
    if tokenizer not in sent:
        sc.addFile(tokenizer)
        sent.add(tokenizer)
    return tokenizer.rsplit("/", 1)[-1]


def distinct_texts(rows: DataFrame) -> DataFrame:
    """One row per text, so that copies under other ids don't repeat it: the least id among the labelled ones, else among all."""
    pick = F.min(F.struct(F.col("source").isNull().alias("none"), "doc_id", "source", "tokens", "p")).alias("r")
    return rows.groupBy("text_hash").agg(pick).select("r.doc_id", "r.source", "r.tokens", "r.p").dropDuplicates(["doc_id"])


def memberships(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, pd.DataFrame]:
    """(doc_id, source, tokens, p) of the texts, p over the target sources, and the targets.

    A text keeps its label; one without gets the likeliest source. Texts whose label has no target are left out: their share is 0.
    """
    t = targets.where("source is not null and target_share > 0").groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("cap")).orderBy("source").toPandas()  # one row a source
    t["cap"] = t["cap"].fillna(1).clip(lower=0)
    labels = list(t["source"])
    if not labels:
        return documents.select(F.col("doc_id"), "source", F.lit(0).cast("long").alias("tokens"), F.array().cast("array<float>").alias("p")).limit(0), t
    texts = distinct_texts(sized(documents, fit(documents, labels, fit_rows), labels, tokenizer))
    likely = F.get(F.array(*[F.lit(x) for x in labels]), F.array_position("p", F.array_max("p")).cast("int") - 1)
    return texts.where(F.col("source").isNull() | F.col("source").isin(labels)).select("doc_id", F.coalesce("source", likely).alias("source"), "tokens", "p"), t


def _lists(p: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32) if p.size else np.zeros(len(p) + 1, np.int32), p.ravel())


def _matrix(b: pa.RecordBatch, k: int) -> np.ndarray:
    return b.column("p").flatten().to_numpy().astype(float).reshape(len(b), k)


def _joined(b: pa.RecordBatch, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(name).to_pylist()), kind).astype(float)


class Rates:
    """Least squares for the rates of texts.

    Of all rates in [0, cap] whose expected totals are nearest to the aims, those of least norm (weighted by tokens) have the form
    clip(p . level): the gradient of a text is a mean of its sources' errors by membership, and the projection puts it back into the box. So one level per source is
    all that passes between steps. A step divides the gradient by the Gram matrix of the texts strictly inside the box.
    """

    def __init__(self, members: DataFrame, t: pd.DataFrame, kept: Scratch):
        self.k = len(t)
        self.sources, self.caps = list(t["source"]), t["cap"].to_numpy(float)
        self.share = t["share"].to_numpy(float)
        if self.k:
            blocks = kept.put(self._packed(members), "blocks")
            self.blocks = blocks.coalesce(math.ceil(blocks.count() / _BLOCKS) or 1)

    def _packed(self, members: DataFrame) -> DataFrame:
        """The texts in blocks, a row each: what a scan needs of them, as bytes. Every scan reads all of them, and rows and tasks cost more than the sums."""
        k, ceiling, per = self.k, self.ceiling, max(1, _BLOCK // self.k)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                parts = {"tokens": b.column("tokens").to_numpy(), "top": ceiling(b.column("source")), "p": b.column("p").flatten().to_numpy().reshape(len(b), k)}
                yield pa.RecordBatch.from_pydict({c: pa.array([x[i : i + per].tobytes() for i in range(0, len(b), per)], pa.binary()) for c, x in parts.items()})

        return members.select("source", "tokens", "p").mapInArrow(pack, "tokens binary, top binary, p binary")

    @property
    def ceiling(self):
        """A function from sources to their caps; it goes to the tasks without the tables."""
        caps = dict(zip(self.sources, self.caps))

        def of(source: pa.Array) -> np.ndarray:
            source = source.dictionary_encode()
            return np.array([caps[x] for x in source.dictionary.to_pylist()], float)[source.indices.to_numpy()]

        return of

    def scan(self, level: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Expected totals and the Gram matrix of the free texts, at these levels; without levels at the caps."""
        k = self.k

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((k + 1, k))
            for b in (b.slice(i, _AT_ONCE) for b in batches for i in range(0, len(b), _AT_ONCE)):
                p, top, tokens = _joined(b, "p", np.float32).reshape(-1, k), _joined(b, "top", np.float64), _joined(b, "tokens", np.int64)
                raw = p @ level if level is not None else top
                sums[0] += (tokens * np.clip(raw, 0, top)) @ p
                inside = (raw > 0) & (raw < top)
                free = p[inside]
                sums[1:] += (free * tokens[inside, None]).T @ free
            yield pa.RecordBatch.from_pydict({"i": np.repeat(np.arange(k + 1, dtype=np.int32), k), "j": np.tile(np.arange(k, dtype=np.int32), k + 1), "s": sums.ravel()})

        got = self.blocks.mapInArrow(add, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
        out = np.zeros((k + 1, k))
        out[got["i"].to_numpy(np.int64), got["j"].to_numpy(np.int64)] = got["s"]
        return out[0], out[1:]

    def solve(self, aim: np.ndarray, level: np.ndarray | None = None, steps: int = STEPS) -> tuple[np.ndarray, float]:
        """Levels for these totals, and the largest relative error that is left."""
        scale = np.where(aim > 0, aim, 1.0)
        level = np.where(aim > 0, self.caps / 2, 0.0) if level is None else level
        best = None
        for _ in range(steps):
            totals, gram = self.scan(level)
            error = np.where(aim > 0, (totals - aim) / scale, 0.0)
            worst = float(np.abs(error).max(initial=0))
            if best is None or worst < best[1]:
                best = (level, worst)
            if worst < TOLERANCE:
                break
            # in units of the aims, with a little weight on the diagonal where a source has no free text
            g = gram / scale[:, None] / scale[None, :]
            step = np.linalg.solve(g + max(1e-12, 1e-6 * np.abs(g).max()) * np.eye(self.k), error) / scale
            level = level - np.clip(step, -self.caps / 2, self.caps / 2)
        return best if best else (np.zeros(self.k), 0.0)


def _rounded(members: DataFrame, rates: Rates, level: np.ndarray) -> DataFrame:
    """doc_id, source, tokens, repeats: whole repeats by systematic rounding.

    Fractions are rounded along the texts of a source in an order by size and hash: the running sum of fractions passes a whole
    number where a text gets one more. The sum is taken in slices of the order, so a large source is no single task.
    """
    k, ceiling = rates.k, rates.ceiling

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            top = ceiling(b.column("source"))
            rate = pa.array(np.clip(_matrix(b, k) @ level, 0, top))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("tokens"), rate, pa.array(top)], ["doc_id", "source", "tokens", "rate", "cap"])

    r = members.mapInArrow(put, "doc_id bigint, source string, tokens bigint, rate double, cap double")
    r = r.withColumn("whole", F.floor(F.col("rate") + 1e-9)).withColumn("part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    # by size first, so that what is passed over is as long as what is chosen
    r = r.withColumn("h", F.xxhash64("doc_id")).withColumn("slice", F.least(F.floor(F.col("tokens") / 8), F.lit(_SIZES)) * _SLICES + F.pmod("h", F.lit(_SLICES)))
    per = r.groupBy("source", "slice").agg(F.sum("part").alias("sum"))
    per = per.withColumn("before", F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    run = F.col("before") + F.sum("part").over(Window.partitionBy("source", "slice").orderBy("tokens", "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    r = r.join(per.drop("sum"), ["source", "slice"]).withColumn("run", run)
    one = F.floor(F.col("run") + 0.5) - F.floor(F.col("run") - F.col("part") + 0.5)
    r = r.withColumn("repeats", F.least(F.col("whole") + one, F.floor("cap")).cast("int"))
    return r.where("repeats > 0").select("doc_id", "source", "tokens", "repeats")


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, pd.DataFrame]:
    """(doc_id, source, tokens, repeats) of the chosen texts, and the targets with the expected totals aimed at and the residual of the fit.

    Without ``total_tokens`` the total is the largest that every source with texts can carry its share of. What rounding
    to whole texts, and counting a text for one source, leave of a source's error is added to its aim and rounded again; the best of these roundings is taken.
    """
    kept = Scratch(documents.sparkSession, "mixing")
    members, t = memberships(documents, targets, tokenizer)
    members = kept.put(members, "members")
    rates = Rates(members, t, kept)
    if not rates.k:
        return members.select("doc_id", "source", "tokens", F.lit(0).alias("repeats")), t.assign(aim=[], residual=[])
    most, _ = rates.scan(None)
    # a source that no text belongs to can't have its share
    live = most > 1e-3 * most.sum() * rates.share
    total = total_tokens or (float((most[live] / rates.share[live]).min()) * 0.999 if live.any() else 0.0)
    aim = np.where(live, rates.share * total, 0.0)
    level, residual = rates.solve(aim)
    wanted, best = aim, None
    for turn in range(CORRECTIONS):
        chosen = kept.put(_rounded(members, rates, level), f"chosen{turn}")
        got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("n")).toPandas().set_index("source")["n"]
        reached = np.array([float(got.get(s, 0.0)) for s in rates.sources])
        parts = reached / max(1.0, reached.sum()), aim / max(1.0, aim.sum())
        off = float(np.max(np.divide(np.abs(parts[0] - parts[1]), parts[1], out=np.zeros(rates.k), where=parts[1] > 0), initial=0))
        if best is None or off < best[0]:
            if best:
                kept.drop(best[1])
            best = (off, f"chosen{turn}", chosen)
        else:
            kept.drop(f"chosen{turn}")
        if off <= CLOSE or turn + 1 == CORRECTIONS:
            break
        wanted = np.clip(wanted + np.where(live, aim - reached, 0.0), 0, np.where(live, most, 0.0))
        level, _ = rates.solve(wanted, level, 4)
    kept.drop("members", "blocks")
    return best[2], t.assign(aim=aim, residual=residual)


def shares(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """source, target_share, texts, mixed_tokens, reached_share, deviation (from the target share, relative) and fit_residual of every target; a source without texts reaches 0."""
    chosen, t = mix(documents, targets, total_tokens, tokenizer)
    got = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"))
    aims = documents.sparkSession.createDataFrame([(s, float(x), float(r)) for s, x, r in zip(t["source"], t["share"], t["residual"])], "source string, target_share double, fit_residual double")
    out = got.join(F.broadcast(aims), "source", "right").fillna(0, ["texts", "mixed_tokens"])  # one row a source
    out = out.withColumn("reached_share", F.col("mixed_tokens") / F.greatest(F.sum("mixed_tokens").over(Window.partitionBy()), F.lit(1)))
    return out.select("source", "target_share", "texts", "mixed_tokens", "reached_share", (F.col("reached_share") / F.col("target_share") - 1).alias("deviation"), "fit_residual")
