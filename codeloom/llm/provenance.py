"""Files that nobody wrote by hand: belief propagation over directory trees.

Every file shows some of a list of SIGNS (notices, repeated shapes, dense text, code that other collections have too, names). Files
and directories form a tree per collection. Messages go up from files to directories and down again, level by level, with a
compatibility between a directory's label and its children's, so what is known of
parents and siblings reaches files that show little themselves. On trees this is
exact: two passes give each file's posterior. What a sign says for a label, and how labels of directories and children go together, starts
from rough odds and is then fitted to the expected counts of a first propagation, as in expectation maximisation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.model import current, file_path
from codeloom.operators.skew import heavy_keys, salted_join
from codeloom.session import Scratch

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")

# fixed patterns: what generators and packagers write, and how they name files
GENERATED_NOTICE = r"(?im)(?:\bdo not (?:edit|modify)\b|<auto-?generated|@generated\b|\bauto-?generated\b|^\W*(?:automatically )?(?:code )?generated (?:by|from|with)\b|machine output|will be overwritten|lost on the next build|automatisch (?:erzeugt|generiert)|nicht bearbeiten|otomatik (?:olarak )?(?:üretil|oluşturul)|elle değiştirmeyiniz)"
VENDORED_NOTICE = r"(?i)(?:bundled copy|imported unchanged|\bvendored;|upstream changes only|patches are not accepted|kitaplığından aynen|copied (?:verbatim )?from (?:the )?upstream|unverändert (?:aus|von) |aynen alınmıştır)"
HAND_NOTICE = r"(?i)(?:maintained by hand|edit freely|our own code|von hand gepflegt|elle bakım)"
GENERATED_NAME = r"(?:_TLB\.pas|\.pb\.\w+|\.gen\.\w+|\.g\.\w+|\.generated\.\w+|\.Designer\.\w+|_pb2(?:_grpc)?\.py|_bindings\.\w+|Stub\.java|(?:^|/)moc_\w+\.\w+|_generated\.\w+)$"
MINIFIED_NAME = r"(?:[.-]min\.\w+|\.bundle\.js)$"
VENDORED_DIR = r"(?i)^(?:node_modules|third[_-]?party|3rdparty|vendor|vendored|vendors|external|externals|upstream|bower_components)$"


def _skeleton(code: Column) -> Column:
    """Code with s for every string, w for every word and number, and no blanks inside lines."""
    c = F.regexp_replace(code, r"\"[^\"\r\n]*\"|'[^'\r\n]*'", "\x01")
    c = F.translate(F.regexp_replace(c, r"[$#]?[\p{L}\p{N}_]+", "w"), "\x01", "s")
    return F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"[ \t\f]+", "")


def chunk_evidence(chunks: DataFrame) -> DataFrame:
    """Per current chunk: collection, path, kind and the figures the files' scores are made of; no text."""
    code = F.coalesce(F.col("code"), F.lit(""))
    body = F.col("kind") != "unithead"
    skel = _skeleton(F.when(body, code).otherwise(""))
    dense = F.regexp_replace(code, r"\s+", "")
    rows = chunks.select("id", "indexed_at", "collection", file_path(F.col("unit")).alias("path"), "kind", code.alias("code"), skel.alias("skel"), dense.alias("dense"))
    rows = rows.select(
        "id", "indexed_at", "collection", "path", "kind",
        F.when(body, F.char_length("code")).otherwise(0).alias("chars"), F.when(body, F.char_length("dense")).otherwise(0).alias("inked"),
        F.when(body, F.regexp_count("skel", F.lit(r"[^\n]+"))).otherwise(0).alias("lines"),
        # lines of nothing but values, several of them or one long string
        F.when(body, F.regexp_count("skel", F.lit(r"(?m)^(?:[ws:\[\]{}()+.\-]*(?:[,;|][ws:\[\]{}()+.\-]*){3,};?|s[+,;]?)$"))).otherwise(0).alias("values"),
        # lines of the same shape as the line before
        F.when(body, F.regexp_count("skel", F.lit(r"(?m)^([^\n]{4,})\n(?=\1$)"))).otherwise(0).alias("repeats"),
        F.when(F.col("kind") == "method", F.xxhash64(F.regexp_replace("skel", r"\n", ""))).alias("shape"),
        F.when(F.col("kind").isin("method", "type") & (F.char_length("dense") >= 30), F.xxhash64("dense")).alias("same"),
        F.when(~body, F.col("code").rlike(GENERATED_NOTICE)).otherwise(False).alias("says_generated"),
        F.when(~body, F.col("code").rlike(VENDORED_NOTICE)).otherwise(False).alias("says_vendored"),
        F.when(~body, F.col("code").rlike(HAND_NOTICE)).otherwise(False).alias("says_hand"),
    )
    return current(rows, [c for c in rows.columns if c not in ("id", "indexed_at")])


#: rough log odds for a label of files that show a sign; the start of the fit
SIGNS = {
    "own": {"handwritten": 2.5}, "bare": {"handwritten": 1.0}, "hand": {"handwritten": 4.0},
    "gen": {"generated": 9.0}, "alike": {"generated": 8.0}, "rows": {"generated": 8.0}, "gen_name": {"generated": 2.5},
    "packed_code": {"minified": 8.0, "blob": 4.0}, "packed_data": {"blob": 8.0, "minified": 4.0}, "min_name": {"minified": 3.0},
    "ven": {"vendored": 9.0}, "copies": {"vendored": 9.0}, "values": {"blob": 8.0},
}
#: what is fitted counts as the files or children that it comes from, the rough odds as so many
SMOOTH_FILES, SMOOTH_CHILDREN = 20.0, 200.0


def file_signs(evidence: DataFrame) -> DataFrame:
    """collection, path and whether the file shows each of SIGNS."""
    e = evidence.where("path is not null and path <> ''").withColumn("collection", F.coalesce("collection", F.lit("")))
    # code that stands in several collections; a hot piece of code combines before the shuffle
    same = e.where("same is not null").groupBy("same").agg(F.min("collection").alias("a"), F.max("collection").alias("b")).where("a <> b").select("same", F.lit(1).alias("copied"))
    copied = e.where("same is not null").select("collection", "path", "same")
    copied = salted_join(copied, same, "same", heavy_keys(copied, "same"), "left")
    copied = copied.groupBy("collection", "path").agg(F.avg(F.coalesce("copied", F.lit(0))).alias("copied"))
    shapes = e.where("shape is not null").groupBy("collection", "path", "shape").agg(F.count(F.lit(1)).alias("n"))
    shapes = shapes.groupBy("collection", "path").agg(F.sum("n").alias("methods"), F.count(F.lit(1)).alias("shapes"))
    f = e.groupBy("collection", "path").agg(
        F.sum("chars").alias("chars"), F.sum("inked").alias("inked"), F.sum("lines").alias("lines"), F.sum("repeats").alias("repeats"), F.sum("values").alias("values"),
        F.max("says_generated").alias("gen"), F.max("says_vendored").alias("ven"), F.max("says_hand").alias("hand"), F.sum((F.col("kind") == "method").cast("int")).alias("n_methods"), F.sum(F.col("kind").isin("method", "method_part", "type").cast("int")).alias("n_code"),
    )
    f = f.join(shapes, ["collection", "path"], "left").join(copied, ["collection", "path"], "left")
    packed = (F.col("chars") >= 150) & (1 - F.col("inked") / F.greatest("chars", F.lit(1)) < 0.075)
    code_like = F.col("path").rlike(r"\.(?:js|mjs|cjs|css|ts)$") | (F.col("n_methods") > 0)
    signs = {
        "hand": F.col("hand"), "gen": F.col("gen") & ~F.col("hand"), "alike": (F.col("methods") >= 4) & (F.col("shapes") < 0.5 * F.col("methods")),
        "rows": (F.col("lines") >= 12) & (F.col("repeats") > 0.6 * F.col("lines")) & (F.col("n_methods") > 0), "gen_name": F.col("path").rlike(GENERATED_NAME),
        "packed_code": packed & code_like, "packed_data": packed & ~code_like, "min_name": F.col("path").rlike(MINIFIED_NAME), "ven": F.col("ven") & ~F.col("hand"),
        "copies": F.coalesce(F.col("copied"), F.lit(0.0)) >= 0.5, "values": (F.col("lines") >= 4) & (F.col("values") > 0.6 * F.col("lines")) & (F.col("n_code") == 0),
    }
    f = f.select("collection", "path", (F.col("lines") > 0).alias("has_body"), *[F.coalesce(c, F.lit(False)).alias(n) for n, c in signs.items()])
    # a file that has a body and nothing odd about it; one without says little of its own
    own = F.col("has_body") & ~(F.col("alike") | F.col("rows") | F.col("packed_code") | F.col("packed_data") | F.col("copies") | F.col("values"))
    return f.select("collection", "path", *[{"own": own, "bare": ~F.col("has_body")}.get(n, F.col(n)).alias(n) for n in SIGNS])


def scored(signs: DataFrame, odds: dict[str, dict[str, float]]) -> DataFrame:
    """collection, path and a log score s_<label> for each label: what the signs that a file shows add up to."""
    score = lambda x: sum((F.when(F.col(n), float(odds[n].get(x, 0.0))).otherwise(0.0) for n in SIGNS), F.lit(0.0))
    return signs.select("collection", "path", *[score(x).alias(f"s_{x}") for x in LABELS])


def fitted_signs(signs: DataFrame, beliefs: DataFrame) -> dict[str, dict[str, float]]:
    """Log odds of a sign under each label against the overall rate, from the expected counts: (signs + 1) x labels numbers reach the driver.

    A sign that few files show keeps more of its rough odds. Only shown signs count, because many exclude each other.
    """
    b = signs.join(beliefs, ["collection", "path"])
    sums = [F.sum(F.when(F.col(n), F.col(f"p_{x}")).otherwise(0.0)).alias(f"{n}_{x}") for n in SIGNS for x in LABELS]
    row = b.agg(*[F.sum(f"p_{x}").alias(f"n_{x}") for x in LABELS], *sums).first()
    total = sum(row[f"n_{x}"] or 0.0 for x in LABELS)
    out = {}
    for n in SIGNS:
        shown = sum(row[f"{n}_{x}"] or 0.0 for x in LABELS)
        rate = shown / total if shown else 1.0
        # half a file at the overall rate keeps the logarithms finite
        fit = {x: math.log(((row[f"{n}_{x}"] or 0.0) + 0.5 * rate) / ((row[f"n_{x}"] or 0.0) + 0.5) / rate) for x in LABELS}
        out[n] = {x: (shown * fit[x] + SMOOTH_FILES * SIGNS[n].get(x, 0.0)) / (shown + SMOOTH_FILES) for x in LABELS}
    return out


#: rough compatibility of a directory's label (row) with its child's (column), the start of the fit. What people write and what they
#: generate or pack lie side by side; a directory of copies holds copies.
_P = {
    "handwritten": (0.86, 0.05, 0.035, 0.02, 0.035),
    "generated": (0.25, 0.60, 0.05, 0.05, 0.05),
    "minified": (0.25, 0.05, 0.60, 0.05, 0.05),
    "vendored": (0.02, 0.01, 0.02, 0.94, 0.01),
    "blob": (0.25, 0.05, 0.05, 0.05, 0.60),
}
_DIR_NAMED = 9.0


def _vec(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}_{x}") for x in LABELS]


def _lse(xs: list[Column]) -> Column:
    m = F.greatest(*xs)
    return m + F.log(sum((F.exp(x - m) for x in xs[1:]), F.exp(xs[0] - m)))


def _to_parent(score: list[Column], odds: dict) -> list[Column]:
    """The message of a child: for each label of the directory, over the child's labels."""
    return [_lse([s + math.log(p) for s, p in zip(score, odds[d])]).alias(f"m_{d}") for d in LABELS]


def _to_child(score: list[Column], odds: dict) -> list[Column]:
    return [_lse([s + math.log(odds[d][i]) for s, d in zip(score, LABELS)]).alias(f"d_{c}") for i, c in enumerate(LABELS)]


class Propagation:
    """Sum-product over the directory trees of the collections, for files (collection, path, s_<label>).

    ``beliefs`` has collection, path and p_<label> of each file; ``pairs`` the expected number of children with each label under directories with each
    label, 25 numbers.
    """

    def __init__(self, files: DataFrame, kept: Scratch, odds: dict | None = None, name: str = "run"):
        odds = odds or _P
        parts = F.split("path", "/")
        key = lambda c: F.concat("collection", F.lit("\x01"), c).alias("key")
        f = files.withColumn("depth", F.size(parts)).withColumn("parent", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))
        f = kept.put(f.select("collection", "path", "parent", "depth", *_vec("s"), key("parent").alias("dir")), f"{name}-files")
        self.pairs = {d: [0.0] * len(LABELS) for d in LABELS}
        deepest = f.agg(F.max("depth")).first()[0]
        if deepest is None:
            self.beliefs = f.select("collection", "path", *[F.lit(0.0).alias(f"p_{x}") for x in LABELS])
            return
        crowded = heavy_keys(f, "dir")  # directories with a large part of all files
        sums = [F.sum(c).alias(c) for c in (f"m_{x}" for x in LABELS)]
        ups: dict[int, DataFrame] = {}
        below = None
        for level in range(deepest, 0, -1):  # nodes with `level` segments report to their directories; one sum per directory
            msgs = f.where(F.col("depth") == level).select("collection", "parent", *_to_parent(_vec("s"), odds))
            if below is not None:
                msgs = msgs.union(below.select("collection", "parent", *_to_parent(_vec("s"), odds)))
            got = msgs.groupBy("collection", F.col("parent").alias("path")).agg(*sums)
            named = F.element_at(F.split("path", "/"), -1).rlike(VENDORED_DIR)
            prior = lambda x: F.when(named, _DIR_NAMED).otherwise(0.0) if x == "vendored" else F.lit(0.0)
            up = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
            below = kept.put(got.select("collection", "path", up.alias("parent"), *[(F.col(f"m_{x}") + prior(x)).alias(f"s_{x}") for x in LABELS]), f"{name}-up{level - 1}")
            ups[level - 1] = below
        # down: what a child hears is its directory's belief without the child's own message
        down = ups[0].select(key("path").alias("dir"), *[F.col(f"s_{x}").alias(f"b_{x}") for x in LABELS])
        done = []
        for level in range(1, deepest + 1):
            nodes = f.where(F.col("depth") == level).select("collection", "path", "dir", F.lit(True).alias("is_file"), *_vec("s"))
            if level in ups:
                nodes = nodes.union(ups[level].select("collection", "path", key("parent").alias("dir"), F.lit(False).alias("is_file"), *_vec("s")))
            n = salted_join(nodes, down, "dir", crowded).select("*", *_to_parent(_vec("s"), odds))
            n = n.select("collection", "path", "is_file", *_vec("s"), *[(F.col(f"b_{x}") - F.col(f"m_{x}")).alias(f"o_{x}") for x in LABELS])
            n = n.select("*", *_to_child(_vec("o"), odds))
            n = kept.put(n.select("collection", "path", "is_file", *_vec("s"), *_vec("o"), *[(F.col(f"s_{x}") + F.col(f"d_{x}")).alias(f"b_{x}") for x in LABELS]), f"{name}-down{level}")
            self._count(n, odds)
            done.append(n.where("is_file"))
            down = n.where("not is_file").select(key("path").alias("dir"), *_vec("b"))
        b = done[0]
        for x in done[1:]:
            b = b.union(x)
        whole = _lse(_vec("b"))
        self.beliefs = kept.put(b.select("collection", "path", *[F.exp(F.col(f"b_{x}") - whole).alias(f"p_{x}") for x in LABELS]), f"{name}-beliefs")
        kept.drop(*[f"{name}-{x}" for x in ("files", *[f"up{i}" for i in ups], *[f"down{i}" for i in range(1, deepest + 1)])])

    def _count(self, n: DataFrame, odds: dict) -> None:
        pair = {(d, c): F.col(f"o_{d}") + math.log(odds[d][i]) + F.col(f"s_{c}") for d in LABELS for i, c in enumerate(LABELS)}
        whole = _lse(list(pair.values()))
        row = n.withColumn("whole", whole).agg(*[F.sum(F.exp(x - F.col("whole"))).alias(f"{d}_{c}") for (d, c), x in pair.items()]).first()
        for d in LABELS:
            self.pairs[d] = [a + (row[f"{d}_{c}"] or 0.0) for a, c in zip(self.pairs[d], LABELS)]

    def fitted_odds(self) -> dict:
        """Compatibilities from the expected pairs, smoothed towards the rough ones."""
        out = {}
        for d in LABELS:
            n = [a + SMOOTH_CHILDREN * p for a, p in zip(self.pairs[d], _P[d])]
            out[d] = tuple(max(1e-4, x / sum(n)) for x in n)
        return out


def propagate(signs: DataFrame, fit: bool = True) -> DataFrame:
    """collection, path, label, confidence (that it is handwritten, or that it isn't) of each file, from its signs and its surroundings; ``fit`` fits signs and compatibilities on a first propagation."""
    kept = Scratch(signs.sparkSession, "provenance")
    signs = kept.put(signs, "signs")
    run = Propagation(scored(signs, SIGNS), kept, name="rough")
    if fit:
        run = Propagation(scored(signs, fitted_signs(signs, run.beliefs)), kept, run.fitted_odds(), name="fitted")
        kept.drop("rough-beliefs")
    kept.drop("signs")
    # handwritten or not is decided first, then what else it is
    best = F.greatest(*_vec("p")[1:])
    hand = F.col(f"p_{LABELS[0]}") >= 0.5
    label = F.when(hand, LABELS[0]).otherwise(F.coalesce(*[F.when(F.col(f"p_{x}") == best, F.lit(x)) for x in LABELS[1:]]))
    return run.beliefs.select("collection", "path", label.alias("label"), F.round(F.when(hand, F.col(f"p_{LABELS[0]}")).otherwise(1 - F.col(f"p_{LABELS[0]}")), 6).alias("confidence"))


def kept_out(requests: DataFrame) -> DataFrame:
    """collection, folder: the top folders that a collection's latest request keeps out, as patterns for the whole name.

    A glob with a leading ! or - keeps files out. It names a top folder if its first segment, without ./ and
    with / for backslashes, is followed by a slash; * and ? in it match within the name.
    """
    latest = requests.where("collection is not null").groupBy("collection").agg(F.max(F.struct("requested_at", "request_id", F.coalesce("patterns", F.lit("")).alias("patterns"))).alias("r"))
    glob = latest.select("collection", F.explode(F.split("r.patterns", r"[,;\r\n]+")).alias("g")).select("collection", F.trim("g").alias("g")).where("g rlike '^[!-]'")
    g = F.regexp_replace(F.translate(F.trim(F.regexp_replace("g", r"^[!-]\s*", "")), "\\", "/"), r"^(?:\./+|/+)+", "")
    top = glob.select("collection", g.alias("g")).where("instr(g, '/') > 0").select("collection", F.regexp_extract("g", "^([^/]+)/", 1).alias("folder")).where("folder not in ('', '*', '**')")
    name = F.regexp_replace("folder", r"([.+^$(){}|\[\]])", r"\\$1")
    return top.select("collection", F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(name, r"\*+", "[^/]*"), r"\?", "[^/]"), F.lit("$")).alias("folder")).distinct()


def labels(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """collection, unit, label, confidence, kept_out of every file.

    A file is what the current chunks of one collection and path make up; chunks without id or path belong to none, a null collection counts as ''.
    Empty code shows nothing and leaves a file handwritten unless its surroundings say otherwise.
    """
    got = propagate(file_signs(chunk_evidence(chunks)))
    rules = kept_out(requests).groupBy("collection").agg(F.collect_set("folder").alias("folders"))  # a few per request
    got = got.join(rules, "collection", "left").withColumn("top", F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)))
    out = F.coalesce(F.exists("folders", lambda p: F.regexp_like(F.col("top"), p)), F.lit(False))
    return got.select("collection", F.col("path").alias("unit"), "label", "confidence", out.alias("kept_out"))


def found(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    return labels(chunks, requests).where("label <> 'handwritten' or kept_out").select("collection", "unit")
