import datetime

from codeloom.llm import provenance as V

CHUNKS = "id bigint, indexed_at timestamp, collection string, unit string, kind string, code string, label string, path string"
REQ = "request_id bigint, collection string, patterns string, requested_at timestamp, folder string"


def day(n):
    return datetime.datetime(2024, 1, n)


def hand(i):
    return f"procedure Run{i};\nbegin\n" + "".join([f"  a{i} := b + {k};\n  if c > {k} then\n    Go(d, e{k});\n" if k % 2 else f"  while x < {k} do y := z shl {i};\n\n" for k in range(4 + i % 5)]) + "end;"


def chunks(spark, files):
    rows, n = [], 0
    for coll, unit, parts in files:
        for kind, code in parts:
            n += 1
            rows.append((n, day(1), coll, unit, kind, code, "clash", "clash"))
    return spark.createDataFrame(rows, CHUNKS)


def own(n, seed=0):
    return [("unithead", "unit x;"), *[("method", hand(i + 7 * seed)) for i in range(n)]]


FILES = [
    ("c", "src/generators/a.pas", own(5, 1)),
    ("c", ".\\src\\vendor_portal\\b.pas", [("unithead", "// Writes the generated stubs; edit freely.\nunit b;"), *own(4, 2)]),
    ("c", "src/stub.go", [("method", f"func Get{i}() int {{\n return m.f[{i}]\n}}") for i in range(9)]),
    ("c", "src/noticed.py", [("unithead", "# Code generated by tool 3. DO NOT EDIT."), ("method", "def a():\n    return 1"), ("method", "def b(x):\n    for i in x:\n        print(i)")]),
    ("c", "web/app.min.js", [("method", "!function(e,t){" + "".join(f"e.a{i}=t({i});" for i in range(60)) + "}();")]),
    ("c", "data/t.inc", [("decl", "T = [\n" + "  $0A, $1B, $2C, 7,\n" * 9 + "]")]),
    ("c", "net/copy.pas", own(3, 9)), ("d", "lib/copy2.pas", own(3, 9)),
    ("c", "node_modules/pkg/unseen.js", [("method", hand(77)), ("method", hand(78))]),
    ("c", "taken/mine.pas", own(3, 4)), ("d", "taken/mine.pas", own(3, 5)), ("d", "deep/a/b/c/d/e/f.pas", own(3, 6)),
    ("c", "src/empty.pas", [("method", ""), ("method", None)]), (None, "x.pas", own(2, 8)),
]


def test_labels(spark):
    req = spark.createDataFrame([(1, "c", "*.pas, !taken/**", day(2), ""), (2, "d", "!taken/**", day(1), ""), (3, "d", None, day(2), ""), (4, None, "!x/**", day(1), "")], REQ)
    got = {(r.collection, r.unit): r for r in V.labels(chunks(spark, FILES), req).collect()}
    label = {k: r.label for k, r in got.items()}
    assert label["c", "src/generators/a.pas"] == label["c", "src/vendor_portal/b.pas"] == "handwritten"
    assert label["c", "src/stub.go"] == label["c", "src/noticed.py"] == "generated"
    assert label["c", "web/app.min.js"] == "minified"
    assert label["c", "data/t.inc"] == "blob"
    assert label["c", "net/copy.pas"] == label["d", "lib/copy2.pas"] == "vendored"
    assert label["c", "node_modules/pkg/unseen.js"] == "vendored"  # by its directory alone
    assert label["d", "deep/a/b/c/d/e/f.pas"] == label["c", "src/empty.pas"] == label["", "x.pas"] == "handwritten"
    assert got["c", "taken/mine.pas"].kept_out
    assert not got["d", "taken/mine.pas"].kept_out  # only the latest request counts
    assert len(got) == len(FILES)


def test_empty(spark):
    c, r = chunks(spark, []), spark.createDataFrame([], REQ)
    assert V.found(c, r).count() == 0
    assert V.found(chunks(spark, FILES), r).count() > 0


def test_globs(spark):
    pats = "*.pas; !./a/** ;! b/**, -c\\*,!*.min.js,!**/x/**, !v*d/**"
    got = {r.folder for r in V.kept_out(spark.createDataFrame([(1, "c", pats, day(1), "")], REQ)).collect()}
    assert got == {"^a$", "^b$", "^c$", "^v[^/]*d$"}


def test_messages_equal_enumeration(spark):
    """The beliefs, and the expected pairs, against the sum over all labellings of a small tree."""
    import itertools
    import math

    from codeloom.session import Scratch

    scores = {"a/x": (2.0, 0, 0, 0, 0), "a/y": (0, 0, 0, 5.0, 0), "b": (0, 3.0, 0, 0, 0)}
    df = spark.createDataFrame([("c", p, *map(float, s)) for p, s in scores.items()], "collection string, path string, " + ", ".join(f"s_{x} double" for x in V.LABELS))
    run = V.Propagation(df, Scratch(spark, "test"))
    got = {r.path: [r[f"p_{x}"] for x in V.LABELS] for r in run.beliefs.collect()}
    total, mass, pairs = 0.0, {}, {}
    for root, a, x, y, b in itertools.product(range(5), repeat=5):
        p = lambda u, v: V._P[V.LABELS[u]][v]
        w = math.exp(scores["a/x"][x] + scores["a/y"][y] + scores["b"][b]) * p(root, a) * p(a, x) * p(a, y) * p(root, b)
        total += w
        for path, v in (("a/x", x), ("a/y", y), ("b", b)):
            mass[path, v] = mass.get((path, v), 0.0) + w
        for u, v in ((root, a), (root, b), (a, x), (a, y)):
            pairs[u, v] = pairs.get((u, v), 0.0) + w
    for path, p in got.items():
        assert all(abs(q - mass[path, v] / total) < 1e-6 for v, q in enumerate(p))
    assert all(abs(run.pairs[V.LABELS[u]][v] - n / total) < 1e-6 for (u, v), n in pairs.items())
    assert all(abs(sum(o) - 1) < 1e-3 for o in run.fitted_odds().values())


def test_surroundings_decide_where_a_file_shows_little(spark):
    """Without the propagation, and in other company, the same files would be labelled otherwise; no folder has a telling name."""
    from codeloom.session import Scratch

    stub = lambda k: [("method", f"func Get{k}x{i}() int {{\n return m.f[{i}]\n}}") for i in range(9)]
    silent = [("unithead", "unit z;")]
    files = [("c", f"alpha/f{k}.go", stub(k)) for k in range(8)] + [("c", f"beta/g{k}.pas", own(3, 10 + k)) for k in range(8)] + [("c", "alpha/silent.go", silent), ("c", "beta/silent.go", silent)]
    signs = V.file_signs(V.chunk_evidence(chunks(spark, files)))
    alone = V.scored(signs, V.SIGNS).where("path like '%silent%'")
    assert {tuple(r[f"s_{x}"] for x in V.LABELS) for r in alone.collect()} == {(1.0, 0.0, 0.0, 0.0, 0.0)}  # hardly anything of their own
    got = {r.path: r.label for r in V.propagate(signs).collect()}
    assert got["alpha/silent.go"] == "generated" and got["beta/silent.go"] == "handwritten"
    apart = V.Propagation(V.scored(signs, V.SIGNS).withColumn("path", V.F.regexp_replace("path", "/", "-")).where("path not like 'alpha-f%'"), Scratch(spark, "test"))
    assert {r.path: max(V.LABELS, key=lambda x: r[f"p_{x}"]) for r in apart.beliefs.collect()}["alpha-silent.go"] == "handwritten"


def test_fit_learns_what_a_sign_says(spark):
    from codeloom.session import Scratch

    signs = V.file_signs(V.chunk_evidence(chunks(spark, FILES)))
    run = V.Propagation(V.scored(signs, V.SIGNS), Scratch(spark, "test"))
    w = V.fitted_signs(signs, run.beliefs)
    assert w["alike"]["generated"] > w["alike"]["handwritten"] + 2 and w["copies"]["vendored"] > w["copies"]["handwritten"] + 2
