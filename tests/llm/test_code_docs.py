import datetime

import pytest
from pyspark.sql import functions as F

from codeloom.llm import code_docs as C

SCHEMA = "id bigint, indexed_at timestamp, kind string, doc string, lang string, code string, fn_name string, comments string"
REAL = "Only the first bytes are compared; the rest is ignored."


def run(spark, rows):
    day = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, day, k, d, g, c, "clash", "clash") for i, (k, d, g, c) in enumerate(rows)], SCHEMA)
    return {(r.id, r.fn_name) for r in C.found(df).collect()}


def test_languages(spark):
    rows = [
        ("method", None, None, f"/// {REAL}\nfunction TFoo.Bar(a: string = ')'): Boolean;\nvar x: Integer;\nbegin\n  if x = 1 then begin x := 2; end;\nend;"),
        ("method", "-", "python", f'@cached\ndef bar(a: str = "):") -> bool:\n    r"""\n    {REAL}\n    """\n    return 1\n'),
        ("method", "", "go", f"// {REAL}\nfunc (m *T) Bar(a int) (int, error) {{\n  return 1, nil\n}}"),
        ("method", "", "rust", f"/// {REAL}\n#[inline]\npub fn bar<'a>(x: &'a str) -> Option<i64> {{ Some('}}' as i64) }}"),
        ("method", "", "java", f"/**\r\n * {REAL}\r\n */\r\n@Override\r\npublic Map<String, Long> bar(int a) throws E {{\r\n}}"),
        ("method", "", "csharp", f"/// <summary>\r/// {REAL}\r/// </summary>\rpublic IList<string> Bar(int a)\r{{\r  if (a > 1) {{ }}\r}}"),
        ("method", "", "javascript", f"// {REAL}\nconst bar = (a, b) => {{\n  return `}}`;\n}};"),
        ("method", "", "cpp", f"/* {REAL} */\nstatic int T::bar(const char* a) const {{ return 1; }}"),
    ]
    assert run(spark, rows) == {(0, "Bar"), (1, "bar"), (2, "Bar"), (3, "bar"), (4, "bar"), (5, "Bar"), (6, "bar"), (7, "bar")}


def test_members_of_types(spark):
    code = f"""/* {REAL} */
class Foo extends Base {{
  // {REAL}
  first(a) {{ return 1; }}
  second() {{
    // {REAL}
    return 2;
  }}
  /** {REAL} */
  x = 1;
  third() {{ }}
  // see above
  fourth() {{ }}
  /** {REAL} */
  fifth = (a) => {{ return a; }};
}}"""
    assert run(spark, [("type", REAL, "javascript", code)]) == {(0, "first"), (0, "fifth")}
    py = f'class A(B):\n    """{REAL}"""\n    # {REAL}\n    def one(self):\n        # {REAL}\n        return 1\n\n    def two(self):\n        """{REAL}"""\n        def inner():\n            """{REAL}"""\n'
    assert run(spark, [("type", None, "python", py)]) == {(0, "one"), (0, "two")}
    pas = f"TFoo = class(TBase)\npublic\n  // {REAL}\n  procedure Run; virtual;\nend;"
    assert run(spark, [("type", None, None, pas)]) == set()


@pytest.mark.parametrize("doc", [
    "Handles OpenGate", "Gets the OpenGate", "Open gate.", "TODO: doc", "...", "-----", "<summary></summary>", "@param a the first of the values\n@return the count of the values", "See the base class for details.", "Siehe oben.", "{@inheritDoc}",
    "pylint: disable=too-many-arguments,too-many-locals", "eslint-disable-next-line no-loop-func, max-depth, complexity", "$WARN SYMBOL_DEPRECATED OFF",
    "SPDX-License-Identifier: X-1.0\nPermission to use and copy this file is granted to licensees only.", "Copyright (c) the maintainers of this thing. All rights reserved.",
    "Code generated by formweaver 3. DO NOT EDIT.", "Bu dosya otomatik üretilmiştir, elle değiştirmeyiniz.",
    "val := pos + 14;\nif val > 20 then\n  pos := Pack(val, pos);", "for (i = 0; i < 12; i++) { acc += i; }", "x = x.pack(x, 31, true);\nreturn x + x;",
])
def test_not_real(spark, doc):
    assert run(spark, [("method", doc, "go", "func OpenGate() {\n}")]) == set()


@pytest.mark.parametrize("doc", [REAL, "TODO: revisit. " + REAL, "Idempotent, but slow on cold disks.", "Writes the generated stubs; the caller may edit them freely.", "Aynı damgayı taşıyan satırlarda bile geliş sırasını korur.", "See how the generated copy differs: the vendor keeps two locks, this one keeps none at all while it waits for the gate to open again."])
def test_real(spark, doc):
    assert run(spark, [("method", doc, "go", "func OpenGate() {\n}")]) == {(0, "OpenGate")}


def test_nulls_versions_ties_and_long_texts(spark):
    d = lambda n: datetime.datetime(2024, 1, n)
    good, bad = f"// {REAL}\nfunc A() {{\n}}", "func A() {\n}"
    rows = [
        (1, d(2), "method", None, "go", good, "", ""), (1, d(1), "method", None, "go", bad, "", ""), (1, d(2), "method", None, "go", good, "", ""),
        (2, d(2), "method", None, "go", bad, "", ""), (2, d(1), "method", None, "go", good, "", ""), (3, None, "method", None, "go", good, "", ""),
        (None, d(1), "method", None, "go", good, "", ""), (4, d(1), None, None, "go", good, "", ""), (5, d(1), "method", None, None, None, "", ""), (6, d(1), "method", None, "klingon", "", "", ""),
        (7, d(1), "method", None, "javascript", "x" * 300_000 + " " * 100_000, "", ""), (8, d(1), "method", None, "javascript", "{ (" * 50_000, "", ""),
        (9, d(1), "method", None, "go", f"// {REAL}\nfunc B() {{\n" + "  x = y;\n" * 20_000 + "}", "", ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.id, r.fn_name) for r in C.found(df).collect()} == {(1, "A"), (3, "A"), (9, "B")}
    assert C.found(df.limit(0)).count() == 0
    assert C.pairs(df).where(F.col("id") == 1).first().code_doc == REAL


def pairs_of(spark, rows):
    day = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, day, k, None, g, c, "clash", "clash") for i, (k, g, c) in enumerate(rows)], SCHEMA)
    return {(r.id, r.start): (r.fn_name, r.code, r.code_doc) for r in C.pairs(df).collect()}


def test_pairs_have_code_and_keep_overloads(spark):
    one, two = "int Add(int a) {\n    return a; // 😀\n  }", "int Add(int a, int b) {\n    return a + b;\n  }"
    other = "Adds both of these numbers and keeps the sign."
    code = f"class A { '{' }\n  // 😀 {REAL}\n  {one}\n  // {other}\n  {two}\n}}"
    got = pairs_of(spark, [("type", "java", code)])
    assert got == {(0, code.index(one)): ("Add", one, f"😀 {REAL}"), (0, code.index(two)): ("Add", two, other)}


def test_python_code_ends_before_the_next_comment(spark):
    one, two = f'def one(self):\n        """{REAL}"""\n        return 1\n        # inside', 'def two(self):\n        return """\n# text"""'
    code = f"class A:\n    {one}\n\n    # {REAL}\n    {two}\n\n# outside\nx = 1\n"
    assert pairs_of(spark, [("type", "python", code)]) == {(0, code.index(one)): ("one", one, REAL), (0, code.index(two)): ("two", two, REAL)}


def test_statements_and_functions_end_a_comments_reach(spark):
    other = "Adds both of these numbers and keeps the sign."
    code = f"/** {REAL} */ int a() {{ }} int b() {{ }}\n// {other}\nint x;\nint c() {{ }}\n// {other}\n@Inject\n\nint d() {{\n  // {REAL}\n}}\nint e() {{ }}\n"
    # rows that tie repeat every span
    assert {k[1]: v[0] for k, v in pairs_of(spark, [("type", "java", code)]).items()} == {v: k for k, v in {"a": code.index("int a"), "d": code.index("@Inject") + 9}.items()}
    day = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, day, "type", None, "java", code, "", "")] * 3, SCHEMA)
    assert sorted(r.fn_name for r in C.pairs(df).collect()) == ["a", "d"]
