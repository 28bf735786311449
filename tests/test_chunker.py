from pyspark.sql import functions as F

from codeloom.functions import hooks
from codeloom.sources.chunker import chunk_files, parents

FILES = "unit string, lang string, content string"
PAS = """unit Foo;
uses
  Bar;

// Opens the gate and waits for it.
function TFoo.Open(a: Integer): Boolean;
begin
  Result := Wait(a);
end;

procedure Close;
begin
  if Open(1) then Wait(2);
end;
"""
PY = "import os\n\n@cached\ndef run(a):\n    return os.path.join(a, 'x') + str(a)\n\nclass A(Base, metaclass=M):\n    def go(self):\n        return 'something long enough'\n"


def chunks(spark, *files):
    return chunk_files(spark.createDataFrame(list(files), FILES), "lib")


def test_pieces_and_lines(spark):
    got = {(r.kind, r.name): r for r in chunks(spark, ("src/Foo.pas", None, PAS), ("a.py", "python", PY), ("n.go", "go", None), ("e.go", "go", "")).collect()}
    assert {k for k, r in got.items() if r.unit == "src/Foo.pas"} == {("unithead", "Foo"), ("method", "TFoo.Open"), ("method", "Close")}
    assert {k for k, r in got.items() if r.unit == "a.py"} == {("unithead", "a"), ("method", "run"), ("type", "A")}
    r = got["method", "TFoo.Open"]
    assert (r.line_start, r.line_end) == (5, 9)
    assert r.code.startswith("// Opens")
    assert got["method", "run"].code.startswith("@cached")
    assert got["type", "A"].extends_list == ["Base"]


def test_ids_survive_moved_lines_and_tell_files_and_overloads_apart(spark):
    ids = lambda *f: {(r.unit, r.name, r.code[:30]): r.id for r in chunks(spark, *f).where("kind = 'method'").collect()}
    a = ids(("a/Foo.pas", "pascal", PAS))
    assert a == ids(("a/Foo.pas", "pascal", PAS.replace("uses\n", "\n\n\nuses\n").replace("\n", "\r\n")))
    both = ids(("a/Foo.pas", "pascal", PAS), ("b/Foo.pas", "pascal", PAS))
    assert len(set(both.values())) == 4
    over = PAS + PAS[PAS.index("procedure") :].replace("Close;", "Close(a: Integer);")
    assert len(set(ids(("a/Foo.pas", "pascal", over)).values())) == 3
    assert all(0 <= x < 1 << 48 for x in both.values())


def test_huge_code_is_cut_and_its_parts_lose_nothing(spark):
    body = "procedure Big;\nbegin\n" + "".join(f"  Step{i}(x);\n" for i in range(900)) + "end;"
    got = chunks(spark, ("Big.pas", "pascal", "unit Big;\n" + body)).orderBy("part_index").collect()
    parts = [r for r in got if r.kind == "method_part"]
    assert [r.name for r in parts] == ["Big [1/3]", "Big [2/3]", "Big [3/3]"]
    assert "\n".join(r.code for r in parts) == body
    top = next(r for r in got if r.kind == "method")
    assert top.huge
    assert top.code.count("\n") == 399
    assert any("Step899" in r.code for r in parts)


def test_parents_by_language(spark):
    rows = [("pascal", "TA = class(TBase, IOne)"), ("csharp", "public class A : Base<T>, IOne\n{"), ("java", "class A extends x.Base implements I {"), ("cpp", "class A final : public B, virtual C {"), ("rust", "impl Drainer for X {"), ("go", "type A struct {"), ("javascript", "class A extends B {"), ("java", "// Doc.\nclass A<T extends Q> implements I<X>, y.J {\n  int f() {"), ("python", "class A:\n    def go(self): pass"), ("pascal", "TA = class\n  procedure Run(a: X);"), ("csharp", "class A<T> : a.B, C where T : D {"), ("rust", "impl<T> fmt::Display for X<T> {"), ("rust", "struct S {")]
    got = [r[0] for r in spark.createDataFrame(rows, "lang string, code string").select(parents(F.col("code"), F.col("lang"))).collect()]
    assert got == [["TBase", "IOne"], ["Base", "IOne"], ["Base", "I"], ["B", "C"], ["Drainer"], [], ["B"], ["I", "J"], [], [], ["B", "C"], ["Display"], []]


def test_imports_by_language(spark):
    from codeloom.sources.chunker import imports

    rows = [
        (None, "unit A;\ninterface\nuses\n  B, C.D in 'd.pas', // X,\n  E;\nimplementation\nuses F, B;"), ("python", "import os.path\nfrom a.b import c\nx = 1\nimport os"), ("javascript", "import {a} from 'm';\nimport {\n  b\n} from \"n\";\nconst c = require('o');"),
        ("typescript", "import 'side';"), ("java", "import static a.b.C;\nimport d.E;\nclass X {}"), ("c", '#include <stdio.h>\n# include "x.h"'), ("cpp", '#include "y.hpp"'), ("csharp", "using System;\nglobal using static A.B;\nusing (var x = y) {}"),
        ("go", 'import "fmt"\nimport (\n  "os"\n  f "path/file"\n)\nx := "no"'), ("rust", "use std::fmt;\nuse a;"), ("rust", "// r.rs\nrust imports:\n  P\n  Q"), ("python", None),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, "lang string, code string").select(imports(F.col("code"), F.col("lang"))).collect()]
    assert got == [["B", "C.D", "E", "F"], ["os", "a"], ["m", "n", "o"], ["side"], ["a.b.C", "d.E"], ["stdio.h", "x.h"], ["y.hpp"], ["System", "A.B"], ["fmt", "os", "path/file"], ["std", "a"], ["P", "Q"], []]


def test_docs_imports_and_parents_of_parts(spark):
    doc = '@cached\ndef run(a):\n    """Runs it   twice."""\n    return os.path.join(a, "x")\n'
    got = {(r.kind, r.name): r for r in chunks(spark, ("src/Foo.pas", None, PAS), ("b.py", "python", "import os\n\n" + doc)).collect()}
    assert got["method", "TFoo.Open"].doc == "Opens the gate and waits for it." and got["method", "run"].doc == "Runs it twice."
    assert got["unithead", "Foo"].uses_list == ["Bar"] and got["unithead", "b"].uses_list == ["os"] and got["method", "run"].uses_list is None
    big = chunks(spark, ("Big.pas", "pascal", "unit Big;\nprocedure Big;\nbegin\n" + "  Step(x);\n" * 900 + "end;")).collect()
    (whole,) = [r for r in big if r.kind == "method"]
    assert {r.parent_id for r in big if r.kind == "method_part"} == {whole.id} and whole.parent_id is None


def test_hooks(spark):
    r = spark.range(1).select(hooks.embed(F.array(F.lit("a"), F.lit("b"))).alias("v"), hooks.embed(F.array().cast("array<string>")).alias("n"), hooks.relevance_logit(F.array(F.lit("a")), F.array(F.lit("a"))).alias("l")).first()
    assert abs(sum(x * x for x in r.v) - 1) < 1e-9
    assert r.n is None
    assert r.l == 2.0
