import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from codegauge.functions import masking, scan, text

PY = "def increment(value):\n    return value + 1\n"


def one(spark, column, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols))
    return df.select(column.alias("x")).first()[0]


def test_text_functions(spark):
    code = "int x1 = a->b + 3.14; // é_名 != ok"
    want = re.findall(text.TOKEN, code)
    assert one(spark, text.tokens(F.col("c")), c=code) == want
    assert one(spark, text.lexical_set(F.col("c")), c=code) == sorted(set(want))
    assert one(spark, text.short_id(F.col("c"), 3), c="name") == "ID_" + hashlib.sha1(b"name").hexdigest()[:6]
    assert int(one(spark, text.seed_of(F.lit("2025"), F.col("c"), F.lit("java")), c="openai")) == int.from_bytes(hashlib.sha256(b"2025:openai:java").digest()[:8], "big")
    assert one(spark, text.normalized_cwes(F.col("c")), c=[" cwe-79: Cross", "CWE-20", "other ", "cwe-20"]) == ["CWE-20", "CWE-20", "CWE-79", "OTHER"]
    assert [one(spark, f(F.col("c")), c="a::b.c") for f in (text.short_name, text.container)] == ["b.c", "a"]
    assert [one(spark, f(F.col("c")), c="a.b.c") for f in (text.short_name, text.container)] == ["c", "a.b"]
    assert one(spark, text.container(F.col("c")), c="plain") is None
    assert one(spark, text.percent(F.col("c")), c=0.1234) == "12.3%"
    assert [one(spark, text.arity(F.col("c")), c=c) for c in ("", " void ", "int a", "Map<K,V> m, int b")] == [0, 0, 1, 3]
    assert one(spark, text.nonzero(F.col("k"), F.col("v")), k=["a", "b"], v=[0, 2]) == {"b": 2}
    r = one(spark, text.compiler_line(F.col("c")), c="/tmp/a.c:12:5: warning: bad thing [bugprone-x,cert-y]")
    assert tuple(r) == ("/tmp/a.c", 12, 5, "warning", "bad thing", "bugprone-x,cert-y")
    assert one(spark, text.compiler_line(F.col("c")), c="2 warnings generated.") is None


@pytest.mark.parametrize("body,want", [("return 0;", (False, True)), ("return value + 1;", (False, False)), ("", (True, False)), ("// TODO later", (True, False)), ("/* x */ throw new UnsupportedOperationException();", (True, False)), ('return "s";', (False, True))])
def test_generic_stub(spark, body, want):
    code = f"int f(int value) {{ {body} }}"
    stub, constant = text.body_stub(F.col("c"))
    assert tuple(spark.createDataFrame([(code,)], "c string").select(stub, constant).first()) == want == scan._generic_body(code)


def test_java_wrapping(spark):
    bare = "package a.b;\nimport java.util.List;\n  public static int f(int x) {\n    return x;\n  }\n"
    out = one(spark, text.wrap_java(F.col("c")), c=bare)
    assert out == "package a.b;\n\nimport java.util.List;\n\npublic class Submission {\n    public static int f(int x) {\n        return x;\n      }\n}\n"
    whole = "public class A {\n}\n"
    assert one(spark, text.wrap_java(F.col("c")), c=whole) == whole
    assert one(spark, text.java_type_name(F.col("c")), c=whole) == "A"


def test_formulas(spark):
    v, d, e = text.halstead(*(F.lit(x) for x in (4, 3, 10, 6)))
    got = spark.range(1).select(v, d, e, text.maintainability(v, F.lit(2), F.lit(5))).first()
    vol = 16 * math.log2(7)
    assert got[0] == pytest.approx(vol) and got[1] == pytest.approx(4 / 2 * (6 / 3)) and got[2] == pytest.approx(vol * 4)
    assert got[3] == pytest.approx((171 - 5.2 * math.log(vol) - 0.46 - 16.2 * math.log(5)) * 100 / 171)


def test_scanners():
    assert scan.physical_nloc("a = '''x\n# y\n'''  # c\n\n# only\nb = '#'\n", "python") == 4
    assert scan.physical_nloc('int a; /* x\n y */ char *s = "// no";\n// z\n\n', "c") == 2
    assert scan.token_count(PY, "python") == 10
    assert scan.token_count("def (", "python") == 2
    assert scan.without_docstrings('def f():\n    """d"""\n') == "def f():\n    pass"
    assert scan.without_docstrings("def (") == "def ("
    assert scan.nesting_depth("for x in y:\n    if x:\n        z()\n    else:\n        w()\n", "python") == 2
    assert scan.nesting_depth("void f() { for (int i = 0; i < 3; i++) { if (i) { g(); } else { h(); } } if (x) y(); }", "c") == 2
    n1, n2, t1, t2 = scan.halstead_counts("a = b + b", "python")
    assert (n1, n2, t1, t2) == (2, 2, 2, 3)


def test_functions_of():
    code = "class A:\n    def f(self, a=1, *b):\n        def g():\n            return a and b\n        return g\n"
    f, g = scan.functions_of(code, "python")
    assert (f["name"], f["container"], f["depth"], f["parent_index"], f["parameter_count"]) == ("A.f", "A", 0, None, 3)
    assert (g["name"], g["depth"], g["parent_index"], g["ccn"]) == ("A.f.g", 1, 0, 2)
    java = "public class B {\n  int x;\n  public int h(int a, String b) throws E {\n    if (a > 0 && x > 1) { return 1; }\n    return 2;\n  }\n}\n"
    (h,) = scan.functions_of(java, "java")
    assert (h["name"], h["start"], h["end"], h["parameter_count"], h["ccn"], h["max_nesting_depth"], h["drop_reason"]) == ("B::h", 3, 6, 2, 3, 1, None)
    assert scan.functions_of("def (", "python") == []


@pytest.mark.parametrize(
    "language,code,name,arity,want",
    [
        ("python", PY, "increment", 1, dict(parseable=True, target_present=True, arity_ok=True, stub=False, constant=False, statement_count=1)),
        ("python", "def increment(value):\n    pass\n", "increment", 1, dict(stub=True)),
        ("python", PY.replace("increment", "other"), "increment", 1, dict(target_present=False)),
        ("python", "def f(a):\n    return 3\n", "f", 2, dict(arity_ok=False, constant=True)),
        ("python", "def f(:", "f", 0, dict(parseable=False)),
        ("java", "int f(int value) { return value + 1; }", "f", 1, dict(parseable=True, arity_ok=True, stub=False, constant=False)),
        ("c", "int f(int value) { return 0; }", "f", 1, dict(constant=True, target_present=True)),
        ("c", "int f(int value) { return (", "f", 1, dict(parseable=False)),
        ("c", "", "f", 1, dict(empty=True)),
    ],
)
def test_structure(language, code, name, arity, want):
    got = scan.structure_facts(code, language, name, arity)
    assert {k: got[k] for k in want} == want


def test_signature():
    assert scan.signature_of("x = 1\nasync def f(a: int, *, b):\n    pass\n", "python") == ("async def f(a", "f", 2)
    assert scan.signature_of("/* c */ static int  g(int a,\n  char b) { return a; }", "c") == ("static int g(int a, char b)", "g", 2)
    assert scan.signature_of("int x;", "c") is None


def test_masks():
    code = "import os\nfrom a.b import c\n\nclass A:\n    def f(self, x: int) -> str:\n        y = x.z + g(1)\n        return 'q'\n"
    out = masking.masked(code, "python")
    for role in ("<SYM>", "<MOD>", "<CLASS>", "<FUNC>", "<SELF>", "<ATTR>", "<VAR>", "<NUM>", "<STR>", "<PARAM>"):
        assert role in out, role
    assert "os" not in out.split() and "class" in out and "return" in out
    java = masking.masked('import a.B;\npublic class C { @Override int f(String s) { return s.length() + 1; } }', "java")
    assert "<PKG>" in java and "<CLASS>" in java and "<ANNOT>" in java and "<METHOD>" in java and "<NUM>" in java and "<PARAM>" in java
    c = masking.masked('#include <stdio.h>\ntypedef struct node node_t;\nint f(node_t *p) { return MAX_N + p->v; }', "c")
    assert "<HEADER>" in c and "<MACRO>" in c and "<TYPE>" in c and "<ATTR>" in c and "<FUNC>" in c
    assert masking.masked("def (", "python") == "def ("
    assert masking.masked(PY, "python", "none") == PY
    assert masking.masked(PY, "python", "global-hash") == masking.masked(PY, "python", "global-hash", scope="b") != masking.masked(PY, "python", "per-file-hash", scope="b")


def test_trivia():
    assert masking.without_trivia('def f():\n    """doc"""\n    x = 1  # c\n', "python") == "def f():\n\n    x = 1\n"
    assert masking.without_trivia("/** d */ int a; // c\n/* b */ int c;", "java", keep_docs=True).split() == ["/**", "d", "*/", "int", "a;", "int", "c;"]
