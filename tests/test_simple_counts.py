import ast
import random

from codegauge.functions import scan

PYTHON = ["a", "b1", "x_y", "if", "else", "in", "not", "is", "def", "class", "return", "None", "True", "lambda", "self", "len", "pass", "raise", "0", "12", "(", ")", "[", "]", "{", ":", ",", "=", "==", "!=", "<<", "+", "-", "*", "/", "%", "<", ".a", "\n", "    ", "'q'", "1.5", "# c\n", "yield", "_"]
C = ["a", "b1", "if", "else", "for", "return", "int", "long", "char", "void", "static", "const", "size_t", "NULL", "0", "12", "(", ")", "[", "]", "{", "}", ",", ";", "=", "+", "-", "*", "/", "&", "<", ">", "!", "?", ":", ".", "\n", "/* c */", "// z\n", "f (", "f(int a) {\n", "'q'", "1.5", "uint8_t (", "goto"]
HEADS = ["int f(int a) {\n", "static unsigned *f2(const char *a, size_t b)\n{", "struct", "int if(int a) {", ""]


def lexed(code, language):
    seen = {"operator": {}, "operand": {}}
    for kind, value in scan._lexer(language).get_tokens(code):
        if value.strip() and (role := scan._role(kind)):
            seen[role][value] = seen[role].get(value, 0) + 1
    return seen


def test_simple_code_is_counted_as_the_lexer_does():
    rng, simple = random.Random(3), {"python": 0, "c": 0}
    for language, words in (("python", PYTHON), ("c", C)):
        for _ in range(1500):
            code = (rng.choice(HEADS) if language == "c" else "") + "".join(w + rng.choice(["", " ", " "]) for w in rng.choices(words, k=rng.randint(1, 15)))
            got = scan._simple_counts(code, language)
            if got is not None:
                simple[language] += 1
                assert got == lexed(code, language), code
    assert min(simple.values()) > 100


def test_simple_functions_do_not_go_to_the_lexer(monkeypatch):
    codes = {"python": "def f(p0, p1):\n    # note\n    def g(q):\n        return q\n    if p0:\n        x = 1\n    return 1002", "c": "int f(int p0, int p1) {\n    /* note 2 */\n    if (p0) {\n        x = 1;\n    }\n    return 1002; // end\n}"}
    want = {x: scan.functions_of(c, x) for x, c in codes.items()}  # words are looked up once each
    assert want["python"][0]["total_operands"] > 0
    monkeypatch.setattr(scan, "_lexer", None)
    assert {x: scan.functions_of(c, x) for x, c in codes.items()} == want


def test_statements_leave_out_expressions_alone():
    tree = ast.parse("class A:\n    'd'\n    def f(self, a=(lambda: 1)):\n        'd'\n        match a:\n            case 1:\n                def g():\n                    'd'\n        try:\n            pass\n        except E:\n            def h(): 'd'\n")
    assert {x.name for x in scan._statements(tree) if isinstance(x, ast.FunctionDef)} == {"f", "g", "h"}
    assert scan.without_docstrings(ast.unparse(tree)).count("'d'") == 0
    assert [r["name"] for r in scan.functions_of(ast.unparse(tree), "python")] == ["A.f", "A.f.g", "A.f.h"]
