import pytest

from codegauge.functions import masking

C = [
    ("int add(int a, node_t b) { return a + b; }", "int <FUNC>(int <PARAM>, <TYPE> <PARAM>) { return <VAR> + <VAR>; }"),
    ("#include <sys/stat.h>\n#include \"my.h\"\nint x;", "#include <<HEADER>/<HEADER>.<HEADER>>\n#include \"<HEADER>.<HEADER>\"\nint <VAR>;"),
    ("#define limit 10\n#ifdef limit\n#endif\nint y = limit;", "#define <MACRO> <NUM>\n#ifdef <MACRO>\n#endif\nint <VAR> = <VAR>;"),
    ("struct node { int v; };\nstruct node *head; node other;", "struct <TYPE> { int <VAR>; };\nstruct <TYPE> *<VAR>; <TYPE> <VAR>;"),
    ("typedef unsigned long size_type, *size_ptr;\nsize_type n; size_ptr p;", "typedef unsigned long <TYPE>, *<TYPE>;\n<TYPE> <VAR>; <TYPE> <VAR>;"),
    ("typedef struct pair { int a, b; } pair_t;\npair_t p = q->left.right;", "typedef struct <TYPE> { int <VAR>, <VAR>; } <TYPE>;\n<TYPE> <VAR> = <VAR>-><ATTR>.<ATTR>;"),
    ("call(first second, x->y, \"s\", 'c', 0x1F, inner(deep, 2));", "<FUNC>(<TYPE> <PARAM>, <PARAM>-><ATTR>, <STR>, <STR>, <NUM>, <TYPE>(<PARAM>, <NUM>));"),
    ("x = 1+y;", "<VAR> = <NUM><VAR>;"),
    ("std::list l; f(", "<TYPE>::<TYPE> <VAR>; <FUNC>("),
    ("const char *s = \"a \\\" b\"; size_t n = sizeof(s);", "const char *<VAR> = <STR>; <VAR> <VAR> = sizeof(<VAR>);"),
    ("", ""),
]


@pytest.mark.parametrize("code,want", C)
def test_roles_of_c(code, want):
    assert masking.masked(code, "c") == want


def test_names_alone():
    code = "int f(char *s) { return 0xFF + s[\"x\"]; }"
    assert masking.masked(code, "c", "placeholder") == "int <ID>(char *<ID>) { return 0<ID> + <ID>[\"x\"]; }"
    h = masking.short_hash
    assert masking.masked("a + int_b", "c", "global-hash") == f"{h('a', 3)} + {h('int_b', 3)}" and h("a", 3) == "ID_86f7e4"
    assert masking.masked("class A { int b$; }", "java", "placeholder") == "class <ID> { int <ID>; }"
    assert masking.masked(code, "c", "none") == code


JAVA = [
    ("package a.b;\nimport java.util.List;\nimport static a.B.c;\nimport x.y.*;", "package <PKG>.<PKG>;\nimport <PKG>.<PKG>.<SYM>;\nimport static <PKG>.<PKG>.<SYM>;\nimport <PKG>.<PKG>.*;"),
    ("public class Box<T extends Item> { T value; }", "public class <CLASS><<TYPE> <TYPE> <TYPE>> { <TYPE> <VAR>; }"),
    ("@Override public int size(List<String> all, int n) { return all.size() + n; }", "@<ANNOT> public int <METHOD>(<TYPE><<TYPE>> <PARAM>, int <PARAM>) { return <VAR>.<ATTR>() + <VAR>; }"),
    ("Map<String, Integer> m = new a.HashMap<>(); x = new Foo(y);", "<TYPE><<TYPE>, <TYPE>> <VAR> = new <TYPE>.<TYPE><>(); <VAR> = new <TYPE>(<VAR>);"),
    ("run(x -> x.go(1), \"s\", 'c', Other.NAME);", "<METHOD>(<PARAM> -> <PARAM>.<PARAM>(<NUM>), <STR>, <STR>, <TYPE>.<TYPE>);"),
    ("@a.b.Test int x = 0x1F; String s = \"\"\"\n a \\\"\"\" b\"\"\";", "@<ANNOT>.<ANNOT>.<ANNOT> int <VAR> = <NUM>; <TYPE> <VAR> = <STR>;"),
    ("if (a < b) c = d;", "if (<TYPE> < <TYPE>) <TYPE> = <TYPE>;"),
    ("enum Color { RED }", "enum <CLASS> { <TYPE> }"), ("f(", "<METHOD>("), ("", ""),
]


@pytest.mark.parametrize("code,want", JAVA)
def test_roles_of_java(code, want):
    assert masking.masked(code, "java") == want
