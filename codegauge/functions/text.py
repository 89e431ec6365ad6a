"""Text functions as Column expressions: no Python on the executors.

`unicode=True` makes \\w and \\d mean what they mean in Python; without it they are ASCII, as in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what counts as a token of code.
TOKEN = r"[A-Za-z_]\w*|\d+(?:\.\d+)?|==|!=|<=|>=|&&|\|\||->|[^\s]"
WORD_OR_SIGN = r"\w+|[^\s\w]"
# What marks a stub in C and Java bodies.
STUB_WORD = r"(?i)\b(?:todo|fixme|implementation\s+goes\s+here)\b"
NOT_IMPLEMENTED = r"(?i)(?:NotImplementedError|UnsupportedOperationException|not\s+implemented)"
CONSTANT_RETURN = r'^return\s+(?:null|NULL|nullptr|true|false|-?\d+(?:\.\d+)?|"[^"]*")\s*;$'
MASK_COMMENT = r"(?ms)//.*?$|/\*.*?\*/"


def tokens(c: Column, unicode: bool = True) -> Column:
    """names, numbers, two-sign operators and single other non-space characters."""
    return F.regexp_extract_all(c, F.lit(("(?U)" if unicode else "") + f"({TOKEN})"), F.lit(1))


def split_words(c: Column, how: str = "regex") -> Column:
    """tokens for language models: between white space, or words and single other signs."""
    if how == "whitespace":
        return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")
    return F.regexp_extract_all(c, F.lit(f"(?U)({WORD_OR_SIGN})"), F.lit(1))


def lexical_set(c: Column, unicode: bool = True) -> Column:
    """distinct tokens in code point order."""
    return F.array_sort(F.array_distinct(tokens(c, unicode)))


def sha256(c: Column) -> Column:
    """F1."""
    return F.sha2(c.cast("binary"), 256)


def short_id(c: Column, n: int = 4) -> Column:
    """ID_ and the first 2n hex digits of the SHA-1."""
    return F.concat(F.lit("ID_"), F.substring(F.sha1(c.cast("binary")), 1, 2 * n))


def seed_of(*parts: Column) -> Column:
    """first 8 bytes of the SHA-256 of the parts joined by ":", big-endian, as decimal(20, 0)."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def normalized_cwes(labels: Column) -> Column:
    """trimmed, upper-cased, cut to the leading CWE-<n> where there is one; sorted, repeats kept."""
    def one(x: Column) -> Column:
        t = F.upper(F.trim(x))
        n = F.regexp_extract(t, r"^(CWE-\d+)", 1)
        return F.when(n != "", n).otherwise(t)

    return F.array_sort(F.transform(labels, one))


def prompt(language: Column, docstring: Column, signature: Column) -> Column:
    """F8: what a model is asked (fixed wording)."""
    head = F.lit(" function. Return code only. Preserve the required function name and parameters.\n\nSignature:\n")
    return F.concat(F.lit("Implement the following "), language, head, signature, F.lit("\n\nSpecification:\n"), F.trim(docstring))


def content_hash(signature: Column, docstring: Column, code: Column) -> Column:
    """F9."""
    return F.sha2(F.concat(signature, F.lit("\n"), docstring, F.lit("\n"), code).cast("binary"), 256)


def task_id(language: Column, source_id: Column) -> Column:
    """F10."""
    return F.concat(language, F.lit(":"), source_id)


def short_name(name: Column) -> Column:
    """the innermost name: after the last "::", else after the last "."."""
    return F.when(name.contains("::"), F.substring_index(name, "::", -1)).otherwise(F.substring_index(name, ".", -1))


def container(name: Column) -> Column:
    """what stands before the innermost name; null at the top."""
    sep = F.when(name.contains("::"), F.lit("::")).when(name.contains("."), F.lit("."))
    return F.when(sep.isNotNull(), F.substring(name, F.lit(1), F.length(name) - F.length(short_name(name)) - F.length(sep)))


def java_file_base(name: Column) -> Column:
    """F12."""
    return F.regexp_replace(name, r"[^A-Za-z0-9_]", "_")


_PACKAGE, _IMPORT = r"(?m)^\s*package\s+[^\n;]+;", r"(?m)^\s*import\s+[^\n;]+;"


def java_body(code: Column) -> Column:
    """without package and import lines."""
    for line in (_PACKAGE, _IMPORT):
        code = F.regexp_replace(code, line + r"\n?", "")
    return F.regexp_replace(code, r"^\s+|\s+$", "")


def java_type_name(code: Column) -> Column:
    """the first public class, interface or enum; null if none."""
    n = F.regexp_extract(code, r"public\s+(?:class|interface|enum)\s+(\w+)", 1)
    return F.when(n != "", n)


def has_orphan_methods(code: Column) -> Column:
    """a line starts with what looks like a method header."""
    modifiers, head, throws = r"(?:public|protected|private)?\s+(?:static\s+)?", r"[\w<>\[\]]+\s+\w+\s*\([^;]*\)\s*", r"(?:throws\s+[\w, ]+)?\s*\{"
    return code.rlike(r"(?m)^\s*" + modifiers + head + throws)


def wrap_java(code: Column, name: str = "Submission") -> Column:
    """F16: code with orphan methods or no public class goes into a class; package and imports stay in front."""
    body = java_body(code)
    package = F.trim(F.regexp_extract(code, _PACKAGE, 0))
    imports = F.array_join(F.regexp_extract_all(code, F.lit(_IMPORT), F.lit(0)), "\n")
    whole = body.rlike(r"(?m)^\s*public\s+class\s+\w+") & ~has_orphan_methods(body)
    wrapped = F.concat(F.lit(f"public class {name} {{\n"), F.regexp_replace(body, r"(?m)^", "    "), F.lit("\n}"))
    parts = F.filter(F.array(package, imports, F.when(whole, body).otherwise(wrapped)), lambda p: p != "")
    return F.concat(F.regexp_replace(F.array_join(parts, "\n\n"), r"^\s+|\s+$", ""), F.lit("\n"))


def arity(parameters: Column) -> Column:
    """commas plus one; none for an empty list or void."""
    p = F.trim(parameters)
    return F.when((p == "") | (p == "void"), 0).otherwise(F.size(F.split(p, ",")))


def body_stub(text: Column) -> tuple[Column, Column]:
    """(stub, constant only) of a C or Java function's text."""
    body = F.trim(F.regexp_extract(text, r"(?s)\{(.*)\}\s*$", 1))
    bare = F.trim(F.regexp_replace(body, MASK_COMMENT, ""))
    empty = F.coalesce(text, F.lit("")) == ""
    stub = ~empty & ((bare == "") | bare.rlike(STUB_WORD) | bare.rlike(NOT_IMPLEMENTED))
    return stub, ~empty & ~stub & bare.rlike(CONSTANT_RETURN)


def percent(c: Column, digits: int = 1) -> Column:
    """F32: 12.3%, an em dash for null."""
    return F.when(c.isNotNull(), F.concat(F.format_string(f"%.{digits}f", c * 100), F.lit("%"))).otherwise("—")


#: Fixed value: path:line:column: severity: message [check].
COMPILER_LINE = r"^(.*?):(\d+):(\d+):\s+(\w+):\s+(.*?)\s+\[([^\]]+)\]\s*$"


def compiler_line(c: Column) -> Column:
    """the six parts of a diagnostic line; null where the line is none."""
    names = ("path", "line", "column", "severity", "message", "check")
    parts = [F.regexp_extract(c, COMPILER_LINE, i + 1) for i in range(6)]
    cast = [p.try_cast("int") if n in ("line", "column") else p for n, p in zip(names, parts)]
    return F.when(c.rlike(COMPILER_LINE), F.struct(*[p.alias(n) for n, p in zip(names, cast)]))


def nonzero(keys: Column, values: Column) -> Column:
    """a map without its zeros."""
    return F.map_filter(F.map_from_arrays(keys, values), lambda _, v: v > 0)


def json_path(c: Column, path: str, default: str | None = None) -> Column:
    """F43."""
    return F.coalesce(F.get_json_object(c, path), F.lit(default))


def maintainability(volume: Column, ccn: Column, nloc: Column) -> Column:
    """0 to 100; volume and lines count as 1 at least."""
    v, n = F.greatest(volume.cast("double"), F.lit(1.0)), F.greatest(nloc.cast("double"), F.lit(1.0))
    return F.greatest(F.lit(0.0), (171 - 5.2 * F.ln(v) - 0.23 * ccn - 16.2 * F.ln(n)) * 100 / 171)


def halstead(n1: Column, n2: Column, t1: Column, t2: Column) -> tuple[Column, Column, Column]:
    """(volume, difficulty, effort) from distinct (n) and total (t) operators (1) and operands (2)."""
    volume = F.when(n1 + n2 > 0, (t1 + t2) * F.log2((n1 + n2).cast("double"))).otherwise(0.0)
    difficulty = F.when(n2 > 0, n1 / 2.0 * (t2 / n2)).otherwise(0.0)
    return volume, difficulty, volume * difficulty


def field_spec(spec: str, languages: tuple[str, ...] = ("python", "java", "c")) -> tuple[str, str]:
    """"field:language" to its two parts, the language in lower case; another form or language raises."""
    field, colon, language = (x.strip() for x in spec.partition(":"))
    if not colon or language.lower() not in languages:
        raise ValueError(f"not field:language with a language of {', '.join(sorted(languages))}: {spec!r}")
    return field, language.lower()
