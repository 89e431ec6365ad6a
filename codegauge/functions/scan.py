"""Per-sample code scanners in plain Python, and their Arrow-batched Spark form.

One pass over a batch gives all facts of a sample (`facts`), so a pipeline crosses into Python once. Python code is
read with the standard library's parser; C and Java with a tolerant scanner of their own (`_flatten`, `_spans`), so
node and function counts of C and Java are this scanner's and not any other parser's.
"""

from __future__ import annotations

import ast
import functools
import hashlib
import io
import math
import re
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

# The words that open a control structure.
CONTROL = {
    "python": {"if", "elif", "for", "while", "try", "except", "with", "match"},
    "java": {"if", "for", "while", "switch", "do", "try", "catch", "synchronized"},
    "c": {"if", "for", "while", "switch", "do", "try", "catch"},
}
_DECISIONS = re.compile(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?!\s*>)")
_STUB, _UNIMPLEMENTED, _TOKEN = re.compile(text.STUB_WORD), re.compile(text.NOT_IMPLEMENTED), re.compile(text.TOKEN)
_TRIVIA = {tokenize.ENCODING, tokenize.ENDMARKER, tokenize.INDENT, tokenize.DEDENT, tokenize.NEWLINE, tokenize.NL, tokenize.COMMENT}

# A quoted text runs to its delimiter or to the end; comments are what is left outside quotes.
_QUOTED = r"""(?P<q>%s)(?:\\.|(?!(?P=q)).)*(?:(?P=q)|\Z)"""
_LEXICAL = {
    "python": re.compile(_QUOTED % r"'''|\"\"\"|'|\"" + r"|(?P<c>\#[^\n]*)", re.S),
    "c": re.compile(_QUOTED % r"'|\"" + r"|(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))", re.S),
}
_LEXICAL["java"] = _LEXICAL["c"]


def without_comments(code: str, language: str) -> str:
    """Comments blanked, lines kept."""
    return _LEXICAL[language].sub(lambda m: "\n" * m["c"].count("\n") if m["c"] is not None else m[0], code)


def physical_nloc(code: str, language: str) -> int:
    """lines that are not blank once comments are gone."""
    return sum(bool(x.strip()) for x in without_comments(code, language).splitlines())


def token_count(code: str, language: str) -> int:
    """Python's own tokens without trivia; the token pattern elsewhere and for what Python can not read."""
    if language == "python":
        try:
            return sum(t.type not in _TRIVIA for t in tokenize.generate_tokens(io.StringIO(code).readline))
        except (SyntaxError, tokenize.TokenError):
            return len(re.findall(text.WORD_OR_SIGN, code))
    return len(_TOKEN.findall(code))


def _statements(tree: ast.AST) -> Iterator[ast.AST]:
    """The tree and what is below it but for expressions, which hold no statements."""
    todo = [tree]
    while todo:
        yield (node := todo.pop())
        todo.extend(x for x in ast.iter_child_nodes(node) if not isinstance(x, ast.expr))


def without_docstrings(code: str) -> str:
    """docstrings out, through the parser; a body left empty gets pass; code that can not be read stays."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return code
    for node in _statements(tree):
        if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and ast.get_docstring(node, clean=False) is not None:
            node.body = node.body[1:] or ([] if isinstance(node, ast.Module) else [ast.Pass(lineno=node.lineno, col_offset=node.col_offset)])
    try:
        return ast.unparse(tree)
    except (ValueError, RecursionError):
        return code


@functools.cache
def _lexer(language: str):
    from pygments.lexers import get_lexer_by_name

    return get_lexer_by_name(language)


@functools.cache
def _role(kind) -> str | None:
    """What a kind of token counts as; kinds are few."""
    from pygments.token import Token

    if kind in Token.Comment or kind in Token.Text:
        return None
    return "operator" if kind in Token.Keyword or kind in Token.Operator or kind in Token.Punctuation else "operand" if kind in Token.Name or kind in Token.Literal else None


# Names, whole numbers and signs, whose roles do not depend on what stands around them; and the words of which that is not so.
_SIMPLE = {
    "python": re.compile(r"([A-Za-z_][A-Za-z0-9_]*|(?:0|[1-9][0-9]*)(?![\w.])|==|!=|<<|>>|:=|[-~+/*%=<>&^|\[\]{}:(),;]|\.(?=[A-Za-z_]))|[ \n]+"),
    "c": re.compile(r"([A-Za-z_][A-Za-z0-9_]*|(?:0|[1-9][0-9]*)(?![\w.'])|[~!%^&*+=|?<>(){}\[\],;]|-(?![0-9])|/(?![/*]))|[ \n]+|//[^\n\\]*\n|/\*[^*\\]*\*/"),
}
_C_HEAD = re.compile(r"[A-Za-z_]\w*(?:[ *\n]+[A-Za-z_]\w*)*[ *\n]+([A-Za-z_]\w*)\([^;(){}/]*\)[ \n]*\{", re.A)  # as the lexer has it, so that it finds no function inside
_BOUND = {
    "python": {"from", "import", "match", "case", "type", "_", "yield", "async", "await", "print", "exec"},
    "c": {"case", "default", "struct", "union", "enum", "class", "namespace", "typedef", "typename", "goto", "asm"},
}


@functools.lru_cache(1 << 16)
def _word_role(word: str, language: str) -> str | None:
    """What a word, number or sign of _SIMPLE counts as; null if it depends on what stands around it."""
    if word in _BOUND[language] or word.startswith("__"):
        return None
    found = [(_role(kind), value) for kind, value in _lexer(language).get_tokens(word) if value.strip()]
    return found[0][0] if len(found) == 1 and found[0][1] == word else None


def _simple_counts(code: str, language: str) -> dict[str, dict[str, int]] | None:
    """What the lexer counts, of code that is made of _SIMPLE alone; null for any other."""
    simple, seen, at, last, depth = _SIMPLE.get(language), {"operator": {}, "operand": {}}, 0, "", 0
    if simple is None or not code.isascii():
        return None
    if language == "c" and ((head := _C_HEAD.match(code)) is None or _word_role(head[1], language) != "operand"):
        return None
    for m in simple.finditer(code):
        if m.start() != at:
            return None
        at = m.end()
        if (value := m[1]) is not None:
            role = "operand" if value.isdigit() else _word_role(value, language)
            if role is None or (last in ("def", "class") and (role == "operator" or value.isdigit())) or (last == "}" and depth == 0 and language == "c"):
                return None  # no name where the lexer looks for one, or more than a function
            depth += (value == "{") - (value == "}")
            seen[role][value] = seen[role].get(value, 0) + 1
            last = value
    return seen if at == len(code) else None


def halstead_counts(code: str, language: str) -> tuple[int, int, int, int]:
    """distinct and total operators and operands. Keywords, operators and punctuation are operators.

    The lexer tries hundreds of patterns at each place, so code of simple words and signs is counted by one pattern; any other goes to the lexer.
    """
    seen = _simple_counts(code, language)
    if seen is None:
        seen = {"operator": {}, "operand": {}}
        for kind, value in _lexer(language).get_tokens(code):
            if value.strip() and (role := _role(kind)):
                seen[role][value] = seen[role].get(value, 0) + 1
    a, b = seen["operator"], seen["operand"]
    return len(a), len(b), sum(a.values()), sum(b.values())


def nesting_depth(code: str, language: str) -> int:
    """deepest control structure. In C and Java by braces that a control word opened; in Python by indents under a control header."""
    if language != "python":
        flat, depth, opened = _flatten(code, language), [0], []
        while (bare := re.sub(r"\([^()]*\)", " ", flat)) != flat:  # what stands in parentheses ends no statement
            flat = bare
        for before, brace in re.findall(r"([^{}]*)([{}])", flat):
            if brace == "{":
                opened.append(bool(CONTROL[language].intersection(re.findall(r"\w+", before.rpartition(";")[2]))))
                depth.append(sum(opened))
            elif opened:
                opened.pop()
        return max(depth)
    depth = deepest = 0
    header, ended, last = set(), False, ""
    try:
        for t in tokenize.generate_tokens(io.StringIO(code).readline):
            if t.type == tokenize.INDENT:
                depth += last == ":" and not CONTROL["python"].isdisjoint(header)
                deepest = max(deepest, depth)
            elif t.type == tokenize.DEDENT:
                depth = max(0, depth - 1)  # whatever the indent stood under
            elif t.type == tokenize.NEWLINE:
                ended = True
            elif t.type not in _TRIVIA:
                header = set() if ended else header
                header.add(t.string)
                ended, last = False, t.string
    except (SyntaxError, tokenize.TokenError):
        return 0
    return deepest


def _flatten(code: str, language: str) -> str:
    """Same length: comments and quoted texts blanked."""
    return _LEXICAL[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


_HEAD = re.compile(r"([A-Za-z_~][\w:~.]*)\s*(\([^(){};]*(?:\([^(){};]*\)[^(){};]*)*\))\s*(?:const\s*|throws\s+[\w.,\s]+|__attribute__\s*\(\([^)]*\)\)\s*)*\{")
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "synchronized", "return", "sizeof", "else", "do", "try", "new"}
_TYPE = re.compile(r"\b(?:class|interface|enum|record|struct|namespace)\s+([A-Za-z_]\w*)[^;{}()]*\{")


def _close(flat: str, at: int) -> int:
    """Where the brace that opens at `at` closes; the end if it does not."""
    depth = 0
    for m in re.finditer(r"[{}]", flat[at:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return at + m.end()
    return len(flat)


def _spans(code: str, language: str) -> list[tuple[str, str, int, int]]:
    """(qualified name, parameters, start, end) in characters of each C or Java function definition."""
    flat = _flatten(code, language)
    types = [(m[1], m.end() - 1, _close(flat, m.end() - 1)) for m in _TYPE.finditer(flat)]
    out = []
    for m in _HEAD.finditer(flat):
        if m[1] in _NOT_NAMES or re.search(r"\bnew\s+$", flat[: m.start()][-40:]):
            continue
        start = max(flat.rfind(x, 0, m.start()) for x in ";{}")
        start = start + 1 + len(flat[start + 1 :]) - len(flat[start + 1 :].lstrip())
        inside = [n for n, a, b in types if a < m.start() < b]
        out.append(("::".join([*inside, m[1]]), m[2][1:-1].strip(), start, _close(flat, m.end() - 1)))
    return out


def _count_parameters(p: str) -> int:
    return 0 if p in ("", "void") else p.count(",") + 1


_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)


def functions_of(code: str, language: str) -> list[dict]:
    """One record for each function, in order of appearance, with metrics or why it is left out."""
    lines = code.splitlines()
    found: list[tuple[str, int, int, int, int, str]] = []  # name, parameters, first and last line, decisions, source
    if language == "python":
        try:
            tree = ast.parse(code)
        except (SyntaxError, ValueError, RecursionError):
            return []

        def visit(node: ast.AST, inside: tuple[str, ...]) -> None:
            for x in ast.iter_child_nodes(node):
                if isinstance(x, (ast.expr, ast.expr_context)):  # no function stands in an expression
                    continue
                if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    a = x.args
                    n = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
                    source = "\n".join(lines[x.lineno - 1 : x.end_lineno])
                    hits = sum(len(y.values) - 1 if isinstance(y, ast.BoolOp) else isinstance(y, _BRANCHES) for y in ast.walk(x))
                    found.append((".".join((*inside, x.name)), n, x.lineno, x.end_lineno, hits, source))
                visit(x, (*inside, x.name) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else inside)

        visit(tree, ())
    else:
        flat = _flatten(code, language)
        for name, params, a, b in _spans(code, language):
            found.append((name, _count_parameters(params), code.count("\n", 0, a) + 1, code.count("\n", 0, max(a, b - 1)) + 1, len(_DECISIONS.findall(flat[a:b])), code[a:b]))
    order = {i: k for k, i in enumerate(sorted(range(len(found)), key=lambda i: (found[i][2], found[i][3], i)))}
    out = []
    for i, (name, n_params, first, last, hits, source) in enumerate(found):
        around = [(b - a, j) for j, (_, _, a, b, _, _) in enumerate(found) if a <= first and last <= b and (a, b) != (first, last)]
        valid = 1 <= first <= last <= len(lines)
        record = {"function_index": i, "source_order": order[i], "name": name, "container": re.sub(r"(?:::|\.)?[^:.]*$", "", name) or None, "start": first, "end": last}
        record |= {"parent_index": min(around)[1] if around else None, "depth": len(around), "sha256": hashlib.sha256(source.encode()).hexdigest()}
        metrics: dict[str, float | None] = {}
        if valid:
            body = without_docstrings(_dedent(source)) if language == "python" else source
            n1, n2, t1, t2 = halstead_counts(body, language)
            nloc = physical_nloc(source, language)
            volume = (t1 + t2) * math.log2(n1 + n2) if n1 + n2 else 0.0
            difficulty = n1 / 2 * (t2 / n2) if n2 else 0.0
            index = max(0.0, (171 - 5.2 * math.log(max(volume, 1.0)) - 0.23 * (hits + 1) - 16.2 * math.log(max(nloc, 1))) * 100 / 171)
            metrics = {
                "nloc": nloc, "ccn": hits + 1, "parameter_count": n_params, "max_nesting_depth": nesting_depth(body, language), "distinct_operators": n1, "distinct_operands": n2,
                "total_operators": t1, "total_operands": t2, "halstead_volume": volume, "halstead_difficulty": difficulty, "halstead_effort": volume * difficulty, "maintainability_index": index,
            }
        why = "invalid_source_span" if not valid else "nonpositive_nloc" if metrics["nloc"] <= 0 else "no_operators" if not metrics["distinct_operators"] else "no_operands" if not metrics["distinct_operands"] else None
        out.append(record | {"drop_reason": why} | {k: None if v is None else float(v) for k, v in metrics.items()})
    return out


def _dedent(source: str) -> str:
    import textwrap

    return textwrap.dedent(source)


def signature_of(code: str, language: str) -> tuple[str, str, int] | None:
    """(text, name, arity) of the first function; null if there is none. Python's text ends at the first colon."""
    if language == "python":
        try:
            nodes = [x for x in ast.walk(ast.parse(code)) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
        except (SyntaxError, ValueError, RecursionError):
            return None
        if not nodes:
            return None
        x = min(nodes, key=lambda x: (x.lineno, x.col_offset))
        word = "async def" if isinstance(x, ast.AsyncFunctionDef) else "def"
        head = (ast.get_source_segment(code, x) or "").partition(":")[0].strip()
        return head if head.startswith(word) else f"{word} {x.name}(...)", x.name, _python_arity(x)
    spans = _spans(code, language)
    if not spans:
        return None
    name, params, a, b = min(spans, key=lambda s: (s[2], s[3]))
    return " ".join(code[a : code.index("{", a)].split()), name.rpartition("::")[2].rpartition(".")[2], _count_parameters(params)


def _python_arity(x: ast.FunctionDef | ast.AsyncFunctionDef) -> int:
    return len(x.args.posonlyargs) + len(x.args.args) + len(x.args.kwonlyargs)


def _python_body(x, code: str) -> tuple[bool, bool]:
    """(stub, constant only) of a Python function."""
    match x.body:
        case [ast.Pass()]:
            return True, False
        case [ast.Expr(value=ast.Constant(value=v))] if v is ... or isinstance(v, str) and _STUB.search(v):
            return True, False
        case [ast.Raise() as error] if _UNIMPLEMENTED.search(ast.unparse(error)):
            return True, False
        case [ast.Return(value=None | ast.Constant())]:
            return False, True
    return len(x.body) <= 2 and bool(_STUB.search(ast.get_source_segment(code, x) or "")), False


def _generic_body(source: str) -> tuple[bool, bool]:
    """the same of a C or Java function's text."""
    m = re.search(r"\{(.*)\}\s*$", source, re.S)
    bare = re.sub(text.MASK_COMMENT, "", m[1].strip() if m else "").strip()
    if not bare or _STUB.search(bare) or _UNIMPLEMENTED.search(bare):
        return True, False
    return False, bool(re.match(text.CONSTANT_RETURN, bare))


def structure_facts(code: str | None, language: str, name: str, arity: int | None) -> dict:
    """what the status cascade needs to know of a sample. An exception of the parser is a fact too."""
    code = code or ""
    facts = {"parseable": False, "target_present": False, "arity_ok": False, "stub": False, "constant": False, "token_count": 0, "ast_node_count": 0, "statement_count": 0, "failure": None, "empty": not code.strip()}
    if facts["empty"]:
        return facts
    facts["token_count"] = token_count(code, language)
    if language == "python":
        try:
            tree = ast.parse(code)
            same = [x for x in ast.walk(tree) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) and x.name == name]
            exact = [x for x in same if _python_arity(x) == arity]
            facts |= {"parseable": True, "target_present": bool(same), "arity_ok": bool(exact)}
            if same:
                x = (exact or same)[0]
                nodes = list(ast.walk(x))
                stub, constant = _python_body(x, code)
                facts |= {"ast_node_count": len(nodes), "statement_count": sum(isinstance(y, ast.stmt) for y in nodes) - 1, "stub": stub, "constant": constant}
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            facts["failure"] = str(e)
        return facts
    flat = _flatten(code, language)
    facts["parseable"] = _balanced(flat)
    same = [s for s in _spans(code, language) if s[0].rpartition("::")[2].rpartition(".")[2] == name]
    exact = [s for s in same if arity is None or _count_parameters(s[1]) == arity]
    facts |= {"target_present": bool(same), "arity_ok": bool(exact)}
    if same:
        _, _, a, b = (exact or same)[0]
        stub, constant = _generic_body(code[a:b])
        # A node for each token; a statement for each semicolon outside parentheses and each control word.
        facts |= {"ast_node_count": len(_TOKEN.findall(flat[a:b])), "statement_count": len(re.findall(r";(?![^(]*\))", flat[a:b])) + len(re.findall(r"\b(?:if|for|while|switch|do|try)\b", flat[a:b])), "stub": stub, "constant": constant}
    return facts


def _balanced(flat: str) -> bool:
    stack = []
    for c in re.findall(r"[(){}\[\]]", flat):
        if c in "({[":
            stack.append(c)
        elif not stack or stack.pop() + c not in ("()", "{}", "[]"):
            return False
    return not stack


def nloc(code: Column, language: str) -> Column:
    """F17 as a Column, Arrow-batched."""

    @F.pandas_udf("long")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda c: None if c is None else physical_nloc(c, language)).astype("Int64")

    return run(code)


def sample_nloc(rows: DataFrame, language: str, code: str = "code", name: str = "sample_nloc") -> DataFrame:
    """Rows with the physical lines of their code, which must be some: none raises."""
    n = nloc(F.col(code), language)
    return rows.withColumn(name, n).withColumn(name, F.when(F.col(name) > 0, F.col(name)).otherwise(F.raise_error(F.lit("a sample without lines of code"))))


RECORD = (
    "function_uid string, function_index int, source_order int, short_name string, name string, container string, `start` int, `end` int, parent_index int, parent_uid string, depth int, sha256 string, "
    "drop_reason string, detected int, computable int, nloc double, ccn double, parameter_count double, max_nesting_depth double, distinct_operators double, distinct_operands double, total_operators double, total_operands double, "
    "halstead_volume double, halstead_difficulty double, halstead_effort double, maintainability_index double"
)


_RECORD_NAMES = [c.split()[0].strip("`") for c in RECORD.split(", ")]


class _Functions:
    """The table function behind `function_records`."""

    def eval(self, row_id: str, field: str, language: str, code: str):
        found = functions_of(code or "", language)
        uid = lambda i: None if i is None else f"{row_id}:{field}:{i}"
        extra = {"detected": len(found), "computable": sum(r["drop_reason"] is None for r in found)}
        for r in found:
            r = r | extra | {"function_uid": uid(r["function_index"]), "parent_uid": uid(r["parent_index"]), "short_name": re.split(r"::|\.", r["name"])[-1]}
            yield tuple(map(r.get, _RECORD_NAMES))


def function_records(samples: DataFrame, row_id: str = "row_id") -> DataFrame:
    """A row for each function of samples (row_id, field, language, code), beside its sample's columns.

    A lateral table function: functions come out as rows, not as an array that is exploded. function_uid is row_id:field:index and
    parent_uid that of the smallest span that holds the function's; function_index is the scanner's order, source_order that of the text. Functions
    that can not be measured have a drop_reason and no figures. Samples without functions give no row.
    """
    table = F.udtf(_Functions, returnType=RECORD, useArrow=False)  # with Arrow each sample would be a batch of its own
    c = lambda n: F.col(n).outer()
    return samples.lateralJoin(table(c(row_id).cast("string"), c("field"), c("language"), c("code")))


def sample_summary(records: DataFrame, keys: list[str]) -> DataFrame:
    """Of each sample's functions: counts, and the uids and names in the scanner's order. A sample's functions are few."""
    nested = F.col("parent_uid").isNotNull()
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("function_index", c))), lambda x: x[c])
    return records.groupBy(*keys).agg(
        F.count("*").alias("function_count_detected"), F.count_if(F.col("drop_reason").isNull()).alias("function_count_computable"), F.count_if(F.col("drop_reason").isNotNull()).alias("function_count_dropped"),
        F.count_if(nested).alias("function_count_nested"), F.count_if(~nested).alias("function_count_outermost"), listed("function_uid").alias("function_uids"), listed("name").alias("function_names"),
    )


_FACTS = "parseable boolean, target_present boolean, arity_ok boolean, stub boolean, constant boolean, token_count long, ast_node_count long, statement_count long, failure string, empty boolean"


def with_facts(samples: DataFrame, key: str = "task_id", functions: bool = True) -> DataFrame:
    """F44 and F29 in one pass: samples (key, language, code, name, arity) to key, facts, functions; without functions these are not looked for, and null."""
    from .. import schemas

    fields = [f.name for f in schemas.FUNCTION.fields]
    names = [x.split()[0] for x in _FACTS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, language, code, name, arity in pdf.itertuples(index=False):
                f = structure_facts(code, language, name, None if arity is None or arity != arity else int(arity))
                rows.append((k, [f[n] for n in names], [{n: r.get(n) for n in fields} for r in functions_of(code or "", language)] if functions else None))
            yield pd.DataFrame({key: [r[0] for r in rows], "facts": [dict(zip(names, r[1])) for r in rows], "functions": [r[2] for r in rows]})

    schema = f"{key} {samples.schema[key].dataType.simpleString()}, facts struct<{_FACTS.replace(' ', ':').replace(',:', ',')}>, functions array<{schemas.FUNCTION.simpleString()}>"
    return samples.select(key, "language", "code", "name", "arity").mapInPandas(run, schema)
