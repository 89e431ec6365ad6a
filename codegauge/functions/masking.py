"""Comment and docstring removal, and identifiers masked by role.

`masked(code, language)` replaces each identifier by its role, so that language models see structure alone. Keywords,
builtins and punctuation stay. Roles come from one left-to-right pass over significant tokens.
"""

from __future__ import annotations

import ast
import bisect
import builtins
import hashlib
import io
import keyword
import re
import tokenize

from . import scan

_KEEP = set(keyword.kwlist) | set(dir(builtins))
# Words of C and Java that are no identifiers.
_WORDS = {
    "java": set("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while var record sealed permits non yield true false null".split()),
    "c": set("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Alignas _Alignof _Atomic _Bool _Complex _Generic _Imaginary _Noreturn _Static_assert _Thread_local".split()),
}


def short_hash(name: str, n: int = 4) -> str:
    """F2."""
    return "ID_" + hashlib.sha1(name.encode()).hexdigest()[: 2 * n]


def without_trivia(code: str, language: str, keep_docs: bool = False) -> str:
    """without comments; with keep_docs, documentation comments (/** */) and docstrings stay."""
    if language != "python":
        keep = re.compile(r"/\*\*(?!/)")
        return scan._LEXICAL[language].sub(lambda m: m[0] if m["c"] is None or keep_docs and keep.match(m[0]) else " " + "\n" * m[0].count("\n"), code)
    try:
        tokens = list(tokenize.generate_tokens(io.StringIO(code).readline))
        tree = ast.parse(code)
    except (SyntaxError, ValueError, tokenize.TokenError, RecursionError):
        return code
    lines = code.splitlines(keepends=True)
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x))
    gone = [(starts[t.start[0] - 1] + t.start[1], starts[t.end[0] - 1] + t.end[1]) for t in tokens if t.type == tokenize.COMMENT]
    if not keep_docs:
        for node in ast.walk(tree):
            if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and ast.get_docstring(node, clean=False) is not None:
                d = node.body[0].value
                at = lambda line, byte: starts[line - 1] + len(lines[line - 1].encode()[:byte].decode(errors="ignore"))
                gone.append((at(d.lineno, d.col_offset), at(d.end_lineno, d.end_col_offset)))
    for a, b in sorted(gone, reverse=True):
        code = code[:a] + code[b:]
    return "\n".join(x.rstrip() for x in code.split("\n"))


def _mask_python(code: str, legacy: bool) -> str:
    """legacy keeps two habits of published data: imported names go on to the next `from`, and call arguments are parameters.

    Regions are found first (imports, signatures, annotations); a name then gets the first role that claims it.
    """
    try:
        tokens = list(tokenize.generate_tokens(io.StringIO(code).readline))
    except (SyntaxError, tokenize.TokenError):
        return code
    at = [i for i, t in enumerate(tokens) if t.type not in scan._TRIVIA]
    word, kind, line = [tokens[i].string for i in at], [tokens[i].type for i in at], []
    ends = [i for i, t in enumerate(tokens) if t.type == tokenize.NEWLINE]
    for i in at:
        line.append(bisect.bisect(ends, i))
    closes, opens = {}, []
    for p, w in enumerate(word):
        if kind[p] == tokenize.OP and w == "(":
            opens.append(p)
        elif kind[p] == tokenize.OP and w == ")" and opens:
            closes[opens.pop()] = p
    names = [p for p, w in enumerate(word) if kind[p] == tokenize.NAME and w not in _KEEP]
    until = lambda p, stop: next((q for q in range(p + 1, len(word)) if stop(q)), len(word))
    claims: dict[str, set[int]] = {r: set() for r in ("<FUNC>", "<CLASS>", "<MOD>", "<SYM>", "<TYPE>", "<SELF>", "<CLS>", "<ATTR>", "<PARAM>")}
    covered = -1
    for p, w in enumerate(word):
        if w in ("def", "class"):
            claims["<FUNC>" if w == "def" else "<CLASS>"].add(p + 1)
        elif w == "from":
            claims["<MOD>"].update(range(p, until(p, lambda q: word[q] == "import" or not legacy and line[q] != line[p])))
        elif w == "import":
            claims["<SYM>"].update(range(p, until(p, lambda q: word[q] == "from" if legacy else line[q] != line[p])))
        elif w in ("self", "cls"):
            claims[f"<{w.upper()}>"].add(p)
        elif w == ".":
            claims["<ATTR>"].add(p + 1)
        elif w == "->":
            claims["<TYPE>"].update(range(p, until(p, lambda q: word[q] == ":")))
        elif p in closes and p > covered and p > 0 and kind[p - 1] == tokenize.NAME and (legacy or p > 1 and word[p - 2] == "def"):
            covered = closes[p]
            claims["<PARAM>"].update(range(p, covered))
            for q in range(p, covered):
                if word[q] == ":":
                    claims["<TYPE>"].update(range(q, min(covered, until(q, lambda r: word[r] in (",", "=", ")")))))
    roles = {p: "<NUM>" if kind[p] == tokenize.NUMBER else "<STR>" for p in range(len(word)) if kind[p] in (tokenize.NUMBER, tokenize.STRING)}
    for p in names:
        called = p + 1 < len(word) and word[p + 1] == "("
        roles[p] = next((r for r, where in claims.items() if p in where), "<FUNC>" if called else "<VAR>")
    for p, r in roles.items():
        tokens[at[p]] = tokens[at[p]]._replace(string=r)
    try:
        return tokenize.untokenize(tokens)
    except ValueError:
        return code


_GENERIC = re.compile(r"""(?P<inc>(?m:^)[ \t]*\#[ \t]*include[^\n]*)|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<num>\b\d[\w.]*)|(?P<id>[A-Za-z_]\w*)|(?P<sp>\s+)|(?P<op>.)""", re.S)


# Literals of Java, numerals with what they go on with in masked data.
_JAVA_TOKEN = re.compile(r'''(?P<str>"""(?:\\.|(?!""").)*(?:"""|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z))|(?P<num>[0-9][0-9._xXbBeEfFdDlL]*)|(?P<id>[A-Za-z_$][\w$]*)|(?P<sp>\s+)|(?P<op>.)''', re.S | re.A)


def _mask_java(code: str) -> str:
    """Roles of Java, from left to right: packages and imports, annotations, attributes, new types, declared classes, methods with what stands in their parentheses, types, variables.

    Types are words in angle brackets (an open one counts from there on), before one, or with a capital. In a method's parentheses, in calls too,
    all other words are parameters.
    """
    tokens = [(m.start(), m.lastgroup, m[0]) for m in _JAVA_TOKEN.finditer(code) if m.lastgroup != "sp"]
    text = lambda k: tokens[k][2] if 0 <= k < len(tokens) else ""
    out: dict[int, str] = {}
    n = angle = depth = 0
    annotation = made = declared = False

    def bracketed(k: int, angle: int) -> tuple[int, int]:
        """Every word up to the angle bracket's end is a type, keywords included."""
        while k < len(tokens) and angle > 0:
            angle = max(0, angle + (text(k) == "<") - (text(k) == ">"))
            if tokens[k][1] == "id":
                out[k] = "<TYPE>"
            k += 1
        return k, angle

    while n < len(tokens):
        _, kind, s = tokens[n]
        here, after = n, text(n + 1)
        n += 1
        if kind in ("str", "num"):
            out[here] = f"<{kind.upper()}>"
        elif kind == "op":
            angle = max(0, angle + (s == "<") - (s == ">"))
            depth += ((s == "(") - (s == ")")) if depth else 0
            annotation = annotation or s == "@" and not depth
        elif s in _WORDS["java"]:
            if depth:
                continue
            made, declared = made or s == "new", declared or s in ("class", "interface", "enum", "record")
            if s in ("package", "import"):
                end = next((k for k in range(n, len(tokens)) if text(k) == ";"), len(tokens))
                names = [k for k in range(n, end) if tokens[k][1] == "id" and text(k) not in _WORDS["java"]]
                out |= dict.fromkeys(names, "<PKG>")
                if s == "import" and names and text(end - 1) != "*":
                    out[names[-1]] = "<SYM>"
                n = end
        elif depth:
            out[here] = "<TYPE>" if s[0].isupper() or after == "<" else "<PARAM>"
        elif annotation or made and text(here - 1) != ".":
            role = "<ANNOT>" if annotation else "<TYPE>"
            out[here] = role
            while True:
                if text(n) == "." and n + 1 < len(tokens) and tokens[n + 1][1] == "id":
                    out[n + 1] = role
                    n += 2
                elif text(n) == "<" and not annotation:
                    n, angle = bracketed(n + 1, angle + 1)
                else:
                    break
            annotation, made = False, made and annotation
        elif text(here - 1) == ".":
            out[here] = "<ATTR>"
        elif declared:
            out[here], declared = "<CLASS>", False
            if after == "<":
                n, angle = bracketed(n + 1, angle + 1)
        elif after == "(":
            out[here], depth = "<METHOD>", 1
            n += 1
        else:
            out[here] = "<TYPE>" if angle or after == "<" or s[0].isupper() else "<VAR>"
    parts, end = [], 0
    for k in sorted(out):
        at, _, s = tokens[k]
        parts += [code[end:at], out[k]]
        end = at + len(s)
    return "".join(parts) + code[end:]


# Fixed value: what a numeral of C goes on with in masked data, signs included.
_C_TOKEN = re.compile(r"""(?P<str>"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z))|(?P<num>[0-9][0-9._xXbBeEpPuUlLfF+-]*)|(?P<id>[A-Za-z_]\w*)|(?P<sp>[ \t\r\n]+)|(?P<op>->|::|.)""", re.S | re.A)
_DIRECTIVE = re.compile(r"(?m)^[ \t]*\#[ \t]*(?P<word>[A-Za-z_]\w*)(?:\s*(?P<header><[^>\n]*>?|\"[^\"\n]*\"?))?", re.A)


def c_types(code: str) -> set[str]:
    """Tags of structs, unions and enums, and names that typedefs give: of each declarator the last word that is no keyword."""
    flat = re.sub(_C_TOKEN, lambda m: " " if m["str"] else m[0], without_trivia(code, "c"))
    found = set(re.findall(r"\b(?:struct|union|enum)\s+([A-Za-z_]\w*)", flat, re.A))
    for m in re.finditer(r"\btypedef\b", flat):
        depth, words = 0, []
        for part in re.finditer(r"[A-Za-z_]\w*|[^\w\s]", flat[m.end() :], re.A):
            sign = part[0]
            depth = max(0, depth + (sign in "([{") - (sign in ")]}"))
            if not depth and sign in ",;":
                found.update(words[-1:])
                words = []
                if sign == ";":
                    break
            elif sign[0].isalpha() or sign[0] == "_":
                words += [sign] if sign not in _WORDS["c"] else []
    return found


def _mask_c(code: str) -> str:
    """Roles of C: directives first, then the words of each outermost call or definition by comma, then all others.

    A name before a parenthesis is a function, and what stands in it is read as parameters are, in calls too: of a part between commas, the
    last word of no other role is its parameter and words before it are types.
    """
    types, out = c_types(code), {}
    tokens = [(m.start(), m.lastgroup, m[0]) for m in _C_TOKEN.finditer(code)]
    macros, skipped = set(), []
    for m in _DIRECTIVE.finditer(code):
        skipped.append((m.start("word"), m.end("word")))
        if m["word"] == "include" and m["header"]:
            skipped[-1] = (m.start("word"), m.end("header"))
            out |= {m.start("header") + x.start(): ("<HEADER>", len(x[0])) for x in re.finditer(r"[A-Za-z_]\w*", m["header"], re.A)}
        elif m["word"] in ("define", "ifdef", "ifndef", "undef"):
            macros.add(m.end("word"))
    inside = lambda at: any(a <= at < b for a, b in skipped)
    solid = [(at, kind, s) for at, kind, s in tokens if kind != "sp" and not inside(at)]
    tag = macro = False
    n = 0
    while n < len(solid):
        at, kind, s = solid[n]
        n += 1
        if macros and at >= min(macros):
            macro = True
            macros = {x for x in macros if x > at}
        if kind in ("str", "num"):
            out[at] = (f"<{kind.upper()}>", len(s))
        elif kind == "id" and s in _WORDS["c"]:
            tag = s in ("struct", "union", "enum")
        elif kind == "id":
            before, after = solid[n - 2][2] if n > 1 else "", solid[n][2] if n < len(solid) else ""
            role = "<MACRO>" if macro else _c_role(s, tag, types, before, after)
            macro, tag = False, tag and macro
            if role is None and after == "(":
                role, last = "<FUNC>", _close_of(solid, n)
                out |= _c_arguments(solid[n + 1 : last], types)
                n = last
            out[at] = (role or ("<MACRO>" if s.isupper() and len(s) > 1 else "<VAR>"), len(s))
    parts, end = [], 0
    for at, (role, size) in sorted(out.items()):
        parts += [code[end:at], role]
        end = at + size
    return "".join(parts) + code[end:]


def _c_role(s: str, tag: bool, types: set[str], before: str, after: str) -> str | None:
    if tag or s in types or "::" in (before, after):
        return "<TYPE>"
    return "<ATTR>" if before in (".", "->") else None


def _close_of(solid: list[tuple[int, str, str]], opens: int) -> int:
    """Where the parenthesis that opens there closes; the end if it does not."""
    depth = 0
    for k in range(opens, len(solid)):
        depth += (solid[k][2] == "(") - (solid[k][2] == ")")
        if not depth:
            return k
    return len(solid)


def _c_arguments(inner: list[tuple[int, str, str]], types: set[str]) -> dict[int, tuple[str, int]]:
    out: dict[int, tuple[str, int]] = {}
    depth, tag, free, first = 0, False, [], 0
    for k, (at, kind, s) in enumerate([*inner, (-1, "op", ",")]):
        if s == "," and (not depth or k == len(inner)):
            out |= {x: ("<TYPE>", size) for x, size in free[:-1]} | {x: ("<PARAM>", size) for x, size in free[-1:]}
            free, tag, first = [], False, k + 1
        elif kind in ("str", "num"):
            out[at] = (f"<{kind.upper()}>", len(s))
        elif kind == "id" and s in _WORDS["c"]:
            tag = s in ("struct", "union", "enum")
        elif kind == "id":
            role = _c_role(s, tag, types, inner[k - 1][2] if k > first else "", inner[k + 1][2] if k + 1 < len(inner) else "")
            tag = False
            if role:
                out[at] = (role, len(s))
            else:
                free.append((at, len(s)))
        depth += (s == "(") - (s == ")")
    return out


_NAMES = re.compile(r"""(?P<str>"(?:\\.|[^"\\])*(?:"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z))|(?P<id>[A-Za-z_$][\w$]*)""", re.S | re.A)


def masked(code: str, language: str, mode: str = "structure", legacy: bool = False, scope: str = "") -> str:
    """Structure, none, placeholder, per-file-hash or global-hash.

    Hashes name an identifier by its SHA-1; per-file ones add the file's scope, so names do not match across files.
    """
    if mode == "none":
        return code
    if mode == "structure":
        return _mask_python(code, legacy) if language == "python" else _mask_c(code) if language == "c" else _mask_java(code)
    words = _KEEP if language == "python" else _WORDS[language]

    def name(m: re.Match) -> str:
        s = m["id"]
        if s is None or s in words:
            return m[0]
        if language == "python":
            return "ID" if mode == "placeholder" else short_hash(f"{scope}:{s}" if mode == "per-file-hash" else s)
        return "<ID>" if mode == "placeholder" else short_hash(f"{scope}:{s}" if mode == "per-file-hash" and scope else s, 3)

    return (_GENERIC if language == "python" else _NAMES).sub(name, code)
