"""Imports, calls, definitions, type references and type definitions of one source text.

Every function returns facts (kind, name, module, items, flag, line): for imports the module,
items and whether it is relative; for definitions whether they are exported. Python goes
through its own parser; the other languages through patterns over text freed of comments
and strings. A text that cannot be parsed gives no facts.
"""

from __future__ import annotations

import ast
import re

from .scanner import Lines, blank

Fact = tuple[str, str | None, str | None, list[str], bool, int]

#: Names that are no types of a project.
BUILTIN_TYPES = frozenset(
    "i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize f32 f64 bool char str String Vec Option Result Box Rc Arc HashMap HashSet BTreeMap BTreeSet Self"
    " int float complex bytes list dict tuple set frozenset None Any Union Optional List Dict Tuple Set Callable Iterable Iterator Type"
    " string number boolean any unknown never void object symbol null undefined Array Promise Map Record Partial Readonly Date Error Function Object Number Boolean Symbol RegExp"
    " byte rune error int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 float32 float64 complex64 complex128 uintptr"
    " Int Int8 Int16 Int32 Int64 UInt Float Double Bool Character Dictionary Never Void AnyObject".split()
)
#: Words before a bracket that call nothing, by language.
KEYWORDS = {
    "rust": frozenset("if for while match return fn in as use mod pub else let loop impl where move Some Ok Err None".split()),
    "javascript": frozenset("if for while switch return catch function class in else do try await async new typeof super import with yield constructor".split()),
    "go": frozenset("if for switch return func struct in else defer go select case range make interface import package type var const map chan".split()),
    "swift": frozenset("if for while switch return catch func in as is else do try await guard super self init deinit where case".split()),
}


def facts(path: str, source: str) -> list[Fact]:
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    reader = READERS.get(ext)
    return reader(source) if reader and source else []


def python(source: str) -> list[Fact]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[Fact] = []

    def types(node: ast.AST | None) -> None:
        for n in ast.walk(node) if node is not None else ():
            if isinstance(n, ast.Constant) and isinstance(n.value, str) and n.value.isidentifier():
                out.append(("type_ref", n.value, None, [], False, n.lineno))
            elif isinstance(n, ast.Name):
                out.append(("type_ref", n.id, None, [], False, n.lineno))
            elif isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name):
                out.append(("type_ref", n.attr, n.value.id, [], False, n.lineno))

    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            out += [("import", None, a.name, [f"as {a.asname}"] if a.asname else [], False, n.lineno) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            module = "." * n.level + (n.module or "")
            out += [("import", None, module, [a.name], n.level > 0, n.lineno) for a in n.names]
        elif isinstance(n, ast.Call):
            if isinstance(n.func, ast.Name):
                out.append(("call", n.func.id, None, [], False, n.lineno))
            elif isinstance(n.func, ast.Attribute):
                if isinstance(n.func.value, ast.Name):
                    out.append(("call", n.func.attr, n.func.value.id, [], False, n.lineno))
                out.append(("call", n.func.attr, None, [], False, n.lineno))
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(("def", n.name, None, [], not n.name.startswith("_"), n.lineno))
            out.append(("type_def", n.name, "def", [], True, n.lineno))
            a = n.args
            for arg in [*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg]:
                types(arg.annotation if arg else None)
            types(n.returns)
        elif isinstance(n, ast.ClassDef):
            out.append(("type_def", n.name, "class", [], True, n.lineno))
            for base in n.bases:
                types(base)
        elif isinstance(n, ast.AnnAssign):
            types(n.annotation)
    return _clean(out)


def _clean(found: list[Fact], language: str = "") -> list[Fact]:
    """Without built-in types and keyword calls, in order of lines."""
    words = KEYWORDS.get(language, frozenset())
    keep = [f for f in found if not (f[0] == "type_ref" and f[1] in BUILTIN_TYPES) and not (f[0] == "call" and f[1] in words)]
    return sorted(keep, key=lambda f: (f[5], f[0], f[1] or "", f[2] or ""))


def _scan(out: list[Fact], code: str, lines: Lines, kind: str, pattern: str, name: int | str = "n", module: str | None = None, flag=None) -> None:
    for m in re.finditer(pattern, code):
        d = m.groupdict()
        out.append((kind, d[name], d.get(module) if module else None, [], bool(flag(m)) if flag else False, lines.at(m.start(name))))


def _braces(tree: str) -> list[tuple[str, str]]:
    """(prefix, item) for each leaf of a Rust use tree."""
    tree = tree.strip()
    m = re.match(r"(.*?)(?:::)?\s*\{(.*)\}\s*$", tree, re.S)
    if not m:
        head, _, leaf = tree.rpartition("::")
        return [(head, leaf)]
    parts, depth, last = [], 0, 0
    for i, c in enumerate(m[2] + ","):
        depth += (c == "{") - (c == "}")
        if c == "," and not depth:
            parts.append(m[2][last:i])
            last = i + 1
    out = []
    for p in filter(str.strip, parts):
        for head, leaf in _braces(p):
            out.append(("::".join(x for x in (m[1].strip(), head) if x), leaf))
    return out


def rust(source: str) -> list[Fact]:
    code, out = blank(source), []
    lines = Lines(code)
    for m in re.finditer(r"\buse\s+([^;]+);", code):
        tree, line = " ".join(m[1].split()), lines.at(m.start())
        relative = tree.startswith(("self::", "super::", "crate::"))
        if "{" in tree:
            out += [("import", None, head, [leaf], relative, line) for head, leaf in _braces(tree)]
        elif tree.endswith("::*"):
            out.append(("import", None, tree[:-3], ["*"], relative, line))
        elif " as " in tree:
            path, alias = tree.split(" as ", 1)
            out.append(("import", None, path, [f"as {alias}"], relative, line))
        else:
            out.append(("import", None, tree, [], relative, line))
    for m in re.finditer(r"\bmod\s+(\w+)\s*[;{]", code):
        out.append(("import", None, m[1], [], True, lines.at(m.start())))
    for m in re.finditer(r"\bextern\s+crate\s+(\w+)", code):
        out.append(("import", None, m[1], [], False, lines.at(m.start())))
    _scan(out, code, lines, "def", r"(?P<p>\bpub(?:\s*\([^)]*\))?\s+)?(?:(?:async|const|unsafe|extern\s+\"?\w*\"?)\s+)*\bfn\s+(?P<n>\w+)", flag=lambda m: m["p"])
    _scan(out, code, lines, "call", r"(?<![\w:.])(?P<m>(?:\w+::)+)(?P<n>[a-z_]\w*)\s*(?:::<[^>]*>)?\(", module="m")
    out = [(k, n, m.removesuffix("::") if k == "call" and m else m, i, f, ln) for k, n, m, i, f, ln in out]
    _scan(out, code, lines, "call", r"(?<!fn )(?<![\w:])(?P<n>[a-z_]\w*)\s*(?:::<[^>]*>)?\(")
    _scan(out, code, lines, "call", r"\b(?P<n>[a-z_]\w*)!\s*[(\[{]")
    _scan(out, code, lines, "type_ref", r"(?<![\w:])(?P<m>(?:[a-z_]\w*::)+)?(?P<n>[A-Z]\w*)\b(?!\s*!)", module="m")
    out = [(k, n, m.removesuffix("::") if k == "type_ref" and m else m, i, f, ln) for k, n, m, i, f, ln in out]
    _scan(out, code, lines, "type_def", r"\b(?P<k>struct|enum|trait|type|union)\s+(?P<n>[A-Z]\w*)", module="k")
    named = {item: f[2] for f in out if f[0] == "import" for item in f[3] if item[:1].isupper()}
    out = [(k, n, named.get(n) if k == "type_ref" and m is None else m, i, f, ln) for k, n, m, i, f, ln in out]
    return _clean(out, "rust")


def javascript(source: str, typed: bool = False) -> list[Fact]:
    text, code, out = blank(source, True, keep_text=True), blank(source, True), []
    lines = Lines(code)
    for m in re.finditer(r"""\bimport\s+(?:type\s+)?(?:(?P<w>[\w$*{},\s]+?)\s+from\s+)?['"](?P<s>[^'"\n]+)['"]|\bexport\s+(?P<e>[\w$*{},\s]+?)\s+from\s+['"](?P<t>[^'"\n]+)['"]|\brequire\(\s*['"](?P<r>[^'"\n]+)['"]\s*\)|\bimport\(\s*['"](?P<d>[^'"\n]+)['"]\s*\)""", text):
        spec = m["s"] or m["t"] or m["r"] or m["d"]
        what = m["w"] or m["e"] or ""
        items = [re.sub(r"^\*\s+as\s+", "", x.split(" as ")[0].strip()) for x in re.split(r"[{},]", what) if x.strip()]
        out.append(("import", None, spec, items, spec.startswith("."), lines.at(m.start())))
    _scan(out, code, lines, "def", r"\bfunction\s*\*?\s+(?P<n>[\w$]+)", flag=lambda m: True)
    _scan(out, code, lines, "def", r"\b(?:const|let|var)\s+(?P<n>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*(?::[^=\n{]+)?=>|[\w$]+\s*=>)", flag=lambda m: True)
    _scan(out, code, lines, "def", r"(?m)^\s+(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*(?P<n>(?!(?:if|for|while|switch|catch|return|function)\b)[\w$]+)\s*\([^;{}]*\)\s*(?::[^{;=]+)?\{", flag=lambda m: True)
    _scan(out, code, lines, "call", r"(?<![\w$.])(?P<n>[\w$]+)\s*\(")
    _scan(out, code, lines, "call", r"(?<![\w$.])(?P<m>[\w$]+)\.(?P<n>[\w$]+)\s*\(", module="m")
    _scan(out, code, lines, "type_ref", r"<(?P<n>[A-Z][\w$]*)(?=[\s/>])")
    _scan(out, code, lines, "type_def", r"\b(?P<k>class)\s+(?P<n>[\w$]+)", module="k")
    if typed:
        _scan(out, code, lines, "type_def", r"\b(?P<k>interface|enum|type)\s+(?P<n>[A-Z][\w$]*)", module="k")
        _scan(out, code, lines, "type_ref", r"(?::|\bextends\b|\bimplements\b|\bas\b|[<,|&(=]|=>)\s*(?P<n>[A-Z][\w$]*)\b")
    else:
        _scan(out, code, lines, "def", r"\bexports\.(?P<n>[\w$]+)\s*=", flag=lambda m: True)
        _scan(out, code, lines, "type_def", r"\b(?P<k>function)\s+(?P<n>[\w$]+)", module="k")
    defined = {(f[1], f[5]) for f in out if f[0] == "def"}
    return _clean([f for f in dict.fromkeys((k, n, m, tuple(i), f, ln) for k, n, m, i, f, ln in out) if not (f[0] == "call" and (f[1], f[5]) in defined)], "javascript")


def typescript(source: str) -> list[Fact]:
    return javascript(source, typed=True)


def go(source: str) -> list[Fact]:
    text, code, out = blank(source, keep_text=True), blank(source), []
    lines = Lines(code)
    for block in re.finditer(r"\bimport\s*(?:\((?P<b>[^)]*)\)|(?P<o>[^\n(]+))", text):
        body = block["b"] or block["o"] or ""
        for m in re.finditer(r'(?:(?P<a>[\w.]+)\s+)?"(?P<p>[^"\n]+)"', body):
            start = block.start("b" if block["b"] is not None else "o") + m.start()
            out.append(("import", None, m["p"], [m["a"]] if m["a"] else [], m["p"].startswith("."), lines.at(start)))
    alias = {(i[0] if i else p.rsplit("/", 1)[-1]): p for k, _, p, i, *_ in out}
    _scan(out, code, lines, "def", r"\bfunc\s+(?:\([^)]*\)\s*)?(?P<n>\w+)\s*[\[(]", flag=lambda m: True)
    _scan(out, code, lines, "call", r"(?<![\w.])(?<!func )(?P<n>[A-Za-z_]\w*)\s*\(")
    _scan(out, code, lines, "call", r"(?<![\w.])(?P<m>\w+)\.(?P<n>[A-Za-z_]\w*)\s*\(", module="m")
    _scan(out, code, lines, "type_ref", r"(?<![\w.])(?P<m>[a-z]\w*)\.(?P<n>[A-Z]\w*)\b(?!\s*\()", module="m")
    _scan(out, code, lines, "type_ref", r"(?<![\w.\"])(?P<n>[A-Z]\w*)\b(?!\s*\()")
    _scan(out, code, lines, "type_def", r"\btype\s+(?P<n>\w+)\b(?P<k>)", module="k")
    out = [(k, n, alias.get(m, m) if k in ("call", "type_ref") else m, i, f, ln) for k, n, m, i, f, ln in out]
    defined = {(f[1], f[5]) for f in out if f[0] == "def"}
    return _clean([f for f in out if not (f[0] == "call" and (f[1], f[5]) in defined)], "go")


_SWIFT_IMPORT = re.compile(r"(?m)^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|internal|fileprivate|package|open)\s+)?import\s+(?:(?:typealias|struct|class|enum|protocol|let|var|func|actor)\s+)?(?P<p>[\w.]+)")


def swift(source: str) -> list[Fact]:
    code, out = blank(source), []
    lines = Lines(code)
    for m in _SWIFT_IMPORT.finditer(code):
        module, _, item = m["p"].partition(".")
        out.append(("import", None, module, [item] if item else [], False, lines.at(m.start("p"))))
    _scan(out, code, lines, "def", r"\bfunc\s+(?P<n>\w+)", flag=lambda m: True)
    _scan(out, code, lines, "call", r"(?<![\w.])(?<!func )(?P<n>\w+)\s*\(")
    _scan(out, code, lines, "call", r"(?<![\w.])(?P<m>\w+)\.(?P<n>\w+)\s*\(", module="m")
    _scan(out, code, lines, "type_ref", r"(?:[:<,&\[(]|->|\bas[?!]?|\bis)\s*(?P<n>[A-Z]\w*)")
    _scan(out, code, lines, "type_def", r"(?<!import )\b(?P<k>class|struct|enum|actor|extension|protocol|typealias)\s+(?P<n>[A-Z]\w*)", module="k")
    out += [("type_ref", f[1], f[2], [], False, f[5]) for f in out if f[0] == "call" and f[1][:1].isupper()]
    defined = {(f[1], f[5]) for f in out if f[0] == "def"}
    return _clean([f for f in out if not (f[0] == "call" and (f[1], f[5]) in defined)], "swift")


READERS = {"py": python, "pyi": python, "pyw": python, "rs": rust, "js": javascript, "jsx": javascript, "mjs": javascript, "cjs": javascript, "ts": typescript, "tsx": typescript, "go": go, "swift": swift}


def swift_targets(manifest: str) -> dict[str, str]:
    """Folder of each target of a package manifest: its path argument, else Sources/ or Tests/ and its name."""
    out = {}
    text = blank(manifest, keep_text=True)
    for m in re.finditer(r"\.(?P<k>target|executableTarget|testTarget|macro|plugin)\s*\(", text):
        depth, end = 1, m.end()
        while end < len(text) and depth:
            depth += (text[end] == "(") - (text[end] == ")")
            end += 1
        body = text[m.end() : end]
        name, path = (re.search(rf'\b{k}\s*:\s*"([^"]*)"', body) for k in ("name", "path"))
        if name:
            out[name[1]] = path[1] if path else f"{'Tests' if m['k'] == 'testTarget' else 'Sources'}/{name[1]}"
    return out
