"""Driver-side pieces without Spark: facts of each language, resolution candidates, wire format, hunks, globs."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.extract import languages as L
from strataloom.extract.scanner import Lines, blank
from strataloom.functions import globs
from strataloom.operators.resolve import Project, candidates, external_confidence
from strataloom.operators.search import hunks
from strataloom.sources import otlp


def kinds(found, kind):
    return [(f[1], f[2], list(f[3]), f[4], f[5]) for f in found if f[0] == kind]


def test_rust_facts():
    found = L.rust('use a::{b, c::D};\nuse super::x::*;\nextern crate serde;\nmod inner;\npub fn f() { g(1); m::h(); x.y(); println!("no_call()"); }\nstruct S { t: Other }\n')
    assert kinds(found, "import") == [(None, "a", ["b"], False, 1), (None, "a::c", ["D"], False, 1), (None, "super::x", ["*"], True, 2), (None, "serde", [], False, 3), (None, "inner", [], True, 4)]
    assert {(n, m) for n, m, *_ in kinds(found, "call")} == {("g", None), ("h", "m"), ("y", None), ("println", None)}
    assert kinds(found, "def") == [("f", None, [], True, 5)]
    assert ("S", "struct", [], False, 6) in kinds(found, "type_def") and "Other" in {n for n, *_ in kinds(found, "type_ref")}


def test_python_facts():
    found = L.python("import a.b, c as d\nfrom . import x\nfrom ..p import q as r\nclass K(Base):\n    def go(self, t: List[Foo]) -> 'Bar':\n        return u.run(t)\n")
    assert [(m, i, f) for _, m, i, f, _ in kinds(found, "import")] == [("a.b", [], False), ("c", ["as d"], False), (".", ["x"], True), ("..p", ["q"], True)]
    assert {(n, m) for n, m, *_ in kinds(found, "call")} == {("run", "u"), ("run", None)}
    assert {n for n, *_ in kinds(found, "type_ref")} == {"Base", "Foo", "Bar"}
    assert L.python("def broken(:") == []


def test_script_facts():
    found = L.typescript("import React, { useState as u } from 'react';\nconst y = require(\"./b\");\nexport const f = async (a: Foo) => { g(a); };\nexport class C extends Base {\n  run(x: T) { return <Widget a=\"b\"/>; }\n}\n// call()\n")
    assert {m for _, m, *_ in kinds(found, "import")} == {"react", "./b"}
    assert {n for n, *_ in kinds(found, "def")} == {"f", "run"}
    assert {"Foo", "Base", "T", "Widget"} <= {n for n, *_ in kinds(found, "type_ref")}
    assert "call" not in {n for n, *_ in kinds(found, "call")}


def test_go_and_swift_facts():
    found = L.go('package a\nimport (\n\t"fmt"\n\tm "x/y"\n)\nfunc (s *S) Run(u m.User) { fmt.Println("f(x)"); go helper(u) }\ntype S struct{}\n')
    assert [(m, i) for _, m, i, *_ in kinds(found, "import")] == [("fmt", []), ("x/y", ["m"])]
    assert {(n, m) for n, m, *_ in kinds(found, "call")} == {("Println", "fmt"), ("helper", None)}
    assert ("User", "x/y") in {(n, m) for n, m, *_ in kinds(found, "type_ref")}
    found = L.swift("@testable import Foo\nimport struct Bar.Baz\nfinal class V: Base {\n  func go(a: Item) { helper(); Thing(a) }\n}\n")
    assert [(m, i) for _, m, i, *_ in kinds(found, "import")] == [("Foo", []), ("Bar", ["Baz"])]
    assert {"Base", "Item", "Thing"} <= {n for n, *_ in kinds(found, "type_ref")}
    assert L.swift_targets('targets: [.target(name: "A", path: "src/A"), .testTarget(name: "B")]') == {"A": "src/A", "B": "Tests/B"}


@given(st.text(alphabet='ab"\'/*\n\\`#r', max_size=60))
@settings(max_examples=300, deadline=None)
def test_blanking_keeps_the_shape(source):
    for quotes in (False, True):
        out = blank(source, quotes)
        assert len(out) == len(source) and [i for i, c in enumerate(out) if c == "\n"] == [i for i, c in enumerate(source) if c == "\n"]


def test_lines():
    at = Lines("ab\nc\n\nd").at
    assert [at(0), at(2), at(3), at(5), at(6)] == [1, 1, 2, 3, 4]


def first(file, module, item, known, project=None):
    return next((t for t, _ in candidates(file, module, item, project or Project()) if t in known), None)


def test_resolution_candidates():
    assert first("src/a/mod.rs", "super::b::C", None, {"src/b.rs"}) == "src/b.rs"
    assert first("src/main.rs", "my_app::x", "y", {"src/x/y.rs", "src/x.rs"}, Project(crate="my-app")) == "src/x/y.rs"
    assert first("src/a.rs", "std::io", None, {"std.rs"}) is None
    assert first("p/q/a.py", "..m", "x", {"p/m/x.py", "p/m/__init__.py"}) == "p/m/x.py"
    assert first("p/a.py", ".", "x", {"p/x.py"}) == "p/x.py"
    assert first("p/a.py", "os", None, {"os.py"}) is None
    assert first("src/a/b.ts", "../c/d", None, {"src/c/d/index.ts"}) == "src/c/d/index.ts"
    assert first("src/a.js", "./x.service", None, {"src/x.service.js"}) == "src/x.service.js"
    assert first("src/a.js", "react", None, {"src/react.js"}) is None
    assert first("cmd/m.go", "ex.org/app/store", None, {"store"}, Project(go_module="ex.org/app")) == "store"
    assert first("Sources/A/x.swift", "B", None, {"Sources/B"}) == "Sources/B"
    assert candidates("a.py", "....x", None, Project()) == []
    assert external_confidence("a.py", "os.path") == 1.0 and external_confidence("a.py", "numpy") == 1.0 and external_confidence("a.py", "ours") == 0.5


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
@settings(max_examples=300, deadline=None)
def test_hunks_rebuild_the_new_text(a, b):
    for context in (0, 1, 2, 3):
        out, i = [], 0
        for h in hunks(a, b, context):
            rows = h.text.splitlines()
            changed = [k for k, r in enumerate(rows) if r[0] != " "]
            before = changed[0]
            at = h.old_start - 1 + before
            assert [r[1:] for r in rows[:before]] == a[h.old_start - 1 : at] == b[h.new_start - 1 : h.new_start - 1 + before]
            assert (h.old_lines, h.new_lines, len(changed)) == (before + h.removed, before + h.added, h.removed + h.added)
            out += a[i:at]
            out += [r[1:] for r in rows if r[0] == "+"]
            i = at + h.removed
            after = [r[1:] for r in rows[changed[-1] + 1 :]]
            assert after == a[i : i + len(after)] and len(after) <= context
        assert out + a[i:] == b


def test_globs():
    hit = lambda g, p: bool(re.search(globs.ignore_regex(g), p))
    assert hit("*.rs", "a/b.rs") and not hit("/*.rs", "a/b.rs") and hit("src/**/x.py", "src/x.py") and hit("src/**/x.py", "src/a/b/x.py")
    assert hit("**/*.{rs,go}", "q/w.go") and not hit("a?.py", "a/.py") and hit("[!a].c", "b.c") and hit("build/", "x/build/y") and not hit("build/", "build")
    assert re.search(globs.plain_regex("*.py"), "a.py") and not re.search(globs.plain_regex("*.py"), "d/a.py")


def test_wire_format_is_strict():
    for bad in (b"\x0a\x05a", b"\xff" * 12, b"\x0b"):
        try:
            list(otlp.fields(bad))
        except (ValueError, IndexError):
            continue
        raise AssertionError(bad)
