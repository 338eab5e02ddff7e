"""Small projects in temporary folders: scan, facts, resolution, expansion, search, diff, telemetry."""

import json
import random
import struct
import subprocess

import pytest
from pyspark.sql import functions as F

from strataloom.functions.globs import BadPattern, IgnoreRules, check_pattern
from strataloom.operators import graph, rank, search
from strataloom.plans import api, render
from strataloom.sources import config, corpus, gitlog, otlp


def write(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


PYTHON = {
    "utils.py": "def helper(x):\n    return x\n\ndef _hidden():\n    pass\n",
    "main.py": "from utils import helper\n\nhelper(1)\n",
    "api.py": "import utils\n\ndef run():\n    return utils.helper(2)\n",
    "other.py": "x = 1\n",
}
RUST_CHAIN = {
    "Cargo.toml": '[package]\nname = "chain"\n',
    "src/main.rs": "mod module_a;\nfn main() { module_a::go(); }\n",
    "src/module_a.rs": "use crate::module_b::next;\npub fn go() { next(); }\n",
    "src/module_b.rs": "use crate::module_c::last;\npub fn next() { last(); }\n",
    "src/module_c.rs": "pub fn last() {}\n",
}


def names(df):
    return sorted(r[0] for r in df.select("relative_path").collect())


def test_scan_ignores_and_errors(spark, tmp_path):
    root = write(tmp_path, {".gitignore": "*.log\n!keep.log\nbuild/\n", "a.py": "x", "b.log": "x", "keep.log": "x", "build/c.py": "x", ".hid/d.py": "x", "bad.txt": b"\xff\xfe", "img.png": b"\x89PNG"})
    files = corpus.scan(spark, root)
    assert names(files) == ["a.py", "bad.txt", "img.png", "keep.log"]
    assert [r["path"].endswith("bad.txt") or r["path"].endswith("img.png") for r in corpus.rejects(files).collect()] == [True, True]
    assert names(corpus.scan(spark, root, corpus.ScanOptions(include=["*.py"]))) == ["a.py"]
    assert names(corpus.scan(spark, root, corpus.ScanOptions(include=["*.py"], ignore=["a.*"]))) == []


def test_scan_obeys_folders_above_and_reads_only_what_is_asked(spark, tmp_path, monkeypatch):
    subprocess.run(["git", "init", "-q", tmp_path], check=True)
    (tmp_path / "home/git").mkdir(parents=True)
    (tmp_path / "home/git/ignore").write_text("*.swp\n")
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "home"))
    monkeypatch.setenv("GIT_CONFIG_GLOBAL", str(tmp_path / "none"))
    (tmp_path / ".git/info/exclude").write_text("secret*\n")
    root = write(tmp_path / "a/b", {
        ".gitignore": "!kept.tmp\nlocal/\n", "x.py": "x", "x.swp": "x", "secret.py": "x", "kept.tmp": "x", "gone.tmp": "x", "deep/gone.tmp": "x", "deep/.ignore": "*.md\n!y.md\n",
        "deep/z.md": "x", "deep/y.md": "x", "local/q.py": "x", "only/here.py": "x", "raw.dat": b"a\0b", "pic.PNG": b"\x89PNG", "z.md": "x",
    })
    (tmp_path / ".gitignore").write_text("*.tmp\n/a/b/only/\n")
    assert [f[1] for f in corpus.list_files(root, corpus.ScanOptions())] == ["deep/y.md", "kept.tmp", "pic.PNG", "raw.dat", "x.py", "z.md"]
    (tmp_path / "a/b/x.swp").unlink()  # Spark's workers have the environment that the session started with
    assert names(corpus.scan(spark, root)) == ["deep/y.md", "kept.tmp", "pic.PNG", "raw.dat", "x.py", "z.md"]
    assert names(corpus.scan(spark, root, corpus.ScanOptions(skip_binary=True))) == ["deep/y.md", "kept.tmp", "x.py", "z.md"]
    assert [f[1] for f in corpus.list_files(root, corpus.ScanOptions(include=["*.md"], ignore=["deep/"]))] == ["z.md"]
    for f in (tmp_path / "a/b").rglob("*"):
        if f.is_file() and not f.name.startswith("."):
            f.chmod(0)
    bare = corpus.scan(spark, root, content=False)
    assert names(bare) == ["deep/y.md", "kept.tmp", "pic.PNG", "raw.dat", "x.py", "z.md"] and bare.where("content is not null or error is not null").count() == 0


def test_patterns_are_checked():
    for bad in ("/etc/passwd", "../x", "a\0b", "x" * 1001):
        with pytest.raises(BadPattern):
            check_pattern(bad)


def test_ignore_rules_agree_with_git(tmp_path):
    lines = "*.o\n/top\nsub/dir/\n!sub/x.o\n**/deep\na?c\n[xy].txt\nfoo/**/bar\n"
    subprocess.run(["git", "init", "-q", tmp_path], check=True)
    (tmp_path / ".gitignore").write_text(lines)
    rules = IgnoreRules()
    rules.add(lines)
    paths = ["m.o", "sub/m.o", "sub/x.o", "top", "q/top", "q/deep", "abc", "ac", "x.txt", "z.txt", "foo/bar", "foo/q/w/bar", "q/a-c"]
    for p in paths:
        known = subprocess.run(["git", "-C", tmp_path, "check-ignore", "-q", p]).returncode == 0
        assert rules.ignored(p, False) == known, p


def test_python_imports_and_callers(spark, tmp_path):
    root = write(tmp_path, PYTHON)
    s = config.Settings(paths=[root], include=["utils.py"], callers=True)
    assert names(api.corpus_query(spark, s)) == ["api.py", "main.py", "utils.py"]
    s = config.Settings(paths=[root], include=["main.py"], imports=True)
    got = api.corpus_query(spark, s)
    assert names(got) == ["main.py", "utils.py"]
    assert got.where("relative_path = 'utils.py'").first()["imported_by"] == ["main.py"]


def test_rust_chain_depth(spark, tmp_path):
    root = write(tmp_path, RUST_CHAIN)
    s = config.Settings(paths=[root], include=["src/main.rs"], imports=True, semantic_depth=2)
    assert names(api.corpus_query(spark, s)) == ["src/main.rs", "src/module_a.rs", "src/module_b.rs"]


def test_type_expansion_typescript(spark, tmp_path):
    root = write(tmp_path, {"src/types.ts": "export interface User { id: string }\n", "src/handlers.ts": "import { User } from './types';\nexport function f(u: User) { return u; }\n", "src/z.ts": "const a = 1;\n"})
    s = config.Settings(paths=[root], include=["src/handlers.ts"], types=True, semantic_depth=1)
    assert names(api.corpus_query(spark, s)) == ["src/handlers.ts", "src/types.ts"]
    s = config.Settings(paths=[root], include=["src/handlers.ts"], types=True, semantic_depth=0)
    assert names(api.corpus_query(spark, s)) == ["src/handlers.ts"]


def test_go_and_swift_packages(spark, tmp_path):
    root = write(tmp_path, {
        "go.mod": "module example.org/app\n", "main.go": 'package main\nimport "example.org/app/store"\nfunc main() { store.Open() }\n',
        "store/store.go": "package store\nfunc Open() {}\n", "store/more.go": "package store\nfunc More() {}\n", "store/store_test.go": "package store\n",
    })
    s = config.Settings(paths=[root], include=["main.go"], imports=True, semantic_depth=1)
    assert names(api.corpus_query(spark, s)) == ["main.go", "store/more.go", "store/store.go"]


def test_budget_skips_and_render(spark):
    rows = spark.createDataFrame([("a", 3.0, 60), ("b", 2.0, 50), ("c", 1.0, 40), ("d", 0.5, 1)], "path string, priority double, tokens long")
    assert sorted(r[0] for r in rank.greedy_budget(rows, 100).collect()) == ["a", "c"]
    assert sorted(r[0] for r in rank.greedy_budget(rows, 100, chunk=1).collect()) == ["a", "c"]
    files = spark.createDataFrame([("b.rs", "Rust", 1.0, "fn x() {}", 9), ("a.md", "Markdown", 0.5, "hi]]>\n", 3)], "relative_path string, file_type string, priority double, content string, size long")
    text = render.join_fragments(render.markdown_files(files)).first()[0]
    assert text == "## b.rs\n\n```rust\nfn x() {}\n```\n\n## a.md\n\n```markdown\nhi]]>\n```\n\n"
    assert "]]]]><![CDATA[>" in render.join_fragments(render.xml_files(files)).first()[0]
    assert [r["fragment"] for r in render.path_lines(files).orderBy("ord").collect()] == ["a.md", "b.rs"]


def plain_greedy(rows, budget):
    left, out = budget, []
    order = lambda r: (r[1] is None, -(r[1] or 0), r[0] is None, r[0] or "", r[2])
    for r in sorted((r for r in rows if r[2] is not None), key=order):
        if r[2] <= left:
            left -= r[2]
            out.append(r)
    return out


def test_greedy_budget_at_chunk_borders(spark):
    """Ties, repeated rows, nulls, sizes of zero: a chunk of any length gives what a plain loop gives."""
    rng = random.Random(5)
    for case in range(3):
        rows = [(rng.choice(["a", "b", "c", None]), rng.choice([2.0, 1.0, None, -1.0]), rng.choice([0, 1, 2, 3, 5, None])) for _ in range(14)] + [("a", 1.0, 2)] * 4
        df = spark.createDataFrame(rows, "path string, priority double, tokens long")
        for budget in (7, 100):
            want = sorted(map(str, plain_greedy(rows, budget)))
            for chunk in (1, 2, 5, 50) if case else range(1, 16, 3):
                assert sorted(str(tuple(r)) for r in rank.greedy_budget(df, budget, chunk=chunk).collect()) == want, (budget, chunk)


def test_document_with_history(spark, tmp_path):
    files = spark.createDataFrame([("b.rs", "Rust", 1.0, "fn x() {}", 9, [("fix", "ann"), ("two", "bob"), ("three", "c"), ("four", "d")]), ("a/a.md", "Markdown", 0.5, "hi\n", 3, [])], "relative_path string, file_type string, priority double, content string, size long, history array<struct<message:string, author:string>>")
    parts = render.document(files, "shop")
    text = "".join(r["fragment"] for r in parts.orderBy("part", "place", "key").collect())
    assert text == (
        "# Code Context: shop\n\n## Statistics\n\n- Total files: 2\n- Total size: 12 B\n  - Markdown: 1\n  - Rust: 1\n\n"
        "## File Structure\n\n```\n├── a/\n│   ├── a.md\n├── b.rs\n```\n\n## Table of Contents\n\n- [b.rs](#b-rs)\n- [a/a.md](#a-a-md)\n\n"
        "## b.rs\n\nGit history:\n  - fix by ann\n  - two by bob\n  - three by c\n\n```rust\nfn x() {}\n```\n\n## a/a.md\n\n```markdown\nhi\n```\n\n"
    )
    assert render.file_count(parts).first()[0] == 2
    render.write_document(parts, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == text


def test_graph_shapes(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)], "src long, dst long")
    assert sorted((r["node"], r["component"]) for r in graph.strong_components(e).collect()) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6)]
    assert [r["members"] for r in graph.cycles(e).collect()] == [[1, 2, 3]]
    assert graph.shortest_path(e, 1, 4).first()["path"] == [1, 2, 3, 4]
    assert graph.shortest_path(e, 1, 6).count() == 0
    with pytest.raises(ValueError):
        graph.topological_levels(e)
    assert sorted((r["node"], r["level"]) for r in graph.levels_without_cycles(e).collect()) == [(1, 0), (2, 0), (3, 1), (4, 0), (5, 1), (6, 0)]
    dag = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src long, dst long")
    assert sorted((r["node"], r["level"]) for r in graph.topological_levels(dag).collect()) == [(1, 2), (2, 1), (3, 0)]
    none = spark.createDataFrame([], "src long, dst long")
    assert graph.strong_components(none).count() == 0


def test_search_and_diff(spark, tmp_path):
    root = write(tmp_path, PYTHON)
    got = api.search_codebase(spark, root, "HELPER").collect()
    assert [(r["path"], r["line"]) for r in got] == [("api.py", 4), ("main.py", 1), ("main.py", 3), ("utils.py", 1)]
    assert [r["name"] for r in api.semantic_search(spark, root, "help", "functions").collect()] == ["helper"]
    found = search.hunks(["a", "b", "c", "d", "e"], ["a", "x", "c", "d", "e"], 2)
    assert found == [search.Hunk(1, 2, 1, 2, 1, 1, " a\n-b\n+x\n c\n d\n")]
    assert search.hunks(["a"], ["a"]) == []


def test_git_diff_query(spark, tmp_path):
    root = write(tmp_path, PYTHON)
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "utils.py").write_text(PYTHON["utils.py"] + "y = 2\n")
    git("commit", "-qam", "two")
    files, stats = api.diff_query(spark, root, "HEAD~1", "HEAD", config.Settings(callers=True))
    assert {r["relative_path"]: r["changed"] for r in files.collect()} == {"utils.py": True, "main.py": False, "api.py": False}
    assert stats.first().asDict() == {"files_changed": 1, "insertions": 1, "deletions": 0}
    text = render.joined(api.diff_document(spark, root, "HEAD~1", "HEAD", config.Settings(callers=True)))
    assert text.startswith("# Git Diff Analysis: HEAD~1 → HEAD\n\nFrom: HEAD~1\n") and "- **Lines added**: 1\n" in text and "## Changed Files\n\n- `utils.py`\n\n## Semantic Context Files\n\n- `api.py`\n- `main.py`\n\n" in text
    assert "### main.py\n\n```python\nfrom utils" in text and text.rstrip().rpartition("\n")[2].startswith("- **Estimated tokens**: ")
    same = render.joined(api.diff_document(spark, root, "HEAD", "HEAD", config.Settings()))
    assert "No files changed.\n" in same and "Semantic" not in same
    assert [(r["ord"], r["message"]) for r in gitlog.history(spark, root).where("path = 'utils.py'").orderBy("ord").collect()] == [(1, "two"), (2, "one")]
    for bad in ("--output=x", "a..b", "a;b"):
        with pytest.raises(gitlog.GitError):
            gitlog.check_ref(bad)


def test_otlp_json_and_telemetry(spark, tmp_path):
    span = lambda n, ms, code=0: {"name": n, "startTimeUnixNano": "1000000", "endTimeUnixNano": str(1000000 + ms * 1000000), "attributes": [{"key": "code.function.name", "value": {"stringValue": n}}, {"key": "code.lineno", "value": {"intValue": "3"}}], "status": {"code": code, "message": "boom" if code else ""}}
    doc = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "shop"}}]}, "scopeSpans": [{"spans": [span("helper", 1), span("helper", 3, 2), span("nothing", 1)]}]}]}
    (tmp_path / "t.json").write_text(json.dumps(doc))
    root = write(tmp_path / "src", PYTHON)
    got = api.telemetry_query(spark, str(tmp_path / "t.json"), [root], service="shop")
    m = got["metrics"].first()
    assert (m["name"], m["call_count"], m["p50"], m["p95"], m["error_count"], m["last_error"]) == ("helper", 2, 1.0, 3.0, 1, "boom")
    assert got["summary"].first().asDict() == {"spans": 3, "correlated": 2, "functions": 1}
    assert got["report"].count() == 2


def test_facts_are_cached_by_content(spark, tmp_path):
    from strataloom.extract.facts import all_facts, cached_facts

    root, store = write(tmp_path / "p", PYTHON), str(tmp_path / "store")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(cached_facts(corpus.scan(spark, root), store)) == rows(all_facts(corpus.scan(spark, root)))
    write(tmp_path / "p", {"main.py": "import api\n"})
    files = corpus.scan(spark, root)
    assert rows(cached_facts(files, store)) == rows(all_facts(files))


def test_enriched_files(spark):
    from strataloom.operators.telemetry import enrich_files

    files = spark.createDataFrame([("a.py", "x"), ("b.py", None)], "relative_path string, content string")
    m = spark.createDataFrame([("a.py", "f", 3, 1.25, 2.0, 2.0, 1 / 3)], "path string, name string, call_count long, p50 double, p95 double, p99 double, error_rate double")
    got = dict(enrich_files(files, m).collect())
    assert got == {"a.py": "// f // calls: 3, p50: 1.2 ms, p95: 2.0 ms, p99: 2.0 ms, errors: 33.3%\nx", "b.py": None}


def test_otlp_protobuf(spark, tmp_path):
    def field(n, kind, body):
        head = bytes([n << 3 | kind])
        return head + (bytes([len(body)]) + body if kind == 2 else body)

    text = lambda s: field(1, 2, s.encode())
    pair = lambda k, v: field(1, 2, k.encode()) + field(2, 2, v)
    span = field(5, 2, b"op") + field(7, 1, struct.pack("<Q", 1_000_000)) + field(8, 1, struct.pack("<Q", 3_000_000)) + field(9, 2, pair("code.function.name", text("f"))) + field(15, 2, field(2, 2, b"bad") + field(3, 0, b"\x02"))
    data = field(1, 2, field(1, 2, field(1, 2, pair("service.name", text("svc")))) + field(2, 2, field(2, 2, span)))
    (tmp_path / "a.bin").write_bytes(data)
    (tmp_path / "b.bin").write_bytes(b"\xff\xff\xff")
    (tmp_path / "c.bin").write_bytes(b"")
    rows = {r["source"][-5:]: r for r in otlp.read_protobuf(spark, str(tmp_path)).collect()}
    a = rows["a.bin"]
    assert (a["name"], a["function_name"], a["service_name"], a["duration_ms"], a["attributes"]) == ("op", "f", "svc", 2.0, {"status.code": "2", "status.message": "bad"})
    assert rows["b.bin"]["error"] and "c.bin" not in rows


def test_settings(tmp_path):
    (tmp_path / ".strataloom.toml").write_text('ignore = ["x"]\n[defaults]\nsemantic_depth = 1\n[tokens]\nlarge = 5000\n[[priorities]]\npattern = "a"\nweight = 2\n')
    s = config.load(config.find_config(str(tmp_path)), prompt="abcd", ignore=["y"])
    assert (s.ignore, s.semantic_depth, s.priorities, s.budget()) == (["y"], 1, [("a", 2.0)], 5000 - 1 - 1000)
    assert config.Settings().budget() is None and config.Settings(max_tokens=10, prompt=None).budget() == 10
    with pytest.raises(ValueError):
        config.Settings(format="pdf").check()


def test_streaming_windows(spark, sf, tmp_path):
    from strataloom.sources.tables import spans
    from strataloom.streaming.spans import read_spans, windowed_metrics

    rows = spans(spark, sf)
    rows.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    q = windowed_metrics(read_spans(spark, str(tmp_path / "in"), schema), late="400 days", size="1 day").writeStream.outputMode("complete").format("memory").queryName("metrics").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("metrics").agg(F.sum("call_count")).first()[0] == rows.count()


def test_calling_files_are_those_of_the_pairs(spark):
    from strataloom.operators import joins

    rng = random.Random(9)
    path = lambda: rng.choice(["a/x", "a/y", "b/x", "b/pack/z", "pack/w", "q"]) + rng.choice([".py", ".go", ".swift", ".rs"])
    defs = spark.createDataFrame([(path(), rng.choice("fgh"), rng.random() < 0.8, 1) for _ in range(40)], "path string, name string, is_exported boolean, line int")
    calls = spark.createDataFrame([(path(), rng.choice("fghk"), rng.choice([None, "pack", "x/pack", "b", "a"]), 1) for _ in range(120)], "path string, name string, module string, line int")
    for k in range(4):
        targets = defs.select("path").distinct().orderBy(F.xxhash64("path", F.lit(k))).limit(4)
        want = joins.callers_of(targets, defs, calls, joins.call_may_reach(F.col("target"), F.col("node"), F.col("module"))).select("node").distinct()
        assert sorted(want.collect()) == sorted(joins.calling_files(targets, defs, calls).collect())


def test_service_answers(spark, tmp_path):
    from strataloom.plans import service

    root = write(tmp_path / "p", PYTHON)
    ask = lambda method, **p: service.handle(spark, {"jsonrpc": "2.0", "id": 7, "method": method, "params": p})
    assert ask("health_check")["result"]["status"] == "healthy"
    got = ask("analyze_local", prompt="why", path=root, include_context=True)["result"]
    assert got["file_count"] == 4 and "## main.py" in got["markdown"] and got["markdown"].startswith("# Code Context: .") and got["token_count"] > 0
    got = ask("search_codebase", path=root, query="HELPER", max_results=2)["result"]
    assert [(r["file_path"], r["line_number"]) for r in got["results"]] == [("api.py", 4), ("main.py", 1)] and got["files_searched"] == 4
    assert [r["symbol_name"] for r in ask("semantic_search", path=root, query="hel", search_type="functions")["result"]["results"]] == ["helper"]
    got = ask("diff_files", file1_path=f"{root}/main.py", file2_path=f"{root}/api.py")["result"]
    assert got["added_lines"] == 4 and got["removed_lines"] == 3 and not got["is_binary"] and got["hunks"][0]["old_start"] == 1
    assert ask("file_metadata", file_path=f"{root}/main.py")["result"]["language"] == "python"
    assert ask("nothing")["error"]["code"] == -32601 and ask("search_codebase", path=root)["error"]["code"] == -32602
    assert ask("search_codebase", path="../x", query="a")["error"]["code"] == -32602 and service.handle(spark, {"method": "x"})["error"]["code"] == -32600
    now = [0.0]
    answers = service.Answers(most=1, seconds=10, clock=lambda: now[0])
    for at, method in ((0, "health_check"), (5, "health_check"), (20, "health_check")):
        now[0] = at
        answers.handle(spark, {"jsonrpc": "2.0", "id": at, "method": method})
    assert answers.stats() == {"entries": 1, "hits": 1, "misses": 2}


def test_token_counts_of_a_vocabulary(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from strataloom.operators import token_counts

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(3)
    texts = [None, "", "one two", "x\n\n  y\n" * 50, "\n".join("word " * rng.randint(1, 9) + "end" for _ in range(60_000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, "one two")], "tokens int, content string")
    got = token_counts.with_token_counts(df.withColumnRenamed("tokens", "id"), path)
    assert sorted(map(tuple, got.select("id", "tokens").collect())) == [(i, len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)] + [(9, 2)]


def test_history_in_documents(spark, tmp_path):
    root = write(tmp_path, PYTHON)
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "utils.py").write_text("y = 2\n")
    git("commit", "-qam", "two")
    text = render.joined(api.whole_document(spark, config.Settings(paths=[root], include=["utils.py"], history=2)).drop("root_no"))
    assert "## utils.py\n\nGit history:\n  - two by t\n  - one by t\n\n```python\ny = 2\n```" in text


def test_passages_of_any_length(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "ab", "b", "ba", "c"])
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(99, "")]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 8)))) for i in range(50)]
    got = search.texts_with_passage(spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(items, "item long, passage string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, k) for i, t in docs for k, p in items if p in t)
    assert search.texts_with_passage(spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame([], "item long, passage string")).count() == 0


def test_a_program_reads_prompt_and_document(spark, tmp_path):
    root = write(tmp_path, PYTHON)
    got = api.ask(spark, config.Settings(paths=[root], include=["main.py"], prompt="why?", max_tokens=5000), ["cat"])
    assert got.startswith("why?\n\n# Code Context: ") and "helper(1)" in got
    with pytest.raises(RuntimeError):
        api.ask(spark, config.Settings(paths=[root], max_tokens=5000), ["false"])
    with pytest.raises(ValueError):
        api.ask(spark, config.Settings(paths=[root]), ["cat"])


def test_resolution_never_broadcasts_candidates(spark, sf):
    """An import has several candidates that no estimate foresees: at 512,820 files they broke the driver (project_resolution)."""
    from strataloom.plans import catalog

    df = catalog.queries()["project_resolution"](spark, sf)
    assert df.count() > 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 2


def test_whole_document_of_more_than_a_gigabyte(spark, sf, monkeypatch):
    """As in the SQL, the query's total stays in MB; other documents tell it in GB, as the engine does."""
    from strataloom.plans import catalog, project_queries
    from tests.oracle import connect, same_rows

    own, sql = project_queries.S.corpus, catalog.oracle_sql()["whole_document"]
    monkeypatch.setattr(project_queries.S, "corpus", lambda s, d: own(s, d).withColumn("size", F.col("size") + (1 << 26)))
    large = sql.replace("strlen(text)::BIGINT AS size", f"(strlen(text) + {1 << 26})::BIGINT AS size")
    assert large != sql
    same_rows(catalog.queries()["whole_document"](spark, sf), connect(sf), large)
    total = render.statistics(project_queries.S.corpus(spark, sf)).orderBy("ord").first()["fragment"]
    assert total.endswith(" GB\n")
