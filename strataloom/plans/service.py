"""The service: one request in JSON-RPC shape gives one response; every answer is bounded by its own limits.

Work stays in DataFrames until a response is put together: results are limited or aggregated
first, and documents are counted before their text is fetched. No transport is part of this; a
language model's answer is not either, so `answer` is empty.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.facts import all_facts, split
from ..operators import search
from ..sources import corpus, gitlog
from ..sources.config import Settings
from . import api, render

#: Results of a search if none are named, tokens that a document's text may have to be sent along.
RESULTS, TEXT_TOKENS = 100, 1_000_000


class BadRequest(ValueError):
    """A parameter is missing or not allowed."""


def _need(params: dict, *names: str) -> list:
    missing = [n for n in names if params.get(n) in (None, "")]
    if missing:
        raise BadRequest(f"missing: {', '.join(missing)}")
    return [params[n] for n in names]


def _folder(path: str) -> str:
    api._check_path(path)
    if not Path(path).exists():
        raise BadRequest(f"no such path: {path}")
    return path


def health_check(spark: SparkSession, params: dict) -> dict:
    return {"status": "healthy", "timestamp": int(time.time()), "version": "1"}


def _document(spark: SparkSession, params: dict, root: str) -> dict:
    s = Settings(paths=[root], include=params.get("include_patterns") or [], ignore=params.get("ignore_patterns") or [], prompt=params.get("prompt"), imports=bool(params.get("include_imports")), max_tokens=params.get("max_tokens"))
    began = time.monotonic()
    files = api.corpus_query(spark, s.check())
    parts = render.document(files, ".")
    known = files.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    text = render.joined(parts) if params.get("include_context") and known <= TEXT_TOKENS else None
    count = render.file_count(parts).first()["file_count"]
    return {"answer": "", "context": text, "markdown": text, "file_count": count, "token_count": int(known), "processing_time_ms": int(1000 * (time.monotonic() - began)), "llm_tool": params.get("llm_tool") or s.tool}


def process_local_codebase(spark: SparkSession, params: dict) -> dict:
    _, path = _need(params, "prompt", "path")
    return _document(spark, params, _folder(path))


def process_remote_repo(spark: SparkSession, params: dict) -> dict:
    """`target` names the folder for the copy."""
    _, url, target = _need(params, "prompt", "repo_url", "target")
    name = gitlog.parse_repository_url(url)[1] if "://" in url and not url.startswith("file:") else Path(url).name
    return _document(spark, params, gitlog.fetch(url, target)) | {"repo_name": name}


def get_file_metadata(spark: SparkSession, params: dict) -> dict:
    (path,) = _need(params, "file_path")
    found = corpus.file_metadata(_folder(path))
    return {k: found[k] for k in ("path", "size", "modified", "is_symlink")} | {"language": found["language"] or None}


def search_codebase(spark: SparkSession, params: dict) -> dict:
    path, query = _need(params, "path", "query")
    began = time.monotonic()
    files = corpus.scan(spark, _folder(path)).withColumn("path", F.col("relative_path"))
    rows = search.search_lines(files, query, int(params.get("max_results") or RESULTS), params.get("file_pattern")).collect()
    results = [{"file_path": r["path"], "line_number": r["line"], "line_content": r["text"], "match_context": r["snippet"]} for r in rows]
    return {"results": results, "total_matches": len(results), "files_searched": files.count(), "search_time_ms": int(1000 * (time.monotonic() - began))}


def diff_files(spark: SparkSession, params: dict) -> dict:
    old, new = _need(params, "file1_path", "file2_path")
    for p in (old, new):
        _folder(p)
    rows = api.diff_files(spark, old, new, int(params.get("context_lines") or 3)).orderBy("hunk").collect()
    binary = any(r["text"] == "binary\n" and not r["removed"] and not r["added"] for r in rows)
    hunks = [] if binary else [{"old_start": r["old_start"], "old_lines": r["old_lines"], "new_start": r["new_start"], "new_lines": r["new_lines"], "content": r["text"]} for r in rows]
    return {"file1_path": old, "file2_path": new, "hunks": hunks, "added_lines": sum(r["added"] for r in rows), "removed_lines": sum(r["removed"] for r in rows), "is_binary": binary}


def semantic_search(spark: SparkSession, params: dict) -> dict:
    path, query, kind = _need(params, "path", "query", "search_type")
    wanted = {"functions": ("def",), "types": ("type_ref",), "imports": ("import",), "references": ("call", "type_ref")}
    if kind.lower() not in wanted:
        raise BadRequest(f"unknown search_type: {kind}")
    began = time.monotonic()
    files = corpus.scan(spark, _folder(path))
    rows = search.symbols(split(all_facts(files, kinds=wanted[kind.lower()])), query, kind.lower(), int(params.get("max_results") or RESULTS)).collect()
    results = [{"file_path": r["path"], "symbol_name": r["name"], "symbol_type": r["kind"], "line_number": r["line"], "context": f"{r['kind']} {r['name']}"} for r in rows]
    return {"results": results, "total_matches": len(results), "files_analyzed": files.count(), "search_time_ms": int(1000 * (time.monotonic() - began))}


METHODS: dict[str, Callable[[SparkSession, dict], dict]] = {
    f.__name__: f for f in (health_check, process_local_codebase, process_remote_repo, get_file_metadata, search_codebase, diff_files, semantic_search)
}
#: The same calls under the names of tools.
TOOLS = {"analyze_local": "process_local_codebase", "analyze_remote": "process_remote_repo", "file_metadata": "get_file_metadata", "search": "search_codebase", "diff": "diff_files", "semantic_search": "semantic_search"}


def handle(spark: SparkSession, request: dict) -> dict:
    """The response to a request {jsonrpc, id, method, params}; errors carry the codes of JSON-RPC."""
    answer = {"jsonrpc": "2.0", "id": request.get("id")}
    name = request.get("method")
    method = METHODS.get(TOOLS.get(name, name))
    if request.get("jsonrpc") != "2.0" or not isinstance(name, str):
        return answer | {"error": {"code": -32600, "message": "not a request"}}
    if method is None:
        return answer | {"error": {"code": -32601, "message": f"unknown method: {name}"}}
    try:
        return answer | {"result": method(spark, request.get("params") or {})}
    except (ValueError, gitlog.GitError, FileNotFoundError) as e:
        return answer | {"error": {"code": -32602, "message": str(e)}}


class Answers:
    """A bounded store of responses by method and parameters: the oldest goes first, and none is given after `seconds`."""

    def __init__(self, most: int = 100, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.seconds, self.clock = most, seconds, clock
        self.held: dict[str, tuple[float, dict]] = {}
        self.hits = self.misses = 0

    def handle(self, spark: SparkSession, request: dict) -> dict:
        key = f"{request.get('method')} {sorted((request.get('params') or {}).items())!r}"
        now = self.clock()
        held = self.held.get(key)
        if held and now - held[0] < self.seconds:
            self.hits += 1
            return held[1] | {"id": request.get("id")}
        self.misses += 1
        answer = handle(spark, request)
        if "result" in answer:
            self.held.pop(key, None)
            self.held[key] = (now, answer)
            while len(self.held) > self.most:
                del self.held[next(iter(self.held))]
        return answer

    def stats(self) -> dict:
        return {"entries": len(self.held), "hits": self.hits, "misses": self.misses}
