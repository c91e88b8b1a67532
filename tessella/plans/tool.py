"""The code graph as one call: a request with an action and its options, answered by one JSON object."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import graph, search
from tessella.plans import index
from tessella.sources import git

ACTIONS, MODES, KINDS = ("search", "query", "impact", "overview"), ("fts", "semantic", "hybrid"), ("file", "class", "function")


@dataclass(frozen=True)
class Embeddings:
    """What semantic search needs: an encoder of queries, whose identity the stored vectors must have, and consent."""

    encode_query: Callable[[str], list[float]]
    identity: str
    consent: bool = False


def _texts(value) -> bool:
    return isinstance(value, list) and all(isinstance(x, str) for x in value)


def request_error(request: dict) -> tuple[str, str] | None:
    """(code, message) of the first thing that is wrong with a request; None if nothing is."""
    action, most = request.get("action"), request.get("max_results", search.DEFAULT_RESULTS)
    context, changed = request.get("context_files"), request.get("changed_files")
    rules = [
        ("invalid_action", f"action is one of {', '.join(ACTIONS)}", action in ACTIONS),
        ("invalid_max_results", f"max_results is a whole number from 1 to {search.MOST_RESULTS}", type(most) is int and 1 <= most <= search.MOST_RESULTS),
    ]
    if action == "search":
        rules += [
            ("missing_query", "a search needs a query", bool(str(request.get("query") or "").strip())),
            ("invalid_search_mode", f"mode is one of {', '.join(MODES)}", request.get("mode", "fts") in MODES),
            ("invalid_kind", f"kind is one of {', '.join(KINDS)}", request.get("kind") in (None, *KINDS)),
            ("invalid_context_path", "context_files is a list of paths", context is None or (_texts(context) and all(x.strip() for x in context))),
        ]
    if action == "query":
        known = request.get("relation") in ("children_of", *graph.RELATIONS)
        rules.append(("invalid_query", "a query needs a target and a relation", bool(str(request.get("target") or "").strip()) and known))
    rules.append(("invalid_changed_files", "changed_files is a list of paths", changed is None or _texts(changed)))
    return next(((code, message) for code, message, good in rules if not good), None)


def _failed(action, code: str, message: str, **details) -> str:
    return json.dumps({"ok": False, "action": action, "error": {"code": code, "message": message, **details}}, ensure_ascii=False)


def _done(action: str, rows: DataFrame, **details) -> str:
    """rows are limited already: MOST_RESULTS, or the groups of an overview."""
    data = [json.loads(r[0]) for r in rows.select(F.to_json(F.struct("*"))).collect()]
    return json.dumps({"ok": True, "action": action, "results": data, **details}, ensure_ascii=False)


def code_graph(spark: SparkSession, root: str, version: int, request: dict, project: str = "/", embeddings: Embeddings | None = None, changed: list[str] | None = None) -> str:
    """Answers a request from a version of the index at root; changed are the paths that the working tree has changed."""
    action, wrong = request.get("action"), request_error(request)
    if wrong:
        return _failed(action, *wrong)
    table = lambda name: index.read(spark, root, version, name)
    nodes, limit = table("nodes"), search.check_limit(request.get("max_results", search.DEFAULT_RESULTS))
    if action == "overview":
        most = graph.indegree(nodes, table("edges"), limit).select("qualified_name", "indegree")
        return _done(action, graph.overview(table("files"), nodes, table("edges")), high_indegree=[r.asDict() for r in most.collect()])
    if action == "query":
        name, error, candidates = graph.resolve_target(nodes, request["target"])
        if error:
            return _failed(action, error, f"no single node is meant by {request['target']!r}", **({"candidates": candidates} if candidates else {}))
        return _done(action, graph.related(nodes, table("edges"), request["relation"], name, limit))
    if action == "impact":
        given = request.get("changed_files")
        try:
            paths = git.inside(project, (changed or []) if given is None else given)
        except ValueError as e:
            return _failed(action, "invalid_changed_files", str(e))
        seeds = graph.changed_nodes(nodes, table("old_nodes"), git.as_table(spark, paths))
        hit = graph.impact(nodes, table("edges"), seeds, limit, table("old_edges"))
        names = seeds.orderBy("qualified_name").select("qualified_name", "file_path", "deleted")
        return _done(action, hit.drop("path"), changed_files=paths, changed_nodes=[r.asDict() for r in names.collect()])
    try:
        context = git.inside(project, request.get("context_files") or [])
    except ValueError as e:
        return _failed(action, "invalid_context_path", str(e))
    options = {"limit": limit, "kind": request.get("kind"), "context": context}
    query, mode = request["query"], request.get("mode", "fts")
    try:
        vectors = None if embeddings is None else index.vectors_of(table("embeddings"), nodes, embeddings.identity)
        encode = None if embeddings is None else lambda text: index.checked_query(vectors, embeddings.encode_query(text))
        used, rows, warning = search.search(nodes, query, mode, vectors, encode, embeddings is not None and embeddings.consent, **options)
    except PermissionError as e:
        return _failed(action, str(e), "embeddings may be sent out only with consent")
    except ValueError as e:
        return _failed(action, "semantic_search_failed", str(e))
    shown = [c for c in ("kind", "name", "qualified_name", "file_path", "line_start", "line_end", "score") if c in rows.columns]
    return _done(action, rows.select(*shown), mode=used, **({"warning": warning} if warning else {}))
