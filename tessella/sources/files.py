"""Source files: scan, languages, and the symbols and edges of Python files."""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.graph import EXTENSIONS
from tessella.storage import materialize

MOST_BYTES, LOOKED_AT = 2 * 1024 * 1024, 8192
# Folders that are not scanned (a tool adds its own caches), and what marks a test file.
IGNORED = (
    ".git", ".hg", ".svn", ".idea", ".vscode", "node_modules", "vendor", "dist", "build", "target", "coverage", "__pycache__", ".venv", "venv",
    ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".cache",
)
TEST_MARKS = ("test_", "_test.", "/tests/")


def language(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[suffix]


def is_test_path(path: Column) -> Column:
    lower = F.concat(F.lit("/"), F.lower(path))
    out = F.element_at(F.split(lower, "/"), -1).startswith("test_")
    for m in TEST_MARKS:
        out = out | lower.contains(m)
    return out


def in_ignored(path: Column, ignored: tuple[str, ...] = IGNORED) -> Column:
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.arrays_overlap(folders, F.array(*map(F.lit, ignored)))


def classify(files: DataFrame) -> DataFrame:
    """files (path, content) with language, size, content_hash and skip: a reason, or null for files to index.

    Files of other languages have no reason: they are not counted as skipped, and language is null.
    """
    rows = files.withColumn("language", language(F.col("path")))
    rows = rows if "size" in files.columns else rows.withColumn("size", F.length("content").cast("long"))
    pairs = F.regexp_count(F.hex(F.substring("content", 1, LOOKED_AT)), F.lit("^(?:[0-9A-F]{2})*?00"))
    skip = F.when(in_ignored(F.col("path")), "ignored folder").when(F.col("language").isNotNull() & (F.col("size") > MOST_BYTES), "too large").when(F.col("language").isNotNull() & (pairs > 0), "binary")
    return rows.withColumn("content_hash", F.sha2("content", 256)).withColumn("skip", skip)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """classify() of the source files below a folder, with paths relative to it.

    Names are chosen when the files are listed and lengths before their content is read: files of other languages and those
    above MOST_BYTES are not opened (the latter are rows without content and hash).
    """
    either = lambda suffix: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix)
    names = "*{" + ",".join(map(either, EXTENSIONS)) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    path = F.regexp_replace(F.col("path"), "^(?:file:)?/*\\Q" + root.replace("file:", "").strip("/") + "\\E/", "")
    columns = [path.alias("path"), F.col("length").alias("size"), (F.unix_millis("modificationTime") * 1_000_000).alias("mtime_ns")]
    small = raw.where(F.col("length") <= MOST_BYTES).select(*columns, "content")
    large = raw.where(F.col("length") > MOST_BYTES).select(*columns, F.lit(None).cast("binary").alias("content"))
    return classify(small.unionByName(large))


class _Symbols(ast.NodeVisitor):
    """Collects the symbols and edges of one Python file."""

    def __init__(self, path: str, source: str, test_file: bool):
        self.path, self.test_file = path, test_file
        self.used = {path}
        self.nodes = [("file", path, path, "", 1, source.count("\n") + 1, test_file)]
        self.edges: list[tuple[str, str, str, int]] = []
        self.parent, self.cls, self.fn = path, "", ""
        self.local: frozenset[str] = frozenset()

    def _define(self, node, kind: str, scope: str) -> str:
        tail = scope.rsplit("::", 1)[-1] if scope else ""
        name = f"{self.path}::{tail}.{node.name}" if tail else f"{self.path}::{node.name}"
        if name in self.used:
            name = f"{name}@{node.lineno}:{node.col_offset + 1}"
        self.used.add(name)
        test = self.test_file or kind == "function" and node.name.lower().startswith("test")
        self.nodes.append((kind, node.name, name, self.parent, node.lineno, node.end_lineno, test))
        self.edges.append(("CONTAINS", self.parent, name, node.lineno))
        return name

    def visit_ClassDef(self, node):
        was = self.parent, self.cls
        name = self._define(node, "class", self.cls)
        for base in node.bases:
            for x in ast.walk(base):
                if isinstance(x, ast.Name):
                    self.edges.append(("INHERITS", name, x.id, node.lineno))
        self.parent = self.cls = name
        for child in [*node.decorator_list, *node.body]:
            self.visit(child)
        self.parent, self.cls = was

    def visit_FunctionDef(self, node):
        was = self.parent, self.fn, self.local
        self.parent = self.fn = self._define(node, "function", self.cls or self.fn)
        args = node.args
        names = {a.arg for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, [args.vararg, args.kwarg])]}
        stack = list(node.body)
        while stack:
            x = stack.pop()
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                continue
            if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store):
                names.add(x.id)
            stack.extend(ast.iter_child_nodes(x))
        self.local = frozenset(names)
        for child in [*node.decorator_list, *args.defaults, *filter(None, args.kw_defaults), *node.body]:
            self.visit(child)
        self.parent, self.fn, self.local = was

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node):
        for a in node.names:
            self.edges.append(("IMPORTS", self.path, a.name, node.lineno))

    def visit_ImportFrom(self, node):
        self.edges.append(("IMPORTS", self.path, "." * node.level + (node.module or ""), node.lineno))

    def visit_Call(self, node):
        f = node.func
        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
        if name:
            self.edges.append(("CALLS", self.fn or self.cls or self.path, name, node.lineno))
        for child in [*([] if isinstance(f, ast.Name) else [f]), *node.args, *node.keywords]:
            self.visit(child)

    def visit_Name(self, node):
        if self.fn and isinstance(node.ctx, ast.Load) and node.id not in self.local:
            self.edges.append(("REFERENCES", self.fn, node.id, node.lineno))


def python_symbols(path: str, source: bytes, test_file: bool) -> tuple[list[tuple], list[tuple]]:
    """Nodes and edges of a Python file; a file that does not parse is its file node alone."""
    text = source.decode("utf-8", "replace")
    found = _Symbols(path, text, test_file)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return found.nodes, []
    for child in tree.body:
        found.visit(child)
    return found.nodes, found.edges


def c_symbols(path: str, source: bytes, test_file: bool) -> tuple[list[tuple], list[tuple]]:
    """Nodes and edges of a C or C++ file by tokens: includes, structs and classes with bases, functions with bodies, and calls.

    Templates, macros that open braces and nested declarators are beyond it.
    """
    import re

    text = source.decode("utf-8", "replace")
    blank = lambda m: re.sub(r"[^\n]", " ", m.group())
    code = re.sub(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])+'", blank, text, flags=re.S)
    line = lambda at: code.count("\n", 0, at) + 1
    nodes = [("file", path, path, "", 1, text.count("\n") + 1, test_file)]
    edges = [("IMPORTS", path, m.group(1), line(m.start())) for m in re.finditer(r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]", code, re.M)]
    code = re.sub(r"\"(?:\\.|[^\"\\\n])*\"|^[ \t]*#[^\n]*", blank, code, flags=re.M)
    opens = re.compile(r"\b(?:class|struct)\s+(\w+)\s*(?::\s*([^{;]*))?\{|\b(\w+)\s*\(([^(){};]*)\)\s*(?:const\s*)?\{|\b(\w+)\s*\(|[{}]")
    words = {"if", "for", "while", "switch", "return", "sizeof", "catch", "else", "do"}
    stack: list[tuple[str, str, int]] = []  # kind, qualified name, number of the node
    used = {path}
    for m in opens.finditer(code):
        kind = next((k for k, _, _ in reversed(stack) if k != "block"), "")
        owner = next((q for k, q, _ in reversed(stack) if k != "block"), path)
        cls = next((q for k, q, _ in reversed(stack) if k == "class"), "")
        if m.group() == "}":
            if stack:
                k, _, n = stack.pop()
                if k != "block":
                    nodes[n] = (*nodes[n][:5], line(m.start()), nodes[n][6])
        elif m.group(1) or m.group(3) and m.group(3) not in words and kind != "function":
            name, what = m.group(1) or m.group(3), "class" if m.group(1) else "function"
            tail = cls.rsplit("::", 1)[-1] if cls else ""
            q = f"{path}::{tail}.{name}" if tail else f"{path}::{name}"
            if q in used:
                q = f"{q}@{line(m.start())}:{m.start() - code.rfind(chr(10), 0, m.start())}"
            used.add(q)
            nodes.append((what, name, q, owner, line(m.start()), line(m.start()), test_file or what == "function" and name.lower().startswith("test")))
            edges.append(("CONTAINS", owner, q, line(m.start())))
            for base in re.findall(r"\w+", m.group(2) or ""):
                if base not in ("public", "private", "protected", "virtual"):
                    edges.append(("INHERITS", q, base, line(m.start())))
            stack.append((what, q, len(nodes) - 1))
        elif m.group() == "{" or m.group(3):
            stack.append(("block", "", 0))
        elif m.group(5) and m.group(5) not in words and kind == "function":
            edges.append(("CALLS", owner, m.group(5), line(m.start())))
    return nodes, edges


PARSED = "file_path string, row string, kind string, name string, qualified_name string, parent_qualified string, line_start int, line_end int, is_test boolean"


def parse(files: DataFrame) -> DataFrame:
    """Node and edge rows of files (path, language, content, is_test), a file at a time on the executors."""

    def run(batches) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for path, lang, content, test in zip(pdf["path"], pdf["language"], pdf["content"], pdf["is_test"], strict=True):
                nodes, edges = (python_symbols if lang == "python" else c_symbols)(path, bytes(content), bool(test))
                out += [(path, "node", k, n, q, p, a, b, t) for k, n, q, p, a, b, t in nodes]
                out += [(path, "edge", k, target, source, None, at, at, None) for k, source, target, at in edges]
            yield pd.DataFrame(out, columns=["file_path", "row", "kind", "name", "qualified_name", "parent_qualified", "line_start", "line_end", "is_test"])

    return files.select("path", "language", "content", "is_test").mapInPandas(run, PARSED)


def symbols(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges without targets) of classified files.

    A file is parsed once, however often the two are read: the rows are written first. Files are dealt out by path before,
    so that tasks are not those of the input, which may be one block."""
    use = files.where(F.col("language").isNotNull() & F.col("skip").isNull()).withColumn("is_test", is_test_path(F.col("path")))
    rows = materialize(parse(use.select("path", "language", "content", "is_test").repartition("path")), "parsed")
    nodes = rows.where("row = 'node'").drop("row")
    edges = rows.where("row = 'edge'").select("file_path", "kind", F.col("qualified_name").alias("source_qualified"), F.col("name").alias("target_name"), F.col("line_start").alias("line"))
    return nodes, edges
