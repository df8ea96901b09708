"""Facts of Python sources: one row a syntax node of interest, read in one pass over the files.

Syntax trees are the one thing here that Spark's functions cannot build, so this is an
Arrow function; all questions about the trees are joins and aggregates over its rows.

pre: number of the node in walking order; parent: that of its parent; above: the
numbers of the functions around it; nest: how many control statements are around or at
it; guarded: whether a ``try`` is around it.  What ``name``, ``value`` and ``n`` hold
depends on ``kind`` (see ``_facts``).
"""

from __future__ import annotations

import ast
import warnings

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

import stratalens

# Functions sent to executors travel by value, so that workers need no copy of the repository.
cloudpickle.register_pickle_by_value(stratalens)

SCHEMA = "path string, pre int, parent int, parent_kind string, kind string, name string, value string, n int, line int, end_line int, code_lines int, above array<int>, nest int, guarded boolean, listed boolean"
NESTING = ("If", "For", "While", "Try", "With", "AsyncFor", "AsyncWith", "TryStar")
FUNCTIONS = ("FunctionDef", "AsyncFunctionDef")
KINDS = frozenset((*NESTING, *FUNCTIONS, "ExceptHandler", "Assert", "BoolOp", "IfExp", "comprehension", "Raise", "Call", "Return", "Import", "ImportFrom", "alias"))


def dotted(node: ast.AST) -> str | None:
    """``a.b.c`` of a chain of attributes of a name; None for anything else."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def _shape(body: list[ast.stmt]) -> str:
    """``pass``: that alone; ``empty``: only pass, ... and strings; else ``code``."""
    idle = lambda s: isinstance(s, ast.Pass) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and (s.value.value is ... or isinstance(s.value.value, str))
    if len(body) == 1 and isinstance(body[0], ast.Pass):
        return "pass"
    return "empty" if all(map(idle, body)) else "code"


def _facts(node: ast.AST, kind: str) -> tuple[str | None, str | None, int | None]:
    """(name, value, n) of a node."""
    if kind in FUNCTIONS:  # name, kind of the last statement, first line of the body
        return node.name, type(node.body[-1]).__name__, node.body[0].lineno
    if kind == "ExceptHandler":  # the type if it is a name, shape of the body, whether a type is given
        return (node.type.id if isinstance(node.type, ast.Name) else None), _shape(node.body), int(node.type is not None)
    if kind == "BoolOp":  # n: operators
        return None, None, len(node.values) - 1
    if kind == "comprehension":  # n: filters
        return None, None, len(node.ifs)
    if kind == "Raise":  # the raised name, called or not
        exc = node.exc.func if isinstance(node.exc, ast.Call) else node.exc
        return (exc.id if isinstance(exc, ast.Name) else None), None, None
    if kind == "Call":  # dotted name, first argument if it is a string
        first = node.args[0] if node.args else None
        return dotted(node.func), (first.value if isinstance(first, ast.Constant) and isinstance(first.value, str) else None), None
    if kind == "Return":  # n: whether a value is returned
        return None, None, int(node.value is not None)
    if kind == "ImportFrom":
        return None, node.module, node.level
    if kind == "alias":
        return node.name, node.asname, None
    return None, None, None


def facts(path: str, text: str) -> list[tuple]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            module = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [(path, 0, None, None, "SyntaxError", None, None, None, None, None, None, [], 0, False, False)]
    code = [0]
    for line in text.splitlines():
        code.append(code[-1] + (line.strip() != "" and not line.strip().startswith("#")))
    out, count = [(path, 0, None, None, "Module", None, None, None, None, None, None, [], 0, False, False)], 1
    # listed: whether the functions below count as functions of the file; classes: names around
    todo = [(child, 0, "Module", [], 0, False, True, ()) for child in reversed(list(ast.iter_child_nodes(module)))]
    while todo:
        node, parent, parent_kind, above, nest, guarded, listed, classes = todo.pop()
        kind, pre = type(node).__name__, count
        count += 1
        nest += kind in NESTING
        if kind in KINDS:
            name, value, n = _facts(node, kind)
            end, n_code = getattr(node, "end_lineno", None), None
            if kind in FUNCTIONS:
                name = ".".join([*classes, name])
                n_code = code[min(end, len(code) - 1)] - code[min(n - 1, len(code) - 1)]
            out.append((path, pre, parent, parent_kind, kind, name, value, n, getattr(node, "lineno", None), end, n_code, above, nest, guarded, listed))
        function = kind in FUNCTIONS
        for child in reversed(list(ast.iter_child_nodes(node))):
            definition = isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
            inner = listed and (definition if function else True)
            todo.append((child, pre, kind, [*above, pre] if function else above, nest, guarded or kind == "Try", inner, (*classes, node.name) if kind == "ClassDef" else classes))
    return out


def ast_nodes(files: DataFrame) -> DataFrame:
    """Facts of the ``.py`` files of files(path, ext, text); a file that does not parse gives one ``SyntaxError`` row."""

    def work(batches):
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(zip(*facts(path, text or ""), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _TYPES, strict=True)], _NAMES)

    return files.where("ext = '.py'").select("path", "text").mapInArrow(work, SCHEMA)


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}[c.split()[1]] for c in SCHEMA.split(", ")]
