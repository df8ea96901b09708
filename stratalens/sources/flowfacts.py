"""Events of variable flow in Python sources, in the order in which names are bound and read.

``bind`` rows are nodes of the flow graph: a name bound in a scope, or a place without a
name of its own (a return, a call that is a sink).  ``read`` rows say that a name is
looked up for a node.  Which binding a lookup finds is left to a join (operators.flow):
it is the last one before it in the innermost scope around it that holds the name, so
the order of events carries the rules: an assignment binds its target before its right
side is read, comprehension targets bind in the scope around them.
"""

from __future__ import annotations

import ast
import warnings
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

import stratalens

cloudpickle.register_pickle_by_value(stratalens)

# Calls that change the form of data, by category.
TRANSFORMS = {
    "encoding": ("encode", "decode", "b64encode", "b64decode", "urlsafe_b64encode", "urlsafe_b64decode", "quote", "unquote"),
    "hashing": ("hexdigest", "digest", "sha256", "sha1", "sha512", "md5", "pbkdf2_hmac"),
    "encryption": ("encrypt", "decrypt", "fernet"),
    "serialization": ("dumps", "dump"),
    "deserialization": ("loads", "load"),
    "sanitization": ("strip", "lstrip", "rstrip", "replace"),
    "case_transform": ("lower", "upper", "title", "capitalize"),
    "splitting": ("split",),
    "joining": ("join",),
    "formatting": ("format", "format_map"),
    "type_cast": ("int", "float", "str", "bool", "bytes", "list", "dict", "tuple", "set"),
}
# Calls that data leaves the program through, by category.
SINKS = {
    "console": ("print", "pprint"),
    "file": ("write", "writelines", "writerow", "writerows"),
    "network": ("send", "sendall", "sendto"),
    "http": ("post", "get", "put", "patch", "delete", "request"),
    "database": ("execute", "executemany", "executescript", "insert", "update", "bulk_create", "bulk_update"),
    "logging": ("log", "warning", "error", "info", "debug", "critical", "exception"),
    "environment": ("setenv", "putenv"),
    "subprocess": ("run", "call", "check_call", "check_output", "Popen"),
}
# Names that are sinks only on something that looks like an HTTP client.
HTTP_ONLY = ("get", "post", "put", "patch", "delete")
HTTP_OWNERS = ("requests", "session", "client", "http", "api", "aiohttp")

TRANSFORM_OF = {name: kind for kind, names in TRANSFORMS.items() for name in names}
SINK_OF = {name: kind for kind, names in SINKS.items() for name in names}

SCHEMA = (
    "path string, seq int, event string, node int, name string, shown string, kind string, scope string, scopes array<int>, line int, col int, "
    "transform string, transform_category string, sink string, sink_category string, may_loop boolean, module string, imported string, level int"
)


def called(node: ast.AST) -> dict:
    """What a call is as a transform or a sink; empty for anything else."""
    if not isinstance(node, ast.Call):
        return {}
    parts, at = [], node.func
    while isinstance(at, ast.Attribute):
        parts.append(at.attr)
        at = at.value
    if isinstance(at, ast.Name):
        parts.append(at.id)
    name = node.func.attr if isinstance(node.func, ast.Attribute) else node.func.id if isinstance(node.func, ast.Name) else ""
    out = {}
    if name in TRANSFORM_OF:
        out |= {"transform": name, "transform_category": TRANSFORM_OF[name]}
    whole = ".".join(reversed(parts)).lower()
    if name in SINK_OF and (name not in HTTP_ONLY or any(owner in whole for owner in HTTP_OWNERS)):
        out |= {"sink": name, "sink_category": SINK_OF[name]}
    return out


def reads(node: ast.AST) -> list[str]:
    return [n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)]


def targets(node: ast.AST) -> list[str]:
    """Plain names that an assignment target binds."""
    if isinstance(node, ast.Name):
        return [node.id]
    inner = node.elts if isinstance(node, (ast.Tuple, ast.List)) else [node.value] if isinstance(node, ast.Starred) else []
    return [name for each in inner for name in targets(each)]


class Log:
    """The events of one file so far, and which names the open scopes hold."""

    def __init__(self, path: str):
        self.path, self.rows, self.nodes = path, [], 0
        self.scopes: list[tuple[int, str, set]] = [(0, PurePosixPath(path).stem, set())]
        self.opened = 1

    def bind(self, kind: str, at: ast.AST, name: str | None, shown: str | None = None, **more) -> int:
        self.nodes += 1
        if name is not None:
            self.scopes[-1][2].add(name)
        self._add("bind", self.nodes, name, shown or name, kind, line=getattr(at, "lineno", 0), col=getattr(at, "col_offset", 0), **more)
        return self.nodes

    def read(self, kind: str, node: int, names: list[str], **more) -> None:
        for name in names:
            self._add("read", node, name, None, kind, **more)

    def holds(self, name: str) -> bool:
        return any(name in held for _, _, held in self.scopes)

    def _add(self, event, node, name, shown, kind, **more) -> None:
        scopes = [number for number, _, _ in self.scopes]
        scope = ".".join(own for _, own, _ in self.scopes)
        row = {"path": self.path, "seq": len(self.rows), "event": event, "node": node, "name": name, "shown": shown, "kind": kind, "scope": scope, "scopes": scopes} | more
        self.rows.append(tuple(row.get(c) for c in NAMES))

    def within(self, name: str, children) -> None:
        self.scopes.append((self.opened, name, set()))
        self.opened += 1
        children()
        self.scopes.pop()

    def assign(self, names: list[str], value: ast.AST, at: ast.AST, kind: str) -> None:
        tags, right = called(value), reads(value)
        for name in names:
            self.read("ASSIGN", self.bind(kind, at, name), right, may_loop=False, **tags)

    def stored(self, target: ast.Attribute, value: ast.AST, at: ast.AST) -> None:
        """An attribute is a node for each name on the right that is known."""
        shown = f"self.{target.attr}" if isinstance(target.value, ast.Name) else target.attr
        for name in reads(value):
            if self.holds(name):  # looked up before the attribute is bound
                self.read("ATTR_ACCESS", self.nodes + 1, [name], may_loop=True)
                self.bind("ASSIGN", at, shown)

    def parameters(self, node: ast.AST) -> None:
        a = node.args
        plain = [(arg, arg.arg) for arg in [*a.args, *a.kwonlyargs]]
        starred = [(arg, stars + arg.arg) for arg, stars in ((a.vararg, "*"), (a.kwarg, "**")) if arg]
        for arg, shown in plain + starred:
            self.bind("PARAM", arg, arg.arg, shown)

    def visit(self, node: ast.AST) -> None:
        below = lambda: [self.visit(child) for child in ast.iter_child_nodes(node)]
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                self.within(node.name, lambda: (self.parameters(node), below()))
                return
            case ast.ClassDef():
                self.within(node.name, below)
                return
            case ast.Assign():
                for target in node.targets:
                    if isinstance(target, ast.Attribute):
                        self.stored(target, node.value, node)
                    else:
                        self.assign(targets(target), node.value, node, "ASSIGN")
            case ast.AnnAssign(value=ast.AST()):
                self.assign(targets(node.target), node.value, node, "ASSIGN")
            case ast.AugAssign():
                self.assign(targets(node.target), node.value, node, "AUG_ASSIGN")
            case ast.Return(value=ast.AST()):
                tags = {k: v for k, v in called(node.value).items() if k.startswith("transform")}
                self.read("RETURN", self.bind("RETURN", node, None, "<return>"), reads(node.value), may_loop=True, **tags)
            case ast.For():
                for name in targets(node.target):
                    self.read("ASSIGN", self.bind("FOR_TARGET", node, name), reads(node.iter), may_loop=True)
            case ast.With() | ast.AsyncWith():
                for item in node.items:
                    for name in targets(item.optional_vars) if item.optional_vars else []:
                        self.read("ASSIGN", self.bind("WITH_TARGET", node, name), reads(item.context_expr), may_loop=True)
            case ast.ListComp() | ast.SetComp() | ast.DictComp() | ast.GeneratorExp():
                for each in node.generators:
                    for name in targets(each.target):
                        self.read("ASSIGN", self.bind("COMPREHENSION", each, name), reads(each.iter), may_loop=True)
            case ast.Import():
                for alias in node.names:
                    self.bind("IMPORT", node, alias.asname or alias.name.split(".")[-1], module=alias.name, level=0)
            case ast.ImportFrom():
                for alias in node.names:
                    if alias.name != "*":
                        self.bind("IMPORT", node, alias.asname or alias.name, module=node.module or "", imported=alias.name, level=node.level or 0)
            case ast.Call():
                tags = {k: v for k, v in called(node).items() if k.startswith("sink")}
                given = [*node.args, *(k.value for k in node.keywords)]
                if tags:
                    at = self.bind("CALL_RESULT", node, None, f"<sink:{tags['sink']}>")
                    self.read("CALL_ARG", at, [name for arg in given for name in reads(arg)], may_loop=True, **tags)
                for child in [*given, node.func]:
                    self.visit(child)
                return
        below()


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
_TYPES = [_KINDS[c.split()[1]] for c in SCHEMA.split(", ")]


def events(path: str, text: str) -> list[tuple]:
    """Rows of SCHEMA; none for a file that does not parse."""
    log = Log(path)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            log.visit(ast.parse(text))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    return log.rows


def flow_events(files: DataFrame) -> DataFrame:
    """The events of the ``.py`` files of files(path, ext, text)."""

    def work(batches):
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows := events(path, text or ""):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], NAMES)

    return files.where("ext = '.py'").select("path", "text").mapInArrow(work, SCHEMA)
