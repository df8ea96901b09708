"""A small source tree held in memory, for queries and tests on code: ``TEXTS`` maps paths to texts.

Values that look like secrets are put together here, so that no file of the repository holds one.
"""

from __future__ import annotations

from textwrap import dedent

from pyspark.sql import DataFrame, SparkSession

from stratalens.sources.files import literal

_Q = '"' * 3
_KEY = "AK" + "IA" + "ABCDEFGHIJ234567"
_HEX = "gh" + "p_" + "a1B2" * 9
_RANDOM = "q8Zr2LmX" + "0vTk5YpWb7NsHd3J" + "cGe9"

TEXTS = {
    path: dedent(text).lstrip("\n")
    for path, text in {
        "pkg/__init__.py": "from . import a\n",
        "pkg/a.py": """
            import pkg.b
            from pkg import c

            def first(x):
                return pkg.b.second(x)
            """,
        "pkg/b.py": """
            from .c import third

            def second(x):
                return third(x)
            """,
        "pkg/c.py": """
            from pkg.a import first
            import pkg.c

            def third(x):
                return first(x)
            """,
        "tool.py": """
            import importlib
            plugin = importlib.import_module("plugins.fast")
            names = ["plugins.slow", "scripts/helper.py"]
            """,
        "plugins/fast.py": "SPEED = 3\n",
        "plugins/slow.py": "SPEED = 1\n",
        "plugins/unused.py": "SPEED = 2\n",
        "scripts/helper.py": "print('help')\n",
        "orphan.py": "def lonely():\n    return 1\n",
        "broken.py": "import orphan_not\nfrom metrics import area\ndef (:\n",
        "test_tool.py": "import tool\n\ndef test_tool():\n    try:\n        pass\n    except:\n        pass\n",
        "metrics.py": """
            class Shape:
                def area(self, w, h):
                    # width first
                    if w > 0 and h > 0:
                        for k in range(w):
                            if k % 2:
                                h += 1
                            elif k > 7:
                                h += 2
                    return w * h

                class Inner:
                    async def wait(self):
                        async with self.lock:
                            assert self.ready
                        return [x for x in self.rows if x if x > 1]

            def outer(a):
                def inner(b):
                    return b if b else 0
                while a:
                    try:
                        a = inner(a) or a - 1
                    except ValueError:
                        break
                if a:
                    def hidden():
                        return 2

            def flat():

                return 5
            """,
        "errors.py": f"""
            import requests

            def load(path):
                try:
                    return open(path)
                except:
                    pass

            def fetch(url):
                data = requests.get(url)
                try:
                    return data.json()
                except Exception:
                    {_Q}ignored{_Q}
                raise Exception("bad")

            def pick(n):
                if n:
                    return n
                return

            def later(n):
                for k in n:
                    if k:
                        return k
                print(n)

            def fine(n):
                try:
                    return open(n)
                except (OSError, ValueError) as e:
                    raise RuntimeError("no") from e
            """,
        "dup1.py": """
            def total(rows):
                s = 0  # running
                for r in rows:
                    if r > 10:
                        s += r * 2
                print("done", s)
                return s
            """,
        "dup2.py": """
            import sys
            def summed(items):
                acc = 1
                for item in items:
                    if item > 99:
                        acc += item * 3
                print('finished', acc)
                return acc
            """,
        "dup3.py": """
            value = 7
            def summed(things):
                acc = 1
                for thing in things:
                    if thing > 12:
                        acc += thing * 4
                print("over", acc)
                other()
            """,
        "secrets.py": f"""
            access = "{_KEY}"
            gh = '{_HEX}'
            password = "hunter2!"
            api_key: str = load()
            signing = "{_RANDOM}"
            url = "postgres://bob:pw1@db.local/x"
            path_key = "/usr/share/{_RANDOM}"
            """,
        "stale.py": f"""
            # TODO: split this
            x = 1  # FIXME trailing ones are not seen
            {_Q}
            hack: inside a string
            {_Q}
            # total = 0
            # for x in rows:
            #     total = x
            # plain words here

            # just prose
            # more prose
            # and more
            """,
        "stale.m": """
            % XXX look again
            %! kept
            % y = 3;
            % if y
            % end
            y = 4;
            """,
    }.items()
}

#: (path, line, author, ts_epoch); ``NOW`` is the time the ages are taken from.
NOW = 1_700_000_000
BLAME = [
    ("stale.py", 1, "ann", NOW - 10 * 86_400),
    ("stale.py", 4, "bob", NOW - 200 * 86_400),
    ("stale.py", 6, "ann", NOW - 40 * 86_400),
    ("stale.py", 8, "bob", NOW - 400 * 86_400),
    ("stale.m", 1, "cid", NOW - 364 * 86_400),
]


def files(spark: SparkSession) -> DataFrame:
    return literal(spark, TEXTS)


def blame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BLAME, "path string, line int, author string, ts_epoch long")


#: What ``git blame -p`` says of a file of four lines and three commits, one of them in two places.
_SHA = ("a" * 40, "b" * 40, "c" * 40)
PORCELAIN = {
    "stale.py": "\n".join([
        f"{_SHA[0]} 1 1 2", "author ann", "author-mail <ann@example.org>", "author-time 1699000000", "author-tz +0000", "summary first", "filename stale.py", "\t# TODO: split this", f"{_SHA[0]} 2 2", "\tx = 1",
        f"{_SHA[1]} 3 3 1", "author bob b.", "author-time 1680000000", "summary author of it", "filename stale.py", "\tauthor = 3", f"{_SHA[0]} 9 4 1", "\tauthor-time 7", f"{_SHA[2]} 5 5 1", "filename stale.py", "\ty", "",
    ]),
    "none.py": "",
}


def values_sql(texts: dict[str, str] | None = None) -> str:
    """A tree as a DuckDB VALUES list of (path, text)."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({quote(p)}, {quote(t)})" for p, t in sorted((texts or TEXTS).items())) + ") AS f(path, text)"


#: A second tree, for variable flow.
FLOW = {
    path: dedent(text).lstrip("\n")
    for path, text in {
        "lib/__init__.py": "from .base import LIMIT, clean\n",
        "lib/base.py": """
            import os.path
            LIMIT = 10
            limit = LIMIT
            clean = str.strip

            def unused(a, _b, *rest, key=None, **more):
                return key
            """,
        "app.py": """
            import json, sys
            import lib.base.deep
            from lib import clean, missing as gone
            from lib.base import LIMIT
            from elsewhere import thing

            x = LIMIT
            x = int(x)
            y, (z, *w) = x, x
            for x in x:
                total = x + y
            names = [k for k in names_of(y) if k]
            late = k

            class Job:
                SIZE = 3

                def __init__(self, size, url):
                    self.size = size
                    self.inner.deep = size
                    deep = url.lower()
                    requests.get(url, params=size)
                    settings.get(size)
                    return deep

                async def run(self, rows):
                    rows += clean(rows)
                    with open(rows) as handle, other:
                        data = handle.read()
                        body: str = data.encode()
                        print(json.dumps(body), file=handle)
                    loop = body
                    loop = again(loop)
                    return loop.decode()
            """,
        "bad.py": "def (:\n",
    }.items()
}


def flow_files(spark: SparkSession) -> DataFrame:
    return literal(spark, FLOW)


def sql_value(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(sql_value, v)) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def rows_sql(rows: list[tuple], columns: str) -> str:
    """A DuckDB table of rows; columns: ``name type`` pairs, as in a schema of Spark."""
    kinds = [c.split() for c in columns.split(", ")]
    to = {"string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN", "array<int>": "INTEGER[]", "long": "BIGINT"}
    cast = ", ".join(f"CAST({name} AS {to[kind]}) AS {name}" for name, kind in kinds)
    names = ", ".join(name for name, _ in kinds)
    return f"(SELECT {cast} FROM (VALUES " + ", ".join("(" + ", ".join(map(sql_value, r)) + ")" for r in rows) + f") AS t({names}))"

#: A third tree: MATLAB sources, and the Python files they call.
MATLAB = {
    path: dedent(text).lstrip("\n")
    for path, text in {
        "main.m": """
            function [a, b] = outer(x, y, unused)
              % it's a comment with if
              global G H
              if x > 0 && y(end) > 1
                for k = 1:3
                  s = 'if end % no';
                end
              elseif y || x
                while true
                end
              end
              a = double(x) + ...
                  y;   % note
              load data.mat P Q
              [c, ~, d.f] = size(a);
              for k = 1:c
                t = sprintf("done", k);
                disp(k)
              end
              if any(y) > plot(y, k)
              end
              helper(a, c);
            end

            function other(z)
              a = z';
              Box(a);
              run('scripts/start')
            end
            """,
        "helper.m": """
            function r = helper(p, q)
            persistent n
            try
              fid = fopen(p);
              load('a.mat')
            catch
              % nothing
            end
            try
              n = 1;
            catch ME
              disp(MEX)
              if q
                rethrow(ME)
              end
            end
            try
              n = 2;
            catch err
              n = 3; % err
            end
            fid = fopen(q);
            data = fread(fid);
            f2 = fopen(p);
            n = p;
            if f2 == -1
            end
            eval('x'); v = py.tools.clean.strip(n);
            fprintf(1, n);
            """,
        "noend.m": """
            function one(a)
            if a
              b = 1;
            end
            function two(b)
            c = b;
            """,
        "scripts/start.m": """
            %{
            helper(1)
            %}
            x = 1;
            x = x + 1;
            y = lonely(x);
            addpath('lib');
            run next;
            pyrunfile("job.py", 1);
            pyrun('import numpy.linalg');
            pyrun("from tools import clean")
            z = "a % b"; w = noend(z); % two(z)
            """,
        "scripts/next.m": "disp('next')\n",
        "lib/@Box/area.m": "function s = area(o)\ns = o;\nend\n",
        "lib/lonely.m": "function q = lonely(p)\nend\n",
        "test_case.m": "function test_case\neval('1')\nend\n",
        "tools/__init__.py": "",
        "tools/clean.py": "def strip(x):\n    return x\n",
        "job.py": "print(1)\n",
        "idle.py": "x = 1\n",
        "lib/dead.m": "function dead()\nend\n",
    }.items()
}


def matlab_files(spark: SparkSession) -> DataFrame:
    return literal(spark, MATLAB)
