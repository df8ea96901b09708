"""Files, lines and the in-row text functions."""

import math
import subprocess

from pyspark.sql import functions as F

from stratalens.functions.text import entropy
from stratalens.operators import duplicates, secrets
from stratalens.plans.staging import stage
from stratalens.sources import blame, files


def test_tree(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "venv").mkdir()
    (tmp_path / "pkg" / "a.py").write_bytes(b"x = 1\r\ny = '\xff'\n")
    (tmp_path / "venv" / "b.py").write_bytes(b"no\n")
    (tmp_path / "c.bin").write_bytes(b"a\x00b")
    (tmp_path / ".env").write_bytes(b"A=1\n")
    (tmp_path / "pkg" / "__init__.py").write_bytes(b"")
    got = {r.path: (r.ext, r.text) for r in files.tree(spark, str(tmp_path)).collect()}
    assert got == {"pkg/a.py": (".py", "x = 1\r\ny = '�'\n"), ".env": ("", "A=1\n"), "pkg/__init__.py": (".py", "")}


def test_tree_of_an_odd_root(spark, tmp_path):
    root = tmp_path / "a+b (1)"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg" / "m.py").write_bytes(b"x")
    (root / "pkg" / "_m.py").write_bytes(b"y")
    assert sorted(tuple(r) for r in files.tree(spark, str(root)).collect()) == [("pkg/_m.py", ".py", "y"), ("pkg/m.py", ".py", "x")]


def test_blame(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=ann", "-c", "user.email=a@example.org", *a], cwd=tmp_path, check=True, capture_output=True)
    (tmp_path / "m.py").write_text("x = 1\ny = 2\n")
    run("init", "-q")
    run("add", "m.py")
    run("commit", "-q", "-m", "one")
    asked = spark.createDataFrame([("m.py",), ("unknown.py",)], "path string")
    found = blame.porcelain(blame.blame_output(asked, str(tmp_path))).collect()
    assert sorted((r.path, r.line, r.author) for r in found) == [("m.py", 1, "ann"), ("m.py", 2, "ann")] and all(r.ts_epoch > 1e9 for r in found)


def test_lines(spark):
    found = files.lines(files.literal(spark, {"a.txt": "one\r\ntwo\rthree\n\nfive", "b.txt": "", "c.txt": "x\x0cy"}))
    assert sorted((r.path, r.line, r.raw) for r in found.collect()) == [("a.txt", 1, "one"), ("a.txt", 2, "two"), ("a.txt", 3, "three"), ("a.txt", 4, ""), ("a.txt", 5, "five"), ("c.txt", 1, "x\x0cy")]
    assert files.lines(files.literal(spark, {"c.txt": "x\x0cy"}), wide=True).count() == 2


def test_entropy(spark):
    for text in ("", "a", "ab", "aabbccdd", "hällo wörld"):
        want = -sum(text.count(c) / len(text) * math.log2(text.count(c) / len(text)) for c in set(text)) if text else 0.0
        assert abs(spark.range(1).select(entropy(F.lit(text))).first()[0] - want) < 1e-9


def test_normalised(spark):
    line = lambda text, ext: spark.range(1).select(duplicates.normalised(F.lit(text), F.lit(ext))).first()[0]
    assert line("    total = rows[3] + 1.5e3  # note", ".py") == "_VAR_ = _VAR_[_VAR_] + _VAR_"
    assert line("x = '#no' + f(\"a\") # yes", ".py") == '_VAR_ = "_STR_" + _VAR_("_STR_")'
    assert line("if naïve in d.items():", ".py") == "if _VAR_ in _VAR_.items():"
    assert line("y = sum(x) % total", ".m") == "_VAR_ = sum(_VAR_)"


def test_ignored(spark):
    held = files.literal(spark, {"a/b.py": "x", "out/c.py": "x", "d.log": "x"})
    assert [r.path for r in secrets.ignored(held, ["out/", "*.log", "# note", "!keep"]).collect()] == ["a/b.py"]


def test_stage(spark):
    df = spark.range(5)
    assert stage(df, "t").count() == 5
