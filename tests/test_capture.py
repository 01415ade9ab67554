"""Reference capture and resolution, pattern members, trees, greedy merging, streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tessera.operators import capture, decisions, evaluation, overview
from tessera.streaming import events as stream

SOURCE = "import numpy as np\nfrom a.b import C as D\nclass K(D):\n    def __init__(self):\n        self.x = Box()\n    def f(self):\n        np.zeros(1)\n        self.x.open()\n        self.g()\n        helper()\n"


def test_references_and_resolution(spark):
    df = spark.createDataFrame([(1, SOURCE, "m.n"), (2, "def (", "m.n"), (3, None, "m.n")], "id int, text string, module string")
    r = capture.references(df)
    got = {(x.src, x.name, x.kind, x.alias_of, x.owner) for x in r.collect()}
    assert ("m.n.K", "D", "inherits", "a.b.C", None) in got
    assert ("m.n.K.f", "np.zeros", "calls", "numpy", None) in got
    assert ("m.n.K.f", "self.x.open", "calls", None, "Box") in got
    assert ("m.n", "a.b.C", "imports", None, None) in got
    nodes = spark.createDataFrame([("p", "a.b.C"), ("p", "lib.Box.open"), ("p", "u.helper"), ("q", "v.helper")], "package string, node string")
    out = {(x.name, x.dst, x.rule) for x in capture.resolve(r.withColumn("package", F.lit("p")), nodes).collect()}
    assert {("D", "a.b.C", "alias"), ("self.x.open", "lib.Box.open", "typed"), ("helper", "u.helper", "suffix"), ("self.g", None, "open"), ("a.b.C", "a.b.C", "exact")} <= out


def test_members_by_pattern():
    text = "def go(a,\n       b=(1, 2)) -> int:\n    '''Doc.'''\n    pass\nclass K(B):\n    def m(self): pass\ndef _no(): pass\n"
    assert capture.members_by_pattern(text) == [("function", "go", "(a, b=(1, 2)) -> int", "Doc."), ("class", "K", "(B)", ""), ("method", "m", "(self)", "")]


def test_pages_and_trees(spark):
    m = spark.createDataFrame([("p.m", "b", "def b()", "Does b.\nmore"), ("p.m", "a", None, "Does a."), ("p.m", "_c", "def _c()", "no"), ("p.m", "d", "def d()", " ")], "module string, name string, signature string, docstring string")
    mod = spark.createDataFrame([("p.m", "Module.")], "module string, text string")
    assert capture.doc_pages(m, mod).first().page == "Module.\n\na\n    Does a.\ndef b()\n    Does b."
    t = spark.createDataFrame([("p", None, "package", "x"), ("p.m", "p", "module", " "), ("p.m.C", "p.m", "class", "c"), ("p.m.C.f", "p.m.C", "method", "f"), ("z", None, "function", "z")], "node string, parent string, kind string, text string")
    assert {(r.node, r.module) for r in capture.flatten_tree(t).collect()} == {("p.m.C", "p.m"), ("p.m.C.f", "p.m"), ("z", "z")}


def test_greedy_groups_join_the_first_representative(spark):
    rows = [("p", 1, "cache rows in memory store"), ("p", 2, "cache rows in memory"), ("p", 3, "the cache rows in memory store"), ("p", 4, "drop everything"), ("q", 5, "cache rows in memory store")]
    df = spark.createDataFrame(rows, "package string, id int, title string")
    got = {r.id: r.group for r in decisions.greedy_groups(df, "package", "id", least=0.7).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_paired_bootstrap_and_power(spark):
    a = spark.createDataFrame([(i, 0.0) for i in range(50)], "k int, v double")
    b = spark.createDataFrame([(i, 1.0) for i in range(50)], "k int, v double")
    r = evaluation.paired_bootstrap(a, b, "k", "v", 50).first()
    assert (r["mean"], r.low, r.high) == (1.0, 1.0, 1.0)
    assert evaluation.pairs_needed(0.3, 0.9) < evaluation.pairs_needed(0.3, 0.7)


def test_partial_ratio_is_about_the_best_window():
    assert overview.partial_ratio("needle", "hay needle hay") == 100.0
    assert overview.partial_ratio("", "x") == 0.0
    assert overview.partial_ratio("abcd", "wxyz") < 30


def test_span_overlap(spark):
    s = "by string, lo int, hi int"
    a = spark.createDataFrame([("f", 1, 4), ("f", 3, 6), ("g", None, 2)], s)
    b = spark.createDataFrame([("f", 5, 8), ("g", 1, 2)], s)
    assert {(r.by, r.overlap) for r in overview.span_overlap(a, b).collect()} == {("f", 0.5), ("g", 0.0)}


def test_streams(spark, tmp_path):
    rows = [("a.PY", datetime(2025, 1, 1, 0, 0, i)) for i in range(3)] + [("build/b.py", datetime(2025, 1, 1, 0, 0, 1)), ("c.txt", datetime(2025, 1, 1, 1, 0, 0)), ("a.py", datetime(2025, 1, 1, 2, 0, 0))]
    df = spark.createDataFrame(rows, "path string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = stream.watched(stream.file_events(spark, str(tmp_path / "in"), df.schema), "path", [".py"], ["build"])
    out = stream.drain(stream.debounce(s, "path", "ts", "5 seconds", "1 second"), str(tmp_path / "o"), str(tmp_path / "l"))
    assert [(r.path, r.events) for r in out.collect()] == [("a.PY", 3)]
    seen = []
    stream.reindex(s, lambda b, i: seen.append(b.count()), str(tmp_path / "l2"))
    assert sum(seen) == 4
