"""Hand-worked cases of the core operators."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import capture, chunking, decisions, evaluation, filters, fusion, graph, incremental, lexical, overview, retrieval, workspace
from tessera.plans import core_queries, pipeline
from tessera.sources import files as src


def test_rrf_ranks_start_at_zero(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "qid int, id int, rank int")
    b = spark.createDataFrame([(0, 2, 1), (0, 3, 2), (0, None, 3)], "qid int, id int, rank int")
    got = {r.id: r.score for r in fusion.rrf([a, b]).collect()}
    assert got == {2: round(1 / 61 + 1 / 60, 9), 1: round(1 / 60, 9), 3: round(1 / 61, 9)}


@pytest.mark.parametrize(("wa", "wb", "a", "b", "want"), [(0.5, 0.5, {1: 10, 2: 5}, {1: 1, 2: 0.5}, {1: 1.0, 2: 0.0}), (0.8, 0.2, {1: 10, 2: 0}, {1: 0, 2: 1}, {1: 0.8, 2: 0.2}), (0.5, 0.5, {1: 7}, {1: 3}, {1: 1.0})])
def test_weighted(spark, wa, wb, a, b, want):
    f = lambda x: spark.createDataFrame([(0, k, float(v)) for k, v in x.items()], "qid int, id int, score double")
    assert {r.id: r.score for r in fusion.weighted([f(a), f(b)], [wa, wb]).collect()} == want


def test_weights_are_checked(spark):
    a = spark.createDataFrame([(0, 1, 1.0)], "qid int, id int, score double")
    with pytest.raises(ValueError):
        fusion.weighted([a], [0.5])
    with pytest.raises(ValueError):
        fusion.weighted([a], [0.5, 0.5])


def test_diversify_equals_the_greedy_choice(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for q in range(30):
        items = sorted(((round(rng.random(), 2), rng.randint(-1, 3)) for _ in range(12)), reverse=True)
        rows += [(q, i, s, i + 1, c) for i, (s, c) in enumerate(items)]
        left, seen, order = [(s, i, c) for i, (s, c) in enumerate(items)], set(), []
        while left:
            best = max(left, key=lambda x: (round(x[0] - (0.5 if x[2] in seen and x[2] != -1 else 0), 9), -x[1]))
            left.remove(best)
            seen.add(best[2])
            order.append(best[1])
        want[q] = order
    df = spark.createDataFrame(rows, "qid int, id int, score double, rank int, community int")
    got = {}
    for r in fusion.diversify(df).orderBy("qid", "new_rank").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == want


def test_centrality_boost(spark):
    r = spark.createDataFrame([(0, "hub", 0.5), (0, "leaf", 0.5)], "qid int, node string, score double")
    s = spark.createDataFrame([("hub", 0.4)], "node string, pagerank double")
    assert {x.node: x.score for x in fusion.centrality_boost(r, s).collect()} == {"hub": 0.75, "leaf": 0.5}


def test_reverse_closure_takes_the_least_hop(spark):
    e = spark.createDataFrame([("A", "T", "calls"), ("B", "T", "calls"), ("A", "B", "calls"), ("T", "A", "calls"), ("S", "T", "similar"), ("C", None, "calls")], "src string, dst string, kind string")
    t = spark.createDataFrame([("T",)], "target string")
    assert {(r.node, r.hop) for r in graph.closure(e, t, 3).collect()} == {("A", 1), ("B", 1)}


def _pagerank(edges, rounds=2000):
    """Brute force, far beyond convergence."""
    links = {(a, b) for a, b in edges if a is not None and b is not None}
    nodes = {x for link in links for x in link}
    deg = Counter(a for a, _ in links)
    r = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        new = dict.fromkeys(nodes, (0.15 + 0.85 * sum(r[x] for x in nodes if x not in deg)) / len(nodes))
        for a, b in links:
            new[b] += 0.85 * r[a] / deg[a]
        if new == r:
            break
        r = new
    return r


# a long chain into a cycle, a hub, a sink, a repeated edge and an open one: far from done after 5 rounds
LINKS = [(f"c{i}", f"c{i + 1}") for i in range(30)] + [("c30", "x"), ("x", "y"), ("y", "x"), ("a", "h"), ("b", "h"), ("b", "h"), ("h", "sink"), ("h", None)]


def test_pagerank_converges(spark):
    e = spark.createDataFrame(LINKS, "src string, dst string")
    want = _pagerank(LINKS)
    got = {r.node: r.pagerank for r in graph.pagerank(e, rounds=200, tolerance=1e-10).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    early = {r.node: r.pagerank for r in graph.pagerank(e, rounds=5).collect()}
    assert max(abs(early[k] - want[k]) for k in want) > 1e-3
    assert {r.pagerank for r in graph.pagerank(e, rounds=5, tolerance=1e-10).collect()} == {0.0}


def test_pagerank_query_has_converged(spark):
    d = "/root/testdata/sf0.001"
    want = _pagerank([(r.src, r.dst) for r in core_queries._edges(spark, d).select("src", "dst").collect()])
    got = {r.node: r.pagerank for r in core_queries.graph_pagerank_converged(spark, d).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 2e-9


def test_impact_ranks_by_pagerank_before_in_degree(spark, monkeypatch):
    # a has the larger in-degree, b the larger score: its one reference comes from a hub
    links = [("a", "T"), ("b", "T"), ("z", "T"), ("y", "T"), ("h", "b"), *((f"h{i}", "h") for i in range(9)), ("p", "a"), ("q", "a")]
    e = spark.createDataFrame([(s, t, "calls") for s, t in links], "src string, dst string, kind string")
    monkeypatch.setattr(core_queries, "_edges", lambda *_: e)
    monkeypatch.setattr(core_queries, "_targets", lambda *_: spark.createDataFrame([("T",)], "target string"))
    got = core_queries.impact_by_pagerank(spark, "").orderBy("rank").collect()
    score, near = _pagerank(links), Counter(t for _, t in links)
    hop = {"a": 1, "b": 1, "y": 1, "z": 1, "h": 2, "p": 2, "q": 2} | {f"h{i}": 3 for i in range(9)}
    assert [r.node for r in got] == sorted(hop, key=lambda x: (hop[x], -round(score[x], 9), -near[x], x))
    assert [r.node for r in got][:2] == ["b", "a"]


def test_pack_context_skips_what_does_not_fit(spark):
    n = spark.createDataFrame([(0, "a", 3.0, 0, 10), (0, "b", 2.0, 1, 95), (0, "c", 1.0, 1, 80), (0, "d", 0.5, 1, 1)], "qid int, id string, score double, hop int, chars int")
    assert [(r.id, r.body) for r in fusion.pack_context(n, 100).orderBy("rank").collect()] == [("a", True), ("b", False), ("c", True), ("d", False)]


def test_parent_rollup(spark):
    tree = spark.createDataFrame([("m.C.a", "m.C", "method"), ("m.C.b", "m.C", "method"), ("m.C.c", "m.C", "method"), ("m.C", "m", "class"), ("m.f", "m", "function"), ("m", None, "module")], "node string, parent string, kind string")
    hits = spark.createDataFrame([(0, "m.C.a", 0.9), (0, "m.C.b", 0.5), (0, "z", 0.1)], "qid int, node string, score double")
    assert {(r.node, r.score) for r in fusion.parent_rollup(hits, tree).collect()} == {("m.C", 0.9), ("z", 0.1)}


def _rollup(tree, hits):
    """Post-order with final claims, as the reference does it; hits {node: score}."""
    kids, kind = {}, {n: k for n, _, k in tree}
    for n, p, _ in tree:
        kids.setdefault(p, []).append(n)
    now, out = dict(hits), {}

    def visit(n):
        for k in kids.get(n, []):
            visit(k)
        hit = [k for k in kids.get(n, []) if k in now]
        if n in kind and len(hit) >= 2 and len(hit) >= fusion.ROLLUP.get(kind.get(n), 0.5) * len(kids[n]):
            out[n] = (max(now.pop(k) for k in [*hit, *([n] if n in now else [])]), 1)

    for top in {p for _, p, _ in tree if p not in kind} | {None}:
        visit(top)
    return {n: (s, 0) for n, s in now.items()} | out


@pytest.mark.parametrize("seed", range(3))
def test_rollup_tree_against_brute_force(spark, seed):
    rng, tree = random.Random(seed), []
    for m in range(12):
        tree.append((f"m{m}", f"p{m % 3}", "module"))
        for c in range(3):
            tree.append((f"m{m}.C{c}", f"m{m}", "class"))
            for f in range(3):
                tree.append((f"m{m}.C{c}.f{f}", f"m{m}.C{c}", "method"))
                tree += [(f"m{m}.C{c}.f{f}.g{g}", f"m{m}.C{c}.f{f}", "function") for g in range(2)]
        tree += [(f"m{m}.f{f}", f"m{m}", "function") for f in range(2)]
    hits = {n: round(rng.random(), 3) for n, _, _ in tree if rng.random() < 0.45} | {"z": 0.1}
    t = spark.createDataFrame(tree, "node string, parent string, kind string")
    h = spark.createDataFrame([(0, n, s) for n, s in hits.items()], "qid int, node string, score double")
    got = {r.node: (r.score, r.rolled) for r in fusion.rollup_tree(h, t).collect()}
    assert got == _rollup(tree, hits)
    assert {got[n][1] for n, _, k in tree if n in got and k == "module"} >= {1}


def test_rollup_tree_of_functions_and_cycles(spark):
    t = spark.createDataFrame([("m.f", "m", "function"), ("m.g", "m", "function"), ("m", None, "module"), ("a", "b", "class"), ("b", "a", "class"), ("s", "s", "class")], "node string, parent string, kind string")
    h = spark.createDataFrame([(0, "m.f", 0.4), (0, "m.g", 0.6), (0, "a", 0.2), (1, "m.f", 0.3)], "qid int, node string, score double")
    assert {(r.qid, r.node, r.score, r.rolled) for r in fusion.rollup_tree(h, t).collect()} == {(0, "m", 0.6, 1), (0, "a", 0.2, 0), (1, "m.f", 0.3, 0)}


@pytest.mark.parametrize("bad", [{"$or": 1}, {"a": {}}, {"a": {"eq": 1, "in": []}}, {"a": {"gt": 1}}, {"a": {"in": "x"}}])
def test_filters_refuse(bad):
    with pytest.raises(ValueError):
        filters.parse(bad)


def test_filters_and_scope(spark):
    df = spark.createDataFrame([(1, "A_b", "__project__"), (2, "axb", "dep"), (3, None, None)], "id int, name string, package string")
    pick = lambda c: [r.id for r in df.where(c).collect()]
    assert pick(filters.column(filters.parse({"name": {"like": "a_B"}}))) == [1]
    assert pick(filters.column(filters.parse({}))) == [1, 2, 3]
    assert pick(filters.column(filters.parse({"id": {"in": []}}))) == []
    rest, scopes = filters.split_scope(filters.parse({"scope": {"in": ["project_only"]}, "id": 1}))
    assert scopes == {"project_only"} and filters.fields(rest) == {"id"}
    assert pick(filters.scope_column({"project_only"})) == [1]
    assert pick(filters.scope_column({"project_only", "dependencies_only"})) == [1, 2]
    assert pick(filters.scope_column({"all"})) == [1, 2, 3]
    with pytest.raises(ValueError):
        filters.check(rest, {"name"})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("batch inference", [["batch"], ["inference"]]),
        ("a b", []),
        ("", []),
        (None, []),
        ("AND gate implementation", [["and"], ["gate"], ["implementation"]]),
        ("x OR", [["or"]]),
        ("Problem: x OR y", [["problem"], ["or"]]),
        ("red AND green OR blue", [["red", "green"], ["blue"]]),
        ("red green OR blue", [["red", "green"], ["blue"]]),
        ("red NOT green", [["red", "-green"]]),
        ("red NOT green blue", [["red", "-green"], ["red", "-blue"]]),
        ("red OR NOT blue", [["red"], ["or"], ["not"], ["blue"]]),
        ('say "shift"', [["say"], ["shift"]]),
        ("pkg.mod x", [["pkg", "mod"]]),
    ],
)
def test_match_grammar(text, want):
    assert [["-" * absent + t for t, absent in c] for c in lexical.match_clauses(text)] == want


def test_lexical_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red green red"), (2, "green"), (3, "red blue"), (4, None), (5, "Greens and reds")], "id long, text string")
    q = spark.createDataFrame([("a", "red AND green"), ("b", "red NOT green"), ("c", "blue OR greens"), ("d", "x")], "qid string, terms string")
    got = lambda ix: {(r.qid, r.id) for r in lexical.match(ix, q, "qid", "terms").collect()}
    index = lexical.build_index(docs, "id", F.col("text"))
    assert (index.documents, index.mean_length) == (5, 9 / 5)
    assert {(r.id, r.term): r.tf for r in index.postings.collect()}[1, "red"] == 2
    index.write(str(tmp_path / "ix"))
    for ix in (index, lexical.LexicalIndex.read(spark, str(tmp_path / "ix"))):
        assert got(ix) == {("a", 1), ("b", 3), ("c", 3), ("c", 5)}
    assert got(lexical.build_index(docs, "id", F.col("text"), stemmed=True)) == {("a", 1), ("a", 5), ("b", 3), ("c", 1), ("c", 2), ("c", 3), ("c", 5)}
    assert lexical.build_index(docs.limit(0), "id", F.col("text")).documents == 0


def test_literal_and_dense_search_in_blocks(spark, monkeypatch):
    m = spark.createDataFrame([(i, f"Name{i % 7}", None if i % 3 else f"doc {i}") for i in range(60)], "id long, name string, docstring string")
    n = spark.createDataFrame([("a", "NAME3"), ("b", "doc 1"), ("c", "name3"), ("d", " "), ("e", None), ("f", "e")], "qid string, needle string")
    v = spark.createDataFrame([(i, [float(i % 5), float(i % 3), 1.0]) for i in range(40)] + [(100, None), (101, [1.0])], "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 1.0, 0.0]), (2, [0.0, 0.0, 1.0]), (3, [2.0]), (4, None)], "qid long, embedding array<float>")
    seen = []
    for chars, numbers in ((5_000_000, 8_000_000), (1, 1)):
        monkeypatch.setattr(retrieval, "NEEDLE_CHARS", chars)
        monkeypatch.setattr(retrieval, "QUERY_NUMBERS", numbers)
        like = sorted(tuple(r) for r in retrieval.like_search(m, n, "qid", "needle", 4).collect())
        near = sorted(tuple(r) for r in retrieval.dense(v, q, 3).collect())
        seen.append((like, near))
    assert seen[0] == seen[1]
    assert [r for r in seen[0][0] if r[0] == "a"] == [("a", 3, 1), ("a", 10, 2), ("a", 17, 3), ("a", 24, 4)]
    assert {r[0] for r in seen[0][0]} == {"a", "b", "c", "f"}
    assert [r[:3] for r in seen[0][1] if r[0] == 2] == [(2, 0, 1.0), (2, 1, 1.0), (2, 2, 1.0)]
    assert [r for r in seen[0][1] if r[0] == 3] == [(3, 101, 2.0, 1)]


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("controlling", "control"), ("generalization", "gener"), ("sky", "sky"), ("agreed", "agre")])
def test_porter(word, stem):
    assert tx.porter(word) == stem


def test_stem_column(spark):
    df = spark.createDataFrame([(["running", "ponies"],), (None,)], "w array<string>")
    assert [r[0] for r in df.select(tx.stem("w")).collect()] == [["run", "poni"], None]


@pytest.mark.parametrize(("pattern", "path", "ok"), [("*.py", "a.py", True), ("*.py", "d/a.py", False), ("**/*.py", "d/e/a.py", True), ("**/*.py", "a.py", True), ("**", "x/y", True), ("a?c", "a/c", False)])
def test_glob(pattern, path, ok):
    import re

    assert bool(re.match(tx.glob_regex(pattern), path)) is ok


def test_hash_keeps_fields_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("é", None)], "x string, y string")
    assert df.select(tx.content_hash("x", "y")).distinct().count() == 3


def test_markdown_sections_skip_fences(spark):
    df = spark.createDataFrame([(1, "# One\ntext\n```\n# no\n```\n## Two\n#### deep\n# One\n```\n# open"), (2, None)], "doc_id int, text string")
    got = [(r.title, r.start_line, r.end_line, r.slug_no) for r in chunking.markdown_sections(df).orderBy("start_line").collect()]
    assert got == [("One", 1, 5, 0), ("Two", 6, 7, 0), ("One", 8, 10, 1)]


def test_other_chunkers(spark):
    df = spark.createDataFrame([(1, "Title\n=====\nbody\n\nNext\n--\nx")], "doc_id int, text string")
    assert [r.title for r in chunking.rst_sections(df).collect()] == ["Title"]
    ini = spark.createDataFrame([(1, "[a.b]\nx = 1\n[[c]]\ny = 2\nkey:\n  z")], "id int, text string")
    assert [r.title for r in chunking.header_sections(ini).orderBy("section").collect()] == ["a.b", "c", "key"]
    js = spark.createDataFrame([(1, '{\n  "a": {\n    "b": 1\n  },\n  "c": 2\n}')], "id int, text string")
    assert chunking.json_keys(js).first()["keys"] == ["a", "c"]
    nb = spark.createDataFrame([("n", '{"cells": [{"cell_type": "code", "source": ["a\\n", "b"]}, {"cell_type": "markdown", "source": "t"}]}')], "path string, content string")
    assert [(r.kind, r.source) for r in chunking.notebook_cells(nb).orderBy("cell").collect()] == [("code", "a\nb"), ("markdown", "t")]
    py = spark.createDataFrame([(1, "import a\nimport b\nclass C(B):\n    def f(self):\n        '''d'''\n        g.h()\n", "m"), (2, "def (", "m")], "id int, text string, module string")
    got = [(r.id, r.kind, r.name) for r in chunking.python_symbols(py).orderBy("id", "start_line").collect()]
    assert got == [(1, "imports", "a,b"), (1, "class", "C"), (1, "method", "C.f"), (2, "module", "m")]


def test_diff_merge_multiset(spark):
    old = spark.createDataFrame([(1, "p", "h"), (2, "p", "h"), (3, "p", None), (4, "p", "g")], "id long, package string, content_hash string")
    new = spark.createDataFrame([(11, "p", "h"), (12, "p", "k"), (13, "p", None)], "id long, package string, content_hash string")
    got = {(r.action, r.existing_id, r.incoming_id) for r in incremental.diff_merge(old, new, "package").collect()}
    assert got == {("keep", 1, 11), ("delete", 2, None), ("delete", 3, None), ("delete", 4, None), ("insert", None, 12), ("insert", None, 13)}


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "qid int, id string, rank int")
    gold = spark.createDataFrame([(1, "b"), (2, "x"), (1, "b")], "qid int, id string")
    got = {r.qid: (r.recall, r.mrr, r.ndcg, r.p1) for r in evaluation.ranking_metrics(ranked, gold).collect()}
    assert got == {1: (1.0, 0.5, round(1 / 1.584962500721156, 6), 0.0), 2: (0.0, 0.0, 0.0, 0.0)}
    assert evaluation.mcnemar(5, 0)[0] == 0.0625


def test_pipelines(spark):
    corpus = spark.createDataFrame([(i, "t", f"word{i % 5} common text", f"n{i}", "__project__" if i % 2 else "dep", [float(i % 3), 1.0]) for i in range(30)], "id long, title string, text string, node string, package string, embedding array<double>")
    q = spark.createDataFrame([("q1", "word1 text", [1.0, 0.5]), ("q2", "one two three four five six seven word2 eight", [0.2, 1.0])], "qid string, terms string, embedding array<double>")
    edges = spark.createDataFrame([("n1", "n2", "calls"), ("n6", "n7", "inherits")], "src string, dst string, kind string")
    s = pipeline.State(q, corpus, edges)
    for name in pipeline.PRESETS:
        out = pipeline.build(name)(s).ranked
        assert out.count() > 0, name
    scoped = pipeline.from_yaml("- {type: pre_filter, spec: {scope: project_only}}\n- {type: lexical}\n- {type: limit, n: 3}")(s).ranked
    assert all(r.id % 2 for r in scoped.collect())
    with pytest.raises(ValueError):
        pipeline.build([{"type": "nothing"}])
    with pytest.raises(KeyError):
        pipeline.build([{"type": "weighted", "branches": ["x"], "weights": [1.0]}])(s)


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "a" / "x.py").write_bytes(b"print(1)\xff\n")
    (tmp_path / ".git" / "y.py").write_text("no")
    (tmp_path / "big.md").write_text("x" * 2000)
    f = src.discover(spark, str(tmp_path), most=1000)
    assert [r.path for r in f.collect()] == ["a/x.py"]
    assert src.read_text(f).first().text == "print(1)�\n"
    assert len(src.fingerprint(f.withColumn("p", F.lit(1)), "p").first().fingerprint) == 16
    assert src.parse_requirements("# c\nA-b>=1,<2 ; python_version>'3'\n-r x\nc[extra]\n") == [("a_b", ">=1,<2"), ("c", "")]
    assert src.parse_pyproject('[project]\ndependencies = ["X-y==1"]\n[project.scripts]\ngo = "m:f"\n') == ([("x_y", "==1")], {"go": "m:f"})
    assert src.parse_pyproject('[project]\ndependencies = "no"\n[project.optional-dependencies]\na = ["P>1"]\n[dependency-groups]\nd = ["Q", {include-group = "a"}]\n')[0] == [("p", ">1"), ("q", "")]
    (tmp_path / "log").write_text("commit: abc\nauthor-date: 2025-01-01 00:00:00\nsubject: One\nbody: B\nmore\nfiles:\na.py\nb.py\n==END==\n")
    r = src.commit_log(spark, str(tmp_path / "log")).first()
    assert (r["commit"], r.subject, r.body, r.files) == ("abc", "One", "B\nmore", ["a.py", "b.py"])


def test_label_propagation_and_tree(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x")], "src string, dst string")
    got = {r.node: r.community for r in graph.communities(e, 4).collect()}
    assert got["a"] == got["b"] == got["c"] != got["x"] == got["y"] == got["z"]
    m = spark.createDataFrame([("p.q.r",), ("p.q.s",), ("p.t",)], "module string")
    assert {(r.node, r.parent, r.kind) for r in graph.package_tree(m).collect()} == {("p", None, "subpackage"), ("p.q", "p", "subpackage"), ("p.q.r", "p.q", "module"), ("p.q.s", "p.q", "module"), ("p.t", "p", "module")}


def test_reexports(spark):
    edges = spark.createDataFrame(
        [
            (1, "b", "b.x", "a.api.run", None, "calls"), (2, "a", "a.api", "run", "a.core.run", "imports"),  # resolved import
            (3, "b", "b.x", "a.api.stop", None, "calls"), (4, "a", "a.api", "core.stop", None, "imports"),  # relative import
            (5, "b", "b.x", "a.api.none", None, "calls"), (6, "a", "a.z", "a.api.run", None, "calls"),  # nothing; own project
            (7, "b", "b.x", "a.two.f", None, "calls"), (8, "a", "a.two", "f", "a.core.run.f", "imports"), (9, "a", "a.two", "core.f", None, "imports"),  # ambiguous
            (10, "b", "b.x", None, None, "calls"), (11, "b", "b.x", "plain", None, "calls"),
        ],
        "ref_id long, project string, src string, name string, dst string, kind string",
    )
    symbols = spark.createDataFrame([("a", n) for n in ("a.api", "a.core.run", "a.core.stop", "a.two", "a.core.run.f", "a.core.f")] + [("b", "b.x"), ("b", "b.x")], "project string, node string")
    got = sorted(tuple(r) for r in workspace.reexports(edges, symbols).collect())
    assert got == [(1, "b", "a", "a.core.run"), (3, "b", "a", "a.core.stop")]
    assert workspace.reexports(edges.limit(0), symbols).count() == 0


def test_similar_projects_and_scores(spark):
    s = spark.createDataFrame([(1, "a", "x", [1.0, 0.0]), (2, "a", "x", [0.0, 1.0]), (3, "b", "y", [1.0, 0.1]), (4, "b", "z", [0.0, 0.9]), (5, "b", "z", [0.5, 0.5]), (6, None, "w", [1.0, 1.0])], "id long, project string, node string, embedding array<double>")
    got = sorted(tuple(r) for r in workspace.similar_projects(s, 1, 0.6).collect())
    assert got == [("a", "x", "b", "y", 1.0, 1), ("b", "y", "a", "x", 1.0, 1), ("b", "z", "a", "x", 0.9, 1)]
    local = spark.createDataFrame([("p", "a", "b"), ("p", "b", None)], "project string, src string, dst string")
    cross = spark.createDataFrame([("p", "a", "q", "c")], "from_project string, from_node_id string, to_project string, to_node_id string")
    rows = {r.node: r for r in workspace.workspace_scores(local, cross).collect()}
    assert {n: r.in_degree for n, r in rows.items()} == {"p::a": 0, "p::b": 1, "q::c": 1}
    assert abs(sum(r.pagerank for r in rows.values()) - 1) < 1e-9


def test_walks_go_to_the_end_of_a_deep_tree(spark):
    deep = [("m", None, "module", "t")] + [(f"m.{i:02d}", "m" if i == 0 else f"m.{i - 1:02d}", "class", "t") for i in range(30)]
    t = spark.createDataFrame([*deep, ("u", "v", "class", "t"), ("v", "u", "class", "t")], "node string, parent string, kind string, text string")
    assert {r.module for r in capture.flatten_tree(t).where("node like 'm%'").collect()} == {"m"}
    assert {(r.node, r.module) for r in capture.flatten_tree(t).where("node not like 'm%'").collect()} == {("u", "u"), ("v", "v")}
    assert overview.prune_tree(t, spark.createDataFrame([("m.29",)], "node string")).count() == 31
    assert overview.prune_tree(t, spark.createDataFrame([("u",)], "node string")).count() == 2
    levels = {r.node: r.level for r in overview.node_budget(t, 100).collect()}
    assert levels["m.29"] == 30 and len(levels) == 31
    tree = spark.createDataFrame([(f"n{i}{s}", None if i == 0 else f"n{i - 1}a", "class") for i in range(12) for s in "ab" if i or s == "a"], "node string, parent string, kind string")
    hits = spark.createDataFrame([(1, f"n{i}b", 1.0) for i in range(1, 12)] + [(1, "n11a", 1.0)], "qid int, node string, score double")
    assert [(r.node, r.rolled) for r in fusion.parent_rollup(hits, tree).collect()] == [("n0a", 11)]


def test_decisions_are_mined_and_merged(spark):
    docs = spark.createDataFrame(
        [
            (1, "intro\n# 12. Use sidecar for vectors\nStatus: Accepted\nDate: 2024-05-01\nsee a.b.c and a.q"), (2, "# Other\nStatus: on hold\n"), (3, "no heading"), (4, None),
            (5, "## Replace the cache\none\ntwo\nthree\n\n# Short\nadopt it\n"), (6, "x # DECISION: Use the sidecar for vectors\ny\n# REJECTED: one file\n"),
        ],
        "doc_id long, text string",
    )
    adr = decisions.decision_records(docs)
    assert sorted((r.id, r.title, r.status, str(r.dated)) for r in adr.collect()) == [(1, "Use sidecar for vectors", "active", "2024-05-01"), (2, "Other", "proposed", "None"), (5, "Short", "proposed", "None"), (6, "REJECTED: one file", "proposed", "None")]
    log = decisions.changelog_decisions(docs)
    assert [(r.id, r.title) for r in log.collect()] == [(5, "Replace the cache")]
    marks = decisions.inline_markers(docs, "doc_id").withColumnRenamed("doc_id", "id")
    assert sorted((r.title, r.status, r.evidence.count("\n")) for r in marks.collect()) == [("Use the sidecar for vectors", "active", 3), ("one file", "rejected", 3)]
    prose = decisions.keyword_gate(docs)
    raws = decisions.mined(adr=adr, markers=marks, changelog=log, prose=prose).withColumn("package", F.lit("p")).withColumn("at", F.concat("source", F.lpad("id", 9, "0"), F.lpad(F.col("place").cast("string"), 9, "0")))
    keyed = raws.join(decisions.greedy_groups(raws, "package", "at"), ["package", "at"])
    best = {r.title: r for r in decisions.merged_decisions(keyed).collect()}
    assert (best["Use sidecar for vectors"].members, best["Use sidecar for vectors"].confidence, best["Use sidecar for vectors"].source) == (2, 1.0, "adr_files")
    names = decisions.mentioned_names(docs, spark.createDataFrame([("a.b.c.d",), (None,)], "node_id string"), "doc_id", "text")
    assert [tuple(r) for r in decisions.governs_edges(adr, names).collect()] == [("decision:use-sidecar-vectors", "a.b.c", "governs")]
    commits = spark.createDataFrame([("s1", None, "Migrate and replace it", ""), ("s2", None, "adopt", "a\nb"), ("s3", None, "adopt", "a\n\nb\nc"), (None, None, "migrate replace", "")], "sha string, at timestamp, subject string, body string")
    assert sorted(r.id for r in decisions.commit_decisions(commits).collect()) == ["s1", "s3"]


def test_relative_imports_and_annotated_attributes():
    import ast

    source = "from . import one\nfrom ..two import three as t\nfrom ....far import x\nclass K:\n    store: db.Store\n    def f(self):\n        self.store.get(t())\n"
    got = {(n, k, a, o) for _, n, k, a, o in capture._capture(ast.parse(source), "p.q.m")}
    assert {("p.q.one", "imports", None, None), ("p.two.three", "imports", None, None), ("far.x", "imports", None, None), ("t", "calls", "p.two.three", None), ("self.store.get", "calls", None, "db.Store")} <= got
    package = {n for _, n, k, _, _ in capture._capture(ast.parse(source), "p.q", True) if k == "imports"}
    assert package == {"p.q.one", "p.two.three", "far.x"}
