"""Hierarchies and orphan references: hand-worked, random and edge cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import hierarchy as hi
from tessera.operators import orphans as orp


def brute(edges):
    parent = {}
    for c, p in edges:
        parent[c] = min(p, parent.get(c, p))
    out = {}
    for n in {x for e in edges for x in e}:
        way, at = [n], n
        while at in parent and parent[at] not in way:
            at = parent[at]
            way.append(at)
        if at in parent:
            ring = way[way.index(parent[at]) :]
            out[n] = (min(ring), -1, None, n in ring)
        else:
            out[n] = (at, len(way) - 1, way[::-1], False)
    return out


CASES = {
    "tree": [("b", "a"), ("c", "b"), ("d", "b"), ("e", "a")],
    "self": [("x", "x"), ("y", "x")],
    "ring": [("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), ("e", "d"), ("q", "p")],
    "chain": [(f"n{i + 1:03d}", f"n{i:03d}") for i in range(60)],
    "star": [(f"s{i}", "hub") for i in range(200)],
}
_r = random.Random(3)
CASES["random"] = [(f"r{i}", f"r{_r.randrange(i)}" if _r.random() < 0.97 else f"r{_r.randrange(150)}") for i in range(1, 150)]


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("most", [hi.MAX_COMPONENT, 2])
def test_hierarchy(spark, name, most):
    df = spark.createDataFrame(CASES[name] + [(None, "a"), ("a", None), (" ", "a")], "child string, parent string")
    rows = hi.hierarchy(df, "child", "parent", max_component=most).collect()
    assert {r.node_id: (r.root_id, r.depth, r.path, r.on_cycle) for r in rows} == brute(CASES[name])
    # numbers are those of a walk over sorted children, however large the component
    for root in {r.root_id for r in rows if r.depth >= 0}:
        tree = sorted((r for r in rows if r.root_id == root and r.depth >= 0), key=lambda r: r.path)
        assert [r.enter for r in tree] == list(range(len(tree)))
        assert [r.leave - r.enter for r in tree] == [sum(x.path[: len(r.path)] == r.path for x in tree) - 1 for r in tree]
    assert all(r.enter is None and r.leave is None for r in rows if r.depth < 0)


def test_hierarchy_numbers_and_descendants(spark):
    df = spark.createDataFrame([(" b", "a ", 1), ("b", "a", 2), ("c", "b", 3), ("d", "a", 4)], "child string, parent string, depth int")
    h = hi.hierarchy(df, "child", "parent")
    rows = {r.node_id: r for r in h.collect()}
    a, b = rows["a"], rows["b"]
    assert {n for n, r in rows.items() if a.enter < r.enter <= a.leave} == {"b", "c", "d"}
    assert {n for n, r in rows.items() if b.enter < r.enter <= b.leave} == {"c"}
    assert sorted(tuple(r) for r in hi.descendants(h).collect()) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 1), ("b", "c", 1)]
    assert hi.hierarchy(df.limit(0), "child", "parent").count() == 0


def test_key_runs_and_matching(spark):
    p = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (5, "x"), (6, "y"), (15, "y"), (16, "y"), (-1, "x"), (None, "x")], "k long, s string")
    at = lambda df: df.withColumn("bucket", orp.bucket_of(F.col("k"), 16))
    runs = orp.key_runs(at(p), "k", ["s"], ["bucket"])
    assert sorted((r.run_start, r.run_end, r.s) for r in runs.collect()) == [(-1, -1, "x"), (1, 3, "x"), (5, 5, "x"), (6, 6, "y"), (15, 15, "y"), (16, 16, "y")]
    refs = spark.createDataFrame([(i, k) for i, k in enumerate([0, 1, 3, 4, 5, 6, 7, 16, 17, -1, None] + [3] * 50)], "id int, k long")
    at = lambda df: df.withColumn("bucket", orp.bucket_of(F.col("k"), 2))
    runs = orp.key_runs(at(p), "k", ["s"], ["bucket"])
    for hot in (3, 1000):
        r, q = orp.salted(at(refs), runs, "bucket", ["id"], hot)
        assert (q.count() > runs.count()) == (hot == 3)
        m = {x.id: (x.matched, x.s) for x in orp.match_runs(r, "k", q, ["s"], ["bucket", "salt"]).collect()}
        assert [m[i][0] for i in range(11)] == [False, True, True, False, True, True, False, True, False, True, False]
        assert m[5][1] == "y" and m[0][1] is None and len(m) == 61


def test_runs_of_text_ids_hold_several_keys_and_end_at_gaps(spark):
    parents = spark.createDataFrame([(None, f"n{i:03d}", i % 50 != 7, None, False) for i in range(200) if i % 20 != 3], "proj string, node string, alive boolean, first_indexed timestamp, fixed boolean")
    refs = spark.createDataFrame([("t", i, None, f"n{i:03d}", None) for i in range(200)] + [("t", 1000 + i, None, "n005", None) for i in range(60)], "source_table string, ref_id long, proj string, node string, at timestamp")
    for hot in (orp.HOT, 5):
        r, p = orp.ranked_keys(refs, parents, 2, hot)
        runs = orp.index_runs(p).collect()
        assert sum(x.run_end - x.run_start + 1 for x in runs) / len(runs) > 3
        assert all(len(x.members) == x.run_end - x.run_start + 1 for x in runs)
        got = {(x.ref_id, x.state) for x in orp.orphan_references(refs, parents, 2, hot).collect()}
        assert got == {(i, "missing") for i in range(200) if i % 20 == 3} | {(i, "deleted") for i in range(200) if i % 50 == 7 and i % 20 != 3}


def test_find_orphans(spark):
    node = "ref_id long, from_package string, to_name string, to_node_id string, kind string, captured_at timestamp"
    from datetime import datetime as dt

    a, b, c = dt(2025, 1, 5), dt(2025, 2, 5), dt(2025, 3, 5)
    refs = spark.createDataFrame(
        [(1, "p", "x", " pkg.live ", "calls", b), (2, "p", "x", "pkg.gone", "calls", b), (3, "p", "x", "pkg.none", "calls", None), (4, "p", "x", "pkg.live", "calls", a), (5, "p", "pkg.none2", " ", "calls", b), (6, "p", "other.none", None, "calls", b), (7, "p", None, None, "calls", b), (8, "p", "x", "pkg.shared", "calls", a), (3, "p", "x", "pkg.none", "calls", None), (9, "p", "x", "PKG.live", "calls", b), (10, "p", "x", "pkg.live", "calls", None)],
        node,
    )
    cross = spark.createDataFrame([(1, "P", "pkg.live", b), (2, "Q", "pkg.live", b), (3, "P", "pkg.live", a)], "ref_id long, to_project string, to_node_id string, linked_at timestamp")
    tree = spark.createDataFrame([("P", "pkg.live", b, None), ("P", "pkg.live", c, a), ("P", "pkg.gone", a, b), ("P", None, a, None)], "project string, node_id string, indexed_at timestamp, deleted_at timestamp")
    shared = spark.createDataFrame([("S", "pkg.shared")], "project string, node_id string")
    packages = spark.createDataFrame([("pkg",), (None,)], "import_name string")
    got = sorted(tuple(r) for r in orp.find_orphans(refs, cross, tree, shared, packages).collect())
    assert got == [
        ("cross_references", 2, "missing", "2025-02"), ("cross_references", 3, "late", "2025-01"),
        ("node_references", 2, "deleted", "2025-02"), ("node_references", 3, "missing", "unknown"), ("node_references", 4, "late", "2025-01"), ("node_references", 5, "missing", "2025-02"), ("node_references", 9, "missing", "2025-02"),
    ]
    empty = orp.find_orphans(refs.limit(0), cross.limit(0), tree, shared, packages)
    assert empty.count() == 0
    assert orp.find_orphans(refs, cross, tree.limit(0), shared.limit(0), packages).where("state = 'missing'").count() == 11
