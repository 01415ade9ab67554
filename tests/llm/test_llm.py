"""Small cases for the training-data operators, against brute force where there is one."""

from __future__ import annotations

import random
import re
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.llm import code_docs, conversations, keyword_pages, leakage, mixing, neighbours, splitting

CHUNK = "id long, text string, source_path string, start_line int, piece string"


# 1: splitting


@pytest.mark.parametrize("seed", range(12))
def test_split_pieces_cover_the_text(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "x" * rng.randint(1, 400), "\n", "\r\n", "\r", "\n\n", "  \n", "End. ", "é漢"]) for _ in range(rng.randint(1, 400)))
    pieces, kind, _ = splitting.split_text(text, 500, 50)
    assert "".join(text[s:e] for _, s, e, _ in pieces) == text
    assert all(e - a <= 500 for a, _, e, _ in pieces) or len(text) <= 500
    assert all(s - a == min(50, s) for a, s, _, _ in pieces)
    assert kind in ("blank", "line", "inline")


def test_split_prefers_blank_lines():
    block = "a line of text\n" * 40
    pieces, kind, _ = splitting.split_text("\n".join([block] * 6), 1000, 100)
    assert kind == "blank"
    assert {how for *_, how in pieces} <= {"blank", "end"}


def test_split_boundary_classes():
    assert splitting.split_text("x" * 2001, 2000, 200)[1] == "inline"
    assert splitting.split_text("x" * 1500 + "\r\n" + "y" * 1500, 2000, 200)[1] == "line"
    assert splitting.split_text("x" * 1500 + "\n \t\n" + "y" * 1500, 2000, 200)[1] == "blank"
    # line ends inside a block count, those at its ends do not
    assert splitting.split_text("x" * 1000 + "\r\n" + "y" * 998 + "\r\n\r\n", 2000, 200)[1] == "blank"
    assert splitting.split_text("x" * 1000 + "\r\n" + "y" * 999 + "\r\n\r\nz", 2000, 200)[1] == "line"


def _boundary(text, limit):
    """The class by its definition: the longest block and the longest line."""
    lines = re.split("\r\n|\n|\r", text)
    flat = re.sub("\r\n", "\x00\n", text)
    blocks = re.split("(?:^|(?<=[\n\r]))(?:[ \t]*(?:\x00\n|\n|\r|$))+", flat)
    longest = max(len(re.sub("(?:\x00\n|\n|\r)$", "", b)) for b in blocks)
    return "blank" if longest <= limit else "line" if max(map(len, lines)) <= limit else "inline"


@pytest.mark.parametrize("seed", range(60))
def test_boundary_is_that_of_the_cuts(seed):
    rng = random.Random(seed)
    most = rng.choice([30, 60, 130])
    text = "".join(rng.choice(["word ", "x" * rng.randint(1, most), "\n", "\r\n", "\r", "\n\n", "\n \t\n", "End. "]) for _ in range(rng.randint(1, 60)))
    assert splitting.split_text(text, 100, 10)[1] == _boundary(text, 100)


def test_boundary_comes_from_merging(monkeypatch):
    text = "\n\n".join("line of text\n" * 9 for _ in range(5))
    assert splitting.split_text(text, 200, 20)[1] == "blank"
    monkeypatch.setattr(splitting, "merge", lambda segments, limit, overlap: segments)
    assert splitting.split_text(text, 200, 20)[1] == "line"


def test_split_rows(spark):
    rows = [(1, None, "p", 1, "a"), (2, "", "p", 1, "a"), (3, "one\ntwo\n", "p", 10, "b"), (4, "line\n" * 1000, "q", None, None), (5, "line\n" * 1000, "q", 7, None), (5, "line\n" * 1000, "q", 7, None)]
    out = splitting.split_oversized(spark.createDataFrame(rows, CHUNK)).collect()
    by = {i: [r for r in out if r.id == i] for i in range(1, 6)}
    assert not by[1]
    assert len(by[2]) == 1
    assert (by[3][0].start_line, by[3][0].end_line, by[3][0].boundary) == (10, 11, "blank")
    assert len(by[4]) == 4 and by[4][0].start_line is None
    assert len(by[5]) == 8
    ends = sorted((r.start_line, r.end_line) for r in by[5])
    assert ends[0][0] == 7 and max(e for _, e in ends) == 1006
    assert splitting.split_oversized(spark.createDataFrame([], CHUNK)).count() == 0


# 2: neighbours


def _vectors(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(centres[i % 12] + 0.35 * rng.normal(size=dim)).astype(np.float32).tolist() for i in range(n)]


def test_neighbours_match_brute_force(spark):
    dim = 16
    vecs = _vectors(600, dim)
    vecs[:40] = [vecs[0]] * 40  # a hot group of equal vectors
    rows = [(i, v) for i, v in enumerate(vecs)] + [(900, None), (901, [0.0] * dim), (902, [1.0] * 3), (903, [float("nan")] * dim), (904, [None] * dim), (905, [])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = {}
    for r in neighbours.all_neighbours(df, k=5, dim=dim, list_size=100).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour, r.cosine))
    want = neighbours.brute_force([r[0] for r in rows], [r[1] for r in rows], 5, dim)
    assert set(got) == set(want)
    hit = total = 0
    for i, near in want.items():
        mine = [n for _, n, _ in sorted(got[i])]
        assert len(mine) == 5
        hit += len(set(mine) & {n for n, _ in near})
        total += 5
    assert hit / total > 0.9
    assert [n for _, n, _ in sorted(got[39])] == [0, 1, 2, 3, 4]
    assert [n for _, n, _ in sorted(got[2])] == [0, 1, 3, 4, 5]


def test_similar_pairs(spark):
    dim = 16
    rows = list(enumerate(_vectors(400, dim, 3)))
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    want = {(min(i, n), max(i, n)) for i, near in neighbours.brute_force(*map(list, zip(*rows, strict=True)), 5, dim).items() for n, c in near if c >= 0.78}
    got = {tuple(r) for r in neighbours.similar_pairs(df, 0.78, dim=dim, list_size=60).collect()}
    assert len(want & got) >= 0.95 * len(want)
    assert len(got - want) <= 0.05 * len(want)
    assert neighbours.all_neighbours(df.limit(0), dim=dim).count() == 0
    assert neighbours.all_neighbours(df.limit(1), dim=dim).count() == 0


def test_long_list_as_a_grid(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    dim = 16
    rows = list(enumerate(_vectors(300, dim, 5)))
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    want = neighbours.brute_force(*map(list, zip(*rows, strict=True)), 5, dim)
    got = {}
    for r in neighbours.all_neighbours(df, k=5, dim=dim, list_size=300).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour))
    assert all([n for _, n in sorted(got[i])] == [n for n, _ in near] for i, near in want.items())


def test_lists_grow_with_the_vectors(spark):
    """More lists than the sample carries: recall stays, lists stay short, postings stay in proportion."""
    dim = 16
    found = {}
    for n in (1200, 4800):
        rng = np.random.default_rng(n)
        centres = rng.normal(size=(n // 25, dim))
        rows = [(i, (centres[i % len(centres)] + 0.3 * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]
        df = spark.createDataFrame(rows, "id long, embedding array<float>")
        want = neighbours.brute_force(*map(list, zip(*rows, strict=True)), 5, dim)
        got = {}
        for r in neighbours.all_neighbours(df, k=5, dim=dim, list_size=30, sample=160).collect():
            got.setdefault(r.id, set()).add(r.neighbour)
        hit = sum(len(got.get(i, set()) & {j for j, _ in near}) for i, near in want.items())
        vecs = neighbours.usable(df, "id", "embedding", dim).select("vec", F.array("id").alias("ids"))
        x = neighbours._unit(np.array([v for _, v in rows[:160]], np.float32))
        posted = neighbours._post_by_region(vecs, neighbours.fit_centroids(x, min(40, round((n / 30) ** 0.5))), dim, 30, neighbours.VISIT_RATIO, neighbours.VISIT_MOST)
        per_list = posted.groupBy("list").agg(F.count("*").alias("n"), F.count_if("stored").alias("k")).collect()
        found[n] = (hit / (5 * n), len(per_list), sum(r.n for r in per_list) / n, max(r.k for r in per_list))
    assert all(recall >= 0.95 for recall, *_ in found.values()), found
    assert all(lists >= 0.6 * n / 30 and longest < 30 * 12 for n, (_, lists, _, longest) in found.items()), found
    assert found[4800][2] < 1.5 * found[1200][2] + 1, found


# 3: conversations

STREAM = "line_id long, session_id string, uuid string, type string, subtype string, message struct<role:string,content:array<struct<type:string,text:string,id:string,name:string,tool_use_id:string>>>, seq int, ts timestamp, received_at timestamp, model string"


def _line(i, session, kind, text=None, role=None, uuid=None, use=None, result=None, seq=None, at=None):
    blocks = []
    if text is not None:
        blocks.append(("text", text, None, None, None))
    if use:
        blocks.append(("tool_use", None, use, "Read", None))
    if result:
        blocks.append(("tool_result", "ok", None, None, result))
    t = datetime(2025, 1, 1, 0, 0, at if at is not None else i % 60)
    return (i, session, uuid or f"u{i}", kind, None, (role, blocks), seq if seq is not None else i, t, t, "m")


def test_drop_reasons(spark):
    rows = [
        _line(1, "good", "user", "hi"), _line(2, " GOOD", "assistant", "yes"), _line(3, "Good", "user", result="t1"), _line(4, "good", "assistant", "done", use="t1"),
        _line(5, "empty", "user", "—"), _line(6, "empty", "result"),
        _line(7, "late", "assistant", "I start"), _line(8, "late", "user", "so"), _line(9, "late", None, "ok", role=" Model "),
        _line(10, "noreply", "user", "a"), _line(11, "noreply", "user", "b"), _line(12, "noreply", "assistant", "c"),
        _line(13, "tail", "user", "a"), _line(14, "tail", "assistant", "b"), _line(15, "tail", None, "c", role="human"),
        _line(16, "tool", "user", "a", use=None), _line(17, "tool", "assistant", "b", use="t9"),
        _line(18, None, "user", "a"),
        # delivered again, out of order
        _line(19, "again", "assistant", "b", at=20, seq=2), _line(20, "again", "user", "a", uuid="x", at=19, seq=1), _line(21, "again", "user", "a", uuid="x", at=19, seq=1),
    ]
    df = spark.createDataFrame(rows, STREAM)
    for size in (4096, 2):
        got = {tuple(r) for r in conversations.drop_reasons(df, size).collect()}
        assert got == {("empty", "empty"), ("late", "no_prompt"), ("noreply", "no_reply"), ("tail", "no_reply"), ("tool", "lost_tool")}
    whole = conversations.conversations(df).orderBy("session_id", "position").collect()
    assert [(r.session_id, r.position, r.speaker, r.text) for r in whole] == [("again", 0, "user", "a"), ("again", 1, "assistant", "b"), ("good", 0, "user", "hi"), ("good", 1, "assistant", "yes"), ("good", 2, "user", ""), ("good", 3, "assistant", "done")]
    assert conversations.drop_reasons(df.limit(0)).count() == 0


def _stored(batches):
    """Rows of one session: each batch is (minute of arrival, message names); a message's order is that of its name."""
    out = []
    for minute, names in batches:
        for u in names:
            k = ord(u) - ord("a")
            row = list(_line(len(out), "s", "user" if k % 2 == 0 else "assistant", u, uuid=u, seq=k, at=k))
            row[8] = datetime(2025, 1, 1, 2 + minute // 60, minute % 60)
            out.append(tuple(row))
    return out


def _edges(spark, batches):
    rows = conversations.message_rows(spark.createDataFrame(_stored(batches), STREAM))
    edges = conversations.overlap_edges(conversations.links(conversations.fragments(rows)))
    msgs = conversations.assemble(rows).orderBy("seq").collect()
    return sorted((r.a, r.b, r.shared, r.kind) for r in edges.collect()), [(r.uuid, r.contig) for r in msgs]


def test_overlapping_fragments_become_one_contig(spark):
    edges, msgs = _edges(spark, [(0, "bacd"), (120, "cdef"), (300, "gh")])
    assert edges == [(0, 1, 2, "overlap")]
    assert msgs == [(u, 1) for u in "abcdef"] + [("g", 2), ("h", 2)]


def test_contained_and_mixed_fragments(spark):
    edges, msgs = _edges(spark, [(0, "abcd"), (120, "c"), (240, "ebf"), (400, "c")])
    assert edges == [(0, 1, 1, "contained"), (0, 2, 1, "mixed"), (1, 3, 1, "contained")]
    assert msgs == [(u, 1) for u in "abcd"] + [("e", 2), ("f", 2)]


def test_messages_leave_along_edges_only(spark, monkeypatch):
    """Without the overlap graph a message that was delivered again stays, and its session seems to lack a reply."""
    df = spark.createDataFrame(_stored([(0, "abcd"), (120, "a"), (240, "c")]), STREAM)
    assert conversations.drop_reasons(df).count() == 0
    plain = conversations.links
    monkeypatch.setattr(conversations, "links", lambda f: plain(f).withColumn("a", F.lit(None).cast("long")))
    assert [tuple(r) for r in conversations.drop_reasons(df).collect()] == [("s", "no_reply")]


@pytest.mark.parametrize(
    ("batches", "edges", "contigs"),
    [
        # held by a fragment that is not the last one with these messages; and in one stored later
        (["abcd", "b", "bc"], [(0, 1, 1, "contained"), (0, 2, 2, "contained"), (2, 1, 1, "contained")], ["abcd"]),
        (["bc", "abcd"], [(1, 0, 2, "contained")], ["abcd"]),
        # the fragment before is stored later, or another one is stored in between
        (["cdef", "abcd"], [(1, 0, 2, "overlap")], ["abcdef"]),
        (["abcd", "xy", "cdef"], [(0, 2, 2, "overlap")], ["abcdef", "xy"]),
        # the first and the last overlap as both overlap the second
        (["abcd", "bcde", "cdef"], [(0, 1, 3, "overlap"), (0, 2, 2, "overlap"), (1, 2, 3, "overlap")], ["abcdef"]),
        # two ways on
        (["abc", "cde", "cfg"], [(0, 1, 1, "overlap"), (0, 2, 1, "overlap"), (1, 2, 1, "mixed")], ["abc", "de", "fg"]),
    ],
)
def test_overlap_graph_of_any_fragments(spark, batches, edges, contigs):
    got, msgs = _edges(spark, [(120 * k, b) for k, b in enumerate(batches)])
    assert got == edges
    assert ["".join(u for u, c in msgs if c == k) for k in sorted({c for _, c in msgs})] == contigs


def test_random_fragments_in_order(spark):
    """Contigs and tangles give the order of (ts, seq) with each message once, whatever was exported again."""
    rng = random.Random(5)
    rows, want = [], {}
    for k in range(80):
        n, lines, first = rng.randint(1, 14), [], {}
        for batch in range(rng.randint(1, 5)):
            a = rng.randrange(n)
            part = list(range(a, min(n, a + rng.randint(1, 8)))) if rng.random() < 0.7 else sorted(rng.sample(range(n), rng.randint(1, n)))
            lines += [(batch, m) for m in (rng.sample(part, len(part)) if rng.random() < 0.5 else part)]
        for batch, m in lines:
            i = len(rows) + 1
            row = list(_line(i, f"s{k}", "user" if m % 2 == 0 else "assistant", "x", uuid=f"{k}-{m}", seq=m % 3, at=m // 3))
            row[7] = None if m > 11 else row[7]
            row[8] = datetime(2025, 1, 1, 2 + 3 * batch)
            rows.append(tuple(row))
            first.setdefault(m, row)
        want[f"s{k}"] = [r[2] for r in sorted(first.values(), key=lambda r: (r[7] is None, r[7] or 0, r[6], r[0]))]
    df = spark.createDataFrame(rows, STREAM)
    got, alone = {}, 0
    for r in conversations._ranged(conversations.assemble(conversations.message_rows(df))).collect():
        got.setdefault(r.session_id, []).append(r.uuid)
        alone += r.at is not None
    assert got == want
    assert 0.2 * len(rows) < alone


def test_reasons_follow_the_contigs(spark, monkeypatch):
    """With other places in the contig the messages come in another order, and sessions are dropped for it."""
    df = spark.createDataFrame(_stored([(0, "abc"), (120, "bcd")]), STREAM)
    assert conversations.drop_reasons(df).count() == 0
    plain = conversations.contigs
    monkeypatch.setattr(conversations, "contigs", lambda *a: plain(*a).withColumn("offset", -10 * F.col("offset")))
    assert {tuple(r) for r in conversations.drop_reasons(df).collect()} == {("s", "no_prompt"), ("s", "no_reply")}


# 6: code and documentation


@pytest.mark.parametrize(
    ("name", "signature", "doc", "tells"),
    [
        ("rank_leaf", "def rank_leaf(self, a: int) -> bool", "Ranks the leaf.", False),
        ("rank_leaf", None, "Ranking leaf", False),
        ("rank_leaf", None, "rank_leaf(self,\n    a: int) -> bool", False),
        ("rank_leaf", None, "TODO: write docs", False),
        ("rank_leaf", None, "Inherited, see parent.", False),
        ("rank_leaf", None, ":param a: TODO\\n:type a: int", False),
        ("rank_leaf", None, "Parameters\n----------\na : int", False),
        ("rank_leaf", None, "Beschreibung fehlt.", False),
        ("rank_leaf", None, "Rank leaf.\n\nKeeps the oldest page on ties.", True),
        ("rank_leaf", None, "TODO\n\nNever blocks; a full heap is dropped.", True),
        ("rank_leaf", None, "Args:\n    a: Half-open, so the last stays out.", True),
        ("rank_leaf", None, "À documenter.", False),
        ("rank_leaf", None, None, False),
        ("rank_leaf", None, "  \n", False),
        (None, None, "Seconds since the last heading was fetched.", True),
        ("rank_leaf", "def rank_leaf(self, a", "x" * 100_000 + " y z", True),
        ("rank_leaf", "def rank_leaf(self, depth: int = 1, imp", "rank_leaf(self, depth, import)", False),
        ("rank_leaf", "rank_leaf(import: int, depth)", ":param import: TODO\n:type import: int\n:param depth: TODO", False),
        ("rank_leaf", None, "Generated stub - signature only.", False),
        ("rank_leaf", None, "@generated by stubmaker, do not edit", False),
        ("rank_leaf", None, "TODO: make this one much faster than it is now, " + "and faster " * 20, False),
        ("rank_leaf", None, "No documentation is available for this method yet, so please see the documentation of the base class, or write some here.", False),
        ("rank_list", None, "Empty rank in, empty list out.", True),
    ],
)
def test_informative(name, signature, doc, tells):
    assert code_docs.informative(doc, name, signature) is tells


def test_visit_functions():
    got = code_docs.visit_functions("    @wrap\n    async def f(x):\n        '''Doc.'''\n        def g(): pass\n        return 1\n")
    assert [(n, d, a, z) for n, d, _, a, z, _ in got] == [("f", "Doc.", 0, 4), ("g", None, 3, 3)]
    assert code_docs.visit_functions("def broken(:\n") == []


def test_functions_of_text_that_does_not_parse():
    src = "class K:\n    @wrap(\n        1,\n    )\n    def f(self, a=':', b={1: 2}) -> int:\n        \"\"\"Joins the\n        parts.\n        \"\"\"\n        import = (1,\n  2)\n        s = '''\ndef no(): pass\n'''\n\n        def g(): return 1\n        # end\n\n    x = 1\nasync def h(): 'Bad \\\\x'\ndef cut(a,\ndef last():\n    'Is last.'\n"
    lines = src.split("\n")
    assert code_docs.visit_functions(src) == [
        ("f", "Joins the\nparts.", "\n".join(lines[1:15]), 1, 14, True),
        ("g", None, lines[14], 14, 14, False),
        ("h", "Bad \\x", lines[18], 18, 18, False),
        ("last", "Is last.", "\n".join(lines[20:22]), 20, 21, False),
    ]


def test_functions_by_pattern_are_those_of_the_tree():
    src = "@a\n@b(\n  2)\nasync def f(x: dict[str, int] = {'a': 1}, *, y=lambda q: q) -> 'T':\n    r'''One\n      two.'''\n    class L:\n        def m(self): return '#'\n    return [\n1]\n\n# no\ndef g():\n\t# first\n\t\"Short.\"\n\treturn 1\n"
    assert code_docs.functions_by_pattern(src) == code_docs.visit_functions(src)


def test_pairs_of_a_chunk_that_does_not_parse(spark):
    m = spark.createDataFrame([(1, "m", "drop", "function", "drop(a)", "Evicts stale sessions before the cache warms.", [])], "id long, module string, name string, kind string, signature string, docstring string, parameters array<struct<name:string,annotation:string,default:string>>")
    c = spark.createDataFrame([(7, "m", "m.drop", "function", 10, 'def drop(a):\n    """Evicts stale sessions before the cache warms."""\n    import.append(a)\n')], "id long, module string, qualified_name string, kind string, start_line int, text string")
    assert [(r.id, r.chunk_id, r.first_line, r.last_line) for r in code_docs.code_pairs(m, c).collect()] == [(1, 7, 10, 12)]


def test_members_and_pairs(spark):
    schema = "id long, package string, module string, name string, kind string, signature string, return_annotation string, parameters array<struct<name:string,annotation:string,default:string>>, docstring string"
    doc = "Keeps the oldest page on ties."
    m = spark.createDataFrame(
        [(3, "p", "p.m", "rank", "Function ", "def rank()", None, None, doc), (2, "p", "p.m", "rank", "Function ", "def rank()", None, None, doc), (4, "p", "p.m", "C", "class", None, None, None, doc), (5, "p", "p.m", "flat", "method", None, None, [("a", None, None)], None)],
        schema,
    )
    assert [r.id for r in code_docs.members_telling(m).collect()] == [2]
    c = spark.createDataFrame([(1, "p.m", "p.m.rank", "function", 5, f'def rank():\n    """{doc}"""\n    return 1\n'), (2, "p.m", "p.m.x", "function", None, None)], "id long, module string, qualified_name string, kind string, start_line int, text string")
    r = code_docs.code_pairs(m, c).collect()
    assert [(x.id, x.chunk_id, x.first_line, x.last_line) for x in r] == [(2, 1, 5, 7)]
    assert code_docs.members_telling(m.limit(0)).count() == 0


# 7: leakage


def _prose(rng, n):
    return [rng.choice("alpha beta gamma delta omega sigma kappa lambda theta river stone cloud forest window table garden paper silver copper marble".split()) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n)]


def _longest(item, doc, share=0.1):
    """Brute force: longest item stretch with few enough edits (edit distance to any stretch of the document)."""
    best = 0
    for a in range(len(item)):
        row = [0] * (len(doc) + 1)
        for b in range(a, len(item)):
            new = [row[0] + 1]
            for j in range(len(doc)):
                new.append(min(row[j] + (item[b] != doc[j]), row[j + 1] + 1, new[j] + 1))
            row = new
            if min(row) <= share * (b - a + 1) + 1e-9 and item[b] in doc and item[a] in doc:
                best = max(best, b - a + 1)
    return best


def _find(ix, docs, templates):
    """The windows of each document, the bands as the join forms them, and the alignment."""
    enc = leakage.Words(*ix.lexicon)
    todo = []
    for i, text in docs:
        got = ix.passing(*enc.encode(text))
        hits = {}
        for h, w, at in zip(*(x.tolist() for x in got), strict=True) if got else ():
            for k in np.flatnonzero(ix.h == h):
                for c in (0, 1):
                    hits.setdefault((int(ix.owner[k]), ((at - int(ix.place[k])) // 6 + c) * 6), {}).setdefault(int(ix.place[k]), w != 0 and w == ix.w[k])
        todo.append((i, text, [p for p, x in hits.items() if sum(x.values()) >= leakage.MIN_HITS or templates and len(x) >= leakage.MIN_TEMPLATE_HITS]))
    return leakage.judge(ix, enc, todo, templates)


@pytest.mark.parametrize("seed", range(10))
def test_align_against_brute_force(seed):
    rng = random.Random(seed)
    item = _prose(rng, 70)
    part = item[5 : 5 + rng.choice([30, 38, 45, 60])]
    for _ in range(rng.randint(0, 8)):
        k = rng.randrange(len(part))
        part[k : k + 1] = rng.choice([[], [part[k], "extra"], ["other"]])
    words = _prose(rng, 20) + part + _prose(rng, 20)
    ix = leakage.ItemIndex([(1, " ".join(item))])
    got = _find(ix, [(9, " ".join(words))], False)
    want = _longest(item, words)
    if want >= 44:
        assert got and got[0][:2] == (9, 1)
    if want < 40:
        assert not got


def test_leaks(spark):
    rng = random.Random(1)
    item = _prose(rng, 60)
    wide = "".join(chr(ord(c) + 0xFEE0) if c.isalnum() else c for c in " ".join(item[:50]))
    numbered = "With `one_name` set to 41 and " + " ".join(item)
    docs = [(1, "> " + "\n> ".join(item[:45])), (2, wide), (3, " ".join(item[:30])), (4, None), (5, ""), (6, "<p>" + "​".join(" ".join(item)[i : i + 9] for i in range(0, 500, 9))), (7, " ".join(w if i % 5 else "other" for i, w in enumerate(item))), (1, "> " + "\n> ".join(item[:45]))]
    items = spark.createDataFrame([(10, " ".join(item), "x"), (11, None, "x"), (12, "short", "x")], "item_id long, text string, kind string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for words in (2_000_000, 10):
        got = {(r.doc_id, r.item_id) for r in leakage.leaks(df, items, block_words=words).where("kind = 'verbatim'").collect()}
        assert got == {(1, 10), (2, 10), (6, 10)}
    assert leakage.leaks(df.limit(0), items).count() == 0
    assert leakage.leaks(df, items.limit(0)).count() == 0
    assert numbered


def test_leak_from_far_into_a_very_long_item():
    words = ["q" + "".join(chr(97 + n // 26**i % 26) for i in range(4)) for n in range(9000)]
    ix = leakage.ItemIndex([(1, " ".join(words))])
    for first in (100, 8170, 8900):
        got = _find(ix, [(5, "before it " + " ".join(words[first : first + 50]) + " after it")], False)
        assert [(r[0], r[1], r[2], r[3], r[4]) for r in got] == [(5, 1, "verbatim", 50, 0)]


def test_reparameterised():
    rng = random.Random(2)
    words = _prose(rng, 90)
    item = " ".join(f"{w} {i // 3}" if i % 3 == 0 else w for i, w in enumerate(words))
    doc = " ".join(f"{w} {i // 3 + 500}" if i % 3 == 0 else w for i, w in enumerate(words))
    mixed = " ".join(f"{w} {rng.randint(1000, 1005)}" if i % 3 == 0 else w for i, w in enumerate(words))
    ix = leakage.ItemIndex([(1, item)])
    got = _find(ix, [(5, doc), (6, mixed)], True)
    kinds = {(r[0], r[2]) for r in got}
    assert (5, "verbatim") not in kinds and (5, "reparameterised") in kinds and (6, "reparameterised") not in kinds


# 8: mixing


def test_flow_repeats_no_more_than_needed():
    supply = {"a": (100, ["a"]), "b": (10, ["b"]), "a|b": (20, ["a", "b"])}
    flow = mixing.min_cost_flow(supply, {"a": 1, "b": 3}, {"a": 90, "b": 40})
    assert sum(x for (_, s), x in flow.items() if s == "a") == 90
    assert sum(x for (_, s), x in flow.items() if s == "b") == 40
    assert flow["a|b", "b"] == 20


def test_mix(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("red green blue stone river cloud paper".split())
    docs = [(i, " ".join(word() for _ in range(rng.randint(20, 80))) + str(i), ["Big Source", "big-source", "big_source "][i % 3]) for i in range(300)]
    docs += [(1000 + i, " ".join(word() for _ in range(40)) + str(i), "small") for i in range(30)]
    docs += [(2000, None, "small"), (2001, "", "small"), (2002, "text", None), (2003, "text", "unknown")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    goal = spark.createDataFrame([("big_source", 0.6, 1), ("Small", 0.3, 4), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    sample = mixing.mix(df, goal)
    rows = sample.collect()
    caps = {"big_source": 1, "small": 4}
    assert rows and all(1 <= r.repeats <= caps[r.source] for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)
    got = {r.source: r.actual_share for r in mixing.shares(sample, goal).collect()}
    assert abs(got["big_source"] - 0.6 / 0.9) < 0.02 and abs(got["small"] - 0.3 / 0.9) < 0.02 and got["absent"] == 0
    assert {tuple(r) for r in rows} == {tuple(r) for r in mixing.mix(df.repartition(5), goal).collect()}
    assert mixing.mix(df.limit(0), goal).count() == 0
    part = mixing.mix(df, goal, total_tokens=2000).collect()
    assert abs(sum(r.tokens * r.repeats for r in part) - 2000) < 300


def test_tokens_of_a_very_long_text():
    enc = mixing._encoding(mixing.TOKENIZERS, mixing.VOCABULARY)
    text = "some words and numbers 123\n" * 60_000
    assert mixing._length(enc, text) == len(enc.encode_ordinary(text))


# 9: keyword pages

PROSE = [
    "The index keeps at most twelve entries for each page, and the reader drops the oldest one when it runs out of room.",
    "We chose a small cache over a large table because the writer could not lock the file before the test was over.",
    "If the list returns nothing, check the path in the report and build it again after the next release of the tool.",
    "Nobody noticed that the counter was wrong until a second process tried to read the same row on a cold start.",
] * 30


def test_spam_pages(spark):
    links = "\n".join(f"- [best stone {i}](https://stone-{i}.example/river)" for i in range(30))
    tags = " ".join(f"#river{i}" for i in range(60))
    stuffed = ", ".join(["cheap stone", "buy stone", "stone online", "best river stone"] * 20)
    code = "\n".join(f"def f{i}(x):\n    return x + {i}" for i in range(30))
    log = "\n".join(f"2026-01-0{i % 9 + 1} 10:00 INFO stone: sealed {i} rows" for i in range(30))
    docs = [(1, links), (2, tags), (3, stuffed), (4, code), (5, log), (6, "\n\n".join(PROSE[:20])), (7, None), (8, ""), (9, "\n".join(PROSE[:20]) + "\n" + links[:300]), (10, stuffed.replace("e", "ｅ"))]
    prose = spark.createDataFrame([(t,) for t in PROSE], "text string")
    got = {r.doc_id: r.spam for r in keyword_pages.score_pages(spark.createDataFrame(docs, "doc_id long, text string"), prose).collect()}
    assert {i for i, s in got.items() if s} == {1, 2, 3, 10}
    assert len(got) == 10
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert keyword_pages.score_pages(empty, prose).count() == 0
    assert keyword_pages.score_pages(spark.createDataFrame([Row(doc_id=1, text="x y")]), prose.limit(0)).count() == 1


def test_model_is_fitted_on_all_prose(spark):
    """Long texts and texts beyond any number of characters count, in any order and partition."""
    rng = random.Random(3)
    long = " ".join(rng.choice(PROSE) for _ in range(6000))
    texts = [" ".join(rng.sample(PROSE[k % 4].split(), 12)) for k in range(40)] + [f"{k}, {k} | " * 70_000 for k in range(10)] + [long, "", None]
    assert len(long) > 500_000 and sum(len(t or "") for t in texts) > 5_000_000
    want = keyword_pages.ProseModel([t for t in texts if t]).surplus
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert np.array_equal(keyword_pages.fit_prose(df.repartition(3)).surplus, want)
    assert not np.array_equal(keyword_pages.ProseModel([t for t in texts if t and t != long]).surplus, want)


def test_lists_are_counted_not_drawn():
    """The expected slots of lists are those that many drawn lists have."""
    rng = random.Random(2)
    got, n = np.zeros((5, 5, 5)), 4000
    for _ in range(n):
        seq = [1] if rng.random() < 0.2 else []
        for _ in range(rng.choice(keyword_pages.ITEMS)):
            seq += [2] if rng.random() < 0.3 else [3] * rng.randint(1, 3)
            seq += [4] + ([2] if rng.random() < 0.5 else [])
        x = [0, 0, *seq[: 2 * keyword_pages.STRETCH]]
        for t in zip(x, x[1:], x[2:], strict=False):
            got[t] += 1 / n
    want = keyword_pages._slots(True, True)
    assert np.allclose(got, want, rtol=0.1, atol=0.03) and ((got > 0) <= (want > 0)).all()
    kinds = keyword_pages._lists(np.arange(len(keyword_pages.CLASSES)))
    assert len(kinds) == keyword_pages.LISTS
    model = keyword_pages.ProseModel(PROSE)
    assert np.array_equal(model.surplus, keyword_pages.ProseModel(PROSE[::-1]).surplus)


def test_perplexity_decides_what_is_spam(monkeypatch):
    """Without either of the two models other pages come out."""
    frames = " ".join(f"Our river {w} is the {w} stone for river and stone. Find stone {w}, stone river, stone {w} here." for w in ["cheap", "best", "free"] * 6)
    pages = {"prose": "\n\n".join(PROSE[:8]), "capitals": PROSE[0].upper(), "frames": frames, "links": "\n".join(f"[stone {i}](https://s{i}.example/)" for i in range(20)), "linked": "\n".join(f"{t} See https://s.example/{i} for it." for i, t in enumerate(PROSE[:6]))}

    def flagged():
        model, vocab = keyword_pages.ProseModel(PROSE), keyword_pages.Vocabulary()
        out = set()
        for name, text in pages.items():
            c = keyword_pages.page_counts(text, model, vocab)
            if sum(c.get(k, 0) for k in ("links", "tags", "keywords")) > 0.5 * sum(c.values()):
                out.add(name)
        return out

    assert flagged() == {"frames", "links"}
    both = keyword_pages._cost
    monkeypatch.setattr(keyword_pages, "_cost", lambda s: both(s) if len(s) == keyword_pages.LISTS else np.full((len(keyword_pages.CLASSES),) * 3, 9.0))
    assert flagged() > {"frames", "links", "prose"}  # no model of prose
    monkeypatch.setattr(keyword_pages, "_cost", lambda s: both(s) if len(s) != keyword_pages.LISTS else np.full((len(keyword_pages.CLASSES),) * 3, 9.0))
    assert "frames" not in flagged()  # no model of lists


def test_page_with_very_long_links_and_tags():
    model, vocab = keyword_pages.ProseModel(PROSE), keyword_pages.Vocabulary()
    for line in ("[stone](https://stone.example/" + "river/" * 2000 + ")", '<meta name="keywords" content="' + "stone; river; " * 2000 + '">'):
        c = keyword_pages.page_counts("\n".join([line] * 3), model, vocab)
        assert c.get("links", 0) + c.get("tags", 0) > 0.9 * sum(c.values())


def test_tree_decides_what_a_docstring_adds(spark, monkeypatch):
    """Without syntax trees nothing is known of a member, and restated names and parameters seem to tell something."""
    doc = ["Ranks the old leaf by depth.", "Old leaf of a fresh depth.", "Keeps the oldest page on ties."]
    m = spark.createDataFrame(
        [(1, "m", "rank_leaf", "function", "def rank_leaf(old: int, depth)", doc[0], []), (2, "m", "g", "function", None, doc[1], []), (3, "m", "h", "function", None, doc[2], [])],
        "id long, module string, name string, kind string, signature string, docstring string, parameters array<struct<name:string,annotation:string,default:string>>",
    )
    c = spark.createDataFrame([(7, "m", "m.g", "function", 10, f'def g(old, leaf, fresh=None, depth=0):\n    """{doc[1]}"""\n    return 1\n')], "id long, module string, qualified_name string, kind string, start_line int, text string")
    assert [r.id for r in code_docs.members_telling(m, c).collect()] == [3]
    assert {r.id for r in code_docs.members_telling(m).collect()} == {2, 3}  # without sources the parameters of 2 are not known
    monkeypatch.setattr(code_docs, "parse_function", lambda code: None)
    assert code_docs.informative(doc[0], "rank_leaf", "def rank_leaf(old: int, depth)") and code_docs.informative(doc[0], "rank_leaf", None)


def test_one_documentation_in_several_sources(spark):
    m = spark.createDataFrame([(1, " m ", "f", "method", None, "Keeps the\n   oldest page.", [])], "id long, module string, name string, kind string, signature string, docstring string, parameters array<struct<name:string,annotation:string,default:string>>")
    c = spark.createDataFrame([(i, "m", "m.f", "function", None, 'def f():\n    """Keeps the oldest page."""\n') for i in (1, 2, 2)], "id long, module string, qualified_name string, kind string, start_line int, text string")
    assert [r.id for r in code_docs.members_telling(m, c).collect()] == [1]
    assert code_docs.members_telling(m, c.limit(0)).count() == 1


def test_template_windows_find_leaks_and_slots_reject(spark, monkeypatch):
    """Other values in the slots come out as re-parameterised where they agree; without template windows nothing does."""
    rng = random.Random(5)
    item = " ".join(f"{w} {i // 4}" if i % 4 == 0 else w for i, w in enumerate(_prose(rng, 80)))
    swap = lambda f: " ".join(f(w) if w.isdigit() else w for w in item.split())
    docs = [(1, item), (2, swap(lambda w: str(int(w) + 700))), (3, swap(lambda w: str(rng.randint(700, 702)))), (4, item.upper()), (5, " ".join(f"_{w}_" for w in item.split()))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(10, item)], "item_id long, text string")
    got = {(r.doc_id, r.kind, r.slots_consistent) for r in leakage.leaks(df, items).collect()}
    assert got == {(1, "verbatim", True), (2, "reparameterised", True), (4, "verbatim", True), (5, "verbatim", True)}
    monkeypatch.setattr(leakage, "slots", lambda *a: (0, True))
    assert (3, "reparameterised") in {(r[0], r[2]) for r in _find(leakage.ItemIndex([(10, item)]), docs, True)}
    monkeypatch.setattr(leakage, "window_hashes", lambda ids, width: np.zeros(max(0, len(ids) - width + 1), np.uint64))
    assert not _find(leakage.ItemIndex([(10, item)]), docs, True)


def test_leak_with_very_long_markup_between_words():
    words = _prose(random.Random(6), 60)
    ix = leakage.ItemIndex([(1, " ".join(words))])
    for length in (20, 220, 5000):
        doc = " ".join(w + (f' <a href="https://x.example/{"path/" * (length // 5)}">' if i % 5 == 4 else "") for i, w in enumerate(words))
        assert [r[:3] for r in _find(ix, [(5, doc)], False)] == [(5, 1, "verbatim")]
    commented = " ".join(w + (" <!-- " + "note " * 300 + "-->" if i % 5 == 4 else "") for i, w in enumerate(words))
    assert [r[:3] for r in _find(ix, [(5, commented)], False)] == [(5, 1, "verbatim")]
