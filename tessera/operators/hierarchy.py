"""Parent-child rows to full hierarchies: path, depth, root, descendants and cycles.

Components are found first, each component is co-located, and one iterative depth-first walk with
node colouring numbers its nodes. A component above ``max_component`` nodes never meets in one task:
its nodes are resolved exactly by pointer doubling instead, and numbered by ranking the list of its Euler
tour, so the bound moves work but the columns are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tessera.session import blank_to_null, cut

#: Components above this number of nodes are resolved by pointer doubling.
MAX_COMPONENT = 200_000

NODES = T.StructType(
    [
        T.StructField("node_id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("root_id", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("enter", T.LongType()),
        T.StructField("leave", T.LongType()),
        T.StructField("on_cycle", T.BooleanType()),
    ]
)


def edges_of(df: DataFrame, child: str, parent: str) -> DataFrame:
    """Distinct (child, parent) rows with both ends trimmed and neither null nor blank."""
    return (
        df.select(blank_to_null(child).alias("child"), blank_to_null(parent).alias("parent"))
        .where("child is not null and parent is not null")
        .distinct()
    )


def connected_components(edges: DataFrame, a: str = "child", b: str = "parent") -> DataFrame:
    """(node, component) for an undirected edge list; component is the smallest node id in it.

    Alternates large-star and small-star: every node links its larger neighbours to the smallest node
    it knows, until nothing changes. The rounds grow with the logarithm of the longest path; each is a
    partial aggregate and an equi-join that AQE may split where one node holds many edges, and each
    round is checkpointed. Self loops are kept as single nodes; null ends are ignored.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = e.select(F.col("u").alias("node")).union(e.select(F.col("v"))).distinct()
    links = cut(
        e.where("u != v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct()
    )
    before = None
    while True:
        both = links.union(links.select("lo", "hi")).toDF("n", "o")
        least = both.groupBy("n").agg(F.least(F.min("o"), F.first("n")).alias("m"))
        large = both.where("o > n").join(least, "n").select(F.col("o").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi")
            .select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("x"))
            .select("x.hi", "x.lo")
            .where("hi != lo")
            .distinct()
        )
        links = cut(small)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return nodes.join(links.select(F.col("hi").alias("node"), F.col("lo").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def _walk(pairs: list[tuple[str, str | None]], paths: bool) -> Iterator[tuple]:
    """Depth-first over one component, a row for each node as the walk leaves it. pairs: (node, parent or None); a node has at most one parent."""
    parent = dict(pairs)
    kids: dict[str, list[str]] = {}
    for n, p in parent.items():
        if p is not None:
            kids.setdefault(p, []).append(n)
    white, grey, black = 0, 1, 2
    colour = dict.fromkeys(parent, white)
    cycle: dict[str, str] = {}  # node at or below a cycle -> smallest id of the cycle
    loops: set[str] = set()
    # upward walks colour the nodes and meet a grey node exactly where a back edge closes a cycle
    for start in sorted(parent):
        trail = []
        n = start
        while n is not None and colour[n] == white:
            colour[n] = grey
            trail.append(n)
            n = parent[n]
        if n is not None and colour[n] == grey:
            ring = trail[trail.index(n) :]
            least = min(ring)
            loops.update(ring)
            cycle.update(dict.fromkeys(ring, least))
        above = cycle.get(n) if n is not None else None
        for x in reversed(trail):
            colour[x] = black
            if x in cycle:
                above = cycle[x]
            elif above is not None:
                cycle[x] = above
    clock = 0
    for root in sorted(n for n, p in parent.items() if p is None):
        stack: list[tuple[str, int]] = [(root, -1)]
        way: list[str] = []
        while stack:
            n, entered = stack.pop()
            if entered >= 0:
                yield n, parent[n], root, len(way) - 1, list(way) if paths else None, entered, clock - 1, False
                way.pop()
                continue
            way.append(n)
            stack.append((n, clock))
            clock += 1
            stack.extend((k, -1) for k in sorted(kids.get(n, ()), reverse=True))
    for n, c in sorted(cycle.items()):
        yield n, parent[n], c, -1, None, None, None, n in loops


def hierarchy(df: DataFrame, child: str, parent: str, paths: bool = True, max_component: int = MAX_COMPONENT) -> DataFrame:
    """One row for each node at either end of a parent-child row.

    Columns: node_id, parent_id, root_id, depth (root 0), path (root first), enter and leave (preorder
    numbers within the component: the descendants of x are the rows of the same root_id whose enter is
    in (x.enter, x.leave]), on_cycle. In or below a cycle depth is -1, root_id is the smallest id of the
    cycle, and path, enter and leave are null.

    Null or blank ends drop the row; repeated rows count once; extra columns are ignored; an empty table
    gives no rows. Each node must have at most one distinct parent: of several, the smallest is taken.
    ``paths=False`` leaves path null. Components above ``max_component`` give the same values in every column.
    """
    edges = cut(edges_of(df, child, parent))
    links = edges.groupBy("child").agg(F.min("parent").alias("parent"))
    comp = connected_components(links)
    nodes = cut(comp.join(links, comp["node"] == links["child"], "left").select("component", "node", "parent"))
    sizes = nodes.groupBy("component").count().where(F.col("count") > max_component).select("component")
    giants = [r[0] for r in sizes.limit(1).collect()]
    if not giants:
        return _by_component(nodes, paths)
    small = nodes.join(sizes, "component", "left_anti")
    large = nodes.join(sizes, "component", "left_semi")
    return _by_component(small, paths).unionByName(_by_doubling(large, paths))


def _by_component(nodes: DataFrame, paths: bool) -> DataFrame:
    schema = pa.schema(
        [("node_id", pa.string()), ("parent_id", pa.string()), ("root_id", pa.string()), ("depth", pa.int32()), ("path", pa.list_(pa.string())), ("enter", pa.int64()), ("leave", pa.int64()), ("on_cycle", pa.bool_())]
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        def components() -> Iterator[list[tuple[str, str | None]]]:
            current, pairs = None, []
            for b in batches:
                for c, n, p in zip(*(x.to_pylist() for x in b.columns), strict=True):
                    if c != current:
                        if pairs:
                            yield pairs
                        current, pairs = c, []
                    pairs.append((n, p))
            if pairs:
                yield pairs

        out, size = [], 0
        for pairs in components():
            for row in _walk(pairs, paths):
                out.append(row)
                size += 1 + len(row[4] or ())
                if size > 500_000 or len(out) >= 20_000:
                    yield flush(out)
                    out, size = [], 0
        yield flush(out)

    return nodes.select("component", "node", "parent").repartition("component").sortWithinPartitions("component").mapInArrow(walk, NODES)


def _by_doubling(nodes: DataFrame, paths: bool) -> DataFrame:
    """Exact for components of any size: each round doubles how far up every node sees."""
    links = nodes.select("node", "parent")
    state = cut(
        links.select("node", F.coalesce("parent", "node").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("d"), F.col("parent").isNull().alias("done"), F.col("node").alias("least"))
    )
    total = state.count()
    rounds = max(1, total.bit_length() + 1)
    for _ in range(rounds):
        if not state.where("not done").limit(1).count():
            break
        o = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"), F.col("done").alias("done2"), F.col("least").alias("least2"))
        state = cut(
            state.where("not done")
            .join(o, "up")
            .select("node", F.col("up2").alias("up"), (F.col("d") + F.col("d2")).alias("d"), F.col("done2").alias("done"), F.least("least", "least2").alias("least"))
            .union(state.where("done").select("node", "up", "d", "done", "least"))
        )
    ended = state.where("done").select("node", F.col("up").alias("root_id"), F.col("d").cast("int").alias("depth"), F.lit(False).alias("on_cycle"))
    # after that many doublings an endless node points into its cycle, and its least covers every node of it
    endless = state.where("not done")
    ring = cut(endless.select(F.col("up").alias("node")).distinct())
    ring_least = ring.join(endless, "node").select(F.col("node").alias("up"), F.col("least").alias("root_id"))
    members = endless.join(ring_least, "up").select("node", "root_id")
    # the ring turns under doubling, so its nodes are exactly the nodes that are pointed at
    on = ring.withColumn("hit", F.lit(True))
    looped = members.join(on, "node", "left").select("node", "root_id", F.lit(-1).alias("depth"), F.coalesce("hit", F.lit(False)).alias("on_cycle"))
    res = ended.unionByName(looped)
    if paths:
        res = res.join(_paths(links, state.where("done").select("node")), "node", "left")
    else:
        res = res.withColumn("path", F.lit(None).cast("array<string>"))
    tour = cut(_preorder(links.join(ended.select("node"), "node", "left_semi")))
    # what the tour has left at a root is the size of its tree; roots of components this large are few
    totals = F.broadcast(ended.where("depth = 0").select("node").join(tour, "node").select(F.col("node").alias("root_id"), F.col("down").alias("total")))
    res = res.join(tour, "node", "left").join(totals, "root_id", "left")
    res = res.withColumn("enter", F.col("total") - F.col("down")).withColumn("leave", F.col("enter") + F.col("size") - 1)
    return res.join(links, "node").select(F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), "root_id", "depth", "path", "enter", "leave", "on_cycle")


def _next_sibling(links: DataFrame) -> DataFrame:
    """(node, sibling): the next child of the same parent by id. A range sort, so that the children of one parent may fill many partitions."""
    ordered = links.where("parent is not null").repartitionByRange("parent", "node").sortWithinPartitions("parent", "node")
    ordered = cut(ordered.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    w = W.partitionBy("part").orderBy("at")
    # what follows the last row of a partition: the first of the next one that has any, one row for each partition
    heads = ordered.groupBy("part").agg(F.min_by(F.struct("parent", "node"), "at").alias("head"))
    heads = heads.select("part", F.lead("head").over(W.orderBy("part")).alias("head"))
    near = ordered.withColumn("after", F.lead(F.struct("parent", "node")).over(w)).join(F.broadcast(heads), "part", "left")
    after = F.coalesce("after", "head")
    return near.select("node", F.when(after["parent"] == F.col("parent"), after["node"]).alias("sibling"))


def _preorder(links: DataFrame) -> DataFrame:
    """(node, down, size) of forests of any size: each node is entered and left once in a tour, and pointer doubling ranks the tour.

    Entering a node counts one; down is the number of nodes that the tour has left from there, and size that of the node's subtree.
    """
    first = links.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.min("node").alias("child"))
    t = links.join(first, "node", "left").join(_next_sibling(links), "node", "left")
    spot = lambda n, side: F.struct(n.alias("n"), F.lit(side).alias("s"))
    node, parent, child, sibling = (F.col(c) for c in ("node", "parent", "child", "sibling"))
    down = F.struct(spot(node, 0).alias("el"), F.when(child.isNotNull(), spot(child, 0)).otherwise(spot(node, 1)).alias("next"), F.lit(1).cast("long").alias("left"))
    up = F.struct(spot(node, 1).alias("el"), F.when(sibling.isNotNull(), spot(sibling, 0)).when(parent.isNotNull(), spot(parent, 1)).alias("next"), F.lit(0).cast("long").alias("left"))
    state = cut(t.select(F.explode(F.array(down, up)).alias("x")).select("x.*"))
    while state.where("next is not null").limit(1).count():
        o = state.select(F.col("el").alias("next"), F.col("next").alias("next2"), F.col("left").alias("left2"))
        more = state.where("next is not null").join(o, "next").select("el", F.col("next2").alias("next"), (F.col("left") + F.col("left2")).alias("left"))
        state = cut(more.unionByName(state.where("next is null")))
    at = state.groupBy(F.col("el.n").alias("node")).agg(F.max(F.when(F.col("el.s") == 0, F.col("left"))).alias("down"), F.max(F.when(F.col("el.s") == 1, F.col("left"))).alias("up"))
    return at.select("node", "down", (F.col("down") - F.col("up")).alias("size"))


def _paths(links: DataFrame, keep: DataFrame) -> DataFrame:
    state = cut(links.join(keep, "node", "left_semi").select("node", F.col("parent").alias("up"), F.array("node").alias("path")))
    while state.where("up is not null").limit(1).count():
        o = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        state = cut(
            state.where("up is not null").join(o, "up").select("node", F.col("up2").alias("up"), F.concat("path2", "path").alias("path")).union(state.where("up is null").select("node", "up", "path"))
        )
    return state.select("node", "path")


def descendants(nodes: DataFrame) -> DataFrame:
    """(node_id, descendant_id, distance) from the paths of ``hierarchy``: as many rows as depths add up to."""
    n = F.size("path")
    return (
        nodes.where("path is not null and depth > 0")
        .select(F.col("node_id").alias("descendant_id"), "depth", F.posexplode(F.slice("path", 1, n - 1)).alias("at", "node_id"))
        .select("node_id", "descendant_id", (F.col("depth") - F.col("at")).alias("distance"))
    )


def inherits_edges(refs: DataFrame) -> DataFrame:
    """The rows of a reference table whose kind is inherits, in any case, white space around."""
    return refs.where(F.lower(F.trim(F.col("kind"), F.lit(" \t\n\r "))) == "inherits").select("from_node_id", "to_node_id")
