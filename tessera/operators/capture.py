"""What extraction hands to the graph: references with their aliases, members by pattern, pages, flat trees."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.session import cut

REFERENCES = "id {t}, src string, name string, kind string, alias_of string, owner string"


def references(df: DataFrame, id_col: str = "id", text: str = "text", module: str = "module", package: str | None = None) -> DataFrame:
    """(id, src, name, kind, alias_of, owner): calls, imports and bases of source texts, by syntax tree.

    src is the enclosing symbol under its module. alias_of is what the first segment of a name was imported
    as; for ``self.x.y`` owner is the class that ``self.x`` was assigned or annotated in the same class. Relative
    imports are named from the module's package; one that climbs past the root keeps its own name. ``package`` may name a
    boolean column that says of a module that it is a package. A text that does not parse gives nothing.
    """
    is_package = F.col(package) if package else F.lit(False)
    rows = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(module).alias("module"), F.col(text).alias("text"), is_package.alias("package"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out: list[tuple] = []
            for i, mod, src, pkg in zip(pdf["id"], pdf["module"], pdf["text"], pdf["package"], strict=True):
                try:
                    tree = ast.parse(src)
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    continue
                out += [(i, *r) for r in _capture(tree, mod or "", bool(pkg))]
            yield pd.DataFrame(out, columns=["id", "src", "name", "kind", "alias_of", "owner"])

    return rows.mapInPandas(run, REFERENCES.format(t=dict(rows.dtypes)["id"]))


def _name(n: ast.AST) -> str | None:
    if isinstance(n, ast.Name):
        return n.id
    if isinstance(n, ast.Attribute):
        base = _name(n.value)
        return f"{base}.{n.attr}" if base else None
    return None


def _base(n: ast.ImportFrom, module: str, package: bool) -> str:
    """What the names of a from-import hang under: a package counts as the first level above itself."""
    up = max(0, n.level - package)
    parts = module.split(".") if module else []
    if not n.level or up > len(parts):
        return n.module or ""
    return ".".join([*parts[: len(parts) - up], *([n.module] if n.module else [])])


def _aliases(tree: ast.AST, module: str, package: bool) -> dict[str, str]:
    out: dict[str, str] = {}
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            for a in n.names:
                out[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
        elif isinstance(n, ast.ImportFrom):
            base = _base(n, module, package)
            for a in n.names:
                out[a.asname or a.name] = f"{base}.{a.name}" if base else a.name
    return out


def _attributes(cls: ast.ClassDef) -> dict[str, str]:
    """Attributes that the class body annotates, and those of self that are assigned a call or annotated: their class."""
    out: dict[str, str] = {}
    for n in cls.body:
        if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name) and (v := _name(n.annotation)):
            out.setdefault(n.target.id, v)
    for n in ast.walk(cls):
        target, value = None, None
        if isinstance(n, ast.Assign) and len(n.targets) == 1:
            target, value = n.targets[0], n.value.func if isinstance(n.value, ast.Call) else None
        elif isinstance(n, ast.AnnAssign):
            target, value = n.target, n.annotation
        if isinstance(target, ast.Attribute) and _name(target.value) == "self" and value is not None and (v := _name(value)):
            out.setdefault(target.attr, v)
    return out


def _capture(tree: ast.Module, module: str, package: bool = False) -> list[tuple]:
    alias = _aliases(tree, module, package)
    out: set[tuple] = set()

    def put(src: str, name: str | None, kind: str, owners: dict[str, str]) -> None:
        if not name:
            return
        head, _, rest = name.partition(".")
        owner = None
        if head == "self" and "." in rest:
            attr, _, _tail = rest.partition(".")
            owner = owners.get(attr)
        out.add((src, name, kind, alias.get(head), owner))

    def visit(node: ast.AST, src: str, owners: dict[str, str]) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.ClassDef):
                inner = f"{src}.{n.name}"
                for b in n.bases:
                    put(inner, _name(b), "inherits", {})
                visit(n, inner, _attributes(n))
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                visit(n, f"{src}.{n.name}", owners)
            else:
                if isinstance(n, ast.Call):
                    put(src, _name(n.func), "calls", owners)
                elif isinstance(n, ast.Import):
                    for a in n.names:
                        put(src, a.name, "imports", {})
                elif isinstance(n, ast.ImportFrom):
                    base = _base(n, module, package)
                    for a in n.names:
                        put(src, f"{base}.{a.name}" if base else a.name, "imports", {})
                visit(n, src, owners)

    visit(tree, module, {})
    return sorted(out, key=str)


def resolve(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References with dst and rule, the first rule that gives one node: typed self, alias, exact, document, suffix.

    refs (package, name, kind, alias_of, owner), nodes (package, node). ``self.x.f`` needs the class of x;
    other ``self`` names stay open; kind similar keeps its name as target.
    """
    n = nodes.select("package", "node").distinct()
    every = n.select("node").distinct()
    # the numbers join three branches, so they are written down once
    r = cut(refs.withColumn("__k", F.monotonically_increasing_id()))
    rest = F.expr("substring(name, instr(name, '.') + 1)")
    is_self = F.col("name").startswith("self.")
    has_dot = F.contains("name", F.lit("."))
    typed = F.when(is_self & F.col("owner").isNotNull(), F.concat_ws(".", "owner", F.expr("substring_index(name, '.', -1)")))
    aliased = F.when(~is_self & F.col("alias_of").isNotNull(), F.when(has_dot, F.concat_ws(".", "alias_of", rest)).otherwise(F.col("alias_of")))
    plain = F.when(~is_self, F.col("name"))
    tries = [("alias", aliased), ("exact", plain), ("document", F.concat(plain, F.lit(".md"))), ("document", F.concat(plain, F.lit(".ipynb")))]
    cand = r.select("__k", "package", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(rule).alias("rule"), c.alias("node")) for i, (rule, c) in enumerate(tries)))).alias("t")).select("__k", "t.*").where("node is not null")
    direct = cand.join(every, "node")
    tails = r.select("__k", "package", F.coalesce(typed, plain).alias("want"), F.when(typed.isNotNull(), -1).otherwise(9).alias("i")).where("want is not null").withColumn("tail", F.substring_index("want", ".", -1))
    hit = tails.join(n.withColumn("tail", F.substring_index("node", ".", -1)), ["package", "tail"]).where((F.col("node") == F.col("want")) | F.endswith("node", F.concat(F.lit("."), F.col("want"))))
    one = hit.groupBy("__k", "i").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").select("__k", "i", F.when(F.col("i") < 0, "typed").otherwise("suffix").alias("rule"), "node")
    best = direct.select("__k", "i", "rule", "node").unionByName(one).groupBy("__k").agg(F.min_by(F.struct("rule", "node"), F.struct("i", "node")).alias("b"))
    j = r.join(best, "__k", "left").withColumn("dst", F.when(F.col("kind") == "similar", F.col("name")).otherwise(F.col("b.node"))).withColumn("rule", F.coalesce("b.rule", F.lit("open")))
    return j.drop("__k", "b")


_HEADER = re.compile(r"^([ \t]*)(async[ \t]+def|def|class)[ \t]+(\w+)", re.M)


def members_by_pattern(text: str, most_signature: int = 4000, most_doc: int = 3000, reach: int = 500) -> list[tuple[str, str, str, str]]:
    """(kind, name, signature, docstring) by header pattern and balanced brackets, for text no parser reads; names with _ are left out."""
    out = []
    for m in _HEADER.finditer(text):
        kind, name = "class" if m[2] == "class" else "method" if m[1] else "function", m[3]
        if name.startswith("_"):
            continue
        at, depth = m.end(), 0
        while at < min(len(text), m.end() + most_signature):
            c = text[at]
            depth += c in "([{"
            depth -= c in ")]}"
            if (c == ":" and depth <= 0) or (c == "\n" and depth <= 0):
                break
            at += 1
        doc = re.match(r":?\s*(?:r|u)?(\"\"\"|''')(.*?)\1", text[at : at + reach + most_doc], re.S)
        body = doc[2].strip()[:most_doc] if doc and doc.start(1) <= reach else ""
        out.append((kind, name, re.sub(r"\s+", " ", text[m.end() : at]).strip(), body))
    return out


def doc_pages(members: DataFrame, modules: DataFrame, most: int = 8000) -> DataFrame:
    """(module, page): a module's documentation and the signatures of its public, documented members, cut at ``most``.

    members (module, name, signature, docstring), modules (module, text).
    """
    m = members.where(~F.startswith("name", F.lit("_")) & F.col("docstring").isNotNull() & (F.trim("docstring") != ""))
    line = F.concat(F.coalesce("signature", F.col("name")), F.lit("\n    "), F.trim(F.substring_index(F.trim("docstring"), "\n", 1)))
    g = m.groupBy("module").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    j = g.join(modules.groupBy("module").agg(F.max("text").alias("text")), "module", "left")
    return j.select("module", F.substring(F.concat_ws("\n\n", F.nullif(F.trim("text"), F.lit("")), "body"), 1, most).alias("page"))


def flatten_tree(nodes: DataFrame) -> DataFrame:
    """(node, module, kind, text) of nodes with text that are no mere structure; module is the nearest module above, else the node.

    nodes (node, parent, kind, text). Each round doubles how far up a node has looked, until every node has met
    a module or the top; nodes whose way up ends in a cycle without one stand for themselves. Of several parents the smallest counts.
    """
    own = nodes.groupBy("node").agg(F.min("parent").alias("at"), F.max(F.when(F.col("kind") == "module", F.col("node"))).alias("module"))
    near = cut(own.withColumn("at", F.when(F.col("module").isNull(), F.col("at"))))
    for _ in range(max(1, near.count()).bit_length() + 1):
        if near.where("at is not null").isEmpty():
            break
        up = near.select(F.col("node").alias("at"), F.col("at").alias("above"), F.col("module").alias("found"))
        more = near.where("at is not null").join(up, "at", "left").select("node", "above", "found").toDF("node", "at", "module")
        near = cut(near.where("at is null").unionByName(more))
    live = nodes.where(~F.col("kind").isin("package", "subpackage") & F.col("text").isNotNull() & (F.trim("text") != ""))
    return live.select("node", "kind", "text").join(near.select("node", "module"), "node").select("node", F.coalesce("module", "node").alias("module"), "kind", "text")


def sequenced(events: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Trace records with the sequence number that a recorder would have given them."""
    return events.withColumn("seq", F.row_number().over(W.partitionBy(by).orderBy(*order)) - 1)
