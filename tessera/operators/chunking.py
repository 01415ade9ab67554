"""Files to sections: headings, titles, headers, keys, windows, notebook cells, mentions."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.text import slug


def _lines(df: DataFrame, id_col: str, text: str) -> DataFrame:
    body = F.regexp_replace(text, "\r\n?", "\n")
    return df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(body, "\n", -1)).alias("at", "line"))


def _sections(lines: DataFrame, starts: Column, title: Column) -> DataFrame:
    """(id, section, title, start_line, end_line, text): a section from each start to the line before the next."""
    w = W.partitionBy("id").orderBy("at")
    l = lines.withColumn("s", F.sum(F.when(starts, 1).otherwise(0)).over(w)).withColumn("__t", F.when(starts, title))
    g = l.where("s > 0").groupBy("id", F.col("s").cast("int").alias("section")).agg(F.max("__t").alias("title"), (F.min("at") + 1).alias("start_line"), (F.max("at") + 1).alias("end_line"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("__l"))
    return g.select("id", "section", "title", "start_line", "end_line", F.array_join(F.transform("__l", lambda x: x["line"]), "\n").alias("text"))


def markdown_sections(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Headings of levels 1 to 3, flat; lines inside code fences are no headings, an open fence reaches the end.

    slug_no tells apart equal slugs of one document, from 0.
    """
    l = _lines(df, id_col, text)
    w = W.partitionBy("id").orderBy("at")
    fence = F.col("line").rlike("^ {0,3}(```|~~~)")
    l = l.withColumn("inside", (F.sum(F.when(fence, 1).otherwise(0)).over(w) % 2 == 1) | fence)
    start = ~F.col("inside") & F.col("line").rlike(r"^#{1,3}\s+\S")
    s = _sections(l, start, F.trim(F.regexp_replace("line", r"^#{1,3}\s+|\s+#*\s*$", "")))
    same = W.partitionBy("id", "slug").orderBy("section")
    return s.withColumn("slug", slug("title")).withColumn("slug_no", F.row_number().over(same) - 1)


def code_fences(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, language, code) of each closed code fence."""
    x = F.regexp_extract_all(F.regexp_replace(text, "\r\n?", "\n"), F.lit(r"(?s)(?:^|\n)```[^\n]*\n.*?\n```"), F.lit(0))
    d = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(x).alias("no", "block"))
    return d.select("id", "no", F.regexp_extract("block", r"```([^\n]*)\n", 1).alias("language"), F.regexp_extract("block", r"(?s)```[^\n]*\n(.*)\n```$", 1).alias("code"))


def rst_sections(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Titles underlined by a run of one punctuation character at least as long as the title."""
    l = _lines(df, id_col, text)
    w = W.partitionBy("id").orderBy("at")
    nxt = F.lead("line").over(w)
    l = l.withColumn("next", nxt)
    title = F.rtrim("line")
    start = F.coalesce((F.length(title) > 0) & F.rtrim("next").rlike(r"^([=\-~^\"'#*+])\1*$") & (F.length(F.rtrim("next")) >= F.length(title)) & ~title.rlike(r"^([=\-~^\"'#*+])\1*$"), F.lit(False))
    l = l.withColumn("__start", start)
    return _sections(l, F.col("__start"), F.trim("line"))


def header_sections(df: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """[section] and [[table]] headers and keys at column 0 that open a block."""
    l = _lines(df, id_col, text)
    head = r"^\[{1,2}([^\[\]]+)\]{1,2}\s*$"
    key = r"^([A-Za-z_][\w.-]*):\s*$"
    start = F.col("line").rlike(head) | F.col("line").rlike(key)
    return _sections(l, start, F.coalesce(F.nullif(F.regexp_extract("line", head, 1), F.lit("")), F.regexp_extract("line", key, 1)))


def json_keys(df: DataFrame, id_col: str = "id", text: str = "text", most: int = 50) -> DataFrame:
    """(id, keys, many): keys at the least indent, found by lines; the text is not parsed."""
    l = _lines(df.where(F.ltrim(text).startswith("{")), id_col, text)
    k = l.withColumn("indent", F.length(F.regexp_extract("line", r'^(\s*)"', 1))).withColumn("key", F.regexp_extract("line", r'^\s*"([^"]+)"\s*:', 1)).where("key != ''")
    k = k.withColumn("least", F.min("indent").over(W.partitionBy("id"))).where("indent = least")
    g = k.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "key"))).alias("x"))
    return g.select("id", F.transform("x", lambda v: v["key"]).alias("keys"), (F.size("x") > most).alias("many"))


def line_windows(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 80) -> DataFrame:
    """Fixed windows of lines, titled by their range."""
    l = _lines(df, id_col, text)
    g = l.groupBy("id", F.floor(F.col("at") / size).cast("int").alias("window")).agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("x"))
    a, b = F.col("window") * size + 1, F.col("window") * size + F.size("x")
    return g.select("id", "window", F.concat(F.lit("lines "), a.cast("string"), F.lit("-"), b.cast("string")).alias("title"), F.array_join(F.transform("x", lambda v: v["line"]), "\n").alias("text"))


def notebook_cells(df: DataFrame, id_col: str = "path", text: str = "content") -> DataFrame:
    """(id, cell, kind, source) of notebook JSON whose sources are strings or lists of lines."""
    one = "struct<cells:array<struct<cell_type:string,source:string>>>"
    cell = F.from_json(F.col(text), one)
    d = df.select(F.col(id_col).alias("id"), F.posexplode(cell["cells"]).alias("cell", "c"))
    lines = F.from_json("c.source", "array<string>")
    return d.select("id", "cell", F.col("c.cell_type").alias("kind"), F.when(F.ltrim("c.source").startswith("["), F.coalesce(F.array_join(lines, ""), F.col("c.source"))).otherwise(F.col("c.source")).alias("source"))


def mentions(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, name, times): dotted names in backticks."""
    x = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"`([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+)`"), F.lit(1))
    return df.select(F.col(id_col).alias("id"), F.explode(x).alias("name")).groupBy("id", "name").agg(F.count("*").alias("times"))


def headings_of_html(df: DataFrame, id_col: str, text: str) -> DataFrame:
    x = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), F.lit(1))
    return df.select(F.col(id_col).alias("id"), F.posexplode(x).alias("no", "title"))


def python_symbols(df: DataFrame, id_col: str = "id", text: str = "text", module: str = "module") -> DataFrame:
    """(id, kind, name, start_line, end_line, docstring, calls, bases) of functions, classes and import blocks, by syntax tree.

    A text that does not parse is one module row. Arrow batches; the tree of one text at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out: list[tuple] = []
            for i, mod, src in zip(pdf["id"], pdf["module"], pdf["text"], strict=True):
                try:
                    tree = ast.parse(src)
                except (SyntaxError, ValueError, RecursionError, MemoryError):
                    out.append((i, "module", mod, 1, src.count("\n") + 1, None, [], []))
                    continue
                _visit(tree, i, "", out)
            yield pd.DataFrame(out, columns=["id", "kind", "name", "start_line", "end_line", "docstring", "calls", "bases"])

    rows = df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(module).alias("module"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, kind string, name string, start_line int, end_line int, docstring string, calls array<string>, bases array<string>")


def _dotted(n: ast.AST) -> str | None:
    if isinstance(n, ast.Name):
        return n.id
    if isinstance(n, ast.Attribute) and (base := _dotted(n.value)):
        return f"{base}.{n.attr}"
    return None


def _visit(node: ast.AST, i: object, prefix: str, out: list[tuple]) -> None:
    run: list[ast.stmt] = []

    def close() -> None:
        if run:
            out.append((i, "imports", ",".join(a.name for s in run for a in s.names), run[0].lineno, run[-1].end_lineno, None, [], []))
            run.clear()

    for n in getattr(node, "body", []):
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            run.append(n)
            continue
        close()
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            cls = isinstance(n, ast.ClassDef)
            calls = sorted({c for x in ast.walk(n) if isinstance(x, ast.Call) and (c := _dotted(x.func))})
            bases = [b for x in n.bases if (b := _dotted(x))] if cls else []
            kind = "class" if cls else "method" if isinstance(node, ast.ClassDef) else "function"
            out.append((i, kind, prefix + n.name, n.lineno, n.end_lineno, ast.get_docstring(n), calls, bases))
            _visit(n, i, f"{prefix}{n.name}.", out)
    close()
