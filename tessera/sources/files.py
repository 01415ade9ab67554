"""Sources and sinks: files, dependency lists, commit logs, traces, workspaces."""

from __future__ import annotations

import re
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.files import excluded

# Extensions that are read, folders that are not, and the largest file.
EXTENSIONS = [".py", ".md", ".ipynb", ".rst", ".txt", ".toml", ".yaml", ".yml", ".ini", ".cfg", ".json", ".js", ".ts", ".tsx", ".c", ".h", ".rs"]
SKIPPED = [
    ".git", ".hg", ".svn", ".venv", "venv", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".nox", ".eggs", "egg-info",
    "node_modules", ".yarn", "bower_components", "extern", "third_party", "build", "dist", "target", "htmlcov", ".coverage", ".cache", "site-packages",
]
MAX_BYTES = 1_000_000


def discover(spark: SparkSession, root: str, extensions: list[str] = EXTENSIONS, skipped: list[str] = SKIPPED, anchored: list[str] = (), most: int = MAX_BYTES) -> DataFrame:  # type: ignore[assignment]
    """(path, modified, length, content): files by extension and size, outside the skipped folders.

    Extension and size are pushed to the listing, so the bytes of other files are never read.
    """
    glob = "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}"
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root).where(F.col("length") <= most)
    rel = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/")) + "/", "")
    return f.select(rel.alias("path"), F.col("modificationTime").alias("modified"), "length", "content").where(~excluded(F.col("path"), list(skipped), list(anchored)))


def read_text(files: DataFrame) -> DataFrame:
    """(path, text): bytes as UTF-8, malformed ones replaced, a null content empty."""
    return files.select("path", F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.make_valid_utf8(F.col("content").cast("string")), F.lit("")).alias("text"))


def fingerprint(files: DataFrame, *by: str) -> DataFrame:
    """16 hex digits over path and modification time of a set of files, in path order."""
    line = F.concat("path", F.lit(":"), F.floor(F.col("modified").cast("double") * 1000).cast("string"), F.lit("\n"))
    g = files.select(*by, F.struct("path", line.alias("line")).alias("x")).groupBy(*by).agg(F.sort_array(F.collect_list("x")).alias("x"))
    return g.select(*by, F.substring(F.md5(F.array_join(F.transform("x", lambda v: v["line"]), "")), 1, 16).alias("fingerprint"))


_SPEC = re.compile(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(\[[^\]]*\])?\s*([^;#]*)")


def parse_requirements(text: str) -> list[tuple[str, str]]:
    """(normalised name, version spec) of a requirements list; options, comments and blank lines are no requirements."""
    out = []
    for line in text.splitlines():
        if line.lstrip().startswith(("#", "-")) or not (m := _SPEC.match(line)):
            continue
        out.append((m[1].lower().replace("-", "_"), m[3].strip()))
    return out


def parse_pyproject(text: str) -> tuple[list[tuple[str, str]], dict[str, str]]:
    """(dependencies, scripts) of a project file; those of extras and dependency groups too. What is no list of texts is left out."""
    data = tomllib.loads(text)
    project = data.get("project", {})
    lists = [project.get("dependencies"), *project.get("optional-dependencies", {}).values(), *data.get("dependency-groups", {}).values()]
    specs = [x for part in lists if isinstance(part, list) for x in part if isinstance(x, str) and x.strip()]
    return parse_requirements("\n".join(specs)), dict(project.get("scripts", {}))


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit, date, subject, body, files) from records of labelled lines that end with ==END==."""
    r = spark.read.option("lineSep", "==END==").text(path).where(F.trim("value", F.lit(" \n\r\t")) != "")
    g = lambda name, rx: F.trim(F.regexp_extract("value", rx, 1)).alias(name)
    r = r.select(
        g("commit", r"(?m)^commit:?\s*(\S+)"),
        F.to_timestamp(F.regexp_extract("value", r"(?m)^author-date:?\s*(.+)$", 1)).alias("date"),
        g("subject", r"(?m)^subject:?\s*(.*)$"),
        g("body", r"(?s)\nbody:?\s*(.*?)\nfiles:?"),
        F.filter(F.split(F.regexp_extract("value", r"(?s)\nfiles:?\s*(.*)$", 1), r"\s*\n\s*"), lambda x: x != "").alias("files"),
    )
    return r.where("commit != ''")


TRACE = T.StructType([T.StructField(n, t) for n, t in (("trajectory_id", T.StringType()), ("seq", T.IntegerType()), ("kind", T.StringType()), ("tool", T.StringType()), ("ts", T.DoubleType()), ("args", T.MapType(T.StringType(), T.StringType())), ("tokens", T.LongType()))])


def traces(spark: SparkSession, path: str, schema: T.StructType = TRACE) -> DataFrame:
    """Trace records from JSON lines, with a schema and no inference; a broken line is a row of nulls with the line as ``broken``."""
    return spark.read.schema(T.StructType([*schema, T.StructField("broken", T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)


def write_traces(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def blobs(df: DataFrame, content: str) -> DataFrame:
    """(key, content): contents once each, under their own hash."""
    return df.where(F.col(content).isNotNull()).select(F.sha2(F.col(content).cast("binary"), 256).alias("key"), F.col(content).alias("content")).dropDuplicates(["key"])


def workspace(spark: SparkSession, root: str, table: str, version: int) -> DataFrame:
    """One table of all projects of a workspace (root/project=.../table); a newer layout is refused."""
    df = spark.read.option("basePath", root).option("mergeSchema", "true").parquet(f"{root}/project=*/{table}")
    if "schema_version" in df.columns:
        newest = df.agg(F.max("schema_version")).first()[0]
        if newest is not None and newest > version:
            raise ValueError(f"layout {newest} is newer than {version}")
    return df
