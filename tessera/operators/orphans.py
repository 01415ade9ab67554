"""References to keys that do not exist, were deleted, or arrived later.

Keys are integers within buckets: integer keys as they are, ids of text by their dense rank among all ids,
of parents and of references, that fall into the bucket, so that an id without a parent leaves a gap. Sorted
parent keys are compressed into runs of contiguous keys of one state; a reference is matched as of the
preceding run start and is an orphan beyond the run's end. Buckets that hold far more references than
others are salted, and their parents are repeated for each salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.session import blank_to_null, partitions

#: References of one bucket above this number, and above four times what a bucket holds on average, are spread over salts.
HOT = 100_000


def bucket_of(key: Column, width: int) -> Column:
    """Floor of an integer key / width, for widths that are powers of two also at the ends of the 64-bit range."""
    if width & (width - 1):
        raise ValueError("width must be a power of two")
    return F.shiftright(key, width.bit_length() - 1)


def salted(refs: DataFrame, parents: DataFrame, bucket: str, by: list[str], hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``salt``: references of a hot bucket spread by a hash of ``by``, its parents repeated for each salt."""
    load = refs.groupBy(bucket).agg(F.count("*").alias("__n"))
    usual = F.broadcast(load.agg(F.avg("__n").alias("__usual")))  # one row
    load = load.crossJoin(usual).select(bucket, F.ceil(F.col("__n") / F.greatest(F.lit(float(hot)), 4 * F.col("__usual"))).cast("int").alias("__salts")).where("__salts > 1")
    r = refs.join(load, bucket, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("__salts").cast("long")), F.lit(0)).cast("int")).drop("__salts")
    p = parents.join(load, bucket, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return r, p


def key_runs(parents: DataFrame, key: str, state: list[str], within: list[str], member: str | None = None) -> DataFrame:
    """(*within, run_start, run_end, *state): contiguous integer keys with equal state as one row.

    Keys must be distinct within the ``within`` columns; null keys are dropped. ``member`` names a column
    whose values come out as the array ``members``, in the order of the keys of the run.
    """
    p = parents.where(F.col(key).isNotNull()).select(*within, F.col(key).alias("k"), *state, *([member] if member else []))
    w = W.partitionBy(*within).orderBy("k")
    same = F.lag("k").over(w) == F.col("k") - 1
    for s in state:
        same = same & F.lag(s).over(w).eqNullSafe(F.col(s))
    p = p.withColumn("first", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("first").over(w))
    kept = [F.transform(F.sort_array(F.collect_list(F.struct("k", F.col(member).alias("m")))), lambda x: x["m"]).alias("members")] if member else []
    return p.groupBy(*within, "run").agg(F.min("k").alias("run_start"), F.max("k").alias("run_end"), *(F.first(s).alias(s) for s in state), *kept).drop("run")


def match_runs(refs: DataFrame, key: str, runs: DataFrame, state: list[str], within: list[str]) -> DataFrame:
    """refs with the state columns of the run that holds their key, run_start, and ``matched``.

    As-of match: runs and references are sorted together by key in their bucket, and each reference takes
    the last run start at or before it. Null keys stay, unmatched. State columns must not be columns of refs.
    """
    state = ["run_start", *state]
    run = F.struct("run_end", *state)
    right = runs.select(*within, F.col("run_start").alias("__k"), F.lit(0).alias("__side"), run.alias("__run"))
    left = refs.select(*within, F.col(key).alias("__k"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema["__run"].dataType).alias("__run"), F.struct(*refs.columns).alias("__ref"))
    right = right.withColumn("__ref", F.lit(None).cast(left.schema["__ref"].dataType))
    w = W.partitionBy(*within).orderBy("__k", "__side")
    m = left.unionByName(right).withColumn("__last", F.last("__run", ignorenulls=True).over(w)).where("__side = 1")
    hit = F.col("__last.run_end").isNotNull() & (F.col("__k") <= F.col("__last.run_end"))
    return m.select("__ref.*", F.coalesce(hit, F.lit(False)).alias("matched"), *(F.when(hit, F.col(f"__last.{s}")).alias(s) for s in state))


def index_state(nodes: DataFrame, project: str | None) -> DataFrame:
    """One row for each key of an index table of versions: is one alive, and when was it first indexed.

    Keys are node ids, or (project, node id) if ``project`` names a column. Versions without a usable id
    are dropped; repeated rows change nothing.
    """
    keys = [blank_to_null("node_id").alias("node")] + ([blank_to_null(project).alias("proj")] if project else [F.lit(None).cast("string").alias("proj")])
    return (
        nodes.select(*keys, F.col("deleted_at").isNull().alias("alive"), "indexed_at", "fixed")
        .where("node is not null")
        .groupBy("proj", "node")
        .agg(F.max("alive").alias("alive"), F.min("indexed_at").alias("first_indexed"), F.max("fixed").alias("fixed"))
    )


def ranked_keys(refs: DataFrame, parents: DataFrame, buckets: int, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Both sides with bucket, salt and ``k``: the dense rank of (proj, node) among all ids of the bucket, whether parents hold them or not.

    Parents have the columns of ``index_state``, references source_table, ref_id, proj, node, at.
    """
    bucket = F.pmod(F.xxhash64(F.coalesce("proj", F.lit("")), "node"), F.lit(buckets)).cast("int")
    r, p = salted(refs.withColumn("bucket", bucket), parents.withColumn("bucket", bucket), "bucket", ["source_table", "ref_id"], hot)
    mine = ["source_table", "ref_id", "at"]
    theirs = ["alive", "first_indexed", "fixed"]
    both = r.select("bucket", "salt", "proj", "node", *mine, *(F.lit(None).cast(parents.schema[c].dataType).alias(c) for c in theirs), F.lit(1).alias("side")).unionByName(
        p.select("bucket", "salt", "proj", "node", *(F.lit(None).cast(refs.schema[c].dataType).alias(c) for c in mine), *theirs, F.lit(0).alias("side"))
    )
    ranked = both.withColumn("k", F.dense_rank().over(W.partitionBy("bucket", "salt").orderBy("proj", "node")))
    return ranked.where("side = 1").select("bucket", "salt", "k", *mine), ranked.where("side = 0").select("bucket", "salt", "k", *theirs)


def index_runs(keys: DataFrame) -> DataFrame:
    """The runs of ranked parents of one state: fixed, deleted or alive; members holds when each key was first indexed."""
    kind = F.when(F.col("fixed"), "fixed").when(~F.col("alive"), "deleted").otherwise("alive")
    return key_runs(keys.withColumn("kind", kind), "k", ["kind"], ["bucket", "salt"], "first_indexed")


def orphan_references(refs: DataFrame, parents: DataFrame, buckets: int | None = None, hot: int = HOT) -> DataFrame:
    """References whose target is missing, deleted or late, with the state and the month.

    ``refs``: source_table, ref_id, proj (null where keys are node ids alone), node, at. ``parents``: the
    output of ``index_state``. Columns out: source_table, ref_id, state, period; rows are distinct. Ids fall
    into ``buckets`` by hash, four for each shuffle partition by default; buckets with many
    references are salted. A null
    ``at`` is never late and has period ``unknown``; a null node is no reference. A target that is fixed
    (always there) is never an orphan, and neither is any reference to a target that is alive in time.
    """
    r, p = ranked_keys(refs.where("node is not null"), parents, buckets or 4 * partitions(refs.sparkSession), hot)
    m = match_runs(r, "k", index_runs(p), ["kind", "members"], ["bucket", "salt"])
    first = F.try_element_at("members", (F.col("k") - F.col("run_start") + 1).cast("int"))
    state = F.when(~F.col("matched"), "missing").when(F.col("kind") == "deleted", "deleted").when((F.col("kind") == "alive") & (first > F.col("at")), "late")
    period = F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("unknown"))
    return m.select("source_table", "ref_id", state.alias("state"), period.alias("period")).where("state is not null").distinct()


def reference_targets(refs: DataFrame, packages: DataFrame) -> DataFrame:
    """Targets of node references: to_node_id, or to_name where its first dotted segment is an import name."""
    names = packages.select(blank_to_null("import_name").alias("head")).where("head is not null").distinct().withColumn("known", F.lit(True))
    r = refs.select(F.lit("node_references").alias("source_table"), "ref_id", blank_to_null("to_node_id").alias("id"), blank_to_null("to_name").alias("name"), F.col("captured_at").alias("at"))
    r = r.withColumn("head", F.when(F.col("id").isNull(), F.substring_index("name", ".", 1))).join(names, "head", "left")
    node = F.coalesce("id", F.when(F.col("known"), F.col("name")))
    return r.select("source_table", "ref_id", F.lit(None).cast("string").alias("proj"), node.alias("node"), "at").where("node is not null")


def cross_targets(refs: DataFrame) -> DataFrame:
    """Targets of cross references: (to_project, to_node_id)."""
    return refs.select(F.lit("cross_references").alias("source_table"), "ref_id", F.coalesce(blank_to_null("to_project"), F.lit("")).alias("proj"), blank_to_null("to_node_id").alias("node"), F.col("linked_at").alias("at")).where("node is not null")


def find_orphans(node_refs: DataFrame, cross_refs: DataFrame, nodes: DataFrame, shared: DataFrame, packages: DataFrame) -> DataFrame:
    """Orphans of both reference tables against the index; see ``orphan_references``."""
    cols = ["project", "node_id", "deleted_at", "indexed_at"]
    index = nodes.select(*cols).withColumn("fixed", F.lit(False)).unionByName(
        shared.select("project", "node_id", F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(None).cast("timestamp").alias("indexed_at"), F.lit(True).alias("fixed")).select(*cols, "fixed")
    )
    index = index.withColumn("deleted_at", F.col("deleted_at").cast("timestamp")).withColumn("indexed_at", F.col("indexed_at").cast("timestamp"))
    by_node = index_state(index, None)
    by_project = index_state(index, "project").withColumn("proj", F.coalesce("proj", F.lit("")))
    refs = reference_targets(node_refs, packages).unionByName(cross_targets(cross_refs)).withColumn("at", F.col("at").cast("timestamp"))
    return orphan_references(refs, by_node.unionByName(by_project))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """How many references of each table, period and state are orphans."""
    return orphans.groupBy("source_table", "period", "state").agg(F.count("*").alias("orphans"))
