"""Conversations from message rows that were stored in pieces, out of order and more than once.

The rows of a session are cut into export fragments: runs of stored lines that arrived together, of
bounded size. A fragment is the ordered list of its message hashes. Fragments that share messages are the
edges of an overlap graph: the end of one is the beginning of the next (suffix-prefix), or one lies whole
within another (containment). Contained fragments vanish, overlaps that follow from two others are left out,
and unambiguous paths are merged into contigs, in which each message has its place by the graph. Contigs that
lie apart in time follow one another; only where several lie across each other, which the graph cannot order,
are their messages ordered by (ts, seq). Sessions with gaps come out with their reasons.

No step gathers the messages of a session in one task: fragments are bounded, the order is a range sort over all
rows, and what holds between neighbouring ranges is combined from one summary row for each range.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.session import blank_to_null, cut, shared_folder, strip

#: Stored lines that one export fragment spans at most, and the seconds between two arrivals that begin another.
FRAGMENT, PAUSE = 4096, 1800


def _blocks(kind: str) -> Column:
    return F.filter(F.coalesce("message.content", F.array()), lambda b: F.lower(F.trim(b["type"])) == kind)


def message_rows(df: DataFrame, text: bool = True) -> DataFrame:
    """One typed row for each stored line with a session.

    session_id in lower case without white space around; speaker is user, assistant or null; speaks: a
    text block holds a letter or digit; hash stands for the uuid (for the line where there is none);
    uses and results are the tool ids. Lines without session id are dropped.
    """
    role = F.lower(strip("message.role"))
    role = F.when(role.isin("user", "human"), "user").when(role.isin("assistant", "model"), "assistant")
    kind = F.lower(blank_to_null("type"))
    speaker = F.when(kind.isin("user", "assistant"), kind).when(kind.isNull(), role)
    texts = F.transform(_blocks("text"), lambda b: F.coalesce(b["text"], F.lit("")))
    has = lambda t: t.rlike(r"[\p{L}\p{N}]")
    ids = lambda kind_, f: F.filter(F.transform(_blocks(kind_), lambda b: strip(b[f])), lambda i: i.isNotNull() & (i != ""))
    cols = [
        F.lower(blank_to_null("session_id")).alias("session_id"),
        "line_id",
        F.coalesce(blank_to_null("uuid"), F.concat(F.lit("line "), F.col("line_id").cast("string"))).alias("uuid"),
        speaker.alias("speaker"),
        F.exists(texts, has).alias("has_text"),
        F.col("ts").cast("timestamp").alias("ts"),
        "seq",
        F.col("received_at").cast("timestamp").alias("received"),
        ids("tool_use", "id").alias("uses"),
        ids("tool_result", "tool_use_id").alias("results"),
    ]
    if text:
        cols.append(F.array_join(F.filter(texts, has), "\n").alias("text"))
    out = df.select(*cols).where("session_id is not null")
    return out.withColumn("speaks", F.col("speaker").isNotNull() & F.col("has_text")).drop("has_text").withColumn("hash", F.xxhash64("uuid"))


_ALL = (W.unboundedPreceding, W.unboundedFollowing)


def _order() -> list[Column]:
    """Order of the messages: nulls last, equal (ts, seq) as stored."""
    return [F.asc_nulls_last("ts"), F.asc_nulls_last("seq"), F.asc("line_id")]


def _key() -> Column:
    """The same order as one value that compares."""
    return F.struct(F.col("ts").isNull().alias("no_ts"), "ts", F.col("seq").isNull().alias("no_seq"), "seq", "line_id")


def fragments(rows: DataFrame, size: int = FRAGMENT, pause: int = PAUSE) -> DataFrame:
    """The rows of each fragment once for each message, with position and length.

    Adds fragment (ordered as stored), pos (from 1, by time), len, and copies, the stored lines of the message. Lines
    with the same uuid are one message, for which the earliest stored line stands in all fragments (line_id is that
    of it). A fragment ends where the next stored line of the session arrived more than ``pause`` seconds before or
    after, and at multiples of ``size`` lines. Within a fragment a message counts once.
    """
    same = W.partitionBy("session_id", "uuid").orderBy("line_id").rowsBetween(*_ALL)
    own = [c for c in rows.columns if c not in ("session_id", "uuid", "hash", "received")]
    r = rows.select("session_id", "uuid", "hash", "received", F.col("line_id").alias("stored"), *(F.first(c).over(same).alias(c) for c in own), F.count("*").over(same).alias("copies"))
    r = r.withColumn("block", F.floor(F.col("stored") / size))
    block = W.partitionBy("session_id", "block").orderBy("stored")
    apart = F.abs(F.col("received").cast("double") - F.lag("received").over(block).cast("double")) > pause
    r = r.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("long"))
    r = r.withColumn("fragment", F.col("block") * size + F.sum("apart").over(block)).drop("apart", "received")
    w = W.partitionBy("session_id", "block", "fragment").orderBy(*_order())
    # equal messages of a fragment are neighbours in it
    r = r.withColumn("again", F.coalesce(F.lag("line_id").over(w) == F.col("line_id"), F.lit(False))).where("not again")
    return r.withColumn("pos", F.row_number().over(w)).withColumn("len", F.count("*").over(w.rowsBetween(*_ALL)).cast("int")).drop("block", "stored", "again")


def links(frag: DataFrame) -> DataFrame:
    """One row for each message that two fragments share: fragment, pos and len, and the one stored before, a, pa and la.

    A fragment with the same message hashes as one before is linked with the first such alone, so that one that was
    exported again and again has no more links than messages.
    """
    w = W.partitionBy("session_id", "fragment").rowsBetween(*_ALL)
    s = frag.where("copies > 1").select("session_id", "fragment", "hash", "line_id", "pos", "len", _key().alias("key"))
    s = s.withColumn("held", F.count("*").over(w)).withColumn("x", F.bit_xor(F.xxhash64("hash", F.lit(1))).over(w)).withColumn("y", F.bit_xor(F.xxhash64(F.lit(2), "hash")).over(w))
    alike = W.partitionBy("session_id", "line_id", "pos", "len", "x", "y").rowsBetween(*_ALL)
    s = s.withColumn("twin", F.when(F.expr("held = len"), F.min("fragment").over(alike)).otherwise(F.col("fragment"))).withColumn("is_twin", F.expr("fragment > twin"))
    before = W.partitionBy("session_id", "line_id").orderBy("fragment").rowsBetween(W.unboundedPreceding, -1)
    held = F.collect_list(F.when(~F.col("is_twin"), F.struct(F.col("fragment").alias("a"), F.col("pos").alias("pa"), F.col("len").alias("la")))).over(before)
    first = F.array(F.struct(F.col("twin").alias("a"), F.col("pos").alias("pa"), F.col("len").alias("la")))
    s = s.withColumn("held", F.when(F.col("is_twin"), first).otherwise(held))
    return s.select("session_id", "fragment", "line_id", "key", "pos", "len", F.explode("held").alias("h")).select("session_id", "fragment", "line_id", "key", "pos", "len", "h.*")


def overlap_edges(linked: DataFrame) -> DataFrame:
    """(session_id, a, b, shared, kind, la, key): fragments that share messages; la is the length of a, key that of the first message shared.

    kind: ``overlap``, the end of a is the beginning of b in the same order; ``contained``, all of b lies in
    a; ``mixed``, anything else, which orders nothing. In the first two, a may be stored after b.
    """
    e = (
        linked.where("a is not null").groupBy("session_id", "a", F.col("fragment").alias("b"))
        .agg(F.count("*").alias("shared"), F.min("pa").alias("a0"), F.max("pa").alias("a1"), F.first("la").alias("la"), F.first("len").alias("lb"), F.min("pos").alias("b0"), F.max("pos").alias("b1"), F.min(F.expr("pa - pos")).alias("s0"), F.max(F.expr("pa - pos")).alias("s1"), F.min("key").alias("key"))
    )
    e = e.withColumn("kind", F.expr("""case when shared = lb then 'contained' when shared = la then 'contains'
        when s0 = s1 and a1 = la and a1 - a0 + 1 = shared and b0 = 1 and b1 = shared then 'overlap'
        when s0 = s1 and b1 = lb and b1 - b0 + 1 = shared and a0 = 1 and a1 = shared then 'overlapped' else 'mixed' end"""))
    turned = F.col("kind").isin("contains", "overlapped")
    kind = F.when(F.col("kind") == "contains", "contained").when(F.col("kind") == "overlapped", "overlap").otherwise(F.col("kind"))
    return e.select("session_id", F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"), "shared", kind.alias("kind"), F.when(turned, F.col("lb")).otherwise(F.col("la")).alias("la"), "key")


def contained(edges: DataFrame) -> DataFrame:
    """(session_id, fragment): the fragments that lie whole within another."""
    return edges.where("kind = 'contained'").select("session_id", F.col("b").alias("fragment")).distinct()


_PATH = "session_id string, fragment long, head long, offset long"


def paths(edges: DataFrame) -> DataFrame:
    """(session_id, fragment, head, offset): the unambiguous paths of the overlap graph, without fragments that begin one.

    Contained fragments are left out, then overlaps that follow from two others; an overlap that is then the only
    one out of a and the only one into b is unambiguous. head is the fragment that begins the path, offset the
    messages of the path before the fragment. On a path first messages come in order, so one pass in that
    order numbers all paths, with no more in memory than those that are open.
    """
    gone = contained(edges)
    e = edges.where("kind = 'overlap'").select("session_id", "a", "b", "la", "shared", "key")
    for end in ("a", "b"):
        e = e.join(gone.withColumnRenamed("fragment", end), ["session_id", end], "left_anti")
    e = cut(e)
    follows = e.select("session_id", "a", F.col("b").alias("c")).join(e.select("session_id", F.col("a").alias("c"), "b"), ["session_id", "c"]).select("session_id", "a", "b").distinct()
    e = e.join(follows, ["session_id", "a", "b"], "left_anti")
    e = e.withColumn("out", F.count("*").over(W.partitionBy("session_id", "a"))).withColumn("in", F.count("*").over(W.partitionBy("session_id", "b"))).where("out = 1 and in = 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, ends = None, {}
        for batch in batches:
            out = []
            for s, a, b, la, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != session:
                    session, ends = s, {}
                head, offset = ends.pop(a, (a, 0))
                ends[b] = (head, offset + la - shared)
                out.append((s, b, *ends[b]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            types = [("session_id", pa.string()), ("fragment", pa.int64()), ("head", pa.int64()), ("offset", pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, types, strict=True)], names=[n for n, _ in types])

    return e.repartition("session_id").sortWithinPartitions("session_id", "key").select("session_id", "a", "b", "la", "shared").mapInArrow(run, _PATH)


def contigs(frag: DataFrame, edges: DataFrame, leaving: DataFrame) -> DataFrame:
    """(session_id, fragment, contig, offset, tangle, alone) for each fragment that is not contained.

    contig: its path, numbered by the first message; offset: messages of the contig before the fragment. Contigs
    that lie across each other in time are a tangle; tangles are numbered by time, alone says that one has a single contig.
    """
    f = frag.groupBy("session_id", "fragment").agg(F.min(_key()).alias("first"), F.max(_key()).alias("last"), F.count("*").alias("rows"))
    f = f.join(contained(edges), ["session_id", "fragment"], "left_anti").join(leaving.groupBy("session_id", "fragment").agg(F.count("*").alias("left")), ["session_id", "fragment"], "left")
    f = f.join(paths(edges), ["session_id", "fragment"], "left").withColumn("head", F.coalesce("head", "fragment")).withColumn("offset", F.coalesce("offset", F.lit(0)))
    c = f.groupBy("session_id", "head").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum(F.col("rows") - F.coalesce("left", F.lit(0))).alias("rows")).where("rows > 0")
    w = W.partitionBy("session_id").orderBy("first", "head")
    c = c.withColumn("contig", F.row_number().over(w)).withColumn("before", F.max("last").over(w.rowsBetween(W.unboundedPreceding, -1)))
    c = c.withColumn("tangle", F.sum(F.coalesce(F.col("first") > F.col("before"), F.lit(True)).cast("int")).over(w))
    c = c.withColumn("alone", F.count("*").over(W.partitionBy("session_id", "tangle")) == 1)
    return f.join(c.select("session_id", "head", "contig", "tangle", "alone"), ["session_id", "head"]).select("session_id", "fragment", "contig", "offset", "tangle", "alone")


def _leaving(linked: DataFrame, edges: DataFrame) -> DataFrame:
    """(session_id, fragment, pos): messages that leave a fragment, as one stored before holds them that is not contained itself."""
    whole = contained(edges).withColumnRenamed("fragment", "a")
    return linked.where("a is not null").join(whole, ["session_id", "a"], "left_anti").select("session_id", "fragment", "pos").distinct()


def _stored(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder and read from there."""
    path = f"{shared_folder(df.sparkSession)}/conversations-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def assemble(rows: DataFrame, size: int = FRAGMENT, keep: tuple[str, ...] = ("uuid",)) -> DataFrame:
    """Every message once, with its contig and its order: tangle, then at (its place in the contig by the graph), then (ts, seq).

    Contained fragments leave whole, other messages where an edge says that a fragment before holds them. at is
    null where contigs lie across each other. ``keep`` says which ids of the message are kept.
    """
    frag = fragments(rows, size)
    frag = _stored(frag.withColumn("hash", F.when(F.col("copies") > 1, F.col("hash"))).drop(*({"uuid"} - set(keep))))
    linked = _stored(links(frag))
    edges = cut(overlap_edges(linked))
    leaving = _leaving(linked, edges)
    own = frag.where("copies > 1").join(leaving, ["session_id", "fragment", "pos"], "left_anti")
    kept = frag.where("copies = 1").unionByName(own).join(contigs(frag, edges, leaving), ["session_id", "fragment"])
    at = F.when(F.col("alone"), F.col("offset") + F.col("pos"))
    return kept.withColumn("at", at).drop("fragment", "pos", "len", "hash", "copies", "offset", "alone")


def _ranged(messages: DataFrame) -> DataFrame:
    """All messages in order over range partitions, so that a long session spreads over many."""
    keys = ["session_id", "tangle", F.asc_nulls_last("at"), *_order()]
    return messages.repartitionByRange(*keys).sortWithinPartitions(*keys)


_SUMMARY = "session_id string, part int, rows long, speaking long, first string, last string, doubled boolean"


def _summaries(ranged: DataFrame) -> DataFrame:
    """One row for each session and range partition: who speaks first and last, and whether two user messages meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out: list[list] = []
        for b in batches:
            for s, who, speaks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not out or out[-1][0] != s:
                    if len(out) > 10_000:
                        yield _to_batch(out[:-1])
                        out = out[-1:]
                    out.append([s, part, 0, 0, None, None, False])
                o = out[-1]
                o[2] += 1
                if speaks:
                    o[3] += 1
                    o[6] |= o[5] == "user" and who == "user"
                    o[4], o[5] = o[4] or who, who
        yield _to_batch(out)

    return ranged.select("session_id", "speaker", "speaks").mapInArrow(run, _SUMMARY)


def _to_batch(rows: list[list]) -> pa.RecordBatch:
    types = [("session_id", pa.string()), ("part", pa.int32()), ("rows", pa.int64()), ("speaking", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("doubled", pa.bool_())]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, types, strict=True)], names=[n for n, _ in types])


def drop_reasons(df: DataFrame, size: int = FRAGMENT) -> DataFrame:
    """(session_id, reason), one row for each reason to drop a session.

    empty: no message speaks. no_prompt: the first that speaks is the assistant's. no_reply: a user message
    that speaks has no assistant message that speaks before the next user message that speaks, or the end.
    lost_tool: a tool_use id without tool_result in the session, or the reverse.

    Null session ids are dropped; ids equal but for case and white space around are one session; rows of
    one uuid are one row; a null ts or seq sorts last; equal (ts, seq) fall back to the storage order; null or empty content
    says nothing; a null tool id is none. An empty table gives no rows.
    """
    rows = message_rows(df, text=False)
    return _reasons(rows, assemble(rows.drop("uses", "results"), size, keep=()))


def _reasons(rows: DataFrame, msgs: DataFrame) -> DataFrame:
    """The reasons, by the rows as stored and the messages assembled from them."""
    parts = _summaries(_ranged(msgs.drop("contig", "text")))
    w = W.partitionBy("session_id").orderBy("part")
    talk = parts.where("speaking > 0").withColumn("next", F.lead("first").over(w)).withColumn("n", F.row_number().over(w))
    gap = F.col("doubled") | ((F.col("last") == "user") & ~F.coalesce(F.col("next") == "assistant", F.lit(False)))
    talked = talk.groupBy("session_id").agg(F.max(gap).alias("no_reply"), F.max((F.col("n") == 1) & (F.col("first") == "assistant")).alias("no_prompt"), F.lit(False).alias("empty"))
    silent = parts.groupBy("session_id").agg(F.sum("speaking").alias("k")).where("k = 0").select("session_id", F.lit("empty").alias("reason"))
    said = talked.select("session_id", F.explode(F.array(F.when(F.col("no_reply"), "no_reply"), F.when(F.col("no_prompt"), "no_prompt"))).alias("reason")).where("reason is not null")
    both = F.array_union(F.transform("uses", lambda i: F.struct(i.alias("id"), F.lit(1).alias("use"))), F.transform("results", lambda i: F.struct(i.alias("id"), F.lit(0).alias("use"))))
    tools = rows.where("size(uses) > 0 or size(results) > 0").select("session_id", F.explode(both).alias("t")).groupBy("session_id", "t.id").agg(F.max("t.use").alias("u"), F.min("t.use").alias("r"))
    lost = tools.where("not (u = 1 and r = 0)").select("session_id", F.lit("lost_tool").alias("reason")).distinct()
    return silent.unionByName(said).unionByName(lost)


def conversations(df: DataFrame, size: int = FRAGMENT) -> DataFrame:
    """The sessions that are whole, one row for each message in order.

    Columns: session_id, position (from 0), speaker, text, ts, contig. Messages are the rows of the user
    and the assistant; edge cases as in ``drop_reasons``.
    """
    rows = message_rows(df)
    msgs = assemble(rows.drop("uses", "results"), size, keep=())
    bad = _reasons(rows.drop("text"), msgs).select("session_id").distinct()
    msgs = msgs.where("speaker is not null").join(bad, "session_id", "left_anti")
    ranged = cut(_ranged(msgs).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    starts = ranged.groupBy("session_id", part.alias("__part")).agg(F.count("*").alias("__rows"), F.min("__at").alias("__first"))
    w = W.partitionBy("session_id").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.withColumn("__before", F.coalesce(F.sum("__rows").over(w), F.lit(0)))
    at = F.col("__at") - F.col("__first") + F.col("__before")
    return ranged.withColumn("__part", part).join(starts, ["session_id", "__part"]).select("session_id", at.alias("position"), "speaker", "text", "ts", "contig")
