"""Decision mining: markers, keyword gates, title merging, staleness, grounding and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.operators.files import lines
from tessera.session import cut

# Words that announce a change of architecture, words that titles are compared without, states of a decision record.
KEYWORDS = ["migrate", "switch to", "replace", "adopt", "deprecate", "rewrite", "introduce", "remove", "extract", "split", "convert", "transition", "revert"]
STOPWORDS = ["a", "an", "the", "for", "to", "of", "in", "on", "and", "or", "with", "is", "be"]
STATUS = {"accepted": "active", "proposed": "proposed", "draft": "proposed", "superseded": "superseded", "deprecated": "deprecated", "rejected": "rejected"}
#: Confidence in what a source says, and what each further source of one decision adds.
CONFIDENCE = {"adr_files": 1.0, "inline_markers": 0.95, "commit_messages": 0.70, "changelog": 0.70, "docs_prose": 0.60}
CORROBORATION = 0.05
#: Longest title, and lines before and after a marker that are kept as its evidence.
TITLE, CONTEXT = 80, 3


def _plain(text: Column | str) -> Column:
    """A text with LF line ends, empty for null."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\r\n?", "\n")


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def keyword_hits(text: Column, keywords: list[str] = KEYWORDS) -> Column:
    """How many distinct keywords a text holds, as parts of words too."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.size(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k)))


def body_lines(body: Column) -> Column:
    return F.size(F.filter(F.split(body, "\n"), lambda x: x.rlike(r"\S")))


def qualifies(text: Column, body: Column) -> Column:
    """Two keywords, or one and a body of at least three lines that are not blank."""
    n = keyword_hits(text)
    return (n >= 2) | ((n == 1) & (body_lines(body) >= 3))


def keyword_gate(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, paragraph, title, body, keywords, body_lines): paragraphs that qualify; blank ones do not count."""
    parts = F.filter(F.transform(F.split(_plain(text), "\n\n"), _trim), lambda x: x != "")
    p = df.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("paragraph", "body")).where(qualifies(F.col("body"), F.col("body")))
    heads = F.filter(F.transform(F.split("body", "\n"), lambda x: _trim(F.regexp_replace(_trim(x), "^#+", ""))), lambda x: x != "")
    title = F.substring(F.coalesce(F.try_element_at(heads, F.lit(1)), F.col("body")), 1, TITLE)
    return p.select("id", "paragraph", title.alias("title"), "body", keyword_hits(F.col("body")).alias("keywords"), body_lines(F.col("body")).alias("body_lines"))


def changelog_decisions(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, entry, title, body): entries under headings of level 1 to 3 that qualify; what stands before the first is dropped."""
    l = lines(df.where(F.col(text).isNotNull()).withColumn(text, _plain(text)), id_col, text)
    head = F.nullif(F.regexp_extract("line", r"^#{1,3}\s+(\S.*?)\s*$", 1), F.lit(""))
    w = W.partitionBy("id").orderBy("line_no")
    l = l.withColumn("head", head).withColumn("entry", F.count("head").over(w)).where("entry > 0")
    e = l.groupBy("id", "entry").agg(F.max("head").alias("title"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("head").isNull(), F.struct("line_no", "line")))), lambda x: x["line"]), "\n").alias("body"))
    e = e.withColumn("body", _trim(F.col("body"))).where(qualifies(F.concat_ws("\n", "title", "body"), F.col("body")))
    return e.select("id", F.col("entry").cast("int").alias("entry"), F.substring("title", 1, TITLE).alias("title"), "body")


def inline_markers(df: DataFrame, id_col: str = "id", text: str = "text", context: int = CONTEXT) -> DataFrame:
    """(id, line_no, marker, title, status, evidence) of comment markers; the evidence is the line and those around it."""
    mark = r"#\s*(WHY|DECISION|TRADEOFF|RATIONALE|REJECTED|WORKAROUND):\s*(.+)"
    l = lines(df.where(F.col(text).rlike(mark)), id_col, text)
    around = F.array_join(F.collect_list("line").over(W.partitionBy("id").orderBy("line_no").rowsBetween(-context, context)), "\n")
    l = l.withColumn("evidence", around).where(F.col("line").rlike(mark))
    m = F.regexp_extract("line", mark, 1)
    return l.select("id", "line_no", m.alias("marker"), F.substring(F.trim(F.regexp_extract("line", mark, 2)), 1, TITLE).alias("title"), F.when(m == "REJECTED", "rejected").otherwise("active").alias("status"), "evidence")


def decision_records(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, title, status, confidence, dated) of documents with a heading of level 1, which is the title without a leading number.

    A status line says the state; a word that is not known, or no such line, is ``proposed``. ``dated`` is the day of a date line.
    """
    word = F.lower(F.regexp_extract("body", r"(?im)^status:[ \t]*(\S.*?)\s*$", 1))
    status = F.lit("proposed")
    for k, v in STATUS.items():
        status = F.when(word == k, v).otherwise(status)
    d = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), _plain(text).alias("body"))
    d = d.withColumn("head", F.regexp_extract("body", r"(?m)^#[ \t]+(\S.*?)\s*$", 1)).where("head != ''")
    day = F.try_to_date(F.nullif(F.regexp_extract("body", r"(?im)^date:[ \t]*(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd")
    return d.select("id", _trim(F.regexp_replace("head", r"^\d+\.\s*", "")).alias("title"), status.alias("status"), F.lit(CONFIDENCE["adr_files"]).alias("confidence"), day.alias("dated"))


def commit_decisions(log: DataFrame) -> DataFrame:
    """(id, title, body, at) of commits (sha, at, subject, body) that qualify; the evidence is subject and body."""
    text = F.concat_ws("\n", "subject", "body")
    return log.where(F.col("sha").isNotNull() & qualifies(text, F.coalesce("body", F.lit("")))).select(F.col("sha").alias("id"), F.substring("subject", 1, TITLE).alias("title"), _trim(text).alias("body"), "at")


def mentioned_names(texts: DataFrame, known: DataFrame, id_col: str = "id", text: str = "body", name: str = "node_id") -> DataFrame:
    """(id, name): dotted names in a text that are known, or the beginning of a known one up to a dot."""
    tokens = texts.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+\b"), F.lit(0)))).alias("name"))
    n = F.split(name, r"\.")
    heads = known.where(F.col(name).isNotNull()).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(n)), lambda i: F.array_join(F.slice(n, F.lit(1), i), "."))).alias("name")).distinct()
    return tokens.join(heads, "name", "left_semi").select("id", "name")


def mined(adr: DataFrame | None = None, markers: DataFrame | None = None, commits: DataFrame | None = None, changelog: DataFrame | None = None, prose: DataFrame | None = None) -> DataFrame:
    """(source, id, place, title, status, confidence, body): what all sources say, in the order in which they are asked.

    Each argument is the output of its own function; place is the paragraph, entry or line.
    """
    cols = lambda df, source, place, status, body: df.select(F.lit(source).alias("source"), F.col("id").cast("string").alias("id"), place.cast("int").alias("place"), "title", status.alias("status"), F.lit(CONFIDENCE[source]).alias("confidence"), body.alias("body"))
    no, proposed = F.lit(0), F.lit("proposed")
    parts = [
        adr is not None and cols(adr, "adr_files", no, F.col("status"), F.col("title")),
        markers is not None and cols(markers, "inline_markers", F.col("line_no"), F.col("status"), F.col("evidence")),
        commits is not None and cols(commits, "commit_messages", no, proposed, F.col("body")),
        changelog is not None and cols(changelog, "changelog", F.col("entry"), proposed, F.col("body")),
        prose is not None and cols(prose, "docs_prose", F.col("paragraph"), proposed, F.col("body")),
    ]
    parts = [p for p in parts if p]
    if not parts:
        raise ValueError("no source to mine")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merged_decisions(raws: DataFrame, by: tuple[str, ...] = ("package",), group: str = "group") -> DataFrame:
    """(*by, group, title, status, source, confidence, members): one decision for each group of ``greedy_groups``.

    Title, status and source are those of the member with the highest confidence, of several the first (column
    ``at``); each further member adds CORROBORATION, 1 at most.
    """
    best = F.min_by(F.struct("title", "status", "source"), F.struct((-F.col("confidence")).alias("c"), "at")).alias("best")
    g = raws.groupBy(*by, group).agg(best, F.max("confidence").alias("c"), F.count("*").alias("members"))
    return g.select(*by, group, "best.*", F.round(F.least(F.lit(1.0), F.col("c") + CORROBORATION * (F.col("members") - 1)), 6).alias("confidence"), "members")


def decision_chunks(decisions: DataFrame) -> DataFrame:
    """(decision_key, title, text, kind) of decisions (title, body), as rows for the index; one for each key."""
    d = decisions.withColumn("decision_key", title_key(F.col("title"))).where("decision_key != ''")
    return d.groupBy("decision_key").agg(F.min(F.struct("title", "body")).alias("d")).select("decision_key", "d.title", F.col("d.body").alias("text"), F.lit("decision_record").alias("kind"))


def governs_edges(decisions: DataFrame, names: DataFrame) -> DataFrame:
    """(from_node_id, to_node_id, kind) from the key of a decision (id, title) to each name (id, name) it speaks of."""
    d = decisions.select("id", title_key(F.col("title")).alias("key")).where("key != ''")
    return d.join(names, "id").select(F.concat(F.lit("decision:"), F.col("key")).alias("from_node_id"), F.col("name").alias("to_node_id"), F.lit("governs").alias("kind")).distinct()


def target_class(target: Column) -> Column:
    """``path`` for a slash or a source file's extension, else ``qname`` for a dotted name, else ``both``."""
    file = F.lower(target).rlike(r"\.(py|pyi|md|rst|txt|toml|yaml|yml|cfg)$")
    return F.when(F.contains(target, F.lit("/")) | file, "path").when(F.contains(target, F.lit(".")), "qname").otherwise("both")


def target_parents(target: Column) -> Column:
    """The modules above a target, nearest first; of a path, above the name that it stands for."""
    stem = F.regexp_replace(target, r"(?i)\.(py|pyi|md|rst|txt|toml|yaml|yml|cfg)$", "")
    name = F.when(target_class(target) == "path", F.trim(F.regexp_replace(stem, r"[/\\]", "."), F.lit("."))).otherwise(target)
    parts = F.split(name, r"\.")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).otherwise(F.array().cast("array<string>"))


def title_words(title: Column) -> Column:
    """A title's words in lower case without punctuation and stopwords, in order."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}_\s]+", " "), r"\s+")
    return F.filter(words, lambda w: (w != "") & ~F.array_contains(F.array(*map(F.lit, STOPWORDS)), w))


def title_tokens(title: Column) -> Column:
    """The words of a title, each once."""
    return F.array_distinct(title_words(title))


def title_key(title: Column) -> Column:
    return F.array_join(title_words(title), "-")


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets; 0 if both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(0.0)


def similar_titles(df: DataFrame, least: float = 0.85, id_col: str = "id", title: str | None = "title", by: str | None = None, tokens: str = "toks") -> DataFrame:
    """(a, b, overlap) between different token sets; rows of equal sets come as members of one representative.

    ``by`` names a column that both must share; without a title column the sets are those of ``tokens``.

    Candidates share one of the tokens that a set this similar must have in common with another (prefix
    filter over tokens ordered by rarity), so no group is expanded into all its pairs.
    """
    own = F.col(by).cast("string") if by else F.lit("")
    t = df.select(F.col(id_col).alias("id"), own.alias("by"), (F.col(tokens) if title is None else title_tokens(F.col(title))).alias("toks")).where(F.size("toks") > 0)
    sets = t.groupBy("by", F.sort_array("toks").alias("toks")).agg(F.min("id").alias("rep"))
    # a token is one of its ``by``
    tok = sets.select("rep", "toks", F.explode(F.transform("toks", lambda x: F.concat("by", F.lit("\0"), x))).alias("tok"))
    freq = tok.groupBy("tok").agg(F.count("*").alias("n"))
    order = tok.join(freq, "tok").groupBy("rep", "toks").agg(F.sort_array(F.collect_list(F.struct("n", "tok"))).alias("o"))
    n = F.size("toks")
    prefix = order.select("rep", "toks", F.explode(F.slice("o", F.lit(1), (n - F.ceil(n * F.lit(least)) + 1).cast("int"))).alias("p")).select("rep", "toks", F.col("p.tok").alias("tok"))
    a, b = prefix.toDF("a", "ta", "tok"), prefix.toDF("b", "tb", "tok")
    near = a.join(b, "tok").where((F.col("a") < F.col("b")) & (F.size("ta") >= F.size("tb") * least) & (F.size("tb") >= F.size("ta") * least)).drop("tok").distinct()
    return near.withColumn("overlap", F.round(jaccard(F.col("ta"), F.col("tb")), 6)).where(F.col("overlap") >= least).select("a", "b", "overlap")


def title_groups(df: DataFrame, id_col: str = "id", title: str = "title") -> DataFrame:
    """(title_key, first_id, members, confidence): rows of one normalised title; 0.05 more for each further one, 1 at most."""
    g = df.select(F.col(id_col).alias("id"), title_key(F.col(title)).alias("title_key")).where("title_key != ''").groupBy("title_key").agg(F.min("id").alias("first_id"), F.count("*").alias("members"))
    return g.withColumn("confidence", F.round(F.least(F.lit(1.0), 0.7 + 0.05 * (F.col("members") - 1)), 6))


def staleness(changed: Column, total: Column, age_days: Column) -> Column:
    """0.7 x share of changed files + 0.3 x age in years of 365 days, both at most 1."""
    ratio = F.when(total > 0, changed / total).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), 0.7 * ratio + 0.3 * F.least(F.lit(1.0), age_days / 365.0)), 6)


def grounding(claims: DataFrame, spans: DataFrame, least: float = 0.6) -> DataFrame:
    """(id, overlap, verified): the best share of a claim's content words that one single span holds."""
    j = claims.select("id", title_tokens(F.col("claim")).alias("c")).join(spans.select("id", title_tokens(F.col("span")).alias("s")), "id", "left")
    share = F.when(F.size("c") > 0, F.size(F.array_intersect("c", F.coalesce("s", F.array()))) / F.size("c")).otherwise(0.0)
    return j.withColumn("o", share).groupBy("id").agg(F.round(F.max("o"), 6).alias("overlap")).withColumn("verified", F.col("overlap") >= least)


def census(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def activity(df: DataFrame, at: str, group: str, now: str, days: int = 90, top: int = 5) -> DataFrame:
    """The most active groups within a window before ``now``."""
    t = F.to_timestamp(F.lit(now))
    return df.where((F.col(at) <= t) & (F.col(at) > t - F.expr(f"interval {days} days")) & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).limit(top)


def trend(df: DataFrame, at: str, now: str, by: str | None = None) -> DataFrame:
    """Count of the last 30 days over that of the 30 before; 1 where there were none before."""
    t = F.to_timestamp(F.lit(now))
    age = t.cast("double") - F.col(at).cast("timestamp").cast("double")
    day = 86400.0
    recent, before = F.sum(F.when((age >= 0) & (age < 30 * day), 1).otherwise(0)), F.sum(F.when((age >= 30 * day) & (age < 60 * day), 1).otherwise(0))
    g = df.groupBy(*([by] if by else [])).agg(recent.alias("recent"), before.alias("before"))
    return g.withColumn("trend", F.round(F.when(F.col("before") > 0, F.col("recent") / F.col("before")).otherwise(1.0), 6))


def community_cards(nodes: DataFrame, top: int = 10) -> DataFrame:
    """(community, size, head, label): the largest communities, their most central node, their common dotted prefix."""
    g = nodes.where("community is not null").groupBy("community").agg(F.count("*").alias("size"), F.max_by("node", F.struct("pagerank", "node")).alias("head"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    a, b = F.split("lo", r"\."), F.split("hi", r"\.")
    same = F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda i: F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i))
    label = F.array_join(F.slice(a, F.lit(1), F.size(same)), ".")
    w = W.partitionBy().orderBy(F.desc("size"), "label", "community")
    return g.withColumn("label", label).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("community", "size", "head", "label")


def greedy_groups(df: DataFrame, by: str, order: str, title: str = "title", least: float = 0.85) -> DataFrame:
    """(by, order, group): rows in order join the first group whose first title is similar enough.

    The fold depends on the order, so titles that may meet are walked together: distinct normalised titles that
    have a similar one in their ``by`` at all, found by the join of ``similar_titles``. All others, and rows without a title word,
    are groups of their own set; rows of one set take its group afterwards.
    """
    import pandas as pd

    rows = df.select(by, F.col(order).alias("__o"), F.sort_array(title_tokens(F.col(title))).alias("toks"))
    sets = rows.groupBy(by, "toks").agg(F.min("__o").alias("first")).withColumn("rep", F.concat_ws("\0", F.col(by).cast("string"), F.array_join("toks", " ")))
    sets = cut(sets)
    near = similar_titles(sets, least, "rep", None, by, "toks")
    meet = near.select(F.col("a").alias("rep")).union(near.select("b")).distinct()
    t = dict(sets.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first", kind="stable")
        groups: list[tuple[frozenset, object]] = []
        holding: dict[str, list[int]] = {}
        out = []
        for toks, first in zip(pdf["toks"], pdf["first"], strict=True):
            s = frozenset(toks)
            near_ = sorted({g for w in s for g in holding.get(w, ())})
            hit = next((g for g in near_ if len(s & groups[g][0]) / len(s | groups[g][0]) >= least), None)
            if hit is None:
                hit = len(groups)
                groups.append((s, first))
                for w in s:
                    holding.setdefault(w, []).append(hit)
            out.append(groups[hit][1])
        return pd.DataFrame({by: pdf[by], "toks": pdf["toks"], "group": out})

    folded = sets.join(meet, "rep", "left_semi").groupBy(by).applyInPandas(fold, f"`{by}` {t[by]}, toks array<string>, `group` {t['first']}")
    alone = sets.join(meet, "rep", "left_anti").select(by, "toks", F.col("first").alias("group"))
    return rows.join(folded.unionByName(alone), [by, "toks"]).select(by, F.col("__o").alias(order), "group")
