"""Held-out items that leak into a corpus, also re-parameterised.

Texts become words (runs of letters and digits, without regard to case, width and invisible characters),
and words become a template: numbers, names and units are typed placeholders. Hashes of template windows
of the corpus are joined with those of the items; only windows whose bit is set in a bitmap of the items
leave the task that read the text. Where enough windows of a document and an item lie on one diagonal, the
passage is aligned word by word and its edits are counted; where the words differ too much, the templates
are aligned and the slots checked: a re-parameterised item maps each old value to one new value.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut, partitions

#: Words of a template window. Of 40 words with 4 edits at least 6 windows of 7 stay whole, see ``MIN_HITS``.
WINDOW, MIN_HITS = 7, 6
#: Shortest passage, and the share of its words that may be replaced, dropped or added; of a template whose slots differ, less.
MIN_WORDS, MAX_EDITS, TEMPLATE_EDITS = 40, 0.1, 0.05
#: Of 40 template words with 2 edits at least 20 windows stay whole.
MIN_TEMPLATE_HITS = 20
#: Items are looked up in blocks of at most so many words, one pass over the corpus for each block.
BLOCK_WORDS = 2_000_000
#: Candidates, and pairs of them, that are broadcast: about 30 MB.
FEW = 1_000_000
#: Half the width of a band of diagonals.
BAND = 12

# Units that follow a number.
UNITS = set(
    "ms s sec secs second seconds min mins minute minutes h hour hours day days week weeks month months year years percent pct times kb mb gb tb bytes byte rows row lines entries entry items workers"
    " sekunden minuten stunden tage prozent mal zeilen blöcke plätze einträge werte secondes minutes heures jours fois lignes tranches places entrées valeurs segundos minutos horas días veces filas bloques huecos entradas valores".split()
)
NUM, NAME, UNIT = 1, 2, 3

#: A word, with the underscore that ties it to the next one.
_TOKEN = re.compile(r"[^\W_]+(?:_(?=[^\W_]))?")
_RUN = re.compile(r"[^\W_]+")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(_)|[nrtfb\"'/\\])")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*+>|<!--.*?-->", re.S)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[a-zA-Z]{2,8});")


def clean(text: str) -> str:
    """Escapes, entities and tags taken out, width folded, invisible characters removed."""
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else m[2] or " ", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if not text.isprintable():
            text = "".join(c for c in text if unicodedata.category(c) != "Cf") if any(unicodedata.category(c) == "Cf" for c in set(text)) else text
    return text


class Words:
    """Text to word and template numbers, against the vocabulary of a block of items.

    What a word stands for in the template follows from its letters without regard to case and from the
    underscores that tie it to its neighbours, so that equal words have equal templates: a number, a word
    with a digit, of a tied name, or written as a name (``camelCase``) in an item, a unit, or itself. Words that no
    item has are names by their own shape.
    """

    def __init__(self, vocab: dict[str, int], joined: dict[str, tuple[int, int]], names: set[str]) -> None:
        self.vocab, self.joined, self.names = vocab, joined, names
        self.of: dict[str, int] = {}
        self.table = np.empty((1 << 12, 4), np.int64)

    def _row(self, tok: str) -> tuple[int, int, int, int]:
        """(word, template, second word of two that stand joined, tied to the next)."""
        w = tok.rstrip("_")
        low = w.casefold()
        got, second = self.vocab.get(low), 0
        known = got is not None
        if not known:
            got, second = self.joined.get(low, (0, 0))
        if low.isdigit():
            form = NUM
        elif low in self.names or any(c.isdigit() for c in w) or (not known and not second and shaped_as_name(w)):
            form = NAME
        elif low in UNITS:
            form = UNIT
        else:
            form = got
        return got, form, second, len(w) < len(tok)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, template numbers); 0 is a word that no item has, which no window may hold."""
        of = self.of
        if len(of) > 300_000:
            of.clear()
        tokens = _TOKEN.findall(clean(text))
        for t in set(tokens).difference(of):
            if len(of) == len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[len(of)] = self._row(t)
            of[t] = len(of)
        got = self.table[np.fromiter(map(of.__getitem__, tokens), np.int64, len(tokens))]
        ids, forms, second, tied = got[:, 0], got[:, 1], got[:, 2], got[:, 3] > 0
        tied[1:] |= tied[:-1].copy()
        forms = np.where(tied & (forms != NUM), NAME, forms)
        two = np.flatnonzero(second)
        if len(two):
            again = np.where(forms[two] == ids[two], second[two], forms[two])
            ids, forms = np.insert(ids, two + 1, second[two]), np.insert(forms, two + 1, again)
        return ids, forms


def shaped_as_name(w: str) -> bool:
    """Capitals inside a word that is not in capitals altogether."""
    return len(w) > 3 and not w.isupper() and any(c.isupper() for c in w[1:])


_MULT = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(32)], np.uint64)


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of ``width`` numbers, never 0; 0 where a window holds a 0."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    u = ids.astype(np.uint64)
    u = (u ^ (u >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    u ^= u >> np.uint64(27)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = (h ^ (u[j : j + n] * _MULT[j])) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    bad = np.cumsum(np.r_[0, ids == 0])
    h |= np.uint64(1)
    h[bad[width:] - bad[:-width] > 0] = 0
    return h


class ItemIndex:
    """Vocabulary, words, templates and template windows of a block of items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        texts = {i: clean(t) for i, t in items}
        vocab: dict[str, int] = {}
        names: set[str] = set()
        for t in texts.values():
            for w in _RUN.findall(t):
                vocab.setdefault(w.casefold(), len(vocab) + 16)
                if shaped_as_name(w):
                    names.add(w.casefold())
        joined: dict[str, tuple[int, int]] = {}
        self.words: dict[int, np.ndarray] = {}
        self.forms: dict[int, np.ndarray] = {}
        self.spoken: dict[int, list[str]] = {}
        enc = Words(vocab, {}, names)
        hashes, words, owners, places = [], [], [], []
        for i, t in texts.items():
            ids, forms = enc.encode(t)
            self.words[i], self.forms[i] = ids, forms
            self.spoken[i] = spoken(t)
            for a, b in zip(self.spoken[i], self.spoken[i][1:], strict=False):
                if a + b not in vocab:  # punctuation between the two may be lost
                    joined.setdefault(a + b, (vocab[a], vocab[b]))
            h = window_hashes(forms, WINDOW)
            p = np.flatnonzero(h)
            hashes.append(h[p])
            words.append(window_hashes(ids, WINDOW)[p])
            owners.append(np.full(len(p), i, np.int64))
            places.append(p)
        self.lexicon = (vocab, joined, names)
        none = np.empty(0, np.uint64)
        h, w = (np.concatenate(x) if x else none for x in (hashes, words))
        self.owner, self.place = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (owners, places))
        # bitmaps over some bits of the hashes: at least 64 bits for each window up to 16 MB, then fewer
        self.low = min(27, max(16, int(64 * len(h)).bit_length()))
        self.templates, self.exact = np.zeros(1 << self.low, bool), np.zeros(1 << self.low, bool)
        self.templates[self._bit(h)] = True
        self.exact[self._bit(w)] = True
        self.h, self.w = h.view(np.int64), w.view(np.int64)

    def _bit(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(20)) & np.uint64((1 << self.low) - 1)

    def passing(self, ids: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(template hash, word hash, place) of the windows of a document that an item may have; None if they are too few for any passage."""
        h = window_hashes(forms, WINDOW)
        at = np.flatnonzero(self.templates[self._bit(h)] & (h != 0))
        if len(at) < MIN_HITS:
            return None
        w = window_hashes(ids, WINDOW)[at]
        same = at[self.exact[self._bit(w)] & (w != 0)]
        keep = np.isin(at, dense(same, MAX_EDITS)) | np.isin(at, dense(at, TEMPLATE_EDITS))
        return (h[at[keep]].view(np.int64), w[keep].view(np.int64), at[keep]) if keep.any() else None

    def windows(self) -> pa.Table:
        return pa.table({"h": pa.array(self.h, pa.int64()), "item_w": pa.array(self.w, pa.int64()), "item_id": pa.array(self.owner, pa.int64()), "place": pa.array(self.place, pa.int64())})


def dense(at: np.ndarray, share: float) -> np.ndarray:
    """Those of the sorted places that may belong to a passage, given how many windows it keeps whole in how few words.

    A passage of n words with e edits keeps n - WINDOW + 1 - e * WINDOW windows in at most n + e words. Of the lengths with
    as many edits the shortest asks for the least, and passages of twice the least length contain shorter ones.
    """
    ok = np.zeros(len(at), np.int64)
    edits = int(MIN_WORDS * share)
    while (n := max(MIN_WORDS, math.ceil(edits / share))) < 2 * MIN_WORDS:
        least = n - WINDOW + 1 - edits * WINDOW
        first = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] <= n + edits - WINDOW) if len(at) >= least else np.empty(0, np.int64)
        np.add.at(ok, first, 1)
        ends = first + least
        np.add.at(ok, ends[ends < len(at)], -1)
        edits += 1
    return at[np.cumsum(ok) > 0]


def spoken(text: str) -> list[str]:
    """The words of a cleaned text."""
    return [w.casefold() for w in _RUN.findall(text)]


def align(pairs: list[tuple[np.ndarray, np.ndarray, int]], least: int = MIN_WORDS, share: float = MAX_EDITS) -> list[tuple[int, int, int, int] | None]:
    """The best passage of each (item words, document words, diagonal): (words, edits, item end, document end).

    best[e] at (i, j) is the most item words that end there with e edits; an edit replaces, drops or adds
    a word. A passage of any length with few enough edits contains one of less than twice the least
    length with few enough, so edits up to a tenth of that suffice. None: no such passage.
    """
    if not pairs:
        return []
    most = int((2 * least - 1) * share)
    width = 2 * BAND + 1
    n = max(len(a) for a, _, _ in pairs)
    item = np.full((len(pairs), n), -1, np.int64)
    doc = np.full((len(pairs), n + width), -2, np.int64)
    for k, (a, b, d) in enumerate(pairs):
        item[k, : len(a)] = a
        lo = d - BAND
        s, e = max(0, lo), min(len(b), lo + n + width)
        if e > s:
            doc[k, s - lo : e - lo] = b[s:e]
    doc[doc == 0] = -2
    # without as many words somewhere in the band as a passage must keep there is nothing to align
    seen = np.zeros((len(pairs), n), np.int32)
    for x in range(width):
        seen |= doc[:, x : x + n] == item
    total = np.cumsum(np.pad(seen, ((0, 0), (1, 0))), axis=1)
    span = min(least, n)
    live = np.flatnonzero((total[:, span:] - total[:, :-span]).max(axis=1) >= least - int(least * share))
    if len(live) < len(pairs):
        part = align([pairs[k] for k in live], least, share)
        out_: list = [None] * len(pairs)
        for k, got in zip(live, part, strict=True):
            out_[k] = got
        return out_
    neg = -(10**6)
    # f[e, pair, x]: x is the diagonal within the band
    f = np.full((most + 1, len(pairs), width), neg, np.int32)
    best = np.full((most + 1, len(pairs)), 0, np.int32)
    end_i = np.zeros((most + 1, len(pairs)), np.int32)
    end_j = np.zeros((most + 1, len(pairs)), np.int32)
    rows = np.arange(len(pairs))
    for i in range(n):
        same = doc[:, i : i + width] == item[:, i : i + 1]
        g = np.full_like(f, neg)
        # a match goes on along the diagonal, or begins a passage
        g[0] = np.where(same, np.maximum(f[0], 0) + 1, neg)
        for e in range(1, most + 1):
            x = np.where(same, f[e] + 1, f[e - 1] + 1)  # replaced
            x[:, :-1] = np.maximum(x[:, :-1], f[e - 1][:, 1:] + 1)  # dropped: one diagonal further right before
            x[:, 1:] = np.maximum(x[:, 1:], g[e - 1][:, :-1])  # added
            g[e] = x
        f = g
        # a passage ends with a word that is there
        ended = np.where(same[None], f, neg)
        at = ended.argmax(axis=2)
        top = ended[np.arange(most + 1)[:, None], rows[None], at]
        better = top > best
        best = np.where(better, top, best)
        end_i = np.where(better, i, end_i)
        end_j = np.where(better, i + at, end_j)
    out: list[tuple[int, int, int, int] | None] = []
    for k in range(len(pairs)):
        got = None
        for e in range(most + 1):
            if best[e, k] >= least and e <= best[e, k] * share + 1e-9 and (got is None or best[e, k] > got[0]):
                got = (int(best[e, k]), e, int(end_i[e, k]), int(end_j[e, k]) + pairs[k][2] - BAND)
        out.append(got)
    return out


def slots(item: list, forms: np.ndarray, doc: list, diag: int, first: int, last: int) -> tuple[int, bool]:
    """(changed slots, consistent): numbers, names and units of the item for which the document has other values.

    Consistent if each old value of the passage has one new value and each new value one old.
    """
    there, back = defaultdict(set), defaultdict(set)
    changed = 0
    for i in range(max(0, first), min(len(item), last + 1)):
        j = i + diag
        if NUM <= forms[i] <= UNIT and 0 <= j < len(doc):
            there[item[i]].add(doc[j])
            back[doc[j]].add(item[i])
            changed += item[i] != doc[j]
    return changed, all(len(v) == 1 for v in there.values()) and all(len(v) == 1 for v in back.values())


RESULT = "doc_id long, item_id long, kind string, words int, edits int, slots_changed int, slots_consistent boolean"
_TYPES = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("kind", pa.string()), ("words", pa.int32()), ("edits", pa.int32()), ("slots_changed", pa.int32()), ("slots_consistent", pa.bool_())]


def judge(index: ItemIndex, enc: Words, docs: list[tuple[int, str, list[tuple[int, int]]]], templates: bool) -> list[tuple]:
    """Result rows of a few documents with their candidates (item, diagonal); alignments run for many pairs at once."""
    todo: list[tuple[int, int, int, np.ndarray, np.ndarray, str]] = []
    for doc_id, text, pairs in docs:
        ids, forms = enc.encode(text)
        todo += [(doc_id, it, d, ids, forms, text) for it, d in sorted(pairs)]
    found: dict[tuple[int, int], tuple] = {}
    last, words = None, []
    for i in range(0, len(todo), 256):
        part = todo[i : i + 256]
        exact = align([(index.words[it], ids, d) for _, it, d, ids, _, _ in part])
        loose: list = [None] * len(part)
        rest = [k for k, got in enumerate(exact) if got is None] if templates else []
        for k, got in zip(rest, align([(index.forms[part[k][1]], part[k][4], part[k][2]) for k in rest], share=TEMPLATE_EDITS), strict=True):
            loose[k] = got
        for (doc_id, it, _, ids, _, text), a, b in zip(part, exact, loose, strict=True):
            got = a or b
            if got is None:
                continue
            if last is not text:
                last, words = text, spoken(clean(text))
            values, doc_values = (index.spoken[it], words) if len(words) == len(ids) else (index.words[it].tolist(), ids.tolist())
            changed, ok = slots(values, index.forms[it], doc_values, got[3] - got[2], got[2] - got[0] + 1, got[2])
            if a is None and not ok:
                continue
            row = (doc_id, it, "verbatim" if a else "reparameterised", got[0], got[1], changed, ok)
            old = found.get((doc_id, it))
            if old is None or (row[2] == "verbatim", row[3], -row[4]) > (old[2] == "verbatim", old[3], -old[4]):
                found[(doc_id, it)] = row
    return list(found.values())


_HITS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("hits", pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64()), ("at", pa.int64())])))])


def _scan(rows: DataFrame, block: list[tuple[int, str]], templates: bool) -> DataFrame:
    """Leaks of one block of items: windows that may be an item's, the join on their hash, bands, alignment."""
    spark = rows.sparkSession
    built = ItemIndex(block)
    index = spark.sparkContext.broadcast(built)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        enc = Words(*ix.lexicon)
        for b in batches:
            keep, found = [], []
            for k, text in enumerate(b.column(2).to_pylist()):
                got = ix.passing(*enc.encode(text))
                if got is not None:
                    keep.append(k)
                    found.append(got)
            if not keep:
                continue
            ends = np.cumsum([0] + [len(x[0]) for x in found])
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate([x[j] for x in found]), pa.int64()) for j in (0, 1, 2)], fields=list(_HITS.field("hits").type.value_type))
            ids = [b.column(j).take(pa.array(keep, pa.int64())) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs).cast(_HITS.field("hits").type)], schema=_HITS)

    keyed = rows.select("doc_id", F.xxhash64("text").alias("key"), "text")
    met = keyed.mapInArrow(hits, "doc_id long, key long, hits array<struct<h:long,w:long,at:long>>")
    windows = spark.createDataFrame(built.windows())
    step = BAND // 2
    each = met.select("doc_id", "key", F.explode("hits").alias("x")).select("doc_id", "key", F.col("x.h").alias("h"), F.col("x.w").alias("w"), F.col("x.at").alias("at"))
    # each hit counts for the two nearest centres, so every run of half a band is seen whole
    centre = F.floor((F.col("at") - F.col("place")) / step)
    bands = each.join(windows, "h").select("doc_id", "key", "item_id", "place", ((F.col("w") == F.col("item_w")) & (F.col("w") != 0)).alias("same"), F.explode(F.array(centre, centre + 1)).alias("centre"))
    once = bands.groupBy("doc_id", "key", "item_id", "centre", "place").agg(F.max("same").alias("same"))
    enough = (F.sum(F.col("same").cast("int")) >= MIN_HITS) | F.lit(templates) & (F.count("*") >= MIN_TEMPLATE_HITS)
    pairs = once.groupBy("doc_id", "key", "item_id", "centre").agg(enough.alias("enough")).where("enough")
    todo = cut(pairs.groupBy("doc_id", "key").agg(F.collect_list(F.struct("item_id", (F.col("centre") * step).alias("diagonal"))).alias("pairs")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        enc = Words(*ix.lexicon)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                p = b.slice(i, 64)
                pairs_ = [[(x["item_id"], x["diagonal"]) for x in row] for row in p.column(2).to_pylist()]
                got = judge(ix, enc, list(zip(p.column(0).to_pylist(), p.column(1).to_pylist(), pairs_, strict=True)), templates)
                cols = list(zip(*got, strict=True)) if got else [[]] * len(_TYPES)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _TYPES, strict=True)], names=[n for n, _ in _TYPES])

    # the texts of the candidates are read again rather than kept; candidates of a counted size go to the texts, others meet them in a shuffle
    rows_, pairs_ = todo.agg(F.count("*"), F.coalesce(F.sum(F.size("pairs")), F.lit(0))).first()
    if rows_ + pairs_ <= FEW:
        todo = F.broadcast(todo)
    spread = keyed.join(todo, ["doc_id", "key"]).select("doc_id", "text", "pairs").repartition(partitions(spark), "doc_id", F.length("text"))
    return spread.mapInArrow(run, RESULT)


def leaks(docs: DataFrame, items: DataFrame, templates: bool = True, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, kind, words, edits, slots_changed, slots_consistent), one row for each leak.

    kind is ``verbatim`` (at least 40 consecutive words of the item, of which at most one in ten is
    replaced, dropped or added; words and edits of the longest such passage that was found) or, with
    ``templates``, ``reparameterised`` (such a passage of the template, whose slots change consistently).

    Every document is read whole. Items go to the executors in blocks of at most ``block_words`` words, and
    the corpus is passed once for each block. Null or empty texts and items under 40 words leak nothing; rows repeated with the same
    ids give one row; an item that holds a passage of another is reported beside it. Extra columns are
    ignored.
    """
    rows = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null and text != ''")
    out = None
    block: list[tuple[int, str]] = []
    size = 0
    for r in items.select(F.col(item_col).cast("long"), F.col(text_col)).where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).distinct().orderBy(item_col, text_col).toLocalIterator():
        n = len(r[1]) // 4 + 1
        if block and size + n > block_words or any(r[0] == i for i, _ in block[-1:]):
            part = _scan(rows, block, templates)
            out = part if out is None else out.unionByName(part)
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block or out is None:
        part = _scan(rows, block, templates)
        out = part if out is None else out.unionByName(part)
    best = F.max_by(F.struct("kind", "words", "edits", "slots_changed", "slots_consistent"), F.struct((F.col("kind") == "verbatim").alias("v"), "words", (-F.col("edits")).alias("e"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def leaked_items(found: DataFrame) -> DataFrame:
    """How many documents each leaked item is in."""
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.sum(F.when(F.col("kind") == "verbatim", 1).otherwise(0)).alias("verbatim"), F.max("words").alias("longest"))
