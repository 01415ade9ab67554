"""Keyword-stuffed pages, link lists and tag lists.

Each word becomes its class: function words by their part (article, preposition, ...), other words by
shape and by whether they were just said; separators stay, markup goes. An n-gram model of such sequences,
trained on prose, gives each stretch of a page its perplexity; a second one, trained on lists made of the
same words (items of a few words, separators, links, tags, words said again), says what perplexity the
stretch would have as a list. A stretch is abnormal, too high or too low for prose, if the list model
finds it far less surprising. Abnormal stretches that are code, configuration, logs, tables or glossaries are
set aside by the form of their line, and a page is flagged if more than half of its words are in the rest.
"""

from __future__ import annotations

import html
import itertools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a list may be, as often as it is written: what separates its items, the share of words said again, what marks items, the share of function words (few or many words again), and the items.
SEPARATORS = ["comma", "pipe", "arrow", "semicolon", "colon", "stop", "bang", None, None]
AGAIN = [0, 0, 0.3, 0.6, 0.9]
MARKS = [None, None, "url", "url", "hashtag", "tag", "number", "upper"]
SPOKEN = [0, 0, 0.05, 0.15], [0, 0.1, 0.25, 0.4]
ITEMS = [1, 1, 2, 8, 20]
#: Kinds of lists, and how many lists in all the model is to have seen.
LISTS = len(set(SEPARATORS)) * len(set(MARKS)) * sum(len(set(SPOKEN[a >= 0.6])) for a in set(AGAIN))
SEEN = 6000
#: Tokens of a stretch; a line that is longer has several.
STRETCH = 40
#: Logarithm of how many times likelier a stretch must be as a list than as prose.
ODDS = math.log(20)
#: Words within which a word said again counts as a repetition.
ECHO = 30

# Function words of en, de, fr, es by their part.
PARTS = {
    "article": "the a an this that these those each every some any all no its his her their our my your one der die das den dem des ein eine einen einem einer eines diese dieser dieses jede jeder jedes kein keine alle le la les l un une des ce cet cette ces chaque tout toute tous mon son sa ses leur leurs aucun el los las una unos unas este esta estos estas ese esa cada todo toda todos su sus mi ningún ninguna",
    "preposition": "of in on at by for with from to into onto over under about after before between through during without within against than as per of via across beside inside outside instead apart since until like unlike von in im am an auf mit bei beim nach vor aus zu zum zur für durch ohne gegen um über unter zwischen ab bis seit als de du à au aux en dans par pour avec sans sur sous entre vers chez depuis avant après selon del al con sin por para sobre bajo desde hasta hacia según",
    "conjunction": "and or but nor so yet if when while because although unless whether once where whenever und oder aber sondern denn wenn weil dass ob damit bevor während sofern et ou mais donc car si quand lorsque puisque que afin alors y e o u pero sino porque cuando aunque mientras",
    "pronoun": "it they we you he she i them us him me who which what there everyone nobody nothing er sie es wir ihr ich man wer was niemand il elle on nous vous ils elles je qui quoi dont rien personne lo se nos yo quien nadie nada le les",
    "auxiliary": "is are was were be been being am has have had do does did can could may might must shall should will would let lets ist sind war waren wird werden wurde hat haben hatte kann können muss soll darf est sont était a ont avait peut doit sera fait être avoir es son era fue está están ha han puede debe hay ser",
    "negation": "not never cannot n't nicht nie kein weder ne pas jamais ni no nunca jamás tampoco",
    "adverb": "only also already just still even then now here there too very more most less least rarely often always seldom once twice first later yet again how why nur auch schon noch dann jetzt hier sehr mehr erst so wie warum daher danach bereits seulement aussi déjà encore puis ensuite ici très plus moins tant comment pourquoi solo sólo también ya aún todavía luego después aquí muy más menos como cómo",
}
CLASSES = ["start", "word", "echo", "capital", "upper", "name", "number", "url", "hashtag", "tag", "comma", "stop", "semicolon", "colon", "bang", "pipe", "arrow", "open", "close", "bracket", "quote", "star", "dash", "slash", "equals", "hash", "brace", "symbol", *PARTS]
_C = {c: i for i, c in enumerate(CLASSES)}
_PUNCT = {**dict.fromkeys(",，、", "comma"), **dict.fromkeys(".。…", "stop"), ";": "semicolon", ":": "colon", **dict.fromkeys("!?¡¿", "bang"), **dict.fromkeys("|¦•·", "pipe"), **dict.fromkeys("»›→>«‹", "arrow"), "(": "open", ")": "close", **dict.fromkeys("[]", "bracket"), **dict.fromkeys("\"'`’‘“”´", "quote"), **dict.fromkeys("*_", "star"), **dict.fromkeys("-–—−", "dash"), **dict.fromkeys("/\\", "slash"), "=": "equals", "#": "hash", **dict.fromkeys("{}", "brace")}
#: Classes that mark up a text and are no part of what it says.
_MARKUP = np.isin(np.arange(len(CLASSES)), [_C[c] for c in "star quote hash bracket open close dash symbol slash brace equals".split()])
_FUNCTION = {w: _C[p] for p, ws in PARTS.items() for w in ws.split()}

_TOKEN = re.compile(r"\n|(?:https?|ftp)://[^\s<>\"')\]]+|www\.[^\s<>\"')\]]+|<[a-zA-Z/!][^<>\n]*+>|#\w+|\w+(?:[.'’-]\w+)*|[^\w\s]")
_RUN = re.compile(r"[^\W_]+")
_WIDE = re.compile("[\uff01-\uff5e]")


class Vocabulary:
    """Tokens to class, number of words and identity, remembered."""

    def __init__(self) -> None:
        self.of: dict[str, int] = {}
        self.table = np.empty((1 << 12, 3), np.int64)
        self.low: dict[str, int] = {}

    def codes(self, tokens: list[str]) -> np.ndarray:
        """(class, words, identity) of each token; identity is 0 for what is no plain word."""
        if len(self.of) > 300_000:
            self.__init__()
        of = self.of
        for t in set(tokens).difference(of):
            if len(of) == len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[len(of)] = self._row(t)
            of[t] = len(of)
        return self.table[np.fromiter(map(of.__getitem__, tokens), np.int64, len(tokens))]

    def _row(self, t: str) -> tuple[int, int, int]:
        runs = _RUN.findall(t)
        n = len(runs)
        if not n:
            return _C[_PUNCT.get(t, "symbol")], 0, 0
        if t.startswith(("http://", "https://", "ftp://", "www.")):
            return _C["url"], n, 0
        if t[0] == "<":
            return (_C["tag"], n, 0) if "=" in t else (_C["symbol"], 0, 0)
        if t[0] == "#":
            return (_C["number"] if t[1:].isdigit() else _C["hashtag"]), n, 0
        low = t.casefold()
        if low in _FUNCTION:
            return _FUNCTION[low], n, 0
        if t[0].isdigit():
            return _C["number"], n, 0
        key = self.low.setdefault(low, len(self.low) + 1)
        if "_" in t or "." in t or any(a.islower() and b.isupper() for a, b in zip(t, t[1:], strict=False)):
            return _C["name"], n, key
        if len(t) > 1 and t.isupper():
            return _C["upper"], n, key
        return (_C["capital"] if t[0].isupper() else _C["word"]), n, key


def _classes(codes: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Classes with words said again within ECHO tokens of the same line turned into echoes."""
    cls, ident = codes[:, 0].copy(), codes[:, 2]
    order = np.lexsort((np.arange(len(ident)), ident))
    prev = np.full(len(ident), -(10**9))
    same = (ident[order][1:] == ident[order][:-1]) & (ident[order][1:] > 0)
    prev[order[1:][same]] = order[:-1][same]
    echo = (np.arange(len(ident)) - prev <= ECHO) & (prev >= 0)
    echo[echo] &= line[echo] == line[prev[echo]]
    cls[echo] = _C["echo"]
    return cls


class Stretches:
    """A text as stretches of at most STRETCH tokens within a line."""

    def __init__(self, text: str, vocab: Vocabulary) -> None:
        if "&" in text:
            text = html.unescape(text)
        if not text.isascii() and _WIDE.search(text):
            text = unicodedata.normalize("NFKC", text)
        self.lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        tokens = _TOKEN.findall("\n".join(self.lines))
        codes = vocab.codes(tokens) if tokens else np.empty((0, 3), np.int64)
        brk = np.fromiter((t == "\n" for t in tokens), bool, len(tokens))
        line = np.cumsum(brk)
        keep = ~brk
        codes, line = codes[keep], line[keep]
        cls = _classes(codes, line)
        keep = ~_MARKUP[cls]
        codes, line, self.cls = codes[keep], line[keep], cls[keep]
        n = len(line)
        self.words = codes[:, 1]
        first = np.r_[True, line[1:] != line[:-1]] if n else np.empty(0, bool)
        start = np.flatnonzero(first)
        into = np.arange(n) - np.repeat(start, np.diff(np.r_[start, n])) if n else np.empty(0, np.int64)
        self.cut = np.flatnonzero(into % STRETCH == 0)
        # a rest that is too short to judge belongs to the stretch before
        if len(self.cut) > 1:
            size = np.diff(np.r_[self.cut, n])
            self.cut = self.cut[~((size < STRETCH // 2) & (into[self.cut] > 0))]
        self.line = line[self.cut] if n else line
        self.into = into

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each class with the two before it in its line."""
        c = self.cls
        a, b = np.r_[0, 0, c][: len(c)], np.r_[0, c][: len(c)]
        return np.where(self.into > 1, a, 0), np.where(self.into > 0, b, 0), c


def _count(texts: Iterable[str], vocab: Vocabulary) -> np.ndarray:
    """How often each class follows two others in all lines of the texts."""
    v = len(CLASSES)
    total, open_, size = np.zeros(v**3, np.int64), [], 0
    for t in texts:
        a, b, c = Stretches(t, vocab).grams()
        open_.append((a * v + b) * v + c)
        size += len(c)
        if size > 1 << 20:
            total += np.bincount(np.concatenate(open_), minlength=v**3)
            open_, size = [], 0
    if size:
        total += np.bincount(np.concatenate(open_), minlength=v**3)
    return total.reshape(v, v, v)


def _cost(counts: np.ndarray | list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the logarithm of the probability of a class after two others: trigrams, interpolated with bigrams and single classes.

    By the counts of the trigrams, or by several parts of them (places and counts).
    """
    v = len(CLASSES)
    if isinstance(counts, np.ndarray):
        n3 = counts
    else:
        n3 = np.zeros(v**3)
        for place, n in counts:
            n3[place] += n
        n3 = n3.reshape(v, v, v)
    n2 = n3.sum(axis=0)
    n1 = n2.sum(axis=0)
    p1 = (n1 + 0.5) / (n1.sum() + 0.5 * v)
    p2 = (n2 + 2 * p1) / (n2.sum(axis=1, keepdims=True) + 2)
    return -np.log((n3 + 4 * p2[None]) / (n3.sum(axis=2, keepdims=True) + 4))


_START, _NUMBER, _MARK, _WORD, _SEPARATOR = range(5)


@cache
def _slots(separated: bool, marked: bool) -> np.ndarray:
    """How often a list is expected to have a slot after two others: a leading number, marks, words and separators.

    A fifth of the lists begin with a number. An item is a mark in three of ten cases (where there are marks), else one
    to three words; a separator follows, and in half the cases a mark. The first 2 * STRETCH slots count.
    """
    out = np.zeros((5, 5, 5))
    for items in ITEMS:
        now = {(items, "lead", _START, _START): 1 / len(ITEMS)}
        for _ in range(2 * STRETCH):
            then: dict[tuple, float] = {}
            while now:
                (left, at, a, b), p = now.popitem()
                if at == "lead":
                    steps = [(0.2, _NUMBER, left, "item"), (0.8, None, left, "item")]
                elif at == "item":
                    steps = [((0.7 if marked else 1) / 3, None, left, k) for k in (1, 2, 3)] + ([(0.3, _MARK, left, "end")] if marked else []) if left else []
                elif at == "end":
                    steps = [(1, _SEPARATOR if separated else None, left, "after")]
                elif at == "after":
                    steps = [(0.5, _MARK, left - 1, "item"), (0.5, None, left - 1, "item")] if marked else [(1, None, left - 1, "item")]
                else:
                    steps = [(1, _WORD, left, at - 1 if at > 1 else "end")]
                for q, slot, *to in steps:
                    if slot is not None:
                        out[a, b, slot] += p * q
                    key = (*to, a, b) if slot is None else (*to, b, slot)
                    into = now if slot is None else then
                    into[key] = into.get(key, 0) + p * q
            now = then
    return out


def _lists(counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The trigrams that lists are expected to have, for each kind of list: places and counts.

    Lists are items of one to three words of the prose, separators, links and tags, with any share of words said again.
    ``counts`` says how often the prose has each class. Function words are rare between items that differ and
    frequent in phrases that say the same words again and again.
    """
    v = len(CLASSES)

    def shares(classes: list[int]) -> np.ndarray:
        n = np.zeros(v)
        n[classes] = counts[classes]
        n[classes[0]] += not n.any()
        return n / n.sum()

    content = shares([_C[c] for c in ("word", "capital", "upper", "name", "number")])
    function = shares(list(range(_C["article"], v)))
    out = []
    for (separator, s), (mark, m), (again, g) in itertools.product(Counter(SEPARATORS).items(), Counter(MARKS).items(), Counter(AGAIN).items()):
        spoken_ = SPOKEN[again >= 0.6]
        for spoken, f in Counter(spoken_).items():
            d = np.zeros((5, v))
            d[_START, _C["start"]] = d[_NUMBER, _C["number"]] = d[_MARK, _C[mark or "start"]] = d[_SEPARATOR, _C[separator or "start"]] = 1
            d[_WORD] = (1 - again) * (spoken * function + (1 - spoken) * 0.4 * content)
            d[_WORD, _C["word"]] += (1 - again) * (1 - spoken) * 0.6
            d[_WORD, _C["echo"]] += again
            some = np.flatnonzero(d.any(axis=0))
            x = d[:, some]
            n = np.einsum("xyz,xa,yb,zc->abc", _slots(separator is not None, mark is not None), x, x, x, optimize=True)
            share = s * m * g * f / (len(SEPARATORS) * len(MARKS) * len(AGAIN) * len(spoken_))
            out.append((((some[:, None, None] * v + some[:, None]) * v + some).ravel(), SEEN * share * n.ravel()))
    return out


class ProseModel:
    """How much more surprising a class is as prose than as a list, after the two before it."""

    def __init__(self, prose: list[str] | np.ndarray) -> None:
        """By texts, or by the counts of their trigrams."""
        n3 = prose if isinstance(prose, np.ndarray) else _count(prose, Vocabulary())
        # prose in capitals or with capital initials is prose all the same
        both, seen = n3.astype(float), np.nonzero(n3)
        for c in ("upper", "capital"):
            as_ = np.arange(len(CLASSES))
            as_[[_C["word"], _C["capital"], _C["name"]]] = _C[c]
            np.add.at(both, tuple(as_[i] for i in seen), n3[seen] / 4)
        self.surplus = (_cost(both) - _cost(_lists(n3.sum(axis=(0, 1))))).astype(np.float32)

    def abnormal(self, s: Stretches) -> np.ndarray:
        """Which stretches have a perplexity that no prose has: the list model finds them less surprising."""
        return np.add.reduceat(self.surplus[s.grams()], s.cut) > ODDS if len(s.cut) else np.empty(0, bool)


_CODE = re.compile(
    r"^\s*(?:def|class|return|yield|raise|assert|import|from|if|elif|else|for|while|with|try|except|finally|async|await|lambda|pass|break|continue|print|del|global|nonlocal|@\w+|public|private|static|const|let|var|function|func|fn|struct|enum|package|use|include|#include)\b.*(?:[:({;=]|$)"
    r"|^\s*[\w.\[\]'\"]+\s*(?:[-+*/|&]?=|:=)\s*\S|^\s*[\w.]+\(.*\)\s*;?\s*$|^\s*(?:#|//|/\*|\*)\s*[\w ,]+see `|^\s*(?:Traceback|File \"|>>>|\$ )|^\s*[}\])]+[,;]?\s*$|[{;]\s*$"
)
_CONFIG = re.compile(r"^\s*\[{1,2}[\w.\- ]+\]{1,2}\s*$|^\s*[\"']?[\w.\-]+[\"']?\s*[:=]\s*[^|]*$|^\s*[{}\[\],]+\s*$|^\s*-\s+[\w.\-]+\s*$|^\s*[\w.\-]+:\s*$")
_LOG = re.compile(r"^\s*\[?\d{4}-\d\d-\d\d[ T]\d\d:\d\d|^\s*\[?\d\d:\d\d:\d\d|^\s*(?:DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b|^\s*(?:at [^\s(]++\(|File \"|Traceback)|\b(?:DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\s+[^\s:]++:")
_TABLE = re.compile(r"^\s*\|.*\|\s*$|^\s*[-+=:| ]{5,}$|^\s*<t[drh]\b|\t[^\s]++\t")
_LINK = re.compile(r"(?:https?|ftp)://|www\.\w|\]\([^()\s]++\)|<a\s[^<>]*?\bhref|^\s*\[[^\[\]]++\]:\s*\S|\[\[[^\[\]]++\]\]", re.I)
_TAGS = re.compile(r"(?:^|\s)#[^\W\d]\w+|<meta\s[^<>]*?keywords|^\s*(?:tags?|keywords?|labels?|schlagw\S+|mots[- ]cl\S+|palabras clave|etiquetas|étiquettes|stichw\S+)\s*[:=]|\bSKU-?\d+|rel=[\"']tag", re.I)


def line_kind(line: str, fenced: bool) -> str:
    """What a line that is no sentence is by its form: code, config, log or table; else links, tags or keywords."""
    if fenced or _LOG.search(line):
        return "log" if not fenced else "code"
    if _TABLE.search(line) and not _LINK.search(line):
        return "table"
    if _LINK.search(line):
        return "links"
    if _TAGS.search(line):
        return "tags"
    if _CODE.search(line):
        return "code"
    if _CONFIG.search(line):
        return "config"
    return "keywords"


def page_counts(text: str, model: ProseModel, vocab: Vocabulary) -> dict[str, int]:
    """Words of a page by kind: prose, links, tags, keywords, code, config, log, table."""
    s = Stretches(text, vocab)
    odd = model.abnormal(s)
    words = np.add.reduceat(s.words, s.cut) if len(s.cut) else np.empty(0, int)
    out: dict[str, int] = {"prose": int(words[~odd].sum()) if len(words) else 0}
    if not odd.any():
        return out
    fence = np.cumsum([ln.lstrip().startswith(("```", "~~~")) for ln in s.lines]) % 2 == 1
    kinds: dict[int, str] = {}
    for k in np.flatnonzero(odd):
        i = int(s.line[k])
        kind = kinds.get(i)
        if kind is None:
            kind = kinds[i] = line_kind(s.lines[i], bool(fence[i]))
        out[kind] = out.get(kind, 0) + int(words[k])
    return out


PAGE = "doc_id long, words int, prose int, links int, tags int, keywords int, other int, spam boolean"
_TYPES = [("doc_id", pa.int64()), ("words", pa.int32()), ("prose", pa.int32()), ("links", pa.int32()), ("tags", pa.int32()), ("keywords", pa.int32()), ("other", pa.int32()), ("spam", pa.bool_())]


def fit_prose(prose: DataFrame, text_col: str = "text") -> ProseModel:
    """The model of prose, fitted on all of a table of prose: trigrams are counted where the texts are, only the counts come to the driver."""
    v = len(CLASSES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = _count((t for b in batches for t in b.column(0).to_pylist()), Vocabulary()).ravel()
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(n[seen], pa.int64())], names=["gram", "n"])

    text = F.col(text_col)
    counts = prose.select(text.alias("t")).where(text.isNotNull()).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    n3 = np.zeros(v**3, np.int64)
    for gram, n in counts.collect():
        n3[gram] = n
    return ProseModel(n3.reshape(v, v, v))


def score_pages(docs: DataFrame, prose: DataFrame, share: float = 0.5, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words, prose, links, tags, keywords, other, spam): words by what they are in, one row for each row.

    spam: more than ``share`` of the words are links with their labels, tags or keywords. Null, empty and
    wordless texts are no spam. Texts are read whole, in one pass without a shuffle. Repeated rows give
    repeated results; extra columns are ignored; without any prose to learn from every stretch that may be a list is one.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_prose(prose))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, vocab = model.value, Vocabulary()
        for b in batches:
            out = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = page_counts(text or "", m, vocab)
                n = sum(c.values())
                bad = c.get("links", 0) + c.get("tags", 0) + c.get("keywords", 0)
                rest = n - bad - c.get("prose", 0)
                out.append((i, n, c.get("prose", 0), c.get("links", 0), c.get("tags", 0), c.get("keywords", 0), rest, n > 0 and bad > share * n))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _TYPES, strict=True)], names=[n for n, _ in _TYPES])

    return docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PAGE)
