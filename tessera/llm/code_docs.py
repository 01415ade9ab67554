"""Functions paired with their documentation, by abstract syntax trees.

Source text is parsed, function nodes are visited, and each gives its exact source range and the
documentation attached to it. A member whose source is in no chunk is parsed from its own signature, with
repairs where that was cut. What a node says of itself (name, parameters, annotations, defaults) is known;
documentation is scored by the words it adds to that, and what adds next to nothing is dropped.
"""

from __future__ import annotations

import ast
import inspect
import keyword
import re
import textwrap
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.session import strip

# Words of placeholders and of notices that documentation is missing, stubbed or inherited, in en, de, fr, es.
NOTICE = set(
    "todo fixme xxx hack tbd tba wip na null nothing pass noqa ellipsis lorem ipsum placeholder dummy stub stubs stubbed stubmaker auto autogenerated generated automatically unimplemented implemented implements implement"
    " doc docs document documents documented undocumented documentation docstring docstrings description descriptions comment comments summary text signature missing lacks needs needed pending unavailable available incomplete wanted required provided given found yet"
    " add write insert fill put provide edit please here later soon come comes follow follows goes go written done defined determined completed progress work not no do without only more details see refer same as check above below source code readme interface"
    " base parent super superclass baseclass abstract overridden overrides override overriding original inherit inherits inherited inheritdoc nonjavadoc javadoc non from by"
    " beschreibung dokumentation doku dokumentieren dokumentiert undokumentiert kommentar text fehlt folgt offen ausstehend einfügen ergänzen nachgereicht fehlend fehlende vorhanden später kommt nachgetragen arbeit bitte erledigen tun implementiert hinzufügen schreiben nachtragen verfügbar angegeben platzhalter unfertig siehe basisklasse oberklasse elternklasse basismethode wie geerbt noch nicht ohne keine zu hier wird in"
    " documenter documenté documentée compléter completer faire rédiger rediger remplir écrire ecrire venir définir décrire ici plus tard absente manquante manque cours suivre disponible fournie vide pas aucune sans non ajouter il voir hérité héritée herite insérer base mère implémentée commentaire construction chantier attente provisoire ébauche à a"
    " documentar documentado documentada descripción descripcion documentación documentacion sin falta pendiente agregar añadir anadir completar escribir hacer poner insertar ver véase heredado heredada aquí aqui luego definir describir comentario clase padre implementado hay existe todavía aún rellenar redactar proceso progreso obras construcción ausente vacía incompleta próximamente indocumentado indocumentada por no".split()
)
#: A line that begins so is a note to its author.
_NOTE = re.compile(r"^[\s#*\-.:/@\[({]*(?:todo|fixme|xxx|hack|tbd|tba|wip|noqa|lorem ipsum)\b", re.I)

# Words around a name that add nothing to it.
FILLER = set(
    "a an the this that these those it its my our your of for to from in on at by with and or is are was be does do did will can used use uses using"
    " function functions func method methods class procedure routine helper utility property attribute constructor initializer initialiser initialize initialise init operation implementation"
    " def async self cls object instance value values given current new simple simply just some any all one returns return returned"
    " der die das den dem des ein eine einen einer diese dieser dieses methode funktion klasse von für und ist zum zur"
    " le la les un une des de du cette ce cet fonction méthode methode classe pour et est l d"
    " el los las una unos unas del esta este función funcion método metodo clase para y es".split()
)

#: Words that documentation must add.
LEAST = 2

_WORD = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_SECTION = re.compile(
    r"^\s*(args|arguments|parameters|params|returns?|raises|yields?|keyword args|keyword arguments|other parameters|attributes|parameter|argumente|rückgabe|rückgabewert|paramètres|arguments|retourne|parámetros|argumentos|devuelve|retorna)\s*:?\s*$", re.I
)
_RULE = re.compile(r"^\s*[-=~*^#_.]{2,}\s*$")
_FIELD = re.compile(r"^[:@\\](\w+)\b([^:\n]*)(?::(?!\S*:)|$)(.*)$")
#: Fields of a parameter list that name a type, and those whose first word is a name.
_TYPE_FIELDS, _NAMED_FIELDS = {"type", "rtype", "ytype"}, {"param", "parameter", "arg", "argument", "keyword", "key", "kwarg", "var", "ivar", "raise", "raises", "throws", "exception"}
_VALUE_FIELDS = {"return", "returns", "yield", "yields"}


def unescape(doc: str) -> str:
    """Docstrings that were stored with their escapes: line ends, tabs and quotes put back."""
    if "\\" in doc:
        doc = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), doc)
        doc = doc.replace("\\r\\n", "\n").replace("\\n", "\n").replace("\\r", "\n").replace("\\t", "\t").replace('\\"', '"').replace("\\'", "'")
    return doc.replace("\r\n", "\n").replace("\r", "\n")


@lru_cache(maxsize=50_000)
def _stems(w: str) -> frozenset[str]:
    """Forms under which an inflected word and its base meet; the word is in lower case."""
    out = {w}
    for end in ("ing", "ies", "ied", "es", "ed", "er", "or", "ion", "s", "d", "e", "n", "en", "ung", "t"):
        if w.endswith(end) and len(w) - len(end) >= 2:
            b = w[: -len(end)]
            out.add(b)
            if end in ("ing", "ed", "er") and len(b) > 2 and b[-1] == b[-2]:
                out.add(b[:-1])
            if end in ("ies", "ied"):
                out.add(b + "y")
    return frozenset(out)


def name_words(name: str) -> list[str]:
    return [w.lower() for part in _WORD.findall(name or "") for w in _CAMEL.split(part) if w]


def added_words(text: str, known: set[str]) -> set[str]:
    """The words of a text that neither follow from the known ones nor belong to fillers and notices."""
    out = set()
    for raw in _WORD.findall(text):
        for w in [raw] if raw.isupper() or raw.islower() else _CAMEL.split(raw):
            w = w.lower()
            if not (w in FILLER or w in NOTICE or w.isdigit() or _stems(w) & known):
                out.add(w)
    return out


_KEYWORD = re.compile(r"\b(" + "|".join(keyword.kwlist) + r")\b(?=\s*[:=,)])")
_CONSTANT = {"None", "True", "False"}


def parse_function(code: str) -> ast.AST | None:
    """The first function or class node of a source text, or None."""
    try:
        node = ast.parse(code).body[0]
    except (SyntaxError, ValueError, RecursionError, MemoryError, IndexError):
        return None
    return node if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else None


def stub_node(name: str | None, signature: str | None) -> ast.AST | None:
    """The node of a signature with or without ``def``; without a usable one, of the name alone.

    Keywords that stand for parameters get an underscore; a signature that was cut ends after its last whole parameter.
    """
    flat = re.sub(r"\s+", " ", signature or "").strip().rstrip(":").strip()
    if flat:
        code = flat if re.match(r"(async\s+)?def\s|class\s", flat) else "def " + flat
        code = _KEYWORD.sub(lambda m: m[1] if m[1] in _CONSTANT else m[1] + "_", code)
        ends = [len(code)]
        depth, at = 0, []
        for i, c in enumerate(code):
            depth += (c in "([{") - (c in ")]}")
            if (c == "," and depth == 1) or (c == "(" and depth == 1):
                at.append(i + (c == "("))
        for end, close in [(ends[0], ""), (ends[0], ")"), *((i, ")") for i in reversed(at))]:
            node = parse_function(code[:end] + close + ":\n    pass")
            if node is not None:
                return node
    plain = (name or "").strip()
    return parse_function(f"def {plain}():\n    pass") if plain.isidentifier() else None


def node_words(node: ast.AST | None) -> set[str]:
    """The words a node says of itself: its name, parameters, annotations, defaults, bases."""
    words: set[str] = set()
    if node is None:
        return words
    words.update(name_words(node.name))
    for part in (getattr(node, "args", None), getattr(node, "returns", None), *getattr(node, "bases", ())):
        for n in ast.walk(part) if part is not None else ():
            for f in ("id", "arg", "attr"):
                if isinstance(v := getattr(n, f, None), str):
                    words.update(name_words(v))
            if isinstance(n, ast.Constant) and n.value is not None:
                words.update(name_words(str(n.value)))
    return words


def _own_signature(lines: list[str], at: int, names: set[str]) -> int:
    """The number of lines that restate the signature from ``at`` on: a header of one of the names that parses, 0 if there is none."""
    head = re.match(r"[\s`>]*(?:(?:async\s+)?def\s+|class\s+)?(\w+)\s*[(\[:]?", lines[at])
    if not head or head[1] not in names:
        return 0
    depth = 0
    for n in range(at, len(lines)):
        depth += lines[n].count("(") - lines[n].count(")")
        if depth <= 0:
            text = " ".join(x.strip(" `>") for x in lines[at : n + 1])
            node = stub_node(None, text.rstrip("`.: ")) if "(" in text else parse_function(text.rstrip("`.: ") + ":\n    pass")
            return n + 1 - at if node is not None and node.name in names else 0
    return len(lines) - at if "(" in lines[at] else 0


def added_by(doc: str | None, node: ast.AST | None, params: list[str] | None = None) -> set[str]:
    """The words that the documentation attached to a node adds to what the node says of itself.

    Left out: restated signatures, notes to the author, section titles, rules, and the names and types of parameter lists.
    """
    text = textwrap.dedent(unescape(doc or "")).strip()
    if not text:
        return set()
    words = node_words(node)
    for p in params or ():
        words.update(name_words(p))
    known = {s for w in words for s in _stems(w)}
    own = {node.name} if node is not None else set()
    lines = text.split("\n")
    out: set[str] = set()
    at, section = 0, False
    while at < len(lines):
        line = lines[at].strip()
        skip = _own_signature(lines, at, own)
        at += skip or 1
        if skip or not line or _NOTE.match(line) or _RULE.match(line):
            continue
        if _SECTION.match(line):
            section = True
            continue
        if m := _FIELD.match(line):
            field, name, rest = m[1].lower(), m[2].strip(), m[3].strip()
            if field in _TYPE_FIELDS:
                continue
            if field in _NAMED_FIELDS:
                # the name, with or without its type before it and a colon after it
                line = rest if m[0][m.end(2) : m.end(2) + 1] == ":" else " ".join(name.split()[1:])
            elif field in _VALUE_FIELDS:
                line = f"{name} {rest}"
            if _NOTE.match(line):
                continue
        elif section and (m := re.match(r"^[*`]*(\w+)[*`]*\s*(\([^)]*\))?\s*(:|--?|–)\s*(.*)$", line)) and not added_words(m[1], known | {"return", "self"}):
            line = m[4].strip()
            if _NOTE.match(line):
                continue
        out |= added_words(line, known)
    return out


def informative(doc: str | None, name: str | None, signature: str | None, params: list[str] | None = None, least_words: int = LEAST, source_words: list[str] | None = None) -> bool:
    """Does a docstring tell something that does not follow from name and signature alone?

    ``source_words``: what the node of the member's source says of itself, where its source is known.
    """
    return len(added_by(doc, stub_node(name, signature), [*(params or ()), *(source_words or ())])) >= least_words


def members_telling(members: DataFrame, chunks: DataFrame | None = None, least_words: int = LEAST) -> DataFrame:
    """The functions and methods of a member table whose documentation tells something.

    All columns of the input, one row for rows equal in every column but id (the smallest id). With
    ``chunks`` the documentation is that of the function node of the member's source, and its names count
    as known, where a chunk holds it (same module, name and documentation); else the node of the signature
    is taken, and of the name where there is no signature. Kinds compare without regard to case; null and
    empty docstrings tell nothing; very long docstrings are read whole; an empty table gives no rows.
    """
    rows = members.where(F.lower(strip("kind")).isin("function", "method") & F.col("docstring").isNotNull() & (F.trim("docstring") != ""))
    rest = [c for c in members.columns if c != "id"]
    rows = rows.groupBy(*rest).agg(F.min("id").alias("id"))

    @F.pandas_udf("boolean")
    def tells(doc, name, signature, params, words):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([informative(d, n, s, list(p) if p is not None else None, least_words, list(w) if w is not None else None) for d, n, s, p, w in zip(doc, name, signature, params, words, strict=True)])

    names = F.transform("parameters", lambda p: F.concat_ws(" ", p["name"], p["annotation"], p["default"]))
    if chunks is None:
        return rows.where(tells("docstring", "name", "signature", names, F.lit(None).cast("array<string>"))).select(*members.columns)
    f = functions_of(chunks).where("docstring is not null").select(strip("module").alias("__m"), F.col("name").alias("__n"), _fingerprint("docstring").alias("__p"), "docstring", "words", "chunk_id", "first_line")
    f = f.groupBy("__m", "__n", "__p").agg(F.max_by(F.struct("docstring", "words"), F.struct("chunk_id", "first_line")).alias("__source"))
    met = rows.join(f, (strip("module") == F.col("__m")) & (strip("name") == F.col("__n")) & (_fingerprint(rows["docstring"]) == F.col("__p")), "left")
    doc = F.coalesce("__source.docstring", rows["docstring"])
    return met.where(tells(doc, "name", "signature", names, F.col("__source.words"))).select(*(rows[c] for c in members.columns))


FUNCTION = "chunk_id long, module string, qualified_name string, name string, kind string, code string, docstring string, signature string, words array<string>, first_line int, last_line int"
_TYPES = [("chunk_id", pa.int64()), ("module", pa.string()), ("qualified_name", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("code", pa.string()), ("docstring", pa.string()), ("signature", pa.string()), ("words", pa.list_(pa.string())), ("first_line", pa.int32()), ("last_line", pa.int32())]


_DEF = re.compile(r"(?:async[ \t]+)?def[ \t]+(\w+)(?=\s*[(\[])|class[ \t]+\w+(?=\s*[(\[:])")
_LEX = re.compile(r'"""(?:[^\\]|\\.)*?(?:"""|\Z)|\'\'\'(?:[^\\]|\\.)*?(?:\'\'\'|\Z)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|#[^\n]*|\\\n|[()\[\]{}:\n]', re.S)
_QUOTED = re.compile(r"\s*[rRuU]?(\"{3}|'{3})(.*)\1\s*", re.S)


def _logical_lines(src: str) -> list[tuple[int, int, int, int]]:
    """(start, end, first line, last line) of each logical line that is not blank or a comment; a header ends an open bracket."""
    out = []
    start = line = first = depth = 0

    def put(end: int) -> None:
        if (s := src[start:end].strip()) and not s.startswith("#"):
            out.append((start, end, first, line))

    for m in _LEX.finditer(src):
        t = m[0]
        if t in "([{":
            depth += 1
        elif t in ")]}":
            depth = max(0, depth - 1)
        elif t == "\n":
            if depth and _DEF.match(src[m.end() : m.end() + 300].lstrip(" \t")):
                depth = 0
            if not depth:
                put(m.start())
                start, first = m.end(), line + 1
            line += 1
        else:
            line += t.count("\n")
    put(len(src))
    return out


def _doc_of(statement: str) -> str | None:
    try:
        return ast.get_docstring(ast.parse(statement.strip()), clean=True)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        m = _QUOTED.fullmatch(statement)  # an escape that Python does not read
        return inspect.cleandoc(m[2]) if m else None


def functions_by_pattern(src: str) -> list[tuple[str, str | None, str, int, int, bool]]:
    """What ``visit_functions`` gives, for text that no parser reads: by headers, balanced brackets and indents.

    A function needs a whole header and something below it. Nothing is cut; line ends are LF.
    """
    rows = _logical_lines(src)
    lines = src.split("\n")
    dents = [len((s := src[a:z].expandtabs(8))) - len(s.lstrip()) for a, z, _, _ in rows]
    out = []
    above: list[tuple[int, bool]] = []  # indent and is a class, of the headers around a line
    for k, (a, z, first, last) in enumerate(rows):
        while above and above[-1][0] >= dents[k]:
            above.pop()
        text = src[a:z]
        own = text.lstrip()
        if not (m := _DEF.match(own)):
            continue
        in_class = bool(above) and above[-1][1]
        above.append((dents[k], m[1] is None))
        if m[1] is None:
            continue
        depth, colon = 0, None
        for t in _LEX.finditer(own, m.end()):
            if t[0] in "([{":
                depth += 1
            elif t[0] in ")]}":
                depth -= 1
            elif t[0] == ":" and depth == 0:
                colon = t.end()
                break
        if colon is None:
            continue
        end = k + 1
        while end < len(rows) and dents[end] > dents[k]:
            end += 1
        beside = own[colon:].strip()
        if not beside or beside.startswith("#"):
            if end == k + 1:
                continue
            beside = src[slice(*rows[k + 1][:2])]
        top = k
        while top and dents[top - 1] == dents[k] and src[rows[top - 1][0] :].lstrip(" \t").startswith("@"):
            top -= 1
        first, last = rows[top][2], rows[end - 1][3]
        out.append((m[1], _doc_of(beside), "\n".join(lines[first : last + 1]), first, last, in_class))
    return out


def visit_functions(text: str) -> list[tuple[str, str | None, str, int, int, bool]]:
    """(name, docstring, code, first line, last line, in a class) of each function of a source text, nested ones too.

    Text that does not parse is read again without its indent; if it still does not, by ``functions_by_pattern``.
    Lines count from 0. Ranges are those of the syntax tree, decorators included.
    """
    src = re.sub(r"\r\n?", "\n", text)
    tree = None
    for attempt in (textwrap.dedent(src), "if 1:\n" + src, "class _:\n" + textwrap.indent(textwrap.dedent(src), " ")):
        try:
            tree = ast.parse(attempt)
            break
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            continue
    if tree is None:
        return functions_by_pattern(src)
    shift = 0 if attempt is not None and not attempt.startswith(("if 1:\n", "class _:\n")) else 1
    lines = src.split("\n")
    out = []

    def visit(node: ast.AST, in_class: bool) -> None:
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                first = min([n.lineno, *(d.lineno for d in n.decorator_list)]) - 1 - shift
                last = n.end_lineno - 1 - shift
                out.append((n.name, ast.get_docstring(n, clean=True), "\n".join(lines[first : last + 1]), first, last, in_class))
                visit(n, False)
            else:
                visit(n, in_class or isinstance(n, ast.ClassDef))

    visit(tree, False)
    return out


def functions_of(chunks: DataFrame, id_col: str = "id") -> DataFrame:
    """One row for each function in the source chunks: code, documentation and exact line range.

    Chunks of other kinds than function, method and class, and null or blank texts, give nothing. Lines are null where
    the chunk's first line is unknown. qualified_name is the chunk's, and for functions inside a class or
    function chunk that name and their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, module, qual, first, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = (qual or "").rpartition(".")[2]
                for name, doc, code, a, z, in_class in visit_functions(text):
                    q = qual if name == own else f"{qual}.{name}" if qual else name
                    head = code.split(":\n", 1)[0]
                    out.append((i, module, q, name, "method" if in_class else "function", code, doc, head, sorted(node_words(stub_node(name, re.sub(r"^(?:\s*@[^\n]*\n)+", "", head)))), None if first is None else first + a, None if first is None else first + z))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _TYPES, strict=True)], names=[n for n, _ in _TYPES])

    rows = chunks.where(F.lower(strip("kind")).isin("function", "method", "class") & F.col("text").isNotNull() & (F.trim("text") != ""))
    return rows.select(F.col(id_col).cast("long").alias("id"), "module", strip("qualified_name").alias("q"), F.col("start_line").cast("int").alias("l"), "text").mapInArrow(run, FUNCTION)


def _fingerprint(doc: Column | str) -> Column:
    """A docstring by its letters and digits, so that indents, escapes and line ends do not matter."""
    c = F.col(doc) if isinstance(doc, str) else doc
    return F.xxhash64(F.lower(F.regexp_replace(F.regexp_replace(c, r"\\[nrt]", " "), r"[^\p{L}\p{N}]+", "")))


def code_pairs(members: DataFrame, chunks: DataFrame, least_words: int = LEAST) -> DataFrame:
    """(id, module, name, code, docstring, chunk_id, first_line, last_line): members with telling documentation and their code.

    A member meets the functions of its module that have its name and its documentation; of several
    (a chunk indexed again) the largest chunk id counts. Members whose code is in no chunk are left out.
    """
    m = members_telling(members, None, least_words).select("id", strip("module").alias("module"), strip("name").alias("name"), "docstring", _fingerprint("docstring").alias("print"))
    f = functions_of(chunks).where("docstring is not null").select(strip("module").alias("module"), "name", _fingerprint("docstring").alias("print"), "code", "chunk_id", "first_line", "last_line")
    w = W.partitionBy("id").orderBy(F.desc("chunk_id"), "first_line")
    return m.join(f, ["module", "name", "print"]).withColumn("__n", F.row_number().over(w)).where("__n = 1").select("id", "module", "name", "code", "docstring", "chunk_id", "first_line", "last_line")
