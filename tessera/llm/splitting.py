"""Oversized texts cut into overlapping pieces at natural boundaries.

Agglomerative: a text is first taken apart into atomic segments (lines; sentences, words or hard cuts
inside a line that is too long). Neighbouring pairs wait in a heap ordered by the strength of the boundary
between them; the weakest boundary whose merged size plus overlap still fits is dissolved first. What is
left between the pieces are the strongest boundaries that had to stay.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest piece and overlap, in code points.
LIMIT, OVERLAP = 2000, 200
#: Strength of a boundary, weakest first, and the name of a cut made there.
INLINE, WORD, SENTENCE, LINE, DEDENT, BLANK = range(6)
NAMES = ["inline", "word", "sentence", "line", "line", "blank"]

_LINE = re.compile(r"([^\r\n]*)(\r\n|\n|\r|\Z)")
_SENTENCE = re.compile(r"(?<=[.!?;:])[ \t]+|(?<=[。！？])")
_SPACE = re.compile(r"\s+")

SCHEMA = "id long, piece int, text string, overlap_chars int, source_path string, start_line int, end_line int, cut string, boundary string"


def lines_of(text: str) -> list[tuple[int, int, int]]:
    """(start, end without line end, end with it) of each line; lines end with CR LF, LF or CR."""
    out, at, n = [], 0, len(text)
    while at < n:
        m = _LINE.match(text, at)
        out.append((m.start(1), m.end(1), m.end(2)))
        at = m.end(2)
    return out


def boundary_class(text: str, lines: list[tuple[int, int, int]], limit: int) -> str:
    """The finest boundary that cuts of at most ``limit`` need, the overlap left aside: that of the weakest cut which merging leaves.

    The segments are the lines that are not blank, without the line ends and blank lines around them. Merging
    dissolves every boundary inside a block before one at a blank line, so a block that fits is whole
    and one that does not keeps a cut at a line, or inside a line that does not fit.
    """
    segments: list[tuple[int, int, int]] = []
    blank = False
    for s, e, _ in lines:
        if not text[s:e].strip(" \t"):
            blank = True
            continue
        level = BLANK if blank else LINE
        blank = False
        at = s
        for part_level, cut in _parts(text, s, e, limit) if e - s > limit else ((level, e),):
            segments.append((at, cut, level if at == s else min(part_level, SENTENCE)))
            at = cut
    weakest = min((level for _, _, level in merge(segments, limit, 0)[1:]), default=BLANK)
    return "blank" if weakest == BLANK else "line" if weakest == LINE else "inline"


def atoms(text: str, lines: list[tuple[int, int, int]], most: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary before it), without gaps, each at most ``most`` long."""
    out: list[tuple[int, int, int]] = []
    blank, indent = False, 0
    for s, e, full in lines:
        body = text[s:e]
        if not body.strip(" \t"):
            blank = True
            if out and full - out[-1][0] <= most:
                out[-1] = (out[-1][0], full, out[-1][2])
                continue
        step = len(body) - len(body.lstrip(" \t"))
        level = BLANK if blank else DEDENT if step < indent else LINE
        if body.strip(" \t"):
            blank, indent = False, step
        if full - s <= most:
            out.append((s, full, level))
            continue
        at = s
        for part_level, cut in _parts(text, s, full, most):
            out.append((at, cut, level if at == s else part_level))
            at = cut
    return out


def _parts(text: str, s: int, e: int, most: int) -> Iterator[tuple[int, int]]:
    """(strength of the boundary before the part, end of the part) inside a line that is too long."""
    level = INLINE
    at = s
    ends = [m.end() for m in _SENTENCE.finditer(text, s, e) if m.end() < e] + [e]
    for end in ends:
        if end - at <= most:
            yield level, end
            at, level = end, SENTENCE
            continue
        spaces = [m.end() for m in _SPACE.finditer(text, at, end) if m.end() < end] + [end]
        for stop in spaces:
            while stop - at > most:
                at += most
                yield level, at
                level = INLINE
            if stop > at:
                yield level, stop
                at, level = stop, WORD
        level = SENTENCE


def merge(segments: list[tuple[int, int, int]], limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """Weakest boundaries first; a piece that is not the first also carries the overlap."""
    n = len(segments)
    start = [s for s, _, _ in segments]
    end = [e for _, e, _ in segments]
    level = [x for _, _, x in segments]
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    alive = [True] * n
    heap = [(level[i], end[i] - start[i - 1], i - 1, i) for i in range(1, n)]
    heapq.heapify(heap)
    while heap:
        _, size, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b]) or after[a] != b or end[b] - start[a] != size:
            continue
        if size + (overlap if start[a] else 0) > limit:
            continue
        end[a] = end[b]
        alive[b] = False
        after[a] = after[b]
        if after[b] >= 0:
            before[after[b]] = a
            c = after[b]
            heapq.heappush(heap, (level[c], end[c] - start[a], a, c))
        if before[a] >= 0:
            p = before[a]
            heapq.heappush(heap, (level[a], end[a] - start[p], p, a))
    return [(start[i], end[i], level[i]) for i in range(n) if alive[i]]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, int, str]], str, list[int]]:
    """Pieces as (start with overlap, start, end, boundary at the end), the boundary class, line starts."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and below the limit")
    lines = lines_of(text)
    kind = boundary_class(text, lines, limit)
    if len(text) <= limit:
        return [(0, 0, len(text), "end")], kind, [s for s, _, _ in lines]
    own = merge(atoms(text, lines, limit - overlap), limit, overlap)
    out = []
    for i, (s, e, _) in enumerate(own):
        out.append((max(0, s - overlap), s, e, "end" if i + 1 == len(own) else NAMES[own[i + 1][2]]))
    return out, kind, [s for s, _, _ in lines]


def split_oversized(
    df: DataFrame,
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    id_col: str = "id",
    text_col: str = "text",
    path_col: str = "source_path",
    line_col: str = "start_line",
    keep_short: bool = True,
) -> DataFrame:
    """One row for each piece of each text.

    Columns: id, piece (from 0), text (the overlap first), overlap_chars, source_path, start_line and
    end_line of the lines the piece touches, overlap included (null where the row's first line is unknown), cut (blank, line,
    sentence, word, inline: the boundary at the piece's end; end for the last), boundary (blank, line or
    inline: the finest boundary the row needs, the overlap left aside; blank also for a short row).

    Every piece has at most ``limit`` code points, overlap included, and the pieces without their overlaps
    add up to the text. Rows of at most ``limit`` come out as one piece, or not at all without
    ``keep_short``. Null texts give no piece, empty texts one empty piece. Repeated rows are cut again.
    Other columns are ignored, so their names cannot clash. Filters on length run in the JVM.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(path_col).alias("source_path"), F.col(line_col).cast("int").alias("start_line")).where("text is not null")
    long = F.length("text") > limit
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("text", pa.string()), ("overlap_chars", pa.int32()), ("source_path", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("cut", pa.string()), ("boundary", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            size = 0
            for id_, text, path, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                pieces, kind, starts = split_text(text, limit, overlap)
                for k, (a, s, e, how) in enumerate(pieces):
                    lo = hi = None
                    if first is not None:
                        lo = first + max(0, bisect_right(starts, a) - 1)
                        hi = first + max(0, bisect_right(starts, max(a, e - 1)) - 1)
                    out.append((id_, k, text[a:e], s - a, path, lo, hi, how, kind))
                    size += e - a
                if size > 8_000_000:
                    yield _batch(out, schema)
                    out, size = [], 0
            yield _batch(out, schema)

    pieces = rows.where(long).mapInArrow(cut, SCHEMA)
    if not keep_short:
        return pieces
    breaks = F.length("text") - F.length(F.translate("text", "\r\n", "")) - F.regexp_count("text", F.lit("\r\n"))
    last = F.when(F.col("text").rlike("[\r\n]$"), breaks - 1).otherwise(breaks)
    short = rows.where(~long).select(
        "id", F.lit(0).alias("piece"), "text", F.lit(0).alias("overlap_chars"), "source_path", "start_line", (F.col("start_line") + F.greatest(last, F.lit(0))).cast("int").alias("end_line"), F.lit("end").alias("cut"), F.lit("blank").alias("boundary")
    )
    return pieces.unionByName(short)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
