"""Cutting oversized items into overlapping pieces at natural boundaries.

A recursive hierarchy (section, paragraph, line, sentence, word, character)
yields units that fit into ``limit - overlap``; pieces are packed greedily from
them and each starts exactly ``overlap`` characters before its predecessor's
end, wherever that is: the overlap is of stated length, the cuts are natural.
Pieces are substrings: the first, plus every later one without its first
``overlap`` characters, give the content back. The level an item is cut at is
told by the units of the same hierarchy: the first kind, from paragraphs down, of
which none exceeds the limit.

Defined cases: contents of at most ``limit`` characters, null or empty ones give
no piece unless ``keep_short``; rows without id are left out, repeated ids are items of their own; whitespace longer than the limit is cut like any
other text; very long contents cost linear time.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.sentences import sentence_spans

SECTION = re.compile(r"\r?\n(?:[ \t]*\r?\n){2,}|\n(?=#{1,6} )")
PARAGRAPH = re.compile(r"\r?\n(?:[ \t]*\r?\n)+")
LINE = re.compile(r"\r?\n")
WORD = re.compile(r"\S+")
BLANK_HEAD = re.compile(r"(?:[ \t]*\r?\n)+")
BLANK_TAIL = re.compile(r"(?:\r?\n[ \t]*)+\Z")
LEVELS = ("section", "paragraph", "line", "sentence", "word")


class Units:
    """The units of a text, kind by kind, each found once and only when a larger kind doesn't fit."""

    def __init__(self, text: str):
        self.text, self._spans, self._starts = text, {}, {}

    def spans(self, level: str) -> list[tuple[int, int]]:
        """(start, end) of the units of the whole text, without the blanks and line ends between them."""
        if level not in self._spans:
            t = self.text
            if level == "word":
                got = [m.span() for m in WORD.finditer(t)]
            elif level == "sentence":
                got = sentence_spans(t)
            else:
                lead, trail = (BLANK_HEAD.match(t), BLANK_TAIL.search(t)) if level != "line" else (None, None)
                lo = lead.end() if lead else 0
                hi = max(lo, trail.start()) if trail else len(t)
                cuts = [m.span() for m in {"section": SECTION, "paragraph": PARAGRAPH, "line": LINE}[level].finditer(t, lo, hi)]
                got = list(zip([lo, *(b for _, b in cuts)], [*(a for a, _ in cuts), hi]))
            self._spans[level] = got
        return self._spans[level]

    def starts(self, level: str, lo: int, hi: int) -> list[int]:
        """Where units begin inside of lo..hi."""
        if level not in self._starts:
            self._starts[level] = [a for a, _ in self.spans(level)]
        every = self._starts[level]
        return every[bisect_right(every, lo) : bisect_left(every, hi)]

    def fits(self, level: str, limit: int) -> bool:
        return all(b - a <= limit for a, b in self.spans(level))

    def cut_level(self, limit: int) -> str:
        return next((level for level in LEVELS[1:] if self.fits(level, limit)), "none")

    def ends(self, lo: int, hi: int, budget: int, level: int, out: list[int]) -> None:
        """Append the ends of units of the text's part lo..hi, none longer than the budget."""
        if hi - lo <= budget:
            out.append(hi)
            return
        if level == len(LEVELS):
            out.extend(range(lo + budget, hi, budget))
            out.append(hi)
            return
        at = lo
        for c in (*self.starts(LEVELS[level], lo, hi), hi):
            self.ends(at, c, budget, level + 1, out)
            at = c


def pieces(text: str, limit: int = 2000, overlap: int = 200, units: Units | None = None) -> list[tuple[int, int]]:
    """Offsets (start, end) of the pieces of the text."""
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    ends: list[int] = []
    (units or Units(text)).ends(0, len(text), limit - overlap, 0, ends)
    out, start, last = [], 0, 0
    for end in ends:
        if end - start > limit:
            out.append((start, last))
            start = last - overlap
        last = end
    out.append((start, last))
    return out


def split_items(items: DataFrame, id_col: str, text_col: str, limit: int = 2000, overlap: int = 200, keep_short: bool = False) -> DataFrame:
    """(id, chunk_index, start_char, end_char, piece, cut_level) of every item over the limit; no exchange."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                units = Units(text)
                cuts = pieces(text, limit, overlap, units)
                level = units.cut_level(limit)
                for k, (a, b) in enumerate(cuts):
                    for col, v in zip(cols, (key, k, a, b, text[a:b], level)):
                        col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "chunk_index", "start_char", "end_char", "piece", "cut_level"])

    source = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    source = source.where(F.col("id").isNotNull() & (F.char_length("t") > (0 if keep_short else limit)))
    return source.mapInArrow(split, "id long, chunk_index int, start_char int, end_char int, piece string, cut_level string").withColumnRenamed("id", id_col)
