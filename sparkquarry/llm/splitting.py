"""Cutting oversized texts into overlapping pieces at natural boundaries.

Method: every place between two characters has a boundary strength; a sparse table over
the strengths answers range-maximum queries. A piece is cut at the strongest place of the
permissible window of lengths, the rightmost of equals, and the next piece begins before
the cut by the overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 200
#: Places a sparse table holds at once.
STRETCH = 1 << 16
#: Strengths, strongest first: after a blank line, a line, a sentence, a clause, a word.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD = 5, 4, 3, 2, 1
_BOUNDARIES = (
    (WORD, re.compile(r"\s+")),
    (CLAUSE, re.compile(r"[,;:–—][\"'”’»)\]]*\s+")),
    (SENTENCE, re.compile(r"[.!?…。！？]+[\"'”’»)\]]*\s+|[。！？]+")),
    (LINE, re.compile(r"[^\S\n]*\n\s*")),
    (PARAGRAPH, re.compile(r"[^\S\n]*\n[^\S\n]*\n\s*")),
)


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each character; [0] and the inside of a surrogate-free text is 0."""
    out = np.zeros(len(text) + 1, np.int8)
    for strength, pattern in _BOUNDARIES:
        for m in pattern.finditer(text):
            out[m.end()] = strength
    return out


class RangeMaximum:
    """Sparse table: place of the greatest value in [lo, hi], the rightmost of equals.

    Queries are at most ``widest`` places wide and move on through the values; the table is
    made for one stretch of them at a time and of as many levels as such a query needs, so
    its memory doesn't depend on the number of values.
    """

    def __init__(self, values: np.ndarray, widest: int):
        self.values, self.widest = values, widest
        self._build(0)

    def _build(self, begin: int) -> None:
        part = self.values[begin : begin + max(STRETCH, 2 * self.widest)]
        # value and place in one number, so that a maximum is the rightmost of equals
        level = part.astype(np.int64) * (len(part) + 1) + np.arange(len(part))
        self.begin, self.end, self.n = begin, begin + len(part), len(part) + 1
        self.levels, width = [level], 1
        while 2 * width <= min(len(part), self.widest):
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def place(self, lo: int, hi: int) -> int:
        if lo < self.begin or hi >= self.end:
            self._build(max(0, lo - self.widest))
        k = (hi - lo + 1).bit_length() - 1
        level = self.levels[k]
        return self.begin + int(max(level[lo - self.begin], level[hi - self.begin - (1 << k) + 1]) % self.n)


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(begin, end) of the pieces of ``text``: at most ``limit`` long, each but the first
    beginning between 1 and ``overlap`` characters before the end of the one before."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    table = RangeMaximum(s := strengths(text), limit + 1)
    out, begin = [], 0
    while n - begin > limit:
        # The shortest permissible piece is half the limit, and longer than the overlap so that every cut moves on.
        shortest = max(limit // 2, overlap + 1, 1)
        end = table.place(begin + shortest, begin + limit)
        if not s[end]:  # no boundary in the window: one in a shorter piece is better than none
            near = table.place(begin + overlap + 1, begin + limit)
            end = near if s[near] else begin + limit
        out.append((begin, end))
        begin = end if not overlap else table.place(max(end - overlap, begin + 1), end - 1)
        if overlap and not s[begin]:
            begin = end - overlap
    return [*out, (begin, n)]


def split_texts(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", source_col: str = "source", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, source, piece, start, text): the pieces of every text over ``limit`` characters.

    The text is measured and cut without leading and trailing white space (no-break spaces
    included). Pieces count from 1; ``start`` is the place in the stripped text. Texts
    within the limit, null, empty and blank ones give no row. Rows equal in id, source and
    text count once; a null id or source is kept. Other columns are not read.

    Null-safe and narrow up to the last step: lengths are filtered in the scan, so only
    oversized texts reach Python and the shuffle that removes repeated rows.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and under limit")
    kind, source_kind = (df.schema[c].dataType.simpleString() for c in (id_col, source_col))
    long = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).filter(F.length("text") > limit)
    long = long.dropDuplicates(["id", "source", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.strip() for t in batch.column(2).to_pylist()]
            rows = [(k, p, a, t[a:b]) for k, t in enumerate(texts) if len(t) > limit for p, (a, b) in enumerate(cuts(t, limit, overlap), 1)]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.string())],
                ["id", "source", "piece", "start", "text"],
            )

    pieces = long.mapInArrow(run, f"id {kind}, source {source_kind}, piece int, start long, text string")
    return pieces.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "piece", "start", F.col("text").alias(text_col))
