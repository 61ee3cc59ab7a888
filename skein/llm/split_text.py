"""Oversized texts cut into pieces at natural boundaries, by range-maximum queries over boundary strengths.

Every position of a text has the strength of a cut before it: the end of a paragraph, line, sentence or word, or
none. A sparse table over the strengths answers "where is the strongest cut of this window, rightmost of equals" in
constant time; each piece ends there, and the next one starts `overlap` code points before that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1600, 160
BLANKS = " \t\r\n"
PARAGRAPH, LINE, SENTENCE, WORD, NONE = 4, 3, 2, 1, 0


def strengths(text: np.ndarray) -> np.ndarray:
    """The strength of a cut before each code point of `text` (uint32), for positions 0 to len.

    A cut comes after the white space of a boundary, so that pieces laid end to end give the text back.
    """
    n = len(text)
    out = np.zeros(n + 1, np.int8)
    if not n:
        return out
    newline = text == 10
    blank = newline | (text == 32) | (text == 9) | (text == 13)
    ends = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    out[ends] = WORD
    # The run of white space before each such cut, and how many line feeds it holds.
    starts = np.flatnonzero(blank & ~np.concatenate([[False], blank[:-1]]))
    first = starts[np.searchsorted(starts, ends, side="right") - 1]
    feeds = np.concatenate([[0], np.cumsum(newline)])
    lines = feeds[ends] - feeds[first]
    before = np.where(first > 0, text[first - 1], 0)
    closing = np.isin(before, [ord(c) for c in "\"')]»”’"])
    before = np.where(closing & (first > 1), text[first - 2], before)
    stop = np.isin(before, [ord(c) for c in ".!?…。"])
    out[ends[stop]] = SENTENCE
    out[ends[lines == 1]] = LINE
    out[ends[lines > 1]] = PARAGRAPH
    return out


class SparseTable:
    """Position of the maximum of any window, the rightmost of equal ones, after n log n preparation."""

    def __init__(self, values: np.ndarray, longest: int):
        # One key orders by strength, then position.
        key = values.astype(np.int64) * (len(values) + 1) + np.arange(len(values))
        self.rows, self.n = [key], len(values)
        width = 1
        while 2 * width <= min(longest, len(values)):
            last = self.rows[-1]
            self.rows.append(np.maximum(last[:-width], last[width:]))
            width *= 2

    def best(self, low: int, high: int) -> tuple[int, int]:
        """(strength, position) of the strongest position in [low, high]."""
        k = (high - low + 1).bit_length() - 1
        row = self.rows[k]
        key = int(max(row[low], row[high - (1 << k) + 1]))
        return divmod(key, self.n + 1)


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of `text`: at most `limit` long, together the whole text, each starting `overlap`
    before the end of its predecessor. A text within the limit is one piece, an empty one has none.

    A piece ends at the strongest boundary of the window in which it is more than twice the overlap and at least half
    the limit long; without any boundary there, at the strongest that leaves it more than twice the overlap; without one, at
    the limit.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("the overlap must be under half the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = SparseTable(strengths(points), limit)
    shortest = max(limit // 2, 2 * overlap + 1)
    out, start = [], 0
    while n - start > limit:
        strength, end = table.best(start + min(shortest, limit), start + limit)
        if not strength and 2 * overlap + 1 < shortest:
            strength, end = table.best(start + 2 * overlap + 1, start + shortest - 1)
        end = end if strength else start + limit
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


_SCHEMA = "piece_no bigint, n_pieces bigint, start bigint, piece string"


def split_texts(rows: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The columns of `rows` but `text`, with its pieces: piece_no from 0, n_pieces, start (in code points of the
    trimmed text) and piece. Blank and null texts give nothing; the rest keep at least one row.

    Texts within the limit stay in the engine; only oversized ones go through Python, whole, with no shuffle.
    """
    keys = [c for c in rows.columns if c != text]
    clash = {"piece_no", "n_pieces", "start", "piece"} & set(keys)
    if clash:
        rows = rows.withColumnsRenamed({c: f"source_{c}" for c in clash})
        keys = [f"source_{c}" if c in clash else c for c in keys]
    body = rows.withColumn(text, F.btrim(F.col(text), F.lit(BLANKS))).where(F.length(text) > 0)
    small = body.where(F.length(text) <= limit).select(*keys, F.lit(0).cast("bigint").alias("piece_no"), F.lit(1).cast("bigint").alias("n_pieces"), F.lit(0).cast("bigint").alias("start"), F.col(text).alias("piece"))
    large = body.where(F.length(text) > limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A window of rows at a time: pieces repeat their overlaps, so output is somewhat larger than input.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                take, no, of, starts, pieces = [], [], [], [], []
                for i, value in enumerate(part.column(text).to_pylist()):
                    spans = cuts(value, limit, overlap)
                    for k, (a, b) in enumerate(spans):
                        take.append(i)
                        no.append(k)
                        of.append(len(spans))
                        starts.append(a)
                        pieces.append(value[a:b])
                kept = part.select(keys).take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(no, pa.int64()), pa.array(of, pa.int64()), pa.array(starts, pa.int64()), pa.array(pieces, pa.string())], [*keys, "piece_no", "n_pieces", "start", "piece"])

    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema.fields[: len(keys)])
    return small.unionByName(large.mapInArrow(run, f"{key_schema}, {_SCHEMA}"))
