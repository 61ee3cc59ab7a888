"""Passages of held-out items inside a corpus, by q-gram counting in diagonal bands and banded alignment.

Texts are reduced to their words (runs of letters or digits, decomposed, case-folded, without accents and invisible
characters), one blank between two. A passage of at least `length` characters with at most `edits` edits shares
at least length + 1 - q * (edits + 1) q-grams with its item (the q-gram lemma), all within a band of diagonals. Counting comes in
three steps of growing cost: stretches of a document with that many q-grams of any item, then (item, band) pairs with
that many, then a banded local alignment of what is left.

Short words leave passages of fewer characters, for which the lemma asks of shorter q-grams: such items are indexed apart, and
each item's own shortest passage is its bound, so that no item changes what another one finds.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS, EDITS, Q = 12, 2, 12
#: Bytes of item text indexed at a time; more items are searched in blocks of this size, each in a pass of its own. An index
#: takes about 25 bytes a byte of text, and three times as much while it is built, once in a Python process.
BLOCK_BYTES = 8 << 20
#: Characters reduced and searched together; more make the alignments wider and take more memory (about 60 bytes each).
SLICE = 3 << 20
_LAST_LETTER = 0x32400
_GAP, _DROP, _MANY = 0, 255, 254
_PENALTY = 2
LEAST_Q = 4


def _folded(ch: str) -> str:
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", ch).casefold())
    return "".join(c for c in text if unicodedata.category(c)[0] != "M" and unicodedata.category(c) != "Cf")


def words(text: str) -> list[str]:
    """The words of a text, the slow and plain way."""
    return re.findall(r"[^\W_]+", "".join(_folded(c) for c in text) if not text.isascii() else text.lower())


def _code(ch: str) -> int:
    """One byte for a character: a blank where it is no letter or digit; rare letters share codes."""
    if not ch.isalnum():
        return _GAP
    o = ord(ch)
    return o if o < 128 else 128 + o % 120


class _Folding:
    """Tables from code points to bytes of reduced text, built once in a process."""

    one: np.ndarray | None = None
    many: dict[int, bytes] = {}

    @classmethod
    def table(cls) -> np.ndarray:
        if cls.one is None:
            one = np.zeros(sys.maxunicode + 1, np.uint8)
            for c in range(_LAST_LETTER):
                if 0xD800 <= c < 0xE000:
                    continue
                ch = chr(c)
                text = ch.lower() if c < 128 else _folded(ch)
                if len(text) == 1:
                    one[c] = _code(text)
                elif not text:
                    one[c] = _DROP
                else:
                    one[c] = _MANY
                    cls.many[c] = bytes(_code(x) for x in text)
            for c in range(0xE0000, 0xE0200):
                one[c] = _DROP
            cls.one = one
        return cls.one


def reduce_texts(texts: list[str], margin: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): the reduced texts laid end to end, each led by `margin` bytes 253 that no q-gram holds."""
    table = _Folding.table()
    if all(t.isascii() for t in texts):
        points = np.frombuffer("".join(texts).encode("ascii"), np.uint8)
    else:
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = table[points]
    owner_end = np.cumsum(np.fromiter((len(t) for t in texts), np.int64, len(texts)))
    wide = np.flatnonzero(code == _MANY)
    if len(wide):
        bits = [_Folding.many[c] for c in points[wide].tolist()]
        counts = np.ones(len(code), np.int64)
        counts[wide] = [len(b) for b in bits]
        first = np.cumsum(counts) - counts
        grown = np.repeat(code, counts)
        for at, b in zip(first[wide].tolist(), bits):
            grown[at : at + len(b)] = list(b)
        owner_end = np.concatenate([first, [len(grown)]])[owner_end]
        code = grown
    if (code == _DROP).any():
        kept = code != _DROP
        owner_end = np.concatenate([[0], np.cumsum(kept)])[owner_end]
        code = code[kept]
    # One blank between words, none at the ends: a blank stays only after a word of the same text.
    gap = code == _GAP
    begin = np.concatenate([[0], owner_end[:-1]])
    extra = gap.copy()
    extra[1:] &= gap[:-1]
    heads = begin[begin < len(code)]
    extra[heads] = gap[heads]
    kept = ~extra
    at = np.concatenate([[0], np.cumsum(kept)])
    begin, owner_end = at[begin], at[owner_end]
    code = code[kept]
    code[code == _GAP] = 32
    out = np.full(len(code) + margin * (len(texts) + 1), 253, np.uint8)
    shift = np.repeat(np.arange(1, len(texts) + 1) * margin, owner_end - begin)
    out[np.arange(len(code)) + shift] = code
    return out, begin + np.arange(1, len(texts) + 1) * margin


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit mark of the q bytes at each position (4 <= q <= 16): exact to q = 8, a mix of two words beyond."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    word = np.empty(len(data) + 8, np.uint64)
    for s in range(8):
        part = padded[s : s + (len(padded) - s) // 8 * 8].view(np.uint64)
        room = len(word[s::8])
        word[s::8] = part[:room] if len(part) >= room else np.pad(part, (0, room - len(part)))
    if q <= 8:
        return word[:n] & np.uint64((1 << (8 * q)) - 1)
    second = word[q - 8 : q - 8 + n]
    return (word[:n] * np.uint64(0x9E3779B97F4A7C15)) ^ (second * np.uint64(0xC2B2AE3D27D4EB4F) + (second >> np.uint64(29)))


def window_marks(w: list[str], n_words: int) -> np.ndarray:
    """A 64-bit mark of each stretch of `n_words` words."""
    return np.array([xxhash.xxh3_64_intdigest(" ".join(w[k : k + n_words])) for k in range(len(w) - n_words + 1)], np.uint64)


def shortest_passage(w: list[str], n_words: int) -> int:
    """Characters of the shortest stretch of `n_words` words, nothing where there are fewer words."""
    if len(w) < n_words:
        return 0
    ends = np.cumsum([len(x) for x in w])
    return int((ends[n_words - 1 :] - np.concatenate([[0], ends[:-n_words]])).min()) + n_words - 1


class ItemIndex:
    """The q-grams of items whose passages are long enough for q, and what the lemma asks of a stretch."""

    BITS = 22

    def __init__(self, ids: list[int], texts: list[str], lengths: list[int], n_words: int, edits: int, q: int):
        self.ids, self.texts, self.n_words = ids, texts, n_words
        self.lengths = np.array(lengths, np.int64)
        self.length = min(lengths)
        self.edits, self.q = edits, q
        self.least = self.length + 1 - q * (edits + 1)
        if self.least < 1:
            raise ValueError(f"passages of {self.length} characters with {edits} edits leave no {q}-gram")
        self.band = self.edits + 1
        self.margin = (edits + 1) * (q + 1) + 4 * self.band
        self.data, self.starts = reduce_texts(texts, self.margin)
        marks = grams(self.data, self.q)
        clean = np.concatenate([[0], np.cumsum(self.data == 253, dtype=np.int32)])
        at = np.flatnonzero(clean[self.q :][: len(marks)] == clean[: len(marks)]).astype(np.int32)
        del clean
        marks = marks[at]
        order = np.argsort(marks, kind="stable").astype(np.int32)
        self.at, marks = at[order], marks[order]
        self.unique, first, count = np.unique(marks, return_index=True, return_counts=True)
        self.first, self.count = first.astype(np.int32), count.astype(np.int32)
        self.bitmap = np.zeros(1 << self.BITS, bool)
        self.bitmap[self._slot(self.unique)] = True
        # The words of each item are kept as marks of its stretches, in sorted runs.
        windows = [np.sort(window_marks(words(t), n_words)) for t in texts]
        self.window_at = np.cumsum([0, *(len(x) for x in windows)])
        self.windows = np.concatenate(windows)
        self._last: tuple[str, list[str], np.ndarray] | None = None

    def _slot(self, marks: np.ndarray) -> np.ndarray:
        return ((marks * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def search(self, texts: list[str]) -> list[tuple[int, int, int]]:
        """(text number, item number, alignment score) of every verified passage, the best one of each pair."""
        if not texts:
            return []
        data, starts = reduce_texts(texts, self.margin)
        marks = grams(data, self.q)
        hit = self.bitmap[self._slot(marks)]
        at = np.flatnonzero(hit)
        if not len(at):
            return []
        which = np.minimum(np.searchsorted(self.unique, marks[at]), len(self.unique) - 1)
        real = self.unique[which] == marks[at]
        at, which = at[real], which[real]
        # Stretches of `length` characters with enough q-grams of any item.
        reach = self.length + self.edits - self.q
        enough = np.zeros(len(at), bool)
        if len(at) >= self.least:
            far = at[self.least - 1 :] - at[: len(at) - self.least + 1] <= reach
            edge = np.zeros(len(at) + 1, np.int64)
            good = np.flatnonzero(far)
            np.add.at(edge, good, 1)
            np.add.at(edge, good + self.least, -1)
            enough = np.cumsum(edge[:-1]) > 0
        at, which = at[enough], which[enough]
        found: dict[tuple[int, int], int] = {}
        # Postings are opened a bounded number at a time, cut between texts where possible.
        opened = np.cumsum(self.count[which])
        low = 0
        owner = np.searchsorted(starts, at, side="right") - 1
        while low < len(at):
            high = int(np.searchsorted(opened, (opened[low - 1] if low else 0) + 2_000_000, side="right"))
            high = max(high, low + 1)
            if high < len(at):
                high = int(np.searchsorted(owner, owner[high - 1], side="right"))
            for text, item, score in self._bands(data, starts, at[low:high], which[low:high]):
                if score > found.get((text, item), 0):
                    found[text, item] = score
            low = high
        return [(t, i, s) for (t, i), s in sorted(found.items())]

    def _bands(self, data, starts, at, which):
        count = self.count[which]
        total = int(count.sum())
        if not total:
            return
        begin = np.repeat(np.cumsum(count) - count, count)
        item_at = self.at[np.repeat(self.first[which], count) + np.arange(total) - begin]
        text_at = np.repeat(at, count)
        text = np.searchsorted(starts, text_at, side="right") - 1
        item = np.searchsorted(self.starts, item_at, side="right") - 1
        # Each diagonal lies in two bands of twice the width, so that no passage is cut by a border. A first count by a
        # hash of text, item and half band leaves out what can't reach the bound; equal hashes only let more through.
        half = (text_at - item_at + len(self.data)) // self.band
        pair = (text * len(self.starts) + item).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

        def slot(h):
            return ((pair + h.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.BITS)).astype(np.int64)

        here = slot(half)
        tally = np.bincount(here, minlength=1 << self.BITS)
        own = tally[here]
        kept = np.flatnonzero(own + np.maximum(tally[slot(half - 1)], tally[slot(half + 1)]) >= self.least)
        if not len(kept):
            return
        text, item, text_at, half = text[kept], item[kept], text_at[kept], half[kept]
        row = np.concatenate([np.arange(len(kept))] * 2)
        band = np.concatenate([half, half - 1])
        upper = np.concatenate([np.zeros(len(kept), bool), np.ones(len(kept), bool)])
        order = np.lexsort((text_at[row], band, item[row], text[row]))
        row, band, upper = row[order], band[order], upper[order]
        t, i, x = text[row], item[row], text_at[row]
        new = np.ones(len(row), bool)
        new[1:] = (t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (band[1:] != band[:-1]) | (x[1:] - x[:-1] > self.length)
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(row)))
        # Hits that all lie in the lower half of a band are all in the upper half of the band below, which is looked at.
        good = (size >= self.least) & np.logical_or.reduceat(upper, head)
        head, size = head[good], size[good]
        last = head + size - 1
        by_length = np.argsort(x[last] - x[head], kind="stable")
        head, last = head[by_length], last[by_length]
        for k in range(0, len(head), 512):
            h, z = head[k : k + 512], last[k : k + 512]
            # Edits near an end leave up to q - 1 characters each without a q-gram beyond the outermost hits.
            reach = self.edits * (self.q + 1)
            low, high = x[h] - reach, x[z] + self.q + reach
            # The band holds diagonals shift to shift + 2 * band - 1; edits beyond the hits may lead above it.
            shift = band[h] * self.band - len(self.data)
            scores = align(data, self.data, low, high, shift, 2 * self.band + self.edits)
            passed = scores >= self.lengths[i[h]] - self.edits * (1 + _PENALTY)
            yield from zip(t[h][passed].tolist(), i[h][passed].tolist(), scores[passed].tolist())

    def exact(self, text: str, item: int) -> bool:
        """Whether the text holds `n_words` consecutive words of the item: equal marks, then the words themselves."""
        if self._last is None or self._last[0] is not text:
            w = words(text)
            self._last = text, w, window_marks(w, self.n_words)
        _, w, marks = self._last
        mine, n = self.windows[self.window_at[item] : self.window_at[item + 1]], self.n_words
        if not len(mine) or not len(marks):
            return False
        hit = np.flatnonzero(mine[np.minimum(np.searchsorted(mine, marks), len(mine) - 1)] == marks)
        if not len(hit):
            return False
        whole = f" {' '.join(words(self.texts[item]))} "
        return any(f" {' '.join(w[k : k + n])} " in whole for k in hit.tolist())


def build_indexes(ids: list[int], texts: list[str], n_words: int = WORDS, edits: int = EDITS, q: int = Q) -> list[ItemIndex]:
    """The items by the longest q up to `q` that their shortest passages allow, halved until it does."""
    groups: dict[int, list[int]] = {}
    lengths = [shortest_passage(words(t), n_words) for t in texts]
    for k, length in enumerate(lengths):
        if length:
            fit = q
            while fit > LEAST_Q and length + 1 - fit * (edits + 1) < 1:
                fit = max(LEAST_Q, fit * 7 // 12)
            groups.setdefault(fit, []).append(k)
    return [ItemIndex([ids[k] for k in g], [texts[k] for k in g], [lengths[k] for k in g], n_words, edits, fit) for fit, g in sorted(groups.items())]


_BUILT: dict[str, list[ItemIndex]] = {}


def _indexes(name: str, packed, *settings) -> list[ItemIndex]:
    """The indexes of a block, built once in a process; those of the block before are given up."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = build_indexes(*packed.value, *settings)
    return _BUILT[name]


def align(text: np.ndarray, item: np.ndarray, low, high, shift, width: int) -> np.ndarray:
    """Best local alignment score (match 1, edit -2) of text[low:high] with the item inside a band of diagonals.

    Text position p meets item positions p - shift - width + 1 to p - shift, for many stretches at once.
    """
    n = len(low)
    score = np.zeros((n, width + 2), np.int32)  # one cell on each side that stays at nothing
    best = np.zeros(n, np.int32)
    steps = int((high - low).max()) if n else 0
    cells = np.arange(width)
    for s in range(steps):
        p = np.minimum(low + s, high - 1)
        live = low + s < high
        # Cell c is diagonal shift + c; the item position is p - shift - c.
        j = (p - shift)[:, None] - cells[None, :]
        same = (item[np.clip(j, 0, len(item) - 1)] == text[p][:, None]) & (j >= 0) & (j < len(item)) & (text[p] != 253)[:, None]
        fresh = np.zeros_like(score)
        step = score[:, 1:-1] + np.where(same, 1, -_PENALTY)
        skip_text = score[:, :-2] - _PENALTY  # diagonal c - 1 one text position before: a text character left over
        fresh[:, 1:-1] = np.maximum(0, np.maximum(step, skip_text))
        for c in range(width - 1, 0, -1):  # an item character left over comes from diagonal c + 1 at the same position
            fresh[:, c] = np.maximum(fresh[:, c], fresh[:, c + 1] - _PENALTY)
        score = np.where(live[:, None], fresh, score)
        best = np.maximum(best, score.max(axis=1))
    return best


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list]:
    """The items in blocks of bounded size, each read by a query of its own; null texts are left out."""
    held = items.where(F.col("text").isNotNull())
    total = held.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // block_bytes)
    for k in range(parts):
        yield held.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).select("item_id", "text").orderBy("item_id").collect()


def leaks(documents: DataFrame, items: DataFrame, n_words: int = WORDS, edits: int = EDITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, exact): documents(doc_id, text) that hold passages of items(item_id, text).

    A passage is `n_words` consecutive words of an item with at most `edits` character edits; `score` is the length of
    the best alignment less its penalties, `exact` says whether the words themselves occur. Repeated documents and items
    give rows of their own; null and blank texts and items of fewer words give none. Documents are read once a block
    of items, whole, without a shuffle.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, item_id bigint, score bigint, exact boolean"
    out = None
    for block in item_blocks(items, block_bytes):
        packed = spark.sparkContext.broadcast(([r["item_id"] for r in block], [r["text"] for r in block]))
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], packed=packed, name=name) -> Iterator[pa.RecordBatch]:
            indexes = _indexes(name, packed, n_words, edits)
            for batch in batches:
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                rows = []
                plain = [i for i, t in enumerate(texts) if t and t.isascii()]
                other = [i for i, t in enumerate(texts) if t and not t.isascii()]
                for group in (plain, other):
                    at = 0
                    while at < len(group):
                        end, size = at, 0
                        while end < len(group) and (end == at or size < SLICE):
                            size += len(texts[group[end]])
                            end += 1
                        part = group[at:end]
                        for index in indexes:
                            for t, i, score in index.search([texts[k] for k in part]):
                                rows.append((ids[part[t]], index.ids[i], score, index.exact(texts[part[t]], i)))
                        at = end
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "exact"]).astype({"doc_id": "int64", "item_id": "int64", "score": "int64", "exact": "bool"}), preserve_index=False)

        found = documents.select("doc_id", "text").where(F.col("text").isNotNull()).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out
