"""Nested JSON to linked rows by a structural index, a batch of texts at a time.

The bytes of many texts lie in one buffer. Bitmaps of quotes and backslashes give the strings, an exclusive-or
prefix scan of the quote bitmap masks their insides, brackets outside strings are counted by a prefix sum into
nesting depths, and a stable sort by depth links every token to the bracket that encloses it. Everything is done
with whole-array operations; only the tokens a caller asks for are decoded.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

QUOTE, BACKSLASH, COMMA, COLON = 34, 92, 44, 58
OPEN_OBJ, CLOSE_OBJ, OPEN_ARR, CLOSE_ARR = 123, 125, 91, 93

_STRUCT = np.zeros(256, bool)
_STRUCT[[COMMA, COLON, OPEN_OBJ, CLOSE_OBJ, OPEN_ARR, CLOSE_ARR]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 13]] = True
_ESCAPABLE = np.zeros(256, bool)
_ESCAPABLE[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_SCALAR = re.compile(rb"(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)")


class Index:
    """Tokens of the valid texts of a buffer: start, end (past the token's last byte), kind, rec, parent, key, ordinal.

    `kind` is the token's first byte ('"' for strings, 's' for other scalars); `parent` is the token index of the
    enclosing bracket (-1 at the top), `key` that of the member's name (-1 outside objects), `ordinal` the position in
    an array (-1 outside arrays), `is_value` tells values from names and punctuation. For brackets, `end` is past the
    matching one. `valid` says of each text whether it is one JSON value and nothing else.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        n = len(offsets) - 1
        rec_start = offsets[:-1]
        self.valid = np.diff(offsets) > 0
        empty = np.zeros(0, np.int64)
        self.start = self.end = self.rec = self.parent = self.key = self.ordinal = empty
        self.kind, self.is_value, self.depth = np.zeros(0, np.uint8), np.zeros(0, bool), empty
        if not len(data) or n == 0:
            return

        def record_of(pos):
            return np.searchsorted(offsets, pos, side="right") - 1

        # Escapes: the parity of the run of backslashes before a byte, runs broken at the starts of texts.
        bs = np.flatnonzero(data == BACKSLASH)
        is_quote = data == QUOTE
        escape_at = empty
        if len(bs):
            first = np.ones(len(bs), bool)
            first[1:] = (bs[1:] != bs[:-1] + 1) | np.isin(bs[1:], rec_start, kind="sort")
            run = np.maximum.accumulate(np.where(first, np.arange(len(bs)), 0))
            active = ((np.arange(len(bs)) - run) & 1) == 0
            escape_at = bs[active]
            after = escape_at + 1
            inside_text = after < offsets[record_of(escape_at) + 1]
            self.valid[record_of(escape_at[~inside_text])] = False
            escape_at, after = escape_at[inside_text], after[inside_text]
            is_quote[after] = False
            bad = ~_ESCAPABLE[data[after]]
            self.valid[record_of(after[bad])] = False
            hexed = after[data[after] == 117]
            for k in range(1, 5):
                at = np.minimum(hexed + k, len(data) - 1)
                self.valid[record_of(hexed[~_HEX[data[at]]])] = False
        # Inside of strings: prefix exclusive-or, toggled back after a text with an odd number of quotes.
        quotes = np.flatnonzero(is_quote)
        count = np.bincount(record_of(quotes), minlength=n)
        odd = np.flatnonzero(count & 1)
        self.valid[odd] = False
        toggles = is_quote.view(np.uint8).copy()
        flips = offsets[odd + 1]
        np.bitwise_xor.at(toggles, flips[flips < len(data)], 1)
        inside = np.bitwise_xor.accumulate(toggles).view(bool)
        control = np.flatnonzero((data < 32) & inside)
        self.valid[record_of(control)] = False
        struct = _STRUCT[data] & ~inside
        plain = ~(struct | inside | is_quote | _SPACE[data])
        begin = plain.copy()
        begin[1:] &= ~plain[:-1]
        begin[rec_start[rec_start < len(data)]] |= plain[rec_start[rec_start < len(data)]]
        opening = is_quote & inside
        tok = np.flatnonzero(struct | begin | opening)
        rec = record_of(tok)
        keep = self.valid[rec]
        tok, rec = tok[keep], rec[keep]
        has = np.zeros(n, bool)
        has[rec] = True
        self.valid &= has
        # Depths; texts whose brackets don't balance leave.
        for _ in range(2):
            kind = data[tok].copy()
            kind[begin[tok] & ~struct[tok] & ~opening[tok]] = 115
            opens = (kind == OPEN_OBJ) | (kind == OPEN_ARR)
            closes = (kind == CLOSE_OBJ) | (kind == CLOSE_ARR)
            depth = np.cumsum(opens.astype(np.int64) - closes)
            if not len(tok):
                return
            head = np.ones(len(tok), bool)
            head[1:] = rec[1:] != rec[:-1]
            at = np.flatnonzero(head)
            base = np.where(at > 0, depth[at - 1], 0)
            depth -= np.repeat(base, np.diff(np.append(at, len(tok))))
            last = np.append(at[1:], len(tok)) - 1
            wrong = (depth[last] != 0) | (np.minimum.reduceat(depth, at) < 0)
            if not wrong.any():
                break
            self.valid[rec[at[wrong]]] = False
            keep = self.valid[rec]
            tok, rec = tok[keep], rec[keep]
        m = len(tok)
        level = depth + closes
        order = np.argsort(level, kind="stable")
        opener = np.maximum.accumulate(np.where(opens[order], np.arange(m), -1))
        parent = np.full(m, -1, np.int64)
        found = (opener >= 0) & (level[order] > 0)
        parent[order[found]] = order[opener[found]]
        commas = np.cumsum(kind[order] == COMMA)
        rank = np.zeros(m, np.int64)
        rank[order] = commas - np.where(found, commas[np.maximum(opener, 0)], commas)
        prev = np.arange(m) - 1
        prev_kind = np.where(head, 0, kind[prev])
        outer = np.where(opens[prev] & ~head, prev, parent[prev])
        outer[head] = -1
        matching = np.where(closes, parent, -1)
        parent = np.where(opens, outer, parent)
        in_obj = np.zeros(m, bool)
        has_parent = parent >= 0
        in_obj[has_parent] = kind[parent[has_parent]] == OPEN_OBJ
        is_string = kind == QUOTE
        is_key = is_string & in_obj & ((prev_kind == OPEN_OBJ) | (prev_kind == COMMA))
        is_value = (is_string & ~is_key) | (kind == 115) | opens
        prev_key = np.zeros(m, bool)
        prev_key[1:] = is_key[:-1]
        prev_done = np.zeros(m, bool)
        prev_done[1:] = ((is_string & ~is_key) | (kind == 115) | closes)[:-1]
        prev_done &= ~head
        may = np.where(has_parent, np.where(in_obj, prev_kind == COLON, (prev_kind == OPEN_ARR) | (prev_kind == COMMA)), head)
        ok = np.ones(m, bool)
        ok &= ~is_value | may
        ok &= (kind != COLON) | (prev_key & in_obj)
        ok &= (kind != COMMA) | (prev_done & has_parent)
        mate = kind[np.maximum(matching, 0)]
        ok &= (kind != CLOSE_OBJ) | ((mate == OPEN_OBJ) & (prev_done | (prev_kind == OPEN_OBJ)))
        ok &= (kind != CLOSE_ARR) | ((mate == OPEN_ARR) & (prev_done | (prev_kind == OPEN_ARR)))
        end = tok + 1
        closing = np.flatnonzero(is_quote & ~inside)
        strings = np.flatnonzero(is_string)
        if len(strings):
            end[strings] = closing[np.searchsorted(closing, tok[strings])] + 1
        scalars = np.flatnonzero(kind == 115)
        if len(scalars):
            stop = plain.copy()
            stop[:-1] &= ~plain[1:]
            ends_at = rec_start[(rec_start > 0) & (rec_start <= len(data))] - 1
            stop[ends_at] |= plain[ends_at]
            stops = np.flatnonzero(stop)
            end[scalars] = stops[np.searchsorted(stops, tok[scalars])] + 1
            raw = data.tobytes() if len(scalars) else b""
            seen: dict[bytes, bool] = {}
            for i, a, b in zip(scalars.tolist(), tok[scalars].tolist(), end[scalars].tolist()):
                text = raw[a:b]
                good = seen.get(text)
                if good is None:
                    good = seen[text] = _SCALAR.fullmatch(text) is not None
                if not good:
                    ok[i] = False
        shut = np.flatnonzero(closes)
        end[matching[shut]] = tok[shut] + 1
        self.valid[rec[~ok]] = False
        keep = self.valid[rec]
        # The tokens of texts found invalid only here stay, marked by `valid`; callers ask for values of valid texts.
        self.start, self.end, self.kind, self.rec, self.parent, self.depth = tok, end, kind, rec, parent, depth
        self.is_value = is_value & keep
        self.key = np.where(is_value & in_obj, np.arange(m) - 2, -1)
        first_in = (prev_kind == OPEN_ARR).astype(np.int64)
        self.ordinal = np.where(is_value & has_parent & ~in_obj, np.where(first_in, 0, rank[prev]), -1)

    def keyed(self, name: str) -> np.ndarray:
        """Whether each token is the value of a member called `name`; names written with escapes are decoded."""
        want = np.frombuffer(name.encode(), np.uint8)
        out = np.zeros(len(self.start), bool)
        at = np.flatnonzero(self.is_value & (self.key >= 0))
        k = self.key[at]
        width = self.end[k] - self.start[k] - 2
        same = np.flatnonzero(width == len(want))
        if len(want):
            for j in range(len(want)):
                same = same[self.data[self.start[k[same]] + 1 + j] == want[j]]
        out[at[same]] = True
        long = np.flatnonzero(width > len(want))
        if len(long):
            slash = np.cumsum(self.data == BACKSLASH)
            a, b = self.start[k[long]], self.end[k[long]] - 1
            for i in long[slash[b] != slash[a]].tolist():
                out[at[i]] = self.text(int(k[i])) == name
        return out

    def raw(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def text(self, i: int) -> str:
        """A string token decoded."""
        body = self.data[self.start[i] + 1 : self.end[i] - 1].tobytes()
        if b"\\" not in body:
            return body.decode("utf-8", "replace")
        return _clean(json.loads(b'"' + body + b'"'))

    def value(self, i: int):
        """A scalar as text (strings decoded), None for null, brackets as their JSON text."""
        if self.kind[i] == QUOTE:
            return self.text(i)
        raw = self.raw(i).decode("utf-8", "replace")
        return None if raw == "null" else raw

    def members(self, name: str, of: np.ndarray | None = None) -> np.ndarray:
        """For each text, the token of the value called `name` in its top object (or in the object `of[rec]`), the last of
        repeated ones, else -1."""
        out = np.full(len(self.valid), -1, np.int64)
        at = np.flatnonzero(self.keyed(name))
        if of is None:
            at = at[self.parent[self.parent[at]] == -1]
        else:
            at = at[self.parent[at] == of[self.rec[at]]]
        out[self.rec[at]] = at
        return out

    def effective(self, at: np.ndarray) -> np.ndarray:
        """`at` without members that a later one of the same name in the same object replaces (same-named tokens only)."""
        if len(at) < 2:
            return at
        _, last = np.unique(self.parent[at][::-1], return_index=True)
        return np.sort(at[::-1][last])


def _clean(text: str) -> str:
    """Lone surrogates can't be written as UTF-8; they come out as question marks."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode()


def slices(column: pa.Array, limit: int = 4 << 20):
    """(first row, bytes, offsets) of runs of rows of at most `limit` bytes (or one longer row); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def index_texts(texts: list[str]) -> Index:
    blobs = [t.encode("utf-8", "replace") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blobs])]).astype(np.int64)
    return Index(np.frombuffer(b"".join(blobs), np.uint8), offsets)
