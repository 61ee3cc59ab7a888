"""Transcript records flattened to linked tables: records, blocks, calls and touched files.

Each row holds the key of its parent: a block its (runtime, rec_id) and, when it lies inside another block, that
block's number and path; a call its record and block; a file its record, block and the path to it. The rows come
out of the structural index without a shuffle: one pass over the texts for each table asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.operators.structural import OPEN_ARR, OPEN_OBJ, QUOTE, Index, index_texts, slices

SCHEMAS = {
    "records": "runtime string, rec_id bigint, kind string, subtype string, role string, session_id string, uuid string, parent_uuid string, cwd string, model string, stamp string, version string, n_blocks bigint",
    "blocks": "runtime string, rec_id bigint, block_no bigint, block_path string, parent_path string, block_type string, text string",
    "calls": "runtime string, rec_id bigint, block_no bigint, call_id string, tool_name string, n_arguments bigint, arguments string",
    "files": "runtime string, rec_id bigint, block_no bigint, json_path string, file_path string",
}
_NESTED_ARGUMENTS = "arguments"


class _Rows:
    """Collects the rows of one table for a run of texts."""

    def __init__(self, table: str):
        self.names = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        self.columns: list[list] = [[] for _ in self.names]

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        types = {"rec_id": pa.int64(), "block_no": pa.int64(), "n_blocks": pa.int64(), "n_arguments": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(self.names, self.columns)], self.names)


class _Record:
    """Where the parts of records lie in an index, by runtime."""

    def __init__(self, ix: Index, codex: np.ndarray):
        self.ix, self.codex = ix, codex
        root = np.full(len(ix.valid), -1, np.int64)
        top = np.flatnonzero(ix.is_value & (ix.parent == -1))
        root[ix.rec[top]] = top
        self.object = (root >= 0) & (ix.kind[np.maximum(root, 0)] == OPEN_OBJ) if len(ix.kind) else np.zeros(len(ix.valid), bool)
        self.root = np.where(self.object, root, -1)
        self.kind = self._string("type")
        message = ix.members("message")
        inside = np.where(codex, self.root, message)
        self.holder = np.where(inside >= 0, inside, -2)
        self.content = ix.members("content", self.holder)

    def _string(self, name: str, of: np.ndarray | None = None) -> list:
        at = self.ix.members(name, of)
        return [self.ix.value(i) if i >= 0 and self.ix.kind[i] != OPEN_OBJ and self.ix.kind[i] != OPEN_ARR else None for i in at.tolist()]

    def blocks(self) -> np.ndarray:
        """Tokens of the elements of `content` arrays, in order."""
        ix = self.ix
        if not len(ix.kind):
            return np.zeros(0, np.int64)
        return np.flatnonzero(ix.is_value & (ix.ordinal >= 0) & (ix.parent == self.content[ix.rec]) & (self.content[ix.rec] >= 0))

    def block_type(self, name: str = "type") -> dict[int, int]:
        """{object token: token of its string member `name`}, the last of repeated ones."""
        at = np.flatnonzero(self.ix.keyed(name))
        return dict(zip(self.ix.parent[at].tolist(), at.tolist()))


def _is_type(ix: Index, types: dict[int, int], block: int, name: str) -> bool:
    at = types.get(block, -1)
    return at >= 0 and ix.kind[at] == QUOTE and ix.text(at) == name


def path_to(ix: Index, at: int, top: int) -> str:
    """The steps from bracket `top` down to token `at`, as .name and [position]."""
    steps = []
    while at != top:
        key = int(ix.key[at])
        steps.append("." + ix.text(key) if key >= 0 else f"[{int(ix.ordinal[at])}]")
        at = int(ix.parent[at])
    return "".join(reversed(steps))


def _top_of(ix: Index, at: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """For each token, the one of `tops` (marked tokens) that encloses it, or -1; all climb one level at a time."""
    marked = np.zeros(len(ix.kind), bool)
    marked[tops] = True
    here, out = at.copy(), np.full(len(at), -1, np.int64)
    active = np.arange(len(at))
    while len(active):
        up = ix.parent[here[active]]
        hit = (up >= 0) & marked[np.maximum(up, 0)]
        out[active[hit]] = up[hit]
        go = (up >= 0) & ~hit
        here[active] = up
        active = active[go]
    return out


def _files(ix: Index, tops: np.ndarray, owner: list[tuple], rows: _Rows, prefix: list[str]) -> None:
    """Rows of the non-empty strings called file_path below the brackets `tops`; `owner` and `prefix` go with tops.

    Strings called `arguments` that hold a JSON object are indexed in turn, as a batch of their own, to any depth.
    """
    place = {int(t): k for k, t in enumerate(tops)}
    seen = ix.effective(np.flatnonzero(ix.keyed("file_path")))
    seen = seen[ix.kind[seen] == QUOTE]
    for at, top in zip(seen.tolist(), _top_of(ix, seen, tops).tolist()):
        if top >= 0 and ix.end[at] - ix.start[at] > 2:
            k = place[top]
            rows.add(*owner[k], prefix[k] + path_to(ix, at, top), ix.text(at))
    inner = ix.effective(np.flatnonzero(ix.keyed(_NESTED_ARGUMENTS)))
    inner = inner[ix.kind[inner] == QUOTE]
    texts, owners, prefixes = [], [], []
    for at, top in zip(inner.tolist(), _top_of(ix, inner, tops).tolist()):
        if top >= 0:
            k = place[top]
            texts.append(ix.text(at))
            owners.append(owner[k])
            prefixes.append(prefix[k] + path_to(ix, at, top))
    _nested_files(texts, owners, prefixes, rows)


def _nested_files(texts: list[str], owners: list[tuple], prefixes: list[str], rows: _Rows) -> None:
    if not texts:
        return
    ix = index_texts(texts)
    if not len(ix.kind):
        return
    tops = np.flatnonzero(ix.is_value & (ix.parent == -1) & (ix.kind == OPEN_OBJ))
    which = ix.rec[tops].tolist()
    _files(ix, tops, [owners[r] for r in which], rows, [prefixes[r] for r in which])


def _extract_files(r: _Record, runtime: list, rec_id: list, rows: _Rows) -> None:
    ix = r.ix
    tops, owners, texts, text_owners = [], [], [], []
    for i, at in enumerate(ix.members("arguments").tolist()):
        if at >= 0 and r.codex[i] and r.object[i] and r.kind[i] == "function_call":
            if ix.kind[at] == QUOTE:
                texts.append(ix.text(at))
                text_owners.append((runtime[i], rec_id[i], 0))
            elif ix.kind[at] in (OPEN_OBJ, OPEN_ARR):
                tops.append(at)
                owners.append((runtime[i], rec_id[i], 0))
    types, inputs = r.block_type(), r.block_type("input")
    for block in r.blocks().tolist():
        i = int(ix.rec[block])
        at = inputs.get(block, -1)
        if not r.codex[i] and at >= 0 and ix.kind[at] in (OPEN_OBJ, OPEN_ARR) and _is_type(ix, types, block, "tool_use"):
            tops.append(at)
            owners.append((runtime[i], rec_id[i], int(ix.ordinal[block])))
    if tops:
        _files(ix, np.array(tops, np.int64), owners, rows, ["$"] * len(tops))
    _nested_files(texts, text_owners, ["$"] * len(texts), rows)


def _extract_records(r: _Record, runtime: list, rec_id: list, rows: _Rows) -> None:
    ix = r.ix
    top = {n: r._string(n) for n in ("subtype", "sessionId", "id", "uuid", "parentUuid", "cwd", "timestamp", "version", "model")}
    held = {n: r._string(n, r.holder) for n in ("role", "model")}
    n_blocks = np.bincount(ix.rec[r.blocks()], minlength=len(ix.valid)) if len(ix.kind) else []
    for i in np.flatnonzero(r.object).tolist():
        codex = r.codex[i]
        session = top["id"][i] if codex else top["sessionId"][i]
        model = top["model"][i] if codex else held["model"][i]
        rows.add(runtime[i], rec_id[i], r.kind[i], top["subtype"][i], held["role"][i], session, top["uuid"][i], top["parentUuid"][i], top["cwd"][i], model, top["timestamp"][i], top["version"][i], int(n_blocks[i]))


def _extract_blocks(r: _Record, runtime: list, rec_id: list, rows: _Rows) -> None:
    ix = r.ix
    for i, at in enumerate(r.content.tolist()):
        if at >= 0 and ix.kind[at] == QUOTE:
            rows.add(runtime[i], rec_id[i], 0, "$", None, "text", ix.text(at))
    if not len(ix.kind):
        return
    types, texts, contents = r.block_type(), r.block_type("text"), r.block_type("content")
    elements: dict[int, list[int]] = {}
    for at in np.flatnonzero(ix.is_value & (ix.ordinal >= 0)).tolist():
        elements.setdefault(int(ix.parent[at]), []).append(at)
    todo = [(b, int(ix.ordinal[b]), f"$[{int(ix.ordinal[b])}]", None) for b in r.blocks().tolist()]
    while todo:
        block, no, path, parent = todo.pop()
        i = int(ix.rec[block])
        kind, text, inner = (d.get(block, -1) for d in (types, texts, contents))
        shown = ix.text(text) if text >= 0 and ix.kind[text] == QUOTE else ix.text(block) if ix.kind[block] == QUOTE else ix.text(inner) if inner >= 0 and ix.kind[inner] == QUOTE else None
        rows.add(runtime[i], rec_id[i], no, path, parent, ix.text(kind) if kind >= 0 and ix.kind[kind] == QUOTE else None, shown)
        if inner >= 0 and ix.kind[inner] == OPEN_ARR:
            for at in elements.get(inner, []):
                todo.append((at, no, f"{path}[{int(ix.ordinal[at])}]", path))


def _extract_calls(r: _Record, runtime: list, rec_id: list, rows: _Rows) -> None:
    ix = r.ix
    if not len(ix.kind):
        return
    held = np.bincount(ix.parent[np.flatnonzero(ix.is_value & (ix.key >= 0))], minlength=len(ix.kind))

    def add(i, no, call, name, arguments):
        shown = ix.value(arguments) if arguments >= 0 else None
        count = int(held[arguments]) if arguments >= 0 and ix.kind[arguments] == OPEN_OBJ else None
        rows.add(runtime[i], rec_id[i], no, ix.value(call) if call >= 0 else None, ix.value(name) if name >= 0 else None, count, shown)

    tops = {n: ix.members(n) for n in ("arguments", "call_id", "name", "input")}
    for i in np.flatnonzero(r.object & r.codex).tolist():
        if r.kind[i] in ("function_call", "custom_tool_call"):
            add(i, 0, tops["call_id"][i], tops["name"][i], tops["arguments" if r.kind[i] == "function_call" else "input"][i])
    types, inputs, ids, names = (r.block_type(n) for n in ("type", "input", "id", "name"))
    for block in r.blocks().tolist():
        i = int(ix.rec[block])
        if not r.codex[i] and _is_type(ix, types, block, "tool_use"):
            add(i, int(ix.ordinal[block]), *(d.get(block, -1) for d in (ids, names, inputs)))


_EXTRACT = {"records": _extract_records, "blocks": _extract_blocks, "calls": _extract_calls, "files": _extract_files}


def flatten(records: DataFrame, table: str) -> DataFrame:
    """The flat table `table` (see SCHEMAS) of records(runtime, rec_id, record), without a shuffle.

    Codex rows hold payloads, all others whole records with a `message`. Texts that aren't one JSON object are left
    out, a repeated row is a row of its own, of repeated names in an object the last holds, a `content` that is itself
    a string is block 0 with path `$`. Empty tables give empty tables; null texts give nothing.
    """
    extract = _EXTRACT[table]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runtime, rec_id = batch.column("runtime").to_pylist(), batch.column("rec_id").to_pylist()
            for row, data, offsets in slices(batch.column("record")):
                n = len(offsets) - 1
                rt, ids = runtime[row : row + n], rec_id[row : row + n]
                rows = _Rows(table)
                extract(_Record(Index(data, offsets), np.array([x == "codex" for x in rt], bool)), rt, ids, rows)
                yield rows.batch()

    return records.select("runtime", "rec_id", "record").mapInArrow(run, SCHEMAS[table])
