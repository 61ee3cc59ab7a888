import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.operators.structural import OPEN_ARR, OPEN_OBJ, QUOTE, Index, index_texts

scalars = st.none() | st.booleans() | st.integers(-10**6, 10**6) | st.text(max_size=12) | st.sampled_from(['"', "\\", '\\"', "{", "}]", "\u00e9\u4e2d", "a:b,c"])
values = st.recursive(scalars, lambda c: st.lists(c, max_size=4) | st.dictionaries(st.text(max_size=6) | st.sampled_from(["file_path", "arguments"]), c, max_size=4), max_leaves=14)


def strict(text):
    def no(_):
        raise ValueError

    try:
        json.loads(text, parse_constant=no)
        return True
    except ValueError:
        return False


def leaves(v, path=""):
    if isinstance(v, dict):
        for k, x in v.items():
            yield from leaves(x, f"{path}.{k}")
    elif isinstance(v, list):
        for i, x in enumerate(v):
            yield from leaves(x, f"{path}[{i}]")
    else:
        yield path, v


def path_of(ix, at):
    out = []
    while ix.parent[at] >= 0:
        k = int(ix.key[at])
        out.append("." + ix.text(k) if k >= 0 else f"[{int(ix.ordinal[at])}]")
        at = int(ix.parent[at])
    return "".join(reversed(out))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(values, st.booleans(), st.integers(0, 400), st.booleans()), min_size=1, max_size=6))
def test_index_agrees_with_json(cases):
    texts = []
    for v, cut, at, ascii_only in cases:
        t = json.dumps(v, ensure_ascii=ascii_only)
        try:
            t.encode()
        except UnicodeEncodeError:
            t = json.dumps(v)
        texts.append(t[: at % (len(t) + 1)] if cut else t)
    ix = index_texts(texts)
    for i, t in enumerate(texts):
        assert bool(ix.valid[i]) == strict(t), t
    for i, t in enumerate(texts):
        if not ix.valid[i]:
            continue
        want = sorted((p, None if v is None else v if isinstance(v, str) else json.dumps(v)) for p, v in leaves(json.loads(t)))
        at = np.flatnonzero(ix.is_value & (ix.rec == i) & (ix.kind != OPEN_OBJ) & (ix.kind != OPEN_ARR))
        got = sorted((path_of(ix, int(k)), ix.value(int(k))) for k in at)
        clean = [(p.encode("utf-8", "replace").decode(), v if v is None else v.encode("utf-8", "replace").decode()) for p, v in want]
        assert [repr(g) for g in got] == [repr(c) for c in sorted(clean, key=lambda x: (x[0], str(x[1])))] or sorted(map(repr, got)) == sorted(map(repr, clean))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='{}[]",:\\ntrue01-.e \n', max_size=20), min_size=1, max_size=8))
def test_validity_of_noise(texts):
    ix = index_texts(texts)
    assert [bool(v) for v in ix.valid] == [strict(t) for t in texts]


def test_escaped_names_and_repeats():
    ix = index_texts(['{"file\\u005fpath": "a", "x": {"file_path": "b", "file_path": "c"}}', "", "[]", "5"])
    at = np.flatnonzero(ix.keyed("file_path"))
    assert [ix.text(int(k)) for k in at] == ["a", "b", "c"]
    assert [ix.text(int(k)) for k in ix.effective(at)] == ["a", "c"]
    assert ix.valid.tolist() == [True, False, True, True]
    assert all(ix.kind[k] == QUOTE for k in at)


def test_deep_nesting():
    depth = 5000
    ix = index_texts(["[" * depth + "]" * depth, "[" * depth])
    assert ix.valid.tolist() == [True, False]


def test_empty_buffer():
    ix = Index(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    assert len(ix.start) == 0
