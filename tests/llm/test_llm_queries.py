import collections

import pytest

from skein.llm import p1_pieces, registry
from skein.llm.grouped_split import SHARES
from skein.llm.packing import CAPACITY
from skein.llm.split_text import LIMIT, OVERLAP
from tests.util import same_as_sql

SQL = registry.oracle_sql()
#: Queries without SQL and the test of this module that holds their rows.
HELD = {
    "p1_pieces": "test_pieces",
    "p4_splits": "test_splits",
    "p8_sequences": "test_sequences",
    "p8_fill": "test_sequences",
    "p9_found": "test_leaks_brute_force",
    "p9_leaks": "test_leaks_brute_force",
    "p10_levels": "test_levels",
    "p10_profile": "test_levels",
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, data, duck):
    same_as_sql(registry.queries()[name](spark, data), duck.sql(SQL[name]))


def test_every_query_is_held():
    assert set(registry.queries()) == set(SQL) | set(HELD) and not set(SQL) & set(HELD)
    assert all(t in globals() for t in HELD.values())


def run(name, spark, data):
    return registry.queries()[name](spark, data).collect()


def test_pieces(spark, data):
    texts = {(r["runtime"], r["rec_id"], r["block_no"]): r["text"].strip(" \t\r\n") for r in p1_pieces.message_texts(spark, data).collect()}
    parts = collections.defaultdict(dict)
    for r in run("p1_pieces", spark, data):
        assert 0 < len(r["piece"]) <= LIMIT
        parts[r["runtime"], r["rec_id"], r["block_no"]][r["piece_no"]] = r
    assert set(parts) == {k for k, t in texts.items() if t}
    for key, mine in parts.items():
        assert sorted(mine) == list(range(len(mine))) and all(r["n_pieces"] == len(mine) for r in mine.values())
        whole, end = "", 0
        for no in range(len(mine)):
            r = mine[no]
            assert r["start"] == (end - OVERLAP if no else 0)
            whole += r["piece"][OVERLAP if no else 0 :]
            end = r["start"] + len(r["piece"])
        assert whole == texts[key]


def test_splits(spark, data, duck):
    rows = run("p4_splits", spark, data)
    ids = {i for (i,) in duck.sql("SELECT DISTINCT id FROM eval_queries WHERE id IS NOT NULL").fetchall()}
    assert len(rows) == len(ids) and {r["query_id"] for r in rows} == ids
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["group_id"]].append(r)
    assert all(len({r["split"] for r in g}) == 1 and g[0]["group_size"] == len(g) and k == min(r["query_id"] for r in g) for k, g in groups.items())
    ties = duck.sql("SELECT id, nullif(lower(trim(e, E' \\t\\r\\n')), '') AS e FROM (SELECT id, unnest(target_episode_ids) AS e FROM eval_queries WHERE id IS NOT NULL)").fetchall()
    of = {r["query_id"]: r["group_id"] for r in rows}
    seen = {}
    for i, e in ties:
        assert e is None or seen.setdefault(e, of[i]) == of[i]
    largest = max(len(g) for g in groups.values())
    for name, share in SHARES.items():
        assert abs(sum(r["split"] == name for r in rows) - share * len(rows)) <= max(1, largest if name == "train" else 1)


def test_sequences(spark, data, duck):
    rows = run("p8_sequences", spark, data)
    loads, pieces = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        loads[r["sequence_id"]] += r["n_tokens"]
        pieces[r["doc_id"]].append((r["start_token"], r["n_tokens"]))
    assert max(loads.values()) <= CAPACITY and set(pieces) == {i for (i,) in duck.sql("SELECT doc_id FROM documents").fetchall()}
    for mine in pieces.values():
        mine.sort()
        assert mine[0][0] == 0 and all(a + n == b and n == CAPACITY for (a, n), (b, _) in zip(mine, mine[1:]))
    (fill,) = run("p8_fill", spark, data)
    assert (fill["n_sequences"], fill["n_tokens"], fill["largest"]) == (len(loads), sum(loads.values()), max(loads.values()))
    assert fill["least"] == -(-sum(loads.values()) // CAPACITY) and fill["n_sequences"] <= 1.05 * fill["least"] + 2


def test_leaks_brute_force(spark, data, duck):
    from tests.llm.test_texts import slow_leaks

    docs = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    items = duck.sql("SELECT item_id, text FROM eval_items").fetchall()
    want = slow_leaks(docs, items, 12)
    assert {(r["doc_id"], r["item_id"]) for r in run("p9_found", spark, data)} == want
    every = run("p9_leaks", spark, data)
    assert {(r["doc_id"], r["item_id"]) for r in every if r["exact"]} == want and all(r["score"] > 0 for r in every)


def test_levels(spark, data, duck):
    rows = run("p10_levels", spark, data)
    assert sorted(r["doc_id"] for r in rows) == sorted(i for (i,) in duck.sql("SELECT doc_id FROM documents").fetchall())
    assert all((r["reader_level"] is None) == (r["grade"] is None) == (r["n_words"] == 0) for r in rows)
    ordered = [r["reader_level"] for r in sorted((r for r in rows if r["grade"] is not None), key=lambda r: r["grade"])]
    assert ordered == sorted(ordered) and set(ordered) <= {1, 2, 3, 4, 5}
    told = {(r["reader_level"], r["language"]): (r["n_documents"], r["n_words"]) for r in run("p10_profile", spark, data)}
    want = collections.defaultdict(lambda: (0, 0))
    for r in rows:
        n, w = want[r["reader_level"], r["language"]]
        want[r["reader_level"], r["language"]] = n + 1, w + r["n_words"]
    assert told == dict(want)
