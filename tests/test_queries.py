import importlib

import pytest

from skein.plans import registry
from tests.util import same_as_sql

SQL = registry.oracle_sql()


#: Queries without SQL and the test that holds their rows.
HELD = {
    "p3_records": "test_brute_force.test_p3_records",
    "p3_blocks": "test_brute_force.test_p3_blocks",
    "p3_calls": "test_brute_force.test_p3_calls",
    "shell_census": "test_brute_force.test_shell_census",
    "p6_table": "test_brute_force.test_p6_table",
    "p6_promoted": "test_brute_force.test_p6_table",
    "p7_found": "test_brute_force.test_p7_found",
    "p7_moments": "test_brute_force.test_p7_moments",
    "excerpt_phrase_window": "test_brute_force.test_excerpts",
    "normalize_title": "test_brute_force.test_titles",
    "ivf_recall": "test_io.test_coarse_index_recall",
    "candidate_scan": "test_candidates.test_candidate_queries",
    "candidate_keys": "test_candidates.test_candidate_queries",
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(name, spark, data, duck):
    same_as_sql(registry.queries()[name](spark, data), duck.sql(SQL[name]))


def test_every_query_is_held():
    assert set(registry.queries()) == set(SQL) | set(HELD) and not set(SQL) & set(HELD)
    for place in HELD.values():
        module, name = place.split(".")
        assert hasattr(importlib.import_module(f"tests.{module}"), name)


def test_core_stands_alone():
    import pathlib
    import re

    root = pathlib.Path(registry.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"skein\.llm|from \.*llm", f.read_text()), f
