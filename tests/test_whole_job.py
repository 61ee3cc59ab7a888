"""Operators against the whole job, where a shorter one would still give rows."""

from skein.operators import vector
from tests.util import rows

SF01 = "/root/testdata/sf0.1"


def test_two_stage_recall(spark):
    from skein.plans.retrieval import maxsim_multivector, two_stage_search

    assert vector.candidate_depth(10) == 320 and vector.candidate_depth(1) == 200
    want = {(r["query_id"], r["id"]) for r in maxsim_multivector(spark, SF01).collect()}
    got = {(r["query_id"], r["id"]) for r in two_stage_search(spark, SF01).collect()}
    assert len(got) == len(want) == 100
    recall = len(got & want) / len(want)
    assert recall >= 0.95


def test_first_mentions_of_all_tokens(spark, tmp_path):
    from skein.plans.evidence import first_mentions, token_first_mentions

    d = f"file://{tmp_path}"
    docs = [(i, "hot" + (" once" if i == 3 else ""), f"2025-01-{20 - i:02d}" if i else None) for i in range(9)]
    spark.createDataFrame(docs, "doc_id bigint, text string, at string").selectExpr("doc_id", "text", "CAST(at AS timestamp_ntz) AS created_at").write.parquet(f"{d}/documents.parquet")
    assert rows(token_first_mentions(spark, d), "token", "df", "first_doc") == [("hot", 9, 8), ("once", 1, 3)]
    assert first_mentions(spark, d).count() == 0


def test_title_behind_long_markup(spark, tmp_path):
    from skein.plans.retrieval import normalize_title

    d = f"file://{tmp_path}"
    spark.createDataFrame([(1, "<b>" + "x" * 300 + "</b> Title"), (2, " " * 250 + "Late"), (3, "y" * 300)], "doc_id bigint, text string").write.parquet(f"{d}/documents.parquet")
    assert rows(normalize_title(spark, d), "id", "title") == [(1, "Title"), (2, "Late"), (3, "y" * 97 + "...")]
