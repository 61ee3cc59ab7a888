"""Filters and services of the search surface."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import lexical

DEFAULT_RESULTS, MAX_RESULTS = 10, 50
EXIT_CODES = {"ok": 0, "failed": 1, "usage": 2, "not_ready": 3, "invalid_predicate": 4}


class SkeinError(Exception):
    code = "failed"

    @property
    def exit_code(self) -> int:
        return EXIT_CODES[self.code]


class InvalidPredicate(SkeinError):
    """A raw clause that doesn't parse or names what isn't there."""

    code = "invalid_predicate"


class NotReady(SkeinError):
    """A search before anything was indexed."""

    code = "not_ready"


def search_filter(filters: dict | None = None, where: str | None = None) -> Column:
    """One predicate of all filters, which must all hold.

    `since` and `until` are dates, both included, on created_at; `<column>_contains` is a literal substring;
    other keys are equalities, booleans among them; the raw clause comes last; `filtered` checks it.
    """
    cond = F.lit(True)
    for key, value in (filters or {}).items():
        if value is None:
            continue
        if key == "since":
            part = F.col("created_at") >= F.lit(value).cast("timestamp_ntz")
        elif key == "until":
            part = F.col("created_at") < F.date_add(F.lit(value).cast("date"), 1).cast("timestamp_ntz")
        elif key.endswith("_contains"):
            part = F.contains(F.col(key.removesuffix("_contains")), F.lit(value))
        else:
            part = F.col(key) == F.lit(value)
        cond = cond & part
    if where:
        cond = cond & F.expr(f"({re.sub(r'strpos\s*\(', 'instr(', where)})")
    return cond


def filtered(df: DataFrame, filters: dict | None = None, where: str | None = None) -> DataFrame:
    try:
        out = df.where(search_filter(filters, where))
        out.schema  # noqa: B018 - analysis happens here
        return out
    except (AnalysisException, ParseException) as e:
        raise InvalidPredicate(str(e)) from e


def clamp_limit(limit: int | None) -> int:
    return min(max(DEFAULT_RESULTS if limit is None else limit, 1), MAX_RESULTS)


def search(docs: DataFrame, query: str, limit: int | None = None, filters: dict | None = None, where: str | None = None) -> DataFrame:
    """The best documents(doc_id, text, ...) for a query by BM25 over the filtered rows, with total_matches and omitted."""
    if docs.isEmpty():
        raise NotReady("nothing is indexed")
    held = filtered(docs, filters, where)
    spark = docs.sparkSession
    q = spark.createDataFrame([(0, query)], "query_id bigint, query string")
    scores = lexical.bm25(held.select(F.col("doc_id").alias("id"), "text"), q)
    total = scores.count()
    k = clamp_limit(limit)
    top = scores.orderBy(F.col("score").desc(), "id").limit(k)
    return top.join(held, F.col("id") == F.col("doc_id")).drop("id", "query_id").withColumns({"total_matches": F.lit(total), "omitted": F.lit(max(0, total - k))}).orderBy(F.col("score").desc(), "doc_id")


def show(docs: DataFrame, doc_id: int) -> DataFrame:
    return docs.where(F.col("doc_id") == doc_id)


def status(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("n_documents"), F.countDistinct("project").alias("n_projects"), F.count_if(F.col("text").isNull()).alias("n_empty"), F.max("created_at").alias("latest"))
