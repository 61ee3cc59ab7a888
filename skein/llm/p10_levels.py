"""Problem 10: how demanding each document is to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.reading_level import fit_cuts, level_of, reading_levels
from skein.session import materialize, table


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demanding documents: more than 20 words a sentence and more than 5.5 letters a word."""
    return _graded(spark, sf_dir).where("n_words > 20 * n_sentences AND 10 * n_letters > 55 * n_words").select("doc_id").distinct()


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its grades and its level, by cut points fitted on level_labels."""
    graded = materialize(_graded(spark, sf_dir), "grades")
    cuts = fit_cuts(graded, table(spark, sf_dir, "level_labels"))
    return graded.withColumn("reader_level", level_of(F.col("grade"), cuts))


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by level and language."""
    return p10_levels(spark, sf_dir).groupBy("reader_level", "language").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_words").alias("n_words"), F.avg("grade").alias("mean_grade"))


QUERIES = {"p10_found": p10_found, "p10_levels": p10_levels, "p10_profile": p10_profile}
SQL = {
    "p10_found": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
marked AS (SELECT *, starts_with(ltrim(line, E' \t'), '```') AS fence FROM lines),
placed AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM marked),
prose AS (SELECT doc_id, line FROM placed WHERE NOT fence AND n % 2 = 0 AND NOT starts_with(line, '#')),
sentences AS (SELECT doc_id, unnest(string_split_regex(line, '[.!?]\s')) AS s FROM prose),
counted AS (SELECT doc_id, len(regexp_extract_all(s, '\pL+')) AS w, length(regexp_replace(s, '\PL', '', 'g')) AS l FROM sentences)
SELECT doc_id FROM counted WHERE w > 0 GROUP BY doc_id HAVING sum(w) > 20 * count(*) AND 10 * sum(l) > 55 * sum(w)
"""
}
