"""Table mutations as rewrites: upserts, deletions, revisions, tombstones, registries and changes of content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, fresh: DataFrame, keys: list[str], defaults: dict | None = None) -> DataFrame:
    """All rows of `fresh`, and those of `base` whose keys `fresh` lacks; columns missing in `fresh` take the defaults."""
    for c in base.columns:
        if c not in fresh.columns:
            fresh = fresh.withColumn(c, F.lit((defaults or {}).get(c)).cast(base.schema[c].dataType))
    return base.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh.select(*base.columns))


def delete_where(base: DataFrame, cond: Column) -> DataFrame:
    """Rows the condition doesn't hold for, those of unknown truth among them."""
    return base.where(~F.coalesce(cond, F.lit(False)))


def update_where(base: DataFrame, cond: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(cond, F.lit(False))
    return base.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def reconcile_absent(registry: DataFrame, found: DataFrame, key: str, now: Column) -> DataFrame:
    """`registry` with status and absent_since: what isn't found turns absent now (or stays so), what is found is available."""
    seen = found.select(F.col(key).alias("_key")).distinct().withColumn("_seen", F.lit(True))
    rows = registry.join(seen, F.col(key) == F.col("_key"), "left")
    gone = F.col("_seen").isNull()
    return rows.withColumn("absent_since", F.when(gone, F.coalesce("absent_since", now))).withColumn("status", F.when(gone, "absent").otherwise("available")).drop("_key", "_seen")


def registry_union(fresh: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Both, the fresh row where a key is in both."""
    rest = registry.join(fresh.select(key), key, "left_anti")
    return fresh.withColumn("origin", F.lit("fresh")).unionByName(rest.withColumn("origin", F.lit("registry")), allowMissingColumns=True)


def prune(tables: dict[str, DataFrame], doomed: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of the doomed keys."""
    ids = doomed.select(key).distinct()
    return {n: t.join(ids, key, "left_anti") for n, t in tables.items()}


def older_than(absent_since: Column, days: int, now: Column) -> Column:
    """Whether something is absent for longer than `days`; of unknown age only when any age will do."""
    if days <= 0:
        return F.lit(True)
    return F.coalesce(absent_since < F.date_add(now.cast("date"), -days).cast("timestamp_ntz"), F.lit(False))


def with_current(rows: DataFrame, period: str, revision: str) -> DataFrame:
    """`rows` with is_current: the highest revision of each period."""
    best = rows.groupBy(F.col(period).alias("_p")).agg(F.max(revision).alias("_r"))
    return rows.join(best, F.col(period) == F.col("_p")).withColumn("is_current", F.col(revision) == F.col("_r")).drop("_p", "_r")


def revise(points: DataFrame, period: str, order: str, content: str) -> DataFrame:
    """The points at which a period's content changes, numbered as revisions from 1."""
    w = Window.partitionBy(period).orderBy(order)
    changed = points.withColumn("_was", F.lag(content).over(w)).where(~F.col("_was").eqNullSafe(F.col(content)) | F.col("_was").isNull())
    return changed.withColumn("revision", F.row_number().over(w).cast("bigint")).drop("_was")


def content_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change, revision) of old(key, digest, revision) and new(key, digest): added as revision 1, changed as the next one, deleted, unchanged."""
    a = old.select(F.col(key).alias("_a"), F.col("digest").alias("_old"), F.col("revision").alias("_rev"))
    b = new.select(F.col(key).alias("_b"), F.col("digest").alias("_new"))
    rows = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "changed").otherwise("unchanged")
    return rows.select(F.coalesce("_a", "_b").alias(key), change.alias("change"), F.when(F.col("_a").isNull(), 1).when(change.isin("changed", "deleted"), F.col("_rev") + 1).otherwise(F.col("_rev")).alias("revision"))


def apply_changes(changes: DataFrame, key: str) -> DataFrame:
    """The state after changes(key, revision, value, is_delete) in any order: the highest revision holds, equal repeats are
    one, contradictions of one revision are quarantined and leave the revision below in force."""
    each = changes.groupBy(key, "revision").agg(F.min("value").alias("value"), F.max("value").alias("_high"), F.count("value").alias("_known"), F.count(F.lit(1)).alias("_n"), F.max("is_delete").alias("is_delete"), F.min("is_delete").alias("_kept"))
    clash = (F.col("value") != F.col("_high")) | (F.col("is_delete") != F.col("_kept")) | ((F.col("_known") > 0) & (F.col("_known") < F.col("_n")))
    each = each.withColumn("_clash", F.coalesce(clash, F.lit(False)))
    out = each.groupBy(key).agg(F.max(F.when(~F.col("_clash"), F.struct("revision", "value", "is_delete"))).alias("s"), F.count_if("_clash").alias("n_quarantined"))
    return out.select(key, F.col("s.revision").alias("revision"), F.when(~F.col("s.is_delete"), F.col("s.value")).alias("value"), F.col("s.is_delete").alias("is_delete"), "n_quarantined")
