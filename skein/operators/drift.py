"""Files whose fields drift, read into one table with a rescue column, and the departures of each file.

Every record is read against the agreed schema of its kind: a field whose JSON type is allowed lands in its
typed column, and any other field (unknown, or of another type) is kept as JSON text in `_rescued`. Fields that
are approved later are promoted: the rescued values are replayed into a new typed column.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import bounded_rows, json_kind, materialize, parse_line

#: A schema table of more rows is refused: it is configuration, held as literals in the plan.
MAX_SCHEMA_ROWS = 5000
_TYPES = {"string": "string", "number": "double", "boolean": "boolean"}


class TargetSchema:
    """The agreed fields: {(runtime, kind): {path: allowed types}} and the required ones of them."""

    def __init__(self, rows):
        self.types: dict[tuple[str, str], dict[str, set[str]]] = defaultdict(lambda: defaultdict(set))
        self.required: dict[tuple[str, str], set[str]] = defaultdict(set)
        for r in rows:
            if None in (r["runtime"], r["rec_kind"], r["field_path"]):
                continue
            self.types[r["runtime"], r["rec_kind"]][r["field_path"]].add(r["json_type"])
            if r["is_required"]:
                self.required[r["runtime"], r["rec_kind"]].add(r["field_path"])

    @classmethod
    def read(cls, schema_fields: DataFrame) -> TargetSchema:
        rows = bounded_rows(schema_fields.distinct(), MAX_SCHEMA_ROWS)
        if rows is None:
            raise ValueError(f"the schema table has more than {MAX_SCHEMA_ROWS} rows")
        return cls(rows)

    def columns(self) -> dict[str, str]:
        """{path: SQL type} of the one table; a field with several allowed types is JSON text."""
        every: dict[str, set[str]] = defaultdict(set)
        for fields in self.types.values():
            for path, types in fields.items():
                every[path] |= types
        return {p: _TYPES.get(next(iter(t)), "string") if len(t) == 1 else "string" for p, t in sorted(every.items())}

    def _lookup(self, make) -> Column:
        """A map from `runtime/kind` to what `make` says, as a literal."""
        pairs = [x for key in sorted(self.types) for x in (F.lit("/".join(key)), make(key))]
        return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,array<string>>")

    def allowed(self) -> Column:
        """runtime/kind -> array of `path|type`."""
        return self._lookup(lambda k: F.array(*[F.lit(f"{p}|{t}") for p in sorted(self.types[k]) for t in sorted(self.types[k][p])]))

    def listed(self) -> Column:
        return self._lookup(lambda k: F.array(*[F.lit(p) for p in sorted(self.types[k])]))

    def needed(self) -> Column:
        return self._lookup(lambda k: F.array(*[F.lit(p) for p in sorted(self.required[k])]).cast("array<string>"))


def _entries(v: Column) -> Column:
    return F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))


def _fields(v: Column, prefix: str = "") -> Column:
    named = F.transform(_entries(v), lambda e: F.struct(F.concat(F.lit(prefix), e["key"]).alias("path"), json_kind(e["value"]).alias("json_type"), e["value"].alias("value")))
    return F.filter(named, lambda f: f["json_type"] != "null")


def parse_records(records: DataFrame) -> DataFrame:
    """(runtime, rec_id, file_name, rec_kind, fields) of records(runtime, rec_id, file_name, text, fallback_kind, has_message).

    Text that isn't a JSON object is left out. The kind is the object's `type` (as text if it isn't a string), else
    `fallback_kind`; JSON nulls count as absent; the keys of an object `message` come out as `message.key`.
    """
    doc = records.withColumn("v", parse_line(F.col("text"))).where(json_kind(F.col("v")) == "object")
    inner = F.try_variant_get("v", "$.message", "variant")
    message = F.when(F.col("has_message") & (json_kind(inner) == "object"), _fields(inner, "message."))
    kind = F.coalesce(F.try_variant_get("v", "$.type", "string"), F.col("fallback_kind"))
    empty = F.array().cast("array<struct<path:string,json_type:string,value:variant>>")
    return doc.select("runtime", "rec_id", "file_name", kind.alias("rec_kind"), F.concat(_fields(F.col("v")), F.coalesce(message, empty)).alias("fields"))


def rescue(parsed: DataFrame, schema: TargetSchema) -> DataFrame:
    """One row per record: its keys, whether its kind is agreed, `fit` (path -> value of every agreed field of an allowed type) and
    `_rescued`, a JSON object of all other fields, null without any."""
    key = F.concat_ws("/", "runtime", "rec_kind")
    allowed = F.element_at(schema.allowed(), key)
    rows = parsed.withColumn("known", allowed.isNotNull()).withColumn("_allowed", F.coalesce(allowed, F.array().cast("array<string>")))

    def fits(f: Column) -> Column:
        return F.array_contains("_allowed", F.concat_ws("|", f["path"], f["json_type"]))

    fit = F.map_from_entries(F.transform(F.filter("fields", fits), lambda f: F.struct(f["path"], f["value"])))
    rest = F.filter("fields", lambda f: ~fits(f))
    rescued = F.when(F.size(rest) > 0, F.to_json(F.map_from_entries(F.transform(rest, lambda f: F.struct(f["path"], F.to_json(f["value"]))))))
    return rows.select("runtime", "rec_id", "file_name", "rec_kind", "known", fit.alias("fit"), rescued.alias("_rescued"))


def _as_text(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def column_name(path: str) -> str:
    return path.replace(".", "_").replace("-", "_")


def ingest(parsed: DataFrame, schema: TargetSchema) -> DataFrame:
    """One row per record: its keys, a typed column for each agreed field and `_rescued`, a JSON object of the rest.

    Records of a kind that isn't agreed have all their fields in `_rescued`. A repeated record stays a row of its own.
    """
    rows = rescue(parsed, schema)
    typed = []
    for path, kind in schema.columns().items():
        value = F.element_at("fit", F.lit(path))
        typed.append((_as_text(value) if kind == "string" else F.try_variant_get(value, "$", kind)).alias(column_name(path)))
    return rows.select("runtime", "rec_id", "file_name", "rec_kind", *typed, "_rescued")


def _without(entries: Column, key: Column) -> Column:
    return F.map_filter(entries, lambda k, v: ~F.coalesce(k == key, F.lit(False)))


def promote(table: DataFrame, approved: dict[str, str]) -> DataFrame:
    """Replay rescued values of the approved {path: SQL type} into typed columns.

    A value that can't be cast stays rescued; one that can leaves `_rescued`, which turns null when it is empty. Where the
    column exists already, only its nulls are filled.
    """
    left = F.from_json("_rescued", "map<string,string>")
    for path, kind in approved.items():
        raw = F.element_at(F.from_json("_rescued", "map<string,string>"), F.lit(path))
        text = F.when(raw.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")).otherwise(raw)
        value = text if kind == "string" else text.try_cast(kind)
        name = column_name(path)
        done = F.coalesce(F.col(name), value.cast(table.schema[name].dataType)) if name in table.columns else value
        table = table.withColumn(name, done)
        taken = F.lit(path) if kind == "string" else F.when(value.isNotNull(), F.lit(path))
        left = _without(left, taken)
    return table.withColumn("_rescued", F.when(F.size(left) > 0, F.to_json(left)))


def drift_report(parsed: DataFrame, schema: TargetSchema) -> DataFrame:
    """(runtime, file_name, rec_kind, field_path, change_kind): each departure of a file from the agreed fields.

    Read off the ingestion: the keys of `_rescued` give `added` and `retyped`, the agreed and required fields that no record of
    the kind in the file has, fitting or rescued, give `removed`, kinds that aren't agreed give `new_kind`.
    """
    rows = rescue(parsed, schema)

    def named(paths: Column, fits: bool) -> Column:
        return F.transform(F.coalesce(paths, F.array().cast("array<string>")), lambda p: F.struct(p.alias("path"), F.lit(fits).alias("fits")))

    # A record without fields still shows that its file has the kind; of kinds that aren't agreed no field counts.
    fields = F.when(F.col("known"), F.concat(named(F.map_keys("fit"), True), named(F.json_object_keys("_rescued"), False)))
    seen = rows.select("runtime", "file_name", "rec_kind", "known", F.explode_outer(fields).alias("f"))
    seen = seen.select("runtime", "file_name", "rec_kind", "known", F.col("f.path").alias("field_path"), F.col("f.fits").alias("fits"))
    # One row per file, kind and field from here on; map-side partial aggregation meets hot files.
    facts = materialize(seen.groupBy("runtime", "file_name", "rec_kind", "known", "field_path").agg(F.min("fits").alias("fits")), "drift")
    key = F.concat_ws("/", "runtime", "rec_kind")
    listed = F.array_contains(F.element_at(schema.listed(), key), F.col("field_path"))
    wrong = facts.where(F.col("known") & ~F.col("fits")).select("runtime", "file_name", "rec_kind", "field_path", F.when(listed, "retyped").otherwise("added").alias("change_kind"))
    kinds = facts.where("known").select("runtime", "file_name", "rec_kind").distinct()
    wanted = kinds.select("*", F.explode(F.element_at(schema.needed(), key)).alias("field_path"))
    same = [wanted[c].eqNullSafe(facts[c]) for c in ("runtime", "file_name", "rec_kind")] + [wanted["field_path"] == facts["field_path"]]
    gone = wanted.join(facts.where(F.col("field_path").isNotNull()), same[0] & same[1] & same[2] & same[3], "left_anti").withColumn("change_kind", F.lit("removed"))
    new = facts.where(~F.col("known")).select("runtime", "file_name", "rec_kind", F.lit("type").alias("field_path"), F.lit("new_kind").alias("change_kind")).distinct()
    return wrong.unionByName(gone).unionByName(new)
