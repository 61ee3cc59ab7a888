"""Session factory, table access and durable cut points."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []
_tables: dict[int, str] = {}


def get_spark(app: str = "skein", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or, in local mode alone, a temporary one where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="skein-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    for spark, path in _made:
        try:
            if path.startswith("file:"):
                shutil.rmtree("/" + path[5:].lstrip("/"), ignore_errors=True)
            else:
                delete_path(spark, path)
        except Exception:  # the session may be gone at exit
            pass
    _made.clear()


atexit.register(_sweep)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark)}/skein/{label}-{os.getpid()}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[id(out)] = path
    weakref.finalize(out, _tables.pop, id(out), None)
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table that `materialize` wrote, once nothing that is still to run reads it."""
    path = _tables.pop(id(df), None)
    if path:
        delete_path(df.sparkSession, path)


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """All rows of a table of configuration size, or None when it has more than `limit`."""
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def parse_line(col):
    """A VARIANT of one JSON text, null for text that isn't one JSON value and nothing else.

    Spark's parser stops after the first value, so the text is read as the only element of an array.
    """
    text = F.btrim(col, F.lit(" \t\r\n"))
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    value = F.try_variant_get(listed, "$[0]", "variant")
    return F.when(F.try_variant_get(listed, "$[1]", "variant").isNull() & ~text.startswith("]"), value)


def json_kind(variant):
    """string, number, boolean, object, array or null of a VARIANT."""
    s = F.schema_of_variant(variant)
    return (
        F.when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s == "VOID", "null")
        .when(s.isNotNull(), "number")
    )


def allow_duplicate_keys(spark: SparkSession) -> None:
    """The last of repeated keys holds, in JSON and in maps made of it, as in other JSON readers, instead of an error."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
