"""Mixed stamps to one moment in UTC, through a dictionary of distinct raw values.

Raw values are reduced to their distinct (text, zone) pairs with a map-side combine, each pair is parsed
once, the parsed pairs are kept in a table that later runs extend, and the moments are joined back.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Zone letters and their offset from UTC in minutes.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120,
    "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "BRT": -180, "BRST": -120, "ART": -180, "AST": -240,
    "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480,
    "PDT": -420,
}
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
PLAIN_UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
#: Bare numbers count from 1970 in the unit that puts them between these seconds (2020-01-01, 2036-01-01).
EPOCH_RANGE = (1577836800, 2082758400)

_CLOCK = r"(\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?"
_ZONE = r"\s*([A-Za-z]{1,5}|[+-]\d{2}(?::?\d{2})?)?(?:\[([A-Za-z0-9_+\-/]+)\])?$"
_ISO = r"^(\d{4})-(\d{2})-(\d{2})[Tt ]" + _CLOCK + _ZONE
_BASIC = r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})(?:[.,](\d{1,12}))?" + _ZONE
_NAMED = r"^(?:[A-Za-z]{3,9}, )?(\d{1,2})[ -]([A-Za-z]{3})[ -](\d{4}) " + _CLOCK + r"(?: ([AaPp][Mm]))?" + _ZONE


def _layout(s: Column) -> Column:
    """year|month|day|hour|minute|second|fraction|half of day|letters|zone name of the layout that matches, parts it lacks empty.

    Each pattern is tried once and rewritten once.
    """
    plain = "$1|$2|$3|$4|$5|$6|$7||$8|$9"
    return (
        F.when(s.rlike(_ISO), F.regexp_replace(s, _ISO, plain))
        .when(s.rlike(_BASIC), F.regexp_replace(s, _BASIC, plain))
        .when(s.rlike(_NAMED), F.regexp_replace(s, _NAMED, "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"))
    )


def _bare_number(s: Column) -> Column:
    """Milliseconds of a bare number in the one unit that puts it inside EPOCH_RANGE; digits are cut as integers."""
    number = s.rlike(r"^\d{9,19}(\.\d{1,15})?$")
    whole = F.when(number, F.split_part(s, F.lit("."), F.lit(1))).try_cast("bigint")
    frac = F.rpad(F.split_part(s, F.lit("."), F.lit(2)), 3, "0").substr(1, 3).try_cast("bigint")
    low, high = EPOCH_RANGE

    def within(scale: int) -> Column:
        return (whole >= low * scale) & (whole < high * scale)

    return (
        F.when(within(1), whole * 1000 + F.coalesce(frac, F.lit(0)))
        .when(within(1000), whole)
        .when(within(10**6), F.call_function("div", whole, F.lit(1000)))
        .when(within(10**9), F.call_function("div", whole, F.lit(1000000)))
    )


def with_epoch_millis(df: DataFrame, raw: str = "raw", zone: str = "zone", name: str = "epoch_ms") -> DataFrame:
    """`df` with the milliseconds since 1970 UTC, rounded down, of its stamps; null where one denotes no moment.

    A stamp with offset or zone letters follows those, a bracketed zone holds where there is no offset, and a
    stamp with neither is wall time in `zone` (UTC where that is null or unknown). Wall times that occur twice
    are the first of the two; skipped ones take the offset before the change. Empty texts, words, impossible
    dates and unknown zone letters give null.
    """
    kept = df.columns
    s = F.btrim(F.col(raw), F.lit(" \t\r\n"))
    df = df.withColumn("_s", s).withColumn("_p", F.split(_layout(F.col("_s")), r"\|", 10))
    part = [F.col("_p")[i] for i in range(10)]
    at = F.instr(F.lit(MONTHS), F.lower(part[1]))
    month = F.when(part[1].rlike("^[0-9]"), part[1]).when((at > 0) & (at % 3 == 1), F.lpad(F.call_function("div", at + 2, F.lit(3)).cast("string"), 2, "0"))
    hour12, half = part[3].try_cast("int"), F.upper(part[7])
    hour = F.when(half == "", part[3]).when(hour12.between(1, 12), F.lpad((hour12 % 12 + F.when(half == "PM", 12).otherwise(0)).cast("string"), 2, "0"))
    clock = F.concat(hour, F.lit(":"), part[4], F.lit(":"), F.when(part[5] == "", "00").otherwise(part[5]))
    wall = F.concat(part[0], F.lit("-"), month, F.lit("-"), F.lpad(part[2], 2, "0"), F.lit(" "), clock).try_cast("timestamp_ntz")
    df = df.withColumns({"_wall": wall, "_letters": F.nullif(F.upper(part[8]), F.lit("")), "_place": F.nullif(part[9], F.lit(""))})
    letters = F.col("_letters")
    digits = F.rpad(F.regexp_replace(letters, "[^0-9]", ""), 4, "0")
    hours, minutes = digits.substr(1, 2).try_cast("int"), digits.substr(3, 2).try_cast("int")
    numeric = F.when(letters.rlike("^[+-]") & (hours <= 18) & (minutes < 60), F.when(letters.startswith("-"), -1).otherwise(1) * (hours * 60 + minutes))
    named = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(ZONE_MINUTES.items()) for x in kv]), letters)
    known = sorted(zoneinfo.available_timezones() - {"localtime", "Factory"})
    place = F.coalesce("_place", zone)
    place = F.when(place.isin(known), place).when(F.col("_place").isNull(), "UTC")
    df = df.withColumns({"_offset": F.coalesce(numeric, named), "_place": place})
    utc = F.when(letters.isNull(), F.convert_timezone(F.col("_place"), F.lit("UTC"), F.col("_wall"))).otherwise(F.col("_wall"))
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), utc)
    seconds = F.call_function("div", micros, F.lit(1000000)) - F.when(letters.isNull(), 0).otherwise(F.col("_offset") * 60)
    millis = F.rpad(part[6], 3, "0").substr(1, 3).cast("bigint")
    return df.withColumn(name, F.coalesce(_bare_number(F.col("_s")), seconds * 1000 + millis)).select(*[c for c in kept if c != name], name)


def build_dictionary(stamps: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(raw, zone, epoch_ms) of each distinct pair of `stamps`(raw, zone) that `known` doesn't hold yet.

    Null raws are left out; a null zone is kept as the empty text, so that pairs compare with plain equality.
    """
    pairs = stamps.where(F.col("raw").isNotNull()).select("raw", F.coalesce("zone", F.lit("")).alias("zone")).distinct()
    if known is not None:
        pairs = pairs.join(known.select("raw", "zone"), ["raw", "zone"], "left_anti")
    return with_epoch_millis(pairs)


class StampDictionary:
    """The dictionary as a table of files under `path`; `extend` appends what is new and leaves the rest.

    Give the same path run after run and each distinct pair is parsed once in all of them. Two writers at a time may both
    append a pair; they parse it alike, and `read` shows it once.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        schema = "raw string, zone string, epoch_ms bigint"
        return self.spark.read.schema(schema).parquet(self.path) if fs.exists(target) else None

    def extend(self, stamps: DataFrame) -> DataFrame:
        build_dictionary(stamps, self.read()).write.mode("append").parquet(self.path)
        return self.read().groupBy("raw", "zone").agg(F.first("epoch_ms").alias("epoch_ms"))


HOT_PART, SALTS = 256, 16


def hot_marks(rows: DataFrame, mark: Column) -> list[int]:
    """The marks that more than one in HOT_PART rows has: fewer than HOT_PART of them, whatever the rows."""
    counts = rows.select(mark.alias("_mark")).groupBy("_mark").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    return [r["_mark"] for r in counts.where(F.col("n") * HOT_PART > total).collect()]


def normalize(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """`rows` with columns raw and zone, and epoch_ms joined from the dictionary; rows without a moment keep null.

    The dictionary holds each pair once, so a raw value of a third of all rows meets one dictionary row. Rows of such
    values are spread over salts, for which alone the dictionary's row is repeated. `rows` is read twice: give a
    table, not a long computation.
    """
    mark = F.xxhash64("raw", F.coalesce("zone", F.lit("")))
    hot = hot_marks(rows, mark)
    salts = F.sequence(F.lit(0), F.when(mark.isin(hot), SALTS - 1).otherwise(0))
    wide = dictionary.select(F.col("raw").alias("_raw"), F.col("zone").alias("_zone"), "epoch_ms", F.explode(salts).alias("_salt"))
    spread = rows.withColumn("_spread", F.when(mark.isin(hot), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS))).otherwise(0).cast("int"))
    match = (F.col("raw") == F.col("_raw")) & (F.coalesce("zone", F.lit("")) == F.col("_zone")) & (F.col("_spread") == F.col("_salt"))
    return spread.join(wide, match, "left").drop("_raw", "_zone", "_salt", "_spread")


def with_zone(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """`rows` with the zone of their host; null for null and unlisted hosts. `hosts` is a table of configuration
    size, which adaptive execution broadcasts while it is small. A host listed twice keeps its smallest zone."""
    zones = hosts.where(F.col("host").isNotNull()).groupBy(F.col("host").alias("_host")).agg(F.min("tz_name").alias("zone"))
    return rows.join(zones, F.col("host") == F.col("_host"), "left").drop("_host")
