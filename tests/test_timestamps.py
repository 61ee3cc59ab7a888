import pytest
from pyspark.sql import functions as F

from skein.operators.timestamps import StampDictionary, build_dictionary, normalize, with_epoch_millis, with_zone
from tests.util import rows

CASES = [
    ("2025-01-02T03:04:05Z", None, 1735787045000),
    ("2025-01-02T03:04:05.678912345Z", None, 1735787045678),
    ("2025-01-02 03:04:05", "America/New_York", 1735805045000),
    ("2025-01-02 03:04:05", "No/Where", 1735787045000),
    ("2025-11-02 01:30:00", "America/New_York", 1762061400000),  # twice: the first, still -04:00
    ("2025-03-09 02:30:00", "America/New_York", 1741505400000),  # skipped: the offset before, -05:00
    ("2025-01-02T03:04:05+05:30", "Europe/Berlin", 1735767245000),
    ("2025-01-02T03:04:05+0530", None, 1735767245000),
    ("2025-01-02T03:04:05-03", None, 1735797845000),
    ("2025-01-02 03:04:05 CET", None, 1735783445000),
    ("2025-01-02T03:04:05,250+01:00[Europe/Berlin]", None, 1735783445250),
    ("2025-01-02T03:04:05[Europe/Berlin]", None, 1735783445000),
    ("20250102T030405Z", None, 1735787045000),
    ("Thu, 02 Jan 2025 03:04:05 +0000", None, 1735787045000),
    ("02-Jan-2025 12:04:05 AM", None, 1735776245000),
    ("02-Jan-2025 12:04:05 PM", None, 1735819445000),
    ("  2025-01-02T03:04:05Z\n", None, 1735787045000),
    ("1735787045", None, 1735787045000),
    ("1735787045.6789", None, 1735787045678),
    ("1735787045678", None, 1735787045678),
    ("1735787045678912", None, 1735787045678),
    ("1735787045678912345", None, 1735787045678),
    ("99", None, None),
    ("9999999999", None, None),
    ("99999999999999999999", None, None),
    ("2025-02-30 01:02:03", None, None),
    ("2025-01-02T25:00:00Z", None, None),
    ("02-Jan-2025 13:04:05 PM", None, None),
    ("2025-01-02 03:04:05 QQQ", None, None),
    ("0000-00-00 00:00:00", None, None),
    ("pending", None, None),
    ("", None, None),
    (None, "UTC", None),
    ("x" * 100_000, None, None),
]


@pytest.fixture
def stamps(spark):
    return spark.createDataFrame([(a, b, c) for a, b, c in CASES], "raw string, zone string, want bigint")


def test_cases(stamps):
    for r in with_epoch_millis(stamps, name="got").collect():
        assert r["got"] == r["want"], (r["raw"] or "")[:60]


def test_dictionary_is_incremental(spark, stamps, tmp_path):
    d = StampDictionary(spark, f"file://{tmp_path}/dict")
    first = d.extend(stamps.limit(5)).count()
    assert d.extend(stamps).count() == len({(a, b or "") for a, b, _ in CASES if a is not None}) > first
    assert d.extend(stamps).count() == d.read().count()


def test_join_back_keeps_rows_and_columns(stamps):
    hot = stamps.unionByName(stamps).withColumn("zone_name", F.lit(1))
    out = normalize(hot, build_dictionary(hot))
    assert out.count() == 2 * len(CASES)
    assert all(r["epoch_ms"] == r["want"] for r in out.collect())
    assert normalize(hot.limit(0), build_dictionary(hot.limit(0))).count() == 0


def test_hosts(spark):
    hosts = spark.createDataFrame([("a", "UTC"), ("a", "Asia/Kolkata"), (None, "UTC")], "host string, tz_name string")
    df = spark.createDataFrame([("a",), ("b",), (None,)], "host string")
    assert rows(with_zone(df, hosts), "host", "zone") == [("a", "Asia/Kolkata"), ("b", None), (None, None)]
