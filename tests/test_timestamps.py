from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.timestamps import normalize_timestamps


def us(y, mo, d, h=0, mi=0, s=0, micro=0, zone=timezone.utc, fold=0):
    t = datetime(y, mo, d, h, mi, s, micro, zone, fold=fold)
    return (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


BERLIN, NEW_YORK = ZoneInfo("Europe/Berlin"), ZoneInfo("America/New_York")
CASES = [
    ("2024-04-20T14:51:17+02:00", None, None, us(2024, 4, 20, 12, 51, 17)),
    ("2024-05-08T04:18:59.830695", "UTC", None, us(2024, 5, 8, 4, 18, 59, 830695)),
    ("2025-01-26T18:12:00.409016994Z", None, None, us(2025, 1, 26, 18, 12, 0, 409016)),
    (" 2024-07-16t21:39:11.006z", None, None, us(2024, 7, 16, 21, 39, 11, 6000)),
    ("2024-02-06T08:55Z", None, None, us(2024, 2, 6, 8, 55)),
    ("20240211T211902Z", None, None, us(2024, 2, 11, 21, 19, 2)),
    ('"2024-03-24 00:12:25,271"', "Europe/London", "dmy", us(2024, 3, 24, 0, 12, 25, 271000)),
    ("2024-05-13 03:52:54.605 +0900", None, None, us(2024, 5, 12, 18, 52, 54, 605000)),
    ("17/Oct/2024:08:53:32 +1100", None, None, us(2024, 10, 16, 21, 53, 32)),
    ("Sun, 01 Sep 2024 06:18:42 +0200", None, None, us(2024, 9, 1, 4, 18, 42)),
    ("03-Nov-2024 02:46:22.773", "America/New_York", "dmy", us(2024, 11, 3, 2, 46, 22, 773000, NEW_YORK)),
    ("08/09/2024 05:25:15 PM", "America/New_York", "mdy", us(2024, 8, 9, 17, 25, 15, 0, NEW_YORK)),
    ("08/09/2024 12:25:15 AM", "UTC", "dmy", us(2024, 9, 8, 0, 25, 15)),
    ("07/06/24 23:53:37", "Europe/Berlin", "dmy", us(2024, 6, 7, 23, 53, 37, 0, BERLIN)),
    ("24/06/07 23:53:37", "Europe/Berlin", "ymd", us(2024, 6, 7, 23, 53, 37, 0, BERLIN)),
    ("05.11.2024 16:15:20", "Asia/Kolkata", "dmy", us(2024, 11, 5, 10, 45, 20)),
    ("2025/02/18 08:06:38 AM", "Asia/Kathmandu", "ymd", us(2025, 2, 18, 2, 21, 38)),
    ("2024-07-25 19:55:10 CEST", "UTC", None, us(2024, 7, 25, 17, 55, 10)),
    ("2024-07-25 19:55:10 BST", "UTC", None, us(2024, 7, 25, 18, 55, 10)),
    ("2024-01-25 19:55:10 CST", "UTC", None, us(2024, 1, 26, 1, 55, 10)),
    ("2024-10-27 02:30:00", "Europe/Berlin", None, us(2024, 10, 27, 0, 30)),  # twice: the earlier
    ("2024-03-31 02:30:00", "Europe/Berlin", None, us(2024, 3, 31, 1, 30)),  # skipped: the offset before
    ("Dec 31 23:59:50", "UTC", None, us(2024, 12, 31, 23, 59, 50)),
    ("Feb 29 10:00:00", "UTC", None, us(2024, 2, 29, 10)),
    ("1732891526", None, None, 1732891526000000),
    ("1734466458.5820849", None, None, 1734466458582084),
    ("1724633181107", None, None, 1724633181107000),
    ("1713588678721208", None, None, 1713588678721208),
    ("1721518020170096814", None, None, 1721518020170096),
    ("2024-02-30 10:00:00", "UTC", None, None),
    ("2024-02-03 24:00:00", "UTC", None, None),
    ("2024-02-03 23:60:00", "UTC", None, None),
    ("2024-02-03 13:00:00 PM", "UTC", None, None),
    ("2024-10-2", "UTC", "ymd", None),
    ("2024-02-03 10:00:00 XYZ", "UTC", None, None),
    ("2024-02-03 10:00:00", "No/Where", None, None),
    ("2024-02-03 10:00:00", None, None, None),
    ("05.11.2024 16:15:20", "UTC", None, None),
    ("now", "UTC", None, None), ("", "UTC", None, None), ('" "', "UTC", None, None), (None, "UTC", "dmy", None),
    ("2024-02-03 10:00:00" + "0" * 200_000, "UTC", None, None),
    ("2024-05-01T12:00:00." + "123456789" * 9 + "Z", None, None, us(2024, 5, 1, 12, 0, 0, 123456)),
    (" " * 500 + "2024-05-01" + " " * 70 + "12:00:00" + " " * 900, "UTC", None, us(2024, 5, 1, 12)),
    ("1734466458." + "9" * 70, None, None, 1734466458999999),
    ("1734466458123.9999", None, None, 1734466458123999),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(CASES)], "k int, epoch_us string, tz string, o string")
    return df.withColumn("received", F.lit("2025-01-01 00:10:00").cast("timestamp"))


def test_cases(rows):
    got = {r.k: r.out for r in normalize_timestamps(rows, "epoch_us", "received", "tz", "o", "out").collect()}
    assert {CASES[k][0]: v for k, v in got.items() if v != CASES[k][3]} == {}


def test_filter_stays_above_and_columns_keep_their_order(rows):
    out = normalize_timestamps(rows.withColumn("__ts_x", F.lit(1)), "epoch_us", "received", "tz", "o", "out")
    assert out.columns == [*rows.columns, "__ts_x", "out"]
    assert out.where("out is not null").count() == sum(c[3] is not None for c in CASES)


def test_no_year_without_reception_and_empty_table(spark, rows):
    none = rows.withColumn("received", F.lit(None).cast("timestamp")).where("epoch_us = 'Dec 31 23:59:50'")
    assert [r.out for r in normalize_timestamps(none, "epoch_us", "received", "tz", "o", "out").collect()] == [None]
    assert normalize_timestamps(rows.limit(0), "epoch_us", "received", "tz", "o", "out").count() == 0


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(
    st.tuples(
        st.datetimes(datetime(2001, 1, 1), datetime(2037, 1, 1)),
        st.sampled_from(["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kathmandu"])
    ),
    min_size=1, max_size=30
))
def test_zones_against_python(spark, times):
    df = spark.createDataFrame([(k, t.strftime("%d/%m/%Y %H:%M:%S") + f".{t.microsecond:06d}", z) for k, (t, z) in enumerate(times)], "k int, t string, z string")
    df = df.withColumn("r", F.current_timestamp()).withColumn("o", F.lit("dmy"))
    got = {r.k: r.epoch_us for r in normalize_timestamps(df, "t", "r", "z", "o").collect()}
    want = {
        k: (t.replace(tzinfo=ZoneInfo(z), fold=0) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1) for k,
        (t, z) in enumerate(times)
    }
    assert got == want
