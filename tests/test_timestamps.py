"""Parsing of printed times, and the dictionary operator around it."""

import calendar
from datetime import datetime, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstream.functions.timestamps import parse_epoch
from inkstream.operators.instants import extend_dictionary, normalise_instants, page_times

UTC = lambda *a: calendar.timegm(datetime(*a).timetuple())


@pytest.mark.parametrize(
    ("raw", "zone", "order", "want"),
    [
        ("2025-07-01 12:00:00", "Asia/Dhaka", "dmy", UTC(2025, 7, 1, 6)),
        (" \t2025-07-01T12:00:00.999999999Z\n", None, None, UTC(2025, 7, 1, 12)),
        ("20250701T120000Z", None, None, UTC(2025, 7, 1, 12)),
        ("2025-07-01T12:00:00+05:30", None, None, UTC(2025, 7, 1, 6, 30)),
        ("2025-07-01T12:00:00-04", None, None, UTC(2025, 7, 1, 16)),
        ("03/04/2025 10:00", "Europe/London", "dmy", UTC(2025, 4, 3, 9)),
        ("03/04/2025 10:00 PM", "America/New_York", "mdy", UTC(2025, 3, 5, 3)),
        ("03.02.2025 01:20", "Europe/Berlin", "dmy", UTC(2025, 2, 3, 0, 20)),
        ("13/13/2025 10:00", "Europe/London", "dmy", None),
        ("২৩ ফেব্রুয়ারি ২০২৬, ১৭:৫৩", "Asia/Dhaka", "dmy", UTC(2026, 2, 23, 11, 53)),
        ("1 avril 2026 à 00h42", "Europe/Paris", "dmy", UTC(2026, 3, 31, 22, 42)),
        ("10. Juli 2025, 10:00 Uhr", "Europe/Berlin", "dmy", UTC(2025, 7, 10, 8)),
        ("12 de diciembre de 2025, 21:05 h", "Europe/Madrid", "dmy", UTC(2025, 12, 12, 20, 5)),
        ("Thu, 30 Oct 2025 13:37:19 GMT", "Asia/Dhaka", "dmy", UTC(2025, 10, 30, 13, 37, 19)),
        ("Sun 19 April 2026 14.07", "Europe/London", "dmy", UTC(2026, 4, 19, 13, 7)),
        ("January 3, 2025 at 2:34 a.m. EST", "America/New_York", "mdy", UTC(2025, 1, 3, 7, 34)),
        ("June 26, 2026 at 1:39 a.m. BST", "Asia/Dhaka", "dmy", UTC(2026, 6, 25, 19, 39)),
        ("June 26, 2026 at 1:39 a.m. BST", "Europe/London", "dmy", UTC(2026, 6, 26, 0, 39)),
        ("1747923232.121074", None, None, 1747923232),
        ("1738950442089", None, None, 1738950442),
        # a local time that occurs twice is the earlier instant; one that is skipped has the offset before the change
        ("2025-11-02 01:30:00", "America/New_York", "mdy", UTC(2025, 11, 2, 5, 30)),
        ("2025-03-09 02:30:00", "America/New_York", "mdy", UTC(2025, 3, 9, 7, 30)),
        ("2025-04-06 02:30:00", "Australia/Sydney", "dmy", UTC(2025, 4, 5, 15, 30)),
        ("2025-01-01 24:00:00", "Europe/London", "dmy", UTC(2025, 1, 2)),
        *[(x, "Europe/London", "dmy", None) for x in (None, "", "  ", "null", "yesterday", "2 hours ago", "25:61", "2026-02-30T08:15:00Z", "0000-00-00 00:00:00", "2025-01-01", "x" * 100_000, "9" * 40)],
        ("2025-07-01 12:00:00", None, None, None),
        ("2025-07-01 12:00:00", "No/Where", None, None),
    ],
)
def test_parse(raw, zone, order, want):
    assert parse_epoch(raw, zone, order) == want


@settings(max_examples=60, deadline=None)
@given(st.datetimes(datetime(1980, 1, 1), datetime(2035, 1, 1)), st.sampled_from(["%Y-%m-%dT%H:%M:%SZ", "%d %B %Y %H:%M:%S UTC", "%a, %d %b %Y %H:%M:%S +0000", "%B %d, %Y %H:%M:%S GMT"]))
def test_round_trip(at, shape):
    at = at.replace(microsecond=0)
    assert parse_epoch(at.strftime(shape), None, None) == at.replace(tzinfo=timezone.utc).timestamp()


def test_dictionary_is_incremental(spark):
    schema = "id int, raw string, tz_name string, date_order string, epoch_s string"
    rows = spark.createDataFrame(
        [(1, "2025-07-01T12:00:00Z", None, None, "x"), (2, " 2025-07-01T12:00:00Z", None, None, None), (3, None, "Asia/Dhaka", "dmy", None), (4, "N/A", None, None, None)], schema
    )
    first = extend_dictionary(rows)
    assert sorted((r.raw, r.epoch_s) for r in first.collect()) == [("2025-07-01T12:00:00Z", 1751371200), ("N/A", None)]
    assert extend_dictionary(rows, first).count() == 0
    found = {r.id: r.epoch_s for r in normalise_instants(rows, first).collect()}
    assert found == {1: 1751371200, 2: 1751371200, 3: None, 4: None}
    assert extend_dictionary(rows.limit(0)).count() == 0


def test_page_times_counts_a_delivery_once(spark):
    extracted = spark.createDataFrame([(1, "a", None), (2, "b", "c"), (None, "d", None)], "page_id long, published_at string, updated_at string")
    pages = spark.createDataFrame([(1, "s"), (1, "s"), (2, None)], "page_id long, source_slug string")
    sources = spark.createDataFrame([("s", "BD"), ("t", None)], "slug string, country string")
    locales = spark.createDataFrame([("BD", "Asia/Dhaka", "dmy")], "country string, tz_name string, date_order string")
    got = sorted(page_times(extracted, pages, sources, locales).collect(), key=str)
    assert [(r.page_id, r.field_name, r.tz_name) for r in got if r.page_id == 1] == [(1, "published_at", "Asia/Dhaka")]
    assert len(got) == 4
