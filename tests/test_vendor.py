"""Vendor requests, screeners and settings."""

from datetime import date

import pytest

from strandline.sources import vendor


def days(r):
    return (r.trade_to - r.trade_from).days + 1


def test_requests_are_split_until_they_fit_and_cover_every_day_once():
    whole = vendor.OptionsRequest("A", date(2024, 1, 1), date(2024, 1, 31))
    parts = vendor.planned_requests(whole, lambda r: 100 * days(r), 500)
    assert all(days(r) <= 5 for r in parts) and sum(map(days, parts)) == 31
    assert all((b.trade_from - a.trade_to).days == 1 for a, b in zip(parts, parts[1:]))


def test_a_request_that_cannot_shrink_is_refused():
    with pytest.raises(ValueError):
        vendor.planned_requests(vendor.OptionsRequest("A", date(2024, 1, 1), date(2024, 1, 1)), lambda r: 10, 5)


def test_strikes_are_split_without_gap_or_overlap():
    a, b = vendor.split_request(vendor.OptionsRequest("A", strike_from=10.0, strike_to=20.0))
    assert a.strike_to == 15.0 and 15.0 < b.strike_from < 15.0001 and b.strike_to == 20.0


def test_pages_are_fetched_until_the_limit_or_an_empty_one(spark):
    asked = []

    def fetch(size, offset):
        asked.append((size, offset))
        return "[" + ",".join(f'{{"code": "S{i}", "exchange": "X"}}' for i in range(offset, min(offset + size, 130))) + "]"

    page = vendor.PAGE_ROWS
    got = vendor.fetch_screener(spark, fetch, 3 * page, 10)
    assert {r.symbol for r in got.collect()} == {f"S{i}" for i in range(130)}
    assert [o for _, o in asked] == [i * page for i in range(len(asked))]
    assert vendor.fetch_screener(spark, fetch, 7, 10).count() == 7
    with pytest.raises(ValueError):
        vendor.fetch_screener(spark, fetch, 0, 1)
