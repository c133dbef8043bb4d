"""Joins on hand-made rows."""

import pytest

from tracelode.operators import joins


@pytest.fixture(scope="module")
def hosts(spark):
    return spark.createDataFrame([("h7", "mail"), ("h8", "web"), ("h9", "dns"), ("", "lost")], "host string, role string")


@pytest.fixture(scope="module")
def alerts(spark):
    return spark.createDataFrame([("h8", "scan"), (" h9 ", "login"), ("h9", "probe"), ("h6", "none"), ("", "blank")], "host string, kind string")


def test_inner_trims_keys_and_skips_empty_ones(hosts, alerts):
    got = joins.join(hosts, alerts, "host", "host")
    assert got.columns == ["host", "role", "right_host", "kind"]
    assert sorted((r.role, r.kind) for r in got.collect()) == [("dns", "login"), ("dns", "probe"), ("web", "scan")]


def test_empty_keys_match_on_request(hosts, alerts):
    got = joins.join(hosts, alerts, "host", "host", match_empty_keys=True)
    assert sorted(r.role for r in got.collect()) == ["dns", "dns", "lost", "web"]


def test_left_keeps_and_fills_unmatched_rows(hosts, alerts):
    got = sorted((r.role, r.kind) for r in joins.join(hosts, alerts, 0, 0, "left", fill="-").collect())
    assert got == [("dns", "login"), ("dns", "probe"), ("lost", "-"), ("mail", "-"), ("web", "scan")]


def test_unknown_kind_is_refused(hosts, alerts):
    with pytest.raises(ValueError):
        joins.join(hosts, alerts, "host", "host", "sideways")


def test_range_join_on_ranges_of_very_different_lengths(spark):
    ranges = [(k * 10, k * 10 + 3, f"s{k}") for k in range(500)] + [(1_000_000, 900_000_000, "wide"), (5_000, 5_000, "one")]
    points = [*range(0, 6000, 7), 999_999, 1_000_000, 450_000_000, 900_000_000, 900_000_001]
    got = joins.range_join(
        spark.createDataFrame([(p,) for p in points], "p bigint"), spark.createDataFrame(ranges, "a bigint, b bigint, name string"), "p", "a", "b"
    ).collect()
    want = [(p, n) for p in points for n in ([x for a, b, x in ranges if a <= p <= b] or [None])]
    assert sorted(((r.p, r.name) for r in got), key=str) == sorted(want, key=str)
