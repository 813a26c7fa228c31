"""Joins by time against brute force: ties, edges of bins, hot keys, nulls, empty tables."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from tideloom.operators import in_force, within

START = datetime(2024, 1, 1)
REQUESTS, HISTORY = "k string, n int, at timestamp", "k string, since timestamp, a int, b string"


def _times(seed: int, n: int) -> list[datetime]:
    draw = random.Random(seed)
    return [START + timedelta(hours=draw.randrange(-400, 400)) for _ in range(n)]


def _key(i: int) -> str | None:
    return None if i % 17 == 0 else "hot" if i % 3 else f"k{i % 5}"


@pytest.fixture(scope="module")
def sides():
    requests = [(_key(i), i, None if i % 19 == 0 else t) for i, t in enumerate(_times(1, 200))]
    history = [(_key(i + 4), None if i % 23 == 0 else t, None if i % 7 == 0 else i % 11, f"v{i % 6}") for i, t in enumerate(_times(2, 150))]
    return requests + requests[:3], history + history[:5]


@pytest.mark.parametrize("hours", [1, 24, 10_000])
def test_in_force_by_brute_force(spark, sides, hours):
    requests, history = sides
    found = in_force(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(history, HISTORY), ["k"], "at", "since", ["a", "b"], hours * 3600)
    expected = []
    for k, n, at in requests:
        earlier = [(since, a is not None, a or 0, b, a) for key, since, a, b in history if None not in (k, at, since) and key == k and since <= at]
        *_, b, a = max(earlier, default=(None, None))
        expected.append((k, n, at, a, b))
    assert found.columns == ["k", "n", "at", "a", "b"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))


@pytest.mark.parametrize("hours, group_rows", [(1, 100), (24, 2), (10_000, 7)])
def test_within_by_brute_force(spark, sides, hours, group_rows):
    requests, history = sides
    spans = [(k, since, None if since is None else since + timedelta(hours=(a or 0) * 24 - 24)) for k, since, a, _ in history]
    found = within(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(spans, "k string, begin timestamp, finish timestamp"), ["k"], "at", "begin", "finish", hours * 3600, group_rows)
    expected = [(k, n, at, begin, end) for k, n, at in requests for key, begin, end in spans if None not in (k, at, begin) and k == key and begin <= at < end]
    assert expected and sorted(map(str, map(tuple, found.select("k", "n", "at", "begin", "finish").collect()))) == sorted(map(str, expected))


def test_joins_by_time_of_empty_tables(spark, sides):
    requests, history = spark.createDataFrame(sides[0], REQUESTS), spark.createDataFrame(sides[1], HISTORY)
    none = in_force(requests, history.where("false"), ["k"], "at", "since", ["a"])
    assert none.count() == requests.count() and none.where("a IS NOT NULL").isEmpty()
    assert in_force(requests.where("false"), history, ["k"], "at", "since", ["a"]).isEmpty()
    assert within(requests.where("false"), history.withColumn("finish", history.since), ["k"], "at", "since", "finish").isEmpty()
