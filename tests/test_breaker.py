"""Breakers in set form against a walk over the calls."""

import random
from datetime import datetime, timedelta

import pytest

from altloom.operators import breaker

SCHEMA = "provider string, ts timestamp, attempt_id bigint, success boolean"


def walked(rows, threshold, recovery, good):
    out, states = [], {}
    for provider, ts, number, success in sorted(rows):
        name, failures, successes, last = states.get(provider, ("closed", 0, 0, None))
        before = name
        if name == "open":
            if (ts - last).total_seconds() < recovery:
                continue
            name, successes = "half_open", 0
        if success:
            if name == "half_open":
                successes += 1
                if successes >= good:
                    name, failures = "closed", 0
            else:
                failures = 0
        else:
            failures, last = failures + 1, ts
            if name == "half_open" or failures >= threshold:
                name = "open"
        states[provider] = (name, failures, successes, last)
        if name != before:
            out.append((provider, ts, number, name, f"{before} to {name}"))
    return sorted(out), states


def calls(seed, n, share, step):
    rng, at, rows = random.Random(seed), datetime(2024, 1, 1), []
    for k in range(n):
        at += timedelta(seconds=rng.choice([0, 1, step]))
        rows.append((rng.choice(["a", "a", "a", "b", "c"]), at, k, rng.random() > share))
    return rows


@pytest.mark.parametrize("seed, share, threshold, recovery, good", [(1, 0.6, 3, 60.0, 2), (2, 0.8, 5, 10.0, 1), (3, 0.5, 1, 5.0, 3), (4, 0.3, 2, 0.5, 2), (5, 1.0, 3, 30.0, 2), (6, 0.0, 3, 30.0, 2)])
def test_changes_equal_a_walk(spark, seed, share, threshold, recovery, good):
    rows = calls(seed, 400, share, 20)
    found = breaker.breaker_changes(spark.createDataFrame(rows, SCHEMA), threshold, recovery, good)
    assert sorted(map(tuple, found.collect())) == walked(rows, threshold, recovery, good)[0]


@pytest.mark.parametrize("cut", [150, 300])
def test_state_is_carried_on(spark, cut):
    rows, settings = calls(8, 400, 0.6, 20), (3, 60.0, 2)
    before, after = spark.createDataFrame(rows[:cut], SCHEMA), spark.createDataFrame(rows[cut:], SCHEMA)
    first, opened = breaker.histories(before, *settings)
    states = breaker.state_after(first, opened)
    want = walked(rows[:cut], *settings)[1]
    assert {r.provider: r.state for r in states.collect()} == {p: s[0] for p, s in want.items()}
    second, opened_then = breaker.histories(breaker.recalled(states, 3, 60.0).unionByName(after), *settings)
    found = breaker.changes(first, opened, 2).unionByName(breaker.changes(second, opened_then, 2).filter("attempt_id >= 0"))
    assert sorted(map(tuple, found.collect())) == walked(rows, *settings)[0]


def test_nothing(spark):
    assert breaker.breaker_changes(spark.createDataFrame([], SCHEMA)).count() == 0
