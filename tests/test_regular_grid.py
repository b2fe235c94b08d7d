import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import rows
from kinetra.operators.regular_grid import regular_grid

SCHEMA = "k string, t bigint, v double, step int"


def brute(readings, max_gap):
    out = []
    for k in {r[0] for r in readings if r[0] is not None}:
        slots = {}
        for _, t, v, step in sorted((r for r in readings if r[0] == k and None not in r and r[2] == r[2] and abs(r[2]) < float("inf") and r[3] > 0), key=lambda r: (r[1], r[2])):
            slots[t // step * step] = v
        seen = sorted(slots)
        out += [(k, s, slots[s], "observed") for s in seen]
        step = next((r[3] for r in readings if r[0] == k), 1)
        for a, b in zip(seen, seen[1:]):
            for s in range(a + step, b, step):
                short = (b - a) // step - 1 <= max_gap
                out.append((k, s, slots[a] + (slots[b] - slots[a]) * ((s - a) / (b - a)) if short else None, "interpolated" if short else "gap"))
    return out


def close(got, want):
    assert [(g[0], g[1], g[3]) for g in got] == [(w[0], w[1], w[3]) for w in want]
    for g, w in zip(got, want):
        assert g[2] == pytest.approx(w[2])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(-3000, 9000) | st.none(), st.floats(-5, 5) | st.none() | st.just(float("nan"))), max_size=40))
def test_against_brute_force(spark, made):
    readings = [(k, t, v, 100) for k, t, v in made]
    got = regular_grid(spark.createDataFrame(readings, SCHEMA), ["k"], "t", "v", "step", max_gap_steps=3, block_slots=4)
    key = lambda r: (r[0], r[1])
    close(sorted(map(tuple, got.collect()), key=key), sorted(brute(readings, 3), key=key))


def test_long_gap_is_whole_and_repeats_change_nothing(spark):
    readings = [("a", 0, 1.0, 1), ("a", 0, 1.0, 1), ("a", 20_000, 3.0, 1)]
    got = regular_grid(spark.createDataFrame(readings, SCHEMA), ["k"], "t", "v", "step", block_slots=64)
    assert got.count() == 20_001
    assert got.where("state = 'gap'").count() == 19_999


def test_bounds_and_ties(spark):
    readings = [("a", 250, 1.0, 100), ("a", 250, 2.0, 100), ("a", 430, 3.0, 100)]
    bounds = spark.createDataFrame([("a", 0, 610), ("b", 0, 5)], "k string, from_ms bigint, to_ms bigint")
    got = regular_grid(spark.createDataFrame(readings, SCHEMA), ["k"], "t", "v", "step", bounds=bounds)
    assert rows(got) == rows(spark.createDataFrame([("a", 0, None, "outside"), ("a", 100, None, "outside"), ("a", 200, 2.0, "observed"), ("a", 300, 2.5, "interpolated"), ("a", 400, 3.0, "observed"), ("a", 500, None, "outside"), ("a", 600, None, "outside")], "k string, slot_ms bigint, value double, state string"))


def test_empty_and_clashing_names(spark):
    assert regular_grid(spark.createDataFrame([], SCHEMA), ["k"], "t", "v", "step").count() == 0
    df = spark.createDataFrame([("a", 0, 1.0, 10, 5, "x", 7), ("a", 30, 1.0, 10, 5, "x", 7)], SCHEMA + ", slot_ms int, state string, _s int")
    assert rows(regular_grid(df, ["k"], "t", "v", "step").select("slot_ms")) == [(0,), (10,), (20,), (30,)]


def test_unusable_readings(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 0), ("a", 5, 1.0, -3), ("a", None, 1.0, 5), (None, 3, 1.0, 5), ("a", 4, float("inf"), 5), ("a", 4, 1.0, None)], SCHEMA)
    assert regular_grid(df, ["k"], "t", "v", "step").count() == 0
