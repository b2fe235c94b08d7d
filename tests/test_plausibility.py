import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from kinetra.operators import plausibility
from kinetra.operators.plausibility import implausible_readings, implausible_transforms

SCHEMA = "id bigint, s string, t bigint, q1 double, q2 double, q3 double, q4 double, x double, most double"


def series(n=400, source="a", first=0, seed=1):
    r, out, x = random.Random(seed), [], 100.0
    for i in range(n):
        x += 0.3
        out.append([first + i, source, i * 100 + r.randrange(50), 0.6 + r.gauss(0, 0.001), 0.2, 0.3, 0.7, x + r.gauss(0, 0.2), 3000.0])
    return out


def found(spark, data):
    df = spark.createDataFrame(data, SCHEMA).withColumn("value", F.lit("clash")).withColumn("_iqr", F.lit(1))
    fields = {"x": (F.col("most"), []), "q1": (F.lit(1.0), ["q2", "q3", "q4"])}
    return {tuple(r) for r in implausible_readings(df, "s", "t", "id", fields).collect()}


def planted():
    data = series()
    for i in (50, 51, 52, 200):
        data[i][7] += 60
    for i in range(120, 130):
        data[i][7] = data[119][7]
    data[300][7] = 5000.0
    for i in range(330, 400):
        data[i][7] += 40  # a lasting move
    for i in range(80, 90):
        for k in (3, 4, 5, 6):
            data[i][k] *= -1  # a joint change of sign
    data[140][3] = 0.8
    data[150][3] = 2.5
    return data


def want():
    return {(i, "x", "spike") for i in (50, 51, 52, 200)} | {(i, "x", "stuck") for i in range(119, 130)} | {(300, "x", "beyond"), (140, "q1", "spike"), (150, "q1", "beyond")}


def test_planted_cases(spark):
    assert found(spark, planted()) == want()


def test_order_repeats_and_other_sources_change_nothing(spark):
    data = planted()
    data += [list(r) for r in data[40:60]] + series(30, "b", 10_000, 5)
    random.Random(3).shuffle(data)
    data += [[None, "a", 1, *[9.0] * 5, 3.0], [77_777, None, 1, *[9.0] * 5, 3.0], [77_778, "a", None, *[9.0] * 5, 3.0], [77_779, "a", 5, None, None, None, None, float("nan"), None]]
    assert found(spark, data) == want()


def test_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(plausibility, "BLOCK", 64)
    assert found(spark, planted()) == want()


def test_empty(spark):
    assert found(spark, []) == set()


EYE = [1.0, 0, 0, 10, 0, 1, 0, 20, 0, 0, 1, 30, 0, 0, 0, 1]


def test_transforms(spark):
    r, data = random.Random(2), []
    for i in range(60):
        m = list(map(float, EYE))
        m[3] += i + r.gauss(0, 0.1)
        data.append([i, "a", i, m, 3000.0])
    data[20][3][7] += 80
    for i in range(40, 49):
        data[i][3] = list(data[39][3])
    data[5][3] = [0.0] * 16
    data[10][3] = None
    data[12][3] = data[12][3][:15]
    data[30][3][3] = 4000.0
    data[33][3][0] = float("nan")
    schema = "id bigint, s string, n int, m array<double>, most double"
    got = rows(implausible_transforms(spark.createDataFrame(data + data[:25], schema), "s", "n", "id", "m", F.col("most")))
    assert got == sorted([(20, "spike"), *[(i, "stuck") for i in range(39, 49)], *[(i, "beyond") for i in (5, 10, 12, 30, 33)]], key=repr)
    assert implausible_transforms(spark.createDataFrame([], schema), "s", "n", "id", "m", F.col("most")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_few_readings(spark, n):
    assert found(spark, series(n)) == set()


def test_whole_source_delivered_often_has_the_same_spikes(spark):
    data = planted()
    once = found(spark, data)
    assert found(spark, data * 8) == once == want()


def test_ends_are_seen_from_one_side(spark):
    data = series()
    data[0][7] += 80
    data[-1][7] -= 80
    assert found(spark, data) == {(i, "x", "spike") for i in (0, 399)}
    data[-2][7] -= 80  # two that agree: a move
    assert found(spark, data) == {(0, "x", "spike")}
    moves = []
    for i in range(40):
        moves.append([i, "a", i, list(map(float, [1, 0, 0, 10 + i + 0.1 * (i % 3), *EYE[4:]])), 3000.0, 1000.0 * i if i % 4 else None])
    moves[0][3][3] += 90
    moves[39][3][7] += 90
    for i in range(20, 39):
        moves[i][3][11] += 300  # a lasting move
    moves[39][3][11] += 300
    df = spark.createDataFrame(moves, "id bigint, s string, n int, m array<double>, most double, ms double")
    assert rows(implausible_transforms(df, "s", "n", "id", "m", F.col("most"), F.col("ms"))) == [(0, "spike"), (39, "spike")]
