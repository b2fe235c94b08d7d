import pytest
from pyspark.sql import functions as F

from conftest import rows
from kinetra.operators.wide_table import cells, frame_table, typed, wide_table

SCHEMA = "e string, a string, v string, n int"


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        ("1,5", "double", 1.5), (' "+2.5e1" ', "double", 25.0), ("1.2.3", "double", None), ("nan", "double", None), ("1e999", "double", None), ("", "double", None), ("59s?", "double", None), (".5", "double", 0.5),
        ("007", "int", 7), ("-3", "int", None), ("99999999999", "int", None), ("1.0", "int", None),
        ("oK ", "flag", True), ("1", "flag", True), ("INVALID", "flag", False), ("　", "flag", None), (None, "flag", None),
        (" ", "string", None), ("none", "string", "none"),
        ("1 " * 16, "matrix", [1.0] * 16), ("1 " * 15, "matrix", None), ("1 " * 15 + "x", "matrix", None), ("1\t" * 15 + "-2,5", "matrix", [1.0] * 15 + [-2.5]),
    ],
)
def test_typed(spark, text, kind, want):
    got = spark.createDataFrame([(text,)], "v string").select(typed(F.col("v"), kind)).first()[0]
    assert got == want


def wide(spark, data, block=64, **attributes):
    df = spark.createDataFrame(data, SCHEMA)
    return wide_table(df, ["e"], F.col("a"), F.col("v"), F.col("n"), attributes, block=block)


def test_highest_line_stands_readable_or_not(spark):
    data = [("x", "Depth_Mm", "1", 1), ("x", "depth mm", "2", 3), ("x", "DEPTH-MM", "bad", 2), ("y", "DepthMm", "4", 1), ("y", "depthmm", None, 9), ("y", "other", "1", 1)]
    assert rows(wide(spark, data, DepthMm="double")) == [("x", 2.0), ("y", None)]


def test_blocks_agree_with_one_pivot(spark):
    data = [(f"e{i % 13}", f"a{i % 29}", str(i), i) for i in range(600)] + [("only", "unknown", "1", 1), (None, "a1", "1", 1), ("e1", None, "1", 1)]
    kinds = {f"a{k}": "int" for k in range(29)}
    one, many = (rows(wide(spark, data, block=b, **kinds)) for b in (64, 5))
    assert one == many
    assert len(one) == 14


def test_blocks_need_no_further_shuffle(spark):
    data = [("e", f"a{k}", "1", 1) for k in range(9)]
    plan = wide(spark, data, block=3, **{f"a{k}": "int" for k in range(9)})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2
    # each block's input is the same pair of exchanges: by entity and attribute, then by entity
    assert plan.count("Exchange hashpartitioning(_e0") == 2 * 3


def test_frames(spark):
    data = [
        (1, 1, "header", "Dim_Size", "4 4 2"), (1, 2, "Seq_Frame0000", "Timestamp", "0.5"), (1, 3, "seq-frame 1", "TIMESTAMP", "x"), (1, 4, "Seq_Frame0002", "Timestamp", "9"),
        (2, 1, "Seq_Frame7", "FreezeOn", "OK"), (2, 2, "Header", "DimSize", "broken"), (None, 1, "Seq_Frame0", "Timestamp", "1"), (3, 1, "Header", "DimSize", "1 1 1"),
    ]
    df = spark.createDataFrame(data, "sequence_id bigint, line_no int, entity string, attribute string, attr_value string").withColumn("frame_id", F.lit("clash"))
    got = frame_table(df)
    assert rows(got.select("sequence_id", "frame_id", "Timestamp")) == [(1, 0, 0.5), (1, 1, None), (2, 7, None)]
    assert rows(cells(got, ["sequence_id", "frame_id"])) == [(1, 0, "Timestamp"), (2, 7, "FreezeOn")]
    assert frame_table(df.limit(0)).count() == 0


def test_a_query_gives_all_numbers_of_the_matrices(spark):
    from kinetra.plans.catalog import queries

    got = queries()["p5_table"](spark, "/root/testdata/sf0.001").where("ProbeToTrackerDeviceTransform is not null").collect()
    assert got and all(len(r.ProbeToTrackerDeviceTransform) == 16 for r in got)
