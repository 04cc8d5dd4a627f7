"""JSON columns without a declared shape."""

from __future__ import annotations

from slotwise.operators import documents as D
from tests.conftest import rows


def frame(spark, column, *texts):
    return spark.createDataFrame(list(enumerate(texts)), f"id LONG, {column} STRING")


def test_payment_metadata_of_all_shapes(spark):
    df = frame(
        spark, "metadata", '{"provider":"toss","card":{"brand":"visa","installments":"12"},"fees":[1,null,2.0]}', '{"card":"none","fees":7}',
        '{"provider":5,"card":{"installments":"many"}}', "[]", "null", '"text"', "", "{", None, '{"provider":"a","provider":"b"}',
        '{"point":{"used":3},"fees":[]}',
    )
    got = {r.id: tuple(r)[1:] for r in D.payment_details(df).collect()}
    assert got[0] == ("toss", "visa", 12, None, 3, True)
    assert got[1] == (None,) * 5 + (True,)
    assert got[2] == ("5", None, None, None, None, True)
    assert all(got[i] == (None,) * 5 + (True,) for i in (3, 4, 5, 8))
    assert all(got[i] == (None,) * 5 + (False,) for i in (6, 7, 9))
    assert got[10] == (None, None, None, 3, 0, True)


def test_opening_hours_of_all_shapes(spark):
    df = frame(
        spark, "operating_hours", '{"mon":{"open":"9:30","close":"18:00","break":["12:00","13:00"]},"TUE":"10:00-20:15","wed":null,"thu":{},"holiday":"1:00-2:00"}',
        '{"fri":{"open":"25:00","close":"26:00"},"sat":"closed","sun":{"open":"00:00","close":"24:00"}}', "[1]", "{", None, "{}",
    )
    got = rows(D.opening_hours(df).select("shop_id", "day_of_week", "is_open", "open_minute", "close_minute", "break_start_minute", "break_end_minute"))
    assert got == [
        (0, 1, True, 570, 1080, 720, 780), (0, 2, True, 600, 1215, None, None), (0, 3, False, None, None, None, None),
        (0, 4, False, None, None, None, None), (1, 0, True, 0, 1440, None, None), (1, 5, False, None, None, None, None),
        (1, 6, False, None, None, None, None),
    ]


def test_leaves_drift_and_merged_schema(spark):
    df = frame(spark, "doc", '{"a":{"b":{"c":1}},"d":[{"e":1}]}', '{"a":{"b":{"c":"x"}}}', '{"a":{"b":2}}', "3", "{}", "null", None, "nope")
    got = rows(D.leaves(df, "doc", "id").select("id", "path", "kind", "value"))
    assert got == [
        (0, "a.b.c", "BIGINT", "1"), (0, "d", "ARRAY<OBJECT<e: BIGINT>>", '[{"e":1}]'), (1, "a.b.c", "STRING", "x"), (2, "a.b", "BIGINT", "2"),
        (3, "", "BIGINT", "3"), (4, "", "OBJECT<>", "{}"), (5, "", "VOID", None),
    ]
    shallow = rows(D.leaves(df.limit(1), "doc", depth=1).select("path", "kind"))
    assert shallow == [("a", "OBJECT<b: OBJECT<c: BIGINT>>"), ("d", "ARRAY<OBJECT<e: BIGINT>>")]
    assert ("a.b.c", "BIGINT", 1) in rows(D.field_kinds(df, "doc")) and ("a.b.c", "STRING", 1) in rows(D.field_kinds(df, "doc"))
    agreed = frame(spark, "doc", '{"a":1,"b":"x"}', '{"a":2}', '{"c":[1]}', "nope", '{"b":5}')
    assert D.merged_schema(agreed, "doc").first().schema == "OBJECT<a: BIGINT, b: VARIANT, c: ARRAY<BIGINT>>"


def test_nothing_to_read(spark):
    none = frame(spark, "metadata").withColumnRenamed("metadata", "operating_hours")
    assert D.opening_hours(none).collect() == []
    assert D.payment_details(frame(spark, "metadata")).collect() == []
    assert D.field_kinds(frame(spark, "doc"), "doc").collect() == []
