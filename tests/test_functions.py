import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rivulet import functions as R
from rivulet.functions.json import edit_append, edit_delete, edit_extend, edit_set, edited


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("now", "2024-03-14 15:09:26"), ("-1d@d", "2024-03-13 00:00:00"), ("+1mon@month", "2024-04-01 00:00:00"), ("-2wk", "2024-02-29 15:09:26"),
        ("@w", "2024-03-10 00:00:00"), ("@w1", "2024-03-11 00:00:00"), ("@q", "2024-01-01 00:00:00"), ("-h@h", "2024-03-14 14:00:00"), ("+y", "2025-03-14 15:09:26"),
    ],
)
def test_relative_timestamp(spark, text, want):
    now = F.lit("2024-03-14 15:09:26").cast("timestamp")
    assert str(one(spark, R.relative_timestamp(text, now).cast("timestamp_ntz"))) == want


def test_relative_timestamp_refuses_unknown_units():
    with pytest.raises(ValueError):
        R.relative_timestamp("-1fortnight")


def test_earliest_and_latest(spark):
    now, at = F.lit("2024-03-14 00:00:00").cast("timestamp"), F.lit("2024-03-13 00:00:00").cast("timestamp")
    assert one(spark, R.earliest("-2d", at, now)) and not one(spark, R.latest("-2d", at, now))


def test_ip(spark):
    df = spark.createDataFrame([("192.168.1.7",), ("10.0.0.1",), (None,)], "ip string")
    assert [r[0] for r in df.select(R.cidrmatch("ip", "192.168.0.0/16")).collect()] == [True, False, None]
    v6 = spark.createDataFrame([("2003:db8::1",), ("2009:db8::1",)], "ip string")
    assert [r[0] for r in v6.select(R.cidrmatch("ip", "2003:db8::/32")).collect()] == [True, False]
    mixed = spark.createDataFrame([("1.2.3.4",), ("::5",), ("nothing",), (None,)], "ip string")
    assert [None if r[0] is None else int(r[0]) for r in mixed.select(R.ip_to_int("ip")).collect()] == [16909060, 5, None, None]
    with pytest.raises(Exception, match="not an IPv4"):
        mixed.select(R.cidrmatch("ip", "1.0.0.0/8")).collect()


def test_json_edits(spark):
    df = spark.createDataFrame([('{"a":{"b":1},"l":[1]}',), ("[1]",), ("no",), (None,)], "j string")
    get = lambda c: [r[0] for r in df.select(c).collect()]
    assert get(R.json_set("j", "a.c", "2"))[0] == '{"a":{"b":1,"c":2},"l":[1]}' and get(R.json_set("j", "x", "2"))[1:] == [None] * 3
    assert get(R.json_delete("j", "a.b", "q.r"))[0] == '{"a":{},"l":[1]}'
    assert get(R.json_append("j", "l", "[2,3]"))[0] == '{"a":{"b":1},"l":[1,[2,3]]}'
    assert get(R.json_extend("j", "l", "[2,3]"))[0] == '{"a":{"b":1},"l":[1,2,3]}'
    assert get(R.json_valid("j")) == [True, True, False, None] or get(R.json_valid("j"))[0] is True
    assert edited('{"l":[{"x":1},{"x":2}]}', ["l.x"], edit_delete) == '{"l":[{},{}]}'


@given(st.dictionaries(st.sampled_from("abc"), st.integers() | st.lists(st.integers())), st.sampled_from("abc"), st.integers())
def test_json_edits_keep_the_rest(doc, key, value):
    import json

    for edit in (edit_set, edit_append, edit_extend):
        new = json.loads(edited(json.dumps(doc), [key, str(value)], edit))
        assert {k: v for k, v in new.items() if k != key} == {k: v for k, v in doc.items() if k != key}
    assert key not in json.loads(edited(json.dumps(doc), [key], edit_delete))


def test_values(spark):
    assert one(spark, R.cast(F.lit("abc"), "integer")) is None
    assert one(spark, R.truncate(F.lit(-2.59), 1)) == -2.5
    assert one(spark, R.modulus(F.lit(5), F.lit(0))) is None and one(spark, R.divide(5, 0)) is None
    assert one(spark, R.strcmp(F.lit("a"), F.lit("b"))) == -1
    assert one(spark, R.isempty(F.lit(None).cast("string"))) is True and one(spark, R.isblank(F.lit("  "))) is True
    with pytest.raises(ValueError):
        R.cast("x", "geometry")


@pytest.mark.parametrize(("x", "digits", "want"), [(1.15, 2, 1.15), (-1.15, 1, -1.1), (1e18, 2, 1e18), (1e300, 0, 1e300), (1234.5, -2, 1200.0), (0.3, 1, 0.3), (8.2, 1, 8.2)])
def test_truncation_is_decimal(spark, x, digits, want):
    assert one(spark, R.truncate(F.lit(x), digits)) == want


def test_if_and_makedate_by_name(spark):
    from rivulet.functions.catalogue import function

    assert one(spark, function("if")(F.lit(1) > 2, "a", F.lit("b"))) == "b"
    assert str(one(spark, function("makedate")(2023, 366))) == "2024-01-01" and one(spark, function("makedate")(2023, 0)) is None


def test_dates(spark):
    d = F.lit("2020-02-29").cast("date")
    assert one(spark, R.date_add(d, 1, "year")) == datetime.date(2021, 2, 28)
    assert one(spark, R.date_sub(d, 1, "week")) == datetime.date(2020, 2, 22)
    assert one(spark, R.monthname(d)) == "February" and one(spark, R.dayname(d)) == "Saturday"
    assert one(spark, R.timestampdiff("hour", F.lit("2020-01-01").cast("timestamp"), F.lit("2020-01-02").cast("timestamp"))) == 24
    assert str(one(spark, (F.lit("2020-01-01").cast("timestamp") + R.interval(3, "millisecond")).cast("timestamp_ntz"))) == "2020-01-01 00:00:00.003000"
    assert one(spark, R.utc_timestamp()) is not None


def test_every_name_has_a_function():
    from rivulet.functions.catalogue import NAMES, function

    assert all(callable(function(n)) for names in NAMES.values() for n in names.split())
    assert function("DATE_ADD") is R.date_add
    with pytest.raises(ValueError):
        function("addtime")
