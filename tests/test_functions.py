from datetime import datetime

import pytest
from pyspark.sql import functions as F

from termloom.functions import fuzzy, similarity, text
from termloom.functions import normalize as N
from termloom.operators.context_types import parse_date, parse_int, parse_position


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_zero_fill(spark):
    rows = ["1", "-1", "9223372036854775807", "-9223372036854775808", "+5", "0", "-0", "x", None, "9223372036854775808"]
    filled = values(spark, N.zero_fill, rows)
    assert filled[:4] == ["100000000000000000001", "000000000000000000001", "109223372036854775807", "009223372036854775808"]
    assert filled[4:] == ["100000000000000000005", "1" + "0" * 20, "1" + "0" * 20, None, None, None]
    assert values(spark, lambda c: N.zero_fill_value(N.zero_fill(c)), rows) == ["1", "-1", rows[2], rows[3], "5", "0", "0", None, None, None]


DATES = {
    "2013-01-01": datetime(2013, 1, 1),
    "2013-01": datetime(2013, 1, 1),
    "2013": datetime(2013, 1, 1),
    "2013-02-30": datetime(2013, 2, 28),
    "2013-01-01T10:20:30": datetime(2013, 1, 1, 10, 20, 30),
    "2013-01-01T10:20:30Z": datetime(2013, 1, 1, 10, 20, 30),
    "2013-01-01T00:20:00+01:00": datetime(2012, 12, 31, 23, 20),
    "2013-01-01T23:20:00-02:00": datetime(2013, 1, 2, 1, 20),
    "--05-06": datetime(1, 5, 6),
    "--05": datetime(1, 5, 1),
    "---07": datetime(1, 1, 7),
    "2013-13-01": None,
    "13-01-01": None,
    "": None,
}


def test_dates(spark):
    rows = list(DATES)
    assert values(spark, N.date_key, rows) == list(DATES.values())
    assert [parse_date(r) for r in rows] == list(DATES.values())
    assert values(spark, N.date_normal, ["2013-01-01T10:20:30"]) == ["20130101102030"]
    assert values(spark, lambda c: N.date_denormal(N.date_normal(c)), ["2013-01-01"]) == ["2013-01-01 00:00:00"]
    assert values(spark, N.date_shape, ["2013", "--05", "x"]) == ["gYear", "gMonth", None]
    assert values(spark, N.show_time_zone, [0, 90, -330], "int") == ["Z", "+01:30", "-05:30"]


def test_positions(spark):
    rows = ["53.6-10.0", "-53.60000--10.5", "1-1", "90-1", "1-180", "89.99-179.99", "x", None]
    assert values(spark, N.is_position, rows) == [True, True, True, False, False, True, False, False]
    assert values(spark, lambda c: N.position_denormal(N.position_normal(c)), rows[:2]) == ["53.6000000-10.0000000", "-53.6000000--10.5000000"]
    assert len(values(spark, N.position_normal, rows)[0]) == 64
    assert parse_position("53.6-10.0") == (53.6, 10.0) and parse_position("90-1") is None
    assert parse_int("-7") == -7 and parse_int("9223372036854775808") is None and parse_int("x") is None


def test_scanning(spark):
    assert values(spark, lambda c: text.scan(c, r"\w*"), ["w1 w2_x ü-y", "", None]) == [["w1", "w2", "x", "ü", "y"], [], []]
    day = "[0-9]{4}-((0[1-9])|(1[0-2]))-((0[1-9])|([12][0-9])|(3[01]))"
    assert [len(x) for x in values(spark, lambda c: text.scan(c, day), ["w1 w2 w3", "2013-01-01", "2013-01-01 asd 2012-12-31", "2013-01"])] == [0, 1, 2, 0]
    assert values(spark, lambda c: text.limit_length(c, 5), ["abcdefgh", "abc"]) == ["ab...", "abc"]


@pytest.mark.parametrize(("searched", "found", "score"), [("this", "this", 1.0), ("this", "This", 0.75), ("ab", "abcd", 0.25), ("abc", "ab", 0.0)])
def test_similarity(spark, searched, found, score):
    assert values(spark, lambda c: similarity.similar(searched, c), [found]) == [score]


def test_number_similarity(spark):
    assert values(spark, lambda c: similarity.similar_int(0, c), [0, 1], "int")[0] == 1.0
    assert abs(values(spark, lambda c: similarity.similar_range_int(10, 20, c), [16], "int")[0] - 2.718281828459045 ** (-1 / 4.5)) < 1e-9


def test_fuzzy():
    forms = fuzzy.fuzz("letter")
    assert "leter" in forms and "letter" not in forms and max(forms.values()) <= 1.0
    assert fuzzy.fuzz("ab", fuzzy.FuzzyConfig(replace=False)) == {"ba": 1.0}
    assert fuzzy.fuzz("") == {}
    costs = [c for _, c in fuzzy.by_cost(forms)]
    assert costs == sorted(costs)
    assert "fuer" in fuzzy.fuzz("für", fuzzy.FuzzyConfig(swap=False, pairs=fuzzy.GERMAN))
