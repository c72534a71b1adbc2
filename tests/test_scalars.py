import datetime as dt
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from callboard.functions import scalars as S


def one(df, *columns):
    got = df.select(*columns).collect()
    return [r[0] if len(r) == 1 else tuple(r) for r in got]


def test_full_name_is_null_if_a_part_is(make):
    names = make([("Ann", "Lee"), (None, "Lee")], "a string, b string")
    assert one(names, S.full_name("a", "b")) == ["Ann Lee", None]


def test_message_fills_gaps_and_checks_their_number(make):
    df = make([(3, "Good")], "id int, state string")
    assert one(df, S.message("Item {} is {}!", "id", "state")) == ["Item 3 is Good!"]
    with pytest.raises(ValueError):
        S.message("{} and {}", "id")


def test_roi_of_zero_null_and_tiny_budgets(make):
    films = make(
        [("30", "10"), ("5", "0"), ("5", None), (None, "8"), ("99999999.99", "0.01"), ("1", "-4"), ("10.01", "8.00")],
        "gross decimal(15,2), budget decimal(15,2)",
    )
    assert one(films, S.roi("gross", "budget")) == [
        Decimal(x) for x in ("200.00", "0.00", "500.00", "-100.00", "999999999800.00", "0.00", "25.13")
    ]


def test_age_ignores_the_birthday_and_null_is_zero(make):
    born = make([("2000-12-31",), (None,)], "dob date")
    assert one(born, S.age_or_zero("dob", dt.date(2024, 1, 1))) == [24, 0]
    assert one(born, S.age_or_zero("dob", "2024-01-01")) == [24, 0]


def test_days_count_both_ends_and_cost_follows(make):
    stays = make(
        [("2024-02-28", "2024-03-01", "10"), ("2024-01-02", "2024-01-01", "10"), ("2024-01-01", None, "10")],
        "a date, b date, rate decimal(12,2)",
    )
    assert one(stays, S.inclusive_days("a", "b")) == [3, 0, None]
    assert one(stays, S.stay_cost("a", "b", "rate")) == [Decimal("30.00"), Decimal("0.00"), None]
    assert one(stays, S.end_or_default("a", "b", 7))[2] == dt.date(2024, 1, 8)


def test_split_list_trims_drops_and_dedupes(make):
    lists = make([("Action, Drama,, drama ",), ("",), (None,), ("a.b",)], "g string")
    assert one(lists, S.split_list("g")) == [["Action", "Drama", "drama"], [], None, ["a.b"]]
    assert one(lists, S.split_list("g", collation="UNICODE_CI_AI"))[0] == ["Action", "Drama"]
    assert one(lists, S.split_list("g", "."))[3] == ["a", "b"]


def test_join_list_with_default(make):
    words = make([(1, "b"), (1, "a"), (1, "b"), (2, None)], "k int, w string")
    got = words.groupBy("k").agg(S.join_list("w", default="Drama").alias("l"))
    assert rows(got) == [(1, "a, b"), (2, "Drama")]


def test_money_rounds_ties_to_even(make):
    amounts = make([("1234.50",), ("1235.50",), ("-15000000",), (None,)], "x decimal(15,2)")
    assert one(amounts, S.money("x")) == [f"${Decimal(v):,.0f}" for v in ("1234.50", "1235.50", "-15000000")] + [None]


def test_percent_text(make):
    values = make([("140.005",), ("-3",)], "x decimal(18,3)")
    assert one(values, S.percent("x")) == ["140.00%", "-3.00%"]


def test_numbers_labels_and_times(make):
    df = make([("12.5", "A"), ("n/a", None)], "t string, code string")
    assert one(df, S.try_number("t")) == [12.5, None]
    assert one(df, S.label("code", {"A": "Active"}, "Inactive")) == ["Active", "Inactive"]
    stamp = F.lit(dt.datetime(2024, 5, 6, 7, 8, 9)).cast("timestamp_ntz")
    assert one(df.limit(1), S.to_minute(stamp), S.to_second(stamp)) == [("2024-05-06 07:08", "2024-05-06 07:08:09")]
