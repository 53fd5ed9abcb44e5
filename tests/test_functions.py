"""Edge rows of the expression helpers, expected values written by hand."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest

from fleetgauge.functions.arithmetic import half_up_ratio, int_avg, int_div, int_div_or_zero, percent_of
from fleetgauge.functions.clock import boundary_diff, duration_text, hour_bucket, minus_millis
from fleetgauge.functions.text import (
    contains_all,
    job_key_of_program,
    job_key_of_uuid,
    last_name_part,
    literal,
    one_of,
    statement_slice,
    substring_clipped,
)


def evaluate(spark, expression: str, columns: str, *values: tuple) -> list:
    df = spark.createDataFrame(list(values), columns)
    return [r[0] for r in df.selectExpr(expression).collect()]


def test_integer_division_truncates_and_survives_zero(spark):
    got = evaluate(spark, int_div("a", "b"), "a bigint, b bigint", (7, 2), (-7, 2), (1, 0), (None, 1), (1, None))
    assert got == [3, -3, None, None, None]


def test_guarded_division_gives_zero_only_for_a_zero_denominator(spark):
    got = evaluate(spark, int_div_or_zero("a", "b"), "a bigint, b bigint", (7, 2), (5, 0), (0, 0), (5, None))
    assert got == [3, 0, 0, None]


def test_integer_average_truncates_and_skips_null(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "v int")
    assert df.selectExpr(int_avg("v")).collect()[0][0] == 1
    assert df.where("v IS NULL").selectExpr(int_avg("v")).collect()[0][0] is None


@pytest.mark.parametrize(
    "num, den, scale, expected",
    [
        (1, 8, 2, "0.13"),  # 0.125
        (3, 8, 2, "0.38"),  # 0.375
        (-1, 8, 2, "-0.13"),
        (1, 3, 4, "0.3333"),
        (2, 3, 4, "0.6667"),
        (5, 1000, 2, "0.01"),  # 0.005
        (4, 1000, 2, "0.00"),
        (9_000_000_000_000_000_000, 1000, 2, "9000000000000000.00"),
        (1, 0, 2, None),
    ],
)
def test_ratio_rounds_half_up_once(spark, num, den, scale, expected):
    got = evaluate(spark, half_up_ratio("a", "b", scale), "a bigint, b bigint", (num, den))
    assert got == [expected and D(expected)]


def test_percentages(spark):
    got = evaluate(
        spark, percent_of("a", "b", 2), "a bigint, b bigint", (1, 3), (1, 800), (3, 800), (5, 5), (0, 0)
    )
    assert got == [D("33.33"), D("0.13"), D("0.38"), D("100.00"), None]


def t(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "Australia/Lord_Howe"])
def test_boundaries_are_counted_not_elapsed_time(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        columns = "a timestamp_ntz, b timestamp_ntz"
        pair = (t("2024-01-01 23:59:59.900000"), t("2024-01-02 00:00:01.100000"))
        for unit in ("day", "hour", "minute"):
            assert evaluate(spark, boundary_diff(unit, "a", "b"), columns, pair, pair[::-1]) == [1, -1]
        assert evaluate(spark, boundary_diff("second", "a", "b"), columns, pair) == [2]
        assert evaluate(spark, duration_text("a", "b"), columns, pair) == ["1d 01:01:02"]
        # Hours that a clock change skips or repeats somewhere still count.
        year = (t("2024-01-01 00:00:00"), t("2024-12-31 00:00:00"))
        assert evaluate(spark, boundary_diff("hour", "a", "b"), columns, year) == [365 * 24]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_durations(spark):
    columns = "a timestamp_ntz, b timestamp_ntz"
    got = evaluate(
        spark,
        duration_text("a", "b"),
        columns,
        (t("2024-01-01 10:00:00.100000"), t("2024-01-01 10:00:00.900000")),
        (t("2023-01-01 00:00:00"), t("2024-01-01 12:34:56")),
        (None, t("2024-01-01 00:00:00")),
    )
    assert got == ["0d 00:00:00", "365d 12:34:56", None]
    with pytest.raises(ValueError):
        boundary_diff("week", "a", "b")


def test_hour_bucket_and_millisecond_shift(spark):
    columns = "a timestamp_ntz, n bigint"
    row = (t("2024-03-31 01:59:59.753000"), 1500)
    assert evaluate(spark, hour_bucket("a"), columns, row) == ["2024-03-31 01"]
    assert evaluate(spark, minus_millis("a", "n"), columns, row) == [t("2024-03-31 01:59:58.253000")]


def test_substring_before_the_first_character(spark):
    rows = [("abcdef", 0, 2), ("abcdef", -3, 2), ("abcdef", -1, 4), ("abcdef", 2, 3), ("abcdef", 9, 3),
            ("abcdef", 2, -1), (None, 1, 1)]
    got = evaluate(spark, substring_clipped("s", "p", "n"), "s string, p int, n int", *rows)
    assert got == ["a", "", "ab", "bcd", "", "", None]


def test_exact_statement_slice(spark):
    text = "select 1; select 22  "
    rows = [(text, 0, 16), (text, 20, -1), (text, 20, 38), (text, 0, 4000), (None, 0, -1), (text, None, -1)]
    got = evaluate(spark, statement_slice("s", "a", "b", "exact"), "s string, a int, b int", *rows)
    assert got == ["select 1;", "select 22  ", "select 22 ", text, None, None]


def test_legacy_statement_slice_is_one_off(spark):
    text = "select 1; select 22  "
    rows = [(text, 0, 16), (text, 0, -1), (text, 20, -1), (text, 20, 38), (text, 2, 6)]
    got = evaluate(spark, statement_slice("s", "a", "b", "legacy"), "s string, a int, b int", *rows)
    # From one character early, without the last; trailing blanks not measured.
    assert got == ["select ", "select 1; select 2", " select 2", " select 2", "se"]
    with pytest.raises(ValueError):
        statement_slice("s", "a", "b", "other")


WIDE = "\U0001f600ab\U0001d11e c\U0001f600  "


def utf16_slice(text: str, start: int, end: int, mode: str) -> str:
    """The scripts' arithmetic on bytes; half a character reads as U+FFFD."""
    data, extra = text.encode("utf-16-le"), 1 if mode == "exact" else 0
    measured = data if mode == "exact" else text.rstrip(" ").encode("utf-16-le")
    first = start // 2 + extra
    length = int(((len(measured) if end == -1 else end) - start) / 2) + extra
    first, last = max(first, 1), first + max(length, 0 if first >= 1 else length)
    return data[2 * (first - 1) : 2 * (max(last, first) - 1)].decode("utf-16-le", "replace")


@pytest.mark.parametrize("mode", ["exact", "legacy"])
@pytest.mark.parametrize("text", [WIDE, "plain text ", "\U0001f600", "", "é\U0001f600"])
def test_statement_slices_count_utf16_units(spark, mode, text):
    offsets = [(start, end) for start in range(0, 26, 2) for end in (-1, *range(0, 28, 2))]
    rows = spark.createDataFrame([(text, *o) for o in offsets], "t string, s int, e int")
    sliced = rows.selectExpr("s", "e", f"{statement_slice('t', 's', 'e', mode)} AS found").collect()
    assert {(r["s"], r["e"]): r["found"] for r in sliced} == {o: utf16_slice(text, *o, mode) for o in offsets}


def test_statement_slices_of_null(spark):
    rows = spark.sql("SELECT CAST(NULL AS STRING) AS t, 0 AS s, -1 AS e UNION ALL SELECT '\U0001f600', NULL, -1")
    assert [r[0] for r in rows.selectExpr(statement_slice("t", "s", "e", "exact")).collect()] == [None, None]


def test_last_part_of_names(spark):
    names = ["[a].[b].[c]", "a.b.c", "[a].[b].[c.d]", "[a].[x]]y]", "plain", "", None]
    got = evaluate(spark, last_name_part("s"), "s string", *((n,) for n in names))
    assert got == ["c", "c", "c.d", "x]y", "plain", None, None]


def test_job_keys(spark):
    uuid = "00112233-4455-6677-8899-AABBCCDDEEFF"
    key = "0x33221100554477668899aabbccddeeff"
    assert evaluate(spark, job_key_of_uuid("s"), "s string", (uuid,), (None,)) == [key, None]
    programs = [
        "SQLAgent - TSQL JobStep (Job 0x33221100554477668899AABBCCDDEEFF : Step 1)",
        "SQLAgent - TSQL JobStep (Job 0x332211 : Step 1)",
        "app",
        None,
    ]
    got = evaluate(spark, job_key_of_program("s"), "s string", *((p,) for p in programs))
    assert got == [key, None, None, None]


def test_log_terms_in_any_case_and_with_quotes(spark):
    lines = [("Detected 2 SOCKETS",), ("detected only",), ("it's a \\path with 100%_",), (None,)]
    assert evaluate(spark, contains_all("s", ["detected", "Socket"]), "s string", *lines) == [True, False, False, None]
    assert evaluate(spark, contains_all("s", ["IT'S", "\\Path", "%_"]), "s string", *lines)[:3] == [False, False, True]


def test_value_lists(spark):
    values = [("a'b",), ("c\\d",), ("e",), (None,)]
    assert evaluate(spark, one_of("s", ["a'b", "c\\d"]), "s string", *values) == [True, True, False, None]
    assert evaluate(spark, one_of("s", []), "s string", *values) == [False, False, False, False]
    assert evaluate(spark, literal("x'y\\z"), "s string", ("",)) == ["x'y\\z"]
