"""Line breaking and the choice of size, line height and scale, on literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import fitting


def plain_lines(text, room):
    """Glyph by glyph: what ``line_count`` counts run by run."""
    wide = lambda c: "㐀" <= c <= "鿿" or "豈" <= c <= "﫿" or c in "，。！？；：、（）《》【】“”‘’"
    if not text:
        return 0
    lines, used, i = 1, 0, 0
    while i < len(text):
        c = text[i]
        if c == "\n":
            lines, used, i = lines + 1, 0, i + 1
        elif c in " \t\x0b\f\r":
            used, i = (0 if used == 0 else min(room, used + 1)), i + 1
        elif wide(c):
            if used + 2 > room:
                lines, used = lines + 1, 0
            used, i = used + 2, i + 1
        else:
            j = i
            while j < len(text) and text[j] not in " \t\n\x0b\f\r" and not wide(text[j]):
                j += 1
            n = j - i
            if used + n <= room:
                used += n
            else:
                lines += used > 0
                used = 0
                for _ in range(n):
                    if used == room:
                        lines, used = lines + 1, 0
                    used += 1
            i = j
    return lines


@pytest.mark.parametrize(
    ("text", "room", "lines"),
    [("", 10, 0), ("abc", 10, 1), ("abc defg hi", 8, 2), ("abcdefghijk", 4, 3), ("ab abcdefghij", 4, 4), ("中文字符", 4, 2), ("中文字符", 5, 2), ("a中文", 4, 2), ("a\nb", 9, 2), ("a\n\nb", 9, 3), ("ab  cd", 3, 2), ("  ab", 2, 1), ("ab ", 2, 1)],
)
def test_lines_of_literal_texts(spark, text, room, lines):
    got = spark.range(1).select(fitting.line_count(fitting.text_runs(F.lit(text)), F.lit(room)).alias("n")).first().n
    assert got == lines == plain_lines(text, room)


def test_lines_run_by_run_equal_glyph_by_glyph(spark):
    r = random.Random(7)
    rows = [("".join(r.choice(["中", "文", "，", "a", "b", "c", " ", " ", "\n", "word"]) for _ in range(r.randrange(60))), r.randrange(2, 24)) for _ in range(400)]
    got = spark.createDataFrame(rows, "text string, room int").select("text", "room", fitting.line_count(fitting.text_runs(F.col("text")), F.col("room")).alias("n")).collect()
    assert [(x.text, x.room, x.n) for x in got] == [(t, m, plain_lines(t, m)) for t, m in rows]


def group(spark, text, width, height, **changes):
    row = {"text": text, "x0": 0.0, "y0": 0.0, "x1": width, "y1": height, "hidden": False, "italic": False, "leading_bold": False, "bold": False, "align": "left", "line_count": 3, "font_size": 10.0, "source": "Plain words.", "body_size": 9.0} | changes
    kinds = "text string, x0 double, y0 double, x1 double, y1 double, hidden boolean, italic boolean, leading_bold boolean, bold boolean, align string, line_count int, font_size double, source string, body_size double"
    df = spark.createDataFrame([tuple(row.values())], kinds).withColumn("placed", F.struct(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))))
    (x,) = fitting.text_fit(df).collect()
    return (x.mode, x.fit and (x.fit.size, x.fit.line_height, x.fit.scale, x.fit.lines, x.fit.spare), x.fits)


def test_first_candidate_that_fits(spark):
    # body text of 9 points is set at 8.5; 200 points are 47 half ems, so 47 glyphs are two lines of full-width ones
    assert group(spark, "中" * 40, 200.0, 60.0) == ("fast", (8.5, 1.2, 1.0, 2, 39.6), True)
    assert group(spark, "中" * 40, 200.0, 20.0) == ("fast", (8.5, 1.1, 1.0, 2, 1.3), True)
    assert group(spark, "中" * 40, 200.0, 17.5) == ("fast", (8.5, 1.0, 1.0, 2, 0.5), True)
    assert group(spark, "中" * 40, 200.0, 17.0 - 0.5) == ("fast", (8.0, 1.0, 1.0, 2, 0.5), True)
    assert group(spark, "中" * 24, 200.0, 10.0) == ("fast", (8.0, 1.2, 1.0, 1, 0.4), True)


def test_marks_and_styles_are_set_as_html(spark):
    assert group(spark, "中，文", 200.0, 20.0)[0] == "html" and group(spark, "**a** b", 200.0, 20.0)[:2] == ("html", (8.5, 1.2, 1.0, 1, 9.8))
    assert group(spark, "a", 200.0, 20.0, italic=True) == ("html", (10.0, 1.2, 1.0, 1, 8.0), True)
    assert group(spark, "a", 200.0, 20.0, leading_bold=True)[0] == "html"


def test_what_fits_no_candidate_is_scaled(spark):
    mode, fit, fits = group(spark, "中" * 34, 200.0, 6.0)
    assert (mode, fit[:4], fits) == ("html", (6.5, 1.0, 0.9, 1), True)
    mode, fit, fits = group(spark, "中" * 34, 200.0, 3.0)
    assert (mode, fit[:4], fits) == ("html", (6.5, 1.0, 0.4, 1), True)
    mode, fit, fits = group(spark, "中" * 340, 200.0, 3.0)
    assert (mode, fit[2], fits) == ("html", 0.4, False) and fit[4] < 0


def test_short_and_hidden_groups(spark):
    assert group(spark, "a", 200.0, 30.0, line_count=1, font_size=20.0, bold=True) == ("fast", (18.0, 1.2, 1.0, 1, 8.4), True)
    assert group(spark, "a", 200.0, 30.0, font_size=20.0) == ("fast", (10.0, 1.2, 1.0, 1, 18.0), True)
    assert group(spark, "a", 200.0, 30.0, body_size=None, font_size=12.0) == ("fast", (9.5, 1.2, 1.0, 1, 18.6), True)
    assert group(spark, "", 200.0, 30.0, hidden=True) == ("hidden", None, None)


def test_a_very_long_text_is_one_fold(spark):
    text = "word 中文" * 60_000
    assert spark.createDataFrame([(text,)], "t string").select(fitting.line_count(fitting.text_runs(F.col("t")), F.lit(40)).alias("n")).first().n == plain_lines(text, 40)
