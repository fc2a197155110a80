"""Text fit: lines broken by glyph widths, and the first size and line height whose lines fit a box.

Widths are counted in half ems: a full-width glyph takes two, any other one.
A text is cut once into runs (blanks, line ends, full-width glyphs, words); a
fold over the runs counts the lines of one size, so its steps grow with the
runs and not with the glyphs, and candidates after the first that fits are not
tried.  All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as T
from . import layout

#: Kinds of runs.
END, BLANK, WIDE, WORD = range(4)
_BLANKS = r"[ \t\x0b\f\r]"
RUNS = rf"\n|{_BLANKS}+|{T.CJK_CLASS}+|[!-~[^ \t\n\x0b\f\r{T.CJK_CLASS[1:-1]}]]+"
FIT = "struct<size:double,line_height:double,scale:double,lines:int,spare:double>"


def text_runs(text: Column) -> Column:
    """array<struct<kind, n>>: the text's runs in order, with their number of glyphs."""
    first = F.transform(F.regexp_extract_all(text, F.lit(RUNS), F.lit(0)), lambda r: F.struct(F.ascii(r).alias("c"), F.length(r).alias("n")))
    wide = lambda c: c.between(0x3400, 0x9FFF) | c.between(0xF900, 0xFAFF) | c.isin(*map(ord, V.CJK_MARKS))
    kind = lambda c: F.when(c == ord("\n"), END).when((c == ord(" ")) | c.between(ord("\t"), ord("\r")), BLANK).when(wide(c), WIDE).otherwise(WORD)
    return F.transform(first, lambda r: F.struct(kind(r["c"]).alias("kind"), r["n"].alias("n")))


def line_count(runs: Column, room: Column) -> Column:
    """Lines that the runs take where a line has ``room`` half ems (two at least).

    Full-width runs break anywhere; a word goes to the next line whole and is cut only if it is longer than a line; blanks
    are left out where a line starts and never start one.  No text takes no line.
    """

    def state(lines: Column, used: Column) -> Column:
        return F.struct(lines.cast("int").alias("lines"), used.cast("int").alias("used"))

    def step(s: Column, r: Column) -> Column:
        lines, used, n = s["lines"], s["used"], r["n"]
        per = F.greatest(F.lit(1), F.floor(room / 2))
        rest = F.greatest(F.lit(0), n - F.greatest(F.lit(0), F.floor((room - used) / 2)))
        more = F.ceil(rest / per)
        wide = F.when(rest == 0, state(lines, used + 2 * n)).otherwise(state(lines + more, 2 * (rest - (more - 1) * per)))
        cut = F.ceil(n / room) - 1
        word = F.when(used + n <= room, state(lines, used + n)).otherwise(state(lines + F.when(used > 0, 1).otherwise(0) + cut, n - cut * room))
        blank = state(lines, F.when(used == 0, 0).otherwise(F.least(room, used + n)))
        return F.when(r["kind"] == WORD, word).when(r["kind"] == WIDE, wide).when(r["kind"] == BLANK, blank).otherwise(state(lines + 1, F.lit(0)))

    return F.when(F.size(runs) == 0, 0).otherwise(F.aggregate(runs, state(F.lit(1), F.lit(0)), step, lambda s: s["lines"]))


def room_of(width: Column, size: Column) -> Column:
    """Half ems of a line; a full-width glyph always has room."""
    return F.greatest(F.lit(2), F.floor(2 * width / size)).cast("int")


def _tried(runs: Column, width: Column, height: Column, size: Column, line_heights: Column, scale: float) -> Column:
    """array of FIT: one size with each line height; the lines are counted once."""
    own = size * scale
    spare = lambda n, h: F.round(height - n * own * h, 6)
    made = lambda n: F.transform(line_heights, lambda h: F.struct(size.alias("size"), h.alias("line_height"), F.lit(scale).alias("scale"), n.alias("lines"), spare(n, h).alias("spare")).cast(FIT))
    return T.bind(line_count(runs, room_of(width, own)), made)


def first_fit(runs: Column, width: Column, height: Column, sizes: Column, line_heights: Column) -> Column:
    """FIT of the first candidate, size by size, whose lines fit the height; null if none does."""
    fitting = lambda size: F.get(F.filter(_tried(runs, width, height, size, line_heights, 1.0), lambda x: x["spare"] >= 0), F.lit(0))
    return F.aggregate(sizes, F.lit(None).cast(FIT), lambda found, size: F.coalesce(found, fitting(size)))


def scaled_fit(runs: Column, width: Column, height: Column, sizes: Column, line_heights: Column) -> Column:
    """FIT of the last candidate scaled down: by the first scale that fits, else by the last."""
    last = [_tried(runs, width, height, F.element_at(sizes, -1), F.array(F.element_at(line_heights, -1)), s)[0] for s in V.FIT_SCALES]
    fits = [F.when(x["spare"] >= 0, x) for x in last[:-1]]
    return F.coalesce(*fits, last[-1])


def text_fit(groups: DataFrame, line_height: float = V.DEFAULT_LINE_HEIGHT) -> DataFrame:
    """How each group's text is set: groups as ``push_down`` gives them, with ``body_size``; adds ``fit`` and ``mode``, ``fits``.

    Plain text is first tried in the group's own box (mode fast); else, and where it doesn't fit, styled text in the placed
    box (html), last scaled down.  Hidden groups have no fit.  A very long text is one fold over its runs.
    """
    plain = (F.col("align") == "left") & ~F.col("bold") & ~F.col("italic") & ~T.is_caption(F.col("source"))
    placed_width, placed_height = F.col("placed.x1") - F.col("placed.x0"), F.col("placed.y1") - F.col("placed.y0")
    body_like = plain & (F.col("line_count") >= 2) & (placed_width >= 170) & (F.col("font_size") <= 12)
    rows = groups.withColumn("body_like", F.coalesce(body_like, F.lit(False)))
    rows = rows.withColumn("sizes", layout.font_size_candidates(layout.base_font_size(F.col("body_like"), F.col("body_size")))).withColumn("line_heights", layout.line_heights(F.col("body_like"), line_height))
    shown = ~F.col("hidden")
    rows = rows.withColumn("runs", F.when(shown, text_runs(F.replace("text", F.lit("**"), F.lit("")))))
    args = F.col("sizes"), F.col("line_heights")
    fast = F.when(shown & layout.can_use_fast_textbox(F.col("text"), F.col("italic"), F.col("leading_bold")), first_fit(F.col("runs"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), *args))
    rows = rows.withColumn("fast", fast)
    html = F.coalesce(first_fit(F.col("runs"), placed_width, placed_height, *args), scaled_fit(F.col("runs"), placed_width, placed_height, *args))
    rows = rows.withColumn("fit", F.when(shown, F.coalesce("fast", html)))
    mode = F.when(F.col("hidden"), "hidden").when(F.col("fast").isNotNull(), "fast").otherwise("html")
    css = F.when(mode == "html", T.textbox_css(F.col("fit.size"), F.col("align"), F.col("fit.line_height")))
    return rows.withColumns({"mode": mode, "fits": F.col("fit.spare") >= 0, "css": css, "align_value": T.text_align_value(F.col("align"))}).drop("runs", "fast", "sizes", "line_heights", "body_like")
