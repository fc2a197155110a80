"""Text functions as Column expressions; all stay in the JVM but ``unescape_html``."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import fixed as V


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def any_of(chars: str) -> str:
    return "[" + "".join("\\" + c if c in r"\[]^-&" else c for c in chars) + "]"


#: All that ``(?U)\\s`` matches.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def holds(c: Column, *marks: str) -> Column:
    """Whether any of the marks occurs: a scan of bytes, so that a text without them is spared a pattern."""
    return reduce(lambda a, b: a | b, (c.contains(m) for m in marks))


def beyond_ascii(c: Column) -> Column:
    return F.octet_length(c) > F.length(c)


def one_of(chars: str) -> str:
    """A pattern like ``any_of`` of marks that aren't among the common characters, which one look rules out."""
    common = r"A-Za-z0-9 ,.;\x{400}-\x{211f}\x{2a00}-\x{ffff}"
    if re.search(f"[{re.sub(r'x{(\w+)}', lambda m: 'u' + m[1].zfill(4), common)}]", chars):
        raise ValueError(f"not only rare marks: {chars}")
    return rf"[^{common}](?<={any_of(chars)})"


def strip(c: Column) -> Column:
    """Trim all Unicode white space."""
    return F.btrim(c, F.lit(SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Trimmed, and runs of white space to one blank; most texts have no such runs and skip the replacement."""
    s = strip(c)
    return F.when(holds(s, "  ", "\t", "\n", "\x0b", "\x0c", "\r") | beyond_ascii(s), F.regexp_replace(s, r"(?U)\s+", " ")).otherwise(s)


def clean_text(c: Column) -> Column:
    """Rejoin words hyphenated at line ends, line ends to blanks, runs of blanks to one, trimmed."""
    single = lambda x: F.regexp_replace(x, r"[ \t]+", " ")
    joined = F.regexp_replace(c, r"(?U)-(?<=\w-)\s*\n\s*(?=\w)", "")
    lines = single(F.regexp_replace(joined, r"(?U)\s*\n\s*", " "))
    return strip(F.when(holds(c, "\n"), lines).when(holds(c, "  ", "\t"), single(c)).otherwise(c))


def word_count(c: Column) -> Column:
    return _count(c, V.WORD3)


def should_translate(c: Column) -> Column:
    words = word_count(c)
    marks = _count(c, r"(?U)[^\p{L}\p{N}\s]")
    return (F.length(strip(c)) >= 3) & (words > 0) & ((words >= 4) | (marks / F.greatest(F.length(c), F.lit(1)) <= 0.45))


def table_header_score(c: Column) -> Column:
    low = F.lower(c)
    return reduce(lambda a, b: a + b, ((holds(low, p.replace(r"\b", "")) & low.rlike(p)).cast("int") for p in V.TABLE_HEADERS))


def looks_like_table_header(c: Column) -> Column:
    return ~c.contains(".") & (table_header_score(c) >= 2)


def is_caption(c: Column) -> Column:
    return c.rlike(V.CAPTION)


def context_label(c: Column) -> Column:
    return F.lower(F.rtrim(squeeze(c), F.lit(":：")))


def is_context_label(c: Column) -> Column:
    return context_label(c).isin(*V.CONTEXT_LABELS)


def reading_priority(c: Column) -> Column:
    return strip(c).rlike(V.READING_PRIORITY).cast("int")


def is_appendix_text(c: Column) -> Column:
    return is_appendix_squeezed(squeeze(c))


def is_appendix_squeezed(s: Column) -> Column:
    heading = F.regexp_extract(s, V.LETTER_HEADING, 1)
    return s.rlike(V.APPENDIX) | ((F.length(s) <= 140) & (F.length(F.regexp_replace(heading, "[^A-Z0-9]", "")) >= 4))


def drop_cap(c: Column) -> Column:
    """struct(heading, letter), or null where the text has no such form."""
    s = strip(c)
    return F.when(s.rlike(V.DROP_CAP), F.struct(F.regexp_extract(s, V.DROP_CAP, 1).alias("heading"), F.regexp_extract(s, V.DROP_CAP, 2).alias("letter")))


def paragraph_continues(c: Column) -> Column:
    return F.substring(rstrip(c), -1, 1).rlike(r"^(?:;|\p{Ll}|[,，\-–])$")


def is_ascii_word_char(c: Column) -> Column:
    return c.rlike("^[A-Za-z0-9_-]$")


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def split_position(text: Column, start: Column, target: Column) -> Column:
    """Where to cut after ``target`` characters (0-based): at a sentence mark, comma or blank near it, else between words."""
    n = F.length(text)

    def near(p: Column) -> Column:
        start, target, left, right = (p[c] for c in ("start", "target", "left", "right"))

        def cut(window: Column) -> Column:
            last = [F.length(F.regexp_extract(window, f"(?s)^(.*){marks}", 1)) for marks in ("[。！？；]", "[，、]", " ")]
            found = [window.rlike(marks) for marks in ("[。！？；]", "[，、]", " ")]
            return F.when(found[0], left + last[0] + 1).when(found[1], left + last[1] + 1).when(found[2], left + last[2])

        def between(at: Column) -> Column:
            word = F.length(F.regexp_extract(F.substring(text, start + 2, at - start - 1), "([A-Za-z0-9_-]*)$", 1))
            return F.when(is_ascii_word_char(F.substring(text, at + 1, F.lit(1))) & (at > start + 1), at - word).otherwise(at)

        back = F.least(F.greatest(target, start + 1), n - 1)
        return F.coalesce(bind(F.substring(text, left + 1, right - left), cut), bind(back, between))

    left, right = F.greatest(start + 1, target - V.SPLIT_WINDOW), F.least(n, target + V.SPLIT_WINDOW)
    place = F.struct(start.alias("start"), target.alias("target"), left.alias("left"), right.alias("right"))
    return F.when(target <= start, F.least(n, start + 1)).when(target >= n, n).otherwise(bind(place, near))


@F.pandas_udf(StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) and "&" in x else x)


#: Steps of ``clean_translation``, each with what a text must hold for any of them to change it.
_END = "(?=[，。！？；：、\\s]|$)"
_CLEANING: tuple[tuple[Callable[[Column], Column], tuple[tuple[str, str], ...]], ...] = (
    (lambda c: holds(c, "\r"), ((r"\r\n|\r", "\n"),)),
    (lambda c: holds(c, "(", "（"), ((V.NOTE_EN, ""), (V.NOTE_ZH, ""))),
    (lambda c: holds(c, "…", "..."), ((rf"(?U)\s*(?:……|\.{{3,}}){_END}", ""),)),
    (lambda c: holds(c, *"≤<>="), ((rf"(?U)\s*[≤<>=]\s*{_END}", ""),)),
    (
        lambda c: holds(c, "\\"),
        (
            (rf"\\(?:{V.LATEX_FONTS})\{{([^{{}}]+)\}}", "$1"), (rf"\\(?:{V.LATEX_TEXT})\{{([^{{}}]+)\}}", "$1"),
            *((rf"\\{k}(?![A-Za-z])", v) for k, v in V.LATEX_SYMBOLS.items()), (r"\\[A-Za-z]+", ""), (r"\\", ""),
        ),
    ),
    (lambda c: holds(c, "$"), ((r"(?U)\${1,2}\s*([^$]+?)\s*\${1,2}", "$1"), (r"\$", ""))),
    (lambda c: holds(c, "\n"), ((r"[ \t]*\n+[ \t]*", " "),)),
    (lambda c: holds(c, "  ", "\t"), ((r"[ \t]+", " "),)),
    (
        lambda c: beyond_ascii(c) & c.rlike(r"[\x{3400}-\x{9fff}，。！？；：、（《【“‘）】》”’]"),
        ((r"(?U)\s(?<=[\x{3400}-\x{9fff}]\s)\s*(?=[\x{3400}-\x{9fff}])", ""), (r"(?U)\s(?<=[，。！？；：、（《【“‘]\s)\s*", ""), (r"(?U)\s+(?=[，。！？；：、）】》”’])", "")),
    ),
)


def clean_translation(c: Column, entities: bool = True) -> Column:
    """Strip what models add to translations: tags, notes, LaTeX, stray blanks.  entities: decode HTML entities (in Arrow batches).

    Steps whose marks a text doesn't hold are passed over, and texts without an ampersand don't leave the JVM.
    """
    bare = F.when(holds(c, "<"), F.regexp_replace(c, "</?(?:sub|sup)>", "")).otherwise(c)
    bare = F.coalesce(unescape_html(F.when(holds(c, "&"), bare)), bare) if entities else bare

    def where_held(x: Column, step: tuple) -> Column:
        return bind(x, lambda s: F.when(step[0](s), reduce(lambda y, r: F.regexp_replace(y, *r), step[1], s)).otherwise(s))

    return strip(reduce(where_held, _CLEANING, bare))


def source_terms(c: Column) -> Column:
    """Acronyms and capitalised words that a translation should keep, each once."""
    found = lambda p: F.regexp_extract_all(c, F.lit("(?=[A-Z])" + p), F.lit(0))  # noqa: E731  capitals are looked for first, bounds of words only there
    acronyms = F.filter(found(V.ACRONYM), lambda t: ~t.isin(*V.NOT_TERMS))
    capitals = F.filter(found(V.CAPITALISED), lambda t: ~F.lower(t).isin(*V.COMMON_HEADINGS))
    return F.array_distinct(F.concat(acronyms, capitals))


CJK_CLASS = rf"[\x{{3400}}-\x{{9fff}}\x{{f900}}-\x{{faff}}{V.CJK_MARKS}]"


def is_cjk(c: Column) -> Column:
    return c.rlike(f"^{CJK_CLASS}")


def _escape(c: Column) -> Column:
    return reduce(lambda x, s: F.replace(x, F.lit(s[0]), F.lit(s[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")), c)


def html_fragments(c: Column) -> Column:
    """Runs of CJK and other characters as spans, line ends as <br>."""
    runs = F.regexp_extract_all(c, F.lit(rf"\n|{CJK_CLASS}+|[^\n{CJK_CLASS[1:-1]}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r == "\n", F.lit("<br>")).otherwise(F.concat(F.lit('<span class="'), F.when(is_cjk(r), F.lit("cjk")).otherwise(F.lit("latin")), F.lit('">'), _escape(r), F.lit("</span>")))), "")


def bold_segments(c: Column) -> Column:
    """array<struct<text, bold>>: the text cut at each ``**``, which turns bold on and off; empty pieces are left out."""
    parts = F.transform(F.split(c, r"\*\*"), lambda s, i: F.struct(s.alias("text"), (i % 2 == 1).alias("bold")))
    return F.filter(parts, lambda p: p["text"] != "")


def leading_style_end(c: Column) -> Column:
    """Length of a bold lead-in: to the first blank, else colon or full stop, else comma, each only if near the start."""
    out = F.lit(0)
    for mark, most in reversed(((" ", 24), ("：", 28), (":", 28), ("。", 28), (".", 28), ("，", 12))):
        at = F.instr(c, mark) - 1
        out = F.when((at > 0) & (at <= most), at + 1).otherwise(out)
    return out


def style_class(bold: Column, italic: Column) -> Column:
    return F.when(bold & italic, "bolditalic").when(bold, "bold").when(italic, "italic").otherwise("regular")


def bold_style(style: Column) -> Column:
    return F.when(style == "italic", "bolditalic").when(style == "bolditalic", style).otherwise("bold")


def styled_text(c: Column, style: Column) -> Column:
    """Spans of style around the fragments of each bold or plain segment."""
    return F.array_join(F.transform(bold_segments(c), lambda p: F.concat(F.lit('<span class="'), F.when(p["bold"], bold_style(style)).otherwise(style), F.lit('">'), html_fragments(p["text"]), F.lit("</span>"))), "")


def styled_html(c: Column, bold: Column, italic: Column, leading_bold: Column) -> Column:
    end = leading_style_end(c)
    end = F.when(end > 0, end).otherwise(F.instr(c, "。"))
    lead = F.concat(styled_text(F.substring(c, F.lit(1), end), F.lit("bold")), styled_text(F.substring(c, end + 1, F.length(c)), F.lit("regular")))
    return F.when(leading_bold & (end > 0), lead).otherwise(styled_text(c, style_class(bold, italic)))


def round_font_size(c: Column) -> Column:
    """To halves, ties to even, at least the smallest size."""
    return F.bround(F.greatest(F.lit(V.MIN_FONT_SIZE), c) * 2) / 2


def textbox_css(size: Column, align: Column, line_height: Column) -> Column:
    return F.format_string("body { margin: 0; font-size: %spt; line-height: %s; text-align: %s; }", size.cast("string"), line_height.cast("string"), align)


def text_align_value(align: Column) -> Column:
    return F.when(align == "center", 1).otherwise(0)


def clean_upload_filename(c: Column) -> Column:
    """The last path component if it ends in .pdf, else null."""
    name = F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.when(F.lower(name).endswith(".pdf"), name)


def stem(c: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"(?<=.)\.[^.]*$", "")


def output_path(c: Column) -> Column:
    return F.concat(stem(c), F.lit(V.OUTPUT_SUFFIX))


def status_label(c: Column) -> Column:
    return F.when(c == "queued", "排队中").when(c == "running", "翻译中").when(c == "done", "已完成").otherwise("失败")


def created_label(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "MM/dd HH:mm")


def progress_percent(status: Column, done: Column, total: Column) -> Column:
    return F.when(status.isin("done", "failed"), 100).when(total <= 0, 0).otherwise(F.floor(100.0 * done / total + 0.5)).cast("int")


def log_kind(c: Column) -> Column:
    """error, success, system or plain, by the first marker that occurs."""
    return F.when(c.rlike("ERROR|FAILED|CRITICAL"), "error").when(c.rlike(r"saved:|Done\."), "success").when(c.rlike("^Job|PDF:|OUT:"), "system").otherwise("plain")


def parse_line_height(value: str) -> float:
    try:
        number = float(value)
    except ValueError as e:
        raise ValueError(f"line height is not a number: {value}") from e
    low, high = V.LINE_HEIGHT_RANGE
    if not low <= number <= high:
        raise ValueError(f"line height is outside {low} to {high}: {value}")
    return number


def line_height_or_null(c: Column) -> Column:
    number = c.try_cast("double")
    return F.when(number.between(*V.LINE_HEIGHT_RANGE), number)


