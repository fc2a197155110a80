"""Raw lines to blocks: a raw block is an array of lines (x0, y0, x1, y1, spans), a span has text, size, font and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as T

LINES = "array<struct<x0:double,y0:double,x1:double,y1:double,spans:array<struct<text:string,size:double,font:string,flags:int>>>>"


def raw_text(line: Column) -> Column:
    return F.array_join(F.transform(line["spans"], lambda s: s["text"]), "")


def with_texts(lines: Column) -> Column:
    """Lines with their ``raw`` and cleaned ``text``, read once; all that follows takes lines of this form."""
    kept = ("x0", "y0", "x1", "y1", "spans")
    return F.transform(lines, lambda ln: T.bind(raw_text(ln), lambda r: F.struct(*(ln[c].alias(c) for c in kept), r.alias("raw"), T.clean_text(r).alias("text"))))


def block_text(lines: Column) -> Column:
    return T.bind(F.array_join(F.transform(F.filter(lines, lambda ln: ln["text"] != ""), lambda ln: ln["raw"]), "\n"), T.clean_text)


def line_count(lines: Column) -> Column:
    return F.size(F.filter(lines, lambda ln: ln["text"] != ""))


def bbox(lines: Column) -> Column:
    edge = lambda pick, c: pick(F.transform(lines, lambda ln: ln[c]))
    return F.struct(*(edge(F.array_min if c[1] == "0" else F.array_max, c).alias(c) for c in ("x0", "y0", "x1", "y1")))


def spans(lines: Column) -> Column:
    return F.flatten(F.transform(lines, lambda ln: ln["spans"]))


def first_font_size(lines: Column) -> Column:
    return F.coalesce(F.get(F.filter(spans(lines), lambda s: s["size"] != 0), F.lit(0))["size"], F.lit(8.0))


def span_is_bold(s: Column) -> Column:
    return (s["flags"].bitwiseAND(16) != 0) | F.lower(s["font"]).rlike(V.BOLD_FONTS)


def span_is_italic(s: Column) -> Column:
    return (s["flags"].bitwiseAND(2) != 0) | F.lower(s["font"]).rlike(V.ITALIC_FONTS)


def block_style(lines: Column) -> Column:
    """struct(bold, italic, leading_bold), by share of characters."""
    sized = F.transform(spans(lines), lambda s: F.struct(F.length(T.strip(s["text"])).alias("n"), span_is_bold(s).alias("bold"), span_is_italic(s).alias("italic")))

    def style(seen: Column) -> Column:
        def counted(of: str) -> Column:
            return F.aggregate(F.filter(seen, lambda s: s[of]), F.lit(0), lambda a, s: a + s["n"])

        total = F.aggregate(seen, F.lit(0), lambda a, s: a + s["n"])
        share = lambda of: F.coalesce(F.try_divide(counted(of), total) >= 0.6, F.lit(False))
        lead = F.coalesce(F.get(seen, F.lit(0))["bold"], F.lit(False))
        return T.bind(share("bold"), lambda bold: F.struct(bold.alias("bold"), share("italic").alias("italic"), (lead & ~bold).alias("leading_bold")))

    return T.bind(F.filter(sized, lambda s: s["n"] > 0), style)


def block_align(box: Column, line_count: Column, page_width: Column, font_size: Column) -> Column:
    return F.when((font_size >= 11) & (line_count <= 3) & (F.abs(box["x0"] + box["x1"] - page_width) < 70), "center").otherwise("left")


def _halves(lines: Column, at: Column) -> Column:
    """[lines before at, the rest] for a cut, [lines] for none (null or 0)."""
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.array(F.slice(lines, F.lit(1), at), F.slice(lines, at + 1, F.size(lines)))).otherwise(F.array(lines))


def split_caption(lines: Column) -> Column:
    rest = block_text(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))))
    return _halves(lines, F.when((F.size(lines) > 1) & T.is_caption(F.get(lines, F.lit(0))["text"]) & T.looks_like_table_header(rest), 1))


def split_wrapped(lines: Column, page_width: Column) -> Column:
    """Cut text that wraps around a figure: a first run of narrow (or wide) lines from the other lines; blank lines go."""

    def of_box(box: Column) -> Column:
        width = box["x1"] - box["x0"]
        limit = box["x1"] - F.greatest(F.lit(55.0), width * 0.22)

        def of_shown(shown: Column) -> Column:
            n = F.size(shown)

            def of_turns(turns: Column) -> Column:
                first, second = F.get(turns, F.lit(0)), F.coalesce(F.get(turns, F.lit(1)), n)
                head = bbox(F.slice(shown, F.lit(1), F.coalesce(first, F.lit(0))))
                ok = (F.size(turns) > 0) & (first >= 3) & (second - first >= 2) & (head["x1"] - head["x0"] < width - 55)
                return F.when(F.coalesce(ok, F.lit(False)), _halves(shown, first)).otherwise(F.array(lines))

            narrow = lambda i: F.get(shown, i)["x1"] < limit
            return T.bind(F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: narrow(i) != narrow(i - 1)), of_turns)

        return F.when(width >= page_width * 0.55, T.bind(F.filter(lines, lambda ln: ln["text"] != ""), of_shown)).otherwise(F.array(lines))

    return F.when(F.size(lines) >= 4, T.bind(bbox(lines), of_box)).otherwise(F.array(lines))


def formula_like(line: Column) -> Column:
    t = line["text"]
    return (t == "") | ((T.word_count(t) <= 1) & (t.rlike("^[A-Z]$") | t.rlike(T.one_of(V.MATH_LINE)) | t.rlike(r"(?U)^[\p{Nd}\s.,]+$")))


def split_formula_tail(lines: Column) -> Column:
    """Cut the lines of a formula from the text before them.  Only cuts behind the last line that is no formula are looked at."""
    n = F.size(lines)
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    more = lambda s, ln: F.when(s["on"] & formula_like(ln), F.struct((s["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(s["n"].alias("n"), F.lit(False).alias("on")))
    tails = F.aggregate(F.reverse(lines), start, more, lambda s: s["n"])

    def fits(i: Column) -> Column:
        head, tail = F.slice(lines, F.lit(1), i), F.slice(lines, i + 1, n)
        right = lambda b: (b["x1"] - b["x0"] <= 80) & (b["x0"] > F.array_min(F.transform(head, lambda ln: ln["x0"])) + 20)
        return F.exists(tail, lambda ln: ln["text"] != "") & T.bind(bbox(tail), right) & (T.word_count(block_text(head)) >= 4)

    def cut(behind: Column) -> Column:
        cuts = F.filter(F.sequence(F.greatest(behind, F.lit(1)), n - 1), fits)
        return F.when(behind < n, F.get(cuts, F.lit(0)))

    return T.bind(F.when(n >= 3, T.bind(n - tails, cut)), lambda at: _halves(lines, at))


def extract_blocks(raw: DataFrame, page_width: str = "page_width") -> DataFrame:
    """Blocks from raw blocks (doc_id, page_index, raw_block, page_width, lines): the three splits, then text, box and style."""
    width = F.col(page_width)
    keys = ["doc_id", "page_index", "raw_block", page_width]

    def parts(groups: Column) -> Column:
        next_y = F.when(F.size(groups) > 1, F.array_min(F.transform(groups[1], lambda ln: ln["y0"])))
        part = lambda g, s, t, ls: F.struct((g * 10000 + s * 100 + t).alias("part"), F.when(g == 0, next_y).alias("next_y"), ls.alias("lines"))
        each = F.transform(groups, lambda a, g: F.transform(split_wrapped(a, width), lambda b, s: F.transform(split_formula_tail(b), lambda c, t: part(g, s, t, c))))
        return F.filter(F.flatten(F.flatten(each)), lambda p: F.exists(p["lines"], lambda ln: ln["text"] != ""))

    step = raw.select(*keys, F.explode(T.bind(with_texts(F.col("lines")), lambda ls: T.bind(split_caption(ls), parts))).alias("p")).select(*keys, "p.*")
    text, size = block_text(F.col("lines")), first_font_size(F.col("lines"))
    step = step.select(*keys, "part", "next_y", text.alias("text"), bbox(F.col("lines")).alias("box"), block_style(F.col("lines")).alias("style"), size.alias("font_size"), line_count(F.col("lines")).alias("line_count"))
    low = F.when(F.col("next_y").isNotNull() & T.is_caption(F.col("text")), F.greatest(F.col("box.y0") + 6, F.least("box.y1", F.col("next_y") - 1))).otherwise(F.col("box.y1"))
    return step.select(
        "doc_id", "page_index", "raw_block", "part", "box.x0", "box.y0", "box.x1", low.alias("y1"), "text", "font_size",
        "line_count", "style.bold", "style.italic", "style.leading_bold", block_align(F.col("box"), F.col("line_count"), width, F.col("font_size")).alias("align"),
    )


def raw_blocks(docs: DataFrame) -> DataFrame:
    """Raw blocks of five document lines each, with boxes, fonts and captions that exercise every split."""
    lines = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    b, j, d = F.floor(F.col("n") / 5).cast("int"), F.col("n") % 5, F.col("doc_id")
    kind = ((d * 3 + b) % 6).cast("int")
    lines = lines.select("doc_id", "line", b.alias("raw_block"), j.cast("int").alias("j"), kind.alias("kind"))
    k, j = F.col("kind"), F.col("j")
    text = F.when((k == 0) & (j == 0), F.concat(F.lit("Table 3: "), F.col("line"))).when((k == 0) & (j == 1), F.lit("Method Dataset AUROC")).when((k == 0), F.lit("memory flops")).when((k == 2) & (j == 4), F.lit("x = y + 1")).otherwise(F.col("line"))
    x0 = F.when((k == 2) & (j == 4), 120.0).otherwise(54.0)
    x1 = F.when((k == 2) & (j == 4), 180.0).when((k == 1) & (j < 3), 300.0).otherwise(500.0)
    font = F.when(k == 3, "Times-Bold").when(k == 4, "CMTI-Italic").otherwise("Times")
    head = F.struct(F.substring("text", 1, 8).alias("text"), F.when(k == 5, 12.0).otherwise(9.5).alias("size"), F.when(j == 0, "Times-Bold").otherwise(font).alias("font"), F.when(k == 4, 2).otherwise(0).alias("flags"))
    tail = F.struct(F.substring("text", F.lit(9), F.length("text")).alias("text"), F.lit(9.5).alias("size"), font.alias("font"), F.lit(0).alias("flags"))
    out = lines.withColumn("text", text).select("doc_id", "raw_block", "j", F.struct(x0.alias("x0"), (60.0 + 14 * j).alias("y0"), x1.alias("x1"), (72.0 + 14 * j).alias("y1"), F.array(head, tail).alias("spans")).alias("line"))
    packed = out.groupBy("doc_id", "raw_block").agg(F.sort_array(F.collect_list(F.struct("j", "line"))).alias("a"))
    return packed.select("doc_id", F.floor(F.col("raw_block") / 4).cast("int").alias("page_index"), "raw_block", F.lit(612.0).alias("page_width"), F.transform("a", lambda x: x["line"]).cast(LINES).alias("lines"))
