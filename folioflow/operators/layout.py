"""Layout groups of translated blocks, font candidates, and the boxes they are set into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as T


def in_order() -> WindowSpec:
    return Window.partitionBy("doc_id", "page_index").orderBy("block_seq")


def same_paragraph_box() -> Column:
    """Whether a layout block may join the one before it (``p``) by place and size."""
    p, gap = F.col("p"), F.col("y0") - F.col("p.y1")
    column = (p["x0"] < F.col("page_w") / 2) == (F.col("x0") < F.col("page_w") / 2)
    return (
        gap.between(-2, F.greatest(F.lit(28.0), p["font_size"] * 3.0)) & (F.col("y0") >= p["y0"] - 2) & (F.abs(p["x0"] - F.col("x0")) <= 24)
        & (F.abs(p["w"] - F.col("w")) <= 36) & (F.abs(p["font_size"] - F.col("font_size")) <= 1.5) & column
    )


def changed_blocks(flags: DataFrame) -> DataFrame:
    """Blocks whose translation differs from their text, and version footers, which are covered in any case."""
    return flags.where((F.col("translated") != F.col("text")) | F.col("version_footer"))


def crosses_heading() -> Column:
    """Whether a heading of the page (``heads``) lies between a block and the one before it (``p``), in their column."""
    p = F.col("p")
    lo, hi = F.least(p["y1"], F.col("y1")), F.greatest(p["y0"], F.col("y0"))
    inside = lambda h: (F.least(p["x1"], F.col("x1"), h["x1"]) - F.greatest(p["x0"], F.col("x0"), h["x0"]) > 20) & (h["y0"] > lo) & (h["y0"] < hi)
    return (F.abs(p["x0"] - F.col("x0")) <= 24) & F.exists("heads", inside)


def layout_groups(flags: DataFrame) -> DataFrame:
    """(doc_id, page_index, group_id, block_seqs, text, hidden, box): flags carries ``translated``, and ``body_size`` if fits are wanted.

    A page's headings are gathered beside its blocks by a window, so no join is needed.
    """
    of_doc = [c for c in ("body_size",) if c in flags.columns]
    heads = F.collect_list(F.when(F.col("heading"), F.struct("x0", "x1", "y0"))).over(Window.partitionBy("doc_id", "page_index"))
    rows = changed_blocks(flags.withColumn("heads", heads)).withColumn("p", F.lag(F.struct("block_seq", "layout_body", "version_footer", "x0", "y0", "x1", "y1", "w", "font_size", "continues")).over(in_order()))
    joins = F.col("layout_body") & ~F.col("version_footer") & F.col("p.layout_body") & ~F.col("p.version_footer") & (F.col("p.block_seq") + 1 == F.col("block_seq")) & same_paragraph_box() & ~crosses_heading()
    rows = rows.withColumn("joins", F.coalesce(joins, F.lit(False)))
    rows = rows.withColumn("group_id", F.sum((~F.col("joins")).cast("int")).over(in_order()) - 1)
    in_group = Window.partitionBy("doc_id", "page_index", "group_id").orderBy("block_seq")
    rows = rows.withColumn("par", F.sum((F.col("joins") & ~F.col("p.continues")).cast("int")).over(in_group))
    item = F.struct("block_seq", "par", "translated", "line_count", "bold", "italic", "leading_bold", "align", "font_size", "heading", "text", "layout_body", "version_footer")
    g = rows.groupBy("doc_id", "page_index", "group_id").agg(F.sort_array(F.collect_list(item)).alias("items"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("line_count").cast("int").alias("line_count"), *(F.max(c).alias(c) for c in of_doc))
    text = rendered_text(F.col("items"))
    first = F.col("items")[0]
    own = F.when(first["version_footer"], F.lit("")).when(first["layout_body"], text).otherwise(first["translated"])
    return g.select(
        "doc_id", "page_index", "group_id", F.transform("items", lambda i: i["block_seq"]).alias("block_seqs"), own.alias("text"), (first["version_footer"] | (~first["layout_body"] & (first["translated"] == ""))).alias("hidden"),
        "x0", "y0", "x1", "y1", "line_count", (first["bold"] | first["heading"]).alias("bold"), first["italic"].alias("italic"), first["leading_bold"].alias("leading_bold"), first["align"].alias("align"), first["font_size"].alias("font_size"), first["heading"].alias("heading"), first["text"].alias("source"), *of_doc,
    )


def rendered_text(items: Column) -> Column:
    """Translations joined within a paragraph, and paragraphs (``par``) by a blank line; empty ones are left out."""
    pars = F.transform(F.array_distinct(F.transform(items, lambda i: i["par"])), lambda n: T.strip(F.array_join(F.transform(F.filter(items, lambda i: i["par"] == n), lambda i: i["translated"]), "")))
    return F.array_join(F.filter(pars, lambda x: x != ""), "\n\n")


def base_font_size(body_like: Column, body_size: Column) -> Column:
    size = F.coalesce(body_size, F.col("font_size"))
    body = F.least(F.when(size >= 9.5, size - 1.0).when(size >= 8.5, size - 0.5).otherwise(size), F.lit(9.5))
    limit = F.when((F.col("align") == "center") | F.col("bold") | (F.col("line_count") <= 2), 18.0).otherwise(10.0)
    return T.round_font_size(F.when(body_like, body).otherwise(F.least(F.col("font_size"), limit)))


def font_size_candidates(base: Column) -> Column:
    return F.array_distinct(F.transform(F.array(*(F.lit(x) for x in (0.0, 0.5, 1.0, 1.5, 2.0))), lambda d: T.round_font_size(base - d)))


def line_heights(body_like: Column, line_height: float = V.DEFAULT_LINE_HEIGHT) -> Column:
    heights = [line_height] + [x for x in (1.1, 1.0) if x < line_height]
    return F.when(body_like, F.array(*map(F.lit, heights))).otherwise(F.array(F.lit(line_height)))


def layout_candidates(sizes: Column, body_like: Column, line_height: float = V.DEFAULT_LINE_HEIGHT) -> Column:
    """Sizes times line heights, size by size; body text also gets tighter lines."""
    lines = line_heights(body_like, line_height)
    return F.flatten(F.transform(sizes, lambda s: F.transform(lines, lambda h: F.struct(s.alias("size"), h.alias("line_height")))))


def cover_boxes(changed: DataFrame) -> DataFrame:
    """White boxes over the original text, a little larger."""
    return changed.select("doc_id", "page_index", "block_seq", *(F.round(F.col(c) + d, 6).alias(c) for c, d in (("x0", -0.8), ("y0", -0.8), ("x1", 0.8), ("y1", 0.8))))


def can_use_fast_textbox(text: Column, italic: Column, leading_bold: Column) -> Column:
    return ~(italic | leading_bold | text.contains("**") | text.rlike(T.any_of(V.CJK_CLOSING)))


def push_down(groups: DataFrame) -> DataFrame:
    """Set the shown groups of a page one after another: a box starts below those that it would overlap.

    A box that would collapse keeps its place; headings get some room around.  Adds ``placed`` (x0, y0, x1, y1) and ``mode``.
    """
    pages = groups.groupBy("doc_id", "page_index").agg(F.sort_array(F.collect_list(F.struct("group_id", *(c for c in groups.columns if c not in ("doc_id", "page_index", "group_id"))))).alias("items"))
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    moved = "aggregate(s.used, x.y0, (y, u) -> if(least(x.x1, u.x1) - greatest(x.x0, u.x0) > 20 and least(x.y1, u.y1) - greatest(y, u.y0) > 1, greatest(y, u.y1 + 1), y))"
    place = f"""transform(array(if({moved} >= x.y1 - 2, x.y0, {moved})), y ->
        if(x.heading, named_struct('x0', x.x0 - 2, 'y0', y - 2, 'x1', x.x1 + 2, 'y1', x.y1 + greatest(3D, x.font_size * 0.35D)), named_struct('x0', x.x0, 'y0', y, 'x1', x.x1, 'y1', x.y1)))[0]"""
    fold = F.expr(f"""aggregate(items, named_struct('used', cast(array() as array<{box}>), 'out', cast(array() as array<{box}>)), (s, x) -> if(x.hidden,
        named_struct('used', s.used, 'out', array_append(s.out, cast(null as {box}))),
        transform(array({place}), b -> named_struct('used', array_append(s.used, b), 'out', array_append(s.out, b)))[0]), s -> s.out)""")
    rows = pages.select("doc_id", "page_index", "items", fold.alias("placed")).select("doc_id", "page_index", F.explode(F.arrays_zip("items", "placed")).alias("z"))
    out = rows.select("doc_id", "page_index", "z.items.*", F.col("z.placed").alias("placed"))
    fast = can_use_fast_textbox(F.col("text"), F.col("italic"), F.col("leading_bold"))
    return out.withColumn("mode", F.when(F.col("hidden"), "hidden").when(fast, "fast").otherwise("html"))
