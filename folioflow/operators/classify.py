"""Block rules: features of a block, its page's flags, reading order, and the ordered rules that make it body text or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as T


def by_page() -> WindowSpec:
    return Window.partitionBy("doc_id", "page_index")


def by_doc() -> WindowSpec:
    return Window.partitionBy("doc_id")


def with_features(blocks: DataFrame, width: float = V.PAGE_WIDTH, height: float = V.PAGE_HEIGHT) -> DataFrame:
    """Add what several rules share: trimmed and squeezed text, word and number counts, box sizes, page size."""
    t = T.strip(F.col("text"))
    out = blocks.withColumns({"t": t, "s": T.squeeze(F.col("text")), "w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0"), "page_w": F.lit(float(width)), "page_h": F.lit(float(height))})
    count = lambda p: F.regexp_count("t", F.lit(p))
    return out.withColumns({
        "n_num": count(V.NUMBER), "n_dec": count(V.DECIMAL), "n_w1": count(V.WORD1), "n_w2": count(V.WORD2), "n_w3": count(V.WORD3), "n_big_o": count(r"O\("),
        "n_math": count(T.one_of(V.MATH_BLOCK)), "caption": T.is_caption(F.col("t")), "table_header": T.looks_like_table_header(F.col("t")), "page_blocks": F.count(F.lit(1)).over(by_page()),
    })


def journal_header() -> Column:
    return (F.col("y0") <= 55) & (F.col("font_size") <= 8.5) & (F.upper("s").contains(V.JOURNAL_BANNER) | (F.col("s").rlike(V.RUNNING_AUTHORS) & F.col("s").rlike(r"\s\p{Nd}+$")))


def version_footer() -> Column:
    return (F.col("y0") >= F.col("page_h") - 65) & ~F.col("t").rlike(r"^\p{Nd}+$") & F.col("t").rlike(V.VERSION_FOOTER)


def conference_header() -> Column:
    return (F.col("y0") <= 65) & F.col("s").rlike(V.CONFERENCE_HEADER)


def table_block() -> Column:
    t, words, nums, lines = F.col("t"), F.col("n_w1"), F.col("n_num"), F.col("line_count")
    pair = lambda words_: F.expr("true") if not words_ else t.contains(words_[0]) & pair(words_[1:])
    return (
        F.when(t.rlike(V.DATASET_PAIR), False)
        .when(F.col("table_header"), True)
        .when((F.col("n_big_o") >= 2) & (words <= 60), True)
        .when(t == V.TABLE_LABEL, True)
        .when(t.rlike(V.TABLE_ROWS), True)
        .when(t.rlike(V.TABLE_MODULE) & (F.col("n_big_o") > 0), True)
        .when(t.rlike(V.TABLE_FIRST) & (lines > 1), True)
        .when(pair(V.TABLE_PAIRS[0]) | pair(V.TABLE_PAIRS[1]), True)
        .when((F.col("n_dec") >= 3) & (nums * 3 >= words), True)
        .when((lines >= 2) & (nums >= 2) & (words <= 12), True)
        .when(t.rlike(T.any_of(V.TABLE_MARKS)) & (nums >= 3) & (nums * 2 >= words), True)
        .otherwise((lines >= 3) & (nums >= 6) & (nums * 3 >= words))
    )


def formula_block() -> Column:
    return ((F.col("n_math") >= 2) & (F.col("n_w3") <= 4)) | ((F.col("line_count") <= 2) & (F.col("n_math") >= 1) & (F.length("t") < 35))


def side_note() -> Column:
    return F.col("t").startswith("arXiv:") | ((F.col("x1") < 45) & (F.col("h") > 120)) | ((F.col("w") < 40) & (F.col("h") > F.col("w") * 5))


def first_page_metadata() -> Column:
    """Needs ``ieee_page``."""
    t = F.col("t")
    on_journal = (
        F.when((F.col("x0") > F.col("page_w") / 2) & (F.col("y0") >= 180), False)
        .when(t.startswith(V.RECEIVED[0]) | t.startswith(V.RECEIVED[1]) | t.startswith(V.RECEIVED[2]), True)
        .when(t.rlike(V.MEMBERSHIP) | t.contains(V.AFFILIATIONS[0]) | t.contains(V.AFFILIATIONS[1]) | F.lower("t").contains(V.SOURCE_CODE), True)
    )
    by_place = F.when(t.startswith("*") | t.startswith("∗"), True).when(F.col("y0") > F.col("page_h") - 100, True).when(F.col("y0") < 130, False).otherwise(F.col("y0") < 220)
    abstract = t.rlike("(?i)^abstract$") | t.rlike(r"(?i)^abstract\s*[—-]\s*\S")
    return F.when((F.col("page_index") != 0) | abstract, False).otherwise(F.coalesce(F.when(F.col("ieee_page"), on_journal), by_place))


def figure_label() -> Column:
    t, small = F.col("t"), F.col("font_size") <= 8.5
    return (
        t.rlike(r"^GT\s+\([a-z]\)")
        | ((F.col("page_index") > 0) & (F.col("y1") < 180) & small & (F.col("n_w2") <= 8))
        | (t.rlike(r"\([a-z]\)") & (F.col("y1") < 540) & (F.col("n_w3") <= 20) & ((F.col("w") < 240) | small))
        | ((F.col("page_blocks") > 40) & (F.col("y1") < 430) & (F.col("w") < 220) & (F.col("n_w2") <= 12))
    )


def appendix_heading() -> Column:
    return (F.col("font_size") >= 9) & (F.col("line_count") <= 2) & T.is_appendix_squeezed(F.col("s"))


def heading() -> Column:
    t, words, lines, size, n = F.col("t"), F.col("n_w1"), F.col("line_count"), F.col("font_size"), F.length("t")
    capitals = (size >= 9.5) & (lines <= 2) & words.between(2, 5) & (n > 4) & ~t.rlike(V.NUMBER) & (F.upper("t") == t) & (F.col("n_math") == 0)
    numbered = t.rlike(r"^\p{Nd}+(?:\.\p{Nd}+)*\s+.") & (lines <= 2) & words.between(1, 12) & (n <= 120)
    rest = T.strip(F.regexp_extract("t", r"^\p{Nd}+(?:\.\p{Nd}+)*\s+(.+)", 1))
    first = F.regexp_extract("t", V.WORD1, 0)
    all_capital = F.forall(F.regexp_extract_all("t", F.lit(V.WORD1), F.lit(0)), lambda x: x.rlike("^[A-Z]"))
    return (
        F.when(appendix_heading() | capitals, True)
        .when(numbered, ~rest.rlike(r"^\p{Nd}") & ~rest.rlike("^[A-Z]$") & first.rlike("^[A-Z]"))
        .otherwise((size >= 9) & (F.col("bold") | (size >= 11)) & words.between(1, 5) & ~t.rlike(r"\p{Nd}") & n.between(5, 80) & all_capital)
    )


def lettered_heading() -> Column:
    return F.col("t").rlike(r"^[A-Z]\.\s+[A-Z]") & (F.col("font_size") >= 9) & F.col("n_w1").between(1, 12) & (F.length("t") <= 120)


def roman_heading() -> Column:
    title = F.regexp_extract("s", r"^[IVX]+\.\s+(.+)$", 1)
    return (title != "") & (F.col("font_size") >= 9) & F.regexp_count(title, F.lit(V.WORD1)).between(1, 8) & (F.length("s") <= 90) & (F.upper(title) == title)


def title_block() -> Column:
    return (F.col("align") == "center") & (F.col("font_size") >= 14) & (F.col("line_count") <= 4) & (F.col("w") >= 250) & (F.col("n_w3") >= 4)


def with_order(features: DataFrame, tie: str = "block_id") -> DataFrame:
    """Add ieee_page, the five sort keys, block_seq within the page and global_seq within the document."""
    out = features.withColumn("journal_header", journal_header()).withColumn("ieee_page", F.bool_or("journal_header").over(by_page()))
    right = F.col("x0") > F.col("page_w") / 2
    top, aside = (F.col("y1") < 220) & (F.col("w") > 250), F.col("ieee_page") & (F.col("page_index") > 0) & right & (F.col("y0") < 330) & (F.col("w") > 180)
    out = out.withColumns({
        "band": F.when(top, 0).when(aside, 1).otherwise(2), "col": F.when(top | aside | (F.col("w") > F.col("page_w") * 0.65) | (F.col("x0") < F.col("page_w") / 2), 0).otherwise(1),
        "y_bucket": (F.bround(F.col("y0") / 3) * 3).cast("int"), "priority": T.reading_priority(F.col("text")),
    })
    keys = ["band", "col", "y_bucket", "priority", "x0", tie]
    return out.withColumn("block_seq", F.row_number().over(by_page().orderBy(*keys)) - 1).withColumn("global_seq", F.row_number().over(by_doc().orderBy("page_index", *keys)) - 1)


def with_references(ordered: DataFrame) -> DataFrame:
    """Add the reference section's bounds (ref_page, ref_y, ref_x, ref_end_page, ref_end_y; null without one) to every row."""
    at = F.struct("page_index", "block_seq", "y0", "x0")
    out = ordered.withColumn("ref", F.min(F.when(F.col("text").rlike(V.REFERENCES), at)).over(by_doc()))
    later = (F.col("page_index") > F.col("ref.page_index")) | ((F.col("page_index") == F.col("ref.page_index")) & (F.col("y0") > F.col("ref.y0")))
    ends = later & (F.col("text").rlike(V.APPENDIX_OR_CHECKLIST) | T.is_appendix_squeezed(F.col("s")))
    out = out.withColumn("ref_end", F.min(F.when(ends, at)).over(by_doc())).withColumn("n_pages", (F.max("page_index").over(by_doc()) + 1))
    has = F.col("ref").isNotNull()
    return out.withColumns({
        "ref_page": F.col("ref.page_index"), "ref_y": F.col("ref.y0"), "ref_x": F.col("ref.x0"), "ref_end_page": F.when(has, F.coalesce("ref_end.page_index", "n_pages")),
        "ref_end_y": F.when(has, F.coalesce("ref_end.y0", F.lit(float("inf")))),
    }).drop("ref", "ref_end", "n_pages")


def reference_block() -> Column:
    page, y0, right = F.col("page_index"), F.col("y0"), F.col("page_w") / 2
    at_start, low = page == F.col("ref_page"), y0 < F.col("ref_y") - 4
    column_rule = at_start & (F.col("ref_y") < 160) & (F.col("ref_x") > right)
    return F.coalesce(
        F.when(F.col("ref_page").isNull() | (page < F.col("ref_page")) | (page > F.col("ref_end_page")), False)
        .when(column_rule, (F.col("x0") > right) & ~low)
        .when(at_start & low, False)
        .otherwise(~((page == F.col("ref_end_page")) & (y0 >= F.col("ref_end_y") - 4))),
        F.lit(False),
    )


def with_flags(blocks: DataFrame) -> DataFrame:
    """All rules of a block, and ``body``: the first rule that fits decides."""
    out = with_references(with_order(with_features(blocks)))
    out = out.withColumns({
        "version_footer": version_footer(), "conference_header": conference_header(), "reference": reference_block(), "side_note": side_note(), "table": table_block(), "formula": formula_block(),
        "figure_label": figure_label(), "metadata": first_page_metadata(), "heading": heading(), "appendix": appendix_heading(), "lettered": lettered_heading(), "roman": roman_heading(), "title": title_block(),
        "drop_cap": T.drop_cap(F.col("text")), "translatable": T.should_translate(F.col("text")), "continues": T.paragraph_continues(F.col("text")),
    })
    wide = F.col("w") >= 25
    body = (
        F.when(F.col("journal_header") | F.col("conference_header") | F.col("version_footer") | F.col("reference") | F.col("side_note"), False)
        .when(F.col("caption"), F.col("translatable"))
        .when(F.col("table") | F.col("formula") | F.col("figure_label") | F.col("metadata"), False)
        .when((F.col("page_index") == 0) & (F.col("y0") < 130) & (F.col("w") > 250), F.col("translatable"))
        .when(F.col("ieee_page") & (F.col("drop_cap").isNotNull() | F.col("roman") | F.col("lettered")), wide)
        .when(F.col("heading"), wide)
        .when(F.col("w") < 170, T.is_context_label(F.col("text")))
        .otherwise(F.col("translatable"))
    )
    plain = (F.col("align") == "left") & ~F.col("bold") & ~F.col("italic")
    sized = (F.col("w") >= 170) & F.col("font_size").between(6, 12)
    out = out.withColumn("body", body).withColumn("breaks", F.col("reference") | F.col("table") | F.col("formula") | F.col("figure_label"))
    return out.withColumns({
        "layout_body": F.col("body") & ~F.col("caption") & ~F.col("heading") & plain & ~F.col("leading_bold") & sized,
        "regular_body": F.col("body") & plain & ~F.col("leading_bold") & (F.col("line_count") >= 2) & sized,
        "body_like": plain & ~F.col("caption") & (F.col("line_count") >= 2) & (F.col("w") >= 170) & (F.col("font_size") <= 12),
    })


def body_font_size(flags: DataFrame) -> DataFrame:
    """(doc_id, body_size): the upper median of regular body sizes, to halves (ties to even), counted per distinct size."""
    sizes = flags.where("regular_body").groupBy("doc_id", "font_size").agg(F.count(F.lit(1)).alias("n"))
    run = sizes.withColumn("upto", F.sum("n").over(by_doc().orderBy("font_size"))).withColumn("total", F.sum("n").over(by_doc()))
    return run.where(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("doc_id").agg((F.bround(F.min("font_size") * 2) / 2).alias("body_size"))


def with_body_size(flags: DataFrame) -> DataFrame:
    """Add ``body_size`` as ``body_font_size`` has it, by a window over what is dealt out by document already: no second look at the rules."""
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN regular_body THEN font_size END DESC) OVER (PARTITION BY doc_id)")
    return flags.withColumn("body_size", F.bround(upper * 2) / 2)


def trim_captions(features: DataFrame) -> DataFrame:
    """Clamp a caption's lower edge to just above the first table header below it on the page; other blocks stay."""
    captions = features.where("caption").select("doc_id", "page_index", "block_id", "x0", "x1", "y0")
    heads = features.where("table_header").select("doc_id", "page_index", F.col("block_id").alias("head_id"), F.col("x0").alias("hx0"), F.col("x1").alias("hx1"), F.col("y0").alias("hy0"))
    near = captions.join(heads, ["doc_id", "page_index"]).where((F.col("head_id") != F.col("block_id")) & (F.col("hy0") > F.col("y0")) & (F.col("hy0") - F.col("y0") <= 25) & (F.least("x1", "hx1") - F.greatest("x0", "hx0") > 20))
    cut = near.groupBy("doc_id", "block_id").agg(F.min("hy0").alias("head_y"))
    out = features.join(cut, ["doc_id", "block_id"], "left")
    return out.withColumn("y1", F.when(F.col("head_y").isNotNull(), F.greatest(F.col("y0") + 6, F.least("y1", F.col("head_y") - 1))).otherwise(F.col("y1")))
