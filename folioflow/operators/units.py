"""Translation units and batches: gaps and islands by windows, and folds for the sequential caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as T


def in_order() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("global_seq")


def can_merge() -> Column:
    """Whether a body block goes on from the body block before it (``p``)."""
    p = F.col("p")
    stops = lambda get: get("caption") | get("heading") | (get("ieee_page") & (get("roman") | get("lettered"))) | get("bold")
    bullet = F.col("ieee_page") & F.col("text").rlike(r"(?U)^\s*•")
    same_page = (F.abs(p["x0"] - F.col("x0")) < 25) | ((p["x0"] < F.col("page_w") / 2) & (F.col("x0") > F.col("page_w") / 2) & (F.col("y0") < p["y0"]))
    place = F.when(F.col("page_index") == p["page_index"], same_page).otherwise((F.col("page_index") == p["page_index"] + 1) & (F.col("y0") < 120))
    return ~stops(lambda c: p[c]) & ~stops(F.col) & ~bullet & p["continues"] & place


def drop_cap_follows() -> Column:
    p = F.col("p")
    return F.coalesce(
        (p["page_index"] == F.col("page_index")) & F.col("ieee_page") & p["drop_cap"].isNotNull() & (F.abs(p["x0"] - F.col("x0")) <= 24) & (F.col("y0") - p["y0"]).between(0, 40) & F.col("text").rlike(V.CAPITAL_WORD),
        F.lit(False),
    )


#: Rows that a fold takes before it sets their results aside: results are appended to short lists, so long documents cost no more a row.
FOLD_ROWS = 256


def long_fold(items: str, start: dict[str, str], step: str, out: str, last: str) -> Column:
    """A fold over an array that gives out rows as it goes, in time linear in the array.

    start: the state's fields; step: SQL of the next state from ``s`` and the item ``x``, with the rows given out so far in
    ``s.out`` (of type ``out``); last: SQL of the rows that the last state ``s`` still holds.
    """
    fields = "".join(f"'{k}', {v}, " for k, v in start.items())
    again = "".join(f"'{k}', s.{k}, " for k in start)
    inner = f"aggregate(slice({items}, q * {FOLD_ROWS} + 1, {FOLD_ROWS}), named_struct({again}'out', cast(array() as array<{out}>)), (s, x) -> {step})"
    kept = "".join(f"'{k}', i.{k}, " for k in start)
    whole = f"transform(array({inner}), i -> named_struct({kept}'out', array_append(s.out, i.out)))[0]"
    steps = f"if(size({items}) = 0, cast(array() as array<int>), sequence(0, cast((size({items}) - 1) div {FOLD_ROWS} as int)))"
    return F.expr(f"aggregate({steps}, named_struct({fields}'out', cast(array() as array<array<{out}>>)), (s, q) -> {whole}, s -> concat(flatten(s.out), {last}))")


def translation_units(flags: DataFrame, max_chars: int = V.MAX_UNIT_CHARS) -> DataFrame:
    """(doc_id, unit_index, indexes, text): paragraphs merged over columns and pages, at most ``max_chars`` unless one block.

    Breaking blocks close a unit; other blocks that are no body text are passed over.
    """
    rows = flags.withColumn("closed", F.sum((~F.col("body") & F.col("breaks")).cast("int")).over(in_order())).where("body")
    before = F.struct("closed", "page_index", "x0", "y0", "caption", "heading", "ieee_page", "roman", "lettered", "bold", "continues", "drop_cap")
    rows = rows.withColumn("p", F.lag(before).over(in_order()))
    hard = F.col("p").isNull() | (F.col("p.closed") != F.col("closed"))
    rows = rows.withColumn("cap", ~hard & drop_cap_follows()).withColumn("cut", hard | ~(F.col("cap") | F.coalesce(can_merge(), F.lit(False))))
    rows = rows.withColumn("island", F.sum(F.col("cut").cast("int")).over(in_order()))
    item = F.struct("global_seq", "text", "cap", F.col("p.drop_cap").alias("lead"))
    islands = rows.groupBy("doc_id", "island").agg(F.sort_array(F.collect_list(item)).alias("items"))
    # the unit that is being filled is the state; a drop cap's heading takes the place of the block before
    unit = "struct<idx:array<int>,texts:array<string>,total:int>"
    filled = lambda idx, texts, total, out: f"named_struct('idx', {idx}, 'texts', {texts}, 'total', {total}, 'out', {out})"
    lead = filled("array_append(s.idx, x.global_seq)", "concat(slice(s.texts, 1, size(s.texts) - 1), array(x.lead.heading, concat(x.lead.letter, x.text)))", "s.total - length(element_at(s.texts, -1)) + length(x.lead.heading) + length(x.lead.letter) + length(x.text)", "s.out")
    more = filled("array_append(s.idx, x.global_seq)", "array_append(s.texts, x.text)", "s.total + length(x.text)", "s.out")
    new = filled("array(x.global_seq)", "array(x.text)", "length(x.text)", "if(size(s.idx) = 0, s.out, array_append(s.out, named_struct('idx', s.idx, 'texts', s.texts, 'total', s.total)))")
    step = f"if(size(s.idx) = 0, {new}, if(x.cap, {lead}, if(s.total + length(x.text) + size(s.texts) <= {int(max_chars)}, {more}, {new})))"
    start = {"idx": "cast(array() as array<int>)", "texts": "cast(array() as array<string>)", "total": "0"}
    folded = long_fold("items", start, step, unit, "array(named_struct('idx', s.idx, 'texts', s.texts, 'total', s.total))")
    units = islands.select("doc_id", F.explode(folded).alias("u")).select("doc_id", F.col("u.idx").alias("indexes"), F.array_join("u.texts", " ").alias("text"))
    order = Window.partitionBy("doc_id").orderBy(F.col("indexes")[0])
    return units.select("doc_id", (F.row_number().over(order) - 1).alias("unit_index"), "indexes", "text")


def translation_batches(units: DataFrame, max_items: int = V.MAX_BATCH_ITEMS, max_chars: int = V.MAX_BATCH_CHARS) -> DataFrame:
    """Add batch_id: units in order, a batch closing before it would exceed the limits; an oversized unit is alone."""
    items = units.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("unit_index", F.length("text").alias("n"), "indexes", "text"))).alias("items"))
    step = f"""if(s.k > 0 and s.k < {int(max_items)} and s.c + x.n <= {int(max_chars)},
        named_struct('b', s.b, 'k', s.k + 1, 'c', s.c + x.n, 'out', array_append(s.out, s.b)), named_struct('b', s.b + 1, 'k', 1, 'c', x.n, 'out', array_append(s.out, s.b + 1)))"""
    ids = long_fold("items", {"b": "-1", "k": "0", "c": "0"}, step, "int", "cast(array() as array<int>)")
    rows = items.select("doc_id", "items", ids.alias("ids")).select("doc_id", F.explode(F.arrays_zip("items", "ids")).alias("z"))
    return rows.select("doc_id", F.col("z.ids").alias("batch_id"), "z.items.unit_index", "z.items.indexes", "z.items.text")


def split_translation(text: Column, boxes: Column, line_height: float = V.DEFAULT_LINE_HEIGHT) -> Column:
    """Cut a unit's translation over its blocks in proportion to their room; boxes: array<struct<w, h, font_size>> in order."""
    room = F.transform(boxes, lambda b: F.greatest(F.lit(1), (b["w"] / (b["font_size"] * 0.95)).cast("int")) * F.greatest(F.lit(1), (b["h"] / (b["font_size"] * line_height)).cast("int")))
    n = F.length(text)
    empty = F.struct(F.lit(0).alias("used"), F.lit(0).alias("start"), F.array().cast("array<string>").alias("out"))

    def over(rooms: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            def part(c: Column) -> Column:
                gap = F.length(F.regexp_extract(F.substring(text, c["cut"] + 1, n), r"(?U)^\s*", 0))
                return F.struct(c["used"].alias("used"), (c["cut"] + gap).alias("start"), F.array_append(s["out"], T.strip(F.substring(text, s["start"] + 1, c["cut"] - s["start"]))).alias("out"))

            def cut(used: Column) -> Column:
                return F.struct(used.alias("used"), T.split_position(text, s["start"], F.bround(n * used / rooms["total"]).cast("int")).alias("cut"))

            return T.bind(T.bind(s["used"] + x, cut), part)

        return F.aggregate(F.slice(rooms["room"], F.lit(1), F.size(rooms["room"]) - 1), empty, step, lambda s: F.array_append(s["out"], T.strip(F.substring(text, s["start"] + 1, n))))

    total = T.bind(room, lambda r: F.struct(r.alias("room"), F.aggregate(r, F.lit(0), lambda a, x: a + x).alias("total")))
    return F.when(F.size(boxes) == 1, F.array(text)).otherwise(T.bind(total, over))
