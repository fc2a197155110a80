"""End to end: blocks, rules, units, batches, provider, checks and overrides, back to blocks, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as T
from ..operators import classify, fitting, glossary, layout, provider, units
from ..operators.answers import Answers
from ..sources.stored import written


def translated_units(unit_rows: DataFrame, flags: DataFrame, answers: DataFrame, make: type | None = None, store: Answers | None = None) -> DataFrame:
    """Units with their final translation, and ``error`` where a call for them failed.

    A unit of one block takes a short label or heading from the glossaries; other answers are cleaned, and doubtful ones are
    asked for once more, alone.  Titles of a journal's first page that are still doubtful have a call of their own.  Section
    headings and conference headers come from the glossaries again, headings are checked, inline headings set apart.
    answers: doc_id, unit_index, translated.  Both further calls go through ``store`` (a new one if none is given).
    """
    store = store or Answers(unit_rows.sparkSession, make=make)
    of_first = ("heading", "leading_bold", "ieee_page", "roman", "lettered", "title", "conference_header", "page_index")
    first = flags.select("doc_id", F.col("global_seq").alias("first"), *of_first)
    rows = unit_rows.withColumn("first", F.col("indexes")[0]).join(first, ["doc_id", "first"]).join(answers.select("doc_id", "unit_index", "translated"), ["doc_id", "unit_index"], "left")
    source, single = F.col("text"), F.size("indexes") == 1
    short, heading = glossary.fixed_short(source), glossary.fixed_heading(source)
    rows = rows.withColumn("fixed", F.when(single, F.coalesce(short, heading))).withColumn("translated", T.clean_translation(F.col("translated")))
    rows = rows.withColumn("is_title", single & (F.col("page_index") == 0) & F.col("ieee_page") & F.col("title"))
    rows = rows.withColumn("doubtful", F.col("fixed").isNull() & F.col("translated").isNotNull() & glossary.suspicious(source, F.col("translated")))

    def again(df: DataFrame, wanted: Column, kind: str) -> DataFrame:
        asked = df.where(wanted).select("doc_id", F.col("unit_index").alias("batch_id"), "unit_index", "text")
        got = store.ask(asked, kind).select("doc_id", "unit_index", T.clean_translation(F.col("translated")).alias("again"), F.coalesce("error", F.when(F.col("translated").isNull(), f"no answer to the {kind} call")).alias(f"{kind}_error"))
        return df.join(got, ["doc_id", "unit_index"], "left")

    rows = again(written(rows), F.col("doubtful"), "unit")
    rows = rows.withColumn("final", F.coalesce("fixed", glossary.merge_retry(source, F.col("translated"), F.col("again")))).drop("again")
    rows = again(written(rows), F.col("is_title") & F.col("final").isNotNull() & glossary.suspicious_title(source, F.col("final")), "title")
    rows = rows.withColumn("final", F.when(F.col("is_title"), glossary.merge_title_retry(source, F.col("final"), F.col("again"))).otherwise(F.col("final")))
    section = F.when(single & F.col("ieee_page") & (F.col("roman") | F.col("lettered")), glossary.fixed_section(source))
    rows = rows.withColumn("final", F.coalesce(F.when(single & F.col("conference_header"), short), section, F.col("final")))
    rows = rows.withColumn("final", F.when(single, glossary.sanitize(source, F.col("final"), F.col("heading"))).otherwise(F.col("final")))
    rows = rows.withColumn("final", F.when(single, glossary.split_leading_heading(source, F.col("final"), F.col("leading_bold"))).otherwise(F.col("final")))
    rows = rows.withColumn("error", F.coalesce("unit_error", "title_error"))
    return rows.withColumn("suspicious", F.coalesce(glossary.suspicious(source, F.col("final")), F.lit(True))).drop("fixed", "again", "is_title", "doubtful", "unit_error", "title_error")


def translated_blocks(flags: DataFrame, unit_rows: DataFrame, line_height: float = V.DEFAULT_LINE_HEIGHT) -> DataFrame:
    """flags with ``translated``: a unit's translation cut over its blocks.

    Behind a drop cap the section's heading is its block's part and the rest is cut over the others.  Blocks that keep their
    text, and conference headers, take a short label's translation from the glossary.
    """
    at = unit_rows.select("doc_id", "unit_index", "final", F.posexplode("indexes").alias("nth", "global_seq"))
    box = flags.select("doc_id", "global_seq", F.struct("w", "h", "font_size", "page_index", "x0", "y0", "ieee_page", F.col("drop_cap.heading").alias("lead"), F.col("text").rlike(V.CAPITAL_WORD).alias("capital")).alias("box"))
    packed = at.join(box, ["doc_id", "global_seq"]).groupBy("doc_id", "unit_index", "final").agg(F.sort_array(F.collect_list(F.struct("nth", "global_seq", "box"))).alias("a"))
    packed = packed.withColumn("boxes", F.transform("a", lambda x: x["box"]))
    one, two = F.get("boxes", F.lit(0)), F.get("boxes", F.lit(1))
    caps = one["ieee_page"] & one["lead"].isNotNull() & (two["page_index"] == one["page_index"]) & (F.abs(one["x0"] - two["x0"]) <= 24) & (two["y0"] - one["y0"] <= 40) & two["capital"]
    packed = packed.withColumn("heading", F.when(caps, F.coalesce(glossary.fixed_section(one["lead"]), one["lead"])))
    packed = packed.withColumn("body", F.when(caps, glossary.strip_section(F.col("final"), F.col("heading"), one["lead"])))
    capped = F.coalesce(F.col("body") != "", F.lit(False))
    packed = packed.withColumns({"over": F.when(capped, F.slice("boxes", F.lit(2), F.size("boxes"))).otherwise(F.col("boxes")), "whole": F.when(capped, F.col("body")).otherwise(F.col("final")), "lead": F.when(capped, F.array("heading")).otherwise(F.array().cast("array<string>"))})
    packed = packed.withColumn("parts", F.concat("lead", units.split_translation(F.col("whole"), F.col("over"), line_height)))
    parts = packed.select("doc_id", F.explode(F.arrays_zip(F.transform("a", lambda x: x["global_seq"]).alias("seq"), F.col("parts").alias("part"))).alias("z"))
    parts = parts.select("doc_id", F.col("z.seq").alias("global_seq"), F.col("z.part").alias("part"))
    out = flags.join(parts, ["doc_id", "global_seq"], "left").withColumn("translated", F.coalesce("part", "text")).drop("part")
    last = F.col("conference_header") | (F.col("translated") == F.col("text"))
    return out.withColumn("translated", F.coalesce(F.when(last, glossary.fixed_short(F.col("text"))), F.col("translated")))


def failed_documents(unit_rows: DataFrame, answers: DataFrame, final: DataFrame | None = None) -> DataFrame:
    """(doc_id, error): documents of which a call failed or a unit has no answer, or a further call for a unit (``final``) failed."""
    got = answers.where("translated is not null")
    reasons = glossary.missing_units(unit_rows.select("doc_id", "unit_index"), got).groupBy("doc_id").agg(F.concat(F.lit("missing ids: "), F.array_join(F.sort_array(F.collect_list("unit_index")).cast("array<string>"), ", ")).alias("error")).withColumn("step", F.lit(1))
    for step, rows in ((0, answers), (2, final)):
        if rows is not None:
            reasons = reasons.unionByName(rows.where("error is not null").select("doc_id", "error", F.lit(step).alias("step")))
    return reasons.groupBy("doc_id").agg(F.min(F.struct("step", "error"))["error"].alias("error"))


def translate_documents(blocks: DataFrame, make: type | None = None, max_items: int = V.MAX_BATCH_ITEMS, store: Answers | None = None, line_height: float = V.DEFAULT_LINE_HEIGHT) -> dict[str, DataFrame]:
    """All stages as DataFrames: flags, units, batches, answers, final units, failed documents, and of the others blocks and groups.

    Rules, units, answers and final units are written once and read by what follows.  Every call goes through ``store``, so each text
    is asked for once, in a later run with the same store too.
    """
    store = store or Answers(blocks.sparkSession, make=make)
    flags = written(classify.with_body_size(classify.with_flags(blocks))).repartition("doc_id")
    unit_rows = written(units.translation_units(flags))
    batches = units.translation_batches(unit_rows, max_items)
    answers = written(store.ask(batches))
    final = written(translated_units(unit_rows, flags, answers, make, store))
    failed = failed_documents(unit_rows, answers, final)
    out = translated_blocks(flags, final, line_height).join(failed, "doc_id", "left_anti")
    groups = fitting.text_fit(layout.push_down(layout.layout_groups(out)), line_height)
    return {"flags": flags, "units": unit_rows, "batches": batches, "answers": answers, "final": final, "failed": failed, "blocks": out, "groups": groups}


def document_summary(blocks: DataFrame) -> DataFrame:
    """A row per document: blocks, body blocks, units, batches, characters, suspicious units; the native offline provider answers.

    The rules are evaluated once: their result is written, units and counts are read from it.
    """
    flags = written(classify.with_flags(blocks)).repartition("doc_id")
    unit_rows = units.translation_batches(units.translation_units(flags), 4, 4000)
    done = unit_rows.withColumn("translated", provider.offline(F.col("text")))
    per_unit = done.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("units"), (F.max("batch_id") + 1).cast("long").alias("batches"), F.sum(F.length("text")).alias("chars"),
        F.sum(glossary.suspicious(F.col("text"), F.col("translated")).cast("long")).alias("suspicious"),
    )
    per_doc = flags.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("body").cast("long")).alias("body_blocks"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("units", "batches", "chars", "suspicious")}
    return per_doc.join(per_unit, "doc_id", "left").select("doc_id", "blocks", "body_blocks", *zero.values())
