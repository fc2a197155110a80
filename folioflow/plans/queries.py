"""Registered queries over the given tables: each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify, fitting, glossary, layout, lines, provider, units
from ..operators.answers import Answers
from ..sources.stored import shared_folder, written
from ..sources.tables import blocks, table
from ..streaming import jobs, records
from . import pipeline, runs

FLAGS = (
    "caption", "table_header", "journal_header", "version_footer", "conference_header", "reference", "side_note", "table", "formula", "figure_label", "metadata", "heading", "appendix", "lettered", "roman", "title",
    "body", "breaks", "layout_body", "regular_body", "body_like", "continues", "translatable",
)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    return classify.with_flags(blocks(spark, d))


def _long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def clean_text(spark, d):
    text = F.replace(F.col("text"), F.lit(" of "), F.lit("-\nof "))
    return table(spark, d, "documents").select("doc_id", T.clean_text(text).alias("cleaned"))


def text_measures(spark, d):
    c = F.col("line")
    return _lines(spark, d).select("doc_id", "line_no", _long(T.word_count(c)).alias("words"), T.should_translate(c).alias("translatable"), T.paragraph_continues(c).alias("continues"), T.reading_priority(c).alias("priority"), T.is_context_label(c).alias("label"))


def source_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(T.source_terms(F.col("text"))), " ").alias("terms"))


def html_fragments(spark, d):
    """Fragments of whole lines, half of each translated, with a mark in the middle."""
    half = F.floor(F.length("line") / 2).cast("int")
    mixed = F.concat(provider.offline(F.substring("line", F.lit(1), half)), F.lit("\n<b>&"), F.substring("line", half + 1, F.length("line")))
    return _lines(spark, d).select("doc_id", "line_no", T.html_fragments(mixed).alias("fragments"))


def bold_segments(spark, d):
    c = F.replace(F.col("line"), F.lit(" of "), F.lit(" **of** "))
    rows = _lines(spark, d).select("doc_id", "line_no", T.leading_style_end(F.col("line")).alias("lead"), F.posexplode(T.bold_segments(c)).alias("pos", "s"))
    return rows.select("doc_id", "line_no", "lead", "pos", F.col("s.text").alias("segment"), F.col("s.bold").alias("bold"))


def styled_html(spark, d):
    c = F.replace(F.col("text"), F.lit(" of "), F.lit(" **of** "))
    return blocks(spark, d).select("doc_id", "block_id", T.styled_html(c, F.col("bold"), F.col("italic"), F.col("leading_bold")).alias("html"))


def clean_translation(spark, d):
    """Pages' HTML through the cleaning of translations, entities decoded."""
    return table(spark, d, "pages").select("page_id", T.clean_translation(F.regexp_replace("html", "<[^>]*>", " ")).alias("cleaned"))


def upload_names(spark, d):
    c = F.concat(F.col("url"), F.when(F.col("page_id") % 3 == 0, ".PDF").when(F.col("page_id") % 3 == 1, ".pdf").otherwise(""))
    name = T.clean_upload_filename(c)
    return table(spark, d, "pages").select("page_id", name.alias("filename"), T.output_path(name).alias("output"))


def log_kinds(spark, d):
    """Conversation turns as log lines, with markers by turn."""
    c = F.concat(F.when(F.col("turn") % 4 == 0, "Job ").when(F.col("turn") % 4 == 1, "ERROR ").when(F.col("turn") % 4 == 2, "saved: ").otherwise(""), F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.log_kind(c).alias("kind"))


def raw_line_blocks(spark, d):
    """Raw lines cut at captions, wraps and formula tails, with text, box and style."""
    return lines.extract_blocks(lines.raw_blocks(table(spark, d, "documents").select("doc_id", "text")))


def doc_blocks(spark, d):
    return blocks(spark, d)


def block_flags(spark, d):
    return _flags(spark, d).select("doc_id", "block_id", *FLAGS)


def block_features(spark, d):
    f = classify.with_features(blocks(spark, d))
    return f.select("doc_id", "block_id", *(_long(c).alias(c) for c in ("n_num", "n_dec", "n_w1", "n_w2", "n_w3", "n_big_o", "n_math", "page_blocks")), _long(T.table_header_score(F.col("t"))).alias("header_score"))


def reading_order(spark, d):
    o = classify.with_order(classify.with_features(blocks(spark, d)))
    return o.select("doc_id", "block_id", "page_index", "band", "col", "y_bucket", "priority", "ieee_page", _long("block_seq").alias("block_seq"), _long("global_seq").alias("global_seq"))


def references_range(spark, d):
    r = classify.with_references(classify.with_order(classify.with_features(blocks(spark, d))))
    return r.where("ref_page is not null").groupBy("doc_id").agg(*(F.min(c).alias(c) for c in ("ref_page", "ref_y", "ref_end_page"))).select("doc_id", "ref_page", "ref_y", "ref_end_page")


def body_font_size(spark, d):
    return classify.body_font_size(_flags(spark, d))


def caption_trim(spark, d):
    return classify.trim_captions(classify.with_features(blocks(spark, d))).select("doc_id", "block_id", "y0", "y1")


def translation_units(spark, d):
    u = units.translation_units(_flags(spark, d))
    return u.select("doc_id", _long("unit_index").alias("unit_index"), F.array_join(F.transform("indexes", lambda i: i.cast("string")), ",").alias("indexes"), "text")


def translation_batches(spark, d):
    b = units.translation_batches(units.translation_units(_flags(spark, d)), 4, 3000)
    return b.select("doc_id", _long("unit_index").alias("unit_index"), _long("batch_id").alias("batch_id"))


def _by_block(spark, d):
    """Flags with every body block translated by the native offline provider."""
    return _flags(spark, d).withColumn("translated", F.when(F.col("body"), provider.offline(F.col("text"))).otherwise(F.col("text")))


def layout_groups(spark, d):
    g = layout.layout_groups(_by_block(spark, d))
    return g.select("doc_id", "page_index", _long("group_id").alias("group_id"), F.array_join(F.transform("block_seqs", lambda i: i.cast("string")), ",").alias("block_seqs"), "text", "hidden", "x0", "y0", "x1", "y1", _long("line_count").alias("line_count"))


def rect_pushdown(spark, d):
    g = layout.push_down(layout.layout_groups(_by_block(spark, d)))
    return g.select("doc_id", "page_index", _long("group_id").alias("group_id"), "mode", *(F.col(f"placed.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")))


def text_fit(spark, d):
    """Size, line height and scale at which each group's translation is set, its lines and the height to spare."""
    blocks_ = classify.with_body_size(_flags(spark, d)).withColumn("translated", F.when(F.col("body"), provider.offline(F.col("text"))).otherwise(F.col("text")))
    g = fitting.text_fit(layout.push_down(layout.layout_groups(blocks_)))
    fit = {c: F.col(f"fit.{c}") for c in ("size", "line_height", "scale", "spare")}
    return g.select("doc_id", "page_index", _long("group_id").alias("group_id"), "mode", *(v.alias(k) for k, v in fit.items()), _long("fit.lines").alias("lines"), "fits", "css")


def cover_boxes(spark, d):
    return layout.cover_boxes(layout.changed_blocks(_by_block(spark, d))).select("doc_id", "page_index", _long("block_seq").alias("block_seq"), "x0", "y0", "x1", "y1")


def split_translation(spark, d):
    """Units' translations cut back over their blocks."""
    flags = written(_flags(spark, d)).repartition("doc_id")
    u = units.translation_units(flags).withColumn("final", provider.offline(F.col("text")))
    return pipeline.translated_blocks(flags, u).where("body").select("doc_id", "block_id", "translated")


def font_candidates(spark, d):
    f = classify.with_body_size(_flags(spark, d))
    base = layout.base_font_size(F.col("body_like"), F.col("body_size"))
    sizes = layout.font_size_candidates(base)
    pairs = F.transform(layout.layout_candidates(sizes, F.col("body_like")), lambda p: F.concat_ws("/", p["size"].cast("string"), p["line_height"].cast("string")))
    return f.select("doc_id", "block_id", base.alias("base"), F.array_join(pairs, " ").alias("candidates"))


def heading_glossary(spark, d):
    f = blocks(spark, d).select("doc_id", "block_id", F.coalesce(glossary.fixed_section(F.col("text")), glossary.fixed_heading(F.col("text")), glossary.fixed_short(F.col("text"))).alias("fixed"))
    return f.where("fixed is not null")


def heading_glossary_join(spark, d):
    """Headings by a join with the glossary table, for glossaries that come as tables; its few dozen rows are broadcast."""
    key = F.lower(T.squeeze(F.col("text")))
    g = glossary.glossary(spark).where("kind = 'heading'").select("key", "value")
    return blocks(spark, d).withColumn("key", key).join(F.broadcast(g), "key").select("doc_id", "block_id", "value")


def translation_checks(spark, d):
    rows = _lines(spark, d).withColumn("out", F.when(F.col("line_no") % 3 == 0, F.col("line")).otherwise(provider.offline(F.col("line"))))
    a, b = F.col("line"), F.col("out")
    rows = rows.withColumns({"keeps_terms": glossary.preserves_terms(a, b), "untranslated": glossary.looks_untranslated(a, b)})
    return rows.select("doc_id", "line_no", "keeps_terms", "untranslated", (~F.col("keeps_terms") | F.col("untranslated") | glossary.drifts(a, b)).alias("suspicious"), glossary.suspicious_title(a, b).alias("bad_title"))


def retry_merge(spark, d):
    first, second = F.when(F.col("line_no") % 2 == 0, F.col("line")).otherwise(provider.offline(F.col("line"))), provider.offline(F.col("line"))
    return _lines(spark, d).select("doc_id", "line_no", glossary.merge_retry(F.col("line"), first, second).alias("kept"))


def sanitized(spark, d):
    f = _flags(spark, d)
    return f.where("body").select("doc_id", "block_id", glossary.sanitize(F.col("text"), provider.offline(F.col("text")), F.col("heading")).alias("kept"))


def missing_units(spark, d):
    """Units whose answers a provider dropped (every seventh here)."""
    u = units.translation_units(_flags(spark, d)).select("doc_id", _long("unit_index").alias("unit_index"))
    return glossary.missing_units(u, u.where("(doc_id + unit_index) % 7 <> 0"))


def provider_answers(spark, d):
    """Batches through the provider boundary (the offline provider in Python)."""
    b = units.translation_batches(units.translation_units(_flags(spark, d)), 4, 3000)
    return provider.translate(b).select("doc_id", _long("unit_index").alias("unit_index"), "translated", "error")


def prompt_json(spark, d):
    g = _lines(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("line_no").alias("unit_index"), F.col("line").alias("text")))).alias("items"))
    return g.select("doc_id", provider.prompt(F.col("items")).alias("prompt"))


def parse_response(spark, d):
    """Each document's prompt as an answer in a code fence, read back and cleaned."""
    answered = prompt_json(spark, d).select("doc_id", F.concat(F.lit("```json\n"), F.col("prompt"), F.lit("\n```")).alias("response"))
    return provider.response_rows(answered, "response").select("doc_id", _long("id").alias("id"), "text")


def translated_documents(spark, d):
    """The whole path from blocks to placed layout groups, with the provider in Python."""
    g = pipeline.translate_documents(blocks(spark, d), max_items=4)["groups"]
    return g.select("doc_id", "page_index", "group_id", "text", "hidden", "mode")


def document_ledger(spark, d):
    """A run over all documents with a provider that refuses long texts; toxic documents come with a damaged font size."""
    toxic = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    damaged = blocks(spark, d).join(toxic, "doc_id", "left").withColumn("font_size", F.when(F.coalesce("toxic", F.lit(0)) == 1, F.lit(0.0)).otherwise(F.col("font_size"))).drop("toxic")
    folder = shared_folder(spark)
    runs.run_documents(damaged, folder, store=Answers(spark, folder, provider.LimitedTranslator, sleep=0.0))
    return runs.ledger(spark, folder).select("doc_id", "status", "error", "blocks")


def document_summary(spark, d):
    return pipeline.document_summary(blocks(spark, d))


def dedupe_digest(spark, d):
    return jobs.duplicate_sources(table(spark, d, "documents"))


def job_state(spark, d):
    s = jobs.job_state(jobs.job_events(table(spark, d, "events")))
    return s.select("job_id", "status", *(_long(c).alias(c) for c in ("pages", "blocks", "batches_completed", "n_logs", "last_seq")), "error")


def job_records(spark, d):
    """Records of created jobs, started anew by requeues."""
    r = records.job_records(records.record_events(table(spark, d, "events")))
    return r.select("job_id", "filename", "status", *(_long(c).alias(c) for c in (*records.FIELDS, "n_logs", "last_seq")), "last_log", "error", "translated_path", F.round(F.col("created_at") * 1_000_000).cast("long").alias("created_us"))


def job_changes(spark, d):
    c = jobs.job_changes(jobs.job_events(table(spark, d, "events")))
    return c.select("job_id", "seq", "status", *(_long(x).alias(x) for x in ("batches_completed", "n_logs")))


def job_frames(spark, d):
    """Snapshots as a client receives them."""
    c = job_changes(spark, d)
    return c.select("job_id", "seq", jobs.sse_frame(F.struct("job_id", "seq", "status")).alias("frame"))


def merge_jobs(spark, d):
    """Ended jobs come in over the same ones as queued."""
    s = job_state(spark, d)
    old = s.withColumn("status", F.lit("queued"))
    return jobs.merge_jobs(old, s.where("status in ('done', 'failed')")).select("job_id", "status", "last_seq")


def _named(spark, d):
    """All documents as files d<doc_id>, with their labels (null: none)."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("n"), "doc_id", "text", "source", "quality", "toxic")


def restore_jobs(spark, d):
    """Every document has an output, labelled ones an original, those of low quality a job already."""
    docs, pdf = _named(spark, d), F.concat("n", F.lit(".pdf"))
    outputs = docs.select(F.concat("n", F.lit("_zh-CN.pdf")).alias("name"), F.col("doc_id").cast("double").alias("modified"))
    originals, known = docs.where("quality is not null").select(pdf.alias("name")), docs.where("quality = 0").select(pdf.alias("filename"))
    return jobs.restore_jobs(outputs, originals, known).select("job_id", "filename", "translated_path", "created_at")


def upload_actions(spark, d):
    """Every document comes as an upload; labelled ones are there already, good ones with a job, toxic ones with an output."""
    docs = _named(spark, d).withColumn("name", F.concat("n", F.lit(".pdf"))).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    known = docs.where("quality = 1").select(F.col("name").alias("filename"), F.col("doc_id").cast("string").alias("job_id"))
    return jobs.new_uploads(docs.select("name", "digest"), docs.where("quality is not null"), known, docs.where("toxic = 1").select(F.col("name").alias("filename"))).select("name", "source", "job_id", "action")


def safe_names(spark, d):
    """Every document comes as an upload named after its source; labels tell which names are taken, with gaps."""
    docs = _named(spark, d)
    number = 2 * F.col("quality") + 3 * F.col("toxic")
    taken = docs.where("quality is not null").select(F.concat("source", F.when(number > 0, F.concat(F.lit("_"), number.cast("string"))).otherwise(""), F.lit(".pdf")).alias("name"))
    return jobs.safe_names(docs.select(F.col("doc_id").alias("seq"), F.concat("source", F.lit(".pdf")).alias("name")), taken)


def shown_requests(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, "GET").otherwise("POST").alias("method"), F.concat(F.when(F.col("event_id") % 3 == 0, "/api/files/original/").otherwise("/api/jobs/"), F.col("user_id").cast("string")).alias("path"), F.when(F.col("event_id") % 5 < 3, 206).otherwise(200).alias("status"))
    return jobs.shown_requests(e)


def job_listing(spark, d):
    s = job_state(spark, d).withColumn("batches_total", F.lit(50)).withColumn("created_at", F.col("last_seq").cast("double"))
    return jobs.listing(s).select("job_id", "label", "percent", T.created_label(F.col("created_at")).alias("created"))


def safe_paths(spark, d):
    return table(spark, d, "pages").select("page_id", jobs.safe_path(F.element_at(F.split("url", "/"), -1)).alias("name"))


def line_heights(spark, d):
    return table(spark, d, "part").select("p_partkey", T.line_height_or_null((F.col("p_size") / 20.0).cast("string")).alias("line_height"))


_NAMES = (
    "clean_text text_measures source_terms html_fragments bold_segments styled_html clean_translation upload_names log_kinds raw_line_blocks doc_blocks block_features block_flags reading_order references_range "
    "body_font_size caption_trim translation_units translation_batches layout_groups rect_pushdown text_fit cover_boxes split_translation font_candidates heading_glossary heading_glossary_join translation_checks retry_merge sanitized "
    "missing_units provider_answers prompt_json parse_response translated_documents document_ledger document_summary dedupe_digest job_state job_records job_changes job_frames merge_jobs restore_jobs upload_actions safe_names shown_requests job_listing safe_paths line_heights"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}
