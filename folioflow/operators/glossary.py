"""Fixed translations (headings, short labels, section titles), overrides in order, and checks of what a provider returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as T


def glossary(spark: SparkSession) -> DataFrame:
    """(kind, key, value) of all glossaries; a few dozen rows."""
    kinds = {"heading": V.HEADING_PHRASES | V.COMMON_HEADINGS, "section": V.COMMON_HEADINGS | V.SECTION_HEADINGS_EXTRA, "inline": V.INLINE_HEADINGS, "label": V.CONTEXT_TRANSLATIONS, "proof": V.PROOF_KINDS}
    return spark.createDataFrame([(k, a, b) for k, m in kinds.items() for a, b in m.items()], "kind string, key string, value string")


def _lookup(table: dict[str, str], key: Column) -> Column:
    """A glossary of a few dozen entries as a literal map: no join, no exchange."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def heading_phrase(c: Column) -> Column:
    proof = r"^proof of (proposition|theorem|lemma|corollary)\s+([\w.]+)"

    def known(key: Column) -> Column:
        template = F.concat(_lookup(V.PROOF_KINDS, F.regexp_extract(key, proof, 1)), F.regexp_extract(key, proof, 2), F.lit("的证明"))
        return F.coalesce(_lookup(V.HEADING_PHRASES | V.COMMON_HEADINGS, key), F.when(key.rlike(proof), template))

    return T.bind(F.lower(T.strip(c)), known)


def fixed_heading(c: Column) -> Column:
    """A heading's fixed translation, its number or letter kept; null if unknown."""
    numbered = r"^([A-Z](?:\.\p{Nd}+)*|\p{Nd}+(?:\.\p{Nd}+)*)\s+(.+)$"

    def found(s: Column) -> Column:
        number, is_numbered = F.regexp_extract(s, numbered, 1), s.rlike(numbered)
        phrase = heading_phrase(F.when(is_numbered, F.regexp_extract(s, numbered, 2)).otherwise(s))
        return F.when(is_numbered, F.concat(number, F.lit(" "), phrase)).otherwise(phrase)

    return T.bind(T.squeeze(c), found)


def fixed_short(c: Column) -> Column:
    def found(s: Column) -> Column:
        mail = F.regexp_replace(F.regexp_replace(s, *V.CORRESPONDENCE_REWRITE), *V.SENIOR_REWRITE)
        return F.when(s.rlike(V.CONFERENCE_HEADER), V.CONFERENCE_TRANSLATION).when(s.rlike(V.CORRESPONDENCE), mail).when(T.is_context_label(s), _lookup(V.CONTEXT_TRANSLATIONS, T.context_label(s)))

    return T.bind(T.squeeze(c), found)


def fixed_section(c: Column) -> Column:
    form = r"^([A-Z]+)\.\s+(.+)$"
    found = lambda s: F.when(s.rlike(form), F.concat(F.regexp_extract(s, form, 1), F.lit(". "), _lookup(V.COMMON_HEADINGS | V.SECTION_HEADINGS_EXTRA, F.lower(F.regexp_extract(s, form, 2)))))
    return T.bind(T.squeeze(c), found)


def strip_section(translated: Column, heading: Column, source: Column) -> Column:
    """A body translation without the section heading (translated or source) before it."""
    t = T.strip(translated)
    tail = lambda h: F.regexp_replace(F.substring(t, F.length(h) + 1, F.length(t)), r"^[ \t\r\n:：,，.。\-—]+", "")
    word = F.regexp_replace(heading, r"(?U)^\S+\s+", "")
    bare = F.regexp_replace(t, r"^(?:[IVX]+\.\s*)?", "")
    rest = T.strip(F.regexp_replace(T.strip(F.substring(bare, F.length(word) + 1, F.length(bare))), "^[:：,，.。—-]", ""))
    return F.when(F.startswith(t, heading), tail(heading)).when(F.startswith(t, source), tail(source)).when(F.startswith(bare, word) & (rest != ""), rest).otherwise(t)


def split_leading_heading(source: Column, translated: Column, leading_bold: Column) -> Column:
    """A blank line after an inline heading at a translation's start, where the source starts with that heading too."""

    def split(s: Column) -> Column:
        out = translated
        for key, value in reversed(V.INLINE_HEADINGS.items()):
            rest = F.regexp_replace(F.substring(translated, F.lit(len(value) + 1), F.length(translated)), "^[ ：:]+", "")
            cut = F.when(translated.startswith(value) & ~translated.startswith(value + "\n\n") & (rest != ""), F.concat(F.lit(value + "\n\n"), rest)).otherwise(translated)
            out = F.when(s.startswith(key + " "), cut).otherwise(out)
        return out

    return F.when(leading_bold, T.bind(F.lower(T.squeeze(source)), split)).otherwise(translated)


# --- checks -----------------------------------------------------------------------------------------------------------


def preserves_terms(source: Column, translated: Column) -> Column:
    def kept(terms: Column) -> Column:
        present = F.size(F.filter(terms, lambda t: F.contains(translated, t)))
        return (F.size(terms) == 0) | (present >= F.greatest(F.lit(1), F.floor(F.size(terms) / 3)))

    return T.bind(F.filter(T.source_terms(source), lambda t: F.length(t) <= 20), kept)


def looks_untranslated(source: Column, translated: Column) -> Column:
    def same(n: Column) -> Column:
        cjk, words = F.regexp_count(translated, F.lit(r"[\x{3400}-\x{9fff}]")), F.regexp_count(translated, F.lit(V.PLAIN_WORD))
        return (n >= 6) & (cjk < F.greatest(F.lit(6), F.floor(n / 4))) & (words >= F.greatest(F.lit(4), F.floor(n / 2)))

    return T.bind(F.regexp_count(source, F.lit(V.PLAIN_WORD)), same)


def drifts(source: Column, translated: Column) -> Column:
    low = F.lower(source)
    about = lambda topics: low.rlike("|".join(topics))
    return (about(V.GRAPH_TOPICS) & translated.rlike(V.GRAPH_DRIFT)) | (about(V.NEURO_TOPICS) & translated.rlike(V.NEURO_DRIFT))


def suspicious(source: Column, translated: Column) -> Column:
    return ~preserves_terms(source, translated) | looks_untranslated(source, translated) | drifts(source, translated)


def suspicious_title(source: Column, translated: Column) -> Column:
    t = T.strip(translated)
    return (t == "") | (F.regexp_count(t, F.lit("[。！？]")) > 1) | (F.length(t) > F.greatest(F.lit(70.0), F.length(source) * 1.8))


def sanitize(source: Column, translated: Column, is_heading: Column) -> Column:
    """A single heading's translation: the glossary's, or the source where the translation looks wrong."""
    t = T.strip(translated)
    wrong = suspicious(source, t) | suspicious_title(source, t) | (F.length(t) > F.greatest(F.lit(28), F.length(source) * 3)) | t.contains("\n") | (F.regexp_count(t, F.lit("[。.]")) > 1)
    return F.when(~is_heading, translated).otherwise(F.coalesce(fixed_heading(source), F.when(wrong, source).otherwise(t)))


def merge_retry(source: Column, first: Column, second: Column) -> Column:
    """Keep a retry that is clean, or that at least has CJK where the first answer had none."""
    cjk = lambda c: c.rlike(r"[\x{3400}-\x{9fff}]")
    return F.when(suspicious(source, first) & second.isNotNull() & (~suspicious(source, second) | (cjk(second) & ~cjk(first))), second).otherwise(first)


def merge_title_retry(source: Column, first: Column, second: Column) -> Column:
    return F.when(suspicious_title(source, first) & second.isNotNull() & ~suspicious_title(source, second), second).otherwise(first)


def missing_units(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """Requested units without an answer; a document with any fails as a whole."""
    return requested.join(returned.select("doc_id", "unit_index"), ["doc_id", "unit_index"], "left_anti")
