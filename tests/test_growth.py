"""Work that grows with the rows and not with their square, and shortcuts that change no result."""

import json
import random
import threading
import time
from functools import reduce

import pytest
from pyspark.sql import functions as F

from folioflow.functions import fixed as V
from folioflow.functions import text as T
from folioflow.operators import fitting, lines, provider
from folioflow.plans import runs

MARKS = [" ", "  ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u2028", "ab-", "Word", "GNN", "(text is incomplete)", "（原文未提供）", "(", "）", "……", "...", "≤", "=", "\\alpha", "\\text{x}", "\\", "$", "$x$", "中", "文", "，", "“", "<sub>", "é", "😀", "1.5", ",", ".", ";", "x", "where:", "of", "∑", "µ", "[", "Method", "flops", "# samples", "±"]


def odd_texts(spark, n=3000):
    r = random.Random(1)
    return spark.createDataFrame([(x,) for x in [None, ""] + ["".join(r.choice(MARKS) for _ in range(r.randint(1, 12))) for _ in range(n)]], "c string")


def test_an_answer_of_4_000_items_is_parsed_once(spark):
    """The JSON was parsed anew for each of its items."""
    items = [{"id": i % 3990, "text": f"item {i} " + "x" * 100} for i in range(4000)]
    rows = spark.createDataFrame([(1, "```json\n" + json.dumps(items) + "\n```")], "doc_id long, response string")
    began = time.time()
    got = {r.id: r.text for r in provider.response_rows(rows, "response").collect()}
    assert time.time() - began < 30
    assert got == {x["id"]: x["text"] for x in items}


def test_an_answer_without_an_id_hides_no_other(spark):
    rows = spark.createDataFrame([(1, '[{"id":2,"text":"b"},{"text":"a"},{"id":1,"text":"c"}]')], "doc_id long, response string")
    assert [(r.id, r.text) for r in provider.response_rows(rows, "response").collect()] == [(2, "b"), (1, "c")]


def plain_cleaning(c):
    """The cleaning of translations step by step, without shortcuts."""
    end = "(?=[，。！？；：、\\s]|$)"
    steps = [
        ("</?(?:sub|sup)>", ""), (r"\r\n|\r", "\n"), (V.NOTE_EN, ""), (V.NOTE_ZH, ""), (rf"(?U)\s*(?:……|\.{{3,}}){end}", ""), (rf"(?U)\s*[≤<>=]\s*{end}", ""),
        (rf"\\(?:{V.LATEX_FONTS})\{{([^{{}}]+)\}}", "$1"), (rf"\\(?:{V.LATEX_TEXT})\{{([^{{}}]+)\}}", "$1"),
        *((rf"\\{k}(?![A-Za-z])", v) for k, v in V.LATEX_SYMBOLS.items()), (r"\\[A-Za-z]+", ""), (r"\\", ""),
        (r"(?U)\${1,2}\s*([^$]+?)\s*\${1,2}", "$1"), (r"\$", ""), (r"[ \t]*\n+[ \t]*", " "), (r"[ \t]+", " "),
        (r"(?U)(?<=[\x{3400}-\x{9fff}])\s+(?=[\x{3400}-\x{9fff}])", ""), (r"(?U)(?<=[，。！？；：、（《【“‘])\s+", ""), (r"(?U)\s+(?=[，。！？；：、）】》”’])", ""), (r"(?U)^\s+|\s+$", ""),
    ]
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, c)


def test_shortcuts_of_text_functions_change_nothing(spark):
    c = F.col("c")
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?U)(?<=\w)-\s*\n\s*(?=\w)", ""), r"(?U)\s*\n\s*", " "), r"[ \t]+", " ")
    t = F.regexp_replace(c, r"(?U)\s+$", "")
    marks = F.length(F.regexp_replace(c, r"(?U)[\p{L}\p{N}\s]", ""))
    pairs = {
        "strip": (T.strip(c), strip(c)),
        "squeeze": (T.squeeze(c), F.regexp_replace(strip(c), r"(?U)\s+", " ")),
        "clean_text": (T.clean_text(c), strip(clean)),
        "cleaned": (T.clean_translation(c, entities=False), plain_cleaning(c)),
        "label": (T.context_label(c), F.lower(F.regexp_replace(F.regexp_replace(strip(c), r"(?U)\s+", " "), "[:：]+$", ""))),
        "continues": (T.paragraph_continues(c), (F.length(t) > 0) & t.rlike(r"(?:;|\p{Ll}|[,，\-–])$") & ~t.rlike(r"[.?!。？！:：]$")),
        "translatable": (T.should_translate(c), (F.length(strip(c)) >= 3) & (T.word_count(c) > 0) & ((marks / F.greatest(F.length(c), F.lit(1)) <= 0.45) | (T.word_count(c) >= 4))),
    }
    pairs["marks"] = (F.regexp_count(c, F.lit(T.one_of(V.MATH_LINE))), F.regexp_count(c, F.lit(T.any_of(V.MATH_LINE))))
    pairs["headers"] = (T.table_header_score(c), reduce(lambda a, b: a + b, (F.lower(c).rlike(p).cast("int") for p in V.TABLE_HEADERS)))
    kinds = F.transform(F.regexp_extract_all(c, F.lit(rf"\n|[ \t\x0b\f\r]+|{T.CJK_CLASS}+|[^ \t\n\x0b\f\r{T.CJK_CLASS[1:-1]}]+"), F.lit(0)), lambda r: F.struct(F.when(r == "\n", fitting.END).when(r.rlike(r"^[ \t\x0b\f\r]"), fitting.BLANK).when(T.is_cjk(r), fitting.WIDE).otherwise(fitting.WORD).alias("kind"), F.length(r).alias("n")))
    pairs["runs"] = (fitting.text_runs(c), kinds)
    rows = odd_texts(spark)
    for name, (new, plain) in pairs.items():
        assert rows.where(~new.eqNullSafe(plain)).count() == 0, name


def test_a_raw_block_of_1_500_lines(spark):
    """Every cut of a block was held against the text of all lines before it."""
    line = lambda i: (54.0, 60.0 + 14 * i, 500.0, 72.0 + 14 * i, [(f"line {i} has some words in it, enough of them to make up a row", 9.5, "Times", 0)])
    rows = spark.createDataFrame([(1, 0, 0, 612.0, [line(i) for i in range(1500)])], f"doc_id long, page_index int, raw_block int, page_width double, lines {lines.LINES}")
    began = time.time()
    got = lines.extract_blocks(rows).collect()
    assert time.time() - began < 30
    assert len(got) == 1 and got[0].line_count == 1500 and got[0].text.count("line ") == 1500


def test_calls_with_a_deadline_share_a_thread():
    """Each call had a thread of its own; only one that doesn't come back costs its thread now."""
    name = lambda texts: [threading.current_thread().name]
    first = provider.within(5, name, ["a"])
    assert [provider.within(5, name, ["a"]) for _ in range(3)] == [first] * 3
    with pytest.raises(TimeoutError):
        provider.within(0.05, lambda texts: time.sleep(0.5), ["a"])
    with pytest.raises(ZeroDivisionError):
        provider.within(5, lambda texts: 1 // 0, ["a"])
    assert provider.within(5, name, ["a"]) not in (first, [threading.current_thread().name])


def test_a_run_reads_digests_and_reasons_in_one_pass(spark):
    """Reasons had a pass of their own over the blocks."""
    row = {"doc_id": 0, "block_id": 0, "page_index": 0, "x0": 1.0, "y0": 1.0, "x1": 2.0, "y1": 2.0, "text": "a", "font_size": 9.0, "line_count": 1}
    odd = [{}, {"block_id": 1}, {"doc_id": 1, "font_size": 0.0}, {"doc_id": 1, "x0": 9.0}, {"doc_id": 2, "text": None}]
    kinds = "doc_id long, block_id int, page_index int, x0 double, y0 double, x1 double, y1 double, text string, font_size double, line_count int"
    blocks = spark.createDataFrame([tuple((row | o).values()) for o in odd], kinds)
    got = {r.doc_id: (r.blocks, r.reason) for r in runs.document_states(blocks).collect()}
    assert got == {0: (2, None), 1: (2, "box"), 2: (1, "text")}
    digest = blocks.groupBy("doc_id").agg(F.bit_xor(F.xxhash64(*sorted(blocks.columns))).alias("d"))
    assert runs.document_states(blocks).join(digest, "doc_id").where("digest = d").count() == 3
