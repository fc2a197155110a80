"""Rules on literal rows: thresholds, texts and folds whose results follow from the rules by hand."""

import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import classify, glossary, layout, lines, provider, units
from folioflow.plans import pipeline
from folioflow.plans.queries import QUERIES
from folioflow.sources import tables
from folioflow.streaming import jobs

DATA = "/root/testdata/sf0.001"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("a-\nb", "ab"), ("co-\n op  x", "coop x"), (" a \n b\t\tc ", "a b c"), ("a -\nb", "a - b"), ("", ""), (None, None)],
)
def test_clean_text(spark, raw, want):
    assert one(spark, raw, T.clean_text) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("x<sub>2</sub> &amp; y", "x2 & y"), (r"\mathbb{R} 与 \alpha", "R 与 α"), ("你 好 ， 世界", "你好，世界"), ("好(text continues here).", "好"), ("$ a+b $", "a+b"), (r"\inf \in", "∈"), ("等等...", "等等"), ("a\r\n\r\nb", "a b"),
    ],
)
def test_clean_translation(spark, raw, want):
    assert one(spark, raw, T.clean_translation) == want


@pytest.mark.parametrize(("raw", "want"), [("and so on,", True), ("end.", False), ("list;", True), ("Title", True), ("ABC", False), ("", False), ("x \n", True), ("full：", False)])
def test_paragraph_continues(spark, raw, want):
    assert one(spark, raw, T.paragraph_continues) is want


@pytest.mark.parametrize(("raw", "want"), [(0.25, 4.5), (4.74, 4.5), (4.75, 5.0), (5.25, 5.0), (5.75, 6.0), (9.6, 9.5)])
def test_font_sizes_round_to_even_halves(spark, raw, want):
    assert spark.range(1).select(T.round_font_size(F.lit(raw)).alias("r")).first()["r"] == want


def test_styled_html(spark):
    df = spark.createDataFrame([("Intro: 你好 **b**",)], "c string")
    got = df.select(T.styled_html(F.col("c"), F.lit(False), F.lit(False), F.lit(True)).alias("r")).first()["r"]
    assert got == '<span class="bold"><span class="latin">Intro: </span></span><span class="regular"><span class="cjk">你好</span><span class="latin"> </span></span><span class="bold"><span class="latin">b</span></span>'


def test_split_position_prefers_marks_then_words(spark):
    cut = lambda text, start, target: spark.range(1).select(T.split_position(F.lit(text), F.lit(start), F.lit(target)).alias("r")).first()["r"]
    assert cut("一二。三四，五六", 0, 4) == 3
    assert cut("一二三四，五六", 0, 3) == 5
    assert cut("ab cd ef", 0, 4) == 5
    assert cut("abcdef", 0, 3) == 1
    assert cut("abcdef", 2, 9) == 6 and cut("abcdef", 2, 1) == 3


def test_split_translation_keeps_all_but_blanks(spark):
    boxes = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(100.0).alias("h"), F.lit(10.0).alias("font_size")) for w in (240.0, 240.0, 120.0)))
    text = "天地玄黄，宇宙洪荒。日月盈昃，辰宿列张。寒来暑往，秋收冬藏。"
    parts = spark.range(1).select(units.split_translation(F.lit(text), boxes).alias("r")).first()["r"]
    assert "".join(parts) == text and len(parts) == 3


def block(spark, **kw):
    base = dict(doc_id=1, block_id=0, page_index=1, x0=54.0, y0=300.0, x1=294.0, y1=400.0, text="some plain body text here", font_size=10.0, line_count=4, bold=False, italic=False, leading_bold=False, align="left")
    return spark.createDataFrame([base | kw])


@pytest.mark.parametrize(
    ("flag", "want", "kw"),
    [
        ("body", True, {}), ("body", False, {"x1": 223.0}), ("body", True, {"x1": 224.0}), ("body", True, {"x1": 100.0, "text": "such that:"}), ("side_note", True, {"x1": 44.0, "y1": 421.0}), ("formula", True, {"text": "a = b", "line_count": 2}),
        ("formula", False, {"text": "a = " + "b" * 31, "line_count": 2}), ("formula", True, {"text": "a = " + "b" * 30, "line_count": 2}), ("heading", True, {"text": "3.2 Method", "line_count": 1}), ("heading", False, {"text": "3.2 method", "line_count": 1}),
        ("heading", False, {"text": "3 4 Data", "line_count": 1}), ("appendix", True, {"text": "A PROOFS", "line_count": 1}), ("version_footer", True, {"y0": 727.0, "text": "Preprint."}), ("version_footer", False, {"y0": 726.0, "text": "Preprint."}),
        ("conference_header", True, {"y0": 65.0, "text": "Under review as a conference paper"}), ("title", True, {"align": "center", "font_size": 14.0, "x1": 304.0, "text": "Four long plain words"}), ("title", False, {"align": "center", "font_size": 13.9, "x1": 304.0, "text": "Four long plain words"}),
        ("table", True, {"text": "0.91 0.82 0.73 model"}), ("table", True, {"text": "Method Dataset"}), ("figure_label", True, {"y1": 179.0, "y0": 170.0, "font_size": 8.5}), ("metadata", True, {"page_index": 0, "y0": 219.0}), ("metadata", False, {"page_index": 0, "y0": 220.0}),
    ],
)
def test_block_rules_at_their_thresholds(spark, flag, want, kw):
    assert classify.with_flags(block(spark, **kw)).first()[flag] is want


def test_upper_median_of_sizes(spark):
    rows = [{"font_size": s, "block_id": i, "y0": 200.0 + 20 * i} for i, s in enumerate((9.0, 10.0, 11.0, 12.0))]
    blocks = block(spark, **rows[0])
    for r in rows[1:]:
        blocks = blocks.unionByName(block(spark, **r))
    assert classify.body_font_size(classify.with_flags(blocks)).first()["body_size"] == 11.0


def test_units_respect_cap_and_breaks(spark):
    flags = classify.with_flags(tables.blocks(spark, DATA)).cache()
    u = units.translation_units(flags).collect()
    assert all(len(r.text) <= 2500 or len(r.indexes) == 1 for r in u)
    assert sum(len(r.indexes) for r in u) == flags.where("body").count()
    small = units.translation_units(flags, 300).collect()
    assert all(len(r.text) <= 300 or len(r.indexes) == 1 for r in small) and len(small) > len(u)


def test_batches_close_before_their_limits(spark):
    u = spark.createDataFrame([(1, i, [i], "x" * n) for i, n in enumerate((5, 5, 12, 1, 1, 1))], "doc_id long, unit_index int, indexes array<int>, text string")
    assert [r.batch_id for r in units.translation_batches(u, 3, 10).orderBy("unit_index").collect()] == [0, 0, 1, 2, 2, 2]
    assert [r.batch_id for r in units.translation_batches(u, 1, 10).orderBy("unit_index").collect()] == [0, 1, 2, 3, 4, 5]


def test_boxes_are_pushed_below_each_other(spark):
    rows = [(1, 0, 0, 54.0, 100.0, 294.0, 150.0, False), (1, 0, 1, 54.0, 140.0, 294.0, 200.0, False), (1, 0, 2, 54.0, 190.0, 294.0, 203.0, False), (1, 0, 3, 54.0, 400.0, 294.0, 420.0, True)]
    g = spark.createDataFrame(rows, "doc_id long, page_index int, group_id long, x0 double, y0 double, x1 double, y1 double, heading boolean")
    g = g.selectExpr("*", "'t' as text", "false as hidden", "false as italic", "false as leading_bold", "10.0D as font_size")
    got = [tuple(r.placed) for r in layout.push_down(g).orderBy("group_id").collect()]
    assert got == [(54.0, 100.0, 294.0, 150.0), (54.0, 151.0, 294.0, 200.0), (54.0, 190.0, 294.0, 203.0), (52.0, 398.0, 296.0, 423.5)]


def test_line_splits(spark):
    def raw(rows):
        return [{"x0": x0, "y0": 10.0 * i, "x1": x1, "y1": 10.0 * i + 9, "spans": [{"text": t, "size": s, "font": f, "flags": fl}]} for i, (t, x0, x1, s, f, fl) in enumerate(rows)]

    body = lambda t, x1=500.0: (t, 54.0, x1, 10.0, "Times", 0)
    data = [
        (1, 0, 0, 612.0, raw([body("Table 1: x"), body("Method Dataset"), body("memory flops")])), (1, 0, 1, 612.0, raw([body("one two", 300.0)] * 3 + [body("three four")] * 3)),
        (1, 0, 2, 612.0, raw([body("four plain words here"), body("and more"), ("x = y", 120.0, 180.0, 10.0, "Times", 0)])), (1, 0, 3, 612.0, raw([("Lead", 54.0, 90.0, 0.0, "Times-Bold", 0), ("italic text goes on", 54.0, 500.0, 12.0, "Times", 2)])),
    ]
    df = spark.createDataFrame(data, f"doc_id long, page_index int, raw_block int, page_width double, lines {lines.LINES}")
    got = {(r.raw_block, r.part): r for r in lines.extract_blocks(df).collect()}
    assert [got[k].text for k in sorted(got)] == ["Table 1: x", "Method Dataset memory flops", "one two one two one two", "three four three four three four", "four plain words here and more", "x = y", "Lead italic text goes on"]
    assert got[0, 0].y1 == 9.0 and got[3, 0].leading_bold and got[3, 0].italic and got[3, 0].font_size == 12.0 and got[3, 0].align == "center"


def test_glossary_and_checks(spark):
    assert one(spark, "3.1 Related  Work", glossary.fixed_heading) == "3.1 相关工作"
    assert one(spark, "Proof of Lemma 2.1 again", glossary.fixed_heading) == "引理2.1的证明"
    assert one(spark, "nothing known", glossary.fixed_heading) is None
    assert one(spark, "II. RESULTS AND ANALYSES", glossary.fixed_section) == "II. 结果与分析"
    assert one(spark, "such  that:", glossary.fixed_short) == "使得："
    assert one(spark, "*Correspondence to: a.b@c.org.", glossary.fixed_short) == "∗通信至：a.b@c.org。"
    assert one(spark, "The GNN model works", lambda c: glossary.suspicious(c, F.lit("GNN 卫星 The"))) is True
    assert one(spark, "Method we use", lambda c: glossary.split_leading_heading(c, F.lit("方法：我们用"), F.lit(True))) == "方法\n\n我们用"


def test_responses_parse_in_all_forms(spark):
    parse = lambda s: one(spark, s, provider.parse_response)
    assert parse('{"translations":[{"id":1,"text":"a"},{"id":1,"text":"b"},{"id":2,"text":"c"}]}') == {1: "b", 2: "c"}
    assert parse('```json\n[{"id":3,"text":" d "}]\n```') == {3: "d"}
    assert not parse("not json")


class Flaky:
    def __init__(self):
        self.n = 0

    def translate(self, texts):
        self.n += 1
        if "never" in texts[0] or self.n % 2:
            raise RuntimeError("down")
        return [t.upper() for t in texts]


def test_a_failing_batch_fails_alone(spark):
    b = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b"), (2, 0, 0, "never")], "doc_id long, batch_id int, unit_index int, text string").coalesce(1)
    got = {(r.doc_id, r.unit_index): (r.translated, r.error) for r in provider.translate(b, Flaky, threads=1, sleep=0.0).collect()}
    assert got[1, 0] == ("A", None) and got[1, 1] == ("B", None) and got[2, 0] == (None, "RuntimeError: down")


def test_groups_partition_changed_blocks(spark):
    out = pipeline.translate_documents(tables.blocks(spark, DATA), max_items=4)
    changed = layout.changed_blocks(out["blocks"]).count()
    sizes = out["groups"].agg(F.sum(F.size("block_seqs")).alias("n"), F.count(F.lit(1)).alias("g")).first()
    assert sizes["n"] == changed and 0 < sizes["g"] <= changed


def test_stream_ends_in_the_batch_state(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    for i in range(3):
        events.where(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    q = jobs.job_state_stream(spark, str(tmp_path / "events"), events.schema).writeStream.outputMode("complete").format("memory").queryName("job_states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = jobs.job_state(jobs.job_events(events)).collect()
    assert sorted(map(repr, spark.table("job_states").collect())) == sorted(map(repr, want))


def test_pdf_scan_and_stream(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for n in ("a.pdf", "b.txt", "deep/c.pdf"):
        (tmp_path / "in" / n).write_bytes(b"%PDF " + n.encode())
    found = tables.pdf_files(spark, str(tmp_path / "in"))
    assert sorted(os.path.basename(r.path) for r in found.select("path").collect()) == ["a.pdf", "c.pdf"]
    assert tables.pdf_stream(spark, str(tmp_path / "in")).isStreaming


def test_line_height_limits():
    assert T.parse_line_height("1.2") == 1.2
    for bad in ("0.69", "2.01", "x"):
        with pytest.raises(ValueError):
            T.parse_line_height(bad)


@pytest.mark.parametrize("name", ["clean_translation", "raw_line_blocks"])
def test_rows_only_queries_give_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


NAMES = [
    (["x_1.pdf", "a_3.pdf"], ["x_1.pdf"], ["x_1_1.pdf"]), ([], ["q_1.pdf", "q.pdf", "q.pdf"], ["q_1.pdf", "q.pdf", "q_2.pdf"]), (["a_3.pdf"], ["a.pdf"], ["a.pdf"]), (["x_1.pdf"], ["x.pdf", "x.pdf", "x.pdf"], ["x.pdf", "x_2.pdf", "x_3.pdf"]),
    (["b.PDF", "b_1.PDF", "b_3.PDF"], ["b.PDF"] * 3, ["b_2.PDF", "b_4.PDF", "b_5.PDF"]), (["c.pdf", "c_02.pdf"], ["c.pdf", "c.pdf"], ["c_1.pdf", "c_2.pdf"]), (["d.pdf"], ["d.PDF", "d.pdf"], ["d.PDF", "d_1.pdf"]), ([], ["e", "e"], ["e", "e_1"]),
]


@pytest.mark.parametrize(("taken", "uploads", "want"), NAMES)
def test_free_names(spark, taken, uploads, want):
    got = jobs.safe_names(spark.createDataFrame(list(enumerate(uploads)), "seq long, name string"), spark.createDataFrame([(x,) for x in taken], "name string")).orderBy("seq").collect()
    assert [r.free_name for r in got] == want


def test_job_ids_are_name_uuids(spark):
    assert one(spark, "a.pdf:a_zh-CN.pdf", jobs.name_uuid) == str(uuid.uuid5(uuid.NAMESPACE_URL, "a.pdf:a_zh-CN.pdf"))


def test_retries_stop_after_the_limit():
    calls = []

    def call(texts):
        calls.append(time.time())
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        provider.with_retries(call, ["a"], attempts=3, sleep=0.0)
    assert len(calls) == 3
