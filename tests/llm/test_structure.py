"""Conversation repair, the Merkle manifest and WARC archives against plain Python."""

import gzip
import hashlib
import itertools
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioflow.llm import common, conversations, merkle, warc

# ---------------------------------------------------------------- conversations

LEGAL = re.compile(r"(s?(ua)+)?")
ODD = re.compile(r"[^\x20\x09-\x0D]")


def faults(turns):
    out, seen = [], set()
    for role, text in turns:
        last = ODD.findall(text)
        out.append(1 if not last else 2 if (role, text) in seen else 3 if last[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(turns):
    """Smallest (cost, audit, repaired) over all edits, with up to two insertions in each gap: two reach any state."""
    marks, best = faults(turns), None
    ways = []
    for (role, text), mark in zip(turns, marks, strict=True):
        extra = 3 if mark == 3 else 0
        ways.append([(4, "D", ())] + ([(extra, "K", ((role, text),))] + [(3 + extra, "R", ((r, text),)) for r in ("user", "assistant")] if mark in (0, 3) else []))
    gaps = [()] + [p for n in (1, 2) for p in itertools.product(("user", "assistant"), repeat=n)]
    # left to right, the cheapest of each prefix of initials that the grammar can still complete
    states = {"": (0, "", ())}

    def key(made):
        s = "".join(r[:1] or "?" for r, _ in made)
        return s if re.fullmatch(r"s?(ua)*u?", s) else None

    def put(new, cost, audit, made):
        k = key(made)
        if k is not None:
            k = re.sub(r"(ua)+", "ua", k)
            if k not in new or (cost, audit) < new[k][:2]:
                new[k] = (cost, audit, made)

    def fill(old):
        new = {}
        for cost, audit, made in old.values():
            for g in gaps:
                put(new, cost + 3 * len(g), audit + "I" * len(g), made + tuple((r, "") for r in g))
        return new

    states = fill(states)
    for way in ways:
        new = {}
        for cost, audit, made in states.values():
            for c, letter, turn in way:
                put(new, cost + c, audit + letter, made + turn)
        states = fill(new)
    for cost, audit, made in states.values():
        if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in made)) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, made)
    return best


def exhaustive(turns):
    """As ``cheapest``, over whole edit sequences and nothing merged: for very short conversations."""
    marks, best = faults(turns), None
    gaps = [()] + [p for n in (1, 2) for p in itertools.product(("user", "assistant"), repeat=n)]
    ways = []
    for (role, text), mark in zip(turns, marks, strict=True):
        extra = 3 if mark == 3 else 0
        ways.append([(4, "D", ())] + ([(extra, "K", ((role, text),))] + [(3 + extra, "R", ((r, text),)) for r in ("user", "assistant")] if mark in (0, 3) else []))
    for picked in itertools.product(*ways):
        for filled in itertools.product(gaps, repeat=len(turns) + 1):
            cost, audit, made = 3 * len(filled[0]), "I" * len(filled[0]), tuple((r, "") for r in filled[0])
            for (c, letter, turn), g in zip(picked, filled[1:], strict=True):
                cost, audit, made = cost + c + 3 * len(g), audit + letter + "I" * len(g), made + turn + tuple((r, "") for r in g)
            if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in made)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, made)
    return best


def parsed(turns):
    parser, given = conversations.Parser(conversations.lr_table(conversations.GRAMMAR)), []
    for (role, text), mark in zip(turns, faults(turns), strict=True):
        parser.turn(role, text, mark)
        given += parser.agreed()
    cost, rest = parser.end()
    return cost, "".join(e.letter for e in given + rest), tuple((e.role, e.text) for e in given + rest if e.letter != "D")


def some_turns(r, n):
    return [(r.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), r.choice(["One.", "Two!", "three", "", " \t", f"T{r.random()}.", f"t{r.random()}"])) for _ in range(n)]


def test_parser_equals_all_edit_sequences():
    r = random.Random(1)
    for k in range(60):
        turns = some_turns(r, k % 3)
        assert parsed(turns) == exhaustive(turns) == cheapest(turns)


def test_parser_equals_the_cheapest_of_prefixes():
    r = random.Random(2)
    for k in range(400):
        turns = some_turns(r, k % 24)
        assert parsed(turns) == cheapest(turns)


def test_edits_are_given_out_as_tops_agree(monkeypatch):
    r = random.Random(3)
    monkeypatch.setattr(conversations, "HELD", 4)
    held = 0
    for k in range(60):
        turns = some_turns(r, 30 + k)
        assert parsed(turns) == cheapest(turns)
        parser = conversations.Parser(conversations.lr_table(conversations.GRAMMAR))
        for (role, text), mark in zip(turns, faults(turns), strict=True):
            parser.turn(role, text, mark)
            held += bool(parser.agreed())
    assert held > 100


def test_grammars_that_need_lookahead_are_refused():
    with pytest.raises(ValueError):
        conversations.lr_table((("C", "A"), ("A", "u"), ("A", "uA")))


def test_summary_and_turns_of_odd_conversations(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (2, None, "user", None), (2, 5, None, "x"), (None, 9, "user", "Why?"), (3, 1, "user", "A" * 3_000_000 + "."), (3, 4, "assistant", "B.")]
    df = spark.createDataFrame([(*x, "kept", 1) for x in rows], "conv_id long, turn long, role string, text string, mark string, copy int")
    start = conversations._start(df).withColumns({"copy": F.lit(0), "gone": F.col("conv_id") == 9})
    got = {r.conv_id: r for r in conversations.repair_summary(start.where("conv_id is null or true")).collect()}
    assert (got[1].cost, got[1].audit, got[1].duplicate, got[1].gaps, got[1].illegal) == (4, "KKKD", 1, 0, 1)
    assert (got[2].blank, got[2].truncated, got[2].cost, got[2].audit, got[2].gaps) == (1, 1, 8, "DD", 0)
    assert (got[None].cost, got[None].audit) == (3, "KI") and (got[3].gaps, got[3].cost) == (2, 0)
    assert got[3].repaired_sha256 == hashlib.sha256(("user:" + "A" * 3_000_000 + ".\nassistant:B.").encode()).hexdigest()
    turns = conversations.repaired_turns(df).where("conv_id = 1 or conv_id is null").collect()
    assert sorted((r.conv_id or 0, r.position, r.action, r.role, r.text) for r in turns) == [(0, 0, "K", "user", "Why?"), (0, 1, "I", "assistant", ""), (1, 0, "K", "system", "Be kind."), (1, 1, "K", "user", "Hi."), (1, 2, "K", "assistant", "Hello.")]
    assert conversations.repaired_turns(df.limit(0)).collect() == [] and conversations.repair_summary(start.limit(0)).collect() == []


def test_conversations_that_lose_all_rows_stay(spark):
    gone = spark.createDataFrame([(7, 0, "user", "x.", 0, True)], "conv_id long, turn long, role string, text string, copy int, gone boolean")
    assert [tuple(r) for r in conversations.repair_summary(gone).collect()] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_summaries_do_not_depend_on_partitions(spark):
    r = random.Random(4)
    rows = [(c, t, *x) for c in range(40) for t, x in enumerate(some_turns(r, c))]
    df = conversations._start(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumns({"copy": F.lit(0), "gone": F.lit(False)})
    got = {x.conv_id: (x.cost, x.audit) for x in conversations.repair_summary(df.repartition(13)).collect()}
    for c in range(1, 40):
        assert got[c] == cheapest([x[2:] for x in rows if x[0] == c])[:2]


# ---------------------------------------------------------------- manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(hashes):
    """Levels of a tree, leaves first."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        low = i - i % 3
        out.append(("".join(level[low:i]), "".join(level[i + 1 : low + 3])))
        i //= 3
    return out


def plain_manifest(rows):
    groups = {}
    for doc_id, source, text in rows:
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, sha(value(doc_id), value(source), value(text)), doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names]
    top, out = tree([t[-1][0] for t in trees]), []
    for g, s in enumerate(names):
        for i, (*_, h, doc_id) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            out.append((doc_id, s, h, trees[g][-1][0], top[-1][0], siblings(trees[g], i) + siblings(top, g)))
    return out


@pytest.mark.parametrize("digits", [1, 2, 7])
def test_manifest_equals_plain_trees(spark, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    r = random.Random(digits)
    rows = [(i, r.choice(["a", "a", "a", "é", "z", None]), r.choice(["x", "", None, "line\nfeed"])) for i in range(120)]
    rows += [(5, "a", "x"), (5, "a", "x"), (None, None, None), (None, "a", None), (7, "alone", "L" * 2_000_000)] + [(200 + i, f"s{i}", "t") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 as grp", "2 as rank", "3 as node", "4 as size")
    got = merkle.manifest(df.repartition(5), ["doc_id", "source", "text"], "doc_id", "source")
    made = got.withColumn("again", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    order = lambda rows: sorted(rows, key=repr)
    assert order((x.doc_id, x.source, x.leaf, x.subroot, x.root, [tuple(p) for p in x.proof]) for x in made) == order(plain_manifest(rows))
    assert all(x.again == x.root for x in made)


def test_manifest_of_one_row_and_of_none(spark):
    df = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string")
    (only,) = merkle.manifest(df, ["doc_id"], "doc_id", "source").collect()
    assert only.leaf == only.subroot == only.root == sha("1:1") and only.proof == []
    assert merkle.manifest(df.limit(0), ["doc_id"], "doc_id", "source").collect() == []


# ---------------------------------------------------------------- archives


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as id", "2 as payload", "3 as block", "4 as original")


def round_trip(spark, tmp_path, rows, parts=3):
    path = f"file://{tmp_path}/{random.random()}"
    warc.write_archive(warc.deduplicated(warc.records(pages(spark, rows).repartition(parts))), path)
    return path


def test_archives_round_trip_whatever_the_payloads_hold(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, f"http://x/{i}", "".join(r.choice(["\r", "\n", "\r\n\r\n", "a", "é", "WARC/1.1\r\n", "Content-Length: 3\r\n", "\x00"]) for _ in range(r.randrange(80)))) for i in range(120)]
    rows += [(500, None, None), (501, "bad\r\nX-Header: 1 ", "y" * 3_000_000), (502, "u", "\r\n" * 40_000), (503, "u", "\r\n\r\n")]
    found = warc.read_archive(spark, round_trip(spark, tmp_path, rows), payloads=True).collect()
    assert len(found) == len(rows) and all(x.block_ok for x in found)
    texts = {i: (t or "").encode() for i, _, t in rows}
    for x in found:
        i = int(x.record_id[len("<urn:page:") : -1])
        digest = hashlib.sha256(texts[i]).hexdigest()
        assert x.payload_digest == digest
        if x.record_type == "response":
            assert bytes(x.payload) == texts[i] and x.payload_bytes == len(texts[i]) and x.found_digest == digest
    assert next(x.uri for x in found if x.record_id == "<urn:page:501>") == "bad%0D%0AX-Header:%201%20"


def test_copies_become_revisits_of_the_smallest_id(spark, tmp_path):
    long, short = "c" * 100, "c" * 99
    rows = [(9, "a", long), (4, "b", long), (4, "b", long), (12, "c", long), (None, "d", long), (1, "e", short), (2, "f", short), (None, "g", long + "!"), (None, "h", long + "!"), (-3, "i", "é" * 50), (-2, "j", "é" * 50)]
    path = round_trip(spark, tmp_path, rows)
    got = warc.resolved(warc.read_archive(spark, path)).collect()
    assert all(x.whole for x in got)
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    want = [(9, "revisit", 4), (4, "response", None), (4, "response", None), (12, "revisit", 4), (None, "revisit", 4), (1, "response", None), (2, "response", None), (None, "response", None), (None, "response", None), (-3, "response", None), (-2, "revisit", -3)]
    assert sorted((x.record_id, x.record_type, x.refers_to or "", x.payload_bytes) for x in got) == sorted((name(i), k, name(o) if o is not None else "", len(t.encode())) for (i, k, o), (*_, t) in zip(want, rows, strict=True))
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in Path(path.removeprefix("file://")).glob("part-*"))
    assert raw.count(long.encode()) == 4 and raw.count(b"WARC/1.1\r\n") == len(rows)  # of page 4, which is there twice, and the two of no page id


def test_a_revisit_without_its_original_is_not_whole(spark, tmp_path):
    path = round_trip(spark, tmp_path, [(1, "a", "c" * 200), (2, "b", "c" * 200)])
    found = warc.read_archive(spark, path).where("record_type = 'revisit'")
    assert [(x.payload_bytes, x.whole) for x in warc.resolved(common.materialise(found)).collect()] == [(None, False)]


def test_no_pages_and_broken_archives(spark, tmp_path):
    assert warc.resolved(warc.read_archive(spark, round_trip(spark, tmp_path, []))).collect() == []
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))
    with pytest.raises(Exception, match="within a record"):
        warc.read_archive(spark, f"file://{tmp_path}/cut").collect()
