"""Which files count as PDFs, in batch and as a stream."""

import os

import pytest

from folioflow.sources import tables


def put(path, content=b"%PDF"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    return f"file://{path}"


def names(df):
    return [os.path.basename(r.path) for r in df.select("path").collect()]


def test_folders_files_and_the_default(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for p in ("z.pdf", "sub/deep/y.pdf", "sub/x.PDF", "notes.txt"):
        put(a / p)
    upper, text = put(b / "Q.PDF"), put(b / "w.pdf.txt")
    assert names(tables.pdf_paths(spark, f"file://{a}")) == ["y.pdf", "z.pdf"]  # by path; capitals count in named files alone
    assert names(tables.pdf_paths(spark, f"file://{a}", upper, text)) == ["y.pdf", "z.pdf", "Q.PDF"]
    assert names(tables.pdf_paths(spark, f"file://{a}", f"file://{a}/z.pdf", f"file://{a}/sub")) == ["y.pdf", "z.pdf"]
    assert names(tables.pdf_paths(spark, default=f"file://{a}/sub")) == ["y.pdf"]
    assert names(tables.pdf_paths(spark, text)) == names(tables.pdf_paths(spark)) == []
    assert [bytes(r.content) for r in tables.pdf_files(spark, upper).collect()] == [b"%PDF"]
    with pytest.raises(Exception, match="nowhere"):
        tables.pdf_files(spark, f"file://{tmp_path}/nowhere.pdf")


def test_a_file_that_comes_twice_is_seen_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    put(folder / "one.pdf", b"1")

    def keep(df, batch):
        seen.extend((os.path.basename(r.path), bytes(r.content)) for r in df.select("path", "content").collect())

    def run():
        q = tables.pdf_stream(spark, f"file://{folder}").writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    put(folder / "two.PDF", b"2")
    put(folder / "copy.pdf", b"1")
    put(folder / "plain.txt", b"3")
    run()
    put(folder / "one.pdf", b"1")
    put(folder / "sub/three.Pdf", b"3")
    run()
    assert sorted(seen) == [("one.pdf", b"1"), ("three.Pdf", b"3"), ("two.PDF", b"2")]
