"""Scans: the parquet tables, PDF files as binary rows, and layout blocks derived from document lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PDF = "path string, modificationTime timestamp, length long, content binary"
ANY_CASE = "*.[pP][dD][fF]"


def pdf_files(spark: SparkSession, *paths: str, default: str | None = None) -> DataFrame:
    """PDF files, each once: path, modificationTime, length, content.

    Of a folder all ``*.pdf`` at any depth (small letters alone), a file itself if its suffix is .pdf in any case; other files
    are passed over.  No paths: the default folder.  Names that begin with a dot or an underscore are hidden from Spark.
    A path that isn't there raises.  Only the given paths are looked at here; folders are listed by Spark.
    """
    folders, files = {}, {}
    for path in paths or ([default] if default else []):
        given = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = given.getFileSystem(spark._jsc.hadoopConfiguration())
        status = store.getFileStatus(given)  # its path is whole: scheme, host and all
        whole, name = status.getPath().toString().rstrip("/"), status.getPath().getName()
        if status.isDirectory():
            folders[whole] = None
        elif name.lower().endswith(".pdf") and len(name) > len(".pdf"):
            files[whole] = None
    inside = lambda path: any(path.startswith(f"{f}/") for f in folders)
    folders = [f for f in folders if not inside(f)]
    files = [f for f in files if not (f.endswith(".pdf") and inside(f))]
    found = []
    if folders:
        found.append(spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folders))
    if files:
        found.append(spark.read.format("binaryFile").load(files))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], PDF)


def pdf_paths(spark: SparkSession, *paths: str, default: str | None = None) -> DataFrame:
    """The paths of ``pdf_files`` in order: path, modificationTime, length; no content is read."""
    return pdf_files(spark, *paths, default=default).select("path", "modificationTime", "length").orderBy("path")


def pdf_stream(spark: SparkSession, folder: str, again: str = "1 day") -> DataFrame:
    """New PDF files of a landing folder as a stream, with their digest.

    Suffixes of any case.  A content that comes again, under another name or written anew, is passed over for as long as
    ``again`` of the files' times; what is kept of a file is its digest.
    """
    new = spark.readStream.format("binaryFile").schema(PDF).option("pathGlobFilter", ANY_CASE).option("recursiveFileLookup", "true").load(folder)
    return new.withColumn("digest", F.sha2("content", 256)).withWatermark("modificationTime", again).dropDuplicatesWithinWatermark(["digest"])


#: label by class k; {b} is the block's number and {line} its line
LABELS = {
    0: "Figure {b}: {line}", 1: "3.2 Method Overview", 2: "References", 3: "x = y + z", 4: "IEEE JOURNAL OF SYNTHETIC DATA 7", 5: "Method Dataset AUROC", 6: "arXiv:{line}", 7: "where",
    8: "A PROOFS AND DETAILS", 9: "Preprint. Under review.", 10: "IV. EXPERIMENTS", 11: "A. Baselines", 13: "0.91 0.82 0.73 model", 14: "Published as a conference paper at ICLR",
}


def doc_blocks(docs: DataFrame) -> DataFrame:
    """One layout block per line of each document, with integer geometry and labels that make the layout rules fire.

    Null texts give no blocks.
    """
    lines = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_id", "line"))
    d, b = F.col("doc_id"), F.col("block_id")
    rows = lines.select("doc_id", "block_id", "line", F.floor(b / 8).cast("int").alias("page_index"), (b % 8).cast("int").alias("slot"), ((d * 7 + b * 5) % 29).cast("int").alias("k"))
    k, slot = F.col("k"), F.col("slot")
    short = k.between(1, 5) | k.between(7, 11) | (k == 14)
    column = 54 + 258 * F.floor(slot / 4)
    y = 60 + 170 * (slot % 4)
    third = (d + b) % 3
    text = F.when(third == 0, F.col("line")).otherwise(F.regexp_replace("line", "[.?!:]+$", ""))
    for n, label in LABELS.items():
        parts = F.concat(*(F.col("line") if p == "{line}" else b.cast("string") if p == "{b}" else F.lit(p) for p in _pieces(label)))
        text = F.when(k == n, parts).otherwise(text)
    y0 = F.when(k == 4, 45).when(k == 9, 740).when(k == 14, 40).when((k == 5) & (slot % 4 > 0), y - 150).otherwise(y)
    x0 = F.when(k == 6, 10).otherwise(column)
    x1 = F.when(k == 6, 30).when(k.isin(3, 7), column + 90).when((F.col("page_index") == 0) & (slot == 0), 558).otherwise(column + 240)
    height = F.when(short, 14).when(k == 6, 200).when(k == 0, 150).when(third == 1, 100).otherwise(150)
    size = F.when(k == 4, 8.0).when(k == 2, 12.0).otherwise(9.0 + third / 2)
    num = lambda c, name: c.cast("double").alias(name)
    return rows.select(
        "doc_id", "block_id", "page_index", "slot", "k", num(x0, "x0"), num(y0, "y0"), num(x1, "x1"), num(y0 + height, "y1"), text.alias("text"), num(size, "font_size"),
        F.when(short, 1).otherwise(3 + b % 4).cast("int").alias("line_count"), (k == 15).alias("bold"), (k == 16).alias("italic"), (k == 17).alias("leading_bold"), F.when(k == 2, "center").otherwise("left").alias("align"),
    )


def _pieces(label: str) -> list[str]:
    out = [label]
    for mark in ("{line}", "{b}"):
        out = [p for x in out for p in ([x] if x in ("{line}", "{b}") else [y for i, y in enumerate(x.split(mark)) for y in ((mark, y) if i else (y,))])]
    return [p for p in out if p]


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of all documents, dealt out by document once: later windows over pages and documents need no other exchange."""
    return doc_blocks(table(spark, sf_dir, "documents").select("doc_id", "text")).repartition("doc_id")


