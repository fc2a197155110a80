"""WARC archives without repeated payloads.

``deduplicated`` shuffles headers (id, target, digest: no payloads) by payload
digest and finds, for each digest that stands more than once, the record that
keeps the payload; all others become revisits of it.  ``write_archive`` gives
every record fresh headers and writes gzip archives through Spark's own text
writer, so any store and Spark's commit protocol serve; the record separator
is the writer's line separator.  ``read_archive`` reads archives as streams of
lines and cuts records by their Content-Length, whatever bytes the payloads
hold.  ``resolved`` joins revisits to their original responses by digest.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialise, shared_dir

#: Payloads of fewer bytes are always kept: a revisit's headers would be as long.
LEAST_BYTES = 100
#: Pages have no time of capture; archives need one.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def records(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """(id, uri, payload, payload_bytes, payload_digest) of each row; a null payload is empty, other columns are left out."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    return pages.select(F.col(key).cast("long").alias("id"), F.col(uri).cast("string").alias("uri"), body.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)}
    )


def deduplicated(rows: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Add refers_to (id) and refers_to_uri: of another record with the same payload, null for records that keep theirs.

    Of equal payloads of ``least`` bytes or more the record of the smallest id keeps it (rows that repeat this id all do: none
    can refer to itself); a null id refers to the smallest, and without any other id all keep theirs.  Copies are counted
    before the shuffle, so a digest of many copies is a few rows.  The originals of repeated digests are a written table whose
    size Spark knows: below its threshold they are broadcast and no payload moves, else payloads are dealt out by digest and
    Spark splits a digest of many copies.
    """
    first = F.min_by(F.struct("id", "uri"), F.struct(F.col("id").isNull(), F.col("id"), F.col("uri"))).alias("first")
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(first, F.count(F.lit(1)).alias("copies")).where("copies > 1 and first.id is not null")
    originals = materialise(groups.select(F.col("payload_digest").alias("original_digest"), F.col("first.id").alias("original"), F.col("first.uri").alias("original_uri")))
    joined = rows.join(originals, F.col("payload_digest") == F.col("original_digest"), "left")
    other = F.col("id").isNull() | (F.col("id") != F.col("original"))
    return joined.select(*rows.columns, F.when(other, F.col("original")).alias("refers_to"), F.when(other, F.col("original_uri")).alias("refers_to_uri"))


def _target(uri: Column, key: Column) -> Column:
    """A header's value: blanks and control characters are written as %XX, a null target as the record's id."""
    for code in (*range(33), 127):
        uri = F.replace(uri, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.coalesce(uri, F.concat(F.lit("urn:page:"), key))


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n"))


def write_archive(rows: DataFrame, path: str, date: str = DATE) -> None:
    """Write records as gzip WARC/1.1 archives, one a partition, into the new folder ``path``.

    rows: as ``deduplicated`` gives them.  Record ids are ``<urn:page:ID>``, without ID where it is null.
    """
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    name = lambda k: F.concat(F.lit("<urn:page:"), k, F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END)).cast("binary")
    block = F.concat(http, F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    original = F.col("refers_to").cast("string")
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _line("WARC-Record-ID", name(key)), _line("WARC-Date", date), _line("WARC-Target-URI", _target(F.col("uri"), key)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))), _line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2("block", 256))),
        F.when(revisit, F.concat(_line("WARC-Profile", PROFILE), _line("WARC-Refers-To", name(original)), _line("WARC-Refers-To-Target-URI", _target(F.col("refers_to_uri"), original)), _line("WARC-Refers-To-Date", date))).otherwise(""),
        _line("Content-Type", "application/http; msgtype=response"), F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit(END),
    )
    # a string of Spark may hold any bytes: the cast changes none and the writer writes them as they are
    whole = F.concat(head.cast("binary"), F.col("block")).cast("string")
    rows.withColumn("block", block).select(whole.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


_FIELDS = {"record_type": pa.string(), "record_id": pa.string(), "uri": pa.string(), "payload_digest": pa.string(), "refers_to": pa.string(), "payload_bytes": pa.int64(), "found_digest": pa.string(), "block_ok": pa.bool_()}


def _parsed(record: bytes, start: int) -> tuple[dict[str, str], int, int]:
    """(header fields in lower case, where the block starts, where it ends) of the record at ``start``; the end is -1 while the headers aren't whole."""
    stop = record.find(b"\r\n\r\n", start)
    if stop < 0:
        return {}, -1, -1
    lines = record[start:stop].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, stop + 4, stop + 4 + int(fields["content-length"])


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of gzip archives: record_type, record_id, uri, payload_digest and refers_to as the headers have them; payload_bytes
    and found_digest of the payload that is there (null for revisits), block_ok (the block has its digest); payload if asked for.

    An archive is one stream of lines, which gzip keeps whole; a task holds a batch of lines and one record.  Broken archives
    raise.  An empty folder gives no rows.
    """
    names = list(_FIELDS) + ["payload"] * payloads

    def run(batches):
        rest = b""
        for batch in batches:
            lines = batch.column(0).cast(pa.binary() if batch.column(0).type == pa.string() else pa.large_binary()).to_pylist()
            data, at, out = rest + b"\n".join(lines) + b"\n" * bool(lines), 0, []
            while at < len(data):
                fields, start, end = _parsed(data, at)
                if end < 0 or len(data) < end + 4:
                    break
                block, digest = data[start:end], fields.get("warc-payload-digest", "").removeprefix("sha256:")
                kind = fields["warc-type"]
                body = block[block.find(b"\r\n\r\n") + 4 :] if kind == "response" else None
                found = (len(body), hashlib.sha256(body).hexdigest()) if body is not None else (None, None)
                out.append((kind, fields["warc-record-id"], fields.get("warc-target-uri"), digest, fields.get("warc-refers-to"), *found, fields.get("warc-block-digest") == f"sha256:{hashlib.sha256(block).hexdigest()}", body))
                at = end + 4
            rest = data[at:]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*_FIELDS.values()] + [pa.binary()] * payloads, strict=False)], names)
        if rest:
            raise ValueError("an archive ends within a record")

    kinds = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean"}
    schema = ", ".join(f"{n} {kinds[t]}" for n, t in _FIELDS.items()) + ", payload binary" * payloads
    # lines end at line feeds alone; a schema is given so that an empty folder is no error
    return spark.read.schema("value string").option("lineSep", "\n").text(path).mapInArrow(run, schema)


def resolved(found: DataFrame) -> DataFrame:
    """Add the payload's size to revisits, from the response that they refer to: (record_id, uri, record_type, payload_digest,
    payload_bytes, refers_to, whole), a row a record.

    whole: the payload is there, or where it refers to, with the digest that the headers tell.  Headers alone are shuffled, by
    digest; responses are counted before.  A revisit without its original has null bytes and is not whole.
    """
    responses = found.where("record_type = 'response'")
    kept = responses.groupBy(F.col("found_digest").alias("have"), F.col("record_id").alias("have_id")).agg(F.max("payload_bytes").alias("have_bytes"))
    revisits = found.where("record_type = 'revisit'").join(kept, (F.col("payload_digest") == F.col("have")) & (F.col("refers_to") == F.col("have_id")), "left")
    cols = ["record_id", "uri", "record_type", "payload_digest"]
    return responses.select(*cols, "payload_bytes", "refers_to", (F.col("block_ok") & (F.col("found_digest") == F.col("payload_digest"))).alias("whole")).unionByName(
        revisits.select(*cols, F.col("have_bytes").alias("payload_bytes"), "refers_to", (F.col("block_ok") & F.col("have").isNotNull()).alias("whole"))
    )


def _page(name: str) -> Column:
    return F.expr(f"try_cast(regexp_extract({name}, '^<urn:page:(-?[0-9]*)>$', 1) as bigint)").alias("page_id" if name == "record_id" else name)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_archive(deduplicated(records(load(spark, sf_dir, "pages"))), path)
    return resolved(read_archive(spark, path)).select(_page("record_id"), "payload_bytes", "payload_digest", "record_type", _page("refers_to"), "whole")
