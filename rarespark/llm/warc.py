"""Content-addressed WARC archive: payload bytes once by strong digest, exact record headers beside them.

``archive`` writes two tables below one folder: ``payloads`` (SHA-256 of the bytes, the bytes), each payload once, and
``headers`` (the record header as it stands in a WARC file, and its payload's SHA-256). Of records with equal payloads,
that with the largest ``page_id`` is the response and the others are revisits that refer to it. ``records`` puts the
original records together again by a join that recomputes every digest from the stored bytes, ``write_warc`` stores them as gzipped WARC
files, ``read_warc`` reads such files record by record, and ``described`` says what the records are, from what was read alone.

At scale: the html is shuffled once, combined per task first, so that copies held by a third of all rows cost one
copy per task; the other joins carry digests and headers only, and both of their sides are plain scans, so that
Spark can split a hot digest. A task that reads a WARC file holds one record at a time.

A missing html is an empty payload; a missing url leaves out its header; an address with line ends, which a header line cannot hold, is
stored escaped and once more exactly, in Base64; equal rows are equal records; a record without ``page_id`` is a response only if none
of its payload's records has one. An empty table gives an empty archive. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import stage, unstage

# Fixed values of the format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE, END = "\r\n", "\r\n\r\n"
URI = "WARC-Target-URI"
#: Our own header, which other readers may ignore, for addresses that hold line ends.
EXACT = "X-Target-URI-Base64"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in bare upper-case base32: five hex digits make four letters."""
    digits = F.sha1(payload)
    letters = []
    for i in range(8):
        number = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("unknown")), F.lit(">"))


def _header(date: str) -> Column:
    def line(name: str, value: Column | str) -> Column:
        return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(LINE))

    # What would end a header line inside an address is written as its escape, beside the exact address in Base64.
    address = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    exact = F.when(address != F.col("url"), line(EXACT, F.base64(F.encode("url", "UTF-8"))))
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit(VERSION + LINE), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _record_id(F.col("page_id"))),
        line("WARC-Date", date), F.coalesce(line(URI, address), F.lit("")), F.coalesce(exact, F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(revisit, F.concat(line("WARC-Refers-To", _record_id(F.col("refers_to"))), line("WARC-Profile", REVISIT_PROFILE)))
        .otherwise(F.lit("")),
        line("Content-Type", "text/html; charset=utf-8"), line("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit(LINE)]
    return F.concat(*lines)


def archive(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write the records of ``pages`` (``page_id``, ``url``, ``html``) to a new archive at ``path``."""
    html = F.coalesce("html", F.lit(""))
    payload = F.encode(html, "UTF-8")
    spark = pages.sparkSession
    pages.select(payload.alias("payload")).groupBy(F.sha2("payload", 256).alias("sha256")).agg(
        F.min("payload").alias("payload")).write.parquet(f"{path}/payloads")
    index = stage(pages.select("page_id", "url", F.sha2(payload, 256).alias("sha256"), base32_sha1(payload).alias("sha1"),
                               F.octet_length(payload).cast("bigint").alias("payload_bytes")))
    latest = stage(index.groupBy("sha256").agg(F.max("page_id").alias("latest")))
    response = F.col("page_id").eqNullSafe(F.col("latest"))
    (index.join(latest, "sha256")
     .withColumn("record_type", F.when(response, "response").otherwise("revisit"))
     .withColumn("refers_to", F.when(~response, F.col("latest")))
     .select(_header(date).alias("header"), "sha256").write.parquet(f"{path}/headers"))
    unstage(index, latest)


def said(name: str, value: str = "([^\r\n]*)") -> Column:
    """What a header line says, null without one. Only LF ends a line here: Java would also take other characters for line ends."""
    pattern = rf"(?md)^{name}: {value}\r$"
    return F.when(F.regexp_like("header", F.lit(pattern)), F.regexp_extract("header", pattern, 1))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """The stored headers with what they say: ``page_id, url, record_type, payload_digest, payload_bytes, refers_to``."""
    return _told(spark.read.parquet(f"{path}/headers")).select("header", "sha256", *TOLD)


TOLD = ("page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to")


def _told(rows: DataFrame) -> DataFrame:
    return rows.select(
        "*", said("WARC-Record-ID", r"<urn:page:(-?\d+)>").cast("bigint").alias("page_id"),
        F.coalesce(F.decode(F.unbase64(said(EXACT, "([A-Za-z0-9+/=]*)")), "UTF-8"), said(URI)).alias("url"),
        said("WARC-Type", r"(\w+)").alias("record_type"), said("WARC-Payload-Digest", r"sha1:(\w+)").alias("payload_digest"),
        said("Content-Length", r"(\d+)").cast("bigint").alias("payload_bytes"),
        said("WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("bigint").alias("refers_to"))


def _checked(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads; bytes that do not have their digest end the job."""
    stored = spark.read.parquet(f"{path}/payloads")
    right = F.sha2("payload", 256) == F.col("sha256")
    wrong = F.raise_error(F.concat(F.lit("payload does not have its digest "), "sha256"))
    return stored.select("sha256", F.when(right, F.col("payload")).otherwise(wrong.cast("binary")).alias("payload"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, url, record_type, header, payload``: every original record, its payload joined by digest."""
    return headers(spark, path).join(_checked(spark, path), "sha256").select("page_id", "url", "record_type", "header", "payload")


def write_warc(spark: SparkSession, path: str, to: str, revisits_with_payload: bool = False) -> None:
    """Store an archive's records as gzipped WARC files in the folder ``to``.

    Revisits have an empty block, as the format wants it, unless their payloads are asked for. Without, only responses fetch their payload.
    """
    told, kept = headers(spark, path), _checked(spark, path)
    block = lambda payload: F.concat("header", F.decode(payload, "UTF-8")).alias("value")
    if revisits_with_payload:
        out = told.join(kept, "sha256").select(block("payload"))
    else:
        bare = F.regexp_replace("header", r"(?md)^Content-Length: \d+\r$", "Content-Length: 0\r")
        out = (told.where("record_type = 'response'").join(kept, "sha256").select(block("payload"))
               .unionByName(told.where("record_type != 'response'").select(bare.alias("value"))))
    out.write.option("lineSep", END).option("compression", "gzip").text(to)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces between record ends, in file order, to records; a block is as long as its header says, whatever it holds."""
    pack = lambda out: pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.string()), pa.array([b for _, b in out], pa.binary())], names=["header", "block"])
    end, now, header, parts, have, need = END.encode(), None, None, [], 0, 0
    for batch in batches:
        out, held = [], 0
        for file, piece in zip(batch.column("file").to_pylist(), batch.column("value")):
            if file != now:
                if header is not None:
                    raise ValueError(f"{now} ends within a record")
                now, parts, have = file, [], 0
            raw = piece.as_buffer().to_pybytes() + end
            parts.append(raw)
            have += len(raw)
            while have and (header is None or have >= need + len(end)):
                whole = b"".join(parts)
                if header is None:
                    stop = whole.find(end)
                    if stop < 0 or not whole.startswith(b"WARC/"):
                        parts = [whole]  # the rest of a separator, at the end of a file
                        break
                    header = whole[:stop + len(end)].decode()
                    need = int(next(x[16:] for x in header.split(LINE) if x.startswith("Content-Length: ")))
                    parts, have = [whole[stop + len(end):]], len(whole) - stop - len(end)
                else:
                    if whole[need:need + len(end)] != end:
                        raise ValueError(f"no record end in {now}")
                    out.append((header, whole[:need]))
                    held += need
                    header, parts, have = None, [whole[need + len(end):]], len(whole) - need - len(end)
                    if held > 4 << 20:
                        yield pack(out)
                        out, held = [], 0
        yield pack(out)
    if header is not None:
        raise ValueError(f"{now} ends within a record")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``header, block`` of every record in gzipped WARC files of text, and what the header says."""
    pieces = spark.read.option("lineSep", END).text(path).select("value", F.input_file_name().alias("file"))
    return _told(pieces.mapInArrow(_parse, "header string, block binary"))


def described(read: DataFrame) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` of records that were read.

    Size and digest are taken from the bytes of the responses, whose headers must agree; revisits get them from the response
    of their digest.
    """
    answer = F.col("record_type") == "response"
    found = stage(read.select("page_id", "url", "record_type", "refers_to", "payload_digest", F.when(answer, F.octet_length("block")).cast("bigint").alias("size"),
                              "payload_bytes", F.when(answer, base32_sha1(F.col("block"))).alias("digest")))
    same = (F.col("size") == F.col("payload_bytes")) & (F.col("digest") == F.col("payload_digest"))
    wrong = F.raise_error(F.concat(F.lit("header does not match its payload: "), "payload_digest"))
    responses = found.where(answer).select("page_id", "url", F.when(same, F.col("size")).otherwise(wrong.cast("bigint")).alias("payload_bytes"),
                                           F.col("digest").alias("payload_digest"), "record_type", "refers_to")
    sizes = stage(responses.groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes")))
    revisits = found.where(~answer).drop("payload_bytes").join(sizes, "payload_digest", "left")
    lost = F.raise_error(F.concat(F.lit("no response has the payload "), "payload_digest")).cast("bigint")
    return responses.unionByName(revisits.select("page_id", "url", F.coalesce("payload_bytes", lost).alias("payload_bytes"), "payload_digest",
                                                 "record_type", "refers_to"))
