"""WARC archives: written with Spark's text writer, read back by verifying the chain of records.

A record's header says where the next one begins. Reading tasks emit every place that looks like a record
with its successor; pointer jumping from the start of each file then keeps what can be reached, so that
record headers inside payloads are not taken for records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarray.llm import tables
from lexarray.llm.groups import turned

_ID = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed value: the alphabet of base32.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CRLF = "\r\n"
#: Bytes of payload in an archive file: a file is read as one row, so it must stay far below a row's 2 GB and a task's memory.
FILE_BYTES = 1 << 27


def with_digest(rows: DataFrame, payload: str, name: str) -> DataFrame:
    """rows with the upper-case base32 of the SHA-1 of a string's UTF-8 bytes: 160 bits are 32 characters without padding.

    In steps, so that the digest and its bits are worked out once and not for every character.
    """
    hexed = rows.withColumn("_sha", F.sha1(F.col(payload).cast("binary")))
    bits = F.concat(*[F.lpad(F.conv(F.substring("_sha", 1 + 10 * k, 10), 16, 2), 40, "0") for k in range(4)])
    letters = [F.substring(F.lit(_BASE32), F.conv(F.substring("_bits", 1 + 5 * i, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(32)]
    return hexed.withColumn("_bits", bits).withColumn(name, F.concat(*letters)).drop("_sha", "_bits")


def with_originals(pages: DataFrame, key: str, digest: str, size: str, least: int) -> DataFrame:
    """pages with `original`: the smallest key of the rows with an equal payload, null for payloads that occur once or have under `least` bytes.

    Payloads are equal if their SHA-1 and size are. Only rows whose digest may be repeated, by a filter of
    fixed size, are shuffled with their columns.
    """
    spark = pages.sparkSession
    mark = F.xxhash64(digest, size)
    first = pages.where(F.col(size) >= least).select(key, digest, size).groupBy(digest, size).agg(F.min(key).alias("original"), F.count("*").alias("n")).where("n > 1")
    first = tables.cut(first.select(mark.alias("mark"), "original"))
    words = tables.sent(spark, tables.bloom_of(first.select("mark"), bits=23).words)

    once, again = tables.split_by(pages.withColumn("mark", mark), F.col("mark"), words)
    once = once.withColumn("original", F.lit(None).cast(pages.schema[key].dataType))
    again = again.join(first.select(turned("mark").alias("t"), "original"), (turned("mark") == F.col("t")) & (F.col(size) >= least), "left").drop("t")
    return once.unionByName(again).drop("mark")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, records_per_file: int = 5000, file_bytes: int = FILE_BYTES) -> None:
    """A record for each row of pages, in files under path of at most records_per_file records and file_bytes of payload.

    Payloads of more than an equal share of a file's bytes go into files of their own folder, each task beginning
    a new one before the next record would exceed it; only a payload above file_bytes does, alone in its file.

    Of rows with equal payloads of at least `least` bytes the one with the smallest id is a response and
    the others are revisits of it; all others are responses. Null html is an empty payload; null urls give
    no target URI; rows without id are revisits where another row has an id, else responses; rows that
    repeat the smallest id are all responses.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7f]", "%20").alias("url"), payload.alias("payload"))
    rows = with_digest(rows.withColumn("size", F.octet_length("payload").cast("long")), "payload", "digest")
    rows = with_originals(rows, "id", "digest", "size", least)
    revisit = F.col("original").isNotNull() & ~F.col("id").eqNullSafe(F.col("original"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("size"), F.lit(_CRLF * 2))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    named = lambda x: F.concat(F.lit(f"<{_ID}"), F.coalesce(x.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(f"WARC/1.1{_CRLF}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(_CRLF),
        line("WARC-Record-ID", named(F.col("id"))),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", named(F.col("original"))), line("WARC-Profile", F.lit(_PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.length(http) + F.when(revisit, 0).otherwise(F.col("size"))).cast("string")),
        F.lit(_CRLF),
    )
    record = F.concat(head, http, F.when(revisit, "").otherwise(F.col("payload")))
    share = file_bytes // records_per_file
    # by size, so that a pass drops the other's rows before it works out their digests
    rows.where(F.col("size") <= share).select(record.alias("value")).write.option("lineSep", _CRLF * 2).option("maxRecordsPerFile", records_per_file).text(f"{path}/small")
    if pages.where(F.octet_length(payload) > share).isEmpty():
        return

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = held = n = 0
        for batch in batches:
            files = []
            for size in batch.column(1).to_pylist():
                if n == records_per_file or n and held + size > file_bytes:
                    file, held, n = file + 1, 0, 0
                held, n = held + size, n + 1
                files.append(file)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.int32())], ["value", "file"])

    large = rows.where(F.col("size") > share).select(record.alias("value"), F.when(revisit, 0).otherwise(F.col("size")).alias("written")).mapInArrow(filed, "value string, file int")
    large.write.partitionBy("file").option("lineSep", _CRLF * 2).text(f"{path}/large")


_HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)*)\r\n")
_RECORD = "path string, at long, next long, size long, record_type string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string, valid boolean"


def _fields(block: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in block.split(b"\r\n") if x)}


def _page(value: bytes | None) -> int | None:
    m = re.fullmatch(rb"<" + _ID.encode() + rb"(-?\d+)>", value or b"")
    return int(m[1]) if m else None


def _candidates(path: str, data: memoryview, payloads: bool) -> Iterator[dict]:
    for m in _HEAD.finditer(data):
        fields = _fields(m[1])
        length = fields.get(b"content-length", b"")
        if not length.isdigit() or b"warc-type" not in fields:
            continue
        end = m.end() + int(length)
        block = bytes(data[m.end() : end])
        http, gap, body = block.partition(b"\r\n\r\n")
        stated = _fields(http.partition(b"\r\n")[2]).get(b"content-length", b"0")
        digest = fields.get(b"warc-payload-digest", b"").decode(errors="replace").removeprefix("sha1:")
        kind = fields[b"warc-type"].decode(errors="replace")
        if kind == "response":
            own = base64.b32encode(hashlib.sha1(body).digest()).decode()
            size, valid, digest = len(body), own == digest, own
        else:
            size, valid = int(stated) if stated.isdigit() else 0, True
        out = {"path": path, "at": m.start(), "next": end + 4, "size": len(data), "record_type": kind, "page_id": _page(fields.get(b"warc-record-id")), "refers_to": _page(fields.get(b"warc-refers-to"))}
        out |= {"url": (lambda u: u.decode(errors="replace") if u is not None else None)(fields.get(b"warc-target-uri")), "payload_bytes": size, "payload_digest": digest, "valid": valid and bool(gap) and bytes(data[end : end + 4]) == b"\r\n\r\n"}
        yield out | ({"payload": body if kind == "response" else None} if payloads else {})


def candidates(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every place in the archives under path that looks like a record, with its successor's offset.

    Files are read one a row: an archive file should be well under the memory of a task, as those of
    write_warc are by file_bytes.
    """
    schema = _RECORD + (", payload binary" if payloads else "")
    empty = spark.createDataFrame([], schema)
    kind = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in empty.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                out = []
                for x in _candidates(name.as_py(), memoryview(content.as_buffer()), payloads):
                    out.append(x)
                    if len(out) == 500:
                        yield pa.RecordBatch.from_pylist(out, kind)
                        out = []
                yield pa.RecordBatch.from_pylist(out, kind)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInArrow(run, schema)


def reachable(links: DataFrame) -> DataFrame:
    """(path, at) of the records that can be reached from offset 0 of their file.

    links: path, at, next. Each round follows pointers twice as long, so that a file of n records takes
    log2(n) rounds.
    """
    parts = max(1, links.rdd.getNumPartitions())  # as many as tasks that read; a round's union would add its own to them
    known = tables.cut(links.select("path", "at", "next").distinct().coalesce(parts))
    ends = known.select(F.col("path").alias("p"), F.col("at").alias("a"))
    jumps = known.join(ends, (F.col("path") == F.col("p")) & (F.col("next") == F.col("a")), "left_semi")
    start = known.where("at = 0").select("path", F.lit(True).alias("found"), "at", F.lit(None).cast("long").alias("next"))
    # one table of the records found and of the pointers, so that a round is one join: positions found so far are
    # the first 2**k of a file's chain, and pointers lead 2**k records on
    state = tables.cut(start.unionByName(jumps.select("path", F.lit(False).alias("found"), "at", "next")).coalesce(parts))
    while not state.where("not found").isEmpty():
        pointers = state.where("not found").select(F.col("path").alias("p"), F.col("at").alias("a"), F.col("next").alias("n"))
        asked = state.select("path", "found", "at", F.when(F.col("found"), F.col("at")).otherwise(F.col("next")).alias("key"))
        moved = asked.join(pointers, (F.col("path") == F.col("p")) & (F.col("key") == F.col("a")))
        moved = moved.select("path", "found", F.when(F.col("found"), F.col("n")).otherwise(F.col("at")).alias("at"), F.when(~F.col("found"), F.col("n")).alias("next"))
        state = tables.cut(state.where("found").unionByName(moved).coalesce(parts))
    return state.where("found").select("path", "at")


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives under path: type, ids, url, payload size and digest, valid, and payload if asked for.

    valid: the record ends as it must and a response's digest is that of its payload, read here. Records
    behind a broken one are not reached.
    """
    found = candidates(spark, path, payloads)
    at = reachable(tables.cut(candidates(spark, path).select("path", "at", "next")))
    return found.join(at, ["path", "at"], "left_semi")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every row of pages, written to archives in
    the shared folder and read back from them; the archives are deleted again. An empty table gives no rows."""
    spark = pages.sparkSession
    tables.shared_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4()}"
    write_warc(pages, path, id_col, url_col, html_col, least)
    found = tables.cut(candidates(spark, path))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    out = found.join(reachable(found), ["path", "at"], "left_semi")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")
